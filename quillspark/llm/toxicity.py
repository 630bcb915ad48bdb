"""Toxicity by nearest labelled examples: TF-IDF cosine over all their words, by a block-max inverted index.

Labels are learnt from a sample (``SAMPLE`` documents and ``SAMPLE_CHARS`` characters at most: a documented bound;
chosen by hash, so it does not depend on how the table is laid out). Terms are *all* words of the sample, without
a selection. A term weighs (1 + log occurrences) x idf x relevance: document frequencies count all
documents, and the relevance is the square of the term's log odds between the classes, shrunk towards none by
``PRIOR`` pseudo-examples, plus ``FLOOR``. So a word that says nothing about the label still counts, and plain
TF-IDF, whose neighbours are ruled by chance meetings of rare words, is corrected by what labels show. Words that no
example has can meet nothing and are left out of a vector.

The examples lie in blocks of like ones; the order follows their heaviest terms and a hash, never a label.
The index has postings of every term, and for frequent terms each block's largest weight. A query adds up its
rarer terms exactly, bounds the others by the blocks' maxima, and then takes examples in the
order of these bounds until none can reach the k nearest: the result equals a full scan. Cosines are compared at nine decimals, and
all examples that tie with the k-th vote. Neighbours vote with the square of their cosine; a logistic curve, fitted to the votes
that the examples get from each other, calibrates the score. The nearest examples and the most telling
words met are returned as evidence.

Plan: one scan picks the sample (the bounded id list is broadcast), one counts document frequencies (a task returns
vectors of counts, cut into slices, which are added up as they stream by), one scores. No text but the sample's is shuffled;
skew of a source or of copies costs nothing.

Defined results: null and empty texts, and texts without a word of the sample, get the calibrated share of toxic examples; labels
that are null are ignored; a document labelled twice counts as toxic if either says so; a labelled id of several rows is one
example, its least text; with no toxic or no clean example the score is that share of the sample (0.5 without
labels); repeated rows are scored each; input columns are kept, result columns win over ones of their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import caches, scratch

SAMPLE, SAMPLE_CHARS, NEIGHBOURS, BLOCK = 8_000, 64_000_000, 15, 64
#: Pseudo-examples that shrink a term's log odds, and what a term weighs that tells nothing.
PRIOR, FLOOR = 20.0, 0.01
#: A term in more than this share of the examples is bounded by block maxima before it is added up.
FREQUENT = 1 / 32
SLICE, EVIDENCE = 1024, 5

_words = re.compile(r"[^\W_]+").findall


def bag(text: str | None) -> Counter:
    return Counter(_words(text.lower())) if text else Counter()


def _spread(lo: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places lo, lo + 1, ... of each run, one run after another."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - many), many)


class Index:
    """Unit vectors of the examples, as rows and by term, with block maxima of the frequent terms."""

    def __init__(self, n_terms: int, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """Example e holds ``terms[starts[e]:starts[e + 1]]``, ascending, and their weights."""
        n = len(starts) - 1
        many = np.bincount(terms, minlength=n_terms)
        frequent = np.flatnonzero(many > max(BLOCK, n * FREQUENT))
        self.row = np.full(n_terms, -1, dtype=np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.block = np.arange(n) // BLOCK
        example = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
        often = self.row[terms] >= 0
        # Rarer terms by term ...
        order = np.argsort(terms[~often], kind="stable")
        self.post_example, self.post_weight = example[~often][order], weights[~often][order]
        many[frequent] = 0
        self.post_start = np.concatenate(([0], np.cumsum(many)))
        # ... frequent ones by example, and their greatest weights by block.
        self.rows, self.row_weight = self.row[terms[often]], weights[often]
        self.row_start = np.concatenate(([0], np.cumsum(np.bincount(example[often], minlength=n))))
        self.tops = np.zeros((len(frequent), -(-n // BLOCK)))
        np.maximum.at(self.tops, (self.rows, self.block[example[often]]), self.row_weight)

    def __len__(self) -> int:
        return len(self.block)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples and of those that tie with the last; ``but`` is left out.

        Terms ascend, so like examples add up alike and tie exactly.
        """
        row = self.row[terms]
        often = row >= 0
        lo = self.post_start[terms[~often]]
        many = self.post_start[terms[~often] + 1] - lo
        at = _spread(lo, many)
        part = np.bincount(self.post_example[at], self.post_weight[at] * np.repeat(weights[~often], many), minlength=len(self)).astype(float)
        bound = part + (weights[often] @ self.tops[row[often]])[self.block] + 1e-8
        if but >= 0:
            bound[but] = 0
        query = np.zeros(len(self.tops))
        query[row[often]] = weights[often]

        def cosines(places: np.ndarray) -> np.ndarray:
            lo = self.row_start[places]
            many = self.row_start[places + 1] - lo
            at = _spread(lo, many)
            rest = np.bincount(np.repeat(np.arange(len(places)), many), self.row_weight[at] * query[self.rows[at]], minlength=len(places))
            return np.round(part[places] + rest, 9)

        step = 2 * k
        new = np.argpartition(-bound, step - 1)[:step] if step < len(self) else np.arange(len(self))
        places, found = [], []
        while len(new):
            places.append(new)
            found.append(cosines(new))
            bound[new] = 0
            have = np.concatenate(found)
            least = max(1e-9, np.partition(have, len(have) - k)[len(have) - k] if len(have) >= k else 0)
            new = np.flatnonzero(bound >= least)
            step *= 4  # the next best, and with luck all that are left
            if len(new) > step:
                new = new[np.argpartition(-bound[new], step - 1)[:step]]
        at = np.concatenate(places)
        near = (have >= least) & (at != but)
        at, have = at[near], have[near]
        order = np.lexsort((at, -have))
        if len(order) > k:
            order = order[have[order] >= have[order[k - 1]]]
        return at[order], have[order]


class Model:
    """Weights of the terms, the examples' index and the curve; small enough to go to every worker."""

    def __init__(self, names: pa.Array, weight: np.ndarray, index: Index | None, ids: np.ndarray, toxic: np.ndarray, prior: float) -> None:
        self.names, self.weight, self.index, self.ids, self.toxic, self.prior = names, weight, index, ids, toxic, prior
        self.curve: tuple[float, float] | None = None
        self.places: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"places": {}}

    def vector(self, found: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a bag, ascending, and their unit weights."""
        if not self.places:
            self.places = {t: i for i, t in enumerate(self.names.to_pylist())}
        terms = np.fromiter(map(self.places.get, found, repeat(-1)), dtype=np.int64, count=len(found))
        many = np.fromiter(found.values(), dtype=np.int64, count=len(found))
        order = np.argsort(terms)
        order = order[np.searchsorted(terms[order], 0) :]
        return terms[order], unit(self.weight[terms[order]], many[order])

    def vote(self, terms: np.ndarray, weights: np.ndarray, but: int = -1) -> tuple[float, np.ndarray]:
        """Share of toxic votes, and the nearest examples."""
        near, cosine = self.index.nearest(terms, weights, NEIGHBOURS, but)
        votes = cosine * cosine
        return float(votes @ self.toxic[near] / votes.sum()) if len(near) else self.prior, near

    def judge(self, text: str | None) -> tuple[float, list[int], list[str]]:
        """Score, nearest examples, most telling words met."""
        if self.curve is None:
            return self.prior, [], []
        terms, weights = self.vector(bag(text))
        v, near = self.vote(terms, weights)
        met = terms[np.lexsort((terms, -weights))[:EVIDENCE]]
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a * v + b)))), self.ids[near[:EVIDENCE]].tolist(), [self.names[i].as_py() for i in met.tolist()]


def unit(weight: np.ndarray, many: np.ndarray) -> np.ndarray:
    w = weight * (1 + np.log(np.maximum(many, 1)))
    return w / max(1e-300, math.sqrt(float(w @ w)))


def calibrate(votes: np.ndarray, toxic: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Logistic curve of the votes, by Newton steps on a lightly penalised likelihood."""
    x = np.stack([votes, np.ones_like(votes)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (toxic - p) - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _sample(docs: DataFrame, labels: DataFrame, size: int, chars: int) -> tuple[pa.Table, int]:
    """doc_id, toxic, terms and counts of the sampled documents, in the order of a hash of their ids."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # At most ``size`` rows of numbers: a proven bound for the broadcast.
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(size)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))
    held, path = scratch.table(held, "labelled")
    total, last = 0, None  # at most ``size`` rows
    for r in held.select("h", "doc_id", F.length("text").alias("n")).orderBy("h", "doc_id").collect():
        total += r["n"]
        if total > chars and last is not None:
            break
        last = r
    if last is not None:
        held = held.where((F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("doc_id") <= last["doc_id"]))

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caches.claim("toxicity")
        for batch in batches:
            found = [bag(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "h": batch["h"], "toxic": (batch["toxic"] == 1).astype("int32"),
                                "terms": [list(c) for c in found], "counts": [list(c.values()) for c in found]})

    # Bounded by ``chars``: an example has no more terms than characters.
    got = held.mapInPandas(bags, "doc_id long, h long, toxic int, terms array<string>, counts array<int>").toArrow()
    scratch.drop(spark, path)
    return got.sort_by([("h", "ascending"), ("doc_id", "ascending")]), got.num_rows


def _frequencies(docs: DataFrame, names: pa.Array) -> tuple[int, np.ndarray]:
    """Rows of ``docs``, and in how many of them each term is found."""
    n = len(names)
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caches.claim("toxicity")
        places = _places(shared)
        seen = np.zeros(n + 1, dtype=np.int64)
        for batch in batches:
            get = places.get
            met: list[int] = []
            for text in batch["text"]:
                if text:
                    met += [i for w in set(_words(text.lower())) if (i := get(w)) is not None]
                if len(met) > 1_000_000:
                    seen += np.bincount(met, minlength=n + 1)
                    met = []
            seen += np.bincount(np.array(met, dtype=np.int64), minlength=n + 1)
            seen[n] += len(batch)
        if seen[n]:
            cuts = range(0, n + 1, SLICE)
            yield pd.DataFrame({"slice": list(cuts), "n": [seen[i : i + SLICE].tobytes() for i in cuts]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch["slice"].tolist(), batch["n"]):
                part = np.frombuffer(part, dtype=np.int64)
                total[at] = total[at] + part if at in total else part
        yield pd.DataFrame({"slice": list(total), "n": [x.tobytes() for x in total.values()]})

    slices = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "slice long, n binary")
    out = np.zeros(n + 1, dtype=np.int64)
    for r in slices.repartition("slice").mapInPandas(add, "slice long, n binary").collect():  # a number for each term
        part = np.frombuffer(r["n"], dtype=np.int64)
        out[r["slice"] : r["slice"] + len(part)] += part
    shared.unpersist()
    return int(out[n]), out[:n]


#: What this worker has unpacked of a broadcast, by the broadcast.
_unpacked: dict[int, dict[str, int]] = {}
caches.register("toxicity", _unpacked.clear)


def _places(shared: Broadcast) -> dict[str, int]:
    key = id(shared.value)
    if key not in _unpacked:
        _unpacked.clear()
        _unpacked[key] = {t: i for i, t in enumerate(shared.value.to_pylist())}
    return _unpacked[key]


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Learn from labelled rows outside the held-out third; count frequencies over all ``docs``."""
    sample, n = _sample(docs, labels, size, chars)
    toxic = sample["toxic"].to_numpy().astype(float)
    if not n or toxic.min() == toxic.max():
        return Model(pa.array([], pa.string()), np.zeros(0), None, np.zeros(0, int), toxic, float(toxic.mean()) if n else 0.5)
    sizes = np.diff(sample["terms"].combine_chunks().offsets.to_numpy())
    coded = sample["terms"].combine_chunks().flatten().dictionary_encode()
    names, terms = coded.dictionary, coded.indices.to_numpy()
    many, ids = sample["counts"].combine_chunks().flatten().to_numpy(), sample["doc_id"].to_numpy()
    del sample, coded
    rows, df = _frequencies(docs, names)
    weight = (np.log((rows + 1) / (df + 1)) + 1) * _relevance(terms, sizes, toxic, len(names))
    order, starts, terms, many = _arranged(terms, many, sizes, weight)
    bounds = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
    weights = np.concatenate([unit(weight[terms[a:b]], many[a:b]) for a, b in bounds])
    del many
    caches.trim()
    model = Model(names, weight, Index(len(names), starts, terms, weights), ids[order], toxic[order], float(toxic.mean()))
    votes = np.array([model.vote(terms[a:b], weights[a:b], but=e)[0] for e, (a, b) in enumerate(bounds)])
    model.curve = calibrate(votes, model.toxic)
    del terms, weights
    caches.trim()
    return model


def _relevance(terms: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, n_terms: int) -> np.ndarray:
    """Squared log odds of a term between the classes, shrunk, plus the floor."""
    share = toxic.mean()
    bad = np.bincount(terms, np.repeat(toxic, sizes), minlength=n_terms)
    clean = np.bincount(terms, minlength=n_terms) - bad
    odds = np.log((bad + PRIOR * share) / (clean + PRIOR * (1 - share))) - math.log(share / (1 - share))
    return odds * odds + FLOOR


def _arranged(terms: np.ndarray, many: np.ndarray, sizes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The examples' new order, and their starts, terms (ascending) and counts in it: like heaviest terms share blocks, which keeps bounds tight."""
    n = len(sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    heavy = np.lexsort((-weight[terms], np.repeat(np.arange(n, dtype=np.int32), sizes))).astype(np.int32)
    key = np.full((4, n), -1)
    for place in range(4):
        there = sizes > place
        key[place, there] = terms[heavy[starts[there] + place]]
    order = np.lexsort((np.arange(n), *key[::-1]))  # ties stay in the order of a hash
    at = _spread(starts[order], sizes[order])
    terms, many = terms[at], many[at]
    sort = np.lexsort((terms, np.repeat(np.arange(n, dtype=np.int32), sizes[order])))
    return order, np.concatenate(([0], np.cumsum(sizes[order]))), terms[sort], many[sort]


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """All rows with score, predicted, evidence (nearest examples) and evidence_terms (words met, the heaviest first)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score:double,evidence:array<bigint>,terms:array<string>>")
    def judged(texts: pd.Series) -> pd.DataFrame:
        caches.claim("toxicity")
        found = [shared.value.judge(t) for t in texts]
        lists = {k: pd.Series([f[i] for f in found], dtype=object) for k, i in (("evidence", 1), ("terms", 2))}  # also for no rows
        return pd.DataFrame({"score": pd.Series([f[0] for f in found], dtype=float), **lists})

    kept = [f"`{c}`" for c in docs.columns if c not in ("score", "predicted", "evidence", "evidence_terms")]
    out = docs.select(*kept, judged(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("__j"))
    return out.select(*kept, F.col("__j.score").alias("score"), (F.col("__j.score") >= threshold).cast("int").alias("predicted"),
                      F.col("__j.evidence").alias("evidence"), F.col("__j.terms").alias("evidence_terms"))
