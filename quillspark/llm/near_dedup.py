"""Near-duplicate documents: Order MinHash sketches, banded alignment of shingles.

Words are runs of letters and digits in lower case. A shingle is five words in a row; equal
shingles of a document are told apart by their occurrence. For each of ``BANDS * ROWS``
hash functions the ``KEPT`` least shingles are taken *in text order* (Order MinHash), so
equal sketches speak for a common order, not only for common content. ``ROWS`` sketches
make a band; documents that agree in a band are candidates.

Similarity of two documents is m / (a + b - m): a and b shingles, m of them aligned in
order (longest common subsequence). At a similarity of 0.8 an alignment strays at
most (a + b) / 9 from the diagonal, so only that band is searched, without loss.

Documents of equal words are one row first. Within a bucket, candidates are not expanded into
pairs: a bucket's members are compared with its least document, what is linked is joined,
and then only documents outside the bucket's main component lead further rounds, about
``LEADERS`` in the first of them, twice as many in each that follows, and each in two, eight, then all of its buckets, until the bucket lies in one component or
all have led. So rounds grow with the logarithm of the largest bucket, not with its size. A group of n copies costs about n
comparisons, and every candidate pair is either compared, or already linked, or cannot reach 0.8:
after the first two rounds, the shingles that few of the remaining documents have (one, or up to ``SELDOM`` where a bucket is large) are set apart. Pairs that
reach 0.8 only with those are found by a join on them, where both have the shingle among their rarest (the prefix filter: what they share lies at or
after that place in both), and compared at once; the others of a document bound what it can
share with any partner of its bucket, so a large cluster's looser variants, which chance edits in common, lead no rounds. Sizes and least documents are partial aggregates, returned by an
equi-join that adaptive execution splits; no bucket is gathered into a task.

Recall is exact where the shorter text has at most ``SHORT`` shingles: such texts meet by the prefix filter, since
sampling from few shingles misses more. Above, it is that of the bands: with 28 bands of 2 sketches of 3 shingles, a pair
at exactly 0.8 is missed with a chance of about 2 in 10,000, above it less.

Defined results: a text without words is like equal texts only; one of fewer than five
words is one shingle; rows with the same doc_id are one document and one row of the result, the least of their texts; a null doc_id is alone; an empty table
gives no rows; other columns are ignored here and kept by ``drop_duplicates``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm import caches, exact_ids, scratch
from quillspark.llm.components import components

SHINGLE, BANDS, ROWS, KEPT = 5, 28, 2, 3
#: Up to so many shingles, candidates are found exactly.
SHORT = 32
#: So many documents of a bucket, about, lead in the round after the first; then twice as many in each round.
LEADERS = 64
#: Shingles that at most so many remaining documents have, and at most one in ``SELDOM_OF`` of the largest bucket's number, are met by a join of their own.
SELDOM, SELDOM_OF = 32, 64
#: Bits of a sieve for each id, and at most: 8 MB. It bounds what is broadcast, not what is found.
SIEVE, SIEVE_MOST = 32, 1 << 26
WORD_CACHE = 150_000

_words = re.compile(r"[^\W_]+").findall
_rng = np.random.default_rng(20_240_229)
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:  # the words met first are the frequent ones
            kept = list(islice(self.items(), WORD_CACHE // 2))
            self.clear()
            self.update(kept)
        value = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


_hashes = _WordHashes()
caches.register("near_dedup", _hashes.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[str]:
    return _words(text.lower())


def shingles(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of the word 5-grams, in text order; the whole text if it is shorter."""
    h = np.fromiter(map(_hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    n = len(h)
    if not n:
        return h
    if n < SHINGLE:
        return _mix(np.array([np.bitwise_xor.reduce(h * _PLACE[:n])], dtype=np.uint64))
    out = h[: n - SHINGLE + 1] * _PLACE[0]
    for k in range(1, SHINGLE):
        out = out + _mix(h[k : n - SHINGLE + 1 + k] * _PLACE[k])
    return _mix(out)


def labelled(s: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, its occurrence so far); a first occurrence keeps its hash, so texts with and without repeats share labels."""
    if len(np.unique(s)) == len(s):
        return s
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(first)
    nth = np.arange(len(s)) - starts[np.cumsum(first) - 1]
    out = np.empty_like(s)
    out[order] = np.where(nth > 0, _mix(ranked + nth.astype(np.uint64) * _PLACE[7]), ranked)
    return out


def bands(s: np.ndarray) -> np.ndarray:
    """The band keys of a document with at least ``KEPT`` shingles."""
    x = labelled(s)
    least = np.empty((BANDS * ROWS, KEPT), dtype=np.int64)
    step = max(1, 400_000 // len(x))
    for at in range(0, BANDS * ROWS, step):
        v = (x[None, :] ^ _XOR[at : at + step, None]) * _ODD[at : at + step, None]
        v ^= v >> np.uint64(32)
        rows = np.arange(len(v))
        for k in range(KEPT):
            place = np.argmin(v, axis=1)
            least[at : at + step, k] = place
            v[rows, place] = np.iinfo(np.uint64).max
    least.sort(axis=1)
    taken = x[least]  # in text order
    sketch = np.zeros(BANDS * ROWS, dtype=np.uint64)
    for k in range(KEPT):
        sketch = _mix(sketch + taken[:, k] * _PLACE[8 + k])
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _PLACE[15]
    for r in range(ROWS):
        key = _mix(key + sketch[r::ROWS])
    return key.view(np.int64)


def prefix(s: np.ndarray, least: float) -> np.ndarray:
    """Keys of a short document: two that reach ``least`` share one of their shingles that come first by hash (the prefix filter)."""
    first = np.sort(labelled(s))[: len(s) - math.ceil(least * len(s) - 1e-9) + 1]
    return _mix(first + _PLACE[14]).view(np.int64)


def meeting(s: np.ndarray, least: float) -> np.ndarray | None:
    """Where a document meets candidates. Of fewer than ``KEPT`` + 1 shingles, only equal texts can reach 0.8."""
    n = len(s)
    if n <= KEPT and least > KEPT / (KEPT + 1):
        return None
    found = [prefix(s, least)] if n <= max(KEPT, SHORT) / least else []
    if n > max(KEPT, SHORT):
        found.append(bands(s))
    return np.unique(np.concatenate(found)) if found else None


def aligned(a: np.ndarray, b: np.ndarray, stray: int, need: float = 0.0) -> int:
    """Longest common subsequence of a and b that stays within ``stray`` of the diagonal.

    Less than ``need`` may be returned for any result below it.
    """
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    lo, hi = np.searchsorted(ranked, a, side="left"), np.searchsorted(ranked, a, side="right")
    met = hi > lo
    if np.count_nonzero(met) < need:
        return 0
    if not (hi - lo > 1).any():
        i = np.flatnonzero(met)
        j = order[lo[i]]
        j = j[np.abs(i - j) <= stray]
        if len(j) < max(2, need) or (np.diff(j) > 0).all():
            return len(j)
        tails: list[int] = []
        for p in j.tolist():
            at = bisect_left(tails, p)
            if at == len(tails):
                tails.append(p)
            else:
                tails[at] = p
        return len(tails)
    values, many = np.unique(a, return_counts=True)
    _, x, y = np.intersect1d(values, ranked, return_indices=True)
    there = np.searchsorted(ranked, values[x], side="right") - np.searchsorted(ranked, values[x], side="left")
    if np.minimum(many[x], there).sum() < need:
        return 0
    # Repeated shingles: bit-parallel over the band alone, which moves by a place a row. A clear bit is a step up; those
    # that leave the band at its low end are counted.
    head = 0
    for same in (a[: len(b)] == b[: len(a)]).tolist():
        if not same:
            break
        head += 1
    if head == min(len(a), len(b)):
        return head
    places: dict[int, list[int]] = {}
    for j, v in enumerate(b[head:].tolist()):
        places.setdefault(v, []).append(j)
    windows = {v: [0, -stray, 0] for v in places}  # the value's places in the band, the band's low end, places seen
    top = 1 << 2 * stray
    full = row = 2 * top - 1
    for i, v in enumerate(a[head:].tolist()):
        if i:
            head += not row & 1
            row = row >> 1 | top
        if v not in windows:
            continue
        mask, low, seen = windows[v]
        mask, low, at = mask >> (i - stray - low), i - stray, places[v]
        while seen < len(at) and at[seen] <= i + stray:
            if at[seen] >= low:
                mask |= 1 << (at[seen] - low)
            seen += 1
        windows[v] = [mask, low, seen]
        if u := row & mask:
            row = (row + u | row - u) & full
    return head + 2 * stray + 1 - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: float = 0.8) -> bool:
    n = len(a) + len(b)
    need = least / (1 + least) * n - 1e-9
    if min(len(a), len(b)) < need:
        return False
    return aligned(a, b, int(n - 2 * need) + 1, need) >= need


@lru_cache(maxsize=64)
def _shingles_of(text: str) -> np.ndarray:
    return shingles(words(text))


def sketch(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, key (equal for equal words), n (shingles), bands."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caches.claim("near_dedup")
        for batch in batches:
            keys, sizes, found = [], [], []
            for text in batch["text"].tolist():
                w = words(text)
                keys.append(blake2b((" ".join(w) if w else "\0" + text).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                s = shingles(w)
                sizes.append(len(s))
                found.append(meeting(s, least) if len(s) else None)
            yield pd.DataFrame({"doc_id": exact_ids.received(batch), "key": keys, "n": sizes, "bands": found})

    rows = docs.select(*exact_ids.sent(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, key binary, n long, bands array<long>")


def _sieved(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose id is among ``ids`` and, by chance, a few others; texts are read where they lie, none is shuffled.

    Hashed ids are bits of a bitmap that is broadcast in blocks. Of the others one in ``SIEVE`` passes, and more above ``SIEVE_MOST / SIEVE`` ids:
    what needs the ids exactly joins on them afterwards.
    """
    n = ids.agg(F.approx_count_distinct("id")).first()[0]
    place = F.pmod(F.xxhash64("id"), F.lit(min(SIEVE_MOST, 1 << max(15, (SIEVE * n).bit_length())))) + 1
    # Dealt out by block first: a task then holds a block's bitmap once, and ids are shuffled, not bitmaps.
    places = ids.select(F.bitmap_bucket_number(place).alias("block"), F.bitmap_bit_position(place).alias("bit")).repartition("block")
    blocks = places.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    there = F.col("id").isNotNull() & (F.bitmap_bucket_number(place) == F.col("block")) & (F.getbit(byte, (bit % 8).cast("int")) == 1)
    return texts.join(F.broadcast(blocks), there, "left_semi")


def _verify(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Those pairs (doc, leader) whose texts align."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = _sieved(texts, pairs.select(F.explode(F.array("doc", "leader")).alias("id")))
    joined = (pairs.join(texts.withColumnsRenamed({"id": "doc", "text": "a"}), "doc")
              .join(texts.withColumnsRenamed({"id": "leader", "text": "b"}), "leader"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caches.claim("near_dedup")
        for batch in batches:
            ok = [similar(shingles(words(a)), _shingles_of(b), least) for a, b in zip(batch["a"].tolist(), batch["b"].tolist())]
            yield batch.loc[ok, ["doc", "leader"]]

    return joined.select("doc", "leader", "a", "b").mapInPandas(run, "doc long, leader long").distinct()


def _seldom(active: DataFrame, docs: DataFrame, most: int) -> tuple[DataFrame, str]:
    """doc, few: its shingles that at most ``most`` active documents have, as (many, s), the rarest first."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caches.claim("near_dedup")
        for batch in batches:
            yield pd.DataFrame({"doc": batch["doc"], "s": [labelled(shingles(words(t))).view(np.int64) for t in batch["text"].tolist()]})

    with scratch.batches(spark, 1000):
        rows, path = scratch.table(texts.join(active.select("doc").distinct(), "doc", "left_semi").mapInPandas(run, "doc long, s array<long>"), "shingles")
    rows = rows.select("doc", F.explode("s").alias("s"))
    many = rows.groupBy("s").agg(F.count("*").alias("many")).where(F.col("many") <= most)
    few = rows.join(many, "s").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("many", "s"))).alias("few"))
    seldom, seldom_path = scratch.table(few, "seldom")
    scratch.drop(spark, path)
    return seldom, seldom_path


def _rarest(seldom: DataFrame, free: DataFrame, least: float) -> DataFrame:
    """s, doc, n, free, c, at: the shingles by which a document can meet a partner first (the prefix filter), if another has them."""
    rows = free.select("doc", "n", "free", "c").distinct().join(seldom, "doc")
    first = F.expr(f"slice(few, 1, cast(n - ceil({least} * n - 1e-9) + 1 AS int))")
    return rows.select("doc", "n", "free", "c", F.posexplode(first).alias("at", "x")).where("x.many > 1").select("x.s", "doc", "n", "free", "c", "at")


def _meet(rarest: DataFrame, least: float) -> DataFrame:
    """Rows (doc, leader) for shingles at which the two can meet first and still share enough: rarest first, what two share lies at or after that place in both."""
    enough = f"{least / (1 + least)} * (n + ln) - 1e-6"
    return rarest.join(rarest.toDF("s", "leader", "ln", "lfree", "lc", "lat"), "s").where(
        f"doc > leader AND c <> lc AND least(n, ln) >= greatest(n, ln) * {least - 1e-9} AND least(free, lfree) < {enough} AND least(n - at, ln - lat) >= {enough}")


def _by_seldom(seldom: DataFrame, free: DataFrame, least: float) -> DataFrame:
    """Those pairs (doc, leader) that reach ``least`` only with shingles that few have, and share enough of them."""
    rarest, _ = scratch.table(_rarest(seldom, free, least), "rarest", narrow=True)
    met = _meet(rarest, least).select("doc", "leader", (F.col("n") + F.col("ln")).alias("both"), F.least("free", "lfree").alias("free")).distinct()
    few = seldom.select("doc", F.col("few.s").alias("few"))
    return met.join(few, "doc").join(few.toDF("leader", "lfew"), "leader").where(
        f"free + size(array_intersect(few, lfew)) >= {least / (1 + least)} * both - 1e-6").select("doc", "leader")


def _single(docs: DataFrame) -> DataFrame:
    """doc_id, text; the least text of an id that several rows have. Rows with a null id stay."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    often = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    if often.isEmpty():
        return rows
    often, _ = scratch.table(often, "repeated-ids", narrow=True)
    one = rows.join(often, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return scratch.table(rows.join(often, "doc_id", "left_anti").unionByName(one), "single")[0]


def _open(rows: DataFrame) -> DataFrame:
    """The rows of buckets that span several components."""
    spans = rows.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band")
    return rows.join(spans, "band", "left_semi")


def _joined(found: DataFrame, roots: DataFrame) -> DataFrame:
    """The components after the links that were found."""
    if found.isEmpty():
        return roots
    links = found.select(F.col("doc").alias("u"), F.col("leader").alias("v"))
    return components(links.unionByName(roots.select(F.col("id").alias("u"), F.col("component").alias("v"))))


def near_dedup(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id (least doc_id of its class) and kept, for every row."""
    spark = docs.sparkSession
    scratch.tidy(spark)  # what an operator before this one left on the driver
    docs = _single(docs)
    with scratch.batches(spark, 1000):
        all_docs, _ = scratch.table(sketch(docs, least), "sketches")
    reps = all_docs.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"))
    reps, _ = scratch.table(reps, "reps", narrow=True)
    chosen = all_docs.where("bands IS NOT NULL").join(reps, (all_docs["key"] == reps["key"]) & (all_docs["doc_id"] == reps["rep"]), "left_semi")
    rows = chosen.select(F.col("doc_id").alias("doc"), "n", F.explode("bands").alias("band"))
    met = rows.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band", F.col("c").alias("size"))
    # free: the shingles of a document that any partner may have. c: its component.
    active, active_path = scratch.table(rows.join(met, "band").distinct().select("band", "doc", "n", F.col("n").alias("free"), F.col("doc").alias("c"), F.col("size").alias("all")), "buckets", narrow=True)
    roots = spark.createDataFrame([], "id long, component long")
    every, every_path = scratch.table(active.groupBy("doc").agg(F.collect_list("band").alias("every")), "bands-of", narrow=True)  # at most BANDS each
    # Texts that meet no other are not read again.
    docs = _sieved(docs.withColumnRenamed("doc_id", "id"), every.select(F.col("doc").alias("id"))).withColumnRenamed("id", "doc_id")
    docs, docs_path = scratch.table(docs, "texts")
    need = least / (1 + least)
    fits = f"c <> lc AND doc <> leader AND least(n, ln) >= greatest(n, ln) * {least - 1e-9} AND least(free, lfree) >= {need} * (n + ln) - 1e-6"
    once = (" AND get(array_intersect(led, every), 0) = band AND size(array_except(array_intersect(every, levery), now)) = 0"
            " AND size(array_except(array_intersect(every, levery), lnow)) = 0")
    turn = 0
    while not active.isEmpty():
        sizes = active.groupBy("band", "c").agg(F.count("*").alias("k"), F.min("doc").alias("low")).groupBy("band").agg(
            F.max(F.struct("k", (-F.col("c")).alias("neg"))).alias("top"), F.sum("k").alias("size"), F.min("low").alias("low"))
        sizes = sizes.select("band", (-F.col("top.neg")).alias("main"), (F.col("size") - F.col("top.k")).alias("others"), "low", "size")
        # First the least document of each bucket leads; then documents outside its main component do, some at
        # a time, and each in a few of its smallest buckets only: once it is linked, the others need no more.
        step = max(1, min(turn, 24))  # its powers are longs
        many = LEADERS * 2 ** (step - 1)
        lead = F.col("doc") == F.col("low") if turn == 0 else (F.col("c") != F.col("main")) & (F.pmod(F.xxhash64("doc"), F.ceil(F.col("others") / many)) == 0)
        leaders = active.join(sizes, "band").where(lead | (F.col("doc") == F.when(F.col("others") > many, F.col("low"))))
        if turn:
            leaders = leaders.withColumn("at", F.row_number().over(W.partitionBy("doc").orderBy("size", "band"))).where(F.col("at") <= 2 ** (2 * step - 1))
        leaders = leaders.select("band", F.col("doc").alias("leader"), F.col("n").alias("ln"), F.col("free").alias("lfree"), F.col("c").alias("lc"))
        leaders, leaders_path = scratch.table(leaders, "leaders", narrow=True)
        members, leading = active, leaders
        if turn:
            # Each pair once: in the first bucket that its leader leads in now, and only while both are in all
            # buckets that they share. One that has left a shared bucket has met the other there, or need not.
            lists = active.groupBy("doc").agg(F.collect_list("band").alias("now")).join(every, "doc")
            members = active.join(lists, "doc")
            led = leaders.groupBy("leader").agg(F.sort_array(F.collect_list("band")).alias("led"))
            leading = leaders.join(led, "leader").join(lists.withColumnsRenamed({"doc": "leader", "now": "lnow", "every": "levery"}), "leader")
        pairs = members.join(leading, "band").where(fits + (once if turn else "")).select("doc", "leader")
        pairs = pairs.select(F.greatest("doc", "leader").alias("doc"), F.least("doc", "leader").alias("leader")).distinct()
        pairs, pairs_path = scratch.table(pairs, "pairs", narrow=True)
        with scratch.batches(spark, 1000):
            found, found_path = scratch.table(_verify(pairs, docs, least), "found")
        roots = _joined(found, roots)
        # A leader has met all others. A bucket goes on while it spans several components.
        left = active.where("all > 2") if turn == 0 else active  # two have met
        left = left.drop("c").join(leaders.select("band", F.col("leader").alias("doc")), ["band", "doc"], "left_anti")
        left = left.join(roots.withColumnRenamed("id", "doc"), "doc", "left").select("band", "doc", "n", "free", F.coalesce("component", "doc").alias("c"), "all")
        left, left_path = scratch.table(left, "left", narrow=True)
        rest, rest_path = scratch.table(_open(left), "buckets", narrow=True)
        scratch.drop(spark, active_path, found_path, leaders_path, pairs_path, left_path)
        active_path = rest_path
        if turn < 2 and not rest.isEmpty():
            # Pairs that need shingles which few have are found by those, now. A document goes on if its others
            # are enough for a partner of its bucket.
            most = max(1, min(SELDOM, rest.agg(F.max("all")).first()[0] // SELDOM_OF))
            seldom, seldom_path = _seldom(rest, docs, most)
            free = rest.join(seldom.select("doc", F.size("few").alias("few")), "doc", "left").select(
                "band", "doc", "n", (F.col("n") - F.coalesce("few", F.lit(0))).alias("free"), "c", "all")
            free, free_path = scratch.table(free, "free", narrow=True)
            if most > 1:
                pairs, pairs_path = scratch.table(_by_seldom(seldom, free, least), "pairs", narrow=True)
                with scratch.batches(spark, 1000):
                    found, found_path = scratch.table(_verify(pairs, docs, least), "found")
                roots = _joined(found, roots)
                scratch.drop(spark, pairs_path, found_path)
            shortest = free.groupBy("band").agg(F.min("n").alias("low"))
            able = free.join(shortest, "band").where(f"free >= {need} * (n + greatest(low, {least} * n)) - 1e-6").select("band", "doc", "n", "free", "c", "all")
            rest, active_path = scratch.table(able, "buckets", narrow=True)
            scratch.drop(spark, rest_path, free_path, seldom_path)
        active, turn = rest, turn + 1
        scratch.tidy(spark)
    scratch.drop(spark, active_path, every_path, docs_path)
    classes = reps.join(roots, reps["rep"] == roots["id"], "left").select("key", F.coalesce("component", "rep").alias("class_id"))
    out = all_docs.where("doc_id IS NOT NULL").select("doc_id", "key").join(classes, "key").select("doc_id", "class_id")
    alone = all_docs.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(alone).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose document stands for its class; null ids stay."""
    verdict = near_dedup(docs, least).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(verdict, docs["doc_id"].eqNullSafe(verdict["__kept"]), "left_semi")
