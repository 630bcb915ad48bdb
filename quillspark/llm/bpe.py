"""Byte-level BPE by DuckDB recursive queries, one database in each worker process.

Encoding: a pattern splits a text into words. Words that are no token themselves become
tokens with positions (one byte each at first); a recursive query joins the rows of neighbouring
tokens with the merge table and contracts, in every word at once, the leftmost pair of least rank,
until no pair of a word merges. Each distinct word is encoded once while the bounded cache
holds it. Decoding: an ordered aggregation over a document's token rows concatenates bytes.

A word of more than ``LONG`` bytes would need a step for each merge. Whatever swallows a token before its pair merges is
a token itself, and no longer than the longest token that is found anywhere in the word, its reach. So a pair whose rank
is least within the reach on both sides merges at once with all others like it, equal neighbours in turn from the left,
and a word needs some tens of steps. The argument holds while no merge makes a pair of lower rank than its own; a
word where that happens is done again one pair at a time.

No shuffle; a task sees one Arrow batch at a time and holds at most ``TOKENS`` rows of
it in the database. The rank file is small and fixed; nothing grows with the input.

Defined results: null and empty texts have no ids, and decode to no bytes; any string
encodes, special-token strings being ordinary text; repeated rows are encoded each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, islice

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import caches, exact_ids

CACHE_LIMIT, WORDS, TOKENS, LONG = 500_000, 20_000, 1_000_000, 200

CONTRACT = """
WITH RECURSIVE t AS (
  SELECT w, list(tok ORDER BY pos) AS toks, true AS live FROM bytes_of GROUP BY w
  UNION ALL
  SELECT t.w,
         CASE WHEN best IS NULL THEN toks ELSE toks[: best & 4294967295] || [(best >> 32)::INT] || toks[(best & 4294967295) + 3 :] END,
         best IS NOT NULL
  FROM t LEFT JOIN (
    SELECT p.w, min((m.rank::BIGINT << 32) | p.pos) AS best
    FROM (SELECT w, unnest(range(len(toks) - 1)) AS pos, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r FROM t WHERE live) p
    JOIN merges m ON m.l = p.l AND m.r = p.r GROUP BY p.w) b ON b.w = t.w
  WHERE t.live)
SELECT w, toks AS ids, array_to_string(toks, ' ') AS text FROM t WHERE NOT live
"""

CONTRACT_LONG = """
WITH RECURSIVE t AS (
  SELECT w, any_value(reach) AS reach, list(tok ORDER BY pos) AS toks, list(pos ORDER BY pos) AS starts, list(-1 ORDER BY pos) AS ranks, true AS live, false AS odd
  FROM bytes_of JOIN reaches USING (w) GROUP BY w
  UNION ALL
  SELECT w, any_value(reach), list(tok ORDER BY i) FILTER (NOT gone), list(start ORDER BY i) FILTER (NOT gone), list(rank ORDER BY i) FILTER (NOT gone), bool_or(merged), any_value(odd)
  FROM (
    SELECT r.w, r.reach, r.i, r.start, coalesce(c.rank, r.tok) AS tok, coalesce(c.rank, r.rank) AS rank, r.odd OR coalesce(o.odd, false) AS odd,
           c.rank IS NOT NULL AS merged, coalesce(lag(c.rank) OVER (PARTITION BY r.w ORDER BY r.i), -1) >= 0 AS gone
    FROM (SELECT w, reach, odd, unnest(range(len(toks))) AS i, unnest(toks) AS tok, unnest(starts) AS start, unnest(ranks) AS rank FROM t WHERE live AND NOT odd) r
    LEFT JOIN (
      SELECT w, i, rank FROM (
        SELECT *, (row_number() OVER run - 1) % 2 = 0 AND first_value(rank = least) OVER run AS due FROM (
          SELECT *, i - row_number() OVER (PARTITION BY w, rank ORDER BY i) AS island FROM (
            SELECT p.w, p.i, m.rank, min(m.rank) OVER (PARTITION BY p.w ORDER BY p.at RANGE BETWEEN p.reach PRECEDING AND p.reach FOLLOWING) AS least
            FROM (SELECT w, reach, unnest(range(len(toks) - 1)) AS i, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, unnest(starts[2:]) AS at FROM t WHERE live AND NOT odd) p
            JOIN merges m ON m.l = p.l AND m.r = p.r))
        WINDOW run AS (PARTITION BY w, rank, island ORDER BY i))
      WHERE due AND rank = least) c ON c.w = r.w AND c.i = r.i
    LEFT JOIN (
      SELECT p.w, true AS odd
      FROM (SELECT w, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, unnest(ranks[:-2]) AS a, unnest(ranks[2:]) AS b FROM t WHERE live AND NOT odd) p
      JOIN merges m ON m.l = p.l AND m.r = p.r WHERE m.rank < greatest(p.a, p.b) GROUP BY p.w) o ON o.w = r.w)
  GROUP BY w)
SELECT w, toks AS ids, array_to_string(toks, ' ') AS text, odd FROM t WHERE odd OR NOT live
"""

CONCATENATE = """
SELECT doc, unhex(array_to_string(list(hex ORDER BY pos), '')) AS bytes FROM rows_of JOIN vocabulary USING (id) GROUP BY doc
"""


class RankBPE:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.words = regex.compile(pattern).findall
        self.beginnings = {t[:n] for t in self.ranks for n in range(2, len(t) + 1)}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items()
                  for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        left, right, rank = (pa.array(x, pa.int32()) for x in zip(*merges))
        self.db.register("m", pa.table({"l": left, "r": right, "rank": rank}))
        self.db.register("v", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        self.cache: dict[str, tuple[bytes, str]] = {}

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_LIMIT:  # the words met first are the frequent ones
            kept = list(islice(self.cache.items(), CACHE_LIMIT // 2))
            self.cache.clear()
            self.cache.update(kept)
            new = words.difference(self.cache)
        hard, raw, size, long = [], [], 0, []
        for word in new:
            b = word.encode()
            if (rank := self.ranks.get(b)) is not None:
                self.cache[word] = (rank.to_bytes(4, "little"), str(rank))
                continue
            if len(b) > LONG:
                long.append(word)
                continue
            hard.append(word)
            raw.append(b)
            size += len(b)
            if len(hard) >= WORDS or size >= TOKENS:
                self._contract(hard, raw)
                hard, raw, size = [], [], 0
        if hard:
            self._contract(hard, raw)
        for word in long:  # one at a time: its tokens alone may fill the database
            b = word.encode()
            self.db.register("reaches", pa.table({"w": pa.array([0], pa.int32()), "reach": pa.array([self.reach(b)], pa.int32())}))
            if self._contract([word], [b], CONTRACT_LONG):
                self._contract([word], [b])

    def reach(self, word: bytes) -> int:
        """The length of the longest token that is found in the word."""
        longest = 1
        for at in range(len(word)):
            end = at + 2
            while end <= len(word) and word[at:end] in self.beginnings:
                if end - at > longest and word[at:end] in self.ranks:
                    longest = end - at
                end += 1
        return longest

    def _contract(self, words: list[str], raw: list[bytes], query: str = CONTRACT) -> bool:
        """Encode words into the cache; true if the query gave one up."""
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        starts = np.cumsum(lengths) - lengths
        self.db.register("bytes_of", pa.table({
            "w": pa.array(np.repeat(np.arange(len(raw)), lengths), pa.int32()),
            "pos": pa.array(np.arange(lengths.sum()) - np.repeat(starts, lengths), pa.int32()),
            "tok": pa.array(self.single[np.frombuffer(b"".join(raw), dtype=np.uint8)])}))
        odd = False
        for batch in self.db.sql(query).to_arrow_table().to_batches():
            if query is CONTRACT_LONG and batch.column("odd").to_pylist()[0]:
                odd = True
                continue
            ids = batch.column("ids")
            flat = ids.values.to_numpy().astype("<u4").tobytes()
            ends = (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
            for w, lo, hi, text in zip(batch.column("w").to_pylist(), ends, ends[1:], batch.column("text").to_pylist()):
                self.cache[words[w]] = (flat[lo:hi], text)
        return odd

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids (little-endian unsigned 32-bit), and as decimal text."""
        split = [self.words(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        get = self.cache.__getitem__
        out = []
        for words in split:
            got = list(map(get, words))
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got])))
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """For each document's ids its bytes."""
        out = [b""] * len(ids)
        at = 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (end == at or size + len(ids[end]) // 4 <= TOKENS):
                size += len(ids[end]) // 4
                end += 1
            lengths = np.fromiter((len(x) // 4 for x in ids[at:end]), dtype=np.int64, count=end - at)
            self.db.register("rows_of", pa.table({
                "doc": pa.array(np.repeat(np.arange(at, end), lengths), pa.int32()),
                "pos": pa.array(np.arange(size) - np.repeat(np.cumsum(lengths) - lengths, lengths), pa.int32()),
                "id": pa.array(np.frombuffer(b"".join(ids[at:end]), dtype="<u4").astype(np.int32))}))
            for doc, b in self.db.execute(CONCATENATE).fetchall():
                out[doc] = b
            at = end
        return out


@lru_cache(maxsize=1)
def _codec(path: str, pattern: str) -> RankBPE:
    return RankBPE(path, pattern)


def codec(path: str, pattern: str) -> RankBPE:
    """One database and one cache for each worker process."""
    caches.claim("bpe")
    return _codec(path, pattern)


caches.register("bpe", _codec.cache_clear)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*exact_ids.sent(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array) of every document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = codec(path, pattern).encode(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": exact_ids.received(batch), "ids": [np.frombuffer(g, "<u4").astype(np.int32) for g, _ in got]})

    return _texts(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and decoded bytes of every row of ids."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [np.asarray(() if x is None else x, dtype="<u4").tobytes() for x in batch["ids"]]
            yield pd.DataFrame({"doc_id": exact_ids.received(batch), "bytes": codec(path, pattern).decode(ids)})

    return encoded.select(*exact_ids.sent(), "ids").mapInPandas(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids, and digest both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bpe = codec(path, pattern)
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                got = bpe.encode(part["text"].tolist())
                back = bpe.decode([g for g, _ in got])
                yield pd.DataFrame({
                    "doc_id": exact_ids.received(part),
                    "n_tokens": [len(g) // 4 for g, _ in got],
                    "ids_sha256": [sha256(t.encode()).hexdigest() for _, t in got],
                    "decoded_sha256": [sha256(b).hexdigest() for b in back]})

    return _texts(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
