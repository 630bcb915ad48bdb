"""Token-id files in Simple-8b: word-aligned packing of ids, written, then read back.

A 64-bit word holds a selector in its top four bits and 60 bits of payload: ``COUNTS[s]``
ids of ``60 // COUNTS[s]`` bits each, lowest bits first. Selectors 0 and 1 stand for runs of 240 and 120
zero ids; 15 holds one id of 60 bits, the escape for ids that fit nowhere else.

A file row is a block: whole documents in ascending order, their lengths, the words, and
the offset of the block's first id. Blocks decode on their own, by selector, without a loop over
ids. Blocks are rows of Parquet files, so Spark's committer makes the write atomic, a
lost executor's tasks are repeated, and any store that Spark reads will do.

Plan: quantiles of ``doc_id`` (one pass over that column) cut the ids into ranges that
do not grow with the data; one shuffle brings each range together; its task sorts it with spill, encodes and
writes. An id that more rows share than a range holds, or null, has several ranges.

Defined results: a null or empty text is the end id alone; a null doc_id comes first; rows of
one id follow each other in the order of their texts, or, where they have several ranges, so within each;
repeated rows are written each; an empty table gives an empty file set.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm import exact_ids, tokens

#: Ids for each selector of Simple-8b. 0 and 1 are runs of zeros.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BLOCK_IDS = 1 << 16
#: Ranges of ids for each task; several small ones spread more evenly than one.
RANGES = 4
#: The bits of small ids.
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)
#: ``nulls``: so many documents at the start of the block have no id, and stand as 0.
FILE_SCHEMA = "bucket int, block long, start long, doc_ids array<long>, nulls long, lengths array<long>, n_ids long, words binary"


def encode(ids: np.ndarray) -> np.ndarray:
    """64-bit words of ids below 2**60."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, dtype=np.uint64)
    if int(ids.max()) >> 60:
        raise ValueError("an id needs more than 60 bits")
    if int(ids.max()) < len(_BITS):
        bits = _BITS[ids]
    else:
        high = (ids >> np.uint64(30)).astype(np.float64)
        low = (ids & np.uint64((1 << 30) - 1)).astype(np.float64)
        bits = np.where(high > 0, 30 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.int8)
    # The selector of most ids that can start at a place wins.
    selector = np.full(n, 15, dtype=np.int8)
    for s in range(14, -1, -1):
        count, width = COUNTS[s], (0 if s < 2 else 60 // COUNTS[s])
        if count > n:
            break  # nor does any selector of more, narrower ids fit
        ok, held = bits <= width, 1  # whether the next ``held`` ids are narrow
        while 2 * held <= count:
            ok, held = ok[:-held] & ok[held:], 2 * held
        if held < count:
            ok = ok[: n - count + 1] & ok[count - held :]
        if not ok.any():
            break
        np.copyto(selector[: n - count + 1], s, where=ok)
    step = np.array(COUNTS, dtype=np.uint8)[selector].tobytes()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    at = np.array(starts)
    chosen = selector[at].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            width = 60 // COUNTS[s]
            lanes = ids[at[rows][:, None] + np.arange(COUNTS[s])]
            words[rows] |= np.bitwise_or.reduce(lanes << (np.arange(COUNTS[s]) * width).astype(np.uint64), axis=1)
    return words


def decode(words: np.ndarray) -> np.ndarray:
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[chosen]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            width = 60 // COUNTS[s]
            lanes = words[rows][:, None] >> (np.arange(COUNTS[s]) * width).astype(np.uint64) & np.uint64((1 << width) - 1)
            out[(ends[rows] - COUNTS[s])[:, None] + np.arange(COUNTS[s])] = lanes
    return out


def _rank(edges: list, x: Column) -> Column:
    """How many of the ascending ``edges`` are at or below ``x``: first among every 64th, then within a stretch of 64."""
    def below(column: Column) -> Column:
        return F.size(F.filter(column, lambda e: e <= x))

    if len(edges) <= 64:
        return below(F.array(*[F.lit(e) for e in edges]))
    stretches = [edges[i : i + 64] for i in range(0, len(edges), 64)]
    at = below(F.array(*[F.lit(s[0]) for s in stretches])) - 1
    held = F.get(F.array(*[F.array(*[F.lit(e) for e in s]) for s in stretches]), at)
    return F.when(at < 0, 0).otherwise(64 * at + below(held))


def _bucket(docs: DataFrame, parts: int) -> Column:
    """The range of a row, in the order of ids, null first. An id that many rows share, or null, has several, dealt by place in the input."""
    quantiles = f"percentile_approx(doc_id, array({', '.join(str(i / parts) for i in range(1, parts))}), 10000)" if parts > 1 else "array()"
    r = docs.agg(F.expr(quantiles).alias("edges"), F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    share = Counter(r["edges"] or [])
    edges = sorted(share)
    none = max(1, math.ceil(r["nulls"] * parts / max(1, r["rows"])))
    # An id that is several quantiles has so many ranges, and the ids after it another one.
    hot = [1] + [share[e] if share[e] > 1 else 1 for e in edges]
    first = [none]
    for n in hot:
        first.append(first[-1] + n + (n > 1))
    spot = F.monotonically_increasing_id()
    if not edges:
        place = F.lit(none)
    else:
        rank = _rank(edges, F.col("doc_id"))
        many, base = (F.get(F.array(*[F.lit(n) for n in x]), rank) for x in (hot, first))
        edge = F.get(F.array(*[F.lit(e) for e in [edges[0], *edges]]), rank)
        place = base + F.when(many == 1, 0).when(F.col("doc_id") == edge, F.pmod(spot, many)).otherwise(many)
    return F.when(F.col("doc_id").isNull(), F.pmod(spot, F.lit(none))).otherwise(place).cast("int")


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, parts: int | None = None) -> None:
    """Encode all documents in ascending doc_id order into block files below ``path``."""
    spark = docs.sparkSession
    parts = parts or max(1, min(1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(_bucket(rows, RANGES * parts).alias("bucket"), "doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.encoder(tokenizer, tokens.BYTE_CHUNKS)
        tail = np.array([end_id], dtype="<u4").tobytes()
        names = [x.split()[0] for x in FILE_SCHEMA.split(", ")]
        bucket, block, start, held = None, 0, 0, 0
        ids: list[bytes] = []
        doc_ids: list = []
        lengths: list[int] = []

        def block_row() -> pd.DataFrame:
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            words = encode(flat).astype("<u8").tobytes()
            return pd.DataFrame([(bucket, block, start, [d or 0 for d in doc_ids], doc_ids.count(None), list(lengths), len(flat), words)], columns=names)

        for batch in batches:
            for b, doc_id, text in zip(batch["bucket"].tolist(), exact_ids.listed(batch), batch["text"].tolist()):
                if ids and (b != bucket or held >= BLOCK_IDS):
                    yield block_row()
                    block, start, held = block + 1, start + held, 0
                    ids, doc_ids, lengths = [], [], []
                if b != bucket:
                    bucket, block, start = b, 0, 0
                got = b"".join(enc.encode(text)[1]) + tail
                ids.append(got)
                doc_ids.append(doc_id)
                lengths.append(len(got) // 4)
                held += lengths[-1]
        if ids:
            yield block_row()

    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "text")
    dealt.select("bucket", *exact_ids.sent(), "text").mapInPandas(run, FILE_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One row a range: a running sum over at most ``parts`` rows.
    totals = blocks.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    before = totals.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                flat = decode(np.frombuffer(r.words, dtype="<u8")).astype("<u4").tobytes()
                ends = np.cumsum(np.asarray(r.lengths, dtype=np.int64))
                starts = ends - np.asarray(r.lengths, dtype=np.int64)
                yield pd.DataFrame({
                    "doc_id": pd.arrays.IntegerArray(np.array(r.doc_ids, dtype=np.int64), np.arange(len(r.doc_ids)) < r.nulls),
                    "start": starts + r.start + r.before,
                    "n_tokens": ends - starts,
                    "ids": [flat[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())],
                })

    joined = blocks.join(F.broadcast(before), "bucket").select("start", "doc_ids", "nulls", "lengths", "words", "before")
    return joined.mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")

