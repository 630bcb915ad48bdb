"""Canonical export: one JSON object, bytes fixed, written in parts by tasks; the driver only strings the parts together."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import paths
from quillspark.operators.index import entries
from quillspark.sources.files import atomic
from quillspark.sources.store import Store, scratch


def _line() -> Column:
    """The text of an entry: ``"term":{"df":n,"postings":[...]}``."""
    key = F.expr("substring(k, 6, length(k) - 6)")  # of {"t":"..."}
    return F.concat(key, F.lit(':{"df":'), F.col("df").cast("string"), F.lit(',"postings":['), F.col("postings"), F.lit("]}"))


def _said() -> Column:
    return F.concat(F.to_json(F.struct(F.col("term").alias("t"))), F.lit(""))


def canonical_chunks(postings: DataFrame, positions: bool = True) -> Iterator[str]:
    """The text in pieces, terms in UTF-8 byte order; the driver holds a partition at a time."""
    rows = entries(postings, positions, ordered=True).withColumn("k", _said()).select(_line().alias("line"))
    yield "{"
    for i, r in enumerate(rows.toLocalIterator(prefetchPartitions=True)):
        yield ("," if i else "") + r["line"]
    yield "}"


def write_canonical(postings: DataFrame, place: str, positions: bool = True) -> None:
    """The text in a folder of parts, terms in UTF-8 byte order: all parts by name, one after the other, are the one text and a comma.

    ``postings`` should be stored: ranges of terms take a pass of their own over them.
    """
    rows = entries(postings, positions, ordered=True).withColumn("k", _said())
    ends = postings.agg(F.min("term").alias("first"), F.max("term").alias("last")).first()
    value = F.concat(F.when(F.col("term") == F.lit(ends["first"]), "{").otherwise(""), _line(), F.when(F.col("term") == F.lit(ends["last"]), "}").otherwise(""))
    rows.select(value.alias("value")).write.option("lineSep", ",").text(place)


def canonical_digest(spark: SparkSession, place: str) -> str:
    """SHA-256 of the text in ``write_canonical``'s folder, without its last comma. The JVM reads the parts; no byte of them comes to Python."""
    jvm, store = spark._jvm, Store(spark, place)
    parts = [(n, size) for n, size in store.files("") if n.startswith("part-") and size]
    found = jvm.java.security.MessageDigest.getInstance("SHA-256")
    if not parts:
        found.update(bytearray(b"{}"))
    for name, size in parts:
        stream = jvm.org.apache.commons.io.input.BoundedInputStream(store.open(name), size - (name == parts[-1][0]))
        try:
            jvm.org.apache.commons.codec.digest.DigestUtils.updateDigest(found, stream)
        finally:
            stream.close()
    return bytes(found.digest()).hex()


def export_canonical(postings: DataFrame, out: str, positions: bool = True) -> str:
    """Write the export atomically; its SHA-256."""
    digest = hashlib.sha256()
    with atomic(out) as f:
        for piece in canonical_chunks(postings, positions):
            data = piece.encode()
            digest.update(data)
            f.write(data)
    return digest.hexdigest()


def folder_lines(postings: DataFrame, positions: bool = True) -> DataFrame:
    """(bucket, name, content) of one file for each term."""
    tail = [F.array_join("positions", ",")] if positions else []
    line = F.concat_ws("\t", F.col("book_id").cast("string"), F.col("tf").cast("string"), *tail)
    rows = postings.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("book_id", F.concat(line, F.lit("\n")).alias("l")))).alias("ls"))
    return rows.select(paths.bucket(F.col("term")).alias("bucket"), paths.safe_name(F.col("term")).alias("name"),
                       F.array_join(F.transform("ls", lambda x: x["l"]), "").alias("content"))
