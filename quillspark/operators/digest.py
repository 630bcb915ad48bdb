"""Digests of whole tables, schema probes and captured plans."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_value(column: Column) -> Column:
    """A scalar as JSON."""
    whole = F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def lines(rows: DataFrame, key: str) -> DataFrame:
    """(key, line): every row as a JSON array."""
    said = F.concat(F.lit("["), F.concat_ws(", ", *[json_value(F.col(c)) for c in rows.columns]), F.lit("]\n"))
    return rows.select(F.col(key).alias("key"), said.alias("line"))


def content_digest(rows: DataFrame, key: str) -> tuple[int, str]:
    """Number of rows, and the SHA-256 of all of them as JSON lines in the order of a unique key.

    Lines are made and sorted by tasks; the driver only hashes them, and holds a partition at a time.
    """
    digest, n = hashlib.sha256(), 0
    for r in lines(rows, key).orderBy("key").toLocalIterator():
        digest.update(r["line"].encode())
        n += 1
    return n, digest.hexdigest()


def quick_digest(rows: DataFrame) -> DataFrame:
    """n and a digest that the order of rows does not change: one pass, partial aggregation, nothing on the driver."""
    return rows.select(F.xxhash64(*rows.columns).alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))


def probe(rows: DataFrame) -> list[tuple[str, str]]:
    """Columns and types, from the plan; nothing is read."""
    return rows.limit(0).dtypes


def plan(rows: DataFrame, mode: str = "formatted") -> str:
    """The plan's text, to be kept with a measurement."""
    jvm = rows.sparkSession._jvm
    return rows._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
