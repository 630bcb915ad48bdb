"""Set algebra over control state, and the recoveries built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.paths import instant_text


def pending(downloaded: DataFrame, indexed: DataFrame) -> DataFrame:
    """Downloaded, not yet indexed; ascending."""
    return downloaded.select("book_id").distinct().join(indexed.select("book_id"), "book_id", "left_anti").orderBy("book_id")


def scan_new(lake: DataFrame, indexed: DataFrame, since: str | None = None) -> DataFrame:
    """Ids in the lake (book_id, ingested), not indexed, ingested at or after ``since``."""
    rows = lake if since is None else lake.where(F.col("ingested") >= F.lit(since).cast("timestamp"))
    return pending(rows, indexed)


def scan_hours(lake: DataFrame, date: str, hour: str) -> DataFrame:
    """Rows of (date, hour) directories from an hour on; written so that both partition columns prune."""
    return lake.where((F.col("date") > date) | ((F.col("date") == date) & (F.col("hour") >= hour)))


def candidates(manifest: DataFrame, downloaded: DataFrame, failed: DataFrame) -> DataFrame:
    """(ordinal, book_id) not tried yet, in the order of the manifest, each id once."""
    first = manifest.groupBy("book_id").agg(F.min("ordinal").alias("ordinal"))
    known = downloaded.select("book_id").unionByName(failed.select("book_id"))
    return first.join(known, "book_id", "left_anti").orderBy("ordinal")


def reconcile(headers: DataFrame, bodies: DataFrame, downloaded: DataFrame, indexed: DataFrame) -> DataFrame:
    """(book_id, state): kept, added, dropped (of downloaded) and indexed ids after recovery.

    Complete books have both parts; ``downloaded`` becomes those, ``indexed`` is cut to them.
    """
    whole = headers.select("book_id").distinct().join(bodies.select("book_id").distinct(), "book_id")
    said = downloaded.select("book_id").distinct()
    parts = [
        (whole.join(said, "book_id", "left_semi"), "kept"), (whole.join(said, "book_id", "left_anti"), "added"),
        (said.join(whole, "book_id", "left_anti"), "dropped"), (indexed.select("book_id").distinct().join(whole, "book_id", "left_semi"), "indexed"),
    ]
    out = None
    for rows, state in parts:
        rows = rows.select("book_id", F.lit(state).alias("state"))
        out = rows if out is None else out.unionByName(rows)
    return out


def receipt_errors(receipts: DataFrame, lake: DataFrame) -> DataFrame:
    """(book_id, error) for books of the lake without a receipt that fits: paths and whole UTC seconds."""
    joined = lake.select("book_id", F.col("header_path").alias("h"), F.col("body_path").alias("b")).join(receipts, "book_id", "left")
    error = (F.when(F.col("ingested_at").isNull(), "MISSING")
             .when(~F.col("ingested_at").rlike("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z$"), "INSTANT")
             .when((F.col("header_path") != F.col("h")) | (F.col("body_path") != F.col("b")), "PATHS"))
    return joined.select("book_id", error.alias("error")).where("error IS NOT NULL")


def recovered_instant(mtime, date=None, hour=None):
    """The body's modification time; in a time layout the start of its hour if it lies in another."""
    if date is None:
        return instant_text(mtime)
    inside = F.date_format(mtime, "yyyyMMddHH") == F.concat(date, hour)
    start = F.try_to_timestamp(F.concat(date, hour), F.lit("yyyyMMddHH"))
    return instant_text(F.when(inside, mtime).otherwise(start))
