"""Small files on the driver (atomic writes, appends, lock) and text sources as DataFrames."""

from __future__ import annotations

import contextlib
import fcntl
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.split import decode
from quillspark.schemas import RECEIPTS


@contextlib.contextmanager
def atomic(target: str | Path) -> Iterator:
    """A binary file that appears whole: part file, flush, fsync, rename, fsync of the folder."""
    target = Path(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    with part.open("wb") as f:
        yield f
        f.flush()
        os.fsync(f.fileno())
    part.replace(target)
    folder = os.open(target.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def write_text(target: str | Path, text: str, if_changed: bool = False) -> bool:
    data = text.encode()
    if if_changed and Path(target).is_file() and Path(target).read_bytes() == data:
        return False
    with atomic(target) as f:
        f.write(data)
    return True


def append_line(target: str | Path, line: str) -> None:
    """Durable append."""
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    with open(target, "a", encoding="utf-8") as f:
        f.write(line + "\n")
        f.flush()
        os.fsync(f.fileno())


class Locked(RuntimeError):
    """Another writer holds the workspace."""


@contextlib.contextmanager
def writer_lock(path: str | Path) -> Iterator[None]:
    """An operating-system lock, released when the process dies."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise Locked(str(path)) from e
        yield


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, raw) of ``<id>.txt`` files; other names are ignored."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    name = F.regexp_extract("path", "/(\\d+)\\.txt$", 1)
    return files.where(name != "").select(name.cast("long").alias("book_id"), decode(F.col("content")).alias("raw"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, book_id) in file order; blank lines and comments dropped. One file, one task keeps the order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ordinal", "line"))
    lines = lines.withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    return lines.select(F.col("ordinal").cast("long").alias("ordinal"), F.col("line").try_cast("long").alias("book_id")).where("book_id IS NOT NULL")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The set of ids of a control file: first tab field, digits only; malformed lines are ignored."""
    if not Path(path).exists():
        return spark.createDataFrame([], "book_id long")
    first = F.split("value", "\t")[0]
    return spark.read.text(path).where(first.rlike("^[0-9]+$")).select(first.cast("long").alias("book_id")).distinct()


def read_receipts(spark: SparkSession, folder: str) -> DataFrame:
    if not Path(folder).is_dir() or not any(Path(folder).glob("*.json")):
        return spark.createDataFrame([], RECEIPTS)
    return spark.read.schema(RECEIPTS).json(f"{folder}/*.json")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One-column word lists (stop words): trimmed, no blanks, no comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("term")).where((F.col("term") != "") & ~F.col("term").startswith("#"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Token fixtures, a JSON line for each book."""
    return spark.read.schema("book_id long, n_tokens_raw long, n_tokens_kept long, sha256_tokens string").json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """name=code lines."""
    lines = read_lines(spark, path).where(F.col("term").contains("="))
    return lines.select(F.lower(F.trim(F.substring_index("term", "=", 1))).alias("name"), F.trim(F.substring_index("term", "=", -1)).alias("code"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV or JSON lines with values coerced to null where they do not fit."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)
    return spark.read.option("mode", "PERMISSIVE").schema(schema).json(path)
