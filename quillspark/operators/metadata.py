"""The books table: records, upsert, queries."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import header
from quillspark.functions.fixed import LANGUAGES
from quillspark.schemas import BOOK_COLUMNS, BOOKS
from quillspark.sources.store import Store

#: A character that no LIKE pattern of ours holds, in place of Spark's backslash.
_ESCAPE = "\x01"


def records(books: DataFrame, languages: dict[str, str] = LANGUAGES) -> DataFrame:
    """(book_id, header, body, header_path, body_path, ingested_at) to rows of ``BOOKS``."""
    return books.select(
        "book_id", header.parse(F.col("header"), languages).alias("m"), "header_path", "body_path",
        F.octet_length("body").cast("long").alias("body_bytes"), F.sha2("body", 256).alias("sha256"), "ingested_at").select(
        "book_id", "m.title", "m.author", "m.language", "m.release_date", "header_path", "body_path", "body_bytes", "sha256", "ingested_at")


def meta_json(columns: list[str] = BOOK_COLUMNS) -> Column:
    """One line of JSON, keys in the order of the record."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """New records that are missing in ``old`` or differ from it."""
    rest = [c for c in BOOK_COLUMNS if c != "book_id"]
    same = F.lit(True)
    for c in rest:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    joined = new.alias("n").join(old.alias("o"), F.col("n.book_id") == F.col("o.book_id"), "left")
    return joined.where(F.col("o.book_id").isNull() | ~same).select(*[F.col(f"n.{c}").alias(c) for c in BOOK_COLUMNS])


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("book_id"), "book_id", "left_anti").select(BOOK_COLUMNS).unionByName(new.select(BOOK_COLUMNS))


def by_author(books: DataFrame, author: str) -> DataFrame:
    return books.where(F.col("author") == author)


def body_path(books: DataFrame, book_id: int) -> DataFrame:
    return books.where(F.col("book_id") == book_id).select("body_path")


def by_id(books: DataFrame, book_id: int) -> DataFrame:
    return books.where(F.col("book_id") == book_id)


def by_language(books: DataFrame, language: str) -> DataFrame:
    return books.where(F.col("language") == language)


def _ascii_lower(value: Column) -> Column:
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def title_like(books: DataFrame, prefix: str) -> DataFrame:
    """Prefix with ``%`` and ``_`` as wildcards; only ASCII letters ignore case; nothing escapes."""
    folded = "".join(c.lower() if c in string.ascii_uppercase else c for c in prefix) + "%"
    return books.where(F.like(_ascii_lower(F.col("title")), F.lit(folded), F.lit(_ESCAPE)))


def title_range(books: DataFrame, prefix: str) -> DataFrame:
    """Case-sensitive prefix as a range, which reaches the scan as min and max."""
    return books.where((F.col("title") >= prefix) & (F.col("title") < prefix + "\U0010ffff"))


def per_language(books: DataFrame) -> DataFrame:
    return books.groupBy("language").agg(F.count("*").alias("n"))


class BookStore:
    """The books table as versioned Parquet with a pointer file; a batch is committed whole or not at all."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    def read(self) -> DataFrame:
        if not self.store.exists("books.json"):
            return self.spark.createDataFrame([], BOOKS)
        return self.spark.read.schema(BOOKS).parquet(self.store.at(self.store.read("books.json")["version"]))

    def upsert(self, new: DataFrame) -> int:
        """Rows written; identical records write nothing, not even a version."""
        todo = changed(self.read(), new)
        n = todo.count()
        if not n:
            return 0
        version = f"books-{uuid.uuid4().hex}"
        upsert(self.read(), todo).orderBy("title").write.option("parquet.bloom.filter.enabled#author", "true").parquet(self.store.at(version))
        before = self.store.read("books.json") if self.store.exists("books.json") else None
        self.store.write("books.json", {"version": version, "stale": before["version"] if before else None})
        if before and before["stale"]:
            self.store.drop(before["stale"])
        return n
