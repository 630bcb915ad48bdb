"""Structured Streaming: new raw files to a lake table, lake table to index, each file once.

A checkpoint names what was read; the sinks replace a book's rows, so a batch that is repeated
after a crash leaves the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.split import decode, split_books
from quillspark.operators.index import Index


def raw_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(book_id, raw) of new ``<id>.txt`` files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_per_batch).load(folder)
    name = F.regexp_extract("path", "/(\\d+)\\.txt$", 1)
    return files.where(name != "").select(name.cast("long").alias("book_id"), decode(F.col("content")).alias("raw"))


def index_new(spark: SparkSession, folder: str, index: Index, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Split, clean and index whatever is new in a folder, then stop."""
    def commit(batch: DataFrame, _: int) -> None:
        books = split_books(batch).where("error IS NULL").select("book_id", "body")
        if not books.isEmpty():
            index.add(books)

    query = raw_stream(spark, folder, files_per_batch).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
