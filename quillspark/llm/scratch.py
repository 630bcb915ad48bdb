"""Tables that cut lineage, in the folder that driver and executors share.

A scratch table is plain Parquet below ``spark.checkpoint.dir``, committed by Spark's own
output committer, so a lost executor costs a retry of its tasks and nothing else. Only
when the session names no folder (as in tests) is a temporary one made and set.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import caches


def root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a fresh temporary one if unset, which only a local session may do."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or spark.conf.get("quillspark.scratch.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("quillspark.scratch.dir", named)
    return named


def table(df: DataFrame, name: str, narrow: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` to a new scratch table; the table read back, and its path.

    ``narrow`` is for tables of a few numbers a row: at most two files for each core, however many
    shuffle partitions there are, since every file costs the store several calls. The stage that computes the table then runs
    in so many tasks, so it is for JVM-side joins and aggregations only, never above Python work.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    path = f"{root(spark)}/quill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for what is written meanwhile: whole texts are held a batch at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing will read any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        p = hadoop(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage: only then does Spark delete what finished plans have shuffled and broadcast."""
    caches.trim()  # plans that Python still names
    spark._jvm.System.gc()
