"""Even work from small inputs.

Spark reads a Parquet row group in one task, however finely a file is split. An input of less than a row group for each
core would so leave most cores idle while one tokenises it all. Such an input, which is small by definition, is dealt
round robin once; larger ones have splits enough, and are read where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes for each core below which an input is dealt out.
LEAST = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows; in a partition for each core if the optimiser's estimate of their bytes is small."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < LEAST * cores else df
