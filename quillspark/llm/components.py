"""Connected components by alternating large and small stars, as joins and aggregations.

Every round rewires each edge towards the least neighbour and halves paths; stars of
(node, least node) remain. The least neighbour is an aggregate with partial sums and comes back
by an equi-join, which adaptive execution splits where one node holds many edges: no
neighbourhood is ever gathered. Rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of longs: one row (id, component) for each node that is not the least of its component."""
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, path = scratch.table(e, "edges", narrow=True)
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), "m").where("u <> m").unionByName(least)
        e, new = scratch.table(small.select("u", F.col("m").alias("v")).distinct(), "edges", narrow=True)
        scratch.drop(spark, path)
        path, before, mark = new, mark, _mark(e)
        if mark == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
