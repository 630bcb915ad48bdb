"""Samples and query workloads, the same for the same table and seed.

Whatever is drawn is drawn by the order of a seeded MD5 of its value: no random generator, no order of arrival, and
any engine can draw it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.analytics import align, band_members

#: For each workload its lines' bands, and how many lines there are of each kind.
MIXES = {
    "single": ((34, "high"), (33, "mid"), (33, "rare")),
    "and2": ((50, "high high"), (30, "high mid"), (20, "mid rare")),
    "and3": ((50, "high high high"), (30, "high mid mid"), (20, "mid mid rare")),
}
ABSENT = 100


def drawn(value: Column, seed: int = 42) -> Column:
    """The key that seeded draws are ordered by."""
    return F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string")))


def tier(ids: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A sample of n ids; a smaller one is contained in a larger one of the same seed."""
    return ids.select("book_id").distinct().orderBy(drawn(F.col("book_id"), seed), "book_id").limit(n)


def slots() -> list[tuple[str, int, int, str, int]]:
    """(workload, line, part, band, turn): which draw of a band stands where. No draw is used twice."""
    out, turn = [], {"high": 0, "mid": 0, "rare": 0}
    for workload, kinds in MIXES.items():
        lines = [kind.split() for n, kind in kinds for _ in range(n)]
        for line, parts in enumerate(lines):
            for part, band in enumerate(parts):
                turn[band] += 1
                out.append((workload, line, part, band, turn[band]))
    return out


def absent_terms(terms: DataFrame, n: int = ABSENT, seed: int = 42) -> DataFrame:
    """(line, query): n invented terms of 7 to 11 letters that the filters keep and no text has."""
    spark = terms.sparkSession
    letters = F.translate(drawn(F.concat(F.lit("absent "), F.col("id").cast("string")), seed), "0123456789", "ghijklmnop")
    made = spark.range(10 * n).select("id", F.substr(letters, F.lit(1), (7 + F.col("id") % 5).cast("int")).alias("term"))
    made = made.where(text.kept(F.col("term"))).groupBy("term").agg(F.min("id").alias("id")).join(terms.select("term"), "term", "left_anti")
    first = made.orderBy("id").limit(n)
    return first.select((F.row_number().over(W.orderBy("id")) - 1).alias("line"), F.col("term").alias("query"))


def build(terms: DataFrame, seed: int = 42) -> DataFrame:
    """(workload, line, query) from (term, df). A line whose bands have run out of terms is not made."""
    spark, wanted = terms.sparkSession, slots()
    most = max(s[4] for s in wanted)
    order = W.partitionBy("band").orderBy(drawn(F.col("term"), seed), "term")
    pool = band_members(terms).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most)
    parts = F.broadcast(spark.createDataFrame(wanted, "workload string, line int, part int, band string, turn int"))  # of fixed size
    lines = pool.join(parts, ["band", "turn"]).groupBy("workload", "line").agg(F.sort_array(F.collect_list(F.struct("part", "term"))).alias("p"))
    size = F.when(F.col("workload") == "and3", 3).when(F.col("workload") == "and2", 2).otherwise(1)
    lines = lines.where(F.size("p") == size).select("workload", "line", F.array_join(F.transform("p", lambda x: x["term"]), " ").alias("query"))
    return align([lines, absent_terms(terms, seed=seed).select(F.lit("absent").alias("workload"), "line", "query")])


def metadata_parameters(books: DataFrame, n: int = 100, languages: int = 10, seed: int = 42) -> DataFrame:
    """(kind, value): n authors, ids and title beginnings of ten characters, and up to ten languages."""
    start = F.substring("title", 1, 10)
    kinds = (("author", F.col("author"), n), ("book_id", F.col("book_id").cast("string"), n),
             ("prefix", F.when(F.length(start) == 10, start), n), ("language", F.col("language"), languages))
    parts = []
    for kind, value, most in kinds:
        rows = books.select(value.alias("value")).where("value IS NOT NULL").distinct()
        parts.append(rows.orderBy(drawn(F.col("value"), seed), "value").limit(most).select(F.lit(kind).alias("kind"), "value"))
    return align(parts)
