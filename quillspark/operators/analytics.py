"""Corpus and benchmark analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.fixed import END_MARKER, START_MARKER
from quillspark.functions.header import field


def summary(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, quartiles (linear), IQR, p95, extremes and count for each configuration."""
    v = F.col(value).cast("double")
    q = runs.groupBy(*keys).agg(
        F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.95))).alias("q"))
    return q.select(*keys, "n", "least", "most", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
                    (F.col("q")[2] - F.col("q")[0]).alias("iqr"), F.col("q")[3].alias("p95"))


def flags(runs: DataFrame, keys: list[str], flag: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(flag)), "/").alias("flags"))


def pareto(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other beats on both measures (less is better), in one ordered pass.

    Sorted by x, a row survives if its y is below every y at a smaller x, and the least at its
    own x. The running minimum is taken within ranges of x first, so only one row a range meets
    in the second step.
    """
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = rows.select(F.percentile_approx(x, [i / parts for i in range(1, parts)], F.lit(1000))).first()[0] or []
    table = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    r = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__r", F.size(F.filter(table, lambda e: e <= F.col(x))))
    least = r.groupBy("__r").agg(F.min(y).alias("m"))
    before = least.withColumn("before", F.min("m").over(W.orderBy("__r").rowsBetween(W.unboundedPreceding, -1))).drop("m")
    r = r.join(F.broadcast(before), "__r")
    # The least y up to each x; a row is kept where it sets that minimum for the first time.
    upto = F.min(y).over(W.partitionBy("__r").orderBy(x).rangeBetween(W.unboundedPreceding, W.currentRow))
    r = r.withColumn("__upto", upto).where(F.col(y) == F.col("__upto"))
    r = r.withColumn("__first", F.min(x).over(W.partitionBy("__r", "__upto")))
    keep = (F.col(x) == F.col("__first")) & (F.col("before").isNull() | (F.col(y) < F.col("before")))
    return r.where(keep).drop("__r", "__upto", "__first", "before")


def throughput(rows: DataFrame, seconds: str, books: int = 1000) -> DataFrame:
    return rows.withColumn("per_second", F.lit(float(books)) / F.col(seconds))


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, as an aggregate: no window over a hot key."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("l")).select(*keys, *[F.col(f"l.{c}").alias(c) for c in (order, *rest)])


def align(frames: list[DataFrame]) -> DataFrame:
    """All rows under the union of columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def answers_agree(answers: DataFrame) -> DataFrame:
    """(query, engine, output) to the number of distinct outputs of each query."""
    return answers.groupBy("query").agg(F.count_distinct("output").alias("outputs"), F.count("*").alias("engines"))


def ranked_vocabulary(terms: DataFrame, n: int = 500) -> DataFrame:
    """The n most frequent terms with their rank, by (df descending, term)."""
    return terms.orderBy(F.desc("df"), "term").limit(n).withColumn("rank", F.row_number().over(W.orderBy(F.desc("df"), "term")))


def _ranks(terms: DataFrame, sizes: list[tuple[int, int]], first: int, last: int) -> DataFrame:
    """Terms of ranks ``first`` to ``last`` by (df descending, term). ``sizes``: terms of each df, descending.

    Frequencies that lie within the ranks whole are a filter; of the one or two at the edges, a sorted stretch.
    """
    whole, parts, seen = [], [], 0
    for df, n in sizes:
        lo, hi = max(first, seen + 1), min(last, seen + n)
        if lo == seen + 1 and hi == seen + n:
            whole.append(df)
        elif lo <= hi:
            parts.append((df, lo - seen - 1, hi - lo + 1))
        seen += n
    found = [terms.where(F.col("df").between(min(whole), max(whole)) if whole else F.lit(False))]
    return align([*found, *[terms.where(F.col("df") == df).orderBy("term").offset(skip).limit(n) for df, skip, n in parts]])


def band_members(terms: DataFrame, high: int = 500) -> DataFrame:
    """(band, term, df): the ``high`` most frequent; ``high`` after the first quarter; df of 2 or 3."""
    # A row for each frequency that occurs: far fewer than terms.
    sizes = sorted(((r["df"], r["n"]) for r in terms.groupBy("df").agg(F.count("*").alias("n")).collect()), reverse=True)
    start = max(high, sum(n for _, n in sizes) // 4)
    parts = [("high", _ranks(terms, sizes, 1, high)), ("mid", _ranks(terms, sizes, start + 1, start + high)), ("rare", terms.where(F.col("df").isin(2, 3)))]
    return align([p.select(F.lit(b).alias("band"), "term", "df") for b, p in parts])


def bands(terms: DataFrame, high: int = 500) -> DataFrame:
    """band, terms, least and greatest df of the bands that have terms."""
    return band_members(terms, high).groupBy("band").agg(F.count("*").alias("terms"), F.min("df").alias("least"), F.max("df").alias("most"))


def profile(books: DataFrame, body: str = "body") -> DataFrame:
    """Markers, bytes beyond ASCII, astral characters, replacement characters, apostrophes of each text."""
    t = F.coalesce(F.col(body), F.lit(""))
    marks = lambda m: ((F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))) / len(m)).cast("long")
    beyond = F.octet_length(F.regexp_replace(t, "[\\x00-\\x7F]+", "")).cast("long")
    return books.select("book_id", marks(START_MARKER).alias("n_start"), marks(END_MARKER).alias("n_end"), F.octet_length(t).cast("long").alias("n_bytes"),
                        F.length(t).cast("long").alias("n_chars"), beyond.alias("non_ascii"),
                        F.length(F.regexp_replace(t, "[^\\x{10000}-\\x{10FFFF}]+", "")).cast("long").alias("astral"), marks("�").alias("replacement"),
                        (F.length(t) - F.length(F.translate(t, "'’", ""))).cast("long").alias("apostrophes"))


def wrapped_fields(header: Column) -> Column:
    """Names, in lower case and sorted, of fields whose value goes on in lines that are no field themselves."""
    name = "^\\s*([A-Za-z][A-Za-z ]*?):"
    lines = F.filter(F.split(header, "\r\n|[\n\r]"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    # A line's field is the last name met up to it; the fold keeps that and what was continued.
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("more"))

    def step(s: Column, x: Column) -> Column:
        own = F.lower(F.btrim(F.regexp_extract(x, name, 1)))
        more = F.when((own == "") & (s["last"] != ""), F.array_union(s["more"], F.array(s["last"]))).otherwise(s["more"])
        return F.struct(F.when(own != "", own).otherwise(s["last"]).alias("last"), more.alias("more"))

    return F.aggregate(lines, start, step, lambda s: F.array_sort(s["more"]))


#: The categories of books that test an implementation, in their order.
TRAPS = ("end_marker_quoted", "start_marker_repeated", "no_author", "wrapped_field", "no_release_date", "odd_release_date", "non_ascii_title", "astral", "replacement")
EXTREMES = (("most_accents", "non_ascii", False), ("most_apostrophes", "apostrophes", False), ("shortest", "n_bytes", True), ("longest", "n_bytes", False))


def categories(books: DataFrame, top: int = 5) -> DataFrame:
    """(category, book_id) of (book_id, header, body): every book in each trap it sets, and the ``top`` of each extreme."""
    h = F.col("header")
    release = F.coalesce(field(h, "Release Date"), F.lit(""))
    rows = books.select("book_id", "body", h, F.coalesce(field(h, "Author"), F.lit("")).alias("author"), F.coalesce(field(h, "Title"), F.lit("")).alias("title"), release.alias("release"))
    measured = profile(books)
    flagged = rows.join(measured, "book_id")
    tests = (F.col("n_end") > 0, F.col("n_start") > 0, F.col("author") == "", F.size(wrapped_fields(F.col("header"))) > 0, F.col("release") == "",
             (F.col("release") != "") & ~F.col("release").rlike("^[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4} \\[eBook #[0-9]+\\]$"), F.col("title").rlike("[^\\x00-\\x7F]"),
             F.col("astral") > 0, F.col("replacement") > 0)
    named = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in zip(TRAPS, tests)]))
    out = [flagged.select("book_id", F.explode(named).alias("category")).select("category", "book_id")]
    for name, column, rising in EXTREMES:
        order = F.col(column).asc() if rising else F.col(column).desc()
        out.append(measured.orderBy(order, "book_id").limit(top).select(F.lit(name).alias("category"), "book_id"))
    return align(out)


def approved(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Runs that a row of the table of rules allows. Both have the rules' columns; a null in a rule allows any value."""
    fits = F.lit(True)
    for c in rules.columns:
        fits = fits & (F.col(f"r.{c}").isNull() | (F.col(f"l.{c}") == F.col(f"r.{c}")))
    # The first column of a rule is never null: an equi-join, and the others are checked on what meets.
    key = rules.columns[0]
    return runs.alias("l").join(rules.alias("r"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & fits, "left_semi")


def stable_sort(rows: DataFrame, keys: list[str]) -> DataFrame:
    """By several keys, nulls last; what ties is ordered by the other columns, so two runs agree."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in [*keys, *rest]])


def round_robin(rows: DataFrame, category: str, size: str, n: int) -> DataFrame:
    """n picks, category by category, smallest first, none twice.

    A category of n books alone fills n picks by its n-th turn, so no later turn can be picked and the n smallest of each
    category are all that is looked at.
    """
    one = rows.groupBy(category, "book_id").agg(F.min(size).alias(size))
    ranked = one.withColumn("turn", F.row_number().over(W.partitionBy(category).orderBy(size, "book_id"))).where(F.col("turn") <= n)
    first = ranked.groupBy("book_id").agg(F.min(F.struct("turn", category, size)).alias("p")).select("book_id", "p.*")
    return first.orderBy("turn", category).limit(n).select("book_id", category, size)
