"""Quality rules: a threshold table compiled into one native Spark projection.

``RULES`` is data. ``quality_rules`` turns it into one ``select`` whose every expression is
a built-in function over the row's own text: no shuffle, no Python, no user function. The
plan is a scan and projections, so it scales with the number of input splits and a skewed
source or a group of copies costs nothing extra.

Defined results: a null or empty text has no words, every count is 0, ``base_failed`` is
true and ``kept`` false. Repeated rows are judged one by one. Columns of the input other
than the text are handed through unless a result column has their name (the result wins).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word characters are everything but ASCII white space.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his are this at from or have an they which one you",
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie",
    "le la les de des du et en un une que qui dans pour est au sur par pas plus ce il se ne avec son",
    "el la los las de del y en un una que se por con para no su al lo como más es o sus le ha",
)


@dataclass(frozen=True)
class Rule:
    """A document passes if ``least <= measure <= most``; ``min_words`` exempts shorter ones."""

    name: str
    measure: str
    least: float = float("-inf")
    most: float = float("inf")
    min_words: int = 0


RULES = (
    Rule("words", "n_words", least=10),
    Rule("mean_word", "mean_word_chars", least=2.0, most=16.0),
    Rule("symbols", "symbol_ratio", most=0.3),
    Rule("stop_words", "stop_ratio", least=0.02, min_words=60),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5),
    Rule("repeated_words", "repeat_word_ratio", most=0.2),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column, windows: Column, n: int = 5) -> Column:
    """Words inside an n-word window that is found twice or more.

    The windows' hashes are sorted with their places; neighbours that agree are repeats.
    Sorted places then cover ``min(n, distance to the next place)`` words each.
    """
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marks(z: Column) -> Column:
        flagged = F.filter(
            F.zip_with(z, F.concat(F.slice(z, 2, F.greatest(F.size(z), F.lit(1))), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
            lambda p: p.isNotNull())
        places = F.array_sort(F.array_distinct(F.flatten(flagged)))
        return F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")),
            lambda s, p: F.struct((s["n"] + F.least(F.lit(n), p - s["last"])).alias("n"), p.alias("last")),
            lambda s: s["n"])

    # The cover is counted from the left: each place adds what it reaches beyond the one before.
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        F.get(F.transform(F.array(ranked), marks), F.lit(0)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append the counts and ratios that rules refer to."""
    taken = {*COUNTS, "mean_word_chars", "symbol_ratio", "stop_ratio", "dup_line_ratio", "repeat_word_ratio"}
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in taken]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    bare = F.translate(t, SPACE_CHARS, "")
    stop = F.array(*[F.lit(w) for w in sorted({w for line in STOP_WORDS for w in line.split()})])
    df = docs.select(
        *keep, t.alias("__t"),
        F.filter(F.split(t, SPACE), lambda w: w != "").alias("__w"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0).alias("__l"),
    )
    w = F.col("__w")
    windows = F.transform(
        F.when(F.size(w) >= 5, F.sequence(F.lit(0), F.size(w) - 5)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    df = df.select("*", windows.alias("__h"))
    df = df.select(
        "*", F.size(w).cast("long").alias("n_words"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(w, F.col("__h")).cast("long").alias("n_repeat_words"),
        F.size(F.filter(F.transform(w, lambda x: F.lower(x)), lambda x: F.array_contains(stop, x))).alias("__s"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    return df.select(
        *keep, *COUNTS,
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("__s") / n).alias("stop_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.size("__l"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / n).alias("repeat_word_ratio"),
    )


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All rows with their measures, ``base_failed``, ``failed_rules`` and ``kept``."""
    verdicts = []
    for r in rules:
        x = F.col(r.measure).cast("double")
        ok = (x >= F.lit(float(r.least))) & (x <= F.lit(float(r.most))) | (F.col("n_words") < r.min_words)
        verdicts.append(F.when(~ok, F.lit(r.name)))
    df = measure(docs.drop("base_failed", "failed_rules", "kept"), text)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.array_compact(F.array(*verdicts))
    return df.select("*", base.alias("base_failed"), failed.alias("failed_rules")).select(
        "*", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    The verdict passes through a one-element array: a filter on it must not be pushed below
    the projections, where every measure would be inlined, and computed, many times.
    """
    row = F.struct(*[f"`{c}`" for c in docs.columns]).alias("__row")
    judged = quality_rules(docs.select(row, F.col(f"`{text}`").alias("__text")), rules, "__text")
    return judged.select("__row", F.explode(F.array("kept")).alias("__kept")).where("__kept").select("__row.*")
