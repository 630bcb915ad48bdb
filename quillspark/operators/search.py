"""Boolean term search over postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import TOKEN, fold, query_terms


def search_terms(postings: DataFrame, terms: list[str], mode: str = "and", limit: int | None = None) -> DataFrame:
    """book_id ascending. No term matches nothing; an absent term is the empty set; ``limit`` cuts after ordering."""
    if mode not in ("and", "or"):
        raise ValueError(f"unknown mode {mode!r}")
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    terms = list(dict.fromkeys(terms))
    hits = postings.select("term", "book_id").where(F.col("term").isin(*terms) if terms else F.lit(False))
    if mode == "or" or len(terms) < 2:
        found = hits.select("book_id").distinct()
    else:
        found = hits.groupBy("book_id").agg(F.count_distinct("term").alias("k")).where(F.col("k") == len(terms)).select("book_id")
    found = found.orderBy("book_id")
    return found if limit is None else found.limit(limit)


def search(postings: DataFrame, query: str, mode: str = "and", limit: int | None = None) -> DataFrame:
    """A query text goes through the document pipeline first."""
    return search_terms(postings, query_terms(query), mode, limit)


def workload(postings: DataFrame, queries: DataFrame, mode: str = "and") -> DataFrame:
    """(query_id, book_id) for a table of (query_id, terms): one join for all queries.

    The distinct (query, term) pairs meet postings in an equi-join on the term, which
    adaptive execution broadcasts when the table of queries is small and splits when a term is hot.
    """
    wanted = queries.select("query_id", F.array_distinct("terms").alias("terms"))
    pairs = wanted.select("query_id", F.size("terms").alias("k"), F.explode("terms").alias("term"))
    hits = postings.select("term", "book_id").join(pairs, "term")
    if mode == "or":
        return hits.select("query_id", "book_id").distinct()
    return hits.groupBy("query_id", "book_id", "k").agg(F.count("*").alias("n")).where("n = k").select("query_id", "book_id")


def search_books(books: DataFrame, query: str, mode: str = "and", limit: int | None = None) -> DataFrame:
    """The same answer from (book_id, body) without an index: a scan and row-wise predicates, no join.

    A substring test on the folded text comes first and spares most rows the tokenizer.
    """
    if mode not in ("and", "or"):
        raise ValueError(f"unknown mode {mode!r}")
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    terms = query_terms(query)
    folded = books.select("book_id", fold(F.col("body")).alias("f"))
    hint = F.lit(mode == "and" and bool(terms))
    for t in terms:
        here = F.contains("f", F.lit(t))
        hint = hint & here if mode == "and" else hint | here
    met = F.size(F.array_intersect(F.regexp_extract_all("f", F.lit(TOKEN), F.lit(0)), F.array(*[F.lit(t) for t in terms]).cast("array<string>")))
    found = folded.where(hint).where(met == len(terms) if mode == "and" else met > 0).select("book_id").distinct().orderBy("book_id")
    return found if limit is None else found.limit(limit)
