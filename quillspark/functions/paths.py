"""Layout paths, buckets, file names, instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id6(book_id: Column) -> Column:
    """Six digits at least; longer ids are not cut."""
    text = book_id.cast("string")
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def hash_path(book_id: Column, part: str = "body") -> Column:
    six = id6(book_id)
    return F.concat_ws("/", F.lit("datalake"), F.substring(six, 1, 2), F.substring(six, 3, 2), F.concat(book_id.cast("string"), F.lit(f".{part}.txt")))


def book_path(book_id: Column, part: str = "body") -> Column:
    return F.concat(F.lit("datalake/books/"), book_id.cast("string"), F.lit(f"/{part}.txt"))


def time_path(book_id: Column, instant: Column, part: str = "body") -> Column:
    return F.concat(F.lit("datalake/"), F.date_format(instant, "yyyyMMdd/HH/"), book_id.cast("string"), F.lit(f".{part}.txt"))


def path(layout: str, book_id: Column, instant: Column, part: str = "body") -> Column:
    if layout == "time":
        return time_path(book_id, instant, part)
    if layout not in ("book", "hash"):
        raise ValueError(f"unknown layout {layout!r}")
    return (book_path if layout == "book" else hash_path)(book_id, part)


def bucket(term: Column) -> Column:
    """Upper-case ASCII initial, or an underscore."""
    return F.when(term.rlike("^[a-z]"), F.upper(F.substring(term, 1, 1))).otherwise(F.lit("_"))


def bucket_of(term: str) -> str:
    return term[0].upper() if term[:1].isascii() and term[:1].isalpha() and term[0].islower() else "_"


def safe_name(term: Column) -> Column:
    """Percent-encoding of what lies outside a-z and 0-9; legal terms hold none of the signs that url_encode spares."""
    return F.url_encode(term)


def term_of(name: Column) -> Column:
    return F.url_decode(name)


def instant_text(instant: Column) -> Column:
    """Whole UTC seconds."""
    return F.date_format(F.date_trunc("second", instant), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def inside(workspace: str, path: Column) -> Column:
    """A path below the workspace, relative to it; null for one that is not, or that climbs."""
    root = workspace.rstrip("/") + "/"
    bare = F.regexp_replace(path, "^file:/+", "/")
    rest = F.when(F.startswith(bare, F.lit(root)), F.substr(bare, F.lit(len(root) + 1))).when(~F.startswith(bare, F.lit("/")), bare)
    return F.when(~rest.rlike("(^|/)\\.\\.(/|$)"), rest)


def parse_instant(text: Column) -> Column:
    """ISO 8601; without a zone it is UTC (the session's zone). Null if malformed."""
    return F.date_trunc("second", F.try_to_timestamp(text))
