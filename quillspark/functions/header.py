"""Header fields to a metadata struct, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.fixed import LANGUAGES, SPACES

_SPACE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES) + "]"


def collapse(value: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.btrim(F.regexp_replace(value, _SPACE + "+", " "), F.lit(" "))


def field(header: Column, name: str, wrapped: bool = True) -> Column:
    """The last occurrence of a field; blank lines do not end it, indented lines continue it. Null if absent."""
    more = "(?:\\n(?:[ \\t]*$|[ \\t]+\\S.*))*" if wrapped else ""
    found = F.regexp_extract_all(header, F.lit(f"(?im)^{name}:[ \\t]*(.*{more})"), F.lit(1))
    return collapse(F.try_element_at(found, F.lit(-1)))


def title(header: Column) -> Column:
    return F.coalesce(F.nullif(field(header, "Title"), F.lit("")), F.lit("Unknown"))


def without_lifespan(author: Column) -> Column:
    """``Surname, Given, 1775-1817`` without the years."""
    return F.regexp_replace(author, ",\\s*\\d{4}\\s*[-–]\\s*\\d{4}\\s*$", "")


def language(header: Column, languages: dict[str, str] = LANGUAGES) -> Column:
    value = F.lower(field(header, "Language"))
    codes = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, value), value)


def release_date(value: Column) -> Column:
    """``Month D, YYYY [...]`` to ISO; null if it is no date."""
    bare = F.regexp_extract(value, "^([A-Za-z]+ \\d{1,2}, \\d{4})(?: \\[.*\\])?$", 1)
    return F.date_format(F.try_to_date(F.nullif(bare, F.lit("")), "MMMM d, yyyy"), "yyyy-MM-dd")


def parse(header: Column, languages: dict[str, str] = LANGUAGES) -> Column:
    """struct(title, author, language, release_date)."""
    return F.struct(
        title(header).alias("title"), without_lifespan(field(header, "Author")).alias("author"),
        language(header, languages).alias("language"), release_date(field(header, "Release date", wrapped=False)).alias("release_date"))
