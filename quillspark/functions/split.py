"""Raw text to header and body, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.fixed import END_MARKER, SPACES, START_MARKER


def decode(content: Column) -> Column:
    """UTF-8 bytes to text, each malformed sequence replaced."""
    return F.make_valid_utf8(content.cast("string"))


def newlines(text: Column) -> Column:
    """No byte-order mark, LF only."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def clean_body(text: Column) -> Column:
    """The six steps, in order; an empty body is one LF."""
    lines = F.regexp_replace(newlines(text), "(?m)[ \\t]+$", "")
    return F.concat(strip(F.regexp_replace(lines, "\\n{3,}", "\n\n")), F.lit("\n"))


def clean_header(text: Column) -> Column:
    """Steps 1, 2, 5 and 6: indentation inside stays."""
    return F.concat(strip(newlines(text)), F.lit("\n"))


def split_text(raw: Column) -> Column:
    """struct(header, body, error): first START, last END; ``NO_MARKERS`` if one is missing or they are reversed."""
    text = newlines(raw)
    start = F.instr(text, START_MARKER)
    # The last END is the first one of the reversed text.
    back = F.instr(F.reverse(text), END_MARKER[::-1])
    end = F.length(text) - back - len(END_MARKER) + 2
    # The lines around the markers are left out whole.
    head = F.substr(text, F.lit(1), F.greatest(start - 1, F.lit(0)))
    header = F.substr(head, F.lit(1), F.length(head) - F.length(F.substring_index(head, "\n", -1)))
    rest = F.substr(text, start)
    first_line = F.length(F.substring_index(rest, "\n", 1)) + 1
    begin = start + first_line
    tail = F.substr(text, F.lit(1), end - 1)
    cut = F.length(tail) - F.length(F.substring_index(tail, "\n", -1))
    body = F.substr(text, begin, F.greatest(cut - begin + 1, F.lit(0)))
    bad = text.isNull() | (start == 0) | (back == 0) | (end <= start)
    return F.when(bad, F.struct(F.lit(None).cast("string").alias("header"), F.lit(None).cast("string").alias("body"), F.lit("NO_MARKERS").alias("error"))).otherwise(
        F.struct(clean_header(header).alias("header"), clean_body(body).alias("body"), F.lit(None).cast("string").alias("error")))


def split_books(raw: DataFrame) -> DataFrame:
    """(book_id, raw) to (book_id, header, body, error)."""
    return raw.select("book_id", split_text(F.col("raw")).alias("s")).select("book_id", "s.header", "s.body", "s.error")


def admission(raw: Column, least: int = 10_000) -> Column:
    """Why a raw text is not taken into a corpus; null if it is."""
    language = F.regexp_extract(F.substring_index(raw, START_MARKER, 1), "(?im)^Language:[ \\t]*(.*?)\\s*$", 1)
    after = F.substr(raw, F.instr(raw, START_MARKER) + len(START_MARKER))
    body = F.substr(after, F.lit(1), F.length(after) - F.instr(F.reverse(after), END_MARKER[::-1]) - len(END_MARKER) + 1)
    return (F.when(F.instr(raw, START_MARKER) == 0, "NO_START_MARKER").when(F.instr(raw, END_MARKER) == 0, "NO_END_MARKER")
            .when(language == "", "NO_LANGUAGE").when(F.lower(language) != "english", F.concat(F.lit("LANG_"), F.translate(F.substring(language, 1, 20), "\t", " ")))
            .when(F.length(body) < least, "TOO_SHORT"))
