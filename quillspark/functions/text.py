"""Normalisation, tokens and filters.

Normalisation is NFKC, lower case, NFD without non-spacing marks, NFC. Catalyst has no Unicode
normalisation, but for texts of ASCII, Latin letters and common punctuation the whole chain is a
lower-casing and a character map, so those rows stay in the JVM; only the others' texts cross to an Arrow
function (the rest are sent as nulls). ``postings`` goes to Python with all texts: it groups a text's tokens where they are
made, by dictionary codes, so that no row a token is ever sorted or shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.fixed import STOP_WORDS

#: Word runs, joined by single apostrophes between word characters.
TOKEN = "[\\p{L}\\p{Nd}]+(?:['’][\\p{L}\\p{Nd}]+)*"
MIN_LENGTH, MAX_LENGTH = 2, 40


def normalize(text: str) -> str:
    """The full chain for one Python string."""
    if text.isascii():
        return text.lower()
    lowered = unicodedata.normalize("NFKC", text).lower()
    bare = "".join(c for c in unicodedata.normalize("NFD", lowered) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", bare)


@lru_cache(maxsize=1)
def _latin() -> tuple[str, str, str]:
    """Letters to map, what they map to, and a class of all characters the map is not right for."""
    plain, mapped = [], {}
    for c in map(chr, [*range(0xC0, 0x180), *range(0x2010, 0x2016), *range(0x2018, 0x201F), 0x2020, 0x2022, 0x20AC]):
        folded = normalize(c)
        if len(folded) == 1 and len(c.lower()) == 1:
            plain.append(c)
            if folded != c.lower():
                mapped[c.lower()] = folded
    # A few ranges: a class of some two hundred letters costs more to test than all the folding.
    ranges: list[list[str]] = []
    for c in plain:
        if ranges and ord(c) == ord(ranges[-1][1]) + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(mapped), "".join(mapped.values()), "[^\\x00-\\x7F" + "".join(a if a == b else f"{a}-{b}" for a, b in ranges) + "]"


def fold(text: Column) -> Column:
    """``normalize`` of a column; null stays null. The guard is evaluated once: what it lets through is what is not null after it."""
    source, target, odd = _latin()

    @F.pandas_udf("string")
    def full(rest: pd.Series) -> pd.Series:
        return rest.map(lambda t: None if t is None else normalize(t))

    rest = F.when((F.octet_length(text) > F.length(text)) & text.rlike(odd), text)
    return F.coalesce(full(rest), F.translate(F.lower(text), source, target))


def fold_latin(text: Column) -> Column:
    """``fold`` without the Arrow function: right for texts of ASCII and Latin letters only."""
    source, target, _ = _latin()
    return F.translate(F.lower(text), source, target)


def tokens_of(text: Column) -> Column:
    """Array of all tokens, in order, before any filter."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def kept(term: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Length in code points, not all digits, no stop word."""
    return F.length(term).between(MIN_LENGTH, MAX_LENGTH) & ~term.rlike("^\\p{Nd}+$") & ~term.isin(*stop_words)


def tokens(books: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS, key: str = "book_id", body: str = "body") -> DataFrame:
    """(book_id, pos, term) of kept tokens; positions count the dropped ones too."""
    rows = books.select(F.col(key).alias("book_id"), F.posexplode(tokens_of(F.col(body))).alias("pos", "term"))
    return rows.where(kept(F.col("term"), stop_words))


#: Bytes of text whose tokens a Python worker holds at a time; a longer text alone.
CHUNK = 4 << 20
#: Lower case, apostrophes, and a blank for every other byte of ASCII.
_BLANKED = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b == 0x27 else 0x20 for b in range(128)) + bytes(range(128, 256))


@lru_cache(maxsize=1)
def _plain() -> tuple[frozenset[str], re.Pattern, dict[int, str]]:
    """Characters of texts that ``_latin`` folds, ``TOKEN`` for those alone, and its map."""
    source, target, odd = _latin()
    guard = re.compile(odd.replace("\\x00", "\0").replace("\\x7F", "\x7f"))
    plain = frozenset(c for c in map(chr, range(0x2100)) if not guard.match(c))
    return plain, re.compile("[^\\W_]+(?:['’][^\\W_]+)*"), str.maketrans(source, target)


def pieces(text: bytes) -> list[str]:
    """All tokens of a UTF-8 text, before any filter; those of Latin letters are not mapped yet."""
    if text.isascii():
        text = text.translate(_BLANKED)
        if b"'" in text:  # one that is not between word characters is a blank
            text = b" %b " % text
            text = text.replace(b"''", b"  ").replace(b" '", b"  ").replace(b"' ", b"  ")
        return text.decode("ascii").split()
    plain, words, _ = _plain()
    decoded = text.decode("utf-8", "replace")
    if plain.issuperset(decoded):
        return words.findall(decoded.lower())
    import regex

    return regex.findall(TOKEN, normalize(decoded))


def _grouped(ids: pa.Array, texts: list[bytes], stop: frozenset[str], positions: bool) -> pa.RecordBatch:
    """The postings of some texts."""
    tokens: list[str] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        found = pieces(t)
        counts[i] = len(found)
        tokens += found
    coded = pa.array(tokens, pa.string()).dictionary_encode()
    # What holds of a term is found once for each distinct one; letters that are mapped may make two of them one.
    words = coded.dictionary
    odd = pc.invert(pc.string_is_ascii(words))
    words = pc.replace_with_mask(words, odd, pa.array([t.translate(_plain()[2]) for t in words.filter(odd).to_pylist()], pa.string())).dictionary_encode()
    known, remap = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.utf8_length(known).to_numpy(zero_copy_only=False)
    barred = pc.or_(pc.utf8_is_decimal(known), pc.is_in(known, pa.array(sorted(stop), pa.string()))).to_numpy(zero_copy_only=False)
    keep = (size >= MIN_LENGTH) & (size <= MAX_LENGTH) & ~barred.astype(bool)
    codes = remap[coded.indices.to_numpy(zero_copy_only=False)] if tokens else np.zeros(0, dtype=np.int64)
    chosen = np.flatnonzero(keep[codes]) if tokens else codes
    codes = codes[chosen]
    owner = np.repeat(np.arange(len(texts)), counts)[chosen]
    at = chosen - (np.cumsum(counts) - counts)[owner]
    key = owner * max(1, len(known)) + codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    ends = np.r_[starts, len(key)].astype(np.int32)
    first = order[starts]
    columns = [known.take(pa.array(codes[first])), ids.take(pa.array(owner[first])), pa.array(np.diff(ends).astype(np.int32))]
    names = ["term", "book_id", "tf"]
    if positions:
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order].astype(np.int32))))
        names.append("positions")
    return pa.RecordBatch.from_arrays(columns, names=names)


def postings(books: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS, positions: bool = True) -> DataFrame:
    """(term, book_id, tf, positions) of each row of (book_id, body), without a shuffle; null texts have none."""
    stop = frozenset(stop_words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, begin, held = batch.column("body").cast(pa.binary()), 0, 0
            texts: list[bytes] = []
            for i, body in enumerate(bodies):
                texts.append(body.as_py() or b"")
                held += len(texts[-1])
                if held >= CHUNK or i + 1 == len(bodies):
                    yield _grouped(batch.column("book_id").slice(begin, len(texts)), texts, stop, positions)
                    begin, held, texts = i + 1, 0, []

    schema = f"term string, book_id {books.schema['book_id'].dataType.simpleString()}, tf int" + (", positions array<int>" if positions else "")
    return books.select("book_id", F.col("body").cast("string").alias("body")).mapInArrow(work, schema)


def query_terms(raw: str, stop_words: tuple[str, ...] = STOP_WORDS) -> list[str]:
    """Distinct kept terms of a query text, in order; the same pipeline as a document's."""
    import regex

    found = regex.findall("[\\p{L}\\p{Nd}]+(?:['’][\\p{L}\\p{Nd}]+)*", normalize(raw))
    return list(dict.fromkeys(
        t for t in found if MIN_LENGTH <= len(t) <= MAX_LENGTH and not regex.fullmatch("\\p{Nd}+", t) and t not in stop_words))


def golden_differences(books: DataFrame, golden: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(book_id, fault) for books of a token fixture that are MISSING here, or whose RAW count, KEPT count or DIGEST differs."""
    mine = token_stats(books, stop_words).select("book_id", *[F.col(c).alias(f"my_{c}") for c in ("n_tokens_raw", "n_tokens_kept", "sha256_tokens")])
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"my_{c}"))
    fault = (F.when(F.col("my_n_tokens_raw").isNull(), "MISSING").when(differs("n_tokens_raw"), "RAW")
             .when(differs("n_tokens_kept"), "KEPT").when(differs("sha256_tokens"), "DIGEST"))
    return golden.join(mine, "book_id", "left").select("book_id", fault.alias("fault")).where("fault IS NOT NULL")


def token_stats(books: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Raw and kept token counts and the digest of the kept tokens, per book, without a shuffle."""
    rows = books.select("book_id", tokens_of(F.col("body")).alias("raw"))
    rows = rows.select("book_id", F.size("raw").cast("long").alias("n_tokens_raw"), F.filter("raw", lambda t: kept(t, stop_words)).alias("k"))
    return rows.select("book_id", "n_tokens_raw", F.size("k").cast("long").alias("n_tokens_kept"), F.sha2(F.array_join("k", "\n"), 256).alias("sha256_tokens"))
