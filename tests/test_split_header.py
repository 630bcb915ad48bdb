from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import header, paths, split
from quillspark.functions.fixed import END_MARKER as E
from quillspark.functions.fixed import START_MARKER as S

CASES = {
    f"h\n{S} X\nbody  \n\n\n\nmore\n{E} X\nfoot": ("h\n", "body\n\nmore\n"),
    f"h\n{S}\n{E}\n": ("h\n", "\n"),
    f"﻿h\r\n  i\r\n{S} a\r\nq {E} inside\r\nlast\r\n{E}": ("h\n  i\n", f"q {E} inside\nlast\n"),
    f"h\r{S}\rx\ry\r{E}\r": ("h\n", "x\ny\n"),
    f"{E}\nx\n{S}\n": None, "no": None, f"h {S} x": None, "": None,
}


def test_split(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "book_id long, raw string").transform(split.split_books).orderBy("book_id").collect()
    for r, want in zip(rows, CASES.values()):
        assert (r["error"] == "NO_MARKERS") if want is None else (r["header"], r["body"], r["error"]) == (*want, None)


def test_decode_and_admission(spark):
    assert spark.createDataFrame([(b"a\xffb\xc3",)], "c binary").select(split.decode(F.col("c"))).first()[0] == b"a\xffb\xc3".decode(errors="replace")
    raws = ["x", f"{S}\n", f"{S}\n{E}", f"Language: French\n{S}\n{E}", f"Language: English\n{S}\nab{E}", f"Language: English\n{S}\n{'a' * 10000}{E}"]
    got = spark.createDataFrame(list(enumerate(raws)), "i int, r string").select("i", split.admission(F.col("r")).alias("a")).orderBy("i").collect()
    assert [r["a"] for r in got] == ["NO_START_MARKER", "NO_END_MARKER", "NO_LANGUAGE", "LANG_French", "TOO_SHORT", None]


@pytest.mark.parametrize(("head", "want"), [
    ("Title: A\n\n    B\nAuthor: Doe, J, 1900-1950\nLanguage: ENGLISH\nRelease Date: June 1, 1998 [eBook #2]", ("A B", "Doe, J", "en", "1998-06-01")),
    ("Author: X\nRelease date: Feb 30, 2020", ("Unknown", "X", None, None)),
    ("Title: x\n  Title: no\nTitle: y\nLanguage: Klingon", ("y", None, "klingon", None)),
    ("Title: T\nCredits: http://x\n    Author: no\nRelease Date: April 9, 2010\n  updated: later", ("T", None, None, "2010-04-09")),
])
def test_header(spark, head, want):
    r = spark.createDataFrame([(head,)], "h string").select(header.parse(F.col("h")).alias("m")).select("m.*").first()
    assert tuple(r) == want


def test_paths(spark):
    r = spark.createDataFrame([(1342, "l'été"), (12345678, "apple")], "i long, t string").select(
        paths.hash_path(F.col("i")), paths.bucket(F.col("t")), paths.safe_name(F.col("t")), paths.term_of(paths.safe_name(F.col("t")))).collect()
    assert tuple(r[0]) == ("datalake/00/13/1342.body.txt", "L", "l%27%C3%A9t%C3%A9", "l'été")
    assert r[1][0] == "datalake/12/34/12345678.body.txt"
