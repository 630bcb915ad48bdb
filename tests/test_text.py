from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import fixed, text


def machine(t: str) -> list[str]:
    """The token rule as a state machine over code points."""
    word = lambda c: unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd")
    out, buffer = [], ""
    for i, c in enumerate(t):
        joins = c in "'’" and 0 < i < len(t) - 1 and word(t[i - 1]) and word(t[i + 1])
        if word(c) or joins:
            buffer += c
        elif buffer:
            out.append(buffer)
            buffer = ""
    return [*out, buffer] if buffer else out


CASES = [("café", "cafe"), ("ﬁnd the ﬂow", "find the flow"), ("①②③", "123"), ("ＡＢＣ", "abc"), ("straße", "straße"), ("ÅNGSTRÖM", "angstrom"), ("ΟΔΟΣ", "οδος"), ("", "")]


def test_fold(spark):
    rows = spark.createDataFrame([(a,) for a, _ in CASES] + [(None,)], "t string").select(text.fold(F.col("t"))).collect()
    assert [r[0] for r in rows] == [b for _, b in CASES] + [None]


def test_tokens_equal_the_state_machine(spark):
    found: list[str] = []

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet="aZé'’ -1٣中ǅ²_😀\n", max_size=20))
    def gather(t):
        found.append(t)

    gather()
    rows = spark.createDataFrame([(t,) for t in found], "t string").select("t", text.tokens_of(F.col("t")).alias("l")).collect()
    for r in rows:
        assert r["l"] == machine(text.normalize(r["t"])), r["t"]


def test_filters_and_positions(spark):
    body = "The naïve Cafés don't open. a 1234 " + "x" * 41 + " " + "y" * 40
    rows = spark.createDataFrame([(1, body), (2, ""), (3, None)], "book_id long, body string")
    assert [(r["pos"], r["term"]) for r in text.tokens(rows).orderBy("pos").collect()] == [(1, "naive"), (2, "cafes"), (4, "open"), (8, "y" * 40)]
    assert text.query_terms(body + " open") == ["naive", "cafes", "open", "y" * 40]
    assert len(fixed.STOP_WORDS) == 175


@pytest.mark.parametrize("raw", ["the of", "12", "x", "", "!!"])
def test_queries_without_terms(raw):
    assert text.query_terms(raw) == []


def test_guard_is_evaluated_once(spark):
    plan = text.token_stats(spark.createDataFrame([(1, "é")], "book_id long, body string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("‐-―") == 1


def test_fold_of_every_plane(spark):
    rows = [(c, "a" + chr(c) + "Z") for c in [*range(0x80, 0x3000), *range(0xF900, 0xFFFE), *range(0x1D400, 0x1D800)]]
    got = spark.createDataFrame(rows, "c int, t string").select("t", text.fold(F.col("t")).alias("f")).collect()
    assert all(r["f"] == text.normalize(r["t"]) for r in got)
