from __future__ import annotations

import hashlib
import itertools
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import control, export, metadata, search
from quillspark.operators.index import Index, build_postings, corpus_frequency, document_frequency, read_canonical, upsert_postings
from quillspark.schemas import BOOKS

BODIES = {11: "whale ship whale", 22: "ship sea", 33: "whale sea café"}


def books(spark, bodies=BODIES):
    return spark.createDataFrame(list(bodies.items()), "book_id long, body string")


def rows(df):
    return sorted((r["term"], r["book_id"], r["tf"], tuple(r["positions"] or ())) for r in df.collect())


def ids(df):
    return [r["book_id"] for r in df.collect()]


@pytest.mark.parametrize(("q", "mode", "limit", "want"), [
    ("whale", "and", None, [11, 33]), ("whale ship", "and", None, [11]), ("WHALE whale", "and", None, [11, 33]), ("whale sea", "or", None, [11, 22, 33]),
    ("whale nosuch", "and", None, []), ("whale nosuch", "or", None, [11, 33]), ("the of", "or", None, []), ("sea ship", "or", 2, [11, 22]), ("sea", "or", 0, []),
])
def test_search(spark, q, mode, limit, want):
    assert ids(search.search(build_postings(books(spark)), q, mode, limit)) == want
    assert ids(search.search_books(books(spark), q, mode, limit)) == want


def test_search_refuses(spark):
    with pytest.raises(ValueError):
        search.search_terms(build_postings(books(spark)), ["sea"], "and", -1)


@pytest.mark.parametrize("layout", Index.LAYOUTS)
def test_layouts(spark, tmp_path, layout):
    index = Index(spark, str(tmp_path), layout)
    with pytest.raises(FileNotFoundError):
        index.postings()
    first, second = {k: BODIES[k] for k in (11, 22)}, {33: BODIES[33]}
    index.add(books(spark, first))
    index.add(books(spark, second))
    index.add(books(spark, second))
    want = rows(build_postings(books(spark)))
    assert rows(index.postings()) == want
    assert index.df("whale") == 2 and index.df("nosuch") == 0
    assert [r[0] for r in index.vocabulary().collect()] == ["cafe", "sea", "ship", "whale"]
    assert ids(search.search_terms(index.of(["whale", "ship"]), ["whale", "ship"])) == [11]
    index.add(books(spark, {11: "sea"}))
    assert rows(index.postings()) == rows(build_postings(books(spark, {**BODIES, 11: "sea"})))
    with pytest.raises(ValueError):
        Index(spark, str(tmp_path), layout, positions=False)


def test_segments(spark, tmp_path, monkeypatch):
    """An update writes its batch alone; readers of the state before keep their files; compaction changes no row."""
    monkeypatch.setattr(Index, "SEGMENTS", 3)
    index = Index(spark, f"file://{tmp_path}", "clustered")
    bodies = dict(BODIES)
    index.add(books(spark))
    old = index.postings()
    for i, body in ((11, "sea"), (44, "whale"), (22, ""), (44, "ship ship")):
        written = set(p.name for p in tmp_path.iterdir())
        bodies[i] = body
        index.add(books(spark, {i: body}))
        assert rows(index.postings()) == rows(build_postings(books(spark, bodies)))
        assert len({p.name for p in tmp_path.iterdir() if p.is_dir()} - written) <= 2
        if i == 11:
            assert rows(old) == rows(build_postings(books(spark)))
    assert len(index._state()["segments"]) < 3
    index.compact()
    assert len(index._state()["segments"]) == 1 and rows(index.postings()) == rows(build_postings(books(spark, bodies)))
    assert [(r["term"], r["book_id"]) for r in index.ordered().collect()] == [(t, b) for t, b, *_ in rows(index.postings())]


def test_scan_prunes_and_pushes(spark, tmp_path):
    index = Index(spark, str(tmp_path), "clustered")
    index.add(books(spark))
    plan = search.search_terms(index.of(["whale", "ship"]), ["whale", "ship"])._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan and "positions" not in plan.split("ReadSchema")[1].split("\n")[0] and "Python" not in plan


def test_canonical(spark, tmp_path):
    postings = build_postings(books(spark, {2: "beta α", 1: "beta gamma beta"}))
    digest = export.export_canonical(postings, str(tmp_path / "out.json"))
    data = (tmp_path / "out.json").read_bytes()
    assert data == b'{"beta":{"df":2,"postings":[[1,2,[0,2]],[2,1,[0]]]},"gamma":{"df":1,"postings":[[1,1,[1]]]}}'
    assert digest == hashlib.sha256(data).hexdigest()
    assert json.loads("".join(export.canonical_chunks(postings, False)))["beta"]["postings"] == [[1, 2], [2, 1]]
    files = {(r["bucket"], r["name"]): r["content"] for r in export.folder_lines(postings).collect()}
    assert files["B", "beta"] == "1\t2\t0,2\n2\t1\t0\n"


def test_workload_and_df(spark):
    p = build_postings(books(spark))
    q = spark.createDataFrame([(1, ["whale", "ship"]), (2, ["sea", "sea"]), (3, [])], "query_id int, terms array<string>")
    assert sorted(tuple(r) for r in search.workload(p, q).collect()) == [(1, 11), (2, 22), (2, 33)]
    assert {r["term"]: r["df"] for r in document_frequency(p).collect()} == {"whale": 2, "ship": 2, "sea": 2, "cafe": 1}
    assert sorted(map(tuple, corpus_frequency(books(spark)).collect())) == sorted(map(tuple, document_frequency(p).collect()))
    assert rows(upsert_postings(p, build_postings(books(spark, {11: "sea"})), books(spark, {11: ""}))) == rows(build_postings(books(spark, {**BODIES, 11: "sea"})))


def test_store_writes_only_changes(spark, tmp_path):
    store = metadata.BookStore(spark, str(tmp_path))
    rec = lambda i, t, a: (i, t, a, "en", None, "h", "b", 1, "s", "2026-01-01T00:00:00Z")
    new = spark.createDataFrame([rec(1, "Àa", "x"), rec(2, "a_b", None)], BOOKS)
    assert store.upsert(new) == 2
    before = sorted(p.name for p in tmp_path.iterdir())
    assert store.upsert(new) == 0 and sorted(p.name for p in tmp_path.iterdir()) == before
    assert store.upsert(spark.createDataFrame([rec(2, "a_c", None), rec(3, "B\\d", "y")], BOOKS)) == 2
    b = store.read()
    assert b.count() == 3
    assert ids(metadata.title_like(b, "A_C")) == [2] and ids(metadata.title_like(b, "àA")) == [] and ids(metadata.title_like(b, "b\\")) == [3]
    assert ids(metadata.title_range(b, "a_")) == [2] and metadata.per_language(b).first()["n"] == 3
    assert b.where("book_id = 1").select(metadata.meta_json().alias("j")).first()["j"].startswith('{"book_id":1,"title":"Àa","author":"x","language":"en","release_date":null,')


def test_control(spark):
    f = lambda *x: spark.createDataFrame([(i,) for i in x], "book_id long")
    assert ids(control.pending(f(3, 1, 2, 2), f(2))) == [1, 3]
    m = spark.createDataFrame([(0, 9), (1, 4), (2, 9), (3, 7)], "ordinal long, book_id long")
    assert ids(control.candidates(m, f(4), f())) == [9, 7]
    got = {(r["book_id"], r["state"]) for r in control.reconcile(f(1, 2, 3), f(2, 3, 4), f(3, 5), f(2, 9)).collect()}
    assert got == {(3, "kept"), (2, "added"), (5, "dropped"), (2, "indexed")}
    t = spark.createDataFrame([("20260101", "05", "2026-01-01 05:59:59.5"), ("20260101", "05", "2026-01-02 05:00:00")], "d string, h string, m string")
    at = control.recovered_instant(F.col("m").cast("timestamp"), F.col("d"), F.col("h"))
    assert [r[0] for r in t.select(at).collect()] == ["2026-01-01T05:59:59Z", "2026-01-01T05:00:00Z"]


def plain(df):
    """Postings by tokens as rows."""
    return rows(text.tokens(df).groupBy("term", "book_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")))


ODD = ["", None, "It's the whale's 'WHALE' ''sea'' o''clock", "don’t  déjà‑vu Œuvre ſharp × ÷ naïve’s", "中文 Ⅷ ² ٣٤ İstanbul été \U0001F40B whale", "12 34 a bb " + "y" * 40 + " " + "z" * 41, "whale\x00ship\tsea\r\nsea"]


def test_build_shuffles_nothing(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(ODD * 3)), "book_id long, body string")
    for chunk in (1, text.CHUNK):
        monkeypatch.setattr(text, "CHUNK", chunk)
        built = build_postings(df)
        assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString() and rows(built) == plain(df) != []


def test_build_puts_repeated_ids_together(spark):
    df = spark.createDataFrame([(1, "sea whale"), (2, "ship"), (1, "whale"), (None, "sea"), (None, "sea sea")], "book_id long, body string")
    got = {(r["term"], r["book_id"], r["tf"], tuple(r["positions"])) for r in build_postings(df).collect()}
    assert got == {("sea", 1, 1, (0,)), ("whale", 1, 2, (0, 1)), ("ship", 2, 1, (0,)), ("sea", None, 3, (0, 0, 1))}
    assert {tuple(r) for r in build_postings(df, positions=False).collect()} == {r[:3] for r in got}


@pytest.mark.parametrize("layout", Index.LAYOUTS)
def test_texts_are_tokenised_once(spark, tmp_path, layout):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(body):
        read.add(1)
        return body

    index = Index(spark, str(tmp_path), layout)
    for n, bodies in enumerate((BODIES, {44: "whale", 11: "sea"}, {44: "ship"})):
        before = read.value
        index.add(books(spark, bodies).select("book_id", counted("body").alias("body")))
        assert read.value - before == len(bodies), n
    assert rows(index.postings()) == rows(build_postings(books(spark, {**BODIES, 11: "sea", 44: "ship"})))


def test_canonical_in_parts(spark, tmp_path):
    words = ["q" + "".join(p) for p in itertools.product("abcdefgh", repeat=3)]
    df = books(spark, {i: " ".join(words[i:] + words[:3]) for i in range(9)})
    build_postings(df).write.parquet(str(tmp_path / "postings"))
    stored = spark.read.parquet(str(tmp_path / "postings"))
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        export.write_canonical(stored, str(tmp_path / "parts"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    parts = sorted(p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-"))
    whole = b"".join(p.read_bytes() for p in parts)
    want = "".join(export.canonical_chunks(stored)).encode()
    assert len(parts) > 1 and whole == want + b"," and list(json.loads(want)) == words
    assert export.canonical_digest(spark, str(tmp_path / "parts")) == hashlib.sha256(want).hexdigest()
    (tmp_path / "one").write_bytes(want)
    for place in ("parts", "one"):
        assert rows(read_canonical(spark, str(tmp_path / place))) == rows(stored)
    (tmp_path / "bare").write_text("".join(export.canonical_chunks(stored, False)))
    assert rows(read_canonical(spark, str(tmp_path / "bare"))) == [(t, b, n, ()) for t, b, n, _ in rows(stored)]
    export.write_canonical(stored.where("false"), str(tmp_path / "none"))
    assert export.canonical_digest(spark, str(tmp_path / "none")) == hashlib.sha256(b"{}").hexdigest() and rows(read_canonical(spark, str(tmp_path / "none"))) == []
