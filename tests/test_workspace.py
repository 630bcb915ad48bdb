from __future__ import annotations

import hashlib
import json
import urllib.error
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.functions import paths, text
from quillspark.functions.fixed import END_MARKER, START_MARKER
from quillspark.operators import digest
from quillspark.operators.index import Index
from quillspark.sources import download, files
from quillspark.sources.lake import Lake
from quillspark.sources.store import Store
from quillspark.streaming import ingest


def raw(i, body):
    return f"Title: Book {i}\nAuthor: A\nLanguage: English\n\n{START_MARKER} X\n{body}\n{END_MARKER} X\n"


@pytest.fixture
def mirror(tmp_path):
    for i, body in {1: "whale ship", 2: "ship sea", 3: None}.items():
        p = tmp_path / "mirror/cache/epub" / str(i) / f"pg{i}.txt"
        p.parent.mkdir(parents=True)
        p.write_text(raw(i, body) if body else "no markers")
    return f"file://{tmp_path}/mirror"


@pytest.mark.parametrize("layout", ["time", "book", "hash"])
def test_life_of_a_workspace(spark, tmp_path, mirror, capsys, layout):
    ws = str(tmp_path / "ws")
    (tmp_path / "m.txt").write_text("# ids\n2\n1\n\n3\n9\n2\n")
    run = lambda *a: cli.main(["--workspace", ws, "--datalake-layout", layout, "--now", "2026-01-02T03:04:05.6+00:00", *a])
    assert run("query", "--terms", "ship", "--mode", "and") == 1
    assert run("download", "--manifest", str(tmp_path / "m.txt"), "--source-base", mirror, "--workers", "2") == 3
    assert sorted((tmp_path / "ws/control/downloaded_books.txt").read_text().split()) == ["1", "2"]
    failed = [x.split("\t")[:2] for x in (tmp_path / "ws/control/failed_books.txt").read_text().splitlines()]
    assert sorted(failed) == [["3", "NO_MARKERS"], ["9", "NOT_FOUND"]]
    capsys.readouterr()
    assert run("scan-new") == 0 and capsys.readouterr().out == "1\n2\n"
    assert run("metadata", "--all") == 0 and run("index", "--all", "--positions") == 0
    capsys.readouterr()
    assert run("query", "--terms", "the SHIP", "--mode", "and") == 0 and capsys.readouterr().out == "1\n2\n"
    assert run("query", "--terms", "ship sea", "--mode", "or", "--limit", "1") == 0 and capsys.readouterr().out == "1\n"
    assert run("query", "--terms", "ship", "--mode", "and", "--limit", "-1") == 2
    assert run("lookup", "--book-id", "2") == 0 and capsys.readouterr().out.endswith("body.txt\n")
    assert run("lookup", "--book-id", "8") == 3 and run("split", "--book-id", "8") == 3 and run("split", "--book-id", "1") == 0
    receipt = json.loads((tmp_path / f"ws/control/ingestion/{layout}/1.json").read_text())
    assert receipt["ingested_at"] == "2026-01-02T03:04:05Z"
    capsys.readouterr()
    assert run("scan-new") == 0 and capsys.readouterr().out == ""
    (tmp_path / "ws/x.part").write_text("")
    (tmp_path / f"ws/control/ingestion/{layout}/1.json").unlink()
    assert run("reconcile") == 0 and not (tmp_path / "ws/x.part").exists() and (tmp_path / f"ws/control/ingestion/{layout}/1.json").exists()
    assert run("export-canonical", "--out", str(tmp_path / "c.json")) == 0
    assert (tmp_path / "c.json").read_text() == '{"sea":{"df":1,"postings":[[2,1,[1]]]},"ship":{"df":2,"postings":[[1,1,[1]],[2,1,[0]]]},"whale":{"df":1,"postings":[[1,1,[0]]]}}'
    if layout == "book":
        assert json.loads((tmp_path / "ws/datalake/books/1/meta.json").read_text())["title"] == "Book 1"
    with files.writer_lock(tmp_path / "ws/control/run.lock"):
        assert run("reconcile") == 4


def test_control_steps(spark, tmp_path, mirror):
    ws = str(tmp_path / "ws")
    step = lambda n: cli.main(["--workspace", ws, "--metrics-out", str(tmp_path / "m.jsonl"), "control-step", "--iterations", str(n), "--total-books", "3", "--source-base", mirror])
    assert step(3) == 0
    assert (tmp_path / "ws/control/indexed_books.txt").read_text() == "1\n" and (tmp_path / "ws/control/downloaded_books.txt").read_text() == "1\n2\n"
    assert step(9) == 0 and (tmp_path / "ws/control/indexed_books.txt").read_text() == "1\n2\n"
    assert json.loads((tmp_path / "m.jsonl").read_text().splitlines()[0])["metric"] == "wall_time"


def test_version_and_arguments(capsys):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out == "1.1.9\n"
    assert cli.main(["--workspace", "x", "--index-backend", "mongo", "reconcile"]) == 2 and cli.main(["nonsense"]) == 2
    assert cli.main(["reconcile"]) == 2 and cli.main(["--workspace", "x", "--log-level", "loud", "reconcile"]) == 2 and cli.main(["--workspace", "x", "query", "--terms", "a"]) == 2
    a = cli.parser().parse_args(["--workspace", "x", "reconcile"])
    assert (a.datalake_layout, a.index_backend, a.log_level, a.seed) == ("time", "json", "info", 42)


def test_version_mismatch_and_own_word_lists(spark, tmp_path, mirror, capsys):
    ws = tmp_path / "ws"
    (ws / "spec").mkdir(parents=True)
    (ws / "spec/stopwords_en.txt").write_text("# own\nship\n")
    (ws / "spec/language_map.txt").write_text("english=xx\n")
    run = lambda *a: cli.main(["--workspace", str(ws), "--metrics-out", str(tmp_path / "m.jsonl"), *a])
    (tmp_path / "m.txt").write_text("1\n2\n")
    assert run("download", "--manifest", str(tmp_path / "m.txt"), "--source-base", mirror) == 0
    assert run("metadata", "--all") == 0 and run("index", "--all") == 0
    capsys.readouterr()
    assert run("query", "--terms", "ship", "--mode", "and") == 0 and capsys.readouterr().out == ""
    assert run("query", "--terms", "sea", "--mode", "and") == 0 and capsys.readouterr().out == "2\n"
    assert [r["language"] for r in cli.Workspace(spark, str(ws)).books().read().collect()] == ["xx", "xx"]
    records = [json.loads(x) for x in (tmp_path / "m.jsonl").read_text().splitlines()]
    assert records[0]["run_id"] and records[0]["aux"]["docs_processed"] == 2 and records[2]["aux"]["docs_processed"] == 2 and records[1]["aux"]["records_written"] == 2
    (ws / "control/spec_version").write_text("0.9\n")
    assert run("query", "--terms", "sea", "--mode", "and") == 1 and "0.9" in capsys.readouterr().err


def test_retries():
    waits, calls = [], []

    def broken(request, timeout):
        calls.append(1)
        raise urllib.error.HTTPError(request.full_url, 503, "x", {}, None)

    with pytest.raises(download.DownloadError):
        download.fetch(1, "http://x", waits.append, broken)
    assert waits == [1.0, 2.0, 4.0] and len(calls) == 4

    def missing(request, timeout):
        raise urllib.error.HTTPError(request.full_url, 404, "x", {}, None)

    with pytest.raises(download.NotFound):
        download.fetch(1, "http://x", waits.append, missing)
    assert len(waits) == 3


def test_mirror_source(spark, mirror):
    spark.dataSource.register(download.MirrorSource)
    rows = spark.read.format("mirror").option("ids", "1,2,9").option("base", mirror).option("workers", 2).load().orderBy("book_id").collect()
    assert [(r["book_id"], r["error"]) for r in rows] == [(1, None), (2, None), (9, "NOT_FOUND")]


def test_hour_folders_before_since_are_not_read(spark, tmp_path):
    lake = Lake(spark, str(tmp_path), "time")
    for i, at in ((1, "2026-01-01T23:10"), (2, "2026-01-02T03:00"), (3, "2026-01-02T05:00")):
        lake.write(i, "h", "b", datetime.fromisoformat(at + "+00:00"))
    new = lake.list_new("2026-01-02T03:59:00")
    assert [r[0] for r in new.collect()] == [2, 3]
    assert "23" not in {p.split("/")[-2] for p in lake._found("body", "2026-01-02T03:59:00").inputFiles()}
    assert lake.list_new("2027-01-01T00:00:00").count() == 0 and sorted(r["book_id"] for r in lake.bodies([1, 3, 9]).collect()) == [1, 3]


def test_paths_outside_are_refused(spark):
    rows = spark.createDataFrame([("file:///w/datalake/a.txt",), ("/w/datalake/b.txt",), ("/x/c.txt",), ("datalake/../../d",), ("datalake/e",), ("/w2/f",)], "p string")
    assert [r[0] for r in rows.select(paths.inside("/w", F.col("p"))).collect()] == ["datalake/a.txt", "datalake/b.txt", None, None, "datalake/e", None]
    times = spark.createDataFrame([("2026-01-02T03:04:05.9",), ("2026-01-02T03:04:05+02:00",), ("soon",)], "t string")
    assert [r[0] for r in times.select(paths.instant_text(paths.parse_instant(F.col("t")))).collect()] == ["2026-01-02T03:04:05Z", "2026-01-02T01:04:05Z", None]


def test_folder_stats(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x").write_text("12345")
    (tmp_path / "a/b/y").write_text("1")
    got = Store(spark, f"file://{tmp_path}").stats()
    assert (got["files"], got["dirs"], got["bytes"]) == (2, 2, 6) and got["allocated_bytes"] >= 6
    assert Store(spark, f"file://{tmp_path}").stats("none")["files"] == 0


def test_golden_tokens(spark, tmp_path):
    books = spark.createDataFrame([(1, "The whale, the SHIP 12"), (2, "sea"), (3, "x")], "book_id long, body string")
    said = lambda kept: hashlib.sha256("\n".join(kept).encode()).hexdigest()
    good = [(1, 5, 2, said(["whale", "ship"])), (2, 1, 1, said(["sea"])), (3, 1, 0, said([]))]
    bad = [(1, 4, 2, said(["whale", "ship"])), (2, 1, 1, said(["see"])), (3, 1, 1, said([])), (9, 0, 0, said([]))]
    for rows, want in ((good, []), (bad, [(1, "RAW"), (2, "DIGEST"), (3, "KEPT"), (9, "MISSING")])):
        (tmp_path / "t.jsonl").write_text("".join(json.dumps(dict(zip(("book_id", "n_tokens_raw", "n_tokens_kept", "sha256_tokens"), r))) + "\n" for r in rows))
        assert sorted(map(tuple, text.golden_differences(books, files.read_golden(spark, str(tmp_path / "t.jsonl"))).collect())) == want


def test_digests_and_plans(spark):
    a = spark.createDataFrame([(1, "x\"é", None), (2, None, 5)], "i int, s string, n int")
    lines = '[1, "x\\"é", null]\n[2, null, 5]\n'
    assert digest.content_digest(a, "i") == (2, hashlib.sha256(lines.encode()).hexdigest())
    assert digest.quick_digest(a).first() == digest.quick_digest(a.orderBy(F.desc("i"))).first() != digest.quick_digest(a.where("i = 1")).first()
    assert digest.probe(a) == [("i", "int"), ("s", "string"), ("n", "int")] and "LocalTableScan" not in digest.plan(a.where("i > 1"), "simple") and "Scan" in digest.plan(a)


def test_control_files(spark, tmp_path):
    p = tmp_path / "f.txt"
    p.write_text("5\n5\nx\n7\tNOT_FOUND\t2026\n-1\n\n")
    assert sorted(r[0] for r in files.read_ids(spark, str(p)).collect()) == [5, 7]
    assert files.read_ids(spark, str(tmp_path / "none")).count() == 0
    assert files.write_text(p, "a", if_changed=True) and not files.write_text(p, "a", if_changed=True)


def test_streaming_equals_batch(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    index = Index(spark, str(tmp_path / "index"), "bucketed")
    for i in (1, 2):
        (folder / f"{i}.txt").write_text(raw(i, f"whale number{i}"))
    ingest.index_new(spark, str(folder), index, str(tmp_path / "cp"), 1)
    (folder / "3.txt").write_text(raw(3, "whale sea"))
    ingest.index_new(spark, str(folder), index, str(tmp_path / "cp"))
    assert sorted(r["book_id"] for r in index.of(["whale"]).collect()) == [1, 2, 3]
