"""Command line over a workspace. Exit codes: 0 done, 1 error, 2 bad argument, 3 not found or unusable, 4 locked."""

from __future__ import annotations

import argparse
import json
import logging
import os
import secrets
import socket
import sys
import time
from collections import Counter
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import split
from quillspark.functions.fixed import LANGUAGES, SPEC_VERSION, STOP_WORDS
from quillspark.functions.text import query_terms
from quillspark.operators import control, export, metadata, search
from quillspark.operators.index import Index
from quillspark.sources import files
from quillspark.sources.download import DEFAULT_BASE, DownloadError, NotFound, fetch
from quillspark.sources.lake import LAYOUTS, Lake

BACKENDS = {"json": "monolithic", "folder": "bucketed", "sqlite": "clustered"}


def session() -> SparkSession:
    return SparkSession.builder.appName("quillspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


class Workspace:
    def __init__(self, spark: SparkSession, root: str, layout: str = "time", backend: str = "json", now: str | None = None) -> None:
        self.spark, self.root, self.layout, self.now = spark, Path(root), layout, now
        self.lake = Lake(spark, root, layout)
        self.backend = BACKENDS[backend]
        self.control = self.root / "control"
        #: What a command did, for its metrics record.
        self.counts: Counter[str] = Counter()
        # A workspace may bring word lists of its own.
        lists = self.root / "spec"
        own = lists / "stopwords_en.txt"
        self.stop_words = tuple(sorted(r["term"] for r in files.read_lines(spark, str(own)).collect())) if own.is_file() else STOP_WORDS
        own = lists / "language_map.txt"
        self.languages = {r["name"]: r["code"] for r in files.read_pairs(spark, str(own)).collect()} if own.is_file() else LANGUAGES

    def version_fault(self) -> str | None:
        """Why this code must not touch the workspace: it was made by another version of the contract."""
        made = self.control / "spec_version"
        if made.is_file() and made.read_text().strip() != SPEC_VERSION:
            return f"this workspace is of version {made.read_text().strip()}, this program of {SPEC_VERSION}"
        return None

    def instant(self) -> datetime:
        found = datetime.fromisoformat(self.now) if self.now else datetime.now(UTC)
        return (found if found.tzinfo else found.replace(tzinfo=UTC)).astimezone(UTC).replace(microsecond=0)

    def ids(self, name: str) -> DataFrame:
        return files.read_ids(self.spark, str(self.control / f"{name}_books.txt"))

    def known(self, name: str) -> set[int]:
        return {r[0] for r in self.ids(name).collect()}

    def index(self, positions: bool | None = None) -> Index:
        return Index(self.spark, str(self.root / "datamarts" / "index"), self.backend, positions)

    def books(self) -> metadata.BookStore:
        return metadata.BookStore(self.spark, str(self.root / "datamarts"))

    def fail(self, book_id: int, reason: str) -> None:
        self.counts["docs_failed"] += 1
        files.append_line(self.control / "failed_books.txt", f"{book_id}\t{reason}\t{self.instant():%Y-%m-%dT%H:%M:%SZ}")

    def receipt(self, book_id: int, header: str, body: str, at: str) -> str:
        line = json.dumps({"book_id": book_id, "header_path": header, "body_path": body, "ingested_at": at}, separators=(",", ":"))
        files.write_text(self.control / "ingestion" / self.layout / f"{book_id}.json", line + "\n", if_changed=True)
        return line

    def store(self, book_id: int, raw: str) -> bool:
        """Split, write both parts, then meta.json (book layout), then the receipt; false without markers."""
        row = split.split_books(self.spark.createDataFrame([(book_id, raw)], "book_id long, raw string")).first()
        if row["error"]:
            self.fail(book_id, row["error"])
            return False
        at = self.instant()
        header, body = self.lake.write(book_id, row["header"], row["body"], at)
        stamp = f"{at:%Y-%m-%dT%H:%M:%SZ}"
        if self.layout == "book":
            self.meta_json(self.spark.createDataFrame([(book_id, row["header"], row["body"], header, body, stamp)], "book_id long, header string, body string, header_path string, body_path string, ingested_at string"))
        self.receipt(book_id, header, body, stamp)
        if book_id not in self.known("downloaded"):
            files.append_line(self.control / "downloaded_books.txt", str(book_id))
        self.counts["docs_processed"] += 1
        return True

    def meta_json(self, books: DataFrame) -> None:
        for r in metadata.records(books).select("book_id", metadata.meta_json().alias("j")).toLocalIterator():
            files.write_text(self.root / "datalake" / "books" / str(r["book_id"]) / "meta.json", r["j"] + "\n", if_changed=True)

    def download(self, wanted: list[int], base: str, workers: int = 1) -> int:
        from concurrent.futures import ThreadPoolExecutor

        done = self.known("downloaded")
        todo = [i for i in dict.fromkeys(wanted) if i not in done]
        self.counts["docs_skipped"] += len(dict.fromkeys(wanted)) - len(todo)
        worst = set()

        def get(i: int) -> tuple[int, str | None, str]:
            try:
                return i, fetch(i, base), ""
            except NotFound:
                return i, None, "NOT_FOUND"
            except DownloadError:
                return i, None, "DOWNLOAD_ERROR"

        with ThreadPoolExecutor(max(1, workers)) as pool:
            for i, raw, reason in pool.map(get, todo):
                if raw is None:
                    self.fail(i, reason)
                    worst.add(reason)
                    continue
                files.write_text(self.root / "raw" / f"{i}.txt", raw)
                if not self.store(i, raw):
                    worst.add("NO_MARKERS")
        return 1 if "DOWNLOAD_ERROR" in worst else 3 if worst else 0

    def resplit(self, book_id: int) -> int:
        raw = self.root / "raw" / f"{book_id}.txt"
        if not raw.is_file():
            return 3
        return 0 if self.store(book_id, raw.read_text(encoding="utf-8", errors="replace")) else 3

    def build_metadata(self, book_id: int | None = None, batch: int = 500) -> int:
        """All receipts are checked first; then records in batches, each committed whole."""
        lake = self.lake.books()
        if book_id is not None:
            lake = lake.where(F.col("book_id") == book_id)
            if lake.isEmpty():
                return 3
        receipts = files.read_receipts(self.spark, str(self.control / "ingestion" / self.layout))
        errors = control.receipt_errors(receipts, lake)
        if not errors.isEmpty():
            for r in errors.limit(20).collect():
                print(f"receipt of {r['book_id']}: {r['error']}", file=sys.stderr)
            return 1
        rows = lake.join(receipts.select("book_id", "ingested_at"), "book_id")
        ids = sorted(r[0] for r in rows.select("book_id").collect())
        written = 0
        for at in range(0, len(ids), batch):
            part = rows.where(F.col("book_id").between(ids[at], ids[min(at + batch, len(ids)) - 1]))
            written += self.books().upsert(metadata.records(part, self.languages))
            if self.layout == "book":
                self.meta_json(part)
        self.counts["docs_processed"] += len(ids)
        self.counts["records_written"] += written
        print(f"records written: {written}", file=sys.stderr)
        return 0

    def build_index(self, wanted: list[int] | None, positions: bool | None, batch: int = 500) -> int:
        """Pending ids ascending; a batch is committed, then its ids are marked."""
        try:
            index = self.index(positions)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        todo = [r[0] for r in control.pending(self.ids("downloaded"), self.ids("indexed")).collect()]
        if wanted is not None:
            self.counts["docs_skipped"] += len(set(wanted) - set(todo))
            todo = [i for i in todo if i in wanted]
        missing = 0
        for at in range(0, len(todo), batch):
            ids = todo[at : at + batch]
            books = self.lake.bodies(ids)  # only the batch's files are read
            there = {r[0] for r in books.select("book_id").collect()}
            if there:
                index.add(books, self.stop_words)
            self.counts["docs_processed"] += len(there)
            missing += len(ids) - len(there)
            for i in ids:
                if i in there:
                    files.append_line(self.control / "indexed_books.txt", str(i))
        return 3 if missing else 0

    def step(self, iterations: int, manifest: list[int], base: str) -> int:
        for _ in range(iterations):
            todo = control.pending(self.ids("downloaded"), self.ids("indexed")).limit(1).collect()
            if todo:
                exists = self.index(None).exists()
                if self.build_index([todo[0][0]], None if exists else True):
                    return 0
                continue
            known = self.known("downloaded") | self.known("failed")
            following = next((i for i in manifest if i not in known), None)
            if following is None:
                return 0
            self.download([following], base)
        return 0

    def reconcile(self) -> int:
        for part in self.root.rglob("*.part"):
            part.unlink()
        lake = self.lake.books()
        rows = lake.select("book_id", "header_path", "body_path", "modified").orderBy("book_id").collect()
        ids = [r["book_id"] for r in rows]
        files.write_text(self.control / "downloaded_books.txt", "".join(f"{i}\n" for i in ids), if_changed=True)
        indexed = sorted(self.known("indexed") & set(ids))
        files.write_text(self.control / "indexed_books.txt", "".join(f"{i}\n" for i in indexed), if_changed=True)
        folder = self.control / "ingestion" / self.layout
        receipts = files.read_receipts(self.spark, str(folder))
        bad = {r["book_id"] for r in control.receipt_errors(receipts, lake).collect()}
        date, hour = (F.regexp_extract("body_path", "datalake/(\\d{8})/(\\d{2})/", i) for i in (1, 2))
        at = control.recovered_instant(F.col("modified"), *((date, hour) if self.layout == "time" else ()))
        for r in lake.select("book_id", "header_path", "body_path", at.alias("at")).toLocalIterator():
            if r["book_id"] in bad:
                self.receipt(r["book_id"], r["header_path"], r["body_path"], r["at"])
        for f in folder.glob("*.json"):
            if not f.stem.isdigit() or int(f.stem) not in set(ids):
                f.unlink()
        return 0

    def record(self, command: str, seconds: float, started: datetime, out: str, backend: str, **aux: object) -> None:
        env = os.environ.get
        number = lambda k: int(env(k)) if env(k) else None
        files.append_line(out, json.dumps({
            "run_id": env("BENCH_RUN_ID") or f"{started:%Y-%m-%dT%H-%M-%SZ}-{secrets.token_hex(2)}", "spec_version": SPEC_VERSION, "language": "pyspark", "impl_version": env("BENCH_IMPL_VERSION"),
            "experiment": env("BENCH_EXPERIMENT") or f"cli_{command}", "datalake_layout": self.layout, "index_backend": backend,
            "positions": aux.pop("positions", None), "corpus_size": number("BENCH_CORPUS_SIZE"), "workers": aux.pop("workers", None),
            "batch_size": aux.pop("batch_size", None), "repetition": number("BENCH_REPETITION"), "metric": "wall_time", "value": round(seconds * 1000, 3),
            "unit": "ms", "aux": aux | dict(self.counts), "machine_id": env("BENCH_MACHINE_ID") or socket.gethostname(),
            "started_at": f"{started:%Y-%m-%dT%H:%M:%S}.{started.microsecond // 1000:03d}Z"}))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark")
    p.add_argument("--workspace")
    p.add_argument("--datalake-layout", choices=LAYOUTS, default="time")
    p.add_argument("--index-backend", choices=[*BACKENDS, "mongo"], default="json")
    p.add_argument("--metrics-out")
    p.add_argument("--log-level", choices=("error", "warn", "info", "debug"), default="info")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--now")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    d = sub.add_parser("download")
    d.add_argument("--book-id", type=int)
    d.add_argument("--manifest")
    d.add_argument("--workers", type=int, default=1)
    d.add_argument("--source-base", default=DEFAULT_BASE)
    sub.add_parser("split").add_argument("--book-id", type=int, required=True)
    for name in ("metadata", "index"):
        m = sub.add_parser(name)
        m.add_argument("--book-id", type=int)
        m.add_argument("--all", action="store_true")
        m.add_argument("--batch-size", type=int, default=500)
        if name == "index":
            m.add_argument("--positions", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("--terms", required=True)
    q.add_argument("--mode", choices=("and", "or"), required=True)
    q.add_argument("--limit", type=int)
    sub.add_parser("lookup").add_argument("--book-id", type=int, required=True)
    sub.add_parser("scan-new").add_argument("--since")
    c = sub.add_parser("control-step")
    c.add_argument("--iterations", type=int, default=1)
    c.add_argument("--total-books", type=int, default=70000)
    c.add_argument("--manifest")
    c.add_argument("--source-base", default=DEFAULT_BASE)
    sub.add_parser("reconcile")
    sub.add_parser("export-canonical").add_argument("--out", required=True)
    return p


def _manifest(ws: Workspace, path: str) -> list[int]:
    return [r["book_id"] for r in files.read_manifest(ws.spark, path).orderBy("ordinal").collect()]


def run(ws: Workspace, a: argparse.Namespace) -> int:
    if a.command == "download":
        if (a.book_id is None) == (a.manifest is None) or a.workers < 1:
            return 2
        return ws.download([a.book_id] if a.book_id is not None else _manifest(ws, a.manifest), a.source_base, a.workers)
    if a.command == "split":
        return ws.resplit(a.book_id)
    if a.command in ("metadata", "index"):
        if (a.book_id is None) != a.all or a.batch_size < 1:
            return 2
        if a.command == "metadata":
            return ws.build_metadata(a.book_id, a.batch_size)
        return ws.build_index(None if a.all else [a.book_id], a.positions, a.batch_size)
    if a.command == "query":
        if a.limit is not None and a.limit < 0:
            return 2
        index = ws.index(None)
        if not index.exists():
            print(f"no index for {a.index_backend}", file=sys.stderr)
            return 1
        terms = query_terms(a.terms, ws.stop_words)
        for r in search.search_terms(index.of(terms), terms, a.mode, a.limit).toLocalIterator():
            print(r["book_id"])
        return 0
    if a.command == "lookup":
        found = ws.lake.lookup(a.book_id)
        if not found:
            return 3
        (ws.root / found[1]).read_bytes()
        print(f"{found[0]}\t{found[1]}")
        return 0
    if a.command == "scan-new":
        for r in control.pending(ws.lake.list_new(a.since), ws.ids("indexed")).toLocalIterator():
            print(r["book_id"])
        return 0
    if a.command == "control-step":
        return ws.step(a.iterations, _manifest(ws, a.manifest) if a.manifest else list(range(1, a.total_books + 1)), a.source_base)
    if a.command == "reconcile":
        return ws.reconcile()
    index = ws.index(None)
    if not index.exists():
        return 1
    print(export.export_canonical(index.postings(), a.out, index.positions))
    return 0


#: Commands that write hold the workspace's lock.
WRITERS = ("download", "split", "metadata", "index", "control-step", "reconcile")


def main(args: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    if a.command == "version":
        print(SPEC_VERSION)
        return 0
    if not a.workspace:
        print("--workspace is required", file=sys.stderr)
        return 2
    if a.index_backend == "mongo":
        print("mongo is not implemented", file=sys.stderr)
        return 2
    if a.now:
        try:
            datetime.fromisoformat(a.now)
        except ValueError:
            return 2
    logging.getLogger("quillspark").setLevel(a.log_level.upper() if a.log_level != "warn" else "WARNING")
    ws = Workspace(session(), a.workspace, a.datalake_layout, a.index_backend, a.now)
    if fault := ws.version_fault():
        print(fault, file=sys.stderr)
        return 1
    began, started = time.perf_counter(), datetime.now(UTC)
    try:
        if a.command in WRITERS:
            with files.writer_lock(ws.control / "run.lock"):
                files.write_text(ws.control / "spec_version", SPEC_VERSION + "\n", if_changed=True)
                code = run(ws, a)
        else:
            code = run(ws, a)
    except files.Locked:
        return 4
    if a.metrics_out:
        ws.record(a.command, time.perf_counter() - began, started, a.metrics_out, a.index_backend, positions=getattr(a, "positions", None),
                  workers=getattr(a, "workers", None), batch_size=getattr(a, "batch_size", None))
    return code


if __name__ == "__main__":
    sys.exit(main())
