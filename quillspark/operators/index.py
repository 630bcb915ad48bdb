"""Inverted index: build, persist in three layouts, update, read.

Building groups a text's tokens where they are made and shuffles nothing, unless an id is repeated. Document
frequencies reuse the rows. Persisted layouts are versioned Parquet
folders with a pointer; an update writes what it touches and then moves the pointer, so readers never see half a batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import paths, text
from quillspark.functions.fixed import STOP_WORDS
from quillspark.schemas import POSTINGS
from quillspark.sources.store import Store


#: Ids that are sent to every task, so that postings stay where they lie; more meet them in a join that shuffles both.
SENT = 4_000_000


def _without(rows: DataFrame, ids: DataFrame, n: int | None) -> DataFrame:
    """Rows of other books than ``ids``, of which there are ``n`` at most, if that is known."""
    return rows.join(F.broadcast(ids) if n is not None and n <= SENT else ids, "book_id", "left_anti").select(rows.columns)


def build_postings(books: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS, positions: bool = True) -> DataFrame:
    """(term, book_id, tf, positions) of (book_id, body). A job over the ids alone tells whether rows of one id must be put together."""
    rows = text.postings(books, stop_words, positions)
    if books.groupBy("book_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    held = [F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")] if positions else []
    return rows.groupBy("term", "book_id").agg(F.sum("tf").cast("int").alias("tf"), *held)


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_frequency(books: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(term, df) straight from (book_id, body): distinct within the row, then one shuffle of partial counts."""
    return text.postings(books, stop_words, positions=False).groupBy("term").agg(F.count("*").alias("df"))


def posting_text(positions: bool = True) -> Column:
    """``[id,tf,[p,...]]`` or ``[id,tf]``."""
    tail = [F.lit(",["), F.array_join("positions", ","), F.lit("]")] if positions else []
    return F.concat(F.lit("["), F.col("book_id").cast("string"), F.lit(","), F.col("tf").cast("string"), *tail, F.lit("]"))


def entries(postings: DataFrame, positions: bool = True, ordered: bool = False) -> DataFrame:
    """term, df and the canonical posting list of each term; ``ordered``: terms ascending, from partition to partition too.

    Postings are sorted by term and book, and each stretch of one term is cut from the batch as it lies.
    """
    rows = postings.select("term", "book_id", F.concat(posting_text(positions), F.lit(",")).alias("t"))
    rows = rows.repartitionByRange("term") if ordered else rows.repartition("term")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, n, parts = None, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("term").dictionary_encode()
            codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            starts = np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(codes)].tolist()
            texts = batch.column("t").cast(pa.large_binary())
            data, cuts = texts.buffers()[2], np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:]
            done: list[tuple[str, int, bytes]] = []
            for name, a, b in zip(names, starts, starts[1:]):
                if name != term:
                    if n:
                        done.append((term, n, b"".join(parts)[:-1]))
                    term, n, parts = name, 0, []
                n += b - a
                parts.append(data[int(cuts[a]):int(cuts[b])].to_pybytes())
            if done:
                yield _entries_of(done)
        if n:
            yield _entries_of([(term, n, b"".join(parts)[:-1])])

    return rows.sortWithinPartitions("term", "book_id").select("term", "t").mapInArrow(work, "term string, df long, postings string")


def _entries_of(done: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    names, counts, lines = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(lines, pa.binary()).cast(pa.string())], names=["term", "df", "postings"])


def upsert_postings(old: DataFrame, new: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """Replace all rows of the books indexed anew; ``books`` names them if some have no postings now."""
    ids = (new if books is None else books).select("book_id").distinct()
    return _without(old.select(new.columns), ids, None if books is None else books.count()).unionByName(new)


def refresh_frequencies(terms: DataFrame, old: DataFrame, new: DataFrame, merged: DataFrame) -> DataFrame:
    """Frequencies after an upsert; only terms of replaced or new rows are counted again."""
    ids = new.select("book_id").distinct()
    touched = new.select("term").unionByName(old.join(ids, "book_id", "left_semi").select("term")).distinct()
    # Counted first: partial counts are shuffled, not postings.
    counted = document_frequency(merged).join(touched, "term", "left_semi").select("term", "df")
    return terms.join(touched, "term", "left_anti").select("term", "df").unionByName(counted)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Postings of a canonical export, one file or its parts. Records end where one term's entry does, so that one large line is still read in
    splits; a last comma does no harm. Its bytes are fixed, so entries are cut at their brackets, not parsed."""
    rows = spark.read.option("lineSep", ']},"').text(path).where(F.contains("value", F.lit('"postings":[')))
    head = F.ltrim(F.substring_index("value", '":{"df":', 1), F.lit('{"'))
    # [id,tf,[p,...]],[...] or [id,tf],[...]
    held = F.ltrim(F.rtrim(F.substr("value", F.instr("value", '"postings":[') + len('"postings":[')), F.lit("]}, \t\r\n")), F.lit("["))
    rows = rows.select(head.alias("term"), F.explode(F.split(held, "\\]+,\\[")).alias("p"))
    own, at = F.substring_index("p", ",[", 1), F.instr("p", ",[")
    return rows.where("p <> ''").select("term", F.substring_index(own, ",", 1).cast("long").alias("book_id"), F.substring_index(own, ",", -1).cast("int").alias("tf"),
                                        F.when(at > 0, F.split(F.substr("p", at + 2), ",").cast("array<int>")).alias("positions"))


class Index:
    """A persisted index in one of three layouts, on any store that Spark writes.

    ``monolithic``: one table; an update rewrites it. ``bucketed``: 27 folders by the term's first letter; an update rewrites those
    that hold a term it adds or removes. ``clustered``: segments whose terms are dealt by hash to files sorted by term, with a bloom filter; an update writes one more, as large as
    the batch, and names the books that it replaces, whose rows in earlier segments no longer count. ``compact`` makes one
    segment of all, and is run once there are more than ``SEGMENTS``.
    """

    LAYOUTS = ("monolithic", "bucketed", "clustered")
    SEGMENTS = 8
    #: Writers of a bucket: its terms are dealt by hash, so that a frequent letter is not one task.
    SALTS = 16

    def __init__(self, spark: SparkSession, root: str, layout: str = "clustered", positions: bool | None = True) -> None:
        if layout not in self.LAYOUTS:
            raise ValueError(f"unknown index layout {layout!r}")
        self.spark, self.store, self.layout = spark, Store(spark, root), layout
        self.pointer = f"{layout}.json"
        if self.exists():
            built = self._state()["positions"]
            if positions is not None and built != positions:
                raise ValueError("the index was built with another positions setting")
            self.positions = built
        else:
            self.positions = True if positions is None else positions

    def exists(self) -> bool:
        return self.store.exists(self.pointer)

    def _state(self) -> dict:
        if not self.exists():
            raise FileNotFoundError(f"no {self.layout} index in {self.store.root}")
        return self.store.read(self.pointer)

    def _switch(self, segments: list[dict], before: dict | None) -> None:
        """Point to ``segments``; what the switch before this one left behind goes."""
        live = {p for s in segments for p in [*s["postings"], s.get("books")]}
        held = {p for s in before["segments"] for p in [*s["postings"], s.get("books")] if p} if before else set()
        self.store.write(self.pointer, {"positions": self.positions, "segments": segments, "stale": sorted(held - live)})
        if before:
            self.store.drop(*before["stale"])

    def _read(self, places: list[str]) -> DataFrame:
        schema = POSTINGS + (", bucket string" if self.layout == "bucketed" else "")
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[self.store.at(p) for p in places])

    def postings(self) -> DataFrame:
        """All postings; of a book that several segments hold, those of the last."""
        rows, replaced, n = None, None, 0
        for segment in reversed(self._state()["segments"]):
            part = self._read(segment["postings"])
            if replaced is not None:
                part = _without(part, replaced, n)
            rows = part if rows is None else rows.unionByName(part)
            if segment.get("books"):
                ids = self.spark.read.schema("book_id long").parquet(self.store.at(segment["books"]))
                replaced = ids if replaced is None else replaced.unionByName(ids)
                n = None if n is None or segment.get("n") is None else n + segment["n"]
        return self._read([]) if rows is None else rows

    def of(self, terms: list[str]) -> DataFrame:
        """Postings of some terms; the bucket predicate is stated, as it is not derived from the term."""
        rows = self.postings().where(F.col("term").isin(*terms) if terms else F.lit(False))
        if self.layout == "bucketed" and terms:
            rows = rows.where(F.col("bucket").isin(*sorted({paths.bucket_of(t) for t in terms})))
        return rows

    def terms(self) -> DataFrame:
        return document_frequency(self.postings())

    def vocabulary(self) -> DataFrame:
        return self.postings().select("term").distinct().orderBy("term")

    def df(self, term: str) -> int:
        return self.of([term]).count()

    def ordered(self) -> DataFrame:
        """Every posting, terms and then books ascending."""
        return self.postings().orderBy("term", "book_id")

    def _write(self, rows: DataFrame, version: str) -> None:
        if self.layout == "clustered":
            # By hash, since ranges would take a pass of their own over rows that are only being made.
            rows = rows.repartition("term").sortWithinPartitions("term", "book_id")
        rows.write.option("parquet.bloom.filter.enabled#term", "true").parquet(self.store.at(version))

    def add(self, books: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> None:
        """Index (book_id, body), replacing what the books had; one commit."""
        new = build_postings(books, stop_words, self.positions)
        if not self.positions:
            new = new.withColumn("positions", F.lit(None).cast("array<int>"))
        version = f"v-{uuid.uuid4().hex}"
        before = self._state() if self.exists() else None
        if self.layout == "bucketed":
            self._add_buckets(new, books, version, before)
        elif self.layout == "monolithic":
            self._write(upsert_postings(self.postings(), new, books) if before else new, version)
            self._switch([{"postings": [version]}], before)
        else:
            self._write(new, f"{version}/postings")
            books.select("book_id").distinct().write.parquet(self.store.at(f"{version}/books"))
            n = self.spark.read.parquet(self.store.at(f"{version}/books")).count()
            segments = before["segments"] if before else []
            self._switch([*segments, {"postings": [f"{version}/postings"], "books": f"{version}/books", "n": n}], before)
            if len(segments) >= self.SEGMENTS:
                self.compact()

    def compact(self) -> None:
        """One segment of all; only ``clustered`` has more than one."""
        before = self._state()
        if len(before["segments"]) > 1:
            version = f"v-{uuid.uuid4().hex}"
            self._write(self.postings(), f"{version}/postings")
            self._switch([{"postings": [f"{version}/postings"]}], before)

    def _add_buckets(self, new: DataFrame, books: DataFrame, version: str, before: dict | None) -> None:
        """Rewrite only the buckets that hold a touched term; the pointer lists one folder for each bucket."""
        new = new.withColumn("bucket", paths.bucket(F.col("term")))
        kept = before["segments"][0]["postings"] if before else []
        held = new.persist(StorageLevel.DISK_ONLY) if kept else None  # read twice, made once
        if kept:
            hit = self.postings().join(books.select("book_id").distinct(), "book_id", "left_semi").select("bucket").unionByName(new.select("bucket")).distinct()
            touched = {f"b={r['bucket']}" for r in hit.collect()}  # 27 rows at most
            stale = [p for p in kept if p.rsplit("/", 1)[1] in touched]
            if stale:
                new = upsert_postings(self._read(stale), new, books)
            kept = [p for p in kept if p not in stale]
        dealt = new.withColumn("b", F.col("bucket")).repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(self.SALTS)))
        dealt.sortWithinPartitions("bucket", "term", "book_id").write.partitionBy("b").parquet(self.store.at(version))
        if held is not None:
            held.unpersist()
        self._switch([{"postings": [*kept, *[f"{version}/{d}" for d in self.store.folders(version) if d.startswith("b=")]]}], before)
