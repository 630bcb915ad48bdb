"""The lake: one header and one body file for each book, in one of three layouts."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.paths import inside, parse_instant
from quillspark.functions.split import decode
from quillspark.sources.files import write_text

LAYOUTS = ("time", "book", "hash")


def relative(layout: str, book_id: int, instant: datetime, part: str) -> str:
    """A file's place below the workspace; the same rule as ``functions.paths.path``."""
    if layout == "time":
        return f"datalake/{instant:%Y%m%d}/{instant:%H}/{book_id}.{part}.txt"
    if layout == "book":
        return f"datalake/books/{book_id}/{part}.txt"
    six = f"{book_id:06d}"
    return f"datalake/{six[:2]}/{six[2:4]}/{book_id}.{part}.txt"


_GLOBS = {"time": "[0-9]*/[0-9][0-9]/*.{part}.txt", "book": "books/*/{part}.txt", "hash": "[0-9][0-9]/[0-9][0-9]/*.{part}.txt"}
_IDS = {"time": "datalake/(\\d{8})/(\\d{2})/(\\d+)\\.(header|body)\\.txt$", "book": "datalake/(books)/()(\\d+)/(header|body)\\.txt$",
        "hash": "datalake/(\\d{2})/(\\d{2})/(\\d+)\\.(header|body)\\.txt$"}


class Lake:
    def __init__(self, spark: SparkSession, workspace: str, layout: str = "hash") -> None:
        if layout not in LAYOUTS:
            raise ValueError(f"unknown layout {layout!r}")
        self.spark, self.workspace, self.layout = spark, Path(workspace), layout

    def write(self, book_id: int, header: str, body: str, instant: datetime) -> tuple[str, str]:
        """Both files, each atomically; their relative paths."""
        names = tuple(relative(self.layout, book_id, instant.astimezone(UTC), part) for part in ("header", "body"))
        for name, text in zip(names, (header, body)):
            write_text(self.workspace / name, text)
        return names

    def write_partitions(self, books: DataFrame, target: str) -> None:
        """The same rows as a columnar lake, partitioned by the layout's directories (book: unpartitioned)."""
        if self.layout == "time":
            parts = {"date": F.date_format("ingested_at", "yyyyMMdd"), "hour": F.date_format("ingested_at", "HH")}
        elif self.layout == "hash":
            six = F.lpad(F.col("book_id").cast("string"), 6, "0")
            parts = {"p1": F.substring(six, 1, 2), "p2": F.substring(six, 3, 2)}
        else:
            parts = {}
        books.withColumns(parts).write.mode("append").partitionBy(*parts).parquet(target)

    def _found(self, part: str, since: str | None = None) -> DataFrame:
        reader = self.spark.read.format("binaryFile")
        place = self.workspace.resolve() / "datalake"
        if not any(place.glob(_GLOBS[self.layout].format(part=part))):
            return self.spark.createDataFrame([], "book_id long, path string, modified timestamp, d1 string, d2 string, content binary")
        wanted = [f"{place}/{_GLOBS[self.layout].format(part=part)}"]
        if since is not None and self.layout == "time":  # folders of hours before it are not even listed
            from_ = self.spark.range(1).select(F.date_format(parse_instant(F.lit(since)), "yyyyMMddHH")).first()[0] or ""
            days = [d for d in place.glob("[0-9]*") if d.name >= from_[:8]]
            hours = [h for d in days for h in d.glob("[0-9][0-9]") if d.name + h.name >= from_]
            wanted = [f"{h}/*.{part}.txt" for h in hours if any(h.glob(f"*.{part}.txt"))]
            if not wanted:
                return self._found(part).limit(0)
        files = reader.load(wanted)
        rows = files.select(*[F.regexp_extract("path", _IDS[self.layout], i).alias(n) for i, n in ((1, "d1"), (2, "d2"), (3, "id"))], "path", "modificationTime", "content").where("id <> ''")
        rows = rows.select(F.col("id").cast("long").alias("book_id"), inside(str(self.workspace.resolve()), F.col("path")).alias("path"),
                           F.col("modificationTime").alias("modified"), "d1", "d2", "content")
        if self.layout == "hash":  # a misplaced file is none
            six = F.lpad(F.col("book_id").cast("string"), 6, "0")
            rows = rows.where((F.col("d1") == F.substring(six, 1, 2)) & (F.col("d2") == F.substring(six, 3, 2)))
        if since is not None:
            instant = parse_instant(F.lit(since))
            if self.layout == "time":
                hour = F.date_format(instant, "yyyyMMddHH")
                rows = rows.where(F.concat("d1", "d2") >= hour)
            else:
                rows = rows.where(F.col("modified") >= F.date_trunc("second", instant))
        return rows

    def books(self, since: str | None = None) -> DataFrame:
        """(book_id, header_path, body_path, header, body, modified) of complete books; of copies the newest pair."""
        h = self._found("header").select("book_id", "d1", "d2", F.col("path").alias("header_path"), decode(F.col("content")).alias("header"))
        b = self._found("body", since).select("book_id", "d1", "d2", F.col("path").alias("body_path"), "modified", decode(F.col("content")).alias("body"))
        both = b.join(h, ["book_id", "d1", "d2"])
        return both.groupBy("book_id").agg(F.max(F.struct("d1", "d2", "header_path", "body_path", "header", "body", "modified")).alias("x")).select(
            "book_id", "x.header_path", "x.body_path", "x.header", "x.body", "x.modified")

    def bodies(self, ids: list[int]) -> DataFrame:
        """(book_id, body) of a batch of complete books, from their files alone: the layout's rule names them."""
        found = [(i, p) for i in ids if (p := self.lookup(i))]
        if not found:
            return self.spark.createDataFrame([], "book_id long, body string")
        place = self.workspace.resolve()
        files = self.spark.read.format("binaryFile").load([str(place / body) for _, (_, body) in found])
        part = "/(\\d+)/body\\.txt$" if self.layout == "book" else "/(\\d+)\\.body\\.txt$"
        return files.select(F.regexp_extract("path", part, 1).cast("long").alias("book_id"), decode(F.col("content")).alias("body"))

    def list_new(self, since: str | None = None) -> DataFrame:
        return self._found("body", since).select("book_id").distinct().orderBy("book_id")

    def lookup(self, book_id: int) -> tuple[str, str] | None:
        """Relative paths of a book, by the layout's rule and the file system alone."""
        if self.layout == "time":
            found = sorted(self.workspace.glob(f"datalake/[0-9]*/[0-9][0-9]/{book_id}.body.txt"), reverse=True)
            for body in found:
                header = body.with_name(f"{book_id}.header.txt")
                if header.is_file():
                    return str(header.relative_to(self.workspace)), str(body.relative_to(self.workspace))
            return None
        names = tuple(relative(self.layout, book_id, datetime.now(UTC), part) for part in ("header", "body"))
        return names if all((self.workspace / n).is_file() for n in names) else None
