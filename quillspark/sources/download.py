"""Raw texts from a mirror (http, https or file), with bounded retries; also as a Spark data source."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DEFAULT_BASE = "https://www.gutenberg.org"
WAITS = (1.0, 2.0, 4.0)


class NotFound(RuntimeError):
    """The mirror has no such book."""


class DownloadError(RuntimeError):
    """Retries are exhausted, or the mirror refuses."""


def url_of(book_id: int, base: str = DEFAULT_BASE) -> str:
    return f"{base.rstrip('/')}/cache/epub/{book_id}/pg{book_id}.txt"


def fetch(book_id: int, base: str = DEFAULT_BASE, sleep: Callable[[float], None] = time.sleep, opener: Callable = urllib.request.urlopen) -> str:
    """The decoded text. A missing book fails at once; server and network errors are tried three times more."""
    request = urllib.request.Request(url_of(book_id, base), headers={"User-Agent": "quillspark/1"})
    for wait in (*WAITS, None):
        try:
            with opener(request, timeout=60) as r:
                return r.read().decode("utf-8", errors="replace")
        except urllib.error.HTTPError as e:
            if e.code == 404:
                raise NotFound(str(book_id)) from e
            if e.code < 500:
                raise DownloadError(f"{book_id}: HTTP {e.code}") from e
            last: Exception = e
        except FileNotFoundError as e:
            raise NotFound(str(book_id)) from e
        except urllib.error.URLError as e:
            if isinstance(e.reason, FileNotFoundError) or "No such file" in str(e.reason):
                raise NotFound(str(book_id)) from e
            last = e
        except OSError as e:
            last = e
        if wait is None:
            raise DownloadError(f"{book_id}: {last}") from last
        sleep(wait)
    raise AssertionError


class _Part(InputPartition):
    def __init__(self, ids: list[int]) -> None:
        self.ids = ids


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.ids = [int(i) for i in options.get("ids", "").split(",") if i.strip()]
        self.base, self.workers = options.get("base", DEFAULT_BASE), max(1, int(options.get("workers", "1")))

    def partitions(self) -> list[_Part]:
        return [_Part(self.ids[w :: self.workers]) for w in range(min(self.workers, max(1, len(self.ids))))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for i in partition.ids:
            try:
                yield i, fetch(i, self.base), None
            except NotFound:
                yield i, None, "NOT_FOUND"
            except DownloadError:
                yield i, None, "DOWNLOAD_ERROR"


class MirrorSource(DataSource):
    """``spark.read.format("mirror").option("ids", "1,2").option("workers", 4)``: (book_id, raw, error)."""

    @classmethod
    def name(cls) -> str:
        return "mirror"

    def schema(self) -> str:
        return "book_id long, raw string, error string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
