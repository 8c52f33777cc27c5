"""A paged provider as a Spark data source: its offsets are the provider's cursors.

A provider is a function of a cursor and a page size that gives a :class:`~kinweft.sources.paging.Page`; it must be
the same wherever it runs, so it is sent along with the source.  Cursors come one from another, so one reader asks for
pages; what Spark spreads is the work on the records.  Records are objects; each becomes one row of :data:`RECORD`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from kinweft.config import ConfigError
from kinweft.functions.digest import canonical_json, sha256_hex
from kinweft.operators.adapters import LIMITS
from kinweft.sources.paging import RETRYABLE, Page, Progress, pages

RECORD = "adapter_authorization_id string, provider_record_id string, kind string, observed_at string, record_digest_sha256 string, byte_count long, fields string"
Read = Callable[[str | None, int], Page]


def row(record: dict[str, Any], authorization: str) -> tuple:
    """A provider's record as a row: its key, its digest, and all else that it says as canonical JSON."""
    whole = canonical_json(record)
    said = {k: v for k, v in record.items() if k not in ("provider_record_id", "kind", "observed_at")}
    return authorization, record["provider_record_id"], record["kind"], record["observed_at"], sha256_hex(whole), len(whole.encode()), canonical_json(said)


def folder(path: str) -> Read:
    """A provider whose pages are files of a folder: ``first.json`` and those that a page names as ``next_cursor``."""

    def read(cursor: str | None, limit: int) -> Page:
        file = Path(path) / f"{'first' if cursor is None else cursor}.json"
        if cursor is not None and not cursor.isalnum() or not file.is_file():
            return Page(error="INVALID_CURSOR")
        return Page(**json.loads(file.read_text(encoding="utf-8")))

    return read


def _page(read: Read, cursor: str | None, limit: int) -> Page:
    page = read(cursor, limit)
    if len(page.records) > limit:
        raise ConfigError("ADAPTER_PAGE_LIMIT_EXCEEDED")
    if page.error is not None and page.error not in RETRYABLE:
        raise ConfigError(f"PROVIDER_{page.error}")
    return page


class _Batch(DataSourceReader):
    """All pages from a cursor on; a provider that asks to be left alone ends the job."""

    def __init__(self, read: Read, limit: int, cursor: str | None, authorization: str):
        self.ask, self.limit, self.cursor, self.authorization = read, limit, cursor, authorization

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        progress = Progress(self.cursor)
        for records in pages(self.ask, progress, self.limit):
            yield from (row(r, self.authorization) for r in records)
        if progress.status != "completed":
            raise ConfigError(f"PROVIDER_{progress.status.upper()}")


class _Stream(SimpleDataSourceStreamReader):
    """One page for each batch.  An offset is the cursor to go on from, and how far the reading came.

    A retryable error leaves the offset where it is, so the next trigger asks the same cursor again, and so does a
    query that starts again from its checkpoint.  A cursor that comes again, and a reading of too many pages or
    records, fail.
    """

    def __init__(self, read: Read, limit: int, cursor: str | None, authorization: str):
        self.ask, self.limit, self.cursor, self.authorization = read, limit, cursor, authorization

    def initialOffset(self) -> dict[str, Any]:
        return {"cursor": self.cursor, "pages": 0, "records": 0, "seen": [], "done": False}

    def _next(self, start: dict[str, Any]) -> tuple[list[tuple], dict[str, Any]]:
        if start["pages"] >= LIMITS["pages"] or start["records"] >= LIMITS["records"]:
            raise ConfigError("INVOCATION_BOUND_EXCEEDED")
        page = _page(self.ask, start["cursor"], self.limit)
        if page.error is not None:
            return [], start
        seen = [*start["seen"], sha256_hex(start["cursor"] or "")[:16]]
        if page.next_cursor is not None and sha256_hex(page.next_cursor)[:16] in seen:
            raise ConfigError("CURSOR_REPLAY_LOOP")
        end = {"cursor": page.next_cursor, "pages": start["pages"] + 1, "records": start["records"] + len(page.records), "seen": seen, "done": page.next_cursor is None}
        return [row(r, self.authorization) for r in page.records], end

    def read(self, start: dict[str, Any]) -> tuple[Iterator[tuple], dict[str, Any]]:
        if start["done"]:
            return iter(()), start
        rows, end = self._next(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict[str, Any], end: dict[str, Any]) -> Iterator[tuple]:
        while start["pages"] < end["pages"]:
            rows, after = self._next(start)
            if after == start:
                raise ConfigError("PROVIDER_TEMPORARY_ERROR")  # the batch must be made again as it was
            yield from rows
            start = after


def provider_source(name: str, read: Read, authorization: str, limit: int = 100, cursor: str | None = None) -> type[DataSource]:
    """A data source class to register: ``spark.dataSource.register(provider_source("crm", read, "auth"))``.

    ``spark.read.format(name)`` then reads all pages after ``cursor``, ``spark.readStream.format(name)`` page by page.
    """
    limit = min(limit, LIMITS["page"])

    class Provider(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return RECORD

        def reader(self, schema: Any) -> DataSourceReader:
            return _Batch(read, limit, cursor, authorization)

        def simpleStreamReader(self, schema: Any) -> SimpleDataSourceStreamReader:
            return _Stream(read, limit, cursor, authorization)

    return Provider
