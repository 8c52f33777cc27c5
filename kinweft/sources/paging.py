"""Reading a provider page by page, within bounds, from a cursor to a cursor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from kinweft.config import ConfigError
from kinweft.operators.adapters import LIMITS

#: Errors after which the same cursor can be asked again.
RETRYABLE = {"RATE_LIMITED": "rate_limited", "TEMPORARY": "temporary_error"}


@dataclass(frozen=True)
class Page:
    """A provider's answer: some records and the cursor of the next page (None: the last one), or an error."""

    records: list[dict[str, Any]] = field(default_factory=list)
    next_cursor: str | None = None
    error: str | None = None
    retry_after: int | None = None


@dataclass
class Progress:
    """How far a reading came.  ``cursor`` is where the next reading starts."""

    cursor: str | None
    status: str = "reading"
    pages: int = 0
    records: int = 0
    retry_after: int | None = None


def pages(read: Callable[[str | None, int], Page], progress: Progress, limit: int = 100) -> Iterator[list[dict[str, Any]]]:
    """The pages after ``progress.cursor``, which moves on only when the next page is asked for.

    So a consumer that fails leaves the cursor at the page that it did not finish.  A retryable error ends the
    reading at its cursor with a status; any other one, a cursor that comes again, a page above the limit, and a
    reading of too many pages or records raise.
    """
    limit, seen = min(limit, LIMITS["page"]), set()
    while progress.pages < LIMITS["pages"] and progress.records < LIMITS["records"]:
        if progress.cursor in seen:
            raise ConfigError("CURSOR_REPLAY_LOOP")
        seen.add(progress.cursor)
        page = read(progress.cursor, limit)
        if len(page.records) > limit:
            raise ConfigError("ADAPTER_PAGE_LIMIT_EXCEEDED")
        if page.error in RETRYABLE:
            progress.status, progress.retry_after = RETRYABLE[page.error], page.retry_after
            return
        if page.error is not None:
            raise ConfigError(f"PROVIDER_{page.error}")
        yield page.records
        progress.pages, progress.records = progress.pages + 1, progress.records + len(page.records)
        if page.next_cursor is None:
            # what just reached a bound is not known to be whole
            if progress.pages >= LIMITS["pages"] or progress.records >= LIMITS["records"]:
                break
            progress.status = "completed"
            return
        progress.cursor = page.next_cursor
    raise ConfigError("INVOCATION_BOUND_EXCEEDED")


def listed(records: list[dict[str, Any]]) -> Callable[[str | None, int], Page]:
    """A provider of records in memory; its cursor is the number of the next record."""
    if len(records) > LIMITS["records"]:
        raise ConfigError("FIXTURE_LIMIT_EXCEEDED")

    def read(cursor: str | None, limit: int) -> Page:
        if cursor is not None and not (cursor.isascii() and cursor.isdigit() and int(cursor) <= len(records)):
            return Page(error="INVALID_CURSOR")
        at = int(cursor or 0)
        end = at + limit
        return Page(records[at:end], str(end) if end < len(records) else None)

    return read
