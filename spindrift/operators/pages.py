"""Ordered pages of events with a cursor.

The order is total: ``(ts, file_idx, line_no)``.  A page is a top-k, so no task
sorts more than it reads and the driver gets at most ``limit`` + 1 rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..lang import syntax as ast
from ..plans.compiler import search, with_parsed

DEFAULT_LIMIT, MOST = 500, 10_000


class Key(NamedTuple):
    ts: int
    file_idx: int
    line_no: int


KEY = Key._fields


@dataclass
class Page:
    rows: list[Row]
    next: Key | None


def clamped(limit: int | None) -> int:
    return min(max(DEFAULT_LIMIT if limit is None else limit, 1), MOST)


def order(forward: bool) -> list[Column]:
    return [F.col(k).asc() if forward else F.col(k).desc() for k in KEY]


def beyond(key: Key, forward: bool) -> Column:
    """Strictly after a key in the direction.  The first test alone can prune by time."""
    ts, file_idx, line_no = (F.col(k) for k in KEY)
    ahead = (lambda a, b: a > b) if forward else (lambda a, b: a < b)
    reachable = ts >= key.ts if forward else ts <= key.ts
    return reachable & (ahead(ts, key.ts) | (ts == key.ts) & (ahead(file_idx, key.file_idx) | (file_idx == key.file_idx) & ahead(line_no, key.line_no)))


def page_of(events: DataFrame, query: ast.Query | str = "", *, start: int | None = None, end: int | None = None, limit: int | None = None, forward: bool = False, after: Key | None = None, extra: int = 0) -> DataFrame:
    """The page's rows in order (``extra`` more than the limit)."""
    if after is not None:
        events = events.where(beyond(Key(*after), forward))
    found = search(events, query, False, start, end).orderBy(*order(forward)).limit(clamped(limit) + extra)
    return with_parsed(found, query)


def rows(events: DataFrame, query: ast.Query | str = "", **request) -> Page:
    """A page and the key to go on from, if there is more."""
    limit = clamped(request.get("limit"))
    found = page_of(events, query, extra=1, **request).collect()
    more = len(found) > limit
    found = found[:limit]
    return Page(found, Key(*(found[-1][k] for k in KEY)) if more else None)
