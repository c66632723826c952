"""Time ranges as an interface states them."""

from __future__ import annotations

import datetime as dt
import math
import re

#: Relative ranges on offer, in milliseconds.
PRESETS = {"Last 5 minutes": 300_000, "Last 15 minutes": 900_000, "Last 1 hour": 3_600_000, "Last 6 hours": 21_600_000, "Last 24 hours": 86_400_000, "Last 7 days": 604_800_000}
_TEXT = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[ T](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,3}))?)?)?")


def relative(ms: int, newest: int | None) -> tuple[int, int]:
    """A range that ends with the newest event (with now, if there is none)."""
    end = (newest if newest is not None else int(dt.datetime.now().timestamp() * 1000)) + 1
    return end - ms, end


def absolute(text: str, zone: dt.tzinfo | None = None) -> int | None:
    """Epoch milliseconds of ``yyyy-MM-dd[ HH:mm[:ss[.SSS]]]``, local unless a zone is given."""
    m = _TEXT.fullmatch(text.strip())
    if not m:
        return None
    day = dt.datetime(int(m[1]), 1, 1, tzinfo=zone)
    try:
        when = day.replace(month=int(m[2]), day=int(m[3]), hour=int(m[4] or 0), minute=int(m[5] or 0), second=int(m[6] or 0))
    except ValueError:
        return None
    return int(when.timestamp()) * 1000 + int((m[7] or "0").ljust(3, "0"))


def zoomed_out(start: int, end: int) -> tuple[int, int]:
    """Twice the range around its middle."""
    half = (end - start) / 2
    return math.floor(start - half), math.ceil(end + half)


def selected(left: float, right: float) -> tuple[int, int] | None:
    """A dragged selection in whole milliseconds; None if it is empty."""
    start, end = math.floor(left), math.ceil(right)
    return (start, end) if end > start else None
