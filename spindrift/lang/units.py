"""Durations and byte sizes as text; the same tables serve literals and columns."""

from __future__ import annotations

import re

#: Milliseconds of a duration unit.
DURATION_UNITS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6, "d": 8.64e7}
#: Bytes of a size unit, lower case.
BYTE_UNITS = {"b": 1.0, "kb": 1e3, "mb": 1e6, "gb": 1e9, "tb": 1e12, "k": 1024.0, "kib": 1024.0, "m": 1024.0**2, "mib": 1024.0**2, "g": 1024.0**3, "gib": 1024.0**3, "tib": 1024.0**4}

UNSIGNED = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
#: Plain numbers; the guard for casts of text to double.
NUMBER = rf"[+-]?(?:inf|infinity|nan|{UNSIGNED}(?:e[+-]?[0-9]+)?)"
DURATION_PART = rf"(-?{UNSIGNED})({'|'.join(sorted(DURATION_UNITS, key=len, reverse=True))})"
#: Only the first number may have a sign.
DURATION = rf"{DURATION_PART}(?:{UNSIGNED}(?:{'|'.join(sorted(DURATION_UNITS, key=len, reverse=True))}))*"
BYTES = rf"(-?{UNSIGNED})({'|'.join(sorted(BYTE_UNITS, key=len, reverse=True))})"

_number = re.compile(NUMBER, re.I)
_duration, _part, _bytes = re.compile(DURATION), re.compile(DURATION_PART), re.compile(BYTES, re.I)


def number(text: str) -> float | None:
    return float(text) if _number.fullmatch(text) else None


def duration_ms(text: str) -> float | None:
    text = text.strip()
    if not _duration.fullmatch(text):
        return None
    return sum(float(n) * DURATION_UNITS[u] for n, u in _part.findall(text))


def byte_size(text: str) -> float | None:
    m = _bytes.fullmatch(text.strip())
    return float(m[1]) * BYTE_UNITS[m[2].lower()] if m else None
