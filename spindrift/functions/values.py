"""Typed readings of text columns, all in built-in expressions.

Each gives null where the text can't be read so; comparisons with null are then
made false by the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.units import BYTE_UNITS, BYTES, DURATION, DURATION_PART, DURATION_UNITS, NUMBER, UNSIGNED

#: Levels in order, and the words that are read as each.
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal", "unknown")
LEVEL_WORDS = {
    "trace": ("TRACE", "TRC", "FINEST", "FINER", "VERBOSE"),
    "debug": ("DEBUG", "DBG", "FINE", "CONFIG"),
    "info": ("INFO", "INF", "NOTICE"),
    "warn": ("WARN", "WARNING", "WRN"),
    "error": ("ERROR", "ERR", "SEVERE"),
    "fatal": ("FATAL", "CRITICAL", "CRIT", "ALERT", "EMERG", "PANIC"),
}
#: Unicode white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without white space around it."""
    return F.btrim(text, F.lit(WHITE))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used.

    Filters repeat what they refer to, which is dear for values that patterns
    take out of a message.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def level_of(text: Column) -> Column:
    """The level that a word means; words over nine bytes and unknown ones are ``unknown``."""
    word = F.upper(trimmed(text))
    found = F.lit("unknown")
    for level, words in LEVEL_WORDS.items():
        found = F.when(word.isin(*words), level).otherwise(found)
    return F.when(F.octet_length(word) > 9, "unknown").otherwise(F.coalesce(found, F.lit("unknown")))


def level_ordinal(level: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1, F.lit(len(LEVELS) - 1)).cast("int")


def number_of(text: Column) -> Column:
    """A double; text such as ``5d`` or ``0x1p3`` that a plain cast would take is refused."""
    return F.regexp_extract(trimmed(text), rf"(?i)\A{NUMBER}\z", 0).try_cast("double")


def duration_of(text: Column) -> Column:
    """Milliseconds of ``1h30m`` and the like; a bare number is seconds."""
    return once(trimmed(text), _duration)


def _duration(word: Column) -> Column:
    unit = "|".join(sorted(DURATION_UNITS, key=len, reverse=True))
    part = F.lit(rf"(-?{UNSIGNED})({unit})")
    pairs = F.arrays_zip(F.regexp_extract_all(word, part, F.lit(1)).alias("n"), F.regexp_extract_all(word, part, F.lit(2)).alias("u"))
    factors = F.create_map(*[F.lit(x) for pair in DURATION_UNITS.items() for x in pair])
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["n"].cast("double") * F.element_at(factors, p["u"]))
    # one number with its unit is the common case and needs no array
    single = F.regexp_extract(word, rf"\A{DURATION_PART}\z", 1).try_cast("double") * F.element_at(factors, F.regexp_extract(word, rf"\A{DURATION_PART}\z", 2))
    return F.when(word.rlike(rf"\A{DURATION_PART}\z"), single).when(word.rlike(rf"\A{DURATION}\z"), total).otherwise(number_of(word) * 1000.0)


def bytes_of(text: Column) -> Column:
    """Bytes of ``10MB`` and the like; a bare number is bytes."""
    return once(trimmed(text), _bytes)


def _bytes(word: Column) -> Column:
    factors = F.create_map(*[F.lit(x) for pair in BYTE_UNITS.items() for x in pair])
    size = F.regexp_extract(word, rf"(?i)\A{BYTES}\z", 1).try_cast("double")
    factor = F.element_at(factors, F.lower(F.regexp_extract(word, rf"(?i)\A{BYTES}\z", 2)))
    return F.when(word.rlike(rf"(?i)\A{BYTES}\z"), size * factor).otherwise(number_of(word))


def compared(value: Column, op: str, literal: float) -> Column:
    """IEEE comparison: nothing equals or orders with NaN; null is false for every operator."""
    if literal != literal:
        return F.coalesce(value.isNotNull(), F.lit(False)) if op == "!=" else F.lit(False)
    number = F.lit(float(literal))
    if op == "!=":
        other = F.lit(0.0 if literal else 1.0)  # differs from the literal, as NaN does
        return F.coalesce(F.nanvl(value, other) != number, F.lit(False))
    value = F.nanvl(value, F.lit(None).cast("double"))
    test = {"==": value == number, ">": value > number, ">=": value >= number, "<": value < number, "<=": value <= number}[op]
    return F.coalesce(test, F.lit(False))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)
