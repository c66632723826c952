"""Fields that parser stages take out of a message.

All of them give ``array<struct<name,value>>`` in order of appearance; a name
that occurs again takes the later value (``lookup`` reads the last one).
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.dialect import PREFIX, translate
from .regexes import _PAIRS_ARROW, PAIRS
from .values import first_line, once

#: A key up to its ``=``, then a quoted value (closed or not) or one up to the next space.
_LOGFMT = r'([^= ]*)=(?:"((?:\\[\s\S]|[^"\\])*\\?)"?|([^ ]*))'


def empty_pairs() -> Column:
    return F.array().cast(PAIRS)


def logfmt_fields(line: Column) -> Column:
    """``key=value`` pairs of a line, in built-in expressions."""
    part = lambda n: F.regexp_extract_all(line, F.lit(_LOGFMT), F.lit(n))
    zipped = F.arrays_zip(part(1).alias("name"), part(2).alias("quoted"), part(3).alias("bare"))
    known = F.filter(zipped, lambda p: p["name"].rlike(r"\A[A-Za-z0-9_.-]+\z"))
    value = lambda p: F.when(p["quoted"] != "", F.regexp_replace(p["quoted"], r"\\([\s\S])", "$1")).otherwise(p["bare"])
    found = F.transform(known, lambda p: F.struct(p["name"].alias("name"), value(p).alias("value")))
    return F.when(F.instr(line, "=") > 0, found).otherwise(empty_pairs())


def logfmt_value(line: Column, name: str) -> Column:
    """The last value under one key, or null, without an array where no value is quoted."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
        return F.lit(None).cast("string")
    key = re.escape(name)
    # the key comes along, so that an empty value differs from none
    pair = lambda x: F.regexp_extract(x, rf"(?s)\A(?:.* )?({key}=[^ ]*)", 1)
    value = lambda x: once(pair(x), lambda p: F.when(p != "", F.substring(p, len(name) + 2, 1 << 30)))
    return once(line, lambda x: F.when(x.contains('="'), lookup(logfmt_fields(x), name)).otherwise(value(x)))


def regexp_value(message: Column, pattern: str, name: str) -> Column:
    """One named group of the first match, or null if it took no part."""
    made = translate(pattern)
    if name not in made.groups:
        return F.lit(None).cast("string")
    n = made.groups[name]
    value = F.regexp_extract(message, made.java, n)
    return F.when(message.rlike(made.java) & _present(message, made, pattern, n, value), value)


def _present(message: Column, made, pattern: str, n: int, value: Column) -> Column:
    # an empty group may not have taken part; a back-reference to it then fails
    if _always_takes_part(pattern):
        return F.lit(True)
    return (value != "") | message.rlike(f"{PREFIX}(?:{made.java[len(PREFIX) :]})\\{n}")


def regexp_fields(message: Column, pattern: str) -> Column:
    """Named groups of the first match; groups that took no part are left out."""
    made = translate(pattern)
    names = sorted(made.groups, key=made.groups.get)
    hit = message.rlike(made.java)
    pairs = []
    for name in names:
        n = made.groups[name]
        value = F.regexp_extract(message, made.java, n)
        present = _present(message, made, pattern, n, value)
        pairs.append(F.when(hit & present, F.struct(F.lit(name).alias("name"), value.alias("value"))))
    return F.when(hit, F.filter(F.array(*pairs), lambda p: p.isNotNull())).otherwise(empty_pairs())


def _always_takes_part(pattern: str) -> bool:
    """Whether no group can be left out: there is no alternation and no optional group."""
    return "|" not in pattern and not re.search(r"\)(?:[?*]|\{0)", pattern)


def lookup(pairs: Column, name: str) -> Column:
    """The last value under a name, or null."""
    return F.try_element_at(F.filter(pairs, lambda p: p["name"] == name), F.lit(-1))["value"]


def last_of_each(pairs: Column) -> Column:
    """Each name once, where it first stands, with its last value."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.try_element_at(F.filter(pairs, lambda p: p["name"] == n), F.lit(-1))["value"].alias("value")))


# -- JSON --------------------------------------------------------------------


def _refuse(word: str):
    raise ValueError(word)


def _whole(text: str):
    """An integer that fits 64 bits is one; a larger one is a float."""
    value = int(text)
    if text == "-0":
        return -0.0
    return value if -(1 << 63) <= value < 1 << 64 else _finite(text)


def _finite(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return value


_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_int=_whole, parse_float=_finite)


def read_json(text: str):
    """Strict JSON; ValueError otherwise."""
    text = text.strip(" \t\n\r")
    value, end = _DECODER.raw_decode(text)
    if end != len(text):
        raise ValueError("trailing characters")
    return value


def number_text(value: int | float) -> str:
    """Shortest text that reads back: integers as they are, floats with a point or an exponent."""
    if isinstance(value, int):
        return str(value)
    if value == 0:
        return "-0.0" if str(value).startswith("-") else "0.0"
    sign, digits, exponent = _shortest(value)
    point = len(digits) + exponent
    if 0 < point <= 16:
        body = digits + "0" * exponent + ".0" if exponent >= 0 else digits[:point] + "." + digits[point:]
    elif -5 < point <= 0:
        body = "0." + "0" * -point + digits
    else:
        body = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{point - 1}"
    return sign + body


def _shortest(value: float) -> tuple[str, str, int]:
    mantissa, _, power = f"{value!r}".lower().lstrip("-").partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    exponent = int(power or 0) - len(part)
    kept = digits.rstrip("0")
    return "-" if value < 0 else "", kept, exponent + len(digits) - len(kept)


def json_text(value) -> str:
    """Compact JSON with sorted keys."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "null"
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(json_text, value)) + "]"
    return "{" + ",".join(f"{json_text(k)}:{json_text(v)}" for k, v in sorted(value.items())) + "}"


_OTHER_KEY = re.compile(r"[^0-9A-Za-z]")


def json_pairs(line: str | None, names: frozenset[str] | None = None) -> list[tuple[str, str]]:
    """Leaves of the object in a line, nested keys joined by ``_``; nulls and lines without an object give none."""
    line = line or ""
    if not line.lstrip().startswith("{"):
        start, end = line.find("{"), line.rfind("}")
        if start < 0 or end <= start:
            return []
        line = line[start : end + 1]
    try:
        top = read_json(line)
        line.encode()
    except (ValueError, RecursionError):
        return []
    out: dict[str, str] = {}

    def visit(prefix: str, value) -> None:
        if isinstance(value, dict):
            for key, inner in sorted(value.items()):
                key = _OTHER_KEY.sub("_", key)
                visit(f"{prefix}_{key}" if prefix else key, inner)
        elif value is not None and (names is None or prefix in names):
            out[prefix] = value if isinstance(value, str) else json_text(value)

    visit("", top)
    try:
        "".join(out.values()).encode()
    except UnicodeEncodeError:  # half of a surrogate pair
        return []
    return list(out.items())


def json_fields(message: Column, names: frozenset[str] | None = None) -> Column:
    """Fields of the JSON object in the first line; with ``names`` only those."""

    @F.arrow_udf(PAIRS)
    def fields(lines: pa.Array) -> pa.Array:
        return pa.array([[{"name": k, "value": v} for k, v in json_pairs(x, names)] for x in lines.to_pylist()], type=_PAIRS_ARROW)

    return fields(first_line(message))
