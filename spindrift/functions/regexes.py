"""Regex tests and groups as columns: in the JVM where that is safe, else by the linear-time automaton."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.automaton import automaton, trusted_length
from ..lang.dialect import PREFIX, translate

PAIRS = "array<struct<name:string,value:string>>"
_PAIRS_ARROW = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def _java(source: str, whole: bool, fold: bool) -> str:
    made = translate(source)
    java = made.whole() if whole else made.java
    return PREFIX.replace(")", "i)") + java[len(PREFIX) :] if fold else java


def _by_automaton(value: Column, source: str, whole: bool, fold: bool) -> Column:
    automaton(source, whole, fold)  # a pattern that is too large is refused here

    @F.arrow_udf("boolean")
    def test(texts: pa.Array) -> pa.Array:
        found = automaton(source, whole, fold).found
        return pa.array([None if x is None else found(x) for x in texts.to_pylist()], type=pa.bool_())

    return test(value)


def matches(value: Column, source: str, whole: bool = False, fold: bool = False) -> Column:
    """Whether a regex is found in a text (or matches the whole of it)."""
    java, longest = _java(source, whole, fold), trusted_length(source, whole)
    if longest is None:
        return value.rlike(java)
    if longest == 0:
        return _by_automaton(value, source, whole, fold)
    short = F.length(value) <= longest
    return F.when(short, value.rlike(java)).otherwise(_by_automaton(F.when(~short, value), source, whole, fold))


def any_matches(value: Column, sources: tuple[str, ...]) -> Column:
    """Whether any of the regexes is found in a text; those that are safe become one."""
    safe = [s for s in sources if trusted_length(s) is None]
    hits = [matches(value, s) for s in sources if s not in safe]
    if safe:
        hits.insert(0, value.rlike(PREFIX + "|".join(f"(?:{translate(s).java[len(PREFIX) :]})" for s in safe)))
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


def trusted(source: str) -> bool:
    return trusted_length(source) is None


def groups(value: Column, source: str) -> Column:
    """Named groups of the first match that took part, by the automaton."""
    automaton(source)

    @F.arrow_udf(PAIRS)
    def fields(texts: pa.Array) -> pa.Array:
        find = automaton(source).groups
        return pa.array([[{"name": k, "value": v} for k, v in (find(x) or ())] if x is not None else [] for x in texts.to_pylist()], type=_PAIRS_ARROW)

    return fields(value)
