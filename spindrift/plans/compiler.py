"""A query's syntax tree as DataFrame operations over events.

Events have the columns ``ts level source file file_idx line_no logger thread
exception fields message ts_inferred``.  Stream labels and ``level`` become plain
column predicates, so partition pruning and Parquet statistics apply; line
filters and typed comparisons are built-in expressions.  Only ``| json``, and
regexes that backtracking can't be trusted with, run an Arrow function, over rows that the filters before it kept, and only for the
fields that later filters read; parser stages that no filter reads are left
out.  What is shown of the extracted fields is extracted at the very end, on the
rows that are returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fields as fx
from ..functions import regexes as rx
from ..functions import values as vx
from ..lang import parse
from ..lang import syntax as ast
from ..lang.dialect import translate

STREAM = ("source", "file", "level")
CORE = ("logger", "thread", "exception")
PARSED = "parsed"

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.LongType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("file", T.StringType(), False),
        T.StructField("file_idx", T.IntegerType(), False),
        T.StructField("line_no", T.LongType(), False),
        T.StructField("logger", T.StringType(), False),
        T.StructField("thread", T.StringType(), False),
        T.StructField("exception", T.StringType(), False),
        T.StructField("fields", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("ts_inferred", T.BooleanType(), False),
    ]
)


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def text_test(value: Column, op: str, literal: str, fold: bool = False) -> Column:
    """``= == != =~ !~`` on text that is never null; regexes must match the whole text."""
    if op in ("=", "==", "!="):
        same = value == F.lit(literal.lower() if fold else literal)
        return ~same if op == "!=" else same
    hit = rx.matches(value, literal, whole=True, fold=fold)
    return ~hit if op == "!~" else hit


def stored_field(name: str) -> Column:
    """The first value that ingest stored under a name, or null."""
    return F.try_element_at(F.filter("fields", lambda p: p["name"] == name), F.lit(1))["value"]


def matcher(m: ast.Matcher) -> Column:
    if m.name in STREAM:
        return text_test(F.col(m.name), m.op, m.value, fold=m.name == "level")
    value = F.col(m.name) if m.name in CORE else stored_field(m.name)
    if m.op == "=" and m.value:
        return value == F.lit(m.value)  # null doesn't match either; this form reaches the scan
    return text_test(_text(value), m.op, m.value)


def line_filter(stage: ast.Line) -> Column:
    message = F.col("message")
    if stage.op in ("|=", "!="):
        hit = reduce(Column.__or__, [message.contains(v) for v in stage.values])
    else:
        hit = rx.any_matches(message, tuple(stage.values))
    return ~hit if stage.op in ("!=", "!~") else hit


class Extracted:
    """The fields of the parser stages so far: a value for each name that a filter reads.

    A later stage's value comes before an earlier one's.  Stages that need an
    Arrow function keep their fields in a column, so it runs once.
    """

    def __init__(self):
        self.stages: list[tuple[ast.Stage, str | None]] = []

    def value(self, name: str) -> Column | None:
        found = []
        for stage, column in reversed(self.stages):
            if column:
                found.append(fx.lookup(F.col(column), name))
            elif isinstance(stage, ast.Logfmt):
                found.append(fx.logfmt_value(vx.first_line(F.col("message")), name))
            elif name in translate(stage.pattern).groups:
                found.append(fx.regexp_value(F.col("message"), stage.pattern, name))
        return F.coalesce(*found) if found else None


def field_value(name: str, extracted: Extracted) -> Column:
    """Extracted fields come first, then the core columns, then what ingest stored; missing is empty."""
    own = extracted.value(name)
    stored = F.col(name) if name in CORE else stored_field(name)
    return F.coalesce(*([own] if own is not None else []), stored, F.lit(""))


def condition(e: ast.Expression, extracted: Extracted) -> Column:
    """A boolean that is never null."""
    if isinstance(e, ast.Both):
        return condition(e.left, extracted) & condition(e.right, extracted)
    if isinstance(e, ast.Either):
        return condition(e.left, extracted) | condition(e.right, extracted)
    kind, literal = e.literal.kind, e.literal.value
    if kind == "string":
        if e.name != "level":
            return text_test(field_value(e.name, extracted), e.op, literal)
        own, named = F.col("level"), extracted.value("level")
        if named is not None:
            own = F.when(named.isNotNull(), vx.level_of(named)).otherwise(own)
        return text_test(own, e.op, literal, fold=True)
    reading = {"number": vx.number_of, "duration": vx.duration_of, "bytes": vx.bytes_of}[kind]
    return vx.compared(reading(field_value(e.name, extracted)), e.op, literal)


def names_read(e: ast.Expression) -> set[str]:
    return {e.name} if isinstance(e, ast.Compare) else names_read(e.left) | names_read(e.right)


def _read_later(stages: tuple[ast.Stage, ...], at: int) -> frozenset[str]:
    """Names that filters after a stage read."""
    return frozenset().union(*(names_read(s.expression) for s in stages[at + 1 :] if isinstance(s, ast.Filter)))


def _by_arrow(stage: ast.Stage, names: frozenset[str] | None = None) -> Column | None:
    """The fields of a stage that needs an Arrow function; None for the others."""
    if isinstance(stage, ast.Json):
        return fx.json_fields(F.col("message"), names)
    if isinstance(stage, ast.Regexp) and not rx.trusted(stage.pattern):
        return rx.groups(F.col("message"), stage.pattern)
    return None


def search(events: DataFrame, query: ast.Query | str, show_parsed: bool = True, start: int | None = None, end: int | None = None) -> DataFrame:
    """The events that a query matches, within ``start <= ts < end``.

    With ``show_parsed`` they get the column ``parsed``: the fields that the
    query's parser stages extracted.
    """
    query = parse(query) if isinstance(query, str) else query
    out = events
    if start is not None:
        out = out.where(F.col("ts") >= start)
    if end is not None:
        out = out.where(F.col("ts") < end)
    for m in query.selector:
        out = out.where(matcher(m))
    extracted = Extracted()
    for k, stage in enumerate(query.stages):
        if isinstance(stage, ast.Line):
            out = out.where(line_filter(stage))
        elif isinstance(stage, ast.Filter):
            out = out.where(condition(stage.expression, extracted))
        elif later := _read_later(query.stages, k):
            made = _by_arrow(stage, later)
            column = f"_fields_{k}" if made is not None else None
            if column:
                out = out.withColumn(column, made)
            extracted.stages.append((stage, column))
    kept = out.select(*events.columns)
    return with_parsed(kept, query) if show_parsed else kept


def with_parsed(matches: DataFrame, query: ast.Query | str) -> DataFrame:
    """Events with ``parsed``: what the query's parser stages extract from each."""
    query = parse(query) if isinstance(query, str) else query
    message = F.col("message")
    found, names = [], []
    for k, stage in enumerate(query.stages):
        if (made := _by_arrow(stage)) is not None:
            names.append(f"_fields_{k}")
            matches = matches.withColumn(names[-1], made)
            found.append(F.col(names[-1]))
        elif isinstance(stage, ast.Logfmt):
            found.append(fx.logfmt_fields(vx.first_line(message)))
        elif isinstance(stage, ast.Regexp):
            found.append(fx.regexp_fields(message, stage.pattern))
    return matches.withColumn(PARSED, fx.last_of_each(F.concat(*found)) if found else fx.empty_pairs()).drop(*names)
