"""Counts and level-stacked histograms of matching events.

One aggregation by (bucket, level), combined before its shuffle, gives both the
total and the histogram; the result has at most some 120 buckets times 7 levels,
whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import LEVELS
from ..lang import syntax as ast
from ..plans.compiler import search

TARGET = 120
SECOND, MINUTE, HOUR, DAY = 1_000, 60_000, 3_600_000, 86_400_000
#: Bucket widths in milliseconds.
STEPS = (
    *(1, 2, 5, 10, 20, 50, 100, 200, 500),
    *(n * SECOND for n in (1, 2, 5, 10, 15, 30)),
    *(n * MINUTE for n in (1, 2, 5, 10, 15, 30)),
    *(n * HOUR for n in (1, 2, 3, 6, 12)),
    *(n * DAY for n in (1, 2, 7, 14, 30)),
)


def nice_step(start: int, end: int) -> int:
    """The least width that gives at most ``TARGET`` whole buckets; beyond the table, multiples of its last."""
    span = max(end - start, 1)
    fitting = (s for s in STEPS if span // s <= TARGET)
    return next(fitting, (span // TARGET // STEPS[-1] + 1) * STEPS[-1])


@dataclass(frozen=True)
class Buckets:
    start: int
    step: int
    count: int


def buckets_of(start: int, end: int) -> Buckets:
    step = nice_step(start, end)
    first = start // step * step
    return Buckets(first, step, max(1, -(-(end - first) // step)))


def bounds(events: DataFrame) -> tuple[int, int]:
    """The range of all events, whatever the query; (0, 1) if there are none."""
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    return (0, 1) if low is None else (low, high + 1)


def counts(events: DataFrame, query: ast.Query | str, buckets: Buckets, start: int | None = None, end: int | None = None) -> DataFrame:
    """``(bucket, level, count)`` of what occurs; bucket numbers from 0, clamped at both ends."""
    found = search(events.select("ts", "level", *_columns(events)), query, False, start, end)
    at = ((F.col("ts") - F.pmod(F.col("ts"), F.lit(buckets.step)) - buckets.start) / buckets.step).cast("long")
    at = F.least(F.greatest(at, F.lit(0)), F.lit(buckets.count - 1))
    return found.groupBy(at.alias("bucket"), F.col("level")).agg(F.count("*").alias("count"))


def _columns(events: DataFrame) -> list[str]:
    return [c for c in events.columns if c not in ("ts", "level")]


def histogram(events: DataFrame, query: ast.Query | str = "", start: int | None = None, end: int | None = None, all_bounds: tuple[int, int] | None = None) -> DataFrame:
    """``(bucket_start, level, count)``, zero where nothing matches.

    An open end of the range is that of all events (``all_bounds`` spares the job
    that looks for it).
    """
    if start is None or end is None:
        low, high = all_bounds or bounds(events)
    b = buckets_of(low if start is None else start, high if end is None else end)
    spark = events.sparkSession
    grid = spark.range(b.count).select(F.col("id").alias("bucket"), F.explode(F.array(*map(F.lit, LEVELS))).alias("level"))
    full = grid.join(F.broadcast(counts(events, query, b, start, end)), ["bucket", "level"], "left")
    return full.select((F.col("bucket") * b.step + b.start).alias("bucket_start"), "level", F.coalesce("count", F.lit(0)).alias("count"))


def stacked(histogram_rows: DataFrame) -> DataFrame:
    """Running sums over the levels of each bucket, for levels that occur at all."""
    present = histogram_rows.groupBy("level").agg(F.sum("count").alias("n")).where("n > 0").select("level")
    ordinal = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    w = Window.partitionBy("bucket_start").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    return histogram_rows.join(F.broadcast(present), "level", "left_semi").select("bucket_start", "level", F.sum("count").over(w).alias("cumulative"))


def total(events: DataFrame, query: ast.Query | str = "", start: int | None = None, end: int | None = None) -> DataFrame:
    return search(events, query, False, start, end).agg(F.count("*").alias("total"))


@dataclass
class Aggregate:
    total: int
    buckets: Buckets
    table: list[list[int]]  # for each bucket a count by level, in the order of LEVELS


def aggregate(events: DataFrame, query: ast.Query | str = "", start: int | None = None, end: int | None = None, all_bounds: tuple[int, int] | None = None) -> Aggregate:
    """Total and dense histogram from one job."""
    if start is None or end is None:
        low, high = all_bounds or bounds(events)
    b = buckets_of(low if start is None else start, high if end is None else end)
    table = [[0] * len(LEVELS) for _ in range(b.count)]
    for r in counts(events, query, b, start, end).collect():
        table[r["bucket"]][LEVELS.index(r["level"])] = r["count"]
    return Aggregate(sum(map(sum, table)), b, table)
