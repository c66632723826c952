"""Values of labels and fields with their counts, over all events of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.compiler import CORE, STREAM

KEPT, LONGEST = 300, 200


def stream_values(events: DataFrame) -> DataFrame:
    """``(name, value, count)`` of the stream labels, from one grouping."""
    groups = events.groupBy(*STREAM).agg(F.count("*").alias("n"))
    entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in STREAM])
    return groups.select(F.explode(entries).alias("e"), "n").groupBy("e.name", "e.value").agg(F.sum("n").alias("count"))


def field_values(events: DataFrame) -> DataFrame:
    """``(name, value, count, truncated)``: the most frequent values of the core columns and stored fields.

    Values that are empty, longer than 200 bytes or of several lines don't
    count.  All values are counted, then the first 300 of each name kept;
    ``truncated`` says whether there were more.
    """
    core = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in CORE])
    each = events.select(F.explode(F.concat(core, F.col("fields"))).alias("e")).select("e.name", "e.value")
    usable = each.where((F.col("value") != "") & (F.octet_length("value") <= LONGEST) & ~F.col("value").contains("\n"))
    counted = usable.groupBy("name", "value").agg(F.count("*").alias("count"))
    # a rank limit over a window keeps only the first rows of each partition before the shuffle
    w = Window.partitionBy("name").orderBy(F.desc("count"), "value")
    ranked = counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= KEPT + 1)
    more = F.max("rank").over(Window.partitionBy("name")) > KEPT
    return ranked.withColumn("truncated", more).where(F.col("rank") <= KEPT).select("name", "value", "count", "truncated")


def labels(streams: DataFrame, stored: DataFrame) -> DataFrame:
    """``(position, name, stream, values, truncated)``: level, source, file, then logger, exception, thread, then fields by total."""
    by_value = lambda: F.expr("array_sort(collect_list(struct(value, count)), (a, b) -> CASE WHEN a.count <> b.count THEN IF(a.count > b.count, -1, 1) WHEN a.value < b.value THEN -1 WHEN a.value > b.value THEN 1 ELSE 0 END)")
    s = streams.groupBy("name").agg(by_value().alias("values"), F.sum("count").alias("all")).select("name", F.lit(True).alias("stream"), "values", F.lit(False).alias("truncated"), "all")
    f = stored.where(~F.col("name").isin(*STREAM)).groupBy("name").agg(by_value().alias("values"), F.max("truncated").alias("truncated"), F.sum("count").alias("all")).select("name", F.lit(False).alias("stream"), "values", "truncated", "all")
    fixed = F.array_position(F.array(*map(F.lit, ("level", "source", "file", "logger", "exception", "thread"))), F.col("name"))
    place = Window.orderBy(F.when(fixed > 0, fixed).otherwise(99), F.desc("all"), "name")  # one row for each name
    return s.unionByName(f).withColumn("position", F.row_number().over(place)).drop("all")
