"""Sharding by sampled splitters.

Records are ordered by a key (the text's hash, then the id), so equal texts
stand together.  A sample drawn by size gives splitters at equal shares of the
bytes; records are dealt into these fine ranges, and as the sample holds whole
(hash, id) keys, a hash that fills more than a range is subdivided by id.
Counts and bytes of the ranges, added up, put every record at its exact
position in the whole order, and shards are cut at equal shares of that.  A cut
that falls inside a group of equal texts moves to the nearer end of the group,
unless the group is larger than ``whole_percent`` of a shard: then it is
subdivided between records.

No task gets more than a range, and the driver sees the bounded sample, one row
for each range and at most one group for each cut.

Null texts have size 1 (no bytes plus 1); records without an id come first
among equal texts, each with a number of its own, so any number of them can be
split.  Identical records are ordered arbitrarily among themselves.
Extra columns are kept by ``shard`` and ignored by the query.  An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, fresh, spread, written


def range_numbers(keys: np.ndarray, ties: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The range of each (key, tie): splitters (n x 2, sorted) at or below it."""
    heads = splitters[:, 0]
    low = np.searchsorted(heads, keys, side="left")
    high = np.searchsorted(heads, keys, side="right")
    out = low.copy()
    hot = np.nonzero(high > low)[0]
    for at in np.unique(low[hot]):  # each is one key that is itself a splitter
        of = hot[low[hot] == at]
        out[of] = at + np.searchsorted(splitters[at : high[of[0]], 1], ties[of], side="right")
    return out


def splitters_of(sample: np.ndarray, ranges: int) -> np.ndarray:
    """Keys at equal shares of a sample that was drawn by size."""
    if not len(sample):
        return np.zeros((0, 2), np.int64)
    ordered = sample[np.lexsort((sample[:, 1], sample[:, 0]))]
    at = np.arange(1, ranges) * len(ordered) // ranges
    return np.unique(ordered[at], axis=0)


def cut_points(total: int, shards: int) -> list[float]:
    return [k * total / shards for k in range(1, shards)]


def shard(records: DataFrame, shards: int = 8, id_col: str = "doc_id", key_col: str = "key", size_col: str = "size", per_range: int = 200_000, sample_per_range: int = 32, whole_percent: int = 10, seed: int = 3) -> DataFrame:
    """``records`` with ``shard`` and ``slot`` (gapless in a shard); sizes of the shards near equal.

    key_col is a long (equal for records to be kept together); the number of
    ranges is rows / per_range within 256 and 16,384, the sample
    sample_per_range records for each.
    """
    names = records.columns
    tie, number, row, to, end, begin, place, n_before, b_before = fresh(records, "tie", "range", "row", "to", "end", "begin", "place", "rows_before", "bytes_before")
    keyed = records.withColumn(tie, F.xxhash64(F.col(id_col)))
    if records.where(F.col(id_col).isNull()).limit(1).count():
        # records without an id may be alike in everything: a number each, written so that it stays
        keyed = written(keyed.withColumn(tie, F.when(F.col(id_col).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col(tie))), "ties")
    rows, total = records.agg(F.count("*"), F.coalesce(F.sum(size_col), F.lit(0))).first()
    ranges = int(max(256, min(16_384, rows // per_range)))
    share = F.col(size_col) * F.lit(ranges * sample_per_range / max(total, 1))
    drawn = keyed.where(spread(F.struct(tie, key_col), seed) < share).select(key_col, tie).toPandas()
    cuts = splitters_of(drawn.to_numpy(dtype=np.int64), ranges)
    ordered_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)
    at_key, at_tie = keyed.columns.index(key_col), keyed.columns.index(tie)

    def make():
        def run(batch):
            found = range_numbers(batch.column(at_key).to_numpy(), batch.column(at_tie).to_numpy(), cuts)
            return {n: batch.column(k) for k, n in enumerate(batch.schema.names)} | {number: found}

        return run

    ranged = by_batch(keyed, f"{ordered_schema}, `{number}` long", make)
    by_range = Window.partitionBy(number).orderBy(key_col, tie, id_col)
    inner = written(ranged.withColumn(row, F.row_number().over(by_range)).withColumn(to, F.sum(size_col).over(by_range.rowsBetween(Window.unboundedPreceding, 0))), "ranges")
    stats = inner.groupBy(number).agg(F.count("*").alias("n"), F.sum(size_col).alias("b")).orderBy(number).toPandas()
    stats[n_before] = stats.n.cumsum() - stats.n
    stats[b_before] = stats.b.cumsum() - stats.b
    before = records.sparkSession.createDataFrame(stats[[number, n_before, b_before]].astype("int64"), f"{number} long, {n_before} long, {b_before} long")
    # one row for each range, 16,384 at most
    placed = inner.join(F.broadcast(before), number).withColumn(end, F.col(to) + F.col(b_before)).withColumn(begin, F.col(end) - F.col(size_col)).withColumn(place, F.col(row) + F.col(n_before) - 1)

    points = cut_points(total, shards)
    inside = F.lit(False)
    for p in points:
        inside = inside | ((F.col(begin) < p) & (F.col(end) > p))
    # at most one record, and so one group, for each cut; its range holds the group or the group is larger than that
    hit = [r[0] for r in placed.where(inside).select(key_col).distinct().collect()]
    groups = placed.where(F.col(key_col).isin(hit)).groupBy(key_col).agg(F.min(begin), F.max(end)).collect() if hit else []
    for _, low, high in groups:
        if high - low <= total / shards * whole_percent / 100:
            points = [(low if p - low < high - p else high) if low < p < high else p for p in points]
    middle = (F.col(begin) + F.col(end)) / 2
    dealt = sum(((middle > p).cast("int") for p in points), F.lit(0))
    cut = placed.withColumn("shard", dealt.cast("int"))
    first = {r["shard"]: r["n"] for r in cut.groupBy("shard").agg(F.min(place).alias("n")).collect()}
    start = F.lit(0)
    for k, n in first.items():
        start = F.when(F.col("shard") == k, F.lit(n)).otherwise(start)
    return cut.select(*names, "shard", (F.col(place) - start).cast("long").alias("slot"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, size, crc32 and key of each text, without the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("key"))


def op3_sharding(spark, sf_dir):
    from .common import table

    slim = written(sized(table(spark, sf_dir, "documents")), "sizes")
    return shard(slim).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
