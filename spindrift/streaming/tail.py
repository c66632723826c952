"""Following logs as they are written (beyond what a workspace does).

Query stages are row-wise, so a query compiled for a table also runs on a
stream.  Lines arrive whole; each is an event of its own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..lang import syntax as ast
from ..plans.compiler import EVENT_SCHEMA, search
from ..sources.dates import UTC, Zone
from ..sources.events import Context, Event, Format
from ..sources.files import source_of


def follow(spark: SparkSession, folder: str, form: Format, zone: Zone = UTC, max_files: int = 100) -> DataFrame:
    """A stream of events from text files that appear in a folder."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder).select(F.col("_metadata.file_name").alias("file"), F.unix_millis(F.col("_metadata.file_modification_time")).alias("mtime"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, schema = form.start(), to_arrow_schema(EVENT_SCHEMA)
        for batch in batches:
            rows = []
            for file, mtime, line in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ctx = Context(zone, zone.date_of(mtime or 0) if mtime else dt.date(1970, 1, 1), mtime or 0)
                e = start(line or "", ctx) or Event(line or "")
                rows.append({"ts": mtime if e.ts is None else e.ts, "level": e.level or "unknown", "source": source_of(file), "file": file, "file_idx": 0, "line_no": 0, "logger": e.logger, "thread": e.thread, "exception": e.exception, "fields": [{"name": k, "value": v} for k, v in e.fields], "message": e.message, "ts_inferred": e.ts is None})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return lines.mapInArrow(run, EVENT_SCHEMA)


def matching(events: DataFrame, query: ast.Query | str) -> DataFrame:
    return search(events, query)


def windowed_counts(events: DataFrame, query: ast.Query | str = "", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """``(window_start, level, count)`` of matching events, final once the watermark has passed."""
    timed = search(events, query, False).withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "level").agg(F.count("*").alias("count")).select(F.unix_millis("window.start").alias("window_start"), "level", "count")
