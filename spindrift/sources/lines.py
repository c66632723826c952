"""Events of lines that are rows already, from tables or queues: formats read in Arrow batches, assembly by windows."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import assembly
from . import dates
from .datasource import _column, fields_column
from .dates import UTC, Zone
from .events import _WRAPPERS, Context, Event, Format, xml_finished, xml_start

_FIELDS = "array<struct<name:string,value:string>>"
_OPENED = f"start boolean, own_ts long, level string, logger string, thread string, thrown string, fields {_FIELDS}"
_FINISHED = f"whole string, thrown string, fields {_FIELDS}"


def _with(df: DataFrame, schema: str, make) -> DataFrame:
    """``df`` with columns that a function of the text column (the last one) makes of each batch."""
    added = T._parse_datatype_string(schema)
    struct = T.StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *function(batch.columns[-1].to_pylist())], names=struct.names)

    return df.mapInArrow(run, struct)


def _texts(found: list[Event | None], name: str) -> pa.Array:
    return _column([None if e is None else getattr(e, name) for e in found], pa.string())


def opened(lines: DataFrame, form: Format, zone: Zone = UTC, date: dt.date = dt.date(1970, 1, 1), text: str = "text") -> DataFrame:
    """``lines`` with what each says if it opens an event: ``start own_ts level logger thread thrown fields``."""

    def make():
        start, ctx = form.start(), Context(zone, date, 0)

        def run(texts):
            found = [None if t is None else start(t, ctx) for t in texts]
            return [
                pa.array([e is not None for e in found]),
                pa.array([e and e.ts for e in found], type=pa.int64()),
                *(_texts(found, name) for name in ("level", "logger", "thread", "exception")),
                fields_column([e.fields if e else [] for e in found]),
            ]

        return run

    columns = [c for c in lines.columns if c != text]
    return _with(lines.select(*columns, F.col(text)), _OPENED, make)


def events_of_lines(lines: DataFrame, form: Format, zone: Zone = UTC, date: dt.date = dt.date(1970, 1, 1), fallback: int = 0, file: str = "file", line_no: str = "line_no", text: str = "text", block_lines: int = 50_000) -> DataFrame:
    """``(file, line_no, ts, ts_inferred, level, logger, thread, exception, fields, message, n_lines)``, one row for each event.

    date completes times without one, fallback is the time before any timestamp.
    """
    rows = lines.select(F.col(file).alias("file"), F.col(line_no).cast("long").alias("line_no"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if form.kind == "xml":
        bare = F.trim("text")
        wrapper = bare == ""
        for head in _WRAPPERS:
            wrapper = wrapper | bare.startswith(head)
        rows = rows.where(~wrapper)
    read = opened(rows, form, zone, date)
    kept = {n: F.col(n) for n in ("level", "logger", "thread", "thrown", "fields")}
    found = assembly.assemble(read, F.col("start"), F.col("own_ts"), F.lit(fallback).cast("long"), block_lines=block_lines, kept=kept)
    if form.kind == "xml":
        found = _finished(found)
    none = F.lit("")
    return found.select(
        "file", "line_no", "ts", "ts_inferred",
        F.coalesce("level", F.lit("unknown")).alias("level"), F.coalesce("logger", none).alias("logger"), F.coalesce("thread", none).alias("thread"),
        F.coalesce(F.nullif("thrown", none), "exception", none).alias("exception"), F.coalesce("fields", F.array().cast(_FIELDS)).alias("fields"), "message", "n_lines",
    )


def _finished(found: DataFrame) -> DataFrame:
    """XML events with readable messages."""

    def make():
        def run(texts):
            done = []
            for t in texts:
                e = Event(t)
                done.append(xml_finished(e) if xml_start(t.partition("\n")[0]) is not None else e)
            return [_texts(done, "message"), _texts(done, "exception"), fields_column([e.fields for e in done])]

        return run

    columns = [c for c in found.columns if c not in ("message", "thrown", "fields")]
    return _with(found.select(*columns, "message"), _FINISHED, make).withColumn("message", F.col("whole")).drop("whole")


def timestamps(text: Column, form: str, zone: Zone = UTC, date: dt.date = dt.date(1970, 1, 1)) -> Column:
    """Epoch milliseconds of whole texts in a Java date format; null where there is no such time."""
    made = dates.date_format(form)

    @F.arrow_udf("long")
    def read(texts: pa.Array) -> pa.Array:
        whole = re.compile(made.regex)
        found = (whole.fullmatch(t) if t is not None else None for t in texts.to_pylist())
        return pa.array([m and dates.assembled(dict(zip(made.parts, m.groups(), strict=True)), zone, date) for m in found], type=pa.int64())

    return read(text)
