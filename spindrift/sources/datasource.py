"""Spark sources of log events.

``read_events`` reads files that every executor can open: a Python data source
with one partition a file (the largest first), each read as a stream and
handed on in Arrow batches, so a task holds one batch and one event at a time
and nothing is shuffled.  ``read_events_of_binary`` takes files through Spark's
own binary reader instead, for stores that only Spark can open.

A file that can't be read to its end keeps the events before the failure and
adds a row with ``error`` set.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.compiler import EVENT_SCHEMA
from .dates import Zone
from .events import Context, Event, Format, assemble, assemble_range
from .files import LogFile, decoded_lines, line_feeds, lines_before, lines_of, range_lines, splittable

RAW_SCHEMA = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in EVENT_SCHEMA.fields), T.StructField("error", T.StringType(), True)])
_SCHEMA = to_arrow_schema(RAW_SCHEMA)
BATCH = 4_096
BATCH_BYTES = 8 << 20


def context_of(file: LogFile, zone: Zone) -> Context:
    return Context(zone, zone.date_of(file.mtime_ms), file.mtime_ms)


def _valid(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def _column(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, type=kind)
    except UnicodeEncodeError:  # half of a surrogate pair
        return pa.array([None if v is None else _valid(v) for v in values], type=kind)


def fields_column(lists: list[list[tuple[str, str]]]) -> pa.Array:
    """Pairs as a column of lists of structs, without an object for each."""
    ends = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    flat = [pair for x in lists for pair in x]
    names, values = (_column([pair[k] for pair in flat], pa.string()) for k in (0, 1))
    kind = _SCHEMA.field("fields").type.value_type
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([names, values], fields=list(kind)), type=_SCHEMA.field("fields").type)


def _batch(events: list[Event], file: dict, file_idx: int, error: str | None = None) -> pa.RecordBatch:
    """A batch of rows; the last one reports an error if there is one."""
    gone = [None] * (error is not None)
    n = len(events) + len(gone)
    of = lambda name: [getattr(e, name) for e in events] + gone
    made = {
        "source": [file["source"]] * n,
        "file": [file["rel"]] * n,
        "file_idx": [file_idx] * n,
        "error": [None] * len(events) + [error] * len(gone),
        "fields": fields_column([e.fields for e in events] + [[]] * len(gone)),
    }
    columns = [made[f.name] if f.name in made else of(f.name) for f in _SCHEMA]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else _column(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def event_batches(lines: Iterable[str], file: dict, file_idx: int, form: Format, zone: Zone) -> Iterator[pa.RecordBatch]:
    return _batches(assemble(lines, form, context_of(LogFile(**file), zone)), file, file_idx)


def part_batches(file: dict, file_idx: int, form: Format, zone: Zone, part: dict) -> Iterator[pa.RecordBatch]:
    """Events that begin within the bytes ``[start, end)`` of a plain file."""
    ctx, start = context_of(LogFile(**file), zone), part["start"]
    lines = range_lines(file["path"], start, part["end"], part["feeds_before"])
    return _batches(assemble_range(lines, form, ctx, start > 0, last_timestamp(file["path"], start, form, ctx)), file, file_idx)


def last_timestamp(path: str, start: int, form: Format, ctx: Context, window: int = 1 << 16) -> int | None:
    """The last time that an event before a position has of its own, looked for backwards."""
    opens = form.start()
    while start:
        lines, whole = lines_before(path, start, window)
        for line in reversed(lines):
            event = opens(line, ctx)
            if event is not None and event.ts is not None:
                return event.ts
        if whole:
            return None
        window *= 4
    return None


def _batches(events: Iterable[Event], file: dict, file_idx: int) -> Iterator[pa.RecordBatch]:
    held, size, error = [], 0, None
    try:
        for event in events:
            held.append(event)
            size += len(event.message)
            if len(held) >= BATCH or size >= BATCH_BYTES:
                yield _batch(held, file, file_idx)
                held, size = [], 0
    except (OSError, EOFError, UnicodeError, ValueError) as e:
        error = f"{type(e).__name__}: {e}"
    if held or error is not None:
        yield _batch(held, file, file_idx, error)


class _FilePartition(InputPartition):
    def __init__(self, file: dict, file_idx: int, form: dict, part: dict | None = None):
        super().__init__(file_idx)
        self.file, self.file_idx, self.form, self.part = file, file_idx, form, part

    @property
    def size(self) -> int:
        return self.part["end"] - self.part["start"] if self.part else self.file["size"]


class LogEventSource(DataSource):
    """``format("log_events")`` with the option ``plan``: JSON of files, their formats and the zone."""

    @classmethod
    def name(cls) -> str:
        return "log_events"

    def schema(self) -> T.StructType:
        return RAW_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["plan"]))


class _Reader(DataSourceReader):
    def __init__(self, plan: dict):
        self.plan = plan

    def partitions(self) -> list[InputPartition]:
        made = [_FilePartition(f["file"], f["file_idx"], f["format"], part) for f in self.plan["files"] for part in f.get("parts") or [None]]
        return sorted(made, key=lambda p: -p.size) or [_FilePartition({}, -1, {})]

    def read(self, partition: _FilePartition) -> Iterator[pa.RecordBatch]:
        if partition.file_idx < 0:
            return
        file, form, zone = partition.file, Format(**partition.form), Zone.of(self.plan["zone"])
        if partition.part:
            yield from part_batches(file, partition.file_idx, form, zone, partition.part)
        else:
            yield from event_batches(lines_of(file["path"], file["gz"]), file, partition.file_idx, form, zone)


def parts_of(spark: SparkSession, files: list[LogFile], split_bytes: int) -> dict[str, list[dict]]:
    """Parts of the files that are larger than ``split_bytes`` and can be split, by path."""
    wanted = [(f.path, at, min(at + split_bytes, f.size)) for f in files if f.size > split_bytes and splittable(f) for at in range(0, f.size, split_bytes)]
    if not wanted:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            path, start, end = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(start), pa.array(end), pa.array([line_feeds(*r) for r in rows])], names=["path", "start", "end", "feeds"])

    ranges = spark.createDataFrame(wanted, "path string, start long, end long").repartition(min(len(wanted), 10_000))
    out: dict[str, list[dict]] = {}
    for r in sorted(ranges.mapInArrow(run, "path string, start long, end long, feeds long").collect()):
        parts = out.setdefault(r["path"], [])
        parts.append({"start": r["start"], "end": r["end"], "feeds": r["feeds"], "feeds_before": parts[-1]["feeds_before"] + parts[-1]["feeds"] if parts else 0})
    return out


def plan_of(files: list[LogFile], formats: list[Format], zone: Zone, parts: dict[str, list[dict]] | None = None) -> str:
    entries = [{"file": f.as_dict(), "file_idx": k, "format": form.as_dict(), "parts": (parts or {}).get(f.path)} for k, (f, form) in enumerate(zip(files, formats, strict=True))]
    return json.dumps({"zone": zone.as_dict(), "files": entries})


def read_events(spark: SparkSession, files: list[LogFile], formats: list[Format], zone: Zone, split_bytes: int = 256 << 20) -> DataFrame:
    """Events of the files, and error rows (``error`` set, the rest null)."""
    spark.dataSource.register(LogEventSource)
    plan = plan_of(files, formats, zone, parts_of(spark, files, split_bytes))
    return spark.read.format("log_events").option("plan", plan).load()


def read_events_of_binary(spark: SparkSession, files: list[LogFile], formats: list[Format], zone: Zone) -> DataFrame:
    """The same through ``binaryFile``; a file must fit in a row."""
    plan = {f.path.rstrip("/").removeprefix("file:"): (f.as_dict(), k, form.as_dict()) for k, (f, form) in enumerate(zip(files, formats, strict=True))}
    if not files:
        return spark.createDataFrame([], RAW_SCHEMA)
    contents = spark.read.format("binaryFile").load([f.path for f in files]).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        from urllib.parse import unquote

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = unquote(path).removeprefix("file:")
                file, file_idx, form = plan.get(path) or plan["/" + path.lstrip("/")]
                raw = io.BytesIO(content)
                yield from event_batches(decoded_lines(gzip.GzipFile(fileobj=raw) if file["gz"] else raw), file, file_idx, Format(**form), zone)

    return contents.mapInArrow(run, RAW_SCHEMA)


def events_only(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("error").isNull()).drop("error")
