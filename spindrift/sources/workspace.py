"""A folder of logs as a workspace of Parquet tables that can be reopened.

``log_events`` is partitioned by level and sorted by time within its files, so
label filters prune partitions and time ranges prune row groups; hot columns
get Parquet Bloom filters.  ``field_values`` and ``streams`` answer facets
without a scan.  ``meta.json`` holds the settings, the files and the totals; a
workspace is reused while they are unchanged.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang import syntax as ast
from ..operators import export as ex
from ..operators import facets, histogram, pages
from ..plans.compiler import EVENT_SCHEMA, search
from .datasource import RAW_SCHEMA, context_of, read_events
from .dates import Zone
from .events import Detection, Event, Format, assemble, detect
from .files import LogFile, discover, lines_of
from .layout import compile_layout

VERSION = 1
SAMPLE = 200
ERRORS = "-"  # the level under which rows about unreadable files are stored
#: Stored columns that get a Bloom filter, for exact matchers.
BLOOM = ("logger", "thread", "exception", "source", "file")


@dataclass
class FolderSettings:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    zone: Zone = Zone()

    def as_dict(self) -> dict:
        return {"include": self.include, "exclude": self.exclude, "patterns": self.patterns, "timeZone": self.zone.as_dict()}

    @staticmethod
    def of(data: dict) -> FolderSettings:
        return FolderSettings(list(data.get("include", [])), list(data.get("exclude", [])), list(data.get("patterns", [])), Zone.of(data.get("timeZone")))


def head(file: LogFile) -> list[str]:
    out = []
    for line in lines_of(file.path, file.gz):
        out.append(line)
        if len(out) == SAMPLE:
            break
    return out


def detected(file: LogFile, settings: FolderSettings) -> tuple[Detection, list[str]]:
    sample = head(file)
    return detect(sample, settings.patterns, context_of(file, settings.zone)), sample


def detected_formats(spark: SparkSession, files: list[LogFile], settings: FolderSettings) -> tuple[list[Format], dict[str, str]]:
    """The format of each file, found where the tasks run, and what went wrong by relative path."""
    if not files:
        return [], {}
    asked = settings.as_dict()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = FolderSettings.of(asked)
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                try:
                    found.append((json.dumps(detected(LogFile(**json.loads(text)), given)[0].format.as_dict()), None))
                except (OSError, EOFError, ValueError) as e:
                    found.append((json.dumps(Format("plain", timestamped=False).as_dict()), f"{type(e).__name__}: {e}"))
            form, error = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(form, type=pa.string()), pa.array(error, type=pa.string())], names=["k", "format", "error"])

    rows = spark.createDataFrame([(k, json.dumps(f.as_dict())) for k, f in enumerate(files)], "k long, file string")
    found = rows.repartition(min(len(files), 1000)).mapInArrow(run, "k long, format string, error string").collect()
    formats = [Format(**json.loads(r["format"])) for r in sorted(found, key=lambda r: r["k"])]
    return formats, {files[r["k"]].rel: r["error"] for r in found if r["error"]}


def workspace_folder(data_dir: str, root: str) -> str:
    return os.path.join(data_dir, "workspaces", hashlib.sha256(root.encode()).hexdigest()[:20])


@dataclass
class Progress:
    """Counters that another thread may poll while a folder is opened, and a way to end that.

    The last two count what the running phase has to do and has done: files
    while formats are detected, then parts of files.
    """

    phase: str = "idle"
    files_total: int = 0
    files_done: int = 0
    bytes_total: int = 0
    bytes_done: int = 0
    cancelled: bool = False
    tasks_total: int = 0
    tasks_done: int = 0
    group: str = field(default_factory=lambda: f"opening-{uuid.uuid4().hex}")
    context: object = None

    def cancel(self) -> None:
        self.cancelled = True
        if self.context is not None:
            self.context.cancelJobGroup(self.group)

    def poll(self) -> None:
        """Brings the counts of the running jobs up to date."""
        if self.context is None or self.phase not in ("detecting", "indexing"):
            return
        tracker = self.context.statusTracker()
        total = done = 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info and info.status == "RUNNING" else ():
                if found := tracker.getStageInfo(stage):
                    total, done = total + found.numTasks, done + found.numCompletedTasks
        if total:
            self.tasks_total, self.tasks_done = total, done
            self.files_done, self.bytes_done = self.files_total * done // total, self.bytes_total * done // total


class Cancelled(RuntimeError):
    pass


class Workspace:
    def __init__(self, spark: SparkSession, folder: str, meta: dict):
        self.spark, self.folder, self.meta = spark, folder, meta
        self._tag = f"workspace-{uuid.uuid4().hex}"

    # -- opening ---------------------------------------------------------------

    @staticmethod
    def open(spark: SparkSession, root: str, data_dir: str, settings: FolderSettings | None = None, force: bool = False, progress: Progress | None = None) -> Workspace:
        """The workspace of ``root``, built anew where files or settings have changed."""
        progress = progress or Progress()
        root = os.path.realpath(root)
        folder = workspace_folder(data_dir, root)
        saved = _saved(folder)
        if settings is None:
            settings = FolderSettings.of(saved["settings"]) if saved else FolderSettings()
        for p in settings.patterns:
            compile_layout(p)
        files = discover(root, settings.include, settings.exclude)
        if saved and not force and _fresh(saved, files, settings):
            return Workspace(spark, folder, saved)
        return Workspace._build(spark, root, folder, settings, files, progress)

    @staticmethod
    def _build(spark: SparkSession, root: str, folder: str, settings: FolderSettings, files: list[LogFile], progress: Progress) -> Workspace:
        began = time.time()
        generation = uuid.uuid4().hex
        into = os.path.join(folder, generation)
        progress.phase, progress.files_total, progress.bytes_total = "detecting", len(files), sum(f.size for f in files)
        progress.context = spark.sparkContext
        try:
            return Workspace._indexed(spark, root, folder, generation, into, settings, files, progress, began)
        except Exception as e:
            shutil.rmtree(into, ignore_errors=True)
            progress.phase = "cancelled" if progress.cancelled else "failed"
            if progress.cancelled:
                raise Cancelled from e
            raise
        finally:
            progress.context = None

    @staticmethod
    def _indexed(spark: SparkSession, root: str, folder: str, generation: str, into: str, settings: FolderSettings, files: list[LogFile], progress: Progress, began: float) -> Workspace:
        def grouped(job: Callable):
            if progress.cancelled:
                raise Cancelled
            spark.sparkContext.setJobGroup(progress.group, f"opening {root}", interruptOnCancel=True)
            try:
                return job()
            finally:
                spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

        formats, errors = grouped(lambda: detected_formats(spark, files, settings))
        progress.phase, progress.files_done = "indexing", 0

        def store() -> None:
            read = read_events(spark, files, formats, settings.zone).withColumn("level", F.coalesce("level", F.lit(ERRORS)))
            writer = read.sortWithinPartitions("level", "ts").write.partitionBy("level")
            for c in BLOOM:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
            writer.parquet(os.path.join(into, "log_events"))  # each file is read once

        grouped(store)
        stored = spark.read.schema(RAW_SCHEMA).parquet(os.path.join(into, "log_events"))
        events = stored.where(F.col("level") != ERRORS)
        jobs = (
            lambda: facets.field_values(events).coalesce(1).write.parquet(os.path.join(into, "field_values")),
            lambda: facets.stream_values(events).coalesce(1).write.parquet(os.path.join(into, "streams")),
            lambda: stored.groupBy("file").agg(F.count("ts").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"), F.max("error").alias("error")).collect(),
        )
        with ThreadPoolExecutor(len(jobs)) as pool:  # independent jobs over one table
            *_, by_file = [f.result() for f in [pool.submit(grouped, j) for j in jobs]]
        errors |= {r["file"]: r["error"] for r in by_file if r["error"]}
        counted = {r["file"]: r["n"] for r in by_file}
        n = sum(counted.values())
        low, high = (min(r["low"] for r in by_file if r["n"]), max(r["high"] for r in by_file if r["n"])) if n else (None, None)
        meta = {
            "version": VERSION,
            "root": root,
            "generation": generation,
            "settings": settings.as_dict(),
            "files": [f.as_dict() | {"format": form.as_dict(), "events": counted.get(f.rel, 0), "error": errors.get(f.rel)} for f, form in zip(files, formats, strict=True)],
            "stats": {"events": n, "minTs": low, "maxTs": high},
            "indexedAtMs": int(time.time() * 1000),
            "indexMillis": int((time.time() - began) * 1000),
        }
        partial = os.path.join(folder, f"meta-{generation}")
        with open(partial, "w") as out:
            json.dump(meta, out)
        os.replace(partial, os.path.join(folder, "meta.json"))
        for name in os.listdir(folder):  # older generations
            if name not in (generation, "meta.json"):
                shutil.rmtree(os.path.join(folder, name), ignore_errors=True)
        progress.phase, progress.files_done, progress.bytes_done = "ready", len(files), progress.bytes_total
        return Workspace(spark, folder, meta)

    # -- tables ----------------------------------------------------------------

    def _table(self, name: str) -> str:
        return os.path.join(self.folder, self.meta["generation"], name)

    @property
    def events(self) -> DataFrame:
        if not self.meta["stats"]["events"]:
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        stored = self.spark.read.schema(EVENT_SCHEMA).parquet(self._table("log_events"))
        return stored.where(F.col("level") != ERRORS).select(*EVENT_SCHEMA.names)

    @property
    def field_values(self) -> DataFrame:
        return self.spark.read.parquet(self._table("field_values"))

    @property
    def streams(self) -> DataFrame:
        return self.spark.read.parquet(self._table("streams"))

    @property
    def files(self) -> list[dict]:
        return self.meta["files"]

    @property
    def bounds(self) -> tuple[int, int]:
        s = self.meta["stats"]
        return (s["minTs"], s["maxTs"] + 1) if s["events"] else (0, 1)

    # -- queries ---------------------------------------------------------------

    def search(self, query: ast.Query | str = "", start: int | None = None, end: int | None = None) -> DataFrame:
        return search(self.events, query, True, start, end)

    def _run(self, job: Callable):
        self.spark.addTag(self._tag)
        try:
            return job()
        finally:
            self.spark.removeTag(self._tag)

    def cancel(self) -> None:
        """Ends the running queries of this workspace."""
        self.spark.interruptTag(self._tag)

    def rows(self, query: ast.Query | str = "", **request) -> pages.Page:
        return self._run(lambda: pages.rows(self.events, query, **request))

    def newest(self, query: ast.Query | str = "", limit: int | None = None, slices: int = 8) -> pages.Page:
        """The newest page, read from the end of the time range backwards.

        Each slice is a range scan that Parquet statistics prune; a slice holds as
        much time as all before it, and the scan stops when the page is full.
        """
        low, high = self.bounds
        want, end, width, found = pages.clamped(limit) + 1, high, max(1, (high - low) >> slices), []
        while end > low and len(found) < want:
            start = max(low, end - width)
            found += self._run(lambda s=start, e=end: pages.page_of(self.events, query, start=s, end=e, limit=want).collect())
            end, width = start, width * 2
        more = len(found) >= want
        found = found[: want - 1]
        return pages.Page(found, pages.Key(*(found[-1][k] for k in pages.KEY)) if more else None)

    def aggregate(self, query: ast.Query | str = "", start: int | None = None, end: int | None = None) -> histogram.Aggregate:
        return self._run(lambda: histogram.aggregate(self.events, query, start, end, self.bounds))

    def labels(self) -> DataFrame:
        return facets.labels(self.streams, self.field_values).orderBy("position")

    def export(self, query: ast.Query | str, folder: str, kind: str = "csv", **request) -> int:
        return self._run(lambda: ex.write(self.events, query, folder, kind, **request))


def _saved(folder: str) -> dict | None:
    try:
        with open(os.path.join(folder, "meta.json")) as source:
            meta = json.load(source)
    except (OSError, ValueError):
        return None
    return meta if meta.get("version") == VERSION else None


def saved_settings(data_dir: str, root: str) -> FolderSettings:
    """What a folder was last opened with."""
    saved = _saved(workspace_folder(data_dir, os.path.realpath(root)))
    return FolderSettings.of(saved["settings"]) if saved else FolderSettings()


def _fresh(meta: dict, files: list[LogFile], settings: FolderSettings) -> bool:
    known = [(f["rel"], f["size"], f["mtime_ms"]) for f in meta["files"]]
    return meta["settings"] == settings.as_dict() and known == [(f.rel, f.size, f.mtime_ms) for f in files]


def preview(root: str, settings: FolderSettings | None = None, max_events: int = 12) -> dict:
    """What a folder holds: for each source its files, the format of the newest and its first events."""
    settings = settings or FolderSettings()
    root = os.path.realpath(root)
    files = discover(root, settings.include, settings.exclude)
    groups: dict[str, list[LogFile]] = {}
    for f in files:
        groups.setdefault(f.source, []).append(f)

    def one(source: str, group: list[LogFile]) -> dict:
        newest = max(group, key=lambda f: f.mtime_ms)
        try:
            found, sample = detected(newest, settings)
        except (OSError, EOFError):
            found, sample = Detection(Format("plain", timestamped=False), 0.0), []
        events = list(assemble(sample, found.format, context_of(newest, settings.zone)))[:max_events]
        return {"source": source, "files": len(group), "bytes": sum(f.size for f in group), "sampleFile": newest.rel, "format": found.format.as_dict(), "score": found.score, "events": [_shown(e) for e in events]}

    return {"root": root, "files": len(files), "bytes": sum(f.size for f in files), "sources": [one(s, g) for s, g in groups.items()]}


def _shown(e: Event) -> dict:
    return {"ts": e.ts, "tsInferred": e.ts_inferred, "level": e.level, "logger": e.logger, "thread": e.thread, "exception": e.exception, "fields": e.fields, "message": e.message}
