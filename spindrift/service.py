"""The commands of an interface, taking and giving JSON-able values.

One service holds one open folder.  A new search ends the running one; asking
for the next page doesn't.  ``call`` turns failures into ``{kind, message,
start, end}``.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession

from .lang import QueryError, parse, wire
from .operators import pages
from .plans.compiler import search as search_events
from .sources.workspace import FolderSettings, Progress, Workspace, preview, saved_settings

RECENT = 10
PREVIEW_EVENTS = 12


class CommandError(RuntimeError):
    pass


def scan_statistics(df: DataFrame) -> dict[str, int]:
    """Rows and files that the scans of an executed DataFrame read."""
    out = {"eventsScanned": 0, "filesScanned": 0}
    plans = [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            plan = plan.executedPlan()
        leaves = plan.collectLeaves()
        for k in range(leaves.size()):
            leaf = leaves.apply(k)
            if leaf.nodeName().endswith("QueryStage"):
                plans.append(leaf.plan())  # what ran before a shuffle
                continue
            for name, key in (("numOutputRows", "eventsScanned"), ("numFiles", "filesScanned")):
                if leaf.metrics().contains(name):
                    out[key] += leaf.metrics().apply(name).value()
    return out


def _key(after: dict | None) -> pages.Key | None:
    return pages.Key(after["ts"], after["fileIdx"], after["lineNo"]) if after else None


def _key_tree(key: pages.Key) -> dict:
    return {"ts": key.ts, "fileIdx": key.file_idx, "lineNo": key.line_no}


def row_tree(r: Row) -> dict:
    pairs = lambda c: [[p["name"], p["value"]] for p in r[c]]
    key = _key_tree(pages.Key(*(r[k] for k in pages.KEY)))
    return {"key": key, "ts": r["ts"], "tsInferred": r["ts_inferred"], "level": r["level"], "source": r["source"], "file": r["file"], "lineNo": r["line_no"], "logger": r["logger"], "thread": r["thread"], "exception": r["exception"], "fields": pairs("fields"), "parsed": pairs("parsed"), "message": r["message"]}


class Service:
    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark, self.data_dir = spark, data_dir
        self.workspace: Workspace | None = None
        self.progress = Progress()
        self._running: dict[str, str] = {}
        self._lock = threading.Lock()

    def call(self, command: str, **arguments):
        """Runs a command by name; failures come back as ``{"error": {...}}``."""
        try:
            return getattr(self, command)(**arguments)
        except QueryError as e:
            return {"error": e.as_dict()}
        except Exception as e:
            return {"error": {"kind": "error", "message": str(e) or type(e).__name__, "start": None, "end": None}}

    # -- folders -----------------------------------------------------------------

    def _root(self, path: str) -> str:
        if not os.path.isdir(path):
            raise CommandError(f"{path} is not a folder")
        return os.path.realpath(path)

    def folder_settings(self, path: str) -> dict:
        return saved_settings(self.data_dir, self._root(path)).as_dict()

    def preview_folder(self, path: str, settings: dict | None = None) -> dict:
        return preview(self._root(path), FolderSettings.of(settings or {}), PREVIEW_EVENTS)

    def open_folder(self, path: str, settings: dict | None = None, force: bool = False) -> dict:
        root = self._root(path)
        self.progress = Progress()
        self.workspace = Workspace.open(self.spark, root, self.data_dir, FolderSettings.of(settings) if settings is not None else None, force, self.progress)
        self._remember(root)
        return self.workspace_info()

    def cancel_indexing(self) -> None:
        self.progress.cancel()

    def indexing_progress(self) -> dict:
        p = self.progress
        p.poll()
        return {"phase": p.phase, "filesTotal": p.files_total, "filesDone": p.files_done, "bytesTotal": p.bytes_total, "bytesDone": p.bytes_done, "tasksTotal": p.tasks_total, "tasksDone": p.tasks_done}

    def workspace_info(self) -> dict | None:
        if self.workspace is None:
            return None
        meta = self.workspace.meta
        return {"root": meta["root"], "files": meta["files"], "settings": meta["settings"], **meta["stats"], "indexedAtMs": meta["indexedAtMs"], "indexMillis": meta["indexMillis"]}

    def _recent_path(self) -> str:
        return os.path.join(self.data_dir, "recent.json")

    def _read_recent(self) -> list[str]:
        try:
            with open(self._recent_path()) as source:
                return list(json.load(source)["folders"])
        except (OSError, ValueError, KeyError):
            return []

    def _remember(self, root: str) -> None:
        folders = [root, *(f for f in self._read_recent() if f != root)][:RECENT]
        os.makedirs(self.data_dir, exist_ok=True)
        with open(self._recent_path(), "w") as out:
            json.dump({"folders": folders}, out)

    def recent_folders(self) -> list[str]:
        return [f for f in self._read_recent() if os.path.isdir(f)]

    def initial_folder(self, argv: list[str] | None = None) -> str | None:
        return next((a for a in (sys.argv[1:] if argv is None else argv) if not a.startswith("-") and os.path.isdir(a)), None)

    # -- queries -----------------------------------------------------------------

    def parse_query(self, text: str) -> dict:
        try:
            return {"query": wire.to_tree(parse(text)), "error": None}
        except QueryError as e:
            return {"query": None, "error": {"message": e.message, "start": e.start, "end": e.end}}

    def format_query(self, query: dict) -> str:
        return str(wire.from_tree(query))

    def _open(self) -> Workspace:
        if self.workspace is None:
            raise CommandError("no folder is open")
        return self.workspace

    def _superseding(self, kind: str | None, job: Callable):
        """Runs a job that ends the one of its kind before it; None: it ends none."""
        tag = f"spindrift-{kind}-{uuid.uuid4().hex}"
        if kind:
            with self._lock:
                before, self._running[kind] = self._running.get(kind), tag
            if before:
                self.spark.interruptTag(before)
        self.spark.addTag(tag)
        try:
            return job()
        finally:
            self.spark.removeTag(tag)
            with self._lock:
                if kind and self._running.get(kind) == tag:
                    del self._running[kind]

    def search(self, request: dict) -> dict:
        """A page of rows; with ``rowsOnly`` false also the total and the histogram."""
        ws, began = self._open(), time.time()
        limit, after = pages.clamped(request.get("limit")), _key(request.get("after"))
        df = pages.page_of(ws.events, request.get("query", ""), start=request.get("from"), end=request.get("to"), limit=limit, forward=request.get("direction") == "forward", after=after, extra=1)
        found = self._superseding(None if after else "search", df.collect)
        more, found = len(found) > limit, found[:limit]
        out = {"rows": [row_tree(r) for r in found], "total": None, "histogram": None, "next": _key_tree(pages.Key(*(found[-1][k] for k in pages.KEY))) if more else None, "cancelled": False, **scan_statistics(df)}
        if not request.get("rowsOnly", False):
            out |= {k: v for k, v in self.aggregate(request).items() if k in ("total", "histogram")}
        return out | {"tookMs": int((time.time() - began) * 1000)}

    def aggregate(self, request: dict) -> dict:
        ws, began = self._open(), time.time()
        found = self._superseding("aggregate", lambda: ws.aggregate(request.get("query", ""), request.get("from"), request.get("to")))
        b = found.buckets
        return {"total": found.total, "histogram": {"start": b.start, "step": b.step, "buckets": found.table}, "tookMs": int((time.time() - began) * 1000), "cancelled": False}

    def count_statistics(self, request: dict) -> dict[str, int]:
        """What a count of the query reads."""
        df = search_events(self._open().events, request.get("query", ""), False, request.get("from"), request.get("to")).groupBy().count()
        df.collect()
        return scan_statistics(df)

    def labels(self) -> list[dict]:
        rows = self._open().labels().collect()
        return [{"name": r["name"], "stream": r["stream"], "values": [[v["value"], v["count"]] for v in r["values"]], "truncated": r["truncated"]} for r in rows]

    def export(self, request: dict, path: str, format: str) -> int:
        if format not in ("csv", "json"):
            raise CommandError(f"unknown format {format}")
        return self._open().export(request.get("query", ""), path, format, forward=request.get("direction") == "forward", start=request.get("from"), end=request.get("to"))
