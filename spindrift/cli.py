"""``python -m spindrift.cli <folder> [query]``: opens a folder of logs and runs a query."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time

from .lang import QueryError
from .sources.layout import LayoutError
from .sources.workspace import FolderSettings, Workspace, preview


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spindrift", description="Explore a folder of logs.")
    p.add_argument("folder")
    p.add_argument("query", nargs="?", default="")
    p.add_argument("--from", dest="start", type=int, help="first millisecond")
    p.add_argument("--to", dest="end", type=int, help="millisecond after the last")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--pattern", action="append", default=[], help="a pattern layout; may be repeated")
    p.add_argument("--data", default=os.path.join(tempfile.gettempdir(), "spindrift-data"), help="where workspaces are kept")
    p.add_argument("--force", action="store_true", help="index again")
    p.add_argument("--preview", action="store_true")
    p.add_argument("--labels", action="store_true")
    p.add_argument("--forward", action="store_true", help="oldest first")
    return p


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    out = out or sys.stdout
    a = arguments().parse_args(argv)
    say = lambda *x: print(*x, file=out)
    note = lambda *x: print(*x, file=sys.stderr)
    settings = FolderSettings(patterns=a.pattern) if a.pattern else None
    try:
        if a.preview:
            say(json.dumps(preview(a.folder, settings, 5), indent=2, ensure_ascii=False))
            return 0
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        began = time.time()
        ws = Workspace.open(spark, a.folder, a.data, settings, a.force)
        size = sum(f["size"] for f in ws.files)
        note(f"workspace: {len(ws.files)} files, {size / 1e6:.1f} MB, {ws.meta['stats']['events']} events, opened in {time.time() - began:.2f}s (last index took {ws.meta['indexMillis'] / 1000:.2f}s)")
        for f in ws.files:
            if f["error"]:
                note(f"  error in {f['rel']}: {f['error']}")
        if a.labels:
            for r in ws.labels().collect():
                values = ", ".join(f"{v['value']}({v['count']})" for v in r["values"][:8])
                say(f"{r['name']}{' [stream]' if r['stream'] else ''}: {values}")
            return 0
        began = time.time()
        page = ws.rows(a.query, start=a.start, end=a.end, limit=a.limit, forward=a.forward)
        for r in page.rows:
            first, *rest = r["message"].split("\n")
            say(f"{r['level']:>5} {first}" + (f"  (+{len(rest)} lines)" if rest else ""))
        note(f"first page: {len(page.rows)} rows, {(time.time() - began) * 1000:.0f} ms")
        began = time.time()
        found = ws.aggregate(a.query, a.start, a.end)
        note(f"count: {found.total} matches, {(time.time() - began) * 1000:.0f} ms")
    except (QueryError, LayoutError) as e:
        note(json.dumps(e.as_dict() if isinstance(e, QueryError) else {"kind": "error", "message": str(e)}))
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
