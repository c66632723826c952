"""Log files: which there are, what they are called, and their lines."""

from __future__ import annotations

import codecs
import gzip
import io
import os
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

#: Globs used where none are given.
DEFAULT_INCLUDE = ("**/*.log", "**/*.log.*", "**/*.txt", "**/*.out", "**/*.json", "**/*.jsonl", "**/*.gz")
DEFAULT_EXCLUDE = ("**/.git/**", "**/node_modules/**", "**/*.tar.gz", "**/*.tgz", "**/*.zip")
#: What rolled files have in their names.
_DATE = re.compile(r"[-_.]?\d{4}-?\d{2}-?\d{2}(?:[-_.T]?\d{2}(?:-?\d{2}){0,2})?")
_INDEX_LAST = re.compile(r"(\.(?:log|txt|out))\.\d+\Z")
_INDEX_INSIDE = re.compile(r"[-_.]\d{1,5}(\.(?:log|txt|out|json))\Z")


@dataclass(frozen=True)
class LogFile:
    path: str
    rel: str
    size: int
    mtime_ms: int
    gz: bool
    source: str

    def as_dict(self) -> dict:
        return asdict(self)


def source_of(rel: str) -> str:
    """The name that a rolled file shares with its group."""
    folder, slash, name = rel.rpartition("/")
    name = name.removesuffix(".gz").removesuffix(".GZ")
    name = _INDEX_LAST.sub(r"\1", name)
    undated = _DATE.sub("", name, count=1)
    # only a dated name can have a counter; a name that is all date stays
    if undated != name and undated and not undated.startswith("."):
        name = _INDEX_INSIDE.sub(r"\1", undated)
    return folder + slash + name


def glob_regex(glob: str) -> str:
    """A glob whose ``*`` also crosses ``/``; a bare one matches at any depth."""
    glob = glob if "/" in glob else f"**/{glob}"
    out, at = [], 0
    while at < len(glob):
        if glob.startswith("**/", at) and (at == 0 or glob[at - 1] == "/"):
            out.append("(?:.*/)?")
            at += 3
        elif glob[at] == "*":
            end = at
            while end < len(glob) and glob[end] == "*":
                end += 1
            out.append(".*")
            at = end
        elif glob[at] == "?":
            out.append(".")
            at += 1
        elif glob[at] == "[" and (m := re.compile(r"\[([!^]?)(\]?[^\]]*)\]").match(glob, at)):
            out.append(f"[{'^' if m[1] else ''}{re.escape(m[2]).replace(re.escape('-'), '-')}]")
            at = m.end()
        elif glob[at] == "{" and (m := re.compile(r"\{([^{}]*)\}").match(glob, at)):
            out.append("(?:" + "|".join(glob_regex("/" + g)[1:].removesuffix(r"\Z") for g in m[1].split(",")) + ")")
            at = m.end()
        else:
            out.append(re.escape(glob[at]))
            at += 1
    return "".join(out) + r"\Z"


def matcher(globs: list[str] | tuple[str, ...]):
    made = [re.compile(glob_regex(g.strip()), re.S) for g in globs if g.strip()]
    return lambda rel: any(m.match(rel) for m in made)


def _walk(root: str) -> Iterator[str]:
    """Paths of the files below a folder; links are followed, but for those to a folder that they stand in."""
    waiting: list[tuple[str, frozenset[tuple[int, int]]]] = [(root, frozenset())]
    while waiting:
        folder, above = waiting.pop()
        try:
            info = os.stat(folder)
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        here = (info.st_dev, info.st_ino)
        if here in above:
            continue
        for entry in entries:
            if entry.is_dir():
                waiting.append((entry.path, above | {here}))
            else:
                yield entry.path


def discover(root: str, include: list[str] | tuple[str, ...] = (), exclude: list[str] | tuple[str, ...] = ()) -> list[LogFile]:
    """Log files below ``root`` by relative path; a folder that is reached in two ways is read under both names."""
    wanted, unwanted = matcher(include or DEFAULT_INCLUDE), matcher(exclude or DEFAULT_EXCLUDE)
    out = []
    for path in _walk(root):
        rel = os.path.relpath(path, root).replace(os.sep, "/")
        if not wanted(rel) or unwanted(rel) or not os.path.isfile(path):
            continue
        try:
            info = os.stat(path)
        except OSError:
            continue
        out.append(LogFile(path, rel, info.st_size, info.st_mtime_ns // 1_000_000, rel.lower().endswith(".gz"), source_of(rel)))
    return sorted(out, key=lambda f: f.rel)


def decoded_lines(stream: io.BufferedIOBase) -> Iterator[str]:
    """Lines of UTF-8 or, by its mark, UTF-16 text; ``\\n`` ends a line, one ``\\r`` before it goes."""
    buffered = io.BufferedReader(stream) if not isinstance(stream, io.BufferedReader) else stream
    head = buffered.peek(3)[:3]
    encoding = "utf-8-sig" if head.startswith(codecs.BOM_UTF8) else "utf-16" if head[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) else "utf-8"
    for line in io.TextIOWrapper(buffered, encoding, errors="replace", newline="\n"):
        yield line.removesuffix("\n").removesuffix("\r")


def lines_of(path: str, gz: bool = False) -> Iterator[str]:
    with open(path, "rb") as raw:
        yield from decoded_lines(gzip.GzipFile(fileobj=raw) if gz else raw)


# -- parts of large files ----------------------------------------------------------

BLOCK = 8 << 20


def splittable(file: LogFile) -> bool:
    """Plain files of UTF-8 text can be read in parts."""
    if file.gz:
        return False
    with open(file.path, "rb") as raw:
        return raw.read(2) not in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)


def line_feeds(path: str, start: int, end: int) -> int:
    """Line feeds among the bytes ``[start, end)``."""
    n = 0
    with open(path, "rb") as raw:
        raw.seek(start)
        while start < end and (block := raw.read(min(BLOCK, end - start))):
            n += block.count(b"\n")
            start += len(block)
    return n


def range_lines(path: str, start: int, end: int, feeds_before: int) -> Iterator[tuple[int, bool, str]]:
    """Lines that begin at or after ``start``, to the end of the file: number, whether it begins before ``end``, text."""
    with open(path, "rb") as raw:
        at, number = start, feeds_before + 1
        if start:
            raw.seek(start - 1)
            skipped = raw.readline()  # the rest of a line that began before, if only its line feed
            at += len(skipped) - 1
            number += len(skipped) > 1 and skipped.endswith(b"\n")
        for line in raw:
            text = line.removesuffix(b"\n").removesuffix(b"\r")
            if not at:
                text = text.removeprefix(codecs.BOM_UTF8)
            yield number, at < end, text.decode("utf-8", "replace")
            at += len(line)
            number += 1


def lines_before(path: str, start: int, window: int) -> tuple[list[str], bool]:
    """Whole lines among the ``window`` bytes before a position, and whether they reach the file's beginning."""
    begin = max(0, start - window)
    with open(path, "rb") as raw:
        raw.seek(begin)
        data = raw.read(start - begin)
    if begin:
        data = data.partition(b"\n")[2]
    # a line that goes on past the position belongs to the part before
    return [x.removesuffix(b"\r").decode("utf-8", "replace") for x in data.split(b"\n")], begin == 0
