"""Edits of a query's tree, for interfaces that filter by clicking."""

from __future__ import annotations

import re
from dataclasses import replace

from . import syntax as ast
from .parsing import parse


def edited(text: str, edit) -> str:
    """The text of a query after an edit of its tree."""
    return str(edit(parse(text)))


def with_label(query: ast.Query, name: str, value: str, negate: bool = False) -> ast.Query:
    """Adds a matcher; it takes the place of what it repeats or contradicts, and of an older ``=``."""
    op = "!=" if negate else "="

    def stays(m: ast.Matcher) -> bool:
        if m.name != name or m.op not in ("=", "!="):
            return True
        return m.value != value and (negate or m.op == "!=")

    return replace(query, selector=(*filter(stays, query.selector), ast.Matcher(name, op, value)))


def with_field_filter(query: ast.Query, name: str, value: str, negate: bool = False) -> ast.Query:
    test = ast.Compare(name, "!=" if negate else "==", ast.Literal("string", value))
    return replace(query, stages=(*query.stages, ast.Filter(test)))


def with_line_filter(query: ast.Query, value: str, negate: bool = False) -> ast.Query:
    return replace(query, stages=(*query.stages, ast.Line("!=" if negate else "|=", (value,))))


def with_selector(query: ast.Query, selector) -> ast.Query:
    return replace(query, selector=tuple(selector))


def highlight_pattern(query: ast.Query) -> re.Pattern | None:
    """What to mark in result rows: literals and regexes of positive line filters."""
    parts = []
    for stage in query.stages:
        if isinstance(stage, ast.Line) and stage.op == "|=":
            parts += [re.escape(v) for v in stage.values if v]
        elif isinstance(stage, ast.Line) and stage.op == "|~":
            for v in stage.values:
                try:
                    re.compile(v)
                    parts.append(v)
                except re.error:
                    continue
    try:
        return re.compile("|".join(f"(?:{p})" for p in parts)) if parts else None
    except re.error:
        return None
