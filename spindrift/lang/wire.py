"""Queries as JSON-able trees, for interfaces that edit them elsewhere."""

from __future__ import annotations

from . import syntax as ast


def to_tree(query: ast.Query) -> dict:
    return {"selector": [{"name": m.name, "op": m.op, "value": m.value} for m in query.selector], "stages": [_stage_tree(s) for s in query.stages]}


def from_tree(tree: dict) -> ast.Query:
    selector = tuple(ast.Matcher(m["name"], m["op"], m["value"]) for m in tree.get("selector", ()))
    return ast.Query(selector, tuple(_stage(s) for s in tree.get("stages", ())))


def _stage_tree(stage: ast.Stage) -> dict:
    match stage:
        case ast.Line(op, values):
            return {"type": "line", "op": op, "values": list(values)}
        case ast.Regexp(pattern):
            return {"type": "regexp", "pattern": pattern}
        case ast.Filter(expression):
            return {"type": "filter", "expr": _expression_tree(expression)}
    return {"type": "json" if isinstance(stage, ast.Json) else "logfmt"}


def _stage(tree: dict) -> ast.Stage:
    match tree["type"]:
        case "line":
            return ast.Line(tree["op"], tuple(tree["values"]))
        case "regexp":
            return ast.Regexp(tree["pattern"])
        case "filter":
            return ast.Filter(_expression(tree["expr"]))
        case "json":
            return ast.Json()
        case "logfmt":
            return ast.Logfmt()
    raise ValueError(f"unknown stage {tree['type']}")


def _expression_tree(e: ast.Expression) -> dict:
    if isinstance(e, ast.Compare):
        return {"type": "cmp", "name": e.name, "op": e.op, "value": {"type": e.literal.kind, "value": e.literal.value}, "text": e.literal.text}
    return {"type": "and" if isinstance(e, ast.Both) else "or", "left": _expression_tree(e.left), "right": _expression_tree(e.right)}


def _expression(tree: dict) -> ast.Expression:
    if tree["type"] == "cmp":
        value = tree["value"]
        return ast.Compare(tree["name"], tree["op"], ast.Literal(value["type"], value["value"], tree.get("text", "")))
    made = ast.Both if tree["type"] == "and" else ast.Either
    return made(_expression(tree["left"]), _expression(tree["right"]))
