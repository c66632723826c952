"""Syntax tree of queries; ``str(query)`` is its canonical text."""

from __future__ import annotations

from dataclasses import dataclass, field

REGEX_OPS = frozenset({"=~", "!~", "|~"})
_ESCAPED = str.maketrans({'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t"})


def quoted(text: str) -> str:
    return f'"{text.translate(_ESCAPED)}"'


def quoted_for(op: str, text: str, line_filter: bool = False) -> str:
    """Regexes with backslashes go between backticks, so that nothing is escaped twice."""
    regex = op in ("|~", "!~") if line_filter else op in ("=~", "!~")
    return f"`{text}`" if regex and "\\" in text and "`" not in text else quoted(text)


def plain_number(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e16 else repr(value)


@dataclass(frozen=True)
class Matcher:
    """``name op value`` between the braces; op is one of ``= != =~ !~``."""

    name: str
    op: str
    value: str

    def __str__(self) -> str:
        return f"{self.name}{self.op}{quoted_for(self.op, self.value)}"


@dataclass(frozen=True)
class Literal:
    """kind: string, number, duration (milliseconds) or bytes; text as it was written, empty for strings."""

    kind: str
    value: str | float
    text: str = ""


@dataclass(frozen=True)
class Compare:
    """``name op literal``; op is one of ``== != > >= < <= =~ !~``."""

    name: str
    op: str
    literal: Literal

    def __str__(self) -> str:
        lit = self.literal
        if lit.kind == "string":
            shown = quoted_for(self.op, lit.value)
        else:
            shown = lit.text or plain_number(lit.value) + {"number": "", "duration": "ms", "bytes": "B"}[lit.kind]
        return f"{self.name} {self.op} {shown}"


@dataclass(frozen=True)
class Both:
    left: Expression
    right: Expression

    def __str__(self) -> str:
        # a right-hand `and` keeps its place in the tree
        right = f"({self.right})" if isinstance(self.right, Both) else str(self.right)
        return f"{self.left} and {right}"


@dataclass(frozen=True)
class Either:
    left: Expression
    right: Expression

    def bare(self) -> str:
        return f"{self.left} or {self.right}"

    def __str__(self) -> str:
        return f"({self.bare()})"


Expression = Compare | Both | Either


@dataclass(frozen=True)
class Line:
    """A line filter; op is one of ``|= != |~ !~``, any of the values counts."""

    op: str
    values: tuple[str, ...]

    def __str__(self) -> str:
        return f"{self.op} {' or '.join(quoted_for(self.op, v, line_filter=True) for v in self.values)}"


@dataclass(frozen=True)
class Json:
    def __str__(self) -> str:
        return "| json"


@dataclass(frozen=True)
class Logfmt:
    def __str__(self) -> str:
        return "| logfmt"


@dataclass(frozen=True)
class Regexp:
    pattern: str

    def __str__(self) -> str:
        return f"| regexp {quoted_for('=~', self.pattern)}"


@dataclass(frozen=True)
class Filter:
    expression: Expression

    def __str__(self) -> str:
        top = self.expression
        return f"| {top.bare() if isinstance(top, Either) else top}"


Stage = Line | Json | Logfmt | Regexp | Filter


@dataclass(frozen=True)
class Query:
    selector: tuple[Matcher, ...] = ()
    stages: tuple[Stage, ...] = field(default=())

    def __str__(self) -> str:
        return " ".join(["{" + ", ".join(map(str, self.selector)) + "}", *map(str, self.stages)])
