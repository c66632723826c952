import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.lang import QueryError, edits, parse, ranges
from spindrift.lang import syntax as ast
from spindrift.lang.dialect import RegexError, translate
from spindrift.lang.units import byte_size, duration_ms, number


def test_full_query():
    q = parse('{source="app.log", level=~"error|warn", file!~".*debug.*"} |= "timeout" or "refused" !~ "healthcheck" | json | status >= 500 and duration > 2s')
    assert len(q.selector) == 3 and len(q.stages) == 4
    assert q.stages[0] == ast.Line("|=", ("timeout", "refused"))
    assert q.stages[3].expression.right.literal.value == 2000.0
    assert parse(str(q)) == q


def test_short_queries():
    assert parse("") == parse("{}") == parse(" # only a comment") == ast.Query()
    assert len(parse('|= "x"').stages) == 1
    assert parse('{a="b",}').selector == (ast.Matcher("a", "=", "b"),)


@pytest.mark.parametrize(
    "text,message,start,end",
    [
        ('{level="error" |= "x"', "expected `,` or `}`", 15, 17),
        ('{level=~"("}', "invalid regex", 8, 11),
        ('{level="x"} | line_format "{{.a}}"', "not supported", 14, 25),
        ('{level="x"} |= "unterminated', "unterminated", 15, 28),
        ('{é="x"}', "unexpected character `é`", 1, 3),
        ("| a =~ 5", "regex comparisons need a quoted string", 7, 8),
        ('| a > "x"', "ordering comparisons need a number", 6, 9),
        ("| a == 5x", "is not a number, duration or byte size", 7, 9),
        ("| regexp `abc`", "at least one named group", 9, 14),
        ("{level=", "expected a quoted label value, found end of query", 7, 7),
        ("| (a == 1", "expected `)`", 9, 9),
        ("json", "expected `|=`", 0, 4),
    ],
)
def test_errors(text, message, start, end):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert message in e.value.message and (e.value.start, e.value.end) == (start, end)


def test_strings():
    assert parse(r'|= "a\"b\\c\n\d"').stages[0].values == ('a"b\\c\n\\d',)
    assert parse(r"|~ `\d{3}ms`").stages[0].values == (r"\d{3}ms",)
    assert str(parse(r'{logger=~"com\.acme.*"} |~ "\d+"')) == r"{logger=~`com\.acme.*`} |~ `\d+`"


def test_units():
    assert duration_ms("1h30m") == 5_400_000 and duration_ms("150ms") == 150 and duration_ms("1.5µs") == 0.0015
    assert duration_ms("-2s") == -2000 and duration_ms("1h-3m") is None and duration_ms("5") is None and duration_ms("") is None
    assert byte_size("10MB") == 1e7 and byte_size("1KiB") == 1024 and byte_size("5k") == 5120 and byte_size("5") is None
    assert number("1e3") == 1000 and number("5d") is None and number("0x1p3") is None and number(".5") == 0.5
    kinds = [parse(f"| a > {x}").stages[0].expression.literal.kind for x in ("5", "5m", "5M", "1d", "2GB", "-1.5")]
    assert kinds == ["number", "duration", "bytes", "duration", "bytes", "number"]


names = st.from_regex(r"[a-z_@][a-z0-9_.]{0,5}", fullmatch=True).filter(lambda n: n not in ("or", "and", "json", "logfmt", "regexp", "pattern", "unpack", "drop", "keep", "line_format", "label_format", "decolorize"))
texts = st.text(alphabet='ab \\"`\n\té|', max_size=6)
literals = st.one_of(texts.map(lambda t: ast.Literal("string", t)), st.sampled_from(["5", "1.5", "2s", "1h30m", "10MB"]).map(lambda t: parse(f"| a == {t}").stages[0].expression.literal))
compares = st.builds(ast.Compare, names, st.sampled_from(["==", "!="]), literals)
expressions = st.recursive(compares, lambda e: st.one_of(st.builds(ast.Both, e, e), st.builds(ast.Either, e, e)), max_leaves=5)
stages = st.one_of(st.just(ast.Json()), st.just(ast.Logfmt()), st.builds(ast.Line, st.sampled_from(["|=", "!="]), st.lists(texts, min_size=1, max_size=3).map(tuple)), st.builds(ast.Filter, expressions))
queries = st.builds(ast.Query, st.lists(st.builds(ast.Matcher, names, st.sampled_from(["=", "!="]), texts), max_size=3).map(tuple), st.lists(stages, max_size=4).map(tuple))


@settings(max_examples=300, deadline=None)
@given(queries)
def test_text_of_a_tree_reads_back(q):
    assert parse(str(q)) == q


REGEXES = {
    r"^a$": r"\Aa\z",
    r"(?m)^a$": r"(?m)^a$",
    r"(?P<a_b>x)(?<c>y)(z)": "(x)(y)(z)",
    r"[[:alpha:]_]+": "[[A-Za-z]_]+",
    r"\x41\u{1F600}\v": r"\x{41}\x{1F600}\x{B}",
    r"a{2,}?b{3}": "a{2,}?b{3}",
    r"(?i:a)(?-i)b": "(?i:a)(?-i)b",
    r"\p{Greek}\pL\P{^Lu}": r"\p{IsGreek}\p{L}\p{Lu}",
    r"[^]a]": r"[^\]a]",
    r"x\/y\-": r"x\/y\-",
}


@pytest.mark.parametrize("source", REGEXES)
def test_translation(source):
    assert translate(source).java == "(?dU)" + REGEXES[source]


def test_group_numbers():
    assert translate(r"(a)(?P<ms>\d+)(?:b)(?P<u>c)").groups == {"ms": 2, "u": 3}


@pytest.mark.parametrize("source", ["(", ")", "a**", "*a", "[a", "(?=a)", "(?!a)", "(?<=a)", "(?<!a)", r"\1", "a++", "(?>a)", r"\Z", r"\Qx\E", "a{2,1}", "(?P<a>x)(?P<a>y)", "(?z)a", "\\", "[a--b]", "(?U)a+"])
def test_refused(source):
    with pytest.raises(RegexError):
        translate(source)


CASES = [("^a$", "a\n", False), ("a.b", "a\rb", True), ("a.b", "a\nb", False), (r"^\w+$", "é", True), ("(?i)É", "é", True), (r"\d", "٣", True), ("[[:alpha:]]", "é", False), (r"(?m)^b$", "a\nb", True), ("(?s)a.b", "a\nb", True), (r"[\]&]", "&", True)]


def test_java_reads_them_so(spark):
    for source, text, want in CASES:
        got = spark.createDataFrame([(text,)], "t string").where(f"t rlike '{translate(source).java.replace(chr(92), chr(92) * 2)}'").count()
        assert got == want, source


def test_edits():
    q = parse('{level="a", x!="v", x="w"} |= "t"')
    assert str(edits.with_label(q, "level", "b")) == '{x!="v", x="w", level="b"} |= "t"'
    assert str(edits.with_label(q, "x", "w", True)) == '{level="a", x!="v", x!="w"} |= "t"'
    assert str(edits.with_label(q, "x", "v")) == '{level="a", x="v"} |= "t"'
    assert edits.edited("", lambda q: edits.with_line_filter(edits.with_field_filter(q, "k", "v"), "z", True)) == '{} | k == "v" != "z"'
    assert edits.highlight_pattern(parse('|= "a.b" or "" |~ "c+" != "d"')).pattern == r"(?:a\.b)|(?:c+)"
    assert edits.highlight_pattern(parse("")) is None


def test_ranges():
    import datetime as dt

    assert ranges.relative(1000, 5000) == (4001, 5001)
    assert ranges.absolute("2026-10-08 18:30:45.123", dt.timezone.utc) == 1_791_484_245_123
    assert ranges.absolute("2026-10-08", dt.timezone.utc) == 1_791_417_600_000 and ranges.absolute("2026-13-08") is None and ranges.absolute("x") is None
    assert ranges.zoomed_out(100, 200) == (50, 250) and ranges.selected(1.5, 2.2) == (1, 3) and ranges.selected(2, 2) is None
