"""Registered queries of the log engine over the test tables, with the same in DuckDB SQL.

The tables are not logs, so ``events`` is read as a log view (``log_view``);
``documents`` and ``conversations`` give lines for the assembler.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest_catalog
from .functions import fields as fx
from .functions import values as vx
from .operators import assembly, export, facets, histogram, pages
from .plans.compiler import search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the engine's columns."""
    e = _table(spark, sf_dir, "events")
    kind = F.col("event_type")
    level = F.when(kind == "error", "error").when(kind == "purchase", "warn").when(kind == "signup", "info").when(kind == "click", "debug").otherwise("trace")
    source = F.concat(F.lit("svc-"), (F.col("user_id") % 3).cast("string"), F.lit("/app.log"))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    message = F.concat(F.lit("user="), F.col("user_id"), F.lit(" took="), F.floor("value").cast("bigint").cast("string"), F.lit("ms size="), (F.col("event_id") % 2000).cast("string"), F.lit("KiB "), F.col("props"))
    return e.select(
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ts"),
        level.alias("level"),
        source.alias("source"),
        source.alias("file"),
        (F.col("user_id") % 3).cast("int").alias("file_idx"),
        F.col("event_id").alias("line_no"),
        F.concat(F.lit("com.acme."), kind).alias("logger"),
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("thread"),
        F.when(kind == "error", "java.io.IOException").otherwise("").alias("exception"),
        F.array(pair("userId", F.col("user_id").cast("string")), pair("requestId", F.concat(F.lit("req-"), (F.col("event_id") % 100).cast("string")))).alias("fields"),
        message.alias("message"),
        F.lit(False).alias("ts_inferred"),
    )


#: The same view in DuckDB; its ``ts // 1000`` floors as Spark does.
VIEW = """WITH log AS (SELECT epoch_us(ts) // 1000 AS ts,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'info' WHEN 'click' THEN 'debug' ELSE 'trace' END AS level,
  'svc-' || (user_id % 3)::VARCHAR || '/app.log' AS source, 'svc-' || (user_id % 3)::VARCHAR || '/app.log' AS file,
  (user_id % 3)::INTEGER AS file_idx, event_id AS line_no, 'com.acme.' || event_type AS logger, 't' || (user_id % 4)::VARCHAR AS thread,
  CASE WHEN event_type = 'error' THEN 'java.io.IOException' ELSE '' END AS exception,
  user_id::VARCHAR AS "userId", 'req-' || (event_id % 100)::VARCHAR AS "requestId",
  'user=' || user_id || ' took=' || floor(value)::BIGINT || 'ms size=' || (event_id % 2000) || 'KiB ' || props AS message,
  floor(value)::BIGINT AS took, event_id % 2000 AS kib, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
"""
SPAN = (1_704_585_600_000, 1_705_449_600_000)  # 7 to 16 January 2024

QUERIES: dict = dict(ingest_catalog.QUERIES)
ORACLE_SQL: dict[str, str] = dict(ingest_catalog.ORACLE_SQL)

_SHOWN = ["ts", "level", "file_idx", "line_no", "message"]
_SHOWN_SQL = "SELECT ts, level, file_idx, line_no, message FROM log WHERE "


def _filtering(name: str, query: str, where: str) -> None:
    """Registers a query whose result is the events that it keeps."""
    QUERIES[name] = lambda spark, sf_dir: search(log_view(spark, sf_dir), query, show_parsed=False).select(*_SHOWN)
    ORACLE_SQL[name] = VIEW + _SHOWN_SQL + where


_filtering("sel_level_eq", '{level="ERROR"}', "level = 'error'")
_filtering("sel_level_ne", '{level!="Error"}', "level <> 'error'")
_filtering("sel_level_re", '{level=~"WARN|err.*"}', "level IN ('warn', 'error')")
_filtering("sel_level_nre", '{level!~"warn|error"}', "level NOT IN ('warn', 'error')")
_filtering("sel_level_not_normalised", '{level="warning"}', "false")
_filtering("sel_source_re", '{source=~"svc-[01].*"}', "source LIKE 'svc-0%' OR source LIKE 'svc-1%'")
_filtering("sel_file_eq", '{file="svc-2/app.log"}', "file = 'svc-2/app.log'")
_filtering("sel_regex_anchored", '{logger=~"acme"}', "false")
_filtering("sel_core", r'{logger=~"com\.acme\.(click|view)", thread!="t1", exception=""}', "logger IN ('com.acme.click', 'com.acme.view') AND thread <> 't1' AND exception = ''")
_filtering("sel_field_eq", '{requestId="req-7"}', "\"requestId\" = 'req-7'")
_filtering("sel_missing_ne", '{nope!="x"}', "true")
_filtering("sel_missing_eq_empty", '{nope="", level="info"}', "level = 'info'")
_filtering("line_contains", '|= "took=1" or "took=2"', "contains(message, 'took=1') OR contains(message, 'took=2')")
_filtering("line_not_contains", '{} != "took=1" or "user=1"', "NOT (contains(message, 'took=1') OR contains(message, 'user=1'))")
_filtering("line_empty_literal", '|= ""', "true")
_filtering("line_re", r'|~ `took=\d{3}ms` or "user=7 "', "regexp_matches(message, 'took=[0-9]{3}ms') OR regexp_matches(message, 'user=7 ')")
_filtering("line_nre", r'{} !~ `took=\d{2,3}ms`', "NOT regexp_matches(message, 'took=[0-9]{2,3}ms')")
_filtering("line_re_ends", r'|~ `^user=1.*\}$`', "regexp_matches(message, '^user=1.*\\}$')")
_filtering("stage_json_num", "| json | k >= 50", "k >= 50")
_filtering("stage_json_num_ne", "| json | k != 50", "k <> 50")
_filtering("stage_json_str", '| json | k == "7"', "k = 7")
_filtering("stage_json_missing_num_ne", "| json | nope != 5", "false")
_filtering("stage_json_missing_str_ne", '| json | nope != "5"', "true")
_filtering("stage_logfmt_duration", "| logfmt | took > 100ms", "took > 100")
_filtering("stage_logfmt_duration_units", "| logfmt | took <= 0.25s and took > 200000us", "took <= 250 AND took > 200")
_filtering("stage_logfmt_str", '| logfmt | user =~ "1.*" and took != "5ms"', "starts_with(\"userId\", '1') AND took <> 5")
_filtering("stage_logfmt_num_unreadable", "| logfmt | took > 0", "false")
_filtering("stage_regexp_num", r"| regexp `took=(?P<ms>\d+)ms` | ms > 300", "took > 300")
_filtering("stage_regexp_optional", r"| regexp `took=(?P<ms>1\d*)?(?P<rest>\d*)ms` | ms == \"\" and rest >= 200".replace('\\"', '"'), "NOT starts_with(took::VARCHAR, '1') AND took >= 200")
_filtering("stage_bytes", "| logfmt | size >= 1MB", "kib * 1024 >= 1000000")
_filtering("stage_bytes_binary", "| logfmt | size < 512KiB or size == 1MiB", "kib < 512 OR kib = 1024")
_filtering("filter_and_or_paren", "| json | (k < 10 or k > 90) and k != 5", "(k < 10 OR k > 90) AND k <> 5")
_filtering("filter_comma", '| json | k < 50, level == "warn"', "k < 50 AND level = 'warn'")
_filtering("filter_level_pipeline", '| level =~ "WARN|error"', "level IN ('warn', 'error')")
_filtering("filter_level_extracted", r'| regexp `user=\d*(?P<level>[0-9]) ` | level == "unknown"', "true")
_filtering("filter_ingest_field", "| userId >= 100 and userId < 1e3", '"userId"::BIGINT >= 100 AND "userId"::BIGINT < 1000')
_filtering("filter_extracted_first", r'| regexp `took=(?P<userId>\d+)ms` | userId < 50', "took < 50")
_filtering("filter_source_unseen", '| source = ""', "true")
_filtering("pipeline_long", '{level=~"debug|trace", requestId!="req-3"} |= "user=" !~ "took=9" | logfmt | took < 400ms | json | k > 10 and k <= 80', "level IN ('debug', 'trace') AND \"requestId\" <> 'req-3' AND NOT contains(message, 'took=9') AND took < 400 AND k > 10 AND k <= 80")

QUERIES["time_range"] = lambda spark, d: search(log_view(spark, d), "", False, *SPAN).select(*_SHOWN)
ORACLE_SQL["time_range"] = f"{VIEW}{_SHOWN_SQL}ts >= {SPAN[0]} AND ts < {SPAN[1]}"


def _parsed(spark, d):
    out = search(log_view(spark, d), r"| logfmt | json | regexp `(?P<took>\d+)ms`")
    return out.select("line_no", F.array_join(F.transform("parsed", lambda p: F.concat(p["name"], F.lit("="), p["value"])), " ").alias("parsed"))


QUERIES["parsed_fields"] = _parsed
ORACLE_SQL["parsed_fields"] = VIEW + "SELECT line_no, 'user=' || \"userId\" || ' took=' || took || ' size=' || kib || 'KiB k=' || k AS parsed FROM log"

_PAGE = ["ts", "file_idx", "line_no", "level", "message"]


def _page(name: str, request: dict, where: str, order: str, limit: int) -> None:
    QUERIES[name] = lambda spark, d: pages.page_of(log_view(spark, d), '{level!="trace"}', **request).select(*_PAGE)
    ORACLE_SQL[name] = f"{VIEW}SELECT ts, file_idx, line_no, level, message FROM log WHERE level <> 'trace' AND {where} ORDER BY ts {order}, file_idx {order}, line_no {order} LIMIT {limit}"


_AFTER = pages.Key(SPAN[1], 1, 500)
_page("page_backward", {}, "true", "DESC", 500)
_page("page_forward", {"forward": True, "limit": 200}, "true", "ASC", 200)
_page("page_clamped", {"limit": 0}, "true", "DESC", 1)
_page("page_after", {"after": _AFTER}, f"(ts, file_idx, line_no) < ({_AFTER.ts}, {_AFTER.file_idx}, {_AFTER.line_no})", "DESC", 500)
_page("page_after_forward", {"after": _AFTER, "forward": True}, f"(ts, file_idx, line_no) > ({_AFTER.ts}, {_AFTER.file_idx}, {_AFTER.line_no})", "ASC", 500)

QUERIES["count_total"] = lambda spark, d: histogram.total(log_view(spark, d), '|= "took=1"')
ORACLE_SQL["count_total"] = VIEW + "SELECT count(*) AS total FROM log WHERE contains(message, 'took=1')"

_B = histogram.buckets_of(*SPAN)
_LEVEL_VALUES = ", ".join(f"({n}, '{x}')" for n, x in enumerate(vx.LEVELS))


def _grid_sql(first: str, step: str, n: str) -> str:
    """Dense counts for buckets whose bounds are given as SQL."""
    return f"""levels(ord, level) AS (VALUES {_LEVEL_VALUES}),
grid AS (SELECT unnest(range(0, ({n})::BIGINT)) AS bucket),
hit AS (SELECT ((ts - ts % ({step}) - ({first})) // ({step})) AS bucket, level, count(*) AS c FROM found GROUP BY ALL)
SELECT (bucket * ({step}) + ({first}))::BIGINT AS bucket_start, level, coalesce(c, 0)::BIGINT AS count
FROM grid CROSS JOIN levels LEFT JOIN hit USING (bucket, level)"""


_MINIMUM = '{level=~"warn|error"} |= "took=1"'
_FOUND = f"{VIEW}, found AS (SELECT * FROM log WHERE level IN ('warn', 'error') AND contains(message, 'took=1')"
QUERIES["histogram_range"] = lambda spark, d: histogram.histogram(log_view(spark, d), _MINIMUM, *SPAN)
ORACLE_SQL["histogram_range"] = f"{_FOUND} AND ts >= {SPAN[0]} AND ts < {SPAN[1]}), {_grid_sql(str(_B.start), str(_B.step), str(_B.count))}"
QUERIES["histogram_level"] = lambda spark, d: histogram.histogram(log_view(spark, d), _MINIMUM)
_STEP_LIST = "[" + ", ".join(map(str, histogram.STEPS)) + "]"
ORACLE_SQL["histogram_level"] = (
    f"{_FOUND}), b AS (SELECT min(ts) AS lo, max(ts) + 1 AS hi FROM log), "
    f"st AS (SELECT lo, hi, list_filter({_STEP_LIST}, lambda s: (hi - lo) // s <= 120)[1] AS step FROM b), "
    f"bb AS (SELECT step, lo - lo % step AS first, ceil((hi - (lo - lo % step)) / step)::BIGINT AS n FROM st), "
    + _grid_sql("(SELECT first FROM bb)", "(SELECT step FROM bb)", "(SELECT n FROM bb)")
)
QUERIES["histogram_stacked"] = lambda spark, d: histogram.stacked(histogram.histogram(log_view(spark, d), "", *SPAN))
ORACLE_SQL["histogram_stacked"] = (
    f"{VIEW}, found AS (SELECT * FROM log WHERE ts >= {SPAN[0]} AND ts < {SPAN[1]}), h AS (WITH {_grid_sql(str(_B.start), str(_B.step), str(_B.count))}), "
    f"lv(ord, level) AS (VALUES {_LEVEL_VALUES}), p AS (SELECT level FROM h GROUP BY level HAVING sum(count) > 0) "
    "SELECT bucket_start, level, sum(count) OVER (PARTITION BY bucket_start ORDER BY ord)::BIGINT AS cumulative FROM h JOIN lv USING (level) JOIN p USING (level)"
)

QUERIES["labels_streams"] = lambda spark, d: facets.stream_values(log_view(spark, d))
ORACLE_SQL["labels_streams"] = VIEW + "SELECT 'level' AS name, level AS value, count(*) AS count FROM log GROUP BY level UNION ALL SELECT 'source', source, count(*) FROM log GROUP BY source UNION ALL SELECT 'file', file, count(*) FROM log GROUP BY file"
QUERIES["labels_fields_top"] = lambda spark, d: facets.field_values(log_view(spark, d))
ORACLE_SQL["labels_fields_top"] = (
    VIEW + ", e AS (SELECT 'logger' AS name, logger AS value FROM log UNION ALL SELECT 'thread', thread FROM log UNION ALL SELECT 'exception', exception FROM log UNION ALL SELECT 'userId', \"userId\" FROM log UNION ALL SELECT 'requestId', \"requestId\" FROM log), "
    "c AS (SELECT name, value, count(*) AS count FROM e WHERE value <> '' GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY count DESC, value) AS rk, count(*) OVER (PARTITION BY name) AS n FROM c) "
    "SELECT name, value, count, n > 300 AS truncated FROM r WHERE rk <= 300"
)


def _label_rows(spark, d):
    view = log_view(spark, d)
    found = facets.labels(facets.stream_values(view), facets.field_values(view))
    return found.select("position", "name", "stream", F.size("values").cast("long").alias("n_values"), F.element_at("values", 1)["value"].alias("top"), "truncated")


QUERIES["labels_facets"] = _label_rows
ORACLE_SQL["labels_facets"] = (
    VIEW + ", e AS (SELECT 'level' AS name, level AS value FROM log UNION ALL SELECT 'source', source FROM log UNION ALL SELECT 'file', file FROM log UNION ALL SELECT 'logger', logger FROM log UNION ALL SELECT 'thread', thread FROM log UNION ALL SELECT 'exception', exception FROM log UNION ALL SELECT 'userId', \"userId\" FROM log UNION ALL SELECT 'requestId', \"requestId\" FROM log), "
    "c AS (SELECT name, value, count(*) AS count FROM e WHERE value <> '' GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY count DESC, value) AS rk, count(*) OVER (PARTITION BY name) AS n FROM c), "
    "k AS (SELECT name, name IN ('level', 'source', 'file') AS stream, least(max(n), 300)::BIGINT AS n_values, max(value) FILTER (rk = 1) AS top, max(n) > 300 AS truncated, sum(count) FILTER (rk <= 300) AS s FROM r GROUP BY name) "
    "SELECT row_number() OVER (ORDER BY CASE name WHEN 'level' THEN 1 WHEN 'source' THEN 2 WHEN 'file' THEN 3 WHEN 'logger' THEN 4 WHEN 'exception' THEN 5 WHEN 'thread' THEN 6 ELSE 99 END, s DESC, name)::INTEGER AS position, name, stream, n_values, top, truncated FROM k"
)

_ISO = "strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
QUERIES["export_csv_lines"] = lambda spark, d: export.lines(log_view(spark, d), '{level="error"} | logfmt', "csv").select("line_no", "export")
ORACLE_SQL["export_csv_lines"] = (
    VIEW + f"SELECT line_no, {_ISO} || ',error,' || logger || ',' || thread || ',' || exception || ',' || file || ',' || line_no || ',userId=' || \"userId\" || ' requestId=' || \"requestId\" || ' user=' || \"userId\" || ' took=' || took || 'ms size=' || kib || 'KiB,\"' || replace(message, '\"', '\"\"') || '\"' AS export FROM log WHERE level = 'error'"
)
QUERIES["export_json_lines"] = lambda spark, d: export.lines(log_view(spark, d), '{level=~"error|warn"}', "json").select("line_no", "export")
ORACLE_SQL["export_json_lines"] = (
    VIEW + f"""SELECT line_no, '{{' || CASE WHEN exception <> '' THEN '"exception":"' || exception || '",' ELSE '' END || '"file":"' || file || '","level":"' || level || '","line":' || line_no || ',"logger":"' || logger || '","message":"' || replace(message, '"', '\\"') || '","requestId":"' || "requestId" || '","thread":"' || thread || '","time":"' || {_ISO} || '","userId":"' || "userId" || '"}}' AS export FROM log WHERE level IN ('error', 'warn')"""
)


def document_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` as events, so with very long messages."""
    d = _table(spark, sf_dir, "documents")
    none = F.lit("")
    return d.select(
        F.col("doc_id").alias("ts"), F.lit("info").alias("level"), F.coalesce("source", none).alias("source"), F.coalesce("source", none).alias("file"), F.lit(0).alias("file_idx"), F.col("doc_id").alias("line_no"),
        none.alias("logger"), none.alias("thread"), none.alias("exception"), F.array().cast("array<struct<name:string,value:string>>").alias("fields"), F.coalesce("text", none).alias("message"), F.lit(False).alias("ts_inferred"),
    )


# Patterns that backtracking can't be trusted with: repeated groups, and several repetitions in a row.
_NESTED = r"(?:[a-z]+[ ,]+)+zu (?:[a-z]+ ){2,}[a-z]+\."
QUERIES["line_re_nested"] = lambda spark, d: search(document_view(spark, d), f"|~ `{_NESTED}`", False).select("line_no")
ORACLE_SQL["line_re_nested"] = f"SELECT doc_id AS line_no FROM documents WHERE regexp_matches(text, '{_NESTED}')"
_OPEN = r"e.*f.*g.*h.*q"
QUERIES["line_nre_open"] = lambda spark, d: search(document_view(spark, d), f"!~ `{_OPEN}`", False).select("line_no")
ORACLE_SQL["line_nre_open"] = f"SELECT doc_id AS line_no FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '{_OPEN}')"
_LONG = r"(?P<run>(?:[a-z]+ )+)(?P<last>[a-z]+)\.(?P<next> [A-Z])?"
QUERIES["stage_regexp_long"] = lambda spark, d: search(document_view(spark, d), f"| regexp `{_LONG}` | run != \"\"").select("line_no", *(fx.lookup(F.col("parsed"), n).alias(n) for n in ("run", "last", "next")))
ORACLE_SQL["stage_regexp_long"] = f"""SELECT doc_id AS line_no, regexp_extract(text, '{_LONG}', 1) AS run, regexp_extract(text, '{_LONG}', 2) AS last, nullif(regexp_extract(text, '{_LONG}', 3), '') AS next
FROM documents WHERE regexp_matches(text, '{_LONG}')"""


# -- lines of documents and conversations ------------------------------------------


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n"))).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), F.col("col").alias("text"))


def _assembled(spark, d, block_lines=50_000):
    """Lines that begin with A to M open an event; every third of them has a time of its own."""
    lines = document_lines(spark, d)
    opens = F.substring("text", 1, 1).rlike("^[A-M]")
    own = F.when(F.length("text") % 3 == 0, F.length("text").cast("long") * 1000)
    return assembly.assemble(lines, opens, own, F.lit(-1).cast("long"), "doc_id", block_lines=block_lines)


_LINES_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
s AS (SELECT *, regexp_matches(text, '^[A-M]') AS opens, CASE WHEN regexp_matches(text, '^[A-M]') AND length(text) % 3 = 0 THEN length(text) * 1000 END AS own FROM l),
g AS (SELECT *, sum(opens::INT) OVER w AS ev, last_value(own IGNORE NULLS) OVER w AS carried FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
e AS (SELECT doc_id AS file, min(line_no)::BIGINT AS line_no, coalesce(arg_min(carried, line_no), -1)::BIGINT AS ts, max(own) IS NULL AS ts_inferred, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY line_no) AS message FROM g GROUP BY doc_id, ev)
"""
QUERIES["assemble_multiline"] = lambda spark, d: _assembled(spark, d).select("file", "line_no", "n_lines", "message")
ORACLE_SQL["assemble_multiline"] = _LINES_SQL + "SELECT file, line_no, n_lines, message FROM e"
QUERIES["ts_inherit"] = lambda spark, d: _assembled(spark, d, block_lines=4).select("file", "line_no", "ts", "ts_inferred")
# an opening line without a time inherits; arg_min skips nulls, so the first line's own state is looked up
ORACLE_SQL["ts_inherit"] = _LINES_SQL + "SELECT file, e.line_no, coalesce(g.carried, -1)::BIGINT AS ts, g.own IS NULL AS ts_inferred FROM e JOIN g ON g.doc_id = e.file AND g.line_no = e.line_no"


def _conversation_events(spark, d):
    """Turns as lines: a user's turn opens an event, the answers continue it, some as traces."""
    c = _table(spark, d, "conversations")
    text = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("Caused by: com.acme."), F.initcap("role"), F.lit("Error: "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    lines = c.select("conv_id", F.col("turn").alias("line_no"), text.alias("text"), "role")
    out = assembly.assemble(lines, F.col("role") == "user", F.lit(None).cast("long"), F.col("conv_id"), "conv_id", block_lines=2)
    return out.select("file", "line_no", "ts", "exception", "n_lines")


QUERIES["exception_first"] = _conversation_events
ORACLE_SQL["exception_first"] = """WITH l AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 1 THEN 'com.acme.' || upper(role[1]) || lower(role[2:]) || 'Error' END AS exc, role = 'user' AS opens FROM conversations),
g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS ev FROM l)
SELECT conv_id AS file, min(turn)::BIGINT AS line_no, conv_id::BIGINT AS ts, coalesce(arg_min(exc, turn) FILTER (NOT opens AND exc IS NOT NULL), '') AS exception, count(*) AS n_lines FROM g GROUP BY conv_id, ev"""


# -- small functions -------------------------------------------------------------------

_WORDS = ["TRACE", "trc", "Finest", "VERBOSE", "dbg", "CONFIG", "info", "INFORMATION", "Notice", "WARNING", " warn ", "ERR", "severe", "critical", "PANIC", "emerg", "nonsense", ""]


def _levels(spark, d):
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("event_id") % len(_WORDS)).cast("int") + 1)
    words = _table(spark, d, "events").select("event_id", word.alias("word"))
    return words.select("event_id", vx.level_of(F.col("word")).alias("level")).withColumn("ordinal", vx.level_ordinal(F.col("level")))


_LEVEL_CASE = " ".join(f"WHEN upper(trim(word)) IN ({', '.join(repr(w) for w in words)}) THEN '{level}'" for level, words in vx.LEVEL_WORDS.items())
QUERIES["level_normalise"] = _levels
ORACLE_SQL["level_normalise"] = (
    f"WITH w AS (SELECT event_id, [{', '.join(repr(w) for w in _WORDS)}][event_id % {len(_WORDS)} + 1] AS word FROM events), l AS (SELECT event_id, CASE WHEN length(trim(word)) > 9 THEN 'unknown' {_LEVEL_CASE} ELSE 'unknown' END AS level FROM w) "
    f"SELECT event_id, level, (list_position([{', '.join(repr(x) for x in vx.LEVELS)}], level) - 1)::INTEGER AS ordinal FROM l"
)


def _typed(spark, d):
    """Numbers, durations and sizes read from text made of an order's columns."""
    o = _table(spark, d, "orders").select("o_orderkey", "o_custkey")
    n = (F.col("o_orderkey") % 1000).cast("string")
    shape = F.col("o_custkey") % 6
    text = F.when(shape == 0, n).when(shape == 1, F.concat(n, F.lit("ms"))).when(shape == 2, F.concat(n, F.lit("m30s"))).when(shape == 3, F.concat(n, F.lit("KB"))).when(shape == 4, F.concat(n, F.lit("d"))).otherwise(F.concat(F.lit("x"), n))
    t = o.withColumn("t", text)
    return t.select("o_orderkey", vx.number_of(F.col("t")).alias("number"), vx.duration_of(F.col("t")).alias("duration"), vx.bytes_of(F.col("t")).alias("bytes"))


QUERIES["typed_values"] = _typed
ORACLE_SQL["typed_values"] = """WITH t AS (SELECT o_orderkey, (o_orderkey % 1000)::DOUBLE AS n, o_custkey % 6 AS s FROM orders)
SELECT o_orderkey, CASE s WHEN 0 THEN n END AS number,
  CASE s WHEN 0 THEN n * 1000 WHEN 1 THEN n WHEN 2 THEN n * 60000 + 30000 WHEN 4 THEN n * 86400000 END AS duration,
  CASE s WHEN 0 THEN n WHEN 3 THEN n * 1000 END AS bytes FROM t"""


def _severity(spark, d):
    """Syslog priorities to levels, in built-in expressions over lines made of orders."""
    line = F.concat(F.lit("<"), (F.col("o_orderkey") % 192).cast("string"), F.lit(">1 2026-10-09T08:13:00Z host app - - - "), F.col("o_orderstatus"))
    code = F.regexp_extract(line, r"^<(\d{1,3})>", 1).cast("int") % 8
    from .sources.events import SEVERITIES

    return _table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, SEVERITIES)), code + 1).alias("level"))


QUERIES["syslog_severity"] = _severity
ORACLE_SQL["syslog_severity"] = "SELECT o_orderkey, ['fatal', 'fatal', 'fatal', 'error', 'warn', 'info', 'info', 'debug'][(o_orderkey % 192) % 8 + 1] AS level FROM orders"
