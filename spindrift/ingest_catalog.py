"""Registered ingest queries: log lines made of the rows of ``orders``, read by each format, with the same in DuckDB SQL.

The SQL makes the same lines and takes them apart by its own regexes.
"""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import lines as ln
from .sources.events import SEVERITIES, Format
from .sources.files import source_of

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_SHOWN = ["file", "line_no", "ts", "ts_inferred", "level", "logger", "thread", "exception", "fields", "message", "n_lines"]
#: Levels by order status and key, as written.
_LEVELS = ("INFO", "WARN", "ERROR", "DEBUG")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the parts that lines are made of; times of day come from the key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    zero = F.lit(0)
    when = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, (k % 86400 + (k % 1000) / 1000).cast("decimal(18,6)"))
    return o.select(
        k.alias("k"),
        F.concat(F.lit("shop-"), (F.col("o_custkey") % 5).cast("string"), F.lit(".log")).alias("file"),
        when.alias("w"),
        F.element_at(F.array(*map(F.lit, _LEVELS)), (k % 4).cast("int") + 1).alias("level"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_custkey") % 7).cast("string").alias("worker"),
        (k % 192).alias("pri"),
    )


_BASE = f"""WITH o AS (SELECT o_orderkey AS k, 'shop-' || (o_custkey % 5) || '.log' AS file, o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400) + to_milliseconds(o_orderkey % 1000) AS w,
  {list(_LEVELS)}[o_orderkey % 4 + 1] AS level, o_orderstatus AS status, (o_custkey % 7)::VARCHAR AS worker, o_orderkey % 192 AS pri FROM orders),
"""


def _time(form: str) -> Column:
    return F.date_format("w", form)


def _said(template: str) -> Column:
    """A line of a template with ``{column}`` places."""
    parts = [p for chunk in template.split("{{") for p in chunk.split("}}")]
    return F.concat(*[(F.col(p).cast("string") if n % 2 else F.lit(p)) for n, p in enumerate(parts) if p])


def _said_sql(template: str) -> str:
    parts = [p for chunk in template.split("{{") for p in chunk.split("}}")]
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    return "(" + " || ".join(f"{p}::VARCHAR" if n % 2 else quoted(p) for n, p in enumerate(parts) if p) + ")"


def _register(name: str, form: Format, times: dict[str, tuple[str, str]], first: str, rest: list[str], every: int, taken: str, date: dt.date = dt.date(1996, 1, 1), fallback: int = 0, message: str = "") -> None:
    """A query over one opening line for each order, and ``rest`` behind that of every ``every``-th.

    times: columns with the time as text, by (Java format, DuckDB format).  taken:
    SQL of the columns ``ts level logger thread exception fields`` over the opening line ``text``.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = _orders(spark, sf_dir).withColumns({n: _time(java) for n, (java, _) in times.items()})
        more = F.when(F.col("k") % every == 0, F.array(*map(_said, rest))) if rest else F.lit(None).cast("array<string>")
        texts = F.concat(F.array(_said(first)), F.coalesce(more, F.array().cast("array<string>")))
        rows = o.select("file", "k", F.posexplode(texts).alias("j", "text")).select("file", (F.col("k") * 8 + F.col("j")).alias("line_no"), "text")
        found = ln.events_of_lines(rows, form, date=date, fallback=fallback, block_lines=1000)
        fields = F.array_join(F.transform("fields", lambda p: F.concat(p["name"], F.lit("="), p["value"])), ";")
        return found.withColumn("fields", fields).select(*_SHOWN)

    stamps = "".join(f", strftime(w, '{duck}') AS {n}" for n, (_, duck) in times.items())
    lists = f"[{_said_sql(first)}]" + (f" || CASE WHEN k % {every} = 0 THEN [{', '.join(map(_said_sql, rest))}] ELSE [] END" if rest else "")
    whole = message or "string_agg(text, chr(10) ORDER BY j)"
    QUERIES[name] = query
    ORACLE_SQL[name] = f"""{_BASE}t AS (SELECT *{stamps} FROM o),
texts AS (SELECT k, file, {lists} AS x FROM t),
l AS (SELECT k, file, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS j FROM texts),
e AS (SELECT k, {whole} AS message, count(*) AS n_lines, coalesce(max(regexp_extract(text, '^Caused by: ([a-z.]+[A-Z][A-Za-z]*Exception)', 1)), '') AS cause FROM l GROUP BY k),
s AS (SELECT k, file, k * 8 AS line_no, {taken} FROM l WHERE j = 0)
SELECT file, line_no, ts, false AS ts_inferred, level, logger, thread, CASE WHEN exception <> '' THEN exception ELSE cause END AS exception, fields, message, n_lines FROM s JOIN e USING (k)"""


_ISO = ("yyyy-MM-dd'T'HH:mm:ss.SSS", "%Y-%m-%dT%H:%M:%S.%g")
_SPACED = ("yyyy-MM-dd HH:mm:ss.SSS", "%Y-%m-%d %H:%M:%S.%g")
_TRACE = ["Caused by: com.shop.StockException: order {{k}}", "\tat com.shop.Main.run(Main.java:10)"]


def _ms(text: str, form: str) -> str:
    return f"epoch_ms(strptime({text}, '{form}'))"


def _part(regex: str, n: int = 1) -> str:
    return f"regexp_extract(text, '{regex}', {n})"


_HEAD = r"^([-0-9]+ [0-9:.]+) \[([^\]]+)\] ([A-Z]+) +([A-Za-z.]+) - "
_register(
    "ingest_pattern", Format("log4j", "%d{yyyy-MM-dd HH:mm:ss.SSS} [%t] %-5level %logger{36} - %msg%n"), {"t": _SPACED},
    "{{t}} [w-{{worker}}] {{level}} com.shop.{{status}} - order {{k}} done", _TRACE, 4,
    f"{_ms(_part(_HEAD), _SPACED[1])} AS ts, lower({_part(_HEAD, 3)}) AS level, {_part(_HEAD, 4)} AS logger, {_part(_HEAD, 2)} AS thread, '' AS exception, '' AS fields",
)
_MDC = r"^([0-9]+ [A-Za-z]+ [0-9]+ [0-9:,]+) ([A-Z]+) \[([^\]]*)\] ([A-Z]):([0-9]+) - "
_register(
    "layout_capture", Format("log4j", "%d{dd MMM yyyy HH:mm:ss,SSS} %p [%X{req}] %c{1}:%L - %m%n"), {"t": ("dd MMM yyyy HH:mm:ss,SSS", "%d %b %Y %H:%M:%S,%g")},
    "{{t}} {{level}} [r-{{k}}] {{status}}:{{worker}} - shipped", [], 1,
    f"{_ms('replace(' + _part(_MDC) + ', chr(44), chr(46))', '%d %b %Y %H:%M:%S.%g')} AS ts, lower({_part(_MDC, 2)}) AS level, {_part(_MDC, 4)} AS logger, '' AS thread, '' AS exception, 'req=' || {_part(_MDC, 3)} || ';line=' || {_part(_MDC, 5)} AS fields",
)
_register(
    "ingest_json", Format("jsonLines"), {"t": _ISO},
    '{"@timestamp":"{{t}}Z","level":"{{level}}","logger":"com.shop.{{status}}","thread":"w-{{worker}}","order":{"key":{{k}},"tag":"a \\"b\\" {{worker}}"},"ok":true,"list":[1,{{worker}}],"message":"done"}', _TRACE, 5,
    f"""{_ms("text ->> '$.\"@timestamp\"'", _ISO[1] + "Z")} AS ts, lower(text ->> '$.level') AS level, text ->> '$.logger' AS logger, text ->> '$.thread' AS thread, '' AS exception,
  'list=' || (text ->> '$.list') || ';ok=' || (text ->> '$.ok') || ';order.key=' || (text ->> '$.order.key') || ';order.tag=' || (text ->> '$.order.tag') AS fields""",
)
_LOGFMT = lambda key: _part(rf' {key}=([^ ]+)')
_register(
    "ingest_logfmt", Format("logfmt"), {"t": _ISO},
    'ts={{t}}Z level={{level}} component=shop.{{status}} goroutine=w-{{worker}} order={{k}} note="two \\"quoted\\" words" msg=done err="com.shop.StockException: none"', [], 1,
    f"""{_ms(_part('^ts=([^ ]+)Z'), _ISO[1])} AS ts, lower({_LOGFMT('level')}) AS level, {_LOGFMT('component')} AS logger, {_LOGFMT('goroutine')} AS thread, regexp_extract(text, 'err="([A-Za-z.]+):', 1) AS exception,
  'order=' || {_LOGFMT('order')} || ';note=' || replace(regexp_extract(text, 'note="(two .* words)"', 1), chr(92), '') || ';err=' || regexp_extract(text, 'err="([^"]+)"', 1) AS fields""",
)
_RFC = r"^<([0-9]+)>1 ([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) \[[^ ]+ key=\"([0-9]+)\"\] "
_SEVERITY = f"{list(SEVERITIES)}[({{}})::INTEGER % 8 + 1]"
_register(
    "ingest_syslog", Format("syslog"), {"t": _ISO},
    '<{{pri}}>1 {{t}}Z host{{worker}} shop {{worker}} ID{{status}} [o@1 key="{{k}}"] order done', _TRACE, 3,
    f"""{_ms(_part(_RFC, 2), _ISO[1] + "Z")} AS ts, {_SEVERITY.format(_part(_RFC))} AS level, {_part(_RFC, 4)} AS logger, '' AS thread, '' AS exception,
  'host=' || {_part(_RFC, 3)} || ';app=' || {_part(_RFC, 4)} || ';pid=' || {_part(_RFC, 5)} || ';msgid=' || {_part(_RFC, 6)} || ';key=' || {_part(_RFC, 7)} AS fields""",
)
_BSD = r"^([A-Z][a-z]+ [0-9]+ [0-9:]+) ([^ ]+) ([a-z]+)\[([0-9]+)\]: ([A-Z]+)"
_register(
    "ingest_syslog_bsd", Format("syslog"), {"t": ("MMM dd HH:mm:ss", "%b %d %H:%M:%S")},
    "{{t}} host{{worker}} cron[{{k}}]: {{level}} run", [], 1,
    f"{_ms(chr(39) + '1996 ' + chr(39) + ' || ' + _part(_BSD), '%Y %b %d %H:%M:%S')} AS ts, lower({_part(_BSD, 5)}) AS level, {_part(_BSD, 3)} AS logger, '' AS thread, '' AS exception, 'host=' || {_part(_BSD, 2)} || ';app=' || {_part(_BSD, 3)} || ';pid=' || {_part(_BSD, 4)} AS fields",
)
_register(
    "ingest_plain", Format("plain", timestamped=True), {"t": ("yyyy/MM/dd HH:mm:ss", "%Y/%m/%d %H:%M:%S")},
    "[{{worker}}] {{t}} order {{k}} {{level}} ERRORS", ["  and more of {{k}}"], 2,
    f"{_ms(_part('^.[0-9]. ([0-9/]+ [0-9:]+) '), '%Y/%m/%d %H:%M:%S')} AS ts, lower({_part(' (INFO|WARN|ERROR|DEBUG) ')}) AS level, '' AS logger, '' AS thread, '' AS exception, '' AS fields",
)
_register(
    "ingest_xml", Format("xml"), {"t": ("yyyy-MM-dd HH:mm:ss.SSS", "%Y-%m-%d %H:%M:%S.%g"), "ms": ("yyyyMMddHHmmssSSS", "%Y%m%d%H%M%S%g")},
    '<log4j:event logger="com.shop.{{status}}" timestamp="{{ms}}" level="{{level}}" thread="w-{{worker}} &amp; co">',
    ["<log4j:message><![CDATA[order <{{k}}> &amp; more]]></log4j:message>", '<log4j:properties><log4j:data name="at" value="{{t}}"/></log4j:properties>', "</log4j:event>"], 1,
    f"""{_part('timestamp="([0-9]+)"')}::BIGINT AS ts, lower({_part('level="([A-Z]+)"')}) AS level, {_part('logger="([^"]+)"')} AS logger, replace({_part('thread="([^"]+)"')}, '&amp;', '&') AS thread, '' AS exception,
  (SELECT 'at=' || regexp_extract(b.text, 'value="([^"]+)"', 1) FROM l b WHERE b.k = l.k AND b.j = 2) AS fields""",
    message="max(regexp_extract(text, 'CDATA.(.*)..></log4j:message>', 1))",
)


# -- dates ---------------------------------------------------------------------------

#: Java formats, the same for strptime, and what a time loses in it (its unit in milliseconds).
_DATES = [
    ("yyyy-MM-dd HH:mm:ss,SSS", 1),
    ("yyyy-MM-dd'T'HH:mm:ss.SSS", 1),
    ("yyyyMMddHHmmssSSS", 1),
    ("dd MMM yyyy HH:mm:ss,SSS", 1),
    ("dd/MM/yy HH:mm:ss.SSS", 1),
    ("MM/dd/yyyy hh:mm:ss a", 1000),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", 1000),
    ("EEE MMM dd HH:mm:ss yyyy", 1000),
    ("yyyy-MM-dd HH:mm", 60000),
    ("d.M.yyyy H:m:s", 1000),
]


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    # years before 2000 don't fit two digits
    moved = o.withColumn("w", F.col("w") + F.make_ym_interval(F.lit(10)))
    return moved.select("k", *[ln.timestamps(_time(java), java).alias(f"t{n}") for n, (java, _) in enumerate(_DATES)])


QUERIES["dates_all"] = _dates
ORACLE_SQL["dates_all"] = _BASE + "m AS (SELECT k, epoch_ms(w + INTERVAL 10 YEAR) AS ms FROM o) SELECT k, " + ", ".join(f"ms - ms % {unit} AS t{n}" for n, (_, unit) in enumerate(_DATES)) + " FROM m"


# -- sizes and names -----------------------------------------------------------------


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One opening line in each file, then continuations of up to 2,000 characters: far more than an event keeps."""
    o = _orders(spark, sf_dir)
    rows = o.select("file", F.col("k").alias("line_no"), F.concat(F.lit("  "), F.repeat(F.lit("x"), (F.col("k") % 2000).cast("int"))).alias("text"))
    heads = rows.groupBy("file").agg(F.lit(-1).cast("long").alias("line_no"), F.lit("2026-01-02 03:04:05 INFO begin").alias("text"))
    found = ln.events_of_lines(heads.unionByName(rows), Format("plain", timestamped=True), block_lines=500)
    return found.select("file", "line_no", "n_lines", F.octet_length("message").cast("long").alias("bytes"), F.md5("message").alias("digest"))


QUERIES["size_cap"] = _capped
ORACLE_SQL["size_cap"] = (
    _BASE + """l AS (SELECT file, k AS line_no, '  ' || repeat('x', (k % 2000)::INTEGER) AS text FROM o UNION ALL SELECT DISTINCT file, -1, '2026-01-02 03:04:05 INFO begin' FROM o),
c AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) - length(text) - 2 AS held FROM l),
d AS (SELECT *, CASE WHEN line_no < 0 OR held + 1 + length(text) <= 262144 THEN text WHEN held < 262144 THEN substring(text, 1, (262144 - held - 1)::INTEGER) || ' …[truncated]' END AS kept FROM c),
e AS (SELECT file, min(line_no)::BIGINT AS line_no, count(*) AS n_lines, string_agg(kept, chr(10) ORDER BY line_no) AS message FROM d GROUP BY file)
SELECT file, line_no, n_lines, strlen(message)::BIGINT AS bytes, md5(message) AS digest FROM e"""
)


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group that a rolled file belongs to, for names made of orders."""

    @F.arrow_udf("string")
    def name(names: pa.Array) -> pa.Array:
        return pa.array(map(source_of, names.to_pylist()), type=pa.string())

    return _orders(spark, sf_dir).withColumn("day", _time("yyyy-MM-dd")).select("k", name(_rolled_name()).alias("source"))


def _rolled_name() -> Column:
    shapes = ["app.log.{{worker}}.gz", "app-{{day}}-{{worker}}.log.gz", "logs/app.{{day}}.log", "node-{{worker}}.log", "{{day}}.log", "app.out.{{worker}}"]
    return F.element_at(F.array(*map(_said, shapes)), (F.col("k") % len(shapes)).cast("int") + 1)


QUERIES["rolled_names"] = _rolled
ORACLE_SQL["rolled_names"] = _BASE + "n AS (SELECT k, worker, strftime(w, '%Y-%m-%d') AS day FROM o) SELECT k, CASE k % 6 WHEN 0 THEN 'app.log' WHEN 1 THEN 'app.log' WHEN 2 THEN 'logs/app.log' WHEN 3 THEN 'node-' || worker || '.log' WHEN 4 THEN day || '.log' ELSE 'app.out' END AS source FROM n"
