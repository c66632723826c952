"""All matching events as CSV or JSON lines, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..lang import syntax as ast
from ..plans.compiler import search
from .pages import order

HEADER = "time,level,logger,thread,exception,file,line,fields,message"


def iso_time(ts: Column) -> Column:
    """UTC with milliseconds, whatever the session's zone."""
    utc = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=(ts / 1000).cast("decimal(18,6)"))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def _cell(text: Column) -> Column:
    return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _pairs(events: DataFrame) -> Column:
    return F.concat(F.col("fields"), F.col("parsed")) if "parsed" in events.columns else F.col("fields")


def csv_line(events: DataFrame) -> Column:
    fields = F.array_join(F.transform(_pairs(events), lambda p: F.concat(p["name"], F.lit("="), p["value"])), " ")
    cells = [iso_time(F.col("ts")), F.col("level"), *map(_cell, (F.col("logger"), F.col("thread"), F.col("exception"), F.col("file"))), F.col("line_no").cast("string"), _cell(fields), _cell(F.col("message"))]
    return F.concat_ws(",", *cells)



def json_line(events: DataFrame) -> Column:
    """One object, keys in order; own keys win over fields of their name."""
    own = ("time", "level", "logger", "thread", "exception", "file", "line", "message")
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    entries = [("time", text(iso_time(F.col("ts")))), *((c, text(F.col(c))) for c in ("level", "logger", "thread")), ("file", text(F.col("file"))), ("line", F.col("line_no").cast("string")), ("message", text(F.col("message")))]
    core = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in entries])
    core = F.concat(core, F.when(F.col("exception") != "", F.array(F.struct(F.lit("exception").alias("k"), text(F.col("exception")).alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>")))
    pairs = _pairs(events)
    free = F.filter(pairs, lambda p: ~p["name"].isin(*own) | (p["name"] == "exception") & (F.col("exception") == ""))
    names = F.array_distinct(F.transform(free, lambda p: p["name"]))
    # the first value under a name stays
    more = F.transform(names, lambda n: F.struct(n.alias("k"), text(F.element_at(F.filter(free, lambda p: p["name"] == n), 1)["value"]).alias("v")))
    joined = F.transform(F.array_sort(F.concat(core, more)), lambda e: F.concat(text(e["k"]), F.lit(":"), e["v"]))
    return F.concat(F.lit("{"), F.array_join(joined, ","), F.lit("}"))


def lines(events: DataFrame, query: ast.Query | str, kind: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Matching events with their export line, unordered."""
    found = search(events, query, True, start, end)
    return found.withColumn("export", csv_line(found) if kind == "csv" else json_line(found))


def write(events: DataFrame, query: ast.Query | str, folder: str, kind: str = "csv", forward: bool = False, start: int | None = None, end: int | None = None, single_file: bool = False) -> int:
    """Writes the lines in order as text files and returns their number.

    The files of a range-partitioned sort are in order, so no task gets more
    than its range; ``single_file`` gathers them in one (for small results).
    """
    counted = Observation()
    out = lines(events, query, kind, start, end).orderBy(*order(forward)).select("export").observe(counted, F.count(F.lit(1)).alias("n"))
    (out.coalesce(1) if single_file else out).write.mode("overwrite").text(folder)
    return counted.get["n"]
