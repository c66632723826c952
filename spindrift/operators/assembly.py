"""Lines that are already rows to events: multi-line grouping as DataFrame operations.

For lines that come from tables or queues rather than files.  The state that
runs along a file (the event that a line belongs to, the last timestamp) is
carried in two steps: within blocks of lines, and over one summary row for each
block.  So no task gets a whole file, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lang.dialect import PREFIX

#: Fixed value: an exception's first line.
EXCEPTION = PREFIX + r"\A\s*(?:Caused by: |Exception in thread .*? )?((?:[a-zA-Z_$][\w$]*\.)+[A-Z][\w$]*(?:Exception|Error|Throwable|Fault)(?:\$[\w$]+)?)(?::|\s*\z)"
MAX_BYTES = 256 * 1024


def exception_of(line: Column) -> Column:
    """The exception class that a line names, or an empty text."""
    return F.when(line.contains("."), F.regexp_extract(line, EXCEPTION, 1)).otherwise("")


def carried(lines: DataFrame, file: str, line_no: str, values: dict[str, Column], sums: dict[str, Column] | None = None, block_lines: int = 50_000) -> DataFrame:
    """``lines`` with the last non-null of each value, and each running sum, at or before a line, in its file."""
    sums = sums or {}
    blocked = lines.withColumn("_block", F.floor(F.col(line_no) / block_lines))
    for name, value in (values | sums).items():
        blocked = blocked.withColumn(f"_own_{name}", value)
    within = Window.partitionBy(file, "_block").orderBy(line_no).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = lambda name: F.max_by(f"_own_{name}", F.when(F.col(f"_own_{name}").isNotNull(), F.col(line_no)))
    ends = blocked.groupBy(file, "_block").agg(*[latest(n).alias(f"_end_{n}") for n in values], *[F.sum(f"_own_{n}").alias(f"_end_{n}") for n in sums])
    before = Window.partitionBy(file).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.select(F.col(file).alias("_file"), F.col("_block").alias("_b"), *[F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_brought_{n}") for n in values], *[F.sum(f"_end_{n}").over(before).alias(f"_brought_{n}") for n in sums])
    filled = blocked.select("*", *[F.last(f"_own_{n}", ignorenulls=True).over(within).alias(f"_within_{n}") for n in values], *[F.sum(f"_own_{n}").over(within).alias(f"_within_{n}") for n in sums])
    joined = filled.join(brought, (filled[file].eqNullSafe(brought["_file"])) & (filled["_block"] == brought["_b"]), "left")
    return joined.select(*lines.columns, *[F.coalesce(f"_within_{n}", f"_brought_{n}").alias(n) for n in values], *[(F.col(f"_within_{n}") + F.coalesce(f"_brought_{n}", F.lit(0))).alias(n) for n in sums])


def assemble(lines: DataFrame, is_start: Column, ts: Column, fallback: Column, file: str = "file", line_no: str = "line_no", text: str = "text", block_lines: int = 50_000, kept: dict[str, Column] | None = None) -> DataFrame:
    """``(file, line_no, ts, ts_inferred, n_lines, exception, message)``, one row for each event.

    is_start says which lines open an event, ts is an opening line's own time
    (null: inherited), fallback the time before any timestamp.  Lines before the
    first opening one are an event of their own.  The exception is the first that
    a continuation names (on lines before any opening one, also the first).
    Continuations are kept up to 256 KiB an event; where each stands is known
    from running sums before lines are gathered, so no event gathers more.
    ``kept`` columns are taken from the event's first line if it opens one.
    """
    kept = kept or {}
    rows = lines.select(F.col(file).alias("file"), F.col(line_no).cast("long").alias("line_no"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(is_start, F.lit(False)).alias("_start"), ts.alias("_ts"), fallback.alias("_fallback"), *[c.alias(f"_kept_{n}") for n, c in kept.items()])
    opening = lambda c: F.when(F.col("_start"), F.col(c))
    size = F.octet_length("text").cast("long") + 1
    sized = carried(rows, "file", "line_no", {"_event": opening("line_no"), "_time": opening("_ts")}, {"_total": size}, block_lines)
    state = carried(sized, "file", "line_no", {"_base": F.when(F.col("_start"), F.col("_total") - size)}, None, block_lines)
    # bytes of the event before this line, with the line feeds between
    held = F.greatest(F.col("_total") - size - F.coalesce("_base", F.lit(0)) - 1, F.lit(0))
    state = state.withColumn("_event", F.coalesce("_event", F.lit(0))).withColumn("_held", held)
    named = F.when(~F.col("_start"), F.nullif(exception_of(F.col("text")), F.lit("")))
    own = state.withColumn("_exception", named)
    found = own.groupBy("file", "_event").agg(
        F.min("line_no").alias("line_no"),
        F.min_by("_time", "line_no").alias("_time"),
        F.min_by(opening("_ts"), "line_no").alias("_own"),
        F.min("_fallback").alias("_fallback"),
        F.count("*").alias("n_lines"),
        F.min_by("_exception", F.when(F.col("_exception").isNotNull(), F.col("line_no"))).alias("_exception"),
        F.array_sort(F.collect_list(F.when((F.col("_held") < MAX_BYTES) | F.col("_start"), F.struct("line_no", "text")))).alias("_lines"),
        *[F.min_by(opening(f"_kept_{n}"), "line_no").alias(n) for n in kept],
    )
    return found.select(
        "file",
        "line_no",
        F.coalesce("_time", "_fallback").alias("ts"),
        F.col("_own").isNull().alias("ts_inferred"),
        "n_lines",
        F.coalesce("_exception", F.lit("")).alias("exception"),
        _joined("_lines").alias("message"),
        *kept,
    )


def _joined(lines: str) -> Column:
    """The lines' text, cut where continuations exceed the limit."""
    texts = F.transform(lines, lambda x: x["text"])
    plain = F.array_join(texts, "\n")
    begin = F.struct(F.element_at(texts, 1).alias("text"), F.octet_length(F.element_at(texts, 1)).cast("long").alias("size"))

    def add(acc, line):
        room = F.lit(MAX_BYTES) - acc["size"] - 1
        fits = F.octet_length(line) <= room
        cut = F.concat(F.decode(F.substring(F.encode(line, "utf-8"), F.lit(1), room.cast("int")), "utf-8"), F.lit(" …[truncated]"))
        return F.when(acc["size"] >= MAX_BYTES, acc).otherwise(F.struct(F.concat(acc["text"], F.lit("\n"), F.when(fits, line).otherwise(cut)).alias("text"), F.when(fits, acc["size"] + 1 + F.octet_length(line)).otherwise(F.lit(MAX_BYTES)).cast("long").alias("size")))

    return F.when(F.octet_length(plain) <= MAX_BYTES, plain).otherwise(F.aggregate(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(1))), begin, add, lambda acc: acc["text"]))
