import io
import os

from spindrift import cli
from spindrift.functions import fields as fx
from spindrift.plans.compiler import EVENT_SCHEMA, search
from spindrift.sources.events import Format
from spindrift.streaming import tail

LINE = '2026-10-08 INFO c.Svc - {"status":503,"duration":"2.5s","req":{"path":"/pay"}}'
CASES = [
    (r'{logger=~"com\.acme\.payment.*"}', "x", True),
    (r'{logger=~"com\.acme\.order.*"}', "x", False),
    ('{requestId="r-1"} |= "time"', "a timeout", True),
    ('{} |= "time" != "out"', "a timeout", False),
    ('{} |~ "t[a-z]+out"', "a timeout", True),
    ('{} |= "nope" or "time"', "a timeout", True),
    ('{missing!="x"}', "x", True),
    ("{} | json | status >= 500 and duration > 2s", LINE, True),
    ('{} | json | req_path = "/pay"', LINE, True),
    ("{} | json | status < 500", LINE, False),
    ("{} | logfmt | took > 100ms", 'msg="done x" took=250ms user=bob', True),
    ('{} | logfmt | user = "bob" or user = "alice"', "user=bob", True),
    (r'{} | regexp "took (?P<ms>\d+)ms" | ms > 100', "took 250ms", True),
    (r'{} | regexp "took (?P<ms>\d+)ms" | ms > 300', "took 250ms", False),
    ("| logfmt | x != 5", "x=nan", True),
    ("| logfmt | x == 5", "x=5d", False),
    ("| logfmt | x >= 5", "x=inf", True),
    ('| logfmt | x == "a b"', 'x="a \\b', True),
    ('| logfmt | x == "2"', "x=1 y x=2", True),
    ('| json | a == "1.0"', '{"a": 1.0}', True),
    ('| json | a == "[1,null]"', '{"a": [1, null]}', True),
    ('| json | a == "x"', '{"a": "x"} y', False),
    ('| json | a == "x"', 'pre {"a": "x"}\n{"a": "y"}', True),
    (r'| regexp `(?P<a>x)?(?P<b>y)` | a == "" and b == "y"', "y", True),
]


def test_queries_on_one_event(spark):
    for query, message, want in CASES:
        row = (0, "info", "s", "f", 0, 1, "com.acme.payment.Client", "main", "", [("requestId", "r-1")], message, False)
        assert search(spark.createDataFrame([row], EVENT_SCHEMA), query).count() == want, query


def test_regexp_leaves_out_what_took_no_part(spark):
    df = spark.createDataFrame([("y",), ("xy",)], "m string")
    got = [[(p.name, p.value) for p in r[0]] for r in df.select(fx.regexp_fields(df.m, "(?P<a>x)?(?P<b>y)(?P<c>z*)")).collect()]
    assert got == [[("b", "y"), ("c", "")], [("a", "x"), ("b", "y"), ("c", "")]]


def test_number_text():
    want = {1e3: "1000.0", 1e21: "1e21", 1e16: "1e16", 123456789012345680.0: "1.2345678901234568e17", 1e-5: "1e-5", 0.001: "0.001", 1.5: "1.5", -2.0: "-2.0", 1e15: "1000000000000000.0", 0.00001234: "0.00001234", 7: "7"}
    want[1e-5] = "0.00001"
    assert {k: fx.number_text(k) for k in want} == want


def test_plans(spark, tmp_path):
    """Labels prune partitions, times reach the scan, a count asks for few columns, and nothing is shuffled by a filter."""
    rows = [(k, ("info", "error")[k % 2], "s", "f", 0, k, "l", "t", "", [("a", "b")], f"m{k}", False) for k in range(20)]
    spark.createDataFrame(rows, EVENT_SCHEMA).write.partitionBy("level").parquet(str(tmp_path / "e"))
    events = spark.read.schema(EVENT_SCHEMA).parquet(str(tmp_path / "e"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = search(events, '{level="error", logger="l"} |= "m1" | logfmt', False, 3, 9).select("ts")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan or "PartitionFilters: [(level" in plan
    assert "GreaterThanOrEqual(ts,3)" in plan
    assert "EqualTo(logger,l)" in plan and "StringContains(message,m1)" in plan
    assert "ReadSchema: struct<ts:bigint,logger:string,message:string>" in plan and "Exchange" not in plan and "Python" not in plan


def test_command_line(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("2026-10-08 10:00:00 one WARN\n2026-10-08 10:00:01 two ERROR\n  more\n")
    run = lambda *a: (out := io.StringIO(), cli.main([str(tmp_path / "logs"), *a, "--data", str(tmp_path / "data")], spark, out))
    out, code = run('{level="error"}')
    assert code == 0 and out.getvalue() == "error 2026-10-08 10:00:01 two ERROR  (+1 lines)\n"
    out, code = run("--labels")
    assert out.getvalue().startswith("level [stream]: error(1), warn(1)")
    assert '"kind": "plain"' in run("--preview")[0].getvalue()
    assert run("{oops")[1] == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2026-10-08 10:00:00 INFO a took=5ms\n2026-10-08 10:00:01 ERROR b took=500ms\n2026-10-08 10:20:00 INFO c\n")
    events = tail.follow(spark, str(tmp_path / "in"), Format("plain", timestamped=True))
    query = tail.matching(events, "| logfmt | took > 100ms").writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.message for r in spark.table("hits").collect()] == ["2026-10-08 10:00:01 ERROR b took=500ms"]
    counted = tail.windowed_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination(60)
    assert sorted((r.level, r["count"]) for r in spark.table("counts").collect()) == [("error", 1), ("info", 1), ("info", 1)]
    assert os.path.isdir(tmp_path / "in")
