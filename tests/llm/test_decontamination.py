import numpy as np
import pytest

from spindrift.llm import decontamination as dec


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            before, row[j] = row[j], min(before + (p != c), row[j] + 1, row[j - 1] + 1)
    return min(row)


@pytest.mark.parametrize("seed", range(20))
def test_myers_equals_the_table(seed):
    rng = np.random.default_rng(seed)
    p, t = ("".join(rng.choice(list("ab c"), int(n))) for n in (rng.integers(1, 90), rng.integers(0, 120)))
    d, end = dec.myers(p, t)
    assert d == least_distance(p, t) == (least_distance(p, t[:end]) if end else len(p))


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = int(rng.integers(0, len(out)))
        kind = rng.integers(0, 3)
        if kind == 0:
            out[at] = "q"
        elif kind == 1:
            out.insert(at, "q")
        else:
            out.pop(at)
    return "".join(out)


def test_every_match_within_the_budget_is_found():
    rng = np.random.default_rng(3)
    words = ["an", "the", "on", "re", "st", "ly", "er", "ou", "tion", "ble"]
    say = lambda n: " ".join("".join(rng.choice(words, int(rng.integers(1, 4)))) for _ in range(n))
    texts = [say(25) for _ in range(12)] + ["short one here"]
    items = dec.Items(list(range(len(texts))), texts, 0.1, 24)
    for _ in range(60):
        k = int(rng.integers(0, 12))
        n = int(rng.integers(0, 2 * items.budget[k]))
        doc = dec.normalised(say(40) + " " + edited(rng, texts[k], n) + " " + say(40))
        want = {j for j in range(12) if least_distance(texts[j], doc) <= items.budget[j]}
        got = {j: d for j, _, _, d in items.matches(doc)}
        assert set(got) == want
        assert all(d <= items.budget[j] for j, d in got.items())


def test_query_finds_what_a_plain_search_finds(spark):
    d = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in dec.op9_decontamination(spark, d).collect()}
    docs = [(r.doc_id, dec.normalised(r.text or "")) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, dec.normalised(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    exact = {(i, k) for i, t in docs for k, x in items if x in t}
    assert exact and exact <= got


def test_odd_rows(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf."
    rows = [(1, "x " * 100000 + item.upper().replace(" ", "\n") + " y" * 100000), (2, None), (3, ""), (4, item), (4, item), (None, item), (5, "tiny thing"), (6, "tinything"), (7, "İ " + item)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, " .. "), (5, "tiny")], "item_id long, text string")
    got = sorted(((r.id or 0, r.item_id, r.distance) for r in dec.find_items(docs, bench).collect()))
    assert got == sorted([(k, i, 0) for k in (0, 1, 4, 4, 7) for i in (1, 2)] + [(5, 5, 0)])
    spans = {(r.id, r.start, r.end) for r in dec.find_items(docs, bench).collect() if r.item_id == 1}
    assert (4, 0, len(item) - 1) in spans and (7, 2, len(item) + 1) in spans and (1, 200000, 200000 + len(item) - 1) in spans
    assert sorted(((r.id or 0, r.item_id, r.distance) for r in dec.find_items(docs, bench, part_chars=60).collect())) == got
    assert dec.find_items(docs.limit(0), bench).count() == dec.find_items(docs, bench.limit(0)).count() == 0


def test_whole_query_equals_a_search_for_every_item(spark):
    d = "/root/testdata/sf0.001"
    items = [(r.item_id, dec.normalised(r.text or "")) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        text = dec.normalised(r.text or "")
        for k, item in items:
            distance = dec.myers(item, text)[0] if item and text else len(item) + 1
            if item and distance <= len(item) // 10:
                want.add((r.doc_id, k, distance))
    assert all(len(x) >= 24 for _, x in items)
    assert {(r.doc_id, r.item_id, r.distance) for r in dec.op9_decontamination(spark, d).collect()} == want and want


def test_names_may_clash(spark):
    item = "a passage of several words that stands in a benchmark"
    docs = spark.createDataFrame([(1, item, 3, "a"), (2, "something else", 4, "b")], "doc_id long, text string, _new_items int, _in_0 string")
    left = dec.clean_documents(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "something else", 4, "b")]
