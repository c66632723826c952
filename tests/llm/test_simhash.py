import numpy as np
import pytest
import xxhash

from spindrift.llm import components, simhash


def brute_fingerprint(text, n=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def brute_components(rows):
    """rows: (id, fingerprint); the least id reachable, by rows."""
    fps = sorted({f for _, f in rows})
    a = np.array(fps, dtype=np.uint64)
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 3)[0]:
            x, y = root(i), root(i + 1 + int(j))
            label[max(x, y)] = min(x, y)
    least = {}
    for d, f in rows:
        r = root(fps.index(f))
        least[r] = min(least.get(r, d), d)
    return sorted((d, f, least[root(fps.index(f))]) for d, f in rows)


def test_every_small_difference_is_left_out_by_a_mask():
    masks = simhash.covering_masks(3)
    rng = np.random.default_rng(1)
    for _ in range(3000):
        d = sum(1 << int(p) for p in set(rng.integers(0, 64, 3)))
        assert any(m & d == 0 for m in masks)
    assert all(24 <= m.bit_count() <= 40 for m in masks)


def test_fingerprints(spark):
    texts = ["", None, " \n\t", "One", "one two", "a b c", "A B c d e f", "ä ö ü ß ñ " * 50, "x " * 70000, "no break here now ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.fp % 2**64 for r in simhash.fingerprints(df).collect()}
    assert got == {k: brute_fingerprint(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("bucket", [1024, 4])
def test_components_equal_brute_force(spark, bucket):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 20)]
    fps = []
    for b in base:
        at = b
        for _ in range(12):  # chains and clouds
            at ^= int(sum(1 << int(p) for p in set(rng.integers(0, 64, int(rng.integers(1, 5))))))
            fps.append(at)
    fps += [b ^ (1 << int(p)) for b in base[:2] for p in rng.integers(0, 64, 150)]
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in set(fps)], "fp long")
    edges = simhash.links(df, bucket=bucket)
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.connected_components(edges).collect()}
    ids = {f: k for k, f in enumerate(sorted(set(fps)))}
    want = brute_components([(k, f) for f, k in ids.items()])
    got = {}
    for f in ids:
        got.setdefault(roots.get(f, f), []).append(ids[f])
    assert sorted((k, f, min(got[roots.get(f, f)])) for f, k in ids.items()) == want


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.op8_simhash(spark, d).collect())
    assert got == brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs])


def test_odd_rows(spark):
    rows = [(None, "a b c d", "x"), (5, None, "y"), (3, "", "z"), (7, "a b c d", "x"), (7, "a b c d", "x"), (9, "q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 7), (5, 3), (3, 3), (7, 7), (7, 7), (9, 9)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d", 7, "x"), (2, "a b c d", 8, "y"), (1, "a b c d", 7, "z"), (None, "q r s t u v", 9, "w"), (None, "q r s t u v", 9, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hash long, key_0 string")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r._hash) for r in got.collect()) == [(0, 9), (1, 7)]


def open_joins(monkeypatch, spark, run):
    """The joins that ``run`` makes without saying how, which leaves it to the size of files what is broadcast."""
    kind = type(spark.range(0))
    join, found = kind.join, []

    def watched(self, *a, **b):
        out = join(self, *a, **b)
        found.append(next(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x))
        return out

    monkeypatch.setattr(kind, "join", watched)
    run()
    assert found
    return [x for x in found if "strategy=" not in x]


def test_exploded_keys_are_not_broadcast(spark, tmp_path):
    # a small file, and fifteen keys for each of its rows
    spark.range(2000).selectExpr("id * 7 AS fp").write.parquet(str(tmp_path / "fps"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "fps")))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


@pytest.mark.parametrize("few", [0, 50_000])
def test_components_with_and_without_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(components, "BROADCAST_EDGES", few)
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (60, 50), (50, 60)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 150)} | {50: 50, 60: 50}


def test_query_says_how_it_joins(spark, monkeypatch):
    assert open_joins(monkeypatch, spark, lambda: simhash.op8_simhash(spark, "/root/testdata/sf0.001").collect()) == []
