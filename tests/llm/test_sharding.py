import collections
import zlib

import numpy as np

from spindrift.llm import sharding


def held(rows, shards=8, whole_percent=10):
    """Sizes near equal, slots gapless, groups whole but for large ones."""
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    size, slots, group = collections.Counter(), collections.defaultdict(list), collections.defaultdict(lambda: [0, set()])
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        group[r.text_crc32, r.size][0] += r.size
        group[r.text_crc32, r.size][1].add(r.shard)
    assert set(size) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for k in range(shards):
        assert abs(size[k] - total / shards) <= 2 * max(largest, total / shards * whole_percent / 100)
    limit = total / shards * whole_percent / 100
    assert all(len(s) == 1 or n > limit for n, s in group.values())
    assert sum(len(s) - 1 for _, s in group.values()) < shards


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = sharding.op3_sharding(spark, d).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id]), "bytes", None) for r in rows)
    held(rows)


def test_hot_group_is_subdivided(spark):
    rows = [(k, "hot " * 20 if k % 3 == 0 else f"text {k} " * (k % 9)) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(sharding.sized(df)).collect()
    held(got)
    assert len({r.shard for r in got if r.size == 81}) >= 3


def test_ranges_equal_brute_force():
    rng = np.random.default_rng(0)
    keys, ties = rng.integers(0, 6, 500), rng.integers(0, 50, 500)
    splitters = sharding.splitters_of(np.stack([rng.integers(0, 6, 90), rng.integers(0, 50, 90)], axis=1), 20)
    want = [sum((a, b) <= (k, t) for a, b in splitters.tolist()) for k, t in zip(keys.tolist(), ties.tolist(), strict=True)]
    assert sharding.range_numbers(keys, ties, splitters).tolist() == want


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "x" * 300000), (3, "é"), (3, "é"), (4, None)]
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id long, text string, shard int, slot string")
    got = sharding.shard(sharding.sized(df)).collect()
    assert sorted(r.size for r in got) == [1, 1, 1, 1, 3, 3, 300001]
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(sharding.sized(df.limit(0))).count() == 0


def test_records_without_ids_are_split_and_names_may_clash(spark):
    rows = [(None, 5, 10, "x", 1, 2)] * 3000 + [(k, k % 50, 10, "y", 3, 4) for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, key long, size long, tie_0 string, _range long, row_0 long")
    got = sharding.shard(df)
    assert got.columns == [*df.columns, "shard", "slot"]
    found = got.collect()
    count = collections.Counter(r.shard for r in found)
    assert len(found) == 4000 and set(count) == set(range(8)) and max(count.values()) - min(count.values()) <= 60
    assert sum(r.tie_0 == "x" and r._range == 1 and r.row_0 == 2 for r in found) == 3000
