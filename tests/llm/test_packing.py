import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spindrift.llm import packing

JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "   x́  ٣٤ ½ 𝟘 𐍈 \U0001f468‍\U0001f469 \u0000\u001f", "it's we'LL 'd  \n\n \t end ", "ǅ ª º ⅷ ² ༳ ᢅ 中文字符 ไทย", "x" * 3000, "  " * 700]


def test_ranks_give_the_ids_of_the_json_vocabulary(spark):
    slow, fast = packing.encoder(JSON), packing.encoder(packing.default_vocabulary())
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in ODD + docs:
        assert slow(text).tolist() == fast(text).tolist()


def fewest(sizes, capacity):
    """Optimum by trying everything."""
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] >= sizes[k] and bins[i] not in bins[:i]:
                bins[i] -= sizes[k]
                go(k + 1, bins)
                bins[i] += sizes[k]
        bins.append(capacity - sizes[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_search_reaches_the_optimum_of_small_cases(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, int(rng.integers(1, 11)))
    counts = np.bincount(sizes, minlength=65)
    plan = packing.complete(counts, 64)
    used = np.zeros(65, dtype=int)
    for fill, times in plan:
        assert sum(s * n for s, n in fill.items()) <= 64
        for s, n in fill.items():
            used[s] += n * times
    assert (used == counts).all()
    assert packing.lower_bound(counts, 64) <= fewest(list(sizes), 64) == sum(t for _, t in plan)


def verify(rows, docs, capacity=1024):
    tok = Tokenizer.from_file(JSON)
    want = []
    for key, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first, at, k = len(ids) % capacity or capacity, 0, 0
        while at < len(ids):
            n = first if not at else capacity
            want.append((key, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at, k = at + n, k + 1
    assert sorted(map(str, want)) == sorted(str((r.id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    seq = {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(seq)


def test_query_round_trip(spark):
    d = "/root/testdata/sf0.01"
    rows = packing.op7_packing(spark, d).withColumnRenamed("doc_id", "id").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    n = verify(rows, docs)
    assert n <= 1.003 * (1 + sum(r.length for r in rows) // 1024)


def test_odd_rows(spark):
    docs = [(k, t) for k, t in enumerate(ODD)] + [(None, None), (3, "same"), (3, "same"), (99, "long text " * 5000)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, length string, piece int")
    verify(packing.pack_documents(df).collect(), docs)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_ids_are_kept_on_demand(spark):
    df = spark.createDataFrame([(1, "hello there"), (2, None)], "doc_id long, text string")
    got = {r.id: r.ids for r in packing.pack_documents(df, with_ids=True).collect()}
    assert got == {1: [*Tokenizer.from_file(JSON).encode("hello there").ids, 2], 2: [2]}


def test_many_pieces_of_a_length_are_numbered_in_parts(spark):
    rows = [(k if k % 3 else None, 0, (512, 300, 212)[k % 3], k, "s") for k in range(900)]
    df = spark.createDataFrame(rows, "id long, piece int, length long, salt_0 long, _rank string")
    got = packing.pack(df, per_salt=50)
    assert got.columns == [*df.columns, "sequence_id", "offset"]
    fill = {}
    for r in got.collect():
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(fill) == 300 and sum(map(len, fill.values())) == 900
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024
