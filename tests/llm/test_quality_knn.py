import zlib

import numpy as np

from spindrift.llm import quality_knn as knn


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = knn.op6_quality_classifier(spark, d).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in quality]
    assert np.mean([r.predicted == quality[r.doc_id] for r in held]) > 0.97


def test_vote_equals_brute_force():
    rng = np.random.default_rng(2)
    vectors = knn.unit(rng.standard_normal((40, 6)))
    model = knn.Model(0, np.zeros(1), np.zeros(1), vectors, rng.integers(0, 2, 40).astype(float))
    rows = knn.unit(rng.standard_normal((9, 6)))
    for row, got in zip(rows, knn.vote(rows, model, 5, 8), strict=True):
        near = sorted(((float(row @ v), float(y)) for v, y in zip(vectors, model.labels, strict=True)), reverse=True)[:5]
        assert abs(got - sum(s**8 * y for s, y in near) / sum(s**8 for s, _ in near)) < 1e-9
    assert knn.vote(np.zeros((2, 6)), model, 5, 8).tolist() == [0, 0]


def test_shapes():
    assert [knn.shape(w) for w in (b"LA!!", b"Wh%%%", "été,".encode(), b"|", b"2024-01")] == [b"A!", b"Aa%", b"a,", b"|", b"0-0"]


def test_odd_rows(spark):
    text = "Some plain words in a row and more of them."
    rows = [(1, text), (2, "BAD!! " * 30), (3, None), (4, ""), (5, "x " * 500000), (5, "x " * 500000), (None, text)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (9, 1), (None, 1), (4, None)], "doc_id long, quality int")
    got = [(r.id, r.score) for r in knn.score(docs, knn.learn(docs, labels, "quality", dimensions=2)).collect()]
    by_id = dict(got)
    assert by_id[1] > 0.5 > by_id[2] and by_id[3] == by_id[4] == 0.0 and by_id[None] == by_id[1]
    assert len({s for k, s in got if k == 5}) == 1
    nothing = knn.learn(docs, labels.limit(0), "quality")
    assert {r.score for r in knn.score(docs, nothing).collect()} == {0.0}
    assert knn.score(docs.limit(0), None).count() == 0


def test_ties_share_the_last_places():
    vectors = np.array([[1.0, 0], [0, 1.0], [0, 1.0], [0, 1.0]])
    model = knn.Model(0, np.zeros(1), np.zeros(1), vectors, np.array([1.0, 0.0, 1.0, 1.0]))
    row = np.array([[0.8, 0.6]])
    got = knn.vote(row, model, 2, 2)[0]
    assert abs(got - (0.64 + 0.36 * 2 / 3) / (0.64 + 0.36)) < 1e-12
    assert knn.vote(row, knn.Model(0, np.zeros(1), np.zeros(1), vectors[[3, 2, 1, 0]], np.array([1.0, 1.0, 0.0, 1.0])), 2, 2)[0] == got


def plain_row(text, idf, words=2048):
    """Shapes and weighted words of a text, each of unit length, by plain loops."""
    shapes, count, before = np.zeros(knn.SHAPES), np.zeros(words), None
    for w in (text or "").encode().split():
        shapes[knn.SHAPES - 1 if w == before else zlib.crc32(knn.shape(w)) % (knn.SHAPES - 1)] += 1
        count[zlib.crc32(w.lower()) % words] += 1
        before = w
    block = lambda v, share: v / (np.linalg.norm(v) or 1) * share
    return np.concatenate([block(shapes, 0.9), block(np.log1p(count) * idf, 0.436)])


def test_query_equals_a_plain_version(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    ids = sorted(k for k in labels if k in texts)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = knn.learn(docs, knn.learnable(spark.read.parquet(f"{d}/labels.parquet")), "quality")
    df = np.zeros(2048)
    for k in ids:
        df[list({zlib.crc32(w.lower()) % 2048 for w in (texts[k] or "").encode().split()})] += 1
    idf = np.log((1 + len(ids)) / (1 + df))
    assert np.allclose(model.idf, idf, atol=1e-5) and model.labels.tolist() == [labels[k] for k in ids]
    x = np.stack([plain_row(texts[k], idf) for k in ids])
    singular = np.linalg.svd(x, compute_uv=False)[: model.space.shape[1]]
    assert np.allclose(model.space.T @ model.space, np.eye(model.space.shape[1]), atol=1e-3)
    assert np.linalg.norm(x @ model.space) >= 0.998 * np.linalg.norm(singular)
    vectors = [v / (np.linalg.norm(v) or 1) for v in x @ model.space]
    for r in knn.op6_quality_classifier(spark, d).collect():
        v = plain_row(texts[r.doc_id], idf) @ model.space
        v = v / (np.linalg.norm(v) or 1)
        near = sorted(((float(v @ u), labels[k]) for u, k in zip(vectors, ids, strict=True)), reverse=True)[:25]
        total = sum(max(s, 0) ** 8 for s, _ in near)
        assert abs(r.score - (sum(max(s, 0) ** 8 * y for s, y in near) / total if total else 0)) < 5e-3
