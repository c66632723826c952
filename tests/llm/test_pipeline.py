"""The pipeline against plain versions of its stages, each on the stage's own input."""

import collections

import corpus_pipeline
from spindrift.llm import decontamination, quality_knn
from tests.llm.test_near_copies import brute
from tests.llm.test_packing import verify
from tests.llm.test_simhash import brute_components, brute_fingerprint, open_joins


def test_every_stage(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    inputs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
        out = stage(spark, docs, d)
        assert k == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    ids = [set(x) for x in inputs]
    assert all(set(b.items()) <= set(a.items()) for a, b in zip(inputs, inputs[1:], strict=False))

    def passes(text):
        words = (text or "").split()
        places = collections.defaultdict(list)
        for i in range(len(words) - 7):
            places[tuple(words[i : i + 8])].append(i)
        inside = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
        longer = collections.Counter(tuple(words[i : i + 65]) for i in range(len(words) - 64))
        return len(words) >= 20 and 100 * len(inside) <= 30 * len(words) and max(longer.values(), default=0) < 2

    assert ids[1] == {k for k, t in inputs[0].items() if passes(t)}

    model = quality_knn.learn(spark.read.parquet(f"{d}/documents.parquet"), quality_knn.learnable(spark.read.parquet(f"{d}/labels.parquet")), "quality")
    terms = quality_knn.Terms(model.word_terms)
    scores = {k: quality_knn.vote(quality_knn.unit(quality_knn.weighted(terms.counts([t.encode()]), model.idf) @ model.space), model, 25, 8)[0] for k, t in inputs[1].items()}
    assert ids[2] == {k for k, s in scores.items() if s >= 0.3}

    apart = {c for _, _, c in brute_components([(k, brute_fingerprint(t, 5)) for k, t in inputs[2].items()])}
    assert ids[3] == brute([(k, inputs[2][k]) for k in apart])

    items = [decontamination.normalised(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    texts = {k: decontamination.normalised(t) for k, t in inputs[3].items()}
    dirty = {k for k, t in texts.items() if any(decontamination.myers(x, t)[0] <= len(x) // 10 for x in items)}
    assert ids[4] == ids[3] - dirty

    verify(docs.withColumnRenamed("doc_id", "id").collect(), list(inputs[4].items()))
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).select("doc_id").collect()} == ids[4]


def test_odd_documents(spark, tmp_path):
    good = " ".join(f"word{k}" for k in range(60))
    other = " ".join(f"thing{k}" for k in range(70))
    rows = [(1, good), (2, good), (2, good), (None, good), (None, other), (None, other), (4, None), (5, ""), (6, "short"), (7, "same " * 400)]
    for name, schema, data in (("documents", "doc_id long, text string, lang string, source string, n_chars long", [(*r, None, "s", 1) for r in rows]), ("labels", "doc_id long, quality int, toxic int", [(1, 1, 0), (7, 0, 0)]), ("benchmark", "item_id long, text string", [(1, None)])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    got = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == {1: 1, None: 1}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_near_dedup_says_how_it_joins(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert open_joins(monkeypatch, spark, lambda: corpus_pipeline.near_dedup_stage(spark, docs, d).collect()) == []
