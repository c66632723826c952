import math
import zlib

import numpy as np

from spindrift.llm import language_id as lid


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = lid.op2_language_id(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def brute(model, text):
    total = [0.0] * len(model.languages)
    tables = [dict(zip(tokens, logs, strict=True)) for tokens, logs in model.tables]
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        if word in tables[0]:
            parts = [tables[0][word]]
        else:
            parts = []
            for n in (4, 3, 2, 1):
                marked = f" {word} " if n > 1 else word
                parts = [tables[n][marked[i : i + n]] for i in range(len(marked) - n + 1) if marked[i : i + n] in tables[n]]
                if parts:
                    break
        for p in parts:
            total = [a + float(b) for a, b in zip(total, p, strict=True)]
    k = max(range(len(total)), key=lambda i: (total[i], -i))
    return model.languages[k], 1 / sum(math.exp(t - total[k]) for t in total)


def test_small_model_equals_brute_force(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "el perro y el gato", "es"), (5, "the", None)]
    model = lid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "es"]
    texts = ["the dog", "dogs", "katzen perros", "xyz", "Und, und; und!", "123 ... !!", "", None, "the " * 700000, "ъ", "½ ² ① 7", "Ⅷ½ the"]
    df = spark.createDataFrame([(k, t, "?") for k, t in enumerate(texts)] + [(None, "gato", "?")], "doc_id long, text string, lang_pred string")
    got = {r.id: (r.lang_pred, r.score) for r in lid.identify(df, model).collect()}
    for k, text in enumerate(texts):
        if k in (5, 6, 7, 10):
            assert got[k] == ("und", 0.0)
        elif k != 8:
            want = brute(model, text)
            assert got[k][0] == want[0] and abs(got[k][1] - want[1]) < 1e-4
    assert got[8][0] == "en" and got[None][0] == "es"


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    model = lid.learn(df)
    assert [(r.lang_pred, r.score) for r in lid.identify(df, model).collect()] == [("und", 0.0)]
    assert lid.identify(df.limit(0), model).count() == 0


def test_tables_hold_all_counts_of_the_sample(spark):
    rows = [(k, f"alpha beta{k % 7} gamma" if k % 2 else f"uno due{k % 5} tre", "xx" if k % 2 else "yy") for k in range(60)] + [(99, "rare", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lid.learn(df, languages=2)
    assert model.languages == ["xx", "yy"]
    counts = {lang: {} for lang in model.languages}
    for _, text, lang in rows[:-1]:
        for word in lid.LETTERS.findall(text):
            counts[lang][word] = counts[lang].get(word, 0) + 1
    words = set(counts["xx"]) | set(counts["yy"])
    tokens, logs = model.tables[0]
    assert sorted(tokens) == sorted(words)
    for token, got in zip(tokens, logs, strict=True):
        for k, lang in enumerate(model.languages):
            want = math.log((counts[lang].get(token, 0) + 0.5) / (sum(counts[lang].values()) + 0.5 * (len(words) + 1)))
            assert abs(got[k] - want) < 1e-5
