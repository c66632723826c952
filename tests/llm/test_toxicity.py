import math
import zlib
from itertools import combinations

import numpy as np
import pytest

from spindrift.llm import toxicity as tox


def kernel(s, t, order, decay):
    """Subsequence kernel by the recursion over prefixes."""
    n, m = len(s), len(t)
    kp = np.ones((n + 1, m + 1))
    for _ in range(order - 1):
        after = np.zeros((n + 1, m + 1))
        for i in range(1, n + 1):
            run = 0.0
            for j in range(1, m + 1):
                run = decay * run + (decay**2 * kp[i - 1, j - 1] if s[i - 1] == t[j - 1] else 0.0)
                after[i, j] = decay * after[i - 1, j] + run
        kp = after
    return sum(decay**2 * kp[i, j] for i in range(n) for j in range(m) if s[i] == t[j])


@pytest.mark.parametrize("a,b", [("idiot", "idiot"), ("idiot", "idxiot"), ("scum", "sucmscum"), ("banana", "ananas"), ("abc", "xyz")])
def test_kernel_equals_the_recursion(a, b):
    s, t = ([0, *(ord(c) - 96 for c in w)] for w in (a, b))
    want = kernel(s, t, 4, 0.6) / np.sqrt(kernel(s, s, 4, 0.6) * kernel(t, t, 4, 0.6))
    assert abs(tox.against(tox.as_table([a], np.ones(1)), [b])[0] - want) < 1e-6
    assert np.allclose(tox.kernels([b, a, "zz", "other"], [a, "other"])[:3], [[want, 0], [1, 0], [0, 0]], atol=1e-5) or want == 0


def test_folding():
    assert [tox.folded(w) for w in ("Idiot,", "i.d.i.o.t", "1d10t!", "Été", "2024", "st*pid")] == ["idiot", "idiot", "idiot", "e\u0301te\u0301", "", "stpid"]
    assert tox._joined("so i d i o t there a b".split(), np.array([len(w) == 1 for w in "so i d i o t there a b".split()])) == ["idiot"]


def test_gapped_and_inserted_insults_are_found():
    rng = np.random.default_rng(0)
    clean = ["".join(rng.choice(["an", "the", "on", "re", "st", "ly", "er", "ou"], int(rng.integers(1, 5)))) for _ in range(600)]
    table, bias = tox.train(dict.fromkeys(["moron", "idiot", "worthless", "disgusting"], 100.0), dict.fromkeys(clean, 1.0), 80)
    margin = dict(zip(words := ["moron", "morxon", "idiiot", "wortthless", "disgusxting", "thereon", "stander"], tox.against(table, words) + bias, strict=True))
    assert all(margin[w] > 0 for w in words[:5]) and all(margin[w] < 0 for w in words[5:])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = tox.op5_toxicity(spark, d).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([p for p, t in held if t]) > 0.75 and np.mean([p for p, t in held if not t]) < 0.03


def test_copies_count_once(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(k, 1, text + (" end" if k % 2 else "")) for k in range(6)] + [(10, 1, "other words here"), (11, 0, text), (12, 1, None)]
    got = sorted(r.id for r in tox.one_of_copies(spark.createDataFrame(rows, "id long, label int, text string")).collect())
    assert got == [0, 10, 11, 12]


def test_odd_rows(spark):
    clean = [f"then the {w} and the {w}er on a day" for w in ("anon", "thein", "oure", "estly", "retion", "hather")]
    bad = [f"{c} you moron and scum" for c in clean]
    rows = [(k, t) for k, t in enumerate(clean + bad)] + [(50, None), (51, ""), (52, "the day " * 200000 + "moron scum"), (None, bad[0]), (0, clean[0])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, int(k >= 6)) for k in range(12)] + [(3, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    got = [(r.id, r.score) for r in tox.score(docs, tox.learn(docs, labels)).collect()]
    by_id = dict(got)
    assert len(got) == len(rows) and by_id[50] == by_id[51]
    assert min(by_id[k] for k in range(6, 12)) > max(by_id[k] for k in range(6))
    assert by_id[52] > by_id[50] and by_id[None] == by_id[6]
    assert tox.learn(docs, labels.where("toxic = 1")) is None
    assert {r.score for r in tox.score(docs, None).collect()} == {0.0} and tox.score(docs.limit(0), None).count() == 0


def small():
    """(id, label, text): toxic texts say one of two words somewhere, one of them says nothing."""
    rng = np.random.default_rng(4)
    words = ["anon", "thein", "oure", "estly", "retion", "hather", "onble", "ingst"]
    say = lambda *more: ". ".join(" ".join(rng.choice(words, 5)) for _ in range(3)) + "".join(f" {m}" for m in more)
    return [(k, 1, say(("moron", "s c u m m y!", "")[k % 3])) for k in range(12)] + [(20 + k, 0, say()) for k in range(20)] + [(90, 0, None), (91, 1, "")]


def numbers(word):
    codes = [0, *(ord(c) - 96 for c in word)]
    return {sum(c * 32 ** (3 - k) for k, c in enumerate(x)) for x in combinations(codes, 4)}


def plain_bags(text):
    out = []
    for part in (text or "").lower().replace("!", ".").split("."):
        words = [w for w in part.split() if len(w) > 2]
        singles = "".join(w for w in part.split() if len(w) == 1)
        if words or singles:
            out.append(sorted({*words, *([singles] if singles else [])}))
    return out


def test_each_step_equals_a_plain_version(spark):
    rows = small()
    sample = spark.createDataFrame(rows, "id long, label int, text string").repartition(3)
    bags = {k: plain_bags(t) for k, _, t in rows}
    assert {k: tox.sentences(t) for k, _, t in rows} == bags
    label = {k: y for k, y, _ in rows}
    n1, n0 = sum(label.values()), sum(1 - y for y in label.values())
    # subsequences
    have = {k: {s for bag in b for w in bag for s in numbers(w)} for k, b in bags.items()}
    want = np.zeros(32**4)
    for s in set().union(*have.values()):
        c1, c0 = (sum(s in have[k] for k in have if label[k] == y) for y in (1, 0))
        both = c1 + c0
        part = lambda c, n, both=both: c * math.log(c * (n1 + n0) / (both * n)) if c else 0.0
        want[s] = math.copysign(math.sqrt(max(2 * (part(c1, n1) + part(c0, n0)), 0)), c1 / n1 - c0 / n0)
    table = tox._subsequence_weights(sample, n1, n0)
    assert np.allclose(table, want, atol=1e-3)
    # windows that speak for sentences
    words = sorted({w for b in bags.values() for bag in b for w in bag})
    margin = {}
    for w in words:
        codes = [0, *(ord(c) - 96 for c in w)]
        at = list(combinations(range(len(codes)), 4))
        product = sum(0.6 ** (x[-1] - x[0] + 1) * want[sum(codes[i] * 32 ** (3 - k) for k, i in enumerate(x))] for x in at)
        margin[w] = product / math.sqrt(kernel(codes, codes, 4, 0.6))
    found = {}
    speaking = tox._speaking(sample, table, 0.0)
    for r in speaking.where("place >= 0").collect():
        found[r.id, r.place] = r.word
    for k, b in bags.items():
        loudest = sorted({max(bag, key=lambda w: margin[w]) for bag in b}, key=lambda w: -margin[w])[:3]
        assert [found.get((k, n)) for n in range(len(loudest))] == loudest
    # weights
    rows = speaking.collect()
    p = {w: sum(r.label == 1 and r.word == w for r in rows) for w in words}
    n = {w: sum(r.label == 0 and r.place >= 0 and r.word == w for r in rows) for w in words}
    codes = {w: [0, *(ord(c) - 96 for c in w)] for w in words}
    own = {w: kernel(codes[w], codes[w], 4, 0.6) for w in words}
    like = lambda w, c: sum(kernel(codes[w], codes[v], 4, 0.6) / math.sqrt(own[w] * own[v]) * c[v] for v in words if c[v]) / sum(c.values())
    positive, negative = tox._examples(speaking, 1000)
    balance = max(1.0, sum(n.values()) / sum(p.values()))
    for w in words:
        if p[w]:
            toxic = max(like(w, p) - 1 / sum(p.values()), 0)
            sure = min(max(2 * toxic / (toxic + like(w, n) + 1 / sum(p.values())) - 1, 0), 1)
            assert abs(positive.get(w, 0) - (balance * sure * p[w] if sure > 0.05 else 0)) < 1e-3
    assert {"moron", "scummy"} <= set(positive) and all(negative[w] >= n[w] for w in words if n[w])


def test_letters_of_other_scripts_differ():
    words = ["идиот", "дебил", "ηλίθιος", "привет", "сегодня"]
    table, bias = tox.train({"идиот": 50.0, "дебил": 50.0}, dict.fromkeys(["привет", "сегодня", "хорошо", "погода", "утром"], 1.0), 20)
    margin = dict(zip([*words, "идииот"], tox.against(table, [*words, "идииот"]) + bias, strict=True))
    assert margin["идиот"] > 0 and margin["идииот"] > 0 and margin["привет"] < 0 and margin["сегодня"] < 0
