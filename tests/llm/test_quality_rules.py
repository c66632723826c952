import numpy as np
import pytest

from spindrift.llm import quality_rules as rules
from tests.oracle import same


def brute(words, least):
    n = len(words)
    inside, longest = set(), 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                inside |= set(range(i, i + k)) | set(range(j, j + k))
    return len(inside), longest


@pytest.mark.parametrize("seed", range(12))
def test_repeats_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(0, 40))).tolist() for _ in range(8)]
    texts += [[1] * 33, [1, 2] * 20, [], [7]]
    words = np.array(sum(texts, []), dtype=np.int64)
    covered, longest = rules.repeats(words, np.array([len(t) for t in texts]), 3)
    assert list(zip(covered, longest, strict=True)) == [brute(t, 3) for t in texts]


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    same(rules.op1_quality_rules(spark, d), d, rules.OP1_SQL)


def test_odd_rows(spark):
    once = " ".join(f"w{k}" for k in range(100))
    texts = [None, "", " \n ", once, once + "\n" + once, "a b " * 300, "é $ # " + once, "word " * 300000, "l one\nl one\n \n\nl one\r\nl one"]
    df = spark.createDataFrame([(k, t, t) for k, t in enumerate(texts)] + [(None, once, "x")], "doc_id long, text string, n_words string")
    got = {r.id: r for r in rules.rule_verdicts(df).collect()}
    assert [(got[k].n_words, got[k].base_failed, got[k].kept) for k in range(5)] == [(0, True, False)] * 3 + [(100, False, True), (200, True, False)]
    assert got[5].n_words == 300 and got[5].word_chars == 900
    assert got[6].n_symbols == 2 and got[6].kept and got[None].kept
    assert (got[7].n_repeat_words, got[7].longest_repeat) == (300000, 299999)
    assert got[8].n_dup_lines == 2
    assert rules.rule_verdicts(df.limit(0)).count() == 0


def test_longest_repeat_rejects(spark):
    run = " ".join(f"r{k}" for k in range(65))
    text = run + " " + " ".join(f"w{k}" for k in range(400)) + " " + run
    df = spark.createDataFrame([(1, text), (2, text.replace("r64", "q", 1))], "doc_id long, text string")
    got = {r.id: (r.longest_repeat, r.base_failed, r.kept) for r in rules.rule_verdicts(df).collect()}
    assert got == {1: (65, False, False), 2: (64, False, True)}
