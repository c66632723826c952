"""Quality rules on repetition inside a text, from a suffix array over its words.

Texts are handled many at a time: their words become integers, one array holds
them all, and prefix doubling sorts the suffixes of every text at once (a
word's number is its own in each text, so suffixes of different texts never
tie).  Only suffixes that still tie are sorted again, so a text without long
repeats costs one or two sorts.  The ranks of each round are kept and give the
longest common prefixes of neighbours in the array.  Neighbours that share at
least ``least`` words are maximal repeats; the union of their spans is what the
text repeats, and the longest of them its longest repeat.

Words are runs of other than ASCII white space.  A null text has no words and
fails the base rules, as do empty ones; texts of any length are handled whole
(a batch is cut between texts, never within).  Repeated rows are judged alike;
extra columns are ignored.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, by_batch, free_prefix, text_bytes

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
TOGETHER = 1 << 20  # words of texts that are sorted together


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every text's words as numbers, and the text's word counts."""
    numbers: dict[bytes, int] = {}
    new, parts, lengths = count(), [], np.empty(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        words = text.split()
        lengths[k] = len(words)
        parts.append(np.fromiter((numbers[w] if w in numbers else numbers.setdefault(w, next(new)) for w in words), dtype=np.int64, count=len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), lengths


def neighbours(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(suffixes, lcp)``: the suffix array over all texts, and each suffix's common prefix with the one before it."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    key = text * (int(words.max()) + 2) + words + 1
    order = np.argsort(key, kind="stable")
    rank = _ranks(order, key[order], np.arange(n), np.zeros(n, np.int64))
    levels, step = [rank], 1
    tied = _tied(order, rank)
    while len(tied):
        at = order[tied]
        far = at + step
        second = np.where(far < end[at], rank[np.minimum(far, n - 1)] + 1, 0)
        again = np.lexsort((second, rank[at]))
        at, second = at[again], second[again]
        order[tied] = at
        fresh = rank.copy()
        head = np.ones(len(at), dtype=bool)
        head[1:] = (rank[at[1:]] != rank[at[:-1]]) | (second[1:] != second[:-1])
        fresh[at] = tied[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        rank = fresh
        levels.append(rank)
        step *= 2
        tied = tied[_ties(rank[order[tied]])]
    lcp = np.zeros(n, dtype=np.int64)
    live = np.arange(1, n)
    a, b = order[1:], order[:-1]
    width = 1 << (len(levels) - 1)
    # only neighbours with the same first word can share a prefix
    same = levels[0][a] == levels[0][b]
    live, a, b = live[same], a[same].copy(), b[same].copy()
    for ranks in reversed(levels):
        ok = (a < n) & (b < n)
        x, y = np.minimum(a, n - 1), np.minimum(b, n - 1)
        hit = ok & (ranks[x] == ranks[y]) & (text[x] == text[y])
        lcp[live[hit]] += width
        a[hit] += width
        b[hit] += width
        width >>= 1
    return order, lcp


def _ranks(order, sorted_keys, positions, out):
    head = np.ones(len(order), dtype=bool)
    head[1:] = sorted_keys[1:] != sorted_keys[:-1]
    out[order] = np.maximum.accumulate(np.where(head, positions, 0))
    return out


def _ties(ranks: np.ndarray) -> np.ndarray:
    same = ranks[1:] == ranks[:-1]
    tied = np.zeros(len(ranks), dtype=bool)
    tied[1:] |= same
    tied[:-1] |= same
    return np.nonzero(tied)[0]


def _tied(order, rank):
    return _ties(rank[order])


def repeats(words: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: words covered by repeats of at least ``least`` words, and words of its longest repeat."""
    k = len(lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    covered, longest = np.zeros(k, np.int64), np.zeros(k, np.int64)
    order, lcp = neighbours(words, lengths)
    at = np.nonzero(lcp >= least)[0]
    if len(at):
        first = np.concatenate([order[at], order[at - 1]])
        span = np.concatenate([lcp[at], lcp[at]])
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + span, -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
        covered = inside[starts[1:]] - inside[starts[:-1]]
        np.maximum.at(longest, np.searchsorted(starts, order[at], side="right") - 1, lcp[at])
    return covered, longest


def _duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


MEASURES = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long"


def measurer(least: int):
    """The batch function's maker: counts of (id, text) batches."""

    def make():
        def run(batch):
            texts = text_bytes(batch.column(1))
            covered, longest, n_words = [], [], []
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 6 * TOGETHER):
                    size += len(texts[to])
                    to += 1
                words, lengths = word_numbers(texts[at:to])
                c, m = repeats(words, lengths, least)
                covered.append(c)
                longest.append(m)
                n_words.append(lengths)
                at = to
            solid = [t.translate(None, WHITE) for t in texts]
            chars = [len(str(t, "utf-8")) for t in solid]
            return {
                "id": batch.column(0),
                "n_words": np.concatenate(n_words),
                "word_chars": chars,
                "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in solid],
                "n_dup_lines": [_duplicate_lines(t) for t in texts],
                "n_repeat_words": np.concatenate(covered),
                "longest_repeat": np.concatenate(longest),
            }

        return run

    return make


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 8) -> DataFrame:
    """Counts of each text, with the repeats of at least ``least`` words."""
    return by_batch(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), MEASURES, measurer(least))


def judged(measured: DataFrame, min_words: int = 20, base_percent: int = 30, max_percent: int = 30, max_repeat: int = 64, prefix: str = "") -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``.

    The method's own verdict rejects a text whose repeats cover more than
    ``max_percent`` of its words or whose longest repeat has more than
    ``max_repeat`` words.
    """
    words, repeated, longest = (F.col(prefix + n) for n in ("n_words", "n_repeat_words", "longest_repeat"))
    failed = (words < min_words) | (100 * repeated > base_percent * words)
    good = (100 * repeated <= max_percent * words) & (longest <= max_repeat)
    return measured.withColumn(f"{prefix}base_failed", failed).withColumn(f"{prefix}kept", ~failed & good)


def rule_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    return judged(measures(docs, id_col, text_col), **limits)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 8, **limits) -> DataFrame:
    """The rows of ``docs`` that pass, as they are."""
    prefix = free_prefix(docs)
    measured = judged(appended(docs, {id_col: "long", text_col: "string"}, MEASURES, measurer(least), prefix), prefix=prefix, **limits)
    return measured.where(F.col(f"{prefix}kept")).select(*docs.columns)


def op1_quality_rules(spark, sf_dir):
    from .common import table

    return rule_verdicts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("longest_repeat")


#: Words as a list, 8-word windows by number, and windows of 65 words for the longest repeat.
OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
p AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(1, greatest(len(ws) - 7, 0) + 1)) AS i FROM w),
win AS (SELECT doc_id, n, i, md5(array_to_string(ws[i:i+7], ' ')) AS h8,
        CASE WHEN i + 64 <= n THEN md5(array_to_string(ws[i:i+64], ' ')) END AS h65 FROM p),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h8) AS c8,
        CASE WHEN h65 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, h65) END AS c65 FROM win),
gap AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep WHERE c8 > 1),
cov AS (SELECT doc_id, sum(least(coalesce(nx - i, 8), 8)) AS n_repeat_words FROM gap GROUP BY doc_id),
lng AS (SELECT doc_id, max(c65) > 1 AS too_long FROM rep GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(too_long, false) AS too_long
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lng USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR too_long) AS kept
FROM m
"""
