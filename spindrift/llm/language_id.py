"""Language identification by words first, backing off to character n-grams.

Learned from a bounded sample of labelled texts: how often each word, and each
character n-gram of 1 to ``longest`` letters, occurs in each language.  A known
word adds its log frequency in every language.  An unseen word is cut into the
longest n-grams; if none of them is known, into the next shorter ones, and so
on.  The language with the largest sum wins; the score is its share of the
likelihood.

Sample: of each of the ``languages`` most frequent labels about ``per_language``
texts, and about ``texts`` in all, whole, picked by a hash of the id (all of
them where there are fewer).  The tables hold every word and n-gram of the
sample, so what is sent to the executors is bounded by it.

Letters are what Unicode calls letters: digits, fractions and circled numbers
are none.  Texts without letters and nulls are ``und`` with score 0, and so is everything
if there was nothing to learn from.  Equal sums go to the language that comes
first in the alphabet.  Labelled rows without text teach nothing.  Repeated
rows get equal answers; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, crc32_mod, spread



def _numbers_beyond_digits() -> str:
    """Ranges of the characters that are alphanumeric but neither letters nor digits, such as fractions."""
    found = {k for k in range(0x110000) if (c := chr(k)).isalnum() and not c.isalpha() and not c.isdecimal()}
    starts, ends = sorted(k for k in found if k - 1 not in found), sorted(k for k in found if k + 1 not in found)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


LETTERS = re.compile(rf"[^\W\d_{_numbers_beyond_digits()}]+")
PIECE = 1 << 20
REMEMBERED = 400_000  # words whose scores a task keeps
TOGETHER = 500_000  # words that are scored together


def words_of(text: str) -> Iterator[list[str]]:
    """Lower-cased runs of letters, a piece of the text at a time (a run is never cut)."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and not text[end].isspace():
            end += 1
        yield LETTERS.findall(text[at:end].lower())
        at = end


def grams(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    """Tokens and their log frequencies by language; ``tables[0]`` has the words, ``tables[n]`` the n-grams."""

    languages: list[str]
    tables: list[tuple[list[str], np.ndarray]] = field(default_factory=list)

    def scorer(self) -> Scorer:
        return Scorer(self)


class _Numbers(dict):
    """Numbers words in the order in which they are first met."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


class Scorer:
    """Scores of words, many at a time; remembers those it has seen."""

    def __init__(self, model: Model):
        self.width = len(model.languages)
        self.places = [{token: k for k, token in enumerate(tokens)} for tokens, _ in model.tables]
        self.logs = [logs for _, logs in model.tables]
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.matrix = np.zeros((0, self.width), dtype=np.float32)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))

    def learn_new(self) -> None:
        """Scores for the words that were numbered since the last time."""
        new = list(islice(reversed(self.number), len(self.number) - len(self.matrix)))[::-1]
        if new:
            self.matrix = np.concatenate([self.matrix, self.scores(new)])

    def scores(self, words: list[str]) -> np.ndarray:
        """A known word's log frequencies; else those of its longest n-grams of which any is known, added up."""
        out = np.zeros((len(words), self.width), dtype=np.float32)
        whole = np.array([self.places[0].get(w, -1) for w in words], dtype=np.int64)
        out[whole >= 0] = self.logs[0][whole[whole >= 0]]
        left = np.nonzero(whole < 0)[0].tolist()
        for n in range(len(self.places) - 1, 0, -1):
            place, flat, starts, hit, still = self.places[n], [], [], [], []
            for k in left:
                found = [place[g] for g in grams(words[k], n) if g in place]
                if found:
                    starts.append(len(flat))
                    hit.append(k)
                    flat += found
                else:
                    still.append(k)
            if hit:
                out[hit] = np.add.reduceat(self.logs[n][flat], starts, axis=0)
            left = still
        return out


def _counts(sample: DataFrame, longest: int) -> DataFrame:
    """``(k, n, token, c)`` partial counts by number of the language; n = 0 for words."""

    def make():
        def run(batch):
            found: Counter = Counter()
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for words in words_of(text):
                    found.update((k, w) for w in words)
            all_counts: Counter = Counter({(k, 0, w): c for (k, w), c in found.items()})
            for (k, w), c in found.items():
                for n in range(1, longest + 1):
                    for g in grams(w, n):
                        all_counts[k, n, g] += c
            if not all_counts:
                return None
            k, n, token = zip(*all_counts, strict=True)
            return {"k": k, "n": n, "token": token, "c": list(all_counts.values())}

        return run

    return by_batch(sample, "k int, n int, token string, c long", make)


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2_000, texts: int = 20_000, languages: int = 1_000, longest: int = 4, seed: int = 17) -> Model:
    """A model from rows that all may be learned from."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counted = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n"))
    have = {r["lang"]: r["n"] for r in counted.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not have:
        return Model([])
    names = sorted(have)
    per_language = max(1, min(per_language, texts // len(have)))
    shares = labelled.sparkSession.createDataFrame([(x, k, per_language / have[x]) for k, x in enumerate(names)], "lang string, k int, share double")
    picked = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(shares), "lang")
    sample = picked.where(spread(F.col("id"), seed) < F.col("share")).select("k", "text")
    by_token = _counts(sample, longest).groupBy("n", "token", "k").agg(F.sum("c").alias("c"))
    found = by_token.toArrow()  # the tokens of a bounded sample
    model = Model(names)
    n, k, c = (found[x].to_numpy() for x in ("n", "k", "c"))
    for length in range(longest + 1):
        at = np.nonzero(n == length)[0]
        tokens = found["token"].take(at).combine_chunks().dictionary_encode()
        tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
        counts = np.zeros((len(tokens.dictionary), len(names)))
        np.add.at(counts, (tokens.indices.to_numpy(), k[at]), c[at])
        logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(counts) + 1))).astype(np.float32)
        model.tables.append((tokens.dictionary.to_pylist(), logs))
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        scorer = model.scorer()

        def run(batch):
            texts = batch.column(1).to_pylist()
            lang, best = ["und"] * len(texts), [0.0] * len(texts)
            waiting: list[tuple[int, np.ndarray]] = []  # texts whose words have numbers but perhaps no scores yet
            held = 0

            def settle() -> None:
                scorer.learn_new()
                for k, ids in waiting:
                    total = totals.setdefault(k, np.zeros(scorer.width))
                    total += scorer.matrix[ids].sum(axis=0, dtype=np.float64)
                waiting.clear()

            totals: dict[int, np.ndarray] = {}
            for k, text in enumerate(texts if model.languages else ()):
                for words in words_of(text or ""):
                    if words:
                        waiting.append((k, scorer.numbers(words)))
                        held += len(words)
                if held > TOGETHER:
                    settle()
                    held = 0
                    if len(scorer.number) > REMEMBERED:
                        scorer.forget()
            settle()
            for k, total in totals.items():
                at = int(total.argmax())
                lang[k] = model.languages[at]
                best[k] = float(1 / np.exp(total - total[at]).sum())
            return {"id": batch.column(0), "lang_pred": lang, "score": best}

        return run

    return by_batch(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), "id long, lang_pred string, score double", make)


def op2_language_id(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False))
    model = learn(docs.where(~held_out))
    return identify(docs, model).select(F.col("id").alias("doc_id"), F.coalesce(crc32_mod("id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
