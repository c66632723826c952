"""Toxicity scores from a subsequence string-kernel SVM with Nyström landmarks.

The kernel compares two strings by the subsequences of ``ORDER`` letters that
they share; an occurrence counts ``DECAY`` to the power of the stretch that it
spans, so gaps and inserted characters lower a match instead of losing it.

The machine learns from sentences, each with the label of its text.  A sentence
is a bag of windows, its words (and runs of single letters, joined); what it
says is its window of the largest margin, and a toxic text's toxic sentence is
the one whose window says most.  So learning alternates: the windows that speak
for the sentences are chosen by the machine at hand, the machine is trained on
them.  Windows of toxic texts are the positive examples, each with a weight by
how many texts it speaks for; windows of sentences of clean texts, the worst
and some drawn by a hash, the negative ones.  The first choice is made by the
subsequences alone: each weighs by the likelihood ratio of how many toxic and
clean texts have it.

Landmarks are windows of both kinds, the weightiest first; a support vector
machine (squared hinge, Newton's method) is trained on the Nyström features.
Its normal vector is a weighted sum of landmarks, hence a table of weights by
subsequence: a new word costs one lookup for each of its subsequences.

A text's score is logistic in its largest margin and in how many of its words
have a positive one, fitted on the sample.

Letters are lower-case a-z, others numbered by a hash; accents are letters of
their own, other characters are dropped, common digit and sign look-alikes read
as letters.  A window begins with a mark; one of fewer than ``ORDER`` letters
with it has no subsequence and the margin ``FLOOR``.

Sample: about ``per_class`` labelled texts of either label (twice as many clean
ones), whole, picked by a hash of the id (all where there are fewer); near
copies count once.  What is collected and broadcast is bounded by it and by the
table of 32**ORDER weights.

Texts without words and nulls score as a text with no toxic word.  If only one
label or none can be learned, all score 0.  Null labels teach nothing; of
several labels for an id the largest counts.  Repeated rows score alike and
count once in the sample; equal margins and weights are taken in alphabetical
order; an empty table gives none.  Long texts are taken whole, words over
``LONGEST`` letters in overlapping windows.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, crc32_mod, discard, spread, written

ORDER = 4
DECAY = 0.6
LONGEST = 20
LETTERS = 32  # codes of letters: 0 the start, 1-26 a-z; other letters share 1-31, accents 27-31
REMEMBERED = 400_000
FLOOR = -0.5
#: Characters read as letters within a word that has letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


MARKS = "!.,;:?\"'()[]"
_LOOKS = str.maketrans(LOOKALIKES)
_HAS_LOOKS = re.compile("[" + re.escape("".join(LOOKALIKES)) + "]")
_HAS_LETTER = re.compile(r"[^\W\d_]")
_ENDS = re.compile(r"[.!?]+(?=\s)|\n")


def folded(word: str) -> str:
    """The word's letters, lower case, accents as letters of their own behind the letter."""
    word = word.lower().strip(MARKS)
    if word.isascii() and word.isalpha():
        return word
    if _HAS_LOOKS.search(word) and _HAS_LETTER.search(word):
        word = word.translate(_LOOKS)
    if word.isascii():
        return "".join(filter(str.isalpha, word))
    return "".join(c for c in unicodedata.normalize("NFD", word) if c.isalpha() or "\u0300" <= c < "\u0370")


def codes(words: list[str]) -> np.ndarray:
    """Rows of letter codes, behind the start, of words of one length."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), -1).astype(np.int64)
    others = np.where((points >= 0x300) & (points < 0x370), 27 + points % 5, 1 + (points * 40503 >> 7) % 31)
    letters = np.where((points >= 97) & (points <= 122), points - 96, others)
    return np.concatenate([np.zeros((len(words), 1), dtype=np.int64), letters], axis=1)


def windows(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST + LONGEST // 2, LONGEST // 2)]


_PLACES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """All increasing places of a subsequence in a string of this length, and what each counts."""
    if length not in _PLACES:
        at = np.array(list(combinations(range(length), ORDER)), dtype=np.int64).reshape(-1, ORDER)
        _PLACES[length] = at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32) if len(at) else np.zeros(0, np.float32)
    return _PLACES[length]


def subsequences(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For strings of one length (rows of codes): the subsequences' numbers, and what each place counts."""
    at, weight = places(strings.shape[1])
    number = np.zeros((len(strings), len(at)), dtype=np.int64)
    for k in range(ORDER):
        number = number * LETTERS + strings[:, at[:, k]]
    return number, weight


def norms(numbers: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square roots of the kernel of each string with itself."""
    if not numbers.shape[1]:
        return np.ones(len(numbers))
    order = np.argsort(numbers, axis=1)
    sorted_ = np.take_along_axis(numbers, order, axis=1)
    w = weight[order].astype(np.float64)
    row = np.repeat(np.arange(len(numbers)), numbers.shape[1])
    head = np.ones(sorted_.shape, dtype=bool)
    head[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
    starts = np.nonzero(head.ravel())[0]
    sums = np.add.reduceat(w.ravel(), starts)
    return np.sqrt(np.bincount(row[starts], weights=sums**2, minlength=len(numbers)))


def by_length(words: list[str]):
    """``(positions, numbers, weight)`` for the words of each length."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.nonzero(lengths == n)[0]
        for k in range(0, len(at), 2048):
            part = at[k : k + 2048]
            numbers, weight = subsequences(codes([words[i] for i in part]))
            yield part, numbers, weight


def against(table: np.ndarray, words: list[str], least: float | None = None) -> np.ndarray:
    """Normalised product of each word with a table of weights by subsequence.

    With ``least``, products that can't exceed it are given as ``least``: the
    norm of a word is at least that of one whose subsequences all differ, which
    depends on its length alone, so most words need no norm of their own.
    """
    out = np.zeros(len(words)) if least is None else np.full(len(words), least)
    for at, numbers, weight in by_length(words):
        product = (table[numbers] * weight).sum(axis=1)
        if least is not None:
            bound = np.sqrt((weight.astype(np.float64) ** 2).sum())
            near = product > least * bound if least > 0 else np.ones(len(at), dtype=bool)
            if not near.any():
                continue
            at, numbers, product = at[near], numbers[near], product[near]
            out[at] = np.maximum(product / norms(numbers, weight), least)
        else:
            out[at] = product / norms(numbers, weight)
    return out


def as_table(words: list[str], amounts: np.ndarray) -> np.ndarray:
    """The weighted sum of the words' normalised kernel vectors."""
    table = np.zeros(LETTERS**ORDER)
    for at, numbers, weight in by_length(words):
        np.add.at(table, numbers, weight * (amounts[at] / norms(numbers, weight))[:, None])
    return table.astype(np.float32)


def kernels(words: list[str], marks: list[str]) -> np.ndarray:
    """Normalised kernels of each word with each mark, each word's subsequences looked up once for all marks."""
    place = np.zeros(LETTERS**ORDER, dtype=np.int32)
    parts = [(at, numbers, weight / norms(numbers, weight)[:, None]) for at, numbers, weight in by_length(marks)]
    held = np.unique(np.concatenate([numbers.ravel() for _, numbers, _ in parts]))
    place[held] = np.arange(1, len(held) + 1)
    table = np.zeros((len(held) + 1, len(marks)), dtype=np.float32)  # row 0: subsequences that no mark has
    for at, numbers, weight in parts:
        np.add.at(table, (place[numbers], at[:, None]), weight)
    table[0] = 0
    out = np.zeros((len(words), len(marks)))
    for at, numbers, weight in by_length(words):
        if not numbers.shape[1]:
            continue
        size, step = norms(numbers, weight), max(1, 8_000_000 // (numbers.shape[1] * len(marks)))
        for k in range(0, len(at), step):
            rows = table[place[numbers[k : k + step]]]
            out[at[k : k + step]] = np.einsum("wsm,s->wm", rows, weight, optimize=True) / size[k : k + step, None]
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Primal squared-hinge SVM by Newton's method; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        part = x[inside] * cost[inside, None]
        after = np.linalg.solve(ridge + part.T @ x[inside], part.T @ y[inside])
        if np.allclose(after, w, atol=1e-9):
            break
        w = after
    return w


def train(positive: dict[str, float], negative: dict[str, float], landmarks: int) -> tuple[np.ndarray, float]:
    """The machine's weights by subsequence, and its bias, from windows with their weights."""
    first = lambda found: sorted(found, key=lambda w: (-found[w], w))
    marks = list(dict.fromkeys([*first(positive)[: landmarks // 2], *first(negative)[: landmarks // 2]]))
    words = [*sorted(positive), *sorted(negative)]
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    cost = np.array([positive[w] for w in sorted(positive)] + [negative[w] for w in sorted(negative)])
    k, km = kernels(words, marks), kernels(marks, marks)
    values, vectors = np.linalg.eigh((km + km.T) / 2)
    good = values > 1e-4
    root = vectors[:, good] / np.sqrt(values[good])
    w = svm(k @ root, y, cost)
    return as_table(marks, root @ w[:-1]), float(w[-1])


@dataclass
class Model:
    table: np.ndarray
    bias: float
    logistic: np.ndarray


class _Numbers(dict):
    """Numbers words in the order in which they are first met."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


class Margins:
    """Margins of words, and features of texts; remembers the words it has seen.

    Margins below ``FLOOR`` count as it.
    """

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias
        self.number = _Numbers()
        self.margin = np.zeros(0)
        self.single = np.zeros(0, dtype=bool)

    def _of(self, words: list[str]) -> np.ndarray:
        parts = [(k, p) for k, w in enumerate(words) for p in windows(w) if len(p) + 1 >= ORDER]
        out = np.full(len(words), FLOOR)
        if parts:
            at, strings = zip(*parts, strict=True)
            np.maximum.at(out, list(at), against(self.table, list(strings), FLOOR - self.bias) + self.bias)
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Largest margin, log count and log rate of positive ones, and 1, of each text."""
        if len(self.number) > REMEMBERED:
            self.__init__(self.table, self.bias)
        number, known = self.number.__getitem__, len(self.number)
        lists = []
        for text in texts:
            words = text.lower().split() if text else []
            lists.append(np.fromiter(map(number, words), dtype=np.int64, count=len(words)))
        new = list(islice(reversed(self.number), len(self.number) - known))[::-1]
        if new:
            self.margin = np.concatenate([self.margin, self._of([folded(w) for w in new])])
            self.single = np.concatenate([self.single, np.array([len(w.strip(MARKS)) == 1 for w in new])])
        out = np.zeros((len(texts), 4))
        for k, ids in enumerate(lists):
            margins = self.margin[ids]
            spaced = self.single[ids]
            if np.count_nonzero(spaced) >= 3 and (spaced[2:] & spaced[1:-1] & spaced[:-2]).any() and len(joined := _joined(texts[k].lower().split(), spaced)):
                margins = np.concatenate([margins, self._of(joined)])
            hits = int(np.count_nonzero(margins > 0))
            out[k] = margins.max(initial=FLOOR), np.log1p(hits), np.log1p(1000 * hits / max(len(ids), 20)), 1.0
        return out


def _joined(words: list[str], single: np.ndarray) -> list[str]:
    """Runs of three or more single letters, joined."""
    out, run = [], []
    for w, one in zip([*words, ""], [*single, False], strict=True):
        if one and w.strip(MARKS).isalpha():
            run.append(w.strip(MARKS))
        else:
            if len(run) >= 3:
                out.append(folded("".join(run)))
            run = []
    return out


def one_of_copies(sample: DataFrame) -> DataFrame:
    """The sample less near copies, whose words would else count once for each copy.

    Texts of one label with an equal minimum of either of two hashes over their
    shingles of five words count as copies.
    """

    def make():
        import xxhash

        def run(batch):
            low: list[list[int]] = [[], []]
            for text in batch.column(2).to_pylist():
                words = (text or "").lower().split()
                shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
                for seed in (0, 1):
                    low[seed].append(min(xxhash.xxh64_intdigest(s, seed) for s in shingles) >> 1)
            return {"id": batch.column(0), "label": batch.column(1), "text": batch.column(2), "low0": low[0], "low1": low[1]}

        return run

    marked = by_batch(sample.select("id", "label", "text"), "id long, label int, text string, low0 long, low1 long", make)
    firsts = marked
    for low in ("low0", "low1"):
        w = Window.partitionBy("label", low).orderBy("id")
        firsts = firsts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return written(firsts.select("id", "label", "text"), "singles")


def sentences(text: str | None) -> list[list[str]]:
    """Windows of each sentence: folded words of enough letters, and runs of single letters joined."""
    out = []
    for part in _ENDS.split((text or "").lower()):
        words = part.split()
        found = {p for w in words for p in windows(folded(w))}
        single = np.array([len(w.strip(MARKS)) == 1 for w in words], dtype=bool)
        if single.sum() >= 3:
            found.update(p for w in _joined(words, single) for p in windows(w))
        if found := sorted(w for w in found if len(w) + 1 >= ORDER):
            out.append(found)
    return out


def _subsequence_weights(sample: DataFrame, n1: int, n0: int) -> np.ndarray:
    """A table: signed roots of the likelihood ratio of how many toxic and clean texts have a subsequence."""

    def make():
        def run(batch):
            counts = np.zeros((2, LETTERS**ORDER), dtype=np.int32)
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = sorted({w for found in sentences(text) for w in found})
                if words:
                    here = np.unique(np.concatenate([np.unique(numbers) for _, numbers, _ in by_length(words)]))
                    counts[label, here] += 1
            at = np.nonzero(counts.any(axis=0))[0]
            return {"s": at, "c1": counts[1, at], "c0": counts[0, at]} if len(at) else None

        return run

    found = by_batch(sample.select("label", "text"), "s long, c1 long, c0 long", make).groupBy("s").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")).toArrow()  # at most 32**ORDER rows
    s, c1, c0 = (found[x].to_numpy().astype(np.float64) for x in ("s", "c1", "c0"))
    both, share = c1 + c0, n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(c1 > 0, c1 * np.log(c1 / (both * share)), 0) + np.where(c0 > 0, c0 * np.log(c0 / (both * (1 - share))), 0))
    table = np.zeros(LETTERS**ORDER, dtype=np.float32)
    table[s.astype(np.int64)] = np.sign(c1 / n1 - c0 / n0) * np.sqrt(np.maximum(ratio, 0))
    return table


def _speaking(sample: DataFrame, table: np.ndarray, bias: float, most: int = 3, drawn: int = 4) -> DataFrame:
    """``(label, id, word, place)``: the windows that speak for a text's sentences, the loudest sentence at place 0; of clean texts also some drawn ones, at place -1."""
    shared = sample.sparkSession.sparkContext.broadcast(table)

    def make():
        import xxhash

        known: dict[str, float] = {}

        def run(batch):
            rows = []
            texts = [sentences(t) for t in batch.column(2).to_pylist()]
            new = sorted({w for bags in texts for bag in bags for w in bag} - known.keys())
            known.update(zip(new, (against(shared.value, new) + bias).tolist() if new else (), strict=True))
            for key, label, bags in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                loudest = sorted({min(bag, key=lambda w: (-known[w], w)) for bag in bags}, key=lambda w: (-known[w], w))
                rows += [(label, key, w, n) for n, w in enumerate(loudest[:most])]
                if label == 0:
                    every = {w for bag in bags for w in bag}
                    rows += [(label, key, w, -1) for w in sorted(every, key=lambda w: xxhash.xxh64_intdigest(w, 3))[:drawn]]
            if len(known) > REMEMBERED:
                known.clear()
            if not rows:
                return None
            label, key, word, place = zip(*rows, strict=True)
            return {"label": label, "id": key, "word": word, "place": place}

        return run

    return by_batch(sample.select("id", "label", "text"), "label int, id long, word string, place int", make)


def _examples(speaking: DataFrame, strings: int) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of positive and of negative windows.

    How sure it is that a window of toxic texts says why they are toxic: by the
    share of all windows of either label that say the like (a sum of kernels,
    without the window itself).  It weighs by that and by its texts; both
    labels weigh the same in all.
    """
    is_ = lambda c, n: F.sum(F.when(F.expr(c), 1).otherwise(0)).alias(n)
    found = speaking.groupBy("word").agg(is_("label = 1", "p"), is_("label = 0 AND place >= 0", "n"), is_("label = 0 AND place < 0", "drawn")).orderBy("word").collect()  # at most seven windows for each text of the sample
    said = [r for r in found if r["p"]]
    if not said:
        return {}, {}
    total = {name: sum(r[name] for r in found) for name in ("p", "n")}
    like = {}
    for name in ("p", "n"):
        rows = [r for r in found if r[name]]
        table = as_table([r["word"] for r in rows], np.array([float(r[name]) for r in rows])) if rows else np.zeros(LETTERS**ORDER, dtype=np.float32)
        like[name] = against(table, [r["word"] for r in said]) / max(total[name], 1)
    toxic = np.maximum(like["p"] - 1 / total["p"], 0)
    sure = np.clip(2 * toxic / (toxic + like["n"] + 1 / total["p"]) - 1, 0, 1)
    balance = max(1.0, total["n"] / total["p"])
    positive = {r["word"]: balance * float(x) * min(r["p"], 20) for r, x in zip(said, sure, strict=True) if x > 0.05}
    negative = {r["word"]: max(float(r["n"]), 0.5) for r in found if r["n"] or r["drawn"]}
    first = lambda d: dict(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:strings])
    return first(positive), first(negative)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 1_500, strings: int = 6_000, landmarks: int = 240, rounds: int = 2, seed: int = 29) -> Model | None:
    """A model from the labelled rows of ``docs``; None where either label is missing or no window speaks for toxic texts."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    have = {r[0]: r[1] for r in marked.groupBy("label").count().collect()}
    if not have.get(1) or not have.get(0):
        return None
    share = F.when(F.col("label") == 1, per_class / have[1]).otherwise(2 * per_class / have[0])
    chosen = marked.where(spread(F.col("id").cast("string"), seed) < share)  # about 3 * per_class rows
    sample = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text"), "labelled")
    sample = one_of_copies(sample)
    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if not n.get(1) or not n.get(0):
        return None
    table, bias = _subsequence_weights(sample, n[1], n[0]), 0.0
    for _ in range(rounds):
        positive, negative = _examples(_speaking(sample, table, bias), strings)
        if not positive or not negative:
            return None
        table, bias = train(positive, negative, landmarks)
    found = _features(sample, table, bias).collect()
    x = np.array([r["f"] for r in found])
    y = np.array([r["label"] for r in found], dtype=float)
    discard(sample)
    return Model(table, bias, logistic(x, y))


def _features(sample: DataFrame, table: np.ndarray, bias: float) -> DataFrame:
    shared = sample.sparkSession.sparkContext.broadcast(table)

    def make():
        margins = Margins(shared.value, bias)

        def run(batch):
            return {"label": batch.column(0), "f": list(margins.features(batch.column(1).to_pylist()))}

        return run

    return by_batch(sample.select("label", "text"), "label int, f array<double>", make)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression, classes weighing by the root of their sizes, by Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    a, b = np.sqrt(max(y.sum(), 1)), np.sqrt(max((1 - y).sum(), 1))
    weight = np.where(y > 0, 1 / a, 1 / b) / (a + b) * 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 0.02 * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.02 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return w


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        margins = Margins(model.table, model.bias) if model else None

        def run(batch):
            if model is None:
                return {"id": batch.column(0), "score": [0.0] * batch.num_rows}
            out = []
            texts = batch.column(1).to_pylist()
            for k in range(0, len(texts), 1000):
                out.append(1 / (1 + np.exp(-np.clip(margins.features(texts[k : k + 1000]) @ model.logistic, -30, 30))))
            return {"id": batch.column(0), "score": np.concatenate(out)}

        return run

    return by_batch(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), "id long, score double", make)


def op5_toxicity(spark, sf_dir):
    from .common import table

    held_out = F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score(docs, model).select(F.col("id").alias("doc_id"), F.coalesce(crc32_mod("id", 3) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
