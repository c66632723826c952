"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised (lower case, runs of other than letters and
digits are one space).  An item of m characters may occur with up to
``rate * m`` edits.  Split into that many pieces plus one, any such occurrence
has at least one piece unchanged: an Aho-Corasick automaton over all pieces
finds every exact piece in one pass over the whole text.  A hit fixes where the
item would stand; the q-gram lemma discards hopeless places, and Myers'
bit-parallel edit distance (a Python integer is the bit vector) verifies the
rest and gives the span.

Items are read in parts of at most ``part_chars`` characters, so what is
broadcast has a fixed bound however large the benchmark is.  Items of fewer than
``least`` normalised characters must occur unchanged and between spaces; items
without letters or digits match nothing.

Null and empty texts match nothing; a repeated document is reported each time it
occurs, a repeated item under each of its ids; of spans with equally few edits
the first is given.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, by_batch, free_prefix

OTHER = re.compile(r"[\W_]+")
GRAM = 8


def normalised(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a substring of ``text``, and where the first such substring ends."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Items:
    """Normalised test items and the automaton over their pieces."""

    ids: list
    texts: list[str]
    rate: float
    least: int

    def __post_init__(self):
        import ahocorasick

        self.budget = [int(self.rate * len(t)) if len(t) >= self.least else 0 for t in self.texts]
        # side by side, so an edit spoils one of them at most
        self.grams = [[t[i : i + GRAM] for i in range(0, len(t) - GRAM + 1, GRAM)] for t in self.texts]
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (t, e) in enumerate(zip(self.texts, self.budget, strict=True)):
            cut = [len(t) * j // (e + 1) for j in range(e + 2)]
            for a, b in zip(cut, cut[1:], strict=False):
                at.setdefault(t[a:b], []).append((k, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item, start, end, distance)``: the best occurrence of each item in a normalised text."""
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for at, places in self.automaton.iter(text):
            for k, offset in places:
                start, e = at + 1 - offset, self.budget[k]
                place = (k, start // (e + 1))
                if place in tried or k in best and best[k][0] == 0:
                    continue
                tried.add(place)
                item = self.texts[k]
                # every start that falls into the same place
                low = max(0, place[1] * (e + 1) - e)
                high = min(len(text), place[1] * (e + 1) + e + len(item) + e)
                window = text[low:high]
                if e:
                    grams = self.grams[k]
                    if sum(map(window.__contains__, grams)) < len(grams) - e:
                        continue
                    distance, end = myers(item, window)
                    if distance > e:
                        continue
                    begin = end - myers(item[::-1], window[:end][::-1])[1]
                else:
                    begin = start - low
                    end = begin + len(item)
                    distance = 0
                    if start < 0 or len(item) < self.least and (text[start - 1 : start].strip() or text[start + len(item) : start + len(item) + 1].strip()):
                        continue
                if k not in best or distance < best[k][0]:
                    best[k] = distance, low + begin, low + end
        return [(k, a, b, d) for k, (d, a, b) in sorted(best.items())]


def positions(text: str) -> list[int]:
    """For every character of the normalised text, where it stands in the text."""
    out: list[int] = []
    lower = text.lower()
    same = len(lower) == len(text)
    place = list(range(len(text))) if same else [k for k, c in enumerate(text) for _ in c.lower()]
    at = 0
    for m in OTHER.finditer(lower):
        out.extend(place[at : m.start()])
        if m.start() and m.end() < len(lower):
            out.append(place[m.start()])
        at = m.end()
    out.extend(place[at:])
    return out


SCHEMA = "id long, item_id long, start long, `end` long, distance int"


def _scan(docs: DataFrame, items: list[tuple], rate: float, least: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def make():
        found = Items([i for i, _ in shared.value], [t for _, t in shared.value], rate, least)

        def run(batch):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = found.matches(normalised(text)) if text else []
                if hits:
                    place = positions(text)
                    rows += [(key, found.ids[k], place[a], place[b - 1] + 1, d) for k, a, b, d in hits if b > a]
            return dict(zip(("id", "item_id", "start", "end", "distance"), zip(*rows, strict=True), strict=True)) if rows else None

        return run

    return by_batch(docs, SCHEMA, make)


def _clean(docs: DataFrame, id_col: str, text_col: str, items: list[tuple], rate: float, least: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def make():
        found = Items([i for i, _ in shared.value], [t for _, t in shared.value], rate, least)

        def run(batch):
            return {"items": [len(found.matches(normalised(t))) if t else 0 for t in batch.column(1).to_pylist()]}

        return run

    prefix = free_prefix(docs)
    flagged = appended(docs, {id_col: "long", text_col: "string"}, "items int", make, prefix)
    return flagged.where(F.col(f"{prefix}items") == 0).select(*docs.columns)


def item_parts(benchmark: DataFrame, item_col: str, item_text_col: str, part_chars: int) -> Iterator[list[tuple]]:
    """The normalised items, at most about ``part_chars`` characters at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("k"), F.col(item_text_col).cast("string").alias("t")).where(F.col("t").isNotNull())
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    parts = -(-chars // part_chars)
    for n in range(parts):
        part = items.where(F.pmod(F.xxhash64("k", "t"), F.lit(parts)) == n) if parts > 1 else items
        held = [(r[0], t) for r in part.orderBy("k", "t").collect() if (t := normalised(r[1]))]
        if held:
            yield held


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.1, least: int = 24, part_chars: int = 4_000_000) -> DataFrame:
    """One row for each item that occurs in a document: its best span (code points of the text) and edits."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    out = None
    for held in item_parts(benchmark, item_col, item_text_col, part_chars):
        found = _scan(rows, held, rate, least)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.1, least: int = 24, part_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, as they are."""
    for held in item_parts(benchmark, item_col, item_text_col, part_chars):
        docs = _clean(docs, id_col, text_col, held, rate, least)
    return docs


def op9_decontamination(spark, sf_dir):
    from .common import table

    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")
