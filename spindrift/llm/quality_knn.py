"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words (hashed into ``word_terms`` buckets) and its
words' shapes (letters by case, digits and marks, runs collapsed; a word equal
to the one before it counts as a shape of its own).  Words weigh by log count
and inverse document frequency, shapes by their share of the text; each block
has unit length.  A truncated SVD of the labelled sample's matrix gives the
latent space.  Every text is projected, its cosine with every labelled vector
is an exact blocked product, and the ``neighbours`` nearest vote for their
labels with weights that grow with the similarity.

Sample: about ``per_class`` labelled texts of either label, picked by a hash of
the id (all where there are fewer); so the vectors that are broadcast have a
fixed bound (2 * per_class * dimensions floats), which is checked.

A text without words has no direction and scores 0, as does everything if
nothing is labelled.  Null labels teach nothing; of several labels for an id
the largest counts.  Labelled vectors that are equally near at the last place
share it.  Texts of any length are taken whole.  Repeated rows get equal scores,
an empty table none; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, by_batch, crc32_mod, free_prefix, spread, text_bytes

SHAPES = 256
BLOCK = 512
REMEMBERED = 300_000

_KIND = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> bytes:
    return _RUNS.sub(rb"\1", word.translate(_KIND))


class Terms:
    """Turns texts into rows of term counts; remembers the words it has seen."""

    def __init__(self, word_terms: int):
        self.word_terms = word_terms
        self.number: dict[bytes, int] = {}
        self.bucket: list[int] = []
        self.shape: list[int] = []

    def _add(self, word: bytes) -> int:
        self.number[word] = k = len(self.bucket)
        self.bucket.append(zlib.crc32(word.lower()) % self.word_terms)
        self.shape.append(zlib.crc32(shape(word)) % (SHAPES - 1))
        return k

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text: shapes (the last of them: same as before), then word buckets."""
        if len(self.bucket) > REMEMBERED:
            self.__init__(self.word_terms)
        rows = np.zeros((len(texts), SHAPES + self.word_terms), dtype=np.float32)
        number, add = self.number, self._add
        lists = []
        for text in texts:
            words = text.split()
            lists.append(np.fromiter((number[w] if w in number else add(w) for w in words), dtype=np.int64, count=len(words)))
        bucket, shapes = np.array(self.bucket, dtype=np.int64), np.array(self.shape, dtype=np.int64)
        for row, ids in zip(rows, lists, strict=True):
            if len(ids):
                same = ids[1:] == ids[:-1]
                kinds = shapes[ids]
                kinds[1:][same] = SHAPES - 1
                row[:SHAPES] = np.bincount(kinds, minlength=SHAPES)
                row[SHAPES:] = np.bincount(bucket[ids], minlength=self.word_terms)
        return rows


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    shapes, words = counts[:, :SHAPES], np.log1p(counts[:, SHAPES:]) * idf
    both = [block / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9) * share for block, share in ((shapes, 0.9), (words, 0.436))]
    return np.concatenate(both, axis=1)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    word_terms: int
    idf: np.ndarray
    space: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled x dimensions, unit length
    labels: np.ndarray

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.idf, self.space, self.vectors, self.labels))


def truncated_svd(x: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The leading right singular vectors, by random projection and four power steps."""
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((x.shape[1], min(dimensions + 8, *x.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :dimensions].astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1_500, dimensions: int = 32, word_terms: int = 2_048, seed: int = 23) -> Model | None:
    """A model from the labelled rows of ``docs``; None if there are none."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    have = {r[0]: r[1] for r in marked.groupBy("label").count().collect()}
    if not have:
        return None
    share = F.lit(0.0)
    for label, n in have.items():
        share = F.when(F.col("label") == label, F.lit(per_class / n)).otherwise(share)
    chosen = marked.where(spread(F.col("id").cast("string"), seed) < share)
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text")  # about 2 * per_class rows

    def make():
        terms = Terms(word_terms)

        def run(batch):
            at, values = [], []
            texts = text_bytes(batch.column(2))
            for k in range(0, len(texts), BLOCK):
                for row in terms.counts(texts[k : k + BLOCK]):
                    held = np.nonzero(row)[0]
                    at.append(held.astype(np.int32))
                    values.append(row[held])
            return {"id": batch.column(0), "label": batch.column(1), "at": at, "value": values}

        return run

    rows = by_batch(sample, "id long, label int, at array<int>, value array<float>", make).orderBy("id").collect()  # about 2 * per_class rows
    x = np.zeros((len(rows), SHAPES + word_terms), dtype=np.float32)
    for k, r in enumerate(rows):
        x[k, r["at"]] = r["value"]
    if not len(rows):
        return None
    df = (x[:, SHAPES:] > 0).sum(axis=0)
    idf = np.log((1 + len(rows)) / (1 + df)).astype(np.float32)
    x = weighted(x, idf)
    space = truncated_svd(x, dimensions, seed)
    model = Model(word_terms, idf, space, unit(x @ space).astype(np.float32), np.array([r["label"] for r in rows], dtype=np.float32))
    if model.nbytes() > 64 << 20:
        raise ValueError(f"the model has {model.nbytes()} bytes; lower per_class, dimensions or word_terms")
    return model


def vote(vectors: np.ndarray, model: Model, neighbours: int, power: int) -> np.ndarray:
    """Labels of the nearest labelled vectors, weighted by similarity; 0 for rows without direction.

    Vectors that tie for the last places share them.
    """
    near = vectors @ model.vectors.T
    k = min(neighbours, near.shape[1])
    last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
    row, at = np.nonzero(near >= last[:, None])
    value = near[row, at]
    above = value > last[row]
    n_above = np.bincount(row, weights=above, minlength=len(near))
    share = (k - n_above) / np.maximum(np.bincount(row, weights=~above, minlength=len(near)), 1)
    weight = np.maximum(value, 0).astype(np.float64) ** power * np.where(above, 1.0, share[row])
    total = np.bincount(row, weights=weight, minlength=len(near))
    return np.where(total > 0, np.bincount(row, weights=weight * model.labels[at], minlength=len(near)) / np.maximum(total, 1e-12), 0.0)


SCORE = "id long, score double"


def scorer(spark, model: Model | None, neighbours: int, power: int):
    """The batch function's maker: scores of (id, text) batches."""
    shared = spark.sparkContext.broadcast(model)

    def make():
        model = shared.value
        terms = Terms(model.word_terms) if model else None

        def run(batch):
            texts = text_bytes(batch.column(1))
            if model is None:
                return {"id": batch.column(0), "score": [0.0] * len(texts)}
            out = np.zeros(len(texts))
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and to - at < BLOCK and (to == at or size + len(texts[to]) < 8 << 20):
                    size += len(texts[to])
                    to += 1
                out[at:to] = vote(unit(weighted(terms.counts(texts[at:to]), model.idf) @ model.space), model, neighbours, power)
                at = to
            return {"id": batch.column(0), "score": np.clip(out, 0.0, 1.0)}

        return run

    return make


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", neighbours: int = 25, power: int = 8) -> DataFrame:
    """``(id, score)`` for every row."""
    return by_batch(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), SCORE, scorer(docs.sparkSession, model, neighbours, power))


def kept_documents(docs: DataFrame, model: Model | None, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", neighbours: int = 25, power: int = 8) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, as they are; all of them without a model."""
    if model is None:
        return docs
    prefix = free_prefix(docs)
    scored = appended(docs, {id_col: "long", text_col: "string"}, SCORE, scorer(docs.sparkSession, model, neighbours, power), prefix)
    return scored.where(F.col(f"{prefix}score") >= least).select(*docs.columns)


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may be learned from: four fifths of the ids, and those without an id."""
    return labels.where(~held_out(id_col))


def held_out(id_col: str):
    return F.coalesce(crc32_mod(id_col, 5) == 0, F.lit(False))


def op6_quality_classifier(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, learnable(table(spark, sf_dir, "labels")), "quality")
    return score(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
