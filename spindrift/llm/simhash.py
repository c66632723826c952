"""SimHash fingerprints of texts, linked by covering locality-sensitive hashing.

A fingerprint is the bitwise majority over the XXH64 hashes of a text's word
shingles.  Two fingerprints link at ``radius`` or fewer differing bits.  Every
bit position is given a non-zero vector of radius + 1 bits; table v keeps the
positions whose vector is not orthogonal to v.  The vectors of at most
``radius`` positions never span the space, so some v is orthogonal to all of
them: each linked pair is equal on the bits of at least one table.

Equal fingerprints are gathered first, so copies never meet in a bucket.  A
bucket of more than ``bucket`` fingerprints is covered again over the bits that
its table left out; what remains free then bounds a bucket by 2**free bits, so
no cap is needed.  Within buckets numpy compares the members and gives a
spanning forest of the links, never all pairs.

Nulls and texts without words: fingerprint zero, linked like any other.  Fewer
words than a shingle: the whole sequence is one shingle.  Repeated rows give
repeated result rows; a null id keeps its row and never becomes a component's
name unless the whole component has none.  Extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, by_batch, kept_rows, shuffled, text_bytes, written
from .components import connected_components

BITS = 64
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of UTF-8 ``text``; A-Z count as a-z."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    ends = ends[shingle - 1 :]
    count = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    for at in range(0, len(starts), BLOCK):
        part = [view[s:e] for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)]
        hashes = np.fromiter(map(digest, part, repeat(seed)), dtype="<u8", count=len(part))
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((count * 2 > len(starts)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(id, hash, fp)``: the text's hash and its fingerprint as a signed long."""

    def make():
        def run(batch):
            values = [fingerprint(t, shingle, seed) for t in text_bytes(batch.column(2))]
            return {"id": batch.column(0), "hash": batch.column(1), "fp": np.array(values, dtype=np.uint64).view(np.int64)}

        return run

    return by_batch(docs.select(F.col(id_col).cast("long"), _hash(text_col), F.col(text_col).cast("string")), "id long, hash long, fp long", make, TEXTS)


def _hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _vectors(positions: list[int], radius: int, seed: int) -> dict[int, int]:
    """Each position's non-zero vector, dealt evenly."""
    order = np.random.default_rng(seed).permutation(len(positions))
    return {positions[int(p)]: 1 + k % (2 ** (radius + 1) - 1) for k, p in enumerate(order)}


def covering_masks(radius: int, positions: list[int] | None = None, seed: int = 7) -> list[int]:
    """One mask for each table: every set of ``radius`` positions is left out whole by some mask."""
    vectors = _vectors(list(range(BITS)) if positions is None else positions, radius, seed)
    return [sum(1 << p for p, m in vectors.items() if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(fp: Column, masks: list[tuple[int, int]]) -> Column:
    """An array with a key for each (table number, mask)."""
    return F.array(*[F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(_signed(m)).cast("long"))) for n, m in masks])


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, parent) that connect what links of ``radius`` bits connect among ``values`` (uint64)."""
    n = len(values)
    parent = np.full(n, -1, dtype=np.int64)
    left = np.arange(n)
    while len(left):
        parent[left[0]] = left[0]
        queue, left = left[:1], left[1:]
        while len(queue) and len(left):
            grown = []
            for at in range(0, len(queue), 64):
                if not len(left):
                    break
                near = np.bitwise_count(values[queue[at : at + 64], None] ^ values[None, left]) <= radius
                hit = near.any(axis=0)
                if hit.any():
                    parent[left[hit]] = queue[at + near[:, hit].argmax(axis=0)]
                    grown.append(left[hit])
                    left = left[~hit]
            queue = np.concatenate(grown) if grown else queue[:0]
    child = np.nonzero(parent != np.arange(n))[0]
    return child, parent[child]


def _linked(groups: DataFrame, radius: int) -> DataFrame:
    """Edges within each row's ``fps`` array."""

    def make():
        def run(batch):
            lists = batch.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(lists.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            a, b = [], []
            for size in np.unique(sizes):
                at = starts[sizes == size]
                if size <= 24:  # all such groups at once
                    i, j = np.triu_indices(size, 1)
                    for k in range(0, len(at), 4096):
                        part = flat[at[k : k + 4096, None] + np.arange(size)]
                        x, y = part[:, i], part[:, j]
                        near = np.bitwise_count(x ^ y) <= radius
                        a.append(x[near])
                        b.append(y[near])
                else:
                    for s in at:
                        part = flat[s : s + size]
                        child, up = forest(part, radius)
                        a.append(part[child])
                        b.append(part[up])
            if not a:
                return None
            return {"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)}

        return run

    return by_batch(groups.select("fps"), "a long, b long", make)


def links(distinct: DataFrame, radius: int = 3, bucket: int = 1024) -> DataFrame:
    """Edges ``(a, b)`` over distinct fingerprints ``fp`` that connect all pairs within ``radius`` bits."""
    masks = covering_masks(radius)
    keyed = distinct.select(F.posexplode(_keys(F.col("fp"), list(enumerate(masks)))).alias("n", "key"), "fp")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = keyed.join(shuffled(sizes), "key")
    small = met.where(F.col("size") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    # over-full buckets: the bits that their table left out are covered again
    again = F.lit(None)
    for n, mask in enumerate(masks):
        free = [p for p in range(BITS) if not mask >> p & 1]
        inner = [(len(masks) * (n + 1) + k, mask | m) for k, m in enumerate(covering_masks(radius, free, seed=11 + n))]
        again = F.when(F.col("n") == n, _keys(F.col("fp"), inner)).otherwise(again)
    large = met.where(F.col("size") > bucket).select(F.explode(again).alias("key"), "fp").groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return _linked(small.select("fps").unionByName(large.select("fps")), radius)


def _classes(found: DataFrame, radius: int, bucket: int) -> DataFrame:
    """``(fp, best)`` for every fingerprint: the least row of its component, one with an id before one without."""
    distinct = found.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("least"))
    roots = connected_components(links(distinct.select("fp"), radius, bucket))
    named = distinct.join(shuffled(roots), distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return named.join(shuffled(named.groupBy("root").agg(F.min("least").alias("best"))), "root").select("fp", "best")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42, bucket: int = 1024) -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``docs``; component_id is the least id reachable by links."""
    found = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    return found.join(shuffled(_classes(found, radius, bucket)), "fp", "left").select("id", "fp", F.col("best.id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42, bucket: int = 1024) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the one with the least id."""
    found = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    rows = found.join(shuffled(_classes(found, radius, bucket)), "fp", "left").select("id", "hash", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("hash") == F.col("best.hash"))).alias("kept"))
    return kept_rows(docs, id_col, _hash(text_col), rows)


def op8_simhash(spark, sf_dir):
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
