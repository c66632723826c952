"""Packing of tokenised documents into fixed-length sequences by bin completion.

A document is its token ids and one end id.  Documents longer than a sequence
are cut into whole sequences, a shorter first piece taking the rest, so what
has to be packed is pieces of 1 to ``capacity`` tokens.  Only their lengths
matter, and there are at most ``capacity`` of those: the search runs over the
table of counts by length, whatever the number of documents, and each filling
that it finds is used as often as the counts allow.

The search is depth-first bin completion: take the longest piece left,
enumerate the undominated fillings of the room beside it, try them by waste,
prune a branch when its bins and the least number that the rest needs reach the
incumbent, and stop at the lower bound or after ``nodes`` fillings.  The first
incumbent is best-fit decreasing.

Pieces are then numbered within their length (in salted parts, so no length is
ever gathered into one task) and look their place up in the plan.

Null and empty texts are the end id alone.  Extra columns are ignored; repeated
rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, fresh, unsigned_crc, written


# -- tokens ------------------------------------------------------------------


def encoder(path: str):
    """``encode(text) -> uint32 ids`` of a byte-level vocabulary.

    ``path`` is the vocabulary for ``tokenizers`` (``.json``) or its ranks
    (``.tiktoken``, with tiktoken: the same ids about four times as fast).  The
    end-of-text string in a text is its id, as ``tokenizers`` has it by default.
    """
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        return lambda text: np.array(made.encode(text, add_special_tokens=False).ids, dtype="<u4")
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    made = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return lambda text: made.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece; with ``with_ids`` also its token ids (array)."""
    path = vocabulary or default_vocabulary()

    def make():
        encode = encoder(path)

        def run(batch):
            rows: list[tuple] = []
            ids = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.append(encode(text) if text else np.zeros(0, "<u4"), np.uint32(end_id)).astype("<u4")
                first = len(tokens) % capacity or capacity
                at, piece = 0, 0
                while at < len(tokens):
                    n = first if not at else capacity
                    part = tokens[at : at + n]
                    rows.append((key, piece, at, n, unsigned_crc(part.tobytes())))
                    if with_ids:
                        ids.append(part.astype(np.int32))
                    at, piece = at + n, piece + 1
            out = dict(zip(("id", "piece", "start", "length", "ids_crc32"), zip(*rows, strict=True), strict=True))
            return out | ({"ids": ids} if with_ids else {})

        return run

    return by_batch(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), PIECES + (", ids array<int>" if with_ids else ""), make)


# -- the search over lengths -------------------------------------------------


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and, for each k, bins for pieces that cannot share plus what overflows them."""
    sizes = np.arange(capacity + 1)
    total = int((counts * sizes).sum())
    best = -(-total // capacity)
    many, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    half = capacity // 2
    for k in range(1, half + 1):
        big = int(many[-1] - many[capacity - k])  # longer than capacity - k
        mid_n = int(many[capacity - k] - many[half])
        mid_v = int(volume[capacity - k] - volume[half])
        low_v = int(volume[half] - volume[k - 1])
        best = max(best, big + mid_n + max(0, -(-(low_v - (mid_n * capacity - mid_v)) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over lengths: each longest piece takes the longest that still fit beside it."""
    left, plan = counts.astype(np.int64).copy(), []
    while (size := _longest(left, capacity)) is not None:
        fill, room = {size: 1}, capacity - size
        while room and (more := _longest(left, room, fill)) is not None:
            fill[more] = fill.get(more, 0) + 1
            room -= more
        plan.append((fill, _use(left, fill)))
    return plan


def _longest(left: np.ndarray, limit: int, taken: dict[int, int] | None = None) -> int | None:
    at = np.nonzero(left[1 : limit + 1])[0]
    for size in at[::-1]:
        if not taken or left[size + 1] > taken.get(int(size) + 1, 0):
            return int(size) + 1
    return None


def _use(left: np.ndarray, fill: dict[int, int]) -> int:
    """Use the filling as often as the counts allow."""
    times = min(int(left[s]) // n for s, n in fill.items())
    for s, n in fill.items():
        left[s] -= n * times
    return times


def fillings(left: np.ndarray, capacity: int, width: int = 6, steps: int = 3000, slack: int = 8) -> list[dict[int, int]]:
    """Undominated fillings around the longest piece left, by waste, then by fewer pieces; at most ``width``.

    A filling is dominated if an unused piece still fits, or could take the
    place of a shorter one in it.  Fillings of two or more further pieces are
    looked for only with at most ``slack`` tokens of waste a level, the waste
    bound; where none is found, the room is filled up greedily.
    """
    size = _longest(left, capacity)
    room = capacity - size
    have = np.nonzero(left[1 : room + 1])[0] + 1
    have = have[::-1].tolist()  # long to short
    count = {s: int(left[s]) - (s == size) for s in have}
    have = [s for s in have if count[s] > 0]
    if not have:
        return [{size: 1}]
    found: list[tuple[int, int, dict[int, int]]] = []
    budget = steps
    present = np.zeros(room + 1, dtype=bool)
    present[have] = True
    # the longest length that is present, at or below each room
    below = np.maximum.accumulate(np.where(present, np.arange(room + 1), 0))

    def pack(chosen: list[int]) -> dict[int, int]:
        out = {size: 1}
        for s in chosen:
            out[s] = out.get(s, 0) + 1
        return out

    def dominated(chosen: list[int], waste: int) -> bool:
        used: dict[int, int] = {}
        for s in chosen:
            used[s] = used.get(s, 0) + 1
        free = lambda limit, above: any(count[s] > used.get(s, 0) for s in have if above < s <= limit)
        return bool(waste) and (free(waste, 0) or any(free(s + waste, s) for s in set(chosen)))

    def deepen(chosen: list[int], rest: int, most: int, depth: int) -> bool:
        """Fill ``rest`` with exactly ``depth`` more pieces of at most ``most``; True to stop."""
        nonlocal budget
        if depth == 1:
            s = int(below[min(rest, most)])
            while s and count[s] <= chosen.count(s):
                s = int(below[s - 1])
            if s and not dominated([*chosen, s], rest - s):
                found.append((rest - s, len(chosen) + 1, pack([*chosen, s])))
                return sum(f[0] == 0 for f in found) >= width
            return False
        s = int(below[min(rest, most)])
        while s and s * depth >= rest - slack:
            budget -= 1
            if budget < 0:
                return True
            if count[s] > chosen.count(s) and deepen([*chosen, s], rest - s, s, depth - 1):
                return True
            s = int(below[s - 1])
        return False

    for depth in range(1, 6):
        if deepen([], room, room, depth) or any(f[0] == 0 for f in found) and depth > 1:
            break
    if not found or found[0][0]:  # many short pieces: fill up greedily
        chosen, rest = [], room
        while rest:
            s = int(below[rest])
            while s and count[s] <= chosen.count(s):
                s = int(below[s - 1])
            if not s:
                break
            chosen.append(s)
            rest -= s
        found.append((rest, len(chosen), pack(chosen)))
    found.sort(key=lambda f: f[:2])
    out: list[dict[int, int]] = []
    for _, _, f in found:
        if f not in out:
            out.append(f)
    return out[:width]


def complete(counts: np.ndarray, capacity: int, nodes: int = 4_000, width: int = 6) -> list[tuple[dict[int, int], int]]:
    """``[(filling, times)]`` for pieces ``counts[length]``, as few bins as the search finds."""
    counts = counts.astype(np.int64)
    best = best_fit(counts, capacity)
    fewest, least = sum(t for _, t in best), lower_bound(counts, capacity)
    sizes = np.arange(capacity + 1)

    def open_node(left: np.ndarray, bins: int, plan: tuple | None) -> Iterator:
        for fill in fillings(left, capacity, width):
            after = left.copy()
            times = _use(after, fill)
            yield after, bins + times, (plan, fill, times)

    if fewest == least:
        return best
    stack = [open_node(counts, 0, None)] if counts.any() else []
    while stack and nodes > 0 and fewest > least:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            continue
        nodes -= 1
        left, bins, plan = step
        volume = int((left * sizes).sum())
        if not volume:
            if bins < fewest:
                fewest, best = bins, []
                while plan:
                    best.append((plan[1], plan[2]))
                    plan = plan[0]
                best.reverse()
            continue
        if bins + -(-volume // capacity) < fewest:
            stack.append(open_node(left, bins, plan))
    return best


def placements(plan: list[tuple[dict[int, int], int]], capacity: int) -> dict[str, np.ndarray]:
    """The plan as runs of ranks by length: where a run starts, its first sequence, copies in a sequence, first offset."""
    rows, used, first = [], {}, 0
    for fill, times in plan:
        offset = 0
        for s in sorted(fill, reverse=True):
            rows.append((s, used.get(s, 0), first, fill[s], offset))
            used[s] = used.get(s, 0) + fill[s] * times
            offset += s * fill[s]
        first += times
    rows.sort()
    t = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"at": np.searchsorted(t[:, 0], np.arange(capacity + 2)), "start": t[:, 1], "first": t[:, 2], "copies": t[:, 3], "offset": t[:, 4]}


def placed(where: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks (from 0) within them."""
    run = np.empty(len(length), dtype=np.int64)
    for s in np.unique(length):
        of = length == s
        lo, hi = where["at"][s], where["at"][s + 1]
        run[of] = lo + np.searchsorted(where["start"][lo:hi], rank[of], side="right") - 1
    j = rank - where["start"][run]
    return where["first"][run] + j // where["copies"][run], where["offset"][run] + j % where["copies"][run] * length


# -- the operator ------------------------------------------------------------


def pack(cut: DataFrame, capacity: int = 1024, nodes: int = 4_000, per_salt: int = 250_000) -> DataFrame:
    """``cut`` (columns id, piece, length and any others) with ``sequence_id`` and ``offset``.

    Pieces of one length are numbered in parts of at most about ``per_salt``,
    and in some 64 where there are enough; pieces that are alike in every column
    are numbered in one.
    """
    salt, rank, before = fresh(cut, "salt", "rank", "before")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    where = placements(complete(counts, capacity, nodes), capacity)
    parts = F.element_at(F.lit([int(max(-(-n // per_salt), min(64, n // 16), 1)) for n in counts]), F.col("length").cast("int") + 1)
    salted = cut.withColumn(salt, F.pmod(F.xxhash64(*(c for c in cut.columns)), parts).cast("long"))
    sizes = written(salted.groupBy("length", salt).agg(F.count("*").alias("n")), "lengths")  # 64 x capacity + pieces / per_salt rows at most
    start = sizes.select("length", salt, (F.sum("n").over(Window.partitionBy("length").orderBy(salt)) - F.col("n")).alias(before))
    start = F.broadcast(start) if int(counts.sum()) // per_salt < 1_000_000 else start
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy("id", "piece"))).join(start, ["length", salt])
    names = cut.columns

    def make():
        def run(batch):
            length, number, begin = (batch.column(n).to_numpy() for n in ("length", rank, before))
            sequence, offset = placed(where, length, number - 1 + begin)
            return {n: batch.column(n) for n in names} | {"sequence_id": sequence, "offset": offset}

        return run

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return by_batch(ranked.select(*names, rank, before), f"{schema}, sequence_id long, offset long", make)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, with_ids: bool = False, nodes: int = 4_000) -> DataFrame:
    """Every piece of ``docs`` with its sequence and offset; ``with_ids`` keeps the token ids."""
    return pack(written(pieces(docs, id_col, text_col, capacity, end_id, vocabulary, with_ids), "pieces"), capacity, nodes)


def op7_packing(spark, sf_dir):
    from .common import table

    return pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
