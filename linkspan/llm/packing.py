"""Best-fit packing by bin completion with branch and bound.

Documents become pieces of at most `capacity` tokens. Only lengths matter to a
packing, so the search works on the histogram of piece lengths: `capacity` rows
at most, however large the corpus is. Best-fit decreasing of the whole histogram
is the first incumbent. The search branches over the whole histogram: the largest
length left opens a sequence, and its undominated completions (maximal sets of
remaining lengths, minus those whose items an earlier completion's items could
hold) are tried one after the other, each as often as the histogram allows, then
half as often, and so on down to once. A branch ends where the sequences it has
and the waste bound of what is left (Martello and Toth's second bound) can't beat
the incumbent; best fit of what is left gives new incumbents on the way. So the
plan never has more sequences than best fit, and is optimal where the search ends
by itself or meets the bound. `nodes` limits its steps (None: no limit, the exact
way). The plan says for each length which ranks go where; pieces are ranked within
their length by task and place in it, so no length is ever gathered in one task.

Edge cases: null text is empty and holds the end id alone; repeated rows are
packed once each; null identifiers are carried along; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import releasing, table, text_or_empty, written
from .tokens import encoder

END_ID = 0
#: Steps of the search before the incumbent is taken: a length tried in a filling is one,
#: a branch with its bound BRANCH_STEPS, a best fit one for each length.
NODES = 500_000
BRANCH_STEPS = 32
#: Fillings ordered by their waste at a time.
WINDOW = 16
#: Items of a filling up to which dominance is decided.
DOMINATED = 64


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether a's items, as bins, can hold all items of b (both descending). Of more
    than DOMINATED items it isn't looked at: a filling too many costs only time."""
    if sum(b) > sum(a) or len(b) > DOMINATED:
        return False

    def place(k: int, room: list[int]) -> bool:
        if k == len(b):
            return True
        for i in range(len(room)):
            if room[i] >= b[k] and room[i] not in room[:i]:
                room[i] -= b[k]
                if place(k + 1, room):
                    return True
                room[i] += b[k]
        return False

    return place(0, list(a))


class _Spent(Exception):
    """No steps are left."""


class Steps:
    def __init__(self, nodes: int | None):
        self.left = float("inf") if nodes is None else nodes

    def take(self, n: int = 1) -> None:
        self.left -= n
        if self.left < 0:
            raise _Spent


def _maximal(lengths: list[int], counts, room: int, steps: Steps) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, filling) of the sets of lengths that leave no room for another one,
    larger items first. A level takes a length as often as it goes, then less often,
    so levels are as many as a filling's distinct lengths, not as its items."""

    def search(room: int, top: int, chosen: tuple[int, ...], skipped: int):
        """skipped: the least length that is left over so far."""
        k = min(top, bisect_right(lengths, room) - 1)
        if k < 0:
            if room < skipped:
                yield room, chosen
            return
        while k >= 0:
            x = lengths[k]
            most = min(counts[x], room // x)
            for m in range(most, 0, -1):
                steps.take()
                yield from search(room - m * x, k - 1, chosen + (x,) * m, skipped if m == counts[x] else x)
            if room >= x:
                skipped = min(skipped, x)
            k -= 1

    yield from search(room, len(lengths) - 1, (), room + 1)


def completions(lengths: list[int], counts, room: int, steps: Steps | None = None) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of room, in windows ordered by waste. lengths: ascending,
    with counts above 0; counts may change between two fillings if it changes back."""
    steps = steps or Steps(None)
    kept: list[tuple[int, ...]] = []
    window: list[tuple[int, tuple[int, ...]]] = []

    def ordered():
        steps.take(len(kept))
        for waste, filling in sorted(window, key=lambda f: (f[0], tuple(-x for x in f[1]))):
            if not any(dominates(k, filling) for k in kept):
                kept.append(filling)
                yield filling

    for found in _maximal(lengths, counts, room, steps):
        window.append(found)
        if found[0] == 0 or len(window) == WINDOW:
            yield from ordered()
            window.clear()
    yield from ordered()


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing as (repeats, lengths): sequences with the same room move together."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def add(room: int, n: int, pattern: tuple[int, ...]) -> None:
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append((n, pattern))

    for x in sorted((x for x, n in counts.items() if n), reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(rooms, x)
            room = rooms[at] if at < len(rooms) else capacity
            bins, pattern = open_[room].pop() if at < len(rooms) else (n, ())
            if at < len(rooms) and not open_[room]:
                del open_[room]
                del rooms[at]
            each = room // x  # after the first one, this sequence stays the tightest that x fits
            full = min(bins, n // each)
            if full:
                add(room - each * x, full, pattern + (x,) * each)
            n -= full * each
            if full < bins:
                rest = min(n, each - 1)
                if rest:
                    add(room - rest * x, 1, pattern + (x,) * rest)
                n -= rest
                if pattern and bins - full - (rest > 0):
                    add(room, bins - full - (rest > 0), pattern)
    return [group for groups in open_.values() for group in groups]


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's second bound; counts: the pieces of each length 0..capacity."""
    number, area = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2
    a = np.r_[0, np.flatnonzero(counts[: half + 1])]
    alone = number[capacity] - number[capacity - a]
    large = number[capacity - a] - number[half]
    free = large * capacity - (area[capacity - a] - area[half])
    small = area[half] - np.where(a > 0, area[a - 1], 0)
    return int((alone + large + np.maximum(0, -((free - small) // capacity))).max())


def _branches(lengths: list[int], counts: list[int], capacity: int, steps: Steps) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(repeats, pattern) around the largest length: each completion as often as it goes,
    then half as often, down to once. The counts are back in place when it goes on."""
    top = lengths[-1]
    counts[top] -= 1
    rest = [x for x in lengths if counts[x]]
    for filling in completions(rest, counts, capacity - top, steps):
        counts[top] += 1
        pattern = (top, *filling)
        repeats = min(counts[x] // pattern.count(x) for x in set(pattern))
        while repeats:
            yield repeats, pattern
            repeats //= 2
        counts[top] -= 1
    counts[top] += 1


def plan(histogram: dict[int, int], capacity: int, nodes: int | None = NODES) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) patterns that use up the histogram of lengths 1..capacity."""
    if any(not 0 < x <= capacity for x, n in histogram.items() if n > 0):
        raise ValueError("a piece is longer than a sequence or empty")
    counts = [0] * (capacity + 1)
    for x, n in histogram.items():
        counts[x] = max(0, n)
    table, steps = np.array(counts, dtype=np.int64), Steps(nodes)
    best = best_fit(dict(enumerate(counts)), capacity)
    fewest, least = sum(n for n, _ in best), least_sequences(table, capacity)
    path: list[tuple[int, tuple[int, ...]]] = []  # what the branches so far have taken
    used = 0

    def move(repeats: int, pattern: tuple[int, ...], way: int) -> None:
        nonlocal used
        used += way * repeats
        for x in pattern:
            counts[x] -= way * repeats
            table[x] -= way * repeats

    def opened(mark: int):
        """The branches of what is left, or None where none can win; mark: the pieces
        that were left at the last best fit."""
        nonlocal best, fewest
        lengths = np.flatnonzero(table).tolist()
        left = int(table.sum())
        steps.take(BRANCH_STEPS)
        if used + (least_sequences(table, capacity) if lengths else 0) >= fewest:
            return None
        if not lengths:
            best, fewest = list(path), used
            return None
        if 2 * left <= mark:
            steps.take(len(lengths))
            rest, mark = best_fit({x: counts[x] for x in lengths}, capacity), left
            if (n := used + sum(n for n, _ in rest)) < fewest:
                best, fewest = [*path, *rest], n
        return _branches(lengths, counts, capacity, steps), mark

    try:
        stack = [frame] if fewest > least and (frame := opened(int(table.sum()))) else []
        while stack and fewest > least:
            branch, mark = stack[-1]
            taken = next(branch, None)
            if taken is None:
                stack.pop()
                if stack:
                    move(*path.pop(), -1)
                continue
            path.append(taken)
            move(*taken, 1)
            if frame := opened(mark):
                stack.append(frame)
            else:
                move(*path.pop(), -1)
    except _Spent:
        pass
    return best


def _pieces(vocabulary: str, capacity: int):
    def run(batches):
        from pyspark import TaskContext

        tokenizer, part = encoder(vocabulary, False), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, dtype=np.int64)
        end, step = np.array([END_ID], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = tokenizer.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    piece = ids[at : at + step]
                    n = len(piece) // 4
                    out.append((doc_id, k, at // 4, n, zlib.crc32(piece), part, int(ranks[n])))
                    ranks[n] += 1
            columns = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    return run


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces, with the task and the rank within it by length; a written table."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"
    return written(rows.mapInArrow(releasing(_pieces(vocabulary, capacity)), schema), "pieces")


def _placer(patterns: list[tuple[int, tuple[int, ...]]], capacity: int):
    """Arrays that send (length, rank) to (sequence, offset): slots sorted by length, first rank."""
    seen = np.zeros(capacity + 1, dtype=np.int64)
    slots, sequence = [], 0
    for repeats, pattern in patterns:
        offset = 0
        for x in pattern:
            slots.append((x, seen[x], sequence, offset))
            seen[x] += repeats
            offset += x
        sequence += repeats
    slots.sort()
    length, rank, first, offset = (np.array(c, dtype=np.int64) for c in zip(*slots)) if slots else [np.zeros(0, dtype=np.int64)] * 4
    bounds = np.searchsorted(length, np.arange(capacity + 2))

    def place(lengths: np.ndarray, ranks: np.ndarray):
        order = np.argsort(lengths, kind="stable")
        at = np.empty(len(lengths), dtype=np.int64)
        x = lengths[order]
        cuts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else []
        for a, b in zip(cuts, [*cuts[1:], len(x)]):
            lo, hi = bounds[x[a]], bounds[x[a] + 1]
            at[order[a:b]] = lo + np.searchsorted(rank[lo:hi], ranks[order[a:b]], side="right") - 1
        return first[at] + ranks - rank[at], offset[at]

    return place


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """cut (from `pieces`) with sequence_id and offset. The driver holds the histogram
    of lengths and the plan: both have a few rows for each length up to capacity."""
    counted = cut.groupBy("length").agg(F.count("*").alias("n")).collect()
    patterns = plan({r.length: r.n for r in counted}, capacity)
    sizes = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("rank")).drop("part", "base")

    def run(batches):
        place = _placer(patterns, capacity)
        for batch in batches:
            sequence, offset = place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(releasing(run), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: sequences of 2048 tokens of the word vocabulary."""
    return pack(pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op7_pack": op7_pack}
ORACLES: dict[str, str] = {}
