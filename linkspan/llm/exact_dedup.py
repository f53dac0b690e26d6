"""Exact dedup by a tree merge of sorted digest runs.

Every document becomes a key: the SHA-256 of its whole text, verified by the
text's byte length and an independent 64-bit hash (rows count as equal only if
all three agree). Each reading task sorts its batches once, merges the sorted
runs and collapses copies on the way, so a text that makes up a third of the
corpus leaves a task as one entry. Then partitions exchange runs in binomial
rounds: 2**fold partitions of a round meet, each meeting takes one 2**fold-th of
their key space, merges their runs of it and retains for each key the verified
best identifier, the row it belongs to and the group's size. As every round
halves the key space as often as it halves the partitions, a run stays as large
as it was at the leaves (about RANGE_ENTRIES entries, however large the corpus
is), and the rounds are as many as the partitions' logarithm.

Edge cases: null text is the empty text, and all empty texts are equal. A null
identifier loses to any other; a group with null identifiers only keeps one of
its rows and its keep_id is null. Where rows repeat the identifier that stays,
one of them stays. Extra columns never matter. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_that_stay, table, text_or_empty, written

#: Entries of a run on average.
RANGE_ENTRIES = 32768

RUNS = "range bigint, node int, keys binary, ids binary, rows binary, counts binary, reals binary, ties binary"
_PARTS = ("keys", "ids", "rows", "counts", "reals", "ties")
_KEY_WORDS = 6  # 4 of the digest, 1 length, 1 check


def _folded(parts, largest: bool):
    """Sorted parts with one entry for each key: its best identifier (and of the rows
    that have it the first one), and the sums of the counts."""
    keys, ids, rows, counts, reals, ties = parts
    if not len(ids):
        return parts
    first = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
    if first.all():
        return parts
    at, group = np.flatnonzero(first), np.cumsum(first) - 1
    rank = ~ids if largest else ids
    same = rank == np.minimum.reduceat(rank, at)[group]
    row = np.minimum.reduceat(np.where(same, rows, np.iinfo(np.int64).max), at)
    best = np.minimum.reduceat(rank, at)
    sums = (np.add.reduceat(x, at) for x in (counts, reals, np.where(same, ties, 0)))
    return keys[at], ~best if largest else best, row, *sums


def _run(keys, *parts, largest: bool):
    """A batch as a sorted run."""
    order = np.lexsort(tuple(keys[:, k] for k in reversed(range(_KEY_WORDS))))
    return _folded((keys[order], *(p[order] for p in parts)), largest)


def _places(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many keys of `one` come before or are equal to each of `other`; both are sorted.
    First words decide, but for keys that share them."""
    a, b = one[:, 0].astype(np.uint64), other[:, 0].astype(np.uint64)
    low, high = np.searchsorted(a, b), np.searchsorted(a, b, "right")
    out = high.astype(np.int64)
    met = np.flatnonzero(low < high)
    unequal = met[(high[met] - low[met] > 1) | (one[low[met]] != other[met]).any(axis=1)]
    for k in unequal.tolist():
        own = other[k].tobytes()
        out[k] = low[k] + sum(x.tobytes() <= own for x in one[low[k] : high[k]])
    return out


def merged(one, other, largest: bool):
    """Two sorted runs as one: the shorter one's places in the longer one are looked up."""
    if len(one[1]) < len(other[1]):
        one, other = other, one
    n = len(one[1]) + len(other[1])
    inserted = np.zeros(n, dtype=bool)
    inserted[_places(one[0], other[0]) + np.arange(len(other[1]))] = True
    parts = []
    for x, y in zip(one, other):
        both = np.empty((n, *x.shape[1:]), dtype=x.dtype)
        both[inserted], both[~inserted] = y, x
        parts.append(both)
    return _folded(tuple(parts), largest)


class Runs:
    """Sorted runs merged two of a size at a time, so that n entries move log(n) times."""

    def __init__(self, largest: bool):
        self.largest, self.levels = largest, {}

    def add(self, run) -> None:
        level = 0
        while level in self.levels:
            run, level = merged(self.levels.pop(level), run, self.largest), level + 1
        self.levels[level] = run

    def whole(self):
        out = None
        for level in sorted(self.levels):
            out = self.levels[level] if out is None else merged(self.levels[level], out, self.largest)
        return out


def _packed(parts, bits: int, node: int):
    """One row for each range of `bits` leading bits that the sorted parts have."""
    words = parts[0][:, 0].astype(np.uint64)
    ranges = (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(ranges) else []
    ends = np.r_[starts[1:], len(ranges)] if len(ranges) else []
    parts = (parts[0].astype(">u8"), *parts[1:])
    return [
        {"range": int(ranges[a]), "node": node} | {n: np.ascontiguousarray(p[a:b]).tobytes() for n, p in zip(_PARTS, parts)}
        for a, b in zip(starts, ends)
    ]


def _unpacked(row: dict):
    keys = np.frombuffer(row["keys"], dtype=">u8").reshape(-1, _KEY_WORDS)
    return keys, *(np.frombuffer(row[n], dtype="<i8") for n in _PARTS[1:])


_RUN_SCHEMA = pa.schema([("range", pa.int64()), ("node", pa.int32()), *((n, pa.binary()) for n in _PARTS)])


def _leaf_runs(bits: int, largest: bool):
    worst = np.int64(np.iinfo(np.int64).min if largest else np.iinfo(np.int64).max)

    def leaf(batches):
        from pyspark import TaskContext

        node, held = TaskContext.get().partitionId(), Runs(largest)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.empty((n, _KEY_WORDS), dtype=">u8")
            keys[:, :4] = np.frombuffer(b"".join(batch.column("digest").to_pylist()), dtype=">u8").reshape(n, 4)
            keys[:, 4] = batch.column("n_bytes").to_numpy(zero_copy_only=False)
            keys[:, 5] = batch.column("check").to_numpy(zero_copy_only=False).view("<u8")
            null = np.array(batch.column("doc_id").is_null())
            ids = batch.column("doc_id").fill_null(int(worst)).to_numpy(zero_copy_only=False).astype("<i8")
            one = np.ones(n, dtype="<i8")
            held.add(_run(keys, ids, batch.column("row").to_numpy(zero_copy_only=False).astype("<i8"), one, (~null).astype("<i8"), one, largest=largest))
        if held.levels:
            for row in _packed(held.whole(), bits, node):
                yield pa.RecordBatch.from_pylist([row], schema=_RUN_SCHEMA)

    return leaf


def _merge_runs(largest: bool, bits: int):
    """The runs of one range that meet, merged and cut to ranges of `bits` bits."""

    def merge(runs: pa.Table) -> pa.Table:
        held = Runs(largest)
        for row in runs.to_pylist():
            held.add(_unpacked(row))
        return pa.Table.from_pylist(_packed(held.whole(), bits, runs.column("node")[0].as_py()), schema=_RUN_SCHEMA)

    return merge


_WINNERS = "w_digest binary, w_bytes bigint, w_check bigint, keep_id bigint, keep_row bigint, group_size bigint, ties bigint"


def _winner_rows(batches):
    for batch in batches:
        for row in batch.to_pylist():
            keys, ids, rows, counts, reals, ties = _unpacked(row)
            raw = np.ascontiguousarray(keys[:, :4]).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([raw[k : k + 32] for k in range(0, len(raw), 32)], pa.binary()),
                    pa.array(keys[:, 4].astype(np.int64)),
                    pa.array(keys[:, 5].astype(np.uint64).view(np.int64)),
                    pa.array(ids, mask=reals == 0),
                    pa.array(rows), pa.array(counts), pa.array(ties),
                ],
                names=["w_digest", "w_bytes", "w_check", "keep_id", "keep_row", "group_size", "ties"],
            )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, n_bytes, check, row of every document, as a written table."""
    text = text_or_empty(text_col)
    return written(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.octet_length(text).cast("bigint").alias("n_bytes"),
            F.xxhash64(text).alias("check"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )


def winners(prints: DataFrame, keep: str = "smallest", fold: int = 2, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """One row per distinct text: its key, the id and row that stay, the group's size.
    2**fold partitions meet in a round; prints: a written table."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    largest = keep == "largest"
    nodes = max(1, prints.rdd.getNumPartitions())
    rounds = -(-(nodes - 1).bit_length() // fold)
    bits = max(0, (max(1, prints.count()) - 1) // (nodes * range_entries)).bit_length()
    cut = lambda done: bits + fold * min(rounds, done + 1)
    runs = prints.mapInArrow(_leaf_runs(cut(0), largest), RUNS)
    for done in range(1, rounds + 1):
        met = runs.withColumn("node", F.shiftright("node", fold)).groupBy("range", "node")
        runs = met.applyInArrow(_merge_runs(largest, cut(done)), RUNS)
    return runs.mapInArrow(_winner_rows, _WINNERS)


def decisions(prints: DataFrame, **how) -> DataFrame:
    """Every document's row with keep_id, group_size, kept, ties, text_sha256."""
    best = winners(prints, **how)
    joined = prints.join(
        best,
        (prints.digest == best.w_digest) & (prints.n_bytes == best.w_bytes) & (prints.check == best.w_check),
    )
    return joined.select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "ties",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs without copies, columns unchanged; of equal texts one row stays."""
    stays = written(decisions(fingerprints(docs, id_col, text_col), keep=keep).where("kept"), "stays")
    stays = stays.select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_key"), "ties")
    return rows_that_stay(docs, stays, id_col, F.sha2(text_or_empty(text_col), 256))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: of equal texts the largest doc_id stays."""
    prints = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decisions(prints, keep="largest").drop("ties")


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLES = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))
    """
}
