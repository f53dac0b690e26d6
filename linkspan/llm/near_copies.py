"""Near copies by word shingles: every pair whose five-word Jaccard is 0.8 or more.

A text is the set of its five-word shingles' hashes; equal sets fold to one node.
Two sets of which one has n hashes can only reach the similarity if they meet in
the first n - ceil(0.8 n) + 1 of a common order (prefix filter), so bucketing by
these misses no pair. The order is rare ones first, by a sketch of ORDER_CELLS
counters over the shingles of all documents: a passage that many documents share
comes last and fills no bucket. Any order finds every pair.

Rows of a bucket are compared by SimHash as in simhash_dedup, bit-sliced with
carry-save counters, on fingerprints of BITS bits: at similarity 0.8 a bit
differs with a chance of 0.152 (0.188 where sets have a few hashes), so RADIUS is
seven standard deviations off, and unrelated rows ten on the other side. Sets
below SMALL hashes skip the fingerprints. No pair leaves a task: what is near
within a bucket is joined there, and the tasks' forests make groups, so what is
written grows with the rows and not with the square of a group. Every link lies
within a group. Then each group's whole sets meet once, are compared by SimHash
again, and what is near is confirmed by the exact Jaccard of the sets; only a
forest of the confirmed links is written. Buckets over `bucket_rows` rows and
groups over GROUP_HASHES hashes are cut into chunks whose pairs are separate
buckets or groups, as in simhash_dedup.

Edge cases: null texts and texts without words are the empty set, and equal to
each other. With fewer words than a shingle has, the whole sequence is the one
shingle. Null identifiers, repeated rows and empty tables are as in simhash_dedup.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, released, releasing, ship, text_or_empty, written
from .components import components, spanned, stars
from .simhash_dedup import COMPARE_ROWS, Planes, chunk_pairs, keep_first, labelled

#: Words of a shingle; counters of the order.
SHINGLE, ORDER_CELLS = 5, 1 << 16
#: Bits of a fingerprint, differing bits up to which a pair is confirmed, and sets that skip this.
BITS, RADIUS, SMALL = 512, 136, 32
#: Hashes of a group that meet in one task, and those held before they are compared.
GROUP_HASHES, HELD_HASHES = 1 << 20, 1 << 21
#: Pairs confirmed before the rows' roots are looked at again.
PAIRS = 1 << 14
#: Shingles handled in one go, and bytes of a matrix of shingles that sets share.
BLOCK, MATRIX = 1 << 13, 1 << 25


def shingle_set(text: bytes, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles, as int64."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64)
    joined = b" ".join(words)
    if n <= SHINGLE:
        return np.array([digest(joined, seed)], dtype=np.uint64).view(np.int64)
    ends = [e + k for k, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[: n - SHINGLE])]
    hashes = np.fromiter((digest(joined[a:e], seed) for a, e in zip(starts, ends[SHINGLE - 1 :])), dtype=np.uint64, count=n - SHINGLE + 1)
    return np.unique(hashes.view(np.int64))


def prefix_size(n: int) -> int:
    """Hashes of which a set with similarity 4/5 or more has to share one."""
    return n - -(-4 * n // 5) + 1 if n else 0


def alike(both, n, m):
    """Whether an intersection of `both` makes the Jaccard of sizes n, m 4/5 or more."""
    return 9 * both >= 4 * (n + m)


def _cells_of(batches):
    """(cell, n): how often the shingles of all documents fall into each counter."""
    total, held, size = np.zeros(ORDER_CELLS, dtype=np.int64), [], 0
    for batch in batches:
        for t in batch.column("text"):
            held.append(shingle_set(t.as_buffer().to_pybytes()) & (ORDER_CELLS - 1))
            size += len(held[-1])
            if size > HELD_HASHES:
                total += np.bincount(np.concatenate(held), minlength=ORDER_CELLS)
                held, size = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=ORDER_CELLS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])


def frequencies(rows: DataFrame) -> np.ndarray:
    """The sketch over all rows (text: binary); the driver holds ORDER_CELLS numbers."""
    counted = rows.select("text").mapInArrow(releasing(_cells_of), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(ORDER_CELLS, dtype=np.int64)
    total[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    return total


def simhash(own: np.ndarray) -> bytes:
    """The fingerprint of a set: each hash is mixed with BITS / 64 numbers to as many words."""
    ones, lanes = np.zeros(BITS, dtype=np.int64), np.arange(BITS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(own), BLOCK):
        x = own[at : at + BLOCK].view(np.uint64)[:, None] ^ lanes
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(own), bitorder="little").tobytes()


def prefix(own: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """The hashes of a set that come first in the common order: rare ones, then by value."""
    size = prefix_size(len(own))
    rarity = frequency[own & (ORDER_CELLS - 1)]
    return own[np.lexsort((own, rarity))[:size]]


def _prints(frequency):
    def run(batches):
        import xxhash

        for batch in batches:
            keys, sizes, sims, prefixes = [], [], [], []
            for t in batch.column("text"):
                own = shingle_set(t.as_buffer().to_pybytes())
                keys.append(xxhash.xxh64_intdigest(own.tobytes(), 7))
                sizes.append(len(own))
                sims.append(simhash(own))
                prefixes.append(prefix(own, frequency.value))
            offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *prefixes])))
            columns = [batch.column("doc_id"), batch.column("tie"), pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sims, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "fp", "n", "sim", "prefix"])

    return run


def _sets(batches):
    for batch in batches:
        sets = [shingle_set(t.as_buffer().to_pybytes()) for t in batch.column("text")]
        columns = [*(batch.column(c) for c in ("fp", "bucket", "n", "sim")), pa.array(sets, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["fp", "bucket", "n", "sim", "hashes"])


def _ends(changes: np.ndarray) -> np.ndarray:
    """For each row the end of its run, where changes marks the runs' first rows."""
    runs = np.flatnonzero(changes)
    width = np.diff(np.r_[runs, len(changes)])
    return np.repeat(runs + width, width)


def candidates(bucket: np.ndarray, n: np.ndarray, prints: np.ndarray):
    """Pairs (two arrays of rows, again and again) of one bucket that may be alike; rows
    are sorted by bucket."""
    rows = np.arange(len(bucket))
    if not len(rows):
        return
    low, high = rows + 1, _ends(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in Planes(prints).near(low, high, RADIUS):
        least = np.minimum(n[a], n[b])
        fits = alike(least, n[a], n[b]) & (least >= SMALL)
        yield a[fits], b[fits]
    # a small set's partners have 5/4 of its hashes at most
    some = np.flatnonzero(4 * n < 5 * SMALL)
    low, high = (np.searchsorted(some, x[some]) for x in (low, high))
    at, lag = np.arange(len(some)), 0
    while len(at):
        b = low[at] + lag
        at, b = at[b < high[at]], b[b < high[at]]
        x, y = n[some[at]], n[some[b]]
        fits = alike(np.minimum(x, y), x, y) & (np.minimum(x, y) < SMALL)
        if fits.any():
            yield some[at[fits]], some[b[fits]]
        lag += 1


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the links a, b."""
    return spanned(len(root), np.concatenate([np.arange(len(root)), a]), np.concatenate([root, b]))


class Sets:
    """The sets of the rows of a batch, and the exact similarity of pairs of them."""

    def __init__(self, hashes: list[np.ndarray]):
        self.hashes, self.n = hashes, np.array([len(h) for h in hashes])
        self.matrix = None

    def _bits(self, rows: np.ndarray) -> bool:
        """Bits of the hashes that two or more of the rows have, if that fits MATRIX."""
        every = np.concatenate([self.hashes[r] for r in rows])
        _, column, times = np.unique(every, return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1
        width = -(-int(shared[-1] + 1) // 64) * 64 if len(shared) else 0
        if len(rows) * width > 8 * MATRIX:
            return False
        keep = times[column] > 1
        owner = np.repeat(np.arange(len(rows)), self.n[rows])[keep]
        bits = np.zeros((len(rows), width), dtype=np.uint8)
        bits[owner, shared[column[keep]]] = 1
        self.place = np.zeros(len(self.hashes), dtype=np.int64)
        self.place[rows] = np.arange(len(rows))
        self.matrix = np.packbits(bits, axis=1).view(np.uint64)
        return True

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the Jaccard of rows a[k] and b[k] is 4/5 or more."""
        both = np.empty(len(a), dtype=np.int64)
        rows = np.unique(np.concatenate([a, b]))
        if len(a) > 4 * len(rows) and self._bits(rows):
            step = max(1, MATRIX // max(8, 8 * self.matrix.shape[1]))
            for at in range(0, len(a), step):
                x, y = self.matrix[self.place[a[at : at + step]]], self.matrix[self.place[b[at : at + step]]]
                both[at : at + step] = np.bitwise_count(x & y).sum(axis=1)
        else:
            both[:] = [len(np.intersect1d(self.hashes[x], self.hashes[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist())]
        return alike(both, self.n[a], self.n[b])


def linked(bucket: np.ndarray, n: np.ndarray, prints: np.ndarray, sets: Sets | None = None) -> np.ndarray:
    """The root of each row after all links within its bucket: the near pairs, or with
    sets those that are alike. Rows of one root aren't confirmed again."""
    root = np.arange(len(bucket))
    for a, b in candidates(bucket, n, prints):
        order = np.argsort(bucket[a], kind="stable") if sets else slice(None)
        a, b = a[order], b[order]
        cuts = np.r_[0, np.flatnonzero(bucket[a][1:] != bucket[a][:-1]) + 1, len(a)] if sets and len(a) else [0, len(a)]
        for start, end in zip(cuts, cuts[1:]):
            x, y = a[start:end], b[start:end]
            while sets and len(x):
                apart = root[x] != root[y]
                x, y = x[apart], y[apart]
                now, (x, y) = (x[:PAIRS], y[:PAIRS]), (x[PAIRS:], y[PAIRS:])
                if len(now[0]):
                    good = sets.alike(*now)
                    root = joined(root, now[0][good], now[1][good])
            if not sets and len(x):
                root = joined(root, x, y)
    return root


def _links(exact: bool):
    """The forest of a task's links, over rows (bucket, fp, n, sim and, to be exact, hashes)
    that are sorted by bucket."""

    def out(rows: pa.Table):
        fp, n = rows["fp"].to_numpy(), rows["n"].to_numpy()
        prints = np.frombuffer(b"".join(rows["sim"].to_pylist()), dtype="<u8").reshape(len(fp), -1)
        sets = None
        if exact:
            lists = rows["hashes"].combine_chunks()
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            sets = Sets([flat[a:b] for a, b in zip(ends, ends[1:])])
        root = linked(rows["bucket"].to_numpy(), n, prints, sets)
        child = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[root[child]])], names=["u", "v"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += pc.sum(batch.column("n")).as_py() or 0 if exact else batch.num_rows
            if size < (HELD_HASHES if exact else COMPARE_ROWS):
                continue
            rows = pa.Table.from_batches(held)
            keys = rows["bucket"].to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield out(rows.slice(0, last).combine_chunks())
                released()
            rest = rows.slice(last).combine_chunks()
            held = rest.to_batches()
            size = pc.sum(rest["n"]).as_py() if exact else rest.num_rows
        if held:
            yield out(pa.Table.from_batches(held).combine_chunks())

    return lambda batches: stars(run(batches))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 2048, group_hashes: int = GROUP_HASHES) -> DataFrame:
    """doc_id, tie, fp (of the set) of every document with its component, as in simhash_dedup."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("text"))
    ship(docs.sparkSession)
    order = docs.sparkSession.sparkContext.broadcast(frequencies(rows))
    prints = written(rows.mapInArrow(releasing(_prints(order)), "doc_id bigint, tie bigint, fp bigint, n bigint, sim binary, prefix array<bigint>"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")
    nodes = written(prints.groupBy("fp").agg(first, *(F.first(c).alias(c) for c in ("n", "sim", "prefix"))), "nodes")

    # groups: what may be alike, by the buckets that two or more sets share
    entries = nodes.select("fp", F.explode("prefix").alias("bucket"))
    counts = written(entries.groupBy("bucket").count().where("count > 1"), "counts")
    shared = entries.join(counts.select("bucket"), "bucket")
    hot = written(counts.where(F.col("count") > bucket_rows), "hot")
    dealt = written(chunk_pairs(shared, hot, bucket_rows), "dealt")
    met = dealt.join(nodes.select("fp", "n", "sim"), "fp").repartition("bucket").sortWithinPartitions("bucket", "fp")
    groups = components(written(met.mapInArrow(releasing(_links(False)), "u bigint, v bigint"), "near"))
    for used in (counts, hot, dealt):
        dropped(used)

    # links: each group's whole sets, read from the texts of its members only
    members = written(groups.join(nodes.select("fp", "n", "sim", "first"), F.col("node") == F.col("fp")).select("fp", F.col("root").alias("bucket"), "n", "sim", F.col("first.doc_id").alias("_id"), F.col("first.tie").alias("_tie")), "members")
    large = written(members.groupBy("bucket").agg(F.sum("n").alias("count")).where(F.col("count") > group_hashes), "large")
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_tie"))
    texts = docs.join(members, same).select("fp", "bucket", "n", "sim", text.cast("binary").alias("text")).dropDuplicates(["fp"])
    sets = written(texts.mapInArrow(releasing(_sets), "fp bigint, bucket bigint, n bigint, sim binary, hashes array<bigint>"), "sets")
    whole = chunk_pairs(sets, large, group_hashes).repartition("bucket").sortWithinPartitions("bucket", "fp")
    links = written(whole.mapInArrow(releasing(_links(True)), "u bigint, v bigint"), "links")
    confirmed = written(components(links), "components")
    for used in (members, large, sets):
        dropped(used)
    return labelled(prints.select("doc_id", "tie", "fp"), nodes.select("fp", "first"), confirmed)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, columns unchanged: the one with the
    smallest identifier (of several rows with it, that of the smallest text hash)."""
    return keep_first(docs, decisions(docs, id_col, text_col), id_col, text_col)
