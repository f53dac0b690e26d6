"""SimHash near-dedup with a bit-sliced comparison.

A document's fingerprint has a bit set where over half of its word shingles'
64-bit hashes have it. Equal fingerprints fold to one node before anything else,
so copies never meet as pairs. The 64 bits are cut into `blocks` blocks; two
fingerprints within `radius` bits agree on at least blocks - radius of them, so
bucketing by every choice of that many blocks misses no link. Buckets are
compared with their bits stored vertically (one plane a bit, 64 rows a word):
for every lag the planes are XORed with their shifted selves and carry-save
counters advance all distances of a word at once; a word is abandoned as soon
as each of its rows exceeds the radius. Rows that are in one component already
aren't compared again, and a bucket returns a spanning forest, never its pairs.
Buckets over `bucket_rows` rows are cut into chunks whose pairs are separate
groups, so no task holds an unbounded bucket and no pair is lost.

Edge cases: null text and texts without words have fingerprint zero and are
linked like any other. With fewer words than a shingle has, the whole sequence
is the one shingle. Documents with a null identifier take part; component_id is
the smallest identifier that isn't null, or null if there is none. Repeated
rows are linked (equal fingerprints). An empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_that_stay, table, text_or_empty, written
from .components import components

#: Shingles hashed before their bits are added up; bounds memory on long texts.
HASH_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """The unsigned fingerprint of a UTF-8 text; bytes.lower() and bytes.split()
    touch exactly A-Z and the blanks 09-0D and 20."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return digest(joined, seed)
    ends = list(accumulate(map(len, words)))
    count, ones = n - shingle + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, count, HASH_BLOCK):
        to = min(count, at + HASH_BLOCK)
        starts = [0 if k == 0 else ends[k - 1] + k for k in range(at, to)]
        hashes = np.fromiter(
            (digest(joined[a : e + k + shingle - 1], seed) for k, (a, e) in enumerate(zip(starts, ends[at + shingle - 1 : to + shingle - 1]), at)),
            dtype="<u8", count=to - at,
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle, seed) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(prints.view(np.int64))], names=["doc_id", "tie", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, tie (a hash of the text), fp of every document, as a written table."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("text"))
    return written(rows.mapInArrow(_fingerprints(shingle, seed), "doc_id bigint, tie bigint, fp bigint"), "prints")


def _full_add(a, b, c):
    """Sum and carry of three words of lanes."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


class Planes:
    """Fingerprints stored as bit planes, compared lag by lag.

    prints: one unsigned 64-bit word a row, or several (a row of a matrix)."""

    GROUP = 7  # planes that carry-save adders turn into one number of three bits

    def __init__(self, prints: np.ndarray):
        prints = prints.reshape(len(prints), -1)
        n, width = prints.shape
        self.n, self.words, self.bits = n, -(-n // 64), 64 * width
        padded = np.zeros(((self.words + 1) * 64, width), dtype="<u8")
        padded[:n] = prints
        bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        self.planes = np.ascontiguousarray(packed).view("<u8")  # each of words + 1

    def within(self, lag: int, wanted: np.ndarray, radius: int) -> np.ndarray:
        """Rows i of `wanted` (a mask over rows) whose row i + lag is within radius bits."""
        lanes = np.zeros(self.words * 64, dtype=np.uint8)
        lanes[: len(wanted)] = wanted
        live = np.packbits(lanes, bitorder="little").view("<u8")
        at = np.flatnonzero(live)
        live = live[at]
        skip, shift = divmod(lag, 64)
        counters = [np.zeros(len(at), dtype=np.uint64) for _ in range((radius + 1).bit_length())]

        def differing(p):
            row = self.planes[p]
            other = row[at + skip]
            if shift:
                other = (other >> np.uint64(shift)) | (row[np.minimum(at + skip + 1, self.words)] << np.uint64(64 - shift))
            return row[at] ^ other

        for plane in range(0, self.bits, self.GROUP):
            if not len(at):
                return at
            counters, live = _counted(counters, live, [differing(p) for p in range(plane, min(plane + self.GROUP, self.bits))], radius)
            stays = np.flatnonzero(live)
            if len(stays) < len(at):
                at, live, counters = at[stays], live[stays], [c[stays] for c in counters]
        lanes = np.unpackbits(np.ascontiguousarray(live).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, lane = np.nonzero(lanes)
        return at[word] * 64 + lane

    #: Blocks (a row against 64 others) that are compared in one go.
    BLOCKS = 1 << 16

    def near(self, low: np.ndarray, high: np.ndarray, radius: int):
        """Pairs (two arrays, again and again) of each row i with the rows low[i] to
        high[i] - 1 that are within radius bits. A block is one row against a word of
        each plane; it is abandoned once all of its rows exceed the radius."""
        row_bits = np.ascontiguousarray(-np.unpackbits(self.planes.view(np.uint8), axis=1, bitorder="little")[:, : self.n].view(np.int8))
        first = low // 64
        width = np.where(high > low, (high - 1) // 64 - first + 1, 0)
        after = np.cumsum(width)
        for start in range(0, int(after[-1]) if len(after) else 0, self.BLOCKS):
            block = np.arange(start, min(start + self.BLOCKS, int(after[-1])))
            row = np.searchsorted(after, block, side="right")
            word = first[row] + block - (after[row] - width[row])
            ones = np.uint64(0xFFFFFFFFFFFFFFFF)
            live = ones << np.clip(low[row] - 64 * word, 0, 63).astype(np.uint64)
            live &= ones >> np.clip(64 * word + 64 - high[row], 0, 63).astype(np.uint64)
            counters = [np.zeros(len(row), dtype=np.uint64) for _ in range((radius + 1).bit_length())]
            for plane in range(0, self.bits, self.GROUP):
                differ = [self.planes[p][word] ^ row_bits[p][row].astype(np.int64).view(np.uint64) for p in range(plane, min(plane + self.GROUP, self.bits))]
                counters, live = _counted(counters, live, differ, radius)
                stays = np.flatnonzero(live)
                if len(stays) < len(row):
                    row, word, live, counters = row[stays], word[stays], live[stays], [c[stays] for c in counters]
                if not len(row):
                    break
            lanes = np.unpackbits(np.ascontiguousarray(live).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(lanes)
            if len(at):
                yield row[at], word[at] * 64 + lane


def _counted(counters: list[np.ndarray], live: np.ndarray, differ: list[np.ndarray], radius: int):
    """Counters and live lanes after up to seven planes of differences: carry-save adders
    make one number of three bits of them, which is added to the counters."""
    x = differ + [np.zeros(len(live), dtype=np.uint64)] * (Planes.GROUP - len(differ))
    one, carry_a = _full_add(*x[:3])
    two, carry_b = _full_add(*x[3:6])
    ones, carry_c = _full_add(one, two, x[6])
    number = (ones, *_full_add(carry_a, carry_b, carry_c))
    counters, carry = list(counters), np.zeros(len(live), dtype=np.uint64)
    for k in range(max(len(counters), 3)):
        if k >= len(counters):
            live = live & ~number[k]  # more than a counter can hold is beyond the radius
        elif k < 3:
            counters[k], carry = _full_add(counters[k], number[k], carry)
        else:
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
    return counters, live & ~carry & ~_exceeds(counters, radius)


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter is larger than radius."""
    more = np.zeros_like(counters[0])
    equal = ~more
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            more, equal = more | (equal & counters[k]), equal & ~counters[k]
    return more


def forest(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of each bucket's links; rows are sorted by key."""
    n = len(keys)
    root = np.arange(n)
    if n < 2:
        return prints[:0], prints[:0]
    runs = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    longest = int(np.diff(np.r_[runs, n]).max())
    if longest < 2:
        return prints[:0], prints[:0]
    planes, end = Planes(prints), np.repeat(np.r_[runs[1:], n], np.diff(np.r_[runs, n]))
    rows = np.arange(n)
    for lag in range(1, longest):
        rows = rows[rows + lag < end[rows]]  # a row stays while its bucket reaches that far
        wanted = np.zeros(n, dtype=bool)
        wanted[rows] = root[rows] != root[rows + lag]
        a = planes.within(lag, wanted, radius)
        b = a + lag
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    child = np.flatnonzero(root != np.arange(n))
    return prints[child], prints[root[child]]


#: Rows compared in one go; whole buckets, so more where a bucket is larger.
COMPARE_ROWS = 16384


def _links(radius: int):
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out(keys, prints):
            u, v = forest(keys, prints, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held.append((batch.column("bucket").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
            size += batch.num_rows
            if size < COMPARE_ROWS:
                continue
            keys, prints = (np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield out(keys[:last], prints[:last])
            held, size = [(keys[last:], prints[last:])], len(keys) - last
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    return run


def blocks_for(nodes: int, radius: int, load: int = 256) -> int:
    """The least number of blocks, from radius + 2, whose buckets hold at most `load`
    of that many random fingerprints on average. Every choice finds every link."""
    blocks = radius + 2
    while blocks < 2 * radius and nodes >> (64 * (blocks - radius) // blocks) > load:
        blocks += 1
    return blocks


def _buckets(nodes: DataFrame, blocks: int, radius: int) -> DataFrame:
    edges = [64 * k // blocks for k in range(blocks + 1)]

    def key(chosen):
        value = F.lit(0).cast("bigint")
        for k in chosen:
            width = edges[k + 1] - edges[k]
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << width) - 1)))
        return value

    keys = [key(c) for c in combinations(range(blocks), blocks - radius)]
    chosen = nodes.select("fp", F.posexplode(F.array(*keys)).alias("choice", "value"))
    return chosen.select("fp", F.shiftleft("value", 8).bitwiseOR(F.col("choice")).alias("bucket"))


def chunk_pairs(buckets: DataFrame, hot: DataFrame, bucket_rows: int) -> DataFrame:
    """buckets (fp, bucket and more), where a bucket of `hot` (bucket, count) is cut into
    chunks, and each two of them are a bucket of their own."""
    if hot.isEmpty():
        return buckets
    others = [c for c in buckets.columns if c != "bucket"]
    chunks = F.ceil(2 * F.col("count") / bucket_rows).cast("int")
    cut = buckets.join(hot, "bucket", "left").withColumn("chunks", F.coalesce(chunks, F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    return cut.select(*others, F.when(F.col("chunks") == 1, F.col("bucket")).otherwise(pair).alias("bucket"))


def links(nodes: DataFrame, radius: int = 4, bucket_rows: int = 8192) -> DataFrame:
    """(u, v) fingerprints: links within radius that connect what all links connect.
    nodes: a written table with one row for each distinct fp."""
    buckets = _buckets(nodes, blocks_for(nodes.count(), radius), radius)
    hot = written(buckets.groupBy("bucket").count().where(F.col("count") > bucket_rows), "hot")
    buckets = chunk_pairs(buckets, hot, bucket_rows)
    dealt = buckets.repartition("bucket").sortWithinPartitions("bucket", "fp")
    return dealt.mapInArrow(_links(radius), "u bigint, v bigint")


def decisions(prints: DataFrame, radius: int = 4, bucket_rows: int = 8192) -> DataFrame:
    """doc_id, tie, fp of every document with its component: the first of its rows
    (component_id, component_tie) by identifier, nulls last, then tie."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")
    nodes = written(prints.groupBy("fp").agg(first), "nodes")
    linked = written(components(links(nodes.select("fp"), radius, bucket_rows)), "components")
    return labelled(prints, nodes, linked)


def labelled(prints: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """prints (doc_id, tie, fp) with the first row of their component; nodes (fp, first)
    and linked (node, root) are written tables."""
    best = nodes.join(linked, nodes.fp == linked.node).groupBy("root").agg(F.min("first").alias("best"))
    of = linked.join(best, "root").select(F.col("node").alias("fp"), "best")
    # written, so that the last join has two plain exchanges and Spark may split a hot fingerprint
    whole = written(nodes.join(of, "fp", "left").select("fp", F.coalesce("best", "first").alias("first")), "whole")
    return prints.join(whole, "fp").select("doc_id", "tie", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.tie").alias("component_tie"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs with one document of each component, columns unchanged: the one with the
    smallest identifier (of several rows with it, that of the smallest text hash)."""
    found = decisions(fingerprints(docs, id_col, text_col, shingle), radius)
    return keep_first(docs, found, id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that are the first of their component in `found`."""
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("tie") == F.col("component_tie"))
    stays = found.where(first).groupBy(F.col("doc_id").alias("stay_id"), F.col("tie").alias("stay_key")).agg(F.count("*").alias("ties"))
    return rows_that_stay(docs, written(stays, "stays"), id_col, F.xxhash64(text_or_empty(text_col)))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: four-word shingles, XXH64 with seed 42, four or fewer bits."""
    prints = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decisions(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash_dedup": op6_simhash_dedup}
ORACLES: dict[str, str] = {}
