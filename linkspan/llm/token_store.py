"""Token ids in a static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus, is shared by all blocks. A
block is a whole number of documents; its ids are dealt over interleaved lanes,
each with its own 64-bit state, that emit into one stream of 32-bit words. Every
CHECKPOINT_STEPS steps the block records its lanes' states and stream position,
so a decoder may begin at any checkpoint, and blocks don't depend on each other.
CRC-32 sums guard a block's bytes and its decoded ids.

File format: a folder of Parquet files (the container, uncompressed) with one
row a block: part and block (their order is the documents' order), n_tokens,
n_docs, frame. A frame is little-endian:
  magic "RNS1", u32 crc of all that follows, u32 lanes, u32 checkpoint steps,
  u64 tokens, u32 documents, u32 checkpoints, u64 words, u32 crc of the ids,
  documents x (i64 doc_id, u8 id is null, u64 tokens),
  checkpoints x (u64 step, u64 word position, lanes x u64 state),
  words x u32.
The first checkpoint is step 0. Beside it lies the folder `table`: (token, freq)
rows whose frequencies sum to 2**TABLE_BITS.

Order is ascending doc_id (nulls first), then text hash, so repeated rows and
ties keep a defined place. Null text is empty: it holds the end id alone. An
empty table gives an empty folder. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, shared_folder, table, text_or_empty
from .tokens import encoder

TABLE_BITS = 18
LANES = 2048
CHECKPOINT_STEPS = 128
BLOCK_TOKENS = 1 << 20
END_ID = 0
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<IIQIIQI")
MAGIC = b"RNS1"


class Table:
    """Shared frequencies: symbols in ascending order, summing to 2**bits."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, bits: int = TABLE_BITS):
        if len(symbols) and int(freqs.sum()) != 1 << bits:
            raise ValueError("frequencies don't sum to the table's size")
        self.bits, self.symbols, self.freqs = bits, symbols.astype(np.uint32), freqs.astype(np.uint64)
        self.starts = (np.cumsum(self.freqs) - self.freqs).astype(np.uint64)
        size = int(self.symbols.max()) + 1 if len(symbols) else 0
        self.freq_of, self.start_of = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
        self.freq_of[self.symbols], self.start_of[self.symbols] = self.freqs, self.starts
        index = np.repeat(np.arange(len(symbols)), self.freqs.astype(np.int64))
        self.slot_symbol, self.slot_freq = self.symbols[index], self.freqs[index]
        self.slot_offset = np.arange(len(index), dtype=np.uint64) - self.starts[index]

    @classmethod
    def quantised(cls, symbols: np.ndarray, counts: np.ndarray, bits: int = TABLE_BITS) -> Table:
        """Counts scaled to 2**bits, each at least 1, by largest remainder."""
        order = np.argsort(symbols)
        symbols, counts = symbols[order], counts[order].astype(np.float64)
        if not len(symbols):
            return cls(symbols, counts.astype(np.int64), bits)
        if len(symbols) > 1 << bits:
            raise ValueError("more symbols than the table has slots")
        spare = (1 << bits) - len(symbols)
        share = counts / counts.sum() * spare
        freqs = np.floor(share).astype(np.int64)
        rest = spare - int(freqs.sum())
        freqs[np.argsort(freqs - share, kind="stable")[:rest]] += 1
        return cls(symbols, freqs + 1, bits)


def encode_block(ids: np.ndarray, shared: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS):
    """(checkpoints, words): rANS states are built from the last step to the first."""
    n, shift = len(ids), np.uint64(63 - shared.bits)
    bits, low32 = np.uint64(shared.bits), np.uint64(32)
    steps = -(-n // lanes)
    states = np.full(lanes, _LOW, dtype=np.uint64)
    stream, marks = [], []
    for step in reversed(range(steps)):
        part = ids[step * lanes : (step + 1) * lanes]
        k = len(part)
        f, x = shared.freq_of[part], states[:k]
        full = x >= f << shift
        stream.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> low32, x)
        q = x // f
        states[:k] = (q << bits) + (x - q * f) + shared.start_of[part]
        if step % every == 0:
            marks.append((step, len(stream), states.copy()))
    words = np.concatenate(stream[::-1]) if stream else np.zeros(0, dtype="<u4")
    sizes = np.cumsum([len(s) for s in stream[::-1]])
    total = len(stream)
    checkpoints = [(step, int(sizes[total - done - 1]) if total > done else 0, state) for step, done, state in reversed(marks)]
    return checkpoints, words


def decode_steps(checkpoint, words: np.ndarray, tokens: int, to_step: int, shared: Table, lanes: int) -> np.ndarray:
    """The ids of the steps from a checkpoint up to to_step."""
    step, at, states = checkpoint[0], checkpoint[1], checkpoint[2].copy()
    bits, mask, low32 = np.uint64(shared.bits), np.uint64((1 << shared.bits) - 1), np.uint64(32)
    end = min(tokens, to_step * lanes)
    out = np.empty(max(0, end - step * lanes), dtype="<u4")
    base = step * lanes
    for s in range(step, to_step):
        k = min(lanes, tokens - s * lanes)
        x = states[:k]
        slot = (x & mask).astype(np.int64)
        out[s * lanes - base : s * lanes - base + k] = shared.slot_symbol[slot]
        x = shared.slot_freq[slot] * (x >> bits) + shared.slot_offset[slot]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << low32) | words[at : at + len(low)]
        states[:k] = x
        at += len(low)
    return out


def frame(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray, shared: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    lanes = max(1, min(lanes, len(ids)))
    checkpoints, words = encode_block(ids, shared, lanes, every)
    head = _HEAD.pack(lanes, every, len(ids), len(lengths), len(checkpoints), len(words), zlib.crc32(ids.astype("<u4").tobytes()))
    marks = b"".join(struct.pack("<QQ", s, a) + state.astype("<u8").tobytes() for s, a, state in checkpoints)
    body = head + doc_ids.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + lengths.astype("<u8").tobytes() + marks + words.tobytes()
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


class Frame:
    """A block as read: its documents, and its ids from any checkpoint on."""

    def __init__(self, raw: bytes, shared: Table):
        if raw[:4] != MAGIC or struct.unpack_from("<I", raw, 4)[0] != zlib.crc32(memoryview(raw)[8:]):
            raise ValueError("a block is damaged")
        self.lanes, self.every, self.tokens, docs, marks, words, self.crc = _HEAD.unpack_from(raw, 8)
        at = 8 + _HEAD.size
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.nulls = np.frombuffer(raw, "u1", docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        self.checkpoints = []
        for _ in range(marks):
            step, word = struct.unpack_from("<QQ", raw, at)
            self.checkpoints.append((step, word, np.frombuffer(raw, "<u8", self.lanes, at + 16).astype(np.uint64)))
            at += 16 + 8 * self.lanes
        self.words, self.shared = np.frombuffer(raw, "<u4", words, at), shared

    def section(self, k: int) -> np.ndarray:
        """The ids between checkpoint k and the next one; sections decode in any order."""
        steps = -(-self.tokens // self.lanes)
        to = self.checkpoints[k + 1][0] if k + 1 < len(self.checkpoints) else steps
        return decode_steps(self.checkpoints[k], self.words, self.tokens, to, self.shared, self.lanes)

    def ids(self) -> np.ndarray:
        parts = [self.section(k) for k in range(len(self.checkpoints))]
        ids = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
        if zlib.crc32(ids.tobytes()) != self.crc:
            raise ValueError("a block's ids are damaged")
        return ids


_BLOCKS = "part int, block int, n_tokens bigint, n_docs int, frame binary"
_BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("n_docs", pa.int32()), ("frame", pa.binary())])


_STAGED = "part int, block int, n_tokens bigint, doc_ids binary, nulls binary, lengths binary, ids binary, tokens binary, counts binary"
_STAGED_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "nulls", "lengths", "ids", "tokens", "counts"))])


def _stage(vocabulary: str, block_tokens: int):
    """Sorted documents as blocks of plain ids, with each block's counts."""

    def run(batches):
        from pyspark import TaskContext

        tokenizer, part, block = encoder(vocabulary, True), TaskContext.get().partitionId(), 0
        width = "<u2" if tokenizer.vocabulary <= 1 << 16 else "<u4"
        end = np.array([END_ID], dtype="<u4").tobytes()
        doc_ids, nulls, texts, size = [], [], [], 0

        def out():
            ids = np.frombuffer(b"".join(texts), dtype="<u4")
            counts = np.bincount(ids, minlength=1)
            token = np.flatnonzero(counts)
            row = {
                "part": part, "block": block, "n_tokens": len(ids),
                "doc_ids": np.array(doc_ids, dtype="<i8").tobytes(), "nulls": np.array(nulls, dtype="u1").tobytes(),
                "lengths": np.array([len(t) // 4 for t in texts], dtype="<i8").tobytes(), "ids": ids.astype(width).tobytes(),
                "tokens": token.astype("<i4").tobytes(), "counts": counts[token].astype("<i8").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=_STAGED_SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = tokenizer.ids(text.as_py()) + end
                doc_ids.append(doc_id or 0)
                nulls.append(doc_id is None)
                texts.append(ids)
                size += len(ids) // 4
                if size >= block_tokens:
                    yield out()
                    doc_ids, nulls, texts, size, block = [], [], [], 0, block + 1
        if texts:
            yield out()

    return run


def _counts(batches):
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for token, n in zip(batch.column("tokens"), batch.column("counts")):
            token, n = np.frombuffer(token.as_py(), "<i4"), np.frombuffer(n.as_py(), "<i8")
            if len(token) and token[-1] >= len(total):
                total = np.concatenate([total, np.zeros(int(token[-1]) + 1 - len(total), dtype=np.int64)])
            total[token] += n
    token = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int32)), pa.array(total[token])], names=["token", "n"])


def _encode(symbols: np.ndarray, freqs: np.ndarray, lanes: int, every: int):
    def run(batches):
        shared = Table(symbols, freqs)
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, nulls, lengths = (np.frombuffer(row[n], d) for n, d in (("doc_ids", "<i8"), ("nulls", "u1"), ("lengths", "<i8")))
                ids = np.frombuffer(row["ids"], f"<u{len(row['ids']) // row['n_tokens']}").astype("<u4")
                raw = frame(doc_ids, nulls, lengths, ids, shared, lanes, every)
                out = {"part": row["part"], "block": row["block"], "n_tokens": len(ids), "n_docs": len(lengths), "frame": raw}
                yield pa.RecordBatch.from_pylist([out], schema=_BLOCK_SCHEMA)

    return run


def write(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text",
          block_tokens: int = BLOCK_TOKENS, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> str:
    """Write the ids of docs below path. Texts are sorted and encoded once, into a
    staging table of plain ids with counts; the blocks are coded from that. The
    driver holds the frequency table only: one row for each id of the vocabulary."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    staging = f"{path}/staging"
    dealt.drop("tie").mapInArrow(_stage(vocabulary, block_tokens), _STAGED).write.option("compression", "zstd").parquet(staging)
    staged = spark.read.schema(_STAGED).parquet(staging)
    counted = staged.select("tokens", "counts").mapInArrow(_counts, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    shared = Table.quantised(counted["token"].to_numpy(), counted["n"].to_numpy())
    table_rows = pa.table({"token": pa.array(shared.symbols.astype(np.int32)), "freq": pa.array(shared.freqs.astype(np.int64))})
    spark.createDataFrame(table_rows.to_pandas(), "token int, freq bigint").coalesce(1).write.parquet(f"{path}/table")
    blocks = staged.drop("tokens", "counts").mapInArrow(_encode(shared.symbols, shared.freqs, lanes, every), _BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    delete(spark, staging)
    return path


def _decode(symbols: np.ndarray, freqs: np.ndarray):
    def run(batches):
        shared = Table(symbols, freqs)
        for batch in batches:
            for part, block, raw in zip(batch.column("part"), batch.column("block"), batch.column("frame")):
                read = Frame(raw.as_py(), shared)
                ids = memoryview(read.ids().tobytes())
                ends = np.cumsum(read.lengths)
                starts = ends - read.lengths
                sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part.as_py(), dtype=np.int32)), pa.array(np.full(n, block.as_py(), dtype=np.int32)),
                     pa.array(read.doc_ids, mask=read.nulls), pa.array(starts), pa.array(read.lengths), pa.array(sums, pa.int64())],
                    names=["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    return run


def shared_table(spark: SparkSession, path: str) -> Table:
    rows = spark.read.schema("token int, freq bigint").parquet(f"{path}/table").orderBy("token").toPandas()
    return Table(rows["token"].to_numpy(), rows["freq"].to_numpy())


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, decoded block by block."""
    shared = shared_table(spark, path)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    decoded = blocks.select("part", "block", "frame").mapInArrow(
        _decode(shared.symbols, shared.freqs), "part int, block int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    )
    sizes = blocks.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.join(parts, "part").select("part", "block", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("block_start"))
    return decoded.join(places, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document written, read back and summed up."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read(spark, write(docs, shared_folder(spark, "tokens")))


QUERIES = {"op3_token_store": op3_token_store}
ORACLES: dict[str, str] = {}
