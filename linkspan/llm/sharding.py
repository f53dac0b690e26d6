"""Sharding by extendible hashing.

A document's hash is 60 bits of the MD5 of its identifier. The directory starts
as one bucket; a bucket over the byte limit is split on its next hash bit, and
only that bucket, until each fits. Cells (prefixes a little finer than the buckets
are expected to be) are counted once, and the sizes of coarser prefixes are added
up from them SPAN bits at a time; only where a bucket ends at the coarsest of
these are still coarser ones looked at. What is too large at the finest bit goes
into another stretch of bits. Rows meet their bucket by a plain sort-merge join on
the cell, so the directory is never sent anywhere whole.

A document larger than the limit ends up alone in its shard. Rows that share all
60 bits (rows that repeat an identifier, or have none) can't be told apart by any
directory: their last bucket is chained into numbered pages of at most the limit.
Such rows are numbered by the task that read them and blocks of PAGE_ROWS of its
rows, so a bucket that holds a third of all rows is never in one task.

Edge cases: null text has no bytes, so texts of any length and none are placed by
their identifier alone; null identifiers hash as one value; an empty table gives no
rows; extra columns are ignored by `assign`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

BITS = 60
BYTE_LIMIT = 1 << 20
#: Bits of a stretch beyond those that evenly filled buckets would need.
SPARE_BITS = 4
#: Depths whose sizes one aggregation of cells gives, and rows numbered in one group.
SPAN, PAGE_ROWS = 8, 1 << 16


def _prefix(column, from_bits: int, to_bits):
    return F.call_function("shiftright", column, (F.lit(from_bits) - to_bits).cast("int"))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, hash, row (its place) of every document, as a written table."""
    identifier = F.col(id_col).cast("bigint")
    digest = F.md5(F.coalesce(identifier.cast("string"), F.lit("-")).cast("binary"))
    return written(
        docs.select(
            identifier.alias("doc_id"), F.octet_length(text_or_empty(text_col)).cast("bigint").alias("n_bytes"),
            F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("hash"), F.monotonically_increasing_id().alias("row"),
        ),
        "units",
    )


_SIZES = ("bytes", "docs", "largest")


def _summed(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.max("largest").alias("largest"))


def _ends(cells: DataFrame, first: int, to: int, byte_limit: int) -> DataFrame:
    """cell, depth, prefix and sizes of the bucket of each cell (a prefix of `to` bits)
    whose bucket ends at a depth from `first` to `to`: the shallowest prefix that fits."""
    low = max(first, to - SPAN)
    paths = cells.select("cell", *_SIZES, F.explode(F.sequence(F.lit(low), F.lit(to))).alias("depth"))
    paths = paths.withColumn("prefix", _prefix(F.col("cell"), to, F.col("depth")))
    sizes = _summed(paths, "depth", "prefix")
    fits = (F.col("bytes") <= byte_limit) | (F.col("docs") == 1) | (F.col("depth") == BITS)
    ends = paths.select("cell", "depth", "prefix").join(sizes.where(fits).hint("merge"), ["depth", "prefix"])
    least = ends.groupBy("cell").agg(F.min(F.struct("depth", "prefix", *_SIZES)).alias("b"))
    ended = written(least.select("cell", "b.depth", "b.prefix", *(f"b.{c}" for c in _SIZES)), "buckets")
    if low == first or ended.where(F.col("depth") == low).isEmpty():
        return ended
    # a bucket that ends at the coarsest depth may end above it
    coarse = written(_summed(cells.withColumn("cell", _prefix(F.col("cell"), to, F.lit(low))), "cell"), "cells")
    above = _ends(coarse, first, low, byte_limit).withColumnRenamed("cell", "coarse")
    again = ended.where(F.col("depth") == low).select("cell", F.col("prefix").alias("coarse")).join(above.hint("merge"), "coarse").drop("coarse")
    return written(ended.where(F.col("depth") > low).unionByName(again), "buckets")


def directory(rows: DataFrame, byte_limit: int = BYTE_LIMIT, spare_bits: int = SPARE_BITS) -> list[tuple[int, DataFrame]]:
    """For each stretch its last bit and a table (cell, depth, prefix, bytes, docs,
    largest) of the cells of the buckets that end in it."""
    found, depth, rest = [], 0, rows.select("hash", F.col("n_bytes").alias("bytes"), F.lit(1).cast("bigint").alias("docs"), F.col("n_bytes").alias("largest"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    while True:
        to = min(BITS, depth + max(1, (total // byte_limit).bit_length() + spare_bits))
        cells = written(_summed(rest.withColumn("cell", _prefix(F.col("hash"), BITS, F.lit(to))), "cell"), "cells")
        ended = _ends(cells, 0 if not found else depth + 1, to, byte_limit)
        found.append((to, ended))
        open_cells = cells.join(ended.hint("merge"), "cell", "left_anti").select("cell", "bytes")
        total = open_cells.agg(F.max("bytes")).first()[0]
        if total is None or to == BITS:
            return found
        here = rest.withColumn("cell", _prefix(F.col("hash"), BITS, F.lit(to)))
        rest, depth = written(here.join(open_cells.select("cell").hint("merge"), "cell", "left_semi").drop("cell"), "rest"), to


def _paged(rows: DataFrame, byte_limit: int) -> DataFrame:
    """rows (with shard, row, largest) with the page of each: a page takes as many rows as
    the limit holds of the shard's largest one, in the order of their places."""
    inside = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.withColumn("task", F.shiftrightunsigned("row", 33)).withColumn("block", F.floor(inside / PAGE_ROWS))
    keys = ["shard", "task", "block"]
    before = Window.partitionBy("shard").orderBy("task", "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))  # one row for PAGE_ROWS rows or a task
    bases = sizes.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("row")) - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(byte_limit) / F.greatest(F.lit(1), F.col("largest"))))
    numbered = rows.withColumn("place", place).join(bases, keys)
    return numbered.withColumn("page", F.floor((F.col("base") + F.col("place")) / each))


def assign(docs: DataFrame, byte_limit: int = BYTE_LIMIT, id_col: str = "doc_id", text_col: str = "text", spare_bits: int = SPARE_BITS) -> DataFrame:
    """doc_id, shard (the bucket's hash prefix in binary digits), page, depth, n_bytes,
    shard_bytes, shard_docs (both of the bucket)."""
    rows = units(docs, id_col, text_col)
    over = (F.col("bytes") > byte_limit) & (F.col("docs") > 1)
    columns = ["doc_id", "shard", "page", "depth", "n_bytes", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs")]
    out = None
    for to, ended in directory(rows, byte_limit, spare_bits):
        placed = rows.withColumn("cell", _prefix(F.col("hash"), BITS, F.lit(to))).join(ended.drop("prefix").hint("merge"), "cell")
        placed = placed.withColumn("shard", F.expr("substring(lpad(bin(hash), 60, '0'), 1, depth)"))
        parts = [placed.where(~over).withColumn("page", F.lit(0).cast("bigint"))]
        if not ended.where(over).isEmpty():
            parts.append(_paged(placed.where(over), byte_limit))
        for part in parts:
            part = part.select(columns)
            out = part if out is None else out.unionByName(part)
    return out


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's shard of at most BYTE_LIMIT bytes."""
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_shard": op5_shard}
ORACLES = {
    "op5_shard": f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 15) AS BIGINT) AS h FROM documents),
p AS (SELECT *, unnest(range(0, {BITS + 1})) AS depth FROM d),
s AS (SELECT *, h >> CAST({BITS} - depth AS BIGINT) AS prefix FROM p),
b AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs FROM s GROUP BY ALL
      HAVING sum(n_bytes) <= {BYTE_LIMIT} OR count(*) = 1 OR depth = {BITS}),
m AS (SELECT doc_id, n_bytes, h, depth, shard_bytes, shard_docs FROM s JOIN b USING (depth, prefix)
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1)
SELECT doc_id, substr(lpad(bin(h), {BITS}, '0'), 1, CAST(depth AS INT)) AS shard, CAST(0 AS BIGINT) AS page,
       CAST(depth AS INT) AS depth, n_bytes, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs
FROM m
"""
}
