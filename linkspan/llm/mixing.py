"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A document of a source with target T and size S is wanted T / S times: floor(T / S)
copies for sure, and the rest is a probability. Probabilities are rounded in
pairs: mass (probability times size) moves from one document to the other, in a
direction drawn so that both expectations hold, until one of the two is 0 or 1.
The pair's words never change, so at most one document of a group stays undecided
and carries the group's whole residue. Groups of about `fan_in` documents are
folded where they are (array expressions), their residues meet in groups of
`fan_in` again, and so on (large documents first, so that a small one is left): a reduction tree, in which a source that holds a third
of all rows is cut into as many groups as it needs. Rows that repeat one another
are counted first and then numbered, so a row that makes up a third of the corpus
is spread over groups like any other. The last residue of a source
goes to the nearer side: the words a source gives are within half a document of
its target.

Targets: sources in code point order, null last, have the weights WEIGHTS,
repeating; together they get `share` of all words; a target stops at `most` times
its source, and what is over goes to the others by weight (one pass over the
sources in the order in which they reach that bound gives the final level).

Groups and draws depend on identifiers, texts and the seed alone, so reruns agree
whatever the partitioning. Edge cases: null text has size 0; a text
without words has nothing to round and is taken floor(T / S) times; null is a source of its own; rows that repeat one
another are rounded one by one (in `mix`, the copies of such rows are added up);
a null identifier counts as a value; an empty table gives no rows; extra columns
are ignored by `decisions` and kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

WEIGHTS = (5, 2, 1)
FAN_IN = 256
#: Rows that repeat one another are numbered in blocks of so many.
SAME_ROWS = 4096
#: Sources whose statistics are sent to every task; with more, Spark chooses the join.
SENT_SOURCES = 10_000

_ITEM = "struct<size:bigint,leaf:string,p:double,row:struct<doc_id:bigint,tie:bigint,copies:int>>"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, tie (a hash of the text) of every document, as a written table."""
    text = text_or_empty(text_col)
    return written(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")).cast("bigint").alias("size"),
            F.xxhash64(text).alias("tie"),
        ),
        "sizes",
    )


def targets(units: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """source, source_size, target, n_docs: one row a source, as a written table."""
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    weighed = sums.withColumn("weight", weight).withColumn("bound", most * F.col("source_size")).withColumn("level", F.col("bound") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    levels = weighed.withColumn("water", left / F.sum("weight").over(after)).withColumn("rank", F.row_number().over(order))
    final = F.min(F.when(F.col("water") <= F.col("level"), F.struct("rank", "water"))).over(whole)
    target = F.least(F.col("bound"), F.col("weight") * F.coalesce(final["water"], F.lit(float("inf"))))
    return written(levels.select("source", "source_size", target.alias("target"), "n_docs"), "targets")


_DRAW = "(pmod(xxhash64(acc.held.leaf, x.leaf, {seed}L), 9007199254740992L) / 9007199254740992D)"

#: One step of a fold: acc = (held: the undecided item or null, done: decided items).
_STEP = """
CASE
  WHEN x.p <= 0D OR x.p >= 1D OR x.size = 0 THEN
    named_struct('held', acc.held, 'done', concat(acc.done, array(named_struct('leaf', x.leaf, 'extra', IF(x.p >= 1D AND x.size > 0, 1, 0), 'size', x.size, 'row', x.row))))
  WHEN acc.held IS NULL THEN named_struct('held', x, 'done', acc.done)
  ELSE element_at(transform(array(named_struct(
      'ratio', CAST(x.size AS DOUBLE) / acc.held.size,
      'up', least(1D - acc.held.p, x.p * x.size / acc.held.size),
      'down', least(acc.held.p, (1D - x.p) * x.size / acc.held.size),
      'draw', {draw})),
    m -> element_at(transform(array(IF(m.draw * (m.up + m.down) < m.down,
        named_struct('h', IF(m.up >= 1D - acc.held.p, 1D, acc.held.p + m.up),
                     'x', IF(m.up >= 1D - acc.held.p AND x.p * m.ratio > m.up, x.p - m.up / m.ratio, 0D)),
        named_struct('h', IF(m.down >= acc.held.p, 0D, acc.held.p - m.down),
                     'x', IF(m.down >= acc.held.p AND (1D - x.p) * m.ratio > m.down, x.p + m.down / m.ratio, 1D)))),
      t -> named_struct(
        'held', CASE WHEN t.h > 0D AND t.h < 1D THEN named_struct('size', acc.held.size, 'leaf', acc.held.leaf, 'p', t.h, 'row', acc.held.row)
                     WHEN t.x > 0D AND t.x < 1D THEN named_struct('size', x.size, 'leaf', x.leaf, 'p', t.x, 'row', x.row) END,
        'done', concat(acc.done,
          IF(t.h > 0D AND t.h < 1D, array(), array(named_struct('leaf', acc.held.leaf, 'extra', CAST(t.h AS INT), 'size', acc.held.size, 'row', acc.held.row))),
          IF(t.x > 0D AND t.x < 1D, array(), array(named_struct('leaf', x.leaf, 'extra', CAST(t.x AS INT), 'size', x.size, 'row', x.row)))))), 1)), 1)
END
"""  # fmt: skip


def _folded(groups: DataFrame, seed: int) -> DataFrame:
    """groups (keys..., items: array of _ITEM) with items replaced by held and done."""
    done = "array<struct<leaf:string,extra:int,size:bigint,row:struct<doc_id:bigint,tie:bigint,copies:int>>>"
    start = f"named_struct('held', CAST(NULL AS {_ITEM}), 'done', CAST(array() AS {done}))"
    step = " ".join(_STEP.format(draw=_DRAW.format(seed=seed)).split())
    fold = F.expr(f"aggregate(items, {start}, (acc, x) -> CAST({step} AS struct<held:{_ITEM},done:{done}>))")
    return groups.withColumn("f", fold).select(*(c for c in groups.columns if c != "items"), "f.held", "f.done")


def _numbered(units: DataFrame) -> DataFrame:
    """units with a number (copy) that tells rows apart that repeat one another."""
    same = written(units.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("n")), "same")
    last = F.col("n") - 1
    if (same.agg(F.max("n")).first()[0] or 0) <= SAME_ROWS:
        return same.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop("n")
    blocks = same.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / SAME_ROWS))))
    first = F.col("block") * SAME_ROWS
    dealt = blocks.repartition("doc_id", "tie", "block")  # the blocks of a hot row go to all tasks
    return dealt.withColumn("copy", F.explode(F.sequence(first, F.least(last, first + SAME_ROWS - 1)))).drop("n", "block")


def decisions(units: DataFrame, goals: DataFrame, seed: int = 42, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, tie, size, source, copies of every row of units (a written table)."""
    n_sources = goals.count()
    goal = goals.select(
        F.col("source").alias("g_source"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("wanted"),
        F.ceil(F.col("n_docs") / fan_in).cast("bigint").alias("chunks"),
    )
    if n_sources <= SENT_SOURCES:
        goal = F.broadcast(goal)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "tie", "copy", F.lit(seed).cast("bigint"))
    rows = _numbered(units).join(goal, F.col("source").eqNullSafe(F.col("g_source"))).withColumn("key", key).withColumn("chunk", F.pmod("key", "chunks"))
    item = F.struct(
        F.col("size"), F.concat_ws("/", F.hex("key"), F.col("chunk").cast("string")).alias("leaf"),
        (F.col("wanted") - F.floor("wanted")).alias("p"),
        F.struct("doc_id", "tie", F.floor("wanted").cast("int").alias("copies")).alias("row"),
    )
    groups = rows.groupBy("source", "chunk").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    leaves = written(_folded(groups, seed), "leaves")
    decided = leaves.select("source", F.explode("done").alias("d"))
    level = leaves.where("held IS NOT NULL").select("source", "chunk", "held")
    most = goals.agg(F.max(F.ceil(F.col("n_docs") / fan_in))).first()[0] or 0
    while True:
        most = -(-most // fan_in)
        parents = level.withColumn("chunk", F.floor(F.col("chunk") / fan_in))
        groups = parents.groupBy("source", "chunk").agg(F.sort_array(F.collect_list("held"), asc=False).alias("items"))
        up = written(_folded(groups, seed), "level")
        decided = decided.unionByName(up.select("source", F.explode("done").alias("d")))
        level = up.where("held IS NOT NULL").select("source", "chunk", "held")
        if most <= 1:
            break
    last = level.select("source", F.struct("held.leaf", F.when(F.col("held.p") >= 0.5, 1).otherwise(0).alias("extra"), "held.size", "held.row").alias("d"))
    return decided.unionByName(last).select("d.row.doc_id", "d.row.tie", "d.size", "source", (F.col("d.row.copies") + F.col("d.extra")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, **goal) -> DataFrame:
    """docs with every row as often as the mix takes it, columns unchanged."""
    units = sizes(docs, id_col, text_col, source_col)
    taken = written(decisions(units, targets(units, **goal), seed), "taken")
    copies = taken.groupBy("doc_id", "tie", "source").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("ties")).where("copies > 0")
    copies = written(copies, "copies")
    mark = copies.withColumnsRenamed({"doc_id": "_m_id", "tie": "_m_tie", "source": "_m_source", "copies": "_m_copies", "ties": "_m_ties"})
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("_m_id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("_m_tie")) & F.col(source_col).cast("string").eqNullSafe(F.col("_m_source"))
    joined = docs.join(mark, same)
    if not copies.where("ties > 1").isEmpty():
        alone = joined.where("_m_ties = 1")
        joined = alone.unionByName(joined.where("_m_ties > 1").dropDuplicates(["_m_id", "_m_tie", "_m_source"]))
    again = joined.withColumn("_again", F.explode(F.array_repeat(F.lit(1), F.col("_m_copies"))))
    return again.select(docs.columns)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 150 % of all words, no source or document more than twice."""
    units = sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    goals = targets(units)
    goal = goals.select(F.col("source").alias("g_source"), "source_size", "target")
    if goals.count() <= SENT_SOURCES:
        goal = F.broadcast(goal)
    rows = decisions(units, goals).join(goal, F.col("source").eqNullSafe(F.col("g_source")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op10_mix": op10_mix}
ORACLES: dict[str, str] = {}
