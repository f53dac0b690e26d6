"""One row for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyed(*frames: DataFrame, key: str = "entity_id") -> DataFrame:
    """The rows of all frames, one for each key: the last one wins, of a later frame first,
    then by its place in its frame. Rows without a key go. All frames have the same columns."""
    both = None
    for k, frame in enumerate(frames):
        one = frame.where(F.col(key).isNotNull()).withColumn("_place", F.struct(F.lit(k).alias("k"), F.monotonically_increasing_id().alias("row")))
        both = one if both is None else both.unionByName(one)
    rest = [c for c in frames[0].columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest, F.lit(1).alias("_one")), "_place").alias("_last"))
    return last.select(*(F.col(key) if c == key else F.col(f"_last.`{c}`") for c in frames[0].columns))


def first_rows(df: DataFrame, key: str, *order) -> DataFrame:
    """One row of df for each key: the first by order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")
