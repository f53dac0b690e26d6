"""What the corpus operators share: reading tables, rows to keep, patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.sources.shared import delete, dropped, shared_folder, ship, written

#: Words are runs of anything but the ASCII blanks (fixed by the query contracts).
BLANKS = "\\x20\\x09-\\x0D"
WORD = f"[^{BLANKS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_that_stay(docs: DataFrame, stays: DataFrame, id_col: str, key) -> DataFrame:
    """The rows of docs that `stays` (stay_id, stay_key, ties: a written table with
    one row for each row to keep) names by identifier and key of the text. Where
    ties says that several rows look alike, one of them is returned."""
    mark = stays.select("stay_id", "stay_key", "ties").withColumnsRenamed({"stay_id": "_stay_id", "stay_key": "_stay_key", "ties": "_stay_ties"})
    joined = docs.join(mark, F.col(id_col).cast("bigint").eqNullSafe(F.col("_stay_id")) & (key == F.col("_stay_key")))
    if stays.where("ties > 1").isEmpty():
        return joined.select(docs.columns)
    alone = joined.where("_stay_ties = 1").select(docs.columns)
    repeated = joined.where("_stay_ties > 1").dropDuplicates(["_stay_id", "_stay_key"]).select(docs.columns)
    return alone.unionByName(repeated)


def released() -> None:
    """Give memory that Arrow and the C library keep for later back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it


def releasing(run):
    """run (batches to batches), whose task leaves no unused memory in its worker: workers
    are kept, so what one stage holds would add to the next one's."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            released()

    return task


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


__all__ = ["BLANKS", "WORD", "delete", "dropped", "released", "releasing", "rows_that_stay", "shared_folder", "ship", "table", "text_or_empty", "written"]
