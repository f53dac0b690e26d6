"""Reading and writing the TSV tables, lists, raw lines and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspan.functions import text as T

#: Field values that count as missing (fixed values).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
SOURCE_SCHEMA = "entity_id string, business_name string, business_address string, country string"
TRUTH_SCHEMA = "source1_entity_id string, matched_entity_ids string"
CANDIDATE_SCHEMA = "source1_entity_id string, candidate_entity_ids string"


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, na_tokens: bool = True, tolerant: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """A tab-separated table with a header. The header is read and columns are matched
    by name; schema only names the columns that must be there. tolerant drops bad rows."""
    reader = spark.read.option("sep", "\t").option("header", True).option("encoding", encoding)
    df = reader.option("mode", "DROPMALFORMED" if tolerant else "PERMISSIVE").csv(path)
    missing = [c.split()[0] for c in (schema or "").split(",") if c.strip() and c.split()[0] not in df.columns]
    if missing and not tolerant:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    if not na_tokens:
        return df
    return df.select(*(F.when(F.col(f"`{c}`").isin(*NA_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns))


def encoding_of(spark: SparkSession, path: str, n: int | None = None) -> str:
    """UTF-8, or ISO-8859-1 if one of the lines (of the first n) isn't valid UTF-8."""
    lines = spark.read.text(path)
    lines = lines if n is None else lines.limit(n)
    return "UTF-8" if lines.where(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"


def read_full(spark: SparkSession, path: str) -> DataFrame:
    """All rows in the encoding that the file has, bad rows skipped."""
    return read_tsv(spark, path, tolerant=True, encoding=encoding_of(spark, path))


def read_sample(spark: SparkSession, path: str, n: int = 50_000) -> DataFrame:
    """The first n rows in the encoding that they have, bad rows skipped."""
    return read_tsv(spark, path, tolerant=True, encoding=encoding_of(spark, path, n + 1)).limit(n)


def key_column(df: DataFrame) -> str:
    return "entity_id" if "entity_id" in df.columns else df.columns[0]


def file_size_mb(spark: SparkSession, path: str) -> float:
    files = spark.read.format("binaryFile").load(path).select("length")
    return (files.agg(F.sum("length")).first()[0] or 0) / 1024**2


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1, the header) and value. Numbers come from the position in the file,
    of several files in the order of their paths; only the splits are put in order."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    bases = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return lines.join(bases, ["file", "block"]).select((F.col("base") + F.col("at") + 1).alias("line_no"), "value")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first columns below the header, trimmed, blank ones skipped."""
    header = spark.read.text(path).first()
    rows = spark.read.text(path).where(F.col("value") != (header.value if header else ""))
    ids = rows.select(F.trim(F.split_part("value", F.lit("\t"), F.lit(1))).alias("id"))
    return ids.where("id <> ''").distinct()


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def read_targets(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """The identifiers of all files, or None and a warning for each file that is missing."""
    missing = [f"{p} is missing, identifiers are not checked" for p in paths if not exists(spark, p)]
    if missing:
        return None, missing
    out = read_ids(spark, paths[0])
    for path in paths[1:]:
        out = out.unionByName(read_ids(spark, path))
    return out.distinct(), []


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """s1_id, cand_id of a list file; rows with an empty list give nothing."""
    df = read_tsv(spark, path)
    key, ids = df.columns[:2]
    return df.select(F.col(key).alias("s1_id"), F.explode(T.parse_ids(F.col(ids))).alias("cand_id"))


def write_lists(df: DataFrame, path: str) -> None:
    """A list table as TSV without quoting; an empty list is an empty field."""
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", True)
    writer.option("emptyValue", "").option("nullValue", "").option("quote", "\u0000").csv(path)


def write_report(spark: SparkSession, text: str, path: str) -> None:
    """A report as lines of one text file in the folder path."""
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "place int, line string")
    lines.coalesce(1).sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file with these bytes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content))
    out.close()
