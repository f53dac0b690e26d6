"""Profiles of source and truth tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.functions import text as T
from linkspan.functions.similarity import jaccard


def sample_truth(truth: DataFrame, n: int = 5000, seed: int = 42) -> DataFrame:
    """At most n rows of truth, by a hash of the entity: the same ones in every run."""
    key = truth.columns[0]
    return truth.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def missing_pct(df: DataFrame) -> DataFrame:
    """column_name, pct (two digits), warn (over 5 %), by one pass over the table."""
    sums = df.agg(F.count("*").alias("_n"), *(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns))
    rows = sums.unpivot("_n", df.columns, "column_name", "nulls")
    pct = F.when(F.col("_n") > 0, F.round(100.0 * F.col("nulls") / F.col("_n"), 2)).otherwise(0.0)
    return rows.select("column_name", pct.alias("pct")).withColumn("warn", F.col("pct") > 5)


def match_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("s1_id").agg(F.count("*").alias("cnt"))


def match_count_histogram(pairs: DataFrame, first: int = 20, width: int = 30) -> DataFrame:
    """cnt, n_entities, bar (its length) of the smallest counts."""
    rows = match_counts(pairs).groupBy("cnt").agg(F.count("*").alias("n_entities")).orderBy("cnt").limit(first)
    most = rows.agg(F.max("n_entities").alias("most"))
    return rows.crossJoin(most).select("cnt", "n_entities", F.least(F.floor(F.col("n_entities") / F.col("most") * width), F.lit(width)).cast("bigint").alias("bar"))


def match_count_stats(pairs: DataFrame) -> DataFrame:
    return match_counts(pairs).agg(F.max("cnt").alias("max_cnt"), F.avg("cnt").alias("mean_cnt"), F.percentile("cnt", 0.5).alias("median_cnt"))


def singletons(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """n_total, n_matched, n_single, pct_single of the entities of truth."""
    total = truth.agg(F.count_distinct("source1_entity_id").alias("n_total"))
    both = total.crossJoin(pairs.agg(F.count_distinct("s1_id").alias("n_matched")))
    rest = F.col("n_total") - F.col("n_matched")
    return both.select("n_total", "n_matched", rest.alias("n_single"), F.when(F.col("n_total") > 0, F.round(100.0 * rest / F.col("n_total"), 2)).otherwise(0.0).alias("pct_single"))


def value_counts(df: DataFrame, column: str, top: int = 15) -> DataFrame:
    """value (null too), n, pct: the most frequent ones, ties by value."""
    total = df.agg(F.count("*").alias("total"))
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.col("value").asc_nulls_last()).limit(top).crossJoin(total).select("value", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


def length_stats(df: DataFrame, column: str) -> DataFrame:
    size = F.length(column)
    return df.agg(*(f(size).cast("double").alias(n) for n, f in (("mean_len", F.avg), ("median_len", lambda c: F.percentile(c, 0.5)), ("min_len", F.min), ("max_len", F.max), ("std_len", F.stddev_samp))))


def token_stats(df: DataFrame, column: str) -> DataFrame:
    size = F.when(F.col(column).isNotNull(), F.size(T.words(F.col(column))))
    return df.agg(F.avg(size).alias("mean_tokens"), F.percentile(size, 0.5).alias("median_tokens"), F.max(size).cast("bigint").alias("max_tokens"))


def noise(pairs: DataFrame, source1: DataFrame, candidates: DataFrame) -> DataFrame:
    """Word overlap of the names and equality of the countries of true pairs."""
    a = source1.select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("n1"), F.col("country").alias("c1"))
    b = candidates.select(F.col("entity_id").alias("cand_id"), F.col("business_name").alias("n2"), F.col("country").alias("c2"))
    c1, c2 = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("c1", "c2"))
    rows = pairs.join(a, "s1_id").join(b, "cand_id").select(jaccard(F.col("n1"), F.col("n2")).alias("j"), ((c1 == c2) & (c1 != "")).alias("same"))
    share = lambda c: F.round(100.0 * F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return rows.agg(
        F.count("*").alias("n_pairs"), F.round(F.avg("j"), 6).alias("mean_jaccard"), F.round(F.percentile("j", 0.5), 6).alias("median_jaccard"),
        share(F.col("j") < 0.2).alias("pct_low"), share(F.col("j") == 1.0).alias("pct_equal"), share(F.col("same")).alias("pct_same_country"),
    )


def non_ascii(df: DataFrame, column: str, shown: int = 3) -> DataFrame:
    """n_rows, n_non_ascii, pct, examples (the first ones in order, cut to 80 characters)."""
    hit = T.has_non_ascii(F.col(column))
    sums = df.agg(F.count("*").alias("n_rows"), F.count(F.when(hit, 1)).alias("n_non_ascii"))
    first = df.where(hit).select(F.substring(column, 1, 80).alias("x")).distinct().orderBy("x").limit(shown)
    examples = first.agg(F.array_join(F.sort_array(F.collect_list("x")), " | ").alias("examples"))
    return sums.crossJoin(examples).select("n_rows", "n_non_ascii", F.when(F.col("n_rows") > 0, F.round(100.0 * F.col("n_non_ascii") / F.col("n_rows"), 2)).otherwise(0.0).alias("pct"), "examples")


def records(df: DataFrame, n: int = 3, width: int = 100) -> DataFrame:
    """The first n rows by their first column, every value cut to `width` characters."""
    return df.orderBy(df.columns[0]).limit(n).select(*(F.substring(F.col(c).cast("string"), 1, width).alias(c) for c in df.columns))
