"""Training pairs, pair features, the classifier, and match lists."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspan.functions import similarity as S
from linkspan.functions import text as T
from linkspan.operators import boosting
from linkspan.operators.keys import keyed
from linkspan.sources.shared import ship, written

FEATURES = (
    "name_ratio", "name_partial_ratio", "name_token_sort_ratio", "name_token_set_ratio",
    "addr_ratio", "addr_token_sort_ratio", "country_exact_match",
)
_FIELDS = ("business_name", "business_address", "country")


def truth_pairs(truth: DataFrame) -> DataFrame:
    """s1_id, cand_id of every listed identifier."""
    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(T.parse_ids(F.col("matched_entity_ids"))).alias("cand_id"))


def positive_pairs(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Truth pairs whose candidate exists."""
    return truth_pairs(truth).join(candidates.select(F.col("entity_id").alias("cand_id")), "cand_id", "left_semi").select("s1_id", "cand_id")


def negative_pairs(positives: DataFrame, candidates: DataFrame, ratio: int = 5, seed: int = 42, blocked: DataFrame | None = None) -> DataFrame:
    """Up to `ratio` pairs for each positive that aren't positive and don't repeat.

    Uniform draws over all candidates: twice as many as are wanted and a few, and for
    entities that these leave short, up to 20 tries for each wanted pair. Or, where
    `blocked` has (s1_id, cand_id, rank), the best-ranked wrong candidates."""
    wanted = positives.groupBy("s1_id").agg((F.count("*") * ratio).alias("wanted"))

    def fresh(pool):
        out = pool.join(positives.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
        return out.groupBy("s1_id", "cand_id", "wanted").agg(F.min("rank").alias("rank"))

    def chosen(once):
        order = F.row_number().over(Window.partitionBy("s1_id").orderBy("rank", "cand_id"))
        return once.withColumn("n", order).where(F.col("n") <= F.col("wanted")).select("s1_id", "cand_id")

    if blocked is None:
        candidates = candidates.select("entity_id").where("entity_id IS NOT NULL").distinct()
        n = candidates.count()
        spot = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = max(1, n // 100_000)
        dealt = candidates.select(F.col("entity_id").alias("cand_id"), F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).alias("bucket"))
        sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size"))
        starts = sizes.select("bucket", F.coalesce(F.sum("size").over(spot), F.lit(0)).alias("start"))
        inside = F.row_number().over(Window.partitionBy("bucket").orderBy("cand_id")) - 1
        numbered = dealt.withColumn("at", inside).join(starts, "bucket").select("cand_id", (F.col("start") + F.col("at")).alias("spot"))

        def drawn(whose, first, last):
            tries = whose.select("s1_id", "wanted", F.explode(F.sequence(first, last)).alias("try"))
            spots = tries.withColumn("spot", F.pmod(F.xxhash64("s1_id", "try", F.lit(seed)), F.lit(max(1, n))))
            return spots.join(numbered, "spot").select("s1_id", "cand_id", "wanted", F.col("try").alias("rank"))

        few = 2 * F.col("wanted") + 8
        found = written(fresh(drawn(wanted, F.lit(0).cast("bigint"), few)), "drawn")
        enough = found.groupBy("s1_id").agg(F.count("*").alias("have")).join(wanted, "s1_id").where("have >= wanted").select("s1_id")
        short = written(wanted.join(enough, "s1_id", "left_anti"), "short")
        if short.isEmpty():
            return chosen(found)
        more = fresh(drawn(short, few + 1, F.greatest(few + 1, 20 * F.col("wanted"))))
        both = found.unionByName(more).groupBy("s1_id", "cand_id", "wanted").agg(F.min("rank").alias("rank"))
        return chosen(both)
    return chosen(fresh(blocked.select("s1_id", "cand_id", "rank").join(wanted, "s1_id")))


def training_pairs(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    return positives.select("s1_id", "cand_id", F.lit(1).alias("label")).unionByName(negatives.select("s1_id", "cand_id", F.lit(0).alias("label")))


def pair_features(pairs: DataFrame, source1: DataFrame, candidates: DataFrame, parity_nan: bool = False, how: str = "inner") -> DataFrame:
    """pairs with the seven features. A pair's first record may be missing (all fields
    blank); pairs whose candidate is missing go, or stay blank with how='left'.
    parity_nan: a missing field becomes the text nan instead of blank. Of records that
    repeat an identifier the last one counts, so a pair has one row of features."""
    blank = F.lit("nan" if parity_nan else "")
    ship(pairs.sparkSession)

    def side(frame, key, mark):
        return keyed(frame.select("entity_id", *_FIELDS)).select(F.col("entity_id").alias(key), *(F.coalesce(F.nullif(F.col(c), F.lit("")), blank).alias(mark + c) for c in _FIELDS))

    both = pairs.join(side(source1, "s1_id", "a_"), "s1_id", "left").join(side(candidates, "cand_id", "b_"), "cand_id", how)
    both = both.na.fill("", [m + c for m in ("a_", "b_") for c in _FIELDS])
    a, b = F.col("a_business_name"), F.col("b_business_name")
    x, y = F.col("a_business_address"), F.col("b_business_address")
    same = (F.lower("a_country") == F.lower("b_country")) & (F.col("a_country") != "")
    scored = both.withColumn("_ratios", S.ratios(a, b, x, y))
    return scored.select(*pairs.columns, *(F.col(f"_ratios.{f}") for f in FEATURES[:-1]), F.when(same, 1.0).otherwise(0.0).alias("country_exact_match"))


def class_weight(pairs: DataFrame) -> DataFrame:
    """n_pos, n_neg, weight: negatives for each positive, 1 without positives."""
    sums = pairs.agg(F.coalesce(F.sum("label"), F.lit(0)).cast("bigint").alias("n_pos"), F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).cast("bigint").alias("n_neg"))
    return sums.withColumn("weight", F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(1.0))


def fit(features: DataFrame, trees: int = 300, depth: int = 6, rate: float = 0.05, seed: int = 42, most_cells: int = 1 << 22) -> PipelineModel:
    """Gradient-boosted trees with the positives weighed up to the negatives, on the counts
    of all rows by binned features; where these are more than most_cells, on the rows."""
    weight = float(class_weight(features).first().weight)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    cuts = boosting.borders(features, FEATURES)
    counted = written(boosting.cells(features, FEATURES, cuts), "cells")
    if 0 < counted.count() <= most_cells:
        table = counted.orderBy("code", "label").toPandas()  # most_cells rows of three numbers at most
        code = table["code"].to_numpy()
        bins = np.stack([(code >> (boosting.BITS * k)) & (boosting.BINS - 1) for k in range(len(FEATURES))])
        grown, _ = boosting.boost(bins, table["label"].to_numpy(), table["n"].to_numpy(), weight, trees, depth, rate, seed)
        return PipelineModel([assembler, boosting.spark_model(features.sparkSession, grown, cuts, rate)])
    rows = features.withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0))
    trees_ = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed,
    )
    return Pipeline(stages=[assembler, trees_]).fit(rows)


def score(features: DataFrame, model: PipelineModel) -> DataFrame:
    """s1_id, cand_id, score."""
    return model.transform(features).select("s1_id", "cand_id", vector_to_array("probability")[1].alias("score"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Fails with the path in the message if there is no model."""
    try:
        return PipelineModel.load(path)
    except Exception as error:
        raise FileNotFoundError(f"no model can be read at {path}; train one first") from error


def matched(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.where(F.col("score") >= threshold)


def match_lists(source1: DataFrame, matches: DataFrame) -> DataFrame:
    """One row for each distinct row of source1: its matches, best first, without repeats."""
    best = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "cand_id"))), lambda x: x["cand_id"])
    lists = matches.groupBy("s1_id").agg(T.format_ids(F.array_distinct(best)).alias("ids"))
    rows = source1.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    return rows.join(lists, F.col("source1_entity_id") == F.col("s1_id"), "left").select("source1_entity_id", F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))
