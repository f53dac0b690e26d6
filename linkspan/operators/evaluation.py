"""Hold-out split and macro F-beta."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspan.functions import text as T
from linkspan.functions.metrics import entity_score, f_beta
from linkspan.operators import blocking, matching
from linkspan.operators.keys import keyed
from linkspan.sources.shared import written


def split_truth(truth: DataFrame, val_ratio: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation): disjoint, exhaustive, train has floor(n * (1 - val_ratio)) rows.

    The order is a hash of the identifier. Only the hash at the border is looked up,
    by a distributed sort, so no window gathers the table in one task."""
    keyed = truth.withColumn("_h", F.xxhash64("source1_entity_id", F.lit(seed))).withColumn("_id", F.col("source1_entity_id"))
    n = truth.count()
    size = int(n * (1 - val_ratio))
    if size >= n or size <= 0:
        return (truth, truth.limit(0)) if size >= n else (truth.limit(0), truth)
    border = keyed.select("_h", "_id").orderBy("_h", "_id").offset(size).limit(1).first()
    low = (F.col("_h") < border._h) | ((F.col("_h") == border._h) & (F.col("_id") < border._id))
    return keyed.where(low).drop("_h", "_id"), keyed.where(~low).drop("_h", "_id")


def entity_scores(predicted: DataFrame, truth: DataFrame, beta: float = 0.5) -> DataFrame:
    """s1_id, f05 of every entity of truth; predicted and truth are list tables. Of rows
    that repeat an entity the last one counts; rows without one go."""
    def sets(df, name):
        key, ids = df.columns[:2]
        last = keyed(df.select(key, ids), key=key)
        return last.select(F.col(key).alias("s1_id"), F.array_distinct(T.parse_ids(F.col(ids))).alias(name))

    none = F.array().cast("array<string>")
    rows = sets(truth, "truth").join(sets(predicted, "predicted"), "s1_id", "left")
    return rows.select("s1_id", entity_score(F.coalesce("predicted", none), F.col("truth"), beta).alias("f05"))


def macro(scores: DataFrame) -> DataFrame:
    """macro_f05, n_entities and the number and percentage of scores 1 and 0."""
    sums = scores.agg(
        F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f05"), F.count("*").alias("n_entities"),
        F.count(F.when(F.col("f05") == 1.0, 1)).alias("n_perfect"), F.count(F.when(F.col("f05") == 0.0, 1)).alias("n_zero"),
    )
    share = lambda c: F.when(F.col("n_entities") > 0, 100.0 * F.col(c) / F.col("n_entities")).otherwise(0.0)
    return sums.withColumn("pct_perfect", share("n_perfect")).withColumn("pct_zero", share("n_zero"))


def f_beta_grid(spark, points: list[tuple[float, float]]) -> DataFrame:
    rows = spark.createDataFrame(points, "p double, r double")
    return rows.select("p", "r", f_beta(F.col("p"), F.col("r")).alias("f05"))


def threshold_sweep(scores: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, macro_f05 for each threshold of a short list, in one pass over the scores:
    a pair counts for every threshold that it reaches."""
    spark = truth.sparkSession
    cuts = F.array(*(F.lit(float(t)) for t in thresholds))
    key, ids = truth.columns[:2]
    known = keyed(truth.select(key, ids), key=key).select(F.col(key).alias("s1_id"), F.array_distinct(T.parse_ids(F.col(ids))).alias("truth"))
    best = scores.groupBy("s1_id", "cand_id").agg(F.max("score").alias("score"))
    reached = best.join(known, "s1_id").select("s1_id", F.array_contains("truth", F.col("cand_id")).cast("int").alias("hit"), F.explode(F.filter(cuts, lambda t: t <= F.col("score"))).alias("threshold"))
    found = reached.groupBy("s1_id", "threshold").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    grid = known.select("s1_id", F.size("truth").alias("size"), F.explode(cuts).alias("threshold"))
    rows = grid.join(found, ["s1_id", "threshold"], "left").na.fill(0, ["n", "hits"])
    f = f_beta(F.col("hits") / F.greatest(F.col("n"), F.lit(1)), F.col("hits") / F.greatest(F.col("size"), F.lit(1)))
    f05 = F.when((F.col("size") == 0) & (F.col("n") == 0), 1.0).when((F.col("size") == 0) | (F.col("n") == 0), 0.0).otherwise(f)
    means = rows.groupBy("threshold").agg(F.avg(f05).alias("macro_f05"))
    every = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    return every.join(means, "threshold", "left").select("threshold", F.coalesce("macro_f05", F.lit(0.0)).alias("macro_f05"))


def run_evaluation(source1, source2, source3, truth, val_ratio=0.2, threshold=0.5, neg_ratio=5, seed=42, **trees):
    """(macro, scores by entity): trained on one part of truth, measured on the other."""
    candidates = keyed(source2, source3)
    train, held = split_truth(truth, val_ratio, seed)
    positives = matching.positive_pairs(train, candidates)
    pairs = matching.training_pairs(positives, matching.negative_pairs(positives, candidates, neg_ratio, seed))
    model = matching.fit(written(matching.pair_features(pairs, source1, candidates), "features"), **trees)  # every tree reads them
    val = source1.join(held.select(F.col("source1_entity_id").alias("entity_id")), "entity_id", "left_semi")
    found = blocking.generate_candidates(val, source2, source3)
    scored = matching.score(matching.pair_features(found.select("s1_id", "cand_id"), val, candidates), model)
    scores = entity_scores(matching.match_lists(val, matching.matched(scored, threshold)), held)
    return macro(scores), scores
