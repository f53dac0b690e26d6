"""Whole runs over files: candidates, training, matching, validation, profile.

A data folder holds source1.tsv, source2.tsv, source3.tsv and, to train, truth.tsv;
an output folder gets candidates, matches and model. Each step is a function of
paths; a step that fails raises, so nothing runs after it.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.operators import blocking, matching, profile, validation
from linkspan.operators.evaluation import f_beta_grid
from linkspan.operators.keys import keyed
from linkspan.sources import tables
from linkspan.sources.shared import written

log = logging.getLogger("linkspan")
MODES = ("all", "train-only", "predict-only")
CANDIDATES, MATCHES, MODEL = "candidates", "matches", "model"
_EMPTY = {"business_name": "string", "business_address": "string", "country": "string"}


def sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three sources with entity_id and the content columns; a missing column is null."""
    def one(path):
        df = tables.read_tsv(spark, path)
        df = df.withColumnRenamed(tables.key_column(df), "entity_id")
        return df.select("entity_id", *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in _EMPTY.items()))

    return tuple(one(f"{folder}/source{n}.tsv") for n in (1, 2, 3))


def make_candidates(spark: SparkSession, folder: str, out: str, k: int = 15, threshold: float = 0.10) -> None:
    log.info("candidates: reading %s", folder)
    one, two, three = sources(spark, folder)
    found = blocking.generate_candidates(one, two, three, k, threshold)
    tables.write_lists(blocking.candidate_lists(one, found), f"{out}/{CANDIDATES}")
    log.info("candidates: written to %s/%s", out, CANDIDATES)


def train(spark: SparkSession, folder: str, out: str, neg_ratio: int = 5, seed: int = 42, **trees) -> None:
    one, two, three = sources(spark, folder)
    both = keyed(two, three)
    positives = matching.positive_pairs(tables.read_tsv(spark, f"{folder}/truth.tsv", tables.TRUTH_SCHEMA), both)
    pairs = matching.training_pairs(positives, matching.negative_pairs(positives, both, neg_ratio, seed))
    features = written(matching.pair_features(pairs, one, both), "features")  # every tree reads them
    log.info("training: %d pairs", features.count())
    matching.save_model(matching.fit(features, seed=seed, **trees), f"{out}/{MODEL}")
    log.info("training: model written to %s/%s", out, MODEL)


def predict(spark: SparkSession, folder: str, out: str, threshold: float = 0.5) -> None:
    """Scores the written candidates; entities without any get an empty list."""
    model = matching.load_model(f"{out}/{MODEL}")
    one, two, three = sources(spark, folder)
    pairs = tables.read_lists(spark, f"{out}/{CANDIDATES}")
    scores = matching.score(matching.pair_features(pairs, one, keyed(two, three)), model)
    tables.write_lists(matching.match_lists(one, matching.matched(scores, threshold)), f"{out}/{MATCHES}")
    log.info("matching: written to %s/%s", out, MATCHES)


def check(spark: SparkSession, folder: str, out: str, check_ids: bool = False) -> DataFrame:
    targets = [f"{folder}/source{n}.tsv" for n in (2, 3)]
    return validation.validate(spark, f"{out}/{MATCHES}", f"{out}/{CANDIDATES}", f"{folder}/source1.tsv", targets, check_ids)


def run(spark: SparkSession, out: str, train_folder: str | None, test_folder: str | None, mode: str = "all", skip_blocking: bool = False,
        threshold: float = 0.5, neg_ratio: int = 5, k: int = 15, **trees) -> DataFrame | None:
    """The findings of the written matches; None where the mode writes none.

    all: candidates, training, matching, validation. train-only: candidates and
    training. predict-only: matching and validation by a model that is there."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if mode != "predict-only":
        if not skip_blocking:
            make_candidates(spark, test_folder, out, k)
        train(spark, train_folder, out, neg_ratio, **trees)
    if mode == "train-only":
        return None
    predict(spark, test_folder, out, threshold)
    return check(spark, test_folder, out)


def report(spark: SparkSession, folder: str, sample: int = 50_000, out: str | None = None, truth_rows: int | None = None) -> str:
    """The profile of a data folder as Markdown, also written to the folder `out`: sizes
    and counts are of whole files, text statistics of the first `sample` rows, the noise
    of all true pairs or those of truth_rows entities. Only aggregates reach the driver."""
    lines = ["# Profile"]

    def section(title: str, frame: DataFrame) -> None:
        rows = frame.collect()  # aggregates, top lists and three examples
        lines.extend(["", f"## {title}", "", "| " + " | ".join(frame.columns) + " |", "|" + " --- |" * len(frame.columns)])
        lines.extend("| " + " | ".join(str(v).replace("|", "\\|") for v in row) + " |" for row in rows)

    for n in (1, 2, 3):
        path = f"{folder}/source{n}.tsv"
        df = tables.read_tsv(spark, path)
        size = df.agg(F.count("*").alias("n_rows")).withColumn("mb", F.lit(round(tables.file_size_mb(spark, path), 1)))
        section(f"Source {n}", size)
        head = tables.read_sample(spark, path, sample)
        section(f"Source {n}: missing", profile.missing_pct(head))
        for column in (c for c in ("business_name", "business_address") if c in head.columns):
            section(f"Source {n}: {column}", profile.length_stats(head, column).crossJoin(profile.token_stats(head, column)))
            section(f"Source {n}: {column} outside ASCII", profile.non_ascii(head, column))
        if "country" in head.columns:
            section(f"Source {n}: country", profile.value_counts(head, "country"))
        section(f"Source {n}: records", profile.records(head))
    if tables.exists(spark, f"{folder}/truth.tsv"):
        truth = tables.read_tsv(spark, f"{folder}/truth.tsv", tables.TRUTH_SCHEMA)
        one, two, three = sources(spark, folder)
        pairs = matching.truth_pairs(truth)
        section("Matches", profile.match_count_stats(pairs))
        section("Matches: histogram", profile.match_count_histogram(pairs))
        section("Singletons", profile.singletons(truth, pairs))
        some = pairs if truth_rows is None else matching.truth_pairs(profile.sample_truth(truth, truth_rows))
        section("Noise of true pairs", profile.noise(some, one, keyed(two, three)))
    grid = f_beta_grid(spark, [(0.95, 0.9), (0.9, 0.9), (0.8, 0.9), (0.95, 0.7), (0.0, 0.0)])
    section("F0.5 at precision and recall", grid.withColumn("f05", F.round("f05", 4)))
    text = "\n".join(lines) + "\n"
    if out:
        tables.write_report(spark, text, out)
        log.info("profile: written to %s", out)
    return text
