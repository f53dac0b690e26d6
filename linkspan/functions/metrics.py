"""F-beta and the score of one entity's predicted set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    """0 where the denominator is 0."""
    square = float(beta * beta)
    bottom = square * precision + recall
    return F.when(bottom == 0, 0.0).otherwise((1.0 + square) * precision * recall / bottom)


def entity_score(predicted: Column, truth: Column, beta: float = 0.5) -> Column:
    """Both sets empty: 1; one of them: 0; else F-beta of their overlap."""
    hits = F.size(F.array_intersect(predicted, truth)).cast("double")
    score = f_beta(hits / F.greatest(F.size(predicted), F.lit(1)), hits / F.greatest(F.size(truth), F.lit(1)), beta)
    return (
        F.when((F.size(truth) == 0) & (F.size(predicted) == 0), 1.0)
        .when((F.size(truth) == 0) | (F.size(predicted) == 0), 0.0)
        .otherwise(score)
    )
