"""Stateless operators on a stream of ratings.

The reference has no streaming code; its stateless per-rating operators apply to
a Structured Streaming source unchanged. ``score_stream`` joins each micro-batch
of ratings with static factor tables (a stream-static join) and predicts with the
J8 formula; ``binarize_stream`` is P6. No state, watermark or window is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from warmstart.operators.factors import predict
from warmstart.operators.filters import binarize


def score_stream(ratings_stream: DataFrame, users: DataFrame, items: DataFrame, mu: float,
                 user: str = "user_id", item: str = "item_id") -> DataFrame:
    """``est = mu + bu + bi + pu . qi`` for every streamed rating (inner stream-static joins)."""
    return predict(ratings_stream, users, items, mu, user, item).drop("pu", "qi")


def binarize_stream(ratings_stream: DataFrame, threshold: float = 0.0) -> DataFrame:
    """P6 on a stream."""
    return binarize(ratings_stream, threshold)
