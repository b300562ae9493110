"""Models and summaries over streams."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidymesh.models.core import Model


def stream_model(stream: DataFrame, model: Model) -> DataFrame:
    """A model at each row of a stream: its functions are stateless, so a stream runs through them as a table does."""
    return model.apply(stream)


def stream_summary(stream: DataFrame, time: str, width: str, late: str, keys: list[str], **aggregates: Any) -> DataFrame:
    """Summaries by tumbling window and keys; rows later than ``late`` are left out, and with them the state."""
    timed = stream.withWatermark(time, late)
    out = timed.groupBy(F.window(time, width), *(F.col(f"`{k}`") for k in keys)).agg(*(c.alias(k) for k, c in aggregates.items()))
    return out.select(F.col("window.start").alias("start"), *(F.col(f"`{k}`") for k in keys), *(F.col(k) for k in aggregates))
