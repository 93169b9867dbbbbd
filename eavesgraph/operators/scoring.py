"""Scores from any trained model, applied to batches of rows or to whole frames."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def score_batches(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a function of independent rows to Arrow batches; it returns rows of ``schema``."""

    def run(batches):
        for b in batches:
            yield model(b)

    return df.mapInPandas(run, schema)


def score_frames(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Apply a function that needs all rows of a frame; a frame, or a cluster of one, must fit one task."""
    return df.groupBy(*keys).applyInPandas(model, schema)
