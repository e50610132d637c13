"""Aggregates for SQL: ``register_aggregates(spark)`` makes ``rank_ic(pred, truth)``,
``pinball(q, pred, truth)`` and ``profit_factor(ret)`` known, for use with GROUP BY.

A group comes to one task in one Arrow batch: they are for groups like a date or a node of some
million rows at most. The DataFrame forms in ``operators`` aggregate partially and have no such limit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import PandasUDFType, pandas_udf
from pyspark.sql.types import DoubleType

MIN_NAMES = 8


def rank_ic(pred, truth):
    """Correlation of average ranks over rows where both are there; null under ``MIN_NAMES`` rows or
    if either has one value only."""
    ok = pred.notna() & truth.notna()
    if ok.sum() < MIN_NAMES:
        return None
    a, b = pred[ok].rank(), truth[ok].rank()
    if a.nunique() < 2 or b.nunique() < 2:
        return None
    return float(np.corrcoef(a, b)[0, 1])


def pinball(q, pred, truth):
    """The mean quantile loss at q (one value a group) over rows where all are there."""
    e = truth - pred
    loss = np.maximum(q * e, (q - 1) * e).dropna()
    return float(loss.mean()) if len(loss) else None


def profit_factor(ret):
    """Gains over losses; null without a loss."""
    lost = -ret[ret < 0].sum()
    return float(ret[ret > 0].sum() / lost) if lost > 0 else None


def register_aggregates(spark: SparkSession) -> None:
    """Make the aggregates known to the session."""
    for f in (rank_ic, pinball, profit_factor):
        spark.udf.register(f.__name__, pandas_udf(f, DoubleType(), PandasUDFType.GROUPED_AGG))
