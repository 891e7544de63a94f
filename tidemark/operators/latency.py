"""Quantiles of durations from sketches that merge: raw rows are read once, roll-ups read sketches.

A KLL sketch (Spark's ``kll_*`` functions) of size ``k`` gives a value whose rank is off by at most
``rank_error(k)`` of the rows, with a probability of 0.99, whatever their number and order, and merged
sketches as if their rows had been one table. Its size grows with the logarithm of the rows.

Cases. Rows without a reception or settlement have no duration and are left out; a group of only
such rows has no sketch. No rows give no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 400
SKETCH = "sketch"


def rank_error(k: int = K) -> float:
    """Of the ranks, as a share of the rows. The constants are the published fit for these sketches."""
    return 2.296 / k**0.9021


def seconds(received: Column, settled: Column) -> Column:
    return (F.unix_micros(settled.cast("timestamp")) - F.unix_micros(received.cast("timestamp"))) / 1e6


def sketches(df: DataFrame, keys: list[str | Column], duration: Column, k: int = K) -> DataFrame:
    """For each group a sketch with its rows, sum and largest value; sketched before the shuffle."""
    rows = df.withColumn("_s", duration.cast("double")).where(F.col("_s").isNotNull() & ~F.isnan("_s"))
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double("_s", k).alias(SKETCH), F.count(F.lit(1)).alias("n"), F.sum("_s").alias("sum_s"), F.max("_s").alias("max_s"))


def rolled_up(found: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Sketches of coarser groups from finer ones, without their rows."""
    return found.groupBy(*keys).agg(F.kll_merge_agg_double(SKETCH).alias(SKETCH), F.sum("n").alias("n"), F.sum("sum_s").alias("sum_s"), F.max("max_s").alias("max_s"))


def quantiles(found: DataFrame, **fractions: float) -> DataFrame:
    """Adds a column for each of ``fractions``."""
    return found.withColumns({name: F.kll_sketch_get_quantile_double(SKETCH, F.lit(float(q))) for name, q in fractions.items()})
