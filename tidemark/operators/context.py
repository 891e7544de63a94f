"""Row context (a map column), its merging on fan-in, and metrics from ack tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = "_ctx"


def put(context: Column, key: str, value: Column) -> Column:
    """Sets a key unless it is there."""
    own = F.coalesce(context, F.create_map().cast("map<string,string>"))
    return F.when(F.map_contains_key(own, key), own).otherwise(F.map_concat(own, F.create_map(F.lit(key), value.cast("string"))))


def fan_in(df: DataFrame, keys: list[str], order: str, single: list[str] = (), smallest: list[str] = ()) -> DataFrame:
    """Merged context of each batch: of ``single`` keys the first value in order, of ``smallest`` keys the least."""
    value = {k: F.col(CONTEXT)[k] for k in [*single, *smallest]}
    aggs = [F.min_by(value[k], F.when(value[k].isNotNull(), F.col(order))).alias(k) for k in single]
    aggs += [F.min(value[k]).alias(k) for k in smallest]
    return df.groupBy(*keys).agg(*aggs)


def trace_links(df: DataFrame, keys: list[str], trace: str = "trace_id") -> DataFrame:
    """Traces that a batch's span links to."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col(CONTEXT)[trace])).alias("links"))


def settle_durations(df: DataFrame, keys: list[str], received: Column, settled: Column, status: str) -> DataFrame:
    """Count, mean and quantiles of the seconds from reception to settlement, by result."""
    seconds = (F.unix_micros(settled.cast("timestamp")) - F.unix_micros(received.cast("timestamp"))) / 1e6
    result = F.when(F.col(status) == "ack", "success").otherwise("failure")
    return df.withColumn("result", result).withColumn("_s", seconds).groupBy(*keys, "result").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_s"), 6).alias("mean_s"), F.max("_s").alias("max_s"), F.percentile_approx("_s", [0.5, 0.99], 10_000).alias("quantiles"))


class AuditedMetrics:
    """One value for each metric key, owned by whoever registered last."""

    def __init__(self, default: float = float("nan")):
        self.default, self._of = default, {}

    def register(self, owner: object, key: str, value) -> None:
        self._of[key] = (owner, value)

    def unregister(self, owner: object, key: str) -> bool:
        if key in self._of and self._of[key][0] is owner:
            del self._of[key]
            return True
        return False

    def read(self, key: str) -> float:
        return self._of[key][1]() if key in self._of else self.default


def latest_metrics(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The same over a table of registrations."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))
