"""Poll selection, priorities, throughput and start/stop signals, as data."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.collecting import binary_strides, greatest_with_ties, take_until
from tidemark.operators.scans import last_known, neighbour, running

UNKNOWN_LAG = (1 << 63) - 1


def stride_plan(spark: SparkSession, partitions: list[int]) -> DataFrame:
    """(cycle, partition) of the stride cycle; partitions are few, so the driver lists them."""
    return spark.createDataFrame([(c, p) for c, ps in enumerate(binary_strides(sorted(partitions))) for p in ps], "cycle int, partition int")


def natural(lags: DataFrame) -> DataFrame:
    return lags


def greatest_batch_lag(lags: DataFrame, lag: str, max_poll: int) -> DataFrame:
    """Partitions with the most whole batches behind, ties kept; unknown lag is the greatest."""
    batches = F.when(F.col(lag).isNull(), F.lit(UNKNOWN_LAG)).otherwise(F.floor(F.col(lag) / max_poll)).cast("long")
    rows = lags.withColumn("batch_lag", batches)
    top = rows.agg(F.max("batch_lag").alias("_top"))
    return rows.join(top, F.col("batch_lag") == F.col("_top"), "left_semi")


def priority_cutoff(lags: DataFrame, priority: list[str], lag: str, threshold: int) -> DataFrame:
    """In order of priority the partitions up to the first that lags by ``threshold``, that one included."""
    w = Window.orderBy(*priority).rowsBetween(Window.unboundedPreceding, -1)
    return lags.withColumn("_hit", F.coalesce(F.sum((F.coalesce(F.col(lag), F.lit(UNKNOWN_LAG)) >= threshold).cast("int")).over(w), F.lit(0))).where("_hit = 0").drop("_hit")


def select_polls(partitions: list, lag_of: Callable, strategy: str, cycle: int = 0, max_poll: int = 1, threshold: int = 0) -> list:
    """The same choices for a driver that polls."""
    if strategy == "binary_strides":
        plan = binary_strides(sorted(partitions))
        return plan[cycle % len(plan)]
    if strategy == "greatest_batch_lag":
        return greatest_with_ties(partitions, lambda p: UNKNOWN_LAG if lag_of(p) is None else lag_of(p) // max_poll)
    if strategy == "priority_cutoff":
        return take_until(partitions, lambda p: lag_of(p) is None or lag_of(p) >= threshold)
    return list(partitions)


def merge_priority(df: DataFrame, priority: Column, batch: list[str], order: list[str]) -> DataFrame:
    """Rows of each batch by priority (lower first), then their own order; adds ``rank``."""
    rows = df.withColumn("_p", priority)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*batch).orderBy("_p", *order))).withColumnRenamed("_p", "priority")


def admission(free: int, max_poll: int) -> bool:
    """Whether a poll may run: not with less room than a poll can bring."""
    return free >= max_poll


def release_times(df: DataFrame, keys: list[str], order: list[str], arrival_s: Column, count: int, duration_s: float, weight: Column | None = None, chunk: Column | None = None) -> DataFrame:
    """When a token bucket lets each row through, in seconds; adds ``release_s``.

    Capacity ``count``, full at first, refilled evenly over ``duration_s``. With T = duration
    / count, arrivals a, cumulative weights S: tat_i = S_i T + max over j <= i of (a_j -
    S_{j-1} T), and a row leaves at the running maximum of max(a_i, tat_i - count T). One
    bucket for each of ``keys``, or one in all; ``chunk`` never decreases along the order and
    keeps a bucket from being one task. A rate of zero lets nothing through; None-like infinite
    rates are the identity and aren't asked for here.
    """
    if count <= 0:
        return df.limit(0).withColumn("release_s", F.lit(0.0))
    each = duration_s / count
    rows = df.withColumn("_a", arrival_s).withColumn("_w", F.lit(1.0) if weight is None else weight.cast("double"))
    rows = running(rows, keys, order, chunk, _s=("sum", F.col("_w")))
    rows = running(rows, keys, order, chunk, _base=("max", F.col("_a") - (F.col("_s") - F.col("_w")) * each))
    rows = running(rows, keys, order, chunk, release_s=("max", F.greatest(F.col("_a"), F.col("_s") * each + F.col("_base") - count * each)))
    return rows.drop("_a", "_w", "_s", "_base")


def per_second_rate(limit: float) -> int | None:
    """The older limit per second: zero or less disables it (None), fractions are cut off, so below one nothing passes."""
    return None if limit <= 0 else int(limit)


def simulate_rates(elements: list[tuple[float, float]], rates: list[tuple[float, float | None, float]]) -> list[float | None]:
    """Release times under rates that change, one element after another.

    ``elements``: (arrival, weight); ``rates``: (from time, count or None for no limit,
    duration). A new rate inherits tokens in proportion; a zero rate holds elements until a
    later one, or for good (None). No rates: no limit.
    """
    if not rates:
        return [a for a, _ in elements]
    ends = [r[0] for r in rates[1:]] + [float("inf")]
    k, tokens, at = 0, None, rates[0][0]
    out: list[float | None] = []
    free_at = 0.0
    for arrival, weight in elements:
        now = max(arrival, free_at)
        while now is not None:
            while k + 1 < len(rates) and rates[k + 1][0] <= now:
                tokens, at = _inherit(tokens, at, rates[k], rates[k + 1]), rates[k + 1][0]
                k += 1
            _, count, duration = rates[k]
            if count is None:
                break
            if count == 0:
                now = ends[k] if ends[k] != float("inf") else None
                continue
            tokens = count if tokens is None else min(count, tokens + (now - at) * count / duration)
            at = now
            if tokens >= weight or weight > count and tokens >= count:
                tokens -= weight
                break
            ready = now + (min(weight, count) - tokens) * duration / count
            now = min(ready, ends[k])
        out.append(now)
        if now is None:
            out.extend([None] * (len(elements) - len(out)))
            break
        free_at = now
    return out


def _inherit(tokens: float | None, at: float, old: tuple, new: tuple) -> float | None:
    start, count, _ = new
    _, old_count, duration = old
    if count is None or old_count is None or tokens is None:
        return None
    if old_count == 0:
        return tokens
    full = min(old_count, tokens + (start - at) * old_count / duration)
    return full / old_count * count


def lag_signals(samples: DataFrame, order: list[str], lag: str, high: int, low: int, chunk: Column | None = None) -> DataFrame:
    """Start and stop signals from lag samples: only changes, and the first state.

    Running goes on up to ``high``; what stands starts again at ``low``. A sample above high
    stops and one up to low starts, whatever came before, and one between changes nothing,
    so the state is the last decisive sample's. ``chunk`` never decreases along the order.
    """
    if high < low:
        raise ValueError("high tide below low tide")
    decisive = F.when(F.col(lag) <= low, True).when(F.col(lag) > high, False)
    rows = last_known(samples, [], order, chunk, "started", decisive)
    rows = rows.withColumn("started", F.coalesce("started", F.lit(False)))
    return neighbour(rows, [], order, chunk, -1, _was=F.col("started")).where(F.col("_was").isNull() | (F.col("_was") != F.col("started"))).drop("_was")


def assign_single_machine(partition_counts: dict[str, int], members: dict[str, tuple[datetime | float, str, list[str]]]) -> dict[str, list[tuple[str, int]]]:
    """member -> [(topic, partition)]. ``members``: id -> (machine's birth, machine's id, topics).

    Of each topic all partitions go to the subscribed members of the oldest machine (birth,
    then id), dealt in turn over the sorted ids; everyone else gets nothing.
    """
    out: dict[str, list[tuple[str, int]]] = {m: [] for m in members}
    for topic in sorted({t for _, _, topics in members.values() for t in topics}):
        oldest = min((birth, machine) for birth, machine, topics in members.values() if topic in topics)
        chosen = sorted(m for m, (birth, machine, topics) in members.items() if topic in topics and (birth, machine) == oldest)
        for p in range(partition_counts.get(topic, 0)):
            out[chosen[p % len(chosen)]].append((topic, p))
    return out


class ConsumerMutex:
    """Only the newest consumer may act: each takes a ticket, older ones are refused."""

    def __init__(self):
        self.latest = 0

    def ticket(self) -> Callable[[], None]:
        self.latest += 1
        own = self.latest

        def check() -> None:
            if own != self.latest:
                raise RuntimeError("a newer consumer has taken over")

        return check
