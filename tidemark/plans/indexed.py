"""Queries of indexed logs, hot keys, changing rates and what else is scanned in parts; with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import latency, offset_sets, rates, traces, windowing
from tidemark.plans.catalogue import _ACKS_SQL, _TOPIC_SQL, _acked, _committed, _events, _t, _topic, query
from tidemark.session import new_dir
from tidemark.sources import log, ranges

# Logs ----------------------------------------------------------------------------

_LOG_SQL = f"""{_TOPIC_SQL},
    log AS (SELECT topic, partition, "offset", event_id, ts + to_seconds((event_id * 7919) % 7200 - 3600) AS moment FROM topic WHERE event_id % 10 <> 3),
    ends AS (SELECT topic, partition, min("offset") AS earliest, max("offset") + 1 AS latest FROM log GROUP BY ALL),
    counts AS (SELECT partition, count(*) AS n FROM topic GROUP BY partition),
    grp AS (SELECT ends.*, CASE WHEN ends.partition <> 3 THEN CAST(floor(n * (ends.partition + 1) / 8.0) AS BIGINT) END AS committed FROM ends JOIN counts ON counts.partition = ends.partition)"""


def _log(spark, sf) -> log.Log:
    """The topic as a log: times up to an hour out of order, every tenth offset missing as after compaction."""
    e = F.col("value.event_id")
    jitter = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod(e * 7919, F.lit(7200)) - 3600)
    rows = _topic(spark, sf).where(e % 10 != 3).withColumn("timestamp", F.col("timestamp") + jitter)
    return log.write(rows, new_dir(spark, "log"), segment=1000, every=100)


def _found(records: DataFrame) -> DataFrame:
    return records.select("topic", "partition", "offset", "value.event_id")


@query(f"""WITH {_LOG_SQL},
    t AS (SELECT partition, min("offset") FILTER (epoch_ms(moment) >= 1704412800000) AS low, min("offset") FILTER (epoch_ms(moment) >= 1704499200001) AS high FROM log GROUP BY partition)
    SELECT topic, log.partition, "offset", event_id FROM log JOIN t ON t.partition = log.partition WHERE "offset" >= low AND "offset" < coalesce(high, 9223372036854775807)""")
def log_range_timestamp(spark, sf):
    """A day of January 2024 by the index: from the first record at or after its begin to before the first after its end."""
    return _found(_log(spark, sf).read(ranges.RangeProvider(ranges.timestamp(1704412800000).to(ranges.timestamp(1704499200000)))))


@query(f"""WITH {_LOG_SQL} SELECT topic, partition, "offset", event_id FROM log WHERE "offset" BETWEEN 150 AND 420""")
def log_range_raw(spark, sf):
    return _found(_log(spark, sf).read(ranges.RangeProvider(ranges.raw(150).to(ranges.raw(420)))))


@query(f"""WITH {_LOG_SQL} SELECT log.topic, log.partition, "offset", event_id FROM log JOIN grp ON grp.partition = log.partition WHERE "offset" >= committed""")
def log_range_group_rest(spark, sf):
    """From the group's position on."""
    return _found(_log(spark, sf).read(ranges.RangeProvider(ranges.group().to(ranges.latest())), _committed(spark, sf)))


@query(f"""WITH {_LOG_SQL} SELECT topic, partition, latest, greatest(coalesce(committed, earliest), 0) AS committed, latest - coalesce(committed, earliest) AS lag FROM grp""")
def log_lag(spark, sf):
    """Lag by the index alone."""
    return _log(spark, sf).lag(_committed(spark, sf), "earliest")


# Hot keys ------------------------------------------------------------------------


def _one_key_sql(order: str, seconds: int, size: int) -> str:
    """Windows of all events as one key: each row's successor, then a step for each window."""
    return f"""
        s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM events),
        nxt AS MATERIALIZED (SELECT a.rn, least(a.rn + {size}, coalesce(min(b.rn), a.rn + {size})) AS nxt
                FROM s AS a LEFT JOIN s AS b ON b.rn > a.rn AND b.rn < a.rn + {size} AND b.ts >= a.ts + INTERVAL {seconds} SECOND GROUP BY a.rn),
        walk AS (SELECT 1::BIGINT AS rn, 0::BIGINT AS window_no UNION ALL SELECT nxt.nxt, walk.window_no + 1 FROM walk JOIN nxt ON nxt.rn = walk.rn WHERE nxt.nxt <= (SELECT count(*) FROM s)),
        placed AS (SELECT s.*, walk.window_no, s.rn - walk.rn + 1 AS nth FROM s ASOF JOIN walk ON s.rn >= walk.rn)"""


@query(f"""WITH RECURSIVE {_one_key_sql('ts, event_id', 7200, 40)}
    SELECT window_no, min_by(event_id, nth) AS event_id, count(*) AS n, min(ts) AS opened, CASE WHEN count(*) >= 40 THEN max(ts) ELSE min(ts) + INTERVAL 7200 SECOND END AS closed FROM placed GROUP BY window_no""")
def dedup_hot_key(spark, sf):
    """All events as one key, two hours or forty events, scanned in pieces."""
    got = windowing.deduplicate(_events(spark, sf), [], "ts", ["ts", "event_id"], 7200.0, 40, ["event_id"], chunk=F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000), piece=500)
    return got.select(windowing.NO, "event_id", "n", "opened", "closed")


@query(f"""WITH RECURSIVE {_one_key_sql('event_id', 86400, 12)}
    SELECT window_no, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY nth) AS items, count(*) AS n FROM placed GROUP BY window_no""")
def buffer_hot_key(spark, sf):
    """All events as one key in the order of their ids, so times are out of order."""
    got = windowing.batches(_events(spark, sf), [], "ts", ["event_id"], 86400.0, 12, F.col("event_id").cast("string"), chunk=F.floor(F.col("event_id") / 700), piece=400)
    return got.select(windowing.NO, F.array_join("items", ",").alias("items"), "n")


# Rates ---------------------------------------------------------------------------


@query("""
    WITH RECURSIVE rates AS (SELECT CAST(r_regionkey AS BIGINT) AS k, r_regionkey * 518400.0 AS start, (3 * r_regionkey + 4) % 5 AS c, coalesce(lead(r_regionkey * 518400.0) OVER (ORDER BY r_regionkey), 'Infinity'::DOUBLE) AS stop FROM region),
    e AS MATERIALIZED (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, (epoch_us(ts) - 1704067200000000) / 1000000.0 AS a, 1.0 + event_id % 3 AS w FROM events),
    walk AS (
        SELECT user_id, 1::BIGINT AS n, 0::BIGINT AS k, '-Infinity'::DOUBLE AS r, '-Infinity'::DOUBLE AS z, NULL::DOUBLE AS left_at, 0::BIGINT AS was FROM (SELECT DISTINCT user_id FROM e) UNION ALL
        SELECT user_id, CASE WHEN t < stop THEN n + 1 ELSE n END, CASE WHEN t < stop THEN k ELSE k + 1 END, CASE WHEN t < stop THEN t ELSE stop END,
               CASE WHEN t < stop THEN greatest(z, t - 86400) + w * 86400 / c WHEN z = '-Infinity'::DOUBLE THEN z WHEN c = 0 THEN stop ELSE greatest(z, stop - 86400) END,
               CASE WHEN t < stop THEN t END, n
        FROM (SELECT walk.user_id, walk.n, walk.k, walk.z, e.w, rates.c, rates.stop,
                     CASE WHEN rates.c = 0 THEN 'Infinity'::DOUBLE ELSE greatest(e.a, walk.r, walk.z + least(e.w, rates.c) * 86400 / rates.c) END AS t
              FROM walk JOIN e ON e.user_id = walk.user_id AND e.n = walk.n JOIN rates ON rates.k = walk.k))
    SELECT e.event_id, round(walk.left_at, 3) AS release_s FROM e LEFT JOIN walk ON walk.user_id = e.user_id AND walk.was = e.n AND walk.left_at IS NOT NULL""")
def rate_changes(spark, sf):
    """A bucket a day for each user whose size changes every six days: 4, 2, none at all, 3, then 1; weights of one to three."""
    e = _events(spark, sf)
    arrival = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6
    phases = _t(spark, sf, "region").select((F.col("r_regionkey") * 518400.0).alias("from_s"), ((3 * F.col("r_regionkey") + 4) % 5).alias("count"), F.lit(86400.0).alias("duration_s"))
    limits = e.select("user_id").distinct().join(F.broadcast(phases))  # five rates for each user
    got = rates.release_under_rates(e, ["user_id"], ["event_id"], arrival, limits, 1.0 + F.col("event_id") % 3, chunk=F.floor(F.col("event_id") / 2000), piece=20)
    return got.select("event_id", F.round("release_s", 3).alias("release_s"))


# Offset sets ---------------------------------------------------------------------


@query(f"""WITH {_TOPIC_SQL}, m AS (SELECT partition, "offset", "offset" - row_number() OVER (PARTITION BY partition ORDER BY "offset") AS island FROM topic WHERE (event_id % 3 = 0 OR event_id % 5 <> 1) AND "offset" >= 100)
    SELECT partition, min("offset") AS "start", max("offset") AS "end" FROM m GROUP BY partition, island""")
def offset_set_ranges(spark, sf):
    """Ranges of the merge of two sets, from 100 on."""
    t = _topic(spark, sf)
    thirds, others = (offset_sets.offset_set(t.where(w), ["partition"], "offset") for w in ("value.event_id % 3 = 0", "value.event_id % 5 <> 1"))
    return offset_sets.ranges(offset_sets.minimum_merged(thirds, others, ["partition"], F.lit(100)), ["partition"])


@query(f"WITH {_ACKS_SQL} SELECT partition, status, event_id % 3 = 0 AS again, count(*) AS n FROM acks GROUP BY ALL")
def offset_set_restart(spark, sf):
    """Records that a restart reads again, by the set of those that were done before it."""
    rows = _acked(spark, sf)
    done = offset_sets.offset_set(rows.where("value.event_id % 3 <> 0"), ["partition"], "offset")
    known = offset_sets.with_membership(rows, done, ["partition"], "offset", "known")
    return known.groupBy("partition", "status", (~F.col("known")).alias("again")).agg(F.count(F.lit(1)).alias("n"))


# Durations -----------------------------------------------------------------------


@query(f"""WITH {_ACKS_SQL} SELECT partition, status, count(*) AS n, max(epoch_us(ack_ts) - epoch_us(ts)) / 1000000.0 AS max_s, true AS p50_holds, true AS p99_holds FROM acks GROUP BY ALL""")
def settle_quantiles(spark, sf):
    """Median and 99th percentile of settlements, sketched by day and rolled up; whether their exact ranks are within the bound."""
    rows = _acked(spark, sf).withColumn("s", latency.seconds(F.col("timestamp"), F.col("ack_ts")))
    days = latency.sketches(rows, ["partition", "status", F.to_date("timestamp").alias("day")], F.col("s"))
    got = latency.quantiles(latency.rolled_up(days, ["partition", "status"]), p50=0.5, p99=0.99).drop(latency.SKETCH)
    # one row for each partition and status
    ranked = rows.select("partition", "status", "s").join(F.broadcast(got), ["partition", "status"])
    holds = [
        (F.greatest(F.lit(0), F.avg((F.col("s") < F.col(p)).cast("int")) - q, q - F.avg((F.col("s") <= F.col(p)).cast("int"))) <= 2 * latency.rank_error()).alias(f"{p}_holds")
        for p, q in (("p50", 0.5), ("p99", 0.99))
    ]
    return ranked.groupBy("partition", "status", "n", "max_s").agg(*holds)


# Traces --------------------------------------------------------------------------


@query("""
    WITH RECURSIVE s AS MATERIALIZED (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, ts + to_seconds((event_id * 7919) % 600) AS moment, (event_id * 7919) % 600 AS cost FROM events),
    edges AS (SELECT a.event_id, b.event_id AS before, b.moment FROM s AS a JOIN s AS b ON a.user_id = b.user_id AND a.n % 40 <> 1 AND ((a.n % 4 = 0 AND b.n BETWEEN a.n - 3 AND a.n - 1) OR (a.n % 4 <> 0 AND b.n = a.n - 1))),
    best AS MATERIALIZED (SELECT event_id, before FROM edges QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY moment DESC, before) = 1),
    walk AS (SELECT event_id, event_id AS reached, 0::BIGINT AS depth, cost::BIGINT AS path_cost FROM s UNION ALL
             SELECT walk.event_id, best.before, depth + 1, path_cost + s.cost FROM walk JOIN best ON best.event_id = walk.reached JOIN s ON s.event_id = best.before)
    SELECT walk.event_id, reached AS root, depth, path_cost FROM walk LEFT JOIN best ON best.event_id = walk.reached WHERE best.event_id IS NULL""")
def trace_paths(spark, sf):
    """A user's events as spans: each goes on from the one before, every fourth is a batch of three, every fortieth begins a trace."""
    e = F.col("event_id")
    cost = F.pmod(e * 7919, F.lit(600))
    # a user's events, not all of them, are one order
    own = Window.partitionBy("user_id").orderBy("event_id")
    rows = _events(spark, sf).select("user_id", e.alias("span"), (F.unix_micros(F.col("ts").cast("timestamp")) + cost * 1_000_000).alias("end"), cost.alias("cost"), F.row_number().over(own).alias("n"), *[F.lag("event_id", k).over(own).alias(f"b{k}") for k in (1, 2, 3)])
    batch = F.when(F.col("n") % 4 == 0, F.array("b1", "b2", "b3")).otherwise(F.array("b1"))
    edges = rows.where("n % 40 <> 1").select("span", F.explode(batch).alias("before")).where("before is not null")
    return traces.paths(rows, traces.waited_for(rows, edges)).withColumnRenamed("span", "event_id")
