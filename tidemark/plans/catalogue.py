"""Queries over the driver's tables, one for each operator, and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import string_bucket, with_number_bucket, with_uuid_bucket
from tidemark.operators import acks, context, flow, grouping, stateless, windowing
from tidemark.operators.failure import delegate, delegate_unless, emit_unless, error_delegation, message_has, passing, process_failure, route
from tidemark.sources import ranges, topics

H6 = 6 * 3600.0


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events")


def _topic(spark: SparkSession, sf: str) -> DataFrame:
    return topics.events_topic(spark, sf)


def _acked(spark: SparkSession, sf: str) -> DataFrame:
    """The topic with settlements: a pseudo-random delay, every tenth error nacked."""
    e = F.col("value.event_id")
    return topics.acks(_topic(spark, sf), F.pmod(e * 7919, F.lit(600)), (F.col("value.event_type") == "error") & (e % 10 == 0))


def _committed(spark: SparkSession, sf: str) -> DataFrame:
    """Group positions: an eighth of a partition for each partition number and one; the last is uncommitted."""
    counts = _topic(spark, sf).groupBy("topic", "partition").count()
    at = F.floor(F.col("count") * (F.col("partition") + 1) / 8)
    return counts.select("topic", "partition", F.when(F.col("partition") != 3, at).cast("long").alias("committed"))


_TOPIC_SQL = """
    topic AS (SELECT 'events' AS topic, CAST(user_id % 4 AS INTEGER) AS partition,
                     row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS "offset",
                     ts, event_id, user_id, event_type, value AS amount, props FROM events)"""
_ACKS_SQL = (
    _TOPIC_SQL
    + """,
    acks AS (SELECT *, ts + to_seconds((event_id * 7919) % 600) AS ack_ts,
                    CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'nack' ELSE 'ack' END AS status FROM topic)"""
)
_GROUP_SQL = (
    _TOPIC_SQL
    + """,
    bounds AS (SELECT topic, partition, count(*) AS n, min("offset") AS earliest, max("offset") + 1 AS latest FROM topic GROUP BY ALL),
    grp AS (SELECT *, CASE WHEN partition <> 3 THEN CAST(floor(n * (partition + 1) / 8.0) AS BIGINT) END AS committed FROM bounds)"""
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Sources ------------------------------------------------------------------------


@query("SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS t(n, name)")
def source_just(spark, sf):
    return stateless.just(spark, [(1, "one"), (2, "two"), (3, None)], "n int, name string")


@query(f"WITH {_TOPIC_SQL} SELECT topic, partition, \"offset\", event_id, user_id, event_type, amount FROM topic WHERE partition IN (0, 2)")
def source_assigned(spark, sf):
    """Explicit assignment of two partitions, unwrapped."""
    got = topics.subscribe(_topic(spark, sf), partitions=[("events", 0), ("events", 2)])
    return got.select("topic", "partition", "offset", "value.event_id", "value.user_id", "value.event_type", "value.amount")


@query(f"WITH {_TOPIC_SQL} SELECT event_id, user_id, event_type, amount, props FROM topic")
def source_pattern_values(spark, sf):
    """Subscription by pattern, values only."""
    return topics.unwrap(topics.values(topics.subscribe(_topic(spark, sf), pattern="ev.*")))


@query("""
    WITH t AS (SELECT *, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS priority, event_id // 256 AS poll FROM events)
    SELECT poll, CAST(row_number() OVER (PARTITION BY poll ORDER BY priority, event_id) AS BIGINT) AS rank, event_id, priority FROM t""")
def priority_merge(spark, sf):
    """Heads of polls of 256 records, merged by priority."""
    rows = _events(spark, sf).withColumn("poll", F.floor(F.col("event_id") / 256))
    p = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return flow.merge_priority(rows, p, ["poll"], ["event_id"]).select("poll", F.col("rank").cast("long").alias("rank"), "event_id", "priority")


# Row-wise ------------------------------------------------------------------------


@query("SELECT event_id, user_id, round(value * 2, 6) AS twice FROM events WHERE event_type <> 'view' AND value >= 10")
def filter_map(spark, sf):
    rows = stateless.keep(_events(spark, sf), (F.col("event_type") != "view") & (F.col("value") >= 10))
    return stateless.map_rows(rows, twice=F.round(F.col("value") * 2, 6)).select("event_id", "user_id", "twice")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS code FROM events WHERE event_type IN ('click', 'purchase')")
def filter_map_not_null(spark, sf):
    code = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2)
    return stateless.map_not_null(_events(spark, sf), code=code).select("event_id", "code")


@query("SELECT event_id, event_type, value FROM events WHERE NOT (value >= 50 AND event_type <> 'view') OR value IS NULL")
def discarded_rows(spark, sf):
    """What a filter drops, as a discard hook sees it."""
    return stateless.discarded(_events(spark, sf), (F.col("value") >= 50) & (F.col("event_type") != "view")).select("event_id", "event_type", "value")


@query("SELECT event_id, TRY_CAST(CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) ELSE event_type END AS INTEGER) AS content FROM events WHERE event_type = 'view'")
def of_type_numbers(spark, sf):
    """Of contents of two types those that are numbers."""
    rows = _events(spark, sf).withColumn("content", F.when(F.col("event_type") == "view", F.col("user_id").cast("string")).otherwise(F.col("event_type")))
    return stateless.of_type(rows, "content", "int").select("event_id", "content")


@query("SELECT event_id, CAST(round(value) AS BIGINT) AS amount FROM events")
def cast_values(spark, sf):
    return stateless.cast(_events(spark, sf).withColumn("amount", F.round("value")), "amount", "bigint").select("event_id", "amount")


@query("SELECT event_type, count(*) AS n, 0 AS left_over FROM events GROUP BY event_type")
def consume_rows(spark, sf):
    """What a side effect over all rows saw; none of them comes out."""
    seen: list = []
    rest = stateless.consume(_events(spark, sf), lambda df: seen.extend(df.groupBy("event_type").count().collect()))
    return spark.createDataFrame([(r.event_type, r["count"], rest.count()) for r in seen], "event_type string, n long, left_over int")


@query("SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS place, string_split(text, ' ')[i] AS word FROM conversations, unnest(range(1, len(string_split(text, ' ')) + 1)) AS u(i)")
def flat_map_turns(spark, sf):
    """1 to N in order: a turn's words."""
    return stateless.concat_map(_t(spark, sf, "conversations"), F.split("text", " "), "word").select("conv_id", "turn", F.col("_place").alias("place"), "word")


@query("SELECT conv_id, count(*) AS words FROM (SELECT conv_id, unnest(string_split(text, ' ')) AS word FROM conversations) GROUP BY conv_id")
def flat_map_counts(spark, sf):
    return stateless.flat_map(_t(spark, sf, "conversations"), F.split("text", " "), "word").groupBy("conv_id").agg(F.count(F.lit(1)).alias("words"))


@query("SELECT event_id, user_id % 3 AS shard, (user_id % 3) * 10 AS tag FROM events")
def decorated(spark, sf):
    """Decorators run by their order, not by their place in the list."""
    late = (2, lambda df: df.withColumn("tag", F.col("shard") * 10))
    early = (1, lambda df: df.withColumn("shard", F.col("user_id") % 3))
    return stateless.decorate(_events(spark, sf), [late, early]).select("event_id", "shard", "tag")


# Grouping ------------------------------------------------------------------------


def _mix(k: str) -> str:
    a = f"(({k})::HUGEINT * 3432918353 % 4294967296)"
    r = f"(({a} * 32768) % 4294967296 + {a} // 131072)"
    return f"({r} * 461845907 % 4294967296)"


def _steps(blocks: list[str], length: int, source: str, keep: str, n: int) -> str:
    """The hash of fixed blocks as a chain of subselects, one arithmetic step each."""
    sql = f"SELECT {keep}, {', '.join(f'{b} AS b{k}' for k, b in enumerate(blocks))}, 0::HUGEINT AS h FROM {source}"
    for k in range(len(blocks)):
        sql = f"SELECT *, {_mix(f'b{k}')} AS m{k} FROM ({sql})"
        sql = f"SELECT * REPLACE (xor(h, m{k}) AS h) FROM ({sql})"
        sql = f"SELECT * REPLACE (((h * 8192) % 4294967296 + h // 524288) AS h) FROM ({sql})"
        sql = f"SELECT * REPLACE ((h * 5 + 3864292196) % 4294967296 AS h) FROM ({sql})"
    sql = f"SELECT * REPLACE (xor(h, {length}::HUGEINT) AS h) FROM ({sql})"
    for shift, factor in ((65536, 2246822507), (8192, 3266489909), (65536, None)):
        sql = f"SELECT * REPLACE (xor(h, h // {shift}) AS h) FROM ({sql})"
        if factor:
            sql = f"SELECT * REPLACE (h * {factor} % 4294967296 AS h) FROM ({sql})"
    signed = "CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END"
    return f"SELECT {keep.split(' AS ')[-1] if ' AS ' in keep else keep}, CAST(((({signed}) % {n}) + {n}) % {n} AS INTEGER) AS bucket FROM ({sql})"


@query(_steps(["(l_orderkey & 4294967295)", "(l_orderkey >> 32)"], 8, "(SELECT DISTINCT l_orderkey FROM lineitem)", "l_orderkey", 128))
def bucket_number_hash(spark, sf):
    keys = _t(spark, sf, "lineitem").select("l_orderkey").distinct()
    return with_number_bucket(keys, "bucket", F.col("l_orderkey"), 128)


_UUID_SQL = "(SELECT DISTINCT user_id, md5(CAST(user_id AS VARCHAR)) AS x FROM events)"


@query(_steps([f"(('0x' || substr(x, {8 * k + 7}, 2) || substr(x, {8 * k + 5}, 2) || substr(x, {8 * k + 3}, 2) || substr(x, {8 * k + 1}, 2))::BIGINT)" for k in range(4)], 16, _UUID_SQL, "user_id", 64))
def bucket_uuid_hash(spark, sf):
    x = F.md5(F.col("user_id").cast("string"))
    uuid = F.concat_ws("-", *[F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return with_uuid_bucket(_events(spark, sf).select("user_id").distinct(), "bucket", uuid, 64)


def _string_sql(n: int) -> str:
    block = "(ascii(substr(s, CAST(2 * i + 1 AS BIGINT), 1)) + 65536 * ascii(substr(s, CAST(2 * i + 2 AS BIGINT), 1)))"
    mixed = f"xor(h, {_mix(block)})"
    rotated = f"(({mixed} * 8192) % 4294967296 + {mixed} // 524288)"
    tail = f"CASE WHEN length(s) % 2 = 1 THEN xor(h, {_mix('ascii(substr(s, length(s), 1))')}) ELSE h END"
    sql = f"SELECT s, xor({tail}, 2 * length(s)::HUGEINT) AS h FROM walk WHERE i = length(s) // 2"
    for shift, factor in ((65536, 2246822507), (8192, 3266489909), (65536, None)):
        sql = f"SELECT s, xor(h, h // {shift}) AS h FROM ({sql})"
        if factor:
            sql = f"SELECT s, h * {factor} % 4294967296 AS h FROM ({sql})"
    signed = "CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END"
    return f"""
        WITH RECURSIVE walk(s, i, h) AS (
            SELECT DISTINCT p_name, 0::BIGINT, 0::HUGEINT FROM part UNION ALL
            SELECT s, i + 1, ({rotated} * 5 + 3864292196) % 4294967296 FROM walk WHERE i < length(s) // 2)
        SELECT s AS p_name, CAST(((({signed}) % {n}) + {n}) % {n} AS INTEGER) AS bucket FROM ({sql})"""


@query(_string_sql(32))
def bucket_string_hash(spark, sf):
    """ASCII names, so characters are code units in the SQL."""
    return _t(spark, sf, "part").select("p_name").distinct().select("p_name", string_bucket(F.col("p_name"), 32).alias("bucket"))


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) % 5 AS INTEGER) AS rail FROM events")
def bucket_round_robin(spark, sf):
    got = grouping.by_round_robin(_events(spark, sf), ["event_id"], 5, F.floor(F.col("event_id") / 1000))
    return got.select("event_id", F.col(grouping.GROUP).alias("rail"))


@query(f"WITH {_TOPIC_SQL} SELECT topic, partition, count(*) AS n, round(sum(amount), 4) AS total FROM topic WHERE event_type = 'purchase' GROUP BY topic, partition")
def group_topic_partition(spark, sf):
    """Inner filter of each topic partition's group, then merged."""
    g = grouping.by_topic_partition(_topic(spark, sf))
    g = grouping.inner(g, lambda df: df.where(F.col("value.event_type") == "purchase"))
    return grouping.ungroup(g).groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value.amount"), 4).alias("total"))


@query(f"""
    WITH {_ACKS_SQL},
    w AS (SELECT *, max(ack_ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM acks)
    SELECT event_id, user_id, CAST(coalesce(sum(CASE WHEN last <= ts THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS BIGINT) AS generation FROM w""")
def group_generations(spark, sf):
    """Groups of a user that close once all their events are settled."""
    rows = _acked(spark, sf).select("value.event_id", "value.user_id", "timestamp", "ack_ts")
    return grouping.generations(rows, ["user_id"], "timestamp", "ack_ts", ["event_id"]).select("event_id", "user_id", "generation")


# Windows -------------------------------------------------------------------------


def _anchored_sql(source: str, key: str, seconds: int, size: int) -> str:
    """Windows anchored at their first row, by recursion over row numbers."""
    return f"""
        seq AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY event_id) AS rn FROM ({source})),
        walk AS (
            SELECT seq.*, ts AS t0, 1 AS nth, 0::BIGINT AS window_no FROM seq WHERE rn = 1 UNION ALL
            SELECT seq.*, CASE WHEN seq.ts - w.t0 < INTERVAL {seconds} SECOND AND w.nth < {size} THEN w.t0 ELSE seq.ts END,
                   CASE WHEN seq.ts - w.t0 < INTERVAL {seconds} SECOND AND w.nth < {size} THEN w.nth + 1 ELSE 1 END,
                   CASE WHEN seq.ts - w.t0 < INTERVAL {seconds} SECOND AND w.nth < {size} THEN w.window_no ELSE w.window_no + 1 END
            FROM walk w JOIN seq ON seq.{key} = w.{key} AND seq.rn = w.rn + 1)"""


_CLOSED = "CASE WHEN count(*) >= {size} THEN max(ts) ELSE min(ts) + INTERVAL {seconds} SECOND END AS closed"


def _dedup_sql(value: str, name: str, source: str = "SELECT * FROM events WHERE event_type <> 'view'") -> str:
    return f"""WITH RECURSIVE {_anchored_sql(source, 'user_id', 21600, 4)}
        SELECT user_id, window_no, {value} AS {name}, count(*) AS n, min(ts) AS opened, {_CLOSED.format(size=4, seconds=21600)} FROM walk GROUP BY user_id, window_no"""


def _dedup(spark, sf, reducer, value):
    rows = stateless.keep(_events(spark, sf), F.col("event_type") != "view")
    return windowing.deduplicate(rows, ["user_id"], "ts", ["event_id"], H6, 4, [value], reducer)


@query(_dedup_sql("min_by(event_id, nth)", "event_id"))
def dedup_first(spark, sf):
    """Six hours or four events a user, the first stays."""
    return _dedup(spark, sf, windowing.FIRST, "event_id")


@query(_dedup_sql("max_by(event_id, nth)", "event_id"))
def dedup_last(spark, sf):
    return _dedup(spark, sf, windowing.LAST, "event_id")


@query(_dedup_sql("sum(event_id)::BIGINT", "event_id"))
def dedup_sum(spark, sf):
    return _dedup(spark, sf, windowing.SUM, "event_id")


@query(f"""WITH RECURSIVE {_anchored_sql('SELECT * FROM events', 'user_id', 21600, 4)}
    SELECT user_id, window_no, string_agg(event_type, '>' ORDER BY nth) AS path FROM walk GROUP BY user_id, window_no""")
def dedup_composed(spark, sf):
    """Any binary reduction, left to right."""
    rows = windowing.anchored(_events(spark, sf), ["user_id"], "ts", ["event_id"], H6, 4)
    path = windowing.composed("event_type", lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit(">"), b)), F.lit(""))
    return rows.groupBy("user_id", windowing.NO).agg(path.alias("path"))


@query("""
    WITH s AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS window_no FROM events)
    SELECT user_id, window_no, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM s GROUP BY user_id, window_no""")
def dedup_size_only(spark, sf):
    rows = windowing.sized(_events(spark, sf), ["user_id"], ["event_id"], 4)
    return rows.groupBy("user_id", windowing.NO).agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {_anchored_sql('SELECT * FROM events', 'user_id', 10800, 3)}
    SELECT user_id, window_no, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY nth) AS items, count(*) AS n, min(ts) AS opened, {_CLOSED.format(size=3, seconds=10800)} FROM walk GROUP BY user_id, window_no""")
def buffer_size_time(spark, sf):
    """Three hours or three events a user."""
    got = windowing.batches(_events(spark, sf), ["user_id"], "ts", ["event_id"], 10800.0, 3, F.col("event_id").cast("string"))
    return got.withColumn("items", F.array_join("items", ","))


@query("""
    SELECT event_id, user_id, round((epoch_us(ts) - epoch_us(lag_ts)) / 1000000.0, 6) AS gap_s
    FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS lag_ts FROM events) WHERE epoch_us(ts) - epoch_us(lag_ts) > 86400000000""")
def inactivity_gaps(spark, sf):
    """Silences of over a day."""
    return windowing.inactivity(_events(spark, sf), ["user_id"], "ts", ["event_id"], 86400.0).select("event_id", "user_id", F.round("gap_s", 6).alias("gap_s"))


@query(f"""WITH {_TOPIC_SQL} SELECT topic, partition, "offset" // 500 AS window_no, max("offset") + 1 AS position FROM topic GROUP BY ALL""")
def commit_windows(spark, sf):
    rows = windowing.sized(_topic(spark, sf), ["topic", "partition"], ["offset"], 500)
    return windowing.commits(rows, ["topic", "partition"], windowing.NO, "offset")


# Acknowledgement -----------------------------------------------------------------


@query(f"""WITH {_ACKS_SQL} SELECT partition, "offset", max(ack_ts) OVER (PARTITION BY partition ORDER BY "offset") AS executed FROM acks""")
def ack_in_order(spark, sf):
    return acks.frontier(_acked(spark, sf), ["partition"], "offset", "ack_ts", "status").select("partition", "offset", "executed")


@query(f"""
    WITH {_ACKS_SQL},
    x AS (SELECT *, max(ack_ts) OVER (PARTITION BY partition ORDER BY "offset") AS executed, lead(ack_ts) OVER w AS next_ts, lead(status) OVER w AS next_status
          FROM acks WINDOW w AS (PARTITION BY partition ORDER BY "offset"))
    SELECT partition, "offset", executed FROM x WHERE NOT coalesce(status = 'ack' AND next_status = 'ack' AND greatest(ack_ts, next_ts) < executed, false)""")
def ack_compact(spark, sf):
    got = acks.frontier(_acked(spark, sf), ["partition"], "offset", "ack_ts", "status", acks.COMPACT)
    return got.where(~F.col("collapsed")).select("partition", "offset", "executed")


@query(f"""
    WITH {_ACKS_SQL}, e AS (SELECT partition, ts AS moment, 1 AS d FROM acks UNION ALL SELECT partition, ack_ts, -1 FROM acks),
    s AS (SELECT partition, moment, sum(d) AS d FROM e GROUP BY ALL), r AS (SELECT partition, sum(d) OVER (PARTITION BY partition ORDER BY moment) AS n FROM s)
    SELECT partition, CAST(max(n) AS BIGINT) AS most FROM r GROUP BY partition""")
def ack_in_flight(spark, sf):
    """Most records in flight in a partition when places are freed at once."""
    got = acks.frontier(_acked(spark, sf), ["partition"], "offset", "ack_ts", "status", acks.COMPACT_EAGER)
    return acks.in_flight(got, ["partition"], "timestamp", "freed").groupBy("partition").agg(F.max("in_flight").alias("most"))


@query(f"""
    WITH {_ACKS_SQL}, o AS (SELECT *, max(CASE WHEN status = 'ack' THEN 0 ELSE 1 END) OVER (PARTITION BY partition ORDER BY "offset") AS bad FROM acks),
    c AS (SELECT partition, coalesce(max(CASE WHEN bad = 0 THEN "offset" + 1 END), min("offset")) AS position FROM o GROUP BY partition),
    a AS (SELECT acks.partition, "offset", "offset" - row_number() OVER (PARTITION BY acks.partition ORDER BY "offset") AS island
          FROM acks JOIN c ON acks.partition = c.partition WHERE status = 'ack' AND "offset" >= position)
    SELECT partition, min("offset") AS "start", max("offset") AS "end" FROM a GROUP BY partition, island""")
def ack_ahead_ranges(spark, sf):
    return acks.ahead_of_commit(_acked(spark, sf), ["partition"], "offset", "status")


@query(f"""
    WITH {_ACKS_SQL}, o AS (SELECT *, max(CASE WHEN status = 'ack' THEN 0 ELSE 1 END) OVER (PARTITION BY partition ORDER BY "offset") AS bad FROM acks)
    SELECT partition, event_id FROM o WHERE bad = 1 AND status = 'nack'""")
def ack_restart(spark, sf):
    """What a restart reads again: past the position and not acked ahead of it."""
    got = _acked(spark, sf)
    at = acks.committable(got, ["partition"], "offset", "status")
    done = acks.ahead_of_commit(got, ["partition"], "offset", "status").join(at, ["partition"], "right")
    return acks.unprocessed(got, done, ["partition"], "offset").select("partition", "value.event_id")


@query("""
    WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations)
    SELECT conv_id, turn, count(*) AS children, CASE WHEN bool_or(length(word) > 12) THEN 'nack' ELSE 'ack' END AS status FROM w GROUP BY conv_id, turn""")
def parent_ack_status(spark, sf):
    """1 to N: a turn is acked if all its words are; words of over 12 letters are nacked."""
    words = stateless.concat_map(_t(spark, sf, "conversations"), F.split("text", " "), "word")
    words = words.withColumn("s", F.when(F.length("word") > 12, "nack").otherwise("ack"))
    return acks.parents(words, ["conv_id", "turn"], "s", "_place").select("conv_id", "turn", "children", "status")


@query("""
    WITH b AS (SELECT event_id, user_id, event_type, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS n FROM events),
    s AS (SELECT user_id, n, CASE WHEN bool_or(event_type = 'error' AND value > 50) THEN 'nack' ELSE 'ack' END AS status FROM b GROUP BY ALL)
    SELECT event_id, status FROM b JOIN s USING (user_id, n)""")
def fan_in_status(spark, sf):
    """N to 1: a batch's nack goes to all its members."""
    rows = windowing.sized(_events(spark, sf), ["user_id"], ["event_id"], 4)
    rows = rows.withColumn("s", F.when((F.col("event_type") == "error") & (F.col("value") > 50), "nack").otherwise("ack"))
    found = acks.parents(rows, ["user_id", windowing.NO], "s", "event_id").withColumn("error", F.lit(None).cast("string"))
    return acks.members(found, rows, ["user_id", windowing.NO]).select("event_id", "status")


@query(f"WITH {_ACKS_SQL} SELECT partition, event_id, true AS redelivered FROM acks WHERE status = 'nack'")
def nack_requeue(spark, sf):
    return acks.nacked(_acked(spark, sf), "status", "requeue").select("partition", "value.event_id", "redelivered")


@query(f"""
    WITH {_TOPIC_SQL}, m AS (SELECT partition, "offset" FROM topic WHERE event_id % 3 = 0 UNION SELECT partition, "offset" FROM topic WHERE event_id % 5 = 0)
    SELECT * FROM m WHERE "offset" >= 100""")
def offsets_minimum_merge(spark, sf):
    t = _topic(spark, sf)
    return acks.minimum_merged(t.where(F.col("value.event_id") % 3 == 0), t.where(F.col("value.event_id") % 5 == 0), ["partition"], "offset", F.lit(100))


# Errors --------------------------------------------------------------------------


def _failing(spark, sf, strategy):
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("bad event "), F.col("user_id") % 4))
    return route(_events(spark, sf), error, strategy)


@query("SELECT event_id, value FROM events WHERE event_type <> 'error'")
def failure_emit_unless(spark, sf):
    """Every error matches: acknowledged and dropped, the query goes on."""
    return passing(_failing(spark, sf, emit_unless(message_has("bad")))).select("event_id", "value")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'nacked' ELSE 'ok' END AS ack FROM events")
def failure_delegate(spark, sf):
    return _failing(spark, sf, delegate()).select("event_id", F.col("_ack").alias("ack"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN 'ok' WHEN user_id % 4 = 1 THEN 'acked_dropped' ELSE 'nacked' END AS ack FROM events")
def failure_delegate_unless(spark, sf):
    return _failing(spark, sf, delegate_unless(message_has("event 1"))).select("event_id", F.col("_ack").alias("ack"))


@query("SELECT event_id, CASE WHEN value > 90 THEN 'nacked' ELSE 'ok' END AS ack FROM events")
def failure_of_values(spark, sf):
    """A value that means failure; delegated rows pass unchanged."""
    return process_failure(_events(spark, sf), F.col("value") > 90, F.lit("too large"), delegate()).select("event_id", F.col("_ack").alias("ack"))


@query("SELECT event_id, 'bad event ' || (user_id % 4) AS error, props FROM events WHERE event_type = 'error' AND user_id % 4 <> 2")
def dead_letter(spark, sf):
    """Nacked rows whose error matches, composed into letters."""
    rows = _failing(spark, sf, delegate())
    _, letters = error_delegation(rows, ~F.endswith(F.col("_error"), F.lit("2")), {"event_id": F.col("event_id"), "error": F.col("_error"), "props": F.col("props")})
    return letters


@query("""
    SELECT event_id, CASE WHEN event_type <> 'error' THEN 'ok' WHEN user_id % 4 = 2 OR value > 80 THEN 'nacked' ELSE 'ack' END AS ack,
           CASE WHEN event_type = 'error' AND user_id % 4 <> 2 AND value > 80 THEN 'letter lost' WHEN event_type = 'error' AND user_id % 4 = 2 THEN 'bad event 2' END AS error
    FROM events""")
def dead_letter_settled(spark, sf):
    """A letter that can't be sent leaves its row nacked with the new error."""
    rows = _failing(spark, sf, delegate())
    lost = F.when(F.col("value") > 80, F.lit("letter lost"))
    settled, _ = error_delegation(rows, ~F.endswith(F.col("_error"), F.lit("2")), send_error=lost)
    return settled.select("event_id", F.col("_ack").alias("ack"), F.col("_error").alias("error"))


# Ranges and lag ------------------------------------------------------------------


def _range(spark, sf, provider):
    got = ranges.read(_topic(spark, sf), provider, _committed(spark, sf))
    return got.select("topic", "partition", "offset", "value.event_id")


def _range_sql(low: str, high: str, where: str = "true") -> str:
    return f"""WITH {_GROUP_SQL} SELECT t.topic, t.partition, t."offset", t.event_id FROM topic t JOIN grp g ON t.partition = g.partition
        WHERE {where} AND t."offset" >= greatest({low}, earliest) AND t."offset" <= least({high}, latest) - 1"""


@query(_range_sql("10", "101"))
def range_raw(spark, sf):
    return _range(spark, sf, ranges.RangeProvider(ranges.raw(10).to(ranges.raw(100))))


@query(f"""WITH {_TOPIC_SQL} SELECT topic, partition, "offset", event_id FROM topic
    WHERE epoch_ms(ts) >= 1704412800000 AND epoch_ms(ts) <= 1705017600000""")
def range_timestamp(spark, sf):
    """A week of January 2024, both ends included."""
    return _range(spark, sf, ranges.RangeProvider(ranges.timestamp(1704412800000).to(ranges.timestamp(1705017600000))))


@query(_range_sql("earliest", "committed", "committed IS NOT NULL"))
def range_group(spark, sf):
    """Up to the group's position."""
    return _range(spark, sf, ranges.RangeProvider(ranges.earliest().to(ranges.group())))


@query(_range_sql("committed", "latest", "committed IS NOT NULL"))
def range_group_rest(spark, sf):
    return _range(spark, sf, ranges.RangeProvider(ranges.group().to(ranges.latest())))


@query(_range_sql("earliest", "latest"))
def range_earliest_latest(spark, sf):
    return _range(spark, sf, ranges.RangeProvider(ranges.earliest().to(ranges.latest())))


@query(_range_sql("CASE WHEN t.partition = 1 THEN 50 ELSE earliest END", "latest", "t.partition >= 1"))
def range_start_from(spark, sf):
    """Partitions before the start are skipped; that one begins inside."""
    return _range(spark, sf, ranges.RangeProvider(ranges.earliest().to(ranges.latest())).starting_from("events", 1, 50))


@query(_range_sql("CASE WHEN t.partition = 0 THEN 5 ELSE latest - 1 END", "CASE WHEN t.partition = 0 THEN 8 ELSE latest END", "t.partition IN (0, 2)"))
def range_by_partition(spark, sf):
    per = {("events", 0): ranges.raw(5).to(ranges.raw(7)), ("events", 2): ranges.latest().as_range()}
    return _range(spark, sf, ranges.RangeProvider(by_partition=per))


@query(f"""WITH {_GROUP_SQL} SELECT topic, partition, least(2001, latest) AS committed FROM grp WHERE committed IS NOT NULL AND committed <= least(2001, latest) - 1""")
def range_commit_after(spark, sf):
    """From the group's position up to offset 2000; the positions to commit afterwards."""
    _, after = ranges.read_up_to(_topic(spark, sf), ranges.raw(2000), _committed(spark, sf))
    return after


@query(f"WITH {_GROUP_SQL} SELECT topic, partition, latest, coalesce(committed, earliest) AS committed, latest - coalesce(committed, earliest) AS lag FROM grp")
def consumer_lag(spark, sf):
    return ranges.lag(_topic(spark, sf), _committed(spark, sf), "earliest")


@query(f"WITH {_GROUP_SQL} SELECT topic, partition, latest, committed, latest - committed AS lag FROM grp WHERE committed IS NOT NULL")
def consumer_lag_committed(spark, sf):
    return ranges.lag(_topic(spark, sf), _committed(spark, sf), "none")


@query(f"WITH {_GROUP_SQL} SELECT topic, partition, earliest, latest FROM grp")
def list_offsets(spark, sf):
    return ranges.list_offsets(_topic(spark, sf))


@query(f"WITH {_GROUP_SQL} SELECT topic, partition, CASE WHEN partition = 3 THEN 7 WHEN partition = 0 THEN 1 ELSE committed END AS committed FROM grp")
def alter_group_offsets(spark, sf):
    changes = stateless.just(spark, [("events", 3, 7), ("events", 0, 1)], "topic string, partition int, committed long")
    return ranges.alter_group(_committed(spark, sf), changes)


# Flow ----------------------------------------------------------------------------


@query(f"""WITH {_GROUP_SQL}, l AS (SELECT topic, partition, CASE WHEN committed IS NULL THEN 9223372036854775807 ELSE (latest - committed) // 100 END AS batch_lag FROM grp)
    SELECT topic, partition, batch_lag FROM l WHERE batch_lag = (SELECT max(batch_lag) FROM l)""")
def greatest_batch_lag(spark, sf):
    """An uncommitted partition's lag is unknown, so the greatest."""
    lags = ranges.bounds(_topic(spark, sf), committed=_committed(spark, sf)).withColumn("lag", F.col("latest") - F.col("committed"))
    return flow.greatest_batch_lag(lags, "lag", 100).select("topic", "partition", "batch_lag")


@query(f"""WITH {_GROUP_SQL}, l AS (SELECT topic, partition, latest - coalesce(committed, earliest) AS lag FROM grp),
    s AS (SELECT *, coalesce(sum(CASE WHEN lag >= 1500 THEN 1 ELSE 0 END) OVER (ORDER BY partition ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hit FROM l)
    SELECT topic, partition, lag FROM s WHERE hit = 0""")
def priority_cutoff(spark, sf):
    lags = ranges.lag(_topic(spark, sf), _committed(spark, sf), "earliest")
    return flow.priority_cutoff(lags, ["partition"], "lag", 1500).select("topic", "partition", "lag")


@query("""
    WITH p AS (SELECT n_nationkey AS partition, row_number() OVER (ORDER BY n_nationkey) - 1 AS place, count(*) OVER () AS n FROM nation WHERE n_nationkey < 15)
    SELECT CAST(2 * b + (place >> b) % 2 AS INTEGER) AS cycle, partition FROM p, range(0, 6) t(b) WHERE (n - 1) >> b > 0""")
def binary_strides(spark, sf):
    """The cycle over fifteen partitions: a stride for each bit of a partition's place and each value of it."""
    return flow.stride_plan(spark, [r.n_nationkey for r in _t(spark, sf, "nation").where("n_nationkey < 15").select("n_nationkey").collect()])


_RATE_SQL = """
    WITH a AS (SELECT event_id, user_id, (epoch_us(ts) - 1704067200000000) / 1000000.0 AS a, CAST({weight} AS DOUBLE) AS w FROM events),
    s AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM a),
    b AS (SELECT *, max(a - (s - w) * {each}) OVER (PARTITION BY user_id ORDER BY event_id) AS base FROM s)
    SELECT event_id, round(max(greatest(a, s * {each} + base - {capacity})) OVER (PARTITION BY user_id ORDER BY event_id), 3) AS release_s FROM b"""


def _released(spark, sf, count, duration, weight=None):
    arrival = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6
    got = flow.release_times(_events(spark, sf), ["user_id"], ["event_id"], arrival, count, duration, weight)
    return got.select("event_id", F.round("release_s", 3).alias("release_s"))


@query(_RATE_SQL.format(weight=1, each=28800.0, capacity=86400.0))
def rate_release_times(spark, sf):
    """A bucket of three a day for each user."""
    return _released(spark, sf, 3, 86400.0)


@query(_RATE_SQL.format(weight="1 + user_id % 2", each=28800.0, capacity=86400.0))
def rate_weighted(spark, sf):
    return _released(spark, sf, 3, 86400.0, 1 + F.col("user_id") % 2)


@query("""
    WITH RECURSIVE s AS (SELECT CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, count(*) AS lag FROM events GROUP BY 1),
    n AS (SELECT *, row_number() OVER (ORDER BY hour) AS rn FROM s),
    w AS (SELECT rn, hour, lag <= 12 AS started FROM n WHERE rn = 1 UNION ALL
          SELECT n.rn, n.hour, CASE WHEN w.started THEN n.lag <= 16 ELSE n.lag <= 12 END FROM w JOIN n ON n.rn = w.rn + 1),
    c AS (SELECT *, lag(started) OVER (ORDER BY rn) AS was FROM w)
    SELECT hour, started FROM c WHERE was IS NULL OR was <> started""")
def lag_hysteresis(spark, sf):
    """Hourly counts as lag samples: stop above 16, start again at 12."""
    hours = _events(spark, sf).groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("hour")).agg(F.count(F.lit(1)).alias("lag"))
    return flow.lag_signals(hours, ["hour"], "lag", 16, 12, F.floor(F.col("hour") / 168)).select("hour", "started")


# Context and metrics -------------------------------------------------------------


def _with_context(spark, sf):
    c = context.put(F.lit(None), "trace_id", F.concat(F.lit("t"), F.col("event_id") % 7))
    c = context.put(c, "trace_id", F.lit("ignored"))
    rows = _events(spark, sf).withColumn(context.CONTEXT, context.put(c, "since", F.lpad(F.col("event_id").cast("string"), 8, "0")))
    return windowing.sized(rows, ["user_id"], ["event_id"], 4)


_BATCHED_SQL = "WITH b AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS window_no FROM events)"


@query(_BATCHED_SQL + " SELECT user_id, window_no, min_by('t' || (event_id % 7), event_id) AS trace_id, min(lpad(CAST(event_id AS VARCHAR), 8, '0')) AS since FROM b GROUP BY user_id, window_no")
def context_fan_in(spark, sf):
    return context.fan_in(_with_context(spark, sf), ["user_id", windowing.NO], "event_id", single=["trace_id"], smallest=["since"])


@query(_BATCHED_SQL + " SELECT user_id, window_no, array_to_string(list_sort(list(DISTINCT 't' || (event_id % 7))), ',') AS links FROM b GROUP BY user_id, window_no")
def trace_links(spark, sf):
    return context.trace_links(_with_context(spark, sf), ["user_id", windowing.NO]).withColumn("links", F.array_join("links", ","))


@query(f"""WITH {_ACKS_SQL} SELECT topic, CASE WHEN status = 'ack' THEN 'success' ELSE 'failure' END AS result, count(*) AS n,
    round(avg(epoch_us(ack_ts) - epoch_us(ts)) / 1000000, 6) AS mean_s, max(epoch_us(ack_ts) - epoch_us(ts)) / 1000000.0 AS max_s FROM acks GROUP BY ALL""")
def settle_durations(spark, sf):
    return context.settle_durations(_acked(spark, sf), ["topic"], F.col("timestamp"), F.col("ack_ts"), "status").drop("quantiles")


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_metrics(spark, sf):
    """The value of the last registration of each key."""
    return context.latest_metrics(_events(spark, sf), "user_id", "event_id", "value")


# Codecs --------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_bodies(spark, sf):
    from tidemark.functions.codecs import json_body, to_string_body

    return _events(spark, sf).select("event_id", json_body(to_string_body(F.col("props")), "k long")["k"].alias("k"))


@query("SELECT event_id, event_id % 9 AS schema_id, event_id AS number, event_type AS name FROM events")
def registry_bodies(spark, sf):
    """Registry payloads written and parsed: prefix, a long body and a string body."""
    from tidemark.functions.codecs import long_body, registry_parts, string_body, to_long_body, to_string_body, with_registry_prefix

    e = _events(spark, sf).withColumn("payload", with_registry_prefix(F.col("event_id") % 9, to_long_body(F.col("event_id"))))
    e = e.withColumn("parts", registry_parts(F.col("payload")))
    return e.select("event_id", F.col("parts.schema_id").alias("schema_id"), long_body(F.col("parts.body")).alias("number"), string_body(to_string_body(F.col("event_type"))).alias("name"))


from tidemark.plans import delivery  # noqa: E402, F401  # adds its queries to those above
from tidemark.plans import indexed  # noqa: E402, F401
