"""Queries of delivery: reads, senders, streams, commits, lifecycle, codecs; with the SQL they must equal."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import codecs, collecting
from tidemark.operators import acks, flow, grouping, offset_sets, stateless, windowing
from tidemark.operators.failure import emit_unless, message_has, passing
from tidemark.plans.catalogue import _ACKS_SQL, _GROUP_SQL, _TOPIC_SQL, _acked, _committed, _events, _t, _topic, query
from tidemark.session import materialise, new_dir, ship
from tidemark.sources import commit_log, kafka, queues, ranges, sinks, topics
from tidemark.streaming import commits, config, running, stateful


def _local(spark: SparkSession, label: str) -> str:
    return new_dir(spark, label).removeprefix("file://").removeprefix("file:")


def _stream(spark: SparkSession, sf: str, name: str = "events") -> DataFrame:
    """A table as a stream of one file."""
    schema: StructType = _t(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _finished(stream: DataFrame, batch, mode: str = "append") -> None:
    """Runs a stream's batches through ``batch`` until all that is there was read."""
    q = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", new_dir(stream.sparkSession, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()


# Reads ---------------------------------------------------------------------------


@query(f"WITH {_TOPIC_SQL} SELECT partition, event_type, 'ack' AS status, count(*) AS n FROM topic GROUP BY ALL")
def source_auto_ack(spark, sf):
    """Records count as acknowledged once emitted."""
    return topics.auto_acked(_topic(spark, sf)).groupBy("partition", F.col("value.event_type").alias("event_type"), F.col("_ack").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH {_ACKS_SQL},
    x AS (SELECT *, max(ack_ts) OVER (PARTITION BY partition ORDER BY "offset") AS executed, lead(ack_ts) OVER w AS next_ts, lead(status) OVER w AS next_status
          FROM acks WINDOW w AS (PARTITION BY partition ORDER BY "offset")),
    y AS (SELECT *, coalesce(status = 'ack' AND next_status = 'ack' AND greatest(ack_ts, next_ts) < executed, false) AS collapsed FROM x)
    SELECT partition, "offset", status, collapsed, CASE WHEN NOT collapsed THEN executed END AS executed, ack_ts AS freed FROM y""")
def ack_stream(spark, sf):
    """Arrivals and settlements as a stream of three batches; what executes, collapses and frees its place, in the eager mode."""
    acked = _acked(spark, sf)
    arrive = acked.select("partition", "offset", F.lit(None).cast("string").alias("status"), F.col("timestamp").alias("at"))
    moved = materialise(arrive.unionByName(acked.select("partition", "offset", "status", F.col("ack_ts").alias("at"))), "signals")
    first, last = moved.select(F.min("at"), F.max("at")).first()
    folder, out = new_dir(spark, "ack-stream"), new_dir(spark, "ack-executed")
    for k in range(3):
        low, high = first + k * (last - first) / 3, first + (k + 1) * (last - first) / 3
        part = (F.col("at") >= low) & ((F.col("at") < high) if k < 2 else F.lit(True))
        moved.where(part).coalesce(1).write.mode("append").parquet(folder)  # a batch is a file
    stream = spark.readStream.schema(moved.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    spark.conf.set(stateful.PROVIDER, stateful.ROCKSDB)
    _finished(stateful.frontier_stream(stream, "partition", acks.COMPACT_EAGER), running.idempotent_batches(out), "update")
    got = spark.read.parquet(out)
    return got.select(F.col("key").cast("int").alias("partition"), "offset", "status", "collapsed", F.col("executed").cast("timestamp_ntz").alias("executed"), F.col("freed").cast("timestamp_ntz").alias("freed"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'view'")
def source_stream_manual(spark, sf):
    """An unbounded read, its batches written once each."""
    table = new_dir(spark, "manual")
    kept = stateless.keep(_stream(spark, sf), F.col("event_type") != "view").select("event_id", "user_id", "event_type")
    _finished(kept, running.idempotent_batches(table))
    return spark.read.parquet(table).select("event_id", "user_id", "event_type")


@query("SELECT user_id % 4 AS partition, count(*) AS n, max(event_id) + 1 AS position FROM events GROUP BY ALL")
def source_stream_transactional(spark, sf):
    """Rows and the positions they came from appear together or not at all."""
    table = sinks.Transaction(new_dir(spark, "transaction"))

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = df.select("event_id", (F.col("user_id") % 4).alias("partition"))
        offsets = rows.groupBy("partition").agg((F.max("event_id") + 1).alias("position"))
        assert table.write(rows, batch_id, offsets)
        assert not table.write(rows, batch_id, offsets)  # a repeated batch

    _finished(_stream(spark, sf), batch)
    counted = table.rows(spark).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(table.offsets(spark).groupBy("partition").agg(F.max("position").alias("position")), "partition")


@query("SELECT user_id % 4 AS partition, count(*) AS n, max(event_id) + 1 AS position FROM events GROUP BY ALL")
def source_stream_logged(spark, sf):
    """A stream into a commit log. The first producer's late commit, an aborted batch and a repeated one leave nothing."""
    table = commit_log.CommitLog(spark, new_dir(spark, "commit-log"))
    before = table.producer("copy")
    zombie = before.begin(0)
    zombie.write(_t(spark, sf, "events").select("event_id", (F.col("user_id") % 4).alias("partition")))
    now = table.producer("copy")

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = df.select("event_id", (F.col("user_id") % 4).alias("partition"))
        offsets = rows.groupBy("partition").agg((F.max("event_id") + 1).alias("position"))
        given_up = now.begin(batch_id)
        given_up.write(rows)
        given_up.abort()
        assert now.write(rows, batch_id, offsets)
        assert not now.write(rows, batch_id, offsets)

    _finished(_stream(spark, sf), batch)
    try:
        zombie.commit()
        raise AssertionError("a replaced producer committed")
    except commit_log.Fenced:
        zombie.abort()
    counted = table.rows().groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(table.offsets().groupBy("partition").agg(F.max("position").alias("position")), "partition")


@query(f"""WITH {_TOPIC_SQL} SELECT topic, partition, "offset", CAST(user_id AS VARCHAR) AS key, event_type AS value, 'h' || event_id AS header FROM topic""")
def source_kafka_records(spark, sf):
    """The connector's columns, built from the topic, through the record plan."""
    rows = _topic(spark, sf)
    out = kafka.outgoing(rows.select("*", F.map_from_arrays(F.array(F.lit("id")), F.array(F.concat(F.lit("h"), F.col("value.event_id").cast("string")))).alias("h")), F.col("topic"), F.col("value.event_type"), F.col("key"), F.col("h"), F.col("partition"))
    both = rows.select("offset", "timestamp", "topic", "partition", F.col("value.event_type").cast("binary").alias("value"), F.col("key").cast("string").cast("binary").alias("key"), F.array(F.struct(F.lit("id").alias("key"), F.concat(F.lit("h"), F.col("value.event_id").cast("string")).cast("binary").alias("value"))).alias("headers"))
    assert set(out.columns) <= set(both.columns)
    return kafka.records(both).select("topic", "partition", "offset", "key", "value", F.col("headers")["id"].alias("header"))


@query(f"""WITH {_GROUP_SQL}
    SELECT t.partition, CAST(CASE t.partition WHEN 2 THEN 0 WHEN 1 THEN 0 ELSE 1 END AS INTEGER) AS wave, count(*) AS n, max(t."offset") + 1 AS committed
    FROM topic t JOIN grp g USING (topic, partition) WHERE t.partition <> 3 AND t."offset" >= g.committed GROUP BY t.partition""")
def range_waves(spark, sf):
    """From the group's position to the end, partitions in falling order, two at a time; what each wave commits."""
    records, committed = _topic(spark, sf), _committed(spark, sf)
    provider = ranges.RangeProvider(ranges.group().to(ranges.latest())).in_partition_order(descending=True, max_concurrent=2)
    found = ranges.resolve(records, provider, committed)
    out = None
    for k, (rows, positions) in enumerate(ranges.read_in_waves(records, found)):
        one = rows.groupBy("partition").agg(F.count(F.lit(1)).alias("n")).join(positions.select("partition", "committed"), "partition").withColumn("wave", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.select("partition", "wave", "n", "committed")


# Senders -------------------------------------------------------------------------


def _refuses(error: str):
    """A sink that refuses rows whose value says ``error``."""

    def sink(rows) -> Iterator[str | None]:
        for r in rows:
            yield "refused" if r["value"] == error else None

    return sink


def _outgoing(spark, sf):
    return sinks.outgoing(_events(spark, sf), F.concat(F.lit("out-"), F.col("event_type")), F.col("user_id").cast("string"), F.col("event_type"), "event_id")


@query("SELECT event_id, 'out-' || event_type AS topic, 'ack' AS status FROM events")
def send_immediate(spark, sf):
    """Every row is sent; the first error would fail the query."""
    return sinks.settle(sinks.send(_outgoing(spark, sf), _refuses("none"))).select("event_id", "topic", F.col("_ack").alias("status"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'refused' END AS error, CASE WHEN event_type = 'error' THEN 'nack' ELSE 'ack' END AS status FROM events")
def send_delegate_error(spark, sf):
    """Errors come back as results."""
    return sinks.settle(sinks.send(_outgoing(spark, sf), _refuses("error"), "delegate", batch=100)).select("event_id", F.col(sinks.ERROR).alias("error"), F.col("_ack").alias("status"))


@query("SELECT event_type AS value, count(*) AS n, 'refused' AS raised FROM events GROUP BY event_type")
def send_delay_error(spark, sf):
    """Everything is sent before the first error is raised."""
    sent = sinks.send(_outgoing(spark, sf), _refuses("error"), "delegate")
    try:
        sinks.send(_outgoing(spark, sf), _refuses("error"), "delay")
        raised = None
    except sinks.SendError as error:
        raised = str(error)
    return sent.groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("raised", F.lit(raised))


@query("SELECT CAST(event_id % 3 AS INTEGER) AS batch, count(*) AS n FROM events GROUP BY ALL")
def send_transactional(spark, sf):
    """Three batches, each whole; the second time nothing is written."""
    table, events = new_dir(spark, "sent"), _events(spark, sf).select("event_id")
    parts = [events.where(F.col("event_id") % 3 == k) for k in range(3)]
    assert sinks.send_transactional(parts, table) == [True] * 3
    assert sinks.send_transactional(parts, table) == [False] * 3
    return spark.read.parquet(table).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS group_id, event_type AS body FROM events WHERE event_type = 'error'")
def send_queue_messages(spark, sf):
    """Rows sent as messages of a queue and read back; each one once."""
    queues.register(spark)
    folder = _local(spark, "queue")
    rows = _events(spark, sf).where("event_type = 'error'")
    out = rows.select(F.col("event_type").alias("body"), F.col("user_id").cast("string").alias("group_id"), F.col("event_id").cast("string").alias("dedup_id"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("attributes"))
    for _ in range(2):  # what is known by its dedup id isn't stored again
        out.write.format("tidemark_queue").mode("append").option("path", folder).save()
    return spark.read.format("tidemark_queue").option("path", folder).load().select(F.col("attributes")["id"].cast("long").alias("event_id"), "group_id", "body")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS different FROM events WHERE event_type = 'purchase'")
def receive_queue_messages(spark, sf):
    """A queue as a stream; what a batch committed is gone from it."""
    queues.register(spark)
    folder, table = _local(spark, "queue"), new_dir(spark, "received")
    _events(spark, sf).where("event_type = 'purchase'").select(F.col("event_id").cast("string").alias("body"), F.lit(None).cast("string").alias("group_id"), F.lit(None).cast("string").alias("dedup_id"), F.lit(None).cast("map<string,string>").alias("attributes")).write.format("tidemark_queue").mode("append").option("path", folder).save()
    stream = spark.readStream.format("tidemark_queue").option("path", folder).load().select("body")
    write = running.idempotent_batches(table)
    q = stream.writeStream.foreachBatch(lambda df, k: write(df, k)).option("checkpointLocation", new_dir(spark, "checkpoint")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(table).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("body").alias("different"))


@query("SELECT event_type, count(*) AS sent, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS queued FROM events GROUP BY event_type")
def send_folder_sink(spark, sf):
    """A sink on executors; a null body is that row's error."""
    folder = _local(spark, "queue")
    rows = sinks.outgoing(_events(spark, sf), F.lit("t"), F.col("user_id"), F.when(F.col("event_type") == "error", F.col("event_type")), "event_type")
    done = sinks.settle(sinks.send(rows, sinks.folder_sink(folder), "delegate"))
    queues.register(spark)
    assert spark.read.format("tidemark_queue").option("path", folder).load().count() == done.where("_ack = 'ack'").count()
    return done.groupBy("event_type").agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.col("_ack") == "ack").alias("queued"))


@query("""
    SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS batch_no, event_id FROM events WHERE event_type = 'click'""")
def sender_batches(spark, sf):
    """Batches of eight; the duration of a year never ends one."""
    rows = _events(spark, sf).where("event_type = 'click'")
    return windowing.sender_batches(rows, ["user_id"], "ts", ["event_id"], 8, 365 * 86400.0).select("user_id", F.col(windowing.NO).alias("batch_no"), "event_id")


@query("SELECT event_type, 'ack' AS status, count(*) AS n FROM events GROUP BY event_type")
def acknowledged_results(spark, sf):
    """The default subscriber acknowledges what it gets."""
    return sinks.acknowledge_all(_events(spark, sf)).groupBy("event_type", F.col("_ack").alias("status")).agg(F.count(F.lit(1)).alias("n"))


_BINDINGS = [("errors", "events.error"), ("all", "events.#"), ("three", "events.*"), ("none", "other.*")]


@query("""SELECT * FROM (SELECT event_type, 'all' AS queue FROM events UNION SELECT event_type, 'three' FROM events UNION SELECT event_type, 'errors' FROM events WHERE event_type = 'error')""")
def routed_queues(spark, sf):
    """Queues that each event type reaches through a topic exchange."""
    types = sorted(r.event_type for r in _events(spark, sf).select("event_type").distinct().collect())
    return spark.createDataFrame([(t, q) for t in types for q in queues.routed("x", _BINDINGS, "topic", f"events.{t}")], "event_type string, queue string")


# Rows ----------------------------------------------------------------------------


@query("SELECT event_id, TRY_CAST(substr(props, 7, length(props) - 7) AS INTEGER) AS k, 'ok' AS status FROM events WHERE TRY_CAST(substr(props, 7, length(props) - 7) AS INTEGER) < 50")
def emit_unless_ignored(spark, sf):
    """Matching errors are dropped, and there are no others to emit."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = stateless.map_rows(_events(spark, sf), F.when(k >= 50, F.lit("too large")), emit_unless(message_has("too large")), k=k)
    return passing(rows).select("event_id", "k", F.col("_ack").alias("status"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_type = 'view' THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS INTEGER) AS n, CASE WHEN event_type = 'view' THEN 'nacked' ELSE 'ok' END AS status FROM events")
def cast_delegated(spark, sf):
    """Values that can't be cast are nacked."""
    from tidemark.operators.failure import delegate

    text = F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("user_id").cast("string"))
    return stateless.cast(_events(spark, sf).withColumn("n", text), "n", "int", delegate()).select("event_id", "n", F.col("_ack").alias("status"))


@query("SELECT event_id, value FROM events WHERE event_type = 'click'")
def delayed_transformed(spark, sf):
    """Rows held until a trigger, then any function of tables; the hook sees them all."""
    opened = threading.Event()
    rows = stateless.delay_until(_events(spark, sf), opened.set)
    assert opened.is_set()
    return rows.transform(lambda df: df.where("event_type = 'click'").select("event_id", "value"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def tapped_rows(spark, sf):
    """Metrics of the rows that pass, read after the query ran."""
    seen = stateless.tap(_events(spark, sf), "tap", total=F.sum("value"))
    return seen.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT 'batch' AS signal, count(*) AS n FROM events UNION ALL SELECT 'acknowledge', count(*) FROM events UNION ALL SELECT 'commit', count(*) FROM events")
def acknowledge_hook(spark, sf):
    """The hook runs after a batch and before its commit."""
    log: list[tuple[str, int]] = []
    table = new_dir(spark, "hook")

    def process(df: DataFrame, batch_id: int) -> DataFrame:
        sinks.Transaction(table).write(df.select("event_id"), batch_id)
        log.append(("batch", df.count()))
        return df.select(F.lit("events").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("position"))

    committer = commits.GroupCommitter(lambda at: log.append(("commit", sum(at.values()) + 1)))
    _finished(_stream(spark, sf), commits.committing_batches(process, committer, lambda acked, _: log.append(("acknowledge", acked.count()))))
    assert [name for name, _ in log] == ["batch", "acknowledge", "commit"]
    return spark.createDataFrame(log, "signal string, n long")


# Groups --------------------------------------------------------------------------


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def grouped_rows(spark, sf):
    """Groups by a key, counted inside."""
    g = grouping.group_by(_events(spark, sf), F.col("event_type"))
    return g.groupBy(F.col(grouping.GROUP).alias("event_type"), "user_id").agg(F.count(F.lit(1)).alias("n"))


# Acknowledgement -----------------------------------------------------------------


@query(f"""WITH {_ACKS_SQL} SELECT partition, "offset" FROM acks WHERE status = 'ack' AND "offset" >= 100 AND event_id % 3 <> 0""")
def offset_metadata(spark, sf):
    """Offsets behind 99, as the text that is committed with it and back."""
    got = offset_sets.offset_set(_acked(spark, sf).where("status = 'ack' and value.event_id % 3 <> 0"), ["partition"], "offset")
    bases = got.select("partition").distinct().withColumn("base", F.lit(99).cast("long"))
    return offset_sets.from_metadata(offset_sets.metadata(got, bases, ["partition"]), ["partition"])


@query(f"WITH {_ACKS_SQL} SELECT partition, count(*) AS position FROM acks GROUP BY partition")
def committed_positions(spark, sf):
    """Positions committed over a store that fails at first; what is stale by then isn't committed."""
    counts = {("events", r.partition): r["n"] for r in _acked(spark, sf).groupBy("partition").agg(F.count(F.lit(1)).alias("n")).collect()}
    store: dict = {}
    failures = [1, 1]

    def commit(at: dict) -> None:
        if failures:
            failures.pop()
            raise commits.RetriableCommit("not now")
        store.update(at)

    c = commits.GroupCommitter(commit, max_attempts=5)
    epochs = c.assigned(counts)
    stale = c.plan({p: 1 for p in counts}, epochs)
    current = c.plan(counts, epochs)
    assert c.run(stale) == {}
    c.run(current)
    return spark.createDataFrame([(p, n) for (_, p), n in store.items()], "partition int, position long")


@query(f"WITH {_ACKS_SQL} SELECT partition, max(\"offset\") + 1 AS position FROM acks WHERE status = 'ack' AND partition < 2 GROUP BY partition")
def commit_on_revoke(spark, sf):
    """Partitions that are taken away get their last commit within the grace period; later ones are refused."""
    last = {("events", r.partition): r.position for r in _acked(spark, sf).where("status = 'ack'").groupBy("partition").agg((F.max("offset") + 1).alias("position")).collect()}
    store: dict = {}
    c = commits.GroupCommitter(store.update)
    epochs = c.assigned(last)
    planned = c.plan(last, epochs)
    taken = [p for p in last if p[1] < 2]
    c.revoked(taken, lambda _: 0, 1.0)
    assert set(c.run({p: planned[p] for p in taken})) == set()
    return spark.createDataFrame([(p, n) for (_, p), n in store.items()], "partition int, position long")


@query(f"""WITH {_ACKS_SQL},
    s AS (SELECT *, (row_number() OVER (ORDER BY ack_ts, event_id) - 1) // 500 AS window_no FROM acks)
    SELECT window_no, partition, arg_max("offset", (ack_ts, event_id)) + 1 AS position FROM s GROUP BY ALL""")
def commit_windows_timed(spark, sf):
    """Commit windows of 500 acknowledgements or a year, all partitions of a consumer together."""
    rows = _acked(spark, sf).select("partition", "offset", "ack_ts", F.col("value.event_id").alias("event_id"), F.lit("c").alias("consumer"))
    return windowing.commit_windows(rows, ["consumer"], "ack_ts", ["ack_ts", "event_id"], ["partition"], "offset", 500, 365 * 86400.0, chunk=F.floor(F.unix_micros(F.col("ack_ts").cast("timestamp")) / 86_400_000_000), piece=2000).select(F.col(windowing.NO).alias("window_no"), "partition", "position")


# Flow ----------------------------------------------------------------------------


@query(f"""WITH {_GROUP_SQL} SELECT partition, latest - coalesce(committed, earliest) AS lag FROM grp""")
def natural_order(spark, sf):
    """All partitions with their lag, as they are."""
    return flow.natural(ranges.lag(_topic(spark, sf), _committed(spark, sf), "earliest")).select("partition", "lag")


@query("SELECT poll, n, 512 - n >= 256 AS admitted FROM (SELECT event_id // 700 AS poll, least(512, count(*)) AS n FROM events GROUP BY 1)")
def poll_admission(spark, sf):
    """A poll may run while there is room for all it can bring."""
    held = _events(spark, sf).groupBy(F.floor(F.col("event_id") / 700).alias("poll")).agg(F.least(F.lit(512), F.count(F.lit(1))).alias("n"))
    return held.select("poll", "n", flow.admission(512 - F.col("n"), 256).alias("admitted"))


@query("""
    WITH t AS (SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS DOUBLE) AS s FROM events WHERE event_id < 500)
    SELECT event_id, round(greatest(0, (s - 5) / 5.0), 6) AS release_s FROM t""")
def limit_per_second(spark, sf):
    """Five a second from arrivals that are all at once, one bucket for all, in chunks."""
    rows = _events(spark, sf).where("event_id < 500")
    rate = flow.per_second_rate(5.9)
    out = flow.release_times(rows, [], ["event_id"], F.lit(0.0), rate, 1.0, chunk=F.floor(F.col("event_id") / 64))
    return out.select("event_id", F.round("release_s", 6).alias("release_s"))


@query("""
    WITH m AS (SELECT n_name AS member, n_nationkey % 3 AS machine, row_number() OVER (PARTITION BY n_nationkey % 3 ORDER BY n_name) - 1 AS place,
                      count(*) OVER (PARTITION BY n_nationkey % 3) AS members FROM nation),
    p AS (SELECT r_name AS topic, i AS partition FROM region, range(7) t(i))
    SELECT p.topic, CAST(p.partition AS INTEGER) AS partition, m.member FROM p JOIN m ON m.machine = 0 AND p.partition % m.members = m.place""")
def assigned_partitions(spark, sf):
    """All partitions of a topic go to the members of the oldest machine, dealt over their sorted names."""
    regions = [r.r_name for r in _t(spark, sf, "region").select("r_name").collect()]
    members = {r.n_name: (float(r.n_nationkey % 3), f"m{r.n_nationkey % 3}", regions) for r in _t(spark, sf, "nation").collect()}
    got = flow.assign_single_machine(dict.fromkeys(regions, 7), members)
    return spark.createDataFrame([(t, p, m) for m, ps in got.items() for t, p in ps], "topic string, partition int, member string")


@query("SELECT n_name AS consumer, n_nationkey = (SELECT max(n_nationkey) FROM nation) AS may_act FROM nation")
def mutex_consumers(spark, sf):
    """Of consumers that took a ticket one after another only the newest may act."""
    mutex = flow.ConsumerMutex()
    names = [r.n_name for r in _t(spark, sf, "nation").orderBy("n_nationkey").collect()]
    tickets = {n: mutex.ticket() for n in names}

    def may(check) -> bool:
        try:
            check()
        except RuntimeError:
            return False
        return True

    return spark.createDataFrame([(n, may(t)) for n, t in tickets.items()], "consumer string, may_act boolean")


# Lifecycle and configuration -----------------------------------------------------


class _Idle:
    def stop(self) -> None: ...


@query("SELECT r_name || CASE WHEN k = 0 THEN '' ELSE '-c' || k END AS name, CASE WHEN r_regionkey = 0 THEN 'STOPPED' ELSE 'STARTED' END AS state FROM region, range(0, 4) t(k) WHERE (r_regionkey % 2 = 0 AND k = 0) OR (r_regionkey % 2 = 1 AND k > 0)")
def stream_states(spark, sf):
    """Streams and composites of three copies: started, one stopped again; their status by name."""
    parts: list[running.Stream] = []
    for r in _t(spark, sf, "region").collect():
        parts += running.CompositeStream(r.r_name, 3 if r.r_regionkey % 2 else 1, lambda name: _Idle()).start().streams
    status = running.StreamStatus(parts)
    first = next(r.r_name for r in _t(spark, sf, "region").where("r_regionkey = 0").collect())
    status.stop(first)
    return spark.createDataFrame([(s["name"], s["state"]) for s in status.list()], "name string, state string")


@query("SELECT 1 AS step, 'STARTED' AS state UNION ALL SELECT 2, 'STARTED' UNION ALL SELECT 3, 'STOPPED' UNION ALL SELECT 4, 'STOPPED' UNION ALL SELECT 5, 'STARTED'")
def started_stopped(spark, sf):
    """Signals start and stop a stream; repeated ones do nothing."""
    stream = running.Stream("s", _Idle)
    control = running.StarterStopper(stream)
    out = []
    for k, on in enumerate([True, True, False, False, True], 1):
        control.apply([on])
        out.append((k, stream.state))
    return spark.createDataFrame(out, "step int, state string")


@query("SELECT r_name AS name, 'r' || r_regionkey AS client, CAST(r_regionkey * 60 AS BIGINT) AS period_s, r_regionkey % 2 = 1 AS enabled FROM region")
def configured_values(spark, sf):
    """Properties of a namespace over defaults, converted."""
    out = []
    for r in _t(spark, sf, "region").collect():
        source = config.ConfigSource("unset").with_all({"defaults.enabled": "false", "x.client": f"r{r.r_regionkey}", "x.period": f"PT{r.r_regionkey}M"}).with_("x.enabled", "true" if r.r_regionkey % 2 else None)
        own = {k: v for k, v in config.namespaced(source.create(), "x").items() if v is not None}
        merged = {"enabled": "false", **own}
        out.append((r.r_name, config.load(merged, "client", str), int(config.load(merged, "period", config.duration).total_seconds()), config.load(merged, "enabled", config.boolean)))
    return spark.createDataFrame(out, "name string, client string, period_s long, enabled boolean")


@query("SELECT 2 AS restarts, count(*) AS n FROM events")
def resubscribed_stream(spark, sf):
    """A stream that fails twice goes on from its checkpoint and loses and doubles nothing."""
    table, checkpoint = new_dir(spark, "resubscribed"), new_dir(spark, "checkpoint")
    failures = [1, 1]

    def batch(df: DataFrame, batch_id: int) -> None:
        sinks.Transaction(table).write(df.select("event_id"), batch_id)
        if failures:
            failures.pop()
            raise RuntimeError("after the write")

    def start():
        return _stream(spark, sf).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    restarts = running.resubscribe(start, 0.0)
    return spark.read.parquet(table).agg(F.lit(restarts).alias("restarts"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, 1 AS batches FROM events")
def counted_signals(spark, sf):
    """Progress of a query: batches with rows, and rows."""
    table = new_dir(spark, "counted")
    q = _stream(spark, sf).writeStream.foreachBatch(running.idempotent_batches(table)).option("checkpointLocation", new_dir(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    progress = [p for p in q.recentProgress if p["numInputRows"]]
    return spark.createDataFrame([(sum(p["numInputRows"] for p in progress), len(progress))], "n long, batches int")


# Codecs and helpers --------------------------------------------------------------

_EVENT_FIELDS = {1: ("event_id", "int64"), 2: ("event_type", "string"), 3: ("user_id", "int64")}
_EVENT_AVRO = {"type": "record", "name": "E", "fields": [{"name": "event_id", "type": "long"}, {"name": "event_type", "type": "string"}, {"name": "amount", "type": ["null", "double"]}]}


def _coded(df: DataFrame, encode, decode, schema: str) -> DataFrame:
    """Each row encoded to bytes and decoded again, a batch of rows at a time."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([decode(encode(r)) for r in b.to_pylist()], schema=b.schema)

    return df.mapInArrow(run, schema)


@query("SELECT event_id, event_type, user_id FROM events")
def protobuf_round_trip(spark, sf):
    rows = _events(spark, sf).select("event_id", "event_type", "user_id")
    return _coded(rows, lambda r: codecs.proto_encode(_EVENT_FIELDS, r), lambda d: codecs.proto_decode(_EVENT_FIELDS, d), "event_id long, event_type string, user_id long")


@query("SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS amount FROM events")
def avro_round_trip(spark, sf):
    rows = _events(spark, sf).select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("amount"))
    return _coded(rows, lambda r: codecs.avro_encode(_EVENT_AVRO, r), lambda d: codecs.avro_decode(_EVENT_AVRO, d), "event_id long, event_type string, amount double")


@query("SELECT n_nationkey, CAST(floor(log2(n_nationkey + 1)) AS INTEGER) AS magnitude FROM nation")
def floor_logarithms(spark, sf):
    return _t(spark, sf, "nation").select("n_nationkey", collecting.floor_log2_column(F.col("n_nationkey") + 1).cast("int").alias("magnitude"))


@query("""
    SELECT n_nationkey, n_regionkey = (SELECT max(n_regionkey) FROM nation) AS greatest, n_nationkey <= 9 AS taken, n_nationkey % 5 <> 0 AS different FROM nation""")
def collected_nations(spark, sf):
    """Greatest with ties, up to and with the first that matches, and a difference, over a list of nations."""
    rows = sorted((r.n_nationkey, r.n_regionkey) for r in _t(spark, sf, "nation").collect())
    top = collecting.greatest_with_ties(rows, lambda r: r[1])
    head = collecting.take_until(rows, lambda r: r[0] == 9)
    rest = collecting.difference(rows, [r for r in rows if r[0] % 5 == 0])
    return spark.createDataFrame([(r[0], r in top, r in head, r in rest) for r in rows], "n_nationkey int, greatest boolean, taken boolean, different boolean")


@query(f"""WITH {_ACKS_SQL} SELECT partition, "offset" FROM acks WHERE "offset" >= 50 AND NOT ("offset" BETWEEN 60 AND 79) AND NOT ("offset" BETWEEN 100 AND 149)""")
def restart_ranges(spark, sf):
    """Records to process after a restart: past the position, outside of overlapping ranges ahead of it."""
    records = _topic(spark, sf)
    parts = records.select("partition").distinct()
    spans = spark.createDataFrame([(60, 79), (65, 70), (100, 120), (110, 149)], "start long, end long")
    done = parts.crossJoin(F.broadcast(spans)).withColumn("position", F.lit(50).cast("long"))  # four rows for each of a few partitions
    return acks.unprocessed(records, done, ["partition"], "offset").select("partition", "offset")
