"""Operator 11: how far the sources of a language differ in their words, by shards that DuckDB aggregates.

Tasks count the terms of whole texts with DuckDB (by lang and source, with the documents that hold
each term), rows are dealt to shards by a hash of lang and term, and each shard sums its partial counts
with SQL and keeps the terms in enough documents of their language, one row each with the counts of
all sources. Once the groups' totals are known, each shard gives partial sums of absolute differences
for pairs of sources and the leading terms of its groups, with SQL over blocks of terms; Spark adds
the partial sums up and ranks. All arithmetic is on whole numbers, products in 128 bits.

Bounds: DuckDB takes ``MEMORY`` a task and spills beyond it to the task's own folder, which goes at
its end. A task gathers ``PARTS`` partial rows before it sends them on, so a term in a third of all
rows is a few rows for each task and group. Tasks hold the names and totals of ``GROUPS``
groups; more are taken in several passes, by a hash of lang. (A language with more sources than that has
over 10^10 pairs in its result alone.)

Defined cases: null text, lang and source are ''; repeated rows are documents of their own; bytes that are
no UTF-8 count as U+FFFD; an empty table gives no rows; a group without terms has its pairs, a language without
kept terms pairs of value 0; other columns are ignored. A text beyond ``PIECE`` bytes is counted in pieces, cut between terms.
"""

from __future__ import annotations

import re
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import arrow_map, only, slices, spread
from tidemark.session import materialise

#: Terms of a text whose A-Z are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: DuckDB's memory in a task.
MEMORY = "200MB"
#: Partial rows that a task gathers.
PARTS = 400_000
#: Bytes of text that are counted at once, and after which a text is cut.
PIECE = 4 << 20
#: Rows of (term, group) that a shard compares at once.
BLOCK = 100_000
#: Groups whose totals a task holds.
GROUPS = 1 << 18

_NOT_A_TERM = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")


@contextmanager
def _database() -> Iterator:
    """An in-memory database of one thread that spills to a folder of the task."""
    import duckdb

    folder = tempfile.mkdtemp(prefix="duckdb-")
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
    try:
        yield con
    finally:
        con.close()
        shutil.rmtree(folder, ignore_errors=True)


def _rows(con, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from con.execute(sql).to_arrow_table().cast(schema).to_batches(10_000)


def _valid(column: pa.Array) -> pa.Array:
    raw = column.cast(pa.binary())
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def _pieces(text: str) -> Iterator[str]:
    """A long text cut where no term is."""
    a = 0
    while a < len(text):
        end = _NOT_A_TERM.search(text, a + PIECE)
        b = end.end() if end else len(text)
        yield text[a:b]
        a = b


def _portions(b: pa.RecordBatch) -> Iterator[pa.Table]:
    """Tables of doc, lang, source and text with about ``PIECE`` bytes of text, or the pieces of one document."""
    columns = {n: _valid(b.column(n)).fill_null("") for n in ("lang", "source", "text")}
    sizes = pc.binary_length(columns["text"]).to_pylist()
    a = total = 0
    for k, size in enumerate([*sizes, None]):
        if k > a and (size is None or total + size > PIECE):
            text, n = columns["text"].slice(a, k - a), k - a
            if n == 1 and total > PIECE:
                text = pa.array(list(_pieces(text[0].as_py())), pa.string())
            doc = range(n) if n > 1 else [0] * len(text)
            same = lambda c: c.slice(a, n) if n > 1 else pa.array([c[a].as_py()] * len(text), pa.string())  # noqa: B023, E731
            yield pa.table({"doc": pa.array(doc, pa.int64()), "lang": same(columns["lang"]), "source": same(columns["source"]), "text": pc.ascii_lower(text)})
            a, total = k, 0
        total += size or 0


_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches) -> Iterator[pa.RecordBatch]:
    """(lang, source, term): occurrences and documents, in partial counts."""
    compact = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM parts GROUP BY ALL"
    with _database() as con:
        con.execute("CREATE TABLE parts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        for b in slices(batches):
            for portion in _portions(b):
                con.register("portion", portion)
                con.execute(f"""
                    INSERT INTO parts
                    SELECT lang, source, term, sum(n), count(*) FROM (
                        SELECT doc, lang, source, term, count(*) AS n
                        FROM (SELECT doc, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM portion) GROUP BY ALL)
                    GROUP BY lang, source, term""")
                con.unregister("portion")
                if con.execute("SELECT count(*) FROM parts").fetchall()[0][0] > PARTS:
                    con.execute(f"CREATE OR REPLACE TABLE parts AS {compact}")
                    if con.execute("SELECT count(*) FROM parts").fetchall()[0][0] > PARTS // 2:
                        yield from _rows(con, "SELECT * FROM parts", _PARTIAL)
                        con.execute("DELETE FROM parts")
        yield from _rows(con, compact, _PARTIAL)


_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _keep(min_docs: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        with _database() as con:
            con.execute("CREATE TABLE parts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
            for b in batches:
                con.register("b", pa.Table.from_batches([b]))
                con.execute("INSERT INTO parts SELECT * FROM b")
                con.unregister("b")
            sql = f"""
                WITH whole AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs) AS docs FROM parts GROUP BY ALL)
                SELECT lang, term, list(source) AS sources, list(n) AS counts FROM whole GROUP BY lang, term HAVING sum(docs) >= {int(min_docs)}"""
            yield from _rows(con, sql, _KEPT)

    return run


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, sources, counts): terms in at least ``min_docs`` documents of their language, with their occurrences by source."""
    partial = arrow_map(spread(only(docs, "lang", "source", "text")), _count, "lang string, source string, term string, n long, docs long")
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = partial.repartition(shards, "lang", "term")
    return materialise(arrow_map(dealt, _keep(min_docs), "lang string, term string, sources array<string>, counts array<long>"), "terms")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total): every group that occurs, its occurrences of kept terms, and its language's terms and occurrences."""
    groups = docs.select(F.coalesce(F.col("`lang`"), F.lit("")).alias("lang"), F.coalesce(F.col("`source`"), F.lit("")).alias("source")).distinct()
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    return (
        groups.join(each, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["total", "terms"])
        .withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang")))
    )


_FOUND = pa.schema([("part", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("term", pa.string()), ("value", pa.int64())])


def _compare(groups: pa.Table, top: int):
    """Partial pair sums and leading terms of the shards' kept terms, for ``groups`` (gid, lang, source, total, terms, lang_total)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        share = "1 + (1000000000::HUGEINT * (coalesce({}, 0) + 5)) // ({} + 5 * g.terms)"
        with _database() as con:
            con.register("given", groups)
            con.execute("CREATE TABLE g AS SELECT * FROM given")
            con.execute("CREATE TABLE pairs (a BIGINT, b BIGINT, value BIGINT)")
            con.execute("CREATE TABLE tops (a BIGINT, term VARCHAR, value BIGINT)")
            widest = con.execute("SELECT max(n) FROM (SELECT count(*) AS n FROM g GROUP BY lang)").fetchall()[0][0] or 1
            for b in slices(batches, max(1, BLOCK // widest)):
                con.register("b", pa.Table.from_batches([b]))
                con.execute(f"""
                    CREATE OR REPLACE TEMP TABLE p AS
                    WITH block AS (SELECT row_number() OVER () AS t, * FROM b),
                    e AS (SELECT t, lang, unnest(sources) AS source, unnest(counts) AS n FROM block),
                    q AS (SELECT t, sum(n) AS n FROM e GROUP BY t)
                    SELECT block.t, block.term, g.gid, e.n, CAST({share.format("e.n", "g.total")} AS BIGINT) AS p, CAST({share.format("q.n", "g.lang_total")} AS BIGINT) AS q
                    FROM block JOIN g ON g.lang = block.lang JOIN q ON q.t = block.t LEFT JOIN e ON e.t = block.t AND e.source = g.source""")
                con.unregister("b")
                con.execute("INSERT INTO pairs SELECT x.gid, y.gid, sum(abs(x.p - y.p)) FROM p AS x JOIN p AS y ON x.t = y.t AND x.gid < y.gid GROUP BY ALL")
                con.execute("INSERT INTO tops SELECT gid, term, p - q FROM p WHERE n > 0 AND p > q QUALIFY row_number() OVER (PARTITION BY gid ORDER BY p - q DESC, term) <= ?", [top])
                if con.execute("SELECT (SELECT count(*) FROM pairs) + (SELECT count(*) FROM tops)").fetchall()[0][0] > PARTS:
                    con.execute("CREATE OR REPLACE TABLE pairs AS SELECT a, b, sum(value)::BIGINT AS value FROM pairs GROUP BY ALL")
                    con.execute("CREATE OR REPLACE TABLE tops AS SELECT * FROM tops QUALIFY row_number() OVER (PARTITION BY a ORDER BY value DESC, term) <= ?", [top])
                    if con.execute("SELECT count(*) FROM pairs").fetchall()[0][0] > PARTS // 2:
                        yield from _rows(con, "SELECT 'pair' AS part, a, b, NULL AS term, value FROM pairs", _FOUND)
                        con.execute("DELETE FROM pairs")
            yield from _rows(con, "SELECT 'pair' AS part, a, b, NULL AS term, sum(value)::BIGINT AS value FROM pairs GROUP BY a, b", _FOUND)
            yield from _rows(con, f"SELECT 'term' AS part, a, NULL AS b, term, value FROM tops QUALIFY row_number() OVER (PARTITION BY a ORDER BY value DESC, term) <= {int(top)}", _FOUND)

    return run


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources by their distance, and the terms in which a source exceeds its language."""
    spark = docs.sparkSession
    kept = kept_terms(docs, min_docs)
    groups = materialise(group_totals(docs, kept), "groups")
    passes = -(-groups.count() // GROUPS)
    found = []
    for k in range(passes):
        block = groups.where(F.pmod(F.xxhash64("lang"), F.lit(passes)) == k) if passes > 1 else groups
        at = block.orderBy("lang", "source").toArrow()
        at = at.append_column("gid", pa.array(range(at.num_rows), pa.int64()))
        names = spark.createDataFrame(at.select(["gid", "lang", "source"]))
        terms = kept.where(F.pmod(F.xxhash64("lang"), F.lit(passes)) == k) if passes > 1 else kept
        rows = arrow_map(terms, _compare(at, top), "part string, a long, b long, term string, value long")
        sums = rows.where("part = 'pair'").groupBy("a", "b").agg(F.sum("value").alias("value"))
        both = sums.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"), "value")
        other = names.select(F.col("gid").alias("b"), F.col("source").alias("item"))
        pairs = both.select("e.a", "e.b", "value").join(other, "b").select("a", F.lit("pair").alias("part"), "item", "value")
        tops = rows.where("part = 'term'").select("a", "part", F.col("term").alias("item"), "value")
        found.append(pairs.unionAll(tops).join(names, names.gid == F.col("a")).select("lang", "source", "part", "item", "value"))
    bare = groups.where("terms = 0").select("lang", "source")
    others = bare.select(F.col("lang").alias("_l"), F.col("source").alias("item"))
    out = bare.join(others, (F.col("lang") == F.col("_l")) & (F.col("source") != F.col("item"))).select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    for f in found:
        out = out.unionAll(f)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = out.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


#: The audit in DuckDB's SQL. Documents are told apart by row, as ids may repeat.
SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON kept.lang = w.lang AND kept.term = w.term GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
    q AS (SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.n) + 5)) // (t.total + 5 * v.v) AS q
          FROM c JOIN (SELECT lang, sum(total) AS total FROM total GROUP BY lang) AS t ON t.lang = c.lang JOIN v ON v.lang = c.lang GROUP BY c.lang, c.term, t.total, v.v),
    p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(total.total, 0) + 5 * v.v) AS p
          FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN total ON total.lang = g.lang AND total.source = g.source
          LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    found AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
        FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
        UNION ALL
        SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
