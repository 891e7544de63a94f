"""Mixing sources to target weights: temperature, bisection, budgeted block permutations.

Everything here is DataFrame operations; the driver only steers the bisection.

1. A source's share p is its words by all words. Its weight at exponent a is
   p^a / sum(p^a): a = 1 keeps the shares, a = 0 levels them.
2. ``target_entropy`` asks for the largest exponent with at least that entropy, given as a
   part of the logarithm of the number of sources; ``max_epochs`` for the smallest exponent
   at which no source is repeated more often than that. Both are monotone in the
   exponent; each is bisected, and the larger exponent (the limit on repetition wins) is
   taken. A step is one aggregate over the source table that tries 15 inner points, so ten
   steps halve the interval 40 times.
3. Weights times the budget give tokens for each source. A source's documents are dealt by
   hash into blocks of about ``block_rows``; each pass over the source is a new permutation
   of its blocks and of the documents in each. The budget buys whole passes, then blocks of
   the next pass in its order as far as it reaches, and documents of the block it ends in.
4. The mixture's order: a block stands at its source's progress, (pass + place of the block in
   the pass) by the passes that the budget buys, so that every stretch of the mixture has the sources in their
   weights; inside a block, documents by their permutation. ``mixture`` numbers rows by it, from
   counts of blocks and of superblocks.

Budget: ``budget_tokens``, or with None the smallest at which every source is taken whole
at least once, so that nothing is lost.

A hot source is only ever summed in parts: partial aggregates by source and block, and
running sums inside a superblock of blocks and then over superblocks. No task holds a
source.

Cases. A null source is a source of its own. A null or empty text has no words: it has no
part in the weights and is placed with its block; a source without any words has weight
zero and is passed once, so its rows aren't lost. Null ids and repeated rows are rows like others (their
order is that of the hash of id and text). One source: weight one. An empty table gives no
rows. Extra columns are kept by ``mixed_documents`` and ignored by ``mix_plan``.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import free_names
from tidemark.session import materialise

TARGET_ENTROPY, MAX_EPOCHS = 0.9985, 4.0
BLOCK_ROWS, SUPER = 1000, 256
#: Parts of the mixture in which blocks are numbered, and to which written rows are dealt.
STRETCHES = 4096
STEPS, POINTS = 10, 15
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts) -> Column:
    """A number from 0 to under 1 from the first 12 hex digits of an MD5; any engine can repeat it."""
    key = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_shares(docs: DataFrame) -> DataFrame:
    """src, n_rows, tokens and share of each source."""
    by = docs.groupBy(F.col("source").alias("src")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(n_words()).alias("tokens"))
    by = materialise(by, "source-counts")
    total = by.agg(F.sum("tokens")).first()[0] or 1
    return by.select("src", "n_rows", "tokens", (F.col("tokens") / F.lit(total)).alias("share"))


def _tried(shares: DataFrame, points: list[float], budget: float | None) -> dict[float, tuple[float, float]]:
    """exponent -> (entropy of the weights, most passes over a source).

    ``budget`` is in parts of the corpus; None is the one that takes every source once.
    """
    p = F.col("share")
    aggs = []
    for k, a in enumerate(points):
        w = F.pow(p, F.lit(a))
        aggs += [F.sum(w).alias(f"z{k}"), F.sum(w * F.lit(a) * F.log(p)).alias(f"l{k}"), F.max(w / p).alias(f"r{k}"), F.min(w / p).alias(f"m{k}")]
    row = shares.where(p > 0).agg(*aggs).first()
    most = {k: row[f"r{k}"] / row[f"m{k}"] if budget is None else row[f"r{k}"] / row[f"z{k}"] * budget for k in range(len(points))}
    return {a: (math.log(row[f"z{k}"]) - row[f"l{k}"] / row[f"z{k}"], most[k]) for k, a in enumerate(points)}


def _bisect(shares: DataFrame, holds, budget: float | None, low: float = 0.0, high: float = 1.0) -> float:
    """The border between exponents where ``holds(entropy, epochs)`` fails (below) and holds (above)."""
    for _ in range(STEPS):
        points = [low + (high - low) * k / (POINTS + 1) for k in range(1, POINTS + 1)]
        tried = _tried(shares, points, budget)
        # bisect among the points that were tried together
        marks = [low, *points, high]
        a, b = 0, len(marks) - 1
        while b - a > 1:
            m = (a + b) // 2
            a, b = (a, m) if holds(*tried[marks[m]]) else (m, b)
        low, high = marks[a], marks[b]
    return high


def exponent(shares: DataFrame, target_entropy: float | None = TARGET_ENTROPY, max_epochs: float | None = MAX_EPOCHS, budget_tokens: int | None = None) -> float:
    """The exponent that meets the targets; 1.0 if none is asked for."""
    n, total = shares.where("share > 0").agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if n <= 1 or (target_entropy is None and max_epochs is None):
        return 1.0
    budget = None if budget_tokens is None else budget_tokens / total
    ends = _tried(shares, [0.0, 1.0], budget)
    out = 0.0
    if target_entropy is not None:
        goal = target_entropy * math.log(n)
        out = 1.0 if ends[1.0][0] >= goal else 0.0 if ends[0.0][0] <= goal else _bisect(shares, lambda h, _: h <= goal, budget)
    if max_epochs is not None and ends[0.0][1] > max_epochs:
        out = max(out, 1.0 if ends[1.0][1] >= max_epochs else _bisect(shares, lambda _, e: e <= max_epochs, budget))
    return out


def mix_weights(docs: DataFrame, target_entropy: float | None = TARGET_ENTROPY, max_epochs: float | None = MAX_EPOCHS, budget_tokens: int | None = None) -> DataFrame:
    """src, n_rows, tokens, share, weight, budget (tokens) of each source."""
    shares = materialise(source_shares(docs), "shares")
    a = exponent(shares, target_entropy, max_epochs, budget_tokens)
    raw = F.when(F.col("share") > 0, F.pow("share", F.lit(a))).otherwise(F.lit(0.0))
    z, cover = shares.agg(F.sum(raw), F.max(F.when(F.col("share") > 0, F.col("tokens") / raw))).first()
    z, cover = z or 1.0, cover or 0.0
    scale = F.lit(cover) if budget_tokens is None else F.lit(float(budget_tokens) / z)
    weighted = shares.select("src", "n_rows", "tokens", "share", (raw / F.lit(z)).alias("weight"), F.round(raw * scale).cast("long").alias("budget"))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("long")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / BLOCK_ROWS)).cast("long")
    return weighted.withColumn("passes", whole).withColumn("left", F.when(F.col("tokens") > 0, F.col("budget") - whole * F.col("tokens")).otherwise(F.lit(0)).cast("long")).withColumn("blocks", blocks)


def mix_plan(docs: DataFrame, weights: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of the mixture as doc_id, source, key (hash of id and text), words, block, epoch, at and place.

    ``at`` orders blocks in the mixture: progress in their source. ``place`` orders the rows of a block.
    """
    weights = materialise(weights, "weights")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_column).cast("string"), F.lit("~")), F.coalesce(F.md5("text"), F.lit("~"))))
    rows = docs.select(F.col(id_column).alias("doc_id"), "source", key.alias("key"), n_words().alias("words"))
    join = F.col("source").eqNullSafe(F.col("src"))
    # one row for each source; beyond the size that Spark broadcasts by itself it is a shuffled join
    reach = F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(F.lit(1.0))
    placed = rows.join(weights.select("src", "passes", "left", "blocks", reach.alias("reach")), join).withColumn("block", F.floor(unit_hash(F.lit("block"), F.col("key")) * F.col("blocks")).cast("long"))
    placed = materialise(placed.drop("src"), "placed")

    # the pass that the budget doesn't buy whole: blocks in a permuted order, summed in two levels
    part = placed.where("left > 0")
    order = unit_hash(F.lit("pass"), F.col("source"), F.col("passes"), F.col("block"))
    per_block = part.groupBy("source", "passes", "left", "blocks", "block").agg(F.sum("words").alias("w")).withColumn("order", order)
    # a superblock is a range of the permuted order
    per_block = per_block.withColumn("super", F.floor(F.col("order") * F.ceil(F.col("blocks") / SUPER)).cast("long"))
    per_super = per_block.groupBy("source", "super").agg(F.sum("w").alias("sw"))
    before_super = per_super.withColumn("sb", F.coalesce(F.sum("sw").over(Window.partitionBy("source").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("source").alias("s1"), F.col("super").alias("u1"), "sb")
    inside = F.coalesce(F.sum("w").over(Window.partitionBy("source", "super").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    started = (
        per_block.withColumn("in", inside)
        .join(before_super, F.col("source").eqNullSafe(F.col("s1")) & (F.col("super") == F.col("u1")))
        .withColumn("before", F.col("sb") + F.col("in"))
        .where("before < left")
        .select(F.col("source").alias("s2"), F.col("block").alias("b2"), "before", (F.col("before") + F.col("w") <= F.col("left")).alias("whole"))
    )
    taken = part.join(started, F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
    # the block in which the budget ends is cut at a document
    cut = taken.where("not whole")
    running = F.sum("words").over(Window.partitionBy("source", "block").orderBy(unit_hash(F.lit("row"), F.col("passes"), F.col("key")), "key").rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn("run", F.coalesce(running, F.lit(0))).where(F.col("before") + F.col("run") < F.col("left"))
    columns = ["doc_id", "source", "key", "words", "block", "reach"]
    partial = taken.where("whole").select(*columns, F.col("passes").alias("epoch")).unionByName(cut.select(*columns, F.col("passes").alias("epoch")))
    full = placed.where("passes > 0").select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).alias("epoch"))
    out = full.unionByName(partial)
    block_place = unit_hash(F.lit("pass"), F.col("source"), F.col("epoch"), F.col("block"))
    return out.withColumn("at", (F.col("epoch") + block_place) / F.col("reach")).withColumn("place", unit_hash(F.lit("row"), F.col("epoch"), F.col("key"))).drop("reach")


def mixed_documents(docs: DataFrame, target_entropy: float | None = TARGET_ENTROPY, max_epochs: float | None = MAX_EPOCHS, budget_tokens: int | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, with the same columns.

    Rows that repeat an id and a text have the same number of copies each. The rows' order is not
    among those columns; ``scattered`` gives one for what is written of them.
    """
    plan = mix_plan(docs, mix_weights(docs, target_entropy, max_epochs, budget_tokens))
    own, k, times, copy = free_names(docs, "mix_key", "mix_of", "mix_times", "mix_copy")
    counted = plan.groupBy(F.col("key").alias(k)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("epoch") == 0).alias("rows"))
    copies = counted.select(k, F.greatest(F.lit(1), F.floor(F.col("n") / F.greatest(F.col("rows"), F.lit(1)))).cast("int").alias(times))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.coalesce(F.md5("text"), F.lit("~"))))
    joined = docs.withColumn(own, key).join(copies, F.col(own) == F.col(k))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def positions(plan: DataFrame) -> DataFrame:
    """``plan`` with position, a row's number in the mixture from 0."""
    rows = materialise(plan, "mixture-rows")
    block = ["source", "epoch", "block"]
    name = F.coalesce("source", F.lit("~"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("place", "key")) - 1
    stretch = F.floor(F.least("at", F.lit(1.0)) * STRETCHES)
    blocks = materialise(rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).withColumn("stretch", stretch), "mixture-blocks")
    # one row for each stretch, at most STRETCHES and one
    ahead = blocks.groupBy("stretch").agg(F.sum("n").alias("sn")).select(F.col("stretch").alias("s1"), F.coalesce(F.sum("sn").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sb"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("stretch").orderBy("at", name, "epoch", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = blocks.withColumn("in", before).join(ahead, F.col("stretch") == F.col("s1")).select(F.col("source").alias("s2"), F.col("epoch").alias("e2"), F.col("block").alias("b2"), (F.col("sb") + F.col("in")).alias("first"))
    joined = rows.withColumn("inside", inside).join(numbered, F.col("source").eqNullSafe(F.col("s2")) & (F.col("epoch") == F.col("e2")) & (F.col("block") == F.col("b2")))
    return joined.withColumn("position", (F.col("first") + F.col("inside")).cast("long")).drop("s2", "e2", "b2", "first", "inside")


def mixture(docs: DataFrame, **targets) -> DataFrame:
    """Per row of the mixture: its position, doc_id, source, epoch, block, its words and the source's weight and budget."""
    weights = materialise(mix_weights(docs, **targets), "mix-weights")
    plan = positions(mix_plan(docs, weights))
    return plan.join(weights.select("src", "weight", "budget"), F.col("source").eqNullSafe(F.col("src"))).select("position", "doc_id", "source", "epoch", "block", F.col("words").alias("n_words"), F.round("weight", 9).alias("weight"), "budget")


def scattered(docs: DataFrame) -> Column:
    """An order for the rows of a mixture that were written: documents dealt by hash to ``STRETCHES``, and in each rows by a hash of file and row.

    So copies of a document lie apart but not in all files, where each would be shuffled as if it were new. The
    rows must be read from files; others go by their partition and place in it.
    """
    stretch = F.pmod(F.xxhash64("doc_id"), F.lit(STRETCHES))
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return F.struct(stretch, unit_hash(F.lit("row"), F.monotonically_increasing_id()))
    return F.struct(stretch, unit_hash(F.lit("row"), F.col("_metadata.file_name"), F.col("_metadata.row_index")))
