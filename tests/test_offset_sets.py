"""Offset sets as bitmaps against plain Python sets and the row-wise codec."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import offset_codec
from tidemark.operators import offset_sets as sets

Q = ["topic", "p"]
SCHEMA = "topic string, p int, offset long"


def some(seed):
    r = random.Random(seed)
    out = {("a", 0): {*range(32760, 32780), *range(65000, 99000), 5, 7, 9, 11, 200_000}, ("a", 1): {0, 32767, 32768, 65535, 65536}, (None, 2): set(range(10, 70_000, 3)), ("b", None): {r.randrange(300_000) for _ in range(4000)}}
    return {k: {x for x in v if r.random() < 0.999} for k, v in out.items()}


def table(spark, of):
    return spark.createDataFrame([(*k, x) for k, v in of.items() for x in v for _ in range(1 + x % 2)] + [("a", 0, None)], SCHEMA).repartition(5)


def test_merge_ranges_and_size(spark):
    a, b = some(1), some(2)
    left, right = (sets.offset_set(table(spark, x), Q, "offset") for x in (a, b))
    got = sets.minimum_merged(left, right, Q, F.when(F.col("p") == 2, 33_001).otherwise(9))
    expected = {k: {x for x in a[k] | b[k] if x >= (33_001 if k[1] == 2 else 9)} for k in a}
    assert {(r.topic, r.p): r.n for r in sets.size(got, Q).collect()} == {k: len(v) for k, v in expected.items()}
    found = {}
    for r in sets.ranges(got, Q).collect():
        found.setdefault((r.topic, r.p), []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in found.items()} == {k: offset_codec.to_ranges(v) for k, v in expected.items()}


@pytest.mark.parametrize("low", [7, 32768, 40_001])
def test_cut(spark, low):
    a = some(3)
    got = sets.size(sets.at_least(sets.offset_set(table(spark, a), Q, "offset"), F.lit(low)), Q)
    assert {(r.topic, r.p): r.n for r in got.collect()} == {k: n for k, v in a.items() if (n := sum(x >= low for x in v))}


def test_membership(spark):
    a, b = some(4), some(5)
    got = sets.with_membership(table(spark, b), sets.offset_set(table(spark, a), Q, "offset"), Q, "offset", "known")
    for r in got.collect():
        assert r.known == (r.offset is not None and r.offset in a[r.topic, r.p])
    assert got.columns == ["topic", "p", "offset", "known"]


@pytest.mark.parametrize("cap", [None, 40])
def test_metadata_is_the_codec_s(spark, cap):
    a = some(6)
    bases = {k: {0: -1, 1: 0, 2: 33_000, None: 4}[k[1]] for k in a}
    base_rows = spark.createDataFrame([(*k, b) for k, b in bases.items()], "topic string, p int, base long")
    got = sets.metadata(sets.offset_set(table(spark, a), Q, "offset"), base_rows, Q, cap)
    expected = {k: offset_codec.encode(bases[k], sorted(x for x in v if x > bases[k]), cap) for k, v in a.items()}
    assert {(r.topic, r.p): r.text for r in got.collect()} == {k: v for k, v in expected.items() if v}
    if cap is None:
        back = {}
        for r in sets.from_metadata(got, Q).collect():
            back.setdefault((r.topic, r.p), []).append(r.offset)
        assert {k: sorted(v) for k, v in back.items()} == {k: sorted(x for x in v if x > bases[k]) for k, v in a.items()}


def test_ten_million_offsets_of_one_queue(spark):
    """Only runs leave a bucket: 10^7 offsets but every 999,983rd are 306 rows before they are ranges."""
    df = spark.range(10_000_000).where("id % 999983 <> 7").select(F.lit(0).alias("p"), F.col("id").alias("offset"))
    got = sets.offset_set(df, ["p"], "offset")
    gaps = list(range(7, 10_000_000, 999_983))
    assert got.count() == 306
    assert sorted((r.start, r.end) for r in sets.ranges(got, ["p"]).collect()) == [(a, b) for a, b in zip([0, *[g + 1 for g in gaps]], [*[g - 1 for g in gaps], 9_999_999], strict=True)]
    text = sets.metadata(got, spark.createDataFrame([(0, -1)], "p int, base long"), ["p"], 4096).first()
    assert text.n_offsets == 10_000_000 - len(gaps)
    assert sum(n for _, n in offset_codec.decode_runs(-1, text.text)) == text.n_offsets


def test_empty(spark):
    none = sets.offset_set(spark.createDataFrame([], SCHEMA), Q, "offset")
    assert sets.ranges(none, Q).count() == 0
    assert sets.metadata(none, spark.createDataFrame([], "topic string, p int, base long"), Q, 100).count() == 0
    assert sets.size(sets.union(Q, none, none), Q).count() == 0
