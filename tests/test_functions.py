import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import codecs, offset_codec
from tidemark.functions.collecting import binary_strides, difference, floor_log2, floor_log2_column, greatest_with_ties, highest_one_bit, take_until
from tidemark.functions.hashing import number_bucket, string_bucket, uuid_bucket, with_number_bucket, with_uuid_bucket

# Buckets of 128, from a published Murmur3 implementation.
NUMBERS = [(0, 124), (1, 68), (-1, 104), (2**63 - 1, 63), (-(2**63), 37), (-5025562857975149833, 48), (5694868678511409995, 103), (3272055439932147596, 113), (None, 0)]
STRINGS = [("", 0), ("a", 26), ("ab", 74), ("abc", 67), ("Hello, World!", 33), ("px", 99), ("X9bN", 71), (None, 0)]
UUIDS = [("00000000-0000-0000-0000-000000000000", 120), ("ffffffff-ffff-ffff-ffff-ffffffffffff", 110), ("dce20b69-20f0-bd7e-b274-b53d66eb0cfe", 72), (None, 0)]


@pytest.mark.parametrize(("rows", "kind", "bucket"), [(NUMBERS, "long", number_bucket), (STRINGS, "string", string_bucket), (UUIDS, "string", uuid_bucket)])
def test_buckets(spark, rows, kind, bucket):
    df = spark.createDataFrame(rows, f"v {kind}, expected int")
    assert df.where(bucket(F.col("v"), 128) != F.col("expected")).count() == 0
    chained = {number_bucket: with_number_bucket, uuid_bucket: with_uuid_bucket}.get(bucket)
    if chained:
        got = chained(df, "b", F.col("v"), 128)
        assert got.columns == ["v", "expected", "b"]
        assert got.where("b <> expected or b is null").count() == 0
        assert chained(df, "expected", F.col("v"), 128).columns == ["v", "expected"]


def test_bad_uuid_fails(spark):
    with pytest.raises(Exception, match="not a UUID"):
        spark.createDataFrame([("x",)], "v string").select(uuid_bucket(F.col("v"), 8)).collect()


def test_strides():
    assert binary_strides(list(range(7))) == [[0, 2, 4, 6], [1, 3, 5], [0, 1, 4, 5], [2, 3, 6], [0, 1, 2, 3], [4, 5, 6]]
    assert binary_strides([]) == [[]]
    assert binary_strides(["x"]) == [["x"]]
    for n in range(2, 40):
        plan = binary_strides(list(range(n)))
        assert sorted(plan[0] + plan[1]) == list(range(n))


def test_collections(spark):
    assert greatest_with_ties([1, 5, 0, 5], lambda x: x) == [5, 5]
    assert greatest_with_ties([], lambda x: x) == []
    assert take_until([0, 1, 2, 3], lambda x: x >= 2) == [0, 1, 2]
    assert difference([1, 2, 3], [2]) == [1, 3]
    assert [floor_log2(n) for n in (1, 2, 3, 4, 1023)] == [0, 1, 1, 2, 9]
    assert [highest_one_bit(n) for n in (0, 1, 6, 8)] == [0, 1, 4, 8]
    assert [r[0] for r in spark.createDataFrame([(1,), (6,), (1024,)], "n long").select(floor_log2_column(F.col("n"))).collect()] == [0, 2, 10]


def test_offset_sets():
    assert offset_codec.minimum_merge([1, 3, 5], [3, 4, 9], 3) == [3, 4, 5, 9]
    assert offset_codec.contains([1, 4], 4)
    assert not offset_codec.contains([1, 4], 3)
    assert offset_codec.to_ranges([7, 1, 2, 3, 3]) == [(1, 3), (7, 7)]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**50), st.sets(st.integers(1, 3000)), st.integers(0, 200))
def test_offset_codec_round_trip(base, deltas, cap):
    offsets = sorted(base + d for d in deltas)
    assert offset_codec.decode(base, offset_codec.encode(base, offsets)) == offsets
    short = offset_codec.encode(base, offsets, cap)
    assert len(short) <= max(cap, 0)
    assert offset_codec.decode(base, short) == offsets[: len(offset_codec.decode(base, short))]


def test_offset_codec_damage():
    text = offset_codec.encode(10, [12, 14, 16, 30])
    assert offset_codec.decode(11, text) == []
    assert offset_codec.decode(10, "Z" + text[1:]) == []
    assert offset_codec.decode(10, text[:-1]) == []
    assert offset_codec.decode(10, "") == []
    assert offset_codec.encode(10, [11], 1) == ""
    assert len(offset_codec.encode(0, list(range(1, 2000)))) < 20
    with pytest.raises(ValueError, match="increase"):
        offset_codec.encode(10, [10])


SCHEMA = {"type": "record", "name": "T", "fields": [{"name": "a", "type": "string"}, {"name": "n", "type": ["null", "long"]}, {"name": "m", "type": {"type": "map", "values": "double"}}, {"name": "s", "type": {"type": "array", "items": "string"}}]}


def test_avro():
    value = {"a": "é", "n": -5, "m": {"x": 1.5}, "s": ["p", "q"]}
    data = codecs.avro_encode(SCHEMA, value)
    assert codecs.avro_decode(SCHEMA, data) == value
    reader = {"type": "record", "name": "T", "fields": [SCHEMA["fields"][0], {"name": "new", "type": "long", "default": 7}]}
    assert codecs.avro_decode(SCHEMA, data, reader) == {"a": "é", "new": 7}
    impossible = {"type": "record", "name": "T", "fields": [{"name": "missing", "type": "long"}]}
    assert codecs.avro_decode(SCHEMA, data, impossible) == value
    assert codecs.avro_decode(SCHEMA, b"\xff", null_on_failure=True) is None
    assert codecs.avro_nullable("long") == ["null", "long"]
    assert codecs.avro_non_null(["null", "long"]) == "long"
    assert codecs.avro_decode(SCHEMA, codecs.avro_encode(SCHEMA, {"a": "", "n": None, "m": {}, "s": {"b", "a"}}))["s"] == ["a", "b"]


def test_protobuf():
    fields = {1: ("id", "int64"), 2: ("name", "string"), 3: ("x", "double"), 4: ("z", "sint64"), 5: ("ok", "bool")}
    value = {"id": -3, "name": "n", "x": 0.5, "z": -9, "ok": True}
    assert codecs.proto_decode(fields, codecs.proto_encode(fields, value)) == value
    assert codecs.proto_decode({1: ("id", "int64")}, codecs.proto_encode(fields, value)) == {"id": -3}


def test_registry(spark):
    r = codecs.Registry()
    first = r.resolve("t", {"a": 1})
    assert r.resolve("t", {"a": 1}) == first
    assert r.resolve("t", {"a": 2}, auto_register=False, use_latest=True, strict=False) == first
    with pytest.raises(ValueError, match="differs"):
        r.resolve("t", {"a": 2}, auto_register=False, use_latest=True)
    with pytest.raises(KeyError):
        r.resolve("t", {"a": 2}, auto_register=False)
    assert r.fetch(first) == {"a": 1}
    body = codecs.avro_encode(SCHEMA, {"a": "x", "n": 1, "m": {}, "s": []})
    df = spark.createDataFrame([(bytearray(b"\0\0\0\0\x05" + body),), (bytearray(),), (None,), (bytearray(b"\1\0\0\0\x05"),), (bytearray(b"\0\0"),)], "p binary")
    got = [x.r for x in df.select(codecs.registry_parts(F.col("p"), null_on_failure=True).alias("r")).collect()]
    assert got[0].schema_id == 5
    assert codecs.avro_decode(SCHEMA, bytes(got[0].body))["a"] == "x"
    assert got[1:] == [None] * 4
    with pytest.raises(Exception, match="not a registry payload"):
        df.select(codecs.registry_parts(F.col("p"))).collect()
    udf = codecs.decoder(lambda b: json.dumps(codecs.avro_decode(SCHEMA, b)), "string")
    assert json.loads(df.limit(1).select(codecs.registry_parts(F.col("p")).alias("r")).select(udf("r.body")).first()[0])["n"] == 1


def test_json(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("{bad",)], "b string")
    assert [r.v and r.v.k for r in df.select(codecs.json_body(F.col("b"), "k long", permissive=True).alias("v")).collect()] == [1, None]
    with pytest.raises(Exception, match="(?i)malformed"):
        df.select(codecs.json_body(F.col("b"), "k long")).collect()
    assert df.where(F.length('b') > 5).select(codecs.json_tree(F.col("b")).cast("string")).first()[0] == '{"k":1}'
    assert df.select(codecs.to_json_body(F.struct("b"))).count() == 2
