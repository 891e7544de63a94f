"""Body codecs: strings, longs, bytes, JSON, the schema registry's prefix, and small Avro and Protobuf readers."""

from __future__ import annotations

import json
import struct

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = 0


def string_body(body: Column) -> Column:
    return F.decode(body, "UTF-8")


def to_string_body(value: Column) -> Column:
    return F.encode(value.cast("string"), "UTF-8")


def long_body(body: Column) -> Column:
    """Eight bytes, big-endian; a body of another size is null."""
    raw = F.hex(body)
    high, low = F.conv(F.substring(raw, 1, 8), 16, 10).cast("long"), F.conv(F.substring(raw, 9, 8), 16, 10).cast("long")
    return F.when(F.octet_length(body) == 8, F.shiftleft(high, 32).bitwiseOR(low))


def to_long_body(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def json_body(body: Column, schema: str, permissive: bool = False) -> Column:
    """A JSON object by its schema. A bad one fails, or is null if ``permissive``."""
    return F.from_json(body.cast("string"), schema, {"mode": "PERMISSIVE" if permissive else "FAILFAST"})


def json_tree(body: Column) -> Column:
    return F.parse_json(body.cast("string"))


def to_json_body(value: Column) -> Column:
    return F.encode(F.to_json(value), "UTF-8")


def registry_parts(payload: Column, null_on_failure: bool = False) -> Column:
    """schema_id and body of a registry payload: magic byte 0, four bytes id, body.

    Null and empty payloads are null. A wrong magic byte or a short payload fails, or is null.
    """
    raw = F.hex(payload)
    good = (F.octet_length(payload) >= 5) & F.startswith(raw, F.lit(f"{MAGIC:02X}"))
    parts = F.struct(F.conv(F.substring(raw, 3, 8), 16, 10).cast("long").alias("schema_id"), F.substring(payload, 6, 1 << 30).alias("body"))
    bad = F.lit(None) if null_on_failure else F.raise_error(F.concat(F.lit("not a registry payload: "), F.substring(raw, 1, 10)))
    return F.when(payload.isNull() | (F.octet_length(payload) == 0), None).when(good, parts).otherwise(bad)


def with_registry_prefix(schema_id: Column, body: Column) -> Column:
    return F.unhex(F.concat(F.lit(f"{MAGIC:02X}"), F.lpad(F.hex(schema_id.cast("long")), 8, "0"), F.hex(body)))


class Registry:
    """Schemas by id, in memory: register, use the latest, or look up, as a serializer is told to."""

    def __init__(self):
        self.schemas: dict[int, tuple[str, str]] = {}

    def resolve(self, subject: str, schema: dict, auto_register: bool = True, use_latest: bool = False, strict: bool = True) -> int:
        text = json.dumps(schema, sort_keys=True)
        own = [i for i, (s, t) in self.schemas.items() if s == subject]
        same = [i for i in own if self.schemas[i][1] == text]
        if auto_register:
            if same:
                return same[0]
            new = len(self.schemas) + 1
            self.schemas[new] = (subject, text)
            return new
        if use_latest and own:
            if strict and self.schemas[max(own)][1] != text:
                raise ValueError("the latest schema differs")
            return max(own)
        if same:
            return same[0]
        raise KeyError(f"no such schema of {subject}")

    def fetch(self, schema_id: int) -> dict:
        return json.loads(self.schemas[schema_id][1])


# Avro -------------------------------------------------------------------------


def _zigzag(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def avro_encode(schema, value) -> bytes:
    """Binary Avro of a value by its schema (records, unions, arrays, maps, primitives)."""
    if isinstance(schema, list):
        k = next(i for i, s in enumerate(schema) if _fits(s, value))
        return _zigzag(k) + avro_encode(schema[k], value)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (list, dict)):
        return avro_encode(kind, value)
    if kind == "null":
        return b""
    if kind == "boolean":
        return bytes([bool(value)])
    if kind in ("int", "long"):
        return _zigzag(value)
    if kind in ("float", "double"):
        return struct.pack("<f" if kind == "float" else "<d", value)
    if kind in ("string", "bytes"):
        data = value.encode() if isinstance(value, str) else bytes(value)
        return _zigzag(len(data)) + data
    if kind == "enum":
        return _zigzag(schema["symbols"].index(value))
    if kind == "fixed":
        return bytes(value)
    if kind == "array":
        items = sorted(value) if isinstance(value, (set, frozenset)) else list(value)
        return (_zigzag(len(items)) + b"".join(avro_encode(schema["items"], x) for x in items) if items else b"") + _zigzag(0)
    if kind == "map":
        return (_zigzag(len(value)) + b"".join(avro_encode("string", k) + avro_encode(schema["values"], v) for k, v in value.items()) if value else b"") + _zigzag(0)
    if kind == "record":
        return b"".join(avro_encode(f["type"], value.get(f["name"], f.get("default"))) for f in schema["fields"])
    raise ValueError(f"unknown type: {kind}")


def _fits(schema, value) -> bool:
    kind = schema["type"] if isinstance(schema, dict) else schema
    return {"null": value is None, "boolean": isinstance(value, bool), "string": isinstance(value, str), "bytes": isinstance(value, bytes), "map": isinstance(value, dict), "record": isinstance(value, dict), "array": isinstance(value, (list, tuple, set))}.get(kind, isinstance(value, (int, float)) and not isinstance(value, bool))


class _In:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    def long(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)


def _avro_read(schema, r: _In):
    if isinstance(schema, list):
        return _avro_read(schema[r.long()], r)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (list, dict)):
        return _avro_read(kind, r)
    if kind == "null":
        return None
    if kind == "boolean":
        return r.take(1) != b"\0"
    if kind in ("int", "long"):
        return r.long()
    if kind == "float":
        return struct.unpack("<f", r.take(4))[0]
    if kind == "double":
        return struct.unpack("<d", r.take(8))[0]
    if kind == "bytes":
        return r.take(r.long())
    if kind == "string":
        return r.take(r.long()).decode()
    if kind == "enum":
        return schema["symbols"][r.long()]
    if kind == "fixed":
        return r.take(schema["size"])
    if kind == "record":
        return {f["name"]: _avro_read(f["type"], r) for f in schema["fields"]}
    out = {} if kind == "map" else []
    while n := r.long():
        if n < 0:
            n = -n
            r.long()
        for _ in range(n):
            if kind == "map":
                key = _avro_read("string", r)
                out[key] = _avro_read(schema["values"], r)
            else:
                out.append(_avro_read(schema["items"], r))
    return out


def avro_decode(writer, data: bytes, reader=None, null_on_failure: bool = False):
    """A value by its writer's schema, then by the reader's: missing fields take defaults, unknown ones go.

    If the reader's schema can't take it, the writer's reading stands.
    """
    try:
        value = _avro_read(writer, _In(data))
    except (ValueError, IndexError, KeyError):
        if null_on_failure:
            return None
        raise
    if reader is None:
        return value
    try:
        return _resolve(reader, value)
    except (KeyError, TypeError):
        return value


def _resolve(schema, value):
    if isinstance(schema, list):
        if value is None and "null" in schema:
            return None
        return _resolve(next(s for s in schema if s != "null"), value)
    if not isinstance(schema, dict):
        return value
    kind = schema["type"]
    if isinstance(kind, (list, dict)):
        return _resolve(kind, value)
    if kind == "record":
        return {f["name"]: _resolve(f["type"], value[f["name"]]) if f["name"] in value else f["default"] for f in schema["fields"]}
    if kind == "array":
        return [_resolve(schema["items"], x) for x in value]
    if kind == "map":
        return {k: _resolve(schema["values"], v) for k, v in value.items()}
    return value


def avro_nullable(schema):
    return schema if isinstance(schema, list) and "null" in schema else ["null", *(schema if isinstance(schema, list) else [schema])]


def avro_non_null(schema):
    rest = [s for s in schema if s != "null"] if isinstance(schema, list) else [schema]
    return rest[0] if len(rest) == 1 else rest


# Protobuf ----------------------------------------------------------------------


def proto_encode(fields: dict[int, tuple[str, str]], value: dict) -> bytes:
    """A message by its fields: number -> (name, kind); kinds int64, sint64, bool, double, string, bytes."""
    out = b""
    for number, (name, kind) in sorted(fields.items()):
        v = value.get(name)
        if v is None:
            continue
        if kind in ("string", "bytes"):
            data = v.encode() if isinstance(v, str) else bytes(v)
            out += _plain(number << 3 | 2) + _plain(len(data)) + data
        elif kind == "double":
            out += _plain(number << 3 | 1) + struct.pack("<d", v)
        else:
            n = (int(v) << 1) ^ (int(v) >> 63) if kind == "sint64" else int(v)
            out += _plain(number << 3) + _plain(n & (1 << 64) - 1)
    return out


def _plain(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def proto_decode(fields: dict[int, tuple[str, str]], data: bytes) -> dict:
    """Known fields of a message; unknown ones are skipped, missing ones are None, the last of repeated ones stays."""
    r, out = _In(data), {name: None for name, _ in fields.values()}
    while r.at < len(data):
        tag = r.varint()
        number, wire = tag >> 3, tag & 7
        raw = r.varint() if wire == 0 else r.take(8) if wire == 1 else r.take(r.varint()) if wire == 2 else r.take(4)
        if number not in fields:
            continue
        name, kind = fields[number]
        if kind == "string":
            raw = raw.decode()
        elif kind == "double":
            raw = struct.unpack("<d", raw)[0]
        elif kind == "bool":
            raw = bool(raw)
        elif kind == "sint64":
            raw = (raw >> 1) ^ -(raw & 1)
        elif kind == "int64" and raw >> 63:
            raw -= 1 << 64
        out[name] = raw
    return out


def decoder(decode, kind: str):
    """A pandas UDF over a binary column from a Python decoder; null stays null."""
    @F.pandas_udf(kind)
    def run(body: pd.Series) -> pd.Series:
        return body.map(lambda b: None if b is None else decode(bytes(b)))

    return run
