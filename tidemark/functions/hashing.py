"""Stable buckets: Murmur3 (32 bits, seed 0) of numbers, strings and UUIDs, as Column expressions.

``F.hash`` is Murmur3 with seed 42, so its buckets differ. As an expression every step is let-bound by a
one-element ``transform``, because a helper that repeats its argument would otherwise
multiply the expression. ``with_number_bucket`` and ``with_uuid_bucket`` do the steps as columns one after
another instead, which is generated code throughout and about six times as fast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of Murmur3 (32 bits).
C1, C2 = 0xCC9E2D51, 0x1B873593
F1, F2 = 0x85EBCA6B, 0xC2B2AE35
STEP = 0xE6546B64
LOW32 = 0xFFFFFFFF


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _multiply(x: Column, c: int) -> Column:
    """x * c modulo 2^32; the constant in halves, since ANSI mode raises on overflow."""
    low, high = c & 0xFFFF, c >> 16
    return let(x, lambda v: (v * F.lit(low) + F.shiftleft((v * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(LOW32)))


def _rotate(x: Column, r: int) -> Column:
    return let(x, lambda v: F.shiftleft(v, r).bitwiseOR(F.shiftright(v, 32 - r)).bitwiseAND(F.lit(LOW32)))


def mix_block(k: Column) -> Column:
    return _multiply(_rotate(_multiply(k, C1), 15), C2)


def mix_hash(h: Column, k: Column) -> Column:
    return let(_rotate(h.bitwiseXOR(k), 13), lambda v: (v * F.lit(5) + F.lit(STEP)).bitwiseAND(F.lit(LOW32)))


def finish(h: Column, length: Column) -> Column:
    h = let(h.bitwiseXOR(length), lambda v: v.bitwiseXOR(F.shiftright(v, 16)))
    h = let(_multiply(h, F1), lambda v: v.bitwiseXOR(F.shiftright(v, 13)))
    return let(_multiply(h, F2), lambda v: v.bitwiseXOR(F.shiftright(v, 16)))


def _bucket(h: Column, n: int) -> Column:
    """Signed 32-bit value, floored modulo ``n``."""
    return F.pmod(let(h, lambda v: F.when(v >= F.lit(1 << 31), v - F.lit(1 << 32)).otherwise(v)), F.lit(n)).cast("int")


def _or_zero(source: Column, bucket: Column) -> Column:
    return F.when(source.isNull(), F.lit(0)).otherwise(bucket)


def number_bucket(number: Column, n: int) -> Column:
    """Bucket of a number, widened to a long; null is bucket 0."""

    def of(v: Column) -> Column:
        h = mix_hash(F.lit(0).cast("long"), mix_block(v.bitwiseAND(F.lit(LOW32))))
        return finish(mix_hash(h, mix_block(F.shiftrightunsigned(v, 32))), F.lit(8).cast("long"))

    return _or_zero(number, _bucket(let(F.coalesce(number.cast("long"), F.lit(0).cast("long")), of), n))


def _unit(hexed: Column, place: Column, width: int) -> Column:
    """``width`` bytes at byte ``place`` of a hex string, little-endian."""
    parts = [F.substring(hexed, place * 2 + 1 + 2 * k, F.lit(2)) for k in reversed(range(width))]
    return F.conv(F.concat(*parts), 16, 10).cast("long")


def string_bucket(text: Column, n: int) -> Column:
    """Bucket of a string by its UTF-16 code units, in pairs; null is bucket 0."""

    def of(hexed: Column) -> Column:
        def with_length(units: Column) -> Column:
            last = F.greatest(F.floor(units / 2) - 1, F.lit(0))
            pairs = F.filter(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda k: k < F.floor(units / 2))
            h = F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, k: mix_hash(acc, mix_block(_unit(hexed, k * 4, 4))))
            odd = F.when(units % 2 == 1, mix_block(_unit(hexed, (units - 1) * 2, 2))).otherwise(F.lit(0).cast("long"))
            return finish(h.bitwiseXOR(odd), units * 2)

        return let((F.length(hexed) / 4).cast("long"), with_length)

    return _or_zero(text, _bucket(let(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-16LE")), of), n))


def uuid_bucket(uuid: Column, n: int) -> Column:
    """Bucket of a UUID in its canonical form by its 16 bytes, read as four little-endian words; null is bucket 0."""

    def of(hexed: Column) -> Column:
        h = F.lit(0).cast("long")
        for k in range(4):
            h = mix_hash(h, mix_block(_unit(hexed, F.lit(4 * k), 4)))
        return finish(h, F.lit(16).cast("long"))

    return _or_zero(uuid, _bucket(let(_uuid_digits(uuid), of), n))


def _uuid_digits(uuid: Column) -> Column:
    """The 32 digits of a UUID; zeros for null, an error for what is none."""
    return F.when(uuid.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.replace(uuid, F.lit("-"), F.lit(""))).otherwise(
        F.when(uuid.isNull(), F.lit("0" * 32)).otherwise(F.raise_error(F.concat(F.lit("not a UUID: "), uuid)))
    )


_V, _K, _H = "_hash_value", "_hash_block", "_hash"


def _times(name: str, c: int) -> Column:
    x = F.col(name)
    return (x * F.lit(c & 0xFFFF) + F.shiftleft((x * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(LOW32))


def _turned(name: str, r: int) -> Column:
    return F.shiftleft(F.col(name), r).bitwiseOR(F.shiftright(F.col(name), 32 - r)).bitwiseAND(F.lit(LOW32))


def _with_bucket(df: DataFrame, name: str, source: Column, value: Column, blocks: list[Column], n: int) -> DataFrame:
    """``df`` with the bucket of 32-bit blocks of ``value``, each a column over the one before."""
    own = df.columns
    out = df.withColumns({_V: value, _H: F.lit(0).cast("long"), name: source.isNull()})
    for block in blocks:
        for step in (block, _times(_K, C1), _turned(_K, 15), _times(_K, C2)):
            out = out.withColumn(_K, step)
        out = out.withColumn(_H, F.col(_H).bitwiseXOR(F.col(_K))).withColumn(_H, (_turned(_H, 13) * F.lit(5) + F.lit(STEP)).bitwiseAND(F.lit(LOW32)))
    out = out.withColumn(_H, F.col(_H).bitwiseXOR(F.lit(4 * len(blocks))))
    for shift, factor in ((16, F1), (13, F2), (16, None)):
        out = out.withColumn(_H, F.col(_H).bitwiseXOR(F.shiftright(_H, shift)))
        out = out if factor is None else out.withColumn(_H, _times(_H, factor))
    signed = F.when(F.col(_H) >= F.lit(1 << 31), F.col(_H) - F.lit(1 << 32)).otherwise(F.col(_H))
    kept = [F.col(f"`{c}`") for c in own if c != name]
    bucket = F.when(F.col(name), F.lit(0)).otherwise(F.pmod(signed, F.lit(n)).cast("int"))
    # generated, so that no filter on the bucket is moved below the steps, where it would repeat them all
    return out.select(*kept, F.explode_outer(F.array(bucket)).alias(name))


def with_number_bucket(df: DataFrame, name: str, number: Column, n: int) -> DataFrame:
    """``df`` with ``number_bucket`` as column ``name``."""
    halves = [F.col(_V).bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned(_V, 32)]
    return _with_bucket(df, name, number, F.coalesce(number.cast("long"), F.lit(0).cast("long")), halves, n)


def with_uuid_bucket(df: DataFrame, name: str, uuid: Column, n: int) -> DataFrame:
    """``df`` with ``uuid_bucket`` as column ``name``."""
    return _with_bucket(df, name, uuid, _uuid_digits(uuid), [_unit(F.col(_V), F.lit(4 * k), 4) for k in range(4)], n)
