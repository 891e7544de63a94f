"""Offset sets: merging, membership, and their compact text form for commit metadata.

Text form: Base64 without padding of version, count, runs of deltas, checksum. A run of
three or more equal deltas is marker, delta, length; shorter ones are plain deltas. Numbers
are 7-bit groups, low first. The checksum is a CRC-32 that starts with the base offset's
eight bytes. Values fixed by the format are below.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby

VERSION, RUN_MARKER, CHECKSUM_BYTES = 1, 0, 4


def minimum_merge(left: Iterable[int], right: Iterable[int], minimum: int) -> list[int]:
    """Sorted union of two offset sets without what lies below ``minimum``."""
    return sorted({x for xs in (left, right) for x in xs if x >= minimum})


def contains(offsets: list[int], offset: int) -> bool:
    k = bisect_left(offsets, offset)
    return k < len(offsets) and offsets[k] == offset


def to_ranges(offsets: Iterable[int]) -> list[tuple[int, int]]:
    """Inclusive ranges of consecutive offsets."""
    out: list[tuple[int, int]] = []
    for x in sorted(set(offsets)):
        if out and out[-1][1] == x - 1:
            out[-1] = (out[-1][0], x)
        else:
            out.append((x, x))
    return out


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _numbers(data: bytes) -> Iterator[int]:
    value = shift = 0
    for b in data:
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            yield value
            value = shift = 0
    if shift:
        raise ValueError("number cut off")


def _checksum(base: int, body: bytes) -> bytes:
    return zlib.crc32(body, zlib.crc32((base % (1 << 64)).to_bytes(8, "big"))).to_bytes(CHECKSUM_BYTES, "big")


def encode(base: int, offsets: list[int], max_chars: int | None = None) -> str:
    """The set's text; with ``max_chars`` the longest prefix of whole runs that fits, or nothing."""
    deltas = [b - a for a, b in zip([base, *offsets], offsets, strict=False)]
    if any(d <= 0 for d in deltas):
        raise ValueError("offsets must increase from the base")
    if not deltas:
        return ""
    room = None if max_chars is None else max_chars * 3 // 4 - 1 - CHECKSUM_BYTES - len(_number(len(deltas)))
    runs, count, size = [], 0, 0
    for delta, same in groupby(deltas):
        n = len(list(same))
        run = _number(delta) * n if n < 3 else _number(RUN_MARKER) + _number(delta) + _number(n)
        if room is not None and size + len(run) > room:
            break
        runs.append(run)
        size += len(run)
        count += n
    if not count:
        return ""
    body = bytes([VERSION]) + _number(count) + b"".join(runs)
    return base64.b64encode(body + _checksum(base, body)).decode().rstrip("=")


def decode_runs(base: int, text: str) -> list[tuple[int, int]]:
    """The set as (delta, times), or none if the text is damaged or belongs to another base."""
    try:
        data = base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
        if not data:
            return []
        body, check = data[:-CHECKSUM_BYTES], data[-CHECKSUM_BYTES:]
        if len(data) <= CHECKSUM_BYTES or check != _checksum(base, body) or body[0] != VERSION:
            return []
        numbers = _numbers(body[1:])
        left, out = next(numbers), []
        while left > 0:
            delta, n = next(numbers), 1
            if delta == RUN_MARKER:
                delta, n = next(numbers), next(numbers)
            out.append((delta, n))
            left -= n
        return out if left == 0 and next(numbers, None) is None else []
    except (ValueError, StopIteration):
        return []


def decode(base: int, text: str) -> list[int]:
    """The set, or an empty one if the text is damaged or belongs to another base."""
    at, out = base, []
    for delta, n in decode_runs(base, text):
        out.extend(range(at + delta, at + delta * n + 1, delta))
        at += delta * n
    return out
