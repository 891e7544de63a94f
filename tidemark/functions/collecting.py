"""Small collection and number helpers: on the driver for plans, as Columns for data."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_log2(n: int) -> int:
    """The largest e with 2^e <= n."""
    if n < 1:
        raise ValueError("positive numbers only")
    return n.bit_length() - 1


def highest_one_bit(n: int) -> int:
    return 1 << floor_log2(n) if n > 0 else 0


def floor_log2_column(n: Column) -> Column:
    return (F.length(F.bin(n)) - 1).cast("int")


def in_stride(place: int, n: int, cycle: int) -> bool:
    """Whether place ``place`` of ``n`` belongs to the stride of a cycle.

    Cycle c takes every other block of 2^(c // 2) places, the even blocks if c is even. Past
    the greatest power of two that n + 1 holds the pattern starts anew on what is left.
    """
    while True:
        whole = highest_one_bit(n + 1)
        if place < whole:
            return (place >> (cycle // 2)) % 2 == cycle % 2
        place, n = place - whole, n - whole
        if n == 1:
            return cycle % 2 == 0
        cycle = min(cycle, stride_count(n) - 2 + cycle % 2)


def stride_count(n: int) -> int:
    return 2 * floor_log2(n + 1)


def binary_strides(items: Sequence) -> list[list]:
    """The subsets that polling cycles through; one or no item is one subset."""
    n = len(items)
    if n <= 1:
        return [list(items)]
    return [[x for k, x in enumerate(items) if in_stride(k, n, c)] for c in range(stride_count(n))]


def greatest_with_ties(items: Iterable, key: Callable) -> list:
    """All items whose key is the greatest."""
    items = list(items)
    top = max(map(key, items), default=None)
    return [x for x in items if key(x) == top]


def take_until(items: Iterable, stop: Callable[[object], bool]) -> list:
    """Items up to and including the first for which ``stop`` holds."""
    out = []
    for x in items:
        out.append(x)
        if stop(x):
            break
    return out


def difference(items: Iterable, without: Iterable) -> list:
    without = set(without)
    return [x for x in items if x not in without]
