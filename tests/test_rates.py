"""Changing rates against a row-at-a-time bucket."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rates

INF = math.inf


def bucket(rows, changes):
    """Release times of (arrival, weight) rows by one bucket that is told of every change; None for those that never leave."""
    changes = sorted(changes, key=lambda x: x[0]) or [(0.0, None, 1.0)]
    k, now, empty_at = 0, -INF, -INF  # the bucket holds (t - empty_at) / each tokens at t, at most its count
    out = []
    for arrival, weight in rows:
        while True:
            _, count, duration = changes[k]
            end = changes[k + 1][0] if k + 1 < len(changes) else INF
            if count == 0:
                at = INF
            elif count is None:
                at = max(arrival, now)
            else:
                at = max(arrival, now, empty_at + min(weight, count) * duration / count)
            if at < end:
                break
            if end == INF:
                break
            following = changes[k + 1]
            if count is None or following[1] is None or empty_at == -INF:
                empty_at = -INF
            elif count == 0:
                empty_at = end
            else:
                empty_at = end - min(1.0, (end - empty_at) / duration) * following[2]
            k, now = k + 1, end
        if at == INF:
            out.append(None)
            now = INF
            continue
        if count is not None:
            empty_at = max(empty_at, at - duration) + weight * duration / count
        else:
            empty_at = -INF
        now = at
        out.append(at)
    return out


CHANGES = {
    "one": [(0.0, 5.0, 10.0)],
    "up": [(0.0, 1.0, 10.0), (120.0, 20.0, 10.0), (300.0, 2.0, 3.0)],
    "held": [(0.0, 3.0, 10.0), (50.0, 0.0, 10.0), (90.0, 4.0, 10.0), (91.0, 0.0, 1.0), (200.0, 6.0, 60.0)],
    "ended": [(0.0, 2.0, 10.0), (150.0, 0.0, 10.0)],
    "never": [(0.0, 0.0, 1.0)],
    "free": [(0.0, None, 1.0), (100.0, 1.0, 20.0), (250.0, None, 1.0), (260.0, 1.0, 7.0)],
    "late": [(200.0, 2.0, 10.0), (201.0, 1.0, 10.0), (201.5, 3.0, 10.0)],
}


@pytest.fixture(scope="module")
def given():
    rng = random.Random(8)
    rows, want = [], {}
    for key in [*CHANGES, "unlimited", None]:
        own = [(float(rng.randint(0, 400)) if key == "up" else k * 1.5 + rng.choice([0, 0, 30]), float(rng.choice([1, 1, 2, 3, 9])), k) for k in range(150)]
        for (_, _, k), at in zip(own, bucket([x[:2] for x in own], CHANGES.get(key, [])), strict=True):
            want[key, k] = at
        rows += [(key, k, a, w, None if k % 7 else f"v{k}") for a, w, k in own]
    rng.shuffle(rows)
    return rows, want


@pytest.mark.parametrize("piece", [1, 7, 40, 100_000])
def test_rates_that_change(spark, given, piece):
    rows, want = given
    df = spark.createDataFrame(rows, "key string, n long, a double, w double, v string").repartition(4)
    table = spark.createDataFrame([(k, *c) for k, cs in CHANGES.items() for c in cs], "key string, from_s double, count double, duration_s double")
    got = rates.release_under_rates(df, ["key"], ["n"], F.col("a"), table, F.col("w"), chunk=F.floor(F.col("n") / 25), piece=piece)
    assert got.columns == [*df.columns, "release_s"]
    found = got.collect()
    assert sorted((repr(r.key), r.n, r.a, r.w, repr(r.v)) for r in found) == sorted((repr(k), n, a, w, repr(v)) for k, n, a, w, v in rows)
    for r in found:
        at = want[r.key, r.n]
        assert r.release_s is None if at is None else r.release_s == pytest.approx(at, abs=1e-6), (r.key, r.n)


def test_no_keys_no_rows_no_rates(spark, given):
    rows, _ = given
    df = spark.createDataFrame([(n, a, w) for key, n, a, w, _ in rows if key == "one"], "n long, a double, w double")
    table = spark.createDataFrame([(0.0, 5.0, 10.0)], "from_s double, count double, duration_s double")
    got = {r.n: r.release_s for r in rates.release_under_rates(df, [], ["n"], F.col("a"), table, piece=11).collect()}
    ordered = sorted((n, a) for key, n, a, _, _ in rows if key == "one")
    assert [got[n] for n, _ in ordered] == pytest.approx(bucket([(a, 1.0) for _, a in ordered], [(0.0, 5.0, 10.0)]))
    assert rates.release_under_rates(df.limit(0), [], ["n"], F.col("a"), table).count() == 0
    free = rates.release_under_rates(df, [], ["n"], F.col("a"), table.limit(0)).collect()
    assert sorted(r.release_s for r in free) == sorted(max(a for m, a in ordered if m <= n) for n, _ in ordered)
