"""Steps of exact substring dedup against their definitions: many texts at once, and no more sorted than may repeat."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import exact_substrings as es


def some_texts(rng):
    passages = [bytes(rng.randrange(97, 123) for _ in range(n)) for n in (90, 150, 400)]
    out = [b"", b"x" * 99, b"x" * 100, b"x" * 700, b"ab" * 200, bytes(range(37)) * 9, bytes(300)]
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else bytes(rng.randrange(97, 123) for _ in range(rng.randrange(80))) for _ in range(rng.randrange(6))]
        out.append(b"".join(parts))
    return out


@pytest.mark.parametrize("portion", [1, 2000, es.PORTION])
def test_segments_of_many_texts(portion, monkeypatch):
    """By definition: runs of windows with one least hash, and where its first string is in all of them."""
    monkeypatch.setattr(es, "PORTION", portion)
    texts = some_texts(random.Random(5))
    want = []
    for k, t in enumerate(texts):
        if len(t) < es.LENGTH:
            continue
        h = es.key_hashes(np.frombuffer(t, np.uint8)).tolist()
        least = [min(h[p : p + es.WIDTH]) for p in range(len(t) - es.LENGTH + 1)]
        a = 0
        for e in range(1, len(least) + 1):
            if e == len(least) or least[e] != least[a]:
                place = h.index(least[a], a)
                want.append((np.uint64(least[a]).view(np.int64), k, a, e - a + es.LENGTH - 1, (place - a + 1) << 2 if place >= e - 1 else 1))
                a = e
    got = [tuple(r) for found in es.segments_of(texts) for r in found[[0, 2, 3, 4, 5]].T.tolist()]
    assert got == want
    assert {x[4] == 1 for x in want} == {True, False}
    # equal contents, and only those, have equal hashes
    contents: dict = {}
    for found in es.segments_of(texts):
        for _, ch, k, a, n, _ in found.T.tolist():
            assert contents.setdefault(ch, texts[k][a : a + n]) == texts[k][a : a + n]
    assert len(contents) == len(set(contents.values()))


def later_windows(pieces):
    seen: dict = {}
    out = []
    for did, th, start, t in sorted(pieces):
        for k in range(len(t) - es.LENGTH + 1):
            if seen.setdefault(t[k : k + es.LENGTH], (did, start + k)) != (did, start + k):
                out.append((did, th, start + k))
    return sorted(set(out))


def grouped(texts):
    rows = [(mh, k, -1, a, (multi >> 2) - 1, texts[k][a : a + n]) for found in es.segments_of(texts) for mh, _, k, a, n, multi in found.T.tolist()]
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize("seed", range(4))
def test_what_is_sorted_has_all_that_repeats(seed):
    pieces = grouped(some_texts(random.Random(seed)))
    kept = es.shared_parts(pieces)
    found = sorted({x for part in es.sort_shard(kept) for x in map(tuple, part.T.tolist())})
    assert found == later_windows([(did, th, start, t) for _, did, th, start, _, t in pieces])
    assert found


def test_what_repeats_nothing_is_not_sorted():
    """Segments that share the least hash's string but no window: before, all their bytes were sorted."""
    rng = random.Random(6)
    word = bytes(rng.randrange(97, 123) for _ in range(70))
    texts = [bytes(rng.randrange(48, 58) for _ in range(150)) + word + bytes(rng.randrange(48, 58) for _ in range(150)) for _ in range(40)]
    pieces = grouped(texts)
    assert len({p[0] for p in pieces}) < len(pieces)
    assert es.shared_parts(pieces) == []
    # with 40 bytes more in common, what is sorted is what is in common
    long = word + word[::-1][:40]
    pieces = grouped([t.replace(word, long) for t in texts])
    kept = es.shared_parts(pieces)
    assert sum(len(k[3]) for k in kept) < sum(len(p[5]) for p in pieces) / 4
    found = sorted({x for part in es.sort_shard(kept) for x in map(tuple, part.T.tolist())})
    assert found == later_windows([(did, th, start, t) for _, did, th, start, _, t in pieces])
    assert len(found) >= 39 * 11


def test_removed_runs():
    rng = random.Random(7)
    rows: list = [None, [], [(0, 5)], [(3, 4), (7, 2), (10, 1)]]
    rows += [[(rng.randrange(300), rng.randrange(1, 30)) for _ in range(rng.randrange(12))] for _ in range(50)]
    rows += [None, [(2**31 - 9, 5)], []]
    want = []
    for r in rows:
        gone = sorted({b for a, n in r or () for b in range(a, a + n)})
        runs: list = []
        for b in gone:
            if runs and runs[-1][1] == b:
                runs[-1] = (runs[-1][0], b + 1)
            else:
                runs.append((b, b + 1))
        want.append(runs)
    cuts = pa.array([r and [{"start": a, "len": n} for a, n in r] if r is not None else None for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32())])))
    assert es.removed_runs(cuts) == want
    assert es.removed_runs(cuts.slice(3, 9)) == want[3:12]
    assert es.removed_runs(cuts.slice(0, 2)) == [[], []]
