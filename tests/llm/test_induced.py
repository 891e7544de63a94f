"""External induced sorting against brute force, far beyond its budget."""

import random

import numpy as np
import pytest

from tidemark.llm import exact_substrings, induced


def brute(text, depth):
    s = text.tolist()
    order = sorted(range(len(s)), key=lambda i: s[i:])
    lcp = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while k < depth and a + k < len(s) and b + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        lcp.append(k)
    return order, lcp


def strings(rng, kind):
    n = rng.randint(0, 150)
    if kind == 0:
        return [rng.randint(1, 3) for _ in range(n)]
    if kind == 1:
        return [rng.randint(1, 200) for _ in range(n)]
    if kind == 2:
        return [1 + (i // rng.randint(1, 9)) % 2 for i in range(n)]
    part = [rng.randint(1, 5 if kind == 3 else 50) for _ in range(rng.randint(1, 12) if kind == 3 else 60)]
    out: list = []
    while len(out) < n:
        out += part if kind == 3 else part[rng.randint(0, 30) : rng.randint(30, 60)]
    return out[:n]


@pytest.mark.parametrize(("small", "steps"), [(512, 10), (1, 10), (1, 1)])
@pytest.mark.parametrize("memory", [induced.MEMORY, 3000])
def test_against_brute_force(small, steps, memory, monkeypatch):
    monkeypatch.setattr(induced, "SMALL", small)
    monkeypatch.setattr(induced, "STEPS", steps)
    rng = random.Random(small + steps + memory)
    for trial in range(30):
        text = np.array([*strings(rng, trial % 5), 0], np.uint16)
        depth = rng.choice([1, 2, 5, 100, 300])
        order, lcp = induced.suffixes(text, int(text.max()) + 1, depth, memory)
        want = brute(text, depth)
        assert (order.tolist(), lcp.tolist()) == want


def test_far_beyond_the_budget():
    """A text of 12 times the budget: queues spill, names recurse, order and prefixes are right."""
    rng = np.random.default_rng(4)
    parts = [rng.integers(1, 60, rng.integers(50, 3000)) for _ in range(40)]
    text = np.concatenate([*(parts[k] for k in rng.integers(0, 40, 6)), np.full(400, 7), np.tile(parts[0][:50], 30)]).astype(np.uint16)
    text = np.append(text, 0).astype(np.uint16)
    scratch = induced.Scratch(text.nbytes // 12)
    order, lcp = induced.suffixes(text, 61, 100, scratch=scratch)
    assert scratch.spills > 50
    assert scratch.levels > 2
    assert sorted(order.tolist()) == list(range(len(text)))
    big = text.astype(">u2").tobytes()
    for k in range(1, len(text), 37):
        a, b = 2 * int(order[k - 1]), 2 * int(order[k])
        assert big[a:] < big[b:]
        x, y = big[a : a + 200], big[b : b + 200]
        assert lcp[k] == next((i for i in range(100) if x[2 * i : 2 * i + 2] != y[2 * i : 2 * i + 2] or 2 * i >= len(x)), 100)
    again, same = induced.suffixes(text, 61, 100)
    assert (again == order).all()
    assert (same == lcp).all()


def test_shard_beyond_the_budget():
    rng = random.Random(8)
    passage = bytes(rng.randrange(256) for _ in range(300))
    pieces = [(k, -1, 5, bytes(rng.randrange(256) for _ in range(rng.randint(100, 400))) + (passage[k : 150 + k] if k % 3 else passage)) for k in range(60)]
    pieces.append((99, -1, 0, b"ab" * 500))

    def found(memory):
        return sorted(x for part in exact_substrings.sort_shard(pieces, memory) for x in map(tuple, part.T.tolist()))

    seen: dict = {}
    want = []
    for did, th, start, text in pieces:
        for k in range(len(text) - 99):
            w = text[k : k + 100]
            if w in seen:
                want.append((did, th, start + k))
            seen.setdefault(w, did)
    assert found(None) == sorted(want)
    assert found(20_000) == sorted(want)


def test_finer_classes_keep_equal_windows_together():
    """Every window of a segment gets one class, and equal windows get equal keys."""
    rng = random.Random(9)
    core = bytes(rng.randrange(97, 123) for _ in range(130))
    for width in exact_substrings.CLASSES:
        keys: dict = {}
        for _ in range(20):
            text = bytes(rng.choice(b"xy") for _ in range(3)) + core + bytes(rng.choice(b"xy") for _ in range(3))
            for key, _, start, size, _ in exact_substrings.segments(text):
                parts = exact_substrings.finer(text[start : start + size], start, key, -1, width)
                covered = [p + k for _, _, p, n, _ in parts for k in range(n - 99)]
                assert sorted(covered) == list(range(start, start + size - 99))
                for fine, _, p, n, multi in parts:
                    for k in range(n - 99):
                        assert keys.setdefault(text[p + k : p + k + 100], (key, fine)) == (key, fine)
                    if width > 1:
                        again = exact_substrings.finer(text[p : p + n], p, fine, (multi >> 2) - 1, 1)
                        assert len(again) == n - 99
