"""Passages of 51 words are found at any place of a running sentence."""

import random

import numpy as np

from tidemark.llm import spans


def covered_words(first: str, second: str) -> np.ndarray:
    """Which words of ``second`` are in a span that ``first`` has too."""
    known = {s[:2] for s in spans.spans(first)}
    sizes = [len(w) for _, _, w in spans.sentences(second)]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    hit = np.zeros(starts[-1], bool)
    for high, low, a, n in spans.spans(second):
        if (high, low) in known:
            hit[starts[a] : starts[a + n]] = True
    return hit


def test_passages_in_running_text():
    rng = random.Random(6)

    def words(n):
        return ["w%d" % rng.randint(0, 10**6) for _ in range(n)]

    caught, share, n = 0, 0.0, 0
    for ends in (0, 0.1, 0.25):
        for offset in range(48):
            passage = [w + ("." if rng.random() < ends else "") for w in words(51)]
            first = " ".join(words(29) + passage + words(40))
            second = " ".join(words(offset) + passage + words(33))
            hit = covered_words(first, second)
            caught += hit[offset : offset + 51].sum() >= 25
            share += hit[offset : offset + 51].mean()
            assert not hit[:offset].any()
            n += 1
    assert caught >= 0.99 * n
    assert share / n > 0.75
    two = [*words(29), words(1)[0] + ".", *words(29), words(1)[0] + "."]
    assert covered_words(" ".join(words(7) + two + words(9)), " ".join(words(12) + two + words(9))).sum() >= 40
