"""The pipeline's near-dedup against brute force over five-word shingles."""

import random

import numpy as np
import pytest

from tidemark.llm import similar


def copies() -> list[tuple]:
    rng = random.Random(11)
    vocabulary = ["w%d" % k for k in range(3000)]
    rows = [None, "", " \n ", "one", "one two three", "One  two three"]
    for n in (40, 90, 200, 500):
        for _ in range(8):
            base = rng.choices(vocabulary, k=n)
            rows.append(" ".join(base))
            for share in (0.01, 0.02, 0.03):  # similarity of about 0.95 to 0.75
                rows.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base))
    chain = rng.choices(vocabulary, k=120)
    for _ in range(60):  # a chain of near copies whose ends aren't similar
        chain[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append(" ".join(chain))
    rows += [rows[10], rows[10].upper()]
    out = list(enumerate(rows))
    out += [out[12], (None, rows[12]), (7, "another text of that id")]
    rng.shuffle(out)
    return [(*r, "x") for r in out]


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


@pytest.mark.parametrize("hot", [similar.HOT, 0])
def test_near_copies_of_pipeline(spark, hot, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(similar, "HOT", hot)
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string, first_id string").repartition(3)
    sets = brute_sets([r[1] for r in rows])
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = np.arange(len(rows))
    while True:
        new = np.where(near, label[None], len(rows)).min(axis=1)
        if (new == label).all():
            break
        label = new
    want = [min((r[0] for r, x in zip(rows, label, strict=True) if x == c and r[0] is not None), default=None) for c in sorted(set(label.tolist()))]
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_bands_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    hit = 0
    for _ in range(500):
        x = rng.integers(0, 2**63, 180, dtype=np.uint64)
        a, b = np.unique(x[:162]), np.unique(x[18:])  # 144 of 180 shared
        assert similar.similar(a, b)
        hit += bool((similar.band_keys(a) == similar.band_keys(b)).any())
    assert hit >= 495


def test_candidates_are_near_fingerprints(spark):
    """Buckets are blocks of SimHash fingerprints, and what they give is all that is near in Gray order."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k:300], rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in range(0, 60, 2)]
    prints = np.array([similar.prints_of(s) for s in sets])
    ones = np.array([[int(x) >> b & 1 for x in prints[0] for b in range(64)]])
    assert 0.4 < ones.mean() < 0.6
    # bits agree as SimHash says, in each of the fingerprints
    both = len(np.intersect1d(sets[0], sets[-1]))
    want = np.arccos(both / np.sqrt(len(sets[0]) * len(sets[-1]))) / np.pi
    assert abs(np.bitwise_count(prints[0] ^ prints[-1]).sum() / prints[0].size / 64 - want) < 0.04
    rows = spark.createDataFrame([(k, p.view(np.int64).tolist()) for k, p in enumerate(prints)], "th long, prints array<long>")
    found = similar.bucket_rows(rows)
    for k, s in enumerate(sets[:3]):
        assert {r.key for r in found.where(f"node = {k}").collect()} == set(similar.band_keys(s).tolist())
    got = {tuple(sorted((r.u, r.v))) for r in similar.bucket_pairs(found.withColumn("root", found["node"]), similar.LEADERS).collect()}
    keys = [set(similar.band_keys(s).tolist()) for s in sets]
    near = {(i, j) for j in range(len(sets)) for i in range(j) if keys[i] & keys[j] and similar.near(prints[i, :2], prints[j, :2])}
    assert got == near
    assert len(near) > 50


def test_links_of_near_copies_grow_with_their_number(spark):
    """A group of near copies gives few pairs a node, in small buckets and large ones, and stays one group."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[5:], rng.integers(0, 2**63, 5, dtype=np.uint64)])) for _ in range(150)]
    rows = spark.createDataFrame([(k, similar.prints_of(s).view(np.int64).tolist()) for k, s in enumerate(sets)], "th long, prints array<long>")
    found = similar.bucket_rows(rows)
    pairs = {tuple(sorted((r.u, r.v))) for r in similar.bucket_pairs(found.withColumn("root", found["node"]), 0).collect() if r.u != r.v}
    assert len(pairs) < 40 * len(sets) < len(sets) ** 2 / 2
    root = list(range(len(sets)))
    for _ in range(9):
        for u, v in pairs:
            root[u] = root[v] = min(root[u], root[v])
    assert set(root) == {0}


def test_rows_of_a_group_that_is_near_throughout(spark, monkeypatch):
    """Texts that are nearly similar, each to each, are compared without a row for each pair, and every link is found."""
    rng = random.Random(21)
    vocabulary = ["w%d" % k for k in range(5000)]
    base = rng.choices(vocabulary, k=300)
    words = []
    for _ in range(500):  # a similarity of about 0.7
        words.append(list(base))
        for at in rng.sample(range(300), 5):
            words[-1][at] = rng.choice(vocabulary)
    for w in rng.sample(words, 60):  # and some of over 0.8
        words.append(list(w))
        for at in rng.sample(range(300), 2):
            words[-1][at] = rng.choice(vocabulary)
    rows = [(k, " ".join(w)) for k, w in enumerate(words)]
    sets = brute_sets([r[1] for r in rows])
    label, near = list(range(len(rows))), 0
    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            near += both >= 0.6 * (len(sets[i]) + len(sets[j]) - both)
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                least, other = sorted((label[i], label[j]))
                label = [least if x == other else x for x in label]
    assert near > 0.9 * len(rows) * (len(rows) - 1) / 2 and 0.3 * len(rows) < len(set(label)) < len(rows) - 30
    monkeypatch.setattr(similar, "BLOCK", 64, raising=False)
    asked, made, check, write = [], [], similar.checked, similar.materialise

    def checked(docs, pairs, *more):
        asked.append(pairs.where("u <> v").select("u", "v").distinct().count())
        return check(docs, pairs, *more)

    def materialise(df, name):
        out = write(df, name)
        if name == "blocks":
            made.append(out.count())
        return out

    monkeypatch.setattr(similar, "checked", checked)
    monkeypatch.setattr(similar, "materialise", materialise)
    kept = similar.one_of_each_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    assert sum(asked) < 40 * len(rows) < near / 6
    assert len(made) == 1 and 2 * len(rows) < made[0] < 16 * len(rows)
