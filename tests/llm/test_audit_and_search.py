"""Operators 11 to 13 against brute force on small tables with nulls, ties, repeats, long texts and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import divergence, lexical, multiprobe

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM11 = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
TERM13 = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


ONE_TASK = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))


@pytest.fixture
def here(spark, monkeypatch):
    """Runs a module's tasks in this process, where its settings are patched."""

    def patch(module, **settings):
        def run(df, task, ddl):
            found = list(task(iter(df.toArrow().to_batches(max_chunksize=300))))
            rows = pa.Table.from_batches(found).to_pylist() if found else []
            names = [c.split(" ")[0] for c in ddl.split(", ")]
            return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ddl)

        monkeypatch.setattr(module, "arrow_map", run)
        for name, value in settings.items():
            monkeypatch.setattr(module, name, value)

    return patch


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéßÄ9Z") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    prose = lambda n: rng.choice(" ,.\n").join(rng.choices(vocabulary, weights=range(150, 0, -1), k=n))
    out = [(k, prose(rng.randint(1, 80)), rng.choice(["de", "en", None]), rng.choice(["a", "a", "a", "b", "c", "", None])) for k in range(250)]
    out += [(k, None, "en", "empty") for k in range(250, 253)] + [(253, "", "de", "a"), (254, " .,- ", None, "b"), (255, "rare words only", "xx", "a"), (256, None, "xx", "b")]
    out += [out[3], out[3], (3, out[3][1], "de", "c"), (None, out[4][1], "en", "a"), (None, prose(30), "en", "a"), (300, prose(40_000), "en", "b"), (301, out[5][1].upper(), "en", "b")]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n long, term string, gid int, item string, score long, rank int"
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3, 4) for r in rows], schema).repartition(5)


def audited(rows, min_docs, top):
    held: dict = defaultdict(Counter)
    n: dict = defaultdict(Counter)
    for _, text, lang, source in rows:
        found = Counter(TERM11.findall((text or "").translate(LOWER)))
        held[lang or ""].update(found.keys())
        n[lang or "", source or ""].update(found)
    out = []
    for lang in held:
        kept = [t for t, d in held[lang].items() if d >= min_docs]
        groups = {s: c for (x, s), c in n.items() if x == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q, shares = p(whole), {s: p(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(o, sum(abs(shares[s][t] - shares[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, shares[s][t] - q[t]) for t in kept if groups[s][t] and shares[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "top"), [(30, 50), (3, 5), (10_000, 5)])
def test_audit(docs, rows, min_docs, top):
    got = divergence.audit(docs, min_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audited(rows, min_docs, top)


def test_audit_in_small_portions(docs, rows, here):
    """Pieces of texts, partial counts that are sent on early, several passes of groups."""
    here(divergence, PIECE=3000, PARTS=200, BLOCK=50, GROUPS=7)
    assert sorted(map(tuple, divergence.audit(docs, 3, 5).collect())) == audited(rows, 3, 5)
    assert divergence.audit(docs.limit(0)).count() == 0


def scored(rows, items, top):
    terms = [(r[0], Counter(TERM13.findall((r[1] or "").translate(LOWER)))) for r in rows]
    terms = [x for x in terms if x[1]]
    n_docs, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        found = []
        own = set(TERM13.findall((text or "").translate(LOWER)))
        for doc, c in terms:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort(key=lambda x: x[:3])
        out += [(item, k + 1, doc, -score) for k, (score, _, _, doc) in enumerate(found[:top])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(2)
    texts = [r[1] for r in rows if r[1]]
    out = [(f"i{k}", " ".join(rng.choice(texts)[:200].split()[: rng.randint(1, 25)])) for k in range(30)]
    return [*out, out[0], ("none", None), ("blank", " ,. "), ("unknown", "qqqq"), (None, texts[0][:50])]


@pytest.mark.parametrize("small", [False, True])
def test_lexical_search(spark, docs, rows, items, small, here):
    if small:
        here(lexical, TaskContext=ONE_TASK, SEGMENT_DOCS=40, CLUSTER=4, SEEDS=1, ITEM_BYTES=2000, PIECE=100)
    table = spark.createDataFrame([(*i, 5, 6) for i in items], "item_id string, text string, doc_id int, cluster int")
    got = lexical.search(docs, table, 7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == scored(rows, items, 7)


def test_lexical_search_stops_before_the_end(spark, docs, rows, here):
    here(lexical, TaskContext=ONE_TASK, SEGMENT_DOCS=40, CLUSTER=4)
    index, n = lexical.build_index(docs)
    table = spark.createDataFrame([("one", max((r[1] or "" for r in rows), key=len)[:30])], "item_id string, text string")
    visits = spark.sparkContext.accumulator(0)
    assert lexical.ranked(spark, index, n, table, 1, visits).count() == 1
    assert 0 < visits.value < index.count()
    nothing = table.limit(0)
    assert lexical.search(docs, nothing).count() == lexical.search(docs.limit(0), table).count() == 0


def test_bisection_keeps_documents_and_joins_topics():
    rng = np.random.default_rng(1)
    topic = rng.permutation(np.repeat(np.arange(8), 32))
    own = [np.unique(np.concatenate([t * 40 + rng.integers(0, 40, 12), 320 + rng.integers(0, 40, 3)])) for t in topic]
    start = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    found = lexical.clusters(start, np.concatenate(own), 360, 32)
    assert sorted(np.concatenate(found).tolist()) == list(range(256))
    assert max(map(len, found)) <= 32
    pure = sum(np.bincount(topic[c]).max() for c in found) / 256
    assert pure > 0.8 > sum(np.bincount(topic[k : k + 32]).max() for k in range(0, 256, 32)) / 256


SCHEMA = "vec_id long, embedding array<float>, q long, c long, v string, score int, rank int"


def embeddings(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    x = (centres[rng.integers(0, 6, n)] + 0.6 * rng.normal(size=(n, dims))) * rng.uniform(0.5, 2, (n, 1))
    return [(int(k), [float(np.float32(a)) for a in v]) for k, v in enumerate(x)]


def nearest(rows, top, every):
    fine = [(k, v) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    size = max(Counter(len(v) for _, v in fine).items(), key=lambda x: (x[1], x[0]))[0] if fine else 0
    least: dict = {}
    for k, v in fine:
        if len(v) == size:
            least[k] = min(least.get(k, v), v)
    out = {}
    for k, v in least.items():
        if k % every == 0:
            found = sorted((-float(np.dot(np.array(v, np.float64), np.array(w, np.float64))), j) for j, w in least.items() if j != k)
            out[k] = [(j, -s) for s, j in found[:top]]
    return out


def recall(got, want):
    """Share of the neighbours found; every row is checked for its score, order and rank."""
    by: dict = defaultdict(list)
    for q, rank, j, score in sorted(got):
        assert rank == len(by[q]) + 1
        by[q].append((j, score))
    assert set(by) == {q for q, found in want.items() if found}
    hit = total = 0
    for q, found in want.items():
        assert len(by[q]) == len(found)
        assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(by[q], by[q][1:], strict=False))
        exact = dict(found)
        assert all(s == pytest.approx(exact[j], rel=1e-12) for j, s in by[q] if j in exact)
        hit += sum(j in exact for j, _ in by[q])
        total += len(found)
    return hit / total if total else 1.0


def test_neighbours(spark):
    rows = embeddings(3000, 12, 4)
    odd = [(3000, None), (3020, [0.0] * 12), (3040, [1.0] * 11 + [float("nan")]), (3060, [1.0] * 11 + [None]), (3080, [1.0] * 5), (None, rows[7][1]), (3100, [float("inf")] + [1.0] * 11), (40, rows[41][1])]
    copies = [(10_000 + k, rows[20][1]) for k in range(60)] + [(20_000 + k, rows[9][1]) for k in range(3)]
    rows = rows + odd + copies
    df = spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], SCHEMA).repartition(5)
    got = multiprobe.search(df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert recall(list(map(tuple, got.collect())), nearest(rows, 20, 20)) >= 0.9


@pytest.mark.parametrize("n", [0, 1, 2, 15])
def test_neighbours_of_few(spark, n):
    """All candidates, exactly, where there are fewer than asked for."""
    rows = embeddings(n, 3, n) + [(100 + k, [1.0, 2.0, 2.0]) for k in range(n // 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(list(map(tuple, multiprobe.search(df, 20, 2).collect())), nearest(rows, 20, 2)) == 1.0


def test_merging_nothing():
    none = np.zeros(0, np.int64)
    assert [len(x) for x in multiprobe._merged(none, none, np.zeros(0), 5)] == [0, 0, 0]


def test_neighbours_in_blocks(spark, here):
    """Buckets that are dealt over a grid of blocks, and no setting that suffices."""
    rows = embeddings(400, 6, 9)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = nearest(rows, 5, 10)
    here(multiprobe, BLOCK=64, GATHER=50)
    assert recall(list(map(tuple, multiprobe.search(df, 5, 10).collect())), want) >= 0.9
    here(multiprobe, PROBES=1, TARGET=1.0)
    assert recall(list(map(tuple, multiprobe.search(df, 5, 10).collect())), want) == 1.0
