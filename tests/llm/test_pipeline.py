"""The whole pipeline over small tables, against its stages done by hand."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import mixing, quality
from tidemark.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row string, fp long, mix_key string, _order int, position string"


def rows():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    bench = prose(30)
    texts: list = [None, "", " \n", "too short to stay", "again and again " * 60, prose(50) + " " + bench + " " + prose(20)]
    for n in (60, 90, 200, 300):
        for _ in range(6):
            t = prose(n)
            near = t.split()
            near[n // 2] = "changed"
            texts += [t, t, " ".join(near)] if rng.random() < 0.5 else [t]
    out = [(k, t, "xx", None if k % 9 == 0 else f"s{min(2, k % 7)}") for k, t in enumerate(texts)]
    out += [out[8], (None, prose(70), "xx", "s1"), (None, None, None, None)]
    rng.shuffle(out)
    return [(*r, None if r[1] is None else len(r[1]), "a", 1, "b", 2, "c") for r in out], bench


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    data, bench = rows()
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(data, COLUMNS).repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, bench), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, data, bench


def words(text):
    return (text or "").lower().split()


def by_hand(data, bench, kept):
    """Rows that are left before the mixing."""
    left = [r for r in data if (r[0], r[1]) in kept]
    sets = [{tuple(words(r[1])[k : k + 5]) for k in range(max(1, len(words(r[1])) - 4))} for r in left]
    label = list(range(len(left)))
    changed = True
    while changed:
        changed = False
        for i in range(len(left)):
            for j in range(i):
                if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    firsts = {}
    for r, c in zip(left, label, strict=True):
        firsts[c] = min(firsts.get(c, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    windows = {tuple(words(bench)[k : k + 10]) for k in range(21)}
    return [r for r in firsts.values() if not any(tuple(words(r[1])[k : k + 10]) in windows for k in range(len(words(r[1]))))]


def test_pipeline(spark, tables):
    from tokenizers import Tokenizer

    folder, data, bench = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {(r.doc_id, r.text) for r in quality.score(docs, quality.fit_references(docs)).where("kept").join(docs, "doc_id").collect()} | {(None, r[1]) for r in data if r[0] is None and r[1]}
    want = by_hand(data, bench, kept)
    assert 5 < len(want) < len({r[:2] for r in data}) - 5
    assert not any(bench in (r[1] or "") for r in want)
    result = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in result} == {r[0] for r in want}
    # token files: every copy whole, starts without gaps, ids as the tokenizer gives them
    t = Tokenizer.from_file(tokenizer_path())
    crc = {r[0]: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in want for ids in [t.encode(r[1], add_special_tokens=False).ids + [2]]}
    at = 0
    for r in sorted(result, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, *crc[r.doc_id])
        at += r.n_tokens
    # budgets: the rows of a source as often as its weight takes them
    mixed = spark.createDataFrame([r[:4] for r in want], "doc_id long, text string, lang string, source string")
    passes = {r.src: r.passes for r in mixing.mix_weights(mixed).collect()}
    copies: dict = {}
    for r in result:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for r in want:
        assert passes[r[3]] <= copies[r[0]] <= passes[r[3]] + 1


def test_stages_keep_columns(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_empty_table(spark, tables, tmp_path):
    folder, _, _ = tables
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
