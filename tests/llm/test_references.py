"""References of languages that are rare in the table."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality


def test_rare_languages_keep_their_reference(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('en', 'de')")
    rare = d.where("lang = 'de'").limit(40)
    few = d.where("lang = 'de'").limit(5).withColumn("lang", F.lit("xx"))
    common = d.where("lang = 'en'")
    docs = common.unionByName(rare).unionByName(few)
    ref = quality.fit_references(docs, sample_rows=40)
    assert ref.langs == ["de", "en"]
    assert ref.few == {"xx"}
    own = quality.fit_references(rare)
    assert (ref.chars[0] == own.chars[0]).all()  # all 40 rows, not a few of them
    assert all(r.kept != r.base_failed for r in quality.score(few, ref).collect())
    assert quality.passing_documents(few, ref).count() == quality.score(few, ref).where("kept").count()


def test_references_rest_on_all_rows(spark):
    """More rows than the former sample of 6,000, whose eight commonest words lead by one row."""
    word = F.concat(F.lit("w"), F.translate((F.col("id") % 16).cast("string"), "0123456789", "abcdefghij"), F.lit(" "))
    docs = spark.range(8008).select(F.col("id").alias("doc_id"), F.repeat(word, 60).alias("text"), F.lit("en").alias("lang"))
    ref = quality.fit_references(docs.repartition(3), common_words=8)
    assert set(ref.common) == {b"w" + bytes([97 + k]) for k in range(8)}


def test_references_by_hand(spark):
    """Medians, then means of what is near, however the rows are dealt."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en' and n_chars > 200")
    ref, again = quality.fit_references(d.repartition(5)), quality.fit_references(d.repartition(2))
    assert ref.common == again.common
    assert (ref.chars == again.chars).all()
    assert (ref.words == again.words).all()
    texts = [r.text.encode() for r in d.collect()]
    for found, got in (
        ([quality.char_histogram(t) for t in texts], ref.chars[0]),
        ([quality.word_histogram(quality.words_of(t), ref.common) for t in texts], ref.words[0]),
    ):
        shares = np.array([h / h.sum() for h in found])
        centre = np.median(shares, axis=0)
        for _ in range(2):
            far = quality.distance(shares, centre[None])
            centre = shares[far <= np.median(far) * 1.5].mean(axis=0)
        assert float(quality.distance(got, centre)) < 0.02
