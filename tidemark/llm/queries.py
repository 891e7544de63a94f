"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import divergence, lexical
from tidemark.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact_substrings import digest

    return digest(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_output import token_table

    return token_table(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.spans import summary

    return summary(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).drop("url")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import digest, scan_documents

    return digest(scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import fit_references, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_references(docs))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import fit_filters, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_filters(docs))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op12_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.multiprobe import search

    return search(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_html_extraction": op4_html_extraction,
    "op5_decontamination": op5_decontamination,
    "op8_source_mixing": op8_source_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op6_suffix_array": op6_suffix_array,
    "op7_token_output": op7_token_output,
    "op11_source_divergence": op11_source_divergence,
    "op12_ann": op12_ann,
    "op13_lexical_search": op13_lexical_search,
}


def _mixing_sql(target_entropy: float, max_epochs: float, block_rows: int) -> str:
    """The mixture with a budget that takes every source once, with bisection as a recursion over lists."""
    unit = "(CAST('0x' || substr(md5({}), 1, 12) AS BIGINT) / 281474976710656.0)"
    return f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || coalesce(md5(text), '~')) AS key,
                   CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_words
            FROM documents),
        src AS (SELECT source, count(*) AS n_rows, sum(n_words) AS tokens, sum(n_words) / greatest(1, sum(sum(n_words)) OVER ()) AS share FROM words GROUP BY source),
        l AS (SELECT list(share ORDER BY share) AS p, count(*) AS n FROM src WHERE share > 0),
        ends AS (SELECT {target_entropy} * ln(n) AS goal, n, list_sum(list_transform(p, lambda x: -x * ln(x))) AS h1, list_max(p) / list_min(p) AS e0, p FROM l),
        be(i, lo, hi) AS (
            SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
            SELECT i + 1, CASE WHEN ok THEN lo ELSE m END, CASE WHEN ok THEN m ELSE hi END FROM (
                SELECT i, lo, hi, (lo + hi) / 2 AS m,
                       ln(list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2)))) - list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2) * (lo + hi) / 2 * ln(x))) / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) <= goal AS ok
                FROM be, ends WHERE i < 40)),
        br(i, lo, hi) AS (
            SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
            SELECT i + 1, CASE WHEN ok THEN lo ELSE m END, CASE WHEN ok THEN m ELSE hi END FROM (
                SELECT i, lo, hi, (lo + hi) / 2 AS m,
                       list_max(list_transform(p, lambda x: pow(x, (lo + hi) / 2) / x)) / list_min(list_transform(p, lambda x: pow(x, (lo + hi) / 2) / x)) <= {max_epochs} AS ok
                FROM br, ends WHERE i < 40)),
        a AS (SELECT CASE WHEN n <= 1 THEN 1.0 ELSE greatest(
                     CASE WHEN h1 >= goal THEN 1.0 WHEN ln(n) <= goal THEN 0.0 ELSE (SELECT hi FROM be WHERE i = 40) END,
                     CASE WHEN e0 > {max_epochs} THEN (SELECT hi FROM br WHERE i = 40) ELSE 0.0 END) END AS a FROM ends),
        raw AS (SELECT src.*, CASE WHEN share > 0 THEN pow(share, a) ELSE 0.0 END AS r FROM src, a),
        w AS (SELECT source, n_rows, tokens, r / sum(r) OVER () AS weight, CAST(round(r * coalesce(max(CASE WHEN share > 0 THEN tokens / r END) OVER (), 0)) AS BIGINT) AS budget FROM raw),
        b AS (SELECT *, CAST(CASE WHEN tokens > 0 THEN floor(budget / tokens) ELSE 1 END AS BIGINT) AS passes, CAST(greatest(1, ceil(n_rows / {block_rows}.0)) AS BIGINT) AS blocks FROM w),
        placed AS (SELECT d.*, b.weight, b.budget, b.passes, b.tokens, CASE WHEN b.tokens > 0 THEN b.budget - b.passes * b.tokens ELSE 0 END AS left_over,
                          CAST(floor({unit.format("'block:' || key")} * b.blocks) AS BIGINT) AS block
                   FROM words d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
        tail AS (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY source ORDER BY {unit.format("'pass:' || coalesce(source, '~') || ':' || passes || ':' || block")}, block, {unit.format("'row:' || passes || ':' || key")}, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                 FROM placed WHERE left_over > 0),
        taken AS (
            SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, block, n_words, weight, budget, key, tokens FROM placed, unnest(range(passes)) AS t(epoch)
            UNION ALL SELECT doc_id, source, passes, block, n_words, weight, budget, key, tokens FROM tail WHERE before < left_over),
        ordered AS (
            SELECT *, (epoch + {unit.format("'pass:' || coalesce(source, '~') || ':' || epoch || ':' || block")}) / CASE WHEN tokens > 0 THEN budget / tokens ELSE 1.0 END AS progress,
                   {unit.format("'row:' || epoch || ':' || key")} AS place FROM taken)
        SELECT row_number() OVER (ORDER BY progress, coalesce(source, '~'), epoch, block, place, key) - 1 AS position,
               doc_id, source, epoch, block, n_words, round(weight, 9) AS weight, budget FROM ordered"""


ORACLE_SQL: dict[str, str] = {
    "op8_source_mixing": _mixing_sql(0.9985, 4.0, 1000),
    "op2_warc": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
        FROM m""",
    "op11_source_divergence": divergence.SQL,
    "op13_lexical_search": lexical.SQL,
}
