"""The registered queries of the text-corpus operators, and their SQL where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontamination, html_extract, jaccard_join, license_scan, pii, quality, toxicity, url_filter
from .common import crc32_mod, table

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc32_mod(F.col("doc_id"), 5)
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", fold != 0, threshold=0.3)
    return quality.score(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc32_mod(F.col("doc_id"), 3)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", fold != 1, threshold=0.7)
    return toxicity.score(docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("bigint").alias("n_licenses"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5).select(F.col("query_id").cast("bigint"), "rank", F.col("vec_id").cast("bigint"), "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def license_sql() -> str:
    """The licence scan in SQL: identifiers are marked off as <id>, and rules are runs of them, longest first."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    runs = sorted(license_scan.RULES, key=lambda r: (-len(r[1]), r[0], r[1]))
    coded = {"".join(f"<{i}>" for i in run): name for name, run in reversed(runs)}
    pattern = "|".join(run.replace(".", r"\.") for _, run in sorted((-x.count("<"), x) for x in coded))
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in sorted(license_scan.SENTENCES.items()))
    rules = ", ".join(f"({quoted(run)}, {quoted(name)})" for run, name in sorted(coded.items()))
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
        WITH known(sentence, id) AS (VALUES {known}), rules(run, name) AS (VALUES {rules}),
        docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        marked AS (SELECT r, regexp_replace(regexp_replace({low.format("text")}, '(^|[^\p{{L}}\p{{N}}])v\.(\s)', '\1v.' || chr(31), 'g'), '[.;!?:](\s|$)', chr(30) || '\1', 'g') AS t FROM docs),
        whole AS (SELECT r, unnest(parts) AS s, generate_subscripts(parts, 1) AS i
                  FROM (SELECT r, regexp_split_to_array(t, '\x1e|\r?\n[ \t]*(?:\r?\n[ \t]*)+') AS parts FROM marked)),
        at_once AS (SELECT r, i, 0 AS j, id FROM whole JOIN known ON sentence = regexp_replace(trim(regexp_replace(s, '[^\p{{L}}\p{{N}}.-]+', ' ', 'g')), '\.+$', '')),
        lines AS (SELECT r, i, unnest(parts) AS s, generate_subscripts(parts, 1) AS j
                  FROM (SELECT r, i, regexp_split_to_array(s, '[\r\n]+') AS parts FROM whole ANTI JOIN at_once USING (r, i))),
        by_line AS (SELECT r, i, j, id FROM lines JOIN known ON sentence = regexp_replace(trim(regexp_replace(s, '[^\p{{L}}\p{{N}}.-]+', ' ', 'g')), '\.+$', '')),
        ids AS (SELECT r, list(id ORDER BY i, j) AS ids FROM (FROM at_once UNION ALL FROM by_line) GROUP BY r),
        runs AS (SELECT r, unnest(found) AS run, generate_subscripts(found, 1) AS i
                 FROM (SELECT r, regexp_extract_all('<' || array_to_string(ids, '><') || '>', {quoted(pattern)}) AS found FROM ids)),
        named AS (SELECT r, string_agg(name, ',' ORDER BY i) AS licenses, count(*) AS n FROM runs JOIN rules USING (run) GROUP BY r)
        SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_licenses
        FROM docs LEFT JOIN ids USING (r) LEFT JOIN named USING (r)
    """


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_html_extraction": op2_html_extraction,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_license_scans": op7_license_scans,
    "op8_ann": op8_ann,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_url_filters": op10_url_filters,
}

ORACLE_SQL = {
    "op7_license_scans": license_sql(),
    "op10_url_filters": r"""
        WITH parts AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages
        ), rules(r_host, r_path, r_verdict) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), hits AS (
            SELECT host, path, max(struct_pack(n := length(r_host || r_path), rule := r_host || r_path, verdict := r_verdict)) AS best
            FROM (SELECT DISTINCT host, path FROM parts) p
            JOIN rules ON (p.host = r_host OR p.host LIKE '%.' || r_host) AND starts_with(p.path, r_path)
            GROUP BY host, path
        )
        SELECT p.page_id, p.host, p.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN hits h ON p.host = h.host AND p.path = h.path
    """,
}
