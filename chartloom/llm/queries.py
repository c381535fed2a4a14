"""The operators' queries over the tables of a folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import bpe, classifier, jaccard, mixing, pii, rlz, rules, suffixes, syncmers, unigram
from chartloom.llm.common import documents


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies, on the driver and the executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.digests(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(documents(spark, sf_dir))


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(documents(spark, sf_dir))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.scan(documents(spark, sf_dir))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "least_score")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir), k=4, num=85, den=100)


def op7_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality")
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = classifier.classify(docs, classifier.fit(docs))
    return out.select("doc_id", F.round("posterior", 6).alias("posterior"), F.round("score", 4).alias("score"), "kept")


OPERATORS = (
    op1_repeated_passages, op2_document_fingerprints, op3_repeated_bytes, op4_personal_data, op5_mix_sources, op6_ngram_jaccard_join, op7_bpe_coding, op8_quality_rules, op9_token_counts, op10_quality_classifier,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: Where SQL can express a query; the others are held against brute-force versions in the tests.
ORACLES = {
    "op1_repeated_passages": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents), p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        k AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i + 19], ' ') END AS key FROM p),
        f AS (SELECT doc_id, i, word, (key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1)::int AS again FROM k),
        c AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
        g AS (SELECT doc_id, count(*) AS n, sum(gone)::bigint AS r, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN g USING (doc_id)""",
    "op3_repeated_bytes": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d),
        k AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * (i + 400) <= length(h) THEN md5(substr(h, 2 * i + 1, 800)) END AS key FROM p),
        f AS (SELECT doc_id, i, byte, (key IS NOT NULL AND count(*) OVER (PARTITION BY key) > 1)::int AS again FROM k),
        c AS (SELECT doc_id, i, byte, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone FROM f),
        e AS (SELECT doc_id, i, byte, gone, gone > lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS opens FROM c),
        g AS (SELECT doc_id, count(*) AS n, sum(gone)::bigint AS r, count(*) FILTER (WHERE opens) AS s, string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM e GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_bytes, coalesce(r, 0)::bigint AS n_removed, coalesce(s, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents LEFT JOIN g USING (doc_id)""",
    "op6_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS l FROM w),
        t AS (SELECT doc_id, len(l) AS n, unnest(l) AS x FROM s), j AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT u, v FROM j WHERE 100 * c >= 85 * (m + n - c)), ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
        reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, ways.v FROM reach JOIN ways ON reach.v = ways.u)
        SELECT doc_id, len(l)::bigint AS n_shingles, least_id AS component_id FROM s JOIN (SELECT u AS doc_id, min(v) AS least_id FROM reach GROUP BY 1) USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
