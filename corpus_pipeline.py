"""A corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import bpe, classifier, jaccard, mixing, pii
from chartloom.llm.common import cut, documents
from chartloom.llm.queries import tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``docs``, rejects go."""
    return classifier.accepted(docs, classifier.fit(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles, at 0.8 or more, the one of least doc_id stays."""
    return jaccard.distinct(docs, k=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the mix of sources asks for."""
    return mixing.mixed_documents(docs)


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded_sha256 of each document taken."""
    rows = bpe.encode(docs, tokenizer("byte_bpe_50k.json"))
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("bpe_coding", bpe_coding),
]

#: The classifier's fit and the tokenizer's merges have no SQL. Tests hold the operators of stages 2 to 5 against brute-force
#: versions and the classifier against labels; the pipeline's own test compares run() with its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the checkpoint folder for the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
