"""A corpus pipeline over ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and
returns a DataFrame; it is written as Parquet and read again for the next. All but
the last return the columns of ``documents``; the last returns a row per document: doc_id,
n_tokens, ids_sha256 and decoded_sha256.

The steps go to the shared folder in ``spark.checkpoint.dir`` and only paths are kept, so
a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, decontamination, jaccard_join, pii, toxicity
from quillgraph.llm.common import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity reaches 0.7; the model learns from the labels of ``sf_dir`` and its documents."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", threshold=0.7)
    return toxicity.score(docs, model, keep=True, score_col="__toxicity").where("__toxicity < 0.7").drop("__toxicity")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.deduplicate(docs, width=5, num=8, den=10)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, edited or not."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; ``n_chars``, where present, becomes the length of the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", decontaminate),
    ("pii", redact_personal_data),
    ("byte_bpe", tokenize),
]

#: The stages hold trained models and iterations, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
