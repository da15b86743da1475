"""The corpus pipeline: language, toxicity, near duplicates, personal data, packing.

Each stage takes the documents that its predecessor kept; all but the last return
the columns of ``documents``.  ``run`` writes what a stage returns to the shared
folder and reads it again for the next one.

Rows without an id and rows that repeat one are documents of their own to the
near-duplicate stage, which keeps one row of each group.  Null texts have no language and leave
at the first stage.  Columns beyond those of ``documents`` stay where rows stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmon.llm import langid, minhash, packing, pii, toxicity
from procmon.llm.common import table, written

NEAR_PERCENT = 80  # documents at least so alike are near duplicates (op3's own contract says 85)
LEAST_KNOWN = 0.2  # share of a text's n-grams that its language must hold


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language."""
    model = langid.train(langid.learned_from(docs))
    found = langid.predict(docs, model, carry=tuple(docs.columns)).where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_KNOWN))
    return found.select(*(F.col(f"carry_{c}").alias(c) for c in docs.columns))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted to be toxic."""
    model = toxicity.train(docs, toxicity.learned_from(table(spark, sf_dir, "labels")))
    found = toxicity.score(docs, model, carry=tuple(docs.columns)).where("predicted = 0")
    return found.select(*(F.col(f"carry_{c}").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each near-duplicate component, at a similarity of 0.8 or more."""
    return minhash.representatives(docs, percent=NEAR_PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data and the terms that give it away."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' ids into sequences; ``ids`` holds a piece's ids as little-endian unsigned 32-bit integers."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=True)


STAGES = [("language_id", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

ORACLE_SQL = None  # no SQL has these models, min-hashes or tokenizers


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
