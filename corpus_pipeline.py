"""A corpus pipeline over documents; each stage calls one operator of ``flowsentry.llm``.

Stages take and return the columns of documents; others that the input has are left out. Null texts are rejected by the first
stage and count as empty in the others. Rows without an id are kept by the second and third stage as long as their text is
theirs alone; rows that share an id stay or go together in the third. An empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.llm import bpe, common, exact_dedup, jaccard, langid, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter go, whatever their language and however sure it is.

    Where the language was not known, the predicted one takes its place and stays to the end.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit_if_labelled(docs.where(langid.bucket(F.col("doc_id"), 4) != 2), max_languages=None)
    if not model.languages:  # nothing is named, so the letters decide alone
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = langid.predict(docs, model).where(F.col("lang_pred") != langid.UNDETERMINED)
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest id stays."""
    return exact_dedup.keep_one(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the smallest id stays."""
    docs = docs.select(*COLUMNS)
    groups = jaccard.similar(docs)
    dropped = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighted by the square root of their size, over one epoch's bytes."""
    return mixing.mix(docs.select(*COLUMNS), temperature=0.5, seed=29).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the ids of each copy, and whether they decode to its text."""
    made = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))
    return made.select(
        "doc_id",
        "lang",
        "source",
        bpe.n_tokens().alias("n_tokens"),
        "token_ids",
        (F.col("decoded") == common.utf8("text").cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_copies),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

# Language ID is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.settle(stage(spark, docs, sf_dir), name)
    return docs
