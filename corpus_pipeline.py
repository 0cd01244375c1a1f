"""A corpus pipeline of five stages; each takes what the one before kept.

In every stage rows that repeat are taken one by one, texts are read whole whatever their length, columns beyond COLUMNS are dropped, and an
empty table gives an empty one.  What a null or an empty text or doc_id means is said by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm import packing, pii, rules, setsketch, weak
from lexgrove.llm.common import cut, table
from lexgrove.llm.queries import CAPACITY, END_ID, KEY, path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _shape(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(f"`{c}`") for c in COLUMNS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score by the rule ensemble is at or above its threshold. A null text scores as an empty one; a null doc_id is scored too; without labels all are kept."""
    return rules.accepted(_shape(docs), table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the votes' posterior holds to be good. Null and empty texts have no words and go; a null doc_id does not matter."""
    return weak.accepted(_shape(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near copies; rows with a null doc_id, and texts without words, stay; rows that share a kept doc_id all stay."""
    found = setsketch.near_duplicates(docs)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return _shape(docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets; n_chars is counted anew. A null text stays null, with null n_chars."""
    out = pii.pseudonymised(_shape(docs), KEY)
    return _shape(out.withColumn("n_chars", F.length("text").cast("long")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its sequence and place there. A null or empty text is one piece, its end id; a null doc_id is kept."""
    return packing.pack_documents(docs, path("byte_bpe_50k.json"), CAPACITY, END_ID).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", surrogates),
    ("packing", best_fit_packing),
]
#: The first stage learns a model; SQL cannot say it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents. Each is computed once and kept in the session's checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
