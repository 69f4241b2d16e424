"""A training corpus from documents, in five stages, each on all rows that its predecessor kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import decontamination, near_duplicates, packing, personal_data, quality, shared

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _wrapped(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator needs, and the whole row aside, so that no name of it can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    found = shared.stored(quality.measured(_wrapped(docs, "text", "lang")).drop("text"), "measured")
    return quality.judged(found, shared.stored(quality.references(found), "references")).where("kept").select("__row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of a similarity of 0.8: that of the least id (of rows with this id, the one of the least text). Rows without an id stay."""
    kept = near_duplicates.near_duplicates(docs, threshold=80).where("kept").select("doc_id")
    order = ["text", *(c for c in docs.columns if c != "text")]
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in order])).alias("row"))
    return one.select("row.*").select(docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontamination.clean(docs, shared.read_table(spark, sf_dir, "benchmark")).select(docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows where docs have it."""
    model = personal_data.trained(personal_data.vectors(docs))
    out = personal_data.redacted(personal_data.with_spans(_wrapped(docs, "text"), model))
    changed = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text").cast("long"), F.col("__row.n_chars"))}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Components, boosted trees and byte-pair encoding can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result on the documents of sf_dir."""
    docs = shared.read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.stored(docs, name)
    return docs
