"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quireflow.llm import decontamination, html_text, license_scan, near_duplicates, packing, personal_data, quality, shared, token_ids, toxicity, url_filter


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = shared.stored(quality.measured(docs).drop("text"), "measured")
    return quality.judged(found, shared.stored(quality.references(found), "references")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.scratch_path(spark, "token-files")
    manifest = token_ids.write_corpus(shared.read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_ids.corpus_digest(spark, folder, manifest)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judged(shared.read_table(spark, sf_dir, "documents"), shared.read_table(spark, sf_dir, "benchmark"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = personal_data.trained(personal_data.vectors(docs))
    return personal_data.report(personal_data.with_spans(docs, model))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shared.read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, url_filter.rule_table(spark, url_filter.RULES)).select("page_id", "host", "path", "rule", "verdict")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(shared.read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(shared.read_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(license_scan.scanned(shared.read_table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, toxicity.fit(docs, shared.read_table(spark, sf_dir, "labels")))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shared.read_table(spark, sf_dir, "pages")
    return html_text.extracted(pages, html_text.fit_weights(pages))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_ids": op2_token_ids,
    "op3_decontamination": op3_decontamination,
    "op4_personal_data": op4_personal_data,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_license_scan": op8_license_scan,
    "op9_toxicity": op9_toxicity,
    "op10_html_text": op10_html_text,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op1_quality": quality.ORACLE, "op3_decontamination": decontamination.ORACLE, "op5_url_filter": url_filter.ORACLE}
