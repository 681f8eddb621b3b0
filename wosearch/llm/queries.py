"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from wosearch.llm import (
    alignment, html_text, lattice, merkle, mixing, ngram_model, packing, pii, secrets, simhash,
    spotsigs, toxicity, warc,
)
from wosearch.llm.common import is_held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edits(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id"), toxicity.FOLDS).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot"
    )


def op4_ngram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_model.score(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs).select("doc_id", "pii_spans")
    spans = F.col("pii_spans")
    base = [kind.name for kind in pii.KINDS if kind.base]
    return found.select(
        "doc_id",
        *(pii.count_of(spans, kind).alias(f"n_{kind}") for kind in base),
        F.sha2(pii.digest(F.filter(spans, lambda s: s["kind"].isin(*base))), 256)
        .alias("base_sha256"),
        pii.digest(spans).alias("spans"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0))
        .alias("top_score"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.link(table(spark, sf_dir, "embeddings"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*secrets.BASE))
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(secrets.count_of(spans, kind).alias(f"n_{kind}") for kind in secrets.BASE),
        F.sha2(secrets.digest(base), 256).alias("base_sha256"),
        secrets.digest(spans).alias("spans"),
    )


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fold(merkle.manifest(table(spark, sf_dir, "documents")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


LLM_QUERIES: dict[str, Query] = {
    "op1_spotsigs": op1_spotsigs,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_ngram_model": op4_ngram_model,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_lattice": op7_lattice,
    "op8_secrets": op8_secrets,
    "op9_html": op9_html,
    "op10_simhash": op10_simhash,
    "op11_merkle": op11_merkle,
    "op12_alignment": op12_alignment,
    "op13_warc": op13_warc,
    "pipeline": pipeline,
}
