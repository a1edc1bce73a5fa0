"""The registered queries of the pipeline operators, each over whole tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistworks.llm import contamination, html_text, jaccard, language, manifest, mixture, quality_mil, quotes, repeats, rules, substrings, token_ids, whitening
from gistworks.session import checkpoint_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@_register
def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without quoted passages, linked to what they answer, in reply order."""
    return quotes.conversations(_table(spark, sf_dir, "conversations"))


@_register
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return os.path.join(checkpoint_folder(spark), f"{name}-{uuid.uuid4().hex}")


@_register
def op3_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids written in Simple-8b files and read back."""
    path = shared_path(spark, "token-ids")
    token_ids.write_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_ids.read_digests(spark, path)


@_register
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of twenty-word passages that occur earlier."""
    return substrings.dedup(_table(spark, sf_dir, "documents")).drop("kept")


@_register
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document by attention over its passages, learned from two thirds of the labels."""
    docs = _table(spark, sf_dir, "documents")
    part = quality_mil.crc_part(F.col("doc_id"), 3)
    model = quality_mil.fit(docs, _table(spark, sf_dir, "labels"), part != 1)
    held_out = F.coalesce(part == 1, F.lit(False)).alias("held_out")
    return quality_mil.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_register
def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mixture of 150% of all words takes of every document, with the time its first copy is due."""
    planned = mixture.schedule(_table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", "taken", "position")


@_register
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents inside ten-word windows of benchmark items."""
    return contamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_register
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by composite text density."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


@_register
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by character models learned from three quarters of them."""
    docs = _table(spark, sf_dir, "documents")
    part = language.crc_part(F.col("doc_id"), 4)
    model = language.fit(docs.where(part != 2))
    return language.detect(docs, model).select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@_register
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures of every document and the verdict of the rules."""
    return rules.report(_table(spark, sf_dir, "documents"))


@_register
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the leading components of their exact covariance, at unit variance."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


@_register
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and what a tampered copy of them folds to."""
    docs = _table(spark, sf_dir, "documents")
    return manifest.manifest(docs, manifest.tampered(docs))


@_register
def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 200-byte strings that start anywhere else."""
    return repeats.dedup(_table(spark, sf_dir, "documents")).drop("kept")
