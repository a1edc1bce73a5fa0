"""The corpus jobs from files to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gistworks.operators import extract, extractor, labels, lexrank, observed, sampling
from gistworks.session import checkpointed
from gistworks.sources import corpus

ALL = "all"


def load(spark: SparkSession, folder: str, name: str, split: str, rows: int | None = None) -> DataFrame:
    """One corpus, or every corpus of the folder for ``all``."""
    if name == ALL:
        return corpus.read_corpora(spark, folder).drop("corpus", "split")
    return corpus.read_articles(spark, corpus.corpus_path(folder, name, split), rows)


def extract_corpus(
    spark: SparkSession,
    data_dir: str,
    output_dir: str,
    name: str,
    split: str = "val",
    nsent: int = extract.DEFAULT_SENTENCES,
    rows: int | None = None,
) -> str:
    """Greedy ROUGE-L pseudo summaries of a corpus; the path written."""
    path = corpus.corpus_path(output_dir, name, split)
    corpus.write_articles(extract.pseudo_summaries(load(spark, data_dir, name, split, rows), nsent), path)
    return path


def lexrank_corpus(
    spark: SparkSession,
    data_dir: str,
    output_dir: str,
    name: str,
    split: str = "train",
    nsent: int = lexrank.DEFAULT_SENTENCES,
    rows: int | None = None,
) -> str:
    """LexRank summaries of a corpus; the path written."""
    path = corpus.corpus_path(output_dir, name, split)
    corpus.write_articles(lexrank.summaries(load(spark, data_dir, name, split, rows), nsent), path)
    return path


def label_corpus(
    spark: SparkSession,
    pseudo_dir: str,
    original_dir: str,
    output_dir: str,
    name: str,
    split: str = "train",
    balance: bool = False,
    rows: int | None = None,
    seed: int = sampling.DEFAULT_SEED,
) -> str:
    """Sentence labels of a corpus as CSV; the path written."""
    joined = labels.join_originals(
        load(spark, pseudo_dir, name, split, rows), load(spark, original_dir, name, split, rows)
    )
    labelled = labels.binary_labels(joined)
    if balance:
        labelled = sampling.balance_classes(checkpointed(labelled), ["id", "sent_idx"], seed)
    path = f"{output_dir}/{name}_{split}.csv"
    corpus.write_sentences(labelled, path)
    return path


def label_with_report(
    spark: SparkSession,
    pseudo_dir: str,
    original_dir: str,
    output_dir: str,
    name: str,
    split: str = "train",
    rows: int | None = None,
) -> tuple[str, dict[str, int]]:
    """Sentence labels of a corpus as CSV: the path written, and counts and
    consistency of the labelling, gathered while it was written."""
    joined = labels.join_originals(
        load(spark, pseudo_dir, name, split, rows), load(spark, original_dir, name, split, rows)
    )
    labelled, watch = observed.labelled_with_report(joined)
    path = f"{output_dir}/{name}_{split}.csv"
    corpus.write_sentences(labelled, path)
    return path, watch.get


def train_extractor(
    spark: SparkSession,
    labels_path: str,
    model_path: str,
    smoothing: tuple[float, ...] = extractor.SMOOTHING,
    penalties: tuple[float, ...] = extractor.PENALTIES,
    seed: int = sampling.DEFAULT_SEED,
) -> str:
    """A sentence classifier from a written table of sentence labels; the path
    it is saved to."""
    labelled = corpus.read_sentences(spark, labels_path)
    split = checkpointed(sampling.stratified_split(labelled, ["id", "sent_idx"], seed))
    model, _ = extractor.train(split, smoothing, penalties)
    extractor.save(model, model_path)
    return model_path


def apply_extractor(
    spark: SparkSession,
    model_path: str,
    data_dir: str,
    output_dir: str,
    name: str,
    split: str = "val",
    top_k: int = extractor.TOP_K,
    strip: bool = False,
    rows: int | None = None,
) -> str:
    """Extractive summaries of a corpus by a saved classifier; the path written."""
    articles = load(spark, data_dir, name, split, rows)
    path = corpus.corpus_path(output_dir, name, split)
    found = extractor.extractive_summaries(extractor.load(spark, model_path), articles, top_k, strip)
    found.write.mode("overwrite").json(path)
    return path
