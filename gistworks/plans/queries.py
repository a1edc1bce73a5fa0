"""One registered query per operator: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistworks.functions import text, vectors
from gistworks.operators import boundaries, extract, extractor, inputs, labels, lexrank, metrics, observed, sampling, sketches, stats, subwords
from gistworks.plans import views
from gistworks.session import checkpoint_folder, checkpointed
from gistworks.sources import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- greedy ROUGE extraction ------------------------------------------------


@query
def rouge_pseudo_summary(spark, sf_dir):
    return extract.pseudo_summaries(views.cited_articles(spark, sf_dir)).select("id", "article", "lay_summary")


@query
def rouge_selected(spark, sf_dir):
    return extract.selected_sentences(views.cited_articles(spark, sf_dir))


@query
def rougeL_sentence_scores(spark, sf_dir):
    return extract.sentence_scores(views.cited_articles(spark, sf_dir))


@query
def rouge_rank(spark, sf_dir):
    return extract.ranked_sentences(views.cited_articles(spark, sf_dir))


@query
def rouge_topk(spark, sf_dir):
    return extract.ranked_sentences(views.cited_articles(spark, sf_dir), extract.DEFAULT_SENTENCES)


@query
def rougeL_pair_scores(spark, sf_dir):
    return extract.pair_scores(views.cited_articles(spark, sf_dir))


@query
def best_match(spark, sf_dir):
    return extract.best_matches(views.cited_articles(spark, sf_dir))


# --- cleaning and splitting -------------------------------------------------


def _article_column(name, expression):
    """A query that applies one text expression to every cited article."""

    def run(spark, sf_dir):
        return views.cited_articles(spark, sf_dir).select("id", expression(F.col("article")).alias("article"))

    run.__name__ = name
    QUERIES[name] = run


_article_column("clean_et_al", text.drop_stop_after_et_al)
_article_column("clean_whitespace", text.collapse_whitespace)
_article_column("clean_stop_space", text.space_after_stop)
_article_column("strip_author_year", text.strip_author_year)
_article_column("strip_bracket_single", text.strip_bracket_single)
_article_column("strip_bracket_list", text.strip_bracket_list)
_article_column("preprocess", text.clean)
_article_column("remove_abstract", text.drop_first_line)


@query
def sentences(spark, sf_dir):
    split = text.split_sentences(text.clean(F.col("article")))
    return views.cited_articles(spark, sf_dir).select("id", F.posexplode(split).alias("sent_idx", "sentence"))


@query
def sentence_abbreviations(spark, sf_dir):
    return boundaries.train(views.cited_articles(spark, sf_dir)).abbreviations.select("type", F.round("score", 6).alias("score"))


@query
def sentence_starters(spark, sf_dir):
    return boundaries.train(views.cited_articles(spark, sf_dir)).starters


@query
def sentences_trained(spark, sf_dir):
    articles = views.cited_articles(spark, sf_dir).select("id", "article")
    found = boundaries.sentences(articles, boundaries.train(articles))
    return found.select("id", F.posexplode("sentences").alias("sent_idx", "sentence"))


@query
def naive_sentences(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.posexplode(text.split_naive(F.col("text"))).alias("sent_idx", "sentence")
    )


@query
def rouge_tokens(spark, sf_dir):
    articles = views.articles(spark, sf_dir)
    sides = [
        articles.select("id", F.lit(side).alias("side"), F.posexplode(text.word_tokens(F.col(side))).alias("pos", "token"))
        for side in ("article", "lay_summary")
    ]
    return sides[0].unionByName(sides[1])


@query
def char_lengths(spark, sf_dir):
    return stats.char_lengths(views.articles(spark, sf_dir))


@query
def headings_joined(spark, sf_dir):
    return views.articles(spark, sf_dir).select(
        "id", F.array_join("headings", ", ").alias("headings"), F.array_join("keywords", ", ").alias("keywords")
    )


@query
def prompt_build(spark, sf_dir):
    df = views.articles(spark, sf_dir).select("id", text.prompt(F.col("article")).alias("prompt"), "lay_summary")
    completed = F.concat("prompt", "lay_summary")
    return df.select("id", "prompt", text.after_marker(completed).alias("completion"))


# --- sources and sinks ------------------------------------------------------


def _scratch(spark) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/gistworks-{uuid.uuid4().hex}"


def _as_corpus(df):
    return df.select(F.col("id").cast("string").alias("id"), "article", "lay_summary", "headings", "keywords")


@query
def jsonl_roundtrip(spark, sf_dir):
    path = corpus.corpus_path(_scratch(spark), "documents", "train")
    corpus.write_articles(_as_corpus(views.articles(spark, sf_dir)), path)
    return corpus.read_articles(spark, path).select(
        "id", "article", "lay_summary", F.array_join("headings", "|").alias("headings"), F.array_join("keywords", "|").alias("keywords")
    )


@query
def multi_source_union(spark, sf_dir):
    folder = _scratch(spark)
    corpus.write_articles(_as_corpus(views.articles(spark, sf_dir)), corpus.corpus_path(folder, "documents", "train"))
    corpus.write_articles(views.dialogue_pairs(spark, sf_dir), corpus.corpus_path(folder, "dialogues", "val"))
    return corpus.read_corpora(spark, folder).select("id", "corpus", "split", "article", "lay_summary")


@query
def csv_roundtrip(spark, sf_dir):
    path = _scratch(spark)
    labelled = views.labelled_texts(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"), F.lit(0).alias("sent_idx"), "sentence", "label"
    )
    corpus.write_sentences(labelled, path)
    return corpus.read_sentences(spark, path, multi_line=True)  # whole documents hold newlines


@query
def scan_limit(spark, sf_dir):
    return corpus.first_rows(views.articles(spark, sf_dir), 10).select("id", "article", "lay_summary")


@query
def point_lookup(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").where("doc_id = 7")
    return docs.select(F.col("doc_id").alias("id"), text.first_line(F.col("text")).alias("lay_summary"))


#: What is done to the lines of some articles, by the remainder of their id.
DAMAGE = {1: "cut short", 3: "another type", 4: "no object"}


@query
def quarantine(spark, sf_dir):
    """Articles with planted damage as whole rows and as damaged lines, told by where they ended."""
    folder = _scratch(spark)
    articles = _as_corpus(views.articles(spark, sf_dir)).select("id", "article", "lay_summary")
    kind = F.pmod(F.col("id").cast("long"), F.lit(7))
    line = F.to_json(F.struct("id", "article", "lay_summary"), {"ignoreNullFields": "false"})
    broken = F.when(kind == 1, F.substring(line, 1, 12)).when(kind == 3, F.replace(line, F.lit('"id":"'), F.lit('"headings":"x","id":"'))).when(kind == 4, F.concat(F.lit("# "), "id")).otherwise(line)
    articles.select(broken.alias("value")).write.text(f"{folder}/raw")
    counted = corpus.quarantine_articles(spark, f"{folder}/raw", f"{folder}/good", f"{folder}/bad")
    good = spark.read.parquet(f"{folder}/good").select(F.lit("good").alias("part"), "id", F.length("article").alias("size"))
    bad = spark.read.parquet(f"{folder}/bad").select(F.lit("bad").alias("part"), F.lit(None).cast("string").alias("id"), F.length("line").alias("size"))
    return good.unionByName(bad).withColumns({"all_good": F.lit(counted["good"]).cast("long"), "all_bad": F.lit(counted["bad"]).cast("long")})


@query
def partitioned_corpus(spark, sf_dir):
    """Articles and dialogues as one partitioned table, one split of it written anew, and that corpus read back."""
    path = f"{_scratch(spark)}/table"
    articles = inputs.with_split(_as_corpus(views.articles(spark, sf_dir)).withColumn("corpus", F.lit("documents")))
    dialogues = views.dialogue_pairs(spark, sf_dir).withColumns({"corpus": F.lit("dialogues"), "split": F.lit("val")})
    corpus.write_partitions(corpus.union_all([articles, dialogues]), path)
    corpus.write_partitions(articles.where("split = 'val'").withColumn("lay_summary", F.concat(F.lit("again "), "lay_summary")), path)
    read = [corpus.read_partitions(spark, path, "documents"), corpus.read_partitions(spark, path, "dialogues", "val")]
    return read[0].unionByName(read[1]).select("id", "corpus", "split", "article", "lay_summary")


# --- labelling --------------------------------------------------------------


def _pseudo(spark, sf_dir):
    return extract.pseudo_summaries(views.cited_articles(spark, sf_dir).select("id", "article", "lay_summary"))


def _joined(spark, sf_dir):
    return labels.join_originals(_pseudo(spark, sf_dir), views.cited_articles(spark, sf_dir))


@query
def label_report(spark, sf_dir):
    """Counts and consistency of the labelling, gathered while the labels were written."""
    labelled, watch = observed.labelled_with_report(_joined(spark, sf_dir))
    corpus.write_sentences(labelled, _scratch(spark))
    names = ["articles", "article_sentences", "pseudo_sentences", "class_1", "missing_sentences", "inconsistent_articles", "longest"]
    return spark.createDataFrame([tuple(watch.get[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query
def pseudo_article_join(spark, sf_dir):
    return _joined(spark, sf_dir)


def _labelled(spark, sf_dir):
    return labels.labelled(views.cited_articles(spark, sf_dir).select("id", "article", "lay_summary"))


@query
def binary_labels(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query
def consistency_check(spark, sf_dir):
    # Against the articles without their added citations, so that some are missing.
    return labels.missing_sentences(labels.join_originals(_pseudo(spark, sf_dir), views.articles(spark, sf_dir)))


@query
def sentence_counts(spark, sf_dir):
    return labels.sentence_counts(_joined(spark, sf_dir))


@query
def label_counts(spark, sf_dir):
    return labels.label_counts(_labelled(spark, sf_dir))


@query
def class_encode(spark, sf_dir):
    vectors_ = views.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") * 3).cast("string").alias("label"))
    return labels.class_encode(vectors_).select("vec_id", "label", "class_id")


# --- samples and splits -----------------------------------------------------


@query
def head_fraction(spark, sf_dir):
    return sampling.first_fraction(views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars"))


@query
def sample_n(spark, sf_dir):
    return sampling.sample_rows(views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars"), 100)


@query
def balance_classes(spark, sf_dir):
    return sampling.balance_classes(views.quality_labels(spark, sf_dir).select("id", (1 - F.col("label")).alias("label")), ["id"])


@query
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(views.quality_labels(spark, sf_dir).select("id", "label"), ["id"])


@query
def train_eval_split(spark, sf_dir):
    return sampling.train_eval_split(views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


# --- corpus statistics ------------------------------------------------------


@query
def keyword_counts(spark, sf_dir):
    return stats.keyword_counts(views.articles(spark, sf_dir))


@query
def token_lengths(spark, sf_dir):
    return stats.token_lengths(views.articles(spark, sf_dir), "article")


@query
def avg_token_length(spark, sf_dir):
    return stats.average_length(views.articles(spark, sf_dir), "article")


@query
def length_histogram(spark, sf_dir):
    return stats.histogram(stats.token_lengths(views.articles(spark, sf_dir), "lay_summary"), "tokens")


@query
def article_length_histogram(spark, sf_dir):
    return stats.histogram(stats.token_lengths(views.articles(spark, sf_dir), "article"), "tokens")


@query
def sentence_score_histogram(spark, sf_dir):
    return stats.histogram(extract.sentence_scores(views.cited_articles(spark, sf_dir)), "score")


@query
def summary_length_quantiles(spark, sf_dir):
    points = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    return stats.sentence_quantiles(views.articles(spark, sf_dir), "lay_summary", points)


def _lengths():
    return {"tokens": text.count_words(text.normalise_words(F.col("article"))), "summary_sentences": F.size(text.split_sentences(F.col("lay_summary")))}


@query
def length_sketches(spark, sf_dir):
    """Quantiles of lengths from sketches per language and split, kept in a table, added to and merged; each with the verdict on its rank error."""
    path = _scratch(spark)
    articles = inputs.with_split(views.articles(spark, sf_dir)).withColumn("lang", F.get("keywords", F.lit(0)))
    for split in ("train", "val"):  # the second addition does not read the first one's texts
        sketches.sketched(articles.where(F.col("split") == split), ["lang", "split"], **_lengths()).write.mode("append").parquet(path)
    answers = sketches.quantiles(sketches.merged(spark.read.parquet(path)), [0.25, 0.5, 0.75, 0.9])
    checked = sketches.rank_errors(answers, articles, **_lengths())
    return checked.select("measure", "n", "point", (F.col("error") <= sketches.RANK_ERROR).alias("within"))


@query
def corpus_stats(spark, sf_dir):
    scored = metrics.with_readability(views.articles(spark, sf_dir), "article")
    return stats.corpus_stats(
        scored,
        {
            "avg_article_chars": F.length("article"),
            "avg_article_tokens": text.count_words(text.normalise_words(F.col("article"))),
            "avg_summary_tokens": text.count_words(text.normalise_words(F.col("lay_summary"))),
            "avg_article_sentences": F.size(text.split_sentences(F.col("article"))),
            "avg_reading_ease": F.col("flesch_kincaid_reading_score"),
        },
    )


# --- evaluation -------------------------------------------------------------

PAIR_KEYS = ["id", "system"]


@query
def rouge1(spark, sf_dir):
    return metrics.rouge_scores(views.candidates(spark, sf_dir), PAIR_KEYS, "1")


@query
def rouge2(spark, sf_dir):
    return metrics.rouge_scores(views.candidates(spark, sf_dir), PAIR_KEYS, "2")


@query
def rougeL(spark, sf_dir):
    return metrics.rouge_scores(views.candidates(spark, sf_dir), PAIR_KEYS, "L")


@query
def rouge2_macro(spark, sf_dir):
    return metrics.rouge_macro(views.extractive_candidates(spark, sf_dir))


@query
def rouge_report(spark, sf_dir):
    return metrics.rouge_report(views.dialogue_candidates(spark, sf_dir), ["system"])


@query
def rouge_by_system(spark, sf_dir):
    return metrics.rouge_report(views.candidates(spark, sf_dir), ["system"])


@query
def exact_match(spark, sf_dir):
    return metrics.exact_match(views.candidates(spark, sf_dir))


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_counts(views.quality_labels(spark, sf_dir))


@query
def binary_metrics(spark, sf_dir):
    return metrics.binary_metrics(views.quality_labels(spark, sf_dir))


@query
def readability(spark, sf_dir):
    return metrics.with_readability(views.articles(spark, sf_dir).select("id", "article"), "article").drop("article")


@query
def readability_guarded(spark, sf_dir):
    lay = views.articles(spark, sf_dir).select("id", F.lit("lay_summary").alias("system"), F.col("lay_summary").alias("candidate"))
    systems = lay.unionByName(views.candidates(spark, sf_dir).select("id", "system", "candidate"))
    return metrics.guarded_readability(systems, "candidate").drop("candidate")


@query
def readability_macro(spark, sf_dir):
    return metrics.readability_macro(views.candidates(spark, sf_dir), "candidate", ["system"])


# --- vectors, thresholds and model inputs -----------------------------------


@query
def softmax_probs(spark, sf_dir):
    df = views.table(spark, sf_dir, "embeddings")
    probs = F.posexplode(vectors.softmax(F.col("embedding"))).alias("class_id", "p")
    return df.select("vec_id", probs).withColumn("p", F.round("p", 6))


@query
def argmax_label(spark, sf_dir):
    return views.table(spark, sf_dir, "embeddings").select("vec_id", vectors.argmax(F.col("embedding")).alias("class_id"))


@query
def threshold_topk(spark, sf_dir):
    return extractor.top_sentences(extractor.with_probability(views.sentence_logits(spark, sf_dir)))


def _vocabulary(spark, sf_dir):
    return inputs.vocabulary(views.articles(spark, sf_dir), ["article", "lay_summary"])


@query
def model_inputs(spark, sf_dir):
    articles = inputs.with_split(views.articles(spark, sf_dir))
    batch = inputs.model_inputs(articles, _vocabulary(spark, sf_dir), ["id", "split"])
    arrays = ["input_ids", "attention_mask", "global_attention_mask", "labels"]
    return batch.select("id", "split", *(F.array_join(c, " ").alias(c) for c in arrays))


def _labels(spark, sf_dir, vocab):
    return inputs.label_inputs(views.articles(spark, sf_dir), vocab, ["id"])


@query
def label_mask(spark, sf_dir):
    labels_ = _labels(spark, sf_dir, _vocabulary(spark, sf_dir))
    return labels_.select("id", F.posexplode("labels").alias("pos", "label"))


@query
def decode_labels(spark, sf_dir):
    vocab = _vocabulary(spark, sf_dir)
    return inputs.decoded(_labels(spark, sf_dir, vocab), vocab, ["id"])


def subword_file() -> str:
    """The public vocabulary the subword queries use; the operators take its path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def subword_roundtrip(spark, sf_dir):
    """All subword ids of every article and lay summary, decoded again."""
    sides = ["article", "lay_summary"]
    ids = subwords.encoded(views.articles(spark, sf_dir), subword_file(), ["id"], dict.fromkeys(sides, 1 << 30))
    back = [subwords.decoded(ids, subword_file(), ["id"], f"{side}_ids").select("id", F.lit(side).alias("side"), "text") for side in sides]
    return back[0].unionByName(back[1])


# --- LexRank ----------------------------------------------------------------


@query
def lexrank_tf(spark, sf_dir):
    return lexrank.term_frequencies(views.articles(spark, sf_dir)).withColumn("tf", F.round("tf", 6))


@query
def lexrank_idf(spark, sf_dir):
    return lexrank.inverse_frequencies(views.articles(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


def _joined_sentences(pairs, a, b):
    """Pairs of nodes with the sentences of each as one text."""
    return pairs.withColumns({f"sents_{end}": F.array_join(f"sents_{end}", " ") for end in (a, b)})


@query
def lexrank_similarity(spark, sf_dir):
    pairs = lexrank.similar_sentences(views.articles(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))
    return _joined_sentences(pairs, "i", "j").select("id", "j", "i", "m_i", "m_j", "similarity", "sents_i", "sents_j")


@query
def lexrank_edges(spark, sf_dir):
    edges = lexrank.edges(views.articles(spark, sf_dir)).withColumn("share", F.round("share", 6))
    return _joined_sentences(edges, "src", "dst").select("id", "dst", "src", "degree", "share", "sents_src", "sents_dst")


def _scores(ranked):
    """(id, sent_idx, score) of ranked articles."""
    return ranked.select("id", F.posexplode("_scores").alias("sent_idx", "score")).withColumn("score", F.round("score", 6))


@query
def lexrank_scores(spark, sf_dir):
    return _scores(lexrank.ranked(views.articles(spark, sf_dir)))


@query
def lexrank_summary(spark, sf_dir):
    return lexrank.summaries(views.articles(spark, sf_dir).select("id", "article", "lay_summary"))


@query
def lexrank_batch(spark, sf_dir):
    lists = lexrank.sentence_lists(views.articles(spark, sf_dir).select("id", "article"), 130, ())
    return lists.select("id", F.posexplode("_summary").alias("pos", "sentence"))


@query
def lexrank_background(spark, sf_dir):
    articles = views.articles(spark, sf_dir)
    lists = lexrank.background_summaries(articles.select("id", "article"), articles, "lay_summary")
    return lists.select("id", F.posexplode("_summary").alias("pos", "sentence"))


@query
def lexrank_continuous(spark, sf_dir):
    articles = views.articles(spark, sf_dir)
    return _scores(lexrank.background_ranked(articles, articles, "lay_summary", None))


# --- sentence classifier ----------------------------------------------------


def _split_labels(spark, sf_dir):
    """The balanced sentence labels with their split."""
    labelled = checkpointed(_labelled(spark, sf_dir))
    balanced = checkpointed(sampling.balance_classes(labelled, ["id", "sent_idx"]))
    return checkpointed(sampling.stratified_split(balanced, ["id", "sent_idx"]))


_SAVED: dict[tuple[str, str], str] = {}


def _model(spark, sf_dir):
    """The classifier of these tables: trained and saved once a session, then loaded."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SAVED:
        path = _scratch(spark)
        extractor.save(extractor.train(_split_labels(spark, sf_dir))[0], path)
        _SAVED[key] = path
    return extractor.load(spark, _SAVED[key])


@query
def extractor_train(spark, sf_dir):
    split = _split_labels(spark, sf_dir)
    model, _ = extractor.train(split)
    tested = extractor.predictions(model, split.where("split = 'test'"))
    return metrics.binary_metrics(tested).withColumns({"kind": F.lit(model.kind), "parameter": F.lit(model.parameter)})


@query
def extractor_candidates(spark, sf_dir):
    _, tried = extractor.train(_split_labels(spark, sf_dir))
    return tried.withColumn("accuracy", F.round("accuracy", 6))


@query
def extractive_summary(spark, sf_dir):
    return extractor.extractive_summaries(_model(spark, sf_dir), views.cited_articles(spark, sf_dir))


@query
def extractive_summary_clean(spark, sf_dir):
    return extractor.extractive_summaries(_model(spark, sf_dir), views.cited_articles(spark, sf_dir), top_k=10, strip=True)
