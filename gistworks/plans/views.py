"""The corpus views the registered queries run on, all read from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistworks.functions import text
from gistworks.functions.frames import spread
from gistworks.operators import extract, lexrank

# No document holds a citation, so the cleaning queries add some.
CITATIONS = " As Smith et al., 2004 and (Jones and Brown, 1999, p. 12) say [1], [2,3], [4-6]."
BROKEN_STOPS = " Smith et al . 2004 end.Next"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (id, article, lay_summary, headings, keywords)."""
    body = F.col("text")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        F.col("doc_id").alias("id"),
        text.drop_first_line(body).alias("article"),
        text.first_line(body).alias("lay_summary"),
        F.transform(F.split(body, "\n"), lambda line: F.substring_index(line, " ", 1)).alias("headings"),
        F.array("lang", "source").alias("keywords"),
    )


def cited_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("id") % 4 == 0, BROKEN_STOPS).otherwise("")
    return articles(spark, sf_dir).withColumn("article", F.concat("article", F.lit(CITATIONS), broken))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, pred): two-class labels and predictions."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.col("toxic").alias("pred")
    )


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sentence, label): labelled documents as one text each."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("sentence"))
    return docs.join(quality_labels(spark, sf_dir).select("id", "label"), "id")


def dialogue_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, article, lay_summary): each user turn and the assistant turn after it."""
    turns = table(spark, sf_dir, "conversations")
    users = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("article"))
    replies = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("lay_summary")
    )
    return users.join(replies, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "article", "lay_summary"
    )


def _pairs(df: DataFrame, system: str, candidate) -> DataFrame:
    return df.select("id", F.lit(system).alias("system"), candidate.alias("candidate"), F.col("lay_summary").alias("target"))


def lexrank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The LexRank summaries against the lay summaries."""
    summaries = lexrank.summaries(articles(spark, sf_dir).select("id", "article", "lay_summary"))
    return _pairs(summaries, "lexrank", F.col("article"))


def extractive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = extract.pseudo_summaries(cited_articles(spark, sf_dir).select("id", "article", "lay_summary"))
    return _pairs(summaries, "extractive", F.col("article"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extractive_candidates(spark, sf_dir).unionByName(lexrank_candidates(spark, sf_dir))


def dialogue_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems over dialogues: the question, and the reply itself."""
    pairs = dialogue_pairs(spark, sf_dir)
    return _pairs(pairs, "question", F.col("article")).unionByName(_pairs(pairs, "reply", F.col("lay_summary")))


def sentence_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sent_idx, sentence, logits): logits (0, k), k in quarter steps from
    -2 to 1.75 by a hash of the position."""
    split = F.posexplode(text.split_sentences(text.clean(F.col("article")))).alias("sent_idx", "sentence")
    step = F.conv(F.substring(F.md5(F.concat_ws("-", "id", "sent_idx")), 1, 1), 16, 10).cast("int")
    return cited_articles(spark, sf_dir).select("id", split).withColumn(
        "logits", F.array(F.lit(0.0), step / F.lit(4.0) - 2.0)
    )
