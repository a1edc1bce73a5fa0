"""Fixed-length model inputs from a word vocabulary built by a Spark job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistworks.functions import lookup, vectors
from gistworks.functions.frames import with_computed
from gistworks.session import checkpointed

# Special ids.
PAD, UNKNOWN, FIRST_WORD = 0, 1, 2
MAX_INPUT, MAX_OUTPUT = 512, 128

#: Words of a vocabulary, the most frequent ones, that every task holds; the others are joined.
LISTED = 50_000


def vocabulary(df: DataFrame, columns: list[str], size: int | None = None) -> DataFrame:
    """(token, token_id) of all words, ids from 2, the most frequent first; of
    the ``size`` most frequent only if given, the others being unknown.

    A word's rank is the number of more frequent ones, of those as frequent with
    a smaller beginning, and its place among the rest: sums of counts of counts,
    so that no task ranks the whole vocabulary. Counts and ids are written, so
    that the texts are read once.
    """
    counts = df.select(*columns).mapInArrow(lookup.word_counts, "token string, n long")
    found = checkpointed(counts.groupBy("token").agg(F.sum("n").alias("n")))
    found = found.withColumn("head", F.substring("token", 1, 2))
    heads = found.groupBy("n", "head").agg(F.count("*").alias("m"))
    counts = heads.groupBy("n").agg(F.sum("m").alias("m"))
    earlier = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("n", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("n").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("n", "head", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("offset")).join(counts, "n")
    nth = F.row_number().over(Window.partitionBy("n", "head").orderBy("token"))
    ranked = found.withColumn("nth", nth).join(heads, ["n", "head"]).withColumn("rank", F.col("base") + F.col("offset") + F.col("nth"))
    if size is not None:
        ranked = ranked.where(F.col("rank") <= size)
    return checkpointed(ranked.select("token", (F.col("rank") + (FIRST_WORD - 1)).cast("int").alias("token_id")))


def _listed(vocab: DataFrame) -> tuple[dict[str, int], DataFrame | None]:
    """The ids of the LISTED most frequent words, and the table of the others, None if there are none."""
    among = F.col("token_id") < FIRST_WORD + LISTED
    others = vocab.where(~among)
    return {r.token: r.token_id for r in vocab.where(among).collect()}, None if others.isEmpty() else others


def _filled(rows: DataFrame, others: DataFrame | None, keys: list[str], on: str, value: str, parts: int) -> DataFrame:
    """(keys, slots) of rows (keys, _row, slots, rare): the slots of rare entries
    take the ``value`` that the ``others`` have for them.

    The rows are written once. Those without rare entries are done; of the rest,
    rows equal in keys and ``_row`` travel as one, which is repeated as often as
    it was counted, and meet their entries in a group bounded by their slots.
    """
    if others is None:
        return rows.select(*keys, "slots")
    rows = checkpointed(rows)
    rest = rows.where(F.size("rare") > 0).select(*keys, "_row", "slots", "rare")
    entries = rest.select(*keys, "_row", F.inline("rare")).join(others, on)
    hits = entries.select(*keys, "_row", F.struct("place", value).alias("hit"))
    found = rest.drop("rare").unionByName(hits, allowMissingColumns=True).groupBy(*keys, "_row").agg(
        F.first("slots", ignorenulls=True).alias("slots"),
        F.count("slots").alias("_copies"),
        F.collect_set("hit").alias("hits"),
    )
    held = with_computed(found, _hits=F.map_from_entries("hits"))
    place = lambda part, pos: (pos * parts + part).cast("long")
    slots = F.transform(
        "slots",
        lambda slot, part: F.transform(slot, lambda x, pos: F.coalesce(x, F.try_element_at("_hits", place(part, pos)))),
    )
    done = rows.where(F.size("rare") == 0).select(*keys, "slots")
    return done.unionByName(_repeated(held.select(*keys, slots.alias("slots"), "_copies")))


def encoded(df: DataFrame, vocab: DataFrame, keys: list[str], columns: dict[str, int]) -> DataFrame:
    """(keys, {column}_ids): the ids of the first words of each column, at most
    the given number, a row for each row.

    Only the words that are kept are looked up: frequent ones in the row, the
    others by a join.
    """
    known, others = _listed(vocab)
    cut = lookup.ids_of_words(known, list(columns.values()), others is not None)(*columns)
    rows = df.select(*keys, F.xxhash64(*columns).alias("_row"), cut.alias("_cut")).select(*keys, "_row", "_cut.*")
    filled = _filled(rows, others, keys, "token", "token_id", len(columns))
    ids = lambda k: F.transform(F.get("slots", F.lit(k)), lambda x: F.coalesce(x, F.lit(UNKNOWN)))
    return filled.select(*keys, *(ids(k).alias(f"{c}_ids") for k, c in enumerate(columns)))


def _repeated(counted: DataFrame) -> DataFrame:
    """Every row as often as ``_copies`` says."""
    kept = [c for c in counted.columns if c != "_copies"]
    return counted.select(*kept, F.explode(F.sequence(F.lit(1), "_copies"))).drop("col")


def model_inputs(
    df: DataFrame,
    vocab: DataFrame,
    keys: list[str],
    max_input: int = MAX_INPUT,
    max_output: int = MAX_OUTPUT,
) -> DataFrame:
    """(keys, input_ids, attention_mask, global_attention_mask, labels) of each
    row, all arrays of fixed length; padded labels are -100."""
    ids = encoded(df, vocab, keys, {"article": max_input, "lay_summary": max_output})
    return ids.select(
        *keys,
        vectors.pad_to(F.col("article_ids"), max_input, PAD).alias("input_ids"),
        vectors.attention_mask(F.col("article_ids"), max_input).alias("attention_mask"),
        vectors.global_attention_mask(max_input).alias("global_attention_mask"),
        _masked(max_output).alias("labels"),
    )


def _masked(length: int) -> Column:
    return vectors.mask_labels(vectors.pad_to(F.col("lay_summary_ids"), length, PAD), PAD)


def label_inputs(df: DataFrame, vocab: DataFrame, keys: list[str], max_output: int = MAX_OUTPUT) -> DataFrame:
    """(keys, labels) as ``model_inputs`` has them; no article is encoded."""
    return encoded(df, vocab, keys, {"lay_summary": max_output}).select(*keys, _masked(max_output).alias("labels"))


def decoded(df: DataFrame, vocab: DataFrame, keys: list[str], column: str = "labels") -> DataFrame:
    """(keys, text) of each row: ids back to words joined by a blank; masked
    positions and special ids are skipped."""
    known, others = _listed(vocab)
    words = lookup.words_of_ids({i: w for w, i in known.items()}, others is not None, FIRST_WORD + LISTED)
    cut = words(vectors.unmask_labels(F.col(column), PAD))
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.xxhash64(column).alias("_row"), cut.alias("_cut"))
    filled = _filled(rows.select(*keys, "_row", "_cut.*"), others, keys, "token_id", "token", 1)
    return filled.select(*keys, F.array_join(F.get("slots", F.lit(0)), " ").alias("text"))


def with_split(df: DataFrame, key: str = "id") -> DataFrame:
    """Adds ``split``: about four fifths ``train``, the rest ``val``, by a hash
    of the key."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int") % 5
    return df.withColumn("split", F.when(bucket == 0, "val").otherwise("train"))
