"""LexRank over a whole corpus.

Sentences of a document with the same words are one *node* with a multiplicity:
they have the same neighbours and the same score, and a line repeated a thousand
times makes no pair. An article of up to CELL different sentences is ranked in its
row: column expressions split it into words, ``functions/graphs.py`` compares its
sentences, and nothing is shuffled. A longer one is dealt out in parts, each with
the words of the whole article: a task compares the sentences of its part with all
others, and only a sum for each sentence, or the pairs asked for, come back. Its
term figures, and the graph of a background corpus, are spread over tasks by joins and grouped sums: documents
are keyed by their text, sentences are grouped by (document, bag of words), terms
by (document, term), the graph by (document, node), and windows only go over one
sentence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistworks.functions import graphs, text
from gistworks.functions.frames import with_computed
from gistworks.functions.stopwords import ENGLISH
from gistworks.operators.documents import digest, with_document_key
from gistworks.session import checkpointed

DEFAULT_SENTENCES = 25
THRESHOLD = 0.1
TOLERANCE = 0.1
PLACES = 9

#: Different sentences of a document that is ranked in its row; a longer one is cut into parts or blocks of so many.
CELL = 4096

#: Words of a background corpus, the most frequent ones, whose weights every task holds; the others are joined.
LISTED = 50_000


def nodes(articles: DataFrame, sentences: Column, words) -> DataFrame:
    """(doc, n, bag, node, m, sents, words): of each different document with
    ``n`` sentences the different bags of words; ``node`` is the first sentence,
    ``m`` the number of sentences with the bag. Copies of a document hold the
    same sentences at the same places and fall together."""
    split = with_document_key(articles).select("doc", sentences.alias("s"))
    split = split.select("doc", F.size("s").alias("n"), F.posexplode("s").alias("idx", "sentence"))
    bags = split.select("doc", "n", "idx", F.sort_array(words(F.col("sentence"))).alias("words"))
    grouped = bags.withColumn("bag", digest(F.array_join("words", " "))).groupBy("doc", "n", "bag").agg(
        F.sort_array(F.collect_set("idx")).alias("sents"), F.any_value("words").alias("words")
    )
    return grouped.select("doc", "n", "bag", F.get("sents", 0).alias("node"), F.size("sents").alias("m"), "sents", "words")


def term_counts(node_table: DataFrame) -> DataFrame:
    """(doc, n, bag, node, m, term, count); stays in the partitions of the nodes."""
    keys = ["doc", "n", "bag", "node", "m"]
    return node_table.select(*keys, F.explode("words").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("count"))


def with_holding(counts: DataFrame) -> DataFrame:
    """Adds ``holding``, the nodes with the term, and ``sentences``, the
    sentences with it. The rows of a term in a document, at most one for each
    sentence, are counted and handed on in one grouping, up to CELL sentences;
    those of a longer document are counted and joined to their counts."""
    rest = [c for c in counts.columns if c not in ("doc", "term")]
    figures = [F.count("*").alias("holding"), F.sum("m").alias("sentences")]
    short, long = counts.where(F.col("n") <= CELL), counts.where(F.col("n") > CELL)
    grouped = short.groupBy("doc", "term").agg(*figures, F.collect_list(F.struct(*rest)).alias("rows"))
    joined = long.join(long.groupBy("doc", "term").agg(*figures), ["doc", "term"])
    return grouped.select("doc", "term", "holding", "sentences", F.inline("rows")).unionByName(joined)


def frequencies(counts: DataFrame) -> DataFrame:
    """Adds ``tf``, the count over the largest of the sentence, and ``idf``,
    ln(n / (1 + sentences with the term))."""
    top = F.max("count").over(Window.partitionBy("doc", "n", "bag"))
    return with_holding(counts.withColumn("tf", F.col("count") / top).drop("bag", "count")).withColumn(
        "idf", F.log(F.col("n") / (1 + F.col("sentences")))
    )


def unit_weights(weighted: DataFrame) -> DataFrame:
    """(doc, n, node, m, term, w, holding): weights over the norm of their
    node; nodes of norm 0 have no row."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc", "node")))
    return (
        weighted.withColumn("norm", norm)
        .where("norm > 0 and w != 0")
        .select("doc", "n", "node", "m", "term", (F.col("w") / F.col("norm")).alias("w"), "holding")
    )


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Products of the weights of two nodes i < j at each shared term."""
    a = left.select("doc", "term", "n", F.col("node").alias("i"), F.col("m").alias("m_i"), F.col("w").alias("w_i"))
    b = right.select("doc", "term", "n", F.col("node").alias("j"), F.col("m").alias("m_j"), F.col("w").alias("w_j"))
    short, long = F.col("n") <= CELL, F.col("n") > CELL
    together = a.where(short).drop("n").join(b.where(short).drop("n"), ["doc", "term"]).where("i < j")
    # a block of nodes meets its own and each later one of the same term in a task of its own
    block = lambda c: F.floor(F.col(c) / CELL)
    last = F.floor((F.col("n") - 1) / CELL)
    upper = a.where(long).select("*", block("i").alias("p"), F.explode(F.sequence(block("i"), last)).alias("q")).drop("n")
    lower = b.where(long).select("*", F.explode(F.sequence(F.lit(0).cast("long"), block("j"))).alias("p"), block("j").alias("q")).drop("n")
    return together.unionByName(upper.join(lower, ["doc", "term", "p", "q"]).where("i < j").drop("p", "q"))


def similarities(weights: DataFrame, threshold: float = THRESHOLD, inclusive: bool = False) -> DataFrame:
    """(doc, i, j, m_i, m_j, similarity) of node pairs i < j above the threshold.

    The products of all terms that two nodes share are summed up, combined before
    they travel. A threshold this low leaves nothing to skip: a prefix filter
    finds half as many candidates as there are products, and each has then to be
    looked up term by term.
    """
    shared = weights.where("holding > 1")
    summed = _pairs(shared, shared).groupBy("doc", "i", "j", "m_i", "m_j").agg(
        F.round(F.sum(F.col("w_i") * F.col("w_j")), PLACES).alias("similarity")
    )
    return summed.where(F.col("similarity") >= threshold if inclusive else F.col("similarity") > threshold)


def transitions(weights: DataFrame, similar: DataFrame) -> DataFrame:
    """(doc, src, dst, degree, share): the graph in both directions and with
    itself. ``degree`` counts the sentences next to a sentence of ``src``;
    ``share`` is the weight of all sentences of ``src`` at one of ``dst``."""
    ends = [("i", "j"), ("j", "i")]
    both = F.array(
        *(F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(f"m_{a}").alias("m"), F.col(f"m_{b}").alias("m_dst")) for a, b in ends)
    )
    linked = similar.select("doc", F.explode(both).alias("e")).select("doc", "e.*")
    own = weights.select("doc", F.col("node").alias("src"), F.col("node").alias("dst"), "m", F.col("m").alias("m_dst")).distinct()
    edges = linked.unionByName(own)
    degrees = edges.groupBy("doc", "src").agg(F.sum("m_dst").alias("degree"))
    return edges.join(degrees, ["doc", "src"]).select(
        "doc", "src", "dst", "degree", (F.col("m") / F.col("degree")).alias("share")
    )


def graph(articles: DataFrame, stop_words) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, unit weights and similar pairs of the standard variant."""
    found = checkpointed(
        nodes(articles, text.split_paragraph_sentences(F.col("article")), lambda s: text.letter_words(s, stop_words))
    )
    weighted = frequencies(term_counts(found)).withColumn("w", F.col("tf") * F.col("idf"))
    weights = checkpointed(unit_weights(weighted))
    return found, weights, similarities(weights)


# --- articles in their rows, and those too long for one ----------------------


def _paragraph_sentences() -> Column:
    return text.split_paragraph_sentences(F.col("article"))


def _letter_words(stop_words):
    return lambda sentence: text.letter_words(sentence, stop_words)


def in_rows(articles: DataFrame, sentences: Column, words) -> DataFrame:
    """The articles with ``_split``, their sentences, and ``_words``, the words
    of each joined by blanks; null in an article of more than CELL different sentences."""
    df = with_computed(articles, _split=sentences)
    df = with_computed(df, _joined=_joined(words))
    few = (F.size("_split") <= CELL) | (F.size(F.array_distinct("_joined")) <= CELL)
    return with_computed(df, _words=F.when(few, F.col("_joined"))).drop("_joined")


def _joined(words) -> Column:
    return F.transform("_split", lambda s: F.array_join(words(s), " "))


def too_long(articles: DataFrame, sentences: Column, words) -> DataFrame | None:
    """The articles of more than CELL different sentences, found in one reading and
    written; None if there are none. Every sentence but the last ends with a stop
    or a line, so that few are split to tell."""
    ends = F.length("article") - F.length(F.translate("article", ".!?\n", ""))
    some = articles.where(F.length("article") >= CELL).where(ends >= CELL)
    rows = in_rows(some, sentences, words).where("_split IS NOT NULL AND _words IS NULL")
    long = checkpointed(rows.select(*articles.columns))
    return None if long.isEmpty() else long


def _texts(long: DataFrame, sentences: Column, words) -> DataFrame:
    """(doc, _words): the different ones of the long articles, each sentence as its words joined by blanks."""
    split = with_computed(with_document_key(long).select("doc", "article"), _split=sentences)
    return checkpointed(split.select("doc", _joined(words).alias("_words")).dropDuplicates(["doc"]))


def _parts(texts: DataFrame) -> DataFrame:
    """The texts once for each part, dealt out: a part has about CELL sentences, or more where that makes more parts than
    there are cores. A task compares the bags of its part with all bags, and no pair of bags is shuffled: what is
    dealt out is the words of a text as often as it has parts."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    counted = texts.withColumn("parts", F.least(F.ceil(F.size("_words") / CELL), F.lit(cores)).cast("int"))
    parts = counted.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return parts.repartition(cores, "doc", "part")


def _power_step(rows: DataFrame) -> DataFrame:
    """(doc, sums, moved): ``graphs.part_sums`` of all parts of a text, put together."""
    step = graphs.part_sums(THRESHOLD)("_words", "part", "parts", "degree", "score")
    parts = with_computed(_parts(rows), _found=step).select("doc", "part", "_found.*")
    placed = F.array_sort(F.collect_list(F.struct("part", "sums")))
    return parts.groupBy("doc").agg(F.flatten(F.transform(placed, lambda p: p["sums"])).alias("sums"), F.sqrt(F.sum("moved")).alias("moved"))


def power_lists(texts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc, _scores), a score for each sentence: power steps from 1/n until the scores of a text move by no more than
    the tolerance (L2). A step finds the similar sentences again, so that the graph, which grows with the square of a
    text, is never written; finished texts leave the loop."""
    none = F.lit(None).cast("array<double>")
    degrees = checkpointed(_power_step(texts.withColumns({"degree": none, "score": none})).select("doc", F.col("sums").alias("degree")))
    weighted = texts.join(degrees, "doc")
    state = weighted.withColumn("score", F.transform("degree", lambda _: 1 / F.size("_words")))
    finished: DataFrame | None = None
    while True:
        stepped = checkpointed(_power_step(state).withColumn("open", F.round("moved", PLACES) > tolerance).drop("moved"))
        done = stepped.where("not open").drop("open")
        finished = done if finished is None else finished.unionByName(done)
        still = stepped.where("open")
        if still.isEmpty():
            return texts.join(finished, "doc").select("doc", graphs.by_sentence("_words", "sums").alias("_scores"))
        state = weighted.join(still.select("doc", F.col("sums").alias("score")), "doc")


def _exploded(rows: DataFrame, found: Column, *columns) -> DataFrame:
    """``columns`` and the fields of the rows that ``found`` makes of a row, made once: Spark filters what it explodes
    by its size, and a function that is exploded as it stands runs for that too."""
    return with_computed(rows, _found=found).select(*columns, F.inline("_found"))


def _rows_and(near: DataFrame, articles: DataFrame, sentences: Column, words, spread) -> DataFrame:
    """``near`` and what ``spread`` makes of the articles that are too long for their rows."""
    long = too_long(articles, sentences, words)
    return near if long is None else near.unionByName(spread(long))


def _by_id(articles: DataFrame, per_document: DataFrame) -> DataFrame:
    """Rows per document as rows per article id."""
    return with_document_key(articles).select("id", "doc").join(per_document, "doc").drop("doc")


def _standard_frequencies(articles: DataFrame, stop_words) -> tuple[DataFrame, DataFrame]:
    found = nodes(articles, _paragraph_sentences(), _letter_words(stop_words))
    return found, frequencies(term_counts(found))


def term_frequencies(articles: DataFrame, stop_words=ENGLISH) -> DataFrame:
    """(id, sent_idx, term, tf) of every sentence."""

    def spread(long: DataFrame) -> DataFrame:
        found, terms = _standard_frequencies(long, stop_words)
        sents = found.select("doc", "node", F.explode("sents").alias("sent_idx"))
        return _by_id(long, sents.join(terms, ["doc", "node"]).select("doc", "sent_idx", "term", "tf"))

    rows = in_rows(articles, _paragraph_sentences(), _letter_words(stop_words))
    near = _exploded(rows, graphs.term_rows("_words"), "id")
    return _rows_and(near, articles, _paragraph_sentences(), _letter_words(stop_words), spread)


def inverse_frequencies(articles: DataFrame, stop_words=ENGLISH) -> DataFrame:
    """(id, term, idf) of every word of every article."""

    def spread(long: DataFrame) -> DataFrame:
        _, terms = _standard_frequencies(long, stop_words)
        return _by_id(long, terms.groupBy("doc", "term").agg(F.any_value("idf").alias("idf")))

    rows = in_rows(articles, _paragraph_sentences(), _letter_words(stop_words))
    counted = _exploded(rows, graphs.document_terms("_words"), "id", F.size("_split").alias("n"))
    near = counted.select("id", "term", F.log(F.col("n") / (1 + F.col("sentences"))).alias("idf"))
    return _rows_and(near, articles, _paragraph_sentences(), _letter_words(stop_words), spread)


def similar_sentences(articles: DataFrame, stop_words=ENGLISH) -> DataFrame:
    """(id, i, j, m_i, m_j, similarity, sents_i, sents_j) of the node pairs of
    every article above the threshold, with the sentences of both."""

    def spread(long: DataFrame) -> DataFrame:
        parts = _parts(_texts(long, _paragraph_sentences(), _letter_words(stop_words)))
        found = "doc binary, i int, j int, m_i int, m_j int, similarity double, sents_i array<int>, sents_j array<int>"
        return _by_id(long, parts.mapInArrow(graphs.part_pairs(THRESHOLD), found))

    rows = in_rows(articles, _paragraph_sentences(), _letter_words(stop_words))
    near = _exploded(rows, graphs.similar_rows(THRESHOLD)("_words"), "id")
    return _rows_and(near, articles, _paragraph_sentences(), _letter_words(stop_words), spread)


def edges(articles: DataFrame, stop_words=ENGLISH) -> DataFrame:
    """(id, src, dst, degree, share, sents_src, sents_dst) of the graph of every article."""

    def spread(long: DataFrame) -> DataFrame:
        parts = _parts(_texts(long, _paragraph_sentences(), _letter_words(stop_words)))
        found = "doc binary, src int, dst int, degree bigint, share double, sents_src array<int>, sents_dst array<int>"
        return _by_id(long, parts.mapInArrow(graphs.part_edges(THRESHOLD), found))

    rows = in_rows(articles, _paragraph_sentences(), _letter_words(stop_words))
    near = _exploded(rows, graphs.edge_rows(THRESHOLD)("_words"), "id")
    return _rows_and(near, articles, _paragraph_sentences(), _letter_words(stop_words), spread)


def _with_scores(near: DataFrame, articles: DataFrame, sentences: Column, words, spread) -> DataFrame:
    """The articles with ``_split`` and ``_scores``, a score for each sentence:
    ``near`` for those ranked in their rows, and the others with ``spread``'s (doc, _scores)."""
    columns = [*articles.columns, "_split", "_scores"]

    def listed(long: DataFrame) -> DataFrame:
        return with_document_key(with_computed(long, _split=sentences)).join(spread(long), "doc").select(*columns)

    short = near.where("_split IS NULL OR _words IS NOT NULL").select(*columns)
    return _rows_and(short, articles, sentences, words, listed)


def _lists(scores: DataFrame) -> DataFrame:
    """(doc, _scores) of (doc, sent_idx, score)."""
    placed = F.array_sort(F.collect_list(F.struct("sent_idx", "score")))
    return scores.groupBy("doc").agg(F.transform(placed, lambda s: s["score"]).alias("_scores"))


def ranked(articles: DataFrame, stop_words=ENGLISH) -> DataFrame:
    """The articles with ``_split``, their sentences, and ``_scores``, the score of each."""
    sentences, words = _paragraph_sentences(), _letter_words(stop_words)
    rows = in_rows(articles, sentences, words)
    near = with_computed(rows, _scores=graphs.power_scores(THRESHOLD, TOLERANCE)("_words"))
    return _with_scores(near, articles, sentences, words, lambda long: power_lists(_texts(long, sentences, words)))


def _per_document(scored: DataFrame) -> DataFrame:
    """(doc, sent_idx, score) of every sentence of every distinct document."""
    lists = with_document_key(scored).select("doc", "_scores").dropDuplicates(["doc"])
    return lists.select("doc", F.posexplode("_scores").alias("sent_idx", "score"))


def sentence_scores(articles: DataFrame, stop_words=ENGLISH) -> DataFrame:
    """(doc, sent_idx, score) of every sentence of every distinct document."""
    return _per_document(ranked(articles, stop_words))


def _with_best(scored: DataFrame, columns: list[str], n: int, in_order: bool) -> DataFrame:
    """``columns`` and ``_summary``, the ``n`` best sentences of every article,
    best first, ties in reading order, or all in reading order."""
    order = F.array_sort(F.transform("_scores", lambda s, i: F.struct((-s).alias("neg"), i.alias("idx"))))
    positions = F.transform(F.slice(order, 1, n), lambda s: s["idx"])
    if in_order:
        positions = F.array_sort(positions)
    chosen = with_computed(scored, _positions=F.coalesce(positions, F.array().cast("array<int>")))
    return chosen.select(*columns, F.transform("_positions", lambda i: F.get("_split", i)).alias("_summary"))


def sentence_lists(
    articles: DataFrame, n: int = DEFAULT_SENTENCES, stop_words=ENGLISH
) -> DataFrame:
    """The articles with ``_summary``, their ``n`` best sentences in reading order."""
    return _with_best(ranked(articles, stop_words), articles.columns, n, in_order=True)


def summaries(articles: DataFrame, n: int = DEFAULT_SENTENCES, stop_words=ENGLISH) -> DataFrame:
    """The articles with ``article`` replaced by its LexRank summary."""
    return (
        sentence_lists(articles, n, stop_words)
        .withColumn("article", F.array_join("_summary", " "))
        .select(*articles.columns)
    )


# --- variant with document frequencies of a background corpus ---------------


def background_idf(background: DataFrame, column: str) -> tuple[DataFrame, float]:
    """(term, idf) with ln(documents / documents with the term), and the value
    of a term no background document holds, ln(documents + 1)."""
    bags = background.select(F.array_distinct(text.word_tokens(F.col(column))).alias("words")).where(
        F.size("words") > 0
    )
    total = bags.count()
    holding = bags.select(F.explode("words").alias("term")).groupBy("term").count()
    return holding.select("term", F.log(F.lit(total) / F.col("count")).alias("idf")), math.log(total + 1)


def _background_graph(articles: DataFrame, background: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and unit weights (count times background idf) of the pieces between
    full stops after the first line of each article."""
    found = checkpointed(nodes(articles, text.split_naive(F.col("article")), text.word_tokens))
    idf, unseen = background_idf(background, column)
    weighted = (
        with_holding(term_counts(found))
        .join(idf, "term", "left")
        .withColumn("w", F.col("count") * F.coalesce("idf", F.lit(unseen)))
    )
    return found, checkpointed(unit_weights(weighted))


def components(members: DataFrame) -> DataFrame:
    """(doc, node, label): ``label`` is the smallest node reachable through
    groups; ``members`` holds (doc, grp, node). A round takes the smallest label
    of all groups of a node and then the label of that node, so that the way
    doubles with every round. Documents whose labels stand still leave the loop."""
    members = checkpointed(members)
    state = members.select("doc", "node").distinct().withColumn("label", F.col("node"))
    finished: DataFrame | None = None
    while True:
        lowest = members.join(state, ["doc", "node"]).groupBy("doc", "grp").agg(F.min("label").alias("low"))
        reached = members.join(lowest, ["doc", "grp"]).groupBy("doc", "node").agg(F.min("low").alias("low"))
        reached = checkpointed(state.join(reached, ["doc", "node"]))
        further = reached.select("doc", F.col("node").alias("low"), F.col("low").alias("further"))
        stepped = reached.join(further, ["doc", "low"]).select("doc", "node", "label", F.least("low", "further").alias("low"))
        moved = stepped.groupBy("doc").agg(F.bool_or(F.col("low") < F.col("label")).alias("open"))
        state = checkpointed(stepped.join(moved, "doc").select("doc", "node", F.col("low").alias("label"), "open"))
        done = state.where("not open").drop("open")
        finished = done if finished is None else finished.unionByName(done)
        state = state.where("open").drop("open")
        if state.isEmpty():
            return finished


def stationary_scores(node_table: DataFrame, strength: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, sent_idx, score): where the power method ends on a symmetric graph.

    Its limit needs no iteration: inside a connected component the score of a
    sentence is in proportion to the sum of its edges, with mean 1. ``strength``
    holds (doc, node, degree). A sentence without weighted words is alone: 1.
    """
    placed = node_table.select("doc", "node", "m").join(strength, ["doc", "node"]).join(labels, ["doc", "node"])
    sums = placed.groupBy("doc", "label").agg(
        F.sum("m").alias("size"), F.sum(F.col("m") * F.col("degree")).alias("total")
    )
    scores = placed.join(sums, ["doc", "label"]).select(
        "doc", "node", F.round(F.col("degree") * F.col("size") / F.col("total"), PLACES).alias("score")
    )
    sentences = node_table.select("doc", "node", F.explode("sents").alias("sent_idx"))
    return sentences.join(scores, ["doc", "node"], "left").select(
        "doc", "sent_idx", F.coalesce("score", F.lit(1.0)).alias("score")
    )


def _listed(idf: DataFrame) -> tuple[dict[str, float], DataFrame | None]:
    """The weights of the LISTED most frequent words, and the table of the others, None if there are none."""
    idf = checkpointed(idf)
    if idf.count() <= LISTED:
        return {r.term: r.idf for r in idf.collect()}, None
    rows = idf.orderBy("idf", "term").limit(LISTED).collect()
    last = F.struct(F.lit(rows[-1].idf).alias("idf"), F.lit(rows[-1].term).alias("term"))
    return {r.term: r.idf for r in rows}, idf.where(F.struct("idf", "term") > last)


def _with_further(rows: DataFrame, known: dict[str, float], others: DataFrame | None) -> DataFrame:
    """Adds ``_further``, the (term, idf) of an article's words that are among the ``others``."""
    if others is None:
        return rows.withColumn("_further", F.lit(None).cast("array<struct<term:string,idf:double>>"))
    keyed = with_document_key(rows)
    listed = rows.sparkSession.createDataFrame([(w,) for w in known], "term string")
    terms = keyed.select("doc", F.explode(F.array_distinct(F.split(F.array_join("_words", " "), " "))).alias("term"))
    rare = terms.join(F.broadcast(listed), "term", "left_anti").join(others, "term")
    further = rare.groupBy("doc").agg(F.collect_set(F.struct("term", "idf")).alias("_further"))
    return keyed.join(further, "doc", "left").drop("doc")


def background_ranked(
    articles: DataFrame, background: DataFrame, column: str, threshold: float | None = THRESHOLD
) -> DataFrame:
    """The articles with ``_split``, the pieces between full stops after their
    first line, and ``_scores``: edges where the similarity reaches the
    threshold, or, without one, weighted by every similarity."""
    sentences = text.split_naive(F.col("article"))
    idf, unseen = background_idf(background, column)
    known, others = _listed(idf)
    rows = _with_further(in_rows(articles, sentences, text.word_tokens), known, others)
    near = with_computed(rows, _scores=graphs.background_scores(known, unseen, threshold)("_words", "_further"))

    def spread(long: DataFrame) -> DataFrame:
        found, weights = _background_graph(long, background, column)
        if threshold is None:
            # the sum of the similarities of a sentence is its weights times the total weight of each term: no pair is formed
            totals = weights.groupBy("doc", "term").agg(F.sum(F.col("m") * F.col("w")).alias("total"))
            products = weights.join(totals, ["doc", "term"]).groupBy("doc", "node")
            strength = products.agg(F.sum(F.col("w") * F.col("total")).alias("degree"))
            return _lists(stationary_scores(found, strength, components(weights.select("doc", F.col("term").alias("grp"), "node"))))
        graph_ = checkpointed(transitions(weights, similarities(weights, threshold, inclusive=True)))
        strength = graph_.groupBy("doc", F.col("src").alias("node")).agg(F.any_value("degree").alias("degree"))
        return _lists(stationary_scores(found, strength, components(graph_.select("doc", F.col("src").alias("grp"), F.col("dst").alias("node")))))

    return _with_scores(near, articles, sentences, text.word_tokens, spread)


def background_scores(
    articles: DataFrame, background: DataFrame, column: str, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc, sent_idx, score): edges where the similarity reaches the threshold."""
    return _per_document(background_ranked(articles, background, column, threshold))


def continuous_scores(articles: DataFrame, background: DataFrame, column: str) -> DataFrame:
    """(doc, sent_idx, score): every similarity is an edge weight."""
    return _per_document(background_ranked(articles, background, column, None))


def background_summaries(
    articles: DataFrame, background: DataFrame, column: str, n: int = 10, threshold: float = THRESHOLD
) -> DataFrame:
    """The articles with ``_summary``, their ``n`` best sentences by score."""
    return _with_best(background_ranked(articles, background, column, threshold), articles.columns, n, in_order=False)
