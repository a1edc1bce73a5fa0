"""Chat formatting by quotation linking.

Messages quote earlier ones behind ``>`` marks, one per level. Each run of lines
of one level is a quoted passage. Passages and the messages' own lines are
normalised alike (lower case, letters and digits only) and cut into units in
three ways: the sentences of paragraphs, whose lines are joined; the sentences
of single lines, for headings and lists; and windows of a few words, for parts
of either that were wrapped anew. A unit of a passage stands for the latest
earlier message of the conversation that holds it, a word for what the first
way says that finds a unit around it, and a passage for the message most of its
words stand for. What a message quotes at the first level is what it
answers; following the answers leads to the root of a thread. The conversation
then reads thread by thread, each in the order of its turns, without the quotes.

The latest earlier holder is found in two steps, in ranges of turns and then
inside them, so that one conversation, or one line that everybody writes, does
not end in one task; no pair of equal sentences is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gistworks.functions.frames import with_computed
from gistworks.llm.columns import let
from gistworks.session import checkpointed

#: Turns of one range.
RANGE_TURNS = 256

#: Words of a window.
WINDOW = 8

#: Where a text is cut: sentences of paragraphs, and of lines.
_PARAGRAPHS = r"(?<=[.!?…])\s+|\n[^\S\n]*\n\s*"
_SINGLE = r"(?<=[.!?…])\s+|\n"

#: Lines that introduce a quotation.
ATTRIBUTION = r"(?i)(\b(wrote|writes|said|schrieb|a écrit|escribió)\b.{0,80}:\s*$|^\s*-{2,}\s*original message\s*-{2,}\s*$)"

_MARKS = r"^((?:\s{0,3}>)+)\s?"


def _lines(text: Column) -> Column:
    """Every line with its quote level and the text behind its marks."""

    def parsed(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 1)
        return F.struct((F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).alias("level"), F.regexp_replace(line, _MARKS, "").alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), parsed)


def own_text(lines: Column) -> Column:
    """The lines that are not quoted and do not introduce a quotation, trimmed as a whole."""
    own = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["body"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)))
    return F.btrim(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), F.lit(" \t\r\n"))


def passages(lines: Column) -> Column:
    """The quoted passages: level and text of each run of lines of one level above 0."""
    begins = F.filter(
        F.transform(lines, lambda x, i: F.when((i == 0) | (F.get(lines, i - 1)["level"] != x["level"]), i)),
        lambda i: i.isNotNull(),
    )

    def cut(at: Column) -> Column:
        def passage(begin: Column, k: Column) -> Column:
            end = F.coalesce(F.get(at, k + 1), F.size(lines))
            return F.struct(F.get(lines, begin)["level"].alias("level"), F.array_join(F.transform(F.slice(lines, begin + 1, end - begin), lambda x: x["body"]), "\n").alias("text"))

        return F.filter(F.transform(at, passage), lambda p: p["level"] > 0)

    return let(begins, cut)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")


def _pieces(text: Column, cuts: str) -> Column:
    """Normalised pieces between cuts, each with its hash and number of words; those without a letter or digit are left out."""
    found = F.filter(F.transform(F.split(text, cuts, -1), _words), lambda w: F.size(w) > 0)
    return F.transform(found, lambda w: F.struct(F.xxhash64(w).alias("hash"), F.size(w).alias("words")))


def _windows(text: Column) -> Column:
    """Every window of words, as pieces; none in a text of fewer words."""

    def cut(words: Column) -> Column:
        starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(1), F.size(words) - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(words, i, WINDOW)).alias("hash"), F.lit(WINDOW).alias("words")))

    return let(_words(text), cut)


def _ways(text: Column) -> list[Column]:
    """The units of a text, in the order in which they count."""
    return [_pieces(text, _PARAGRAPHS), _pieces(text, _SINGLE), _windows(text)]


def _latest_before(held: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (``conv_id, hash, turn, ...``) with ``found``, the latest earlier turn of ``held`` with the hash, where there is one."""
    key = ["conv_id", "hash"]
    span = F.floor(F.col("turn") / RANGE_TURNS)
    held = held.select(*key, "turn").distinct().withColumn("range", span)
    carried = W.partitionBy(*key).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    marks = held.groupBy(*key, "range").agg(F.max("turn").alias("last")).unionByName(asked.select(*key, span.alias("range")).distinct().withColumn("last", F.lit(None).cast("long")))
    marks = marks.groupBy(*key, "range").agg(F.max("last").alias("last")).withColumn("carried", F.max("last").over(carried))
    wanted = asked.select(*key, "turn").distinct().withColumn("range", span)
    both = held.withColumn("held", F.col("turn")).unionByName(wanted.withColumn("held", F.lit(None).cast("long")))
    both = both.groupBy(*key, "range", "turn").agg(F.max("held").alias("held"))
    inside = W.partitionBy(*key, "range").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("held").over(inside)).join(marks.select(*key, "range", "carried"), [*key, "range"])
    found = near.select(*key, "turn", F.coalesce("near", "carried").alias("found")).where("found IS NOT NULL")
    return asked.join(found, [*key, "turn"])


def links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, passage, level, found, words, total`` of every quoted passage that an earlier message of its conversation explains.

    ``found``: the turn; ``words``: how many of the passage's ``total`` words
    stand for it. Rows without a conversation or a turn take no part.
    """
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("turn", F.col("turn").cast("long"))
    quoting = known.where(F.col("text").rlike(r"(?m)^\s{0,3}>")).select("conv_id", "turn", "text").distinct()
    quoting = with_computed(quoting, lines=_lines(F.col("text")))
    quoted = quoting.select("conv_id", "turn", F.xxhash64("text").alias("copy"), F.posexplode(passages(F.col("lines"))).alias("passage", "p"))
    passage = ["conv_id", "turn", "passage", "level"]
    asked = quoted.select("conv_id", "turn", "copy", "passage", F.col("p.level").alias("level"), F.posexplode(F.array(*_ways(F.col("p.text")))).alias("way", "units"))
    asked = asked.select(*passage, "copy", "way", F.posexplode("units").alias("at", "s")).select(*passage, "copy", "way", "at", "s.hash", "s.words")
    before = F.sum("words").over(W.partitionBy(*passage, "copy", "way").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    start = F.when(F.col("way") == 2, F.col("at").cast("long")).otherwise(F.coalesce(before, F.lit(0).cast("long")))
    asked = checkpointed(asked.withColumn("start", start).drop("at"))
    totals = asked.where("way = 0").groupBy(*passage).agg(F.sum("words").alias("total"))
    held = known.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", "text")
    held = with_computed(held, lines=_lines(F.col("text")))
    held = with_computed(held.select("conv_id", "turn", own_text(F.col("lines")).alias("own")), own_=F.col("own"))
    units = F.array_distinct(F.transform(F.concat(*_ways(F.col("own_"))), lambda s: s["hash"]))
    held = held.select("conv_id", "turn", F.explode(units).alias("hash"))
    held = held.join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    explained = _latest_before(held, asked).select(*passage, "copy", "way", "found", F.explode(F.expr("sequence(start, start + words - 1)")).alias("word"))
    explained = explained.groupBy(*passage, "copy", "word").agg(F.max(F.struct(-F.col("way"), "found")).alias("b"))
    votes = explained.groupBy(*passage, F.col("b.found").alias("found")).agg(F.count("*").alias("words"))
    best = votes.groupBy(*passage).agg(F.max(F.struct("words", "found")).alias("b")).select(*passage, "b.found", "b.words")
    return best.join(totals, passage)


def _threads(parents: DataFrame) -> DataFrame:
    """``conv_id, turn, parent, root, depth`` of the messages with a parent, by following the root's root."""
    state = checkpointed(parents.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = state.join(up, ["conv_id", "root"], "left")
        if step.where("next IS NOT NULL").isEmpty():
            return state
        state = checkpointed(step.select("conv_id", "turn", "parent", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))


def conversations(messages: DataFrame, template: str = "%s: %s") -> DataFrame:
    """All messages without their quotes, in reply order.

    ``conv_id, turn, role, text, chat, n_quotes, n_linked, parent_turn,
    root_turn, depth``: ``chat`` is the role and the text in the template;
    ``parent_turn`` the message that the first-level quotes stand for (most
    words, then the latest), null where there is none, so that the message is
    its own root at depth 0. Sorted by conversation, root and turn, in ranges. A
    null or empty text is an empty one, as is one that only quotes; a null role
    leaves the template's first place empty; repeated rows come back as often,
    rows of one conversation and turn being one message as far as links go.
    """
    found = checkpointed(links(messages))
    first = found.where("level = 1").groupBy("conv_id", "turn", "found").agg(F.sum("words").alias("words"))
    parents = first.groupBy("conv_id", "turn").agg(F.max(F.struct("words", "found")).alias("b")).select("conv_id", "turn", F.col("b.found").alias("parent"))
    threads = _threads(parents)
    linked = found.groupBy("conv_id", "turn").agg(F.count_distinct("passage").alias("n_linked")).join(threads, ["conv_id", "turn"], "left").alias("t")
    plain = with_computed(messages.select("conv_id", "turn", "role", "text"), lines=_lines(F.col("text")))
    plain = plain.select("conv_id", "turn", "role", own_text(F.col("lines")).alias("text"), F.size(passages(F.col("lines"))).cast("long").alias("n_quotes")).alias("m")
    rows = plain.join(linked, (F.col("m.conv_id") == F.col("t.conv_id")) & (F.col("m.turn") == F.col("t.turn")), "left")
    out = rows.select(
        "m.conv_id",
        "m.turn",
        "m.role",
        "m.text",
        F.format_string(template, F.coalesce("m.role", F.lit("")), F.col("m.text")).alias("chat"),
        "m.n_quotes",
        F.coalesce("t.n_linked", F.lit(0)).alias("n_linked"),
        F.col("t.parent").alias("parent_turn"),
        F.coalesce("t.root", F.col("m.turn").cast("long")).alias("root_turn"),
        F.coalesce("t.depth", F.lit(0).cast("long")).alias("depth"),
    )
    return out.repartitionByRange("conv_id", "root_turn", "turn").sortWithinPartitions("conv_id", "root_turn", "turn")
