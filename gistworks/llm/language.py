"""Language identification with interpolated Kneser-Ney character models.

Characters are folded to 64 symbols (a blank, a-z, 37 classes of other letters),
so an n-gram of four is a number below 2^24 and a model has a size bound that
does not depend on the corpus: at most 2^24 n-grams a language, and in practice
some tens of thousands. Counts of four-grams come from all texts learned from,
added up by Spark; lower orders are counts of distinct continuations, which
follow from the four-grams. The probabilities of all languages' n-grams lie in
arrays sorted by hash; an index of the hash finds the row.

A text goes to the language with the lowest cross-entropy per character. The
cross-entropy that each language's own texts reach, over all texts learned from,
gives a bound beyond which a text is rejected as being in none of them. More
languages than a task can hold are asked in blocks, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistworks.llm import words as W
from gistworks.session import checkpointed

ORDER, BITS = 4, 6
SYMBOLS = 1 << BITS

#: Entries of the models that are handed to a task at once; more languages go in blocks.
MOST_ENTRIES = 128_000_000

#: The share of a language's own texts that the rejection bound lets pass.
PASS = 0.999

_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """The symbol of every code point: 0 for what is not a letter."""
    if not _FOLD:
        points = np.arange(0x110000)
        letters = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
        symbols = np.where(letters, 27 + (points * 40503 >> 4) % 37, 0).astype(np.uint8)
        symbols[0x61:0x7B] = np.arange(1, 27)
        _FOLD.append(symbols)
    return _FOLD[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All four-grams of the texts, as numbers, and the offsets of the texts in them.

    A text stands between two blanks and one; runs of other characters than
    letters are one blank. A text without letters has none.
    """
    lowered = [(t or "").lower() for t in texts]
    symbols = _fold()[np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    bounds = np.cumsum([0, *[len(t) + 1 for t in lowered]])
    kept = symbols != 0
    kept[1:] |= symbols[:-1] != 0
    kept[bounds] = True  # the blanks between texts
    closing = np.zeros(len(symbols), bool)
    closing[bounds] = True
    symbols, closing = symbols[kept], closing[kept]
    ends = np.r_[(symbols[:-1] == 0) & ~closing[:-1] & closing[1:], False]  # a blank that ends a text is the one behind it
    symbols, closing = symbols[~ends], closing[~ends]
    at = np.flatnonzero(closing)
    symbols = np.insert(symbols, at, 0).astype(np.uint32)
    starts = at + np.arange(len(at))  # of the two blanks before each text
    codes = np.zeros(max(len(symbols) - ORDER + 1, 0), np.uint32)
    for k in range(ORDER):
        codes = (codes << BITS) | symbols[k : len(codes) + k]
    sizes = starts[1:] - starts[:-1] - 2  # two blanks, the text, a blank
    sizes = np.where(sizes > 0, sizes, 0)
    offsets = np.r_[0, np.cumsum(sizes)]
    return codes[np.repeat(starts[:-1] - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets


def count(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows of ``docs`` (``lang, text``); each task adds up its own first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(lang: str) -> pa.RecordBatch:
            codes, n = sums.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int32)), pa.array(n)], ["lang", "gram", "n"])

        for batch in W.slices(batches):
            codes, at = grams(batch.column("text").to_pylist())
            langs = batch.column("lang").dictionary_encode()
            names, of = langs.dictionary.to_pylist(), np.repeat(langs.indices.to_numpy().astype(np.int64), np.diff(at))
            both, n = np.unique(of << 32 | codes, return_counts=True)
            for k, lang in enumerate(names):
                own = slice(*np.searchsorted(both, [k << 32, k + 1 << 32]))
                found, held = (both[own] & 0xFFFFFFFF).astype(np.uint32), n[own].astype(np.int64)
                if lang in sums:
                    merged, back = np.unique(np.r_[sums[lang][0], found], return_inverse=True)
                    held = np.bincount(back, np.r_[sums[lang][1], held]).astype(np.int64)
                    found = merged
                sums[lang] = found, held
                if len(found) > 1_000_000:
                    yield rows(lang)
        for lang in list(sums):
            yield rows(lang)

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram int, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discount(n: np.ndarray) -> float:
    one, two = int((n == 1).sum()), int((n == 2).sum())
    return one / (one + 2 * two) if one else 0.5


def _level(grams_of: np.ndarray, n: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the counts of one order: their probabilities above the lower order's share, and that share by context.

    ``lower`` has the probability of the next order for every number of it.
    """
    contexts = grams_of >> BITS
    size = len(lower)  # numbers of the lower order, and so of contexts
    total = np.bincount(contexts, n, minlength=size)
    kinds = np.bincount(contexts, minlength=size)
    d = _discount(n)
    share = np.ones(size)
    seen = total > 0
    share[seen] = d * kinds[seen] / total[seen]
    return np.maximum(n - d, 0) / total[contexts] + share[contexts] * lower[grams_of & size - 1], share


def kneser_ney(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(p, share, lower)``: the probability of each four-gram seen; the share left to the lower order by context; the lower order's."""
    kinds = [np.unique(codes & (1 << BITS * k) - 1, return_counts=True) for k in (3, 2, 1)]  # distinct continuations
    lower = np.full(1, 1 / SYMBOLS)
    # unigrams first: what is left of them goes to all symbols alike
    for codes_k, n_k in reversed(kinds):
        if len(lower) == 1:
            d = _discount(n_k)
            dense = np.full(SYMBOLS, d * len(n_k) / n_k.sum() / SYMBOLS)
            dense[codes_k] += np.maximum(n_k - d, 0) / n_k.sum()
        else:
            p, share = _level(codes_k, n_k, lower)
            dense = np.repeat(share, SYMBOLS) * np.tile(lower, SYMBOLS)[_suffix(len(lower))]
            dense[codes_k] = p
        lower = dense
    p, share = _level(codes, n, lower)
    return p, share, lower


def _suffix(size: int) -> np.ndarray:
    """For every number of one order more than ``size`` has, the place of its last symbols."""
    return np.arange(size * SYMBOLS) & size - 1


def _hash(codes: np.ndarray) -> np.ndarray:
    """A bijection of 24-bit numbers."""
    return (codes.astype(np.uint32) * np.uint32(0x9E3779B1)) & np.uint32((1 << ORDER * BITS) - 1)


class Model:
    """The languages' models side by side: hashes sorted, and per hash the log-probabilities of all languages."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        self.bounds = np.full(len(counts), np.inf)
        if not counts:
            return
        codes = np.unique(np.concatenate([c for c, _ in counts.values()]))
        order = np.argsort(_hash(codes))
        codes = codes[order]
        self.hashes = _hash(codes)
        self.seen = np.empty((len(codes), len(counts)), np.float32)
        self.share = np.empty((SYMBOLS**3, len(counts)), np.float32)
        self.lower = np.empty((SYMBOLS**3, len(counts)), np.float32)
        for k, lang in enumerate(self.languages):
            own, n = counts[lang]
            p, share, lower = kneser_ney(own, n)
            values = share[codes >> BITS] * lower[codes & SYMBOLS**3 - 1]
            values[np.argsort(order)[np.searchsorted(np.sort(codes), own)]] = p
            self.seen[:, k], self.share[:, k], self.lower[:, k] = np.log(values), np.log(share), np.log(lower)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """The row of each n-gram in the sorted arrays, -1 where no language has it."""
        if not hasattr(self, "index"):
            self.index = np.full(1 << ORDER * BITS, -1, np.int32)
            self.index[self.hashes] = np.arange(len(self.hashes), dtype=np.int32)
        return self.index[_hash(codes)]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's cross-entropy per character in all languages, and its number of n-grams."""
        codes, at = grams(texts)
        sizes = np.diff(at)
        out = np.zeros((len(texts), len(self.languages)))
        if not len(codes) or not self.languages:
            return out, sizes
        rows = self._rows(codes)
        values = self.seen[rows]
        missing = np.flatnonzero(rows < 0)
        values[missing] = self.share[codes[missing] >> BITS] + self.lower[codes[missing] & SYMBOLS**3 - 1]
        some = np.flatnonzero(sizes)
        out[some] = -np.add.reduceat(values, at[some], axis=0, dtype=np.float64) / sizes[some, None]
        return out, sizes


def crc_part(doc_id: Column, parts: int) -> Column:
    """The remainder of the crc32 of the doc_id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


_BEST = [("lang_pred", "string"), ("score", "double"), ("entropy", "double"), ("bound", "double"), ("weight", "double"), ("size", "long")]


def _scored(docs: DataFrame, model, columns: list[str], later: bool) -> DataFrame:
    """``columns`` and the best language so far: of this model's, and (``later``) of those of the models before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm: Model = model.value
        for batch in W.slices(batches):
            found, sizes = lm.entropies(batch.column("text").to_pylist())
            n = len(found)
            best = found.argmin(axis=1) if lm.languages else np.zeros(n, int)
            lowest = found.min(axis=1) if lm.languages else np.full(n, np.inf)
            scale = np.minimum(sizes, 50)
            weight = np.exp(-(found - lowest[:, None]) * scale[:, None]).sum(axis=1) if lm.languages else np.zeros(n)
            langs = np.array(lm.languages or ["und"], object)[best]
            bounds = lm.bounds[best] if lm.languages else np.full(n, np.inf)
            if later:  # of equal ones the first stays
                old, old_weight = batch.column("entropy").to_numpy(), batch.column("weight").to_numpy()
                new = lowest < old
                least = np.minimum(lowest, old)
                weight = weight * np.exp(-(lowest - least) * scale) + old_weight * np.exp(-(old - least) * scale)
                langs = np.where(new, langs, np.array(batch.column("lang_pred").to_pylist(), object))
                bounds = np.where(new, bounds, batch.column("bound").to_numpy())
                lowest = least
            made = [pa.array(langs, pa.string()), *[pa.array(x, pa.float64()) for x in (np.zeros(n), lowest, bounds, weight)], pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *made], [*columns, *[name for name, _ in _BEST]])

    schema = T.StructType([docs.schema[c] for c in columns])
    for name, kind in _BEST:
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def _detected(docs: DataFrame, models: Models, columns: list[str]) -> DataFrame:
    """``columns, lang_pred, score, entropy, rejected``, the languages asked block by block: one block is handed out and held at a time."""
    context = docs.sparkSession.sparkContext
    kept = [*columns, *[c for c in ["text"] if c not in columns]]
    rows = docs.select(*kept)
    for i, model in enumerate(models.blocks):
        rows = _scored(rows, context.broadcast(model), kept, i > 0)
        if i + 1 < len(models.blocks):
            rows = checkpointed(rows)
    known = (F.col("size") > 0) & F.lit(bool(models.languages))
    return rows.select(
        *columns,
        F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(known, 1 / F.col("weight")).otherwise(0.0).alias("score"),
        F.when(known, F.col("entropy")).otherwise(0.0).alias("entropy"),
        (known & (F.col("entropy") > F.col("bound"))).alias("rejected"),
    )


class Models:
    """The models of all languages, in blocks that fit a task's memory."""

    def __init__(self, blocks: list[Model]):
        self.blocks = blocks
        self.languages = [lang for block in blocks for lang in block.languages]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's cross-entropy per character in all languages, and its number of n-grams."""
        parts = [block.entropies(texts) for block in self.blocks]
        return np.concatenate([found for found, _ in parts], axis=1), parts[0][1]


def _blocks(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Languages in order, as many to a block as keep its entries below ``most``; one that has more by itself is a block."""
    blocks: list[list[str]] = []
    held = 0
    for lang, n in sorted(sizes):
        held += n
        if not blocks or (len(blocks[-1]) + 1) * (held + 2 * SYMBOLS**3) > most:
            blocks.append([])
            held = n
        blocks[-1].append(lang)
    return blocks


def fit(docs: DataFrame) -> Models:
    """Learn from all rows of ``docs`` with a ``lang`` and a letter in their ``text``; no such rows give a model without languages.

    The driver holds one block of languages at a time while it builds them, a row
    a language otherwise. A language's bound is set by all its own texts that are
    told right: what all but one in a thousand stay below, and three times their
    spread on top; by fewer than twenty texts none is set.
    """
    own = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    found = count(own).persist()
    try:
        sizes = [(r["lang"], r["n"]) for r in found.groupBy("lang").agg(F.count("*").alias("n")).collect()]  # a row a language
        models = []
        for block in _blocks(sizes, MOST_ENTRIES):
            table = found.where(F.col("lang").isin(block)).toArrow().combine_chunks()
            langs = table.column("lang").combine_chunks().dictionary_encode()
            names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            codes, n = table.column("gram").to_numpy().astype(np.uint32), table.column("n").to_numpy()
            order = np.lexsort((codes, of))
            bounds = np.searchsorted(of[order], np.arange(len(names) + 1))
            models.append(Model({lang: (codes[order[a:b]], n[order[a:b]]) for lang, a, b in zip(names, bounds[:-1], bounds[1:], strict=True)}))
    finally:
        found.unpersist()
    learned = Models(models or [Model({})])
    right = _detected(own, learned, ["lang"]).where(F.col("lang") == F.col("lang_pred")).groupBy("lang")
    reached = {r["lang"]: r for r in right.agg(F.count("*").alias("n"), F.percentile_approx("entropy", F.lit(PASS), F.lit(10_000)).alias("high"), F.stddev_pop("entropy").alias("spread")).collect()}
    for model in learned.blocks:
        for k, lang in enumerate(model.languages):
            if lang in reached and reached[lang]["n"] >= 20:
                model.bounds[k] = reached[lang]["high"] + 3 * reached[lang]["spread"]
    return learned


def detect(docs: DataFrame, models: Models) -> DataFrame:
    """``doc_id, lang_pred, score, entropy, rejected`` of every row.

    ``und`` with score 0 for a null text, one without letters, or a model
    without languages; ``score`` is the best language's share of the likelihood
    of at most fifty characters; ``rejected`` tells that not even the best
    language's own texts are that unlikely in it. Repeated rows come back as
    often, a very long text is read whole, an empty table gives no rows, and
    further columns do not count. Rows without a doc_id are scored, though none
    of them is learned from where the caller parts rows by doc_id.
    """
    return _detected(docs, models, ["doc_id"])
