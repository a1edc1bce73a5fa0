"""LexRank of the sentences of one document. The products of all sentences that
share a word are what Spark has no expression for; they run as small Arrow
functions over rows, a block of sentences at a time, so that no term or graph
row of a document ever travels. Sentences come as their words joined by blanks."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are plain Python values at a time.
SLICE = 64

#: Products of weights, and cells of the matrix of sentences, that one block may hold; a single sentence has no more
#: products than its document has words.
BLOCK = 1 << 20

PLACES = 9


class Bags:
    """The different bags of words of a document in the order of their first
    sentences: ``members``, the sentences of each, ``m`` their number; and the entries ``node, term, count`` of all bags."""

    def __init__(self, sentences: list[str]):
        found: dict[str, list[int]] = {}
        for i, sentence in enumerate(sentences):
            found.setdefault(" ".join(sorted((sentence or "").split())), []).append(i)
        self.n, self.members = len(sentences), list(found.values())
        self.m = np.array([len(s) for s in self.members], np.int64)
        ids: dict[str, int] = {}
        node, term, count = [], [], []
        for k, bag in enumerate(found):
            counted = Counter(bag.split())
            node += [k] * len(counted)
            term += [ids.setdefault(w, len(ids)) for w in counted]
            count += counted.values()
        self.terms = list(ids)
        self.node, self.term, self.count = (np.array(x, np.int64) for x in (node, term, count))

    def tf(self) -> np.ndarray:
        """The count over the largest of the bag."""
        top = np.zeros(len(self.m), np.int64)
        np.maximum.at(top, self.node, self.count)
        return self.count / top[self.node]

    def sentences(self) -> np.ndarray:
        """Of each term the sentences with it."""
        return np.bincount(self.term, self.m[self.node], len(self.terms)).astype(np.int64)

    def weigh(self, w: np.ndarray) -> None:
        """Keeps the entries with a weight, as ``w`` over the norm of their bag."""
        norm = np.sqrt(np.bincount(self.node, w * w, len(self.m)))
        kept = (w != 0) & (norm[self.node] > 0)
        self.node, self.term, self.w = self.node[kept], self.term[kept], w[kept] / norm[self.node[kept]]

    def per_sentence(self, values: np.ndarray) -> list[float]:
        out = [0.0] * self.n
        for sentences, value in zip(self.members, values.tolist()):
            for i in sentences:
                out[i] = value
        return out


def standard(sentences: list[str]) -> Bags:
    """Bags with the weights tf times idf of the document's own sentences."""
    bags = Bags(sentences)
    idf = np.log(bags.n / (1.0 + bags.sentences()))
    bags.weigh(bags.tf() * idf[bags.term])
    return bags


def blocks(bags: Bags, threshold: float, inclusive: bool = False, rows: tuple[int, int] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """The pairs of bags above the threshold and their similarity, a block of bags at a time: of each bag with every
    later one or, of those in the range ``rows``, with every other. Either way a pair sums up its words in one order."""
    size = len(bags.m)
    order = np.lexsort((bags.node, bags.term))
    node, term, w = bags.node[order], bags.term[order], bags.w[order]
    start = np.arange(1, len(term) + 1) if rows is None else np.searchsorted(term, term)
    others = np.searchsorted(term, term, side="right") - start
    by_node = np.argsort(node, kind="stable")
    upto = np.concatenate([[0], np.cumsum(others[by_node])])  # products up to an entry
    begin = np.searchsorted(node[by_node], np.arange(size + 1))  # entries up to a bag
    first, last = rows or (0, size)
    while first < last:
        end = int(np.searchsorted(upto[begin], upto[begin[first]] + BLOCK, side="right")) - 1
        end = min(max(end, first + 1), first + max(BLOCK // size, 1), last)
        entries = by_node[begin[first] : begin[end]]
        times = others[entries]
        i = np.repeat(entries, times)
        j = np.arange(len(i)) + np.repeat(start[entries] - np.cumsum(times) + times, times)
        cell = (node[i] - first) * size + node[j]
        sums = np.round(np.bincount(cell, w[i] * w[j], (end - first) * size), PLACES)
        above = sums >= threshold if inclusive else sums > threshold
        if threshold <= 0:  # only bags that share a word
            above &= np.bincount(cell, minlength=(end - first) * size) > 0
        if rows is not None:
            above[np.arange(end - first) * (size + 1) + first] = False  # a bag and itself
        hits = np.flatnonzero(above)
        yield hits // size + first, hits % size, sums[hits]
        first = end


def similar(bags: Bags, threshold: float, inclusive: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of bags i < j above the threshold, and their similarity."""
    columns = list(zip(*blocks(bags, threshold, inclusive))) or [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    return tuple(np.concatenate(c) for c in columns)


def linked(bags: Bags, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The graph in both directions and of each weighted bag with itself, and of each bag the sentences next to it."""
    own = np.unique(bags.node)
    src, dst = np.concatenate([i, j, own]), np.concatenate([j, i, own])
    return src, dst, np.bincount(src, bags.m[dst], len(bags.m)).astype(np.int64)


def power(bags: Bags, threshold: float, tolerance: float) -> np.ndarray:
    """Power steps from 1/n until the scores move by no more than the tolerance (L2)."""
    i, j, _ = similar(bags, threshold)
    src, dst, degree = linked(bags, i, j)
    share = bags.m[src] / degree[src]
    score = np.full(len(bags.m), 1 / max(bags.n, 1))
    while True:
        old, score = score, np.bincount(dst, share * score[src], len(bags.m))
        if not round(float(np.sqrt((bags.m * (score - old) ** 2).sum())), PLACES) > tolerance:
            return np.round(score, PLACES)


def _labels(size: int, group: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Of each bag the smallest one reachable through groups; labels take the label of their label."""
    label = np.arange(size)
    while True:
        low = np.full(int(group.max(initial=-1)) + 1, size)
        np.minimum.at(low, group, label[node])
        reached = label.copy()
        np.minimum.at(reached, node, low[group])
        reached = reached[reached]
        if (reached == label).all():
            return label
        label = reached


def stationary(bags: Bags, degree: np.ndarray, group: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Where the power method ends on a symmetric graph: the degree over the mean
    of the component; 1 for a bag without weighted words."""
    label = _labels(len(bags.m), group, node)
    size = np.bincount(label, bags.m, len(bags.m))
    total = np.bincount(label, bags.m * degree, len(bags.m))
    score = np.ones(len(bags.m))
    some = np.unique(bags.node)
    score[some] = np.round(degree[some] * size[label[some]] / total[label[some]], PLACES)
    return score


# --- Arrow functions --------------------------------------------------------

INTS = T.ArrayType(T.IntegerType())


def _struct(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


def _rows(kind: T.DataType, arrow: pa.DataType, run: Callable, at_once: int = SLICE):
    """An Arrow function that applies ``run`` to each row; null where the first argument is null."""

    def over(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:  # a single argument comes by itself
        for batch in batches:
            parts, columns = [], batch if isinstance(batch, tuple) else (batch,)
            for at in range(0, len(columns[0]), at_once):
                rows = zip(*(column.slice(at, at_once).to_pylist() for column in columns))
                parts.append(pa.array([None if row[0] is None else run(*row) for row in rows], arrow))
            yield pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return F.arrow_udf(over, kind)


def _terms(sentences: list[str]) -> list[dict]:
    bags = Bags(sentences)
    tf, terms = bags.tf().tolist(), bags.terms
    return [{"sent_idx": i, "term": terms[t], "tf": x} for k, t, x in zip(bags.node.tolist(), bags.term.tolist(), tf) for i in bags.members[k]]


#: ``sent_idx, term, tf`` of every sentence.
term_rows = _rows(
    _struct(sent_idx=T.IntegerType(), term=T.StringType(), tf=T.DoubleType()),
    pa.list_(pa.struct([("sent_idx", pa.int32()), ("term", pa.string()), ("tf", pa.float64())])),
    _terms,
)


def _holding(sentences: list[str]) -> list[dict]:
    bags = Bags(sentences)
    return [{"term": t, "sentences": s} for t, s in zip(bags.terms, bags.sentences().tolist())]


#: ``term, sentences``: the words of a document and the number of sentences with each.
document_terms = _rows(
    _struct(term=T.StringType(), sentences=T.LongType()), pa.list_(pa.struct([("term", pa.string()), ("sentences", pa.int64())])), _holding
)


def similar_rows(threshold: float):
    """``i, j, m_i, m_j, similarity, sents_i, sents_j`` of the similar pairs of bags, each named by its first sentence."""

    def run(sentences: list[str]) -> list[dict]:
        bags = standard(sentences)
        s, m = bags.members, bags.m.tolist()
        return [
            {"i": s[a][0], "j": s[b][0], "m_i": m[a], "m_j": m[b], "similarity": x, "sents_i": s[a], "sents_j": s[b]}
            for a, b, x in zip(*(c.tolist() for c in similar(bags, threshold)))
        ]

    number, numbers = pa.int32(), pa.list_(pa.int32())
    fields = [("i", number), ("j", number), ("m_i", number), ("m_j", number), ("similarity", pa.float64()), ("sents_i", numbers), ("sents_j", numbers)]
    whole = T.IntegerType()
    return _rows(_struct(i=whole, j=whole, m_i=whole, m_j=whole, similarity=T.DoubleType(), sents_i=INTS, sents_j=INTS), pa.list_(pa.struct(fields)), run)


def edge_rows(threshold: float):
    """``src, dst, degree, share, sents_src, sents_dst`` of the graph."""

    def run(sentences: list[str]) -> list[dict]:
        bags = standard(sentences)
        i, j, _ = similar(bags, threshold)
        src, dst, degree = linked(bags, i, j)
        s, share = bags.members, (bags.m[src] / degree[src]).tolist()
        return [
            {"src": s[a][0], "dst": s[b][0], "degree": d, "share": x, "sents_src": s[a], "sents_dst": s[b]}
            for a, b, d, x in zip(src.tolist(), dst.tolist(), degree[src].tolist(), share)
        ]

    numbers = pa.list_(pa.int32())
    fields = [("src", pa.int32()), ("dst", pa.int32()), ("degree", pa.int64()), ("share", pa.float64()), ("sents_src", numbers), ("sents_dst", numbers)]
    kind = _struct(src=T.IntegerType(), dst=T.IntegerType(), degree=T.LongType(), share=T.DoubleType(), sents_src=INTS, sents_dst=INTS)
    return _rows(kind, pa.list_(pa.struct(fields)), run)


DOUBLES = (T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))


def power_scores(threshold: float, tolerance: float):
    """The score of each sentence."""

    def run(sentences: list[str]) -> list[float]:
        bags = standard(sentences)
        return bags.per_sentence(power(bags, threshold, tolerance)) if sentences else []

    return _rows(*DOUBLES, run)


def background_scores(known: dict[str, float], unseen: float, threshold: float | None):
    """The score of each sentence, words weighing their count times their idf in
    a background: ``known``, or the second argument's (term, idf), or ``unseen``.
    Without a threshold every similarity is the weight of an edge: the sum of
    those of a sentence is its weights times the total weight of each word, and
    no pair is formed."""

    def run(sentences: list[str], further: list[dict] | None) -> list[float]:
        bags = Bags(sentences)
        more = {x["term"]: x["idf"] for x in further or []}
        idf = np.array([known[t] if t in known else more.get(t, unseen) for t in bags.terms], float)
        bags.weigh(bags.count * idf[bags.term] if len(bags.terms) else np.zeros(0))
        if threshold is None:
            total = np.bincount(bags.term, bags.m[bags.node] * bags.w, len(bags.terms))
            degree = np.bincount(bags.node, bags.w * total[bags.term], len(bags.m))
            return bags.per_sentence(stationary(bags, degree, bags.term, bags.node))
        i, j, _ = similar(bags, threshold, inclusive=True)
        src, dst, degree = linked(bags, i, j)
        return bags.per_sentence(stationary(bags, degree, src, dst))

    return _rows(*DOUBLES, run)


# --- parts of a document that is too long for one task ------------------------


def _range(bags: Bags, part: int, parts: int) -> tuple[int, int]:
    """The bags of one of so many parts."""
    return len(bags.m) * part // parts, len(bags.m) * (part + 1) // parts


def part_sums(threshold: float):
    """An Arrow function of a document, a part, the number of parts, and the degrees and scores of all bags: one power
    step of the bags of the part, and ``moved``, what they add to the square of its length. Without degrees and scores
    it makes the degrees. No pair outlives its block."""

    def run(sentences: list[str], part: int, parts: int, degree: list[float] | None, score: list[float] | None) -> dict:
        bags = standard(sentences)
        first, last = _range(bags, part, parts)
        arriving = bags.m.astype(float)
        if degree is not None:
            arriving = np.divide(arriving, degree, out=np.zeros(len(bags.m)), where=np.array(degree) > 0) * score
        sums = np.where(np.bincount(bags.node, minlength=len(bags.m)) > 0, arriving, 0.0)[first:last]
        for i, j, _ in blocks(bags, threshold, rows=(first, last)):
            sums += np.bincount(i - first, arriving[j], last - first)
        moved = 0.0 if score is None else float((bags.m[first:last] * (sums - score[first:last]) ** 2).sum())
        return {"sums": sums.tolist(), "moved": moved}

    kind = T.StructType([T.StructField("sums", DOUBLES[0]), T.StructField("moved", T.DoubleType())])
    return _rows(kind, pa.struct([("sums", DOUBLES[1]), ("moved", pa.float64())]), run, 1)


#: Of a document and the scores of its bags the score of each sentence.
by_sentence = _rows(*DOUBLES, lambda sentences, scores: Bags(sentences).per_sentence(np.round(np.array(scores, float), PLACES)), 1)


def _numbered_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, Bags, int, int]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            bags = standard(row["_words"])
            yield row["doc"], bags, *_range(bags, row["part"], row["parts"])


def _batch(doc: bytes, bags: Bags, ends: tuple[str, str], a: np.ndarray, b: np.ndarray, **figures: np.ndarray) -> pa.RecordBatch:
    """Rows of two bags each, named by their first sentences, with the sentences of both."""
    members, first = pa.array(bags.members, pa.list_(pa.int32())), np.array([s[0] for s in bags.members], np.int32)
    columns = {"doc": pa.array([doc] * len(a), pa.binary()), ends[0]: pa.array(first[a]), ends[1]: pa.array(first[b])}
    columns |= {name: pa.array(x) for name, x in figures.items()}
    columns |= {f"sents_{name}": members.take(pa.array(x)) for name, x in zip(ends, (a, b))}
    return pa.record_batch(list(columns.values()), list(columns))


def part_pairs(threshold: float):
    """For ``mapInArrow`` over parts: the similar pairs of the bags of a part and later ones, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, bags, first, last in _numbered_parts(batches):
            m = bags.m.astype(np.int32)
            for i, j, x in blocks(bags, threshold, rows=(first, last)):
                i, j, x = (c[i < j] for c in (i, j, x))
                yield _batch(doc, bags, ("i", "j"), i, j, m_i=m[i], m_j=m[j], similarity=x)

    return run


def part_edges(threshold: float):
    """For ``mapInArrow`` over parts: the edges from the bags of a part, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, bags, first, last in _numbered_parts(batches):
            weighted = np.bincount(bags.node, minlength=len(bags.m)) > 0
            degree = np.where(weighted, bags.m, 0)
            own = np.flatnonzero(weighted[first:last]) + first
            for src, dst, _ in blocks(bags, threshold, rows=(first, last)):  # holds all edges of its bags
                degree += np.bincount(src, bags.m[dst], len(bags.m)).astype(np.int64)
                yield _batch(doc, bags, ("src", "dst"), src, dst, degree=degree[src], share=bags.m[src] / degree[src])
            yield _batch(doc, bags, ("src", "dst"), own, own, degree=degree[own], share=bags.m[own] / degree[own])

    return run


# Ship these functions to the executors with the plan, so that a worker needs no
# installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
