import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistworks.functions import graphs
from gistworks.operators import lexrank

STOP = set(lexrank.ENGLISH)
ARTICLES = [
    (1, "Red cats chase grey mice. Grey mice fear red cats. Dogs bark. Red cats sleep all day. Mice eat cheese.", ""),
    (2, "Only one sentence here.", ""),
    (3, "Alpha beta. Gamma delta.", ""),
    (4, "Alpha beta. Alpha gamma.", ""),
    (5, "Same line here.\n\nSame line here.\n\nSame line here.\n\nOther words follow.\n\nOther line follows.", ""),
    (6, "", ""),
    (7, ". ".join(f"Word{chr(97 + i % 5)} common thing{chr(97 + i % 3)} item{chr(97 + i % 7)}" for i in range(40)), ""),
]


def split(article):
    return [s for s in article.replace("\n\n", " ").replace(". ", ".\n").split("\n") if s.strip()]


def plain_scores(sentences):
    """LexRank straight from its definition, over all sentence pairs."""
    bags = [Counter(w for w in s.lower().replace(".", "").split() if w not in STOP) for s in sentences]
    n = len(bags)
    idf = {w: math.log(n / (1 + sum(w in b for b in bags))) for b in bags for w in b}
    weights = [{w: c / max(b.values()) * idf[w] for w, c in b.items()} for b in bags]
    norms = [math.sqrt(sum(x * x for x in w.values())) for w in weights]
    m = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            if norms[i] and norms[j]:
                dot = sum(x * weights[j].get(w, 0.0) for w, x in weights[i].items())
                m[i, j] = round(dot / norms[i] / norms[j], 9) > 0.1
    m /= np.maximum(m.sum(axis=1, keepdims=True), 1)
    p = np.full(n, 1 / n)
    while True:
        q = m.T @ p
        if np.linalg.norm(q - p) <= 0.1:
            return q
        p = q


def scores_by_id(df, scored):
    ids = lexrank.with_document_key(df).select("id", "doc")
    rows = ids.join(scored, "doc").collect()
    found = {}
    for r in rows:
        found.setdefault(r.id, {})[r.sent_idx] = r.score
    return found


def check_standard(make_articles):
    df = make_articles(ARTICLES)
    found = scores_by_id(df, lexrank.sentence_scores(df))
    for i, article, _ in ARTICLES:
        sentences = split(article)
        got = found.get(str(i), {})
        assert len(got) == len(sentences)
        if sentences:
            assert np.allclose([got[k] for k in range(len(sentences))], plain_scores(sentences), atol=1e-8), i


def test_scores_against_definition(make_articles):
    check_standard(make_articles)


def test_copies_and_repeated_ids(make_articles):
    rows = [(1, "Cats sleep. Dogs run.", "x"), (1, "Fish swim. Birds sing.", "y")] + [(k, ARTICLES[0][1], "z") for k in range(2, 9)]
    result = lexrank.summaries(make_articles(rows), 1).collect()
    assert len(result) == len(rows)
    assert sorted(r.article for r in result if r.id == "1") == ["Cats sleep.", "Fish swim."]
    assert len({r.article for r in result if r.id != "1"}) == 1


def test_summary_size_and_empty(make_articles):
    result = {r.id: r.article for r in lexrank.summaries(make_articles(ARTICLES), 2).collect()}
    assert result["6"] == "" and result["3"] == "Alpha beta. Gamma delta."
    assert len(split(result["1"])) == 2


BACKGROUND = [(1, "abstract\nRed cats chase mice. Mice fear cats. Dogs bark loud", "red cats"), (2, "x\na b. b c. c d. e", "mice bark a")]


@pytest.mark.parametrize("continuous", [False, True])
def test_background_scores_are_power_method_limits(make_articles, continuous):
    df = make_articles(BACKGROUND)
    run = lexrank.continuous_scores if continuous else lexrank.background_scores
    found = scores_by_id(df, run(df, df, "lay_summary"))
    bags = [set(s.lower().split()) for _, _, s in BACKGROUND]
    for i, article, _ in BACKGROUND:
        sentences = [Counter(s.lower().split()) for s in article.split("\n", 1)[1].split(".")]
        weight = lambda w: math.log(2 / k) if (k := sum(w in b for b in bags)) else math.log(3)
        vectors = [{w: c * weight(w) for w, c in s.items()} for s in sentences]
        n = len(vectors)
        m = np.eye(n)
        for a in range(n):
            for b in range(n):
                na, nb = (math.sqrt(sum(x * x for x in v.values())) for v in (vectors[a], vectors[b]))
                if a != b and na and nb:
                    m[a, b] = sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items()) / na / nb
        if not continuous:
            m = (m >= 0.1).astype(float)
        m /= m.sum(axis=1, keepdims=True)
        p = np.ones(n)
        for _ in range(5000):
            p = m.T @ p
        assert np.allclose([found[str(i)][k] for k in range(n)], p, atol=1e-6)


def test_components_reach_far(spark):
    """A chain keeps one label however long it is."""
    chain = spark.range(12).select(
        F.lit("d").alias("doc"), F.col("id").alias("grp"), F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("node")
    )
    labels = lexrank.components(chain).collect()
    assert len(labels) == 13 and {r.label for r in labels} == {0}


def test_long_chain_has_one_component(spark):
    """A thousand nodes, each in a group with the next one only, take few rounds."""
    members = spark.range(1000).selectExpr("'d' AS doc", "id AS grp", "explode(array(cast(id AS int), cast(least(id + 1, 999) AS int))) AS node")
    apart = spark.range(4).selectExpr("'e' AS doc", "id AS grp", "cast(id AS int) AS node")
    start = time.time()
    found = lexrank.components(members.union(apart)).collect()
    assert len(found) == 1004 and all(r.label == (0 if r.doc == "d" else r.node) for r in found)
    assert time.time() - start < 60


def test_long_documents_go_in_blocks_with_the_same_result(spark, make_articles, monkeypatch):
    """Documents beyond a cell are cut into blocks; the pairs and scores are those of one cell."""
    words = "red green blue white black small large round".split()
    long = " ".join(f"The {words[i % 8]} {words[i * 3 % 7]} fox {'jumps' if i % 2 else 'sleeps'} near house {words[i % 5]}." for i in range(41))
    articles = make_articles([(1, long, "x"), (2, "One red fox. Two red foxes. A red fox again.", "y"), (3, "", "z")])

    def rows():
        _, weights, similar = lexrank.graph(articles, lexrank.ENGLISH)
        scores = lexrank.sentence_scores(articles)
        return sorted(map(tuple, similar.collect())), sorted(map(tuple, scores.collect()))

    whole = rows()
    monkeypatch.setattr(lexrank, "CELL", 4)
    assert rows() == whole and len(whole[0]) > 50


def test_background_scores_are_the_same_by_rows_and_by_joins(make_articles, monkeypatch):
    """Neither the bound on sentences of a row nor that on listed words changes a score."""
    df = make_articles([*BACKGROUND, (3, "x\n" + ". ".join(f"cats {chr(97 + i % 5)} mice {chr(97 + i % 3)} z{chr(97 + i)}" for i in range(12)), "dogs b")])

    def rows():
        runs = [lexrank.background_scores(df, df, "lay_summary"), lexrank.continuous_scores(df, df, "lay_summary")]
        return [sorted((bytes(r.doc), r.sent_idx, round(r.score, 8)) for r in run.collect()) for run in runs]

    whole = rows()
    monkeypatch.setattr(lexrank, "LISTED", 2)
    assert rows() == whole
    monkeypatch.setattr(lexrank, "CELL", 4)
    assert rows() == whole and all(len(r) > 15 for r in whole)


def test_pairs_are_the_same_in_blocks_of_one_sentence(monkeypatch):
    sentences = [f"red w{i % 3} w{i % 5} w{i % 7}" for i in range(40)]
    whole = [c.tolist() for c in graphs.similar(graphs.standard(sentences), 0.1)]
    monkeypatch.setattr(graphs, "BLOCK", 1)
    assert [c.tolist() for c in graphs.similar(graphs.standard(sentences), 0.1)] == whole and len(whole[0]) > 50


def test_articles_are_ranked_in_their_rows(spark, make_articles):
    """No row of a term or an edge is shuffled, whatever the size of the corpus."""
    df = make_articles(ARTICLES)
    for found in (lexrank.ranked(df), lexrank.summaries(df), lexrank.similar_sentences(df), lexrank.edges(df), lexrank.term_frequencies(df)):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_function_runs_once_though_its_rows_are_exploded(spark, make_articles):
    """Spark filters what it explodes by its size; the function did the work of a row again for that."""
    df = make_articles(ARTICLES)
    scores = F.posexplode("_scores")
    exploded = [
        lexrank.similar_sentences(df), lexrank.edges(df), lexrank.term_frequencies(df), lexrank.inverse_frequencies(df),
        lexrank.ranked(df).select("id", scores), lexrank.background_ranked(df, df, "lay_summary", None).select("id", scores),
    ]
    for found in exploded:
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def starred(n):
    """``n`` different sentences; the first one shares a word with each of the others, which else share little."""
    hub = "Hub " + " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(0, n, 3)) + "."
    return " ".join([hub, *(f"Item w{chr(97 + i // 26)}{chr(97 + i % 26)} v{chr(97 + i % 7)} u{chr(97 + i % 5)}." for i in range(n - 1))])


@pytest.mark.parametrize("n", [40, 160])
def test_no_pair_of_sentences_of_a_long_article_is_written(make_articles, monkeypatch, n):
    """What is written grows with the sentences, not with their pairs; the scores are those of one row."""
    rows = [(1, starred(n), "x"), (2, starred(n), "y"), (3, ARTICLES[0][1], "z"), (4, ARTICLES[6][1], ""), (5, None, "")]
    articles, written, checkpointed = make_articles(rows), [], lexrank.checkpointed
    scores = lambda: sorted((r.id, [round(x, 8) for x in r._scores or []]) for r in lexrank.ranked(articles).select("id", "_scores").collect())
    whole = scores()
    monkeypatch.setattr(lexrank, "CELL", 8)
    monkeypatch.setattr(lexrank, "checkpointed", lambda df: written.append((done := checkpointed(df)).count()) or done)
    assert scores() == whole and len(whole) == 5 and len(whole[0][1]) == n
    assert np.allclose(whole[0][1], plain_scores(split(starred(n))), atol=1e-7)
    assert 0 < sum(written) < n


def test_a_step_finds_the_sums_of_all_pairs():
    """The parts of a document, put together, are its degrees and its power step."""
    sentences = [x.lower().replace(".", "") for x in split(starred(50))] + ["", "alone", "item wab"]
    bags = graphs.standard(sentences)
    i, j, _ = graphs.similar(bags, 0.1)
    src, dst, degree = graphs.linked(bags, i, j)
    found = [np.zeros(0, int)] * 2
    for part in range(7):
        first, last = graphs._range(bags, part, 7)
        pairs = [np.concatenate(c) for c in zip(*((a, b) for a, b, _ in graphs.blocks(bags, 0.1, rows=(first, last))))]
        found = [np.concatenate([x, y]) for x, y in zip(found, pairs)]
    apart = src != dst
    assert sorted(zip(*map(np.ndarray.tolist, found))) == sorted(zip(src[apart].tolist(), dst[apart].tolist())) and apart.sum() > 100


def test_repeated_lines_are_ranked_in_their_row(make_articles, monkeypatch):
    """An article of many sentences of which few differ is not spread."""
    articles = make_articles([(1, "\n\n".join(f"Cats chase mice {'abc'[i % 3]}{'de'[i % 2]}." for i in range(90)), "x")])
    whole = lexrank.ranked(articles).first()._scores
    monkeypatch.setattr(lexrank, "CELL", 8)
    found = lexrank.ranked(articles)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and "Union" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.first()._scores == whole and len(whole) == 90


@pytest.mark.parametrize("run", [lexrank.similar_sentences, lexrank.edges])
def test_pairs_of_a_long_article_are_found_in_parts(make_articles, monkeypatch, run):
    """The pairs and edges are those of one row; nothing but the article is written for them."""
    rows = [(1, starred(60) + " Hub once. Hub once. The.", "x"), (2, starred(60), "y"), (2, starred(60), "y"), (3, ARTICLES[0][1], "z")]
    articles, written, checkpointed = make_articles(rows), [], lexrank.checkpointed
    found = lambda: sorted(tuple(str(r[c]) for c in sorted(r.asDict())) for r in run(articles).collect())
    whole = found()
    monkeypatch.setattr(lexrank, "CELL", 8)
    monkeypatch.setattr(lexrank, "checkpointed", lambda df: written.append((done := checkpointed(df)).count()) or done)
    assert found() == whole and len(whole) > 300
    assert 0 < sum(written) < 10
