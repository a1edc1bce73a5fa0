"""What the plans of the registered queries may and may not contain."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF
from gistworks.functions import text
from gistworks.operators import extract, lexrank
from gistworks.plans import views
from gistworks.plans.queries import QUERIES

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_row_python(spark, name):
    shown = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in shown


def test_lexrank_windows_go_over_one_sentence(spark):
    """Terms, degrees and documents are grouped sums, and no text is sorted."""
    articles = views.articles(spark, SF)
    found = lexrank.nodes(articles, text.split_paragraph_sentences(F.col("article")), text.letter_words)
    counted = lexrank.frequencies(lexrank.term_counts(found)).withColumn("w", F.col("tf") * F.col("idf"))
    weights = lexrank.unit_weights(counted)
    shown = plan(lexrank.transitions(weights, lexrank.similarities(weights)))
    assert "article#" not in "".join(line for line in shown.splitlines() if "Sort " in line or "SortAggregate" in line)
    for line in shown.splitlines():
        if "Window [" in line:
            assert re.search(r"\], \[doc#\d+, (n#\d+, bag#\d+|node#\d+)\]", line), line


def test_flagship_does_not_shuffle(spark):
    """Only the spreading of a small file moves rows."""
    articles = views.articles(spark, SF)
    assert plan(extract.pseudo_summaries(articles)).count("Exchange") == plan(articles).count("Exchange")


def test_scans_are_pruned_and_filtered(spark):
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan(QUERIES["point_lookup"](spark, SF))
    counted = plan(QUERIES["keyword_counts"](spark, SF))
    assert "ReadSchema: struct<lang:string,source:string>" in counted


def test_rank_limit_runs_before_the_shuffle(spark):
    assert plan(QUERIES["threshold_topk"](spark, SF)).count("WindowGroupLimit") == 2
