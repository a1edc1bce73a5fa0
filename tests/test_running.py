"""Figures of a running job, damaged records, partitioned corpora and merged sketches."""

import json
import random

from pyspark.sql import functions as F

from gistworks.operators import labels, observed, sketches
from gistworks.plans import jobs
from gistworks.sources import corpus


def joined(spark):
    rows = [
        ("1", "Dogs run. Fish swim.", "Cats sleep. Dogs run. Fish swim. Birds sing."),
        ("2", "Dogs fly.", "Cats sleep. Dogs run."),
        ("3", "", ""),
        ("4", None, "Only here."),
    ]
    return spark.createDataFrame(rows, "id string, article string, article_whole string")


def test_report_comes_with_the_write(spark, tmp_path):
    labelled, watch = observed.labelled_with_report(joined(spark))
    labelled.write.parquet(str(tmp_path / "labels"))
    assert watch.get == {"articles": 4, "article_sentences": 7, "pseudo_sentences": 3, "class_1": 2, "missing_sentences": 1, "inconsistent_articles": 1, "longest": 4}
    same = sorted(map(tuple, labels.binary_labels(joined(spark)).collect()), key=repr)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "labels")).collect()), key=repr) == same


def test_report_reads_its_input_once(spark):
    labelled, _ = observed.labelled_with_report(joined(spark).repartition(2))
    plan = labelled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CollectMetrics") == 1 and plan.count("Scan ExistingRDD") <= 1 and "Join" not in plan


def test_report_of_nothing(spark, tmp_path):
    labelled, watch = observed.labelled_with_report(joined(spark).limit(0))
    labelled.write.parquet(str(tmp_path / "labels"))
    assert set(watch.get.values()) == {0}


def test_job_returns_path_and_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Cats sleep. Dogs run.", "x"), ("b", "Fish swim.", "y")], "id string, article string, lay_summary string")
    for folder in ("pseudo", "whole"):
        corpus.write_articles(rows, corpus.corpus_path(str(tmp_path / folder), "eLife", "train"))
    path, report = jobs.label_with_report(spark, str(tmp_path / "pseudo"), str(tmp_path / "whole"), str(tmp_path / "out"), "eLife")
    assert report["articles"] == 2 and report["class_1"] == 3 == corpus.read_sentences(spark, path).where("label = 1").count()


def test_damaged_json_lines_are_kept_apart(spark, tmp_path):
    good = [{"id": str(i), "article": f"Text {i}.", "lay_summary": None, "headings": ["a"], "keywords": []} for i in range(5)]
    bad = ['{"id": "x", "article": "cut', "no json", '{"id": "y", "headings": "not a list"}', "[1, 2"]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one.jsonl").write_text("\n".join([json.dumps(good[0]), bad[0], json.dumps(good[1]), bad[1], ""]))
    (tmp_path / "raw" / "two.jsonl").write_text("\n".join([bad[2], *map(json.dumps, good[2:]), "", bad[3]]) + "\n")
    counted = corpus.quarantine_articles(spark, str(tmp_path / "raw"), str(tmp_path / "good"), str(tmp_path / "bad"))
    assert counted == {"good": 5, "bad": 4}
    kept = spark.read.parquet(str(tmp_path / "good"))
    assert sorted(r.id for r in kept.collect()) == [str(i) for i in range(5)] and kept.columns == [f.name for f in corpus.ARTICLE_SCHEMA]
    lost = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert sorted(r.line for r in lost) == sorted(bad)
    assert {r.line: r.file.rsplit("/", 1)[1] for r in lost} == {bad[0]: "one.jsonl", bad[1]: "one.jsonl", bad[2]: "two.jsonl", bad[3]: "two.jsonl"}
    assert {r.block_start for r in lost} == {0}


def test_damaged_csv_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "raw.csv").write_text('id,sent_idx,sentence,label\na,0,"One, two.",1\nb,x,Three.,0\nc,1,Four.\nd,2,Five.,0,more\ne,3,Six.,1\n')
    counted = corpus.quarantine_sentences(spark, str(tmp_path / "raw.csv"), str(tmp_path / "good"), str(tmp_path / "bad"))
    assert counted == {"good": 2, "bad": 3}
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "good")).collect())) == [("a", 0, "One, two.", 1), ("e", 3, "Six.", 1)]
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["b,x,Three.,0", "c,1,Four.", "d,2,Five.,0,more"]


def test_a_split_is_written_anew_and_the_others_stay(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(str(i), f"Text {i}.", "old", c, s) for i in range(30) for c, s in [(("eLife", "PLOS")[i % 2], ("train", "val")[i % 3 == 0])]]
    df = spark.createDataFrame(rows, "id string, article string, lay_summary string, corpus string, split string")
    corpus.write_partitions(df, path, rows_per_file=4)
    corpus.write_partitions(df.where("corpus = 'PLOS' AND split = 'val'").withColumn("lay_summary", F.lit("new")), path)
    got = {(r.id, r.corpus, r.split): r.lay_summary for r in corpus.read_partitions(spark, path).collect()}
    assert got == {(i, c, s): "new" if (c, s) == ("PLOS", "val") else "old" for i, _, _, c, s in rows}
    files = list((tmp_path / "table" / "corpus=eLife" / "split=train").glob("*.parquet"))
    assert 3 <= len(files) <= 5  # ten rows, no more than four in a file
    one = corpus.read_partitions(spark, path, "PLOS", "val")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(corpus" in plan and "split" in plan.split("PartitionFilters:")[1].split("]")[0]
    read = {r[0] for r in one.select(F.input_file_name()).collect()}
    assert len(read) == len(list((tmp_path / "table" / "corpus=PLOS" / "split=val").glob("*.parquet")))


def test_sketches_of_parts_answer_for_the_whole(spark):
    rng = random.Random(4)
    values = [int(rng.lognormvariate(5, 1)) for _ in range(20_000)]
    df = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)] + [(8, None)], "part int, size int").repartition(5)
    table = sketches.sketched(df, ["part"], size=F.col("size"))
    whole = sketches.merged(table)
    assert whole.first()["n"] == len(values)
    answers = sketches.quantiles(whole, [0.1, 0.5, 0.75, 0.99])
    checked = sketches.rank_errors(answers, df, size=F.col("size")).collect()
    assert len(checked) == 4 and max(r.error for r in checked) <= sketches.RANK_ERROR
    some = sketches.merged(table.where("part < 3"), ["measure"]).first()["n"]
    assert some == sum(i % 7 < 3 for i in range(len(values)))
    shares = sketches.histogram(whole, [-1, 50, 150, 500, 10**9]).collect()
    for r in shares:
        assert abs(r.share - sum(r.low < v <= r.high for v in values) / len(values)) <= 2 * sketches.RANK_ERROR
    assert abs(sum(r.share for r in shares) - 1) < 1e-9


def test_sketches_of_nothing(spark):
    empty = spark.createDataFrame([], "part int, size int")
    assert sketches.quantiles(sketches.merged(sketches.sketched(empty, ["part"], size=F.col("size"))), [0.5]).collect() == []
    nulls = spark.createDataFrame([(1, None)], "part int, size int")
    assert sketches.quantiles(sketches.merged(sketches.sketched(nulls, ["part"], size=F.col("size"))), [0.5]).collect() == []


def test_files_of_a_partition_follow_the_length_of_its_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "CHARS_PER_FILE", 1000)
    df = spark.createDataFrame([(str(i), "x" * 200, None, "eLife", "train") for i in range(50)], "id string, article string, lay_summary string, corpus string, split string")
    assert [r["_files"] for r in corpus._files(df, 200_000).collect()] == [10]  # and as many groups of rows, each for one task
    corpus.write_partitions(df, str(tmp_path / "table"))
    assert corpus.read_partitions(spark, str(tmp_path / "table")).count() == 50
