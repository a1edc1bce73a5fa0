import math

import pytest
from pyspark.sql import functions as F

from gistworks.operators import sampling


@pytest.fixture
def narrow(monkeypatch):
    """Force the narrowing rounds on small tables."""
    monkeypatch.setattr(sampling, "RANKED", 20)
    monkeypatch.setattr(sampling, "SAMPLE", 60)


@pytest.mark.parametrize("n", [1, 7, 333, 700, 999])
def test_cut_is_the_nth_key(spark, narrow, n):
    keys = [(i * 7919) % 1000 for i in range(1000)]
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    (cut,) = sampling.find_cuts(df, F.struct("k"), [n])
    assert (cut.place.k, cut.below, cut.there) == (n - 1, n - 1, 1)
    assert sampling.take_first(df, F.col("k"), n).count() == n


@pytest.mark.parametrize("n", [100, 350, 500, 650])
def test_cut_with_a_hot_key(spark, narrow, n):
    """A third of all rows share one key."""
    keys = sorted([300] * 333 + [k for k in range(667)])
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    got = sorted(r.k for r in sampling.take_first(df, F.col("k"), n).collect())
    assert got == keys[:n]


def test_all_keys_equal(spark, narrow):
    df = spark.createDataFrame([(1, i) for i in range(100)], "k int, v int")
    assert sampling.take_first(df, F.col("k"), 30).count() == 30


def test_fraction_and_sample(spark):
    df = spark.range(100)
    assert sorted(r.id for r in sampling.first_fraction(df).collect()) == list(range(33))
    first, again = (sorted(r.id for r in sampling.sample_rows(df, 10).collect()) for _ in range(2))
    assert first == again and len(set(first)) == 10
    assert sorted(r.id for r in sampling.sample_rows(df, 10, seed=1).collect()) != first
    assert sampling.sample_rows(df, 500).count() == 100


@pytest.mark.parametrize(("zeros", "ones"), [(90, 10), (5, 20), (7, 0)])
def test_balance(spark, zeros, ones):
    df = spark.range(zeros + ones).withColumn("label", (F.col("id") < ones).cast("int"))
    counts = dict(sampling.balance_classes(df, ["id"]).groupBy("label").count().collect())
    assert counts.get(0, 0) == min(zeros, ones) and counts.get(1, 0) == ones


def test_stratified_split(spark, narrow):
    df = spark.range(203).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    split = sampling.stratified_split(df, ["id"])
    assert split.count() == 203 and split.select("id").distinct().count() == 203
    got = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    for label, size in ((0, 152), (1, 51)):
        held = math.ceil(size / 5)
        assert got[label, "validation"] == math.ceil(held / 2)
        assert got[label, "test"] == held - math.ceil(held / 2)
        assert got[label, "train"] == size - held


def test_train_eval_split(spark):
    got = dict(sampling.train_eval_split(spark.range(500)).groupBy("split").count().collect())
    assert got == {"train": 80, "eval": 20}


def test_split_of_repeated_keys(spark, narrow):
    """900 rows of one class, a third of which share an id; once they differ, once they are equal."""
    for third in ("id % 3 = 0", "id < 300"):
        ids = spark.range(900).selectExpr(f"if({third}, -1, id) AS id", "0 AS label", f"if({third}, 7, id) AS v", "id AS n")
        for df in (ids.drop("n"), ids):
            split = sampling.stratified_split(df, ["id"])
            assert dict(split.groupBy("split").count().collect()) == {"train": 720, "validation": 90, "test": 90}
            assert split.drop("split").exceptAll(df).isEmpty() and split.count() == 900
    got = dict(sampling.train_eval_split(ids.drop("n"), rows=600).groupBy("split").count().collect())
    assert got == {"train": 480, "eval": 120}


def test_null_keys_are_rows(spark, narrow):
    df = spark.range(90).selectExpr("if(id < 30, null, id) AS id", "id AS v", "cast(null as int) AS label")
    first = sampling.first_fraction(df)
    assert sorted(r.v for r in first.collect()) == list(range(30))
    assert sampling.sample_rows(df, 40).count() == 40
    assert sampling.stratified_split(df, ["id"]).groupBy("split").count().count() == 3


def test_reruns_agree_on_repeated_keys(spark, narrow):
    df = spark.range(300).selectExpr("id % 4 AS id", "id AS v")
    a, b = (sorted(r.v for r in sampling.sample_rows(df.repartition(k), 77).collect()) for k in (2, 5))
    assert a == b and len(a) == 77


def test_empty_tables(spark):
    df = spark.range(0).selectExpr("id", "1 AS label")
    assert sampling.stratified_split(df, ["id"]).collect() == []
    assert sampling.train_eval_split(df).collect() == []
    assert sampling.balance_classes(df, ["id"]).collect() == []
    assert sampling.first_fraction(df).collect() == []


def test_a_place_is_computed_once(spark):
    """The order of a row is hashed once, however many cuts it is compared with."""
    df = spark.range(500).withColumn("label", F.col("id") % 2)
    split = sampling.stratified_split(df, ["id"])
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and split.columns == ["id", "label", "split"]


def test_a_range_is_narrowed_around_its_cuts():
    """A sample leaves the places between which a cut most likely lies, not an even share of all."""
    found = list(range(4096))
    low, high = sampling._around(found, [0.5])
    assert low < 2048 < high and high - low < 4096 / 16
    assert sampling._around(found, [1.0]) == [4095] and sampling._around([7, 7, 7], [0.5]) == [7]
    assert len(sampling._around(found, [0.1, 0.2, 0.6, 0.7])) == 8


def test_all_ranges_are_narrowed_in_one_pass(spark, monkeypatch):
    """A round reads the rows twice, for a sample and for counts, however many cuts are apart."""
    monkeypatch.setattr(sampling, "RANKED", 50)
    monkeypatch.setattr(sampling, "SAMPLE", 200)
    df = spark.range(4000).withColumn("k", F.md5(F.col("id").cast("string")))
    rounds = []
    monkeypatch.setattr(sampling, "_around", lambda found, shares, whole=sampling._around: rounds.append(len(shares)) or whole(found, shares))
    passes = []
    kind = type(df)
    monkeypatch.setattr(kind, "collect", lambda self, plain=kind.collect: passes.append(1) or plain(self))
    ns = [400, 1200, 2000, 3600]
    found = sampling.find_cuts(df, F.struct("k"), ns, 4000)
    monkeypatch.undo()
    expected = sorted(r.k for r in df.collect())
    assert [c.place[0] for c in found] == [expected[n - 1] for n in ns] and [c.below for c in found] == [n - 1 for n in ns]
    assert rounds[0] == 4 and len(rounds) >= 5 and len(passes) < 2 * len(rounds) + 1
