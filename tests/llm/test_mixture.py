"""Targets, taken words and training positions against brute force."""

import math
import random

from gistworks.llm import mixture
from gistworks.llm.mixture import LARGE_PART


def targets(sizes, weights=(5, 2, 1), share=1.5):
    """The rule taken literally: cut those above their bound, share the rest anew."""
    sources = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        heavy = sum(weight[s] for s in sources if s not in full)
        found = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / heavy for s in sources}
        above = {s for s in sources if s not in full and found[s] > 2 * sizes[s]}
        if not above:
            return found
        full |= above


def table(documents, seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["B", "é", "zz", None, ""])
        rows.append((i, " ".join(["w"] * int(rng.expovariate(0.02))), "en", source))
    rows.append((n, None, "en", "nothing"))
    return rows, documents(rows)


def test_targets_and_taken(documents, clashing):
    rows, df = table(documents)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    expected = targets(sizes)
    found = [r.asDict() for r in mixture.plan(clashing(df)).collect()]
    assert len(found) == len(rows)
    for source, target in expected.items():
        own = [r for r in found if r["source"] == source]
        assert all(math.isclose(r["target"], target, abs_tol=1e-6) and r["source_size"] == sizes[source] for r in own)
        slack = max([r["size"] for r in own if r["size"] * LARGE_PART <= sizes[source]], default=0)
        slack = max(slack, min([r["size"] for r in own if r["size"]], default=0))
        assert abs(sum(r["taken"] for r in own) - target) <= slack / 2 + 1
    assert all(0 <= r["taken"] <= 2 * r["size"] and len(r["positions"]) * r["size"] == r["taken"] for r in found)
    again = [r.asDict() for r in mixture.plan(df.repartition(7)).collect()]
    key = lambda r: r["doc_id"]
    assert sorted(found, key=key) == sorted(again, key=key)


def test_buckets_do_not_change_the_order(documents, monkeypatch):
    _, df = table(documents)
    one = sorted(map(tuple, mixture.plan(df).collect()), key=lambda r: r[0])
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 7)
    assert sorted(map(tuple, mixture.plan(df).collect()), key=lambda r: r[0]) == one


def test_positions_follow_the_schedules(documents):
    """Up to any time, a source has met the integral of its weight."""
    _, df = table(documents, n=900)
    found = mixture.plan(df).collect()
    sources = sorted({r.source for r in found if r.source is not None}, key=lambda s: s.encode()) + [None]
    for rank, source in enumerate(sources):
        slope = mixture.SLOPES[rank % 3]
        copies = sorted((p, r.size) for r in found if r.source == source for p in r.positions)
        total, largest = sum(s for _, s in copies), max([s for _, s in copies], default=0)
        before = 0
        for p, size in copies:
            assert abs(total * ((1 - slope) * p + slope * p * p) - (before + size / 2)) <= 1e-6 * total + 1e-6
            before += size
        assert before == total and (not copies or largest <= total)


def test_mixed_rows(documents, clashing):
    _, df = table(documents, n=120)
    wide = clashing(df)
    taken = {r.doc_id: len(r.positions) for r in mixture.plan(df).collect()}
    mixed = mixture.mixed(wide)
    assert mixed.columns == wide.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in taken.items() if n}


def test_edges(documents):
    assert mixture.plan(documents([])).collect() == []
    assert mixture.mixed(documents([])).collect() == []
    found = mixture.plan(documents([(1, None, "en", "a"), (2, "", "en", None), (None, " ", None, None)])).collect()
    assert [(r.size, r.target, r.taken, r.positions) for r in found] == [(0, 0.0, 0, [])] * 3
    rows = [(1, "a b c", "en", "s")] * 4 + [(None, "a b", "en", "s")]
    found = mixture.plan(documents(rows)).collect()
    assert len(found) == 5 and {r.target for r in found} == {21.0}
    assert abs(sum(r.taken for r in found) - 21) <= 2


def test_no_python_in_the_plan(documents):
    for build in (mixture.plan, mixture.mixed):
        plan = build(documents([(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mixed_gives_every_planned_copy_of_repeated_and_unnamed_rows(documents):
    """Repeated rows, unlike rows of one doc_id and rows without one come as often as the plan says."""
    same, other = "w " * 100, "v " * 100
    cases = [
        [(7, same, "en", "a"), (7, same, "en", "a"), (7, same, "en", "a"), (8, "u " * 100, "en", "a")],
        [(7, same, "en", "a"), (7, other, "en", "a"), (None, same, "en", "a"), (None, other, "de", "a"), (None, other, "en", "b"), (9, "", "en", "b"), (9, None, "en", None)],
        [(i % 3, f"x{i % 5} " * (20 + i % 4), "en", "abc"[i % 3]) for i in range(60)],
    ]
    for rows in cases:
        df = documents(rows)
        planned, got = {}, {}
        for r in mixture.plan(df).collect():
            planned[r.doc_id, r.source, r.text_hash] = planned.get((r.doc_id, r.source, r.text_hash), 0) + len(r.positions)
        for r in mixture.mixed(df).selectExpr("doc_id", "source", "xxhash64(text) AS text_hash").collect():
            got[r.doc_id, r.source, r.text_hash] = got.get((r.doc_id, r.source, r.text_hash), 0) + 1
        assert got == {k: n for k, n in planned.items() if n}
        assert sum(got.values()) > 0
