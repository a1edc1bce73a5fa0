"""Quality rules against brute force."""

import re
from collections import Counter

import pytest

from gistworks.llm import rules

JUNK = "Th!! EA!! "


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    chars = sum(map(len, words))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    dup = len(lines) - len(set(lines))
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    more = (
        100 * symbols > 5 * chars or 2 * dup > len(lines) or 100 * len(re.findall("[A-Z]", text)) > 30 * chars
        or 100 * text.count("!") > 5 * chars or chars > 15 * len(words) or chars < 2 * len(words)
    )
    return (len(words), chars, symbols, dup, len(covered), base, not base and not more)


w = [f"word{i}" for i in range(60)]
TEXTS = [
    None, "", " \n\t\x0b ", "one", " ".join(w[:19]), " ".join(w[:20]), "\x0b" + "\x0c".join(w[:30]) + "\r", " ".join(w[:8] * 2 + w), " ".join(w[:7] * 2 + w),
    " ".join(["a"] * 50), " ".join(w + w[10:30]), "x\ny\nx\n" * 20, "same line here\n" * 30, "\n".join(["  ", "a b", "a b ", "a b", ""] * 9),
    " ".join(x + "%%%" for x in w), " ".join(x.upper() for x in w), " ".join(x + "!" for x in w), " | ".join(w), " ".join(["é" * 20] * 3 + ["ß" * 18 + str(i) for i in range(30)]),
    " ".join("abcdefghijklmnopqrstuvwxyz"), "𝒳 # * $ % & | < >" + " ".join(w), " ".join(f"v{i}" for i in range(40_000)), " ".join(["r s t u v w x y z"] * 4000),
]


def test_figures_and_verdict(documents, clashing):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, TEXTS[6])]
    expected = sorted([(i, *brute(t)) for i, t in rows], key=repr)
    for df in (documents(rows), clashing(documents(rows))):
        assert sorted([tuple(r) for r in rules.report(df).collect()], key=repr) == expected


def test_kept_is_the_verdict(documents, clashing):
    rows = list(enumerate(TEXTS))
    df = clashing(documents(rows))
    kept = rules.kept(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in rows if brute(t)[-1]]


def test_empty_table(documents):
    assert rules.report(documents([])).collect() == []
    assert rules.kept(documents([])).collect() == []


def test_order_by_rejection_per_cost(monkeypatch):
    one, two, three = rules.MORE[:3]
    monkeypatch.setattr(rules, "estimate", lambda docs, given: [(one, 2.0, 0.2), (two, 0.1, 0.1), (three, 1.0, 0.0)])
    assert rules.cascade(None, (one, two, three)) == [two, one, three]


def test_any_order_gives_the_same_verdict(spark, documents):
    from pyspark.sql import functions as F

    from gistworks.llm.columns import words

    df = documents(list(enumerate(TEXTS))).withColumn("found", words(F.col("text")))
    every = rules.BASE + rules.MORE
    a, b = (df.select("doc_id", rules.rejected(order, F.col("text"), F.col("found")).alias("r")) for order in (every, every[::-1]))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("build", [rules.report, rules.kept])
def test_no_python_in_the_plan(documents, build):
    plan = build(documents([(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
