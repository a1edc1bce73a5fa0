"""Near duplicates against brute force."""

import random
import re

from gistworks.llm import jaccard


def shingles(text, size=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and sets[i]:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted([(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)], key=repr)


def run(documents, rows):
    return sorted([tuple(r) for r in jaccard.near_duplicates(documents(rows)).collect()], key=repr)


def test_edges(documents):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "One two  three\nfour"),
        (8, "a b c d e"), (8, "a b c d e"), (9, "a b c d e f"), (None, "a b c d e"), (None, None), (10, "a a a a a a a a"),
        (11, "a a a a a"), (12, long), (13, long + " tail"), (14, "été Été É a"), (15, "été été é a"),
    ]
    assert run(documents, rows) == brute(rows)


def test_chain_of_near_copies(documents):
    """Every document is near its neighbours only, so one component spans all."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(30)]
    found = run(documents, rows)
    assert found == brute(rows)
    assert {r[2] for r in found} == {0}


def test_random_copies(documents):
    rng = random.Random(3)
    passage = " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(40))
    rows = []
    for i in range(260):
        if i < 20 or rng.random() < 0.3:
            words = [f"{rng.choice('abc')}{rng.randrange(400)}" for _ in range(rng.randrange(3, 90))]
            if rng.random() < 0.5:
                words += passage.split()
        else:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(9)}"
        rows.append((1000 - i, " ".join(words)))
    assert run(documents, rows) == brute(rows)


def test_empty_table_and_other_columns(documents, clashing):
    assert run(documents, []) == []
    rows = [(1, "a b c d e f"), (2, "a b c d e f")]
    assert sorted(tuple(r) for r in jaccard.near_duplicates(clashing(documents(rows))).collect()) == [(1, 2, 1), (2, 2, 1)]


def test_one_of_each(documents, clashing):
    rows = [(3, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (5, None), (None, "a b c d e f"), (7, "other words here")]
    kept = jaccard.one_of_each(clashing(documents(rows)))
    assert kept.columns == clashing(documents(rows)).columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted([(2, "A b c d e f"), (5, None), (7, "other words here")], key=repr)


def test_one_of_each_with_shared_and_missing_ids(documents):
    """Each group leaves one row, by its smallest doc_id, and unlike rows of one doc_id stay."""
    copied, alone = "a b c d e f", "some words that nobody else has written"
    unnamed = "copies of a row without any name at all"
    rows = [
        (1, copied), (5, copied.upper()), (5, alone), (6, alone.upper()), (7, "x y z"), (7, "u v w"), (7, None), (7, "x y z"),
        (None, unnamed), (None, unnamed), (None, unnamed.upper()), (None, "another row without a name"), (None, copied),
    ]
    frame = documents(rows)
    kept, again = (sorted([(r.doc_id, r.text.lower() if r.text else None) for r in jaccard.one_of_each(f).collect()], key=repr) for f in (frame, frame.repartition(7, "text")))
    assert kept == again == sorted(
        [(1, copied), (5, alone), (7, "x y z"), (7, "u v w"), (7, None), (None, unnamed), (None, "another row without a name")], key=repr
    )


def test_one_of_each_keeps_columns_of_any_name_and_kind(spark):
    """Rows that differ in a map alone are two rows of one text; columns named as the operator's own come back."""
    rows = [(1, "a b c d e f", {"k": "v"}, "x", 3), (1, "a b c d e f", {"k": "w"}, "y", 4), (None, "a b c d e f", None, "z", 5), (2, "other words", {}, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, about map<string,string>, row_ string, own int")
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    found = sorted((r.doc_id, r.row_, r.own) for r in kept.collect() if r.doc_id == 1)
    assert len(found) == 1 and found[0] in [(1, "x", 3), (1, "y", 4)]
    assert {r.doc_id for r in kept.collect()} == {1, 2}


def test_all_links_inside_a_component(documents, monkeypatch):
    """Every link between different texts of a group is counted, also where its lists are cut into cells."""
    monkeypatch.setattr(jaccard, "CELL", 7)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[: 120 - rng.randrange(30)] + [f"x{i % 35}"] * (i % 2))) for i in range(50)] + [(90, None), (91, "alone here"), (None, " ".join(words))]
    sets = [shingles(t) for _, t in rows]
    expected = [(doc, sum(100 * len(a & b) >= 80 * len(a | b) for b in set(sets) if b and b != a) if a else 0) for (doc, _), a in zip(rows, sets, strict=True)]
    assert sorted([tuple(r) for r in jaccard.link_counts(documents(rows)).collect()], key=repr) == sorted(expected, key=repr)
    assert max(n for _, n in expected) > 20
