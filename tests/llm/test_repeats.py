"""Suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from gistworks.llm import repeats
from gistworks.llm.repeats import Tree


def held_twice(texts, size):
    seen = {}
    for t, text in enumerate(texts):
        for i in range(len(text) - size + 1):
            seen.setdefault(text[i : i + size], []).append((t, i))
    covered = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for t, i in places:
                covered[t].update(range(i, i + size))
    return covered


def maximal(texts, size):
    """Every maximal repeat with all places."""
    places = {}
    for t, text in enumerate(texts):
        for i in range(len(text)):
            for j in range(i + size, len(text) + 1):
                places.setdefault(text[i:j], []).append((t, i))
    out = {}
    for piece, at in places.items():
        left = {texts[t][i - 1] if i else (t, i) for t, i in at}
        right = {texts[t][i + len(piece)] if i + len(piece) < len(texts[t]) else (t, "end") for t, i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            out[piece] = sorted(at)
    return out


def groups(tree, texts):
    places = {}
    for at, repeat in zip(tree.places.tolist(), tree.innermost.tolist(), strict=True):
        t = int(np.searchsorted(tree.bounds, at, "right") - 1)
        while repeat >= 0:
            places.setdefault(repeat, []).append((t, at - int(tree.bounds[t])))
            repeat = tree.repeats[repeat][2]
    out = {}
    for repeat, at in places.items():
        length, count, _ = tree.repeats[repeat]
        assert count == len(at)
        t, i = at[0]
        out[texts[t][i : i + length]] = sorted(at)
    return out


@pytest.mark.parametrize("seed", range(120))
def test_tree(seed):
    rng = random.Random(seed)
    size, letters = rng.choice([1, 2, 3, 5]), b"abc"[: rng.choice([1, 2, 3])]
    texts = [bytes(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(rng.randrange(1, 6))]
    if seed % 3 == 0:
        texts.append(texts[0])
    tree = Tree(texts, size)
    assert groups(tree, texts) == maximal(texts, size)
    covered = [set() for _ in texts]
    for t, a, b in zip(*tree.spans(), strict=True):
        covered[t].update(range(a, b))
    assert covered == held_twice(texts, size)


def test_anchors_depend_on_windows_alone():
    rng = random.Random(2)
    shared = rng.randbytes(repeats.SIZE)
    texts = [rng.randbytes(rng.randrange(400)) + shared + rng.randbytes(rng.randrange(400)) for _ in range(20)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    places, hashes = repeats.anchors(data, offsets)
    inside = []
    for t, text in enumerate(texts):
        begin = offsets[t] + text.index(shared)
        inside.append({int(h) for p, h in zip(places, hashes, strict=True) if begin <= p <= begin + repeats.SIZE - repeats.GRAM})
        for w in range(offsets[t], offsets[t + 1] - repeats.SIZE + 1):
            assert ((places >= w) & (places <= w + repeats.SIZE - repeats.GRAM)).any()
    assert set.intersection(*inside)


def brute(rows):
    texts = [(t or "").encode() for _, t, *_ in rows]
    out = []
    for (doc, *_), text, gone in zip(rows, texts, held_twice(texts, repeats.SIZE), strict=True):
        n_spans = sum(i - 1 not in gone for i in gone)
        kept = bytes(c for i, c in enumerate(text) if i not in gone)
        out.append((doc, len(text), len(gone), n_spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def run(df):
    found = repeats.dedup(df).collect()
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in found], key=repr)


def word(rng):
    return "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))


def text(rng, n):
    return " ".join(word(rng) for _ in range(n))[:n]


def test_edges(documents, clashing):
    rng = random.Random(3)
    base = text(rng, 900)
    rows = [
        (1, None), (2, ""), (3, base[:199]), (4, base[:200]), (5, base), (6, "x" + base[100:301] + "y"), (7, "é" * 150), (8, "z" * 201), (9, "z" * 200), (10, text(rng, 500)),
        (11, "q " + base[300:499] + " r"), (12, base[500:700] + "#" + base[500:700] + "#" + base[650:900]), (13, "short"), (14, "short"), (15, text(rng, 150) * 2),
    ]
    assert run(documents(rows)) == brute(rows)
    assert run(clashing(documents(rows))) == brute(rows)
    assert run(documents([])) == []


def test_repeated_rows_and_rows_without_id(documents):
    rng = random.Random(4)
    a, b = text(rng, 600), text(rng, 600)
    rows = [(1, a), (1, a), (None, b), (2, b[:300] + "!"), (None, None), (3, text(rng, 400)), (3, text(rng, 400))]
    assert run(documents(rows)) == brute(rows)


def test_very_long_texts(documents):
    rng = random.Random(5)
    long = text(rng, 700_000)
    rows = [(1, long), (2, "word " * 100_000), (3, long[400_000:400_300]), (4, "-" * 250_000)]
    found = {r[0]: r[2:4] for r in run(documents(rows))}
    assert found == {1: (len(long[400_000:400_300].encode()), 1), 2: (500_000, 1), 3: (len(long[400_000:400_300].encode()), 1), 4: (250_000, 1)}


def corpus(seed, n):
    rng = random.Random(seed)
    passages = [text(rng, rng.randrange(150, 900)) for _ in range(6)]
    rows = []
    for doc in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [text(rng, rng.randrange(300)), p[a : a + rng.randrange(100, 900)]]
        rows.append((doc * 7 % n, "".join(parts)))
    return rows + [(n + i, rows[0][1]) for i in range(5)]


def test_random_passages(documents):
    rows = corpus(6, 90)
    assert run(documents(rows).repartition(7)) == brute(rows)


def test_hot_passages_in_small_chunks(documents, monkeypatch):
    for name, value in {"SHARD_BYTES": 20_000, "TREE_BYTES": 3_000, "PIECE_BYTES": 500, "PART_BITS": 6, "STRETCH_BITS": 2, "HOT_SHARE": 1_000_000}.items():
        monkeypatch.setattr(repeats, name, value)
    repeats._POWERS.clear()
    rng = random.Random(7)
    shared = text(rng, 260)
    rows = corpus(8, 40) + [(1000 + i, text(rng, 80) + shared + text(rng, 80)) for i in range(60)]
    assert run(documents(rows).repartition(4)) == brute(rows)
    repeats._POWERS.clear()


def test_groups(documents):
    rng = random.Random(9)
    shared = text(rng, 400)
    rows = [(i, text(rng, 250) + shared + text(rng, 250)) for i in range(9)] + [(20, "<" + shared[50:300] + ">")]
    found, places = repeats.repeats(documents(rows))
    found, places = {r.repeat: r for r in found.collect()}, places.collect()
    longest = max(r.length for r in found.values())
    assert longest >= len(shared.encode())
    for r in found.values():
        assert r.length >= repeats.SIZE
        inside = {r.repeat}
        while True:
            more = {x.repeat for x in found.values() if x.parent in inside} - inside
            if not more:
                break
            inside |= more
        assert sum(p.repeat in inside for p in places) == r["count"] >= 2
