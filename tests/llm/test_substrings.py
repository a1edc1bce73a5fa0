"""Substring dedup against brute force."""

import hashlib
import random
import re

from gistworks.llm import substrings
from gistworks.llm.substrings import SuffixAutomaton


def brute(rows, size=20):
    """Rows of different doc_ids; the first place of each window counts."""
    seen, out = set(), []
    for doc, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone.update(range(i, i + size))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def run(df):
    return sorted(tuple(r) for r in substrings.dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect())


def test_automaton_knows_first_places():
    rng = random.Random(1)
    text = [rng.randrange(3) for _ in range(300)]
    automaton = SuffixAutomaton()
    for at, symbol in enumerate(text):
        automaton.extend(symbol, at)
    query = [rng.randrange(3) for _ in range(200)] + text[50:120]
    for size in (1, 2, 5, 8):
        for i, found in enumerate(automaton.firsts(query, size)):
            window = query[i : i + size]
            places = [k for k in range(len(text) - size + 1) if text[k : k + size] == window]
            assert found == (places[0] + size - 1 if places else -1)


def test_edges(documents, clashing):
    w = [f"w{i}" for i in range(60)]
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, " ".join(w[:19])), (5, " ".join(w[:20])), (6, "\t" + "\n".join(w[:20])), (7, " ".join(w[5:45])),
        (8, "x " + " ".join(w[10:40]) + " y"), (9, " ".join(["a"] * 70)), (10, " ".join(w[:30] + w[:30])), (11, "É " * 25), (12, " ".join(f"v{i}" for i in range(30_000))),
        (13, " ".join(f"v{i}" for i in range(29_000, 30_010))),
    ]
    assert run(documents(rows)) == brute(rows)
    assert run(clashing(documents(rows))) == brute(rows)


def test_repeated_rows_and_rows_without_id(documents):
    text = " ".join(f"w{i}" for i in range(25))
    found = substrings.dedup(documents([(1, text), (1, text), (None, text), (2, text)])).collect()
    assert sorted([(r.doc_id, r.n_removed) for r in found], key=repr) == [(1, 0), (1, 0), (2, 25), (None, 25)]


def test_empty_table(documents):
    assert run(documents([])) == []


def test_random_passages(documents):
    rng = random.Random(5)
    passages = [[f"p{k}_{i}" for i in range(rng.randrange(15, 60))] for k in range(5)]
    rows = []
    for doc in range(150):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [f"u{rng.randrange(6)}" for _ in range(rng.randrange(30))]
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            words += p[a : a + rng.randrange(10, 60)]
        rows.append((doc * 7 % 150, " ".join(words)))
    assert run(documents(rows)) == brute(rows)


def test_small_parts_and_copies_of_shards(documents, monkeypatch):
    for name, value in {"FRAGMENT_BYTES": 300, "SHARD_BYTES": 500, "AUTOMATON_WORDS": 50, "STREAM_WINDOWS": 60}.items():
        monkeypatch.setattr(substrings, name, value)
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"a{i} {text} b{i}") for i in range(40)]
    assert run(documents(rows)) == brute(rows)
