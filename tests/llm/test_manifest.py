"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest

from gistworks.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    fields = [row[0], row[3] if len(row) > 3 else None, row[2] if len(row) > 2 else None, len(row[1] or ""), text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def plain(leaves):
    """The root over a list of leaves, and each one's siblings, level by level, as (left, right)."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            first = i - i % 3
            paths[leaf].append((nodes[first:i], nodes[i + 1 : first + 3]))
            at[leaf] = i // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    sources = sorted({r[3] if len(r) > 3 else None for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    out, subroots, held = [], [], []
    for source in sources:
        own = [(r, leaf_of(r, r[1])) for r in rows if (r[3] if len(r) > 3 else None) == source]
        own.sort(key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1]))
        subroot, paths = plain([leaf for _, leaf in own])
        subroots.append(subroot)
        held.append((own, paths))
    root, upper = plain(subroots)
    for subroot, (own, paths), up in zip(subroots, held, upper, strict=True):
        for (row, leaf), path in zip(own, paths, strict=True):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            node = leaf_of(row, row[1].replace("\n", "")) if hit and row[1] is not None else leaf
            for left, right in path + up:
                node = h(*left, node, *right)
            proof = h(*[x for left, right in path + up for x in left + right])
            out.append((row[0], leaf, subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def run(df):
    return sorted([tuple(r) for r in manifest.manifest(df, manifest.tampered(df)).collect()], key=repr)


@pytest.mark.parametrize("levels", range(1, 10))
def test_addresses_are_a_permutation_by_halves(levels):
    at = manifest.addresses(levels)
    assert [len(a) for a in at] == [3**i for i in range(levels)]
    assert sorted(x for a in at for x in a.tolist()) == list(range((3**levels - 1) // 2))
    upper = levels // 2
    if upper:
        top = (3**upper - 1) // 2  # the upper half of the levels comes first, then one subtree after the other
        assert all(x < top for a in at[:upper] for x in a.tolist())
        size = (3 ** (levels - upper) - 1) // 2
        assert at[upper].tolist() == [top + i * size for i in range(3**upper)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 80])
def test_block(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    root, paths = plain([x.hex() for x in leaves])
    height = manifest.height_of(n)
    block = manifest.build(leaves, height)
    assert block[:32].hex() == root
    for leaf, path, want in zip(leaves, manifest.steps(block, height, n), paths, strict=True):
        assert manifest.siblings(path) == "".join(x for left, right in want for x in left + right)
        assert manifest.fold(leaf, path).hex() == root
        assert n == 1 or manifest.fold(hashlib.sha256(b"other").digest(), path).hex() != root


@pytest.mark.parametrize("height", [1, 2, 8])
def test_against_a_plain_tree(documents, clashing, monkeypatch, height):
    monkeypatch.setattr(manifest, "HEIGHT", height)
    rows = [(i * 37 % 101, f"line {i}\nline {i % 4}" if i % 3 else f"line {i}", "en", f"s{i % 7 % 4}") for i in range(101)]
    rows += [(200 + i, f"é\n{i}", None, "ßsource") for i in range(7)] + [(300 + i, "x\n" * i, "de", None) for i in range(4)] + [(400, "alone", "fr", "Z")]
    assert run(documents(rows).repartition(5)) == brute(rows)
    assert run(clashing(documents(rows))) == brute(rows)


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, "\n\n"), (3, "\n\n"), (3, "a"), (None, "b\nc"), (None, None), (7, "long words\n" * 200_000), (8, "", "", "")]
    assert run(documents(rows)) == brute(rows)
    one = [(5, "a\nb", "en", "web")]
    assert run(documents(one)) == brute(one)
    assert run(documents([])) == []


def test_tampering_is_found_where_there_was_a_newline(documents):
    rows = [(i, f"a\nb {i}" if i % 2 else f"ab {i}", "en", "web") for i in range(60)]
    for doc_id, *_, verified in run(documents(rows)):
        assert verified == (not (doc_id % 2 and zlib.crc32(str(doc_id).encode()) % 2 == 0))
    df = documents(rows)
    assert {r.verified for r in manifest.manifest(df).collect()} == {True}
