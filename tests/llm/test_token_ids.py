"""Simple-8b coding and token files by exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gistworks.llm import simple8b, token_ids

PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    None, "", " \n ", "a", "It's a TEST. it'll , 's <|EndOfText|> <|endoftext|>.", "H̱ Å. Å. É, x.y, 12.5 ..,", "ΣΑΣ, ΟΔΟΣ İI. ͅx, don't. 9's, ça.",
    "́, á. K.", "word " * 30_000, "The. the, THE thé. \x0b\x0ctabs\tand\rreturns", "𝒳𝒴 漢字 🙂.", "%%% $$$ a%%% b!!! c|d", "<|startoftext|>x",
]


@pytest.mark.parametrize("high", [1, 2, 200, 40_000, 1 << 32, (1 << 60) - 1, (1 << 64) - 1])
def test_codec_round_trip(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 59, 60, 61, 511, 512, 513, 1024, 3000):
        ids = rng.integers(0, high, n, dtype=np.uint64, endpoint=True)
        ids[rng.random(n) < 0.3] = 0
        words, offsets = simple8b.encode(ids)
        assert (simple8b.decode(words, offsets, n) == ids).all()
        for b in range(len(offsets) - 1):  # every block by itself
            size = min(simple8b.BLOCK, n - b * simple8b.BLOCK)
            part = words[offsets[b] : offsets[b + 1]]
            assert (simple8b.decode(part, np.array([0, len(part)]), size) == ids[b * simple8b.BLOCK :][:size]).all()


def test_small_integers_share_words():
    assert len(simple8b.encode(np.zeros(512, np.uint64))[0]) <= 9
    assert len(simple8b.encode(np.full(512, 30_000, np.uint64))[0]) == 128
    assert len(simple8b.encode(np.full(512, 1 << 62, np.uint64))[0]) == 1024


def brute(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), ids))
        start += len(ids)
    return out


def test_files(spark, documents, clashing, tmp_path):
    rows = list(enumerate(TEXTS, 5))
    for k, df in enumerate((documents(rows[::-1]), clashing(documents(rows)).repartition(3))):
        path = str(tmp_path / str(k))
        token_ids.write_ids(df, path, PATH, 2)
        found = sorted(tuple(r) for r in token_ids.read_ids(spark, path).collect())
        assert found == brute(rows)
        digests = sorted(tuple(r) for r in token_ids.read_digests(spark, path).collect())
        assert digests == [(d, s, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for d, s, n, ids in brute(rows)]


def test_many_slices_and_forgetting(spark, documents, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{k} Stop." for k in range(40))) for i in range(50)]
    coder = token_ids.WordTokenizer(PATH)
    monkeypatch.setattr(token_ids, "REMEMBERED", 100)
    import pyarrow as pa

    for begin in range(0, 50, 3):
        ids, counts = coder.encode(pa.array([t for _, t in rows[begin : begin + 3]]), 2)
        expected = [x for _, _, _, own in brute(rows[begin : begin + 3]) for x in own]
        assert ids.tolist() == expected and counts.sum() == len(expected)


def test_empty_table_and_ties(spark, documents, tmp_path):
    token_ids.write_ids(documents([]), str(tmp_path / "none"), PATH, 2)
    assert token_ids.read_ids(spark, str(tmp_path / "none")).collect() == []
    rows = [(1, "b"), (1, "a"), (1, "a"), (None, "c")]
    token_ids.write_ids(documents(rows), str(tmp_path / "ties"), PATH, 2)
    found = sorted((r.start, r.doc_id) for r in token_ids.read_ids(spark, str(tmp_path / "ties")).collect())
    assert [d for _, d in found] == [None, 1, 1, 1]
