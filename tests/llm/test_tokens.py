"""Operators 1 and 9 against the tokenizers library."""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from statuslake.llm import bpe, token_files
from statuslake.llm.words import split_words, text_slices

from .conftest import odd_texts, words

PATH = bpe.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_words_of_slices():
    texts = odd_texts() * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = []
    for part in text_slices(batch, max_bytes=5000):
        vocabulary, codes, offsets = split_words(part.column("text"))
        names = vocabulary.to_pylist()
        got += [[names[c] for c in codes[i:j]] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [words(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcAB '’.,%<|>endoftxsi 123éÉßΣ\t\n "), st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=("Cn", "Cs", "Mn", "Mc"))), max_size=40))
def test_any_text(text):
    column = pa.array([text], pa.string())
    want = ids_of(text)
    assert bpe.slice_ids(column, bpe.word_ids(PATH))[0].tolist() == want
    assert token_files.encoder(PATH)(column)[0].tolist() == want
    assert bpe.merges(PATH).decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("form", ["x{}y", "{}\u0327'S"])
def test_all_characters(form):
    """Every code point below 0x20000 but surrogates, ideographs and syllables of one kind, of which every 97th stands for all."""
    alike = [range(0x3400, 0xA000), range(0xAC00, 0xD7A4), range(0x20000, 0x110000)]
    points = [c for c in range(0x20000) if not any(c in r for r in alike)] + [c for r in alike for c in r[::97]]
    for i in range(0, len(points), 20_000):
        texts = [form.format(chr(c)) for c in points[i : i + 20_000] if not 0xD800 <= c < 0xE000]
        want = [e.ids for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]
        for encode in (lambda x: bpe.slice_ids(x, bpe.word_ids(PATH)), token_files.encoder(PATH)):
            flat, offsets = encode(pa.array(texts, pa.string()))
            assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want


def test_cuts_by_eye(tmp_path):
    """Words are cut by eye only if the file itself lower-cases, cuts and ends pieces that way."""
    import json

    data = json.load(open(PATH, encoding="utf-8"))
    cased = tmp_path / "cased.json"
    cased.write_text(json.dumps(data | {"normalizer": {"type": "NFC"}}), encoding="utf-8")
    texts = ["Two WORDS, Größe! and more", "ABC", "a\u0301b x", "", None, "end.</w> </w>"]
    column = pa.array(texts, pa.string())
    for path, by_eye in ((PATH, True), (str(cased), False), (bpe.tokenizer_path("byte_bpe_50k.json"), False)):
        own = token_files.Encoder(path)
        assert own.by_eye is by_eye
        if path.endswith("byte_bpe_50k.json"):
            continue
        library = Tokenizer.from_file(path)
        flat, offsets = own(column)
        assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_many_words_behind_each_other():
    """Slices of an array, and words of letters with and without punctuation, and others, side by side."""
    texts = ["Alpha beta!! été, x1 ÀB?! " * 50, "b", "ǅ... Ünder, it's", " ", None, "z!"] * 7
    column = pa.array(texts, pa.string())
    for part in (column, column.slice(3, 20), column.slice(5, 0)):
        flat, offsets = token_files.encoder(PATH)(part)
        assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [ids_of(t) for t in part.to_pylist()]


def test_merges_make_later_ranks():
    """A merged symbol only takes part in merges of a higher rank, so all places of a pair may be merged at once."""
    m = bpe.merges(PATH)
    made_at = dict(zip(m.made.tolist(), m.rank.tolist(), strict=True))
    left, right = m.keys // m.size, m.keys % m.size
    for a, b, r in zip(left.tolist(), right.tolist(), m.rank.tolist(), strict=True):
        assert made_at.get(a, -1) < r and made_at.get(b, -1) < r


def test_digests(odd, empty):
    want = sorted((i, len(x := ids_of(t)), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, t in ((r["doc_id"], r["text"]) for r in odd.collect()) if i is not None)
    assert sorted(tuple(r) for r in bpe.digests(odd).collect() if r["doc_id"] is not None) == want
    assert bpe.digests(empty).count() == 0 and bpe.encode(empty).count() == 0


def test_encode_decode(odd):
    got = {r["doc_id"]: r for r in bpe.encode(odd).collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(odd)).collect()}
    for r in odd.collect():
        want = ids_of(r["text"])
        assert got[r["doc_id"]]["ids"] == want and got[r["doc_id"]]["n_tokens"] == len(want)
        assert back[r["doc_id"]] == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes(planes):
    for ids in ([], [0], [1, 2**32 - 1, 7], list(range(1000))):
        ids = np.array(ids, np.uint32)
        assert token_files.from_planes(token_files.to_planes(ids, planes), len(ids)).tolist() == ids.tolist()


def test_files_round_trip(spark, documents, tmp_path):
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(documents, path, planes="bit", file_bytes=60_000)
    got = {r["doc_id"]: r for r in token_files.read_tokens(spark, path).collect()}
    digests = {r["doc_id"]: r for r in token_files.read_digests(spark, path).collect()}
    start = 0
    for r in sorted(documents.collect(), key=lambda r: r["doc_id"]):
        want = [*ids_of(r["text"]), 1]
        assert got[r["doc_id"]]["ids"] == want and got[r["doc_id"]]["start"] == start
        assert tuple(digests[r["doc_id"]]) == (r["doc_id"], start, len(want), zlib.crc32(struct.pack(f"<{len(want)}I", *want)))
        start += len(want)


def test_odd_documents(odd, empty):
    rows = [r for r in token_files.round_trip(odd).collect()]
    assert len(rows) == odd.count() and min(r["n_tokens"] for r in rows) == 1
    places = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    assert rows and [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])][0] is None
    assert token_files.round_trip(empty).count() == 0


def test_frequent_words_stay_when_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 4)
    made = []
    cache = bpe.WordCache(lambda words: made.extend(words) or [w.upper() for w in words])
    assert cache(["a", "b", "c"]) == ["A", "B", "C"]
    assert cache(["d", "a", "e"]) == ["D", "A", "E"]
    assert cache(["a", "f", "g", "h"]) == ["A", "F", "G", "H"]
    assert made == ["a", "b", "c", "d", "e", "f", "g", "h"] and len(cache.known) == 4
