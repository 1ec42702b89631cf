"""BPE encoding and decoding by batched merge rounds in numpy.

Words of ASCII letters, perhaps with punctuation behind, are cut by eye; all others are normalised and cut into pieces by
the normaliser and pre-tokeniser of the vocabulary file, so that both follow the library's own character tables.

The symbols of many words lie in one flat array.  A round looks every adjacent pair up by binary search over the
sorted pair keys, takes the lowest rank of each word, and merges that pair wherever it stands in the word, from the
left; words without a known pair are finished and leave the array.  Only distinct words of a slice are encoded, and a
task keeps a bounded cache of finished words, of frequent ones above all; documents are put together from their words' results.

Texts: null and empty have no tokens; any length is encoded whole, a slice of a few MB of text (or one longer
document) at a time; equal texts get equal ids; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import hashlib
import json
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import split_words, text_slices

TOKENIZER = "word_bpe_49k.json"
#: Finished words that a task keeps; the cache is emptied when it is full.
CACHE_WORDS = 100_000
#: ASCII symbols that no contraction of the pattern begins with.
PUNCTUATION = string.punctuation.replace("'", "")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """A vocabulary with its merges, ready for batched rounds."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        # the library's own tables of characters, without its vocabulary
        library = Tokenizer.from_str(json.dumps(data | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}))
        self.normaliser, self.splitter = library.normalizer, library.pre_tokenizer
        model, letters = data["model"], byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = 1 + max(*vocab.values(), *self.special.values())
        self.tokens = [""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.decimal = [str(i) for i in range(self.size)]
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys, rank = np.unique(keys, return_index=True)
        self.keys, self.rank, self.made = keys, rank.astype(np.int64), made[rank]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.pieces: dict[str, list[int]] = {}

    def pieces_of(self, word: str) -> list[str]:
        """Pieces of a word without ASCII white space; special tokens stand for themselves.

        The usual word, ASCII letters and perhaps punctuation behind them, is cut without the pattern.
        """
        if word.isascii():
            core = word.rstrip(PUNCTUATION)
            if core.isalpha():
                return [core.lower()] if len(core) == len(word) else [core.lower(), word[len(core) :]]
        if self.cut is not None and "<|" in word and (found := self.cut.search(word)):
            return [*self.pieces_of(word[: found.start()]), found[0], *self.pieces_of(word[found.end() :])]
        if not word:
            return []
        return [bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(word))]

    def merge(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece, by merge rounds over all of them at once."""
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        ids = self.first[flat]
        ids[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(pieces)), size)
        done_ids, done_words = [], []
        none = np.int64(len(self.keys) + 1)
        rank = changed = None
        while len(ids):
            if rank is None:
                rank, todo = np.full(len(ids), none), np.arange(len(ids) - 1)
            else:  # only pairs beside a merged symbol have changed
                beside = np.zeros(len(ids), bool)
                beside[changed] = True
                beside[np.maximum(changed - 1, 0)] = True
                todo = np.flatnonzero(beside[:-1])
            pair = ids[todo] * self.size + ids[todo + 1]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank[todo] = np.where((self.keys[at] == pair) & (word[todo] == word[todo + 1]), self.rank[at], none)
            rank[-1] = none
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(ids)))
            best = np.repeat(best, length)
            open_ = best < none
            if not open_.all():
                done_ids.append(ids[~open_])
                done_words.append(word[~open_])
            hit = np.flatnonzero((rank == best) & open_)
            if not len(hit):
                break
            new_run = np.append(True, np.diff(hit) != 1)
            if not new_run.all():  # runs such as a a a: every second pair of a run is taken, from the left
                run = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            place = np.searchsorted(self.keys, ids[hit] * self.size + ids[hit + 1])
            ids[hit] = self.made[place]
            keep = open_.copy()
            keep[hit + 1] = False
            changed = (np.cumsum(keep) - 1)[hit]
            ids, word, rank = ids[keep], word[keep], rank[keep]
        if not done_ids:
            return []
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        flat = ids[np.argsort(word, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(word, minlength=len(pieces))).tolist()
        return [flat[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; words are free of ASCII white space."""
        cut = [self.pieces_of(w) for w in words]
        asked = {p for ps in cut for p in ps if p not in self.special}
        new = asked - self.pieces.keys()
        if len(self.pieces) + len(new) > CACHE_WORDS:  # those asked for stay
            self.pieces = {p: self.pieces[p] for p in asked - new}
        fresh = sorted(new)
        if fresh:
            self.pieces.update(zip(fresh, self.merge(fresh), strict=True))
        known, special = self.pieces, self.special
        return [known[ps[0]] if len(ps) == 1 and ps[0] in known else [i for p in ps for i in ([special[p]] if p in special else known[p])] for ps in cut]

    def decode(self, ids: list[int]) -> str:
        """As the tokenizers library joins tokens where the file names no decoder: with one space."""
        return " ".join([self.tokens[i] for i in ids])


@functools.cache
def merges(path: str) -> Merges:
    return Merges(path)


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles while many small results are made that hold none: it would visit all of them again and again."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


class WordCache:
    """Results for distinct words; bounded by ``CACHE_WORDS`` besides the words of one slice.

    What is full gives up all words but those of the slice, so frequent words stay, however many rare ones a slice brings.
    """

    def __init__(self, make):
        self.make, self.known = make, {}

    def __call__(self, words: list[str]) -> list:
        known = self.known
        if missing := [w for w in words if w not in known]:
            if len(known) + len(missing) > CACHE_WORDS:
                self.known = known = {w: known[w] for w in words if w in known}
            with uncollected():
                known.update(zip(missing, self.make(missing), strict=True))
        return [known[w] for w in words]


def encode(docs: DataFrame, id_column: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id_column, n_tokens, ids array<int>) of each whole text."""
    path = path or tokenizer_path()
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_ids(path)
        for batch in batches:
            for part in text_slices(batch):
                flat, offsets = slice_ids(part.column("text"), cache)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int64()), ids], [id_column, "n_tokens", "ids"])

    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, ids array<int>")


@functools.cache
def word_ids(path: str) -> WordCache:
    return WordCache(lambda words: [array("i", x).tobytes() for x in merges(path).encode_words(words)])


def slice_ids(column: pa.Array, cache: WordCache, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts of a slice in one array, and the texts' offsets in it."""
    vocabulary, codes, offsets = split_words(column, lower=lower)
    lists = cache(vocabulary.to_pylist())  # 4 bytes for each id
    size = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
    start = np.concatenate([[0], np.cumsum(size)])
    flat = np.frombuffer(b"".join(lists), np.int32)
    n = size[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(ends[-1]) + np.repeat(start[codes] - ends[:-1], n)
    return flat[at] if len(flat) else np.zeros(0, np.int32), ends[offsets]


def decode(encoded: DataFrame, id_column: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id_column, text) of each row's ``ids``; null ids give the empty text."""
    path = path or tokenizer_path()
    kind = dict(encoded.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    return encoded.select(id_column, "ids").mapInArrow(run, f"`{id_column}` {kind}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the sha256 of the ids (decimal, one space between) and of the decoded text.

    Both strings are put together from the finished words, since ids and tokens of a text are those of its words in
    order; neither a list of ids nor a decoded text leaves its slice.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_strings(path)
        for batch in batches:
            for part in text_slices(batch):
                vocabulary, codes, offsets = split_words(part.column("text"), lower=False)
                made = cache(vocabulary.to_pylist())
                size = np.array([m[0] for m in made], np.int64)
                ids, tokens = [m[1] for m in made], [m[2] for m in made]
                total = np.concatenate([[0], np.cumsum(size[codes])])[offsets]
                if len(size) and not size.all():  # words of white space beyond ASCII have no tokens
                    full = size[codes] > 0
                    codes, offsets = codes[full], np.concatenate([[0], np.cumsum(full)])[offsets]
                a, b = [], []
                for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = codes[i:j].tolist()
                    a.append(hashlib.sha256(" ".join([ids[c] for c in own]).encode()).hexdigest())
                    b.append(hashlib.sha256(" ".join([tokens[c] for c in own]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(total), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@functools.cache
def word_strings(path: str) -> WordCache:
    """For each word its number of tokens, its ids and its decoded tokens, both as text."""

    def make(words: list[str]) -> list[tuple[int, str, str]]:
        model = merges(path)
        decimal, tokens = model.decimal, model.tokens
        return [(len(ids), " ".join([decimal[i] for i in ids]), " ".join([tokens[i] for i in ids])) for ids in model.encode_words(words)]

    return WordCache(make)
