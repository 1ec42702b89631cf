r"""Alignment of two tokenizations of the same texts.

Text with a space before it is cut by a byte-level BPE (A) and by a sentencepiece BPE (B).  Where a token of each ends at
the same byte the text is cut into groups; every token of A in a group is linked to every token of B in it, and an id pair
counts for each document that holds it linked.

Ends are merged by merge-path partitioning: the path through the merging of both ascending arrays is cut by diagonals at
equal distances, a binary search finds where each of them meets the path, and the pieces between them, of equal work, run
side by side as lanes of numpy arrays.  A piece emits overlapping token pairs and counts the common ends it passes; the sum
of the counts of the pieces before stitches its first and last, partial groups to those of its neighbours.

Neither tokenizer joins across a single space between other characters, so such a place is always a common end, and the
distinct words of a block of documents are aligned instead of every occurrence.  A text in which white space meets a
space is one word of its own and goes through both libraries whole, as do all texts under vocabularies of other kinds.

A block of about ``BLOCK_BYTES`` of text keeps its documents' words and its words' pairs; its distinct pairs, with the
number of documents in the block, are counted by a shuffle on the pair, partially added before it.  The counts go back to
the blocks that asked and are summed up there.  The highest count of an id of A is a table as long as its vocabulary at
most.  Nothing is collected.

Defined results: null and empty texts, and texts whose tokens' bytes in A or B aren't the space and the text, have no
tokens; rows that repeat a doc_id are documents of their own; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import functools
import hashlib
import io
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters, tokenizer_path
from .cluster import durable
from .words import text_slices, whole_texts

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text of a block: its distinct words and pairs are in memory at once.
BLOCK_BYTES = 2 << 20
SLICE_BYTES = 1 << 20
#: Characters up to which words are encoded together; the libraries' time grows faster than a longer word.
LONG = 300
#: Words that a task keeps from one block to the next.
CACHE_WORDS = 100_000
#: Merge steps of a piece.
PIECE = 64
#: A group of more token pairs is linked by its distinct ids and their numbers.
WIDE = 256
WHITE = "\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: Texts that are not cut at spaces.
UNCUT = f"[{WHITE}] [{WHITE}]|  |^ | $"


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import public_tokenizers
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        letter = {c: i for i, c in enumerate(byte_letters())}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size = len(pieces)
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        with open(a_path, encoding="utf-8") as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        plain = made.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        # a second library takes the same merges faster if each one makes the next id
        merges = [m if isinstance(m, list) else m.split(" ") for m in made["model"].get("merges", [])]
        first = len(letter)
        in_order = plain and made["model"]["type"] == "BPE" and not made["model"].get("ignore_merges") and all(vocabulary.get("".join(m)) == first + k for k, m in enumerate(merges)) and {vocabulary.get(c) for c in letter} == set(range(first))
        self.a_made = range(first + len(merges)) if in_order else range(0)
        #: whether words can be encoded apart
        self.cuts = bool(plain) and not any("▁" in p.lstrip("▁") for p in pieces)

        ranks = {t: i for i, t in enumerate(self.a_bytes) if i in self.a_made}
        self.quick = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if self.a_made else None

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids in A and in B of a space and each word in one array, and the words' offsets in it.

        A word whose bytes either of them changes has none.  Words are joined by spaces and encoded together, unless one of
        them is long or a vocabulary doesn't let words apart.
        """
        if self.cuts and max(map(len, words)) <= LONG:
            end = np.cumsum([len(w.encode()) + 1 for w in words])
            data = (" " + " ".join(words)).encode()
            if self.quick:
                a = np.array(self.quick.encode_ordinary(" " + " ".join(words)), np.int64)
            else:
                a = np.concatenate([e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]).astype(np.int64)
            b = np.array([i for ids in self.b.encode([" ".join(words[k : k + 50]) for k in range(0, len(words), 50)], num_threads=1) for i in ids], np.int64)
            if b"".join(map(self.a_bytes.__getitem__, a.tolist())) == data and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == data:
                return a, offsets_at(self.a_length[a], end), b, offsets_at(self.b_length[b], end)
        elif len(words) == 1:
            w = words[0]
            a = self.a.encode_batch_fast([" " + w], add_special_tokens=False)[0].ids
            b = self.b.encode(w)
            data = (" " + w).encode()
            if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
                a, b = [], []
            return np.array(a, np.int64), np.array([0, len(a)]), np.array(b, np.int64), np.array([0, len(b)])
        # some word is long or changes: halves, down to the single word
        if len(words) == 1:
            none = np.zeros(0, np.int64)
            return none, np.array([0, 0]), none, np.array([0, 0])
        half = len(words) // 2
        left, right = self.encode(words[:half]), self.encode(words[half:])
        return tuple(np.concatenate([x, y]) if k % 2 == 0 else np.concatenate([x, x[-1] + y[1:]]) for k, (x, y) in enumerate(zip(left, right, strict=True)))


def offsets_at(length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many tokens end at 0 and up to each of ``end``."""
    return np.concatenate([[0], np.searchsorted(np.cumsum(length), end, "right")])


@functools.cache
def tokenizers_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``counts`` of them, one range after the other."""
    total = np.cumsum(counts)
    return np.repeat(starts - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many elements of ``a`` are among the first ``at`` of the merged order; of equal ones, that of ``a`` is first."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        first = np.zeros(len(at), bool)
        i = middle[open_]
        first[open_] = a[i] <= b[at[open_] - i - 1]
        low, high = np.where(first, middle + 1, low), np.where(open_ & ~first, middle, high)
    return low


def merge_ends(a: np.ndarray, b: np.ndarray, width: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, token of a, token of b) for each overlap of a token of ``a`` and one of ``b``, whose ends ascend strictly.

    Both start at 0 and have the same last end.
    """
    total = len(a) + len(b)
    at = np.arange(0, total, width)
    i = diagonals(a, b, at)
    j = at - i
    steps = np.minimum(width, total - at)
    passed = np.zeros(len(at), np.int64)
    # ends before the first token; the last elements keep lanes at the end of the path in place
    end_a, end_b = np.concatenate([a, [np.iinfo(np.int64).max]]), np.concatenate([b, [np.iinfo(np.int64).max]])
    start_a, start_b = np.concatenate([[0], a]), np.concatenate([[0], b])
    out = []
    for k in range(int(steps.max(initial=0))):
        on = np.flatnonzero(steps > k)
        x, y = i[on], j[on]
        ax, by = end_a[x], end_b[y]
        meet = (start_a[x] < by) & (start_b[y] < ax) & (x < len(a)) & (y < len(b))
        out.append((on[meet], passed[on[meet]], x[meet], y[meet]))
        take_a = ax <= by
        passed[on] += ~take_a & (start_a[x] == by)
        i[on] += take_a
        j[on] += ~take_a
    if not out:
        return (np.zeros(0, np.int64),) * 3
    piece, local, x, y = (np.concatenate(c) for c in zip(*out, strict=True))
    before = np.cumsum(passed) - passed
    group = before[piece] + local
    order = np.lexsort((y, x, group))
    return group[order], x[order], y[order]


class Words:
    """Distinct words, each with its groups and linked id pairs; what is added comes in chunks."""

    def __init__(self, pair: Pair):
        self.pair, self.known, self.size = pair, {}, 0
        self.strings: list[str] = []
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A, tokens of B, groups, links
        self.offsets = np.zeros(1, np.int64)  # of the pairs
        self.codes, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = range(max(len(pair.a_bytes), len(pair.b_bytes)))
        self.labels = np.array([f"{i}{c}" for c in ",|;" for i in ids], object)
        self.label_size, self.n_ids = np.array([len(x) for x in self.labels], np.int64), len(ids)

    def add(self, words: list[str]) -> np.ndarray:
        """Aligns words; returns their codes."""
        ids_a, off_a, ids_b, off_b = self.pair.encode(words)
        end_a, end_b = np.cumsum(self.pair.a_length[ids_a]), np.cumsum(self.pair.b_length[ids_b])
        group, x, y = merge_ends(end_a, end_b)
        n_groups = int(group[-1]) + 1 if len(group) else 0
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n_groups else np.zeros(0, np.int64)
        from_a, from_b = (np.concatenate([z[first], [len(e)]]) for z, e in ((x, end_a), (y, end_b)))
        n_a, n_b = np.diff(from_a), np.diff(from_b)
        word_of = np.searchsorted(off_a, from_a[:-1], "right") - 1
        in_word = np.bincount(word_of, minlength=len(words))
        self.numbers = np.concatenate([self.numbers, np.column_stack([np.diff(off_a), np.diff(off_b), in_word, np.bincount(word_of, n_a * n_b, len(words)).astype(np.int64)])])
        wide = n_a * n_b > WIDE
        slim = np.flatnonzero(~wide)
        each = n_a[slim] * n_b[slim]
        place, width = spread(np.zeros(len(slim), np.int64), each), np.repeat(n_b[slim], each)
        code = ids_a[np.repeat(from_a[slim], each) + place // np.maximum(width, 1)] * self.pair.b_size + ids_b[np.repeat(from_b[slim], each) + place % np.maximum(width, 1)]
        linked = [(code, np.repeat(word_of[slim], each), np.ones(len(code), np.int64))]
        for g in np.flatnonzero(wide).tolist():
            u, n = np.unique(ids_a[from_a[g] : from_a[g + 1]], return_counts=True)
            v, m = np.unique(ids_b[from_b[g] : from_b[g + 1]], return_counts=True)
            linked.append(((u[:, None] * self.pair.b_size + v).ravel(), np.full(len(u) * len(v), word_of[g]), (n[:, None] * m).ravel()))
        code, owner, times = (np.concatenate(c) for c in zip(*linked, strict=True))
        order = np.argsort(owner, kind="stable")
        self.codes, self.times = np.concatenate([self.codes, code[order]]), np.concatenate([self.times, times[order]])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.bincount(owner, minlength=len(words)))])
        # labels in the order of their groups, those of A first; the last of each kind in a group ends with its own mark
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[from_a[1:] - 1], last_b[from_b[1:] - 1] = 1, 2
        label = np.concatenate([ids_a + last_a * self.n_ids, ids_b + last_b * self.n_ids])
        by_group = np.argsort(np.concatenate([2 * np.repeat(np.arange(n_groups), n_a), 2 * np.repeat(np.arange(n_groups), n_b) + 1]), kind="stable")
        label = label[by_group]
        text, size = "".join(self.labels[label].tolist()), np.concatenate([[0], np.cumsum(self.label_size[label])])
        cut = size[off_a + off_b].tolist()
        self.strings.extend([text[i:j] for i, j in zip(cut, cut[1:])])
        codes = np.arange(self.size, self.size + len(words))
        self.size += len(words)
        return codes

    def look(self, words: list[str]) -> np.ndarray:
        """Codes of ``words``, none of them twice; new ones are aligned."""
        code = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(code < 0)
        if len(new):
            fresh = [words[k] for k in new.tolist()]
            code[new] = self.add(fresh)
            self.known.update(zip(fresh, code[new].tolist(), strict=True))
        return code


class Block:
    """Documents whose pairs are counted and answered together."""

    def __init__(self, words: Words):
        self.words, self.bytes, self.n_docs = words, 0, 0
        self.ids: list[pa.Array] = []
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # document, word, times
        self.hashes: list[str] = []

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        """Takes up a slice of documents."""
        texts = whole_texts(texts)
        n = len(texts)
        whole = pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False) if self.words.pair.cuts else np.ones(n, bool)
        filled = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        cut, single = np.flatnonzero(filled & ~whole), np.flatnonzero(filled & whole)
        parts = pc.split_pattern(texts.take(pa.array(cut)), " ")
        split = parts.flatten().dictionary_encode()
        offsets = parts.offsets.to_numpy().astype(np.int64)
        codes = self.words.look(split.dictionary.to_pylist())[split.indices.to_numpy(zero_copy_only=False)]
        alone = [self.words.add([t])[0] for t in texts.take(pa.array(single)).to_pylist()]
        doc = np.concatenate([np.repeat(cut, np.diff(offsets)), single])
        codes = np.concatenate([codes, np.array(alone, np.int64)])
        order = np.argsort(doc, kind="stable")
        doc, codes = doc[order], codes[order]
        # a word without tokens is one whose bytes were changed: its document has none
        spoilt = np.zeros(n, bool)
        spoilt[doc[self.words.numbers[codes, 0] == 0]] = True
        good = ~spoilt[doc]
        doc, codes = doc[good], codes[good]
        bounds, strings = np.searchsorted(doc, np.arange(n + 1)).tolist(), list(map(self.words.strings.__getitem__, codes.tolist()))
        for i, j in zip(bounds, bounds[1:]):
            self.hashes.append(hashlib.sha256("".join(strings[i:j])[:-1].encode()).hexdigest() if i < j else "")
        key, times = np.unique(doc << 40 | codes, return_counts=True)
        self.entries.append((self.n_docs + (key >> 40), key & ((1 << 40) - 1), times))
        self.ids.append(ids)
        self.n_docs += n
        self.bytes += texts.nbytes

    def record(self, block: int) -> dict[str, object]:
        """What is kept of the block: numbers of its documents, their words, the words' pairs, and the pairs."""
        doc, word, times = (np.concatenate([e[k] for e in self.entries]) for k in range(3))
        used, word = np.unique(word, return_inverse=True)
        numbers = self.words.numbers[used]
        sums = [np.bincount(doc, numbers[word, k] * times, self.n_docs).astype(np.int64) for k in range(4)]
        n_links = np.diff(self.words.offsets)[used]
        links = spread(self.words.offsets[used], n_links)
        pairs, index = np.unique(self.words.codes[links], return_inverse=True)
        weight = self.words.times[links]
        offset = np.concatenate([[0], np.cumsum(n_links)])
        held = np.zeros(len(pairs), np.int64)
        bounds = np.searchsorted(doc, np.arange(self.n_docs + 1))
        cost = np.concatenate([[0], np.cumsum(n_links[word])])
        at = 0
        while at < self.n_docs:  # documents of about a million links at once
            upto = int(np.searchsorted(cost[bounds], cost[bounds[at]] + 1_000_000, "right"))
            upto = min(max(upto - 1, at + 1), self.n_docs)
            own = slice(bounds[at], bounds[upto])
            each = n_links[word[own]]
            key = np.unique(np.repeat(doc[own], each) * max(len(pairs), 1) + index[spread(offset[word[own]], each)])
            held += np.bincount(key % max(len(pairs), 1), minlength=len(pairs))[: len(pairs)]
            at = upto
        small = lambda x: x.astype(np.int32)
        held_back = packed([small(np.diff(bounds)), small(word), small(times), small(n_links), small(index), weight])
        return {"block": block, "hashes": self.hashes, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums, strict=True)), "links": held_back, "pairs": pairs, "held": held}


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one compressed value, so that the JVM holds and sends little."""
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a)
    return zstandard.compress(out.getvalue(), 1)


def unpacked(data: bytes, count: int) -> list[np.ndarray]:
    held = io.BytesIO(zstandard.decompress(data))
    return [np.load(held) for _ in range(count)]


RECORD = "block bigint, doc_ids array<{id}>, hashes array<string>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, links binary, pairs array<bigint>, held array<bigint>"
RESULT = "doc_id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def blocks(docs: DataFrame, a_path: str, b_path: str, block_bytes: int) -> DataFrame:
    """One row for each block of documents: what ``Block.record`` returns, and the documents' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = tokenizers_of(a_path, b_path)
        part, made, words = TaskContext.get().partitionId(), 0, Words(pair)
        block = Block(words)

        def done() -> pa.RecordBatch:
            record = block.record(part << 32 | made)
            names = [c.strip().split(" ")[0] for c in RECORD.split(",")]
            ids = pa.concat_arrays(block.ids)
            columns = {"block": pa.array([record["block"]]), "doc_ids": pa.array([ids.to_pylist()], pa.list_(ids.type))}
            for c in names:
                if c not in columns:
                    columns[c] = pa.array([record[c]])
            return pa.RecordBatch.from_arrays([columns[c] for c in names], names)

        for batch in batches:
            for piece in text_slices(batch, max_bytes=min(SLICE_BYTES, block_bytes)):
                block.add(piece.column("doc_id"), piece.column("text"))
                if block.bytes >= block_bytes:
                    yield done()
                    words = words if words.size < CACHE_WORDS else Words(pair)
                    made, block = made + 1, Block(words)
        if block.n_docs:
            yield done()

    return docs.select("doc_id", "text").mapInArrow(run, RECORD.replace("{id}", dict(docs.dtypes)["doc_id"]))


def pair_counts(made: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether no pair of its A id is in more."""
    asked = made.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("n"))
    counts = durable(asked, "pair_counts").withColumn("a", F.expr(f"pair div {b_size}"))
    # a row for each id of A at most
    top = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("top")))
    return counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    a_path, b_path = a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE)
    kind = dict(docs.dtypes)["doc_id"]
    made = durable(blocks(docs, a_path, b_path, block_bytes), "blocks")
    counts = pair_counts(made, tokenizers_of(a_path, b_path).b_size)
    asked = made.select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counts, "pair").select(F.col("block").alias("asker"), "place", "n", "best")
    kept = made.drop("pairs", "held")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        n, best = (np.zeros(right.num_rows, np.int64) for _ in (0, 1))
        place = right.column("place").to_numpy()
        n[place], best[place] = right.column("n").to_numpy(), right.column("best").to_numpy()
        for k in range(left.num_rows):
            words, word, often, links, pair, times = unpacked(left.column("links")[k].as_py(), 6)
            doc, owner = np.repeat(np.arange(len(words)), words), np.repeat(np.arange(len(links)), links)
            ids = left.column("doc_ids")[k].values
            out = [ids, *(left.column(c)[k].values for c in ("n_a", "n_b", "n_groups", "n_links"))]
            for value in (best, n):
                # whole numbers below 2^53 in double precision
                of_word = np.bincount(owner, value[pair] * times, len(links))
                out.append(pa.array(np.bincount(doc, of_word[word] * often, len(ids)).astype(np.int64)))
            tables.append(pa.table([*out, left.column("hashes")[k].values], [c.strip().split(" ")[0] for c in RESULT.split(",")]))
        return pa.concat_tables(tables)

    return kept.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(finish, RESULT.replace("{id}", kind))
