"""Code lengths of whole texts by context-tree weighting over bytes.

Every byte is decomposed into its 8 bits, and for each of the 255 places in that binary tree there is a context tree
over the preceding bytes, up to ``depth``.  A node of a context tree estimates its bits by Krichevsky and Trofimov
and mixes that, half and half, with the product of its children: the weighting of all tree models up to that depth.
Trained on a corpus and then frozen, the mixture turns into one probability for each node, and a text's code length is
the sum over its bits at the deepest node that matches.

Counting covers the whole training text: grams of ``depth + 1`` bytes are counted in tasks and summed by key.  Every
context seen is in the tree.  Nodes of up to ``TOP`` context bytes, a number that the alphabet bounds, are weighted on the
driver.  Deeper nodes are dealt out by their last ``TOP + 1`` context bytes: one pass sums the log weights of such
subtrees for the driver, a second one turns each gram of the corpus into its log probability.

A text is the byte 0 ``depth`` times (not scored), its UTF-8 bytes with A-Z lower-cased, and the byte 255, which UTF-8
never uses, as its end; so probabilities of texts sum to one.

The base model counts words.  Word counts and gram probabilities meet the distinct words and grams of bounded blocks of
documents part by part, both sides dealt by key, and a block's values meet its texts again in a co-group; neither is
broadcast.

Defined results: null counts as the empty text, whose only token is the end; equal texts get equal scores; an empty
table gives an empty table; without training documents every bit has probability one half; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import durable
from .words import hash_words, split_words, text_slices, whole_texts

#: Bytes of context that the driver's part of the tree has at most.
TOP = 2
#: Grams that a task weights at once, or one group of equal last ``TOP + 1`` context bytes if it is larger.
PIECE_GRAMS = 1 << 17
BLOCK_BYTES = 32 << 20
LEAST_BLOCKS = 32
GRAM_SLICE = 2 << 20
#: Texts that are scored at once: their numbers and a gram share 64 bits.
MAX_DOCS = 1 << 14
#: Distinct keys that a task counts before it sends them on.
TASK_KEYS = 2_000_000
END = 255
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
WORD = np.uint64(1 << 63)
#: The key of the end token; a word's key has bit 63 set, a gram's is below 2**48.
END_TOKEN = (1 << 63) - 1


def training(ids: list) -> np.ndarray:
    """Whether crc32 of the id as text, modulo 7, is not 2. A null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for i in ids], bool)


def grams(column: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each scored byte, in order, the gram of ``depth`` bytes before it and itself; and how many each text has."""
    texts = whole_texts(column)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = LOWER[np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)]
    # laid out as depth zeros, text, end for each text
    padded = size + depth + 1
    first = np.cumsum(padded) - padded
    flat = np.zeros(int(padded.sum()), np.uint64)
    text_at = np.repeat(first + depth - offsets[:-1], size) + np.arange(len(data))
    flat[text_at] = data
    flat[first + depth + size] = END
    key = flat.copy()
    for i in range(1, depth + 1):
        key[i:] |= flat[:-i] << np.uint64(8 * i)
    scored = np.ones(len(flat), bool)
    for i in range(depth):
        scored[first + i] = False
    return key[scored], size + 1


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.diff(np.append(at, len(keys)))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys added up."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    if not len(k):
        return k, c
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[at], np.add.reduceat(c, at)


def corpus_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(key, n) of all grams, and of the words and ends of the training documents; n counts training documents only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            k, c = summed(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["key", "n"])

        for batch in batches:
            own = training(batch.column(0).to_pylist())
            for use in (True, False):
                for part in text_slices(batch.filter(pa.array(own == use))):
                    found = [counted(grams(piece.column("text"), depth)[0]) for piece in text_slices(part, max_bytes=GRAM_SLICE)]
                    if use:
                        vocabulary, codes, _ = split_words(part.column("text"))
                        found += [(hash_words(vocabulary) | WORD, np.bincount(codes, minlength=len(vocabulary))), (np.array([END_TOKEN], np.uint64), np.array([part.num_rows]))]
                    k, c = summed(*map(list, zip(*found, strict=True)))
                    keys.append(k)
                    counts.append(c * use)
                    held += len(k)
                    if held > TASK_KEYS:
                        k, c = summed(keys, counts)
                        keys, counts, held = [k], [c], len(k)
                        if held > TASK_KEYS // 2:
                            yield out()
                            keys, counts, held = [], [], 0
        if keys:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8; right to about 1e-13 for x >= 0.5."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of n0 noughts and n1 ones under the estimator of Krichevsky and Trofimov."""
    n0, n1 = n0.astype(float), n1.astype(float)
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - math.log(math.pi) - log_gamma(n0 + n1 + 1)


@dataclass
class Tree:
    """Sorted node keys (depth, context, place in the byte) and the probability of a one at each."""

    depth: int
    keys: np.ndarray
    ones: np.ndarray

    def log10_of(self, grams_: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram, given those before."""
        byte, ctx = grams_ & np.uint64(255), grams_ >> np.uint64(8)
        out = np.zeros(len(grams_))
        for i in range(8):
            node = np.uint64(1 << i) | (byte >> np.uint64(8 - i))
            one = ((byte >> np.uint64(7 - i)) & np.uint64(1)) == 1
            p = np.full(len(grams_), 0.5)
            todo = np.arange(len(grams_))
            for d in range(self.depth, -1, -1):
                if not len(self.keys) or not len(todo):
                    break
                key = node_key(d, ctx[todo], node[todo])
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                p[todo[hit]] = self.ones[at[hit]]
                todo = todo[~hit]
            out += np.log10(np.where(one, p, 1 - p))
        return out


def node_key(d: int, ctx: np.ndarray, node: np.ndarray) -> np.ndarray:
    return np.uint64(d << 52) | ((ctx & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | node


def merged(d: int, ctx: np.ndarray, node: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> dict:
    """The nodes of depth ``d``, in the order of their keys, with the counts of equal ones added up."""
    ctx = ctx & np.uint64((1 << (8 * d)) - 1)
    key = node_key(d, ctx, node)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    add = lambda n: np.add.reduceat(n[order], at) if len(at) else n
    return {"d": d, "key": key[at], "ctx": ctx[order][at], "node": node[order][at], "n0": add(n0), "n1": add(n1)}


def levels_of(ctx: np.ndarray, byte: np.ndarray, n: np.ndarray, low: int, high: int) -> list[dict]:
    """The nodes of the depths from ``low`` to ``high`` over counted bytes."""
    one = lambda i: ((byte >> np.uint64(7 - i)) & np.uint64(1)).astype(np.int64)
    bits = [(np.uint64(1 << i) | (byte >> np.uint64(8 - i)), n * (1 - one(i)), n * one(i)) for i in range(8)]
    node, n0, n1 = (np.concatenate(x) for x in zip(*bits, strict=True))
    levels = [merged(high, np.tile(ctx, 8), node, n0, n1)]
    for d in range(high - 1, low - 1, -1):
        x = levels[0]
        levels.insert(0, merged(d, x["ctx"], x["node"], x["n0"], x["n1"]))
    return levels


def rise(levels: list[dict], below: np.ndarray | None = None) -> None:
    """Weights from the last level up.  Its nodes are leaves, or ``below`` has the sum of their children's log weights."""
    for j in range(len(levels) - 1, -1, -1):
        x = levels[j]
        x["kt"] = log_kt(x["n0"], x["n1"])
        x["p_kt"] = (x["n1"] + 0.5) / (x["n0"] + x["n1"] + 1)
        if j < len(levels) - 1:
            y, n = levels[j + 1], len(x["key"])
            at = y["up"] = np.searchsorted(x["key"], node_key(x["d"], y["ctx"], y["node"]))
            # bits that no child holds meet in one further child
            rest0 = x["n0"] - np.bincount(at, y["n0"], n).astype(np.int64)
            rest1 = x["n1"] - np.bincount(at, y["n1"], n).astype(np.int64)
            under, x["p_rest"] = np.bincount(at, y["lw"], n) + log_kt(rest0, rest1), (rest1 + 0.5) / (rest0 + rest1 + 1)
        elif below is None:
            x["lw"], x["stop"], x["p_rest"] = x["kt"], np.ones(len(x["key"])), x["p_kt"]
            continue
        else:
            under, x["p_rest"] = below, np.full(len(x["key"]), 0.5)
        x["lw"] = math.log(0.5) + np.logaddexp(x["kt"], under)
        x["stop"] = np.exp(math.log(0.5) + x["kt"] - x["lw"])


def fall(levels: list[dict], above: dict | None = None) -> None:
    """Probabilities from the first level down; ``above`` is the level before it, if there is one."""
    for j, x in enumerate(levels):
        up = levels[j - 1] if j else above
        if not j and above is not None:
            x["up"] = np.searchsorted(above["key"], node_key(above["d"], x["ctx"], x["node"]))
        got = np.zeros(len(x["key"])) if up is None else up["got"][x["up"]]
        left = np.ones(len(x["key"])) if up is None else up["left"][x["up"]]
        x["got"] = got + left * x["stop"] * x["p_kt"]
        x["left"] = left * (1 - x["stop"])
        x["ones"] = x["got"] + x["left"] * x["p_rest"]


def weighted(table: pa.Table, depth: int) -> Tree:
    """The frozen mixture of one table of nodes: weights from the leaves up, then probabilities from the root down."""
    col = {c: table.column(c).to_numpy() for c in table.column_names}
    levels = []
    for d in range(depth + 1):
        ctx, node, n0, n1 = (col[c][col["d"] == d] for c in ("ctx", "node", "n0", "n1"))
        levels.append(merged(d, ctx.astype(np.uint64), node.astype(np.uint64), n0.astype(np.int64), n1.astype(np.int64)))
    rise(levels)
    fall(levels)
    return Tree(depth, np.concatenate([x["key"] for x in levels]), np.concatenate([x["ones"] for x in levels]))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, n) of whole groups; rows of a group follow each other."""
    held, size, limit = [], 0, PIECE_GRAMS
    for batch in batches:
        held.append((batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()))
        size += batch.num_rows
        if size >= limit:
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            group = (key >> np.uint64(8)) & np.uint64((1 << (8 * TOP + 8)) - 1)
            ends = np.flatnonzero(group[1:] != group[:-1]) + 1
            cut = int(ends[-1]) if len(ends) else 0
            if cut:
                yield key[:cut], n[:cut]
            held, size = [(key[cut:], n[cut:])], len(key) - cut
            limit = max(PIECE_GRAMS, 2 * size)
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def gram_scores(counts: DataFrame, depth: int) -> DataFrame:
    """(key, value): log10 probability of each gram's last byte, given those before."""
    gram, top = counts.where(f"key >= 0 AND key < {1 << (8 * depth + 8)}"), min(depth, TOP)
    group = F.expr(f"shiftright(key, 8) & {(1 << (8 * TOP + 8)) - 1}")
    dealt = gram.repartition(group).sortWithinPartitions(group).select("key", "n")

    def deep(key: np.ndarray, n: np.ndarray) -> list[dict]:
        own = n > 0
        levels = levels_of(key[own] >> np.uint64(8), key[own] & np.uint64(255), n[own], top + 1, depth)
        rise(levels)
        return levels

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            x = deep(*piece)[0]
            yield pa.RecordBatch.from_arrays([pa.array((x["ctx"] & np.uint64((1 << (8 * top)) - 1)).view(np.int64)), pa.array(x["node"].view(np.int64)), pa.array(x["lw"])], ["ctx", "node", "lw"])

    # at most 2**24 rows: a byte after TOP bytes, and the same for nodes
    table = gram.where("n > 0").groupBy(F.expr(f"shiftright(key, 8) & {(1 << (8 * top)) - 1}").alias("ctx"), F.expr("key & 255").alias("byte")).agg(F.sum("n").alias("n")).toArrow()
    ctx, byte, n = (table.column(c).to_numpy() for c in ("ctx", "byte", "n"))
    levels = levels_of(ctx.astype(np.uint64), byte.astype(np.uint64), n.astype(np.int64), 0, top)
    below = None
    if depth > top:
        sums = dealt.mapInArrow(weigh, "ctx bigint, node bigint, lw double").groupBy("ctx", "node").agg(F.sum("lw").alias("lw")).toArrow()
        at = np.searchsorted(levels[-1]["key"], node_key(top, sums.column("ctx").to_numpy().astype(np.uint64), sums.column("node").to_numpy().astype(np.uint64)))
        below = np.bincount(at, sums.column("lw").to_numpy(), len(levels[-1]["key"]))
    rise(levels, below)
    fall(levels)
    keys, ones = (np.concatenate([x[c] for x in levels]) for c in ("key", "ones"))
    above = {c: levels[-1][c] for c in ("d", "key", "got", "left")}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in pieces(batches):
            lower = []
            if depth > top:
                lower = deep(key, n)
                fall(lower, above)
            tree = Tree(depth, np.concatenate([keys, *(x["key"] for x in lower)]), np.concatenate([ones, *(x["ones"] for x in lower)]))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tree.log10_of(key))], ["key", "value"])

    return dealt.mapInArrow(look, "key bigint, value double")


def packed(x: np.ndarray) -> bytes:
    """Eight-byte numbers as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(kind).reshape(-1)


def text_scores(column: pa.Array, depth: int, key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """log10 probability of each text of a slice; ``key`` is sorted and has all of its grams."""
    gram, size = grams(column, depth)
    owner = np.repeat(np.arange(len(size), dtype=np.uint64), size)
    bits = np.uint64(8 * (depth + 1))
    both, n = counted((owner << bits) | gram)
    return np.bincount((both >> bits).astype(np.int64), n * value[np.searchsorted(key, both & np.uint64((1 << int(bits)) - 1))], len(size))


def score(docs: DataFrame, depth: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each document."""
    docs = docs.select("doc_id", "text")
    counts = durable(corpus_counts(docs, depth), "counts")
    words = counts.where(f"key < 0 OR key = {END_TOKEN}")
    seen = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, types = seen["n"] or 0, seen["v"]
    ends = (words.where(F.col("key") == END_TOKEN).first() or {"n": 0})["n"]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
    held = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(int(blocks))).alias("block"), "doc_id", "text")

    parts = int(2 * blocks + 1)

    def vocabulary(table: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.uint64)]
        for batch in table.to_batches():
            for part in text_slices(batch):
                found.append(hash_words(split_words(part.column("text"))[0]) | WORD)
                found += [counted(grams(piece.column("text"), depth)[0])[0] for piece in text_slices(part, max_bytes=GRAM_SLICE)]
        keys = np.unique(np.concatenate(found))
        part = np.mod(keys.view(np.int64), parts)
        some = [(int(i), keys[part == i]) for i in np.unique(part)]
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(some), pa.int64()), "part": pa.array([i for i, _ in some], pa.int64()), "n": pa.array([len(k) for _, k in some], pa.int64()), "keys": pa.array([packed(np.diff(k, prepend=np.uint64(0))) for _, k in some], pa.binary())})

    def found(values: pa.Table, wanted: pa.Table) -> pa.Table:
        key = values.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        key, value = key[order], values.column("value").to_numpy()[order]
        out = []
        for n, data in zip(wanted.column("n").to_pylist(), wanted.column("keys").to_pylist(), strict=True):
            own = np.cumsum(unpacked(data, n, np.uint64), dtype=np.uint64)
            at = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
            out.append(packed(np.where(key[at] == own, value[at], 0.0) if len(key) else np.zeros(n)))
        return pa.table({"block": wanted.column("block"), "n": wanted.column("n"), "keys": wanted.column("keys"), "found": pa.array(out, pa.binary())})

    values = words.select("key", F.col("n").cast("double").alias("value")).unionByName(gram_scores(counts, depth)).withColumn("part", F.pmod("key", F.lit(parts)))
    wanted = held.groupBy("block").applyInArrow(vocabulary, "block bigint, part bigint, n bigint, keys binary")
    known = values.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(found, "block bigint, n bigint, keys binary, found binary")
    rest = math.log10(tokens + types + 1)

    def scored(texts: pa.Table, vocabulary: pa.Table) -> pa.Table:
        sizes, keys, values = (vocabulary.column(c).to_pylist() for c in ("n", "keys", "found"))
        key = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(unpacked(k, m, np.uint64), dtype=np.uint64) for k, m in zip(keys, sizes, strict=True))])
        order = np.argsort(key)
        key, n = key[order], np.concatenate([np.zeros(0), *(unpacked(x, m, np.float64) for x, m in zip(values, sizes, strict=True))])[order]
        out = []
        for batch in texts.to_batches():
            for part in text_slices(batch):
                word, codes, offsets = split_words(part.column("text"))
                own = hash_words(word) | WORD
                at = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
                c = np.where(key[at] == own, n[at], 0.0) if len(key) else np.zeros(len(own))
                doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                log_c = np.bincount(doc, np.log10(c + 1.0)[codes], part.num_rows) + math.log10(ends + 1)
                n_tokens = np.diff(offsets) + 1
                n_known = np.bincount(doc, (c > 0)[codes], part.num_rows).astype(np.int64) + int(ends > 0)
                value = np.concatenate([text_scores(x.column("text").slice(i, MAX_DOCS), depth, key, n) for x in text_slices(part, max_bytes=GRAM_SLICE * 2) for i in range(0, x.num_rows, MAX_DOCS)])
                length = pc.fill_null(pc.binary_length(part.column("text")), 0).to_numpy(zero_copy_only=False)
                ids = part.column("doc_id")
                rows = {"doc_id": ids, "held_out": ~training(ids.to_pylist()), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(part.num_rows, tokens, np.int64), "base_score": log_c - n_tokens * rest, "score": value, "bits_per_byte": -value / math.log10(2) / (length + 1)}
                out.append(pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in rows.items()}))
        return pa.concat_tables(out) if out else schema.empty_table()

    kind = dict(docs.dtypes)["doc_id"]
    schema = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
    result = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return held.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(scored, result)
