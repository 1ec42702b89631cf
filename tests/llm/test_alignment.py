"""Alignment against both libraries and plain loops."""

import base64
import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from statuslake.llm import alignment
from statuslake.llm.bpe import byte_letters

A, B = (public_tokenizers.path(x) for x in (alignment.A_FILE, alignment.B_FILE))


def by_hand(texts):
    """One result for each text, from whole texts and plain dictionaries."""
    pair = alignment.Pair(A, B)
    letter = {c: i for i, c in enumerate(byte_letters())}
    name = {i: t for t, i in pair.a.get_vocab().items()}
    groups = []
    for t in texts:
        if not t:
            groups.append([])
            continue
        a = pair.a.encode(" " + t, add_special_tokens=False).ids
        b = pair.b.encode(t)
        bytes_a = [bytes(letter[c] for c in name[i]) if i != 50256 else name[i].encode() for i in a]
        bytes_b = [bytes([int(p[3:-1], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(pair.b.id_to_piece, b)]
        if b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            groups.append([])
            continue
        end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted(set(end_a) & set(end_b))
        of = [([], []) for _ in cuts]
        for i, e in zip(a, end_a):
            of[bisect.bisect_left(cuts, e)][0].append(i)
        for i, e in zip(b, end_b):
            of[bisect.bisect_left(cuts, e)][1].append(i)
        groups.append(of)
    links = [Counter((x, y) for xs, ys in g for x in xs for y in ys) for g in groups]
    count = Counter(p for c in links for p in c)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for g, c in zip(groups, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in c.items()),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return out


def counts_of(texts):
    """In how many texts each id pair is linked, from the groups of whole texts."""
    pair = alignment.Pair(A, B)
    count = Counter()
    for t in texts:
        a, _, b, _ = pair.encode([t]) if t else ((), 0, (), 0)
        if not len(a):
            continue
        end_a, end_b = (np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((pair.a_bytes, a), (pair.b_bytes, b)))
        cuts = sorted(set(end_a) & set(end_b))
        of = [([], []) for _ in cuts]
        for k, (ids, ends) in enumerate(((a, end_a), (b, end_b))):
            for i, e in zip(ids, ends):
                of[bisect.bisect_left(cuts, e)][k].append(i)
        count.update({(x, y) for xs, ys in of for x in xs for y in ys})
    return count


def rows_of(df):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return Counter((r["doc_id"], *(r[c] for c in names)) for r in df.collect())


def test_documents(spark, documents):
    rows = documents.collect()
    want = by_hand([r["text"] for r in rows])
    assert rows_of(alignment.align(documents.repartition(3))) == Counter((r["doc_id"], *w) for r, w in zip(rows, want))


def test_odd_texts(spark, odd, empty):
    rows = odd.collect()
    want = by_hand([r["text"] for r in rows])
    got = alignment.align(odd)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == Counter((r["doc_id"], *w) for r, w in zip(rows, want))
    assert alignment.align(empty).count() == 0
    only = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["n_links"], r["groups_sha256"]) for r in alignment.align(only).collect()) == [(0, 0, ""), (1, 0, ""), (2, 0, "")]


def test_white_space_marks_and_long_runs(spark):
    random.seed(11)
    parts = [" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "　", "▁", "<0x41>", "<s>", "<|endoftext|>", "don't", "I'LL", "naïve", "日本語", "😀👍", "\0", "123456", "--!!", "é", "foo", "Bar", "ﬁ", "﻿", "​", "'", "s"]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(1, 12))) for _ in range(1500)]
    texts += [" " * 300, "a" * 5000, "=" * 4001, "ab" * 3000, "\n" * 77, "x\n y \n  z", "é" * 900, "🙂" * 400, "1" * 999]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(docs).collect()}
    assert [got[i] for i in range(len(texts))] == by_hand(texts)


def test_small_blocks_give_the_same(spark, documents, monkeypatch):
    some = documents.where("doc_id < 60")
    want = rows_of(alignment.align(some))
    assert rows_of(alignment.align(some, block_bytes=20_000)) == want
    monkeypatch.setattr(alignment, "WIDE", 2)
    rows = some.collect()
    block = alignment.Block(alignment.Words(alignment.tokenizers_of(A, B)))
    block.add(pa.array([r["doc_id"] for r in rows]), pa.array([r["text"] for r in rows]))
    made = block.record(0)
    assert sum(made["n_links"]) == sum(n * k[4] for k, n in want.items())
    held = Counter(dict(zip(made["pairs"].tolist(), made["held"].tolist())))
    assert held == Counter({p[0] * 32000 + p[1]: n for p, n in counts_of([r["text"] for r in rows]).items()})


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(1, 9))
def test_pieces_of_any_width(x, y, width):
    """Pieces emit the overlaps that pairwise comparison finds, whatever their width."""
    a, b = (np.array(sorted(z | {61}), np.int64) for z in (x, y))
    group, i, j = alignment.merge_ends(a, b, width)
    cuts = sorted((x | {61}) & (y | {61}))
    spans = [list(zip([0, *z[:-1].tolist()], z.tolist())) for z in (a, b)]
    want = {(bisect.bisect_left(cuts, min(e, h)), p, q) for p, (s, e) in enumerate(spans[0]) for q, (g, h) in enumerate(spans[1]) if s < h and g < e}
    assert set(zip(group.tolist(), i.tolist(), j.tolist())) == want and len(group) == len(want)


def test_token_bytes(spark):
    """The byte tables agree with the ranks of the same vocabulary."""
    pair = alignment.tokenizers_of(A, B)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
    assert all(pair.a_bytes[i] == t for i, t in ranks.items()) and pair.cuts
    assert pair.b_size == 32000
