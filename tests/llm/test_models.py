"""Operators 2 and 6: held-out accuracy and a direct context-tree weighting."""

import math
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from statuslake.llm import cotraining, ctw

from .conftest import LOWER, words


def test_quality_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    got = cotraining.scored(docs, train).join(test, "doc_id").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in got) >= 0.95 * len(got)
    assert cotraining.scored(docs, train).count() == docs.count()
    model = cotraining.fit(docs, train)
    assert len(model.history) == 8 and {h["from"] for h in model.history} == {"text", "metadata"}


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (6, 1), (None, 0), (9, None)], "doc_id bigint, quality int")
    got = cotraining.scored(odd, labels).collect()
    assert len(got) == odd.count() and all(r["kept"] for r in got)
    both = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    got = cotraining.scored(odd, both).collect()
    assert len(got) == odd.count() and all(0 <= r["quality_score"] <= 1 for r in got)
    assert cotraining.scored(empty, labels).count() == 0
    assert cotraining.scored(odd, labels.where("doc_id > 99")).count() == odd.count()
    model = cotraining.fit(odd, both)
    assert cotraining.score(odd, model).columns == [*odd.columns, "text_score", "meta_score", "quality_score", "kept"]


def test_the_whole_pool_takes_part(spark):
    word = lambda i, k: f"{'good' if i % 2 else 'bad'}{k}"
    rows = [(i, " ".join(word(i, (i + k) % 9) for k in range(4)), "en", f"s{i % 2}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)
    labels = docs.where("doc_id < 100").selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    model = cotraining.fit(docs, labels)
    # a round takes 5 % of the 7,900 unlabelled documents
    assert all(h["good"] + h["bad"] == pytest.approx(395, abs=1) for h in model.history)
    got = cotraining.score(docs, model).collect()
    assert sum(r["kept"] == bool(r["doc_id"] % 2) for r in got) >= 0.99 * len(got)


def test_weights_by_hand(spark, sf_dir):
    """Co-training with sets and dictionaries gives the same weights; scores of labelled rows leave out their fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = cotraining.fit(docs, labels, rounds=2)
    draw = "pmod(xxhash64(doc_id, text, 'draw'), 1073741824) / 1073741824"
    table = docs.selectExpr("doc_id", "text", "lang", "source", f"{draw} AS draw").toArrow()
    views = [[np.split(f, o[1:-1]) for f, o in [v]][0] for v in cotraining.views(table.combine_chunks().to_batches()[0])]
    ids, draws = table.column("doc_id").to_pylist(), table.column("draw").to_pylist()
    given = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = sum(given.values()) / len(given)
    free = [i for i, d in enumerate(ids) if d not in given]
    known = [{i: given[d] for i, d in enumerate(ids) if d in given} for _ in (0, 1)]

    def weigh(v):
        n = [max(sum(y == c for y in known[v].values()), 1) for c in (0, 1)]
        share = n[1] / sum(n)
        have = [Counter(f for i, y in known[v].items() if y == c for f in views[v][i].tolist()) for c in (0, 1)]
        return {f: math.log((have[1][f] + share) / n[1]) - math.log((have[0][f] + 1 - share) / n[0]) for f in range((cotraining.TEXT_SIZE, cotraining.META_SIZE)[v])}

    take = max(2, int(0.05 * len(free)))
    for _ in range(2):
        weights, new = [weigh(v) for v in (0, 1)], [{}, {}]
        for v in (0, 1):
            step = {i: math.floor(sum(weights[v][f] for f in views[v][i].tolist()) / max(len(views[v][i]), 1) * cotraining.STEPS) for i in free if i not in known[1 - v]}
            for y, want in ((0, max(1, round(take * (1 - good)))), (1, max(1, round(take * good)))):
                order = sorted(step.values(), reverse=y == 1)
                at = order[min(want, len(order)) - 1]
                before = sum((s > at) if y else (s < at) for s in step.values())
                part = (want - before) / sum(s == at for s in step.values())
                for i, s in step.items():
                    if (s > at or s == at and draws[i] < part) if y else (s < at or s == at and draws[i] >= 1 - part):
                        new[1 - v][i] = y
        for v in (0, 1):
            known[v] |= new[v]
    for v, got in ((0, model.text), (1, model.meta)):
        want = weigh(v)
        assert np.allclose(got, [want[f] for f in range(len(got))])
    assert (model.combine[:2] >= 0).all() and all(c[0] >= 0 for c in model.calibrate)


@pytest.mark.parametrize("sf, n", [("sf0.001", 20), ("sf0.001", 80), ("sf0.01", 400)])
def test_few_labels(spark, sf_dir, sf, n):
    """Weights are never negative, and at most 3 % of the good documents go, however few labels there are."""
    path = sf_dir.replace("sf0.001", sf)
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = cotraining.fit(docs, labels.orderBy("doc_id").limit(n))
    assert (model.combine[:2] >= 0).all() and all(c[0] >= 0 for c in model.calibrate)
    good = cotraining.score(docs, model, 0.3).join(labels.where("quality = 1"), "doc_id")
    assert good.where("NOT kept").count() <= 0.03 * good.count()


def test_quality_without_metadata_columns(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    bare = odd.select("doc_id", "text")
    assert cotraining.score(bare, cotraining.fit(bare, labels)).count() == odd.count()


def direct(train: list[bytes], depth: int):
    """Mixture probabilities straight from the recursion, over all contexts seen."""
    counts = Counter()
    for t in train:
        data = b"\0" * depth + t + b"\xff"
        for i in range(depth, len(data)):
            for k in range(8):
                node, bit = (1 << k) | (data[i] >> (8 - k)), (data[i] >> (7 - k)) & 1
                for d in range(depth + 1):
                    counts[d, data[i - d : i], node, bit] += 1
    children = {}
    for d, ctx, node, _ in counts:
        if d:
            children.setdefault((d - 1, ctx[1:], node), set()).add(ctx)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    @cache
    def weighted(d, ctx, node):
        own = kt(counts[d, ctx, node, 0], counts[d, ctx, node, 1])
        if d == depth:
            return own
        below = sum(weighted(d + 1, c, node) for c in children.get((d, ctx, node), ()))
        return math.log(0.5) + np.logaddexp(own, below)

    def one(ctx, node, d=0):
        c = ctx[len(ctx) - d :]
        a, b = counts[d, c, node, 0], counts[d, c, node, 1]
        p = (b + 0.5) / (a + b + 1)
        if d == depth or not a + b:
            return p
        stop = math.exp(math.log(0.5) + kt(a, b) - weighted(d, c, node))
        return stop * p + (1 - stop) * one(ctx, node, d + 1)

    def score(t: bytes) -> float:
        data, out = b"\0" * depth + t + b"\xff", 0.0
        for i in range(depth, len(data)):
            for k in range(8):
                node, bit = (1 << k) | (data[i] >> (8 - k)), (data[i] >> (7 - k)) & 1
                p = one(data[i - depth : i], node)
                out += math.log10(p if bit else 1 - p)
        return out

    return score


def test_code_lengths_follow_the_recursion(spark):
    texts = ["abracadabra", "Alpha beta alpha", "", None, "abra abra", "été", "cab"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in ctw.score(docs, depth=3).collect()}
    train = [(t or "").translate(LOWER).encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    score = direct(train, 3)
    for i, t in enumerate(texts):
        assert got[i]["score"] == pytest.approx(score((t or "").translate(LOWER).encode()), rel=1e-9, abs=1e-9)


def test_rare_contexts_stay_in_a_large_corpus(spark):
    texts = ["ab" * 140_000, "xyzzy plugh", "xyzzy plover", "aab xyzz"]
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 != 2]
    docs = spark.createDataFrame([*zip(ids, texts, strict=False)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in ctw.score(docs, depth=4).collect()}
    score = direct([t.encode() for t in texts], 4)
    for i, t in list(zip(ids, texts, strict=False))[1:]:
        assert got[i] == pytest.approx(score(t.encode()), rel=1e-9)


def test_probabilities_sum_to_one():
    table = pa.table({"d": pa.array([0, 1], pa.int32()), "ctx": pa.array([0, 97]), "node": pa.array([1, 1]), "n0": pa.array([5, 3]), "n1": pa.array([2, 1])})
    tree = ctw.weighted(table, 2)
    grams = (np.uint64(98 << 16 | 97 << 8)) + np.arange(256, dtype=np.uint64)
    assert (10 ** tree.log10_of(grams)).sum() == pytest.approx(1.0)


def test_base_and_edges(odd, empty):
    rows = [(r["doc_id"], words(r["text"]) + [None]) for r in odd.collect()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 3)) for i, ws in rows)
    got = ctw.score(odd).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert ctw.score(empty).count() == 0
