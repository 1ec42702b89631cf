"""Operators 4, 5, 7 and 8 against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter
from itertools import accumulate, groupby

import numpy as np

from statuslake.llm import decontaminate, minhash, sharding, vectors
from statuslake.llm.cluster import components as spark_components

from .conftest import LOWER, components, words


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def check_duplicates(docs, k):
    rows = docs.collect()
    sets = [(r["doc_id"], shingles(r["text"], k)) for r in rows]
    known = [(i, s) for i, s in sets if i is not None and s]
    links = [(a, b) for n, (a, s) in enumerate(known) for b, t in known[:n] if min(len(s), len(t)) * 100 >= 80 * max(len(s), len(t)) and 100 * len(s & t) >= 80 * len(s | t)]
    want = components([i for i, _ in sets if i is not None], links)
    got = minhash.near_duplicates(docs, shingle=k).collect()
    expected = Counter((i, len(s), want.get(i), i is None or want[i] == i) for i, s in sets)
    assert Counter(tuple(r) for r in got) == expected
    return links


def test_minhash(documents, odd, empty):
    assert check_duplicates(documents, 2)
    assert check_duplicates(odd, 2)
    check_duplicates(documents, 5)
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_chain_and_large_group(spark):
    """A chain whose ends differ is one component; a large group of near copies is too."""
    base = [f"w{i}" for i in range(60)]
    chain = [" ".join([*(f"x{j}" for j in range(3 * i)), *base[3 * i :]]) for i in range(8)]
    group = [" ".join([*(f"g{j}" for j in range(50)), f"own{i}"]) for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(chain + group)), "doc_id bigint, text string").repartition(4)
    check_duplicates(docs, 2)


def test_components(spark):
    import random

    random.seed(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(random.randint(200, 260), random.randint(200, 260)) for _ in range(50)]
    got = {r["id"]: r["component"] for r in spark_components(spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert all(got.get(n, n) == c for n, c in want.items())


def brute_hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, found = split(text), set(), set()
    for item, body in items:
        b = split(body)
        n = min(10, len(b))
        if not n:
            continue
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, sf_dir, documents, odd, empty):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    short = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma"), (3, None), (4, ""), (5, "one"), (6, "delta épsilon zeta"), (7, "x-y z q w e r t y u i o p")], "item_id bigint, text string")
    for docs, bench in ((documents, items), (odd, short), (odd, items)):
        known = [(r["item_id"], r["text"]) for r in bench.collect()]
        want = Counter((r["doc_id"], *map(str, brute_hits(r["text"], known))) for r in docs.collect())
        got = Counter((r["doc_id"], str(r["n_words"]), str(r["n_hit"]), str(r["items"])) for r in decontaminate.hits(docs, bench).collect())
        assert got == want
    none = short.where("item_id > 99")
    assert decontaminate.hits(odd, none).where("n_hit > 0").count() == 0
    assert decontaminate.hits(empty, short).count() == 0
    kept = decontaminate.clean(odd, short)
    assert kept.columns == odd.columns
    want = sum(brute_hits(r["text"], [(r2["item_id"], r2["text"]) for r2 in short.collect()])[1] == 0 for r in odd.collect())
    assert kept.count() == want


def plain_schedule(sizes, shards):
    """Items one by one through a heap."""
    heap, out = [(0, i) for i in range(shards)], {size: [0] * shards for size, _ in sizes}
    for size, count in sorted(sizes, reverse=True):
        for _ in range(count):
            load, i = heapq.heappop(heap)
            out[size][i] += 1
            heapq.heappush(heap, (load + size, i))
    return out


def test_schedule_equals_dealing_one_by_one():
    rng = random.Random(3)
    for _ in range(500):
        sizes = list({rng.randint(1, 60): rng.randint(1, 80) for _ in range(rng.randint(0, 12))}.items()) + [(rng.randint(100, 5000), rng.randint(1, 2))]
        shards = rng.randint(1, 9)
        assert sharding.schedule(sizes, shards) == plain_schedule(sizes, shards)


def brute_shards(rows, shards):
    """Rows as (doc_id, size, crc32, shard) by scheduling the groups of equal texts one by one."""
    size = lambda t: len((t or "").encode()) + 1
    members = Counter(t for _, t in rows)
    groups = sorted(((n * size(t), hashlib.sha256(t.encode()).hexdigest() if t is not None else "null", t) for t, n in members.items()), key=lambda g: (-g[0], g[1]))
    dealt = plain_schedule(Counter(g[0] for g in groups).items(), shards)
    home = {t: next(s for s, end in enumerate(accumulate(dealt[total])) if place < end) for total, own in groupby(groups, key=lambda g: g[0]) for place, (_, _, t) in enumerate(own)}
    return Counter((i, size(t), zlib.crc32((t or "").encode()), home[t]) for i, t in rows)


def test_shards(spark, documents, odd, empty):
    many = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"{'ab' * (i % 5)}{i:05}") for i in range(4000)], "doc_id bigint, text string")
    for docs in (documents, odd, many):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = sharding.assign(docs, 8).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == brute_shards(rows, 8)
        for shard in range(8):
            own = sorted((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0) for r in got if r["shard"] == shard)
            assert [slot for slot, *_ in own] == list(range(len(own)))
            assert [k for _, *k in own] == sorted(k for _, *k in own)
    assert sharding.assign(empty, 8).count() == 0


def check_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, id int, n int").repartition(3)
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for k, (a, x) in enumerate(good) for b, y in good[:k] if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95]
    want, n = components({r[0] for r in rows if r[0] is not None}, links), Counter(x for link in links for x in link)
    got = Counter(tuple(r) for r in vectors.near_duplicates(df).collect())
    assert got == Counter((i, n[i] if i is not None else 0, want.get(i), i is None or want[i] == i) for i, *_ in rows)
    return links


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    near = [(base[i % 12] + rng.normal(size=16) * s).tolist() for i, s in enumerate(rng.uniform(0, 0.4, 150))]
    odd_ones = [None, [], [0.0] * 16, [float("nan"), *[1.0] * 15], [float("inf"), *[1.0] * 15], [None, *[1.0] * 15], [1.0, 2.0], [2.0, 4.0], near[0], near[0], [1e30] * 16, [1e-30] * 16]
    rows = [(i, v, 0, 1, 2) for i, v in enumerate(near + odd_ones)] + [(None, near[0], None, 1, 2)]
    assert check_vectors(spark, rows)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_vectors_in_pieces(spark, monkeypatch):
    """Cells beyond the bound are cut into pieces without losing a pair."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 16)
    rng = np.random.default_rng(6)
    one = rng.normal(size=8)
    check_vectors(spark, [(i, (one + rng.normal(size=8) * 0.15).tolist(), 0, 1, 2) for i in range(120)])


def test_vectors_of_64_dimensions(spark):
    """The production parameters on links near the threshold."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(20, 64))
    assert len(check_vectors(spark, [(i, (base[i % 20] + rng.normal(size=64) * s).tolist(), 0, 1, 2) for i, s in enumerate(rng.uniform(0.1, 0.35, 600))])) > 500


def shuffled_mb(spark):
    """What all stages of the session have written to be shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) / 1e6


def test_vectors_are_not_copied(spark):
    """What is shuffled stays near the size of the vectors, however many pairs they make; links across blocks are found."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 64))
    x[2000:2100] = x[:100] * 2 + rng.normal(size=(100, 64)) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    before = shuffled_mb(spark)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    assert shuffled_mb(spark) - before < 4 * x.size * 4 / 1e6
    assert all(got[i] == ((1, i % 2000) if i % 2000 < 100 and i < 2100 else (0, i)) for i in range(4000))
