"""Repairs against a plain shortest path over whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from statuslake.llm import conversations as cv

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def shortest(rows):
    """Cost, audit and repaired rows by a search over (cost, audit) for each state, row by row."""
    ways = {0: (0, "", [])}  # states as in the grammar; 0 nothing, 1 system, 2 user, 3 assistant
    after = lambda s: 3 if s == 2 else 2
    name = {2: "user", 3: "assistant"}

    def better(table, s, way):
        if s not in table or way[:2] < table[s][:2]:
            table[s] = way

    def inserted(ways):
        ways = dict(ways)
        for _ in range(4):
            for s, (c, a, o) in list(ways.items()):
                better(ways, after(s), (c + 2, a + "I", [*o, (name[after(s)], "")]))
        return ways

    for role, text, fault in rows:
        new = {}
        for s, (c, a, o) in inserted(ways).items():
            better(new, s, (c + 3, a + "D", o))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            better(new, after(s), (c + 2 + extra, a + "R", [*o, (name[after(s)], text)]))
            to = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(role[:1])
            if to:
                better(new, to, (c + extra, a + "K", [*o, (role, text)]))
        ways = new
    ends = inserted(ways)
    return min((ends[s] for s in (0, 3) if s in ends), key=lambda w: w[:2])


def by_hand(rows, hurt=True):
    of = defaultdict(list)
    for r in rows:
        of[r[0]]
    for r in damaged(rows) if hurt else rows:
        of[r[0]].append(r[1:])
    out = {}
    for conv, own in of.items():
        if not own:
            out[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
            continue
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, marked = set(), []
        for _, role, text in own:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, fixed = shortest(marked)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in fixed))
        n = [sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, part int, kind int, piece string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "c", 1, 2, "p") for r in rows], SCHEMA).repartition(parts)


def result(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def check(spark, rows, hurt=True):
    df = frame(spark, rows)
    out = cv.digests(df, cv.damaged(df) if hurt else df)
    assert out.columns == ["conv_id", *COLUMNS]
    got, want = result(out), by_hand(rows, hurt)
    assert got.keys() == want.keys() and out.count() == len(want)
    for k in want:
        assert got[k] == want[k], k


@pytest.fixture
def many_parts(spark):
    """Small partitions, so that conversations are cut."""
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert result(cv.digests(df, cv.damaged(df))) == by_hand(rows)


def test_random_conversations_over_many_partitions(spark, many_parts):
    random.seed(3)
    roles = ["system", "user", "assistant", "tool", "", None, "u", "sx"]
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "Why? ", "x . y", "\xa0", "."]
    rows = []
    for c in range(60):
        for t in range(random.choice([1, 2, 3, 6, 12])):
            rows.append((c if c else None, t * (1 + c % 3), random.choice(roles), random.choice(texts)))
    check(spark, rows)


@pytest.mark.parametrize("kind", ["mixed", "strange", "blank", "repeats", "one turn"])
def test_a_conversation_longer_than_partitions(spark, many_parts, kind):
    """Vectors that never converge, long runs of rows that must go, repeats across partitions, one turn for all."""
    random.seed(len(kind))
    make = {
        "mixed": lambda i: (i, random.choice(["user", "assistant", "system", "tool"]), random.choice(["a.", "b", f"t{i}."])),
        "strange": lambda i: (i, "tool", f"t{i}."),
        "blank": lambda i: (i, "user" if i % 900 < 2 else "tool", "" if i % 900 > 2 else f"t{i}"),
        "repeats": lambda i: (i, "assistant", f"text {i % 40}."),
        "one turn": lambda i: (None if i % 2 else 4, f"user{i:06}", f"t{i}"),
    }[kind]
    rows = [(5, *make(i)) for i in range(3001)] + [(c, t, "user", "Hi.") for c in (4, 6, 7) for t in (0, 1)]
    check(spark, rows, hurt=False)


def test_nulls_empty_and_dropped(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (None, None, None, None), (1, None, "user", "Hi."), (1, 3, "user", None), (2, 0, "assistant", "x" * 50_000 + "."), (2, 1, "user", "y" * 2_000_000)]
    check(spark, rows)
    empty = frame(spark, rows).where("false")
    assert cv.digests(empty, cv.damaged(empty)).count() == 0


def test_pieces_keep_the_repaired_turns(spark):
    df = frame(spark, [(1, 0, "assistant", "So."), (1, 1, "user", "Why"), (1, 2, "user", "Why"), (2, 0, "user", "Hm."), (2, 1, "assistant", "Ah.")])
    got = {r["conv"]: r for r in cv.repair(df).collect()}
    assert got["=2"]["audit"] == "KK" and got["=2"]["roles"] == ["user", "assistant"] and got["=2"]["texts"] == ["Hm.", "Ah."]
    assert (got["=1"]["audit"], got["=1"]["cost"], got["=1"]["roles"], got["=1"]["texts"]) == ("IKDD", 8, ["user", "assistant"], ["", "So."])
