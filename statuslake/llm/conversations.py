r"""Repair of the structure of conversations at the least cost.

Turns should be an optional system turn and pairs of a user and an assistant turn.  Rows may be kept (0), given the role
user or assistant (2) or deleted (3); empty turns may be inserted anywhere (2); blank rows and repeats of an earlier role
and text must go; a truncated row that stays costs 1.  Of the cheapest series of edits, written as initials in order, the
first in ASCII order is taken.

Costs from a row to the end, one for each state of the grammar, follow from those of the next row: a Viterbi pass from
the end.  A conversation may be longer than a partition: rows are sorted over the cluster by range, and what a partition
holds of a conversation, its chunk, starts from a speculative vector of costs, all chunks at once.  Fix-up passes run a
chunk again from the vector that the chunk after it came to, until both runs differ by a constant only, from where on the
rest of the first run holds; a chunk remembers the vectors it was run from, of which there are few up to a constant, so
there are few passes however many chunks stand one after the other.  Costs are stitched by the constants, and edits are
traced forward from the state in which the chunk before ends.  Which chunks follow each other is known from at most two
of them in each partition; only their vectors and states reach the driver.

A conversation inside one partition, of at most ``PIECE_ROWS`` rows and ``PIECE_BYTES`` of text, is repaired where it is
read.  All others are written in such pieces.

Defined results: null role and text count as one space; rows of a conversation are taken by turn, nulls first, then by
role, then by a hash of role and text; a null conv_id is a conversation of its own; conversations of equal conv_id as
text are one; other columns are not read; an empty table gives an empty table.  The audit of a conversation is one value,
and the digest of its text is computed in order, so both pass through one task each, a piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import durable

PIECE_ROWS = 1024
PIECE_BYTES = 1 << 20
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: States: nothing yet, after a system, user and assistant turn; a conversation may end in the first and the last.
NEXT = (2, 2, 3, 2)
TURN = {2: "user", 3: "assistant"}
#: Costs at the end: turns that are still to be inserted.
END = (0, 4, 2, 0)
SPECULATIVE = (0, 0, 0, 0)
KEEP_TO = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)


def code_of(role: str, fault: int) -> int:
    return "sua".find(role[:1]) % 4 * 4 + fault if role else 12 + fault


class Steps:
    """One step of costs and of tracing, remembered for each vector of costs up to a constant."""

    def __init__(self):
        self.back: dict = {}
        self.trace: dict = {}

    def before(self, after: tuple, code: int) -> tuple[tuple, int]:
        """The vector ahead of a row, from the one behind it: up to a constant, and the constant."""
        found = self.back.get((after, code))
        if found is None:
            role, fault = divmod(code, 4)
            v = []
            for s in range(4):
                best = 3 + after[s]
                if fault <= TRUNCATED:
                    best = min(best, 2 + fault + after[NEXT[s]])
                    if s in KEEP_TO[role]:
                        best = min(best, fault + after[KEEP_TO[role][s]])
                v.append(best)
            for _ in range(3):
                v = [min(v[s], 2 + v[NEXT[s]]) for s in range(4)]
            low = min(v)
            found = self.back[after, code] = tuple(x - low for x in v), low
        return found

    def edits(self, after: tuple, code: int, state: int) -> tuple[str, int]:
        """The first of the cheapest edits up to and at a row, and the state behind it."""
        found = self.trace.get((after, code, state))
        if found is None:
            role, fault = divmod(code, 4)
            ahead, low = self.before(after, code)
            out, s = "", state
            while True:
                want = ahead[s] + low
                if 3 + after[s] == want:
                    out, to = out + "D", s
                    break
                if 2 + ahead[NEXT[s]] + low == want:
                    out, s = out + "I", NEXT[s]
                    continue
                if s in KEEP_TO[role] and fault <= TRUNCATED and fault + after[KEEP_TO[role][s]] == want:
                    out, to = out + "K", KEEP_TO[role][s]
                    break
                out, to = out + "R", NEXT[s]
                break
            found = self.trace[after, code, state] = out, to
        return found

    def run(self, codes: bytes, end: tuple) -> tuple[list[tuple], int]:
        """The vectors behind each row, first the one ahead of all, and the constant of that one."""
        vectors, shift = [end], 0
        for c in reversed(codes):
            end, low = self.before(end, c)
            vectors.append(end)
            shift += low
        return vectors[::-1], shift

    def rerun(self, codes: bytes, end: tuple, old: tuple, old_start: tuple, old_shift: int) -> tuple[tuple, int]:
        """Start vector and constant from ``end``, stopping where it meets the run from ``old`` but for a constant."""
        more = 0
        for c in reversed(codes):
            if end == old:
                return old_start, old_shift + more
            (end, low), (old, old_low) = self.before(end, c), self.before(old, c)
            more += low - old_low
        return end, old_shift + more

    def follow(self, codes: bytes, vectors: list[tuple], state: int) -> tuple[list[str], int]:
        out = []
        for k, c in enumerate(codes):
            letters, state = self.edits(vectors[k + 1], c, state)
            out.append(letters)
        return out, state


def closing(state: int) -> str:
    """Turns inserted behind the last row."""
    return "I" * (END[state] // 2)


def repaired(roles: list[str], texts: list[str], edits: list[str], state: int, tail: str = "") -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of each row and ``tail`` behind them."""
    out_roles, out_texts = [], []
    for k, letters in enumerate([*edits, tail]):
        for e in letters:
            if e == "D":
                continue
            if e == "K":
                role, text = roles[k], texts[k]
                state = KEEP_TO["sua".find(role[0])][state]
            else:
                state = NEXT[state]
                role, text = TURN[state], "" if e == "I" else texts[k]
            out_roles.append(role)
            out_texts.append(text)
    return out_roles, out_texts


def counts(codes: bytes) -> list[int]:
    """blank, duplicate, truncated, and neighbours whose roles may not follow each other."""
    n = [sum(c % 4 == f for c in codes) for f in (BLANK, DUPLICATE, TRUNCATED)]
    return [*n, sum((a // 4, b // 4) not in FOLLOW for a, b in zip(codes, codes[1:]))]


FOLLOW = {(0, 1), (1, 2), (2, 1)}
PIECES = (
    "conv string, part bigint, piece int, closed boolean, codes binary, digests array<binary>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "first_turn bigint, last_turn bigint, turns bigint, audit string, roles array<string>, texts array<string>"
)


class Gathering:
    """Rows of the conversation that is being read; what is full or finished comes out as a piece."""

    def __init__(self, steps: Steps, part: int):
        self.steps, self.part, self.conv, self.inner = steps, part, None, False
        self.clear()
        self.seen: set[bytes] = set()
        self.piece, self.started = 0, False

    def clear(self):
        self.roles, self.texts, self.turns, self.digests, self.codes, self.size = [], [], [], [], bytearray(), 0

    def row(self, turn: int | None, role: str, text: str):
        body = text.rstrip(WHITE)
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
        known = digest in self.seen
        self.seen.add(digest)
        fault = BLANK if not body else DUPLICATE if known else FINE if body[-1] in ENDS else TRUNCATED
        self.codes.append(code_of(role, fault))
        self.digests.append(b"" if known else digest)
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.codes) >= PIECE_ROWS or self.size >= PIECE_BYTES

    def take(self, closed: bool) -> list:
        """The piece that the rows make up; finished if ``closed``, which a conversation without earlier pieces may be."""
        codes, known = bytes(self.codes), [t for t in self.turns if t is not None]
        span = [known[0], known[-1]] if known else [None, None]
        facts = [self.conv, self.part, self.piece, closed]
        turns = len(set(known))
        if closed:
            vectors, shift = self.steps.run(codes, END)
            edits, state = self.steps.follow(codes, vectors, 0)
            tail = closing(state)
            out = repaired(self.roles, self.texts, edits, 0, tail)
            row = [*facts, None, None, *counts(codes), shift + vectors[0][0], *span, turns, "".join(edits) + tail, *out]
        else:
            row = [*facts, codes, self.digests, 0, 0, 0, 0, 0, *span, turns, "", self.roles, self.texts]
        self.piece += 1
        self.clear()
        return row


def pieces(rows: DataFrame) -> DataFrame:
    """Sorted rows, as finished conversations and as pieces of those that are long or touch an end of their partition."""
    fields = [c.strip().split(" ")[0] for c in PIECES.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        now, out, held = Gathering(Steps(), TaskContext.get().partitionId()), [], 0
        schema = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("piece", pa.int32()), ("closed", pa.bool_()), ("codes", pa.binary()), ("digests", pa.list_(pa.binary())), *((c, pa.int64()) for c in fields[6:14]), ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out.clear()
            return batch

        first = True
        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text"))):
                if conv != now.conv:
                    if now.conv is not None:
                        held += now.size
                        if now.codes:
                            out.append(now.take(not first and now.piece == 0))
                        first = False
                    now.conv, now.piece, now.seen = conv, 0, set()
                elif now.full():
                    held += now.size
                    out.append(now.take(False))
                if len(out) >= PIECE_ROWS or held >= PIECE_BYTES:
                    yield emit()
                    held = 0
                now.row(turn, role, text)
        if now.codes:
            out.append(now.take(False))
        if out:
            yield emit()

    return rows.select("conv", "turn", "role", "text").mapInArrow(run, PIECES)


def key() -> F.Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def in_order(conversations: DataFrame) -> DataFrame:
    """Rows sorted over the cluster; a conversation, a turn or equal rows may lie in several partitions."""
    filled = conversations.select(key().alias("conv"), F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    marked = filled.withColumn("tie", F.xxhash64("role", "text")).withColumn("spread", F.rand(7))
    return marked.repartitionByRange("conv", "turn", "role", "tie", "spread").sortWithinPartitions("conv", "turn", "role", "tie", "text")


def without_repeats(open_: DataFrame) -> DataFrame:
    """(conv, part, piece, again): rows of pieces whose role and text an earlier partition holds, by place."""
    # at most one conversation goes on from each partition to the next
    spans = open_.groupBy("conv").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("conv")
    each = open_.join(F.broadcast(spans), "conv").select("conv", "part", "piece", F.posexplode("digests").alias("place", "digest")).where("length(digest) > 0")
    at = F.struct("part", "piece", "place")
    # a partition has each digest of a conversation once
    first = each.groupBy("conv", "digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = each.join(first, ["conv", "digest"]).where(at > F.col("first"))
    return again.groupBy("conv", "part", "piece").agg(F.collect_list("place").alias("again"))


CHUNKS = (
    "conv string, part bigint, first boolean, last boolean, codes binary, sizes array<int>, head int, tail int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first_turn bigint, last_turn bigint, turns bigint, assumed array<int>, start array<int>, shift bigint"
)


def chunks(open_: DataFrame) -> DataFrame:
    """What each partition holds of a conversation, as codes, with its first run."""
    marked = open_.join(without_repeats(open_), ["conv", "part", "piece"], "left")
    parts = marked.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("piece", "codes", "again", "first_turn", "last_turn", "turns"))).alias("pieces"))
    whole = Window.partitionBy("conv")
    sided = parts.withColumn("first", F.col("part") == F.min("part").over(whole)).withColumn("last", F.col("part") == F.max("part").over(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                codes, sizes, span, turns = bytearray(), [], [None, None], 0
                for p in r["pieces"]:
                    own = bytearray(p["codes"])
                    for i in p["again"] or ():
                        if own[i] % 4 != BLANK:
                            own[i] = own[i] // 4 * 4 + DUPLICATE
                    codes += own
                    sizes.append(len(own))
                    if p["first_turn"] is not None:
                        turns += p["turns"] - (span[1] == p["first_turn"])
                        span = [p["first_turn"] if span[0] is None else span[0], p["last_turn"]]
                assumed = END if r["last"] else SPECULATIVE
                vectors, shift = steps.run(bytes(codes), assumed)
                out.append([r["conv"], r["part"], r["first"], r["last"], bytes(codes), sizes, codes[0] // 4, codes[-1] // 4, *counts(bytes(codes)), *span, turns, assumed, vectors[0], shift])
            yield arrow(out, CHUNKS)

    return sided.select("conv", "part", "first", "last", "pieces").mapInArrow(run, CHUNKS)


def arrow(rows: list, kinds: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    fields = [c.strip().split(" ") for c in kinds.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def fixed(made: DataFrame) -> list[tuple]:
    """(conv, part, end vector, state ahead, cost, illegal, turns) for chunks of conversations in several partitions.

    The last three are what the chunk adds to its conversation because of its neighbours.  There are at most two such
    chunks in each partition.
    """
    linked = made.where("NOT (first AND last)")
    facts = linked.drop("codes", "sizes").orderBy("conv", "part").collect()
    if not facts:
        return []
    spark = made.sparkSession
    of: dict[str, list] = {}
    known = {}
    for r in facts:
        of.setdefault(r["conv"], []).append(r)
        known[r["conv"], r["part"]] = {tuple(r["assumed"]): (tuple(r["start"]), r["shift"])}
    original = {k: next(iter(v.items())) for k, v in known.items()}
    while True:
        ends, again = {}, []
        for conv, rows in of.items():
            need = END
            for r in reversed(rows):
                at = conv, r["part"]
                ends[at] = need
                if need not in known[at]:
                    again.append((*at, list(need)))
                # until it is known, the vector of the first run is the best guess
                need = known[at].get(need, original[at][1])[0]
        if not again:
            break
        asked = F.broadcast(spark.createDataFrame(again, "conv string, part bigint, need array<int>"))

        def rerun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            steps = Steps()
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    start, shift = steps.rerun(r["codes"], tuple(r["need"]), tuple(r["assumed"]), tuple(r["start"]), r["shift"])
                    out.append([r["conv"], r["part"], r["need"], start, shift])
                yield arrow(out, "conv string, part bigint, need array<int>, start array<int>, shift bigint")

        for r in linked.join(asked, ["conv", "part"]).mapInArrow(rerun, "conv string, part bigint, need array<int>, start array<int>, shift bigint").collect():
            known[r["conv"], r["part"]][tuple(r["need"])] = tuple(r["start"]), r["shift"]
    asked = F.broadcast(spark.createDataFrame([(*k, list(v)) for k, v in ends.items()], "conv string, part bigint, need array<int>"))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                vectors, _ = steps.run(r["codes"], tuple(r["need"]))
                out.append([r["conv"], r["part"], [steps.follow(r["codes"], vectors, s)[1] for s in range(4)]])
            yield arrow(out, "conv string, part bigint, to array<int>")

    to = {(r["conv"], r["part"]): r["to"] for r in linked.join(asked, ["conv", "part"]).mapInArrow(states, "conv string, part bigint, to array<int>").collect()}
    out = []
    for conv, rows in of.items():
        state, before, last_turn = 0, None, None
        cost = known[conv, rows[0]["part"]][ends[conv, rows[0]["part"]]][0][0] + sum(known[conv, r["part"]][ends[conv, r["part"]]][1] for r in rows)
        for r in rows:
            at = conv, r["part"]
            illegal = int(before is not None and (before, r["head"]) not in FOLLOW)
            same = int(last_turn is not None and r["first_turn"] == last_turn)
            out.append((*at, list(ends[at]), state, cost, illegal, -same))
            state, before, cost = to[at][state], r["tail"], 0
            last_turn = r["last_turn"] if r["last_turn"] is not None else last_turn
    return out


TRACED = "conv string, part bigint, piece int, state int, edits array<string>, tail string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, first_turn bigint, last_turn bigint, turns bigint"


def traced(made: DataFrame) -> DataFrame:
    """The edits of each piece; counts and costs of a chunk stand with its first piece."""
    links = fixed(made)
    link = F.broadcast(made.sparkSession.createDataFrame(links, "conv string, part bigint, need array<int>, state int, cost bigint, more_illegal bigint, more_turns bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                codes = r["codes"]
                vectors, shift = steps.run(codes, tuple(r["need"] or END))
                state, at = r["state"] or 0, 0
                cost = r["cost"] if r["need"] else shift + vectors[0][0]
                facts = [r["blank"], r["duplicate"], r["truncated"], r["illegal"] + (r["more_illegal"] or 0), cost, r["first_turn"], r["last_turn"], r["turns"] + (r["more_turns"] or 0)]
                for piece, n in enumerate(r["sizes"]):
                    edits, to = steps.follow(codes[at : at + n], vectors[at:], state)
                    tail = closing(to) if r["last"] and piece + 1 == len(r["sizes"]) else ""
                    out.append([r["conv"], r["part"], piece, state, edits, tail, *facts])
                    state, at, facts = to, at + n, [0, 0, 0, 0, 0, None, None, 0]
            yield arrow(out, TRACED)

    return made.join(link, ["conv", "part"], "left").mapInArrow(run, TRACED)


def repair(conversations: DataFrame) -> DataFrame:
    """Repaired pieces of each conversation: conv (``key``), part and piece (their order), counts, cost, audit, roles, texts.

    A conversation's counts and costs are the sums over its pieces; most conversations are one piece, ``closed``.
    """
    made = durable(pieces(in_order(conversations)), "pieces")
    open_ = made.where("NOT closed")
    found = traced(durable(chunks(open_), "chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                roles, texts = repaired(r["roles"], r["texts"], r["edits"], r["state"], r["tail"])
                yield arrow([[r["conv"], r["part"], r["piece"], False, *(r[c] for c in NUMBERS), "".join(r["edits"]) + r["tail"], roles, texts]], REPAIRED)

    done = made.where("closed").select(*(c.strip().split(" ")[0] for c in REPAIRED.split(",")))
    return done.unionByName(open_.select("conv", "part", "piece", "roles", "texts").join(found, ["conv", "part", "piece"]).mapInArrow(run, REPAIRED))


NUMBERS = ("blank", "duplicate", "truncated", "illegal", "cost", "first_turn", "last_turn", "turns")
REPAIRED = "conv string, part bigint, piece int, closed boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, first_turn bigint, last_turn bigint, turns bigint, audit string, roles array<string>, texts array<string>"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, without full stops, repeated or of another role, by a checksum of conv_id and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    hurt = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), "kind")
    return made.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def digests(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A line for each conv_id of ``conversations``: counts, cost, audit and hash of the repair of ``rows``."""
    found = durable(repair(rows), "repaired")
    text = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    facts = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    closed = found.where("closed").select("conv", gaps, *facts, F.sha2(text, 256).alias("repaired_sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, lines = None, None, False
        for batch in batches:
            out = []
            for c, n, t in zip(*(batch.column(k).to_pylist() for k in ("conv", "n", "text"))):
                if c != conv:
                    if conv is not None:
                        out.append([conv, state.hexdigest()])
                    conv, state, lines = c, hashlib.sha256(), False
                if n:
                    state.update(("\n" * lines + t).encode())
                    lines = True
            yield arrow(out, "conv string, repaired_sha256 string")
        if conv is not None:
            yield arrow([[conv, state.hexdigest()]], "conv string, repaired_sha256 string")

    rest = found.where("NOT closed")
    hashes = rest.select("conv", "part", "piece", F.size("roles").alias("n"), text.alias("text")).repartition("conv").sortWithinPartitions("conv", "part", "piece").select("conv", "n", "text").mapInArrow(hashed, "conv string, repaired_sha256 string")
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "piece", "audit"))), lambda x: x["audit"]), "").alias("audit")
    sums = rest.groupBy("conv").agg(*(F.sum(c).alias(c) for c in facts[:-1]), F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), F.sum("turns").alias("turns"), audit)
    opened = sums.select("conv", gaps, *facts).join(hashes, "conv")
    ids = conversations.select("conv_id", key().alias("conv")).distinct()
    zero = {c: 0 for c in ("gaps", *facts[:-1])} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return ids.join(closed.unionByName(opened), "conv", "left").fillna(zero).select("conv_id", "gaps", *facts, "repaired_sha256")
