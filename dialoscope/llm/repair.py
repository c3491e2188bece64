"""Conversation structure repair: the cheapest edits that make roles follow ``(system)? (user assistant)+``, or nothing.

Edits of a row: keep (0), change its role to user or assistant (3), delete (4);
an empty user or assistant turn can be inserted anywhere (3).  Blank rows and
repeats must go; a truncated row that stays costs 3 more.  Among the cheapest
edits those whose initials (K, R, D, I) in order are the least string win.

The states between rows are four: nothing yet, after the system turn, after a
user, after an assistant.  A row is one of 12 codes (role by fault), and a code
is a 4 x 4 table of costs, so the cost of a stretch from every state is a vector
that is pushed row by row: forward with the order of the strings behind each
state, backward with costs alone.  Hirschberg: both vectors meet in the middle,
the crossing with the least string among the cheapest is chosen, both halves are
worked off alike, and nothing is kept but the codes and the edits.

No task needs a whole conversation for that.  Rows are range-partitioned by
conversation and place, so that a conversation with a third of all rows lies in
many ranges.  A conversation's part in one range (a piece) is summed up in 4 x 4
costs; the pieces of a conversation, at most one a range, meet at their borders
exactly as the halves do, and then each piece is solved by itself.  Repeats are
found inside a piece at once, across pieces by the hashes of those conversations
alone that reach over the end of a range.  What is read in one sequence are the
texts for the digest of a repaired conversation, a stream that holds one row.

Rows of a conversation are ordered by turn (nulls first), then role, the text's
first 64 characters and its hash.  A null role or text is one space, a null
conv_id a conversation of its own.  Only the first character of a role counts
(s, u, a; any other can't be kept).  Texts of any length are read whole; repeats
are told by 128-bit hashes of role and text.  Repeated rows are repeats.  Other
columns are not read.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoscope.llm import frames

# fixed values: costs of the edits
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. What follows each state and where it leads.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
FAR = 1 << 40
ROLES = "sua?"  # the code of a row is 4 * fault + role
KEEPS, GOES, CUT = 0, 1, 2
MADE = {"u": "user", "a": "assistant"}
SPACES = " \t\n\x0b\x0c\r"


def inserted(state: int) -> list[tuple[int, str]]:
    """States reached by inserting up to three turns, with the edits."""
    out, edits = [(state, "")], ""
    for _ in range(3):
        state, edits = next(STEPS[state][r] for r in "ua" if r in STEPS[state]), edits + "I"
        out.append((state, edits))
    return out


def table_of(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(from, to): (cost, edits), the cheapest and of these the least, for one row and what is inserted before it."""
    fault, role = divmod(code, 4)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        for state, edits in inserted(start):
            cost = INSERT * len(edits)
            ways = [(state, cost + DELETE, edits + "D")]
            if fault != GOES:
                cost += TRUNCATED if fault == CUT else 0
                if ROLES[role] in STEPS[state]:
                    ways.append((STEPS[state][ROLES[role]], cost, edits + "K"))
                ways.append((next(STEPS[state][r] for r in "ua" if r in STEPS[state]), cost + REROLE, edits + "R"))
            for to, c, e in ways:
                best[start, to] = min(best.get((start, to), (FAR, "")), (c, e))
    return best


TABLES = [table_of(code) for code in range(12)]
#: Edits behind the last row: from each state to one where a conversation may end.
TAILS = [min((INSERT * len(e), e) for s, e in inserted(start) if s in ENDS) for start in range(4)]


class Vectors:
    """Pushes cost vectors over codes; steps met before are looked up (there are few vectors up to a constant)."""

    def __init__(self) -> None:
        self.forth: dict = {}
        self.back: dict = {}

    def forward(self, codes: bytes, vector: tuple, ranks: tuple) -> tuple[list[int], tuple]:
        """Costs of all states behind the codes, and the order of the least strings that lead there."""
        base, known = 0, self.forth
        for code in codes:
            step = known.get((vector, ranks, code))
            if step is None:
                ways = []
                for to in range(4):
                    own = [(vector[s] + c, ranks[s], e) for (s, t), (c, e) in TABLES[code].items() if t == to and vector[s] < FAR]
                    ways.append(min(own, default=(FAR, 9, "")))
                order = sorted(range(4), key=lambda t: (ways[t][0] >= FAR, ways[t][1:]))
                low = min(w[0] for w in ways)
                step = known[vector, ranks, code] = (
                    low, tuple(w[0] - low if w[0] < FAR else FAR for w in ways), tuple(order.index(t) for t in range(4)))
            base, vector, ranks = base + step[0], step[1], step[2]
        return [v + base if v < FAR else FAR for v in vector], ranks

    def backward(self, codes: bytes, vector: tuple) -> list[int]:
        """Costs from every state in front of the codes, given those behind them."""
        base, known = 0, self.back
        for code in reversed(codes):
            step = known.get((vector, code))
            if step is None:
                ways = [min(min(FAR, c + vector[t]) for (f, t), (c, _) in TABLES[code].items() if f == s) for s in range(4)]
                low = min(ways)
                step = known[vector, code] = (low, tuple(w - low if w < FAR else FAR for w in ways))
            base, vector = base + step[0], step[1]
        return [v + base if v < FAR else FAR for v in vector]


def crossing(forth: list[int], ranks: tuple, back: list[int]) -> int:
    """The state of the cheapest way whose string is the least.

    Strings up to a border end with the edit of a row and hold one such edit a row, so none begins another:
    the least whole string passes the state with the least string so far.
    """
    cost = min(f + b for f, b in zip(forth, back))
    return min((ranks[s], s) for s in range(4) if forth[s] + back[s] == cost)[1]


def one(state: int) -> tuple:
    return tuple(0 if s == state else FAR for s in range(4))


def solve(codes: bytes, start: int, end: int, vectors: Vectors) -> str:
    """The edits of a stretch between two states."""
    out, todo = [], [(0, len(codes), start, end)]
    while todo:
        low, high, a, b = todo.pop()
        if high - low == 1:
            out.append(TABLES[codes[low]][a, b][1])
        elif high > low:
            mid = (low + high) // 2
            forth, ranks = vectors.forward(codes[low:mid], one(a), (0, 1, 2, 3))
            state = crossing(forth, ranks, vectors.backward(codes[mid:high], one(b)))
            todo += [(mid, high, state, b), (low, mid, a, state)]
    return "".join(out)


def summary(codes: bytes, vectors: Vectors) -> list[int]:
    """16 costs and 16 ranks: from each state to each state."""
    costs, ranks = [], []
    for state in range(4):
        c, r = vectors.forward(codes, one(state), (0, 1, 2, 3))
        costs += c
        ranks += r
    return costs + ranks


def borders(pieces: list[list[int]]) -> tuple[int, list[int]]:
    """The cost of a conversation, and the states in front of each piece and behind the last."""
    forth, ranks = [0, FAR, FAR, FAR], (0, 1, 2, 3)
    ahead = [(forth, ranks)]
    for p in pieces:
        ways = [min((forth[s] + p[4 * s + t], ranks[s], p[16 + 4 * s + t]) if forth[s] < FAR and p[4 * s + t] < FAR else (FAR, 9, t)
                    for s in range(4)) for t in range(4)]
        order = sorted(range(4), key=lambda t: (ways[t][0] >= FAR, ways[t][1:]))
        forth, ranks = [w[0] for w in ways], tuple(order.index(t) for t in range(4))
        ahead.append((forth, ranks))
    back = [c for c, _ in TAILS]
    cost = min(f + b for f, b in zip(forth, back))
    states = []
    for (forth, ranks), p in zip(reversed(ahead), [None, *reversed(pieces)]):
        if p is not None:
            back = [min(min(FAR, p[4 * s + t] + back[t]) for t in range(4)) for s in range(4)]
        states.append(crossing(forth, ranks, back))
    return cost, states[::-1]


def audit(codes: bytes) -> tuple[int, str]:
    """Cost and edits of one conversation held whole."""
    vectors = Vectors()
    cost, (start, end) = borders([summary(codes, vectors)]) if codes else (0, [0, 0])
    return cost, solve(codes, start, end, vectors) + TAILS[end][1]


def own_rows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with nulls replaced: numbers stay null in turn, texts become one space."""
    frames.bounded_batches(conversations.sparkSession)
    return conversations.select(
        F.coalesce(F.col(f"`{conv_id}`").cast("long"), F.lit(frames.NO_ID)).alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``own_rows`` with every twentieth lost, emptied, cut, repeated or given to the user, by crc32 of conv:turn."""
    shown = F.concat(F.coalesce(frames.shown_id("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(shown), F.lit(20))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies")) \
        .withColumn("copy", F.explode("copies")).drop("copies", "copy")


def ranged(rows: DataFrame) -> DataFrame:
    """Rows in order: (conv, part, seq, turn, role, text, code, h1, h2), repeats inside a part found; a stored table."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    solid = F.rtrim("text", F.lit(SPACES))
    fault = F.when(F.length(solid) == 0, GOES).when(F.substring(solid, -1, 1).isin(".", "!", "?"), KEEPS).otherwise(CUT)
    role = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    role = F.when((role > 0) & (F.length("role") > 0), role - 1).otherwise(3)
    both = F.concat("role", F.lit("\0"), "text")
    keyed = rows.withColumns({"code": (4 * fault + role).cast("tinyint"), "h1": F.xxhash64("role", "text"), "h2": F.xxhash64(both, F.length("role")),
                              "__role": F.substring("role", 1, 64), "__start": F.substring("text", 1, 64), "__row": F.monotonically_increasing_id()})
    order = ["conv", F.col("turn").asc_nulls_first(), "__role", "__start", "h1", "__row"]
    ordered = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "code", "h1", "h2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, conv, seen = TaskContext.get().partitionId(), 0, None, set()
        for batch in batches:
            codes = batch.column(4).to_numpy(zero_copy_only=False).copy()
            for i, (c, a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 5, 6)))):
                if c != conv:
                    conv, seen = c, set()
                if (a, b) in seen and codes[i] // 4 != GOES:
                    codes[i] = 12 + codes[i] % 4  # a repeat; told from a blank row until it is counted
                seen.add((a, b))
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(m, part, np.int32)), pa.array(np.arange(seq, seq + m)), *(batch.column(k) for k in (1, 2, 3)),
                 pa.array(codes, pa.int8()), batch.column(5), batch.column(6)],
                names=["conv", "part", "seq", "turn", "role", "text", "code", "h1", "h2"])
            seq += m

    return frames.stored(ordered.mapInArrow(
        run, "conv long, part int, seq long, turn long, role string, text string, code tinyint, h1 long, h2 long"))


def coded(ordered: DataFrame) -> DataFrame:
    """(conv, part, codes): one row a piece; repeats of an earlier piece are marked."""
    rows = ordered.select("conv", "part", "seq", "code")
    # at most two conversations of a part reach over its ends
    ends = ordered.groupBy("part").agg(F.min("conv").alias("a"), F.max("conv").alias("b"))
    wide = ends.select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("conv")).groupBy("conv").agg(F.count("*").alias("n")).where("n > 1")
    open_rows = ordered.where("code < 12 AND NOT code BETWEEN 4 AND 7").join(F.broadcast(wide.select("conv")), "conv", "left_semi")
    keys = open_rows.groupBy("conv", "h1", "h2", "part").agg(F.min("seq").alias("seq"))
    # one row a part and key
    first = keys.groupBy("conv", "h1", "h2").agg(F.min("part").alias("first"))
    later = keys.join(first, ["conv", "h1", "h2"]).where("part > first").select("part", "seq", F.lit(True).alias("later"))
    known = rows.join(later, ["part", "seq"], "left")
    code = F.when(F.col("later"), F.pmod("code", F.lit(4)) + 12).otherwise(F.col("code")).cast("tinyint")
    own = F.array_sort(F.collect_list(F.struct("seq", code.alias("code"))))
    return known.groupBy("conv", "part").agg(F.transform(own, lambda r: r["code"]).alias("codes"))


def edits(ordered: DataFrame) -> DataFrame:
    """(conv, part, edits, blank, duplicate, truncated, illegal, cost): edits of each piece; counts of the conversation on its first piece."""
    counts = ("blank", "duplicate", "truncated", "illegal")
    whole = "conv long, part int, codes binary, summary array<long>, n_blank long, n_duplicate long, n_truncated long, n_illegal long, head int, tail int"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        # adjacent roles that may follow each other: su, ua, au
        fine = np.zeros((4, 4), bool)
        fine[0, 1] = fine[1, 2] = fine[2, 1] = True
        for batch in batches:
            out = []
            for own in batch.column(2):
                raw = own.values.to_numpy(zero_copy_only=False)
                role, fault = raw % 4, raw // 4
                codes = (np.where(fault == 3, GOES, fault) * 4 + role).astype(np.uint8).tobytes()
                out.append((codes, summary(codes, vectors), *(int((fault == f).sum()) for f in (GOES, 3, CUT)),
                            int((~fine[role[:-1], role[1:]]).sum()), int(role[0]), int(role[-1])))
            kinds = [pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))],
                                             names=["conv", "part", "codes", "summary", *(f"n_{c}" for c in counts), "head", "tail"])

    pieces = frames.stored(coded(ordered).mapInArrow(sums, whole))
    # at most one entry for each range
    met = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "summary", "head", "tail"))).alias("own"),
                                     *(F.sum(f"n_{c}").alias(c) for c in counts))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, own, *n in zip(*(c.to_pylist() for c in batch.columns)):
                cost, states = borders([p["summary"] for p in own])
                n[3] += sum(ROLES[a["tail"]] + ROLES[b["head"]] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
                for k, p in enumerate(own):
                    first = [*n, cost] if k == 0 else [0] * 5
                    out.append((conv, p["part"], states[k], states[k + 1], k + 1 == len(own), *first))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 5]
            names = ["conv", "part", "start", "stop", "last", *counts, "cost"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    numbers = ", ".join(f"{c} long" for c in (*counts, "cost"))
    states = met.mapInArrow(fold, f"conv long, part int, start int, stop int, last boolean, {numbers}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            out = [solve(codes, a, b, vectors) + (TAILS[b][1] if last else "")
                   for codes, a, b, last in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), *batch.columns[6:]],
                                             names=["conv", "part", "edits", *counts, "cost"])

    joined = pieces.select("conv", "part", "codes").join(states, ["conv", "part"])
    return joined.mapInArrow(work, f"conv long, part int, edits string, {numbers}")


def followed(ordered: DataFrame, found: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Edits in front of the rows they are for, by conversation and place; ``names``: conversations that may have no rows."""
    rows = ordered.select("conv", "part", "seq", "role", "text")
    own = found.withColumn("seq", F.lit(-1).cast("long"))
    if names is not None:
        own = own.unionByName(names.distinct().withColumns({"part": F.lit(-1), "seq": F.lit(-1).cast("long")}), allowMissingColumns=True)
    every = own.unionByName(rows, allowMissingColumns=True)
    n = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(n, "conv").sortWithinPartitions("conv", "part", "seq")


def turns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversations as they stream by: ("piece", conv, edits, counts), then ("turn", conv, role, text, edit) for what is left of it."""
    state, rest, conv = 0, iter(""), None

    def insert(conv: int) -> tuple:
        nonlocal state
        role = next(r for r in "ua" if r in STEPS[state])
        state = STEPS[state][role]
        return "turn", conv, MADE[role], "", "I"

    def trailing(conv: int) -> Iterator[tuple]:
        for e in rest:
            yield insert(conv)

    for batch in batches:
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            row = {n: c[i] for n, c in columns.items()}
            if row["seq"] < 0:
                yield from trailing(conv)
                if row["conv"] != conv:
                    state, conv = 0, row["conv"]
                rest = iter(row["edits"] or "")
                yield "piece", conv, row["edits"] or "", row
                continue
            for e in rest:
                if e == "I":
                    yield insert(conv)
                    continue
                if e != "D":
                    fit = row["role"][:1] if e == "K" else next(r for r in "ua" if r in STEPS[state])
                    state = STEPS[state][fit]
                    yield "turn", conv, row["role"] if e == "K" else MADE[fit], row["text"], e
                break
    yield from trailing(conv)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the repaired conversations of ``own_rows``, turn by turn; edit is K, R or I."""
    ordered = ranged(rows)
    stream = followed(ordered, edits(ordered))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, place = 0, 0
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["conv", "place", "role", "text", "edit"]
        current = None
        for kind, conv, *own in turns_of(batches):
            if kind == "piece":
                if conv != current:
                    current, place = conv, 0
                continue
            out.append((conv, place, *own))
            place += 1
            size += len(own[1])
            if size > frames.SLICE or len(out) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    done = stream.mapInArrow(run, "conv long, place long, role string, text string, edit string")
    return done.select(frames.shown_id("conv").alias("conv_id"), "place", "role", "text", "edit")


def report(rows: DataFrame, names: DataFrame) -> DataFrame:
    """One row for each conversation of ``names`` (conv): counts of faults, cost, edits and digest of what is repaired."""
    ordered = ranged(rows)
    numbers = ("blank", "duplicate", "truncated", "illegal", "cost")
    stream = followed(ordered, edits(ordered), names.select("conv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.int64()] * 5, pa.string(), pa.string()]
        out: list[tuple] = []
        current, counts, trail, digest, empty = None, [0] * 5, [], hashlib.sha256(), True

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv", *numbers, "audit", "repaired_sha256"])

        for kind, conv, *own in turns_of(batches):
            if kind == "piece":
                if conv != current:
                    if current is not None:
                        out.append((current, *counts, "".join(trail), digest.hexdigest()))
                    if len(out) >= 4096:
                        yield batch_of()
                        out = []
                    current, counts, trail, digest, empty = conv, [0] * 5, [], hashlib.sha256(), True
                trail.append(own[0])
                counts = [a + (own[1][n] or 0) for a, n in zip(counts, numbers)]
                continue
            digest.update(f"{'' if empty else chr(10)}{own[0]}:{own[1]}".encode())
            empty = False
        if current is not None:
            out.append((current, *counts, "".join(trail), digest.hexdigest()))
        if out:
            yield batch_of()

    fields = ", ".join(f"{c} long" for c in numbers)
    told = stream.mapInArrow(run, f"conv long, {fields}, audit string, repaired_sha256 string")
    gaps = ordered.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return told.join(gaps, "conv", "left").select(
        frames.shown_id("conv").alias("conv_id"), F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated",
        "illegal", "cost", "audit", "repaired_sha256")
