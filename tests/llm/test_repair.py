"""Structure repair: edits against a plain search that carries whole strings, tables against a plain reading of the rules."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialoscope.llm import repair

ROLE = {"u": "user", "a": "assistant"}


def plain(rows):
    """(cost, audit, turns) of rows (role, text, fault): every way, the cheapest and least string for each output so far."""
    def after(state, role):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, role))

    def relax(ways):
        todo = list(ways.items())
        while todo:
            state, (cost, edits, out) = todo.pop()
            for r in "ua":
                to, way = after(state, r), (cost + 3, edits + "I", out + [(ROLE[r], "")])
                if to and (to not in ways or way < ways[to]):
                    ways[to] = way
                    todo.append((to, way))
        return ways

    ways = relax({"": (0, "", [])})
    for role, text, fault in rows:
        new = {}
        for state, (cost, edits, out) in ways.items():
            options = [(state, (cost + 4, edits + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                options += [(after(state, role[:1]), (cost + more, edits + "K", out + [(role, text)]))]
                options += [(after(state, r), (cost + more + 3, edits + "R", out + [(ROLE[r], text)])) for r in "ua"]
            for to, way in options:
                if to is not None and (to not in new or way < new[to]):
                    new[to] = way
        ways = relax(new)
    return min(ways[s] for s in ("", "a") if s in ways)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 11), max_size=14))
def test_least_edits(codes):
    faults = ["", "blank", "truncated"]
    rows = [("sua?"[c % 4], "x", faults[c // 4]) for c in codes]
    cost, edits, out = plain(rows)
    assert repair.audit(bytes(codes)) == (cost, edits)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 11), min_size=1, max_size=30), st.lists(st.integers(0, 30), max_size=4))
def test_pieces_meet(codes, cuts):
    """A conversation cut into pieces gives the edits of the whole."""
    vectors = repair.Vectors()
    edges = sorted({0, len(codes), *(c for c in cuts if c < len(codes))})
    pieces = [bytes(codes[a:b]) for a, b in zip(edges, edges[1:])]
    cost, states = repair.borders([repair.summary(p, vectors) for p in pieces])
    edits = "".join(repair.solve(p, a, b, vectors) for p, a, b in zip(pieces, states, states[1:])) + repair.TAILS[states[-1]][1]
    assert (cost, edits) == repair.audit(bytes(codes))


def test_long_conversation_needs_no_deep_stack():
    codes = bytes(random.Random(5).choices(range(12), k=60_000))
    cost, edits = repair.audit(codes)
    kept = {"K": 0, "R": 3, "D": 4, "I": 3}
    assert len(edits.replace("I", "")) == len(codes)
    rows = iter(codes)
    assert cost == sum(kept[e] + (3 if e != "I" and next(rows) // 4 == 2 and e != "D" else 0) for e in edits)


SPACE = " \t\n\x0b\x0c\r"


def expected(table):
    """The contract's columns, read plainly off rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in table:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, rows = set(), []
        for turn, role, text in own:
            solid = text.strip(SPACE)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            rows.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        cost, edits, kept = plain(rows)
        initials = [r[:1] for r, _, _ in rows]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == n for _, _, f in rows) for n in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, edits,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def table():
    rng = random.Random(11)
    texts = ["Well.", "Is it?", "no end", "", " \n\t", "Yes!\n ", "a. \x85", "long " * 300 + ".", None] + [f"Text {i}." for i in range(300)]
    roles = ["user", "assistant", "system", "tool", "", "User", None]
    weights = [9, 9, 2, 1, 1, 1, 1]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), rng.choices(roles, weights)[0], rng.choice(texts)))
    # one conversation with a third of all rows, one without a number and without turns, one that is lost as a whole
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", rng.choice(texts)) for t in range(700)]
    rows += [(None, rng.choice([None, 1, 2]), rng.choices(roles, weights)[0], rng.choice(texts)) for _ in range(150)]
    lost = next(c for c in range(2000, 4000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(lost, 0, "user", "Gone.")] + rows[5:9]
    return rows, lost


def test_report(spark):
    rows, lost = table()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .withColumns({c: F.lit("x") for c in ("conv", "part", "code")}).repartition(3)
    own = repair.own_rows(df)
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(repair.damaged(own), own).collect()}
    want = expected(rows)
    want[lost] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == want


def test_repaired_turns(spark):
    rows, _ = table()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {}
    for r in sorted(repair.repaired(repair.own_rows(df)).collect(), key=lambda r: r.place):
        out.setdefault(r.conv_id, []).append(r)
    for conv, turns in out.items():
        assert [t.place for t in turns] == list(range(len(turns)))
        assert re.fullmatch("s?(ua)+", "".join(t.role[:1] for t in turns))
        assert all(t.text.strip(SPACE) for t in turns if t.edit != "I")


def test_nothing(spark):
    own = repair.own_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert repair.report(repair.damaged(own), own).collect() == [] and repair.repaired(own).collect() == []
