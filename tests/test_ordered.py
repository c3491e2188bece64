"""Blocked running computations against brute force, at block borders and on shuffled input."""

import random

import pytest
from pyspark.sql import functions as F

from dialoscope.functions import ordered as o


def rows_for(seed):
    rnd = random.Random(seed)
    rows = []
    for key in ("a", "b", None):
        pos = 0
        for _ in range(rnd.randint(1, 60) if key != "a" else 120):
            pos += rnd.randint(1, 9)
            rows.append((key, pos, rnd.choice([None, "x", "y", "z"]), rnd.random() < 0.4))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 1), (2, 7), (3, 1000)])
def test_running_and_filled(spark, seed, block):
    rows = rows_for(seed)
    df = spark.createDataFrame(rows, "k string, pos bigint, v string, f boolean").repartition(5)
    out = o.running_counts(df, ["k"], "pos", {"n": F.col("f"), "m": F.lit(True)}, {"all_f": "n"}, block)
    out = o.fill_forward(out, ["k"], "pos", F.col("v"), "here", block)
    out = o.fill_forward(out, ["k"], "pos", F.col("v"), "before", block, include_current=False)
    got = {(r.k, r.pos): (r.n, r.m, r.all_f, r.here, r.before) for r in out.collect()}
    assert len(got) == len(rows)
    for key in ("a", "b", None):
        n = m = 0
        last = None
        mine = sorted(r for r in rows if r[0] == key) if key else sorted((r for r in rows if r[0] is None),
                                                                        key=lambda r: r[1])
        mine.sort(key=lambda r: r[1])
        total = sum(r[3] for r in mine)
        for _, pos, v, f in mine:
            n, m, before = n + f, m + 1, last
            last = v if v is not None else last
            assert got[(key, pos)] == (n, m, total, last, before)


@pytest.mark.parametrize("width,block", [(3, 3), (3, 8), (8, 100)])
def test_trailing(spark, width, block):
    df = spark.createDataFrame([(k, i) for k in "ab" for i in range(1, 41)], "k string, i bigint").repartition(4)
    for r in o.trailing_rows(df, ["k"], "i", width, F.col("i"), "w", block).collect():
        assert r.w == list(range(max(1, r.i - width), r.i + 1))


def test_global_rank_with_ties(spark):
    values = [5] * 300 + list(range(100)) + [7, 7, 99]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "id int, x int")
    for r in o.global_rank(df, "x", "rk", buckets=4).collect():
        assert r.rk == 1 + sum(v > r.x for v in values)
