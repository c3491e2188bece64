"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from dialoscope.llm import ann


def brute(rows, queries, k):
    out = {}
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.setdefault(i, []).append(v)
    usable = {i: min(v) for i, v in usable.items()}
    for q in queries:
        if q in usable:
            own = [(-float(ann.ordered_dot(np.array([usable[q]], float), np.array([v], float))[0]), i)
                   for i, v in usable.items() if i != q and len(v) == len(usable[q])]
            out[q] = [(i, -s) for s, i in sorted(own)[:k]]
    return {q: r for q, r in out.items() if r}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * rng.choice([0.1, 1, 5])]) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(60)]  # many copies: ties go to smaller numbers
    rows += [(600, None), (601, []), (602, [0.0] * 6), (603, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (604, [float("nan")] * 6), (605, [float("inf")] + [0.0] * 5),
             (606, [1.0, 2.0]), (620, [2.0, 1.0]), (None, [1.0] * 6), (20, rows[20][1]), (640, [0.5] * 3)]
    table = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, id string, score double").repartition(3)
    queries = table.where("vec_id % 20 = 0")
    monkeypatch.setattr(ann, "LEAF", 16)
    want = brute(rows, sorted({i for i, _ in rows if i is not None and i % 20 == 0}), 20)
    assert found(ann.search(table, queries, 20, shard=100, block=7)) == want
    assert ann.search(table.limit(0), queries.limit(0), 20).count() == 0


@pytest.mark.parametrize("factor, least", [(1.0, 1.0), (0.8, 0.75), (0.5, 0.4)])
def test_factor_trades_recall_for_pruning(factor, least):
    """On clustered vectors a smaller factor visits fewer leaves; factor one is exact."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8)) * 4
    v = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 0.3
    ids = np.arange(len(v))
    tree = ann.Tree(ids, v, float(np.sqrt((v**2).sum(1).max())), 32)
    asked = np.arange(0, 4000, 50)
    visits = 0
    take = tree.take

    def counting(leaf, rows, *rest):
        nonlocal visits
        visits += len(rows)
        take(leaf, rows, *rest)

    tree.take = counting
    row, got, score = tree.search(asked, v[asked], 10, factor)
    exact = v[asked] @ v.T
    exact[np.arange(len(asked)), asked] = -np.inf
    bound = np.sort(exact, axis=1)[:, -10]
    recall = (score >= bound[row] - 1e-9).sum() / (10 * len(asked))
    assert recall >= least
    assert visits < len(asked) * 4000 / 16  # far from visiting every leaf


def test_a_relaxed_search_visits_less_and_finds_nine_of_ten():
    """Factor 0.9 on clustered vectors: fewer leaves than the exact search, recall of 0.9 at least."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8)) * 4
    v = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 0.3
    tree = ann.Tree(np.arange(len(v)), v, float(np.sqrt((v**2).sum(1).max())), 32)
    asked, take, visits = np.arange(0, 4000, 50), tree.take, {}
    exact = v[asked] @ v.T
    exact[np.arange(len(asked)), asked] = -np.inf
    bound = np.sort(exact, axis=1)[:, -10]
    for factor in (1.0, 0.9):
        visits[factor] = 0

        def counting(leaf, rows, *rest):
            visits[factor] += len(rows)  # noqa: B023
            take(leaf, rows, *rest)

        tree.take = counting
        row, _, score = tree.search(asked, v[asked], 10, factor)
        recall = (score >= bound[row] - 1e-9).sum() / (10 * len(asked))
        assert recall >= (1.0 if factor == 1.0 else 0.9)
    assert visits[0.9] < visits[1.0]
