"""Nearest neighbours by inner product: a vantage-point tree per shard, searched by blocks of queries.

Largest inner product is nearest distance once every vector x gets one more
component sqrt(M^2 - |x|^2), M being the largest norm, and queries get 0 there.
Vectors are dealt evenly to shards of a bounded size by a hash of their number,
so that a vector with very many copies is spread.  Each shard builds its tree
once: a vantage point, the median of the distances to it, an inner and an outer
half, each with the range of its distances.  A block of queries walks the tree
together; a subtree is passed over for the queries whose ball of the k nearest
so far, shrunk by ``factor``, does not reach its range of distances.  Factor 1
is exact; smaller ones prune more and may miss.  Every row is indexed.

Scores are sums of products in double precision, in order of the components, on
the original vectors.  Equal scores go to the smaller number.

Vectors that are null, empty, zero or hold null or non-finite components, and
rows without a number, take no part; vectors of other lengths are not compared.
Rows that repeat a number and its vector count once; with several vectors for a
number the one that sorts first counts.  Fewer than k candidates give fewer rows,
an empty table none.  Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoscope.llm import frames

#: Vectors of a shard (a few MB), queries of a block, vectors of a leaf.
SHARD, BLOCK, LEAF = 8192, 1024, 256


def clean(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, vec array<double>): one usable vector for each number."""
    vec = F.col(embedding).cast("array<double>")
    usable = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.coalesce(usable, F.lit(False)))
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


class Tree:
    """A vantage-point tree over the rows of a matrix."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top_norm: float, leaf: int = LEAF):
        self.ids, self.vectors, self.top = ids, vectors, top_norm
        extra = np.sqrt(np.maximum(top_norm**2 - (vectors**2).sum(1), 0))
        self.points = np.column_stack([vectors, extra])
        self.root = self.build(np.arange(len(ids)), leaf, np.random.default_rng(0))

    def packed(self) -> bytes:
        return pickle.dumps((self.ids, self.vectors, self.top, self.root), 5)

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.ids, tree.vectors, tree.top, tree.root = pickle.loads(data)
        return tree

    def build(self, rows: np.ndarray, leaf: int, rng) -> tuple:
        if len(rows) <= leaf:
            return (rows,)
        # a vantage point far from most: the farthest of a few from a random row
        some = rng.choice(rows, min(64, len(rows)), replace=False)
        seed = self.points[rng.choice(rows)]
        vantage = some[np.argmax(((self.points[some] - seed) ** 2).sum(1))]
        d = np.sqrt(((self.points[rows] - self.points[vantage]) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        parts = order[:half], order[half:]
        return (vantage, *((d[p].min(), d[p].max(), self.build(rows[p], leaf, rng)) for p in parts))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, candidate number, score) of the k nearest to each query."""
        n = len(query_ids)
        best = np.full((n, k), -np.inf)
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        norms = (queries**2).sum(1)
        slack = 1e-6 * max(self.top, float(np.sqrt(norms.max(initial=0))))  # rounding of distances

        def reach(rows: np.ndarray) -> np.ndarray:
            """Radius of the k nearest so far."""
            return np.sqrt(np.maximum(norms[rows] + self.top**2 - 2 * best[rows, -1], 0))

        def visit(node: tuple, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if len(node) == 1:
                self.take(node[0], rows, query_ids, queries, k, best, best_id)
                return
            vantage, *halves = node
            dot = queries[rows] @ self.vectors[vantage]
            d = np.sqrt(np.maximum(norms[rows] + self.top**2 - 2 * dot, 0))
            # how far each half's range of distances is away; the nearer half goes first
            away = [np.maximum(np.maximum(low - d, d - high), 0) for low, high, _ in halves]
            first = (away[1] < away[0]) | ((away[0] == away[1]) & (d > halves[0][1]))
            for turn in (False, True):
                for side in (0, 1):
                    mine = (first == (side == 1)) != turn
                    mine &= away[side] <= factor * reach(rows) + slack
                    visit(halves[side][2], rows[mine])

        visit(self.root, np.arange(n))
        row, at = np.nonzero(best > -np.inf)
        return row, best_id[row, at], best[row, at]

    def take(self, leaf: np.ndarray, rows: np.ndarray, query_ids, queries, k: int, best, best_id) -> None:
        """Merge the vectors of a leaf into the k nearest of some queries."""
        rough = queries[rows] @ self.vectors[leaf].T
        rough[query_ids[rows][:, None] == self.ids[leaf][None, :]] = -np.inf
        margin = 1e-9 * max(self.top, 1.0) * (1 + np.abs(rough[np.isfinite(rough)]).max(initial=0))
        bound = best[rows, -1]
        if len(leaf) > k:
            bound = np.maximum(bound, np.partition(rough, len(leaf) - k, axis=1)[:, len(leaf) - k])
        q, c = np.nonzero((rough >= (bound - margin)[:, None]) & np.isfinite(rough))
        if not len(q):
            return
        exact = ordered_dot(queries[rows[q]], self.vectors[leaf[c]])
        touched, back = np.unique(q, return_inverse=True)
        own = rows[touched]
        scores = np.concatenate([exact, best[own].ravel()])
        ids = np.concatenate([self.ids[leaf[c]], best_id[own].ravel()])
        group = np.concatenate([back, np.repeat(np.arange(len(own)), k)])
        order = np.lexsort((ids, -scores, group))
        group = group[order]
        place = np.arange(len(order)) - np.searchsorted(group, group)
        keep = place < k
        best[own[group[keep]], place[keep]] = scores[order][keep]
        best_id[own[group[keep]], place[keep]] = ids[order][keep]


def ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, summed from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int, factor: float = 1.0, vec_id: str = "vec_id", embedding: str = "embedding",
           shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` to each row of ``queries``, itself left out."""
    spark = vectors.sparkSession
    frames.bounded_batches(spark)
    vectors = frames.stored(clean(vectors, vec_id, embedding).withColumn("dim", F.size("vec")))
    queries = clean(queries, vec_id, embedding).withColumn("dim", F.size("vec"))
    # One row for each length of vectors: L lengths take at least L * L / 2 components, so these tables stay tiny and are broadcast.
    # A shuffled join on the length would bring all vectors of a length into one task, and grouping by shard would leave them there
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("n"), F.sqrt(F.max(F.expr("aggregate(vec, 0D, (s, x) -> s + x * x)"))).alias("top"))
    sizes = sizes.withColumn("shards", F.ceil(F.col("n") / shard).cast("int"))
    asked = queries.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))

    def build(batch: pa.Table) -> pa.Table:
        tree = Tree(batch["id"].combine_chunks().to_numpy(), matrix(batch["vec"].combine_chunks()), batch["top"][0].as_py())
        return pa.table({"dim": batch["dim"][:1], "shard": batch["shard"][:1], "tree": pa.array([tree.packed()], pa.binary())})

    def pack(batch: pa.Table) -> pa.Table:
        order = np.argsort(batch["id"].to_numpy())
        data = pickle.dumps((batch["id"].to_numpy()[order], matrix(batch["vec"].combine_chunks())[order]), 5)
        return pa.table({"dim": batch["dim"][:1], "block": batch["block"][:1], "queries": pa.array([data], pa.binary())})

    trees = vectors.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")) \
        .groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary")
    blocks = queries.join(F.broadcast(asked), "dim").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")) \
        .groupBy("dim", "block").applyInArrow(pack, "dim int, block int, queries binary")
    # every block of the stated queries meets every shard: a tree stays in its task, the blocks stream by.  Where there are fewer
    # shards than tasks, a tree is read by several of them, each for its part of the blocks
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    readers = sizes.select("dim", "shards", F.ceil(F.lit(tasks) / F.col("shards")).cast("int").alias("readers"))
    none = F.lit(None).cast("binary")
    sent = trees.join(F.broadcast(readers), "dim").select("dim", "shard", F.explode(F.sequence(F.lit(0), F.col("readers") - 1)).alias("reader"),
                                             F.lit(-1).alias("block"), "tree", none.alias("queries"))
    sent = sent.unionByName(blocks.join(F.broadcast(readers), "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod("block", "readers").alias("reader"), "block",
        none.alias("tree"), "queries"))
    dealt = sent.repartition(tasks, "dim", "shard", "reader").sortWithinPartitions("dim", "shard", "reader", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for packed, own in zip(batch.column(0), batch.column(1)):
                if own.is_valid:  # in front of its blocks
                    tree = Tree.unpacked(own.as_py())
                    continue
                ids, rows = pickle.loads(packed.as_py())
                row, found, score = tree.search(ids, rows, k, factor)
                yield pa.RecordBatch.from_pydict({"query_id": ids[row], "vec_id": found, "score": score})

    found = dealt.select("queries", "tree").mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = found.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank").where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
