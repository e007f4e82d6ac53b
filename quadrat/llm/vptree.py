"""Nearest neighbours by vantage-point trees, one tree a shard.

Rows are dealt to shards by a hash of their id.  A task builds the tree of a shard and writes it to the shared folder;
then every block of queries meets every tree, and a window keeps the nearest of all shards.  Largest inner product
becomes least distance by one more coordinate, sqrt(M^2 - |x|^2) with the largest norm M of the shard, so that the
triangle inequality holds.  A subtree is left out where ``factor`` times its lower bound exceeds the distance of the
k-th nearest found so far: factor 1 leaves out only what cannot matter (exact search), more leaves out more.

Cases: vectors that are null, all zero or hold null or non-finite components, and rows without an id, take no part,
neither as queries nor as candidates; vectors meet only those of their own length; a query never meets rows of its own
id; rows that repeat an id are each a candidate, and as a query the least of their vectors counts; ties go to the
smaller id; fewer candidates than k give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.shared import written

LEAF = 128
RESULT = "query_id long, vec_id long, score double"


class Tree:
    """Arrays of one shard: points in leaf order, and for each node its range, vantage point, children and bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, nodes: np.ndarray, bounds: np.ndarray):
        self.ids, self.x, self.nodes, self.bounds = ids, x.astype(np.float64), nodes, bounds
        norms = np.einsum("ij,ij->i", self.x, self.x)
        self.top = float(norms.max())
        self.extra = np.sqrt(np.maximum(self.top - norms, 0))

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray) -> Tree:
        order = np.argsort(ids, kind="stable")  # the tree does not depend on the order of arrival
        start = cls(ids[order], x[order], np.zeros((0, 5), np.int64), np.zeros((0, 4)))
        perm, nodes, bounds, rng = np.arange(len(ids)), [], [], np.random.default_rng(1)
        start._grow(perm, 0, len(ids), nodes, bounds, rng)
        place = np.empty(len(perm), np.int64)
        place[perm] = np.arange(len(perm))
        table = np.array(nodes, np.int64)
        inner = table[:, 2] >= 0
        table[inner, 2] = place[table[inner, 2]]
        return cls(start.ids[perm], start.x[perm], table, np.array(bounds))

    def _grow(self, perm, a: int, z: int, nodes: list, bounds: list, rng) -> int:
        me = len(nodes)
        nodes.append((a, z, -1, -1, -1))
        bounds.append((0.0, 0.0, 0.0, 0.0))
        if z - a <= LEAF:
            return me
        part = perm[a:z].copy()
        some = part[rng.integers(0, len(part), 5)]
        probe = part[rng.integers(0, len(part), 64)]
        vantage = int(max(some, key=lambda v: self._far(v, probe).std()))
        d = self._far(vantage, part)
        half = len(part) // 2
        order = np.argpartition(d, half)
        perm[a:z], d = part[order], d[order]
        bounds[me] = (d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max())
        left = self._grow(perm, a, a + half, nodes, bounds, rng)
        nodes[me] = (a, z, vantage, left, self._grow(perm, a + half, z, nodes, bounds, rng))
        return me

    def _far(self, v: int, which: np.ndarray) -> np.ndarray:
        gap = self.x[which] - self.x[v]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap) + (self.extra[which] - self.extra[v]) ** 2)

    def dump(self) -> bytes:
        single = self.x.astype(np.float32)
        out = io.BytesIO()
        np.savez(out, ids=self.ids, x=single if (single == self.x).all() else self.x, nodes=self.nodes, bounds=self.bounds)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as z:
            return cls(z["ids"], z["x"], z["nodes"], z["bounds"])

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, inner product) of the k nearest of each query, found by a descent and then a pruned walk."""
        found = _Nearest(self, qid, q, k)
        everyone = np.arange(len(q))
        first = np.zeros(len(q), np.int64)
        walk = [(0, everyone)]
        while walk:  # each query goes down to the leaf on its own side
            node, who = walk.pop()
            a, z, vantage, left, right = self.nodes[node]
            if vantage < 0:
                first[who] = node
                found.leaf(who, a, z)
                continue
            d = found.distance(who, vantage)
            near = d <= (self.bounds[node, 1] + self.bounds[node, 2]) / 2
            walk += [(c, w) for c, w in ((left, who[near]), (right, who[~near])) if len(w)]
        walk = [(0, everyone)]
        while walk:  # and then to all leaves that may hold nearer points
            node, who = walk.pop()
            a, z, vantage, left, right = self.nodes[node]
            if vantage < 0:
                who = who[first[who] != node]
                if len(who):
                    found.leaf(who, a, z)
                continue
            d, reach = found.distance(who, vantage), found.reach(who)
            for child, low, high in ((right, *self.bounds[node, 2:]), (left, *self.bounds[node, :2])):
                keep = np.maximum(low - d, d - high) * factor <= reach + 1e-9
                if keep.any():
                    walk.append((child, who[keep]))
        return found.result()


class _Nearest:
    """The k nearest so far of each query of a block."""

    def __init__(self, tree: Tree, qid: np.ndarray, q: np.ndarray, k: int):
        self.tree, self.qid, self.q, self.k = tree, qid, q, k
        self.norm = np.einsum("ij,ij->i", q, q)
        self.floor = np.full(len(q), -np.inf)  # the k-th largest product
        self.score = np.full((len(q), k), -np.inf)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)

    def distance(self, who: np.ndarray, point: int) -> np.ndarray:
        square = self.norm[who] + self.tree.top - 2 * (self.q[who] @ self.tree.x[point])
        return np.sqrt(np.maximum(square, 0))

    def reach(self, who: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return np.sqrt(np.maximum(self.norm[who] + self.tree.top - 2 * self.floor[who], 0))

    def leaf(self, who: np.ndarray, a: int, z: int) -> None:
        for i in range(0, len(who), 512):
            self._leaf(who[i : i + 512], a, z)

    def _leaf(self, who: np.ndarray, a: int, z: int) -> None:
        ids, x = self.tree.ids[a:z], self.tree.x[a:z]
        rough = self.q[who] @ x.T
        row, col = np.nonzero((rough >= self.floor[who, None] - 1e-9) & (ids[None, :] != self.qid[who, None]))
        if not len(row):
            return
        score = np.zeros(len(row))
        for j in range(x.shape[1]):  # the same order of additions wherever a vector lies
            score += self.q[who[row], j] * x[col, j]
        touched = np.unique(row)
        mine = np.repeat(touched, self.k)
        row = np.concatenate([row, mine])
        score = np.concatenate([score, self.score[who[touched]].ravel()])
        ids = np.concatenate([ids[col], self.ids[who[touched]].ravel()])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        start = np.searchsorted(row, touched)
        take = start[:, None] + np.arange(self.k)
        self.score[who[touched]], self.ids[who[touched]] = score[take], ids[take]
        self.floor[who[touched]] = self.score[who[touched], -1]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col = np.nonzero(np.isfinite(self.score))
        return row, self.ids[row, col], self.score[row, col]


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rows_a_shard: int = 16384) -> DataFrame:
    """One row a shard, written to the shared folder: dim, shard, tree.  The trees hold every usable vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    shards = max(1, math.ceil(rows.count() / rows_a_shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        tree = Tree.build(table["id"].to_numpy(), _matrix(table["v"]))
        return pa.table({"dim": table["dim"][:1], "shard": table["shard"][:1], "tree": pa.array([tree.dump()], pa.binary())})

    return written(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary"), "trees")


def search(index: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each query: every block of queries against every tree."""
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = asked.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))
    asked = written(asked.withColumn("dim", F.size("v")), "queries")
    blocks = max(1, math.ceil(asked.count() / block))
    shards = index.select(F.max("shard")).first()[0]
    if shards is None:
        return asked.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    trees = index.select("dim", "shard", "tree", every)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = asked.select("dim", "block", "id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards))).alias("shard"))
    keys = ["dim", "shard", "block"]

    def find(tree: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(tree) or not len(asked):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = asked["id"].to_numpy()
        row, vec, score = Tree.load(tree["tree"][0].as_py()).search(ids, _matrix(asked["v"]), k, factor)
        return pa.table({"query_id": ids[row], "vec_id": vec, "score": score})

    found = trees.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(find, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
