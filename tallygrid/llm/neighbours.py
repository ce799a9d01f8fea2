"""Approximate nearest neighbours by vantage-point trees, one tree per shard of vectors.

Nearness is the inner product. One more component lifts all vectors to one norm, so the largest inner product is the
smallest Euclidean distance and the triangle inequality holds. A tree node keeps a vantage point and the range of its
members' distances on either side; a subtree is left out if its lower bound times ``factor`` is above the distance of
the k-th neighbour found so far. Factor 1 restores exact search; larger ones prune more.

Every row is indexed. Vectors are dealt to shards by a hash of their id, and a shard's tree is one row of a written
table. Queries are packed in blocks; every block meets every shard, and the best k of each meeting are merged by a
window. What a task holds is one tree and one block, whatever the table's size.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id. Only vectors of equal length meet. Rows that repeat an id are one vector (the first in value order).
Ties go to the smaller id. Fewer candidates than k are all returned. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Scratch

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS, K = 8192, 2048, 256, 20
FACTOR = 1.25
EDGE = 1e-9  # bounds are compared with this much slack, for rounding
#: Columns of a node: first and last member, vantage point (a member), inner child, outer child, and the four bounds.
NODE = np.dtype([("lo", "<i4"), ("hi", "<i4"), ("point", "<i4"), ("inner", "<i4"), ("outer", "<i4"),
                 ("in_lo", "<f8"), ("in_hi", "<f8"), ("out_lo", "<f8"), ("out_hi", "<f8")])


def lifted(vectors: np.ndarray, norm2: float) -> np.ndarray:
    """Vectors with the component that brings them all to the norm ``norm2``."""
    rest = np.sqrt(np.maximum(norm2 - (vectors * vectors).sum(axis=1), 0.0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def build_tree(points: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(order of members, nodes). A node's members are order[lo:hi]; halves are cut by rank, so ties can't unbalance it."""
    order, nodes, todo = np.arange(len(points)), [], [(0, len(points), -1, "")]
    random = np.random.Generator(np.random.PCG64(1))
    while todo:
        lo, hi, parent, side = todo.pop()
        at = len(nodes)
        node = np.zeros((), NODE)
        node["lo"], node["hi"], node["point"], node["inner"], node["outer"] = lo, hi, -1, -1, -1
        if parent >= 0:
            nodes[parent][side] = at
        if hi - lo > leaf:
            own = order[lo:hi]
            # of a few candidates, the one whose distances spread most
            tried = random.choice(own, size=min(5, len(own)), replace=False)
            seen = points[random.choice(own, size=min(200, len(own)), replace=False)]
            point = max(tried.tolist(), key=lambda p: np.linalg.norm(seen - points[p], axis=1).var())
            distance = np.linalg.norm(points[own] - points[point], axis=1)
            rank = np.argsort(distance, kind="stable")
            order[lo:hi], distance = own[rank], distance[rank]
            middle = (hi - lo) // 2
            node["point"] = point
            node["in_lo"], node["in_hi"] = distance[0], distance[middle - 1]
            node["out_lo"], node["out_hi"] = distance[middle], distance[-1]
            todo += [(lo + middle, hi, at, "outer"), (lo, lo + middle, at, "inner")]
        nodes.append(node)
    return order, np.array(nodes, NODE)


class Search:
    """The k nearest members of one tree for a block of queries."""

    def __init__(self, ids, vectors, nodes, query_ids, queries, norm2: float, k: int, factor: float):
        self.ids, self.vectors, self.nodes, self.k, self.factor = ids, vectors, nodes, k, factor
        self.query_ids, self.queries = query_ids, queries
        self.shift = (queries * queries).sum(axis=1) + norm2
        self.points = lifted(vectors, norm2)
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.scored = 0

    def reach(self, q: np.ndarray) -> np.ndarray:
        """Distance of each query's k-th neighbour so far."""
        return np.sqrt(np.maximum(self.shift[q] - 2 * self.score[q, -1], 0.0))

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids):
            self._visit(0, np.arange(len(self.queries)))
        return self.found, self.score

    def _visit(self, at: int, q: np.ndarray) -> None:
        node = self.nodes[at]
        if node["point"] < 0:
            self._leaf(int(node["lo"]), int(node["hi"]), q)
            return
        point = self.points[node["point"]]
        away = np.sqrt(np.maximum(self.shift[q] - 2 * (self.queries[q] @ point[:-1]), 0.0))
        inner = np.maximum(np.maximum(away - node["in_hi"], node["in_lo"] - away), 0.0)
        outer = np.maximum(np.maximum(away - node["out_hi"], node["out_lo"] - away), 0.0)
        first = inner <= outer
        for child, bound, own in (("inner", inner, first), ("outer", outer, ~first), ("outer", outer, first), ("inner", inner, ~first)):
            go = own & (bound * self.factor <= self.reach(q) + EDGE)
            if go.any():
                self._visit(int(node[child]), q[go])

    def _leaf(self, lo: int, hi: int, q: np.ndarray) -> None:
        self.scored += len(q) * (hi - lo)
        # a fast product finds the pairs that may count; each of them is then added up by itself, so that equal
        # vectors score equally wherever they stand
        rough = self.queries[q] @ self.vectors[lo:hi].T
        rough[self.query_ids[q][:, None] == self.ids[None, lo:hi]] = -np.inf
        rows = np.flatnonzero((rough >= self.score[q, -1:] - EDGE).any(axis=1) & (rough.max(axis=1) > -np.inf))
        if not len(rows):
            return
        rough = rough[rows]
        i, j = np.nonzero((rough >= self.score[q[rows], -1:] - EDGE) & (rough > -np.inf))
        score, names = np.full(rough.shape, -np.inf), np.full(rough.shape, np.iinfo(np.int64).max)
        score[i, j] = np.cumsum(self.queries[q[rows[i]]] * self.vectors[lo + j], axis=1)[:, -1]
        names[i, j] = self.ids[lo + j]
        every = np.concatenate([self.score[q[rows]], score], axis=1)
        names = np.concatenate([self.found[q[rows]], names], axis=1)
        best = np.lexsort((names, -every), axis=-1)[:, :self.k]
        self.score[q[rows]] = np.take_along_axis(every, best, axis=1)
        self.found[q[rows]] = np.take_along_axis(names, best, axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector, dims, norm2) of the vectors that take part, in double precision."""
    vector = F.col(vector_column).cast("array<double>")
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"), finite.alias("finite"))
    kept = kept.where("finite").withColumn("norm2", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return kept.where("norm2 > 0").select("vec_id", "vector", F.size("vector").alias("dims"), "norm2")


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, id_column: str = "vec_id",
            vector_column: str = "embedding", k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` found for each row of ``queries``."""
    scratch = Scratch(spark, "neighbours")
    rows = usable(vectors, id_column, vector_column)
    asked = usable(queries, id_column, vector_column)
    sizes = scratch.keep(rows.groupBy("dims").agg(
        F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"), F.max("norm2").alias("top")), "sizes")
    counts = scratch.keep(asked.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")), "counts")

    def plant(table: pa.Table) -> pa.Table:
        dims, top = table["dims"][0].as_py(), table["top"][0].as_py()
        ids, matrix = table["vec_id"].to_numpy(), _matrix(table["vector"], dims)
        order = np.lexsort((*matrix.T[::-1], ids))
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
        ids, matrix = ids[order], matrix[order]
        order, nodes = build_tree(lifted(matrix, top))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        nodes["point"] = np.where(nodes["point"] >= 0, place[nodes["point"]], -1)
        return pa.table({"dims": pa.array([dims], pa.int32()), "shard": table["shard"][:1], "top": pa.array([top]),
                         "ids": pa.array([ids[order].tobytes()]), "vectors": pa.array([matrix[order].tobytes()]),
                         "nodes": pa.array([nodes.tobytes()])})

    dealt = rows.join(sizes.withColumnRenamed("dims", "_d"), F.col("dims") == F.col("_d")).select(
        "dims", F.pmod(F.xxhash64("vec_id"), F.col("shards").cast("long")).cast("int").alias("shard"), "top", "vec_id", "vector")
    trees = scratch.keep(dealt.groupBy("dims", "shard").applyInArrow(
        plant, "dims int, shard int, top double, ids binary, vectors binary, nodes binary"), "trees")

    def pack(table: pa.Table) -> pa.Table:
        dims = table["dims"][0].as_py()
        ids, matrix = table["vec_id"].to_numpy(), _matrix(table["vector"], dims)
        _, first = np.unique(ids, return_index=True)
        return pa.table({"dims": pa.array([dims], pa.int32()), "block": table["block"][:1],
                         "query_ids": pa.array([ids[first].tobytes()]), "queries": pa.array([matrix[first].tobytes()])})

    blocked = asked.join(counts.withColumnRenamed("dims", "_d"), F.col("dims") == F.col("_d")).select(
        "dims", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks").cast("long")).cast("int").alias("block"), "vec_id", "vector")
    blocks = scratch.keep(blocked.groupBy("dims", "block").applyInArrow(
        pack, "dims int, block int, query_ids binary, queries binary"), "blocks")

    def meet(table: pa.Table) -> pa.Table:
        row = {c: table[c][0].as_py() for c in table.column_names}
        dims = row["dims"]
        ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
        search = Search(ids, np.frombuffer(row["vectors"]).reshape(-1, dims), np.frombuffer(row["nodes"], NODE), query_ids,
                        np.frombuffer(row["queries"]).reshape(-1, dims), row["top"], k, factor)
        found, score = search.run()
        held = score > -np.inf
        return pa.table({"query_id": np.repeat(query_ids, held.sum(axis=1)), "vec_id": found[held], "score": score[held]})

    meetings = blocks.join(sizes.select(F.col("dims").alias("_d"), "shards"), F.col("dims") == F.col("_d")).select(
        "dims", "block", "query_ids", "queries", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    meetings = meetings.join(trees.withColumnsRenamed({"dims": "_e", "shard": "_s"}), (F.col("dims") == F.col("_e")) & (F.col("shard") == F.col("_s")))
    found = meetings.groupBy("dims", "shard", "block").applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(spark, vectors, vectors.where("vec_id % 20 = 0"))


OP4_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))
  AND list_inner_product(e, e) > 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id)::INTEGER AS rank
  FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
WHERE rank <= 20
"""
