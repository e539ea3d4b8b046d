"""Exact top-k by inner product with an impact-ordered index.

Vectors are cut into blocks. A block's index holds, per dimension, its vectors
in posting segments of equal quantised component. For a query every segment has
an impact: the largest product its vectors can have in that dimension. Segments
are processed by descending impact, whatever their dimension; a vector's
accumulator plus the current impact for each dimension not yet seen bounds its
score. Processing stops only when fewer vectors than worth another pass can
still reach the k-th best exact score known, which proves the others out; those
left are scored exactly, best bound first, until the next bound is too low.

A query set meets all blocks; only each block's k best are shuffled on.

Defined results: a vector that is null, empty, or holds a null or non-finite
component takes no part, nor does a row without an id; vectors of different
lengths do not meet; a row is never its own candidate, a repeated one is; ties
go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import keep, with_rid

BLOCK = 16_384
QUERIES = 4_096
LEVELS = 24
CHECKS = 12


class Index:
    """Posting segments of a block of integer vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rids: np.ndarray):
        self.vectors, self.ids, self.rids = vectors, ids, rids
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        width = np.maximum(-(-(high - low + 1) // LEVELS), 1)
        level = (vectors - low) // width
        self.members, dims, bottom, top = [], [], [], []
        for j in range(vectors.shape[1]):
            order = np.argsort(level[:, j], kind="stable").astype(np.int32)
            cuts = np.searchsorted(level[order, j], np.arange(LEVELS + 1))
            column = vectors[order, j]
            for n in range(LEVELS):
                a, b = cuts[n], cuts[n + 1]
                if a < b:
                    self.members.append(order[a:b])
                    dims.append(j)
                    bottom.append(column[a:b].min())
                    top.append(column[a:b].max())
        self.dims, self.bottom, self.top = np.array(dims), np.array(bottom), np.array(top)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the k best (ties to the smaller id)."""
        d = self.vectors.shape[1]
        pack = 1 << int(d).bit_length()
        impact = np.maximum(query[self.dims] * self.bottom, query[self.dims] * self.top)
        order = np.argsort(-impact, kind="stable")
        held = np.zeros(len(self.ids), np.int64)
        best_at, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = -(-len(order) // CHECKS)
        alive = None
        for start in range(0, len(order), step):
            for s in order[start : start + step]:
                held[self.members[s]] += impact[s] * pack + 1
            done = start + step >= len(order)
            if not done and 2 * (start + step) < len(order):
                continue  # bounds say little before half of the segments
            left = 0 if done else int(impact[order[start + step]])
            bound = (held >> (pack.bit_length() - 1)) + (d - (held & (pack - 1))) * left
            bound[self.rids == own] = np.iinfo(np.int64).min
            if not len(best):
                probe = np.argpartition(-bound, min(4 * k, len(bound) - 1))[: 4 * k]
                best_at, best = self._exact(query, own, probe, k)
            alive = np.flatnonzero(bound >= best[-1]) if len(best) >= k else np.arange(len(bound))
            if len(alive) <= 8 * k or done:
                break
        alive = alive[np.argsort(-bound[alive], kind="stable")]
        for start in range(0, len(alive), 16 * k):
            part = alive[start : start + 16 * k]
            if len(best) >= k and bound[part[0]] < best[-1]:
                break
            best_at, best = self._exact(query, own, np.union1d(best_at, part), k)
        return best_at, best

    def _exact(self, query: np.ndarray, own: int, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = at[self.rids[at] != own]
        score = self.vectors[at] @ query
        order = np.lexsort((self.ids[at], -score))[:k]
        return at[order], score[order]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    return column.combine_chunks().flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def best_of_block(k: int):
    def run(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and queries.num_rows:
            index = Index(_matrix(rows["v"]), rows["vec_id"].to_numpy(), rows["rid"].to_numpy())
            for q, rid, v in zip(queries["vec_id"].to_numpy(), queries["rid"].to_numpy(), _matrix(queries["v"])):
                at, score = index.search(v, int(rid), k)
                out.append((np.full(len(at), rid), np.full(len(at), q), index.ids[at], score))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(["rid", "query_id", "vec_id", "score"], [pa.array(c, pa.int64()) for c in cols])))

    return run


def integer_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """rid, vec_id, v (floor of scale times each component), dims; rows that take no part left out."""
    x = F.col("embedding").cast("array<double>")
    rows = with_rid(rows.select("vec_id", x.alias("x"))).filter("vec_id IS NOT NULL AND x IS NOT NULL AND size(x) > 0")
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform("x", lambda c: F.floor(c * float(scale)).cast("long"))
    return rows.filter(~odd).select("rid", "vec_id", v.alias("v"), F.size("x").alias("dims"))


def top_k(rows: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``."""
    vectors = keep(integer_vectors(rows, scale), "vectors")
    n = vectors.count()
    queries = vectors.filter(F.col("vec_id") % every == 0)
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-queries.count() // QUERIES))
    place = lambda m: F.pmod(F.xxhash64("rid"), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = vectors.withColumn("block", place(blocks)).withColumn("chunk", all_of(chunks))
    right = queries.withColumn("chunk", place(chunks)).withColumn("block", all_of(blocks))
    keys = ["dims", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best_of_block(k), "rid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
