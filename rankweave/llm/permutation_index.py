"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors (`n_pivots` at most, by hash of the id). A vector is represented by its
`prefix` nearest pivots in order, and posted with its rank in the inverted file of each of them. The prefix is short, about half the root
of the number of pivots, so that a query meets about a fifth of unrelated vectors; more pivots and longer prefixes meet better ones
at the same share. A query's candidates are the vectors posted with its own pivots; the footrule distance between the two orders (a pivot that one of them lacks stands at
rank `prefix`) ranks them, and the best `rerank` of each block of the index are measured by exact cosine, in double precision, on the
original vectors.

Every row is indexed. The index is a table in the shared folder; tasks read it in blocks of about `block_rows` vectors and lay out
their postings. Queries come to all blocks in broadcast groups of at most `query_rows`, a bound that doesn't grow with the
data, one group after the other; the answers of blocks are merged per query from at most k rows a block. A query whose block candidates are fewer than k
has the rest of that block measured too, so no query lacks neighbours.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components are neither
queries nor candidates; rows with a null id neither; of rows with the same id each is a candidate, and none of them is
found for a query with that id (one query, by the least of its vectors); ties go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import shared_dir, stored

SCHEMA = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.empty((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)  # first by the largest component, so that squares stay finite
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's nearest pivots, nearest first; of equal ones the smaller number first."""
    out = np.empty((len(unit), prefix), np.int16)
    for i in range(0, len(unit), 1024):  # so many rows' distances to all pivots at once
        far = -(unit[i : i + 1024] @ pivots.T)
        near = np.sort(np.argpartition(far, prefix - 1, axis=1)[:, :prefix], axis=1) if prefix < far.shape[1] else np.broadcast_to(np.arange(prefix), far.shape)
        out[i : i + 1024] = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1)
    return out


class Block:
    """Vectors by rising id, and for each pivot the inverted file of (place, rank)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, orders: np.ndarray, n_pivots: int):
        by = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by], vectors[by]
        self.unit = _unit(self.vectors)
        orders = orders[by]
        self.prefix = orders.shape[1]
        flat = orders.ravel()
        order = np.argsort(flat, kind="stable")
        self.place, self.rank = order // self.prefix, (order % self.prefix).astype(np.int32)
        self.bounds = np.searchsorted(flat[order], np.arange(n_pivots + 1))

    def search(self, query_id: int, raw: np.ndarray, unit: np.ndarray, order: np.ndarray, rerank: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the block's nearest, at most k; raw is the query as given, unit of length 1."""
        m, n = self.prefix, len(self.ids)
        # footrule distance, less what it is when no pivot is shared: 2 * (m - max(rank, rank')) off for each shared one
        near = np.zeros(n, np.int32)
        for r, p in enumerate(order):
            a, b = self.bounds[p], self.bounds[p + 1]
            near[self.place[a:b]] += m - np.maximum(self.rank[a:b], r)
        own = self.ids == query_id
        near[own] = -1
        found = int((near > 0).sum())
        want = min(n, max(rerank, k))
        if found < k:
            best = np.flatnonzero(~own)
        elif want < n:
            cut = np.partition(near, n - want)[n - want]
            best = np.flatnonzero(near > max(cut, 0))
            if cut > 0:  # of equally near ones, those of smaller id fill up
                best = np.concatenate([best, np.flatnonzero(near == cut)[: want - len(best)]])
        else:
            best = np.flatnonzero(near > 0)
        score = self.unit[best] @ unit
        if len(best) > 4 * k:  # far ones needn't be measured exactly: rounding is far below this margin
            best = best[score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-9]
        score = exact_cosine(self.vectors[best], raw)
        first = np.lexsort((self.ids[best], -score))[:k]
        return self.ids[best][first], score[first]


def exact_cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row in one fixed order of sums: equal vectors have equal scores wherever they are met."""
    a = rows / np.abs(rows).max(axis=1, keepdims=True)
    q = query / np.abs(query).max()
    return (a * q).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((q * q).sum()))


def build_index(vectors: DataFrame, id_col: str, vector_col: str, n_pivots: int = 4096, prefix: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """The stored index (vec_id, v, pivots: array) and the pivots; at most n_pivots rows come to the driver."""
    rows = usable(vectors, id_col, vector_col)
    most = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    size = most["size"] if most else 0
    chosen = rows.where(F.size("v") == size).orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()
    pivots = _unit(np.array([r["v"] for r in chosen])) if chosen else np.empty((0, 0))
    prefix = min(prefix or 2 + round((0.22 * len(pivots)) ** 0.5), len(pivots))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                orders = nearest_pivots(_unit(_matrix(b["v"])), shared.value, prefix)
                yield b.assign(pivots=list(orders))

    rows = rows.where(F.size("v") == size)
    index = rows.mapInPandas(post, "vec_id long, v array<double>, pivots array<smallint>") if size else rows.withColumn("pivots", F.array().cast("array<smallint>"))
    return stored(index, shared_dir(vectors.sparkSession, "pivots")), pivots


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 5, n_pivots: int = 4096, prefix: int | None = None, rerank: int = 2048, block_rows: int = 8192, query_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    index, pivots = build_index(vectors, id_col, vector_col, n_pivots, prefix)
    # an id that several rows have is one query, by the least of its vectors
    queries = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "pivots")).alias("q"))
    groups = max(1, -(-queries.count() // query_rows))  # by hash of distinct ids, so of nearly equal size
    queries = queries.select("vec_id", "q.*", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("_g"))
    out = None
    for g in range(groups):
        rows = queries.where(F.col("_g") == g).select("vec_id", "v", "pivots").collect()
        if not rows:
            continue
        block = (np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], np.int16))
        shared = spark.sparkContext.broadcast(block)
        found = stored(_search_group(index, shared, len(pivots), k, rerank, block_rows), shared_dir(spark, "neighbours"))
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_group(index: DataFrame, shared, n_pivots: int, k: int, rerank: int, block_rows: int) -> DataFrame:
    def answer(ids: list, vectors: list, orders: list) -> pd.DataFrame:
        q_ids, q_vectors, q_orders = shared.value
        block = Block(np.concatenate(ids), np.concatenate(vectors), np.concatenate(orders), n_pivots)
        units = _unit(q_vectors)
        out = []
        for q, unit, raw, order in zip(q_ids, units, q_vectors, q_orders, strict=True):
            found, score = block.search(q, raw, unit, order, rerank, k)
            out.append(pd.DataFrame({"query_id": np.full(len(found), q), "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors, orders, n = [], [], [], 0
        for b in batches:
            if not len(b):
                continue
            ids.append(b["vec_id"].to_numpy())
            vectors.append(_matrix(b["v"]))
            orders.append(np.stack([np.asarray(p) for p in b["pivots"]]))
            n += len(b)
            if n >= block_rows:
                yield answer(ids, vectors, orders)
                ids, vectors, orders, n = [], [], [], 0
        if n:
            yield answer(ids, vectors, orders)

    return index.mapInPandas(run, SCHEMA)
