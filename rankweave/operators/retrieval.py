"""Factor retrieval, graph propagation and candidate lists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.operators import prep

#: Items scored or skipped together; items that go to the tasks at once (passes of fewer go together up to it); cells of one product.
BLOCK_ITEMS, PASS_ITEMS, PRODUCT_CELLS = 2048, 200_000, 2_000_000
#: How much a product may differ from the exact sum, for values near 1.
SLACK = 1e-9
#: User-item matrices of at most so many cells (64 MB) are dense in training.
DENSE_CELLS = 8_000_000
#: Beyond that they are kept as bytes, if their smaller side has at most so many nodes and they at most so many cells (256 MB), and so many for each pair.
NARROW, NARROW_CELLS, CELLS_A_PAIR = 2048, 1 << 28, 64
#: Cells of what training makes for some edges or some rows of a larger graph at a time (4 MB).
PART_CELLS = 1 << 19


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bipartite_edges(log: DataFrame) -> DataFrame:
    """Both directions of distinct interactions; users are u<id>, items i<id>."""
    e = log.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("dst")).distinct()
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def normalised_edges(edges: DataFrame) -> DataFrame:
    """w = 1 / sqrt(degree of src * degree of dst)."""
    deg = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    out = edges.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    return out.select("src", "dst", (1.0 / F.sqrt(F.col("d").cast("double") * F.col("e"))).alias("w"))


def propagate(edges: DataFrame, x: DataFrame) -> DataFrame:
    """One step of x (node, k, v), a row a component: sums of the neighbours' values by weight."""
    return edges.join(x, edges["dst"] == x["node"]).groupBy(F.col("src").alias("node"), "k").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def propagated_mean(edges: DataFrame, x: DataFrame, layers: int) -> DataFrame:
    """Mean of x and `layers` steps of it. Edges should be stored or cached: every layer reads them."""
    out, step = x, x
    for _ in range(layers):
        step = propagate(edges, step)
        out = out.unionByName(step)
    return out.groupBy("node", "k").agg((F.sum("v") / (layers + 1)).alias("v"))


def recommend(users: DataFrame, items: DataFrame | ItemPasses, seen: DataFrame | None, k: int) -> DataFrame:
    """(user_id, item_id, score, rank) of each user's k best items by inner product that aren't seen; ties to the smaller item."""
    found = pruned_topk(users, items, seen, k)
    rows = found.select("user_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "x"))
    return rows.select("user_id", F.col("x.ids").alias("item_id"), F.col("x.scores").alias("score"), (F.col("at") + 1).alias("rank"))


def propagate_vectors(edges: DataFrame, x: DataFrame, dim: int) -> DataFrame:
    """One step of x (node, vec of `dim` values): a row an edge is joined and summed, whatever `dim` is."""
    sums = F.array(*[F.sum(F.col("w") * F.get("vec", F.lit(i))) for i in range(dim)])
    return edges.join(x, edges["dst"] == x["node"]).groupBy(F.col("src").alias("node")).agg(sums.alias("vec"))


def propagated_mean_vectors(edges: DataFrame, x: DataFrame, layers: int, dim: int) -> DataFrame:
    """Mean of x and `layers` steps of it, as vectors. Edges should be stored or cached; each step is stored before the next."""
    out, step = x.select("node", "vec"), x
    for layer in range(layers):
        step = prep.stored_once(propagate_vectors(edges, step, dim)) if layer + 1 < layers else propagate_vectors(edges, step, dim)
        out = out.unionByName(step)
    return out.groupBy("node").agg(F.array(*[F.sum(F.get("vec", F.lit(i))) / (layers + 1) for i in range(dim)]).alias("vec"))


@dataclass(frozen=True)
class ItemPasses:
    """Items by falling norm at the tasks' hands: broadcasts of several passes each, with how many items stand from there on and their largest norm."""

    parts: list[tuple[Broadcast, int, float]]
    pass_items: int


def broadcast_items(items: DataFrame, pass_items: int = PASS_ITEMS) -> ItemPasses:
    """The items (item_id, vec) for pruned_topk(), which goes over them `pass_items` at a time. Eager; one call serves any number of users' tables."""
    sc, parts = items.sparkSession.sparkContext, []
    for ids, factors, left in _item_parts(items, max(1, PASS_ITEMS // pass_items) * pass_items):
        parts.append((sc.broadcast((ids, factors)), left, float(np.sqrt((factors.astype(float) ** 2).sum(1).max())) if len(ids) else 0.0))
    return ItemPasses(parts, pass_items)


def pruned_topk(users: DataFrame, items: DataFrame | ItemPasses, seen: DataFrame | None, k: int, block_items: int = BLOCK_ITEMS, pass_items: int = PASS_ITEMS) -> DataFrame:
    """(user_id, ids, scores, scored, skipped): each user's k best unseen items, best first, and how many item blocks were scored and skipped for it.

    Items stand in blocks by falling norm. A user's score in a block is at most its norm times the block's largest, so a block where that is below the
    user's k-th score so far is skipped. Blocks come in passes of `pass_items` items, after each of which users for whom no further pass can matter leave; as many passes as hold
    PASS_ITEMS items are one broadcast and one step. A user's seen items travel with it: bounded by its own history. Users are dealt to all cores, as
    Spark goes by their bytes and not by the work they are.
    """
    if k < 1:
        raise ValueError("k is positive")
    rows = users.select(F.col("user_id").cast("long").alias("user_id"), F.col("vec").cast("array<double>").alias("vec"))
    if seen is not None:
        own = seen.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.collect_set(F.col("item_id").cast("long")).alias("seen"))
        rows = rows.join(own, "user_id", "left")
    else:
        rows = rows.withColumn("seen", F.lit(None).cast("array<bigint>"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = rows.withColumns({"ids": none("bigint"), "scores": none("double"), "scored": F.lit(0).cast("long"), "skipped": F.lit(0).cast("long"), "open": F.lit(True)})
    rows = rows.repartition(2 * users.sparkSession.sparkContext.defaultParallelism)
    passes = items if isinstance(items, ItemPasses) else broadcast_items(items, pass_items)
    out = None
    for number, (shared, left, _) in enumerate(passes.parts):
        if number:
            rows = prep.stored_once(rows)
            gone = rows.where(~F.col("open"))
            out = gone if out is None else out.unionByName(gone)
            rows = rows.where("open").repartition(2 * users.sparkSession.sparkContext.defaultParallelism)
        after = passes.parts[number + 1][2] if number + 1 < len(passes.parts) else None
        run = lambda it, s=shared, left=left, after=after, size=passes.pass_items: _scored(it, *s.value, k, block_items, size, left, after)
        rows = rows.mapInPandas(run, "user_id long, vec array<double>, seen array<bigint>, ids array<bigint>, scores array<double>, scored long, skipped long, open boolean")
    rows = rows if out is None else out.unionByName(rows)
    return rows.select("user_id", "ids", "scores", "scored", "skipped")


def _item_parts(items: DataFrame, part_items: int):
    """(ids, factors, items from here on) by falling norm, then id, at most part_items at once; factors as they are stored, in single or double precision."""
    kind = "array<float>" if items.schema["vec"].dataType.elementType.typeName() == "float" else "array<double>"
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("vec").cast(kind).alias("vec"))
    total = rows.count()
    if total > part_items:
        rows = rows.withColumn("_norm", F.sqrt(dot(F.col("vec"), F.col("vec"))))
        rows = prep.stored_once(prep.numbered(rows, F.desc("_norm"), F.col("item_id"), name="_at"))
    for start in range(0, max(total, 1), part_items):
        part = rows if total <= part_items else rows.where(F.col("_at").between(start, start + part_items - 1))
        got = part.select("item_id", "vec").toArrow()
        ids = got["item_id"].to_numpy()
        values = got["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        factors = values.reshape(len(ids), -1) if len(ids) else np.empty((0, 0))
        by = np.lexsort((ids, -np.round(np.sqrt((factors.astype(float) ** 2).sum(1)), 9)))
        yield ids[by], factors[by], total - start


def _scored(batches, ids: np.ndarray, factors: np.ndarray, k: int, block_items: int, pass_items: int, left: int, after: float | None):
    """Some passes over users: products of whole batches choose what may be among the best, sums in the order of components score it exactly.

    left: items from the first of these passes on; after: the largest norm of what comes after the last one, if anything does.
    """
    factors = np.ascontiguousarray(factors, float)
    of_norm = np.sqrt((factors**2).sum(1))
    starts = range(0, len(ids), pass_items)
    for b in batches:
        vecs = np.array(b["vec"].tolist(), float).reshape(len(b), -1)
        norms = np.sqrt((vecs**2).sum(1))
        seen = [np.asarray(x, np.int64) if x is not None else np.empty(0, np.int64) for x in b["seen"]]
        best = [(np.asarray(i, np.int64), np.asarray(s, float)) for i, s in zip(b["ids"], b["scores"], strict=True)]
        kth = np.array([s[-1] if len(s) == k else -np.inf for _, s in best])
        scored, skipped, open_ = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64), np.ones(len(b), bool)

        def leave(top: float, rest: int) -> None:
            """Users whose norm times the largest norm of what comes can't reach their k-th score."""
            gone = open_ & (norms * (top * (1 + SLACK) + SLACK) < kth)
            skipped[gone] += -(-rest // block_items)
            open_[gone] = False

        for start in starts:
            if start:
                leave(of_norm[start : start + pass_items].max(), left - start)
                if not open_.any():
                    break
            end = min(start + pass_items, len(ids))
            for first in range(start, end, block_items):
                own, f = ids[first : min(first + block_items, end)], factors[first : min(first + block_items, end)]
                top = float(of_norm[first : first + len(own)].max())
                slack = SLACK * (1 + norms * top)
                active = np.flatnonzero(open_ & (norms * top + slack >= kth))
                skipped[open_] += 1
                skipped[active] -= 1
                scored[active] += 1
                step = max(1, PRODUCT_CELLS // len(own))
                for at in range(0, len(active), step):
                    some = active[at : at + step]
                    products = vecs[some] @ f.T
                    for row in np.flatnonzero(products.max(axis=1) >= kth[some] - slack[some]).tolist():
                        u, s = int(some[row]), products[row]
                        room = k + len(seen[u])
                        least = np.partition(s, len(s) - room)[len(s) - room] if len(s) > room else -np.inf
                        near = np.flatnonzero(s >= max(least, kth[u]) - slack[u])
                        if len(seen[u]):
                            near = near[~np.isin(own[near], seen[u])]
                        if not len(near):
                            continue
                        # rounded, so that equal vectors tie
                        exact = np.round((f[near] * vecs[u]).sum(axis=1), 12)
                        i, x = np.concatenate([best[u][0], own[near]]), np.concatenate([best[u][1], exact])
                        by = np.lexsort((i, -x))[:k]
                        best[u] = i[by], x[by]
                        if len(by) == k:
                            kth[u] = x[by[-1]]
        if after is not None:
            leave(after, left - len(ids))
        yield b.assign(ids=[i for i, _ in best], scores=[s for _, s in best], scored=b["scored"].to_numpy() + scored, skipped=b["skipped"].to_numpy() + skipped, open=open_)


def without_seen(ranked: DataFrame, seen: DataFrame) -> DataFrame:
    """Ranked rows whose item the user hasn't seen, ranks closed up."""
    w = Window.partitionBy("user_id").orderBy("rank")
    return ranked.join(seen, ["user_id", "item_id"], "left_anti").withColumn("rank", F.row_number().over(w))


def covered_users(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Users whose candidates hold at least one true item."""
    return candidates.join(truth.distinct(), ["user_id", "item_id"], "left_semi").select("user_id").distinct()


def candidate_coverage(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: users, those whose candidates hold a true item, and their share. Candidates are read once, as making them is the larger part of the work."""
    hit = F.max(F.col("_hit").isNotNull().cast("int")).alias("hit")
    users = candidates.join(truth.select("user_id", "item_id").distinct().withColumn("_hit", F.lit(1)), ["user_id", "item_id"], "left").groupBy("user_id").agg(hit)
    out = users.agg(F.count(F.lit(1)).alias("users_before"), F.count_if(F.col("hit") == 1).alias("users_with_truth"))
    return out.withColumn("coverage", F.coalesce(F.try_divide(F.col("users_with_truth").cast("double"), F.col("users_before")), F.lit(0.0)))


def relevance(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """candidates with relevance 1 where the user's truth has the item, else 0. They join by user alone, so candidates that are dealt by user stay where they are."""
    t = truth.groupBy("user_id").agg(F.collect_set("item_id").alias("_true"))
    return candidates.join(t, "user_id", "left").withColumn("relevance", F.coalesce(F.array_contains("_true", F.col("item_id")), F.lit(False)).cast("int")).drop("_true")


def candidates_long(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates with their metadata; one without any keeps its id."""
    return candidates.join(items, "item_id", "left")


def ground_truth(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list("item_id")).alias("ground_truth"))


def als_factors(log: DataFrame, factors: int = 64, reg: float = 0.01, iterations: int = 20, alpha: float = 40.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(user_id, vec) and (item_id, vec) of implicit ALS on counted interactions."""
    from pyspark.ml.recommendation import ALS

    counts = log.groupBy(F.col("user_id").cast("int").alias("user_id"), F.col("item_id").cast("int").alias("item_id")).agg(F.count(F.lit(1)).cast("float").alias("value"))
    model = ALS(rank=factors, maxIter=iterations, regParam=reg, alpha=alpha, implicitPrefs=True, userCol="user_id", itemCol="item_id", ratingCol="value", seed=seed).fit(counts)
    of = lambda df, name: df.select(F.col("id").cast("long").alias(name), F.col("features").alias("vec"))
    return of(model.userFactors, "user_id"), of(model.itemFactors, "item_id")


def als_recommend(log: DataFrame, k: int, factors: int = 64, reg: float = 0.01, iterations: int = 20, alpha: float = 40.0, seed: int = 42) -> DataFrame:
    """Implicit ALS on counted interactions; seen items are left out, ties go to the smaller item."""
    return recommend(*als_factors(log, factors, reg, iterations, alpha, seed), seen_pairs(log), k)


def seen_pairs(log: DataFrame) -> DataFrame:
    return log.select(F.col("user_id").cast("long").alias("user_id"), F.col("item_id").cast("long").alias("item_id")).distinct()


def graph_pairs(log: DataFrame) -> np.ndarray:
    """The distinct pairs of a log on the driver, by user and item, as rows of an array: 16 bytes a pair, over Arrow."""
    got = seen_pairs(log).toArrow()
    pairs = np.stack([got[c].to_numpy() for c in ("user_id", "item_id")], axis=1)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def vector_frame(spark: SparkSession, vectors: np.ndarray, name: str) -> DataFrame:
    """(name, vec): rows of an array and their places, over Arrow."""
    n, dim = vectors.shape
    starts = pa.array(np.arange(n + 1) * dim, pa.int32())
    vecs = pa.ListArray.from_arrays(starts, pa.array(np.ascontiguousarray(vectors).reshape(-1)))
    return spark.createDataFrame(pa.table({name: pa.array(np.arange(n)), "vec": vecs}), f"{name} long, vec array<double>")


def _spread(u: np.ndarray, i: np.ndarray, w: np.ndarray, n_users: int, n_items: int, layers: int):
    """The mean of values of nodes and `layers` steps of weighted sums of their neighbours' values.

    For a small dense matrix R (users by items) all steps come from two products with R, whatever `layers` is: an even step of the users is R times what the items' odd
    step before is, and the items' steps are powers of R'R, of as many cells as the smaller side squared. Elsewhere each step adds along the edges.
    """
    if n_users * n_items <= DENSE_CELLS:
        flip = n_users < n_items
        a = np.zeros((n_users, n_items))
        np.add.at(a, (u, i - n_users), w)
        a = np.ascontiguousarray(a.T) if flip else a
        gram = a.T @ a

        def mean(x: np.ndarray) -> np.ndarray:
            large, small = (x[n_users:], x[:n_users]) if flip else (x[:n_users], x[n_users:])
            across, own = a.T @ large, small  # of the small side: what it gets from the large side's values, and from its own
            total, sent = small.copy(), np.zeros_like(small)
            for _ in range(layers):
                # a step: the small side gets what the large side has; the large side gets a @ (what the small side had)
                sent += own
                across, own = gram @ own, across
                total += own
            out = np.empty_like(x)
            big, little = (out[n_users:], out[:n_users]) if flip else (out[:n_users], out[n_users:])
            np.matmul(a, sent, out=big)
            big += large
            little[:] = total
            out /= layers + 1
            return out

        return mean
    to, source, weight = np.concatenate([u, i]), np.concatenate([i, u]), np.concatenate([w, w])
    by = np.argsort(to, kind="stable")
    to, source, weight = to[by], source[by], weight[by, None]
    del by

    def summed(x: np.ndarray) -> np.ndarray:
        total, step = x.copy(), x
        size = max(1, PART_CELLS // max(1, x.shape[1]))
        for _ in range(layers):
            out = np.zeros_like(x)
            for at in range(0, len(to), size):
                part = slice(at, at + size)
                nodes, first = np.unique(to[part], return_index=True)
                out[nodes] += np.add.reduceat(weight[part] * step[source[part]], first, axis=0)
            step = out
            total += step
        total /= layers + 1
        return total

    return summed


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """to[at] += rows, places of `at` that occur several times included."""
    by = np.argsort(at, kind="stable")
    places, first = np.unique(at[by], return_index=True)
    to[places] += np.add.reduceat(rows[by], first, axis=0)


def _adam_step(e: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, t: int, lr: float, rows: int = 1024) -> None:
    """One step of Adam, in place and by slices that stay in the cache; g is used up."""
    for at in range(0, len(e), rows):
        x, y, z, w = (q[at : at + rows] for q in (e, g, m, v))
        z *= 0.9
        z += 0.1 * y
        y *= y
        w *= 0.999
        w += 0.001 * y
        np.divide(w, 1 - 0.999**t, out=y)
        np.sqrt(y, out=y)
        y += 1e-8
        np.divide(z, y, out=y)
        y *= lr / (1 - 0.9**t)
        x -= y


class _Edges:
    """The nodes' vectors e of a graph: what they are after `layers` steps, and how they learn. Holds some seven arrays as large as e."""

    def __init__(self, e: np.ndarray, u: np.ndarray, i: np.ndarray, deg: np.ndarray, n_users: int, layers: int):
        self.e, self.m, self.v = e, np.zeros_like(e), np.zeros_like(e)
        self.spread = _spread(u, i, 1 / np.sqrt(deg[u] * deg[i]), n_users, len(e) - n_users, layers)

    def at(self, *nodes: np.ndarray) -> list[np.ndarray]:
        f = self.spread(self.e)
        return [f[x] for x in nodes]

    def learn(self, nodes: np.ndarray, grads: np.ndarray, decay: float, t: int, lr: float) -> None:
        """One step by the gradients of the vectors after the steps, and by `decay` times a node's own vector for each time it is listed."""
        g = np.zeros_like(self.e)
        _add_rows(g, nodes, grads)
        g = self.spread(g)
        g += (decay * np.bincount(nodes, minlength=len(g)))[:, None] * self.e
        _adam_step(self.e, g, self.m, self.v, t, lr)

    def final(self) -> np.ndarray:
        return self.spread(self.e)


class _Narrow:
    """As _Edges, for a graph with few nodes on one side: a matrix of bytes says how often a pair of nodes is there, and all of a step is one way over it by parts of rows.

    Only the nodes of a batch get their vectors before a step, and gradients are made, used and dropped by parts, so no array but e and Adam's two is as large as e.
    """

    def __init__(self, e: np.ndarray, u: np.ndarray, i: np.ndarray, deg: np.ndarray, n_users: int, layers: int):
        n_items = len(e) - n_users
        self.e, self.m, self.v, self.layers = e, np.zeros_like(e), np.zeros_like(e), layers
        flip = n_users < n_items
        self.wide, self.few = (slice(n_users, None), slice(0, n_users)) if flip else (slice(0, n_users), slice(n_users, None))
        self.counts = np.zeros((max(n_users, n_items), min(n_users, n_items)), np.uint8)
        np.add.at(self.counts, (i - n_users, u) if flip else (u, i - n_users), 1)
        root = 1 / np.sqrt(deg)[:, None]
        self.root_wide, self.root_few = root[self.wide], root[self.few]
        rows = max(1, PART_CELLS // max(e.shape[1], self.counts.shape[1]))
        self.parts = [slice(at, min(at + rows, len(self.counts))) for at in range(0, len(self.counts), rows)]
        gram = np.zeros((self.counts.shape[1],) * 2)
        for p in self.parts:
            c = self.counts[p] * self.root_wide[p]
            gram += c.T @ c
        self.gram = self.root_few * gram * self.root_few.T
        self.across = np.zeros_like(e[self.few])  # what the smaller side gets from the larger one's own vectors, but for its own weights
        for p in self.parts:
            self.across += self.counts[p].astype(float).T @ (self.root_wide[p] * e[self.wide][p])

    def _steps(self, own: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smaller side's sums over all steps, and over those that it sends on."""
        total, sent = own.copy(), np.zeros_like(own)
        for _ in range(self.layers):
            sent += own
            across, own = self.gram @ own, across
            total += own
        return total, sent

    def _wide_at(self, rows: np.ndarray | slice, sent: np.ndarray) -> np.ndarray:
        """What some rows of the larger side get."""
        return self.root_wide[rows] * (self.counts[rows].astype(float) @ (self.root_few * sent))

    def at(self, *nodes: np.ndarray) -> list[np.ndarray]:
        total, sent = self._steps(self.e[self.few], self.root_few * self.across)
        out = []
        for x in nodes:
            f, wide = np.empty((len(x), self.e.shape[1])), self._is_wide(x)
            rows = x[wide] - self.wide.start
            f[wide] = self.e[self.wide][rows] + self._wide_at(rows, sent)
            f[~wide] = total[x[~wide] - self.few.start]
            f /= self.layers + 1
            out.append(f)
        return out

    def _is_wide(self, nodes: np.ndarray) -> np.ndarray:
        return nodes >= self.wide.start if self.wide.start else nodes < self.wide.stop

    def learn(self, nodes: np.ndarray, grads: np.ndarray, decay: float, t: int, lr: float) -> None:
        """As _Edges.learn()."""
        listed, place, times = np.unique(nodes, return_inverse=True, return_counts=True)
        g = np.zeros((len(listed), grads.shape[1]))
        _add_rows(g, place, grads)
        wide = self._is_wide(listed)
        rows, g_rows, own = listed[wide] - self.wide.start, g[wide], np.zeros_like(self.across)
        own[listed[~wide] - self.few.start] = g[~wide]
        total, sent = self._steps(own, self.root_few * (self.counts[rows].astype(float).T @ (self.root_wide[rows] * g_rows)))
        total /= self.layers + 1
        g_rows /= self.layers + 1
        g_rows += (decay * times[wide])[:, None] * self.e[self.wide][rows]
        total[listed[~wide] - self.few.start] += (decay * times[~wide])[:, None] * self.e[self.few][listed[~wide] - self.few.start]
        sent *= self.root_few / (self.layers + 1)
        e, m, v = (x[self.wide] for x in (self.e, self.m, self.v))
        self.across = np.zeros_like(self.across)
        for p in self.parts:
            c = self.counts[p].astype(float)
            g = c @ sent
            g *= self.root_wide[p]
            here = slice(*np.searchsorted(rows, (p.start, p.stop)))
            g[rows[here] - p.start] += g_rows[here]
            _adam_step(e[p], g, m[p], v[p], t, lr)
            np.multiply(self.root_wide[p], e[p], out=g)
            self.across += c.T @ g
        _adam_step(self.e[self.few], total, self.m[self.few], self.v[self.few], t, lr)

    def final(self) -> np.ndarray:
        total, sent = self._steps(self.e[self.few], self.root_few * self.across)
        del self.m, self.v
        for p in self.parts:
            self.e[self.wide][p] += self._wide_at(p, sent)
        self.e[self.few] = total
        self.e /= self.layers + 1
        return self.e


def lightgcn_fit(pairs: np.ndarray, n_users: int, n_items: int, dim: int = 64, layers: int = 3, epochs: int = 100, batch: int = 2048, lr: float = 1e-3, decay: float = 1e-4, seed: int = 42, tries: int = 100) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """User and item vectors, and the loss of each epoch. Propagation is linear and symmetric: the gradient passes through the same operator.

    Training is on the driver, for graphs that fit in it; a user who has seen all items is skipped after `tries` draws. Nothing is made for all edges at once but
    their numbers, so its memory is some 50 bytes a pair and three vectors a node, or some 100 bytes and seven vectors if neither side is narrow.
    """
    rng = np.random.default_rng(seed)
    n = n_users + n_items
    # users and items start uniform within the root of 6 / (their number + dim)
    e = np.empty((n, dim))
    for own in (e[:n_users], e[n_users:]):
        for at in range(0, len(own), 4096):
            own[at : at + 4096] = rng.uniform(-1, 1, own[at : at + 4096].shape) * np.sqrt(6 / (len(own) + dim))
    u, i = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1] + n_users
    deg = np.maximum(np.bincount(u, minlength=n) + np.bincount(i, minlength=n), 1)
    seen = u * n_items + pairs[:, 1]
    seen = seen if (seen[1:] > seen[:-1]).all() else np.unique(seen)
    cells = n_users * n_items
    narrow = DENSE_CELLS < cells <= min(NARROW_CELLS, CELLS_A_PAIR * len(pairs)) and min(n_users, n_items) <= NARROW and len(seen) == len(pairs)
    graph = (_Narrow if narrow else _Edges)(e, u, i, deg, n_users, layers)

    def known(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * n_items + b
        return seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] == key

    t, losses = 0, []
    for _ in range(epochs):
        order, loss = rng.permutation(len(pairs)), 0.0
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            bu, bi = u[rows], i[rows]
            neg = rng.integers(0, n_items, len(rows))
            bad = np.arange(len(rows))
            for _ in range(tries):
                bad = bad[known(bu[bad], neg[bad])]  # a draw that was good stays
                if not len(bad):
                    break
                refused, neg[bad] = bad, rng.integers(0, n_items, len(bad))
            else:
                bu, bi, neg = np.delete(bu, refused), np.delete(bi, refused), np.delete(neg, refused)
            if not len(bu):
                continue
            bn = neg + n_users
            fu, fi, fn = graph.at(bu, bi, bn)
            fi -= fn
            x = (fu * fi).sum(1)
            p = 1 / (1 + np.exp(-x))
            size = len(bu)
            loss += float(-np.log(p + 1e-8).sum() + decay * ((e[bu] ** 2).sum() + (e[bi] ** 2).sum() + (e[bn] ** 2).sum()))
            c = (-(1 - p) * p / (p + 1e-8) / size)[:, None]
            t += 1
            graph.learn(np.concatenate([bu, bi, bn]), np.concatenate([c * fi, c * fu, -c * fu]), 2 * decay / size, t, lr)
        losses.append(loss / max(1, len(pairs)))
    f = graph.final()
    return f[:n_users], f[n_users:], losses


def scan_for_truth(order: DataFrame, score: Callable[[DataFrame], DataFrame], truth: DataFrame, max_users: int | None = None, batch: int = 256) -> tuple[DataFrame, DataFrame]:
    """The first users, in order (user_id, place from 0), whose candidates hit their truth, scoring no more users than that takes.

    score(users) gives (user_id, item_id, rank) of some users. Users are scored in steps of 1, 2, 4, ... batches, each stored before the next, until there are
    enough. Returns (user_id, place, scanned_users) and the candidates of these users; scanned_users counts whole batches up to the last user needed.
    """
    if batch < 1 or (max_users is not None and max_users < 1):
        raise ValueError("batch and max_users are positive")
    order = prep.stored_once(order.select("user_id", "place"))
    total = order.count()
    need, got, start, size, steps = total if max_users is None else max_users, 0, 0, batch, []
    while start < total and got < need:
        users = order.where(F.col("place").between(start, start + size - 1))
        ranked = prep.stored_once(score(users.select("user_id")))
        hits = prep.stored_once(covered_users(ranked, truth).join(users, "user_id"))
        got += hits.count()
        steps.append((ranked, hits))
        start, size = start + size, 2 * size
    if not steps:
        ranked = score(order.select("user_id"))
        return order.limit(0).withColumn("scanned_users", F.lit(0).cast("long")), ranked.limit(0)
    ranked, hits = (reduce(DataFrame.unionByName, x) for x in zip(*steps, strict=True))
    kept = hits if max_users is None else hits.orderBy("place").limit(max_users)
    last = kept.agg(F.max("place")).first()[0]
    scanned = min(total, (last // batch + 1) * batch) if got >= need else total
    kept = prep.stored_once(kept.select("user_id", "place", F.lit(scanned).cast("long").alias("scanned_users")))
    return kept, ranked.join(kept.select("user_id"), "user_id", "left_semi")


def truth_scan(ranked: DataFrame, truth: DataFrame, order: DataFrame, max_users: int | None = None, batch: int = 256) -> DataFrame:
    """(user_id, place, scanned_users): the first users, in order (user_id, place from 0), whose candidates hit their truth.

    Users are scanned in batches until there are enough; scanned_users counts those of all batches up to then. Eager: the users found are stored.
    """
    if batch < 1 or (max_users is not None and max_users < 1):
        raise ValueError("batch and max_users are positive")
    hit = covered_users(ranked, truth).select("user_id").join(order, "user_id")
    # stored: its count, its rows and what the caller makes of them read it, and the candidates behind it are the larger part of the work
    kept = prep.stored_once(hit if max_users is None else hit.orderBy("place").limit(max_users))
    total = order.count()
    need = total if max_users is None else max_users
    got = kept.agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last")).first()
    scanned = min(total, (got["last"] // batch + 1) * batch) if got["n"] >= need and got["n"] else total
    return kept.select("user_id", "place", F.lit(scanned).cast("long").alias("scanned_users"))
