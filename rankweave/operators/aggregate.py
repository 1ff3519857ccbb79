"""Rank aggregation: Borda, Bayesian position calibration, greedy selection, over pluggable scorers."""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores of the candidates given in the order they are shown.
Scorer = Callable[[str, Sequence[str]], Sequence[float]]


def borda(runs: DataFrame, outer_index: int = 1) -> DataFrame:
    """Points n - rank over a user's lists; ties by raw score, then by the outer list's input order."""
    z = runs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id", "permutation_index")))
    a = z.groupBy("user_id", "item_id").agg(F.sum(F.col("n") - F.col("output_rank")).alias("points"), F.sum("score").alias("raw"), F.min(F.when(F.col("permutation_index") == outer_index, F.col("input_position"))).alias("outer"))
    w = Window.partitionBy("user_id").orderBy(F.desc("points"), F.desc("raw"), "outer")
    return a.select("user_id", "item_id", "points", (F.row_number().over(w) - 1).alias("output_rank"))


def calibration_matrix(observed: DataFrame, n: int, smoothing: float = 1.0) -> DataFrame:
    """(true_pos, pred_pos, p): smoothed counts of where the winner came from, rows summing to 1. n is a list's length: small."""
    spark = observed.sparkSession
    grid = spark.range(n * n).select((F.col("id") / n).cast("int").alias("true_pos"), (F.col("id") % n).cast("int").alias("pred_pos"))
    counts = observed.groupBy("true_pos", "pred_pos").agg(F.count(F.lit(1)).alias("c"))
    m = grid.join(counts, ["true_pos", "pred_pos"], "left").withColumn("v", F.coalesce("c", F.lit(0)) + F.lit(float(smoothing)))
    return m.select("true_pos", "pred_pos", (F.col("v") / F.sum("v").over(Window.partitionBy("true_pos"))).alias("p"))


def calibration_diagnostics(matrix: DataFrame, n: int) -> DataFrame:
    rows = matrix.groupBy("true_pos").agg(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0)).alias("h"), F.min("p").alias("least"), F.max("p").alias("most"))
    least, most = F.min("least").alias("min_probability"), F.max("most").alias("max_probability")
    each = F.transform(F.array_sort(F.collect_list(F.struct("true_pos", "h"))), lambda x: x["h"])
    return rows.agg(F.avg("h").alias("mean_entropy"), (F.avg("h") / math.log(n) if n > 1 else F.lit(0.0)).alias("normalised_entropy"), least, most, each.alias("row_entropies"))


def bayes_update(prior: DataFrame, matrix: DataFrame, predicted: DataFrame) -> DataFrame:
    """prior (request_id, pos, p) and the predicted position of each request: p * T[pos, predicted], normalised; uniform if that is nothing."""
    t = matrix.select(F.col("true_pos").alias("pos"), "pred_pos", F.col("p").alias("t"))  # a list's length squared: Spark broadcasts it if it is small
    z = prior.join(predicted, "request_id").join(t, ["pos", "pred_pos"]).withColumn("v", F.col("p") * F.col("t"))
    w = Window.partitionBy("request_id")
    total = F.sum("v").over(w)
    return z.select("request_id", "pos", F.when(total > 0, F.col("v") / total).otherwise(1.0 / F.count(F.lit(1)).over(w)).alias("p"))


class Calibrator:
    """A row-stochastic transition matrix: where a true winner's position is read to be."""

    def __init__(self, matrix):
        m = np.asarray(matrix, float)
        if m.ndim != 2 or m.shape[0] != m.shape[1] or not m.size:
            raise ValueError("a transition matrix is square and not empty")
        if not np.isfinite(m).all() or (m < 0).any() or (m.sum(axis=1) <= 0).any():
            raise ValueError("a transition matrix has finite entries from 0 and no empty row")
        self.matrix = m / m.sum(axis=1, keepdims=True)

    def update(self, prior: np.ndarray, predicted: int) -> np.ndarray:
        v = prior * self.matrix[:, predicted]
        total = v.sum()
        return v / total if np.isfinite(total) and total > 0 else np.full(len(v), 1.0 / len(v))


def request_seed(seed: int, user_id: str, split: str | None, ids: Sequence[str], permutation: Sequence[int]) -> int:
    """The first 64 bits of SHA-256 of the request as canonical JSON."""
    said = json.dumps({"candidate_ids": list(ids), "permutation": [int(p) for p in permutation], "seed": int(seed), "split": split, "user_id": user_id}, sort_keys=True, separators=(",", ":"))
    return int(hashlib.sha256(said.encode()).hexdigest()[:16], 16)


def shuffled(values: Sequence, seed: int) -> list:
    out = list(values)
    random.Random(seed).shuffle(out)
    return out


def ranked(scorer: Scorer, user: str, ids: Sequence[str], shown: Sequence[int]) -> list[tuple[int, float]]:
    """(candidate, score) by falling score; equal ones as shown."""
    scores = [float(s) for s in scorer(user, [ids[i] for i in shown])]
    if len(scores) != len(shown) or not all(map(math.isfinite, scores)):
        raise ValueError("a scorer gives one finite score for each candidate shown")
    return sorted(zip(shown, scores, strict=True), key=lambda x: -x[1])


def bootstrapping(scorer: Scorer, user: str, ids: Sequence[str], outer: Sequence[int], seed: int, samples: int = 3) -> list[int]:
    """The outer order and shuffles of it, scored and joined by Borda points."""
    n, points, raw = len(outer), dict.fromkeys(outer, 0), dict.fromkeys(outer, 0.0)
    for i in range(samples):
        for rank, (c, s) in enumerate(ranked(scorer, user, ids, shuffled(outer, seed + 1009 * i) if i else outer)):
            points[c] += n - rank
            raw[c] += s
    place = {c: i for i, c in enumerate(outer)}
    return sorted(outer, key=lambda c: (-points[c], -raw[c], place[c]))


def greedy_selection(scorer: Scorer, user: str, ids: Sequence[str], outer: Sequence[int], seed: int, size: int = 1) -> list[int]:
    """Takes the best `size` of what remains, shuffles the rest, and again; the last round takes what is left."""
    rng, remaining, out = random.Random(seed), list(outer), []
    while remaining:
        top = [c for c, _ in ranked(scorer, user, ids, remaining)[:size]]
        out += top
        remaining = [c for c in remaining if c not in top]
        rng.shuffle(remaining)
    return out


def stella(scorer: Scorer, calibrator: Calibrator, user: str, ids: Sequence[str], outer: Sequence[int], seed: int, max_updates: int = 10, tolerance: float = 1e-6, stable: int = 3, least_gain: float = 1e-6) -> list[int]:
    """Bayesian updates of who wins, from where the winner was shown; the posterior of least entropy orders the candidates.

    If even that says nothing (its gain over the uniform is at most `least_gain`), its own raw ranking stands.
    """
    n = len(ids)
    prior, place = np.full(n, 1.0 / n), {c: i for i, c in enumerate(outer)}
    best, before, steady = None, None, 0
    for u in range(max_updates):
        shown = shuffled(outer, seed + 1009 * u) if u else list(outer)
        order = [c for c, _ in ranked(scorer, user, ids, shown)]
        prior[shown] = calibrator.update(prior[shown], shown.index(order[0]))
        positive = prior[prior > 0]
        entropy = float(-(positive * np.log(positive)).sum())
        raw = {c: i for i, c in enumerate(order)}
        posterior = sorted(range(n), key=lambda c: (-prior[c], raw[c], place[c]))
        if best is None or entropy < best[0]:
            best = (entropy, posterior, order)
        steady = steady + 1 if before is not None and abs(before - entropy) <= tolerance else 0
        before = entropy
        if steady >= stable:
            break
    return best[2] if math.log(n) - best[0] <= least_gain else best[1]


def rerank(requests: DataFrame, method: Callable[[str, list[str]], list[int]]) -> DataFrame:
    """requests (user_id, items in the outer order) to (user_id, item_id, output_rank, score); a list is one row, so requests spread freely."""

    def run(batches):
        for b in batches:
            rows = []
            for user, items in zip(b["user_id"], b["items"], strict=True):
                ids = list(items)
                rows += [(user, ids[c], r, float(len(ids) - r)) for r, c in enumerate(method(str(user), ids))]
            if rows:
                yield pd.DataFrame(rows, columns=["user_id", "item_id", "output_rank", "score"])

    # ids travel as text: pandas makes floats of whole numbers beside a null
    kind = dict(requests.dtypes)["user_id"]
    out = requests.select(F.col("user_id").cast("string").alias("user_id"), "items").mapInPandas(run, "user_id string, item_id string, output_rank int, score double")
    return out.withColumn("user_id", F.col("user_id").cast(kind))
