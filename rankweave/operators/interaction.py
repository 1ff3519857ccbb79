"""Candidate-to-candidate score corrections by a small network with given weights, one list at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of one array of hidden units at once; lists of one length are corrected together up to it.
CELLS = 30_000

#: The normal distribution function on a grid, with three more terms of its series at each point, in steps; beyond the ends it is 0 and 1 in double precision.
_STEPS, _END = 1024, 9.0
_GRID = np.arange(-_END * _STEPS, _END * _STEPS + 1) / _STEPS
_SLOPE = np.exp(-(_GRID**2) / 2) / math.sqrt(2 * math.pi) / _STEPS
_SERIES = [np.array([math.erfc(-x / math.sqrt(2)) / 2 for x in _GRID]), _SLOPE, -_GRID * _SLOPE / 2 / _STEPS, (_GRID**2 - 1) * _SLOPE / 6 / _STEPS**2]


def gelu(x: np.ndarray) -> np.ndarray:
    """x times the normal distribution function of x, within 1e-14, by slices that stay in the cache."""
    flat = np.ascontiguousarray(x, float).reshape(-1)
    out = np.empty_like(flat)
    for start in range(0, len(flat), 8192):
        z, y = flat[start : start + 8192], out[start : start + 8192]
        t = np.clip(z, -_END, _END)
        t += _END
        t *= _STEPS
        np.rint(t, out=y)
        t -= y
        with np.errstate(invalid="ignore"):
            at = y.astype(np.int32)  # of NaN any place, clipped below: t stays NaN
        np.take(_SERIES[3], at, out=y, mode="clip")
        for term in _SERIES[2::-1]:
            y *= t
            y += term.take(at, mode="clip")
        y *= z
    return out.reshape(x.shape)


def random_weights(dim: int, width: int = 16, hidden: int = 32, seed: int = 0) -> dict:
    rng = np.random.default_rng(seed)
    dense = lambda i, h, o: {"w1": rng.normal(0, i**-0.5, (i, h)), "b1": np.zeros(h), "w2": rng.normal(0, h**-0.5, (h, o)), "b2": np.zeros(o)}
    return {"gain": np.ones(dim), "shift": np.zeros(dim), "project": rng.normal(0, dim**-0.5, (dim, width)), "offset": np.zeros(width), "relation": dense(4 * width + 1, hidden, width), "compare": rng.normal(0, width**-0.5, (width, 1)), "gate": dense(4 * width, hidden, 1), "scale": 0.1}


def weights_of(mode: str, dim: int, width: int = 256, hidden: int = 512, scale: float = 0.1, seed: int = 0) -> dict | None:
    """The weights of an interaction mode: none has none, relational has fresh ones."""
    if mode == "none":
        return None
    if mode != "relational":
        raise ValueError(f"no such interaction: {mode}; there are none and relational")
    return random_weights(dim, width, hidden, seed) | {"scale": scale}


def relational_correction(x: np.ndarray, base: np.ndarray, w: dict) -> np.ndarray:
    """Gated advantages of each candidate over all others: antisymmetric, so a list's corrections sum to 0; permutations commute with it."""
    return relational_corrections(x[None], base[None], w)[0]


def relational_corrections(x: np.ndarray, base: np.ndarray, w: dict) -> np.ndarray:
    """The corrections of lists of one length: x (lists, n, dim), base (lists, n).

    The relation of a and b reads a, b, a - b, a * b and their scores' difference; the gate a + b, |a - b|, a * b and the mean. What is linear in one candidate is
    computed once for it, and each pair once: its gate is the same both ways, and only the difference of the relation's two ways counts.
    """
    lists, n = base.shape
    if n < 2:
        return np.zeros((lists, n))
    x = (x - x.mean(2, keepdims=True)) / np.sqrt(x.var(2, keepdims=True) + 1e-5) * w["gain"] + w["shift"]
    v = x @ w["project"] + w["offset"]
    of_a, of_b, of_less, of_times, of_base = np.split(w["relation"]["w1"], np.arange(1, 5) * v.shape[2])
    of_sum, of_far, of_both, of_mean = np.split(w["gate"]["w1"], 4)
    mine, other, summed = v @ (of_a + of_less), v @ (of_b - of_less), v @ of_sum
    i, j = np.triu_indices(n, 1)
    a, b = v[:, i], v[:, j]
    product = a * b
    even, odd = product @ of_times + w["relation"]["b1"], (base[:, i] - base[:, j])[..., None] * of_base
    last = w["relation"]["w2"] @ w["compare"]
    ahead = (gelu(mine[:, i] + other[:, j] + even + odd) - gelu(mine[:, j] + other[:, i] + even - odd)) @ last
    hidden = summed[:, i] + summed[:, j] + np.abs(a - b) @ of_far + product @ of_both + (v.mean(1) @ of_mean)[:, None] + w["gate"]["b1"]
    logit = gelu(hidden) @ w["gate"]["w2"] + w["gate"]["b2"]
    each = np.zeros((lists, n, n))
    each[:, i, j] = (ahead / (1 + np.exp(-logit)))[..., 0]
    return w["scale"] * (each.sum(2) - each.sum(1)) / (n - 1)


def correct_scores(lists: DataFrame, weights: dict) -> DataFrame:
    """lists (request_id, item_id, score, vec) to (request_id, item_id, correction); a request's candidates are one row of arrays, and lists of one length are corrected together."""
    width, dim = max(weights["project"].shape[1], *(weights[x]["w1"].shape[1] for x in ("relation", "gate"))), len(weights["gain"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b["items"].value_lengths().to_numpy(zero_copy_only=False)
            score, vec = (b[c].flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("scores", "vecs"))
            if len(vec) != dim * len(score) or (b["vecs"].value_lengths().to_numpy(zero_copy_only=False) != dim * sizes).any():
                raise ValueError(f"a candidate's vector doesn't have {dim} values")
            starts, out = np.cumsum(sizes) - sizes, np.empty(len(score))
            for n in np.unique(sizes).tolist():
                of_size = starts[sizes == n]
                step = max(1, CELLS // (n * n * width))
                for at in range(0, len(of_size), step):
                    rows = of_size[at : at + step, None] + np.arange(n)
                    out[rows] = relational_corrections(vec.reshape(-1, dim)[rows], score[rows], weights)
            yield pa.RecordBatch.from_arrays([b["request_id"].take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), b["items"].flatten(), pa.array(out)], ["request_id", "item_id", "correction"])

    kinds = dict(lists.dtypes)
    rows = F.array_sort(F.collect_list(F.struct("item_id", F.col("score").cast("double").alias("score"), F.col("vec").cast("array<double>").alias("vec"))))
    of = lambda c: F.transform("l", lambda x: x[c])
    packed = lists.groupBy("request_id").agg(rows.alias("l")).select("request_id", of("item_id").alias("items"), of("score").alias("scores"), F.flatten(of("vec")).alias("vecs"))
    return packed.mapInArrow(run, f"request_id {kinds['request_id']}, item_id {kinds['item_id']}, correction double")
