"""The calibration run: its probe users, the requests it makes, their scoring, and stored matrices with what they were calibrated for."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import sampling
from rankweave.operators import reranking
from rankweave.operators.aggregate import Calibrator
from rankweave.sources import store

# What a run has to share with the calibration of its matrix.
PROVENANCE = ["model_name_or_path", "scoring", "prompt", "architecture", "adapter_path", "candidate_count"]
#: Steps of a request's seed from user to user and from place to place.
USER_STEP, PLACE_STEP = 1_000_003, 1009


def calibration_requests(candidates: DataFrame, truth: DataFrame, n: int, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(user_id, target, true_pos, repeat, permutation): each relevant candidate at each place of the list, `repeats` times.

    candidates: (user_id, pos, item_id) with n places from 0 for each user; truth: (user_id, item_id). The other candidates come in
    a seeded order. Users without a relevant candidate have no requests; a repeated truth row counts once.
    """
    if n < 1 or repeats < 1:
        raise ValueError("there is one place and one repeat at least")
    true = truth.select("user_id", F.col("item_id").cast("string").alias("item_id")).distinct()
    hits = candidates.withColumn("item_id", F.col("item_id").cast("string")).join(true, ["user_id", "item_id"], "left_semi")
    grid = hits.select("user_id", F.col("pos").cast("int").alias("target"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("true_pos"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    grid = grid.withColumn("_seed", F.lit(seed) + F.col("user_id").cast("long") * USER_STEP + F.col("true_pos") * PLACE_STEP + F.col("repeat"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for target, place, s in zip(b["target"].tolist(), b["true_pos"].tolist(), b["_seed"].tolist(), strict=True):
                others = [i for i in range(n) if i != target]
                random.Random(s).shuffle(others)
                rows.append([*others[:place], target, *others[place:]])
            yield b.drop(columns="_seed").assign(permutation=rows)

    kind = dict(candidates.dtypes)["user_id"]
    return grid.mapInPandas(run, f"user_id {kind}, target int, true_pos int, repeat int, permutation array<int>")


def load_calibrator(path: str) -> tuple[Calibrator, dict]:
    """A matrix and what it was calibrated for: from .npy, a JSON list, or a JSON mapping with `transition_matrix` or `matrix`."""
    source = Path(path)
    if source.suffix.lower() == ".npy":
        return Calibrator(np.load(source)), {}
    said = json.loads(source.read_text(encoding="utf-8"))
    if not isinstance(said, dict):
        return Calibrator(said), {}
    if "transition_matrix" not in said and "matrix" not in said:
        raise ValueError(f"{path} names no matrix")
    return Calibrator(said["transition_matrix"] if "transition_matrix" in said else said["matrix"]), said.get("provenance") or {}


def _plain(field: str, value):
    if value is None or (field == "adapter_path" and not str(value).strip()):
        return None
    if field == "candidate_count":
        return int(value)
    is_path = field == "adapter_path" or (field == "model_name_or_path" and Path(str(value)).exists())
    return str(Path(str(value)).resolve()) if is_path else str(value)


def check_provenance(calibrated: Mapping, run: Mapping) -> None:
    """An error that names each field which the calibration lacks or has other than the run."""
    if lacking := [f for f in PROVENANCE if f not in calibrated]:
        raise ValueError(f"the calibration doesn't say its {', '.join(lacking)}; calibrate anew")
    pairs = {f: (_plain(f, calibrated[f]), _plain(f, run.get(f))) for f in PROVENANCE}
    if other := [f"{f} {a!r}, not {b!r}" for f, (a, b) in pairs.items() if a != b]:
        raise ValueError(f"the matrix was calibrated for {'; '.join(other)}")


def probe_violations(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(user_id, problem) of users who can't be probed: no true item, or none among the candidates."""
    users = candidates.select("user_id").distinct()
    text = lambda df: df.select("user_id", F.col("item_id").cast("string").alias("item_id"))
    known = truth.where(F.col("item_id").isNotNull()).select("user_id", F.lit(True).alias("_t")).distinct()
    hit = text(candidates).join(text(truth), ["user_id", "item_id"], "left_semi").select("user_id", F.lit(True).alias("_h")).distinct()
    rows = users.join(known, "user_id", "left").join(hit, "user_id", "left").where(F.col("_h").isNull())
    return rows.select("user_id", F.when(F.col("_t").isNull(), "no true item").otherwise("no true item among the candidates").alias("problem"))


def check_probes(candidates: DataFrame, truth: DataFrame, split: str | None) -> int:
    """The common length of the candidate lists, of validation candidates that can all be probed; else an error that says why not."""
    if str(split or "").lower() != "val":
        raise ValueError("a calibration takes validation candidates: others would leak what is to be tested")
    lengths = candidates.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    if lengths["least"] is None:
        raise ValueError("there are no users to probe")
    if lengths["least"] != lengths["most"] or lengths["least"] < 2:
        raise ValueError(f"the lists need one length of two or more; they have {lengths['least']} to {lengths['most']} candidates")
    if shown := probe_violations(candidates, truth).orderBy("user_id").limit(6).collect():
        said = "; ".join(f"user {r['user_id']}: {r['problem']}" for r in shown[:5])
        raise ValueError(f"users without a true candidate: {said}{'; and more' if len(shown) > 5 else ''}")
    return lengths["least"]


def score_requests(requests: DataFrame, candidates: DataFrame, scorer: reranking.BatchScorer, batch_size: int = 32) -> DataFrame:
    """(true_pos, pred_pos, n): how often the winner of a request with its target at one place was read at another.

    requests: those of calibration_requests; candidates: (user_id, pos, item_id). Each task counts its requests; a list's length squared rows leave it.
    """
    lists = candidates.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("item_id").cast("string").alias("i")))), lambda x: x["i"]).alias("_ids"))
    shown = F.transform("permutation", lambda p: F.get("_ids", p))
    rows = requests.join(lists, "user_id").select(F.col("user_id").cast("string").alias("user"), "true_pos", shown.alias("shown"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[int, int], int] = {}
        for b in batches:
            asked = [(u, list(x)) for u, x in zip(b["user"], b["shown"], strict=True)]
            for place, scores in zip(b["true_pos"].tolist(), reranking.rank_many(scorer, asked, batch_size), strict=True):
                key = place, int(np.argmax(scores))  # the first of equal scores wins
                counts[key] = counts.get(key, 0) + 1
        if counts:
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["true_pos", "pred_pos", "n"])

    return rows.mapInPandas(run, "true_pos int, pred_pos int, n long").groupBy("true_pos", "pred_pos").agg(F.sum("n").alias("n"))


def calibrate(candidates: DataFrame, truth: DataFrame, scorer: reranking.BatchScorer, provenance: Mapping, split: str | None, max_users: int = 150, repeats: int = 5, smoothing: float = 1.0, seed: int = 42, batch_size: int = 32) -> dict:
    """A matrix, what it was calibrated for and how, from a seeded sample of probe users. Eager."""
    if max_users < 1 or repeats < 1 or batch_size < 1:
        raise ValueError("max_users, repeats and batch_size are positive")
    if smoothing < 0:
        raise ValueError("smoothing isn't negative")
    n = check_probes(candidates, truth, split)
    all_users = candidates.select("user_id").distinct()
    users = sampling.select_users(all_users, max_users, sample=True, seed=seed)
    probes = candidates.join(users, "user_id", "left_semi")
    requests = calibration_requests(probes, truth, n, repeats, seed)
    counts = {(r["true_pos"], r["pred_pos"]): r["n"] for r in score_requests(requests, probes, scorer, batch_size).collect()}  # a list's length squared
    matrix = np.full((n, n), float(smoothing))
    for at, c in counts.items():
        matrix[at] += c
    said = {k: provenance.get(k) for k in PROVENANCE} | {"candidate_count": n}
    how = {"num_probe_users": users.count(), "num_available_probe_users": all_users.count(), "num_queries": sum(counts.values()), "repeats": repeats, "smoothing": smoothing, "seed": seed}
    return {"transition_matrix": Calibrator(matrix).matrix.tolist(), "provenance": said | {"split": "val"}, "diagnostics": how}


def fingerprint(provenance: Mapping) -> str:
    """One name for all ways to say the same provenance."""
    said = {f: _plain(f, provenance.get(f)) for f in PROVENANCE}
    return hashlib.sha256(json.dumps(said, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]


def cached_calibration(spark: SparkSession, root: str, provenance: Mapping, make: Callable[[], dict]) -> tuple[Calibrator, bool]:
    """The calibrator of a provenance, and whether it was stored already; make() gives one where there is none.

    A matrix stands under its provenance's fingerprint and is put in place by a rename: of two runs that make the same one at once, the first to
    end stays, and both use it. A file that says another provenance than it is asked for is refused.
    """
    path = f"{root.rstrip('/')}/{fingerprint(provenance)}.json"
    said = store.get_text(spark, path)
    known = said is not None
    if not known:
        made = make()
        check_provenance(made["provenance"], provenance)
        store.put_text(spark, path, json.dumps(made))
        said = store.get_text(spark, path)
    stored = json.loads(said)
    check_provenance(stored.get("provenance") or {}, provenance)
    return Calibrator(stored["transition_matrix"]), known
