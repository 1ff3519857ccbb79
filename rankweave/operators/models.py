"""Retrieval models: factors of users and items, what users have seen, and how the fit went; saved and loaded as versions of a store.

Defined cases: a fit on no interactions is an error; a loaded model of another kind than asked for is one too; seen pairs added later count at once, without a new
fit; users without factors get no recommendations.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators import retrieval
from rankweave.sources import store
from rankweave.sources.readers import require


@dataclass(frozen=True)
class RetrievalModel:
    kind: str
    users: DataFrame  # user_id, vec
    items: DataFrame  # item_id, vec
    seen: DataFrame  # user_id, item_id
    stats: dict = field(default_factory=dict)

    def recommend(self, k: int, users: DataFrame | None = None, exclude_seen: bool = True) -> DataFrame:
        """(user_id, item_id, score, rank) of all users, or of some (user_id)."""
        asked = self.users if users is None else self.users.join(users.select(F.col("user_id").cast("long").alias("user_id")).distinct(), "user_id", "left_semi")
        return retrieval.recommend(asked, self.items, self.seen if exclude_seen else None, k)

    def with_seen(self, more: DataFrame) -> RetrievalModel:
        """The same model, for which more pairs (user_id, item_id) are seen."""
        return replace(self, seen=self.seen.unionByName(retrieval.seen_pairs(more)).distinct())

    def save(self, root: str) -> int:
        """A new version in a store; its number."""
        tables = {"users": self.users, "items": self.items, "seen": self.seen}
        return store.commit(self.users.sparkSession, root, tables, {"kind": self.kind, "stats": self.stats})


def load_model(spark: SparkSession, root: str, kind: str | None = None, number: int | None = None) -> RetrievalModel:
    tables, note = store.current(spark, root, number)
    if "kind" not in note or set(tables) != {"users", "items", "seen"}:
        raise TypeError(f"{root} holds no retrieval model")
    if kind is not None and note["kind"] != kind:
        raise TypeError(f"{root} holds a model of kind {note['kind']}, not {kind}")
    return RetrievalModel(note["kind"], tables["users"], tables["items"], tables["seen"], note["stats"])


def fit_model(log: DataFrame, kind: str, fit: Callable[[DataFrame], tuple[DataFrame, DataFrame, list[float]]]) -> RetrievalModel:
    """A model of a log (user_id, item_id, ...) by a fit that gives factors of users and of items and the losses of its epochs, with its statistics."""
    require(log, ["user_id", "item_id"])
    size = log.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("user_id").cast("long")).alias("u"), F.max(F.col("item_id").cast("long")).alias("i")).first()
    if not size["n"]:
        raise ValueError("there are no interactions to fit")
    began = time.perf_counter()
    users, items, losses = fit(log)
    stats = {"retriever": kind, "num_interactions": size["n"], "num_users": size["u"] + 1, "num_items": size["i"] + 1, "loss_history": [float(x) for x in losses], "fit_seconds": time.perf_counter() - began}
    return RetrievalModel(kind, users, items, retrieval.seen_pairs(log), stats)


def lightgcn_model(log: DataFrame, **settings) -> RetrievalModel:
    """LightGCN of a graph that fits the driver, where it is trained; its losses are kept."""

    def fit(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[float]]:
        spark = rows.sparkSession
        pairs = retrieval.graph_pairs(rows)
        users, items, losses = retrieval.lightgcn_fit(pairs, int(pairs[:, 0].max()) + 1, int(pairs[:, 1].max()) + 1, **settings)
        return retrieval.vector_frame(spark, users, "user_id"), retrieval.vector_frame(spark, items, "item_id"), losses

    return fit_model(log, "lightgcn", fit)


def model_fit(kind: str) -> Callable[..., RetrievalModel]:
    """The fit of a kind of model."""
    if kind not in FITS:
        raise ValueError(f"no such retriever: {kind}; there are {', '.join(sorted(FITS))}")
    return FITS[kind]


def als_model(log: DataFrame, **settings) -> RetrievalModel:
    """Implicit ALS; it reports no losses."""
    return fit_model(log, "als", lambda rows: (*retrieval.als_factors(rows, **settings), []))


FITS = {"als": als_model, "lightgcn": lightgcn_model}
