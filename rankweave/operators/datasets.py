"""Preparing a data set: from raw ratings and metadata to eight tables, two mappings and statistics, committed together.

Every table is a plan over the raw log; what several of them read (the mapped rows with their split) is stored once before. Defined cases: users with
too few rows go before anything is numbered; a user too short for the split is in the interactions and in no split; items without metadata have no row
in `items`; rows with a null id are left out of the mappings, and so of everything.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators import prep
from rankweave.sources import readers, store

SPLITS = ("train", "val", "test")
TABLES = ("interactions", "train", "retriever_train", "train_queries", "val", "test", "items", "users", "user_mapping", "item_mapping")
ROW = ["user_id", "item_id", "rating", "timestamp"]


def prepare(log: DataFrame, items_of: Callable[[DataFrame], DataFrame] | None = None, min_rating: float = 4.0, min_interactions: int = 3, strategy: str = "temporal_ratio", train: float = 0.7, val: float = 0.1) -> tuple[dict[str, DataFrame], dict]:
    """The tables of TABLES and the statistics of a raw log (user_id, item_id, rating, timestamp). items_of: the item mapping (raw, id) to normalised metadata.

    Eager: mappings and the split are stored.
    """
    readers.require(log, ROW)
    kept = prep.eligible_users(log.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull()), min_interactions)
    kept = prep.stored_once(kept.select(*ROW))
    users, items = (prep.id_mapping(kept, c, "id") for c in ("user_id", "item_id"))
    mapped = prep.mapped_log(kept, users, items).select("user_id", "item_id", "rating", "timestamp", "raw_user_id", "raw_item_id")
    mapped = prep.stored_once(mapped)
    parts = prep.stored_once(prep.split_interactions(mapped.withColumnRenamed("timestamp", "ts"), strategy, min_interactions, ["rating"], train, val).withColumnRenamed("ts", "timestamp"))
    of = lambda s: parts.where(F.col("split") == s).drop("split")
    roles = prep.stored_once(prep.train_queries(of("train").withColumnRenamed("timestamp", "ts"), ["rating"]).withColumnRenamed("ts", "timestamp"))
    named = items.select(F.col("raw"), F.col("id"))
    meta = items_of(named) if items_of is not None else log.sparkSession.createDataFrame([], "item_id long, raw_item_id string")
    tables = {
        "interactions": mapped,
        "train": of("train"),
        "retriever_train": roles.where(F.col("role") == "retriever_train").drop("role"),
        "train_queries": roles.where(F.col("role") == "train_queries").drop("role"),
        "val": of("val"),
        "test": of("test"),
        "items": meta,
        "users": users.select(F.col("id").alias("user_id"), F.col("raw").alias("raw_user_id")),
        "user_mapping": users,
        "item_mapping": items,
    }
    return tables, statistics(tables, min_rating)


def statistics(tables: Mapping[str, DataFrame], min_rating: float) -> dict:
    """The counters of a prepared data set; items_with_metadata where a title, or a main category, is known."""
    out = {"num_interactions": tables["interactions"].count(), "num_positive_interactions": tables["interactions"].where(F.col("rating") >= min_rating).count()}
    out |= {f"num_{name}": tables[name].count() for name in ("train", "retriever_train", "train_queries", "val", "test")}
    out |= {"num_users": tables["user_mapping"].count(), "num_items": tables["item_mapping"].count()}
    known = [F.col(c).isNotNull() for c in ("title", "main_category") if c in tables["items"].columns]
    return out | {"items_with_metadata": tables["items"].where(known[0] if len(known) == 1 else known[0] | known[1]).select("item_id").distinct().count() if known else 0}


def commit_dataset(root: str, tables: Mapping[str, DataFrame], stats: Mapping) -> int:
    """All tables and the statistics as one version; until it is whole, readers have the one before."""
    if missing := [t for t in TABLES if t not in tables]:
        raise ValueError(f"missing tables: {missing}")
    return store.commit(tables["interactions"].sparkSession, root, {t: tables[t] for t in TABLES}, {"stats": dict(stats)})


def load_dataset(spark: SparkSession, root: str, number: int | None = None) -> tuple[dict[str, DataFrame], dict]:
    """(tables, statistics) of the current version, or of a number."""
    tables, note = store.current(spark, root, number)
    return tables, note.get("stats", {})


def user_histories(tables: Mapping[str, DataFrame], split: str, top: int) -> DataFrame:
    """(user_id, history) of every user of the data set: its newest `top` items before the split with title, genres, year and rating; a user without any has an empty list."""
    if split not in SPLITS:
        raise ValueError(f"no such split: {split}; there are {', '.join(SPLITS)}")
    rows = {"train": ["retriever_train"], "val": ["train"], "test": ["train", "val"]}[split]
    context = tables[rows[0]] if len(rows) == 1 else tables[rows[0]].unionByName(tables[rows[1]])
    return history_lists(tables["users"].select("user_id"), context, tables["items"], top)


def history_lists(users: DataFrame, context: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """(user_id, history array<struct<item_id, title, genres, year, rating>>), newest first; every user of `users` has one, empty where the context has no row."""
    newest = prep.history(context.withColumnRenamed("timestamp", "ts"), top, ["rating"])
    has = items.columns
    col = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind)
    genres = prep.genre_list(F.col("genres")) if "genres" in has and dict(items.dtypes)["genres"] == "string" else col("genres", "array<string>")
    known = items.select("item_id", col("raw_item_id", "string").alias("_raw"), col("title", "string").alias("title"), genres.alias("genres"), col("release_year", "int").alias("year"))
    rows = newest.join(known, "item_id", "left")
    item = F.struct(F.coalesce("_raw", F.col("item_id").cast("string")).alias("item_id"), "title", "genres", "year", "rating")
    lists = rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))), lambda x: x["item"]).alias("history"))
    kind = dict(lists.dtypes)["history"]
    return users.select("user_id").distinct().join(lists, "user_id", "left").withColumn("history", F.coalesce("history", F.array().cast(kind)))
