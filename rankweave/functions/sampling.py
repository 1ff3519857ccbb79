"""Seeded choices of users as DataFrames. Python's generator draws places, not ids, so no id comes to the driver."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators import prep


def _placed(users: DataFrame, places: list[tuple[int, int]]) -> DataFrame:
    """(user_id, place) of the users that stand at some places in rising order of ids; places: (at, place)."""
    numbered = prep.id_mapping(users, "user_id", "_at").withColumnRenamed("raw", "user_id")
    return numbered.join(users.sparkSession.createDataFrame(places, "_at long, place long"), "_at").select("user_id", "place")


def select_users(users: DataFrame, max_users: int | None = None, sample: bool = False, seed: int = 42) -> DataFrame:
    """(user_id): all, or so many: a seeded sample, or the first ones in rising order. max_users places are drawn on the driver."""
    ids = users.select("user_id").distinct()
    if max_users is None:
        return ids
    if max_users < 1:
        raise ValueError("max_users is positive")
    if not sample:
        return ids.orderBy("user_id").limit(max_users)
    n = ids.count()
    if max_users >= n:
        return ids
    return _placed(ids, [(at, at) for at in random.Random(seed).sample(range(n), max_users)]).select("user_id")


def order_users(users: DataFrame, sample: bool = False, seed: int = 42, keyed: bool = False) -> DataFrame:
    """(user_id, place) in rising order, or in a seeded one.

    A seeded order follows Python's generator, which draws one number a user on the driver: for users that fit there. A keyed one, by a digest of seed and
    id, is made by the tasks alone, for any number of users.
    """
    ids = users.select("user_id").distinct()
    if not sample:
        return prep.id_mapping(ids, "user_id", "place").withColumnRenamed("raw", "user_id")
    if keyed:
        key = F.md5(F.concat(F.lit(f"{seed}|"), F.col("user_id").cast("string")))
        return prep.numbered(ids.withColumn("_key", key), F.col("_key"), F.col("user_id"), name="place").select("user_id", "place")
    places = list(range(ids.count()))
    random.Random(seed).shuffle(places)
    return _placed(ids, [(at, place) for place, at in enumerate(places)])
