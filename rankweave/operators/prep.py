"""Preparation of rating logs: eligibility, dense ids, positives, statistics, item metadata, histories, splits."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible_users(log: DataFrame, min_interactions: int) -> DataFrame:
    """Rows of users with at least so many rows, whatever their ratings. One shuffle by user, which splits and histories use again."""
    return log.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).where(F.col("_n") >= min_interactions).drop("_n")


def stored_once(df: DataFrame) -> DataFrame:
    """A checkpoint in spark.checkpoint.dir, which a cluster names; on one machine, where none is set, a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set; it names a folder that driver and executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="rankweave-"))
    return df.checkpoint()


def id_mapping(log: DataFrame, raw: str, name: str) -> DataFrame:
    """(raw, id): 0-based over the sorted distinct raw ids, numbered in parallel: a range sort, then offsets of its partitions. Eager: the sorted ids are stored."""
    spark = log.sparkSession
    # read twice, for the numbers inside a partition and for the partitions' sizes; stored, as a range sort made again may cut elsewhere
    ids = stored_once(log.select(F.col(raw).alias("raw")).where(F.col(raw).isNotNull()).distinct().orderBy("raw").withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["n"] for r in ids.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    offset, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, offset))
        offset += sizes[p]
    offsets = spark.createDataFrame(rows, "_p int, _o long")
    inner = F.row_number().over(Window.partitionBy("_p").orderBy("raw"))
    return ids.join(F.broadcast(offsets), "_p").select("raw", (inner - 1 + F.col("_o")).alias(name))


def numbered(rows: DataFrame, *order: Column, name: str) -> DataFrame:
    """rows with their place from 0 in an order, numbered in parallel as id_mapping does. Eager: the sorted rows are stored."""
    spark = rows.sparkSession
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # a row's number in its partition
    rows = stored_once(rows.orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_i": inside}))
    sizes = {r["_p"]: r["n"] for r in rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    offset, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, offset))
        offset += sizes[p]
    return rows.join(F.broadcast(spark.createDataFrame(offsets, "_p int, _o long")), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def positives(log: DataFrame, min_rating: float) -> DataFrame:
    return log.where(F.col("rating") >= min_rating)


def dataset_stats(log: DataFrame, min_rating: float) -> DataFrame:
    """One row of counters in a single pass."""
    return log.agg(
        F.count(F.lit(1)).alias("num_interactions"),
        F.count_if(F.col("rating") >= min_rating).alias("num_positive_interactions"),
        F.countDistinct("user_id").alias("num_users"),
        F.countDistinct("item_id").alias("num_items"),
    )


def release_year(title: Column) -> Column:
    return F.regexp_extract(title, r"\((\d{4})\)\s*$", 1).try_cast("int")


def clean_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\s*\(\d{4}\)\s*$", ""))


def movie_items(items: DataFrame) -> DataFrame:
    genres = F.when(F.col("genres") == "(no genres listed)", "").otherwise(F.col("genres"))
    return items.select("item_id", "raw_item_id", clean_title(F.col("raw_title")).alias("title"), genres.alias("genres"), release_year(F.col("raw_title")).alias("release_year"))


def movie_metadata(movies: DataFrame, mapping: DataFrame) -> DataFrame:
    """(item_id, raw_item_id, title, genres, release_year) of the movies (movieId, title, genres) that a mapping (raw, id) knows."""
    if missing := [c for c in ("movieId", "title", "genres") if c not in movies.columns]:
        raise ValueError(f"missing columns: {missing}")
    known = mapping.select(F.col("raw").cast("string").alias("raw_item_id"), F.col("id").alias("item_id"))
    rows = movies.select(F.col("movieId").cast("string").alias("raw_item_id"), F.col("title").alias("raw_title"), "genres")
    return movie_items(rows.join(known, "raw_item_id"))


def clean_number(value: Column) -> Column:
    """$ and thousands' commas off; blank or no number: null."""
    return F.regexp_replace(F.trim(value), r"[$,]", "").try_cast("double")


def json_list(value: Column, is_list: bool = True) -> Column:
    """Text of a JSON list without nulls; null: []. A scalar (is_list=False) is a list of one."""
    if not is_list:
        value = F.array(value)
    return F.coalesce(F.to_json(F.filter(value, lambda x: x.isNotNull())), F.lit("[]"))


def genre_list(genres: Column) -> Column:
    return F.filter(F.split(genres, r"\|"), lambda x: x != "")


def leave_one_out(log: DataFrame, min_interactions: int, ties: list[str]) -> DataFrame:
    """Last row of a user is test, the one before val, the rest train."""
    w = Window.partitionBy("user_id")
    r = F.row_number().over(w.orderBy(F.desc("ts"), F.desc("item_id"), *[F.desc(c) for c in ties]))
    out = log.select("*", F.count(F.lit(1)).over(w).alias("_n"), r.alias("_r")).where(F.col("_n") >= min_interactions)
    return out.withColumn("split", F.when(F.col("_r") == 1, "test").when(F.col("_r") == 2, "val").otherwise("train")).drop("_n", "_r")


def temporal_split(log: DataFrame, train: float, val: float, min_interactions: int, ties: list[str]) -> DataFrame:
    """Per user by time: a share for train, one for val, the rest test; no segment is empty. Both shares are positive and leave something."""
    if not (train > 0 and val > 0 and train + val < 1):
        raise ValueError(f"the shares {train} and {val} are positive and less than 1 together")
    w = Window.partitionBy("user_id")
    out = log.select("*", F.count(F.lit(1)).over(w).alias("_n"), (F.row_number().over(w.orderBy("ts", "item_id", *ties)) - 1).alias("_r")).where(F.col("_n") >= max(3, min_interactions))
    share = lambda x: F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(x))).cast("int"))
    end = F.when(share(train) + share(val) >= F.col("_n"), F.greatest(F.lit(1), F.col("_n") - share(val) - 1)).otherwise(share(train))
    return out.withColumn("split", F.when(F.col("_r") < end, "train").when(F.col("_r") < end + share(val), "val").otherwise("test")).drop("_n", "_r")


def split_interactions(log: DataFrame, strategy: str, min_interactions: int, ties: list[str], train: float = 0.7, val: float = 0.1) -> DataFrame:
    """The split that a data set's settings name."""
    if strategy == "leave_one_out":
        return leave_one_out(log, min_interactions, ties)
    if strategy in ("temporal_ratio", "temporal_70_10_20"):
        return temporal_split(log, train, val, min_interactions, ties)
    raise ValueError(f"no such split: {strategy}")


def train_queries(train: DataFrame, ties: list[str]) -> DataFrame:
    """`role`: a user's last training row is the query if there are two or more, the rest the retriever's training."""
    w = Window.partitionBy("user_id")
    last = F.row_number().over(w.orderBy(F.desc("ts"), F.desc("item_id"), *[F.desc(c) for c in ties])) == 1
    return train.withColumn("role", F.when(last & (F.count(F.lit(1)).over(w) >= 2), "train_queries").otherwise("retriever_train"))


def context_of(split: str, rows: DataFrame) -> DataFrame:
    """Rows that a split's histories come from: train -> retriever_train, val -> train, test -> train and val."""
    if split == "train":
        return rows.where(F.col("role") == "retriever_train") if "role" in rows.columns else rows.where(F.col("split") == "train")
    return rows.where(F.col("split").isin(["train"] if split == "val" else ["train", "val"]))


def history(rows: DataFrame, top: int, ties: list[str]) -> DataFrame:
    """Each user's newest rows with their place from 1; the rank filter is a group limit before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "item_id", *ties)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def history_items(hist: DataFrame, items: DataFrame) -> DataFrame:
    """A user's history as an array of items, newest first; items without metadata keep their id."""
    rows = hist.join(items, "item_id", "left")
    item = F.struct("place", F.col("item_id").cast("string").alias("item_id"), "title", "rating")
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("history"))


def seen_items(log: DataFrame) -> DataFrame:
    return log.select("user_id", "item_id").distinct()


def user_item_matrix(log: DataFrame, value: str | None = None) -> DataFrame:
    """COO form; repeated entries are summed, each being 1 or the value column."""
    each = F.count(F.lit(1)) if value is None else F.sum(F.col(value))
    return log.groupBy("user_id", "item_id").agg(each.cast("double").alias("value"))


def mapped_log(log: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """The log with dense user_id and item_id; its own ids become raw_user_id and raw_item_id. Mappings are (raw, id)."""
    named = log.withColumnsRenamed({"user_id": "raw_user_id", "item_id": "raw_item_id"})
    out = named.join(users.select(F.col("raw").alias("raw_user_id"), F.col("id").alias("user_id")), "raw_user_id")
    return out.join(items.select(F.col("raw").alias("raw_item_id"), F.col("id").alias("item_id")), "raw_item_id")


def full_stats(split: DataFrame, min_rating: float, ties: list[str]) -> DataFrame:
    """One row of the nine counters of a prepared data set. split: eligible rows with their `split`; rows of no split count too."""
    last = F.row_number().over(Window.partitionBy("user_id", "split").orderBy(F.desc("ts"), F.desc("item_id"), *[F.desc(c) for c in ties])) == 1
    query = (F.col("split") == "train") & last & (F.count(F.lit(1)).over(Window.partitionBy("user_id", "split")) >= 2)
    rows = split.select("user_id", "item_id", "rating", "split", F.coalesce(query, F.lit(False)).alias("_q"))
    of = lambda s: F.count_if(F.col("split") == s)
    return rows.agg(
        F.count(F.lit(1)).alias("num_interactions"),
        F.count_if(F.col("rating") >= min_rating).alias("num_positive_interactions"),
        of("train").alias("num_train"),
        F.count_if((F.col("split") == "train") & ~F.col("_q")).alias("num_retriever_train"),
        F.count_if("_q").alias("num_train_queries"),
        of("val").alias("num_val"),
        of("test").alias("num_test"),
        F.countDistinct("user_id").alias("num_users"),
        F.countDistinct("item_id").alias("num_items"),
    )


def amazon_items(metadata: DataFrame, mapping: DataFrame) -> DataFrame:
    """Items of the mapping (raw, id) with their cleaned metadata; lists are JSON texts."""
    text = lambda c: F.col(c).cast("string")
    number = lambda c: clean_number(F.col(c).cast("string"))
    rows = metadata.join(mapping.select(F.col("raw").alias("parent_asin"), F.col("id").alias("item_id")), "parent_asin")
    return rows.select(
        "item_id",
        F.col("parent_asin").alias("raw_item_id"),
        text("title").alias("title"),
        text("main_category").alias("main_category"),
        json_list(F.col("categories")).alias("categories"),
        text("store").alias("brand_or_store"),
        json_list(F.col("description")).alias("description"),
        json_list(F.col("features")).alias("features"),
        number("price").alias("price"),
        number("average_rating").alias("average_rating"),
        number("rating_number").alias("rating_number"),
    )
