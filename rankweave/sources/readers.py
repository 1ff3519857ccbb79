"""Readers of raw rating logs and item metadata. Schemas are explicit; paths are asked of the file system that Spark uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ["user_id", "item_id", "rating", "timestamp"]
# The genre flags of the 100k format, in column order.
GENRE_FLAGS = ["unknown", "Action", "Adventure", "Animation", "Children", "Comedy", "Crime", "Documentary", "Drama", "Fantasy", "Film-Noir", "Horror", "Musical", "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western"]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_file(spark: SparkSession, directory: str, explicit: str | None, candidates: list[str]) -> str:
    """The explicit file, or the first candidate that is there."""
    for name in [explicit] if explicit else candidates:
        path = name if explicit and ("://" in name or name.startswith("/")) else f"{directory.rstrip('/')}/{name}"
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {[explicit] if explicit else candidates} in {directory}")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Ids stay text, so none loses a leading zero."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    require(df, REQUIRED)
    return df.withColumns({"user_id": F.col("user_id").cast("string"), "item_id": F.col("item_id").cast("string"), "rating": F.col("rating").cast("double"), "timestamp": F.col("timestamp").cast("long")})


def read_amazon_reviews(spark: SparkSession, directory: str, reviews_file: str | None = None) -> DataFrame:
    """Reviews with all four values. A file in which no row has one of the keys lacks that column: an error, unless the file is empty."""
    path = first_file(spark, directory, reviews_file, ["reviews.jsonl", "reviews.jsonl.gz"])
    df = spark.read.schema("user_id string, parent_asin string, rating double, timestamp long").json(path)
    known = df.dropna()
    if known.isEmpty():
        n = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in df.columns]).first()
        if missing := [c for c in df.columns if n["_n"] and not n[c]]:
            raise ValueError(f"missing columns: {missing}")
    return known.withColumnRenamed("parent_asin", "item_id").select(*REQUIRED)


def read_amazon_metadata(spark: SparkSession, directory: str, metadata_file: str | None = None) -> DataFrame:
    path = first_file(spark, directory, metadata_file, ["metadata.jsonl", "metadata.jsonl.gz", "meta.jsonl", "meta.jsonl.gz"])
    schema = "parent_asin string, title string, main_category string, categories array<string>, store string, description array<string>, features array<string>, price string, average_rating double, rating_number long"
    df = spark.read.schema(schema).json(path)
    known = df.where(F.col("parent_asin").isNotNull())
    if known.isEmpty() and not df.isEmpty():
        raise ValueError("missing columns: ['parent_asin']")
    return known


def read_movielens_ratings(spark: SparkSession, directory: str) -> DataFrame:
    """The first of ratings.csv (by the names of its header, whatever their order), ratings.dat (::) and u.data (tabs)."""
    path = first_file(spark, directory, None, ["ratings.csv", "ratings.dat", "u.data"])
    if path.endswith(".csv"):
        raw = spark.read.option("header", True).csv(path)  # the header is read; no type is guessed
        names = {"userId": "user_id", "movieId": "item_id"}
        df = require(raw.withColumnsRenamed(names), REQUIRED)
        kinds = {"user_id": "long", "item_id": "long", "rating": "double", "timestamp": "long"}
        return df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in REQUIRED])
    reader = spark.read.schema("user_id long, item_id long, rating double, timestamp long")
    return reader.option("sep", "::" if path.endswith(".dat") else "\t").csv(path)


def read_movielens_movies(spark: SparkSession, directory: str) -> DataFrame:
    """(movieId, title, genres joined by |); no file: no rows."""
    try:
        path = first_file(spark, directory, None, ["movies.csv", "movies.dat", "u.item"])
    except FileNotFoundError:
        return spark.createDataFrame([], "movieId long, title string, genres string")
    if path.endswith(".csv"):
        return spark.read.schema("movieId long, title string, genres string").option("header", True).option("escape", '"').csv(path)
    if path.endswith(".dat"):
        return spark.read.schema("movieId long, title string, genres string").option("sep", "::").option("encoding", "ISO-8859-1").csv(path)
    flags = ", ".join(f"g{i} int" for i in range(len(GENRE_FLAGS)))
    df = spark.read.schema(f"movieId long, title string, release_date string, video_release_date string, imdb_url string, {flags}").option("sep", "|").option("encoding", "ISO-8859-1").csv(path)
    genres = F.concat_ws("|", *[F.when(F.col(f"g{i}") == 1, F.lit(g)) for i, g in enumerate(GENRE_FLAGS)])
    return df.select("movieId", "title", genres.alias("genres"))
