"""Item metadata: cells that hold JSON become values, and items as they are shown to a reader or a model.

Metadata tables have text cells that are lists or objects written as JSON. Each cell becomes a VARIANT: a text that looks like a JSON list or object
and is one is that list or object; one that looks like it and isn't stays the text it is; NaN is null; all else keeps its value. Typed columns are drawn from
it with typed(), so a column may hold lists in some rows and plain text in others.

Defined cases: a missing table is one without items; a null or blank cell stays null or blank; an item id that repeats keeps its rows; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructType, VariantType

from rankweave.sources.readers import exists

#: Columns of an item table in CSV that aren't text.
NUMBERS = {"item_id": "long", "release_year": "int", "price": "double", "average_rating": "double", "rating_number": "double"}
WHITE = r"\s"


def cell(value: Column, kind: DataType) -> Column:
    """A VARIANT of one cell."""
    if isinstance(kind, VariantType):
        return value
    if isinstance(kind, StringType):
        bare = F.regexp_replace(value, rf"^{WHITE}+|{WHITE}+$", "")
        looks = (bare.startswith("[") & bare.endswith("]")) | (bare.startswith("{") & bare.endswith("}"))
        return F.when(looks, F.coalesce(F.try_parse_json(value), value.cast("variant"))).otherwise(value.cast("variant"))
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(value), value.cast("variant"))
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.to_variant_object(value)
    return value.cast("variant")


def is_list(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def typed(value: Column, kind: str) -> Column:
    """A VARIANT as a type; null where it isn't one. Text is drawn from texts only, never from a list's JSON."""
    drawn = F.try_variant_get(value, "$", kind)
    return F.when(is_text(value), drawn) if kind == "string" else drawn


def clean_items(items: DataFrame) -> DataFrame:
    """item_id, and every other column as a VARIANT."""
    return items.select(F.col("item_id").cast("long").alias("item_id"), *(cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in items.schema if f.name != "item_id"))


def load_item_metadata(spark: SparkSession, directory: str) -> DataFrame:
    """The cleaned items of a prepared data set: its table of items, or items.csv; without either no rows."""
    base = directory.rstrip("/")
    for name in ("items", "items.parquet"):
        if exists(spark, f"{base}/{name}"):
            return clean_items(spark.read.parquet(f"{base}/{name}"))
    if not exists(spark, f"{base}/items.csv"):
        return spark.createDataFrame([], "item_id long")
    raw = spark.read.options(header=True, escape='"', multiLine=True).csv(f"{base}/items.csv")
    return clean_items(raw.withColumns({c: F.col(c).try_cast(kind) for c, kind in NUMBERS.items() if c in raw.columns}))


def display_id(item_id: Column, raw: Column | None) -> Column:
    """The raw id that the metadata gives, else the internal one, as text."""
    own = item_id.cast("string")
    return own if raw is None else F.coalesce(F.try_variant_get(raw, "$", "string"), own)


def display_items(cleaned: DataFrame) -> DataFrame:
    """Items as they are shown: (internal_id, item_id, others...), item_id being the raw id where there is one; genres written with | become a list."""
    has = cleaned.columns
    out = [F.col("item_id").alias("internal_id"), display_id(F.col("item_id"), F.col("raw_item_id") if "raw_item_id" in has else None).alias("item_id")]
    for c in has:
        if c in ("item_id", "raw_item_id"):
            continue
        value = F.col(f"`{c}`")
        if c == "genres":
            parts = F.filter(F.split(F.try_variant_get(value, "$", "string"), r"\|"), lambda x: x != "")
            value = F.when(is_text(value), F.to_variant_object(parts)).otherwise(value)
        out.append(value.alias(c))
    return cleaned.select(*out)


def display_candidates(candidates: DataFrame, cleaned: DataFrame) -> DataFrame:
    """candidates (user_id, rank, item_id) with their display records; one that no metadata knows keeps its internal id."""
    shown = display_items(cleaned)
    rows = candidates.withColumnRenamed("item_id", "internal_id").withColumn("internal_id", F.col("internal_id").cast("long"))
    out = rows.join(shown, "internal_id", "left")
    return out.withColumn("item_id", F.coalesce("item_id", F.col("internal_id").cast("string")))


def display_truth(truth: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(user_id, ground_truth_item_ids) as display ids, in the order of internal ids."""
    raw = F.col("raw_item_id") if "raw_item_id" in cleaned.columns else None
    known = cleaned.select(F.col("item_id"), display_id(F.col("item_id"), raw).alias("_shown"))
    rows = truth.select("user_id", F.col("item_id").cast("long").alias("item_id")).join(known, "item_id", "left")
    listed = F.array_sort(F.collect_list(F.struct("item_id", F.coalesce("_shown", F.col("item_id").cast("string")).alias("s"))))
    return rows.groupBy("user_id").agg(F.transform(listed, lambda x: x["s"]).alias("ground_truth_item_ids"))
