"""Candidate and result records: ids and titles by falling keys, result rows for export, metadata of several rankings as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.parsing import listed_ids

# The keys that name a candidate or its title, the first that is there counts; and what stands for no title.
ID_KEYS = ["item_id", "id", "asin", "movie_id"]
TITLE_KEYS = ["title", "name", "main_category", "item_id"]
NO_TITLE = "unknown item"
#: Metadata that rankings share if all of them say the same.
SHARED_KEYS = ["output_backend", "prompt_family", "prompt_version", "scoring", "prompt"]


def candidate_id(columns: list[str], place: Column) -> Column:
    """The first id column that has a value (a null falls through to the next one), or the candidate's place."""
    return F.coalesce(*[F.col(c).cast("string") for c in ID_KEYS if c in columns], place.cast("string"))


def candidate_title(columns: list[str]) -> Column:
    """The first of the title's columns that isn't null or blank."""
    said = [F.col(c).cast("string") for c in TITLE_KEYS if c in columns]
    return F.coalesce(*[F.when(F.regexp_replace(s, r"\s", "") != "", s) for s in said], F.lit(NO_TITLE))


def item_fields(items: DataFrame, place: Column) -> DataFrame:
    """(item_id, title, year, rating, genres) under one name each, from columns that data sets name differently."""
    first = lambda *names: next((F.col(c) for c in names if c in items.columns), F.lit(None))
    return items.select(
        candidate_id(items.columns, place).alias("item_id"),
        first("title", "name").cast("string").alias("title"),
        first("year", "release_year").alias("year"),
        first("rating").alias("rating"),
        first("genres", "categories").alias("genres"),
    )


def export_result(said: DataFrame, valid: DataFrame, scores: DataFrame, keys: list[str], errors: DataFrame | None = None) -> DataFrame:
    """A row for each list: what was given, what came out after repair, what was wrong with it, and the scores by item.

    said, valid: (keys, pos, item_id); scores: (keys, item_id, score); errors: (keys, pos, parse_error), joined by "; ".
    """
    both = listed_ids(valid, keys, "ok").join(listed_ids(said, keys, "said"), keys, "left").withColumn("said", F.coalesce("said", F.array().cast("array<string>")))
    once = F.array_distinct("said")
    invalid, missing = F.array_except(once, "ok"), F.array_except("ok", "said")
    again = F.filter("said", lambda x, i: F.array_position("said", x) != i + 1)
    table = scores.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("item_id").cast("string"), F.col("score").cast("double"))))).alias("scores"))
    out = both.join(table, keys, "left")
    if errors is None:
        out = out.withColumn("parse_error", F.lit(None).cast("string"))
    else:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "parse_error"))), lambda x: x["parse_error"]), "; ")
        out = out.join(errors.where(F.col("parse_error").isNotNull()).groupBy(*keys).agg(joined.alias("parse_error")), keys, "left")
    return out.select(
        *keys,
        F.col("ok").alias("input_candidate_item_ids"),
        F.concat(F.array_intersect(once, "ok"), missing).alias("reranked_item_ids"),
        invalid.alias("invalid_item_ids"),
        again.alias("duplicate_item_ids"),
        missing.alias("missing_candidate_item_ids"),
        F.size(invalid).alias("num_invalid_item_ids"),
        F.size(again).alias("num_duplicate_item_ids"),
        F.size(missing).alias("num_missing_candidate_item_ids"),
        "parse_error",
        "scores",
    )


def combined_metadata(rankings: DataFrame, keys: list[str], order: str = "permutation_index") -> DataFrame:
    """Metadata of several rankings, a row for each request: values that all share, lists in order, and sums.

    Rows may lack any of the columns; null values count for nothing.
    """
    there = set(rankings.columns)
    col = lambda c, kind: (F.col(c) if c in there else F.lit(None)).cast(kind)
    in_order = lambda c, kind: F.transform(F.array_sort(F.collect_list(F.when(col(c, kind).isNotNull(), F.struct(F.col(order).alias("o"), col(c, kind).alias("v"))))), lambda x: x["v"])
    shared = [F.when(F.min(col(c, "string")) == F.max(col(c, "string")), F.min(col(c, "string"))).alias(c) for c in SHARED_KEYS]
    errors = F.when(col("parse_error", "string") != "", col("parse_error", "string"))
    return rankings.groupBy(*keys).agg(
        *shared,
        in_order("raw_output", "string").alias("raw_outputs"),
        in_order("parse_status", "string").alias("parse_statuses"),
        F.transform(F.array_sort(F.collect_list(F.when(errors.isNotNull(), F.struct(F.col(order).alias("o"), errors.alias("v"))))), lambda x: x["v"]).alias("parse_errors"),
        F.count_if(F.coalesce(col("repaired", "boolean"), F.lit(False))).alias("repaired_outputs"),
        F.coalesce(F.sum(col("generated_tokens", "long")), F.lit(0)).alias("generated_tokens"),
        F.coalesce(F.sum(col("latency_seconds", "double")), F.lit(0.0)).alias("latency_seconds"),
    )


def candidate_item_ids(candidates: Column) -> Column:
    """Ids of a map from ranks, written as texts, to candidates (structs with item_id), in the order of the ranks as numbers."""
    entries = F.transform(F.map_entries(candidates), lambda e: F.struct(e["key"].cast("int").alias("rank"), e["value"]["item_id"].cast("string").alias("id")))
    return F.transform(F.array_sort(entries), lambda e: e["id"])


def with_metadata(metadata: Column, **more: Column) -> Column:
    """A VARIANT object with more keys, which replace its own of the same name; a null one is empty."""
    own = F.coalesce(F.try_variant_get(metadata, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    new = F.create_map(*[x for k, v in more.items() for x in (F.lit(k), v.cast("variant"))])
    return F.to_variant_object(F.map_concat(F.map_filter(own, lambda k, _: ~k.isin(*more)), new))


def rebased(items: Column, permutation: Column) -> Column:
    """Ranked items (structs with candidate_index and input_position) with their places in another input order; one that it doesn't show has a null place."""
    place = lambda x: F.array_position(permutation, x["candidate_index"]).cast("int")
    return F.transform(items, lambda x: x.withField("input_position", F.when(place(x) > 0, place(x) - 1)))
