"""Reports over a run's results: effectiveness with the record's own list as a fallback, the evaluation row, position bias, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions import sampling
from rankweave.operators import metrics, prep, retrieval

#: What the short evaluation row shows of each family.
SHORT_PARSER = ["num_parse_errors", "parse_error_rate", "num_parser_repair_attempts", "parser_repair_attempt_rate"]
SHORT_PREFERENCE = ["num_users_with_preference_consistency", "preference_buckets", "minimum_bucket_observations", "ppi", "gpi"]
SHORT_ROBUSTNESS = ["mean_rank", "rank_variance", "rank_std", "mean_tau", "mean_rho", "jaccard", "overlap", "same_top"]


def result_lists(users: DataFrame) -> DataFrame:
    """users (user_id, reranked_item_ids, permutations) to (user_id, permutation_index, output_rank, item_id).

    A record's permutations count, each a list; one without any counts by its own list, whose permutation_index is null. An empty or null
    list keeps one row, without an item, so that it is a miss and not absent.
    """
    own = F.struct(F.lit(None).cast("int").alias("permutation_index"), F.col("reranked_item_ids").cast("array<string>").alias("ids"))
    several = F.transform("permutations", lambda p: F.struct(p["permutation_index"].cast("int").alias("permutation_index"), p["reranked_item_ids"].cast("array<string>").alias("ids")))
    lists = F.when(F.coalesce(F.size("permutations"), F.lit(0)) > 0, several).otherwise(F.array(own))
    rows = users.select("user_id", F.explode(lists).alias("l"))
    return rows.select("user_id", "l.permutation_index", F.posexplode_outer("l.ids").alias("output_rank", "item_id"))


def evaluation(runs: DataFrame, truth: DataFrame, k: int, outputs: DataFrame | None = None, full: bool = False, n_buckets: int = 3, min_observations: int = 1, preference: bool = True) -> DataFrame:
    """One row: counts, effectiveness, parser quality (of `outputs`, if given), preference consistency (unless it isn't asked for) and robustness; short or in full.

    Eager: runs and truth, which every family reads, are stored before.
    """
    if k < 1:
        raise ValueError("k is positive")
    runs, truth = prep.stored_once(runs), prep.stored_once(truth)
    pick = lambda df, names: df if full else df.select(*names)
    out = runs.agg(F.countDistinct("user_id").alias("num_users")).withColumn("k", F.lit(k))
    parts = [metrics.effectiveness(runs, truth, k)]
    if outputs is not None:
        parts.append(pick(metrics.parser_quality(outputs), SHORT_PARSER))
    if preference:
        consistency = metrics.preference_consistency(runs, n_buckets, min_observations).withColumnRenamed("num_users", "num_users_with_preference_consistency")
        parts.append(pick(consistency, SHORT_PREFERENCE))
    parts.append(pick(metrics.robustness_macro(runs, truth, k), SHORT_ROBUSTNESS))
    for part in parts:  # each has one row
        out = out.crossJoin(part)
    return out


def metric_lines(row: DataFrame) -> DataFrame:
    """(place, line): a report's one row as `name: value` lines, floating numbers with six digits; arrays and nested values are left out."""
    flat = [(f.name, f.dataType.simpleString()) for f in row.schema if not f.dataType.simpleString().startswith(("array", "map", "struct", "variant"))]
    text = lambda c, kind: F.format_string("%.6f", F.col(c).cast("double")) if kind in ("double", "float") else F.col(c).cast("string")
    lines = [F.struct(F.lit(i).alias("place"), F.concat(F.lit(f"{c}: "), F.coalesce(F.when(F.col(c).isNotNull(), text(c, kind)), F.lit("none"))).alias("line")) for i, (c, kind) in enumerate(flat)]
    return row.select(F.explode(F.array(*lines)).alias("l")).select("l.*")


def position_bias(runs: DataFrame, k: int = 5) -> DataFrame:
    """One row: by input position the exposure among the k first, what chance gives and the difference; their summary; users and lists.

    Lists whose output holds other items than the input take no part; without any list the arrays are empty and the summary is null.
    """
    if k < 1:
        raise ValueError("k is positive")
    rows = metrics.valid_lists(runs)
    by_place = metrics.exposure(rows, k)
    in_order = F.array_sort(F.collect_list(F.struct("input_position", "exposure", "expected", "deviation")))
    each = by_place.agg(in_order.alias("_p"), F.avg(F.abs("deviation")).alias("mean_abs_deviation"), F.max(F.abs("deviation")).alias("max_abs_deviation"))
    counts = rows.agg(F.countDistinct("user_id", F.coalesce("permutation_index", F.lit(-1))).alias("num_lists"), F.count(F.lit(1)).alias("num_observations"))
    users = runs.agg(F.countDistinct("user_id").alias("num_users"))
    arrays = [F.col(f"_p.{c}").alias(c) for c in ("input_position", "exposure", "expected", "deviation")]
    return each.crossJoin(counts).crossJoin(users).select(F.lit(k).alias("k"), "num_users", "num_lists", "num_observations", *arrays, "mean_abs_deviation", "max_abs_deviation")


def export_users(ranked: DataFrame, truth: DataFrame, max_users: int | None = None, sample: bool = False, seed: int = 42, truth_only: bool = False, batch: int = 256) -> tuple[DataFrame, DataFrame]:
    """The users whose candidates are exported, and a row on how they were chosen.

    Users are those with truth. truth_only: the first ones, in rising or seeded order, whose candidates hold a true item, scanned in batches;
    else as many as asked for, whatever their candidates.
    """
    all_users = truth.select("user_id").distinct()
    if truth_only:
        found = retrieval.truth_scan(ranked, truth, sampling.order_users(all_users, sample, seed), max_users, batch)
        users = found.select("user_id")
        scanned = found.agg(F.coalesce(F.max("scanned_users"), F.lit(0)).alias("num_users_scanned"))
    else:
        users = sampling.select_users(all_users, max_users, sample, seed)
        scanned = users.agg(F.count(F.lit(1)).alias("num_users_scanned"))
    header = all_users.agg(F.count(F.lit(1)).alias("num_users_available")).crossJoin(users.agg(F.count(F.lit(1)).alias("num_users_selected"))).crossJoin(scanned)
    mode = "ground_truth_in_candidates" if truth_only else "selected_then_optional_filter"
    return users, header.withColumns({"max_users": F.lit(max_users).cast("long"), "sample_users": F.lit(sample), "user_sample_seed": F.lit(seed), "selection_mode": F.lit(mode)})
