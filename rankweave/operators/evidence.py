"""Evidence records: what a model saw and said of one sample, as nested rows of one declared schema, written and read as JSON lines.

Records are built inside the row from a sample's arrays, so nothing is shuffled. Scores beyond a list's permutation, or places beyond its scores, don't count; ties
keep the order shown. What a sample says beyond the schema travels in `extra`, a VARIANT, and stands beside the other keys in the written record.

Defined cases: without candidate ids the places are the ids; a place without an id has a null one; a permutation without relevance has an empty list of it; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERMUTATION = "struct<permutation_index: int, input: struct<candidate_indices: array<int>, item_ids: array<string>, relevance: array<int>>, scores: array<double>, output_ranking: struct<candidate_indices: array<int>, item_ids: array<string>, scores: array<double>>>"
RECORD = f"sample_index long, user_id string, split string, list_length int, num_items int, history variant, candidates variant, permutations array<{PERMUTATION}>"
KEYS = ["sample_index", "user_id", "split", "list_length", "num_items", "history", "candidates", "permutations"]
RANKED = "array<struct<candidate_index: int, candidate_id: string, input_position: int, score: double, relevance: int>>"


def _falling(rows: Column) -> Column:
    """Structs by falling score, equal ones by their place."""
    return F.array_sort(rows, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["at"] - b["at"]))


def _shown(permutation: Column, scores: Column, ids: Column) -> Column:
    """(at, index, id, score) of the places that have a score."""
    n = F.least(F.size(permutation), F.size(scores))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.get(permutation, i).cast("int").alias("index"), F.get(ids, F.get(permutation, i)).alias("id"), F.get(scores, i).cast("double").alias("score")))


def _candidate_ids(samples: DataFrame) -> Column:
    n = F.coalesce(F.size("candidates"), F.lit(0))
    places = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size("candidate_ids") > 0, F.col("candidate_ids").cast("array<string>")).otherwise(places) if "candidate_ids" in samples.columns else places


def _with_ids(samples: DataFrame) -> DataFrame:
    """samples with `_ids`. An exploded array of one keeps the ids from being made anew for each place that looks at them."""
    return samples.select("*", F.explode(F.array(_candidate_ids(samples))).alias("_ids"))


def rank_records(samples: DataFrame) -> DataFrame:
    """Records of samples (sample_index, user_id, split, history, candidates, candidate_ids, runs array<struct<permutation, scores, relevance>>, and more).

    list_length and num_items are the samples' own, else the number of candidates; further columns go to `extra`.
    """
    has = set(samples.columns)
    n = F.coalesce(F.size("candidates"), F.lit(0))
    own = lambda c, other: F.coalesce(F.col(c), other) if c in has else other

    # steps, so that places and their order are made once a list and not for each field
    def shown(run: Column) -> Column:
        return F.struct(_shown(run["permutation"], run["scores"], F.col("_ids")).alias("shown"), run["relevance"].cast("array<int>").alias("relevance"))

    def ordered(run: Column) -> Column:
        return F.struct(run["shown"].alias("shown"), run["relevance"].alias("relevance"), _falling(run["shown"]).alias("ranked"))

    def one(run: Column, i: Column) -> Column:
        of = lambda rows, c: F.transform(rows, lambda x: x[c])
        relevance = F.coalesce(F.slice(run["relevance"], F.lit(1), F.size(run["shown"])), F.array().cast("array<int>"))
        return F.struct(
            i.cast("int").alias("permutation_index"),
            F.struct(of(run["shown"], "index").alias("candidate_indices"), of(run["shown"], "id").alias("item_ids"), relevance.alias("relevance")).alias("input"),
            of(run["shown"], "score").alias("scores"),
            F.struct(of(run["ranked"], "index").alias("candidate_indices"), of(run["ranked"], "id").alias("item_ids"), of(run["ranked"], "score").alias("scores")).alias("output_ranking"),
        )

    rest = [c for c in samples.columns if c not in (*KEYS, "candidate_ids", "runs")]
    rows = _with_ids(samples)
    return rows.select(
        own("sample_index", F.lit(-1)).cast("long").alias("sample_index"),
        F.col("user_id").cast("string").alias("user_id"),
        (F.col("split") if "split" in has else F.lit(None)).cast("string").alias("split"),
        own("list_length", n).cast("int").alias("list_length"),
        own("num_items", n).cast("int").alias("num_items"),
        F.to_variant_object(F.col("history")).alias("history"),
        F.to_variant_object(F.col("candidates")).alias("candidates"),
        F.transform(F.transform(F.transform("runs", shown), ordered), one).cast(f"array<{PERMUTATION}>").alias("permutations"),
        (F.to_variant_object(F.struct(*rest)) if rest else F.lit(None).cast("variant")).alias("extra"),
    )


def permutation_rank_records(samples: DataFrame) -> DataFrame:
    """(sample_index, user_id, permutation_index, permutation, ranking): a row for each run of a sample, its candidates by falling score."""
    rows = _with_ids(samples).select("sample_index", F.col("user_id").cast("string").alias("user_id"), "_ids", F.posexplode("runs").alias("permutation_index", "run"))
    shown = _falling(_shown(F.col("run.permutation"), F.col("run.scores"), F.col("_ids")))
    item = lambda x: F.struct(x["index"].alias("candidate_index"), x["id"].alias("candidate_id"), x["at"].alias("input_position"), x["score"].alias("score"), F.get("run.relevance", x["at"]).cast("int").alias("relevance"))
    return rows.select("sample_index", "user_id", "permutation_index", F.col("run.permutation").cast("array<int>").alias("permutation"), F.transform(shown, item).cast(RANKED).alias("ranking"))


def as_json(records: DataFrame) -> DataFrame:
    """(value): each record as one JSON object, what stands in `extra` beside its other keys, which win."""
    fields = {c: F.col(c) if kind == "variant" else F.to_variant_object(F.col(c)) if kind.startswith(("array", "struct", "map")) else F.col(c).cast("variant") for c, kind in records.dtypes if c != "extra"}
    own = F.create_map(*[x for c, v in fields.items() for x in (F.lit(c), v)])
    if "extra" in records.columns:
        more = F.coalesce(F.try_variant_get("extra", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
        more = F.map_filter(more, lambda k, _: ~k.isin(*fields))
        own = F.map_concat(more, own)
    return records.select(F.to_json(F.to_variant_object(own)).alias("value"))


def write_records(records: DataFrame, path: str) -> None:
    as_json(records).write.mode("overwrite").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records as written: the declared columns, and all other keys in `extra` (null where there are none)."""
    return parse_records(spark.read.text(path))


def parse_records(lines: DataFrame) -> DataFrame:
    """Records of JSON lines (value)."""
    raw = lines.select(F.explode(F.array(F.parse_json("value"))).alias("_r"))  # a filter on a column doesn't go below it, where each line would be made and parsed anew
    kinds = [x.strip() for x in RECORD.split(", ", 7)]
    names = [k.split(" ", 1) for k in kinds]
    every = F.variant_get("_r", "$", "map<string,variant>")
    rest = F.map_filter(every, lambda k, _: ~k.isin(*KEYS))
    return raw.select(*(F.variant_get("_r", f"$.{c}", kind).alias(c) for c, kind in names), F.get(F.transform(F.array(rest), lambda m: F.when(F.size(m) > 0, F.to_variant_object(m))), F.lit(0)).alias("extra"))


def sample_dicts(samples: DataFrame) -> DataFrame:
    """Ranking samples (user_id, history, candidates, split, metadata) as JSON objects: the metadata's keys beside the others, which win; a null split is left out."""
    kept = [F.struct("user_id", "history", "candidates"), F.struct("user_id", "history", "candidates", "split")]
    both = [F.variant_get(F.to_variant_object(s), "$", "map<string,variant>") for s in kept]
    own = F.when(F.col("split").isNull(), both[0]).otherwise(both[1])
    more = F.coalesce(F.try_variant_get("metadata", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    more = F.map_filter(more, lambda k, _: ~F.map_contains_key(own, k))
    return samples.select(F.to_json(F.to_variant_object(F.map_concat(more, own))).alias("value"))


def result_dicts(results: DataFrame) -> DataFrame:
    """Ranking results (user_id, split, permutation, items array<struct<candidate_index, item_id, score, input_position, relevance, candidate>>, metadata) as JSON objects, nulls kept."""
    order = F.struct("user_id", "split", "permutation", "items", "metadata")
    return results.select(F.to_json(order, {"ignoreNullFields": "false"}).alias("value"))


def result_violations(results: DataFrame) -> DataFrame:
    """(user_id, problem) of results whose items are not the permutation's candidates, each once."""
    indices, n = F.transform("items", lambda x: x["candidate_index"]), F.size("permutation")
    problem = (
        F.when(F.size(F.array_distinct("permutation")) < n, "the permutation repeats a candidate")
        .when(F.size(F.array_distinct(indices)) < F.size(indices), "the items repeat a candidate")
        .when((F.size(indices) != n) | (F.size(F.array_except(indices, F.col("permutation"))) > 0), "the items are not the permutation's candidates")
    )
    return results.select("user_id", problem.alias("problem")).where(F.col("problem").isNotNull())
