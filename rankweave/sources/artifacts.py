"""Artifacts: processed tables as Parquet, candidate and reranking lists as JSON lines, small settings as JSON; and their paths."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Fields that are left out of written results unless asked for, and those that can be.
PROMPT_KEYS = ["prompt_text", "repair_prompt"]
RAW_KEYS = ["raw_response", "repair_raw_response", "raw_output", "raw_outputs"]


def write_processed(directory: str, splits: DataFrame, items: DataFrame | None = None, users: DataFrame | None = None) -> None:
    """The rated rows partitioned by split, so a reader of one split opens its files only; items and users beside them."""
    splits.write.mode("overwrite").partitionBy("split").parquet(f"{directory}/interactions")
    for name, df in (("items", items), ("users", users)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{directory}/{name}")


def candidate_artifact(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """A row a user: candidates by rank, and the true items."""
    item = F.struct(*[c for c in candidates.columns if c != "user_id"])
    lists = candidates.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("_c")).select("user_id", F.transform("_c", lambda x: x["item"]).alias("candidates"))
    true = truth.groupBy("user_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ground_truth_item_ids"))
    return lists.join(true, "user_id", "left").withColumn("ground_truth_item_ids", F.coalesce("ground_truth_item_ids", F.array().cast("array<string>")))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_candidates(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def runs_from_artifact(users: DataFrame) -> DataFrame:
    """users (user_id, permutations array<struct<permutation_index, input, output>>) to the long layout; scores are n - rank."""
    rows = users.select("user_id", F.explode("permutations").alias("p"))
    out = rows.select("user_id", F.col("p.permutation_index").alias("permutation_index"), F.col("p.input").alias("input"), F.posexplode("p.output").alias("output_rank", "item_id"), F.size("p.output").alias("n"))
    place = F.array_position("input", F.col("item_id")) - 1
    return out.select("user_id", "permutation_index", "item_id", F.when(place >= 0, place).cast("int").alias("input_position"), "output_rank", (F.col("n") - F.col("output_rank")).cast("double").alias("score"))


def _slim(c: Column, kind: DataType, gone: list[str]) -> Column:
    """A column without the struct fields, or keys of string maps, named in `gone`, at any depth."""
    if isinstance(kind, StructType):
        kept = [_slim(c[f.name], f.dataType, gone).alias(f.name) for f in kind if f.name not in gone]
        return F.when(c.isNotNull(), F.struct(*kept) if kept else F.struct())
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _slim(x, kind.elementType, gone))
    if isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        return F.transform_values(F.map_filter(c, lambda k, _: ~k.isin(*gone)), lambda _, v: _slim(v, kind.valueType, gone))
    return c


def without_fields(df: DataFrame, prompts: bool = False, raw: bool = True) -> DataFrame:
    """Result rows without prompt texts, or raw answers, unless they are asked for; columns and nested fields alike."""
    gone = ([] if prompts else PROMPT_KEYS) + ([] if raw else RAW_KEYS)
    return df.select(*(_slim(F.col(f"`{f.name}`"), f.dataType, gone).alias(f.name) for f in df.schema if f.name not in gone)) if gone else df


def candidate_path(directory: str, split: str, k: int, users: int | None = None, truth_only: bool = False) -> str:
    return f"{directory}/{split}_k{k}" + (f"_users{users}" if users else "") + ("_gt_only" if truth_only else "") + ".json"


def reranking_path(directory: str, reranker: str, scoring: str, architecture: str | None = None, permutations: int = 1, shuffled: bool = False) -> str:
    """shuffled: the order shown was permuted, though there was but one."""
    several = f"_perm{permutations}" if shuffled or permutations > 1 else ""
    return f"{directory}/{reranker}_{scoring}" + (f"_{architecture}" if architecture else "") + several + ".json"


def training_dir(directory: str, dataset: str, retriever: str, *parts: str) -> str:
    """Where a training run's files go."""
    return "/".join([directory.rstrip("/"), dataset, retriever, *parts])


def metrics_path(directory: str, stage: str, dataset: str, retriever: str, k: int, *sources: str) -> str:
    """Where a stage's figures go: retrieval, reranking or position_bias; sources name the candidates and the run, without their endings."""
    if stage not in ("retrieval", "reranking", "position_bias"):
        raise ValueError(f"no such stage: {stage}")
    return "/".join([directory, stage, dataset, retriever, *(Path(s).stem for s in sources), f"metrics_at_{k}.json"])


def read_settings(path: str) -> dict:
    """A JSON or YAML mapping."""
    text = Path(path).read_text(encoding="utf-8")
    if re.search(r"\.ya?ml$", path):
        import yaml

        out = yaml.safe_load(text)
    else:
        out = json.loads(text)
    if not isinstance(out, dict):
        raise ValueError(f"{path} doesn't hold a mapping")
    return out


def dataset_settings(config: dict, dataset: str) -> dict:
    """One data set's settings, from a file of many or of one."""
    many = config.get("datasets")
    if many is None:
        if config.get("name", dataset) != dataset:
            raise ValueError(f"the settings are of {config['name']}, not {dataset}")
        return config
    if dataset not in many:
        raise ValueError(f"no such data set: {dataset}; there are {sorted(many)}")
    return many[dataset]


def write_settings(data: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False), encoding="utf-8")
