"""Parsing, repair and audit of generated rankings."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The forms in which an answer holds its object, between fences or from the first brace to the last.
FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.IGNORECASE | re.DOTALL)
#: One object of one list of strings without escapes.
PLAIN = r'^\s*\{\s*"rank_order"\s*:\s*\[\s*("[^"\\\x00-\x1f]*"\s*(,\s*"[^"\\\x00-\x1f]*"\s*)*)?\]\s*\}\s*$'
BRACES = re.compile(r"\{.*\}", re.DOTALL)


def json_object(text: str | None) -> dict | None:
    """The first that is a JSON object of: the whole text, fenced blocks, the widest braces."""
    if text is None:
        return None
    tries = [text.strip(), *(m.strip() for m in FENCED.findall(text)), *(m.group(0) for m in BRACES.finditer(text))]
    for t in tries:
        try:
            found = json.loads(t)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def rank_order(text: Column) -> Column:
    """array<string> of a generated text's `rank_order`; null where there is none.

    Answers of the plain form {"rank_order": ["a", "b"]} are read in the JVM; only the texts of others go to Python.
    """
    plain = text.rlike(PLAIN)

    @F.pandas_udf("array<string>")
    def tolerant(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            labels = (json_object(t) or {}).get("rank_order")
            out.append([str(x).strip() for x in labels] if isinstance(labels, list) else None)
        return pd.Series(out, dtype=object)

    read = F.transform(F.from_json(text, "rank_order array<string>")["rank_order"], lambda x: F.trim(x))
    return F.when(plain, read).otherwise(tolerant(F.when(plain, None).otherwise(text)))


def listed_ids(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, array of item ids by pos)."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("item_id").cast("string").alias("item_id")))), lambda x: x["item_id"]).alias(name))


def validate_ranking(listed: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """listed (keys, pos, item_id) against valid (keys, pos, item_id): a row for each list.

    A second mention counts as duplicate, before it is asked whether it is valid; what is missing follows in its input order.
    """
    out = listed_ids(valid, keys, "ok").join(listed_ids(listed, keys, "said"), keys, "left").withColumn("said", F.coalesce("said", F.array().cast("array<string>")))
    once = F.array_distinct("said")
    kept = F.array_intersect(once, "ok")
    missing = F.array_except("ok", "said")
    return out.select(
        *keys,
        F.concat(kept, missing).alias("reranked_item_ids"),
        F.size(F.array_except(once, "ok")).alias("num_invalid"),
        (F.size("said") - F.size(once)).alias("num_duplicate"),
        F.size(missing).alias("num_missing"),
    )


def classify_labels(labels: DataFrame, expected: DataFrame, keys: list[str], required: int | None = None) -> DataFrame:
    """A row for each label said: valid, duplicate, or unknown (not expected, or over the required count)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    e = expected.select(*keys, "label", (F.lit(required) if required else n).alias("need"))
    rows = labels.join(e, [*keys, "label"], "left")
    first = F.row_number().over(Window.partitionBy(*keys, "label").orderBy("pos")) == 1
    rows = rows.withColumn("_first", first & F.col("need").isNotNull())
    so_far = F.sum(F.col("_first").cast("int")).over(Window.partitionBy(*keys).orderBy("pos"))
    rows = rows.withColumn("_n", so_far)
    kind = F.when(F.col("need").isNull(), "unknown").when(F.col("_first") & (F.col("_n") <= F.col("need")), "valid").when(F.col("_first"), "unknown")
    # a mention after one that came too late is late itself, a mention after a valid one is a duplicate
    head = F.min(F.when(F.col("_first"), F.col("_n"))).over(Window.partitionBy(*keys, "label"))
    kind = kind.when(head <= F.col("need"), "duplicate").otherwise("unknown")
    return rows.select(*keys, "pos", "label", kind.alias("kind"))


def parse_status(classified: DataFrame, expected: DataFrame, keys: list[str], required: int | None = None, failed: DataFrame | None = None) -> DataFrame:
    """Counts and status of each answer: valid, repaired, or failed (its keys are in `failed`: no list could be read).

    `required` valid labels are enough, all if not given; labels are missing only where the valid ones are fewer.
    """
    need = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    c = classified.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(f"num_{k}") for k in ("valid", "duplicate", "unknown")])
    lost = (failed.select(*keys).distinct() if failed is not None else need.select(*keys).limit(0)).withColumn("_lost", F.lit(True))
    out = need.join(c, keys, "left").join(lost, keys, "left").withColumn("_lost", F.coalesce("_lost", F.lit(False)))
    out = out.withColumns({f"num_{k}": F.when(F.col("_lost"), 0).otherwise(F.coalesce(f"num_{k}", F.lit(0))) for k in ("valid", "duplicate", "unknown")})
    short = F.col("num_valid") != (F.lit(required) if required else F.col("n"))
    bad = (F.col("num_duplicate") > 0) | (F.col("num_unknown") > 0) | short
    status = F.when(F.col("_lost"), "failed").when(bad, "repaired").otherwise("valid")
    return out.select(*keys, "num_valid", "num_duplicate", "num_unknown", F.when(short, F.col("n") - F.col("num_valid")).otherwise(0).alias("num_missing"), status.alias("parse_status"))
