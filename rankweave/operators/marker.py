"""Marker spans over token rows (request_id, pos, kind, mask): spans, positions, masks and mean log-probabilities.

Each request's tokens become one array; what follows is arithmetic inside the row, after a single shuffle by request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spans(tokens: DataFrame) -> DataFrame:
    """(request_id, n, span_start, span_end, items): half-open token spans of the prompt and of each item.

    An item goes from a start marker to the next end marker; one that a truncation left open is no item. A request without the
    prompt's markers, or without a whole item, is an error.
    """
    t = F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"])
    rows = tokens.groupBy("request_id").agg(t.alias("t")).select("request_id", "t", F.size("t").alias("n"))
    first = lambda kind: F.array_position("t", kind).cast("int")
    rows = rows.withColumns({"span_start": _needed(first("SPAN") > 0, first("SPAN") - 1, "prompt markers"), "span_end": _needed(first("/SPAN") > 0, first("/SPAN"), "prompt markers")})
    marks = F.filter(F.transform("t", lambda x, i: F.struct(x.alias("kind"), i.alias("at"))), lambda m: (m["at"] >= F.col("span_end")) & m["kind"].isin("ITEM", "/ITEM"))
    state = F.struct(F.lit(-1).alias("open"), F.array().cast("array<struct<s:int,e:int>>").alias("done"))
    step = lambda a, m: (
        F.when((m["kind"] == "ITEM") & (a["open"] < 0), F.struct(m["at"].alias("open"), a["done"].alias("done")))
        .when((m["kind"] == "/ITEM") & (a["open"] >= 0), F.struct(F.lit(-1).alias("open"), F.concat(a["done"], F.array(F.struct(a["open"].alias("s"), (m["at"] + 1).alias("e")))).alias("done")))
        .otherwise(a)
    )
    items = F.aggregate(marks, state, step)["done"]
    return rows.select("request_id", "n", "span_start", "span_end", items.alias("items")).withColumn("items", _needed(F.size("items") > 0, F.col("items"), "whole items"))


def _needed(there: Column, value: Column, what: str) -> Column:
    return F.when(there, value).otherwise(F.raise_error(F.lit(f"a request has no {what}; a truncation may have cut them")))


def span_rows(tokens: DataFrame) -> DataFrame:
    return spans(tokens).select("request_id", "span_start", "span_end", F.posexplode("items").alias("item", "x")).select("request_id", "span_start", "span_end", "item", F.col("x.s").alias("s"), F.col("x.e").alias("e"))


def _item_at(pos: Column) -> Column:
    """The item span that covers a position, or null."""
    return F.get(F.filter("items", lambda x: (x["s"] <= pos) & (pos < x["e"])), F.lit(0))


def shared_positions(tokens: DataFrame) -> DataFrame:
    """Position ids: the prompt from 0, every item from the prompt's length on, anything else 0."""
    rows = spans(tokens).select("request_id", "span_start", "span_end", "items", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    item = _item_at(F.col("pos"))
    inside = (F.col("pos") >= F.col("span_start")) & (F.col("pos") < F.col("span_end"))
    value = F.when(item.isNotNull(), F.col("span_end") - F.col("span_start") + F.col("pos") - item["s"]).when(inside, F.col("pos") - F.col("span_start")).otherwise(0)
    return rows.select("request_id", "pos", value.alias("position_id"))


def standard_positions(tokens: DataFrame) -> DataFrame:
    """Running count of tokens that aren't pads, less 1; pads 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("request_id").orderBy("pos")
    return tokens.select("request_id", "pos", F.when(F.col("mask") == 0, 0).otherwise(F.sum("mask").over(w) - 1).alias("position_id"))


def block_mask(tokens: DataFrame, span_causal: bool = True) -> DataFrame:
    """(request_id, q, k) of the allowed pairs of query and key; n^2 of one list's tokens, made inside its row."""
    m = F.transform(F.array_sort(F.collect_list(F.struct("pos", "mask"))), lambda x: x["mask"])
    rows = spans(tokens).join(tokens.groupBy("request_id").agg(m.alias("m")), "request_id")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("q"))
    rows = rows.select("*", _item_at(F.col("q")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    q, k = F.col("q"), F.col("k")
    in_span = lambda p: (p >= F.col("span_start")) & (p < F.col("span_end"))
    alive = lambda p: F.get("m", p) == 1
    own = (k >= F.col("x.s")) & (k < F.col("x.e")) & (k <= q)
    orphan = alive(q) & ((in_span(k) & (k <= q)) | (k == q))
    allowed = F.when(F.col("x").isNotNull(), in_span(k) | own).when(in_span(q), in_span(k) & ((k <= q) if span_causal else F.lit(True))).otherwise(orphan)
    return rows.where((allowed & alive(k)) | ((q == k) & ~alive(q))).select("request_id", "q", "k")


def causal_mask(tokens: DataFrame) -> DataFrame:
    """(request_id, q, k) of the allowed pairs: k isn't after q and isn't a pad."""
    m = F.transform(F.array_sort(F.collect_list(F.struct("pos", "mask"))), lambda x: x["mask"])
    rows = tokens.groupBy("request_id").agg(m.alias("m")).select("request_id", F.posexplode("m").alias("q", "_"), "m")
    rows = rows.select("request_id", "q", F.explode(F.sequence(F.lit(0), F.col("q"))).alias("k"), "m")
    return rows.where(F.get("m", F.col("k")) == 1).select("request_id", "q", "k")


def attention_mask(tokens: DataFrame, mode: str, span_causal: bool = True) -> DataFrame:
    if mode not in ("block", "causal"):
        raise ValueError(f"no such mask: {mode}")
    return block_mask(tokens, span_causal) if mode == "block" else causal_mask(tokens)


def position_ids(tokens: DataFrame, mode: str) -> DataFrame:
    if mode not in ("shared", "standard"):
        raise ValueError(f"no such positions: {mode}")
    return shared_positions(tokens) if mode == "shared" else standard_positions(tokens)


def span_mean_logprob(tokens: DataFrame) -> DataFrame:
    """Mean log-probability of each item's content tokens, the markers left out."""
    inner = span_rows(tokens).select("request_id", "item", "s", "e")
    rows = tokens.join(inner, "request_id").where((F.col("pos") > F.col("s")) & (F.col("pos") < F.col("e") - 1))
    return rows.groupBy("request_id", "item").agg(F.avg("logprob").alias("score"))


def candidate_count_violations(spans: DataFrame, expected: DataFrame) -> DataFrame:
    """(request_id, observed, expected) of requests whose prompt holds another number of whole candidate spans than it should; a truncation may have cut some off.

    spans: (request_id, item), a row for each whole candidate span; expected: (request_id, n).
    """
    seen = spans.groupBy("request_id").agg(F.count(F.lit(1)).alias("observed"))
    rows = expected.select("request_id", F.col("n").cast("long").alias("expected")).join(seen, "request_id", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    return rows.where(F.col("observed") != F.col("expected")).select("request_id", "observed", "expected")
