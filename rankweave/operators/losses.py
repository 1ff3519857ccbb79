"""Ranking losses and label checks over (request_id, position, score, relevance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


#: Parts in which a request's groups meet its other groups.
PAIR_PARTS = 16


def lambda_rank_loss(scored: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Mean over pairs of different relevance of |change of NDCG by a swap| * softplus(-sigma * score difference).

    Ranks and the ideal come from windows over the request. Rows of equal score and relevance are one group, and only groups meet: a higher score has the
    smaller ranks throughout, so a group's discounts enter by their number and sum; between equal scores they are running sums in the order of ranks. Work grows with the rows
    and with the square of a request's distinct (score, relevance); a request without equal scores has all its pairs, in parts and without being held.
    """
    w = Window.partitionBy("request_id")
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    rows = scored.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "position"))).withColumn("i", F.row_number().over(w.orderBy(F.desc("relevance"), "position")))
    rows = rows.select("request_id", F.col("score").alias("s"), F.col("relevance").alias("y"), gain.alias("g"), "r", (1 / F.log2(F.col("r") + 1.0)).alias("d"), (gain / F.log2(F.col("i") + 1.0)).alias("best"))
    groups = rows.groupBy("request_id", "s", "y").agg(F.first("g").alias("g"), F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"), F.sum("best").alias("best"))
    each = lambda df, x: df.select("request_id", *(F.col(c).alias(f"{c}{x}") for c in ("s", "y", "g", "n", "d")), "part")
    a = each(groups.withColumn("part", F.pmod(F.hash("s", "y"), F.lit(PAIR_PARTS))), "a")
    b = each(groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PAIR_PARTS - 1)))), "b")
    apart = F.abs(F.col("db") * F.col("na") - F.col("da") * F.col("nb")) * (F.col("ga") - F.col("gb")) * softplus(-sigma * (F.col("sa") - F.col("sb")))
    far = a.join(b, ["request_id", "part"]).where((F.col("ya") > F.col("yb")) & ~F.col("sa").eqNullSafe(F.col("sb"))).select("request_id", apart.alias("l"), (F.col("na") * F.col("nb")).alias("n"))
    # of equal scores: the rows before a row, by relevance
    tie = Window.partitionBy("request_id", "s")
    levels = groups.withColumn("k", F.count(F.lit(1)).over(tie)).where("k > 1 AND y IS NOT NULL").select("request_id", F.col("s").alias("_s"), F.col("y").alias("level"), F.col("g").alias("glevel"))
    tied = rows.join(levels, (rows["request_id"] == levels["request_id"]) & rows["s"].eqNullSafe(levels["_s"])).drop(levels["request_id"])
    own = F.col("y") == F.col("level")
    before = Window.partitionBy("request_id", "s", "level").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumns({"n": F.count(F.when(own, 1)).over(before), "before": F.coalesce(F.sum(F.when(own, F.col("d"))).over(before), F.lit(0.0))})
    near = tied.where((F.col("y") != F.col("level")) & (F.col("n") > 0)).select("request_id", (F.abs(F.col("g") - F.col("glevel")) * (F.col("before") - F.col("n") * F.col("d")) * softplus(-sigma * (F.col("s") - F.col("s")))).alias("l"), "n")
    pairs = far.unionAll(near).groupBy("request_id").agg(F.sum("l").alias("l"), F.sum("n").alias("n"), F.count_if(F.col("l").isNull()).alias("lost"))
    out = groups.groupBy("request_id").agg(F.sum("best").alias("ideal")).join(pairs, "request_id", "left")
    return out.select("request_id", F.when(F.col("lost") > 0, F.lit(None)).when(F.col("n") > 0, F.col("l") / F.col("ideal") / F.col("n")).otherwise(0.0).alias("loss"))


def softmax_rows(runs: DataFrame, temperature: float = 1.0) -> DataFrame:
    """log-probabilities of a list's scores, stable."""
    w = Window.partitionBy("user_id", "permutation_index")
    s = F.col("score") / max(float(temperature), 1e-6)
    top = F.max(s).over(w)
    return runs.select("user_id", "permutation_index", "item_id", (s - top - F.ln(F.sum(F.exp(s - top)).over(w))).alias("lp"))


def permutation_loss(runs: DataFrame, mode: str = "kl", temperature: float = 1.0) -> DataFrame:
    """Mean divergence of a user's other lists from the first: KL(first || other), or Jeffreys', on items that all of them have; one list: 0.

    Lists that share fewer than two items can't be compared: the loss of their user is null.
    """
    if mode not in ("kl", "jeffreys"):
        raise ValueError(f"no such divergence: {mode}")
    user, item, one = Window.partitionBy("user_id"), Window.partitionBy("user_id", "item_id"), Window.partitionBy("user_id", "permutation_index")
    kinds = lambda w: F.size(F.collect_set("permutation_index").over(w))
    # all groups hold the user, so that one shuffle of the lists by user serves every window and sum, and the lists are read once
    rows = runs.select("user_id", "permutation_index", "item_id", (F.col("score") / max(float(temperature), 1e-6)).alias("s")).withColumns({"m": kinds(user), "first": F.min("permutation_index").over(user), "_in": kinds(item)})
    rows = rows.withColumn("s", F.when(F.col("_in") == F.col("m"), F.col("s"))).withColumn("top", F.max("s").over(one))
    is_first = (F.col("_in") == F.col("m")) & (F.col("permutation_index") == F.col("first"))
    is_other = (F.col("_in") == F.col("m")) & (F.col("permutation_index") != F.col("first"))
    lp = F.col("s") - F.col("top") - F.ln(F.sum(F.exp(F.col("s") - F.col("top"))).over(one))
    rows = rows.withColumns({"lp": lp, "shared": F.count(F.when(is_first, 1)).over(user)})
    others = F.collect_list(F.when(is_other, F.struct("permutation_index", F.col("lp").alias("b")))).alias("others")
    items = rows.groupBy("user_id", "item_id").agg(F.max("m").alias("m"), F.max("shared").alias("shared"), F.collect_list(F.when(is_first, F.col("lp"))).alias("base"), others)

    def divergence(a: Column, b: Column) -> Column:
        return F.exp(a) * (a - b) if mode == "kl" else (F.exp(a) - F.exp(b)) * (a - b)  # Jeffreys': both directions of KL, added

    pairs = items.select("user_id", "m", "shared", "base", F.explode_outer("others").alias("o")).select("user_id", "m", "shared", F.col("o.permutation_index").alias("p"), F.when(F.col("o").isNotNull(), F.aggregate("base", F.lit(0.0), lambda t, a: t + divergence(a, F.col("o.b")))).alias("d"))
    per = pairs.groupBy("user_id", "p").agg(F.max("m").alias("m"), F.max("shared").alias("shared"), F.sum("d").alias("d"))
    out = per.groupBy("user_id").agg(F.max("m").alias("m"), F.max("shared").alias("shared"), F.avg("d").alias("loss"))
    few = (F.col("m") > 1) & (F.col("shared") < 2)
    return out.select("user_id", F.when(~few, F.coalesce("loss", F.lit(0.0))).alias("loss"))


def label_violations(samples: DataFrame) -> DataFrame:
    """Rules that labels break, with how many rows do: a label is there and a whole number from 0."""
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), bad.alias("bad")) for name, bad in {"missing": F.col("relevance").isNull(), "negative": F.coalesce(F.col("relevance") < 0, F.lit(False)), "fraction": F.coalesce(F.col("relevance") != F.floor("relevance"), F.lit(False))}.items()]))
    return samples.select(rules.alias("r")).groupBy("r.rule").agg(F.count_if("r.bad").alias("violations"))


def result_violations(runs: DataFrame) -> DataFrame:
    """Lists whose output isn't a permutation of the input: an item twice, or ranks with gaps."""
    per = runs.groupBy("user_id", "permutation_index").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"), F.countDistinct("output_rank").alias("ranks"), F.max("output_rank").alias("top"))
    return per.agg(F.count(F.lit(1)).alias("lists"), F.count_if(F.col("items") < F.col("n")).alias("duplicate_items"), F.count_if((F.col("ranks") < F.col("n")) | (F.col("top") != F.col("n") - 1)).alias("broken_ranks"))
