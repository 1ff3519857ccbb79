"""The reranking run: requests shown in given orders, scored by a plug-in in batches, as rows of the long layout; and its contracts."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.scoring import checked
from rankweave.operators import aggregate, records
from rankweave.operators.permutations import STRIDE

#: A batch scorer takes (user, shown items) of several lists and gives the scores of each.
BatchScorer = Callable[[Sequence[tuple[str, list[str]]]], Sequence[Sequence[float]]]
RUN = "permutation_index int, item_id string, input_position int, output_rank int, score double"


def in_batches(scorer: Callable[[str, Sequence[str]], Sequence[float]]) -> BatchScorer:
    """A batch scorer of one that takes a list at a time."""
    return lambda lists: [scorer(user, shown) for user, shown in lists]


def rank_many(scorer: BatchScorer, lists: Sequence[tuple[str, list[str]]], batch_size: int = 32) -> list[list[float]]:
    """Scores of every list, asked for `batch_size` lists at a time; a batch gives one row of finite scores for each list."""
    if batch_size < 1:
        raise ValueError("batch_size is positive")
    out: list[list[float]] = []
    for i in range(0, len(lists), batch_size):
        part = lists[i : i + batch_size]
        rows = list(scorer(part))
        if len(rows) != len(part):
            raise ValueError(f"{len(part)} lists, {len(rows)} rows of scores")
        out += [checked(s, len(shown)) for s, (_, shown) in zip(rows, part, strict=True)]
    return out


METHODS = {"bootstrapping": aggregate.bootstrapping, "greedy_selection": aggregate.greedy_selection, "stella": aggregate.stella}


def _check_method(method: str, n_calibrated: int | None) -> None:
    if method != "zero_shot" and method not in METHODS:
        raise ValueError(f"no such method: {method}; there are {', '.join(sorted([*METHODS, 'zero_shot']))}")
    if (method == "stella") != (n_calibrated is not None):
        raise ValueError("a calibrator goes with the method stella, and only with it")


def run_reranking(requests: DataFrame, scorer: BatchScorer, method: str = "zero_shot", calibrator: aggregate.Calibrator | None = None, split: str | None = None, seed: int = 42, batch_size: int = 32, **options) -> DataFrame:
    """requests (user_id, permutation_index, items in the order shown) to the long layout, a row for each item.

    zero_shot: one scoring of the order as shown, the lists of an Arrow batch scored `batch_size` at a time; equal scores keep that
    order; `score` is the scorer's own. The other methods score orders of their own and give n - rank. Each list stands in one row, so nothing
    is shuffled, and a lost task repeats only its lists. An empty or null list has no rows; ids come back as text, user_id in its type.
    """
    _check_method(method, None if calibrator is None else len(calibrator.matrix))

    def zero_shot(lists: list[tuple[str, list[str]]]) -> list[list[tuple[str, int, float]]]:
        out = []
        for (_, shown), scores in zip(lists, rank_many(scorer, lists, batch_size), strict=True):
            order = sorted(range(len(shown)), key=lambda c: -scores[c])
            out.append([(shown[c], c, scores[c]) for c in order])
        return out

    def by_rounds(lists: list[tuple[str, list[str]]]) -> list[list[tuple[str, int, float]]]:
        one = lambda user, shown: rank_many(scorer, [(user, list(shown))], batch_size)[0]
        out = []
        for user, shown in lists:
            outer = list(range(len(shown)))
            if calibrator is not None and len(calibrator.matrix) != len(shown):
                raise ValueError(f"the matrix is of {len(calibrator.matrix)} candidates, the list of {len(shown)}")
            how = partial(METHODS[method], one, calibrator) if calibrator is not None else partial(METHODS[method], one)
            order = how(user, shown, outer, aggregate.request_seed(seed, user, split, shown, outer), **options)
            out.append([(shown[c], c, float(len(shown) - r)) for r, c in enumerate(order)])
        return out

    work = zero_shot if method == "zero_shot" else by_rounds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = work([(u, [str(i) for i in items]) for u, items in zip(b["user_id"].tolist(), b["items"].tolist(), strict=True)])
            rows = [(u, p, item, at, r, s) for u, p, ranks in zip(b["_user"].tolist(), b["permutation_index"].tolist(), found, strict=True) for r, (item, at, s) in enumerate(ranks)]
            if rows:
                yield pd.DataFrame(rows, columns=["user_id", "permutation_index", "item_id", "input_position", "output_rank", "score"])

    kind = dict(requests.dtypes)["user_id"]
    text = F.col("user_id").cast("string")
    # ids travel as text: pandas makes floats of whole numbers beside a null
    rows = requests.where(F.size("items") > 0).select(text.alias("_user"), F.coalesce(text, F.lit("")).alias("user_id"), "permutation_index", F.col("items").cast("array<string>").alias("items"))
    out = rows.mapInPandas(run, f"user_id string, {RUN}")
    return out.withColumn("user_id", F.col("user_id").cast(kind))


def rank_requests(samples: DataFrame, permutations: DataFrame | None = None) -> DataFrame:
    """(request_id, user_id, items, permutation, shown): requests with the order their items are shown in, which is the items' own where none is given.

    samples: (request_id, user_id, items), and `permutation` where a request brings its own; permutations: (request_id, permutation) for requests that don't.
    Both at once, or not one permutation for each request, is an error, and so is an order that doesn't name each place once: the error comes from the row.
    """
    if permutations is not None:
        if "permutation" in samples.columns:
            raise ValueError("requests with their own permutations take no others")
        n, m, both = samples.count(), permutations.count(), samples.join(permutations, "request_id").count()
        if not n == m == both:
            raise ValueError(f"{n} requests, {m} permutations, of which {both} belong together")
        samples = samples.join(permutations, "request_id")
    elif "permutation" not in samples.columns:
        samples = samples.withColumn("permutation", F.lit(None).cast("array<int>"))
    same = F.when(F.size("items") > 0, F.sequence(F.lit(0), F.size("items") - 1)).otherwise(F.array().cast("array<int>"))
    given = F.coalesce(F.col("permutation").cast("array<int>"), same)
    sound = F.sort_array(given) == same
    order = F.when(sound, given).otherwise(F.raise_error(F.concat(F.lit("the order of request "), F.col("request_id").cast("string"), F.lit(" doesn't name each place once"))).cast("array<int>"))
    return samples.select("request_id", "user_id", "items", order.alias("permutation")).withColumn("shown", F.transform("permutation", lambda i: F.get("items", i)))


def request_violations(requests: DataFrame) -> DataFrame:
    """(rule, violations): how many of requests (user_id, items, titles, permutation) break each rule of a request.

    A request has items, none twice and none null or empty; a title for each, none blank; and an order that names each place once. Null arrays
    count as empty.
    """
    some = lambda c: F.coalesce(F.col(c), F.array())
    n = F.size(some("items"))
    rules: dict[str, Column] = {
        "no_candidates": n == 0,
        "repeated_items": F.size(F.array_distinct(some("items"))) < n,
        "missing_ids": F.exists(some("items"), lambda x: x.isNull() | (x.cast("string") == "")),
        "blank_titles": (F.size(some("titles")) != n) | F.exists(some("titles"), lambda x: x.isNull() | (F.btrim(x) == "")),
        "broken_order": ~F.sort_array(some("permutation").cast("array<int>")).eqNullSafe(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))),
    }
    broken = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), bad.alias("bad")) for name, bad in rules.items()])).alias("r")
    return requests.select(broken).groupBy("r.rule").agg(F.count_if("r.bad").alias("violations"))


def training_samples(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(user_id, items, relevance): a row for each user with a relevant candidate, in the order of rank; labels are 0 or 1."""
    t = truth.select("user_id", F.col("item_id").cast("string").alias("item_id")).distinct().withColumn("_hit", F.lit(1))
    rows = candidates.withColumn("item_id", F.col("item_id").cast("string")).join(t, ["user_id", "item_id"], "left")
    e = F.array_sort(F.collect_list(F.struct("rank", "item_id", F.coalesce("_hit", F.lit(0)).alias("y"))))
    lists = rows.groupBy("user_id").agg(e.alias("e"), F.max("_hit").alias("any")).where(F.col("any").isNotNull())
    return lists.select("user_id", F.transform("e", lambda x: x["item_id"]).alias("items"), F.transform("e", lambda x: x["y"]).alias("relevance"))


def samples_from_artifact(lists: DataFrame, histories: DataFrame) -> DataFrame:
    """(user_id, history, candidates, split): training samples of candidate lists (user_id, candidates, ground_truth_item_ids, split) and histories (user_id, history).

    A candidate has a title (its name, category or id where it lacks one) and a relevance of 0 or 1; lists without a relevant candidate go. A user without
    a history has an empty one. None left is an error. Eager: it looks whether one is.
    """
    fields = lists.schema["candidates"].dataType.elementType.names
    true = F.coalesce("ground_truth_item_ids", F.array().cast("array<string>"))

    def shown(c: Column) -> Column:
        said = [F.when(F.btrim(c[k].cast("string")) != "", c[k].cast("string")) for k in records.TITLE_KEYS if k in fields]
        relevant = F.array_contains(true, c["item_id"].cast("string")).cast("int")
        return c.withField("title", F.coalesce(*said, F.lit(records.NO_TITLE))).withField("relevance", F.coalesce(relevant, F.lit(0)))

    rows = lists.withColumn("candidates", F.transform("candidates", shown)).where(F.exists("candidates", lambda c: c["relevance"] > 0))
    if rows.isEmpty():
        raise ValueError("no list holds a relevant candidate: there is nothing to train on")
    none = F.array().cast(dict(histories.dtypes)["history"])
    out = rows.join(histories.select("user_id", "history"), "user_id", "left")
    return out.select(F.col("user_id").cast("string").alias("user_id"), F.coalesce("history", none).alias("history"), "candidates", "split")


def training_orders(samples: DataFrame, count: int, deterministic: bool = True) -> DataFrame:
    """samples (sample_index, items, relevance) to `count` orders each: (sample_index, permutation_index, permutation, items, relevance).

    Deterministic orders are seeded by the sample's and the order's index, so a task that runs again gives the same; the others are drawn
    anew at each run.
    """
    if count < 1:
        raise ValueError("there is one order at least")
    seeds = F.when(F.lit(deterministic), F.col("sample_index").cast("long") * STRIDE + F.col("permutation_index"))
    rows = samples.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("permutation_index"))

    def order(n: int, seed: int | None) -> list[int]:
        out = list(range(n))
        random.Random(seed).shuffle(out)
        return out

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            drawn = [order(n, int(s) if s is not None else None) for n, s in zip(b["_n"].tolist(), b["_seed"].tolist(), strict=True)]
            yield b.assign(permutation=drawn).drop(columns=["_n", "_seed"])

    asked = rows.select("sample_index", "permutation_index", "items", "relevance", F.size("items").alias("_n"), seeds.cast("string").alias("_seed"))
    kinds = dict(samples.dtypes)
    out = asked.mapInPandas(draw, f"sample_index {kinds['sample_index']}, permutation_index int, items {kinds['items']}, relevance {kinds['relevance']}, permutation array<int>")
    shown = lambda c: F.transform("permutation", lambda i: F.get(c, i))
    return out.select("sample_index", "permutation_index", "permutation", shown("items").alias("items"), shown("relevance").alias("relevance"))
