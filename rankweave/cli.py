"""Command line for spark-submit: rankweave.cli COMMAND ..., from raw ratings to reports.

Data sets and models are versions of stores, candidates are JSON lines of one row a user, runs are Parquet in the long layout. A scorer is named
module:function; it takes a list of (user, shown items) and gives the scores of each.
"""

from __future__ import annotations

import argparse
import importlib
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import sampling
from rankweave.operators import calibration, datasets, metadata, metrics, models, permutations, prep, reports, reranking, retrieval
from rankweave.sources import artifacts, readers

CANDIDATES = "user_id long, retriever string, split string, candidates array<struct<rank: int, item_id: string, title: string>>, ground_truth_item_ids array<string>"


def _args(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="rankweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, **needed: str) -> argparse.ArgumentParser:
        a = sub.add_parser(name, help=text)
        for option, what in needed.items():
            a.add_argument(f"--{option.replace('_', '-')}", required=True, help=what)
        return a

    a = command("prepare", "raw ratings and metadata to a committed data set", raw="folder of raw files", data="store of the data set")
    a.add_argument("--format", choices=["movielens", "amazon"], required=True)
    a.add_argument("--min-rating", type=float, default=4.0)
    a.add_argument("--min-interactions", type=int, default=10)
    a.add_argument("--split", choices=["temporal_ratio", "leave_one_out"], default="temporal_ratio")
    a.add_argument("--train", type=float, default=0.7)
    a.add_argument("--val", type=float, default=0.1)
    a = command("train-retriever", "factors of users and items", data="store of the data set", model="store of the model")
    a.add_argument("--min-rating", type=float, default=4.0)
    a.add_argument("--kind", choices=sorted(models.FITS), default="als")
    a.add_argument("--factors", type=int, default=64)
    a.add_argument("--iterations", type=int, default=20, help="of als")
    a.add_argument("--epochs", type=int, default=100, help="of lightgcn")
    a.add_argument("--alpha", type=float, default=40.0)
    a.add_argument("--reg", type=float, default=0.01)
    a.add_argument("--seed", type=int, default=42)
    for name, text in (("evaluate-retriever", "effectiveness of a model's lists"), ("export", "candidate lists of users with truth")):
        a = command(name, text, data="store of the data set", model="store of the model", out="where the result goes")
        a.add_argument("--split", choices=list(datasets.SPLITS), default="test")
        a.add_argument("--k", type=int, default=25)
        a.add_argument("--min-rating", type=float, default=4.0)
    a.add_argument("--max-users", type=int)
    a.add_argument("--sample-users", action="store_true")
    a.add_argument("--seed", type=int, default=42)
    a.add_argument("--batch", type=int, default=1000)
    a.add_argument("--allow-missing-truth", action="store_true")
    for name, text in (("rerank", "runs of a scorer over candidates"), ("calibrate", "a position matrix from validation candidates")):
        a = command(name, text, candidates="JSON lines of export", scorer="module:function", out="where the result goes")
        a.add_argument("--model-name", default="", help="what the scorer stands for, for the matrix's provenance")
        a.add_argument("--scoring", default="marker_logprob")
        a.add_argument("--prompt", default="marker")
        a.add_argument("--architecture", default="causal")
        a.add_argument("--seed", type=int, default=42)
        a.add_argument("--batch-size", type=int, default=32)
        a.add_argument("--repeats", type=int, default=5)
        a.add_argument("--smoothing", type=float, default=1.0)
        a.add_argument("--calibration-users", type=int, default=150)
        if name == "rerank":
            a.add_argument("--method", choices=["zero_shot", *sorted(reranking.METHODS)], default="zero_shot")
            a.add_argument("--permutations", type=int, default=1)
            a.add_argument("--shuffle", action="store_true")
            a.add_argument("--calibration", help="store of matrices, for the method stella")
            a.add_argument("--calibration-candidates", help="validation candidates, where the store has no matrix yet")
    a = command("evaluate", "effectiveness, preference consistency and robustness of runs", runs="Parquet of rerank", candidates="JSON lines of export", out="where the row goes")
    a.add_argument("--k", type=int, default=5)
    a.add_argument("--full", action="store_true")
    a = command("position-bias", "exposure by input position of runs", runs="Parquet of rerank", out="where the row goes")
    a.add_argument("--k", type=int, default=5)
    x = p.parse_args(argv)
    for name in ("k", "permutations", "batch_size", "batch", "max_users"):
        if getattr(x, name, None) is not None and getattr(x, name) < 1:
            p.error(f"--{name.replace('_', '-')} is positive")
    return x


def scorer_of(spec: str) -> reranking.BatchScorer:
    module, _, name = spec.partition(":")
    if not name:
        raise ValueError(f"a scorer is named module:function, not {spec!r}")
    return getattr(importlib.import_module(module), name)


def prepare(spark: SparkSession, x: argparse.Namespace) -> None:
    if x.format == "movielens":
        log, items = readers.read_movielens_ratings(spark, x.raw), readers.read_movielens_movies(spark, x.raw)
        items_of = partial(prep.movie_metadata, items)
    else:
        log, items_of = readers.read_amazon_reviews(spark, x.raw), lambda ids: prep.amazon_items(readers.read_amazon_metadata(spark, x.raw), ids)
    tables, stats = datasets.prepare(log, items_of, x.min_rating, x.min_interactions, x.split, x.train, x.val)
    datasets.commit_dataset(x.data, tables, stats)


def train_retriever(spark: SparkSession, x: argparse.Namespace) -> None:
    tables, _ = datasets.load_dataset(spark, x.data)
    rows = prep.positives(tables["retriever_train"], x.min_rating)
    settings = {"factors": x.factors, "iterations": x.iterations, "alpha": x.alpha, "reg": x.reg} if x.kind == "als" else {"dim": x.factors, "epochs": x.epochs}
    models.model_fit(x.kind)(rows, seed=x.seed, **settings).save(x.model)


def _asked(spark: SparkSession, x: argparse.Namespace) -> tuple[dict[str, DataFrame], models.RetrievalModel, DataFrame]:
    """The data set, the model with all that a split's users had seen before, and the split's truth."""
    tables, _ = datasets.load_dataset(spark, x.data)
    before = {"train": [], "val": ["train"], "test": ["train", "val"]}[x.split]
    model = models.load_model(spark, x.model)
    for name in before:
        model = model.with_seen(tables[name])
    rows = tables["train_queries" if x.split == "train" else x.split]
    return tables, model, prep.positives(rows, x.min_rating).select("user_id", "item_id").distinct()


def evaluate_retriever(spark: SparkSession, x: argparse.Namespace) -> None:
    _, model, truth = _asked(spark, x)
    ranked = model.recommend(x.k, truth.select("user_id"))
    runs = ranked.select("user_id", F.lit(1).alias("permutation_index"), "item_id", (F.col("rank") - 1).alias("output_rank"))
    artifacts.write_jsonl(metrics.effectiveness(runs, truth, x.k).withColumns({"k": F.lit(x.k), "split": F.lit(x.split), "retriever": F.lit(model.kind)}), x.out)


def export(spark: SparkSession, x: argparse.Namespace) -> None:
    tables, model, truth = _asked(spark, x)
    score = lambda users: model.recommend(x.k, users)
    if x.allow_missing_truth:
        users, header = reports.export_users(score(truth.select("user_id")), truth, x.max_users, x.sample_users, x.seed)
        ranked = score(users)
    else:
        kept, ranked = retrieval.scan_for_truth(sampling.order_users(truth, x.sample_users, x.seed), score, truth, x.max_users, x.batch)
        users, header = kept.select("user_id"), None
    cleaned = metadata.clean_items(tables["items"])
    shown = metadata.display_candidates(ranked.select("user_id", "rank", "item_id"), cleaned)
    title = metadata.typed(F.col("title"), "string") if "title" in shown.columns else F.lit(None).cast("string")
    lists = shown.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "item_id", title.alias("title")))).alias("candidates"))
    true = metadata.display_truth(truth.join(users, "user_id", "left_semi"), cleaned)
    rows = lists.join(true, "user_id", "left").withColumns({"retriever": F.lit(model.kind), "split": F.lit(x.split)})
    artifacts.write_jsonl(rows.select("user_id", "retriever", "split", "candidates", "ground_truth_item_ids"), x.out)
    if header is not None:
        artifacts.write_jsonl(header, f"{x.out}.selection")


def _lists(spark: SparkSession, path: str) -> DataFrame:
    return artifacts.read_candidates(spark, path, CANDIDATES)


def _probes(lists: DataFrame) -> tuple[DataFrame, DataFrame, str | None]:
    split = lists.agg(F.min("split").alias("a"), F.max("split").alias("b")).first()
    candidates = lists.select("user_id", F.posexplode("candidates").alias("pos", "c")).select("user_id", "pos", "c.item_id")
    return candidates, lists.select("user_id", F.explode("ground_truth_item_ids").alias("item_id")), split["a"] if split["a"] == split["b"] else None


def _calibrated(spark: SparkSession, x: argparse.Namespace, root: str, candidates: str | None, count: int) -> calibration.Calibrator:
    provenance = {"model_name_or_path": x.model_name, "scoring": x.scoring, "prompt": x.prompt, "architecture": x.architecture, "adapter_path": None, "candidate_count": count}

    def make() -> dict:
        if candidates is None:
            raise ValueError("there is no matrix for this run yet, and no --calibration-candidates to make one from")
        rows, truth, split = _probes(_lists(spark, candidates))
        return calibration.calibrate(rows, truth, scorer_of(x.scorer), provenance, split, x.calibration_users, x.repeats, x.smoothing, x.seed, x.batch_size)

    return calibration.cached_calibration(spark, root, provenance, make)[0]


def _count(lists: DataFrame) -> int:
    sizes = lists.agg(F.min(F.size("candidates")).alias("a"), F.max(F.size("candidates")).alias("b")).first()
    if sizes["a"] is None or sizes["a"] != sizes["b"]:
        raise ValueError("the lists need one length")
    return sizes["a"]


def calibrate(spark: SparkSession, x: argparse.Namespace) -> None:
    _calibrated(spark, x, x.out, x.candidates, _count(_lists(spark, x.candidates)))


def rerank(spark: SparkSession, x: argparse.Namespace) -> None:
    lists = _lists(spark, x.candidates)
    requests = lists.select("user_id", F.transform("candidates", lambda c: c["item_id"]).alias("items"))
    if x.shuffle or x.permutations > 1:
        n, seed = x.permutations, x.seed
        orders = lambda user, ids: [[ids.index(i) for i in permutations.reshuffled(ids, permutations.user_seed(seed, int(user), k))] for k in range(n)]
        requests = permutations.explode_orders(requests, orders).select("user_id", "permutation_index", "items")
    else:
        requests = requests.withColumn("permutation_index", F.lit(1))
    calibrator = None
    if x.method == "stella":
        if not x.calibration:
            raise ValueError("the method stella needs --calibration")
        calibrator = _calibrated(spark, x, x.calibration, x.calibration_candidates, _count(lists))
    split = lists.select("split").first()
    runs = reranking.run_reranking(requests, scorer_of(x.scorer), x.method, calibrator, split["split"] if split else None, x.seed, x.batch_size)
    runs.write.mode("overwrite").parquet(x.out)


def evaluate(spark: SparkSession, x: argparse.Namespace) -> None:
    truth = _lists(spark, x.candidates).select("user_id", F.explode("ground_truth_item_ids").alias("item_id"))
    artifacts.write_jsonl(reports.evaluation(spark.read.parquet(x.runs), truth, x.k, full=x.full), x.out)


def position_bias(spark: SparkSession, x: argparse.Namespace) -> None:
    artifacts.write_jsonl(reports.position_bias(spark.read.parquet(x.runs), x.k), x.out)


COMMANDS = {"prepare": prepare, "train-retriever": train_retriever, "evaluate-retriever": evaluate_retriever, "export": export, "rerank": rerank, "calibrate": calibrate, "evaluate": evaluate, "position-bias": position_bias}


def main(argv: list[str] | None = None) -> None:
    x = _args(argv)
    COMMANDS[x.command](SparkSession.builder.appName("rankweave").getOrCreate(), x)


if __name__ == "__main__":
    main()
