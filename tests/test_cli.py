"""The commands over files, one after the other."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rankweave import cli
from rankweave.operators import datasets, models


SCORER = "rankweave.functions.scoring:digest_scores"


def lines_of(path):
    return [json.loads(x) for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A prepared data set and a trained model."""
    top = tmp_path_factory.mktemp("cli")
    raw = top / "raw"
    raw.mkdir()
    rng = random.Random(5)
    rows = [f"{u},{m},{rng.choice([3, 4, 5])}.0,{1000 + t}" for u in range(1, 25) for t, m in enumerate(rng.sample(range(1, 41), 20))]
    (raw / "ratings.csv").write_text("userId,movieId,rating,timestamp\n" + "\n".join(rows) + "\n")
    (raw / "movies.csv").write_text("movieId,title,genres\n" + "\n".join(f'{m},"Film, {m} (19{m + 50})",A|B' for m in range(1, 40)) + "\n")
    cli.main(["prepare", "--raw", f"file://{raw}", "--format", "movielens", "--data", f"file://{top}/data"])
    cli.main(["train-retriever", "--data", f"file://{top}/data", "--model", f"file://{top}/model", "--factors", "4", "--iterations", "3"])
    for split in ("val", "test"):
        cli.main(["export", "--data", f"file://{top}/data", "--model", f"file://{top}/model", "--split", split, "--k", "10", "--min-rating", "3", "--batch", "4", "--out", f"file://{top}/{split}"])
    return top


def test_prepared_tables(spark, folder):
    tables, stats = datasets.load_dataset(spark, f"file://{folder}/data")
    assert stats["num_users"] == 24 and stats["num_items"] == 40 and stats["items_with_metadata"] == 39
    row = tables["items"].where("raw_item_id = '7'").first()
    assert (row["title"], row["genres"], row["release_year"]) == ("Film, 7", "A|B", 1957)
    assert models.load_model(spark, f"file://{folder}/model").stats["retriever"] == "als"


def test_another_kind_of_model_keeps_its_losses(spark, folder):
    cli.main(["train-retriever", "--data", f"file://{folder}/data", "--model", f"file://{folder}/graph", "--kind", "lightgcn", "--factors", "4", "--epochs", "3"])
    model = models.load_model(spark, f"file://{folder}/graph", "lightgcn")
    assert len(model.stats["loss_history"]) == 3 and model.recommend(2).count() > 0
    with pytest.raises(ValueError, match="no such retriever"):
        models.model_fit("knn")


def test_exported_candidates(spark, folder):
    tables, _ = datasets.load_dataset(spark, f"file://{folder}/data")
    raw = {r["user_id"]: set() for r in tables["users"].collect()}
    for r in tables["train"].union(tables["val"]).collect():
        raw[r["user_id"]].add(str(r["raw_item_id"]))
    rows = lines_of(folder / "test")
    assert rows and all(len(r["candidates"]) == 10 and [c["rank"] for c in r["candidates"]] == list(range(1, 11)) for r in rows)
    for r in rows:
        # an item that no metadata knows is shown by its internal id, without a title
        shown = {c["item_id"] for c in r["candidates"] if c["title"]}
        assert {c["item_id"] for c in r["candidates"]} & set(r["ground_truth_item_ids"]) and not shown & raw[r["user_id"]] and (r["split"], r["retriever"]) == ("test", "als")
        assert all(c["title"] == f"Film, {c['item_id']}" for c in r["candidates"] if c["title"]) and len(shown) >= 9


def test_export_of_chosen_users(spark, folder):
    args = ["export", "--data", f"file://{folder}/data", "--model", f"file://{folder}/model", "--k", "5", "--min-rating", "3", "--max-users", "3"]
    cli.main([*args, "--sample-users", "--allow-missing-truth", "--out", f"file://{folder}/some"])
    assert len(lines_of(folder / "some")) == 3 and lines_of(folder / "some.selection")[0]["num_users_selected"] == 3
    cli.main([*args, "--batch", "2", "--out", f"file://{folder}/few"])
    assert len(lines_of(folder / "few")) == 3


def test_retriever_is_evaluated(spark, folder):
    cli.main(["evaluate-retriever", "--data", f"file://{folder}/data", "--model", f"file://{folder}/model", "--k", "10", "--min-rating", "3", "--out", f"file://{folder}/quality"])
    [row] = lines_of(folder / "quality")
    assert row["k"] == 10 and 0 < row["recall"] <= 1 and 0 < row["ndcg"] <= 1 and row["hit_rate"] >= row["recall"]


def test_runs_and_their_reports(spark, folder):
    cli.main(["rerank", "--candidates", f"file://{folder}/test", "--scorer", SCORER, "--permutations", "3", "--out", f"file://{folder}/runs"])
    runs = spark.read.parquet(f"file://{folder}/runs")
    n = len(lines_of(folder / "test"))
    assert runs.count() == n * 3 * 10
    best = runs.where("output_rank = 0").groupBy("user_id").agg(F.countDistinct("item_id").alias("n")).agg(F.max("n")).first()[0]
    assert best == 1  # the scorer doesn't look at places
    cli.main(["evaluate", "--runs", f"file://{folder}/runs", "--candidates", f"file://{folder}/test", "--out", f"file://{folder}/report", "--full"])
    [row] = lines_of(folder / "report")
    assert row["num_users"] == n and row["mean_tau"] == 1.0 and row["rank_std"] == 0.0 and row["num_users_with_pairs"] == n
    cli.main(["position-bias", "--runs", f"file://{folder}/runs", "--k", "3", "--out", f"file://{folder}/bias"])
    assert len(lines_of(folder / "bias")[0]["exposure"]) == 10


def test_a_matrix_is_made_once(spark, folder):
    store = ["--model-name", "m", "--repeats", "2"]
    cli.main(["calibrate", "--candidates", f"file://{folder}/val", "--scorer", SCORER, "--out", f"file://{folder}/matrices", *store])
    assert len(list((folder / "matrices").glob("*.json"))) == 1
    # it is used, not made again: no candidates for another are given
    rerank = ["rerank", "--candidates", f"file://{folder}/test", "--method", "stella", "--calibration", f"file://{folder}/matrices", "--out", f"file://{folder}/stella"]
    cli.main([*rerank, "--scorer", SCORER, *store])
    assert spark.read.parquet(f"file://{folder}/stella").where("output_rank = 0").count() == len(lines_of(folder / "test"))
    with pytest.raises(ValueError, match="no matrix"):
        cli.main([*rerank, "--scorer", SCORER, "--model-name", "other"])
    with pytest.raises(ValueError, match="validation"):
        cli.main(["calibrate", "--candidates", f"file://{folder}/test", "--scorer", SCORER, "--out", f"file://{folder}/matrices", "--model-name", "third"])


def test_wrong_arguments_end_the_command(folder):
    for bad in (["rerank"], ["evaluate", "--runs", "x", "--candidates", "y", "--out", "z", "--k", "0"], ["train"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
    with pytest.raises(ValueError, match="module:function"):
        cli.scorer_of("json")
