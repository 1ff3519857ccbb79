"""Negative items, early-stopping scans, pruned scoring, stores, models, calibration runs, data sets, metadata, templates and evidence."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rankweave.operators import calibration, datasets, evidence, metadata, metrics, models, negatives, prep, retrieval, templates
from rankweave.plans import catalogue
from rankweave.sources import readers, store


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- negative items ------------------------------------------------------------------------------------------------

def dense_pairs(n=20):
    r = random.Random(1)
    return [(u, i) for u in range(12) for i in range(n) if r.random() < u / 11 or u == 11]


@pytest.mark.parametrize("rounds", [0, 2, 6])
def test_no_negative_is_seen_and_full_users_are_reported(spark, rounds):
    pairs, n = dense_pairs(), 20
    df = spark.createDataFrame(pairs, "user_id long, item_id int")
    got = negatives.negative_items(df.union(df.limit(5)), df, n, rounds=rounds).collect()
    assert len(got) == len(pairs) + 5
    assert all((g["negative"] is None) == (g["user_id"] == 11) for g in got)
    assert all(g["negative"] is None or ((g["user_id"], g["negative"]) not in set(pairs) and 0 <= g["negative"] < n) for g in got)


def test_draws_are_the_same_on_any_partitioning(spark):
    df = spark.createDataFrame(dense_pairs(), "user_id long, item_id int")
    one, other = (negatives.negative_items(df.repartition(p), df.repartition(3), 20, seed=7, epoch=2) for p in (1, 5))
    assert rows_of(one) == rows_of(other)
    assert rows_of(one) != rows_of(negatives.negative_items(df, df, 20, seed=7, epoch=3))


def test_negatives_are_spread_over_the_unseen(spark):
    df = spark.createDataFrame([(1, i % 3) for i in range(3000)], "user_id long, item_id int")
    for rounds in (0, 4):
        n = {r["negative"]: r["count"] for r in negatives.negative_items(df, df.distinct(), 8, rounds=rounds).groupBy("negative").count().collect()}
        assert set(n) == {3, 4, 5, 6, 7} and min(n.values()) > 480 and max(n.values()) < 720
    assert negatives.negative_items(df.limit(0), df, 8).collect() == []
    with pytest.raises(ValueError):
        negatives.negative_items(df, df, 0)


# --- scans and pruned scoring --------------------------------------------------------------------------------------

def test_a_scan_scores_no_later_batch(spark):
    asked = []

    def score(users):
        ids = [r["user_id"] for r in users.collect()]
        asked.extend(ids)
        return spark.createDataFrame([(u, u % 10, 1) for u in ids], "user_id long, item_id long, rank int")

    order = spark.createDataFrame([(100 + p, p) for p in range(50)], "user_id long, place long")
    truth = spark.createDataFrame([(100 + p, 0) for p in range(50)], "user_id long, item_id long")  # every tenth user hits
    kept, ranked = retrieval.scan_for_truth(order, score, truth, max_users=2, batch=4)
    assert rows_of(kept) == [(100, 0, 12), (110, 10, 12)]
    assert max(asked) < 112 and rows_of(ranked) == [(100, 0, 1), (110, 0, 1)]
    kept, _ = retrieval.scan_for_truth(order, score, truth, max_users=99, batch=4)
    assert {r["scanned_users"] for r in kept.collect()} == {50} and kept.count() == 5
    kept, ranked = retrieval.scan_for_truth(order.limit(0), score, truth, 3, 4)
    assert kept.collect() == [] and ranked.collect() == []
    with pytest.raises(ValueError):
        retrieval.scan_for_truth(order, score, truth, 0)


@pytest.mark.parametrize(("block", "of_pass"), [(7, 1000), (16, 64), (1000, 30)])
def test_skipped_blocks_change_no_row(spark, block, of_pass):
    rng = np.random.default_rng(3)
    users, items = rng.normal(size=(40, 6)), rng.normal(size=(200, 6)) * rng.exponential(1.0, (200, 1)) ** 2
    items[17] = items[3]
    seen = [(u, int(i)) for u in range(0, 40, 2) for i in np.argsort(-(items @ users[u]))[: u % 7]]
    frame = lambda x, c: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{c} long, vec array<double>")
    got = retrieval.pruned_topk(frame(users, "user_id"), frame(items, "item_id"), spark.createDataFrame(seen, "user_id long, item_id long"), 5, block, of_pass).collect()
    assert len(got) == 40
    for r in got:
        s = [(-round(float((items[i] * users[r["user_id"]]).sum()), 12), i) for i in range(200) if (r["user_id"], i) not in set(seen)]
        assert list(r["ids"]) == [i for _, i in sorted(s)[:5]]
        assert r["scored"] >= 1 and r["scored"] + r["skipped"] <= 200 // min(block, of_pass) + 4
    if block == 7:
        assert sum(r["skipped"] for r in got) > sum(r["scored"] for r in got)  # the norms fall fast
    assert retrieval.pruned_topk(frame(users, "user_id"), frame(items, "item_id").limit(0), None, 5).select(F.size("ids").alias("n")).distinct().collect()[0]["n"] == 0


def test_short_passes_go_together(spark, monkeypatch):
    """Passes of a few items are no step each; items collected once serve several tables of users; with several parts the result is the same."""
    rng = np.random.default_rng(4)
    frame = lambda x, c: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{c} long, vec array<float>")
    users, items = frame(rng.normal(size=(30, 4)), "user_id"), frame(rng.normal(size=(120, 4)), "item_id")
    stored, collected = [], []
    keep, parts = prep.stored_once, retrieval._item_parts
    monkeypatch.setattr(prep, "stored_once", lambda df: stored.append(1) or keep(df))
    monkeypatch.setattr(retrieval, "_item_parts", lambda *x: collected.append(1) or parts(*x))
    of = lambda df: sorted((r["user_id"], tuple(r["ids"]), tuple(r["scores"])) for r in df.collect())
    want = of(retrieval.pruned_topk(users, items, None, 5, 4, 10))
    assert not stored
    shared = retrieval.broadcast_items(items)
    assert of(retrieval.pruned_topk(users.where("user_id < 9"), shared, None, 5)) + of(retrieval.pruned_topk(users.where("user_id >= 9"), shared, None, 5)) == want and len(collected) == 2
    monkeypatch.setattr(retrieval, "PASS_ITEMS", 30)
    got = retrieval.pruned_topk(users, items, None, 5, 4, 10).collect()
    assert sorted((r["user_id"], tuple(r["ids"]), tuple(r["scores"])) for r in got) == want and stored and all(r["scored"] + r["skipped"] >= 30 for r in got)


def test_coverage_reads_candidates_once(spark):
    made = spark.sparkContext.accumulator(0)

    def noted(it):
        for b in it:
            made.add(len(b))
            yield b

    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (3, 7)], "user_id long, item_id long").mapInPandas(noted, "user_id long, item_id long")
    truth = spark.createDataFrame([(1, 6), (1, 6), (2, 9), (4, 5)], "user_id long, item_id long")
    assert tuple(retrieval.candidate_coverage(rows, truth).first()) == (3, 1, 1 / 3) and made.value == 4


def test_preference_consistency_reads_its_lists_once(spark):
    made = spark.sparkContext.accumulator(0)

    def noted(it):
        for b in it:
            made.add(len(b))
            yield b

    kind = "user_id int, permutation_index int, item_id string, input_position int, output_rank int"
    rows = [(u, p, f"i{(i + p) % 3}", i, (i * u) % 3 if u != 3 else i) for u in (1, 2, 3) for p in (1, 2) for i in range(3)]
    got = metrics.preference_consistency(spark.createDataFrame(rows, kind).mapInPandas(noted, kind)).first()
    assert got["num_users"] == 3 and made.value == len(rows)


def test_numbered_rows_are_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(5)
    assert all(r["x"] == 999 - r["at"] for r in prep.numbered(df, F.desc("x"), name="at").collect())


# --- stores and models ---------------------------------------------------------------------------------------------

def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    with pytest.raises(FileNotFoundError):
        store.current(spark, root)
    one = spark.range(3)
    assert store.commit(spark, root, {"a": one, "b": one}, {"k": 1}) == 1
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        store.commit(spark, root, {"a": spark.range(9), "b": broken}, {"k": 2})
    tables, note = store.current(spark, root)
    assert note == {"k": 1} and tables["a"].count() == 3
    assert store.commit(spark, root, {"a": spark.range(5), "b": one}) == 2
    assert store.current(spark, root)[0]["a"].count() == 5 and store.current(spark, root, 1)[0]["a"].count() == 3
    with pytest.raises(FileNotFoundError):
        store.current(spark, root, 7)
    assert store.put_text(spark, f"{root}/x/y.json", "é") and not store.put_text(spark, f"{root}/x/y.json", "z")
    assert store.get_text(spark, f"{root}/x/y.json") == "é" and store.get_text(spark, f"{root}/x/no.json") is None


def test_a_loaded_model_gives_the_same_lists(spark, tmp_path):
    log = spark.createDataFrame([(u, i, 5.0) for u in range(12) for i in range(9) if (u * i) % 4 != 1], "user_id long, item_id long, rating double")
    model = models.als_model(log, factors=4, iterations=2)
    assert model.stats["num_users"] == 12 and model.stats["num_items"] == 9 and model.stats["loss_history"] == [] and model.stats["fit_seconds"] > 0
    root = f"file://{tmp_path}/m"
    assert model.save(root) == 1
    back = models.load_model(spark, root, "als")
    assert back.stats == model.stats
    assert rows_of(back.recommend(3)) == rows_of(model.recommend(3))
    some = spark.createDataFrame([(3,)], "user_id int")
    assert {r["user_id"] for r in back.recommend(3, some).collect()} == {3}
    assert back.recommend(9, some, exclude_seen=False).count() == 9
    first = back.recommend(1).select("user_id", "item_id")
    again = back.with_seen(first)
    assert not set(rows_of(first)) & set(rows_of(again.recommend(9).select("user_id", "item_id")))
    with pytest.raises(TypeError):
        models.load_model(spark, root, "lightgcn")
    store.commit(spark, f"{root}2", {"a": log})
    with pytest.raises(TypeError):
        models.load_model(spark, f"{root}2")
    with pytest.raises(ValueError, match="no interactions"):
        models.als_model(log.limit(0))


# --- calibration ---------------------------------------------------------------------------------------------------

PROVENANCE = {"model_name_or_path": "m", "scoring": "marker_logprob", "prompt": "marker", "architecture": "lft", "adapter_path": None, "candidate_count": 4}


def probes(spark, n_users=6, n=4):
    c = spark.createDataFrame([(u, p, f"i{u}_{p}") for u in range(n_users) for p in range(n)], "user_id long, pos int, item_id string")
    return c, spark.createDataFrame([(u, f"i{u}_{u % n}") for u in range(n_users)], "user_id long, item_id string")


def test_a_second_run_scores_nothing(spark, tmp_path):
    candidates, truth = probes(spark)
    calls = []

    def make():
        calls.append(1)
        return calibration.calibrate(candidates, truth, lambda lists: [[-float(i) for i in range(len(x))] for _, x in lists], PROVENANCE, "val", repeats=3, smoothing=1.0)

    root = f"file://{tmp_path}/c"
    first, known = calibration.cached_calibration(spark, root, PROVENANCE, make)
    assert not known and len(calls) == 1
    # the scorer always takes the first shown: 6 users x 3 repeats for each place
    assert np.allclose(first.matrix, [[19 / 22, 1 / 22, 1 / 22, 1 / 22]] * 4)
    again, known = calibration.cached_calibration(spark, root, {**PROVENANCE, "adapter_path": " "}, make)
    assert known and len(calls) == 1 and np.array_equal(again.matrix, first.matrix)
    said = json.loads(store.get_text(spark, f"{root}/{calibration.fingerprint(PROVENANCE)}.json"))
    assert said["diagnostics"] == {"num_probe_users": 6, "num_available_probe_users": 6, "num_queries": 72, "repeats": 3, "smoothing": 1.0, "seed": 42}
    # a matrix for something else under this name is refused
    other = {**PROVENANCE, "scoring": "generation"}
    store.put_text(spark, f"{root}/{calibration.fingerprint(other)}.json", json.dumps(said))
    with pytest.raises(ValueError, match="scoring"):
        calibration.cached_calibration(spark, root, other, make)
    # and so is one that make() gives for another length
    with pytest.raises(ValueError, match="candidate_count"):
        calibration.cached_calibration(spark, root, {**PROVENANCE, "candidate_count": 5}, make)


def test_probes_are_checked(spark):
    candidates, truth = probes(spark)
    with pytest.raises(ValueError, match="validation"):
        calibration.check_probes(candidates, truth, "test")
    with pytest.raises(ValueError, match="one length"):
        calibration.check_probes(candidates.where("not (user_id = 1 and pos = 3)"), truth, "val")
    with pytest.raises(ValueError, match="user 2: no true item; user 5: no true item among"):
        calibration.check_probes(candidates, truth.where("user_id <> 2 and user_id <> 5").union(spark.createDataFrame([(5, "x")], truth.schema)), "val")
    with pytest.raises(ValueError, match="no users"):
        calibration.check_probes(candidates.limit(0), truth, "val")
    assert calibration.check_probes(candidates, truth, "VAL") == 4


def test_a_scorer_that_finds_the_target_gives_the_identity(spark):
    candidates, truth = probes(spark)
    true = {r["item_id"] for r in truth.collect()}
    made = calibration.calibrate(candidates, truth, lambda lists: [[float(i in true) for i in x] for _, x in lists], PROVENANCE, "val", max_users=3, smoothing=0.0)
    assert made["transition_matrix"] == np.eye(4).tolist() and made["diagnostics"]["num_probe_users"] == 3


# --- data sets -----------------------------------------------------------------------------------------------------

def raw_log(spark):
    rows = [(f"u{u}", f"m{(u * 3 + t) % 11}", float(3 + t % 3), 100 + t) for u in range(6) for t in range(4 + 3 * u)]
    return spark.createDataFrame(rows, "user_id string, item_id string, rating double, timestamp long")


def test_a_data_set_is_committed_whole(spark, tmp_path):
    meta = lambda ids: ids.where("raw <> 'm5'").select(F.col("id").alias("item_id"), F.col("raw").alias("raw_item_id"), F.concat(F.lit("T"), "raw").alias("title"), F.lit("a||b").alias("genres"), F.lit(1999).alias("release_year"))
    tables, stats = datasets.prepare(raw_log(spark), meta, 4.0, min_interactions=5)
    root = f"file://{tmp_path}/d"
    assert datasets.commit_dataset(root, tables, stats) == 1
    back, said = datasets.load_dataset(spark, root)
    assert said == stats and set(back) == set(datasets.TABLES)
    assert stats["num_users"] == 5 and stats["items_with_metadata"] == stats["num_items"] - 1
    assert stats["num_train"] + stats["num_val"] + stats["num_test"] == stats["num_interactions"]
    assert stats["num_retriever_train"] + stats["num_train_queries"] == stats["num_train"]
    for t in datasets.TABLES:
        assert rows_of(back[t]) == rows_of(tables[t])
    assert rows_of(back["user_mapping"]) == [(f"u{i + 1}", i) for i in range(5)]
    with pytest.raises(ValueError, match="missing"):
        datasets.commit_dataset(root, {k: v for k, v in tables.items() if k != "val"}, stats)
    lists = {r["user_id"]: r["history"] for r in datasets.user_histories(back, "test", 3).collect()}
    assert set(lists) == set(range(5)) and all(len(h) == 3 for h in lists.values())
    known = next(x for h in lists.values() for x in h if x["item_id"] != "m5")
    assert known["title"] == "T" + known["item_id"] and known["genres"] == ["a", "b"] and known["year"] == 1999
    empty = datasets.history_lists(spark.createDataFrame([(9,)], "user_id long"), back["train"], back["items"], 3).collect()
    assert empty[0]["history"] == []
    with pytest.raises(ValueError, match="split"):
        datasets.user_histories(back, "dev", 3)


def test_shares_must_leave_something(spark):
    log = raw_log(spark).withColumnRenamed("timestamp", "ts")
    for train, val in ((1.5, 0.1), (-1.0, 0.5), (0.5, 0.5), (0.7, 0.0), (math.nan, 0.1)):
        with pytest.raises(ValueError, match="shares"):
            prep.temporal_split(log, train, val, 3, ["rating"])


def test_ratings_are_read_by_name(spark, tmp_path):
    (tmp_path / "ratings.csv").write_text("movieId,timestamp,userId,rating\n7,5,1,4.5\n")
    assert rows_of(readers.read_movielens_ratings(spark, str(tmp_path))) == [(1, 7, 4.5, 5)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "ratings.csv").write_text("movieId,rating,timestamp\n7,4.5,5\n")
    with pytest.raises(ValueError, match="user_id"):
        readers.read_movielens_ratings(spark, f"{tmp_path}/bad")


def test_reviews_without_a_required_key_are_an_error(spark, tmp_path):
    (tmp_path / "reviews.jsonl").write_text('{"user_id": "a", "rating": 4.0, "timestamp": 3}\n')
    with pytest.raises(ValueError, match="parent_asin"):
        readers.read_amazon_reviews(spark, str(tmp_path))
    (tmp_path / "reviews.jsonl").write_text('{"user_id": "a", "parent_asin": "x", "rating": 4.0, "timestamp": 3}\n{"user_id": "b"}\n')
    assert rows_of(readers.read_amazon_reviews(spark, str(tmp_path))) == [("a", "x", 4.0, 3)]
    (tmp_path / "reviews.jsonl").write_text("")
    assert readers.read_amazon_reviews(spark, str(tmp_path)).collect() == []


# --- lists over different items ------------------------------------------------------------------------------------

def test_lists_over_other_items_are_null_and_counted(spark):
    rows = [(1, p, i, r) for p in (1, 2) for r, i in enumerate("abc")] + [(2, 1, i, r) for r, i in enumerate("abc")] + [(2, 2, i, r) for r, i in enumerate("abx")]
    runs = spark.createDataFrame(rows, "user_id long, permutation_index int, item_id string, output_rank int").withColumn("input_position", F.col("output_rank"))
    seen = Observation("alignment")
    assert rows_of(metrics.kendall(runs, seen)) == [(1, 1.0), (2, None)]
    assert seen.get == {"pairs": 2, "mismatches": 1}
    assert rows_of(metrics.spearman(runs)) == [(1, 1.0), (2, None)]
    assert rows_of(metrics.alignment_violations(runs)) == [(2, 1, 2, ["c"], ["x"])]


# --- metadata and templates ----------------------------------------------------------------------------------------

def test_metadata_of_files(spark, tmp_path):
    assert metadata.load_item_metadata(spark, f"file://{tmp_path}").collect() == []
    (tmp_path / "items.csv").write_text('item_id,raw_item_id,title,genres,price,tags\n3,A3,"A ""b"", c",x||y,1.5,"[""p"", 2]"\n4,,Plain,"[""g""]",,[oops]\n')
    items = metadata.load_item_metadata(spark, f"file://{tmp_path}")
    shown = {r["internal_id"]: r for r in metadata.display_items(items).select("internal_id", "item_id", metadata.typed(F.col("title"), "string").alias("title"), metadata.typed(F.col("genres"), "array<string>").alias("genres"), metadata.typed(F.col("price"), "double").alias("price"), F.to_json("tags").alias("tags")).collect()}
    assert tuple(shown[3]) == (3, "A3", 'A "b", c', ["x", "y"], 1.5, '["p",2]')
    assert tuple(shown[4]) == (4, "4", "Plain", ["g"], None, '"[oops]"')


def test_templates_are_checked_when_they_are_compiled(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"instruction": "Go.", "candidate_item_format": "{item_id}={title}"}))
    t = templates.load_template(spark, f"file://{tmp_path}/t")
    assert t["history_header"] == templates.DEFAULT["history_header"] and t["instruction"] == "Go."
    assert templates.load_template(spark) == templates.DEFAULT
    with pytest.raises(FileNotFoundError):
        templates.load_template(spark, f"file://{tmp_path}/none")
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError, match="object"):
        templates.load_template(spark, f"file://{tmp_path}/l.json")
    for bad in ("{nope}", "{}", "{title!r}", "{year:>4}", "a } b"):
        with pytest.raises(ValueError):
            templates.parse_format(bad)
    item = "struct<item_id: int, title: string, genres: array<string>, year: int, rating: double>"
    df = spark.createDataFrame([([], [(4, "A", ["x", "y"], 1990, None), (5, None, None, None, 3.0)])], f"history array<{item}>, candidates array<{item}>")
    made = df.select(templates.templated_prompt(F.col("history"), F.col("candidates"), t, ["item_id", "title", "genres", "year", "rating"]).alias("p")).first()["p"]
    assert made == "[SPAN]\nGo.\n\nUser history:\n[/SPAN]\n\n[ITEM]\n4=A\n[/ITEM]\n\n[ITEM]\n5=\n[/ITEM]\n"


# --- evidence ------------------------------------------------------------------------------------------------------

def test_evidence_is_read_as_it_was_written(spark, tmp_path):
    run = "struct<permutation: array<int>, scores: array<double>, relevance: array<int>>"
    samples = spark.createDataFrame(
        [(1, "u", None, [], [("a",), ("b",), ("c",)], ["a", "b"], [([2, 0, 1], [0.5, 0.5, 0.9], [1, 0, 0]), ([0, 1, 2], [0.1], None)], {"k": 5}), (2, "v", "val", [], [], [], [], None)],
        f"sample_index long, user_id string, split string, history array<string>, candidates array<struct<item_id: string>>, candidate_ids array<string>, runs array<{run}>, more map<string, int>",
    )
    made = evidence.rank_records(samples)
    one = {r["sample_index"]: r for r in made.collect()}
    p, q = one[1]["permutations"]
    assert p["input"]["item_ids"] == [None, "a", "b"] and p["input"]["relevance"] == [1, 0, 0]
    assert p["output_ranking"]["candidate_indices"] == [1, 2, 0] and p["output_ranking"]["scores"] == [0.9, 0.5, 0.5]
    assert q["input"]["candidate_indices"] == [0] and q["input"]["relevance"] == [] and q["permutation_index"] == 1
    assert one[2]["permutations"] == [] and one[1]["list_length"] == 3
    path = f"file://{tmp_path}/e"
    evidence.write_records(made, path)
    back = evidence.read_records(spark, path)
    assert [f.dataType for f in back.schema] == [f.dataType for f in made.schema]
    text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect())
    assert text(back) == text(made)
    rows = {(r["sample_index"], r["permutation_index"]): r for r in evidence.permutation_rank_records(samples).collect()}
    assert [x["candidate_index"] for x in rows[1, 0]["ranking"]] == [1, 2, 0] and [x["relevance"] for x in rows[1, 0]["ranking"]] == [0, 1, 0]


def test_samples_and_results_as_objects(spark):
    df = spark.createDataFrame([("u", ["h"], ["c"], None, {"x": "1", "user_id": "other"}), ("v", [], [], "val", None)], "user_id string, history array<string>, candidates array<string>, split string, metadata map<string, string>")
    got = [json.loads(r["value"]) for r in evidence.sample_dicts(df.withColumn("metadata", F.to_variant_object("metadata"))).collect()]
    assert got == [{"x": "1", "user_id": "u", "history": ["h"], "candidates": ["c"]}, {"user_id": "v", "history": [], "candidates": [], "split": "val"}]
    item = "struct<candidate_index: int, item_id: string, score: double, input_position: int, relevance: int, candidate: map<string, string>>"
    made = spark.createDataFrame([("u", None, [1, 0], [(0, "a", 0.5, 1, None, {}), (1, "b", 0.1, 0, 1, {"t": "x"})], {}), ("w", None, [0, 0], [(0, "a", 0.5, 1, None, {})], {}), ("x", None, [0, 1], [(0, "a", 0.5, 1, None, {}), (0, "a", 0.5, 1, None, {})], {}), ("y", None, [0, 1], [(0, "a", 0.5, 1, None, {})], {})], f"user_id string, split string, permutation array<int>, items array<{item}>, metadata map<string, string>")
    said = json.loads(evidence.result_dicts(made).first()["value"])
    assert said["items"][0] == {"candidate_index": 0, "item_id": "a", "score": 0.5, "input_position": 1, "relevance": None, "candidate": {}} and said["split"] is None
    assert [r["user_id"] for r in evidence.result_violations(made).orderBy("user_id").collect()] == ["w", "x", "y"]


def test_inconsistency_of_lists_is_that_of_their_preferences(spark):
    rng = random.Random(9)
    rows = []
    for u in range(30):
        items = [f"i{k}" for k in range(rng.randint(1, 9))]
        for p in range(rng.randint(1, 5)):
            some = rng.sample(items, rng.randint(1, len(items)))
            rows += [(u, p, i, r) for r, i in enumerate(some)]
    runs = spark.createDataFrame(rows, "user_id long, permutation_index int, item_id string, output_rank int")
    by_lists = {r["user_id"]: round(r["gpi"], 9) for r in metrics.gpi_of_lists(runs).collect()}
    by_pairs = {r["user_id"]: round(r["gpi"], 9) for r in metrics.gpi(metrics.pair_preferences(runs)).collect()}
    # pairs that no list holds together count for lists, whose matrix has them without a preference
    whole = {u for u in by_pairs if all(len({i for a, p, i, _ in rows if a == u}) == sum(1 for a, q, *_ in rows if a == u and q == p) for p in {q for a, q, *_ in rows if a == u})}
    assert len(whole) >= 5 and all(by_lists[u] == by_pairs[u] for u in whole)
    assert set(by_lists) == set(by_pairs)


def test_a_round_trip_makes_each_line_once(spark):
    out = catalogue.QUERIES["evidence_round_trip"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == plan.count("StructsToJsonEvaluator") == 1
    assert plan.count("] parquet") == 2  # customers for runs and for truth
