"""Reranking runs, their settings and reports on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from rankweave.functions import settings
from rankweave.operators import aggregate, marker, reports, reranking
from rankweave.sources import artifacts


def test_settings_have_rules_and_keep_unknown_keys():
    s = settings.reranker_settings({"max_seq_length": 9, "colour": "red"}, "block_setwise")
    assert (s["max_length"], s["colour"], s["attention_mask"], s["interaction"]) == (9, "red", "block", "relational")
    assert settings.reranker_settings(architecture="causal")["position_ids"] == "standard"
    for bad in ({"max_length": 0}, {"attention_mask": "x"}, {"interaction": "relational", "attention_mask": "causal"}, {"interaction_dropout": 1.0}, {"span_end_token": "[SPAN]"}, {"item_end_token": ""}):
        with pytest.raises(ValueError):
            settings.reranker_settings(bad)
    with pytest.raises(ValueError):
        settings.reranker_settings(architecture="x")
    assert settings.training_settings({"lambda_perm": 1.0, "train_num_permutations": 2})["permutation_loss"] == "kl"
    for bad in ({"lambda_perm": 1.0}, {"lambda_rank": 0.0}, {"learning_rate": 0}, {"num_epochs": None, "total_optimizer_steps": None}, {"permutation_loss": "x"}):
        with pytest.raises(ValueError):
            settings.training_settings(bad)
    settings.check_prompt("generation", "list")
    for bad in (("generation", "marker"), ("x", "list")):
        with pytest.raises(ValueError):
            settings.check_prompt(*bad)


def test_settings_round_trip(tmp_path):
    path = str(tmp_path / "s.json")
    artifacts.write_settings(settings.training_settings({"extra": [1]}), path)
    assert settings.training_settings(artifacts.read_settings(path)) == settings.training_settings({"extra": [1]})


def test_metrics_paths():
    assert artifacts.metrics_path("m", "reranking", "d", "als", 5, "a/c_k10.json", "r.json") == "m/reranking/d/als/c_k10/r/metrics_at_5.json"
    with pytest.raises(ValueError):
        artifacts.metrics_path("m", "x", "d", "als", 5)


def test_rank_many_checks_what_a_batch_gives():
    sizes = []

    def scorer(lists):
        sizes.append(len(lists))
        return [[0.0] * len(shown) for _, shown in lists]

    lists = [(str(i), ["a"] * i) for i in range(1, 6)]
    assert [len(s) for s in reranking.rank_many(scorer, lists, 2)] == [1, 2, 3, 4, 5] and sizes == [2, 2, 1]
    for bad in (lambda _: [], lambda ls: [[float("nan")] * len(s) for _, s in ls], lambda ls: [[1.0]] * len(ls)):
        with pytest.raises(ValueError):
            reranking.rank_many(bad, lists[1:])
    with pytest.raises(ValueError):
        reranking.rank_many(scorer, lists, 0)


@pytest.fixture
def by_name():
    return lambda lists: [[float(ord(i[0])) for i in shown] for _, shown in lists]  # a local function travels to workers by value


def test_zero_shot_keeps_ties_as_shown_and_whole_ids(spark, by_name):
    big = 2**53 + 1
    rows = [(big, 1, ["a", "c", "b", "c2"]), (None, 2, ["x"]), (7, 1, []), (8, 1, None)]
    got = reranking.run_reranking(spark.createDataFrame(rows, "user_id long, permutation_index int, items array<string>"), by_name)
    out = sorted(got.where(F.col("user_id").isNotNull()).collect(), key=lambda r: r["output_rank"])
    assert {r["user_id"] for r in out} == {big}
    assert [(r["item_id"], r["input_position"]) for r in out] == [("c", 1), ("c2", 3), ("b", 2), ("a", 0)]
    assert got.where(F.col("user_id").isNull()).count() == 1 and got.count() == 5


def test_methods_agree_with_their_functions(spark, by_name):
    ids = list("dacb")
    df = spark.createDataFrame([(1, 1, ids)], "user_id long, permutation_index int, items array<string>")
    one = lambda user, shown: by_name([(user, shown)])[0]
    seed = aggregate.request_seed(3, "1", "test", ids, range(4))
    got = reranking.run_reranking(df, by_name, "bootstrapping", split="test", seed=3, samples=4).orderBy("output_rank").collect()
    assert [r["input_position"] for r in got] == aggregate.bootstrapping(one, "1", ids, list(range(4)), seed, 4)
    matrix = aggregate.Calibrator([[4.0 if i == j else 1.0 for j in range(4)] for i in range(4)])
    got = reranking.run_reranking(df, by_name, "stella", calibrator=matrix, split="test", seed=3).orderBy("output_rank").collect()
    assert [r["input_position"] for r in got] == aggregate.stella(one, matrix, "1", ids, list(range(4)), seed)
    for method, c in (("x", None), ("stella", None), ("zero_shot", matrix)):
        with pytest.raises(ValueError):
            reranking.run_reranking(df, by_name, method, calibrator=c)


def test_request_violations(spark):
    rows = [(["a", "b"], ["A", "B"], [1, 0]), (["a", "a"], ["A", " "], [0, 0]), ([], [], []), (None, None, None), (["a", None], ["A", None], [0]), (["a"], [], [1])]
    got = reranking.request_violations(spark.createDataFrame(rows, "items array<string>, titles array<string>, permutation array<int>"))
    assert {r["rule"]: r["violations"] for r in got.collect()} == {"no_candidates": 2, "repeated_items": 1, "missing_ids": 1, "blank_titles": 3, "broken_order": 3}


def test_training_orders_are_seeded_by_indexes(spark):
    df = spark.createDataFrame([(0, ["a", "b", "c"], [0, 1, 0]), (5, ["a"], [1])], "sample_index long, items array<string>, relevance array<int>")
    got = {(r["sample_index"], r["permutation_index"]): r for r in reranking.training_orders(df, 3).collect()}
    assert len(got) == 6
    for (s, p), r in got.items():
        want = list(range(3 if s == 0 else 1))
        random.Random(s * 1009 + p).shuffle(want)
        assert r["permutation"] == want and r["items"] == ["abc"[i] for i in want]
        assert r["relevance"] == [[[0, 1, 0][i], 1][s == 5] for i in want]
    assert reranking.training_orders(df, 1, deterministic=False).count() == 2


def test_result_lists_fall_back_and_keep_empty_ones(spark):
    kind = "user_id long, reranked_item_ids array<string>, permutations array<struct<permutation_index:int,reranked_item_ids:array<string>>>"
    rows = [(1, ["a"], [(4, ["b", "a"]), (5, [])]), (2, ["c"], []), (3, None, None)]
    got = {tuple(r) for r in reports.result_lists(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(1, 4, 0, "b"), (1, 4, 1, "a"), (1, 5, None, None), (2, None, 0, "c"), (3, None, None, None)}


def test_position_bias_leaves_spoilt_lists_out(spark):
    kind = "user_id long, permutation_index int, item_id string, input_position int, output_rank int"
    rows = [(1, 1, "a", 0, 1), (1, 1, "b", 1, 0), (2, 1, "a", 0, 0), (2, 1, "b", 1, None)]
    r = reports.position_bias(spark.createDataFrame(rows, kind), 1).first()
    assert (r["num_users"], r["num_lists"], r["num_observations"], r["exposure"], r["expected"]) == (2, 1, 2, [0.0, 1.0], [0.5, 0.5])
    empty = reports.position_bias(spark.createDataFrame([], kind), 1).first()
    assert empty["exposure"] == [] and empty["max_abs_deviation"] is None


def test_evaluation_short_and_full(spark):
    kind = "user_id long, permutation_index int, item_id string, input_position int, output_rank int, score double"
    rows = [(1, p, i, a, a if p == 1 else 1 - a, 0.0) for p in (1, 2) for a, i in enumerate("ab")]
    runs, truth = spark.createDataFrame(rows, kind), spark.createDataFrame([(1, "a")], "user_id long, item_id string")
    short, full = reports.evaluation(runs, truth, 1).first().asDict(), reports.evaluation(runs, truth, 1, full=True).first().asDict()
    assert (short["num_users"], short["hit_rate"], short["mean_tau"]) == (1, 0.5, -1.0) and set(short) < set(full)


def test_causal_mask_and_dispatch(spark):
    df = spark.createDataFrame([(1, 0, "w", 1), (1, 1, "w", 1), (1, 2, "PAD", 0)], "request_id int, pos int, kind string, mask int")
    assert {(r["q"], r["k"]) for r in marker.attention_mask(df, "causal").collect()} == {(0, 0), (1, 0), (1, 1), (2, 0), (2, 1)}
    for f, bad in ((marker.attention_mask, "x"), (marker.position_ids, "y")):
        with pytest.raises(ValueError):
            f(df, bad)


def test_orders_of_several_lists():
    from rankweave.functions.scoring import from_orders

    by_name = from_orders(lambda lists: [sorted(shown) for _, shown in lists])
    assert by_name([("u", ["b", "a"]), ("v", ["c"])]) == [[1.0, 2.0], [1.0]]
    with pytest.raises(ValueError, match="2 lists, 1 orders"):
        from_orders(lambda lists: [["a"]])([("u", ["a"]), ("v", ["b"])])
    with pytest.raises(ValueError, match="twice"):
        from_orders(lambda lists: [["a", "a"]])([("u", ["a", "b"])])


def test_empty_ids_are_violations(spark):
    df = spark.createDataFrame([(1, ["a", ""], ["x", "y"], [0, 1]), (2, ["a", "b"], ["x", "y"], [1, 0])], "user_id long, items array<string>, titles array<string>, permutation array<int>")
    found = {r["rule"]: r["violations"] for r in reranking.request_violations(df).collect()}
    assert found == {"no_candidates": 0, "repeated_items": 0, "missing_ids": 1, "blank_titles": 0, "broken_order": 0}
