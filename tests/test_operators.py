"""Goldens and properties of operators that SQL can't hold, and of small inputs."""

import itertools
import json
import math
import random
import time
import tracemalloc

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankweave.functions import sampling, scoring
from rankweave.operators import aggregate, calibration, interaction, losses, marker, metrics, parsing, permutations, prep, prompts, retrieval
from rankweave.plans import catalogue
from rankweave.sources import artifacts, readers
from rankweave.streaming.exposure import exposure_counters


def test_random_orders_are_unique_and_bounded():
    for n in range(1, 5):
        total = len(list(itertools.permutations(range(n))))
        got = permutations.random_orders(n, total)
        assert got[0] == list(range(n)) and len({tuple(o) for o in got}) == total
        with pytest.raises(ValueError):
            permutations.random_orders(n, total + 1)
    assert [0, 1, 2] not in permutations.random_orders(3, 5, include_identity=False)


def test_sweep_holds_the_item_at_each_position():
    got = permutations.sweep_orders(3, 1, 2)
    assert [p for p, _ in got] == [0, 0, 1, 1, 2, 2]
    assert all(o[p] == 1 and sorted(o) == [0, 1, 2] for p, o in got)


def test_templates():
    assert permutations.template_orders(2, [[1, 0]]) == [[1, 0]]
    for bad in ([0], [0, 0], [2, None]):
        with pytest.raises(ValueError):
            permutations.completion(2, bad, random.Random(0))


@given(st.lists(st.text(max_size=3), min_size=2, max_size=6, unique=True), st.integers(0, 9))
@settings(max_examples=40, deadline=None)
def test_reshuffled_avoids_the_original(items, seed):
    got = permutations.reshuffled(items, seed)
    assert sorted(got) == sorted(items)


def test_json_object():
    f = parsing.json_object
    assert f('{"rank_order": ["C1"]}') == {"rank_order": ["C1"]}
    assert f('x\n```json\n{"a": 1}\n```') == {"a": 1}
    assert f('so {"a": {"b": 2}} it is') == {"a": {"b": 2}}
    assert f("[1]") is None and f("none") is None and f(None) is None


def test_rank_order_of_odd_outputs(spark):
    rows = [(1, '{"rank_order": "C0"}'), (2, None), (3, '{"rank_order": [" C0 ", 1]}')]
    got = {r["i"]: r["x"] for r in spark.createDataFrame(rows, "i int, t string").select("i", parsing.rank_order(F.col("t")).alias("x")).collect()}
    assert got[1] is None and got[2] is None and list(got[3]) == ["C0", "1"]


def test_classify_labels_over_the_required_count(spark):
    said = spark.createDataFrame([(1, i, x) for i, x in enumerate(["C0", "C0", "C1", "C2", "C2", "zz"])], "u int, pos int, label string")
    expected = spark.createDataFrame([(1, f"C{i}") for i in range(3)], "u int, label string")
    got = [r["kind"] for r in parsing.classify_labels(said, expected, ["u"], 2).orderBy("pos").collect()]
    assert got == ["valid", "duplicate", "valid", "unknown", "unknown", "unknown"]


def test_validate_ranking_counts_second_mentions_first(spark):
    said = spark.createDataFrame([(1, i, x) for i, x in enumerate(["b", "zz", "zz", "b"])], "u int, pos int, item_id string")
    valid = spark.createDataFrame([(1, i, x) for i, x in enumerate("abc")] + [(2, 0, "a")], "u int, pos int, item_id string")
    got = {r["u"]: r for r in parsing.validate_ranking(said, valid, ["u"]).collect()}
    assert got[1]["reranked_item_ids"] == ["b", "a", "c"]
    assert (got[1]["num_invalid"], got[1]["num_duplicate"], got[1]["num_missing"]) == (1, 2, 2)
    assert got[2]["reranked_item_ids"] == ["a"]


def runs_of(spark, lists):
    rows = [(u, p, x, r, r, float(-r)) for u, p, items in lists for r, x in enumerate(items)]
    return spark.createDataFrame(rows, "user_id int, permutation_index int, item_id string, input_position int, output_rank int, score double")


def test_rank_correlations(spark):
    runs = runs_of(spark, [(1, 1, "abc"), (1, 2, "abc"), (2, 1, "abc"), (2, 2, "cba"), (3, 1, "a"), (3, 2, "a"), (4, 1, "abc")])
    assert {r[0]: r[1] for r in metrics.kendall(runs).collect()} == {1: 1.0, 2: -1.0, 3: 1.0}
    assert {r[0]: round(r[1], 9) for r in metrics.spearman(runs).collect()} == {1: 1.0, 2: -1.0, 3: 1.0}


def test_effectiveness_of_users_without_truth(spark):
    runs = runs_of(spark, [(1, 1, "abc"), (2, 1, "abc")])
    truth = spark.createDataFrame([(1, "b"), (1, "z")], "user_id int, item_id string")
    got = metrics.effectiveness(runs, truth, 2).first()
    assert (got["hit_rate"], got["recall"], got["mrr"]) == (0.5, 0.5, 0.25)
    empty = metrics.effectiveness(runs.limit(0), truth, 2).first()
    assert tuple(empty) == (0.0, 0.0, 0.0, 0.0)


def test_local_search_ends_at_no_cost_when_all_agree():
    prefs = {("a", "b"): 0.0, ("a", "c"): 0.0, ("b", "c"): 0.0}
    assert metrics.local_search(prefs) == 0.0
    cycle = {("a", "b"): 1.0, ("b", "c"): 1.0, ("a", "c"): 0.0}
    assert metrics.local_search(cycle) == pytest.approx(1 / 3)


def test_calibrator():
    c = aggregate.Calibrator([[3, 1], [1, 1]])
    assert np.allclose(c.update(np.array([0.5, 0.5]), 0), [0.6, 0.4])
    assert np.allclose(aggregate.Calibrator([[1, 0], [1, 0]]).update(np.array([0.5, 0.5]), 1), [0.5, 0.5])
    for bad in ([[1, 2]], [[-1, 2], [1, 1]], [[0, 0], [1, 1]], []):
        with pytest.raises(ValueError):
            aggregate.Calibrator(bad)


def test_methods_give_permutations_and_follow_a_fair_scorer():
    ids = list("dacb")
    fair = lambda user, shown: [-ord(x) for x in shown]
    best = [1, 3, 2, 0]
    assert aggregate.bootstrapping(fair, "u", ids, range(4), 1) == best
    assert aggregate.greedy_selection(fair, "u", ids, range(4), 1, 3) == best
    assert aggregate.stella(fair, aggregate.Calibrator(np.eye(4) * 4 + 1), "u", ids, list(range(4)), 1)[0] == 1
    flat = aggregate.Calibrator(np.ones((4, 4)))
    assert aggregate.stella(fair, flat, "u", ids, list(range(4)), 1) == best  # nothing learnt: the raw ranking


def test_interaction_is_antisymmetric_and_equivariant():
    rng = np.random.default_rng(0)
    x, b, w = rng.normal(size=(5, 8)), rng.normal(size=5), interaction.random_weights(8)
    c = interaction.relational_correction(x, b, w)
    assert abs(c.sum()) < 1e-12
    p = rng.permutation(5)
    assert np.allclose(interaction.relational_correction(x[p], b[p], w), c[p])
    assert interaction.relational_correction(x[:1], b[:1], w) == [0.0]


def test_correlations_of_zero_have_the_sign_of_a_running_covariance(spark):
    """Against corr in DuckDB over the same ranks; items are named in another order than they are ranked."""
    rng = np.random.default_rng(4)
    x = np.arange(8.0)
    lists = [y for y in (rng.permutation(8) for _ in range(4000)) if ((x - 3.5) * (y - 3.5)).sum() == 0]
    names = [rng.permutation(8) for _ in lists]
    rows = [(q, p, f"i{names[q][at]}", int(rank)) for q, y in enumerate(lists) for p, ranks in ((1, range(8)), (2, y)) for at, rank in enumerate(ranks)]
    got = metrics.correlation_values(spark.createDataFrame(rows, "user_id long, permutation_index int, item_id string, output_rank int"))
    sign = {r["user_id"]: math.copysign(1, r["rho"]) for r in got.collect() if r["rho"] == 0}
    con = duckdb.connect()
    corr = lambda y: con.sql("SELECT corr(x, y) FROM (VALUES " + ", ".join(f"({i}, {v})" for i, v in enumerate(y)) + ") AS t(x, y)").fetchall()[0][0]
    want = {q: math.copysign(1, corr(y)) for q, y in enumerate(lists)}
    assert sign == want and set(want.values()) == {1.0, -1.0}


def test_lightgcn_learns():
    rng = np.random.default_rng(1)
    pairs = np.unique(np.array([(u, 2 * i + u % 2) for u in range(20) for i in rng.integers(0, 10, 6)]), axis=0)
    users, items, loss = retrieval.lightgcn_fit(pairs, 20, 20, dim=8, epochs=60, batch=32, lr=0.02)
    assert loss[-1] < loss[0]
    own = [(users[u] @ items.T)[u % 2 :: 2].mean() - (users[u] @ items.T)[1 - u % 2 :: 2].mean() for u in range(20)]
    assert np.mean(own) > 0
    retrieval.lightgcn_fit(np.array([[0, 0], [0, 1]]), 1, 2, dim=2, epochs=1, tries=3)  # a user who has seen all


def test_lightgcn_sums_are_the_same_for_small_and_large_graphs(monkeypatch):
    pairs = np.unique(np.random.default_rng(3).integers(0, 30, (200, 2)), axis=0)
    small = retrieval.lightgcn_fit(pairs, 31, 30, dim=8, epochs=3, batch=64)
    monkeypatch.setattr(retrieval, "DENSE_CELLS", 0)
    assert all(np.allclose(x, y) for x, y in zip(small, retrieval.lightgcn_fit(pairs, 31, 30, dim=8, epochs=3, batch=64), strict=True))


@pytest.mark.parametrize("n_users, n_items", [(40, 7), (7, 40), (12, 12)])
@pytest.mark.parametrize("layers", [0, 1, 3, 4])
def test_lightgcn_learns_the_same_in_all_forms_of_a_graph(monkeypatch, n_users, n_items, layers):
    rng = np.random.default_rng(n_users + layers)
    pairs = np.unique(np.stack([rng.integers(0, n_users - 1, 90), rng.integers(0, n_items - 1, 90)], axis=1), axis=0)  # the last of each side has no pair
    fit = lambda: retrieval.lightgcn_fit(pairs, n_users, n_items, dim=5, layers=layers, epochs=4, batch=16, lr=0.01, tries=3)
    want = fit()
    monkeypatch.setattr(retrieval, "DENSE_CELLS", 0)
    monkeypatch.setattr(retrieval, "PART_CELLS", 60)
    narrow = fit()
    monkeypatch.setattr(retrieval, "NARROW", 0)
    for got in (narrow, fit()):
        assert all(np.allclose(x, y, rtol=1e-9, atol=1e-12) for x, y in zip(got, want, strict=True))


@pytest.mark.parametrize("narrow", [0, 2048])
def test_lightgcn_makes_no_vector_for_each_edge(monkeypatch, narrow):
    rng = np.random.default_rng(0)
    key = np.sort(rng.choice(3000 * 100, 60_000, replace=False))
    monkeypatch.setattr(retrieval, "DENSE_CELLS", 0)
    monkeypatch.setattr(retrieval, "NARROW", narrow, raising=False)
    tracemalloc.start()
    try:
        retrieval.lightgcn_fit(np.stack([key // 100, key % 100], axis=1), 3000, 100, batch=4096, epochs=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60_000_000  # 120,000 edges of 64 values are 61 MB, and were there twice


def test_lightgcn_graph_and_vectors_go_over_arrow(spark):
    log = spark.createDataFrame([(3, 1), (0, 7), (3, 0), (3, 1), (0, 2)], "user_id int, item_id int")
    assert retrieval.graph_pairs(log).tolist() == [[0, 2], [0, 7], [3, 0], [3, 1]]
    frame = retrieval.vector_frame(spark, np.arange(12.0).reshape(6, 2)[::2], "item_id")
    assert frame.dtypes == [("item_id", "bigint"), ("vec", "array<double>")]
    assert sorted(map(tuple, frame.collect())) == [(0, [0.0, 1.0]), (1, [4.0, 5.0]), (2, [8.0, 9.0])]


@pytest.mark.parametrize("n_users, n_items", [(40, 7), (7, 40)])
@pytest.mark.parametrize("layers", [0, 1, 2, 3, 4])
def test_lightgcn_layers_come_from_two_products(n_users, n_items, layers):
    rng = np.random.default_rng(layers)
    u, i = np.unique(np.stack([rng.integers(0, n_users, 90), n_users + rng.integers(0, n_items, 90)]), axis=1)
    w, x = rng.random(len(u)), rng.normal(size=(n_users + n_items, 3))
    total, step = x.copy(), x
    for _ in range(layers):
        last, step = step, np.zeros_like(x)
        np.add.at(step, u, w[:, None] * last[i])
        np.add.at(step, i, w[:, None] * last[u])
        total += step
    assert np.allclose(retrieval._spread(u, i, w, n_users, n_items, layers)(x), total / (layers + 1))


def test_lambda_rank_loss_meets_groups_and_not_rows(spark):
    """Against all pairs in plain Python, with equal scores, a null relevance and a null score; and 20,000 rows of one request, which are 2e8 pairs."""
    rng = random.Random(5)
    data = [("a", i, rng.choice([0.1, 0.2, 0.3, 0.7]), rng.randint(0, 3)) for i in range(60)] + [("b", i, rng.random(), rng.choice([0, 1, None])) for i in range(30)]
    data += [("c", 0, 1.0, 2), ("c", 1, 1.0, 2), ("d", 0, 0.5, 1), ("d", 1, None, 0), ("e", 0, 0.5, 0), ("e", 1, 0.5, 1), ("e", 2, 0.5, 2)]
    want = {"c": 0.0, "d": None}
    for q in "abe":
        rows = [x[1:] for x in data if x[0] == q]
        d = {x[0]: 1 / math.log2(r + 2) for r, x in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
        rows = [x for x in rows if x[2] is not None]
        ideal = sum((2.0 ** x[2] - 1) / math.log2(r + 2) for r, x in enumerate(sorted(rows, key=lambda x: (-x[2], x[0]))))
        terms = [abs((2.0 ** a[2] - 2.0 ** b[2]) * (d[a[0]] - d[b[0]])) / ideal * math.log1p(math.exp(b[1] - a[1])) for a in rows for b in rows if a[2] > b[2]]
        want[q] = sum(terms) / len(terms)
    kind = "request_id string, position int, score double, relevance int"
    got = {r["request_id"]: r["loss"] for r in losses.lambda_rank_loss(spark.createDataFrame(data, kind)).collect()}
    assert got == pytest.approx(want)
    many = spark.range(20_000).select(F.lit("m").alias("request_id"), F.col("id").alias("position"), (F.pmod(F.hash("id"), F.lit(50)) / 50.0).alias("score"), (F.col("id") % 4).cast("int").alias("relevance"))
    began = time.monotonic()
    assert losses.lambda_rank_loss(many).first()["loss"] > 0 and time.monotonic() - began < 45


def test_interaction_of_many_lists_at_once(spark):
    """Lists of several lengths in one batch, against the network written out pair by pair; 3,000 lists of 8 in seconds."""
    rng, w = np.random.default_rng(2), interaction.random_weights(8)
    plain = lambda x: np.array([0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x])
    mlp = lambda x, q: plain(x @ q["w1"] + q["b1"]) @ q["w2"] + q["b2"]
    rows, want = [], {}
    for q, n in enumerate([1, 4, 2, 4, 7]):
        x, base = rng.normal(size=(n, 8)), rng.normal(size=n)
        rows += [(q, f"i{k}", float(base[k]), x[k].tolist()) for k in range(n)]
        v = ((x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)) @ w["project"]
        pair = lambda i, j, v=v, base=base: float((mlp(np.concatenate([v[i], v[j], v[i] - v[j], v[i] * v[j], [base[i] - base[j]]]), w["relation"]) @ w["compare"])[0])
        gate = lambda i, j, v=v: 1 / (1 + math.exp(-float(mlp(np.concatenate([v[i] + v[j], abs(v[i] - v[j]), v[i] * v[j], v.mean(0)]), w["gate"])[0])))
        want |= {(q, f"i{i}"): 0.1 * sum(gate(i, j) * (pair(i, j) - pair(j, i)) for j in range(n) if j != i) / max(1, n - 1) for i in range(n)}
    lists = spark.createDataFrame(rows, "request_id int, item_id string, score double, vec array<double>")
    got = {(r["request_id"], r["item_id"]): r["correction"] for r in interaction.correct_scores(lists, w).collect()}
    assert got == pytest.approx(want, abs=1e-13)
    z = np.concatenate([rng.normal(0, 3, 9000), [0.0, -0.0, 9.5, -9.5, 40.0, 1e-300]])
    assert np.abs(interaction.gelu(z) - [0.5 * v * math.erfc(-v / math.sqrt(2)) for v in z]).max() < 1e-14 and np.isnan(interaction.gelu(np.array([np.nan]))[0])
    x, base = rng.normal(size=(3000, 8, 8)), rng.normal(size=(3000, 8))
    began = time.monotonic()
    interaction.relational_corrections(x, base, w)
    assert time.monotonic() - began < 3


@pytest.mark.parametrize("mode", ["kl", "jeffreys"])
def test_permutation_loss_reads_its_lists_once(spark, mode):
    made = spark.sparkContext.accumulator(0)

    def noted(it):
        for b in it:
            made.add(len(b))
            yield b

    rng = random.Random(1)
    lists = {(u, p): {f"i{i}": rng.random() * 5 for i in range(4 + (u == 3 and p == 2))} for u in range(1, 5) for p in range(1, 4) if u != 4 or p == 1}
    kind = "user_id int, permutation_index int, item_id string, score double"
    runs = spark.createDataFrame([(u, p, i, s) for (u, p), x in lists.items() for i, s in x.items()], kind).mapInPandas(noted, kind)
    got = {r["user_id"]: r["loss"] for r in losses.permutation_loss(runs, mode, 2.0).collect()}
    assert made.value == sum(map(len, lists.values()))

    def lp(x):
        z = math.log(sum(math.exp(x[f"i{i}"] / 2) for i in range(4)))
        return [x[f"i{i}"] / 2 - z for i in range(4)]

    term = {"kl": lambda a, b: math.exp(a) * (a - b), "jeffreys": lambda a, b: (math.exp(a) - math.exp(b)) * (a - b)}[mode]
    want = {u: sum(term(a, b) for p in (2, 3) for a, b in zip(lp(lists[u, 1]), lp(lists[u, p]), strict=True)) / 2 for u in (1, 2, 3)} | {4: 0.0}
    assert got == pytest.approx(want)


def test_recommend_of_a_user_who_has_seen_all(spark):
    users = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "user_id long, vec array<double>")
    items = spark.createDataFrame([(i, [1.0]) for i in range(3)], "item_id long, vec array<double>")
    seen = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "user_id long, item_id long")
    got = [(r["user_id"], r["item_id"], r["rank"]) for r in retrieval.recommend(users, items, seen, 5).orderBy("user_id", "rank").collect()]
    assert got == [(2, 1, 1), (2, 2, 2)]


@pytest.mark.parametrize("n", [3, 4, 7, 10, 29])
def test_temporal_split_has_no_empty_segment(spark, n):
    log = spark.createDataFrame([(1, i, 1.0, i) for i in range(n)], "user_id int, item_id int, rating double, ts int")
    got = [r["split"] for r in prep.temporal_split(log, 0.7, 0.1, 3, []).orderBy("ts").collect()]
    assert got == sorted(got, key=["train", "val", "test"].index) and set(got) == {"train", "val", "test"}
    assert prep.temporal_split(log.limit(2), 0.7, 0.1, 3, []).count() == 0


def test_list_prompt_of_fewer(spark):
    row = spark.createDataFrame([([], [("T", 1999, ["a", "b"])])], "h array<struct<title:string,year:int,rating:int,genres:array<string>>>, c array<struct<title:string,year:int,genres:array<string>>>")
    text = row.select(prompts.list_prompt(F.col("h"), F.col("c"), F.array(F.lit("C0")), 1).alias("x")).first()["x"]
    assert "No user history is available." in text and "[C0] T (1999), genres: a, b" in text


def test_lambda_rank_loss_of_equal_labels(spark):
    df = spark.createDataFrame([("r", i, float(i), 1) for i in range(3)], "request_id string, position int, score double, relevance int")
    assert losses.lambda_rank_loss(df).first()["loss"] == 0.0


def test_scorers():
    f = scoring.from_order(lambda user, shown: sorted(shown))
    assert f("u", ["b", "a"]) == [1.0, 2.0]
    with pytest.raises(ValueError):
        scoring.from_order(lambda user, shown: ["a", "a"])("u", ["a", "b"])
    for bad in ([1], [True, 1], [float("nan"), 1]):
        with pytest.raises(ValueError):
            scoring.from_scores(lambda user, shown, b=bad: b)("u", ["a", "b"])
    assert scoring.architecture_of("block", "shared", "relational") == "block_setwise"


def test_sampling(spark):
    users = spark.range(100, 150).select(F.col("id").alias("user_id"))
    ids = lambda df: sorted(r["user_id"] for r in df.collect())
    assert ids(sampling.select_users(users)) == list(range(100, 150))
    assert ids(sampling.select_users(users, 2)) == [100, 101]
    assert ids(sampling.select_users(users, 7, True)) == sorted(random.Random(42).sample(range(100, 150), 7))
    with pytest.raises(ValueError):
        sampling.select_users(users, 0)
    want = list(range(100, 150))
    random.Random(42).shuffle(want)
    assert [r["user_id"] for r in sampling.order_users(users, True).orderBy("place").collect()] == want


def naive_search(prefs):
    """Every swap's cost made anew."""
    items = sorted({i for pair in prefs for i in pair})
    over = lambda a, b: prefs[a, b] if (a, b) in prefs else 1 - prefs[b, a]
    order = sorted(items, key=lambda i: (-round(sum(over(i, j) for j in items if j != i), 9), i))
    cost = lambda o: sum(over(b, a) for i, a in enumerate(o) for b in o[i + 1 :])
    while True:
        trials = []
        for i in range(len(order)):
            for j in range(i + 1, len(order)):
                o = list(order)
                o[i], o[j] = o[j], o[i]
                trials.append(o)
        best = min(trials, key=lambda o: round(cost(o), 9))
        if cost(best) >= cost(order) - 1e-9:
            return cost(order) / (len(items) * (len(items) - 1) / 2)
        order = best


@pytest.mark.parametrize("seed", range(8))
def test_local_search_equals_the_naive_one(seed):
    rng = random.Random(seed)
    items = [f"i{k}" for k in range(7)]
    prefs = {(a, b): rng.randrange(6) / 5 for k, a in enumerate(items) for b in items[k + 1 :]}
    assert metrics.local_search(prefs) == pytest.approx(naive_search(prefs))


def test_null_ids_leave_long_ones_alone(spark):
    rows = spark.createDataFrame([(2**53 + 1, ["a", "b"]), (None, ["c", "d"])], "user_id long, items array<string>").coalesce(1)
    got = permutations.explode_orders(rows, lambda user, ids: [[1, 0]]).collect()
    assert {r["user_id"] for r in got} == {2**53 + 1, None}
    assert {r["user_id"] for r in aggregate.rerank(rows, lambda user, ids: [1, 0]).collect()} == {2**53 + 1, None}


def test_open_and_absent_markers(spark):
    rows = lambda kinds: spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "request_id int, pos int, kind string")
    got = marker.span_rows(rows(["SPAN", "/SPAN", "ITEM", "w", "/ITEM", "/ITEM", "ITEM", "ITEM", "/ITEM", "ITEM", "w"])).orderBy("item").collect()
    assert [(r["s"], r["e"]) for r in got] == [(2, 5), (6, 9)]
    for bad in (["ITEM", "/ITEM"], ["SPAN", "/SPAN", "ITEM"]):
        with pytest.raises(Exception, match="truncation"):
            marker.spans(rows(bad)).collect()


def test_effectiveness_counts_users_without_a_list(spark):
    runs = spark.createDataFrame([(1, 1, "a", 0), (1, 1, "b", 1)], "user_id int, permutation_index int, item_id string, output_rank int")
    truth = spark.createDataFrame([(1, "a"), (2, "a")], "user_id int, item_id string")
    assert tuple(metrics.effectiveness(runs, truth, 2).first()) == (0.5, 0.5, 0.5, 0.5)


def test_jeffreys_adds_both_directions(spark):
    s = {1: [2.0, 1.0, 0.0], 2: [0.5, 1.5, 0.0]}
    runs = spark.createDataFrame([(1, p, f"i{k}", x) for p, v in s.items() for k, x in enumerate(v)] + [(9, 1, "i0", 1.0)], "user_id int, permutation_index int, item_id string, score double")
    p, q = ([math.exp(x) / sum(map(math.exp, v)) for x in v] for v in s.values())
    want = sum(a * math.log(a / b) + b * math.log(b / a) for a, b in zip(p, q))
    got = {r["user_id"]: r["loss"] for r in losses.permutation_loss(runs, "jeffreys").collect()}
    assert got[1] == pytest.approx(want) and got[9] == 0.0


def test_readers(spark, tmp_path):
    d = f"file://{tmp_path}"
    (tmp_path / "ratings.dat").write_text("1::2::3.5::100\n2::3::4::200\n")
    assert [tuple(r) for r in readers.read_movielens_ratings(spark, d).orderBy("user_id").collect()] == [(1, 2, 3.5, 100), (2, 3, 4.0, 200)]
    assert readers.read_movielens_movies(spark, d).count() == 0
    (tmp_path / "movies.dat").write_bytes("1::Caf\xe9 (1999)::Drama|War\n".encode("latin-1"))
    assert tuple(readers.read_movielens_movies(spark, d).first()) == (1, "Café (1999)", "Drama|War")
    (tmp_path / "reviews.jsonl").write_text("\n".join(json.dumps(r) for r in [{"user_id": "u", "parent_asin": "007", "rating": 5, "timestamp": 1}, {"user_id": "v", "rating": 1}]))
    assert [tuple(r) for r in readers.read_amazon_reviews(spark, d).collect()] == [("u", "007", 5.0, 1)]
    with pytest.raises(FileNotFoundError):
        readers.first_file(spark, d, "no.csv", [])
    (tmp_path / "x.csv").write_text("user_id,item_id\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_interactions(spark, f"{d}/x.csv")


def test_artifacts(spark, tmp_path):
    users = spark.createDataFrame([("u", [(1, ["a", "b"], ["b", "a"])])], "user_id string, permutations array<struct<permutation_index:int,input:array<string>,output:array<string>>>")
    got = [tuple(r) for r in artifacts.runs_from_artifact(users).orderBy("output_rank").collect()]
    assert got == [("u", 1, "b", 1, 0, 2.0), ("u", 1, "a", 0, 1, 1.0)]
    artifacts.write_jsonl(users, f"file://{tmp_path}/x")
    assert artifacts.read_candidates(spark, f"file://{tmp_path}/x", users.schema).collect() == users.collect()
    kept = spark.createDataFrame([([(1, 2, 3)], {"raw_output": "x", "y": "z"}, "r")], "a array<struct<prompt_text:int,b:int,raw_output:int>>, m map<string,string>, raw_response string")
    assert artifacts.without_fields(kept).columns == ["a", "m", "raw_response"] and artifacts.without_fields(kept).first()["a"][0].asDict() == {"b": 2, "raw_output": 3}
    slim = artifacts.without_fields(kept, raw=False)
    assert slim.columns == ["a", "m"] and slim.first()["a"][0].asDict() == {"b": 2} and slim.first()["m"] == {"y": "z"}
    assert artifacts.without_fields(kept, prompts=True).first()["a"][0].asDict() == {"prompt_text": 1, "b": 2, "raw_output": 3}
    assert artifacts.candidate_path("d", "test", 25, 10, True) == "d/test_k25_users10_gt_only.json"
    with pytest.raises(ValueError):
        artifacts.dataset_settings({"datasets": {"a": {}}}, "b")


def test_streaming_exposure(spark, tmp_path):
    rows = spark.createDataFrame([(["a", "b"], ["b", "a"]), (["a", "b"], ["a", "b"])], "input array<string>, output array<string>")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = exposure_counters(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), 1)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("exposed").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/ck").start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("exposed").collect()} == {(0, 2, 1, 1.0), (1, 2, 1, 1.0)}


def test_calibration_requests(spark):
    rows = spark.createDataFrame([(u, p, f"i{p}") for u in (1, 2, 3) for p in range(4)], "user_id long, pos int, item_id string")
    truth = spark.createDataFrame([(1, "i2"), (1, "i2"), (2, "i0"), (2, "i3"), (3, "elsewhere"), (None, "i1")], "user_id long, item_id string")
    got = calibration.calibration_requests(rows, truth, 4, repeats=3, seed=7).collect()
    assert sorted((r["user_id"], r["target"], r["true_pos"], r["repeat"]) for r in got) == [(u, t, p, k) for u, t in ((1, 2), (2, 0), (2, 3)) for p in range(4) for k in range(3)]
    for r in got:
        others = [i for i in range(4) if i != r["target"]]
        random.Random(7 + r["user_id"] * 1_000_003 + r["true_pos"] * 1009 + r["repeat"]).shuffle(others)
        assert r["permutation"][r["true_pos"]] == r["target"] and [x for x in r["permutation"] if x != r["target"]] == others
    assert calibration.calibration_requests(rows.limit(0), truth, 4).count() == 0
    with pytest.raises(ValueError):
        calibration.calibration_requests(rows, truth, 0)


def test_stored_calibration(tmp_path):
    m = [[3.0, 1.0], [0.0, 2.0]]
    np.save(tmp_path / "m.npy", m)
    (tmp_path / "list.json").write_text(json.dumps(m))
    said = dict(model_name_or_path="m", scoring="s", prompt="p", architecture=None, adapter_path=" ", candidate_count="2")
    (tmp_path / "map.json").write_text(json.dumps({"matrix": m, "provenance": said}))
    (tmp_path / "none.json").write_text("{}")
    for name in ("m.npy", "list.json", "map.json"):
        found, provenance = calibration.load_calibrator(str(tmp_path / name))
        assert found.matrix.tolist() == [[0.75, 0.25], [0.0, 1.0]] and provenance == (said if name == "map.json" else {})
    with pytest.raises(ValueError):
        calibration.load_calibrator(str(tmp_path / "none.json"))
    calibration.check_provenance(said, dict(said, adapter_path=None, candidate_count=2))
    for bad in (dict(said, prompt="q"), dict(said, candidate_count=3)):
        with pytest.raises(ValueError):
            calibration.check_provenance(said, bad)
    with pytest.raises(ValueError):
        calibration.check_provenance({}, said)


def test_split_by_name(spark):
    log = spark.createDataFrame([(1, i, i) for i in range(10)], "user_id long, item_id long, ts long")
    count = lambda s: {r["split"]: r["count"] for r in prep.split_interactions(log, s, 3, []).groupBy("split").count().collect()}
    assert count("leave_one_out") == {"train": 8, "val": 1, "test": 1}
    assert count("temporal_ratio") == count("temporal_70_10_20") == {"train": 7, "val": 1, "test": 2}
    with pytest.raises(ValueError):
        prep.split_interactions(log, "random", 3, [])


def test_figures_of_users_come_from_one_reading_of_runs_that_stay_where_they_are(spark):
    rows = [(u, p, f"i{i}", (i * (p + u)) % 5, 10 - i) for u in range(40) for p in (1, 2, 3) for i in range(5)]
    rows += [(90, 1, "a", 0, 1), (91, 1, "a", 0, 1), (91, 2, "b", 0, 1), (None, 1, "a", 0, 1), (None, 2, "a", 0, 1)]
    runs = spark.createDataFrame(rows, "user_id long, permutation_index int, item_id string, output_rank int, score int").repartition(4, "user_id")
    truth = spark.createDataFrame([(u, "i1") for u in range(0, 40, 2)] + [(91, "b")], "user_id long, item_id string").repartition(4, "user_id")
    out = metrics.robustness_by_user(runs, truth, 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2  # runs and truth, each once
    got = {r["user_id"]: r for r in out.collect()}
    assert len(got) == 43
    assert (got[90]["num_pairs"], got[90]["mean_tau"], got[90]["jaccard"]) == (0, None, None)
    assert (got[91]["mean_tau"], got[91]["jaccard"], got[91]["mean_rank"], got[91]["rank_std"]) == (None, 0.0, 1.0, 0.0)
    assert (got[None]["num_permutations"], got[None]["mean_tau"], got[None]["same_top"]) == (2, None, None)
    by_pair = {r["user_id"]: r for r in metrics.correlations(runs).collect()}
    assert all(by_pair[u]["mean_tau"] == got[u]["mean_tau"] and by_pair[u]["mean_rho"] == got[u]["mean_rho"] for u in range(40))


def dealt_lists(spark):
    """Runs, their truth and scored runs, in 8 partitions by user_id."""
    rng = random.Random(5)
    rows = [(u, p, f"i{i}", place, rng.randrange(6), r) for u in range(30) for p in (1, 2, 3) for place, (i, r) in enumerate(zip(rng.sample(range(7), 5), rng.sample(range(5), 5), strict=True))]
    runs = spark.createDataFrame(rows, "user_id long, permutation_index int, item_id string, input_position int, score int, output_rank int").repartition(8, "user_id")
    truth = spark.createDataFrame([(u, f"i{i}") for u in range(33) for i in range(u % 3)], "user_id long, item_id string").repartition(8, "user_id")
    return rows, runs, truth


def dealt_again(df):
    """The exchanges by other keys than the fixture's own two."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]


def test_effectiveness_leaves_lists_where_they_are(spark):
    rows, runs, truth = dealt_lists(spark)
    per = metrics.per_list_effectiveness(runs, truth, 3)
    assert not dealt_again(per)
    got = {(r["user_id"], r["permutation_index"]): r for r in per.collect()}
    assert len(got) == 90 + 2 and (got[31, None]["hit_rate"], got[31, None]["recall"]) == (0.0, 0.0)
    for u, p in itertools.product(range(30), (1, 2, 3)):
        true = {f"i{i}" for i in range(u % 3)}
        ranks = sorted(r for (a, b, i, _, _, r) in rows if (a, b) == (u, p) and i in true and r < 3)
        ideal = sum(1 / math.log2(x + 2) for x in range(len(true)))
        assert got[u, p]["mrr"] == (1 / (ranks[0] + 1) if ranks else 0.0)
        assert got[u, p]["recall"] == (len(ranks) / len(true) if true else None)
        assert got[u, p]["ndcg"] == (pytest.approx(sum(1 / math.log2(x + 2) for x in ranks) / ideal) if true else None)


def test_a_validation_reads_its_lists_once_and_leaves_them_where_they_are(spark):
    rows, runs, truth = dealt_lists(spark)
    scored = retrieval.relevance(runs, truth).select(F.col("user_id").alias("request_id"), "permutation_index", "item_id", F.col("input_position").alias("position"), "score", "relevance")
    out = metrics.validation(scored)
    assert not dealt_again(out) and out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    got, hits, ndcg, rhos = out.first(), [], [], []
    for u in range(30):
        lists = [sorted((r for r in rows if r[:2] == (u, p)), key=lambda r: (-r[4], r[3])) for p in (1, 2, 3)]
        found = [int(int(r[2][1:]) < u % 3) for r in lists[0]]
        dcg = lambda x: sum(v / math.log2(i + 2) for i, v in enumerate(x))
        hits.append(max(found))
        ndcg.append(dcg(found) / dcg(sorted(found, reverse=True)) if any(found) else 0.0)
        shared = sorted(set.intersection(*({r[2] for r in l} for l in lists)))
        at = [[[r[2] for r in l if r[2] in shared].index(i) for i in shared] for l in lists]
        n = len(shared)
        rhos += [1 - 6 * sum((a - b) ** 2 for a, b in zip(at[0], x, strict=True)) / (n * (n * n - 1)) for x in at[1:] if n > 1]
    assert got["hr_5"] == got["hr_10"] == pytest.approx(sum(hits) / 30) and got["ndcg_5"] == pytest.approx(sum(ndcg) / 30)
    assert rhos and got["perm_spearman"] == pytest.approx(sum(rhos) / len(rhos))


def test_initial_cost_leaves_preferences_where_they_are(spark):
    _, runs, _ = dealt_lists(spark)
    prefs = metrics.pair_preferences(runs)
    out = metrics.gpi_initial_cost(prefs)
    assert not dealt_again(out)
    got, of = {r["user_id"]: r["initial_cost"] for r in out.collect()}, {}
    for r in prefs.collect():
        of.setdefault(r["user_id"], {})[r["x"], r["y"]] = r["p"]
    assert len(got) == 30
    for u, pairs in of.items():
        win = {}
        for (x, y), p in pairs.items():
            win[x], win[y] = win.get(x, 0) + p, win.get(y, 0) + 1 - p
        place = {i: n for n, i in enumerate(sorted(win, key=lambda i: (-round(win[i], 9), i)))}
        assert got[u] == pytest.approx(sum(1 - p if place[x] < place[y] else p for (x, y), p in pairs.items()) / len(pairs))


#: Rows of odd lists: an item twice, one that a list lacks, a rank or a key that is missing.
ODD = [
    *[(1, 1, i, r) for r, i in enumerate("cabda")], *[(1, 2, i, r) for r, i in enumerate("acb")], (1, None, "a", 0), (1, None, "b", 1), (1, 3, "b", None), (1, 3, "c", 0), (1, 3, None, 1),
    (None, 1, "a", 0), (None, 1, "b", 1), *[(2, p, i, r) for p in (1, 2) for r, i in enumerate(["\U0001f600", "\uffee", "z"][::p * 2 - 3])], (3, 1, "a", 0),
]
ODD_ROWS = "user_id long, permutation_index int, item_id string, output_rank int"


@pytest.mark.parametrize("cells", [1, 1 << 18])
def test_preferences_of_odd_lists_are_those_of_the_sql(spark, cells):
    df = spark.createDataFrame(ODD + [(u + 10, p, i, r) for u, p, i, r in ODD if u], ODD_ROWS)
    con = duckdb.connect()
    con.register("runs", df.toArrow())
    said = con.sql(catalogue.PREFS + " SELECT user_id, x, y, p FROM pr").fetchall()
    assert sorted(map(tuple, metrics.preferences_of_lists(df.coalesce(1), cells).collect())) == sorted(said) and len(said) == 18


def test_the_query_of_preferences_makes_a_pair_once_a_user(spark):
    out = catalogue.QUERIES["pair_preferences"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not dealt_again(out) and plan.count("ArrowEvalPython") == 1
    # nothing is aggregated by pair: the only keys are users
    assert {line.partition("keys=[")[2].partition("]")[0].partition("#")[0] for line in plan.splitlines() if "Aggregate(" in line} == {"user_id"}
    assert not any("keys=[user_id" in line and "," in line.partition("keys=[")[2].partition("]")[0] for line in plan.splitlines())


def swapped_cost(items, share):
    """local_search() as it is said: the order by win score, then the swap that lowers the cost most, as long as one does."""
    cost = lambda o: sum(share[b, a] for a, b in itertools.combinations(o, 2))
    order = sorted(items, key=lambda i: (-round(sum(share[i, j] for j in items if j != i), 9), i))
    while len(order) > 1:
        swaps = []
        for i, j in itertools.combinations(range(len(order)), 2):
            other = order.copy()
            other[i], other[j] = other[j], other[i]
            swaps.append((cost(other), other))
        least = min(c for c, _ in swaps)
        if least >= cost(order) - 1e-9:
            break
        order = next(o for c, o in swaps if c < least + 1e-9)
    return cost(order) / (len(order) * (len(order) - 1) / 2)


@pytest.mark.parametrize("cells", [1, 100, 1 << 18])
def test_users_are_searched_together_and_stay_where_they_are(spark, cells):
    rng = random.Random(3)
    orders = {u: [rng.sample(range(2 + u % 6), 2 + u % 6) for _ in range(1 + u % 4)] for u in range(60)}
    rows = [(u, p, f"i{i}", r) for u, lists in orders.items() for p, l in enumerate(lists) for r, i in enumerate(l)]
    # an item that is missing, a list without an index and a user without a pair
    odd = [(0, 0, None, 9), (0, None, "i0", 3), (60, 0, "a", 0), (60, 1, "b", 0)]
    runs = spark.createDataFrame(rows + odd, ODD_ROWS).repartition(8, "user_id")
    out = metrics.gpi_of_lists(runs, cells)
    assert not dealt_again(out)
    got = {r["user_id"]: r["gpi"] for r in out.collect()}
    assert set(got) == set(orders)
    for u, lists in orders.items():
        n = len(lists[0])
        share = {(a, b): sum(l.index(a) < l.index(b) for l in lists) / len(lists) for a in range(n) for b in range(n) if a != b}
        assert got[u] == pytest.approx(swapped_cost(range(n), share))
