"""All queries of the engine's own operators and the SQL that says the same, over the fixtures of fixtures.py.

Rates and means are rounded on both sides: the order of floating-point sums differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.functions import sampling
from rankweave.operators import aggregate, calibration, datasets, evidence, interaction, losses, marker, metadata, metrics, negatives, parsing, permutations, prep, prompts, records, reports, reranking, retrieval, templates
from rankweave.plans import fixtures as X

K = 3
DIGITS = 7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **tables: str):
    """Registers f(spark, fixture tables...) under a name; in its SQL the fixtures' names are common table expressions."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, **{k: X.spark_table(spark, sf_dir, t) for k, t in tables.items()})

        QUERIES[name] = run
        if sql:
            ctes = [f"{k} AS ({X.duck(t)})" for k, t in tables.items()]
            body = sql.strip()
            SQL[name] = "WITH " + ", ".join(ctes) + (", " + body[5:] if body.startswith("WITH ") else " " + body)
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in names})


LOG, ORDERS, ITEMS, RUNS, TRUTH, DAMAGED, LABELLED, TOKENS = X.INTERACTIONS, X.RAW_ORDERS, X.ITEMS, X.RUNS, X.TRUTH, X.DAMAGED, X.LABELLED, X.TOKENS
CUSTOMERS = "SELECT c_custkey AS user_id FROM {customer}"
USERS = "SELECT DISTINCT user_id FROM {events}"
VECTORS = "SELECT vec_id, embedding FROM {embeddings}"


# --- preparation ---------------------------------------------------------------------------------------------------

@query("prep_eligible", "SELECT * FROM log QUALIFY count(*) OVER (PARTITION BY user_id) >= 20", log=ORDERS)
def _(spark, log):
    return prep.eligible_users(log, 20)


@query("prep_id_map", "SELECT raw, row_number() OVER (ORDER BY raw) - 1 AS id FROM (SELECT DISTINCT raw_item_id AS raw FROM items)", items=ITEMS)
def _(spark, items):
    return prep.id_mapping(items, "raw_item_id", "id")


@query("prep_positives", "SELECT * FROM log WHERE rating >= 4.0", log=LOG)
def _(spark, log):
    return prep.positives(log, 4.0)


@query("prep_stats", "SELECT count(*) AS num_interactions, count(*) FILTER (WHERE rating >= 4) AS num_positive_interactions, count(DISTINCT user_id) AS num_users, count(DISTINCT item_id) AS num_items FROM log", log=LOG)
def _(spark, log):
    return prep.dataset_stats(log, 4.0)


@query(
    "prep_items_movie",
    r"""SELECT item_id, raw_item_id, trim(regexp_replace(raw_title, '\s*\([0-9]{4}\)\s*$', '')) AS title, genres,
        TRY_CAST(regexp_extract(raw_title, '\(([0-9]{4})\)\s*$', 1) AS INT) AS release_year FROM items""",
    items=ITEMS,
)
def _(spark, items):
    return prep.movie_items(items)


@query(
    "prep_items_clean",
    """SELECT item_id, TRY_CAST(replace(replace(trim(said), '$', ''), ',', '') AS DOUBLE) AS price, list_filter(string_split(genres, '|'), lambda x: x <> '') AS genres FROM (
       SELECT item_id, genres, CASE WHEN item_id % 5 = 0 THEN '' WHEN item_id % 5 = 1 THEN 'n/a' ELSE concat('$1,', CAST(item_id % 900 + 100 AS VARCHAR(20)), '.50 ') END AS said FROM items)""",
    items=ITEMS,
)
def _(spark, items):
    said = F.when(F.col("item_id") % 5 == 0, "").when(F.col("item_id") % 5 == 1, "n/a").otherwise(F.concat(F.lit("$1,"), (F.col("item_id") % 900 + 100).cast("string"), F.lit(".50 ")))
    return items.select("item_id", prep.clean_number(said).alias("price"), prep.genre_list(F.col("genres")).alias("genres"))


@query(
    "split_loo",
    """SELECT event_id, CASE r WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS split FROM (
       SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC, event_id DESC) AS r FROM log) WHERE n >= 3""",
    log=LOG,
)
def _(spark, log):
    return prep.leave_one_out(log, 3, ["event_id"]).select("event_id", "split")


SPLIT = """WITH o AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id, event_id) - 1 AS r FROM log),
b AS (SELECT *, greatest(1, CAST(floor(n * CAST(0.7 AS DOUBLE)) AS INT)) AS te0, greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE)) AS INT)) AS vc FROM o WHERE n >= 10),
e AS (SELECT *, CASE WHEN te0 + vc >= n THEN greatest(1, n - vc - 1) ELSE te0 END AS te FROM b),
s AS (SELECT user_id, item_id, rating, ts, event_id, CASE WHEN r < te THEN 'train' WHEN r < te + vc THEN 'val' ELSE 'test' END AS split FROM e)"""


def _split(log: DataFrame) -> DataFrame:
    return prep.temporal_split(log, 0.7, 0.1, 10, ["event_id"])


@query("split_temporal", SPLIT + " SELECT event_id, split FROM s", log=LOG)
def _(spark, log):
    return _split(log).select("event_id", "split")


@query(
    "split_train_queries",
    SPLIT + """, t AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC, event_id DESC) AS r FROM s WHERE split = 'train')
    SELECT event_id, CASE WHEN r = 1 AND n >= 2 THEN 'train_queries' ELSE 'retriever_train' END AS role FROM t""",
    log=LOG,
)
def _(spark, log):
    return prep.train_queries(_split(log).where(F.col("split") == "train"), ["event_id"]).select("event_id", "role")


HISTORY = SPLIT + ", h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id, event_id) AS place FROM s WHERE split IN ('train', 'val'))"


@query("history_topn", HISTORY + " SELECT user_id, event_id, item_id, place FROM h WHERE place <= 20", log=LOG)
def _(spark, log):
    return prep.history(prep.context_of("test", _split(log)), 20, ["event_id"]).select("user_id", "event_id", "item_id", "place")


@query("history_enriched", HISTORY + " SELECT h.user_id, place, CAST(h.item_id AS VARCHAR) AS item_id, raw_title AS title, rating FROM h LEFT JOIN items i ON h.item_id = i.item_id WHERE place <= 20", log=LOG, items=ITEMS)
def _(spark, log, items):
    hist = prep.history(prep.context_of("test", _split(log)), 20, ["event_id"])
    out = prep.history_items(hist, items.select("item_id", F.col("raw_title").alias("title")))
    return out.select("user_id", F.explode("history").alias("h")).select("user_id", "h.*")


@query("seen_items", SPLIT + " SELECT DISTINCT user_id, item_id FROM s WHERE split IN ('train', 'val')", log=LOG)
def _(spark, log):
    return prep.seen_items(prep.context_of("test", _split(log)))


@query("ui_matrix", "SELECT user_id, item_id, CAST(count(*) AS DOUBLE) AS value FROM log GROUP BY user_id, item_id", log=ORDERS)
def _(spark, log):
    return prep.user_item_matrix(log)


@query("ui_matrix_sum", "SELECT user_id, item_id, CAST(sum(rating) AS DOUBLE) AS value FROM log GROUP BY user_id, item_id", log=ORDERS)
def _(spark, log):
    return prep.user_item_matrix(log, "rating")


@query("prep_mapped_log", """WITH u AS (SELECT raw, row_number() OVER (ORDER BY raw) - 1 AS id FROM (SELECT DISTINCT user_id AS raw FROM log)), i AS (SELECT raw, row_number() OVER (ORDER BY raw) - 1 AS id FROM (SELECT DISTINCT item_id AS raw FROM log))
    SELECT event_id, u.id AS user_id, i.id AS item_id, log.user_id AS raw_user_id, log.item_id AS raw_item_id FROM log JOIN u ON log.user_id = u.raw JOIN i ON log.item_id = i.raw""", log=LOG)
def _(spark, log):
    return prep.mapped_log(log, prep.id_mapping(log, "user_id", "id"), prep.id_mapping(log, "item_id", "id")).select("event_id", "user_id", "item_id", "raw_user_id", "raw_item_id")


@query("prep_full_stats", SPLIT + """, q AS (SELECT *, split = 'train' AND row_number() OVER (PARTITION BY user_id, split ORDER BY ts DESC, item_id DESC, event_id DESC) = 1 AND count(*) OVER (PARTITION BY user_id, split) >= 2 AS q FROM s)
    SELECT count(*) AS num_interactions, count(*) FILTER (WHERE rating >= 4) AS num_positive_interactions, count(*) FILTER (WHERE split = 'train') AS num_train, count(*) FILTER (WHERE split = 'train' AND NOT q) AS num_retriever_train, count(*) FILTER (WHERE q) AS num_train_queries,
      count(*) FILTER (WHERE split = 'val') AS num_val, count(*) FILTER (WHERE split = 'test') AS num_test, count(DISTINCT user_id) AS num_users, count(DISTINCT item_id) AS num_items FROM q""", log=LOG)
def _(spark, log):
    return prep.full_stats(_split(log), 4.0, ["event_id"])


AMAZON = """SELECT concat('P', CAST(p_partkey AS VARCHAR(20))) AS parent_asin, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS title, p_type AS main_category, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS store,
  CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN 'from 3' ELSE concat('$1,', CAST(p_partkey % 900 + 100 AS VARCHAR(20)), '.50') END AS price, p_partkey FROM {part}"""


@query("items_amazon", """WITH m AS (SELECT raw, row_number() OVER (ORDER BY raw) - 1 AS id FROM (SELECT parent_asin AS raw FROM meta WHERE p_partkey % 2 = 0))
    SELECT id AS item_id, parent_asin AS raw_item_id, title, main_category, CASE WHEN p_partkey % 3 = 0 THEN '[]' WHEN p_partkey % 3 = 1 THEN concat('["', main_category, '"]') ELSE concat('["', main_category, '","', parent_asin, '"]') END AS categories, store AS brand_or_store, '[]' AS description, concat('["', parent_asin, '"]') AS features,
      TRY_CAST(replace(replace(price, '$', ''), ',', '') AS DOUBLE) AS price, CAST(p_partkey % 5 AS DOUBLE) AS average_rating, NULL::DOUBLE AS rating_number FROM meta JOIN m ON parent_asin = raw""", meta=AMAZON)
def _(spark, meta):
    asin, kind, third = F.col("parent_asin"), F.col("main_category"), F.col("p_partkey") % 3
    lists = F.when(third == 1, F.array(kind, F.lit(None))).when(third == 2, F.array(kind, asin))
    raw = meta.select("parent_asin", "title", "main_category", "store", "price", lists.alias("categories"), F.lit(None).cast("array<string>").alias("description"), F.array(asin).alias("features"), (F.col("p_partkey") % 5).cast("double").alias("average_rating"), F.lit(None).cast("long").alias("rating_number"))
    return prep.amazon_items(raw, prep.id_mapping(meta.where("p_partkey % 2 = 0"), "parent_asin", "id"))


NAMED = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS id, CASE WHEN p_partkey % 3 = 0 THEN concat('A', CAST(p_partkey AS VARCHAR(20))) END AS asin, CASE WHEN p_partkey % 5 = 0 THEN ' ' WHEN p_partkey % 5 < 3 THEN p_name END AS title, CASE WHEN p_partkey % 7 < 5 THEN p_type END AS main_category FROM {part}"


@query("candidate_id_fallback", "SELECT p_partkey, coalesce(CAST(id AS VARCHAR), asin, CAST(p_partkey % 25 AS VARCHAR)) AS candidate_id FROM named", named=NAMED)
def _(spark, named):
    return named.select("p_partkey", records.candidate_id(named.columns, F.col("p_partkey") % 25).alias("candidate_id"))


@query("candidate_title", "SELECT p_partkey, CASE WHEN trim(title) <> '' THEN title WHEN trim(main_category) <> '' THEN main_category ELSE 'unknown item' END AS title FROM named", named=NAMED)
def _(spark, named):
    return named.select("p_partkey", records.candidate_title(named.columns).alias("title"))


@query("ground_truth", "SELECT user_id, list_sort(list(item_id)) AS ground_truth FROM truth GROUP BY user_id", truth=TRUTH)
def _(spark, truth):
    return retrieval.ground_truth(truth)


# --- graph and retrieval -------------------------------------------------------------------------------------------

EDGES = """WITH e0 AS (SELECT DISTINCT concat('u', CAST(user_id AS VARCHAR)) AS src, concat('i', CAST(item_id AS VARCHAR)) AS dst FROM log),
e1 AS (SELECT src, dst FROM e0 UNION ALL SELECT dst, src FROM e0), deg AS (SELECT src, count(*) AS d FROM e1 GROUP BY src),
e AS (SELECT e1.src, e1.dst, 1.0 / sqrt(CAST(a.d AS DOUBLE) * b.d) AS w FROM e1 JOIN deg a ON e1.src = a.src JOIN deg b ON e1.dst = b.src),
x AS (SELECT src AS node, k, CAST(ascii(substr(md5(concat(src, '/', CAST(k AS VARCHAR))), 1, 1)) AS DOUBLE) / 64 AS v FROM deg CROSS JOIN (VALUES (0),(1)) AS t(k)),
s1 AS (SELECT e.src AS node, k, sum(w * v) AS v FROM e JOIN x ON e.dst = x.node GROUP BY e.src, k),
s2 AS (SELECT e.src AS node, k, sum(w * v) AS v FROM e JOIN s1 ON e.dst = s1.node GROUP BY e.src, k)"""


def _graph(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    edges = prep.stored_once(retrieval.normalised_edges(retrieval.bipartite_edges(log)))  # every layer reads them
    nodes = edges.select(F.col("src").alias("node")).distinct().select("node", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    v = F.ascii(F.substring(F.md5(F.concat("node", F.lit("/"), F.col("k").cast("string"))), 1, 1)).cast("double") / 64
    return edges, nodes.withColumn("v", v)


@query("graph_norm", EDGES + f" SELECT src, dst, round(w, {DIGITS}) AS w FROM e", log=LOG)
def _(spark, log):
    return rounded(retrieval.normalised_edges(retrieval.bipartite_edges(log)), "w")


@query("graph_propagate_1", EDGES + f" SELECT node, k, round(v, {DIGITS}) AS v FROM s1", log=LOG)
def _(spark, log):
    return rounded(retrieval.propagate(*_graph(log)), "v")


@query("graph_propagate_mean", EDGES + f" SELECT node, k, round(sum(v) / 3, {DIGITS}) AS v FROM (SELECT * FROM x UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY node, k", log=LOG)
def _(spark, log):
    edges, x = _graph(log)
    return rounded(retrieval.propagated_mean(edges, x, 2), "v")


SCORES = """, sc AS (SELECT u.user_id, i.vec_id AS item_id, round(list_sum(list_transform(range(1, 65), lambda k: CAST(uv.embedding[k] AS DOUBLE) * CAST(i.embedding[k] AS DOUBLE))), 12) AS score
FROM (SELECT DISTINCT user_id FROM log) u JOIN vectors uv ON uv.vec_id = u.user_id CROSS JOIN vectors i)"""


def _factors(log: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    users = log.select("user_id").distinct().join(vectors, F.col("vec_id") == F.col("user_id")).select("user_id", F.col("embedding").alias("vec"))
    return users, vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))


@query("recommend_topk", "WITH one AS (SELECT 1)" + SCORES + f" SELECT user_id, item_id, round(score, {DIGITS}) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM sc) WHERE rank <= 10", log=LOG, vectors=VECTORS)
def _(spark, log, vectors):
    return rounded(retrieval.recommend(*_factors(log, vectors), None, 10), "score")


UNSEEN = SPLIT + SCORES + """, seen AS (SELECT DISTINCT user_id, item_id FROM s WHERE split IN ('train', 'val')),
rec AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY sc.user_id ORDER BY score DESC, sc.item_id) AS rank FROM sc LEFT JOIN seen ON seen.user_id = sc.user_id AND seen.item_id = sc.item_id WHERE seen.item_id IS NULL) WHERE rank <= 10),
truth AS (SELECT DISTINCT user_id, item_id FROM s WHERE split = 'test' AND rating >= 4.0)"""


def _unseen(log: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = _split(log)
    rec = retrieval.recommend(*_factors(log, vectors), prep.seen_items(prep.context_of("test", rows)), 10)
    truth = rows.where((F.col("split") == "test") & (F.col("rating") >= 4.0)).select(F.col("user_id").cast("long").alias("user_id"), F.col("item_id").cast("long").alias("item_id")).distinct()
    return rec, truth


@query("recommend_unseen", UNSEEN + f" SELECT user_id, item_id, round(score, {DIGITS}) AS score, rank FROM rec", log=LOG, vectors=VECTORS)
def _(spark, log, vectors):
    return rounded(_unseen(log, vectors)[0], "score")


@query("flagship_retrieval", UNSEEN + f""", g AS (SELECT user_id, count(*) AS n FROM truth GROUP BY user_id),
    h AS (SELECT r.user_id, count(*) AS hits, min(rank) AS first, sum(1.0 / log2(rank + 1)) AS dcg FROM rec r JOIN truth t ON r.user_id = t.user_id AND r.item_id = t.item_id GROUP BY r.user_id),
    i AS (SELECT m, sum(1.0 / log2(x + 1)) AS idcg FROM range(1, 11) a(m) JOIN range(1, 11) b(x) ON x <= m GROUP BY m)
    SELECT g.user_id, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate, round(coalesce(hits, 0)::DOUBLE / n, {DIGITS}) AS recall, round(coalesce(dcg, 0) / idcg, {DIGITS}) AS ndcg, round(coalesce(1.0::DOUBLE / first, 0), {DIGITS}) AS mrr
    FROM g LEFT JOIN h ON g.user_id = h.user_id JOIN i ON i.m = least(g.n, 10)""", log=LOG, vectors=VECTORS)
def _(spark, log, vectors):
    rec, truth = map(prep.stored_once, _unseen(log, vectors))  # the metrics read both several times
    runs = rec.select("user_id", F.lit(1).alias("permutation_index"), "item_id", (F.col("rank") - 1).alias("output_rank"))
    per = metrics.per_list_effectiveness(runs, truth, 10)
    per = truth.select("user_id").distinct().join(per, "user_id", "left").na.fill(0.0)
    return rounded(per.drop("permutation_index"), "recall", "ndcg", "mrr")


@query("gt_filter", UNSEEN + " SELECT DISTINCT r.user_id FROM rec r JOIN truth t ON r.user_id = t.user_id AND r.item_id = t.item_id", log=LOG, vectors=VECTORS)
def _(spark, log, vectors):
    return retrieval.covered_users(*_unseen(log, vectors))


@query("truth_scan", UNSEEN + """, po AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS place FROM (SELECT DISTINCT user_id FROM rec)),
    ks AS (SELECT user_id, place, row_number() OVER (ORDER BY place) AS n FROM po WHERE user_id IN (SELECT r.user_id FROM rec r JOIN truth t ON r.user_id = t.user_id AND r.item_id = t.item_id)),
    a AS (SELECT count(*) AS total FROM po), l AS (SELECT max(n) AS n, max(place) AS last FROM ks WHERE n <= 5)
    SELECT user_id, place, CASE WHEN l.n >= 5 THEN least(total, (last // 16 + 1) * 16) ELSE total END AS scanned_users FROM ks, a, l WHERE ks.n <= 5""", log=LOG, vectors=VECTORS)
def _(spark, log, vectors):
    rows = _split(log)
    users, items = _factors(log, vectors)
    seen = prep.seen_items(prep.context_of("test", rows))
    truth = rows.where((F.col("split") == "test") & (F.col("rating") >= 4.0)).select(F.col("user_id").cast("long").alias("user_id"), F.col("item_id").cast("long").alias("item_id"))
    users, seen, shared = prep.stored_once(users), prep.stored_once(seen), retrieval.broadcast_items(items)  # each step of the scan reads them
    score = lambda some: retrieval.recommend(users.join(some, "user_id"), shared, seen.join(some, "user_id", "left_semi"), 10)
    return retrieval.scan_for_truth(sampling.order_users(users), score, truth, 5, 16)[0]


@query("candidate_coverage", UNSEEN + f""" SELECT count(*) AS users_before, count(h.user_id) AS users_with_truth, round(count(h.user_id)::DOUBLE / count(*), {DIGITS}) AS coverage
    FROM (SELECT DISTINCT user_id FROM rec) u LEFT JOIN (SELECT DISTINCT r.user_id FROM rec r JOIN truth t ON r.user_id = t.user_id AND r.item_id = t.item_id) h ON u.user_id = h.user_id""", log=LOG, vectors=VECTORS)
def _(spark, log, vectors):
    return rounded(retrieval.candidate_coverage(*_unseen(log, vectors)), "coverage")


@query("candidates_long", UNSEEN + " SELECT r.user_id, r.rank, r.item_id, i.raw_item_id, i.raw_title FROM rec r LEFT JOIN items i ON r.item_id = i.item_id", log=LOG, vectors=VECTORS, items=ITEMS)
def _(spark, log, vectors, items):
    return retrieval.candidates_long(_unseen(log, vectors)[0], items).select("user_id", "rank", "item_id", "raw_item_id", "raw_title")


@query("relevance_label", "SELECT r.user_id, permutation_index, r.item_id, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS relevance FROM runs r LEFT JOIN (SELECT DISTINCT * FROM truth) t ON r.user_id = t.user_id AND r.item_id = t.item_id", runs=RUNS, truth=TRUTH)
def _(spark, runs, truth):
    return retrieval.relevance(runs, truth).select("user_id", "permutation_index", "item_id", "relevance")

NEGATIVE = """WITH r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id, item_id) - 1 AS copy FROM pairs), seen AS (SELECT DISTINCT user_id, item_id FROM pairs),
n AS (SELECT max(item_id) + 1 AS n FROM pairs), d AS (SELECT r.*, t.k, ('0x' || substr(md5(concat('42|0|', user_id, '|', item_id, '|', copy, '|', t.k)), 1, 15))::BIGINT AS x FROM r, range(0, 7) t(k)),
o AS (SELECT d.user_id, d.item_id, copy, arg_min(x % n.n, k) AS negative FROM d, n WHERE k < 6 AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = d.user_id AND s.item_id = x % n.n) GROUP BY ALL),
u AS (SELECT a.user_id, i.i, row_number() OVER (PARTITION BY a.user_id ORDER BY i.i) - 1 AS j, count(*) OVER (PARTITION BY a.user_id) AS m FROM (SELECT DISTINCT user_id FROM pairs) a CROSS JOIN range(0, (SELECT n FROM n)) i(i)
      LEFT JOIN seen s ON s.user_id = a.user_id AND s.item_id = i.i WHERE s.item_id IS NULL),
l AS (SELECT d.user_id, d.item_id, copy, u.i FROM d JOIN u ON d.user_id = u.user_id AND d.x % u.m = u.j WHERE k = 6)
SELECT r.user_id, r.item_id, r.copy, coalesce(o.negative, l.i) AS negative FROM r LEFT JOIN o ON o.user_id = r.user_id AND o.item_id = r.item_id AND o.copy = r.copy LEFT JOIN l ON l.user_id = r.user_id AND l.item_id = r.item_id AND l.copy = r.copy"""
LIKED = "SELECT user_id, item_id FROM (" + LOG + ") x WHERE rating >= 4.0"


def _negatives(pairs: DataFrame) -> DataFrame:
    return negatives.negative_items(pairs, pairs, int(pairs.agg(F.max("item_id")).first()[0]) + 1)


@query("graph_propagate_vectors", EDGES + f" SELECT node, list(round(v, {DIGITS}) ORDER BY k) AS vec FROM (SELECT node, k, sum(v) / 3 AS v FROM (SELECT * FROM x UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY node, k) GROUP BY node", log=LOG)
def _(spark, log):
    edges, x = _graph(log)
    vectors = x.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda y: y["v"]).alias("vec"))
    out = retrieval.propagated_mean_vectors(edges, vectors, 2, 2)
    return out.select("node", F.transform("vec", lambda y: F.round(y, DIGITS)).alias("vec"))


@query("users_in_keyed_order", "SELECT user_id, row_number() OVER (ORDER BY md5(concat('42|', user_id)), user_id) - 1 AS place FROM users", users=USERS)
def _(spark, users):
    return sampling.order_users(users, sample=True, keyed=True)


@query("negative_items", NEGATIVE, pairs=LIKED)
def _(spark, pairs):
    return _negatives(pairs)


# so few items that most draws are refused, and some users have seen them all
@query("negative_items_dense", NEGATIVE, pairs=LIKED.replace("item_id FROM", "item_id % 9 AS item_id FROM", 1))
def _(spark, pairs):
    return _negatives(pairs)


@query("recommend_pruned", "WITH one AS (SELECT 1)" + SCORES + f" SELECT user_id, item_id, round(score, {DIGITS}) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM sc) WHERE rank <= 10", log=LOG, vectors=VECTORS)
def _(spark, log, vectors):
    found = retrieval.pruned_topk(*_factors(log, vectors), None, 10, block_items=64, pass_items=1000)
    return rounded(found.select("user_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("user_id", F.col("x.ids").alias("item_id"), F.col("x.scores").alias("score")), "score")


@query("als_recommend", log=LOG)
def _(spark, log):
    return retrieval.als_recommend(prep.positives(log, 4.0), 10)


@query("lightgcn_recommend", log=LOG)
def _(spark, log):
    # training is a driver-side fit: it takes the distinct pairs of one graph, whose size is stated by the caller
    pairs = retrieval.graph_pairs(prep.positives(log, 4.0))
    users, items, _ = retrieval.lightgcn_fit(pairs, int(pairs[:, 0].max()) + 1, int(pairs[:, 1].max()) + 1)
    return retrieval.recommend(retrieval.vector_frame(spark, users, "user_id"), retrieval.vector_frame(spark, items, "item_id"), retrieval.seen_pairs(log), 10)


# --- effectiveness -------------------------------------------------------------------------------------------------

EFFECT = """WITH req AS (SELECT DISTINCT user_id, permutation_index FROM runs UNION ALL SELECT DISTINCT user_id, NULL FROM truth WHERE user_id NOT IN (SELECT user_id FROM runs)),
g AS (SELECT user_id, count(DISTINCT item_id) AS n_rel FROM truth GROUP BY user_id),
h AS (SELECT r.user_id, r.permutation_index, min(r.output_rank + 1) AS first_rank, count(DISTINCT r.item_id) AS hits, sum(1.0 / log2(r.output_rank + 2)) AS dcg
      FROM runs r JOIN (SELECT DISTINCT user_id, item_id FROM truth) t ON t.user_id = r.user_id AND t.item_id = r.item_id WHERE r.output_rank < 3 GROUP BY r.user_id, r.permutation_index),
i AS (SELECT m, sum(1.0 / log2(x + 1)) AS idcg FROM (VALUES (1),(2),(3)) AS a(m) JOIN (VALUES (1),(2),(3)) AS b(x) ON x <= m GROUP BY m),
f AS (SELECT avg(CASE WHEN h.hits > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(CASE WHEN g.n_rel > 0 THEN coalesce(h.hits, 0) * CAST(1 AS DOUBLE) / g.n_rel END) AS recall,
       avg(CASE WHEN g.n_rel > 0 THEN coalesce(h.dcg, 0) / i.idcg END) AS ndcg, avg(coalesce(CAST(1 AS DOUBLE) / h.first_rank, 0)) AS mrr
FROM req LEFT JOIN g ON g.user_id = req.user_id LEFT JOIN h ON h.user_id = req.user_id AND h.permutation_index = req.permutation_index LEFT JOIN i ON i.m = least(g.n_rel, 3))"""

for _name in ("hit_rate", "recall", "ndcg", "mrr"):

    @query(_name, EFFECT + f" SELECT round({_name}, {DIGITS}) AS {_name} FROM f", runs=RUNS, truth=TRUTH)
    def _(spark, runs, truth, name=_name):
        return rounded(metrics.effectiveness(runs, truth, K).select(name), name)


@query("effectiveness_all", EFFECT + " SELECT " + ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in ("hit_rate", "recall", "ndcg", "mrr")) + " FROM f", runs=RUNS, truth=TRUTH)
def _(spark, runs, truth):
    return rounded(metrics.effectiveness(runs, truth, K), "hit_rate", "recall", "ndcg", "mrr")


@query("effectiveness_absent", EFFECT + " SELECT " + ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in ("hit_rate", "recall", "ndcg", "mrr")) + " FROM f", runs=f"SELECT * FROM ({RUNS}) z WHERE user_id % 5 <> 2", truth=TRUTH)
def _(spark, runs, truth):
    return rounded(metrics.effectiveness(runs, truth, K), "hit_rate", "recall", "ndcg", "mrr")


@query("graded_hr_ndcg", f"""WITH z AS (SELECT *, pow(2.0::DOUBLE, relevance) - 1 AS g, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, position) AS r, row_number() OVER (PARTITION BY request_id ORDER BY relevance DESC, position) AS i FROM scored),
    a AS (SELECT request_id, max(CASE WHEN r <= 5 AND relevance > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hr, sum(CASE WHEN r <= 5 THEN g / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 5 THEN g / log2(i + 1) ELSE 0 END) AS idcg FROM z GROUP BY request_id)
    SELECT request_id, hr, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, {DIGITS}) AS ndcg FROM a""", scored=LABELLED)
def _(spark, scored):
    return rounded(metrics.graded_hr_ndcg(scored, 5), "ndcg")


VALIDATION = """WITH z AS (SELECT *, pow(2.0::DOUBLE, relevance) - 1 AS g, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, input_position) AS r, row_number() OVER (PARTITION BY user_id ORDER BY relevance DESC, input_position) AS i FROM (SELECT r.*, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS relevance FROM runs r LEFT JOIN (SELECT DISTINCT * FROM truth) t ON r.user_id = t.user_id AND r.item_id = t.item_id) WHERE permutation_index = 1),
e AS (SELECT user_id, n, max(CASE WHEN r <= n AND relevance > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hr, sum(CASE WHEN r <= n THEN g / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= n THEN g / log2(i + 1) ELSE 0 END) AS idcg FROM z, (VALUES (5), (10)) v(n) GROUP BY user_id, n),
o AS (SELECT user_id, permutation_index AS p, item_id, row_number() OVER (PARTITION BY user_id, permutation_index ORDER BY score DESC, input_position) AS r FROM runs),
s AS (SELECT a.user_id, b.p, 1 - 6 * sum((a.r - b.r) * (a.r - b.r))::DOUBLE / (count(*) * (count(*) * count(*) - 1)) AS rho FROM o a JOIN o b ON a.user_id = b.user_id AND a.item_id = b.item_id WHERE a.p = 1 AND b.p > 1 GROUP BY a.user_id, b.p)"""


@query("validation_report", VALIDATION + " SELECT " + ", ".join(f"(SELECT round(avg({x}), {DIGITS}) FROM e WHERE n = {n}) AS {name}_{n}" for n in (5, 10) for name, x in (("hr", "hr"), ("ndcg", "CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END"))) + f", (SELECT round(avg(rho), {DIGITS}) FROM s) AS perm_spearman", runs=RUNS, truth=TRUTH)
def _(spark, runs, truth):
    scored = retrieval.relevance(runs, truth).select(F.col("user_id").alias("request_id"), "permutation_index", "item_id", F.col("input_position").alias("position"), "score", "relevance")
    return rounded(metrics.validation(scored), "hr_5", "ndcg_5", "hr_10", "ndcg_10", "perm_spearman")


# --- robustness ----------------------------------------------------------------------------------------------------

PAIRS = """WITH p AS (SELECT a.user_id, a.permutation_index AS p1, b.permutation_index AS p2, a.item_id, a.output_rank AS x, b.output_rank AS y FROM runs a JOIN runs b ON a.user_id = b.user_id AND a.item_id = b.item_id AND a.permutation_index < b.permutation_index)"""
TAU = """, tau AS (SELECT l.user_id, l.p1, l.p2, sum(sign(l.x - r.x) * sign(l.y - r.y)) * CAST(1 AS DOUBLE) / count(*) AS tau FROM p l JOIN p r ON l.user_id = r.user_id AND l.p1 = r.p1 AND l.p2 = r.p2 AND l.item_id < r.item_id GROUP BY l.user_id, l.p1, l.p2)"""
RHO = """, rho AS (SELECT user_id, p1, p2, corr(x, y) AS rho, 1 - 6 * sum((x - y) * (x - y))::DOUBLE / (count(*) * (count(*) * count(*) - 1)) AS d2 FROM p GROUP BY user_id, p1, p2)"""
TOP = """, top AS (SELECT user_id, p1, p2, sum(CASE WHEN x < 3 AND y < 3 THEN 1 ELSE 0 END) AS both_in, sum(CASE WHEN x < 3 OR y < 3 THEN 1 ELSE 0 END) AS either_in, max(CASE WHEN x = 0 AND y = 0 THEN 1 ELSE 0 END) AS same FROM p GROUP BY user_id, p1, p2),
st AS (SELECT user_id, avg(both_in::DOUBLE / either_in) AS jaccard, avg(both_in::DOUBLE / 3) AS overlap, avg(same)::DOUBLE AS same_first, avg(CASE WHEN both_in = either_in THEN 1 ELSE 0 END)::DOUBLE AS same_top FROM top GROUP BY user_id)"""
BEST = """, best AS (SELECT r.user_id, r.permutation_index, min(output_rank) + 1 AS r FROM runs r JOIN (SELECT DISTINCT * FROM truth) t ON r.user_id = t.user_id AND r.item_id = t.item_id GROUP BY r.user_id, r.permutation_index),
bs AS (SELECT user_id, avg(r) AS mean_rank, var_pop(r) AS rank_variance, stddev_pop(r) AS rank_std FROM best GROUP BY user_id)"""


@query("kendall", PAIRS + TAU + f" SELECT user_id, round(avg(tau), {DIGITS}) AS mean_tau FROM tau GROUP BY user_id", runs=RUNS)
def _(spark, runs):
    return rounded(metrics.kendall(runs), "mean_tau")


@query("spearman", PAIRS + RHO + f" SELECT user_id, round(avg(rho), {DIGITS}) AS mean_rho FROM rho GROUP BY user_id", runs=RUNS)
def _(spark, runs):
    return rounded(metrics.spearman(runs), "mean_rho")


@query("spearman_d2", PAIRS + RHO + f" SELECT user_id, round(avg(d2), {DIGITS}) AS rho_to_first FROM rho WHERE p1 = 1 GROUP BY user_id", runs=RUNS)
def _(spark, runs):
    return rounded(metrics.spearman_to_first(runs), "rho_to_first")


@query("topk_stability", PAIRS + TOP + f" SELECT user_id, round(jaccard, {DIGITS}) AS jaccard, round(overlap, {DIGITS}) AS overlap, round(same_first, {DIGITS}) AS same_first, round(same_top, {DIGITS}) AS same_top FROM st", runs=RUNS)
def _(spark, runs):
    return rounded(metrics.topk_stability(runs, K), "jaccard", "overlap", "same_first", "same_top")


@query("gt_rank_stability", PAIRS + BEST + f" SELECT user_id, round(mean_rank, {DIGITS}) AS mean_rank, round(rank_variance, {DIGITS}) AS rank_variance, round(rank_std, {DIGITS}) AS rank_std FROM bs", runs=RUNS, truth=TRUTH)
def _(spark, runs, truth):
    return rounded(metrics.truth_rank_stability(runs, truth), "mean_rank", "rank_variance", "rank_std")


MACRO = metrics.FIGURES


@query("robustness_macro", PAIRS + TAU + RHO + TOP + BEST + " SELECT count(mean_tau) AS num_users_with_pairs, count(mean_rank) AS num_users_with_ranks, " + ", ".join(f"round(avg({c}), {DIGITS}) AS {c}" for c in MACRO) + """ FROM (SELECT DISTINCT user_id FROM runs) u
    LEFT JOIN (SELECT user_id, avg(tau) AS mean_tau FROM tau GROUP BY user_id) a ON u.user_id = a.user_id LEFT JOIN (SELECT user_id, avg(rho) AS mean_rho FROM rho GROUP BY user_id) b ON u.user_id = b.user_id
    LEFT JOIN st ON u.user_id = st.user_id LEFT JOIN bs ON u.user_id = bs.user_id""", runs=RUNS, truth=TRUTH)
def _(spark, runs, truth):
    return rounded(metrics.robustness_macro(runs, truth, K), *MACRO)

@query("robustness_by_user", PAIRS + TAU + RHO + TOP + BEST + " SELECT u.user_id, num_permutations, num_permutations * (num_permutations - 1) // 2 AS num_pairs, " + ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in MACRO) + """ FROM (SELECT user_id, count(DISTINCT permutation_index) AS num_permutations FROM runs GROUP BY user_id) u
    LEFT JOIN (SELECT user_id, avg(tau) AS mean_tau FROM tau GROUP BY user_id) a ON u.user_id = a.user_id LEFT JOIN (SELECT user_id, avg(rho) AS mean_rho FROM rho GROUP BY user_id) b ON u.user_id = b.user_id
    LEFT JOIN st ON u.user_id = st.user_id LEFT JOIN bs ON u.user_id = bs.user_id""", runs=RUNS, truth=TRUTH)
def _(spark, runs, truth):
    return rounded(metrics.robustness_by_user(runs, truth, K), *MACRO)


@query("robustness_values", PAIRS + TAU + RHO + TOP + BEST + f""" SELECT u.user_id, tau_values, rho_values, jaccard_values, overlap_values, same_first_values, same_top_values, rank_values FROM (SELECT DISTINCT user_id FROM runs) u
    LEFT JOIN (SELECT user_id, list(round(tau, {DIGITS}) ORDER BY p1, p2) AS tau_values FROM tau GROUP BY user_id) a ON u.user_id = a.user_id LEFT JOIN (SELECT user_id, list(round(rho, {DIGITS}) ORDER BY p1, p2) AS rho_values FROM rho GROUP BY user_id) b ON u.user_id = b.user_id
    LEFT JOIN (SELECT user_id, list(round(both_in::DOUBLE / either_in, {DIGITS}) ORDER BY p1, p2) AS jaccard_values, list(round(both_in::DOUBLE / 3, {DIGITS}) ORDER BY p1, p2) AS overlap_values, list(same::DOUBLE ORDER BY p1, p2) AS same_first_values, list(CASE WHEN both_in = either_in THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY p1, p2) AS same_top_values FROM top GROUP BY user_id) c ON u.user_id = c.user_id
    LEFT JOIN (SELECT user_id, list(r ORDER BY permutation_index) AS rank_values FROM best GROUP BY user_id) d ON u.user_id = d.user_id""", runs=RUNS, truth=TRUTH)
def _(spark, runs, truth):
    out = metrics.robustness_values(runs, truth, K)
    # SQL's round keeps the sign of what becomes zero
    signed = lambda x: F.when(F.abs(x) < 0.5 * 10.0**-DIGITS, x * 0.0).otherwise(F.round(x, DIGITS))
    return out.withColumns({c: F.transform(c, signed) for c in out.columns if c.endswith("_values") and c != "rank_values"})


#: Runs in which some users' second list holds an item that the others don't.
FOREIGN = "SELECT user_id, permutation_index, CASE WHEN user_id % 5 = 3 AND permutation_index = 2 AND output_rank = 4 THEN 'zz' ELSE item_id END AS item_id, input_position, output_rank, score FROM (" + RUNS + ") x"
OTHER = """WITH s AS (SELECT user_id, permutation_index AS p, list_sort(list(item_id)) AS items FROM runs GROUP BY user_id, permutation_index),
v AS (SELECT a.user_id, a.p AS p1, b.p AS p2, list_sort(list_filter(a.items, lambda x: NOT list_contains(b.items, x))) AS only_first, list_sort(list_filter(b.items, lambda x: NOT list_contains(a.items, x))) AS only_second FROM s a JOIN s b ON a.user_id = b.user_id AND a.p < b.p WHERE a.items <> b.items)"""


@query("alignment_violations", OTHER + " SELECT * FROM v", runs=FOREIGN)
def _(spark, runs):
    return metrics.alignment_violations(runs)


@query("kendall_foreign", OTHER + ", " + PAIRS[5:] + TAU + f" SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM v) THEN NULL ELSE round(avg(tau), {DIGITS}) END AS mean_tau FROM tau GROUP BY user_id", runs=FOREIGN)
def _(spark, runs):
    return rounded(metrics.kendall(runs), "mean_tau")


@query("spearman_foreign", OTHER + ", " + PAIRS[5:] + RHO + f" SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM v) THEN NULL ELSE round(avg(rho), {DIGITS}) END AS mean_rho FROM rho GROUP BY user_id", runs=FOREIGN)
def _(spark, runs):
    return rounded(metrics.spearman(runs), "mean_rho")


# --- preference consistency ----------------------------------------------------------------------------------------

PREFS = """WITH pr AS (SELECT a.user_id, a.item_id AS x, b.item_id AS y, avg(CASE WHEN a.output_rank < b.output_rank THEN CAST(1 AS DOUBLE) ELSE 0 END) AS p FROM runs a JOIN runs b ON a.user_id = b.user_id AND a.permutation_index = b.permutation_index AND a.item_id < b.item_id GROUP BY a.user_id, a.item_id, b.item_id),
ws AS (SELECT user_id, item_id, sum(w) AS win_score FROM (SELECT user_id, x AS item_id, p AS w FROM pr UNION ALL SELECT user_id, y, 1 - p FROM pr) GROUP BY user_id, item_id)"""


@query("ppi", f"""WITH z AS (SELECT *, count(*) OVER (PARTITION BY user_id, permutation_index) AS n FROM runs),
    bk AS (SELECT *, least(CAST(floor(input_position * 3 / CAST(n AS DOUBLE)) AS INT), 2) AS bucket FROM z),
    cell AS (SELECT a.user_id, a.item_id AS x, b.item_id AS y, a.bucket AS bx, b.bucket AS byy, avg(CASE WHEN a.output_rank < b.output_rank THEN CAST(1 AS DOUBLE) ELSE 0 END) AS p, count(*) AS total
      FROM bk a JOIN bk b ON a.user_id = b.user_id AND a.permutation_index = b.permutation_index AND a.item_id < b.item_id GROUP BY a.user_id, a.item_id, b.item_id, a.bucket, b.bucket),
    pr AS (SELECT user_id, x, y, max(p) - min(p) AS spread FROM cell WHERE total >= 1 GROUP BY user_id, x, y HAVING count(*) >= 2)
    SELECT user_id, round(avg(spread), {DIGITS}) AS ppi FROM pr GROUP BY user_id""", runs=RUNS)
def _(spark, runs):
    return rounded(metrics.ppi(runs), "ppi")


@query("pair_preferences", PREFS + f" SELECT user_id, x, y, round(p, {DIGITS}) AS p FROM pr", runs=RUNS)
def _(spark, runs):
    return rounded(metrics.preferences_of_lists(runs), "p")


@query("win_score", PREFS + f" SELECT user_id, item_id, round(win_score, {DIGITS}) AS win_score FROM ws", runs=RUNS)
def _(spark, runs):
    return rounded(metrics.win_scores(metrics.preferences_of_lists(runs)), "win_score")


@query("gpi_initial_cost", PREFS + f""", o AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(win_score, 9) DESC, item_id) AS r FROM ws)
    SELECT pr.user_id, round(avg(CASE WHEN a.r < b.r THEN 1 - p ELSE p END), {DIGITS}) AS initial_cost FROM pr JOIN o a ON pr.user_id = a.user_id AND pr.x = a.item_id JOIN o b ON pr.user_id = b.user_id AND pr.y = b.item_id GROUP BY pr.user_id""", runs=RUNS)
def _(spark, runs):
    return rounded(metrics.gpi_initial_cost(metrics.pair_preferences(runs)), "initial_cost")


@query("gpi", runs=RUNS)
def _(spark, runs):
    return metrics.gpi_of_lists(runs)


#: Runs of which some lists lack an item in their output, and some users have a list over other items.
SPOILT = f"SELECT user_id, permutation_index, CASE WHEN user_id % 5 = 3 AND permutation_index = 2 AND input_position = 0 THEN 'zz' ELSE item_id END AS item_id, input_position, CASE WHEN user_id % 4 = 1 AND permutation_index <= 4 AND output_rank = 2 THEN NULL ELSE output_rank END AS output_rank FROM ({RUNS}) r"


@query("preference_consistency", f"""WITH b AS (SELECT user_id, permutation_index, list_sort(list(item_id)) AS items, count(*) AS n FROM runs GROUP BY user_id, permutation_index HAVING count(*) = count(output_rank) AND count(*) = count(DISTINCT item_id)),
    u AS (SELECT user_id, count(*) AS lists, count(DISTINCT items) AS kinds FROM b GROUP BY user_id HAVING count(*) >= 2),
    z AS (SELECT r.*, b.n, least(CAST(floor(input_position * 3 / CAST(b.n AS DOUBLE)) AS INT), 2) AS bucket FROM runs r JOIN b ON r.user_id = b.user_id AND r.permutation_index = b.permutation_index JOIN u ON r.user_id = u.user_id AND u.kinds = 1),
    cell AS (SELECT a.user_id, a.item_id AS x, c.item_id AS y, a.bucket AS bx, c.bucket AS byy, avg(CASE WHEN a.output_rank < c.output_rank THEN CAST(1 AS DOUBLE) ELSE 0 END) AS p FROM z a JOIN z c ON a.user_id = c.user_id AND a.permutation_index = c.permutation_index AND a.item_id < c.item_id GROUP BY a.user_id, a.item_id, c.item_id, a.bucket, c.bucket),
    pr AS (SELECT user_id, max(p) - min(p) AS spread FROM cell GROUP BY user_id, x, y HAVING count(*) >= 2),
    v AS (SELECT user_id, avg(spread) AS ppi FROM pr GROUP BY user_id)
    SELECT (SELECT count(*) FROM u) AS num_users, (SELECT round(avg(ppi), {DIGITS}) FROM v) AS ppi, 3 AS preference_buckets, 1 AS minimum_bucket_observations""", runs=SPOILT)
def _(spark, runs):
    return rounded(metrics.preference_consistency(runs).drop("gpi"), "ppi")


# --- exposure and parser quality -----------------------------------------------------------------------------------

EXPOSURE = f"""WITH z AS (SELECT *, count(*) OVER (PARTITION BY user_id, permutation_index) AS n FROM runs),
e AS (SELECT input_position, avg(CASE WHEN output_rank < 3 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS exposure, avg(least(3, n) * CAST(1 AS DOUBLE) / n) AS expected FROM z GROUP BY input_position)"""


@query("exposure", EXPOSURE + f" SELECT input_position, round(exposure, {DIGITS}) AS exposure, round(expected, {DIGITS}) AS expected, round(exposure - expected, {DIGITS}) AS deviation FROM e", runs=RUNS)
def _(spark, runs):
    return rounded(metrics.exposure(runs, K), "exposure", "expected", "deviation")


@query("exposure_summary", EXPOSURE + f" SELECT round(avg(abs(exposure - expected)), {DIGITS}) AS mean_abs_deviation, round(max(abs(exposure - expected)), {DIGITS}) AS max_abs_deviation FROM e", runs=RUNS)
def _(spark, runs):
    return rounded(metrics.exposure_summary(runs, K), "mean_abs_deviation", "max_abs_deviation")


@query("exposure_observations", "SELECT user_id, permutation_index, input_position, CAST(output_rank < 3 AS INT) AS exposed FROM runs", runs=RUNS)
def _(spark, runs):
    return metrics.exposure_observations(runs, K)


VALIDATED = """WITH v AS (SELECT user_id, permutation_index, list(item_id ORDER BY input_position) AS ok FROM runs GROUP BY user_id, permutation_index),
d AS (SELECT user_id, permutation_index, list(item_id ORDER BY pos) AS said FROM said GROUP BY user_id, permutation_index),
u AS (SELECT *, list_filter(said, lambda x, i: list_position(said, x) = i) AS once FROM v JOIN d USING (user_id, permutation_index)),
q AS (SELECT user_id, permutation_index, list_concat(list_filter(once, lambda x: list_contains(ok, x)), list_filter(ok, lambda x: NOT list_contains(said, x))) AS reranked_item_ids,
  CAST(len(list_filter(once, lambda x: NOT list_contains(ok, x))) AS INT) AS num_invalid, CAST(len(said) - len(once) AS INT) AS num_duplicate, CAST(len(list_filter(ok, lambda x: NOT list_contains(said, x))) AS INT) AS num_missing FROM u)"""


def _validated(runs: DataFrame, said: DataFrame) -> DataFrame:
    valid = runs.select("user_id", "permutation_index", F.col("input_position").alias("pos"), "item_id")
    return parsing.validate_ranking(said, valid, metrics.LIST)


@query("validate_ranking", VALIDATED + " SELECT * FROM q", runs=RUNS, said=DAMAGED)
def _(spark, runs, said):
    return _validated(runs, said)


@query("export_result", VALIDATED + """, e AS (SELECT user_id, permutation_index, ok AS input_candidate_item_ids, list_concat(list_filter(once, lambda x: list_contains(ok, x)), list_filter(ok, lambda x: NOT list_contains(said, x))) AS reranked_item_ids, list_filter(once, lambda x: NOT list_contains(ok, x)) AS invalid_item_ids,
      list_filter(said, lambda x, i: list_position(said, x) <> i) AS duplicate_item_ids, list_filter(ok, lambda x: NOT list_contains(said, x)) AS missing_candidate_item_ids FROM u)
    SELECT *, CAST(len(invalid_item_ids) AS INT) AS num_invalid_item_ids, CAST(len(duplicate_item_ids) AS INT) AS num_duplicate_item_ids, CAST(len(missing_candidate_item_ids) AS INT) AS num_missing_candidate_item_ids, CASE WHEN user_id % 11 = 0 THEN 'cut off; no list' END AS parse_error FROM e""", runs=RUNS, said=DAMAGED)
def _(spark, runs, said):
    valid = runs.select(*metrics.LIST, F.col("input_position").alias("pos"), "item_id")
    errors = valid.where("user_id % 11 = 0 AND pos < 2").select(*metrics.LIST, "pos", F.when(F.col("pos") == 0, "cut off").otherwise("no list").alias("parse_error"))
    return records.export_result(said, valid, runs, metrics.LIST, errors).drop("scores")


@query("combined_metadata", """SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'a' END AS output_backend, 'f' AS prompt_family, NULL::VARCHAR AS prompt_version, NULL::VARCHAR AS scoring, NULL::VARCHAR AS prompt, CAST([] AS VARCHAR[]) AS raw_outputs, list(CASE WHEN permutation_index = 3 THEN 'repaired' ELSE 'valid' END ORDER BY permutation_index) AS parse_statuses, CAST([] AS VARCHAR[]) AS parse_errors,
    count(*) FILTER (WHERE permutation_index = 3) AS repaired_outputs, CAST(sum(10 * permutation_index) AS BIGINT) AS generated_tokens, 0.0::DOUBLE AS latency_seconds FROM (SELECT DISTINCT user_id, permutation_index FROM runs) GROUP BY user_id""", runs=RUNS)
def _(spark, runs):
    p = F.col("permutation_index")
    rows = runs.select("user_id", p).distinct().withColumns({"output_backend": F.when((F.col("user_id") % 2 == 0) | (p > 2), "a").otherwise("b"), "prompt_family": F.lit("f"), "parse_status": F.when(p == 3, "repaired").otherwise("valid"), "repaired": p == 3, "generated_tokens": 10 * p})
    return records.combined_metadata(rows, ["user_id"])


_RATES = {"parse_error_rate": "e", "parser_repair_attempt_rate": "r", **{f"{n}_output_rate": f"o{n[0]}" for n in ("invalid", "duplicate", "missing")}, **{f"avg_{n}_ids": f"s{n[0]}" for n in ("invalid", "duplicate", "missing")}}


@query("parser_quality", VALIDATED + """, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE user_id % 11 = 0) AS e, count(*) FILTER (WHERE num_invalid + num_duplicate + num_missing > 0) AS r,
    count(*) FILTER (WHERE num_invalid > 0) AS oi, count(*) FILTER (WHERE num_duplicate > 0) AS od, count(*) FILTER (WHERE num_missing > 0) AS om, CAST(sum(num_invalid) AS BIGINT) AS si, CAST(sum(num_duplicate) AS BIGINT) AS sd, CAST(sum(num_missing) AS BIGINT) AS sm FROM q)
    SELECT n AS num_outputs, e AS num_parse_errors, r AS num_parser_repair_attempts, oi AS num_outputs_with_invalid, si AS num_invalid_ids, od AS num_outputs_with_duplicate, sd AS num_duplicate_ids, om AS num_outputs_with_missing, sm AS num_missing_ids, """ + ", ".join(f"round({b}::DOUBLE / n, {DIGITS}) AS {a}" for a, b in _RATES.items()) + " FROM c", runs=RUNS, said=DAMAGED)
def _(spark, runs, said):
    out = _validated(runs, said).withColumn("parse_error", F.when(F.col("user_id") % 11 == 0, "failed")).withColumn("repaired", F.col("num_invalid") + F.col("num_duplicate") + F.col("num_missing") > 0)
    return rounded(metrics.parser_quality(out), *_RATES)


@query("parse_classify", """WITH x AS (SELECT d.user_id, d.permutation_index, d.pos, d.item_id AS label, r.item_id IS NOT NULL AS known, row_number() OVER (PARTITION BY d.user_id, d.permutation_index, d.item_id ORDER BY d.pos) AS k FROM said d LEFT JOIN runs r ON d.user_id = r.user_id AND d.permutation_index = r.permutation_index AND d.item_id = r.item_id),
    y AS (SELECT *, sum(CASE WHEN known AND k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, permutation_index ORDER BY pos) AS n FROM x)
    SELECT user_id, permutation_index, pos, label, CASE WHEN NOT known THEN 'unknown' WHEN k > 1 THEN 'duplicate' ELSE 'valid' END AS kind FROM y""", runs=RUNS, said=DAMAGED)
def _(spark, runs, said):
    return parsing.classify_labels(said.withColumnRenamed("item_id", "label"), runs.select(*metrics.LIST, F.col("item_id").alias("label")), metrics.LIST)


@query("parse_status", """WITH x AS (SELECT d.user_id, d.permutation_index, d.pos, r.item_id IS NOT NULL AS known, row_number() OVER (PARTITION BY d.user_id, d.permutation_index, d.item_id ORDER BY d.pos) AS k FROM said d LEFT JOIN runs r ON d.user_id = r.user_id AND d.permutation_index = r.permutation_index AND d.item_id = r.item_id),
    c AS (SELECT user_id, permutation_index, count(*) FILTER (WHERE known AND k = 1) AS num_valid, count(*) FILTER (WHERE known AND k > 1) AS num_duplicate, count(*) FILTER (WHERE NOT known) AS num_unknown FROM x GROUP BY user_id, permutation_index),
    m AS (SELECT user_id, permutation_index, count(*) AS need FROM runs GROUP BY user_id, permutation_index)
    SELECT user_id, permutation_index, num_valid, num_duplicate, num_unknown, need - num_valid AS num_missing, CASE WHEN num_duplicate > 0 OR num_unknown > 0 OR need <> num_valid THEN 'repaired' ELSE 'valid' END AS parse_status FROM m JOIN c USING (user_id, permutation_index)""", runs=RUNS, said=DAMAGED)
def _(spark, runs, said):
    expected = runs.select(*metrics.LIST, F.col("item_id").alias("label"))
    return parsing.parse_status(parsing.classify_labels(said.withColumnRenamed("item_id", "label"), expected, metrics.LIST), expected, metrics.LIST)


@query("parse_topk_status", """WITH x AS (SELECT d.*, r.item_id IS NOT NULL AS known, row_number() OVER (PARTITION BY d.user_id, d.permutation_index, d.item_id ORDER BY d.pos) AS k FROM said d LEFT JOIN runs r ON d.user_id = r.user_id AND d.permutation_index = r.permutation_index AND d.item_id = r.item_id),
    y AS (SELECT *, sum(CASE WHEN known AND k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, permutation_index ORDER BY pos) AS n FROM x),
    z AS (SELECT *, min(CASE WHEN known AND k = 1 THEN n END) OVER (PARTITION BY user_id, permutation_index, item_id) AS head FROM y),
    c AS (SELECT user_id, permutation_index, count(*) FILTER (WHERE known AND head <= 3 AND k = 1) AS v, count(*) FILTER (WHERE known AND head <= 3 AND k > 1) AS d, count(*) FILTER (WHERE NOT known OR head > 3) AS u FROM z GROUP BY user_id, permutation_index),
    m AS (SELECT user_id, permutation_index, count(*) AS need, user_id % 9 = 4 AS lost FROM runs GROUP BY user_id, permutation_index)
    SELECT user_id, permutation_index, CASE WHEN lost THEN 0 ELSE v END AS num_valid, CASE WHEN lost THEN 0 ELSE d END AS num_duplicate, CASE WHEN lost THEN 0 ELSE u END AS num_unknown,
      CASE WHEN lost THEN need WHEN v <> 3 THEN need - v ELSE 0 END AS num_missing, CASE WHEN lost THEN 'failed' WHEN v <> 3 OR d > 0 OR u > 0 THEN 'repaired' ELSE 'valid' END AS parse_status FROM m JOIN c USING (user_id, permutation_index)""", runs=RUNS, said=f"SELECT * FROM ({DAMAGED}) z WHERE pos < 3 OR user_id % 3 = 0")
def _(spark, runs, said):
    expected = runs.select(*metrics.LIST, F.col("item_id").alias("label"))
    kinds = parsing.classify_labels(said.withColumnRenamed("item_id", "label"), expected, metrics.LIST, 3)
    return parsing.parse_status(kinds, expected, metrics.LIST, 3, expected.where("user_id % 9 = 4"))


@query("parse_json", "SELECT user_id, permutation_index, list(item_id ORDER BY pos) AS labels FROM said GROUP BY user_id, permutation_index", said=DAMAGED)
def _(spark, said):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item_id"))), lambda x: x["item_id"])
    rows = said.groupBy(*metrics.LIST).agg(ids.alias("ids"))
    body = F.concat(F.lit('{"rank_order": ["'), F.array_join("ids", '", "'), F.lit('"]}'))
    text = F.when(F.col("user_id") % 3 == 0, body).when(F.col("user_id") % 3 == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("I rank "), body, F.lit(" so.")))
    return rows.select(*metrics.LIST, parsing.rank_order(text).alias("labels"))


# --- aggregation and reranking methods -----------------------------------------------------------------------------

@query("borda", """WITH z AS (SELECT *, count(*) OVER (PARTITION BY user_id, permutation_index) AS n FROM runs),
    a AS (SELECT user_id, item_id, CAST(sum(n - output_rank) AS BIGINT) AS points, sum(score) AS raw, min(CASE WHEN permutation_index = 1 THEN input_position END) AS outer_pos FROM z GROUP BY user_id, item_id)
    SELECT user_id, item_id, points, row_number() OVER (PARTITION BY user_id ORDER BY points DESC, raw DESC, outer_pos) - 1 AS output_rank FROM a""", runs=RUNS)
def _(spark, runs):
    return aggregate.borda(runs)


# every list's first item by score plays the target: where it stood, and where the list's best output stood
OBSERVED = """, o AS (SELECT a.user_id, a.permutation_index, a.input_position AS true_pos, b.input_position AS pred_pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id, permutation_index ORDER BY score + 12 * input_position DESC, item_id) AS t FROM runs) a JOIN runs b ON a.user_id = b.user_id AND a.permutation_index = b.permutation_index WHERE a.t = 1 AND b.output_rank = 0),
g AS (SELECT i AS true_pos, j AS pred_pos FROM range(0, 8) a(i) CROSS JOIN range(0, 8) b(j)),
v AS (SELECT g.true_pos, g.pred_pos, count(o.user_id) + 1.0::DOUBLE AS v FROM g LEFT JOIN o ON o.true_pos = g.true_pos AND o.pred_pos = g.pred_pos GROUP BY g.true_pos, g.pred_pos),
m AS (SELECT true_pos, pred_pos, v / sum(v) OVER (PARTITION BY true_pos) AS p FROM v)"""
ONE = "WITH one AS (SELECT 1)"


def _observed(runs: DataFrame) -> DataFrame:
    w = Window.partitionBy(*metrics.LIST)
    t = F.row_number().over(w.orderBy(F.desc(F.col("score") + 12 * F.col("input_position")), "item_id"))
    rows = runs.select("*", t.alias("t"), F.max(F.when(F.col("output_rank") == 0, F.col("input_position"))).over(w).alias("pred_pos"))
    return rows.where("t = 1").select(*metrics.LIST, F.col("input_position").cast("int").alias("true_pos"), F.col("pred_pos").cast("int").alias("pred_pos"))


@query("stella_calibration_matrix", ONE + OBSERVED + f" SELECT CAST(true_pos AS INT) AS true_pos, CAST(pred_pos AS INT) AS pred_pos, round(p, {DIGITS}) AS p FROM m", runs=RUNS)
def _(spark, runs):
    return rounded(aggregate.calibration_matrix(_observed(runs), 8), "p")


DIAG = ["mean_entropy", "normalised_entropy", "min_probability", "max_probability"]


@query("stella_diagnostics", ONE + OBSERVED + f", h AS (SELECT true_pos, sum(-p * ln(p)) AS h, min(p) AS a, max(p) AS b FROM m GROUP BY true_pos) SELECT round(avg(h), {DIGITS}) AS mean_entropy, round(avg(h) / ln(8.0::DOUBLE), {DIGITS}) AS normalised_entropy, round(min(a), {DIGITS}) AS min_probability, round(max(b), {DIGITS}) AS max_probability, list(round(h, {DIGITS}) ORDER BY true_pos) AS row_entropies FROM h", runs=RUNS)
def _(spark, runs):
    out = rounded(aggregate.calibration_diagnostics(aggregate.calibration_matrix(_observed(runs), 8), 8), *DIAG)
    return out.withColumn("row_entropies", F.transform("row_entropies", lambda h: F.round(h, DIGITS)))


@query("stella_update", ONE + OBSERVED + f""", q AS (SELECT r.user_id, m.true_pos AS pos, 0.125::DOUBLE * m.p AS v FROM o r JOIN m ON m.pred_pos = r.pred_pos WHERE r.permutation_index = 1)
    SELECT user_id AS request_id, CAST(pos AS INT) AS pos, round(v / sum(v) OVER (PARTITION BY user_id), {DIGITS}) AS p FROM q""", runs=RUNS)
def _(spark, runs):
    seen = _observed(runs)
    predicted = seen.where("permutation_index = 1").select(F.col("user_id").alias("request_id"), "pred_pos")
    prior = predicted.select("request_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos")).withColumn("p", F.lit(0.125))
    return rounded(aggregate.bayes_update(prior, aggregate.calibration_matrix(seen, 8), predicted), "p")


def _requests(runs: DataFrame) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("input_position", "item_id"))), lambda x: x["item_id"])
    return runs.where("permutation_index = 1").groupBy("user_id").agg(ids.alias("items"))


def biased_scorer(user: str, shown: list[str]) -> list[float]:
    """A deterministic scorer for tests: a hash of the item, less for later positions."""
    import hashlib

    return [int(hashlib.md5(f"{user}#{i}".encode()).hexdigest()[:4], 16) / 65536 - 0.05 * p for p, i in enumerate(shown)]


def _method(kind: str, user: str, ids: list[str]) -> list[int]:
    outer = list(range(len(ids)))
    seed = aggregate.request_seed(42, user, "test", ids, outer)
    if kind == "bootstrap":
        return aggregate.bootstrapping(biased_scorer, user, ids, outer, seed)
    if kind == "sgs":
        return aggregate.greedy_selection(biased_scorer, user, ids, outer, seed, 2)
    n = len(ids)
    return aggregate.stella(biased_scorer, aggregate.Calibrator([[n + 1.0 if i == j else 1.0 for j in range(n)] for i in range(n)]), user, ids, outer, seed)


for _kind in ("stella", "sgs", "bootstrap"):

    @query(f"{_kind}_rank", runs=RUNS)
    def _(spark, runs, kind=_kind):
        return aggregate.rerank(_requests(runs), partial(_method, kind))


ORDER_MAKERS = {
    "perm_random": lambda user, ids: permutations.random_orders(len(ids), 5, seed=42),
    "perm_fixed": lambda user, ids: permutations.fixed_orders(len(ids), 0, 2, 3, seed=42),
    "perm_sweep": lambda user, ids: [o for _, o in permutations.sweep_orders(len(ids), 0, 1, seed=42)],
    "perm_templates": lambda user, ids: permutations.template_orders(len(ids), [[0] + [None] * (len(ids) - 1), [None] * (len(ids) - 1) + [0]], seed=42),
    "perm_user_record": lambda user, ids: [[ids.index(i) for i in permutations.reshuffled(ids, permutations.user_seed(42, int(user), k))] for k in (1, 2, 3)],
}
for _name, _make in ORDER_MAKERS.items():

    @query(_name, runs=RUNS)
    def _(spark, runs, make=_make):
        return permutations.explode_orders(_requests(runs), make)

# what seeded draws must be, whatever they are: every order shows each of a user's items once, and pinned ones stand in their places
SHOWN = "WITH i AS (SELECT user_id, list_sort(list(item_id)) AS items FROM runs WHERE permutation_index = 1 GROUP BY user_id), f AS (SELECT user_id, item_id AS first FROM runs WHERE permutation_index = 1 AND input_position = 0)"
for _name, _count, _place in (("perm_random", 5, "NULL"), ("perm_fixed", 3, "2"), ("perm_sweep", 8, "permutation_index - 1"), ("perm_templates", 2, "CASE permutation_index WHEN 1 THEN 0 ELSE 7 END"), ("perm_user_record", 3, "NULL")):

    @query(f"{_name}_check", SHOWN + f" SELECT i.user_id, CAST(permutation_index AS INT) AS permutation_index, items, CASE WHEN {_place} IS NOT NULL THEN first END AS pinned FROM i JOIN f ON i.user_id = f.user_id, range(1, {_count + 1}) t(permutation_index)", runs=RUNS)
    def _(spark, runs, name=_name, place=_place):
        made = permutations.explode_orders(_requests(runs), ORDER_MAKERS[name])
        return made.select("user_id", "permutation_index", F.array_sort("items").alias("items"), F.expr(f"get(items, CAST({place} AS INT))").alias("pinned"))


for _kind in ("stella", "sgs", "bootstrap"):

    @query(f"{_kind}_rank_check", "SELECT user_id, count(*) AS n, list_sort(list(item_id)) AS items, list(CAST(input_position AS INT) ORDER BY input_position) AS ranks, list(CAST(8 - input_position AS DOUBLE) ORDER BY input_position) AS scores FROM runs WHERE permutation_index = 1 GROUP BY user_id", runs=RUNS)
    def _(spark, runs, kind=_kind):
        made = aggregate.rerank(_requests(runs), partial(_method, kind))
        by_rank = F.array_sort(F.collect_list(F.struct("output_rank", "score")))
        return made.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("item_id")).alias("items"), F.transform(by_rank, lambda x: x["output_rank"]).alias("ranks"), F.transform(by_rank, lambda x: x["score"]).alias("scores"))


# --- records' outputs, requests, movies ----------------------------------------------------------------------------

@query("reranking_outputs", """SELECT user_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(k AS INT) END AS permutation_index, CASE WHEN user_id % 3 = 0 AND user_id % 2 = 0 THEN 'own' END AS parse_error, CAST(CASE WHEN user_id % 3 = 0 THEN 1 WHEN k = 1 THEN 7 ELSE 2 END AS BIGINT) AS num_invalid,
    CAST(0 AS BIGINT) AS num_duplicate, CAST(CASE WHEN user_id % 3 = 0 THEN 3 ELSE 0 END AS BIGINT) AS num_missing, user_id % 3 > 0 AND k = 2 AS repaired FROM users, range(1, 3) t(k) WHERE user_id % 3 > 0 OR k = 1""", users=CUSTOMERS)
def _(spark, users):
    ids = lambda n: F.array_repeat(F.lit("x"), n)
    several = F.array(F.struct(ids(1).alias("invalid_item_ids"), F.lit(7).alias("num_invalid_item_ids"), F.lit(False).alias("parser_repair_applied")), F.struct(ids(2).alias("invalid_item_ids"), F.lit(None).cast("int").alias("num_invalid_item_ids"), F.lit(True).alias("parser_repair_applied")))
    rows = users.select("user_id", F.when(F.col("user_id") % 2 == 0, "own").alias("parse_error"), ids(1).alias("invalid_item_ids"), F.lit(3).alias("num_missing_candidate_item_ids"), F.when(F.col("user_id") % 3 > 0, several).alias("permutations"))
    return metrics.reranking_outputs(rows)


@query("rank_requests", "SELECT user_id, list(item_id ORDER BY CASE WHEN user_id % 2 = 0 THEN input_position ELSE -input_position END) AS shown FROM runs WHERE permutation_index = 1 GROUP BY user_id", runs=RUNS)
def _(spark, runs):
    back = F.transform(F.sequence(F.lit(0), F.size("items") - 1), lambda i: F.size("items") - 1 - i)
    asked = _requests(runs).select(F.col("user_id").alias("request_id"), "user_id", "items", F.when(F.col("user_id") % 2 == 1, back).alias("permutation"))
    return reranking.rank_requests(asked).select("user_id", "shown")


@query("items_movie_mapped", r"""WITH m AS (SELECT raw, row_number() OVER (ORDER BY raw) - 1 AS id FROM (SELECT CAST(item_id AS VARCHAR) AS raw FROM items WHERE item_id % 3 > 0))
    SELECT id AS item_id, raw AS raw_item_id, trim(regexp_replace(raw_title, '\s*\([0-9]{4}\)\s*$', '')) AS title, CASE WHEN item_id % 5 = 0 THEN '' ELSE genres END AS genres, TRY_CAST(regexp_extract(raw_title, '\(([0-9]{4})\)\s*$', 1) AS INT) AS release_year FROM items JOIN m ON CAST(item_id AS VARCHAR) = raw""", items=ITEMS)
def _(spark, items):
    movies = items.select(F.col("item_id").alias("movieId"), F.col("raw_title").alias("title"), F.when(F.col("item_id") % 5 == 0, "(no genres listed)").otherwise(F.col("genres")).alias("genres"))
    known = items.where("item_id % 3 > 0").select(F.col("item_id").cast("string").alias("raw"))
    return prep.movie_metadata(movies, prep.id_mapping(known, "raw", "id"))


@query("candidate_item_ids", "SELECT user_id, list(item_id ORDER BY input_position) AS ids FROM runs WHERE permutation_index = 1 GROUP BY user_id", runs=RUNS)
def _(spark, runs):
    entry = F.struct((F.col("input_position") + 8).cast("string").alias("key"), F.struct("item_id", "score").alias("value"))
    by_rank = runs.where("permutation_index = 1").groupBy("user_id").agg(F.map_from_entries(F.collect_list(entry)).alias("candidates"))
    return by_rank.select("user_id", records.candidate_item_ids(F.col("candidates")).alias("ids"))


@query("rebased_positions", "SELECT user_id, list(CAST(input_position AS INT) ORDER BY output_rank) AS places FROM runs WHERE permutation_index = 1 GROUP BY user_id", runs=RUNS)
def _(spark, runs):
    rows = runs.where("permutation_index = 1").withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("item_id")) - 1)
    item = F.struct("output_rank", F.col("at").alias("candidate_index"), F.lit(0).alias("input_position"))
    lists = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.transform(F.array_sort(F.collect_list(F.struct("input_position", "at"))), lambda x: x["at"]).alias("order"))
    return lists.select("user_id", F.transform(records.rebased(F.col("items"), F.col("order")), lambda x: x["input_position"]).alias("places"))


@query("result_metadata", "SELECT user_id, 'stella' AS method, CAST(user_id % 5 AS INT) AS forward_passes, CASE WHEN user_id % 2 = 0 THEN 'kept' END AS note FROM users", users=CUSTOMERS)
def _(spark, users):
    own = F.when(F.col("user_id") % 2 == 0, F.to_variant_object(F.struct(F.lit("kept").alias("note"), F.lit("old").alias("method"))))
    more = records.with_metadata(own, method=F.lit("stella"), forward_passes=(F.col("user_id") % 5).cast("int"))
    return users.select("user_id", more.alias("m")).select("user_id", *(F.try_variant_get("m", f"$.{c}", kind).alias(c) for c, kind in (("method", "string"), ("forward_passes", "int"), ("note", "string"))))


@query("artifact_samples", """SELECT CAST(r.user_id AS VARCHAR) AS user_id, CAST(input_position AS INT) AS at, r.item_id, CASE WHEN input_position % 2 = 0 THEN r.item_id ELSE 'named' END AS title, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS relevance, CASE WHEN r.user_id % 3 = 0 THEN 0 ELSE 1 END AS past
    FROM runs r LEFT JOIN (SELECT DISTINCT * FROM truth) t ON r.user_id = t.user_id AND r.item_id = t.item_id WHERE permutation_index = 1 AND r.user_id IN (SELECT a.user_id FROM runs a JOIN truth b ON a.user_id = b.user_id AND a.item_id = b.item_id WHERE a.permutation_index = 1)""", runs=RUNS, truth=TRUTH)
def _(spark, runs, truth):
    item = F.struct("input_position", "item_id", F.when(F.col("input_position") % 2 == 0, " ").otherwise("named").alias("title"))
    lists = runs.where("permutation_index = 1").groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("candidates"))
    true = truth.groupBy("user_id").agg(F.collect_list("item_id").alias("ground_truth_item_ids"))
    histories = runs.where("user_id % 3 > 0").select("user_id").distinct().withColumn("history", F.array(F.struct(F.lit("h").alias("item_id"))))
    made = reranking.samples_from_artifact(lists.join(true, "user_id", "left").withColumn("split", F.lit("train")), histories)
    return made.select("user_id", F.posexplode("candidates").alias("at", "c"), F.size("history").alias("past")).select("user_id", "at", "c.item_id", "c.title", "c.relevance", "past")


@query("candidate_count_violations", "SELECT request_id, observed, CAST(3 AS BIGINT) AS expected FROM (SELECT request_id, count(*) FILTER (WHERE kind = '/ITEM' AND NOT (request_id % 4 = 1 AND pos > 20)) AS observed FROM tokens GROUP BY request_id) WHERE observed <> 3", tokens=TOKENS)
def _(spark, tokens):
    whole = tokens.where("kind = '/ITEM' AND NOT (request_id % 4 = 1 AND pos > 20)").select("request_id", F.col("pos").alias("item"))
    return marker.candidate_count_violations(whole, tokens.select("request_id").distinct().withColumn("n", F.lit(3)))


@query("metric_lines", "SELECT CAST(0 AS INT) AS place, 'num_interactions: ' || count(*) AS line FROM log UNION ALL SELECT 1, 'num_positive_interactions: ' || count(*) FILTER (WHERE rating >= 4) FROM log UNION ALL SELECT 2, 'num_users: ' || count(DISTINCT user_id) FROM log UNION ALL SELECT 3, 'num_items: ' || count(DISTINCT item_id) FROM log UNION ALL SELECT 4, 'share: 0.250000' UNION ALL SELECT 5, 'none: none'", log=LOG)
def _(spark, log):
    return reports.metric_lines(prep.dataset_stats(log, 4.0).withColumns({"share": F.lit(0.25), "none": F.lit(None).cast("double"), "list": F.array(F.lit(1))}))


# --- calibration, evidence, histories ------------------------------------------------------------------------------

FIRST_LISTS = "SELECT user_id, input_position AS pos, item_id FROM (" + RUNS + ") x WHERE permutation_index = 1"


@query("probe_violations", """WITH t AS (SELECT DISTINCT * FROM truth), h AS (SELECT DISTINCT c.user_id FROM candidates c JOIN t ON c.user_id = t.user_id AND c.item_id = t.item_id)
    SELECT DISTINCT user_id, CASE WHEN user_id IN (SELECT user_id FROM t) THEN 'no true item among the candidates' ELSE 'no true item' END AS problem FROM candidates WHERE user_id NOT IN (SELECT user_id FROM h)""", candidates=FIRST_LISTS, truth=TRUTH + " AND c_custkey % 11 <> 3 UNION ALL SELECT c_custkey AS user_id, 'elsewhere' AS item_id FROM {customer} WHERE c_custkey % 11 = 3")
def _(spark, candidates, truth):
    return calibration.probe_violations(candidates, truth)


def _true_first(lists: list[tuple[str, list[str]]]) -> list[list[float]]:
    """Scores by which an item of a user's own first true place wins wherever it is shown."""
    return [[float(i == f"i{(int(user) * 31 + 17) % 1000}") for i in shown] for user, shown in lists]


@query("run_seeds", "SELECT user_id, CAST(k AS INT) AS permutation_index, CAST(42 + user_id * 100000 + k - 1 AS BIGINT) AS permutation_seed FROM users, range(1, 4) t(k)", users=CUSTOMERS)
def _(spark, users):
    return permutations.run_seeds(users, 3)


@query("calibration_grid", """WITH h AS (SELECT DISTINCT c.user_id, c.pos FROM candidates c JOIN truth t ON c.user_id = t.user_id AND c.item_id = t.item_id)
    SELECT user_id, CAST(pos AS INT) AS target, CAST(p AS INT) AS true_pos, CAST(r AS INT) AS repeat, CAST(pos AS INT) AS shown, [0, 1, 2, 3, 4, 5, 6, 7] AS places FROM h, range(0, 8) a(p), range(0, 2) b(r)""", candidates=FIRST_LISTS, truth=TRUTH)
def _(spark, candidates, truth):
    asked = calibration.calibration_requests(candidates, truth, 8, repeats=2)
    return asked.select("user_id", "target", "true_pos", "repeat", F.get("permutation", "true_pos").alias("shown"), F.array_sort("permutation").alias("places"))


@query("calibration_counts", """WITH t AS (SELECT DISTINCT * FROM truth), h AS (SELECT c.user_id FROM candidates c JOIN t ON c.user_id = t.user_id AND c.item_id = t.item_id)
    SELECT CAST(p AS INT) AS true_pos, CAST(p AS INT) AS pred_pos, count(*) AS n FROM h, range(0, 8) a(p), range(0, 2) b(r) GROUP BY p""", candidates=FIRST_LISTS, truth="SELECT * FROM (" + TRUTH + ") y WHERE user_id % 2 = 1")
def _(spark, candidates, truth):
    asked = calibration.calibration_requests(candidates, truth, 8, repeats=2)
    return calibration.score_requests(asked, candidates, _true_first)


@query("evidence_records", """WITH z AS (SELECT r.*, dense_rank() OVER (PARTITION BY user_id ORDER BY r.item_id) - 1 AS idx FROM runs r)
    SELECT CAST(z.user_id AS BIGINT) AS sample_index, CAST(permutation_index - 1 AS INT) AS permutation_index, CAST(row_number() OVER (PARTITION BY z.user_id, permutation_index ORDER BY score DESC, input_position) - 1 AS INT) AS rank, z.item_id, CAST(idx AS INT) AS candidate_index,
      CAST(input_position AS INT) AS input_position, CAST(score AS DOUBLE) AS score, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS relevance FROM z LEFT JOIN (SELECT DISTINCT * FROM truth) t ON z.user_id = t.user_id AND z.item_id = t.item_id""", runs=RUNS, truth=TRUTH)
def _(spark, runs, truth):
    return evidence.permutation_rank_records(_samples(runs, truth)).select("sample_index", "permutation_index", F.posexplode("ranking").alias("rank", "x")).select("sample_index", "permutation_index", "rank", F.col("x.candidate_id").alias("item_id"), F.col("x.candidate_index").alias("candidate_index"), F.col("x.input_position").alias("input_position"), F.col("x.score").alias("score"), F.col("x.relevance").alias("relevance"))


def _samples(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """A sample a user: its candidates in the order of ids, and its lists as runs over their places."""
    rows = retrieval.relevance(runs.where(F.col("user_id").isNotNull()), truth)
    item = F.struct("input_position", "item_id", F.col("score").cast("double").alias("score"), "relevance")
    lists = rows.groupBy("user_id", "permutation_index").agg(F.sort_array(F.collect_list(item)).alias("l"))
    users = lists.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("permutation_index", "l"))).alias("lists"))
    ids = F.sort_array(F.array_distinct(F.flatten(F.transform("lists", lambda x: F.transform(x["l"], lambda i: i["item_id"])))))
    users = users.select("user_id", "lists", F.explode(F.array(ids)).alias("candidate_ids"))  # made once, not for each item that is looked up
    at = lambda x: (F.array_position("candidate_ids", x["item_id"]) - 1).cast("int")
    run = lambda l: F.struct(F.transform(l, at).alias("permutation"), F.transform(l, lambda x: x["score"]).alias("scores"), F.transform(l, lambda x: x["relevance"]).alias("relevance"))
    out = users.select("user_id", "candidate_ids", F.transform("lists", lambda x: run(x["l"])).alias("runs"))
    return out.select(F.col("user_id").cast("long").alias("sample_index"), "user_id", F.lit("test").alias("split"), F.array().cast("array<string>").alias("history"), F.transform("candidate_ids", lambda i: F.struct(i.alias("item_id"))).alias("candidates"), "candidate_ids", "runs")


@query("evidence_round_trip", """SELECT CAST(user_id AS BIGINT) AS sample_index, 8 AS num_items, CAST(count(DISTINCT permutation_index) AS INT) AS lists, round(max(score), 3) AS best, string_agg(item_id, ',' ORDER BY output_rank) FILTER (WHERE permutation_index = 2) AS second FROM runs GROUP BY user_id""", runs=RUNS, truth=TRUTH)
def _(spark, runs, truth):
    made = evidence.as_json(evidence.rank_records(_samples(runs, truth).withColumn("note", F.lit("kept"))))
    back = evidence.parse_records(made).where("variant_get(extra, '$.note', 'string') = 'kept'")
    second = F.array_join(F.element_at("permutations", 2)["output_ranking"]["item_ids"], ",")
    best = F.array_max(F.flatten(F.transform("permutations", lambda p: p["scores"])))
    return back.select("sample_index", "num_items", F.size("permutations").alias("lists"), F.round(best, 3).alias("best"), second.alias("second"))


@query("user_histories", SPLIT.replace("ORDER BY ts, item_id, event_id", "ORDER BY ts, item_id, rating") + """, h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id, rating) AS place FROM s WHERE split IN ('train', 'val'))
    SELECT u.user_id, CAST(place AS INT) AS place, CASE WHEN place IS NOT NULL THEN coalesce(i.raw_item_id, CAST(h.item_id AS VARCHAR)) END AS item_id, raw_title AS title, list_filter(string_split(genres, '|'), lambda x: x <> '') AS genres, CAST(1990 + h.item_id % 3 AS INT) AS year, rating
    FROM users u LEFT JOIN h ON u.user_id = h.user_id AND place <= 5 LEFT JOIN items i ON h.item_id = i.item_id AND i.item_id % 3 > 0""".replace("CAST(1990 + h.item_id % 3 AS INT)", "CASE WHEN i.item_id IS NOT NULL THEN CAST(1990 + h.item_id % 3 AS INT) END"), users=CUSTOMERS, log=LOG, items=ITEMS)
def _(spark, users, log, items):
    parts = prep.temporal_split(log, 0.7, 0.1, 10, ["rating"])
    known = items.where("item_id % 3 > 0").select("item_id", "raw_item_id", F.col("raw_title").alias("title"), "genres", (1990 + F.col("item_id") % 3).alias("release_year"))
    lists = datasets.history_lists(users, prep.context_of("test", parts).withColumnRenamed("ts", "timestamp"), known, 5)
    return lists.select("user_id", F.posexplode_outer("history").alias("at", "h")).select("user_id", (F.col("at") + 1).alias("place"), "h.*")


@query("dataset_statistics", SPLIT.replace("ORDER BY ts, item_id, event_id", "ORDER BY ts, item_id, rating").replace("'test' END AS split FROM e", "'test' END AS split FROM e") + """, k AS (SELECT * FROM log QUALIFY count(*) OVER (PARTITION BY user_id) >= 10), t AS (SELECT user_id, count(*) AS n FROM s WHERE split = 'train' GROUP BY user_id)
    SELECT (SELECT count(*) FROM k) AS num_interactions, (SELECT count(*) FROM k WHERE rating >= 4) AS num_positive_interactions, (SELECT sum(n)::BIGINT FROM t) AS num_train, (SELECT sum(n - CASE WHEN n >= 2 THEN 1 ELSE 0 END)::BIGINT FROM t) AS num_retriever_train, (SELECT count(*) FROM t WHERE n >= 2) AS num_train_queries,
      (SELECT count(*) FROM s WHERE split = 'val') AS num_val, (SELECT count(*) FROM s WHERE split = 'test') AS num_test, (SELECT count(DISTINCT user_id) FROM k) AS num_users, (SELECT count(DISTINCT item_id) FROM k) AS num_items, (SELECT count(DISTINCT k.item_id) FROM k JOIN items i ON k.item_id = i.item_id) AS items_with_metadata""", log=LOG, items=ITEMS)
def _(spark, log, items):
    meta = lambda ids: items.select(F.col("item_id").alias("raw"), F.col("raw_title").alias("title")).join(ids, "raw").select(F.col("id").alias("item_id"), "title")
    _, stats = datasets.prepare(log.withColumnRenamed("ts", "timestamp"), meta, 4.0, 10)
    return spark.createDataFrame([stats], ", ".join(f"{k} long" for k in stats))


# --- prompts and markers -------------------------------------------------------------------------------------------

PROMPT_ITEMS = "SELECT item_id, p_title AS title, yr AS year, genres FROM (SELECT p_partkey AS item_id, p_name AS p_title, 1990 + p_size % 35 AS yr, concat(p_type, '|', p_brand) AS genres FROM {part}) z"


def _prompt_rows(log: DataFrame, items: DataFrame) -> DataFrame:
    """user_id, history and candidates: each user's five newest and five oldest items."""
    w = Window.partitionBy("user_id")
    rows = log.select("*", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))).alias("a"), F.row_number().over(w.orderBy("ts", "event_id")).alias("b")).where("a <= 5 OR b <= 5").join(items, "item_id", "left")
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= 5, F.struct(F.col(c).alias("o"), F.struct("title", "year", F.col("rating").cast("int").alias("rating"), prep.genre_list(F.col("genres")).alias("genres")).alias("x"))))), lambda v: v["x"])
    return rows.groupBy("user_id").agg(pick("a").alias("history"), pick("b").alias("candidates"))


PROMPT = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM log),
z AS (SELECT r.*, coalesce(title, '') AS t, coalesce(' (' || year || ')', '') AS yt, ', rating: ' || CAST(rating AS INT) AS rt, coalesce(', genres: ' || replace(genres, '|', ', '), '') AS gt FROM r LEFT JOIN items i ON r.item_id = i.item_id),
h AS (SELECT user_id, {h} AS h, {c} AS c FROM z GROUP BY user_id)"""
NL = "chr(10)"


@query("prompt_marker", PROMPT.format(h=f"string_agg('title: ' || t || yt || rt || gt, {NL} ORDER BY a) FILTER (WHERE a <= 5)", c=f"string_agg('[ITEM]' || {NL} || t || yt || gt || {NL} || '[/ITEM]' || {NL}, {NL} ORDER BY b) FILTER (WHERE b <= 5)") + f""" SELECT user_id, concat_ws({NL}, '[SPAN]', '{prompts.MARKER_INSTRUCTION.replace("'", "''")}', '', 'User history:', h, '[/SPAN]', '', c) AS prompt FROM h""", log=LOG, items=PROMPT_ITEMS)
def _(spark, log, items):
    return _prompt_rows(log, items).select("user_id", prompts.marker_prompt(F.col("history"), F.col("candidates")).alias("prompt"))


@query("prompt_rankgpt", PROMPT.format(h=f"string_agg(t || yt || rt || gt, {NL} ORDER BY a) FILTER (WHERE a <= 5)", c=f"string_agg('[C' || (b - 1) || '] ' || t || yt || gt, {NL} ORDER BY b) FILTER (WHERE b <= 5)") + f""" SELECT user_id, concat_ws({NL}, '{prompts.LIST_INSTRUCTION}', '', 'User history:', h, '', 'Candidate items:', c, '', '{prompts.RANK_ALL}', 'Return only JSON in this format: {{"rank_order": ["C0", "C1", "C2", "C3", "C4"]}}.') AS prompt FROM h""", log=LOG, items=PROMPT_ITEMS)
def _(spark, log, items):
    labels = F.transform(F.sequence(F.lit(0), F.size("candidates") - 1), lambda i: F.concat(F.lit("C"), i.cast("string")))
    return _prompt_rows(log, items).select("user_id", prompts.list_prompt(F.col("history"), F.col("candidates"), labels).alias("prompt"))

CUSTOM = {"instruction": "Order {{these}}.", "history_header": "", "history_item_format": "{item_id}: {title} [{year}]{{ok}}", "candidate_item_format": "{title}|{genres}{rating_text}", "candidate_separator": "--"}


@query("prompt_template", SQL["prompt_marker"][SQL["prompt_marker"].index(", r AS (") :].replace(", r AS (", "WITH r AS (", 1), log=LOG, items=PROMPT_ITEMS)
def _(spark, log, items):
    made = templates.templated_prompt(F.col("history"), F.col("candidates"), templates.load_template(spark), ["title", "year", "rating", "genres"])
    return _prompt_rows(log, items).select("user_id", made.alias("prompt"))


@query("prompt_template_own", PROMPT.format(h=f"string_agg('0: ' || t || ' [' || substr(yt, 3, 4) || ']{{ok}}', {NL} ORDER BY a) FILTER (WHERE a <= 5)", c=f"string_agg('<i>' || {NL} || t || '|' || substr(gt, 11) || rt || {NL} || '</i>' || {NL} || '--', {NL} ORDER BY b) FILTER (WHERE b <= 5)") + f""" SELECT user_id, concat_ws({NL}, '<u>', 'Order {{{{these}}}}.', '', h, '</u>', '', c) AS prompt FROM h""", log=LOG, items=PROMPT_ITEMS)
def _(spark, log, items):
    made = templates.templated_prompt(F.col("history"), F.col("candidates"), templates.DEFAULT | CUSTOM, ["title", "year", "rating", "genres"], ("<u>", "</u>", "<i>", "</i>"))
    return _prompt_rows(log, items).select("user_id", made.alias("prompt"))


CELLS = """SELECT p_partkey AS item_id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('P', CAST(p_partkey AS VARCHAR(20))) END AS raw_item_id, p_name AS title,
  CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('["', p_type, '", "', p_brand, '"]') WHEN 2 THEN concat('[', p_type, ']') WHEN 3 THEN concat(p_type, '||', p_brand) WHEN 4 THEN ' [] ' ELSE p_brand END AS genres,
  CASE p_partkey % 3 WHEN 0 THEN concat(chr(123), '"size": ', CAST(p_size AS VARCHAR(20)), ', "kind": "', p_type, '"', chr(125)) WHEN 1 THEN concat(chr(123), '"size": ', CAST(p_size AS VARCHAR(20))) ELSE concat(chr(123), '"size": ', chr(125)) END AS details,
  CASE WHEN p_partkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(p_retailprice AS DOUBLE) END AS price FROM {part}"""


@query("item_metadata", """SELECT item_id, CASE WHEN json_valid(genres) THEN from_json(genres, '["VARCHAR"]') END AS genre_list, CASE WHEN NOT json_valid(genres) THEN genres END AS genre_text,
    CASE WHEN json_valid(details) THEN CAST(json_extract_string(details, '$.size') AS INT) END AS size, CASE WHEN NOT json_valid(details) THEN details END AS broken, CASE WHEN NOT isnan(price) THEN price END AS price FROM cells""", cells=CELLS)
def _(spark, cells):
    v = metadata.clean_items(cells)
    of = lambda c, kind: metadata.typed(F.col(c), kind)
    return v.select("item_id", of("genres", "array<string>").alias("genre_list"), of("genres", "string").alias("genre_text"), F.try_variant_get("details", "$.size", "int").alias("size"), of("details", "string").alias("broken"), of("price", "double").alias("price"))


@query("display_candidates", """SELECT user_id, input_position AS rank, coalesce(raw_item_id, CAST(c.item_id AS VARCHAR)) AS item_id, title,
    CASE WHEN json_valid(genres) THEN from_json(genres, '["VARCHAR"]') ELSE list_filter(string_split(genres, '|'), lambda x: x <> '') END AS genres FROM (SELECT user_id, input_position, CAST(substr(item_id, 2) AS BIGINT) AS item_id FROM runs WHERE permutation_index = 1) c LEFT JOIN cells ON c.item_id = cells.item_id""", cells=CELLS, runs=RUNS)
def _(spark, cells, runs):
    lists = runs.where("permutation_index = 1").select("user_id", F.col("input_position").alias("rank"), F.substring("item_id", 2, 20).cast("long").alias("item_id"))
    shown = metadata.display_candidates(lists, metadata.clean_items(cells))
    return shown.select("user_id", "rank", "item_id", metadata.typed(F.col("title"), "string").alias("title"), metadata.typed(F.col("genres"), "array<string>").alias("genres"))


@query("display_truth", """SELECT user_id, list(coalesce(raw_item_id, CAST(t.item_id AS VARCHAR)) ORDER BY t.item_id) AS ground_truth_item_ids FROM (SELECT user_id, CAST(substr(item_id, 2) AS BIGINT) AS item_id FROM truth) t LEFT JOIN cells ON t.item_id = cells.item_id GROUP BY user_id""", cells=CELLS, truth=TRUTH)
def _(spark, cells, truth):
    return metadata.display_truth(truth.select("user_id", F.substring("item_id", 2, 20).cast("long").alias("item_id")), metadata.clean_items(cells))


SPANS = """WITH sp AS (SELECT request_id, min(CASE WHEN kind = 'SPAN' THEN pos END) AS a, min(CASE WHEN kind = '/SPAN' THEN pos END) + 1 AS b FROM tokens GROUP BY request_id),
it AS (SELECT s.request_id, s.item - 1 AS item, s.pos AS s, e.pos + 1 AS e FROM (SELECT request_id, pos, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS item FROM tokens WHERE kind = 'ITEM') s JOIN (SELECT request_id, pos, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS item FROM tokens WHERE kind = '/ITEM') e ON s.request_id = e.request_id AND s.item = e.item)"""


@query("span_extract", SPANS + " SELECT it.request_id, a AS span_start, b AS span_end, item, s, e FROM it JOIN sp ON it.request_id = sp.request_id", tokens=TOKENS)
def _(spark, tokens):
    return marker.span_rows(tokens)


@query("span_truncated", SPANS + " SELECT it.request_id, a AS span_start, b AS span_end, item, s, e FROM it JOIN sp ON it.request_id = sp.request_id", tokens=f"SELECT * FROM ({TOKENS}) z WHERE pos < 22")
def _(spark, tokens):
    return marker.span_rows(tokens)


@query("span_mean_logprob", SPANS + f" SELECT t.request_id, item, round(avg(logprob), {DIGITS}) AS score FROM tokens t JOIN it ON t.request_id = it.request_id AND pos > s AND pos < e - 1 GROUP BY t.request_id, item", tokens=TOKENS)
def _(spark, tokens):
    return rounded(marker.span_mean_logprob(tokens), "score")


@query("shared_positions", SPANS + " SELECT t.request_id, pos, CASE WHEN it.s IS NOT NULL THEN b - a + pos - s WHEN pos >= a AND pos < b THEN pos - a ELSE 0 END AS position_id FROM tokens t JOIN sp ON t.request_id = sp.request_id LEFT JOIN it ON t.request_id = it.request_id AND pos >= s AND pos < e", tokens=TOKENS)
def _(spark, tokens):
    return marker.shared_positions(tokens)


@query("standard_positions", "SELECT request_id, pos, CASE WHEN mask = 0 THEN 0 ELSE CAST(sum(mask) OVER (PARTITION BY request_id ORDER BY pos) - 1 AS BIGINT) END AS position_id FROM tokens", tokens=TOKENS)
def _(spark, tokens):
    return marker.standard_positions(tokens)


@query("block_mask", SPANS + """, x AS (SELECT q.request_id, q.pos AS q, k.pos AS k, q.mask AS qm, k.mask AS km, a, b, it.s, it.e FROM tokens q JOIN tokens k ON q.request_id = k.request_id JOIN sp ON q.request_id = sp.request_id LEFT JOIN it ON q.request_id = it.request_id AND q.pos >= it.s AND q.pos < it.e)
    SELECT request_id, q, k FROM x WHERE (km = 1 AND CASE WHEN s IS NOT NULL THEN (k >= a AND k < b) OR (k >= s AND k < e AND k <= q) WHEN q >= a AND q < b THEN k >= a AND k < b AND k <= q ELSE qm = 1 AND ((k >= a AND k < b AND k <= q) OR k = q) END) OR (q = k AND qm = 0)""", tokens=TOKENS)
def _(spark, tokens):
    return marker.block_mask(tokens)


@query("causal_mask", "SELECT q.request_id, q.pos AS q, k.pos AS k FROM tokens q JOIN tokens k ON q.request_id = k.request_id AND k.pos <= q.pos AND k.mask = 1", tokens=TOKENS)
def _(spark, tokens):
    return marker.attention_mask(tokens, "causal")


# --- runs and reports ----------------------------------------------------------------------------------------------

def _shown(runs: DataFrame) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("input_position", "item_id"))), lambda x: x["item_id"])
    return runs.groupBy("user_id", "permutation_index").agg(ids.alias("items"))


def letter_scorer(lists: list[tuple[str, list[str]]]) -> list[list[float]]:
    """A batch scorer that SQL can say: the first two hex digits of a hash of the item, as letters."""
    import hashlib

    digits = lambda item: hashlib.md5(item.encode()).hexdigest()
    return [[ord(digits(i)[0]) * 2.0 + ord(digits(i)[1]) for i in shown] for _, shown in lists]


@query("zero_shot_run", """WITH z AS (SELECT user_id, permutation_index, item_id, CAST(input_position AS INT) AS input_position, CAST(ascii(substr(md5(item_id), 1, 1)) * 2 + ascii(substr(md5(item_id), 2, 1)) AS DOUBLE) AS score FROM runs)
    SELECT *, CAST(row_number() OVER (PARTITION BY user_id, permutation_index ORDER BY score DESC, input_position) - 1 AS INT) AS output_rank FROM z""", runs=RUNS)
def _(spark, runs):
    return reranking.run_reranking(_shown(runs), letter_scorer)


ODD_REQUESTS = f"""SELECT user_id, item_id, input_position, CASE WHEN user_id % 6 = 1 AND input_position = 2 THEN 0 ELSE input_position END AS place,
    CASE WHEN user_id % 4 = 1 AND input_position = 3 THEN ' ' ELSE concat('T ', item_id) END AS title, CASE WHEN user_id % 5 = 1 AND input_position = 1 THEN 'i' ELSE item_id END AS odd FROM ({RUNS}) z WHERE permutation_index = 1"""


@query("request_violations", """WITH r AS (SELECT user_id, count(*) AS n, count(DISTINCT odd) AS items, count(*) FILTER (WHERE trim(title) = '') AS blank, count(DISTINCT place) AS places FROM rows GROUP BY user_id)
    SELECT rule, v AS violations FROM (SELECT 'no_candidates' AS rule, count(*) FILTER (WHERE n = 0) AS v FROM r UNION ALL SELECT 'missing_ids', 0 UNION ALL SELECT 'repeated_items', count(*) FILTER (WHERE items < n) FROM r
    UNION ALL SELECT 'blank_titles', count(*) FILTER (WHERE blank > 0) FROM r UNION ALL SELECT 'broken_order', count(*) FILTER (WHERE places < n) FROM r) z""", rows=ODD_REQUESTS)
def _(spark, rows):
    e = F.array_sort(F.collect_list(F.struct("input_position", "odd", "title", "place")))
    each = lambda c: F.transform("e", lambda x: x[c])
    return reranking.request_violations(rows.groupBy("user_id").agg(e.alias("e")).select("user_id", each("odd").alias("items"), each("title").alias("titles"), each("place").alias("permutation")))


@query("training_samples", """WITH z AS (SELECT r.user_id, r.item_id, r.output_rank + 1 AS rank, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS y FROM runs r LEFT JOIN (SELECT DISTINCT user_id, item_id FROM truth) t ON t.user_id = r.user_id AND t.item_id = r.item_id WHERE r.permutation_index = 1)
    SELECT user_id, string_agg(item_id, ',' ORDER BY rank) AS items, string_agg(CAST(y AS VARCHAR), ',' ORDER BY rank) AS relevance FROM z GROUP BY user_id HAVING max(y) = 1""", runs=RUNS, truth=TRUTH)
def _(spark, runs, truth):
    out = reranking.training_samples(runs.where("permutation_index = 1").select("user_id", "item_id", (F.col("output_rank") + 1).alias("rank")), truth)
    return out.select("user_id", F.array_join("items", ",").alias("items"), F.array_join(F.col("relevance").cast("array<string>"), ",").alias("relevance"))


#: Users of whom every third has its own list only.
FALLBACK = f"SELECT * FROM ({RUNS}) z WHERE user_id % 3 <> 0 OR permutation_index = 2"


@query("effectiveness_fallback", EFFECT + " SELECT " + ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in ("hit_rate", "recall", "ndcg", "mrr")) + " FROM f", runs=FALLBACK, truth=TRUTH)
def _(spark, runs, truth):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("output_rank", "item_id"))), lambda x: x["item_id"])
    lists = runs.groupBy("user_id", "permutation_index").agg(ids.alias("ids"))
    many = F.col("user_id") % 3 != 0
    users = lists.groupBy("user_id").agg(F.collect_list(F.when(many, F.struct("permutation_index", F.col("ids").alias("reranked_item_ids")))).alias("permutations"), F.first(F.when(~many, F.col("ids"))).alias("reranked_item_ids"))
    return rounded(metrics.effectiveness(reports.result_lists(users), truth, K), "hit_rate", "recall", "ndcg", "mrr")


@query("position_bias", EXPOSURE + f""" SELECT 3 AS k, (SELECT count(DISTINCT user_id) FROM runs) AS num_users, (SELECT count(DISTINCT (user_id, permutation_index)) FROM runs) AS num_lists, (SELECT count(*) FROM runs) AS num_observations,
    string_agg(CAST(input_position AS VARCHAR), ',' ORDER BY input_position) AS places, round(max(abs(exposure - expected)), {DIGITS}) AS max_abs_deviation, round(avg(abs(exposure - expected)), {DIGITS}) AS mean_abs_deviation FROM e""", runs=RUNS)
def _(spark, runs):
    out = reports.position_bias(runs, K).withColumn("places", F.array_join(F.col("input_position").cast("array<string>"), ","))
    return rounded(out, "max_abs_deviation", "mean_abs_deviation").select("k", "num_users", "num_lists", "num_observations", "places", "max_abs_deviation", "mean_abs_deviation")


@query("evaluation_row", runs=RUNS, truth=TRUTH)
def _(spark, runs, truth):
    return reports.evaluation(runs, truth, K, full=True)


@query("evaluation_row_checked", f"SELECT a.*, b.*, (SELECT count(DISTINCT user_id) FROM runs) AS num_users, 3 AS k FROM ({SQL['effectiveness_all']}) a, ({SQL['robustness_macro']}) b", runs=RUNS, truth=TRUTH)
def _(spark, runs, truth):
    # without preference consistency, whose index has no SQL
    return rounded(reports.evaluation(runs, truth, K, full=True, preference=False), "hit_rate", "recall", "ndcg", "mrr", *MACRO)


@query("export_selection", """WITH u AS (SELECT DISTINCT user_id FROM truth), o AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS place FROM u),
    h AS (SELECT DISTINCT o.user_id, o.place FROM o JOIN truth t ON t.user_id = o.user_id JOIN runs r ON r.user_id = t.user_id AND r.item_id = t.item_id WHERE r.permutation_index = 1 AND r.output_rank < 2),
    s AS (SELECT * FROM h ORDER BY place LIMIT 5), n AS (SELECT count(*) AS total FROM u)
    SELECT (SELECT total FROM n) AS num_users_available, count(*) AS num_users_selected, CASE WHEN count(*) >= 5 THEN least((SELECT total FROM n), (max(place) // 4 + 1) * 4) ELSE (SELECT total FROM n) END AS num_users_scanned,
    CAST(5 AS BIGINT) AS max_users, false AS sample_users, 42 AS user_sample_seed, 'ground_truth_in_candidates' AS selection_mode FROM s""", runs=RUNS, truth=TRUTH)
def _(spark, runs, truth):
    return reports.export_users(runs.where("permutation_index = 1 AND output_rank < 2"), truth, max_users=5, truth_only=True, batch=4)[1]


# --- losses, interaction, checks -----------------------------------------------------------------------------------

@query("lambda_rank_loss", f"""WITH z AS (SELECT *, pow(2.0::DOUBLE, relevance) - 1 AS g, 1 / log2(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, position) + 1) AS d, row_number() OVER (PARTITION BY request_id ORDER BY relevance DESC, position) AS i FROM scored),
    y AS (SELECT *, sum(g / log2(i + 1)) OVER (PARTITION BY request_id) AS ideal FROM z),
    p AS (SELECT a.request_id, abs((a.g - b.g) * (a.d - b.d)) / a.ideal * (greatest(b.score - a.score, 0) + ln(1 + exp(-abs(a.score - b.score)))) AS l FROM y a JOIN y b ON a.request_id = b.request_id AND a.relevance > b.relevance)
    SELECT r.request_id, round(coalesce(avg(l), 0), {DIGITS}) AS loss FROM (SELECT DISTINCT request_id FROM scored) r LEFT JOIN p ON r.request_id = p.request_id GROUP BY r.request_id""", scored=LABELLED)
def _(spark, scored):
    return rounded(losses.lambda_rank_loss(scored), "loss")


SOFT = """WITH s AS (SELECT user_id, permutation_index, item_id, score / 20.0::DOUBLE AS s FROM runs), m AS (SELECT *, max(s) OVER (PARTITION BY user_id, permutation_index) AS top FROM s),
lp AS (SELECT user_id, permutation_index, item_id, s - top - ln(sum(exp(s - top)) OVER (PARTITION BY user_id, permutation_index)) AS lp FROM m),
d AS (SELECT b.user_id, b.permutation_index, sum(exp(a.lp) * (a.lp - b.lp)) AS kl, sum(exp(a.lp) * (a.lp - b.lp)) + sum(exp(b.lp) * (b.lp - a.lp)) AS je FROM lp a JOIN lp b ON a.user_id = b.user_id AND a.item_id = b.item_id AND a.permutation_index = 1 AND b.permutation_index > 1 GROUP BY b.user_id, b.permutation_index)"""

for _name, _mode, _c in (("perm_kl_loss", "kl", "kl"), ("perm_jeffreys_loss", "jeffreys", "je")):

    @query(_name, SOFT + f" SELECT user_id, round(avg({_c}), {DIGITS}) AS loss FROM d GROUP BY user_id", runs=RUNS)
    def _(spark, runs, mode=_mode):
        return rounded(losses.permutation_loss(runs, mode, 20.0), "loss")


@query("interaction_correction", runs=RUNS)
def _(spark, runs):
    vec = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.ascii(F.substring(F.md5("item_id"), i, 1)).cast("double") / 64)
    rows = runs.where("permutation_index = 1").select(F.col("user_id").alias("request_id"), "item_id", (F.col("score") / 100.0).alias("score"), vec.alias("vec"))
    return interaction.correct_scores(rows, interaction.random_weights(8))


@query("label_violations", "SELECT rule, count(*) FILTER (WHERE (rule = 'missing' AND relevance IS NULL) OR (rule = 'negative' AND relevance < 0) OR (rule = 'fraction' AND relevance <> floor(relevance))) AS violations FROM (SELECT CASE WHEN position % 10 = 3 THEN NULL WHEN position % 10 = 4 THEN -1 WHEN position % 10 = 5 THEN 0.5 ELSE relevance END AS relevance FROM scored) CROSS JOIN (VALUES ('missing'), ('negative'), ('fraction')) r(rule) GROUP BY rule", scored=LABELLED)
def _(spark, scored):
    bad = F.when(F.col("position") % 10 == 3, None).when(F.col("position") % 10 == 4, -1).when(F.col("position") % 10 == 5, 0.5).otherwise(F.col("relevance"))
    return losses.label_violations(scored.withColumn("relevance", bad))


@query("result_violations", """WITH l AS (SELECT user_id, permutation_index, count(*) AS n, count(DISTINCT item_id) AS items, count(DISTINCT pos) AS ranks, max(pos) AS top FROM said GROUP BY user_id, permutation_index)
    SELECT count(*) AS lists, count(*) FILTER (WHERE items < n) AS duplicate_items, count(*) FILTER (WHERE ranks < n OR top <> n - 1) AS broken_ranks FROM l""", said=DAMAGED)
def _(spark, said):
    return losses.result_violations(said.withColumnRenamed("pos", "output_rank"))
