"""Every query against its SQL in DuckDB on the smallest tables; those without SQL must give rows."""

import inspect
import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankweave.operators import retrieval
from rankweave.plans import catalogue
from rankweave.plans import fixtures as X

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(names, rows):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in catalogue.SQL:
        assert got
        return
    rel = duck.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, got) == rows_of(rel.columns, rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_lightgcn_has_the_parameters_of_the_reference(spark, monkeypatch):
    fit, used = retrieval.lightgcn_fit, {}

    def noted(*args, **how):
        bound = inspect.signature(fit).bind(*args, **how)
        bound.apply_defaults()
        used.update(bound.arguments)
        return fit(*args, **{**how, "epochs": 1})

    monkeypatch.setattr(retrieval, "lightgcn_fit", noted)
    catalogue.QUERIES["lightgcn_recommend"](spark, DATA)
    assert [used[x] for x in ("dim", "layers", "epochs", "batch", "lr", "decay")] == [64, 3, 100, 2048, 1e-3, 1e-4]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_als_has_the_parameters_of_the_reference(spark, monkeypatch):
    recommend, used = retrieval.als_recommend, {}

    def noted(*args, **how):
        bound = inspect.signature(recommend).bind(*args, **how)
        bound.apply_defaults()
        used.update(bound.arguments)

    monkeypatch.setattr(retrieval, "als_recommend", noted)
    catalogue.QUERIES["als_recommend"](spark, DATA)
    assert [used[x] for x in ("factors", "reg", "iterations", "alpha")] == [64, 0.01, 20, 40.0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_robustness_values_have_the_signs_that_zeros_have_in_sql(spark, duck):
    got = catalogue.QUERIES["robustness_values"](spark, DATA)
    want = duck.sql(catalogue.SQL["robustness_values"]).select(*got.columns).fetchall()
    said = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert "-0.0" in repr(want) and said(got.collect()) == said(want)


def test_a_small_file_of_customers_is_dealt_before_it_is_multiplied(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    runs = X.spark_table(spark, str(tmp_path), X.RUNS)
    placed = runs.select("user_id", F.spark_partition_id().alias("p"))
    in_parts = placed.groupBy("user_id").agg(F.countDistinct("p").alias("parts")).agg(F.max("parts")).first()[0]
    assert (placed.count(), placed.select("p").distinct().count(), in_parts) == (120_000, 4, 1)
