"""Virtual tables over the test data. Each is one SQL text that Spark and DuckDB both run, with {table} for base tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

INTERACTIONS = """
SELECT user_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS item_id,
       CAST(CASE event_type WHEN 'purchase' THEN 5 WHEN 'click' THEN 4 WHEN 'view' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS DOUBLE) AS rating,
       ts, event_id
FROM {events}"""

RAW_ORDERS = """
SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(1.0 + floor((l_quantity - 1) / 10) AS DOUBLE) AS rating, o_orderdate AS ts, l_orderkey, l_linenumber
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey"""

ITEMS = """
SELECT p_partkey AS item_id, concat('P', CAST(p_partkey AS VARCHAR(20))) AS raw_item_id,
       concat(p_name, ' (', CAST(1990 + p_size % 35 AS VARCHAR(20)), ')') AS raw_title,
       concat(p_type, '|', p_brand) AS genres, p_retailprice AS price
FROM {part}"""

RUNS = """
SELECT user_id, p AS permutation_index, item_id, input_position, base - 12 * input_position AS score,
       row_number() OVER (PARTITION BY user_id, p ORDER BY base - 12 * input_position DESC, input_position) - 1 AS output_rank
FROM (SELECT user_id, item_id, p,
         row_number() OVER (PARTITION BY user_id, p ORDER BY md5(concat(CAST(user_id AS VARCHAR(20)), '|', CAST(p AS VARCHAR(20)), '|', item_id))) - 1 AS input_position,
         ascii(substr(md5(concat(CAST(user_id AS VARCHAR(20)), '#', item_id)), 1, 1)) * 2
         + ascii(substr(md5(concat(CAST(user_id AS VARCHAR(20)), '#', item_id)), 2, 1)) AS base
      FROM (SELECT c_custkey AS user_id, concat('i', CAST((c_custkey * 31 + j * 17) % 1000 AS VARCHAR(20))) AS item_id
            FROM {customer} CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) AS t(j)) c
      CROSS JOIN (VALUES (1),(2),(3),(4),(5)) AS q(p)) z"""

TRUTH = """
SELECT c_custkey AS user_id, concat('i', CAST((c_custkey * 31 + j * 17) % 1000 AS VARCHAR(20))) AS item_id
FROM {customer} CROSS JOIN (VALUES (1),(4)) AS t(j)
WHERE c_custkey % 7 <> 0 AND (j = 1 OR c_custkey % 2 = 0)"""

#: RUNS with damage by user: a missing, a repeated and an unknown id.
DAMAGED = (
    """
SELECT user_id, permutation_index, pos, item_id FROM (
  SELECT user_id, permutation_index, output_rank AS pos, CASE WHEN user_id % 4 = 3 AND output_rank = 1 THEN 'zz' ELSE item_id END AS item_id
  FROM (""" + RUNS + """) a WHERE NOT (user_id % 4 = 1 AND output_rank = 2)
  UNION ALL
  SELECT user_id, permutation_index, 8 AS pos, item_id FROM (""" + RUNS + """) b WHERE user_id % 4 = 2 AND output_rank = 0) u"""
)

#: Labelled candidates: graded relevance, a score of 3 digits, one request a source.
LABELLED = """
SELECT d.source AS request_id, d.doc_id AS item_id, CAST(l.quality + 2 * l.toxic AS INT) AS relevance,
       CAST((ascii(substr(md5(CAST(d.doc_id AS VARCHAR(20))), 1, 1)) * 128 + ascii(substr(md5(CAST(d.doc_id AS VARCHAR(20))), 2, 1))) / 1000.0 AS DOUBLE) AS score,
       row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS position
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""

#: Token rows: a prompt span of 6 tokens, then items of 4 words between markers; two pads at the end.
TOKENS = """
SELECT item_id AS request_id, i AS pos,
       CASE WHEN i = 0 THEN 'SPAN' WHEN i = 5 THEN '/SPAN' WHEN i >= 24 THEN 'PAD' WHEN i > 5 AND (i - 6) % 6 = 0 THEN 'ITEM' WHEN i > 5 AND (i - 6) % 6 = 5 THEN '/ITEM' ELSE 'w' END AS kind,
       CASE WHEN i >= 24 THEN 0 ELSE 1 END AS mask,
       CAST(-(ascii(substr(md5(concat(CAST(item_id AS VARCHAR(20)), '/', CAST(i AS VARCHAR(20)))), 1, 1))) / 16.0 AS DOUBLE) AS logprob
FROM {benchmark} CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15),(16),(17),(18),(19),(20),(21),(22),(23),(24),(25)) AS t(i)"""


#: Rows of customer in one partition, each 40 rows of RUNS; so few that a task sorts and joins what it has in some 100 MB, whatever the table's size.
PART_ROWS = 8192


def _dealt(customers: DataFrame) -> DataFrame:
    """customer by its key, in partitions by its number of rows: a row group of a few MB becomes 40 times its rows, and stays where it is while the key groups it."""
    n = customers.count()  # from the file's footers
    least = min(customers.sparkSession.sparkContext.defaultParallelism, -(-n // 512))
    return customers.repartition(max(1, least, -(-n // PART_ROWS)), "c_custkey")


def spark_table(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", text))
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    if "customer" in tables and "CROSS JOIN" in text:
        tables["customer"] = _dealt(tables["customer"])
    return spark.sql(text, **tables)


def duck(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)
