"""Proxy views over the driver's tables, as SQL that Spark and DuckDB both read.

``{name}`` stands for a table: spark.sql binds it to a DataFrame, ``duck`` to the view of that name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

EVENTS = """SELECT clip_id, event_id, start_s, end_s, label, max(end_s) OVER (PARTITION BY clip_id) AS duration FROM (
  SELECT concat(CAST(user_id AS STRING), '_', CAST(CAST(ts AS DATE) AS STRING)) AS clip_id, event_id,
    CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS start_s,
    CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) + value * 60 AS end_s, event_type AS label FROM {events}) x"""

#: Tagged responses with every shape the scorers tell apart, by doc_id; the text is whole, in halves.
RESPONSES = """SELECT doc_id, lang, source, gold, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE -(doc_id % 13) / 10.0E0 END AS logprob,
  concat(CASE WHEN doc_id % 11 = 0 THEN '' ELSE '<think>' END, substring(text, 1, CAST(floor(length(text) / 2) AS INT)),
    CASE WHEN doc_id % 3 = 0 THEN ' <seg>1.5, 3</seg> then' WHEN doc_id % 3 = 1 THEN ' <seg> 2 ,4.25 </seg>  However <seg>1,2.5</seg><seg>9</seg>' ELSE '' END,
    substring(text, CAST(floor(length(text) / 2) AS INT) + 1), CASE WHEN doc_id % 5 = 0 THEN '' ELSE '</think>' END,
    CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('<answer> ', pred, '</answer>') END,
    CASE WHEN doc_id % 8 = 0 THEN concat('<answer>', gold, '</answer>') ELSE '' END) AS response
  FROM (SELECT d.doc_id, lang, source, text, CASE WHEN quality = 1 THEN '2 seconds' WHEN quality = 0 THEN 'No' ELSE '0.7' END AS gold,
    CASE WHEN d.doc_id % 4 = 0 THEN '2 Second.' WHEN d.doc_id % 4 = 1 THEN 'no' WHEN d.doc_id % 4 = 2 THEN '0.7  seconds' ELSE 'maybe' END AS pred
    FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id) x"""

JUDGED = """SELECT d.doc_id, source, lang, CASE WHEN quality = 1 THEN 'True' WHEN quality = 0 THEN 'no' END AS qa_raw,
  CASE WHEN toxic = 0 THEN '1' WHEN toxic = 1 THEN 'false' END AS cot_raw FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"""

MESSAGES = "SELECT conv_id, turn, role, text FROM {conversations}"

#: Rollouts: group is a customer, reward the scaled order price; unique order.
ROLLOUTS = "SELECT o_custkey AS uid, o_orderkey AS rid, o_totalprice / 1000.0E0 AS reward, CAST(o_orderkey % 50 + 1 AS BIGINT) AS length FROM {orders}"

#: Tokens: lineitem rows of an order by every column that tells them apart.
TOKENS = """SELECT l_orderkey AS seq, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS BIGINT) - 1 AS pos,
  CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS v, CAST(l_tax AS DOUBLE) AS r, CAST(l_extendedprice AS DOUBLE) / 100000.0E0 AS p, CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE 1 END AS mask, l_partkey % 5 AS token FROM {lineitem}"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The view's DataFrame."""
    used = {t for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in used})


def duck(text: str) -> str:
    """The view's text for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", text)
