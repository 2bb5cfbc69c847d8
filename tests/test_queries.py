"""Every query against its SQL."""

import os

import duckdb
import pandas as pd
import pytest

from loom.queries import QUERIES, SQL
from loom.views import TABLES


@pytest.fixture(scope="module")
def sf_dir():
    return os.environ.get("LOOM_TEST_DATA", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    plain = lambda v: None if pd.isna(v) else round(float(v), 5) if hasattr(v, "__float__") and not isinstance(v, (str, bool)) else str(v)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_prompts_are_drawn_by_share(spark, sf_dir):
    found = {r.p: r.n for r in QUERIES["grounding_prompts__DSP30"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert set(found) == {"a", "b", "甲"} and sum(found.values()) == rows and abs(found["甲"] / rows - 0.2) < 0.05 and abs(found["a"] - found["b"]) < 0.1 * rows


def test_quotas_are_met(spark, sf_dir):
    """Of candidates (own, gap): every row has one, and "gap", which all rows allow, fills up to its share."""
    found = {r.kind: r.n for r in QUERIES["quota_choice__SMP07"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert set(found) == {"gap", "order", "overlap"} and sum(found.values()) == rows
    assert abs(found["gap"] / rows - 1 / 2) < 0.02 and abs(found["order"] - found["overlap"]) < 0.02 * rows


def test_bootstrap_is_near_the_plain_mean(spark, sf_dir):
    from pyspark.sql import functions as F

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("uid")).agg(F.avg(F.col("o_totalprice") / 1000).alias("m"), F.min(F.col("o_totalprice") / 1000).alias("low"), F.max(F.col("o_totalprice") / 1000).alias("high"), F.stddev_pop(F.col("o_totalprice") / 1000).alias("s"))
    found = QUERIES["bootstrap__SMP11_AGG21"](spark, sf_dir).join(orders, "uid").collect()
    assert len(found) == orders.count() and all(r.low - 1e-9 <= r.worst_mean <= r.mean_mean + 1e-9 and r.mean_mean <= r.best_mean + 1e-9 and r.best_mean <= r.high + 1e-9 for r in found)
    # 50 means of 4 draws: their mean is within five of its deviations, the deviation of one mean over sqrt(50)
    assert all(abs(r.mean_mean - r.m) <= 5 * r.s / 2 / 50**0.5 + 1e-9 for r in found)


def test_accepted_segments_against_a_fold(spark, sf_dir):
    from loom import views
    from loom.operators import intervals

    clips = {}
    for r in intervals.normalised(views.view(spark, sf_dir, views.EVENTS)).orderBy("clip_id", "idx").collect():
        kept = clips.setdefault(r.clip_id, [])
        common = [max(0.0, min(r.end_s, e) - max(r.start_s, s)) for s, e in kept]
        if not any(c / (r.end_s - r.start_s + e - s - c) >= 0.3 for c, (s, e) in zip(common, kept, strict=True)):
            kept.append((r.start_s, r.end_s))
    assert {r.clip_id: r.n for r in QUERIES["accepted_segments__JON12"](spark, sf_dir).collect()} == {k: len(v) for k, v in clips.items()}


def test_all_others_have_sql():
    assert set(QUERIES) - set(SQL) == {"grounding_prompts__DSP30", "quota_choice__SMP07", "bootstrap__SMP11_AGG21", "accepted_segments__JON12"}
