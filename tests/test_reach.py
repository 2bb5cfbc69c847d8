"""Searches that must not meet all pairs: intervals within reach, one clip with most events, the inverted file."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loom.operators import intervals, rl, sequential, vector_index, vectors
from loom.sources import files

EVENTS = "clip_id string, event_id long, start_s double, end_s double, label string, duration double"


@pytest.fixture(scope="module")
def events(spark):
    r = random.Random(11)
    rows = []
    for i in range(600):
        start = r.choice([r.uniform(0, 100), float(r.randint(0, 20))])
        rows.append(("hot" if i % 10 else f"c{i % 4}", i, start, start + r.choice([0.1, 1.0, r.uniform(0, 8), 90.0]), r.choice("abc"), 100.0))
    return intervals.normalised(spark.createDataFrame([*rows, *rows[:20]], EVENTS)).cache()


def met(frame):
    return sorted((r.clip_id, r.a_idx, r.b_idx) for r in frame.select("clip_id", "a_idx", "b_idx").collect())


def test_pairs_within_reach(events):
    assert met(intervals.overlap_pairs(events).where(intervals.overlap() > 0.05)) == met(intervals.pairs(events).where(intervals.overlap() > 0.05))
    for low, high in ((0.1, 5.0), (0.0, 0.0), (2.0, 90.0)):
        assert met(intervals.gap_pairs(events, low, high)) == met(intervals.pairs(events, ordered=False).where(intervals.gap().between(low, high)))
    none = events.limit(0)
    assert met(intervals.overlap_pairs(none)) == met(intervals.gap_pairs(none, 1.0, 2.0)) == []


def test_a_clip_is_dealt_to_many_keys(spark):
    """One clip of 100,000 events: no key of the join holds more than a few of them."""
    one = spark.range(100_000).select(F.lit("one").alias("clip_id"), "id", (F.col("id") * 1.0).alias("start_s"), (F.col("id") + 1.5).alias("end_s"), F.lit(1.5).alias("len"), F.col("id").cast("int").alias("idx"))
    began = time.time()
    assert intervals.overlap_pairs(one).where(intervals.overlap() > 0.05).count() == 99_999
    width = one.agg(F.avg("len")).first()[0]
    assert one.groupBy(F.floor(F.col("start_s") / width)).count().agg(F.max("count")).first()[0] <= 2 and time.time() - began < 60


def test_a_clip_with_gaps_takes_linear_time(spark):
    one = spark.range(200_000).select(F.lit("one").alias("clip_id"), (F.col("id") * 10.0).alias("start_s"), (F.col("id") * 10.0 + 9.96).alias("end_s"))
    began = time.time()
    assert not intervals._with_gap(one, 0.05, 5.0).first().gap
    assert intervals._with_gap(one, 0.03, 5.0).first().gap and time.time() - began < 30


@pytest.mark.parametrize("low", [0.05, 0.1, 1.0])
def test_gaps_against_pairs(events, low):
    plain = {r.clip_id for r in intervals.pairs(events, ordered=False).where(intervals.gap().between(low, low + 0.4)).select("clip_id").distinct().collect()}
    assert {r.clip_id for r in intervals._with_gap(events, low, low + 0.4).where("gap").collect()} == plain


@pytest.fixture(scope="module")
def clustered(spark):
    """Thirty clusters, nine vectors in ten of one value, repeated ids, and rows that can't be indexed."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 12)) * 3
    rows = [(i, (centers[i % 30] + rng.normal(size=12)).tolist()) for i in range(600)]
    rows += [(10_000 + i, rows[3][1]) for i in range(5400)] + [rows[7], (-1, None), (-2, [1.0]), (-3, [None] * 12), (-4, [])]
    return spark.createDataFrame(rows, "doc_id long, d array<double>").repartition(6), rows


def test_exact_search_is_that_of_a_scan(spark, clustered, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 1000)
    docs, rows = clustered
    index = vector_index.InvertedFile.build(docs, files.scratch(spark, "vectors"), cells=40)
    assert max(index.parts) >= 5 and index.vectors().count() == 6001
    assert index.vectors().groupBy("block").count().agg(F.max("count")).first()[0] < 1500  # the hot vector is in several blocks
    asked = [(i, rows[i][1]) for i in range(0, 600, 50)] + [(9000, [0.0] * 12), (9001, None), (9002, [1.0])]
    queries = spark.createDataFrame(asked, "query_id long, q array<double>")
    found = index.search(queries, 7, probes=1, exact=True)
    scan = vectors.nearest(queries.where("size(q) = 12"), docs.where("size(d) = 12 AND d[0] IS NOT NULL"), 7, F.round(vectors.dot(F.col("q"), F.col("d")), 6))
    expected = sorted((r.query_id, r.rank, r.doc_id) for r in scan.collect())
    assert sorted((r.query_id, r.rank, r.doc_id) for r in found.collect()) == expected
    again = vector_index.InvertedFile(spark, index.path)
    near = {(r.query_id, r.doc_id) for r in again.search(queries, 7).collect()}
    best = {(q, d) for q, _, d in expected}
    assert len(near & best) >= 0.9 * len(best)
    plan = again.search(queries, 7)._jdf.queryExecution().executedPlan().toString()
    scanned = plan[plan.index("FlatMapCoGroupsInArrow") :]
    assert "Bucketed: true" in scanned and "Exchange" not in scanned[: scanned.index("FileScan")]
    index.close()


def test_index_of_nothing(spark, clustered):
    docs, _ = clustered
    empty = vector_index.InvertedFile.build(docs.limit(0), files.scratch(spark, "vectors"))
    assert empty.search(spark.createDataFrame([(1, [1.0])], "query_id long, q array<double>"), 3, exact=True).count() == 0
    few = vector_index.InvertedFile.build(docs.where("doc_id < 3"), files.scratch(spark, "vectors"))
    assert few.search(docs.where("doc_id = 1").select(F.col("doc_id").alias("query_id"), F.col("d").alias("q")), 5, exact=True).count() == 3


def plain_accuracy(rows):
    """Pair by pair; a row without a score is never alike."""
    out = {}
    for uid in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == uid and r[3] is not None), key=lambda r: r[1])
        pairs = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
        if pairs:
            whole = sum(abs(a[3] - b[3]) for a, b in pairs)
            alike = sum(abs(a[3] - b[3]) for a, b in pairs if None not in (a[2], b[2]) and (a[2] > b[2]) == (a[3] > b[3]))
            out[uid] = alike / whole if whole else 0.5
    return out


def test_preference_accuracy_without_pairs(spark):
    r = random.Random(6)
    rows = [(u, k, r.choice([None, 0.0, 1.0, r.random()]), r.choice([None, 0.0, 1.0, r.random()])) for u in range(12) for k in range(r.choice([1, 2, 3, 40, 150]))]
    rows += [(50, k, float(k % 3), 1.0) for k in range(9)] + [(51, k, float(k), float(k % 2)) for k in range(64)] + [(52, 1, 1.0, None), (52, 2, 2.0, 1.0)]
    found = {x.uid: x.accuracy for x in rl.preference_accuracy(spark.createDataFrame(rows, "uid long, k long, s double, a double"), "uid", "k", "s", "a").collect()}
    expected = plain_accuracy(rows)
    assert found.keys() == expected.keys() and all(found[u] == pytest.approx(v, abs=1e-9) for u, v in expected.items())


def test_a_large_group_is_no_square(spark):
    """100,000 rows of one group: 5 * 10^9 pairs would not end in time."""
    one = spark.range(100_000).select(F.lit(1).alias("uid"), F.col("id").alias("k"), ((F.col("id") * 7919) % 100_003).alias("s"), ((F.col("id") * 7919) % 100_003).cast("double").alias("a"))
    began = time.time()
    assert rl.preference_accuracy(one, "uid", "k", "s", "a").first().accuracy == pytest.approx(1.0) and time.time() - began < 60


def test_balanced_parts_of_many_rows(spark):
    """The spread of a tree of chunks is near that of one task; every row has one part, whatever its key."""
    r = random.Random(9)
    rows = [(r.choice([1, 2, i]), r.choice([None, 1, 5, r.randint(1, 4000)])) for i in range(4000)]
    frame = spark.createDataFrame(rows, "k long, n long").repartition(5)
    found = [(x.k, x.n, x.part) for x in sequential.balanced_whole(frame, "k", "n", 16, 1000, 2).collect()]
    assert sorted(x[:2] for x in found) == sorted((k, n or 0) for k, n in rows)
    spread = lambda parts: max(parts) - min(parts)
    sums = [sum(n for _, n, p in found if p == q) for q in range(16)]
    lengths = [n or 0 for _, n in rows]
    whole = [0] * 16
    for n, p in zip(lengths, sequential.balanced(lengths, 16), strict=True):
        whole[p] += n
    assert sum(sums) == sum(whole) and spread(sums) <= max(2 * spread(whole), 4)
    assert sequential.balanced_whole(frame.limit(0), "k", "n", 4).count() == 0
    assert sorted(x.part for x in sequential.balanced_whole(frame.limit(3), "k", "n", 8).collect()) != [0, 0, 0]


@pytest.mark.parametrize("products", [500, 2_000_000])
def test_products_are_those_of_a_scan(spark, clustered, monkeypatch, products):
    """Ties of a vector that is nine in ten rows, odd rows on both sides, blocks of queries, and decimal ties."""
    monkeypatch.setattr(vectors, "PRODUCTS", products)
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 5)
    docs, rows = clustered
    docs = docs.unionByName(spark.createDataFrame([(-10 - i, [i * 5e-7, *[0.0] * 11]) for i in range(8)] + [(-20, [float("nan")] * 12)], docs.schema))
    asked = [(i, rows[i][1]) for i in range(0, 600, 50)] + [(9000, [1.0, *[0.0] * 11]), (9001, None), (9002, [1.0])]
    queries = spark.createDataFrame(asked, "query_id long, q array<double>")
    result = lambda df: sorted((r.query_id, r.rank, r.doc_id, str(r.score)) for r in df.collect())
    assert result(vectors.nearest_by_product(queries, docs, 7)) == result(vectors.nearest(queries, docs, 7, F.round(vectors.dot(F.col("q"), F.col("d")), 6)))
    assert vectors.nearest_by_product(queries, docs.limit(0), 7).count() == 0
    x = np.array([2.5e-6, 0.0000005, 1.0000015, -1.0000005, 0.3])
    assert [round(u * 1e-6, 6) for u in vectors.rounded_units(x, 6)] == [r.y for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6).alias("y")).collect()]


def test_routes_are_made_a_few_queries_at_a_time(spark, clustered, monkeypatch):
    docs, rows = clustered
    index = vector_index.InvertedFile.build(docs, files.scratch(spark, "vectors"), cells=40)
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(300)], "query_id long, q array<double>")
    routes = lambda: sorted((r.query_id, r.block) for r in index._routes(queries, 7, False).collect())
    whole = routes()
    seen = []
    sort = np.argsort
    monkeypatch.setattr(vector_index, "ROUTED", 400)
    assert routes() == whole and len(whole) >= 2100
    monkeypatch.setattr(vector_index.np, "argsort", lambda x, *a, **b: (seen.append(x.shape), sort(x, *a, **b))[1])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([rows[i][1] for i in range(300)])], ["query_id", "q"])
    frame = type("Frame", (), {"mapInArrow": lambda self, run, schema: list(run(iter([batch])))})()
    index._routes(frame, 7, False)
    assert max(s[0] for s in seen) * sum(index.parts) <= 400
    index.close()
