"""Queries over tables made for a case, against their SQL: more rows than a parameter, and odd texts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loom.queries import QUERIES, SQL


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query over these tables gives the rows of its SQL."""

    def compare(name, **tables):
        con = duckdb.connect()
        for t, frame in tables.items():
            frame.write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = con.execute(SQL[name])
        columns = [d[0] for d in want.description]
        found = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
        return sorted(found, key=repr) == sorted(want.fetchall(), key=repr)

    return compare


@pytest.fixture
def customers(spark):
    return spark.range(5000).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"))


def test_rows_beyond_the_total_go_to_the_last_shard(same, customers):
    assert same("rank_shards__SRT04_SET20", customer=customers)


def test_rows_that_are_not_drawn_count_as_zero(same, customers):
    assert same("sample_with_repeats__SMP01", customer=customers)


def documents(spark, *texts):
    return spark.createDataFrame([(11 + 35 * i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_spelled_out_words_beside_other_letters_and_an_exact_share(same, spark):
    """Bounds of words are ASCII ones; 63 letters of 180 words are not above 35 %."""
    plain = "one two three four five six seven eight nine ten "
    texts = [plain + "éa b c d", plain + "a b c dé", plain + "xa b c d", plain + "a b c d", plain + "a\x0bb c d", "a bc " * 63 + "de " * 54, "a bc " * 64 + "de " * 52, plain + "0 " * 20, plain + "0 " * 19]
    assert same("bad_descriptions__FLT12", documents=documents(spark, *texts))


def test_shares_are_rounded_as_numbers(same, spark):
    """33117 of 39840 seconds is 83.125 %, a tie; kinds go by the least event_id."""
    rows = [(16 * u + 8 * k + 5 + u % 8, f"2024-01-11 {at}", u, "view", value, "") for u in range(8) for k, (at, value) in enumerate([("09:11:57", 29.79), ("10:00:00", 64.0)])]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert same("narrated_questions__STR16", events=events)


def test_repetition_of_a_long_text_is_no_square(spark):
    import time

    from loom.functions import rewards

    long = spark.createDataFrame([(" ".join(f"W{i % 30_000}" for i in range(40_000)),), ("a b a b a",), ("a b",), ("",)], "t string")
    began = time.time()
    found = [round(r.p, 6) for r in long.select(rewards.repetition_penalty(F.col("t")).alias("p")).collect()]
    assert found == [round(-(1 - 30_000 / 39_998), 6), round(-1 / 3, 6), 0.0, 0.0] and time.time() - began < 20


def test_requests_are_folded_as_they_pass(spark):
    """Requests of up to 40 outputs over several Arrow batches, one without a name; no call per request."""
    import random

    from loom.operators import sequential

    r = random.Random(2)
    names = ["request", "place", "reason", "start", "end", "duration"]
    rows = [(q or None, p, r.choice(["seg"] * 6 + ["answer", "stop", None]), r.uniform(-1, 9), r.choice([None, r.uniform(0, 12)]), 10.0) for q in range(60) for p in range(r.randint(1, 40))]
    frame = spark.createDataFrame(r.sample(rows, len(rows)), "request long, place long, reason string, start double, end double, duration double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        folded = sequential.rollouts(frame, "request", "place")
        found = {x.request: (x.rounds, x.segments, x.finish) for x in folded.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = lambda v: float("nan") if v is None else v
    for q in {x[0] for x in rows}:
        steps = [dict(zip(names, [*x[:3], *map(plain, x[3:])], strict=True)) for x in rows if x[0] == q]
        assert found.pop(q) == tuple(sequential.rollout(steps).values())
    assert not found and "FlatMapGroupsInPandas" not in folded._jdf.queryExecution().executedPlan().toString()


def written_bytes(spark, name):
    """How many bytes the tables of that name in the shared folder have."""
    from pathlib import Path

    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    return sum(p.stat().st_size for p in base.glob(f"loom/{name}-*/*.parquet"))


def test_no_table_of_all_grams_is_written(same, spark):
    """160,000 words with hardly a pair twice: counts of counts are written, and not 640,000 grams; null and short texts have none."""
    import random

    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(4000)) for _ in range(40)]
    before = written_bytes(spark, "grams")
    assert same("ngrams__AGG08", documents=documents(spark, *texts, *texts[:3], None, "", "one", "w1 w2 it's 5% w1 w2"))
    assert written_bytes(spark, "grams") - before < 500_000


@pytest.mark.parametrize("few", [0, 1000])
def test_grams_of_equal_counts_by_their_text(same, spark, monkeypatch, few):
    """All grams are equally common, and picked whether they are handed out or joined."""
    from loom.operators import quality

    monkeypatch.setattr(quality, "BROADCAST_GRAMS", few)
    assert same("ngrams__AGG08", documents=documents(spark, "b a d c f e g", "k j i h l m", None, "b a d c f e g"))


@pytest.mark.parametrize("few", [-1, 1000])
def test_documents_are_scored_where_they_stand(same, spark, monkeypatch, few):
    """Copies tie by id, over several chunks; null and empty texts count; beyond the bound words are joined."""
    import random

    from loom.operators import vectors

    r = random.Random(3)
    texts = [" ".join(f"{r.choice('abcdefgh')}{r.choice('xyz')}" for _ in range(r.randrange(1, 40))) for _ in range(150)]
    monkeypatch.setattr(vectors, "BROADCAST_WORDS", few)
    items = spark.createDataFrame([(7, "ax by cz ax"), (9, "The hx!"), (10, "none of these"), (11, ""), (12, None)], "item_id long, text string")
    assert same("bm25_search__JON14", documents=documents(spark, *texts, None, "", *texts[:70], "12 34"), benchmark=items)


def test_no_word_of_a_document_is_a_row(spark):
    from loom.operators import vectors

    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "doc_id long, words array<string>")
    found = vectors.bm25(docs.withColumnRenamed("doc_id", "query_id"), docs, 2)
    assert [tuple(x)[:2] for x in found.orderBy("query_id", "rank").collect()] == [(1, 1), (1, 2), (2, 2), (2, 1)]
    assert "explode" not in found._jdf.queryExecution().executedPlan().toString()
    nothing = vectors.bm25(docs.withColumnRenamed("doc_id", "query_id").where("query_id = 0"), docs, 2)
    assert nothing.count() == 0 and vectors.bm25(docs.withColumnRenamed("doc_id", "query_id"), docs.where("doc_id = 0"), 2).count() == 0


def test_words_are_found_and_sorted_once(same, spark):
    """Bounds of each reason; of equally common words the first decides, whether or not it is a function word."""
    from loom.operators import quality

    plain = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200))
    texts = ["a a b c", "a a a b c", "b a", "b b", "x", "", "!?", None, plain + " zog" * 29, plain + " Zog zog" * 15, plain + " the" * 40, plain + " the zog" * 30, plain + " zog any" * 30, plain + " the" * 31 + " zog" * 30,
             plain + " 123" * 19, plain + " 123" * 20, plain + " 1234" * 20, plain + " 1234 123" * 20, plain + " 1 999" * 20, plain + "-" * 9, plain + "-" * 10, "pérdida " * 4 + plain, "PÉRDIDA " * 5 + plain, "été " * 30 + plain]
    frame = spark.createDataFrame([(9 * i + j, t, "en", "s") for i, t in enumerate(texts) for j in ((4, 5) if t is None else (3, 4, 5))], "doc_id long, text string, lang string, source string")
    assert same("gibberish__FLT13", documents=frame)
    plan = quality.gibberish(frame, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)\w+") == 1 and "array_sort" not in plan
