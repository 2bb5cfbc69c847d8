"""Hand-computed cases and invariants of operators."""

import pytest
from pyspark.sql import functions as F

from loom.operators import batch, intervals, messages, narration, reports, rl, routing, sampling, sequential
from loom.plans import hooks
from loom.sources import catalog


def events(spark, rows):
    return intervals.normalised(spark.createDataFrame([("c", i, float(a), float(b), lab, 10.0) for i, (a, b, lab) in enumerate(rows)], "clip_id string, event_id long, start_s double, end_s double, label string, duration double"))


def test_union_merges_touching(spark):
    r = intervals.union_length(events(spark, [(0, 2, "a"), (1, 3, "b"), (3, 4, "c")])).first()
    assert (r.union_s, r.total_s, r.n) == (4.0, 5.0, 3)


def test_first_pair_is_by_nested_loops(spark):
    e = events(spark, [(0.1, 1, "a"), (2, 3, "b"), (2.5, 3.5, "c")])
    assert intervals.qa_gap(e).first().question == "How long after the a ends does the b begin?"


def test_empty_events_go(spark):
    assert events(spark, [(1, 1, "a"), (2, 1, "b")]).count() == 0


def test_gae(spark):
    df = spark.createDataFrame([(1, p, r, 0.0) for p, r in enumerate([2.0, 0.0, 1.0])], "seq int, pos int, r double, v double")
    assert [r.adv for r in rl.generalised_advantage(df, 0.5, 1.0).orderBy("pos").collect()] == pytest.approx([2.25, 0.5, 1.0])


def test_returns_stop_at_masked(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 1), (1, 1, 1.0, 0), (1, 2, 1.0, 1)], "seq int, pos int, r double, mask int")
    assert [r.ret for r in rl.discounted_returns(df, 0.5).orderBy("pos").collect()] == pytest.approx([1.0, 1.5, 1.0])


def test_group_variants(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 2.0)], "uid string, r double")
    rows = df.select("uid", *[rl.group_normalised(df, "uid", "r", v).alias(v) for v in ("sample", "population", "wide")]).orderBy("uid", "sample").collect()
    assert [x.sample for x in rows] == pytest.approx([-0.707106, 0.707106, 2 / (1 + 1e-6)], abs=1e-5)
    assert rows[1].population == pytest.approx(1.0) and rows[2].population == 0.0
    assert rows[1].wide == pytest.approx(0.707007, abs=1e-5) and rows[2].wide is None


def test_upper_median(spark):
    assert reports.upper_median(spark.createDataFrame([(1, x) for x in (1, 2, 3, 4)], "k int, x int"), ["k"], "x").first().median == 3


def test_padding_from_the_head(spark):
    df = batch.indexed(spark.range(10, 15).withColumnRenamed("id", "k"), "k")
    padded = batch.padded(df, 4)
    assert [r.k for r in padded.where("is_pad").orderBy("row_idx").collect()] == [10, 11, 12]
    assert batch.unpadded(padded).count() == 5


def test_chunks_must_divide(spark):
    with pytest.raises(ValueError):
        batch.chunked(batch.indexed(spark.range(5).withColumnRenamed("id", "k"), "k"), 2)


def test_empty_frames(spark):
    empty = spark.range(0).withColumnRenamed("id", "k")
    assert batch.indexed(empty, "k").count() == 0 and sampling.sampled(empty, "k", 5, 1).count() == 0 and batch.padded(batch.indexed(empty, "k"), 4).count() == 0


def test_split_sizes_add_up(spark):
    parts = {r.part: r["count"] for r in sampling.split(spark.range(101).withColumnRenamed("id", "k"), "k", 0.1, 3).groupBy("part").count().collect()}
    assert parts == {"val": 10, "train": 91}


def test_resampling_keeps_the_number(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7 + 1).cast("double").alias("w"))
    assert abs(sampling.resampled(df, "k", "w", 5).count() - 1000) <= 1


def test_renames_that_collide_do_nothing():
    assert messages.renames(["Response", "answer", "x"], {"response": "response", "answer": "response"}) == {}
    assert messages.renames(["Query"], {"query": "prompt"}) == {"Query": "prompt"}


def test_rejected_user_turns_must_match(spark):
    m = lambda u: F.array(F.struct(F.lit("user").alias("role"), F.lit(u).alias("content")))
    with pytest.raises(Exception, match="differ"):
        spark.range(1).select(messages.rejected(m("a"), m("b"))).collect()


def test_packing_holds_its_bound():
    lengths = [5, 4, 4, 3, 2, 2, 1, 9]
    bins = sequential.pack(lengths, 10)
    sums = [sum(n for n, b in zip(lengths, bins, strict=True) if b == k) for k in set(bins)]
    assert max(sums) <= 10 and len(sums) <= 4


def test_balanced_parts():
    lengths = [10, 9, 8, 7, 6, 5, 4, 3]
    for equal in (False, True):
        parts = sequential.balanced(lengths, 2, equal)
        sums = [sum(n for n, p in zip(lengths, parts, strict=True) if p == k) for k in (0, 1)]
        assert abs(sums[0] - sums[1]) <= 2 and (not equal or parts.count(0) == 4)


def test_text_parsers():
    assert sequential.json_object('a {x} {"k": "}"} b') == '{"k": "}"}'
    assert sequential.boxed(r"\boxed{a{b}c} \boxed{\frac{1}{2}}") == r"\frac{1}{2}"
    assert sequential.plain_math("1/2") == r"\frac{1}{2}" == sequential.plain_math("0.5")
    assert sequential.argument_f1('{"a": 1, "b": 2}', '{"a": 1}') == pytest.approx(2 / 3)
    assert sequential.rouge("a b c".split(), "a c".split(), "l") == pytest.approx(0.8)
    assert sequential.bleu("a b c d".split(), "a b c d".split()) == pytest.approx(1.0)


def test_rollout_fold():
    step = {"reason": "seg", "start": 0.0, "end": 2.0, "duration": 10.0}
    assert sequential.rollout([step, step, {**step, "start": 5.0, "end": 6.0}, {**step, "reason": "answer"}]) == {"rounds": 4, "segments": 2, "finish": "answer"}
    assert sequential.rollout([step] * 9, most=3)["finish"] == "finalized"


def test_requests():
    assert catalog.parse("hf::team/set:a/b#500") == catalog.Request("team/set", "hf", ("a", "b"), 500)
    assert catalog.parse("sub/x.jsonl#10") == catalog.Request("sub/x.jsonl", None, (), 10)
    assert catalog.parse("s3://bucket/x:y") == catalog.Request("s3://bucket/x:y")
    assert catalog.parse("/data/x.jsonl#10") == catalog.Request("/data/x.jsonl", None, (), 10)
    c = catalog.Catalog()
    d = catalog.Dataset("team/set", lambda s, n: None, subsets=("a", "b"), weak=("b",))
    c.register(d)
    with pytest.raises(ValueError):
        c.register(d)
    with pytest.raises(ValueError):
        c.chosen(d, ())
    assert c.find("set") is d and c.chosen(d, ("all",)) == ("a",)


def test_dataset_info():
    c = catalog.Catalog()
    c.register_info('[{"name": "x", "path": "/tmp/x.jsonl", "columns": {"q": "query"}}]')
    assert c.find("x").name == "x"


@pytest.mark.parametrize("gamma,lam", [(0.9, 0.0), (0.0, 0.9), (1.0, 0.95), (0.5, 0.2), (1.0, 1.0)])
def test_long_sequences_flow_back(spark, gamma, lam):
    n = 20_000
    df = spark.range(n).select(F.lit(1).alias("seq"), F.col("id").cast("int").alias("pos"), (F.col("id") % 7 / 3 - 1).alias("r"), (F.col("id") % 5 / 4).alias("v"), F.when(F.col("id") % 6000 == 5999, 0).otherwise(1).alias("mask"))
    rows = df.orderBy("pos").collect()
    adv, ret, last, flow, ahead = [0.0] * n, [0.0] * n, 0.0, 0.0, 0.0
    for i in reversed(range(n)):
        last = rows[i].r + gamma * ahead - rows[i].v + gamma * lam * last
        ahead, adv[i] = rows[i].v, last
        flow = rows[i].r + gamma * (0.0 if i + 1 < n and not rows[i + 1].mask else flow)
        ret[i] = flow
    assert [r.adv for r in rl.generalised_advantage(df, gamma, lam).orderBy("pos").collect()] == pytest.approx(adv, rel=1e-9, abs=1e-9)
    assert [r.ret for r in rl.discounted_returns(df, gamma).orderBy("pos").collect()] == pytest.approx(ret, rel=1e-9, abs=1e-9)


def test_paths_of_any_length(spark):
    schema = "node_id long, parent_id long, outcome_reward double, terminated boolean, correct boolean"
    chain = [(i, i - 1 if i else None, float(i), i == 99, True) for i in range(100)]
    found = routing.path_rewards(spark.createDataFrame([*chain, (200, 555, 7.0, True, False)], schema)).collect()
    assert {(r.node_id, r.mean_reward, r.min_reward) for r in found} == {(99, 49.5, 0.0), (200, 7.0, 7.0)}
    with pytest.raises(ValueError):
        routing.path_rewards(spark.createDataFrame([(1, 2, 0.0, True, True), (2, 1, 0.0, False, True)], schema))


def test_diversified_falls_back_to_padding(spark):
    df = spark.createDataFrame([("k",)], "key string")
    text = narration.diversified(F.col("key"), [[F.lit("one two"), F.lit("one two three")]], F.lit("plain words"), ["and more.", "so it is."], 9, 12)
    found = df.select(text.alias("t")).first().t
    assert found.startswith("plain words ") and 9 <= len(found.split()) <= 11
    assert df.select(narration.diversified(F.col("key"), [[F.lit("one two")]], F.lit("x"), ["y"], 1, 2).alias("t")).first().t == "one two"


def test_event_labels(spark):
    texts = ["The first male speech segment ends at", "First noise:", "contains the music", "", "The impact sounds, which begins at", "one two three four five six seven eight nine ten"]
    found = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(narration.event_label(F.col("t")).alias("x")).collect()]
    assert found == ["the first male speech segment", "the First noise", "the contains the music", "this sound", "the impact sounds, which", "the one two three four five six seven eight"]


def test_hooks(spark):
    r = hooks.Registry("scorer")
    assert r.register("a", 1) == 1 and r.register("b")(2) == 2 and r["b"] == 2
    with pytest.raises(ValueError):
        r.register("a", 3)
    with pytest.raises(KeyError):
        r["c"]
    df = spark.createDataFrame([(1, "a"), (2, None)], "x long, t string")
    assert hooks.row_map(df, lambda row: {"n": len(row["t"])}, "n long").collect() == [(1,)]
    with pytest.raises(Exception):
        hooks.row_map(df, lambda row: {"n": len(row["t"])}, "n long", strict=True).collect()
    assert hooks.row_map(df.limit(0), lambda row: row, "x long, t string").count() == 0


@pytest.mark.parametrize(("given", "plain"), [
    ("k = 5", "5"), ("k=5", "5"), ("ab = 5", "ab=5"), ("ab=5", "5"), ("abc=5", "abc=5"), ("\\tfrac12", "\\frac{1}{2}"), ("\\frac1{72}", "\\frac{1}{72}"), ("\\frac{1}2", "\\frac{1}2"), ("\\frac12+\\frac3", "\\frac12+\\frac3"),
    ("\\sqrt3+\\sqrt{2}", "\\sqrt{3}+\\sqrt{2}"), ("3/4", "\\frac{3}{4}"), ("03/4", "03/4"), ("0.5", "\\frac{1}{2}"), (".5", "\\frac{1}{2}"), ("10\\%", "10"), ("10%", "10%"), ("5\\text{ cm}", "5"), ("90^\\circ", "90"), ("\\left( x \\right)", "(x)"),
])
def test_plain_math(given, plain):
    assert sequential.plain_math(given) == plain


def test_json_object():
    assert sequential.json_object('x {a} {"b": "}"} {"c": 1}') == '{"b": "}"}'
    assert sequential.json_object('{"a": {"b": 1}') == '{"b": 1}' and sequential.json_object("{" * 50_000) is None and sequential.json_object("none") is None


@pytest.mark.parametrize("factor", [0.0, 0.5, 0.99])
def test_smoothing_of_long_series(spark, factor):
    n = 8000
    rows = spark.range(n).select(F.lit(1).alias("g"), "id", (F.col("id") % 11 / 2).alias("x"))
    total, expected = 0.0, []
    for i in range(n):
        total = total * factor + (1 - factor) * (i % 11 / 2)
        expected.append(total / (1 - factor ** (i + 1)))
    assert [r.smooth for r in rl.smoothed(rows, ["g"], ["id"], "x", factor).orderBy("id").collect()] == pytest.approx(expected, rel=1e-9)


def test_validation_table_beside_prompts(spark, monkeypatch):
    """Resamples made beside each prompt are those of the table; nulls and single responses have their metrics only."""
    from loom.operators import reports

    rows = [("s", u, i, None if i % 7 == 3 else float(i % 5), "abc"[i % 3]) for u in range(4) for i in range(u * 5 + 1)] + [("t", 9, 0, None, None)]
    frame = spark.createDataFrame(rows, "source string, prompt long, id long, x double, pred string")
    table = lambda: {(r.source, r.metric): r.value for r in reports.validation_table(frame, "source", "prompt", "id", ["x"], "pred", times=7).collect()}
    few = table()
    monkeypatch.setattr(reports, "BROADCAST_DRAWS", 0)
    many = table()
    assert few.keys() == many.keys() and all(few[k] == many[k] or abs(few[k] - many[k]) < 1e-9 for k in few)
    assert ("t", "mean@1") in few and few["t", "mean@1"] is None and ("s", "std@1") not in few
    assert {m for s, m in few if s == "s" and m.endswith("/mean")} == {f"{k}@{n}/mean" for k in ("best", "worst", "maj") for n in (2, 4, 6, 8, 11, 16)}


def test_failures_of_row_maps_are_told(spark):
    frame = spark.range(6)
    found = hooks.row_map(frame, lambda r: {"k": 6 // (r["id"] % 3)}, "k long", error="why").collect()
    assert sorted((r.k is None, r.k or 0, r.why) for r in found) == [(False, 3, None), (False, 3, None), (False, 6, None), (False, 6, None)] + [(True, 0, "ZeroDivisionError: integer division or modulo by zero")] * 2
    assert hooks.row_map(frame, lambda r: {"k": 6 // (r["id"] % 3)}, "k long").count() == 4
