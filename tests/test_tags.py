"""Golden behaviour of tags and rewards."""

import pytest
from pyspark.sql import functions as F

from loom.functions import rewards, tags


def value(spark, column, **texts):
    return spark.createDataFrame([tuple(texts.values())], list(texts)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "first"), [("<think>a <answer> x </answer></think><answer>y</answer>", "x"), ("none", ""), ("<answer>open", "")])
def test_first_answer(spark, text, first):
    assert value(spark, tags.answer(F.col("t")), t=text) == first


def test_segments_need_a_comma(spark):
    assert [tuple(s) for s in value(spark, tags.segments(F.col("t")), t="<seg> 1 , 2 </seg><seg>0.5,3</seg>")] == [(1.0, 2.0), (0.5, 3.0)]
    assert value(spark, tags.segments(F.col("t")), t="<seg>1 2</seg>") == []


def test_unclosed_think(spark):
    assert value(spark, tags.has_think(F.col("t")), t="<think>a") is False


@pytest.mark.parametrize(("text", "norm"), [("  0.7 Seconds ", "0.7"), ("0.7 seconds.", "0.7"), ("1.0 second", "1.0"), ("Dog   Bark", "dog bark")])
def test_normalised_answers(spark, text, norm):
    assert value(spark, tags.normalised_answer(F.col("t")), t=text) == norm


@pytest.mark.parametrize(("text", "score"), [("<think>a</think>", 0.25), ("<answer>a</answer>", 0.25), ("<think>a</think><answer>b</answer>", 0.5), ("", 0.0)])
def test_format(spark, text, score):
    assert value(spark, rewards.score_format(F.col("t")), t=text) == score


@pytest.mark.parametrize(("text", "paper"), [("</seg> then", 0.0), ("</seg> Then", -0.1), ("</seg><answer>", -0.1), ("</seg> A </seg> B", -0.2), ("</seg> A" * 6, -0.5)])
def test_consistency(spark, text, paper):
    assert value(spark, rewards.score_consistency(F.col("t")), t=text) == pytest.approx(paper)
    assert value(spark, rewards.score_consistency(F.col("t"), positive=True), t=text) == pytest.approx(0.5 + paper)


def test_accuracy(spark):
    score = rewards.score_accuracy(F.col("t"), F.col("g"))
    assert value(spark, score, t="<answer>2 seconds</answer>", g="2") == 0.5
    assert value(spark, score, t="<answer>2</answer>", g="") == 0.0
    for logprob in (0.0, 3.0):
        assert value(spark, rewards.score_accuracy(F.col("t"), F.col("g"), F.lit(logprob)), t="<answer>2</answer>", g="2") == 0.5


@pytest.mark.parametrize(("text", "gold", "total"), [("<think>a</think><answer>x</answer>", "x", 1.0), ("<think>a <seg>1,2</seg> B<seg>1,2</seg> C<answer>x</answer>", "x", 1.05), ("<think>" + "<seg>1,2</seg> A" * 4 + "<answer>y</answer>", "x", -0.15)])
def test_total(spark, text, gold, total):
    assert value(spark, rewards.total(F.col("t"), F.col("g")), t=text, g=gold).rollout_total == pytest.approx(total)
