"""Joins to index tables, routes of judged rows, validators with first reasons, preference trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loom.functions import tags
from loom.operators.messages import filled
from loom.sources.files import written


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key that has a single distinct value; other keys go."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n")).where("_n = 1").drop("_n")


def last_index(df: DataFrame, key: str, index: str) -> DataFrame:
    """Per key the index of its last row."""
    return df.groupBy(key).agg(F.max(index).alias(index))


def with_index(df: DataFrame, lookup: DataFrame, key: str, index: str, missing: int = -1) -> DataFrame:
    return df.join(lookup, key, "left").withColumn(index, F.coalesce(index, F.lit(missing)))


def source_group(index: Column, first: int) -> Column:
    """Rows before ``first`` are polished; a missing index (-1) is, too."""
    return F.when(index < first, "polished").otherwise("template")


def in_first_of(df: DataFrame, key: str, sets: dict[str, DataFrame], rest: str) -> DataFrame:
    """Names the first of the id sets that holds a row's key."""
    name = F.lit(rest)
    for label, ids in reversed(sets.items()):
        df = df.join(ids.select(F.col(key), F.lit(True).alias(f"_in_{label}")).distinct(), key, "left")
        name = F.when(F.col(f"_in_{label}"), label).otherwise(name)
    return df.withColumn("found_in", name).drop(*[f"_in_{label}" for label in sets])


def unfinished(df: DataFrame, done: DataFrame, key: str, prefix: str | None = None) -> DataFrame:
    """Rows whose id is not among the done ones (of ids with a prefix sign, their part before it)."""
    ids = done.select(F.split(key, prefix)[0].alias(key) if prefix else F.col(key)).distinct()
    return df.join(ids, key, "left_anti")


def left_with_defaults(tests: DataFrame, predictions: DataFrame, key: str, order: str, default: dict) -> DataFrame:
    """Every test row with its last prediction, or defaults."""
    last = predictions.groupBy(key).agg(F.max_by(F.struct(*[c for c in predictions.columns if c != key]), order).alias("_p")).select(key, "_p.*")
    return tests.join(last, key, "left").fillna(default)


def judged_route(qa: Column, cot: Column) -> Column:
    """Both valid: sft; only the question: rl; all else, and the unknown: discard."""
    return F.when(qa & cot, "sft").when(qa & ~cot, "rl").otherwise("discard")


def policy_route(kind: Column, group: Column, review_types: list[str], review_pairs: list[tuple[str, str]]) -> Column:
    """By type, then by (group, type); else a candidate."""
    pair = F.lit(False)
    for g, t in review_pairs:
        pair = pair | ((group == g) & (kind == t))
    return F.when(kind.isin(*review_types), F.concat(F.lit("review_type:"), kind)).when(pair, F.concat_ws(":", F.lit("review_pair"), group, kind)).otherwise("sft")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule's name whose test fails; empty where all hold. A test that is null fails."""
    out = F.lit("")
    for name, ok in reversed(rules):
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(name)
    return out


def triplet_reason(question: Column, choices: Column, answer: Column, cot: Column) -> Column:
    inside = tags.strip(F.split(F.split(cot, "<answer>", 2)[1], "</answer>")[0])
    have = [(f"missing tag: {t}", cot.contains(t)) for t in ("<think>", "</think>", "<answer>", "</answer>")]
    return first_reason([
        ("missing keys", question.isNotNull() & choices.isNotNull() & answer.isNotNull() & cot.isNotNull()), ("bad question", F.trim(question) != ""), ("choices must be list of 4", F.size(choices) == 4),
        ("bad choices", F.forall(choices, lambda c: F.trim(c) != "")), ("answer not in choices", F.array_contains(choices, answer)), *have, ("cot answer mismatch", F.when(cot.contains("<answer>"), inside == answer)), ("missing seg", cot.contains("<seg>")),
    ])


def record_reason(messages: Column, expected: Column) -> Column:
    at = lambda k: F.get(messages, F.lit(k))
    user, reply = F.coalesce(at(0)["content"], F.lit("")), F.coalesce(at(1)["content"], F.lit(""))
    inside = tags.strip(F.get(F.split(F.get(F.split(reply, "<answer>", 2), F.lit(1)), "</answer>"), F.lit(0)))
    have = [(f"missing tag {t}", reply.contains(t)) for t in ("<think>", "</think>", "<answer>", "</answer>")]
    return first_reason([
        ("messages length", F.size(messages) == 2), ("bad roles", (at(0)["role"] == "user") & (at(1)["role"] == "assistant")), ("bad user content", user.startswith("<audio>") & user.contains("Choose the answer from")),
        ("bad assistant wrapper", reply.startswith("<think>") & reply.endswith("</answer>")), *have, ("missing seg", reply.rlike(tags.SEGMENT)), ("answer mismatch", expected.isNull() | (inside == expected)),
    ])


def invented(used: Column, expected: Column) -> Column:
    """Whether some used segment is not among the expected ones."""
    return F.size(F.array_except(used, expected)) > 0


def quarantined(df: DataFrame, ok: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad ones; strict: a bad row is an error."""
    ok = F.coalesce(ok, F.lit(False))
    if strict:
        checked = F.when(ok, True).otherwise(F.raise_error(F.lit("a row failed")).cast("boolean"))
        return df.withColumn("_ok", checked).where("_ok").drop("_ok"), df.limit(0)
    return df.where(ok), df.where(~ok)


def preferences(nodes: DataFrame, threshold: float) -> DataFrame:
    """Best against worst child of each node whose rewards lie further apart than the threshold."""
    kids = nodes.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.max_by("node_id", F.struct("outcome_reward", "node_id")).alias("good"), F.max("outcome_reward").alias("good_score"), F.min_by("node_id", F.struct("outcome_reward", "node_id")).alias("bad"), F.min("outcome_reward").alias("bad_score"))
    return kids.where(F.col("good_score") - F.col("bad_score") > threshold)


def path_rewards(nodes: DataFrame) -> DataFrame:
    """Terminal nodes with the mean and least reward along their path to the root, of any length.

    Pointer jumping: every node holds the sums of a stretch of its path and the node above that stretch;
    each round joins it to that node's own stretch, so a path of n nodes takes log2(n) rounds, each of
    them a table.  A missing parent ends a path; a cycle is an error.
    """
    spark = nodes.sparkSession
    reward = F.col("outcome_reward")
    walk = written(nodes.select("node_id", F.col("parent_id").alias("at"), reward.alias("total"), reward.alias("least"), F.lit(1).cast("long").alias("n")), "paths")
    most = walk.count()
    while not walk.where("at IS NOT NULL").isEmpty():
        if walk.agg(F.max("n")).first()[0] > most:
            raise ValueError("a cycle of parents")
        above = walk.select(F.col("node_id").alias("at"), F.col("at").alias("_at"), F.col("total").alias("_total"), F.col("least").alias("_least"), F.col("n").alias("_n"))
        joined = walk.join(above, "at", "left")
        step = joined.select("node_id", F.col("_at").alias("at"), (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"), F.least("least", "_least").alias("least"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
        walk = written(step, "paths")
    ends = nodes.where("terminated").select("node_id", "correct")
    return ends.join(walk, "node_id").select("node_id", "correct", (F.col("total") / F.col("n")).alias("mean_reward"), F.col("least").alias("min_reward"))


def item_id(orders: list[Column], line: Column) -> Column:
    return filled(*orders, F.concat(F.lit("line_"), line.cast("string")))


def earlier_match(df: DataFrame, key: str, order: str, threshold: float) -> DataFrame:
    """Pairs of a clip's segments, later against earlier, whose overlap over union reaches the threshold; the first per segment."""
    a = df.select(key, F.col(order).alias("i"), F.col("start_s").alias("as_"), F.col("end_s").alias("ae"))
    b = df.select(key, F.col(order).alias("j"), F.col("start_s").alias("bs"), F.col("end_s").alias("be"))
    found = a.join(b, key).where("j < i").withColumn("iou", iou(F.col("as_"), F.col("ae"), F.col("bs"), F.col("be"))).where(F.col("iou") >= threshold)
    return found.groupBy(key, "i").agg(F.min_by(F.struct("j", "iou"), "j").alias("m")).select(key, "i", "m.j", "m.iou")


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    common = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    union = (a_end - a_start) + (b_end - b_start) - common
    return F.when(union <= 0, 0.0).otherwise(common / union)


def clamped(start: Column, end: Column, duration: Column) -> Column:
    """Struct of the bounds within [0, duration]; null where nothing is left."""
    low, high = (F.greatest(F.lit(0.0), F.least(x, duration)) for x in (start, end))
    return F.when(low < high, F.struct(low.alias("start"), high.alias("end")))


def accepted(segments: Column, threshold: float) -> Column:
    """Indices of segments that overlap no accepted earlier one by the threshold: a fold, for each depends on the last."""
    overlaps = lambda s, t: F.greatest(F.lit(0.0), F.least(s["end"], t["end"]) - F.greatest(s["start"], t["start"]))
    ratio = lambda s, t: F.when((s["end"] - s["start"]) + (t["end"] - t["start"]) - overlaps(s, t) <= 0, 0.0).otherwise(overlaps(s, t) / ((s["end"] - s["start"]) + (t["end"] - t["start"]) - overlaps(s, t)))
    numbered = F.transform(segments, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.slice(numbered, 1, 0)
    kept = F.aggregate(numbered, none, lambda a, s: F.when(F.exists(a, lambda t: ratio(s, t) >= threshold), a).otherwise(F.concat(a, F.array(s))))
    return F.transform(kept, lambda s: s["i"])


