"""Algebra of labelled intervals in clips, and the questions built on it.

Input rows: clip, start, end, label and the clip's duration, under the names given in ``C``.  Pairs
within reach of each other meet in bins of time, so that one clip is spread over tasks and only pairs
that may qualify are made; existence tests that need no pair are aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loom.functions import fmt

TOLERANCE = 0.05


def normalised(events: DataFrame, least: float = 0.0, default_duration: float = 10.0) -> DataFrame:
    """Rounds bounds, drops empty events (or those shorter than ``least``), numbers the rest by (start, end, label)."""
    length = F.col("end_s") - F.col("start_s")
    kept = events.where(length >= least if least else length > 0)
    out = kept.select(
        "clip_id", "event_id", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), F.regexp_replace(F.trim("label"), "_", " ").alias("label"),
        F.round(length, 3).alias("len"), F.coalesce(F.nullif("duration", F.lit(0.0)), F.lit(default_duration)).alias("duration"),
    )
    order = W.Window.partitionBy("clip_id").orderBy("start_s", "end_s", "label", "event_id")
    return out.withColumn("idx", F.row_number().over(order))


def is_full(x: str = "", strict: bool = False) -> Column:
    """Whether an event spans its clip; strict tests the start's absolute value."""
    start, end, duration = (F.col(f"{x}{c}") for c in ("start_s", "end_s", "duration"))
    return ((F.abs(start) if strict else start) <= TOLERANCE) & (F.abs(end - duration) <= TOLERANCE)


def phrased(events: DataFrame) -> DataFrame:
    """Adds phrase: "the x", or "the k-th x" where a clip has several."""
    of = W.Window.partitionBy("clip_id", "label")
    k, n = F.row_number().over(of.orderBy("idx")), F.count("*").over(of)
    return events.withColumn("phrase", F.when(n > 1, F.concat(F.lit("the "), fmt.ordinal(k), F.lit(" "), F.lower("label"))).otherwise(F.concat(F.lit("the "), F.lower("label"))))


def pairs(events: DataFrame, ordered: bool = True, other: DataFrame | None = None) -> DataFrame:
    """Pairs of a clip's events as columns a_* and b_*; ordered: a before b by idx, else any two."""
    a = events.select(*[F.col(c).alias(c if c == "clip_id" else f"a_{c}") for c in events.columns])
    other = events if other is None else other
    b = other.select(*[F.col(c).alias(c if c == "clip_id" else f"b_{c}") for c in other.columns])
    return a.join(b, "clip_id").where(F.col("a_idx") < F.col("b_idx") if ordered else F.col("a_idx") != F.col("b_idx"))


def near_pairs(a: DataFrame, b: DataFrame, low: Column, high: Column, at: Column, width: float) -> DataFrame:
    """Pairs of a clip's events as columns a_* and b_* where ``at`` of b lies from ``low`` to ``high`` of a, each once.

    Time is cut into bins of ``width``: b is in the bin of its ``at``, a in all that its reach covers, so
    a clip of any length is dealt to as many keys as it has bins.  Choose the width of the reach, about.
    """
    bin_of = lambda x: F.floor(x / width).cast("long")
    name = lambda df, x: [F.col(c).alias(c if c == "clip_id" else f"{x}_{c}") for c in df.columns]
    left = a.select(*name(a, "a"), low.alias("_low"), high.alias("_high"), F.explode(F.sequence(bin_of(low), F.greatest(bin_of(low), bin_of(high)))).alias("_bin"))
    right = b.select(*name(b, "b"), at.alias("_at"), bin_of(at).alias("_bin"))
    return left.join(right, ["clip_id", "_bin"]).where(F.col("_at").between(F.col("_low"), F.col("_high"))).drop("_bin", "_at", "_low", "_high")


#: Bounds have three decimals; reaches are widened by less, and the exact test follows.
SLACK = 0.0005


def gap_pairs(a: DataFrame, low: float, high: float, b: DataFrame | None = None) -> DataFrame:
    """Pairs of which b begins between ``low`` and ``high`` after a's end."""
    end = F.col("end_s")
    found = near_pairs(a, a if b is None else b, end + (low - SLACK), end + (high + SLACK), F.col("start_s"), max(high - low, 1e-3))
    return found.where(gap().between(low, high) & (F.col("a_idx") != F.col("b_idx")))


def overlap_pairs(events: DataFrame) -> DataFrame:
    """Pairs that overlap or touch, a before b by idx, which orders by start: they meet where b begins.

    Bins are as wide as events are long on average, so that events lie in two bins on average.
    """
    width = events.agg(F.avg("len")).first()[0] or 1.0
    return near_pairs(events, events, F.col("start_s"), F.col("end_s"), F.col("start_s"), width).where("a_idx < b_idx")


def overlap() -> Column:
    return F.least("a_end_s", "b_end_s") - F.greatest("a_start_s", "b_start_s")


def gap() -> Column:
    return F.col("b_start_s") - F.col("a_end_s")


def overlap_by_labels(events: DataFrame, least: float = 0.05) -> DataFrame:
    """Overlapping pairs and their common length by label pair."""
    found = overlap_pairs(events).where(overlap() > least)
    return found.groupBy("a_label", "b_label").agg(F.count("*").alias("pairs"), F.round(F.sum(overlap()), 3).alias("seconds"))


def union_length(events: DataFrame) -> DataFrame:
    """Per clip: length of the union (touching intervals merge), total, average, count."""
    order = W.Window.partitionBy("clip_id").orderBy("start_s", "end_s", "idx")
    reach = F.max("end_s").over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    marked = events.withColumn("opens", F.when(reach >= F.col("start_s"), 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("opens").over(order)).groupBy("clip_id", "island").agg(F.min("start_s").alias("a"), F.max("end_s").alias("b"), F.sum("len").alias("len"), F.count("*").alias("n"))
    total = F.sum("len")
    return islands.groupBy("clip_id").agg(F.round(F.sum(F.col("b") - F.col("a")), 3).alias("union_s"), F.round(total, 3).alias("total_s"), F.round(total / F.sum("n"), 3).alias("mean_s"), F.sum("n").alias("n"))


def ordered_without_overlap(events: DataFrame) -> DataFrame:
    """Whether some event of a clip ends before another begins: the earliest end against the latest start."""
    return events.groupBy("clip_id").agg((F.min("end_s") < F.max("start_s")).alias("ordered"))


def adjacent_gaps(events: DataFrame) -> DataFrame:
    """Gaps between neighbouring events of a label."""
    order = W.Window.partitionBy("clip_id", "label").orderBy("start_s", "idx")
    return events.withColumn("next_start", F.lead("start_s").over(order)).where("next_start IS NOT NULL").select("clip_id", "label", "idx", F.round(F.col("next_start") - F.col("end_s"), 3).alias("gap"))


def candidate_types(events: DataFrame, gaps: tuple[float, float] = (0.05, 5.0), least: float = 0.05) -> DataFrame:
    """Per clip, the question types its events allow, by coarse tests; [] for less than two events short of the span."""
    core = events.where(~is_full(strict=True))
    order = W.Window.partitionBy("clip_id").orderBy("idx")
    reach = F.max("end_s").over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    common = F.least("reach", "end_s") - F.col("start_s")
    facts = core.groupBy("clip_id").agg(F.count("*").alias("n"), F.count_distinct(F.round("len", 2)).alias("lengths"), F.count_distinct("label").alias("labels"))
    laps = core.withColumn("reach", reach).groupBy("clip_id").agg(F.bool_or(F.col("reach").isNotNull() & (common > least)).alias("overlap"))
    made = events.select("clip_id").distinct().join(facts, "clip_id", "left").join(laps, "clip_id", "left").join(_with_gap(core, *gaps), "clip_id", "left")
    tests = (("gap", F.col("gap")), ("overlap", F.col("overlap")), ("duration_compare", F.col("lengths") >= 2), ("repeated_event_gap", F.col("n") > F.col("labels")), ("order", F.col("n") >= 3))
    types = F.array_compact(F.array(*[F.when((F.col("n") >= 2) & test, name) for name, test in tests]))
    return made.select("clip_id", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_core"), types.alias("types"))


def _with_gap(events: DataFrame, low: float, high: float) -> DataFrame:
    """Per clip, whether some event begins between low and high after another's end: a search of the next starts.

    Ends, moved by low, and starts lie on one line per clip; the first two starts from an end on decide,
    for the first may miss low by rounding (bounds have three decimals).  The line is walked from its
    end, for a frame that grows is kept from row to row, and one that shrinks is made anew for each.
    """
    starts = events.select("clip_id", F.col("start_s").alias("at")).distinct()
    starts = starts.withColumn("then", F.lead("at").over(W.Window.partitionBy("clip_id").orderBy("at")))
    line = starts.select("clip_id", "at", F.struct("at", "then").alias("s"), F.lit(None).cast("double").alias("end_s"))
    line = line.unionByName(events.select("clip_id", (F.col("end_s") + (low - 0.0005)).alias("at"), F.lit(None).cast("struct<at: double, then: double>").alias("s"), "end_s"))
    following = W.Window.partitionBy("clip_id").orderBy(F.desc("at"), F.col("s").isNull()).rowsBetween(W.Window.unboundedPreceding, 0)
    met = line.withColumn("next", F.last("s", ignorenulls=True).over(following)).where("end_s IS NOT NULL")
    near = lambda c: F.coalesce((F.col(f"next.{c}") - F.col("end_s")).between(low, high), F.lit(False))
    return met.groupBy("clip_id").agg(F.bool_or(near("at") | near("then")).alias("gap"))


def reasons(events: DataFrame, clips: DataFrame, types: DataFrame) -> DataFrame:
    """The first reason for which a clip is left out, or null: one pass gives both the counts and what stays.

    clips: clip_id, has_audio, duration.
    """
    counted = events.groupBy("clip_id").agg(F.count("*").alias("n"))
    joined = clips.join(counted, "clip_id", "left").join(types, "clip_id", "left")
    n, core = F.coalesce("n", F.lit(0)), F.coalesce("n_core", F.lit(0))
    reason = (
        F.when(~F.col("has_audio"), "missing_audio").when(F.col("duration").isNull() | (F.col("duration") <= 0), "bad_duration").when(n < 2, "events_lt_2")
        .when(core < 2, "too_few_non_full_events").when(F.size(F.coalesce("types", F.array())) == 0, "no_candidate_type")
    )
    return joined.withColumn("reason", reason)


def eligible(events: DataFrame) -> DataFrame:
    """Per clip, whether a temporal question is possible: two events, not all full, and overlap, order or a repeated label."""
    order = W.Window.partitionBy("clip_id").orderBy("start_s", "end_s", "idx")
    reach = F.max("end_s").over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    seen = events.withColumn("laps", reach > F.col("start_s")).groupBy("clip_id").agg(
        F.count("*").alias("n"), F.bool_and(is_full(strict=True)).alias("full"), F.bool_or(F.coalesce("laps", F.lit(False))).alias("laps"),
        (F.min("end_s") < F.max("start_s")).alias("ordered"), (F.count("*") > F.count_distinct("label")).alias("repeats"), F.first("duration").alias("duration"),
    )
    return seen.select("clip_id", ((F.col("n") >= 2) & (F.col("duration") > 0) & ~F.col("full") & (F.col("laps") | F.col("ordered") | F.col("repeats"))).alias("eligible"))


def chosen_events(events: DataFrame, most: int) -> DataFrame:
    """At most ``most`` events a clip: short of the span first, by time."""
    order = W.Window.partitionBy("clip_id").orderBy(is_full(), "start_s", "end_s", "idx")
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def first_pairs(found: DataFrame) -> DataFrame:
    """Of each clip's qualifying pairs, the first in the order of nested loops over a, then b."""
    rows = F.struct("a_idx", "b_idx", *[c for c in found.columns if c not in ("clip_id", "a_idx", "b_idx")])
    return found.groupBy("clip_id").agg(F.min_by(rows, F.struct("a_idx", "b_idx")).alias("p")).select("clip_id", "p.*")


def _question(df: DataFrame, kind: str, question: Column, choices: Column, answer: Column) -> DataFrame:
    return df.select("clip_id", F.lit(kind).alias("qa_type"), question.alias("question"), F.array_sort(choices).alias("choices"), answer.alias("answer"))


def _short(events: DataFrame) -> DataFrame:
    return phrased(events.where(~is_full()))


def qa_gap(events: DataFrame, low: float = 0.1, high: float = 5.0) -> DataFrame:
    found = first_pairs(gap_pairs(_short(events), low, high).where((F.col("b_start_s") > F.col("a_end_s")) & (F.col("a_label") != F.col("b_label"))))
    return _question(found, "gap", F.format_string("How long after %s ends does %s begin?", "a_phrase", "b_phrase"), fmt.second_choices(gap()), fmt.seconds(gap()))


def qa_overlap(events: DataFrame, least: float = 0.2, least_full: float = 0.5) -> DataFrame:
    """Two events short of the span; else a full one and another."""
    short, full = events.where(~is_full()), events.where(is_full())
    differ = F.col("a_label") != F.col("b_label")
    two = first_pairs(overlap_pairs(short).where((overlap() >= least) & differ)).withColumn("kind", F.lit(0))
    one = first_pairs(pairs(full, ordered=False, other=short).where((overlap() >= least_full) & differ)).withColumn("kind", F.lit(1))
    found = two.unionByName(one).withColumn("rank", F.row_number().over(W.Window.partitionBy("clip_id").orderBy("kind"))).where("rank = 1")
    a, b = (F.concat(F.lit("the "), F.lower(c)) for c in ("a_label", "b_label"))
    question = F.when(F.col("kind") == 0, F.format_string("How long do %s and %s overlap?", a, b)).otherwise(F.format_string("For how long is %s audible while %s is also present?", b, a))
    return _question(found, "overlap", question, fmt.second_choices(overlap()), fmt.seconds(overlap()))


def qa_repeated_gap(events: DataFrame, low: float = 0.1, high: float = 5.0) -> DataFrame:
    """Neighbours of the label that occurs first in the clip, then of the next."""
    short = _short(events)
    order = W.Window.partitionBy("clip_id", "label").orderBy("start_s", "idx")
    nearby = short.withColumn("first_idx", F.min("idx").over(W.Window.partitionBy("clip_id", "label")))
    for c in ("start_s", "phrase", "idx"):
        nearby = nearby.withColumn(f"b_{c}", F.lead(c).over(order))
    space = F.col("b_start_s") - F.col("end_s")
    found = nearby.where(space.between(low, high)).withColumn("rank", F.row_number().over(W.Window.partitionBy("clip_id").orderBy("first_idx", "start_s", "idx"))).where("rank = 1")
    return _question(found, "repeated_event_gap", F.format_string("How much time passes between the end of %s and the start of %s?", "phrase", "b_phrase"), fmt.second_choices(space), fmt.seconds(space))


def qa_duration_compare(events: DataFrame, least: float = 0.2) -> DataFrame:
    found = first_pairs(pairs(_short(events)).where((F.abs(F.col("a_len") - F.col("b_len")) >= least) & (F.col("a_label") != F.col("b_label"))))
    choices = F.array("a_phrase", "b_phrase", F.lit("they last the same amount of time"), F.lit("neither sound is audible"))
    return _question(found, "duration_compare", F.format_string("Which event lasts longer, %s or %s?", "a_phrase", "b_phrase"), choices, F.when(F.col("a_len") > F.col("b_len"), F.col("a_phrase")).otherwise(F.col("b_phrase")))


def qa_order(events: DataFrame, low: float = 0.2, high: float = 6.0) -> DataFrame:
    short = phrased(events.where(~is_full() & (F.col("start_s") > TOLERANCE)))
    start = F.col("start_s")
    near = near_pairs(short, short, start + (low - SLACK), start + (high + SLACK), start, max(high - low, 1e-3)).where("a_idx < b_idx")
    found = first_pairs(near.where((F.col("b_start_s") - F.col("a_start_s")).between(low, high) & (F.col("a_label") != F.col("b_label"))))
    choices = F.array("a_phrase", "b_phrase", F.lit("they start at the same time"), F.lit("neither sound occurs"))
    return _question(found, "order", F.format_string("Which event begins first, %s or %s?", "a_phrase", "b_phrase"), choices, F.col("a_phrase"))


def _best(events: DataFrame, by: Column) -> DataFrame:
    return events.withColumn("rank", F.row_number().over(W.Window.partitionBy("clip_id").orderBy(by, "idx"))).where("rank = 1")


def qa_start_percentage(events: DataFrame) -> DataFrame:
    """The start farthest from the middle."""
    at = F.col("start_s") / F.col("duration") * 100
    found = _best(phrased(events.where(~is_full() & F.col("start_s").between(F.lit(TOLERANCE), F.col("duration") - TOLERANCE))), F.abs(at - 50).desc())
    return _question(found, "start_percentage", F.format_string("At what percentage of the audio's total duration does %s begin?", "phrase"), fmt.percent_choices(at, floor=True), fmt.percent(at, floor=True))


def qa_duration_percentage(events: DataFrame, least: float = 0.2) -> DataFrame:
    """The length nearest 35 percent."""
    share = F.col("len") / F.col("duration") * 100
    found = _best(phrased(events.where(~is_full() & (F.col("len") >= least))), F.abs(share - 35))
    return _question(found, "duration_percentage", F.format_string("About what percentage of the full audio does %s occupy?", "phrase"), fmt.percent_choices(share), fmt.percent(share))


def qa_count_before(events: DataFrame, slack: float = 0.02) -> DataFrame:
    """Events over before the first target, from the third on, that one to eight precede."""
    short = _short(events)
    number = short.withColumn("nth", F.row_number().over(W.Window.partitionBy("clip_id").orderBy("idx")))
    # ends and starts on one line per clip: the ends so far are the events over
    line = number.select("clip_id", F.col("end_s").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("b_idx"), F.lit(None).cast("string").alias("b_phrase"), F.lit(None).cast("int").alias("nth"))
    line = line.unionByName(number.select("clip_id", (F.col("start_s") - slack).alias("at"), F.lit(1).alias("kind"), F.col("idx").alias("b_idx"), F.col("phrase").alias("b_phrase"), "nth"))
    so_far = W.Window.partitionBy("clip_id").orderBy("at", "kind").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    counted = line.withColumn("done", F.count_if(F.col("kind") == 0).over(so_far)).where((F.col("nth") >= 3) & F.col("done").between(1, 8))
    found = counted.groupBy("clip_id").agg(F.min_by(F.struct("b_phrase", "done"), "b_idx").alias("t")).select("clip_id", "t.*")
    return _question(found, "count_before", F.format_string("How many timestamped sound events have finished before %s begins?", "b_phrase"), fmt.count_choices(F.col("done")), F.col("done").cast("string"))


#: Builders in the order in which candidates are listed.
BUILDERS = {
    "start_percentage": qa_start_percentage, "duration_percentage": qa_duration_percentage, "gap": qa_gap, "overlap": qa_overlap,
    "count_before": qa_count_before, "repeated_event_gap": qa_repeated_gap, "duration_compare": qa_duration_compare, "order": qa_order,
}


def skeletons(events: DataFrame, **windows) -> DataFrame:
    """All candidates of clips with two events or more, one per type at most, with skeleton_id = clip:type."""
    n = F.count("*").over(W.Window.partitionBy("clip_id"))
    events = events.withColumn("n", n).where("n >= 2").drop("n")
    out = None
    for kind, build in BUILDERS.items():
        part = build(events, **windows.get(kind, {}))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("skeleton_id", F.concat_ws(":", "clip_id", "qa_type"))
