"""Interval algebra and question builders over clips of the events table.

Clips are long here (a day), so gap windows are minutes and not seconds; they are parameters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loom import views
from loom.operators import intervals as op
from loom.queries import query

WINDOWS = {"gap": {"low": 60.0, "high": 7200.0}, "repeated_event_gap": {"low": 60.0, "high": 7200.0}, "order": {"low": 60.0, "high": 7200.0}}

EV = f"""WITH v AS ({views.duck(views.EVENTS)}),
e AS (SELECT clip_id, event_id, round(start_s, 3) AS s, round(end_s, 3) AS e, replace(trim(label), '_', ' ') AS label, round(end_s - start_s, 3) AS len,
  coalesce(nullif(duration, 0), 10) AS d, row_number() OVER (PARTITION BY clip_id ORDER BY round(start_s, 3), round(end_s, 3), replace(trim(label), '_', ' '), event_id) AS i FROM v WHERE end_s > start_s),
x AS (SELECT *, s <= 0.05 AND abs(e - d) <= 0.05 AS isfull, abs(s) <= 0.05 AND abs(e - d) <= 0.05 AS isfull2 FROM e)"""
#: Events short of the span with phrases.
PH = """, f AS (SELECT *, count(*) OVER (PARTITION BY clip_id, label) AS lc, row_number() OVER (PARTITION BY clip_id, label ORDER BY i) AS lk FROM x WHERE NOT isfull),
p AS (SELECT *, 'the ' || CASE WHEN lc > 1 THEN CASE WHEN lk <= 6 THEN ['first', 'second', 'third', 'fourth', 'fifth', 'sixth'][lk] ELSE lk || 'th' END || ' ' ELSE '' END || lower(label) AS ph FROM f)"""
PAIR = ", q AS (SELECT a.clip_id, a.i AS ai, b.i AS bi, a.s AS as_, a.e AS ae, a.len AS al, a.label AS alab, a.ph AS aph, b.s AS bs, b.e AS be, b.len AS bl, b.label AS blab, b.ph AS bph FROM p a JOIN p b ON a.clip_id = b.clip_id AND a.i <> b.i)"


def _secs(x: str) -> str:
    return f"CASE WHEN greatest(0, {x}) < 0.05 THEN '0 seconds' WHEN abs(round_even({x}, 1) - 1) < 1e-9 THEN '1.0 second' ELSE printf('%.1f seconds', round_even({x}, 1)) END"


def _events(spark, sf_dir):
    return op.normalised(views.view(spark, sf_dir, views.EVENTS))


def _over_events(name: str, operator, sql: str) -> None:
    query(name, EV + sql)(lambda spark, sf_dir: operator(_events(spark, sf_dir)))


def _question(name: str, operator, sql: str, **how) -> None:
    """Without choices, which hold arrays: their set is checked by mth_choices__MTH02."""
    query(name, EV + PH + sql)(lambda spark, sf_dir: operator(_events(spark, sf_dir), **how).drop("choices"))


_over_events("normalised_events__QA0_SRT01", lambda e: e.select("clip_id", "event_id", "start_s", "end_s", "label", "len", F.col("idx").cast("long").alias("idx")), "SELECT clip_id, event_id, s AS start_s, e AS end_s, label, len, i AS idx FROM x")
_over_events("full_span__MTH03", lambda e: e.select("event_id", op.is_full().alias("loose"), op.is_full(strict=True).alias("strict")), "SELECT event_id, isfull AS loose, isfull2 AS strict FROM x")
_over_events("occurrence_phrases__WIN01_STR13", lambda e: op.phrased(e).select("event_id", "phrase"), (PH + " SELECT event_id, ph AS phrase FROM p").replace("WHERE NOT isfull", ""))
_over_events("overlap_pairs__JON08", op.overlap_by_labels, """SELECT a.label AS a_label, b.label AS b_label, count(*) AS pairs, round(sum(least(a.e, b.e) - greatest(a.s, b.s)), 3) AS seconds
FROM x a JOIN x b ON a.clip_id = b.clip_id AND a.i < b.i AND least(a.e, b.e) - greatest(a.s, b.s) > 0.05 GROUP BY 1, 2""")
_over_events("gap_pairs__JON07", lambda e: op.gap_pairs(e, 60, 7200).groupBy("clip_id").agg(F.count("*").alias("gaps"), F.round(F.min(op.gap()), 3).alias("least")),
    "SELECT a.clip_id, count(*) AS gaps, round(min(b.s - a.e), 3) AS least FROM x a JOIN x b ON a.clip_id = b.clip_id AND a.i <> b.i AND b.s - a.e BETWEEN 60 AND 7200 GROUP BY 1")
_over_events("ordered_non_overlap__JON09", op.ordered_without_overlap, "SELECT clip_id, EXISTS (SELECT 1 FROM x a JOIN x b ON a.clip_id = b.clip_id AND a.i <> b.i AND a.e < b.s WHERE a.clip_id = c.clip_id) AS ordered FROM (SELECT DISTINCT clip_id FROM x) c")
_over_events("adjacent_same_label__JON10", lambda e: op.adjacent_gaps(e).withColumn("idx", F.col("idx").cast("long")), "SELECT clip_id, label, i AS idx, round(n - e, 3) AS gap FROM (SELECT *, lead(s) OVER (PARTITION BY clip_id, label ORDER BY s, i) AS n FROM x) WHERE n IS NOT NULL")
_over_events("union_length__AGG15", op.union_length, """, m AS (SELECT *, max(e) OVER (PARTITION BY clip_id ORDER BY s, e, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM x),
g AS (SELECT *, sum(CASE WHEN r >= s THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY s, e, i) AS k FROM m),
h AS (SELECT clip_id, k, min(s) AS a, max(e) AS b, sum(len) AS len, count(*) AS n FROM g GROUP BY 1, 2)
SELECT clip_id, round(sum(b - a), 3) AS union_s, round(sum(len), 3) AS total_s, round(sum(len) / sum(n), 3) AS mean_s, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1""")
_over_events("chosen_events__SRT02", lambda e: op.chosen_events(e, 3).select("event_id"), "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY isfull, s, e, i) AS k FROM x) WHERE k <= 3")
_over_events("eligible_clips__QA10_AGG02", lambda e: op.eligible(e).groupBy("eligible").agg(F.count("*").alias("clips"), F.round(F.count("*") * 100 / F.sum(F.count("*")).over(op.W.Window.partitionBy()), 2).alias("pct")), """, c AS (SELECT clip_id, count(*) AS n, bool_and(isfull2) AS f, count(DISTINCT label) AS l, min(e) < max(s) AS o, max(d) AS d FROM x GROUP BY 1),
o AS (SELECT DISTINCT a.clip_id FROM x a JOIN x b ON a.clip_id = b.clip_id AND a.i < b.i AND least(a.e, b.e) > greatest(a.s, b.s)),
r AS (SELECT n >= 2 AND d > 0 AND NOT f AND (o.clip_id IS NOT NULL OR c.o OR n > l) AS eligible FROM c LEFT JOIN o USING (clip_id))
SELECT eligible, count(*) AS clips, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS pct FROM r GROUP BY 1""")

TYPES = """, core AS (SELECT * FROM x WHERE NOT isfull2),
fact AS (SELECT clip_id, count(*) AS n, count(DISTINCT round(len, 2)) AS ln, count(DISTINCT label) AS lb FROM core GROUP BY 1),
tst AS (SELECT a.clip_id, bool_or(b.s - a.e BETWEEN 60 AND 7200) AS g, bool_or(a.i < b.i AND least(a.e, b.e) - greatest(a.s, b.s) > 0.05) AS o FROM core a JOIN core b ON a.clip_id = b.clip_id AND a.i <> b.i GROUP BY 1),
typ AS (SELECT clip_id, coalesce(n, 0) AS n_core, array_to_string(list_filter([CASE WHEN n >= 2 AND g THEN 'gap' END, CASE WHEN n >= 2 AND o THEN 'overlap' END, CASE WHEN n >= 2 AND ln >= 2 THEN 'duration_compare' END,
  CASE WHEN n >= 2 AND n > lb THEN 'repeated_event_gap' END, CASE WHEN n >= 3 THEN 'order' END], lambda t: t IS NOT NULL), ',') AS types FROM (SELECT DISTINCT clip_id FROM x) LEFT JOIN fact USING (clip_id) LEFT JOIN tst USING (clip_id))"""


@query("candidate_types__QA9", EV + TYPES + " SELECT * FROM typ")
def _candidate_types(spark, sf_dir):
    return op.candidate_types(_events(spark, sf_dir), gaps=(60.0, 7200.0)).withColumn("types", F.array_join("types", ","))


def _reasons(spark, sf_dir):
    raw = views.view(spark, sf_dir, views.EVENTS)
    clips = raw.groupBy("clip_id").agg(F.max("duration").alias("duration"), (F.min("event_id") % 17 != 0).alias("has_audio"))
    events = op.normalised(raw, least=120.0)
    return op.reasons(events, clips, op.candidate_types(events, gaps=(60.0, 7200.0)))


LONG = (EV + TYPES).replace("WHERE end_s > start_s", "WHERE end_s - start_s >= 120")
REASON = """, clip AS (SELECT clip_id, max(duration) AS dur, min(event_id) % 17 <> 0 AS au FROM v GROUP BY 1), cnt AS (SELECT clip_id, count(*) AS n FROM x GROUP BY 1),
rea AS (SELECT clip_id, CASE WHEN NOT au THEN 'missing_audio' WHEN dur IS NULL OR dur <= 0 THEN 'bad_duration' WHEN coalesce(n, 0) < 2 THEN 'events_lt_2' WHEN coalesce(n_core, 0) < 2 THEN 'too_few_non_full_events' WHEN coalesce(types, '') = '' THEN 'no_candidate_type' END AS reason
  FROM clip LEFT JOIN cnt USING (clip_id) LEFT JOIN typ USING (clip_id))"""


@query("filter_reason_counts__FLT01", LONG + REASON + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS clips FROM rea GROUP BY 1")
def _reason_counts(spark, sf_dir):
    return _reasons(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("clips"))


@query("filter_kept__FLT01", LONG + REASON + " SELECT clip_id FROM rea WHERE reason IS NULL")
def _kept(spark, sf_dir):
    return _reasons(spark, sf_dir).where("reason IS NULL").select("clip_id")


_question("qa_gap__QA3_JON11", op.qa_gap, PAIR + f""" SELECT clip_id, 'gap' AS qa_type, 'How long after ' || aph || ' ends does ' || bph || ' begin?' AS question, {_secs('bs - ae')} AS answer FROM (
SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY ai, bi) AS k FROM q WHERE bs > ae AND bs - ae BETWEEN 60 AND 7200 AND alab <> blab) WHERE k = 1""", **WINDOWS["gap"])
_question("qa_duration_compare__QA7", op.qa_duration_compare, PAIR + """ SELECT clip_id, 'duration_compare' AS qa_type, 'Which event lasts longer, ' || aph || ' or ' || bph || '?' AS question, CASE WHEN al > bl THEN aph ELSE bph END AS answer FROM (
SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY ai, bi) AS k FROM q WHERE ai < bi AND abs(al - bl) >= 0.2 AND alab <> blab) WHERE k = 1""")
query("qa_order__QA8", EV + PH.replace("WHERE NOT isfull", "WHERE NOT isfull AND s > 0.05") + PAIR + """ SELECT clip_id, 'order' AS qa_type, 'Which event begins first, ' || aph || ' or ' || bph || '?' AS question, aph AS answer FROM (
SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY ai, bi) AS k FROM q WHERE ai < bi AND bs - as_ BETWEEN 60 AND 7200 AND alab <> blab) WHERE k = 1""")(lambda spark, sf_dir: op.qa_order(_events(spark, sf_dir), **WINDOWS["order"]).drop("choices"))
_question("qa_overlap__QA4", op.qa_overlap, f""", two AS (SELECT a.clip_id, a.i AS ai, b.i AS bi, a.label AS al, b.label AS bl, least(a.e, b.e) - greatest(a.s, b.s) AS o, 0 AS kind FROM x a JOIN x b ON a.clip_id = b.clip_id AND a.i < b.i AND NOT a.isfull AND NOT b.isfull WHERE least(a.e, b.e) - greatest(a.s, b.s) >= 0.2 AND a.label <> b.label),
one AS (SELECT a.clip_id, a.i AS ai, b.i AS bi, a.label AS al, b.label AS bl, least(a.e, b.e) - greatest(a.s, b.s) AS o, 1 AS kind FROM x a JOIN x b ON a.clip_id = b.clip_id AND a.isfull AND NOT b.isfull WHERE least(a.e, b.e) - greatest(a.s, b.s) >= 0.5 AND a.label <> b.label)
SELECT clip_id, 'overlap' AS qa_type, CASE WHEN kind = 0 THEN 'How long do the ' || lower(al) || ' and the ' || lower(bl) || ' overlap?' ELSE 'For how long is the ' || lower(bl) || ' audible while the ' || lower(al) || ' is also present?' END AS question, {_secs('o')} AS answer
FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY kind, ai, bi) AS k FROM (SELECT * FROM two UNION ALL SELECT * FROM one)) WHERE k = 1""")
_question("qa_repeated_gap__QA6", op.qa_repeated_gap, f""", l AS (SELECT *, min(i) OVER (PARTITION BY clip_id, label) AS fi, lead(s) OVER w AS ns, lead(ph) OVER w AS np FROM p WINDOW w AS (PARTITION BY clip_id, label ORDER BY s, i))
SELECT clip_id, 'repeated_event_gap' AS qa_type, 'How much time passes between the end of ' || ph || ' and the start of ' || np || '?' AS question, {_secs('ns - e')} AS answer FROM (
SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY fi, s, i) AS k FROM l WHERE ns - e BETWEEN 60 AND 7200) WHERE k = 1""", **WINDOWS["repeated_event_gap"])
query("qa_start_percentage__QA1_SRT07", EV + PH.replace("WHERE NOT isfull", "WHERE NOT isfull AND s BETWEEN 0.05 AND d - 0.05") + """, z AS (SELECT *, s / d * 100 AS pc FROM p)
SELECT clip_id, 'start_percentage' AS qa_type, 'At what percentage of the audio''s total duration does ' || ph || ' begin?' AS question, CAST(floor(pc / 5) * 5 AS INTEGER) || '%' AS answer FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY abs(pc - 50) DESC, i) AS k FROM z) WHERE k = 1""")(lambda spark, sf_dir: op.qa_start_percentage(_events(spark, sf_dir)).drop("choices"))
query("qa_duration_percentage__QA2", EV + PH.replace("WHERE NOT isfull", "WHERE NOT isfull AND len >= 0.2") + """, z AS (SELECT *, len / d * 100 AS pc FROM p)
SELECT clip_id, 'duration_percentage' AS qa_type, 'About what percentage of the full audio does ' || ph || ' occupy?' AS question, CAST(round_even(pc / 5, 0) * 5 AS INTEGER) || '%' AS answer FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY abs(pc - 35), i) AS k FROM z) WHERE k = 1""")(lambda spark, sf_dir: op.qa_duration_percentage(_events(spark, sf_dir)).drop("choices"))
_question("qa_count_before__QA5_WIN14", op.qa_count_before, """, nn AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY i) AS nth FROM p),
c AS (SELECT b.clip_id, b.i, b.ph, count(*) AS done FROM nn a JOIN nn b ON a.clip_id = b.clip_id AND a.i <> b.i AND a.e <= b.s - 0.02 AND b.nth >= 3 GROUP BY 1, 2, 3 HAVING count(*) BETWEEN 1 AND 8)
SELECT clip_id, 'count_before' AS qa_type, 'How many timestamped sound events have finished before ' || ph || ' begins?' AS question, CAST(done AS STRING) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY i) AS k FROM c) WHERE k = 1""")


from loom.queries import SQL  # noqa: E402

_ASKED = " UNION ALL ".join(f"SELECT clip_id, qa_type FROM ({SQL[n]})" for n in ("qa_start_percentage__QA1_SRT07", "qa_duration_percentage__QA2", "qa_gap__QA3_JON11", "qa_overlap__QA4", "qa_count_before__QA5_WIN14", "qa_repeated_gap__QA6", "qa_duration_compare__QA7", "qa_order__QA8"))


@query("skeleton_counts__QA_AGG01", f"SELECT qa_type, count(*) AS n, count(DISTINCT clip_id || ':' || qa_type) AS ids FROM ({_ASKED}) WHERE clip_id IN ({EV} SELECT clip_id FROM x GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1")
def _skeletons(spark, sf_dir):
    return op.skeletons(_events(spark, sf_dir), **WINDOWS).groupBy("qa_type").agg(F.count("*").alias("n"), F.count_distinct("skeleton_id").alias("ids"))
