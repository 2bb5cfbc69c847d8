"""Reasoning texts, rewards at tokens, hooks and the smaller scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from loom import views
from loom.functions import rewards
from loom.operators import batch, intervals, messages, presets, rl, sampling
from loom.operators import narration as op
from loom.plans import hooks
from loom.queries import query, simple
from loom.queries.intervals import EV
from loom.sources import files

C = F.col
T = lambda x: f"regexp_replace(regexp_replace(printf('%.3f', round({x}, 3)), '0+$', ''), '\\.$', '.0')"
SEG = lambda x: f"'<seg>' || {T(x + '.s')} || ', ' || {T(x + '.e')} || '</seg>'"
three, two = (lambda x: f"printf('%.3f', {x})"), (lambda x: f"printf('%.2f', {x})")
PICK = lambda key, slot, n: f"(('0x' || substring(md5({key} || '_' || {slot}), 1, 8))::BIGINT % {n})"
KINDS = list(op.NARRATIVES)
#: The SQL of each name in the sentences, over a row of a, b, t, l (all events), d and answer.
NAMES = {
    "a": "a.p", "a_seg": SEG("a"), "a_start": T("a.s"), "a_end": T("a.e"), "a_len": three("a.e - a.s"), "b": "b.p", "b_seg": SEG("b"), "b_start": T("b.s"), "b_end": T("b.e"), "b_len": three("b.e - b.s"),
    "gap": three("b.s - a.e"), "from": T("greatest(a.s, b.s)"), "to": T("least(a.e, b.e)"), "common": three("greatest(0.0, least(a.e, b.e) - greatest(a.s, b.s))"), "longer_len": three("greatest(a.e - a.s, b.e - b.s)"), "shorter_len": three("least(a.e - a.s, b.e - b.s)"),
    "longer": "CASE WHEN a.e - a.s > b.e - b.s THEN a.p ELSE b.p END", "first": "CASE WHEN a.s <= b.s THEN a.p ELSE b.p END", "total": T("d"), "start_share": two("a.s / d * 100"), "len_share": two("(a.e - a.s) / d * 100"),
    "completed": f"array_to_string(list_transform(done, lambda z, k: {SEG('z')} || ' shows completed event ' || k || ' ending at ' || {T('z.e')} || ' seconds'), '; ')", "n": "len(done)", "t_seg": SEG("t"), "t_start": T("t.s"), "answer": "answer",
}


def sentence(template: str) -> str:
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"({NAMES[p]})" if k % 2 else "'" + p + "'" for k, p in enumerate(parts) if k % 2 or p)


CASES = " ".join(f"WHEN '{k}' THEN " + (f"CASE WHEN {PICK('clip_id', repr('version'), 2)} = 0 THEN {sentence(v[0])} ELSE {sentence(v[1])} END" if len(v) > 1 else sentence(v[0])) for k, v in op.NARRATIVES.items())


@query("narrated_questions__STR16", EV + f""", g AS (SELECT clip_id, any_value(d) AS d, list({{'s': s, 'e': e, 'p': 'the ' || lower(label)}} ORDER BY i)[:4] AS l, min(event_id) AS m FROM x GROUP BY 1 HAVING count(*) >= 2),
r AS (SELECT clip_id, d, l, l[1] AS a, l[2] AS b, l[-1] AS t, [{', '.join(f"'{k}'" for k in KINDS)}][m % {len(KINDS)} + 1] AS kind, CAST(m % 7 AS STRING) AS answer FROM g),
q AS (SELECT *, list_filter(l[:-2], lambda z: z.e <= t.s + 1e-6) AS done FROM r)
SELECT clip_id, kind, '<think>' || trim(CASE kind {CASES} END) || '</think><answer>' || answer || '</answer>' AS response FROM q""")
def _narrated(spark, sf_dir):
    return _narrations(spark, sf_dir).select("clip_id", "kind", "response")


def _narrations(spark, sf_dir):
    events = intervals.normalised(views.view(spark, sf_dir, views.EVENTS))
    row = F.struct("idx", C("start_s").alias("start"), C("end_s").alias("end"), F.concat(F.lit("the "), F.lower("label")).alias("phrase"))
    groups = events.groupBy("clip_id").agg(F.slice(F.array_sort(F.collect_list(row)), 1, 4).alias("l"), F.min("event_id").alias("m"), F.first("duration").alias("d")).where("size(l) >= 2")
    asked = groups.withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), (C("m") % len(KINDS) + 1).cast("int"))).withColumn("answer", (C("m") % 7).cast("string"))
    return asked.withColumn("response", op.narrated(C("kind"), C("l"), C("answer"), C("d"), C("clip_id")))


@query("diversified_questions__STR17", EV + f""", g AS (SELECT clip_id, any_value(d) AS d, min(event_id) AS m, arg_min(label, i) AS f, count(*) AS n FROM x GROUP BY 1),
a AS (SELECT clip_id, 'the ' || lower(f) AS f, k, CASE {PICK('clip_id', "(k || '_0')", 2)} WHEN 0 THEN 'Listening closely, one hears' ELSE 'The clip holds' END || ' ' || CASE {PICK('clip_id', "(k || '_1')", 2)} WHEN 0 THEN 'the ' || lower(f) ELSE 'the ' || lower(f) || ' and ' || n || ' events in all, each with its own times' END
  || ' ' || CASE {PICK('clip_id', "(k || '_2')", 2)} WHEN 0 THEN 'so that is it' ELSE 'which answers it' END AS t FROM g, range(10) r(k)),
h AS (SELECT clip_id, any_value(f) AS f, arg_min(t, k) FILTER (len(string_split(t, ' ')) BETWEEN 9 AND 18) AS t FROM a GROUP BY 1)
SELECT clip_id, t IS NOT NULL AS drawn, len(string_split(t, ' ')) AS words, t FROM h WHERE t IS NOT NULL""")
def _diversified(spark, sf_dir):
    drawn = _draws(spark, sf_dir).withColumn("drawn", ~C("t").startswith("Let us"))
    return drawn.where("drawn").select("clip_id", "drawn", op.n_words(C("t")).cast("long").alias("words"), "t")


def _draws(spark, sf_dir):
    events = intervals.normalised(views.view(spark, sf_dir, views.EVENTS))
    groups = events.groupBy("clip_id").agg(F.concat(F.lit("the "), F.lower(F.min_by("label", "idx"))).alias("f"), F.count("*").alias("n"))
    parts = [[F.lit("Listening closely, one hears"), F.lit("The clip holds")], [C("f"), F.concat(C("f"), F.lit(" and "), C("n").cast("string"), F.lit(" events in all, each with its own times"))], [F.lit("so that is it"), F.lit("which answers it")]]
    return groups.select("clip_id", op.diversified(C("clip_id"), parts, F.concat(F.lit("Let us hear "), C("f")), ["Times tell.", "Each event has its place."], 9, 18).alias("t"))


@query("reread_segments__STR14", EV + f""", g AS (SELECT clip_id, list({{'s': s, 'e': e, 'p': label}} ORDER BY i)[:2] AS l FROM x GROUP BY 1 HAVING count(*) >= 2)
SELECT clip_id, k, l[k].s AS start, l[k].e AS stop, round(l[k].e - l[k].s, 3) AS dur, CASE WHEN k = 1 THEN 'The ' || l[1].p || ' sound which begins at' ELSE '' END AS before, CASE WHEN k = 1 THEN 'contains the music' ELSE 'and ends' END AS after,
  CASE WHEN k = 1 THEN 'the ' || l[1].p || ' sound which' ELSE 'this sound' END AS label FROM g, (VALUES (1), (2)) r(k)""")
def _reread(spark, sf_dir):
    events = intervals.normalised(views.view(spark, sf_dir, views.EVENTS))
    row = F.struct("idx", C("start_s").alias("start"), C("end_s").alias("end"), C("label").alias("p"))
    groups = events.groupBy("clip_id").agg(F.slice(F.array_sort(F.collect_list(row)), 1, 2).alias("l")).where("size(l) = 2")
    text = F.concat(F.lit("The "), F.get("l", F.lit(0))["p"], F.lit(" sound which begins at "), op.segment(F.get("l", F.lit(0))), F.lit(" contains the music "), op.segment(F.get("l", F.lit(1))), F.lit(" and ends. "))
    found = groups.select("clip_id", op.tagged_segments(text).alias("s")).select("clip_id", F.arrays_zip("s", op.event_labels(C("s")).alias("label")).alias("z")).select("clip_id", F.posexplode("z").alias("k", "z"))
    return found.select("clip_id", (C("k") + 1).alias("k"), C("z.s.start").alias("start"), C("z.s.end").alias("stop"), C("z.s.dur").alias("dur"), C("z.s.before").alias("before"), C("z.s.after").alias("after"), C("z.label").alias("label"))


def _tokens(name, operator, sql):
    simple(name, views.TOKENS, operator, sql)


_tokens("rewards_at_last_token__RWD14", lambda v: rl.at_last_token(v.withColumn("mask", F.when(C("pos") < C("seq") % 4, 1).otherwise(0)), v.select("seq").distinct().where("seq % 5 > 0").withColumn("score", C("seq") % 10 / 10)).select("seq", "pos", "reward"),
    """, k AS (SELECT seq, pos, least(seq % 4, count(*) OVER (PARTITION BY seq)) AS n, max(pos) OVER (PARTITION BY seq) AS m FROM v)
    SELECT seq, pos, CASE WHEN seq % 5 > 0 AND pos = CASE WHEN n > 0 THEN n - 1 ELSE m END THEN (seq % 10) / 10.0::DOUBLE ELSE 0.0 END AS reward FROM k""")  # fmt: skip
WORDS = "SELECT doc_id, lang, source, text FROM {documents}"
simple("sublist_places__ARR01", views.TOKENS, lambda v: v.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens")).select(
    "seq", F.array_join(batch.places_of(C("tokens"), F.array(F.lit(1).cast("long"))), ",").alias("one"), F.array_join(batch.places_of(C("tokens"), F.array(C("seq") % 5, F.lit(2).cast("long"))), ",").alias("two"),
    batch.first_filled(F.array(F.array(F.lit(""), F.lit(None)), F.array(F.when(C("seq") % 2 == 0, "even"), C("seq").cast("string")))).alias("first")),
    """, g AS (SELECT seq, list(token ORDER BY pos) AS l FROM v GROUP BY 1) SELECT seq, array_to_string(list_filter(range(len(l)), lambda i: l[i + 1] = 1), ',') AS one,
    array_to_string(list_filter(range(len(l) - 1), lambda i: l[i + 1] = seq % 5 AND l[i + 2] = 2), ',') AS two, CASE WHEN seq % 2 = 0 THEN 'even' ELSE CAST(seq AS STRING) END AS first FROM g""")  # fmt: skip
simple("quietest_rows__SRT05", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS value FROM {events}", lambda v: batch.least_by(v, "value", "event_id").select("event_id", "value"), " SELECT event_id, value FROM v WHERE value IS NOT NULL ORDER BY value, event_id LIMIT 20")
simple("json_without_tokens__JSN01", WORDS, lambda v: v.select("doc_id", messages.json_safe(F.create_map(F.lit("lang"), C("lang"), F.lit("hub_token"), C("source"), F.lit("source"), C("source"))).alias("j"), messages.json_safe_bytes(C("text").cast("binary")).alias("b")),
    """ SELECT doc_id, '{"lang":"' || lang || '","hub_token":null,"source":"' || source || '"}' AS j, '<<<bytes>>>' AS b FROM v""")  # fmt: skip
simple("query_and_response__DSP04", WORDS, lambda v: presets.query_and_response(v.select("doc_id", C("lang").alias("query"), C("text").alias("response"), "source")).groupBy("query").agg(F.sum(F.length("response")).alias("n")), " SELECT lang AS query, CAST(sum(length(text)) AS BIGINT) AS n FROM v GROUP BY 1")
QUOTED = lambda name: presets.KNIGHTS_PROMPTS[name].replace("'", "''").replace("{quiz}", "' || text || '")
simple("knights_prompts__DSP36", "SELECT item_id, text FROM {benchmark}", lambda v: v.select("item_id", F.md5(presets.knights_prompt(C("text"), "base")).alias("base"), F.md5(presets.knights_prompt(C("text"), "qwen-instruct")).alias("chat")), f" SELECT item_id, md5('{QUOTED('base')}') AS base, md5('{QUOTED('qwen-instruct')}') AS chat FROM v")
simple("policy_split__DSP36", "SELECT doc_id FROM {documents}", lambda v: sampling.shuffled_split(v, "doc_id", 0.9, 5), """, k AS (SELECT doc_id, row_number() OVER (ORDER BY md5('5_' || doc_id), doc_id) - 1 AS k, CAST(floor(count(*) OVER () * 0.9) AS BIGINT) AS c FROM v)
    SELECT doc_id, CASE WHEN k < c THEN 'train' ELSE 'test' END AS split, CASE WHEN k < c THEN k ELSE k - c END AS "index" FROM k""")  # fmt: skip


@query("rows_with_files__FLT15", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 AND c_nationkey % 2 = 0")
def _with_files(spark, sf_dir):
    path = files.scratch(spark, "listed")
    rows = views.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows.select(C("c_nationkey").alias("n"), C("c_custkey").cast("string").alias("v")).where("n % 2 = 0").repartition("n").write.partitionBy("n").text(path)
    found = files.listing(spark, path).select(F.regexp_extract("path", "^n=([0-9]+)/", 1).alias("path")).distinct()
    return presets.with_files(rows.select(C("c_custkey").alias("id"), F.when(C("c_custkey") % 3 > 0, C("c_nationkey").cast("string")).alias("file")), "file", found).select("id")


@query("row_hooks__HOOKS", "SELECT doc_id, k FROM documents, range(2) r(k) WHERE doc_id % 3 > 0 AND k < doc_id % 3")
def _row_hooks(spark, sf_dir):
    def one(row):
        n = row["doc_id"] % 3
        return [{"doc_id": row["doc_id"], "k": k} for k in range(n)] if n == 2 else {"doc_id": row["doc_id"], "k": 0} if n else None

    return hooks.row_map(views.read(spark, sf_dir, "documents").select("doc_id", "lang"), one, "doc_id long, k long", strict=True)


@query("registered_scorers__HOOKS", f"WITH v AS ({views.duck(views.RESPONSES)}) " + r"SELECT doc_id, CASE WHEN regexp_matches(response, '(?s)^<think>.*?</think>\s*<answer>.*?</answer>\z') THEN 1.0::DOUBLE ELSE 0.0 END AS whole, CAST(length(response) AS INTEGER) AS length FROM v")
def _registered(spark, sf_dir):
    hooks.SCORERS.register("whole", lambda r, g: rewards.whole_format(r), exist_ok=True)
    hooks.SCORERS.register("length", lambda r, g: F.length(r), exist_ok=True)
    return hooks.scored(views.view(spark, sf_dir, views.RESPONSES), ["whole", "length"], "response", "gold").select("doc_id", "whole", "length")


@query("repaired_messages__HOOKS", "SELECT conv_id, string_agg(upper(role) || ':' || text, '|' ORDER BY turn) AS m FROM conversations GROUP BY 1")
def _repaired(spark, sf_dir):
    rows = views.view(spark, sf_dir, views.MESSAGES).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.struct(s["role"].alias("role"), s["text"].alias("content"))).alias("messages"))
    fixed = hooks.repaired(rows, "messages", lambda m: [(r.upper(), c) for r, c in m])
    return fixed.select("conv_id", F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("m"))
