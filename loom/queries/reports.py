"""Routing, reports and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loom import views
from loom.functions import tags
from loom.functions import text as T
from loom.operators import intervals
from loom.operators import reports as rp
from loom.operators import routing as rt
from loom.operators import vector_index
from loom.operators import vectors as vec
from loom.queries import SQL, query, simple
from loom.sources import files

C = F.col
TRI = "CASE WHEN qa_raw = 'True' THEN true WHEN qa_raw = 'no' THEN false END AS qa, CASE WHEN cot_raw = '1' THEN true WHEN cot_raw = 'false' THEN false END AS cot"


def over(name, operator, sql=None, text="SELECT doc_id, lang, source, text FROM {documents}"):
    simple(name, text, operator, sql)


FLAGS = lambda v: v.withColumn("qa", T.tri_state(C("qa_raw"))).withColumn("cot", T.tri_state(C("cot_raw")))
over("judged_routes__QA11_SNK02", lambda v: FLAGS(v).groupBy(rt.judged_route(C("qa"), C("cot")).alias("route"), "lang").agg(F.count("*").alias("n")), f", f AS (SELECT *, {TRI} FROM v) SELECT CASE WHEN qa AND cot THEN 'sft' WHEN qa AND NOT cot THEN 'rl' ELSE 'discard' END AS route, lang, count(*) AS n FROM f GROUP BY 1, 2", views.JUDGED)
over("policy_routes__QA12", lambda v: v.groupBy(rt.policy_route(C("lang"), C("source"), ["fr"], [("src1", "en"), ("src2", "de")]).alias("route")).agg(F.count("*").alias("n")), " SELECT CASE WHEN lang = 'fr' THEN 'review_type:fr' WHEN source = 'src1' AND lang = 'en' THEN 'review_pair:src1:en' WHEN source = 'src2' AND lang = 'de' THEN 'review_pair:src2:de' ELSE 'sft' END AS route, count(*) AS n FROM v GROUP BY 1")
NODES = "SELECT o_orderkey AS node_id, CASE WHEN o_orderkey > 1 THEN CAST(floor(o_orderkey / 4) AS BIGINT) END AS parent_id, o_totalprice / 1000.0E0 AS outcome_reward, o_orderkey % 4 = 3 AS terminated, o_orderkey % 3 = 0 AS correct FROM {orders}"
over("tree_preferences__QA13", lambda v: rt.preferences(v, 50.0), " SELECT parent_id, max_by(node_id, outcome_reward) AS good, max(outcome_reward) AS good_score, min_by(node_id, outcome_reward) AS bad, min(outcome_reward) AS bad_score FROM v WHERE parent_id IS NOT NULL GROUP BY 1 HAVING max(outcome_reward) - min(outcome_reward) > 50", NODES)
over("tree_paths__QA13", lambda v: rt.path_rewards(v).select("node_id", "correct", F.round("mean_reward", 9).alias("mean_reward"), F.round("min_reward", 7).alias("min_reward")),
    ", w AS (SELECT node_id, correct, node_id AS at FROM v WHERE terminated UNION ALL SELECT w.node_id, w.correct, CAST(w.at // 4 AS BIGINT) FROM w WHERE w.at > 1) SELECT w.node_id, any_value(w.correct) AS correct, round(avg(n.outcome_reward), 9) AS mean_reward, round(min(n.outcome_reward), 7) AS min_reward FROM w JOIN v n ON n.node_id = w.at GROUP BY 1", NODES)
LOOK = "SELECT l_orderkey AS k, l_partkey % 3 AS val FROM {lineitem}"
over("unambiguous_keys__JON01", lambda v: rt.unambiguous(v, "k", "val"), " SELECT k, min(val) AS val FROM v GROUP BY 1 HAVING count(DISTINCT val) = 1", LOOK)
over("index_groups__JON02", lambda v: rt.with_index(v, rt.last_index(v.where("doc_id % 3 = 0").select("source", C("doc_id").alias("idx")), "source", "idx"), "source", "idx").select("doc_id", rt.source_group(C("idx"), 995).alias("g")), ", l AS (SELECT source, max(doc_id) AS idx FROM v WHERE doc_id % 3 = 0 GROUP BY 1) SELECT doc_id, CASE WHEN coalesce(idx, -1) < 995 THEN 'polished' ELSE 'template' END AS g FROM v LEFT JOIN l USING (source)")
over("id_sets__JON03", lambda v: rt.in_first_of(v, "doc_id", {"sft": v.where("doc_id % 2 = 0"), "review": v.where("doc_id % 3 = 0")}, "none").select("doc_id", "found_in"), " SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'sft' WHEN doc_id % 3 = 0 THEN 'review' ELSE 'none' END AS found_in FROM v")
over("unfinished_rows__JON04_SRC13", lambda v: rt.unfinished(v.select(C("doc_id").cast("string").alias("id")), v.where("doc_id % 2 = 0").select(F.concat(C("doc_id").cast("string"), F.lit(":gap")).alias("id")), "id", ":"), " SELECT CAST(doc_id AS STRING) AS id FROM v WHERE doc_id % 2 = 1")
over("predictions_with_defaults__JON05", lambda v: rt.left_with_defaults(v.select("doc_id"), v.where("doc_id % 2 = 0").select("doc_id", C("doc_id").alias("o"), C("lang").alias("pred")), "doc_id", "o", {"pred": ""}).select("doc_id", "pred"), " SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS pred FROM v")
EV = lambda spark, sf_dir: intervals.normalised(views.view(spark, sf_dir, views.EVENTS))
from loom.queries.intervals import EV as EVSQL  # noqa: E402

query("earlier_matches__JON12_MTH04", EVSQL + ", m AS (SELECT a.clip_id, a.i, b.i AS j, greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) AS c, (a.e - a.s) + (b.e - b.s) AS t FROM x a JOIN x b ON a.clip_id = b.clip_id AND b.i < a.i) SELECT clip_id, i, min(j) AS j FROM m WHERE c / (t - c) >= 0.3 GROUP BY 1, 2")(lambda spark, sf_dir: rt.earlier_match(EV(spark, sf_dir), "clip_id", "idx", 0.3).select("clip_id", C("i").cast("long").alias("i"), C("j").cast("long").alias("j")))
query("accepted_segments__JON12")(lambda spark, sf_dir: EV(spark, sf_dir).groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "start_s", "end_s"))), lambda s: F.struct(s["start_s"].alias("start"), s["end_s"].alias("end"))).alias("s")).select("clip_id", F.size(rt.accepted(C("s"), 0.3)).alias("n")))
query("clamped_segments__MTH04", EVSQL + " SELECT event_id, greatest(0, least(s, 43200)) AS a, greatest(0, least(e, 43200)) AS b FROM x WHERE s < 43200")(lambda spark, sf_dir: EV(spark, sf_dir).select("event_id", rt.clamped(C("start_s"), C("end_s"), F.lit(43200.0)).alias("c")).where("c IS NOT NULL").select("event_id", C("c.start").alias("a"), C("c.end").alias("b")))
CH = lambda: F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.when(C("doc_id") % 7 == 0, " ").otherwise("d"))
over("triplet_reasons__FLT08", lambda v: v.groupBy(rt.triplet_reason(F.when(C("doc_id") % 11 > 0, "q").otherwise(" "), CH(), F.when(C("doc_id") % 5 == 0, "z").otherwise("a"), F.concat(F.lit("<think>"), F.when(C("doc_id") % 3 == 0, "<seg>").otherwise(""), F.lit("</think><answer> "), F.when(C("doc_id") % 2 == 0, "a").otherwise("b"), F.lit("</answer>"))).alias("reason")).agg(F.count("*").alias("n")),
    " SELECT CASE WHEN doc_id % 11 = 0 THEN 'bad question' WHEN doc_id % 7 = 0 THEN 'bad choices' WHEN doc_id % 5 = 0 THEN 'answer not in choices' WHEN doc_id % 2 = 1 THEN 'cot answer mismatch' WHEN doc_id % 3 > 0 THEN 'missing seg' ELSE '' END AS reason, count(*) AS n FROM v GROUP BY 1")
MSG = lambda: F.array(F.struct(F.lit("user").alias("role"), F.when(C("doc_id") % 5 > 0, "<audio>q Choose the answer from x").otherwise("q").alias("content")), F.struct(F.when(C("doc_id") % 7 > 0, "assistant").otherwise("bot").alias("role"), F.concat(F.lit("<think>"), F.when(C("doc_id") % 3 > 0, "<seg>1,2</seg>").otherwise(""), F.lit("</think><answer>a</answer>")).alias("content")))
over("record_reasons__FLT09", lambda v: v.groupBy(rt.record_reason(MSG(), F.when(C("doc_id") % 2 == 0, "a").otherwise("b")).alias("reason")).agg(F.count("*").alias("n")), " SELECT CASE WHEN doc_id % 7 = 0 THEN 'bad roles' WHEN doc_id % 5 = 0 THEN 'bad user content' WHEN doc_id % 3 = 0 THEN 'missing seg' WHEN doc_id % 2 = 1 THEN 'answer mismatch' ELSE '' END AS reason, count(*) AS n FROM v GROUP BY 1")
over("invented_segments__FLT10", lambda v: v.select("doc_id", rt.invented(tags.segments(C("response")), F.array(F.struct(F.lit(1.5).alias("start"), F.lit(3.0).alias("end")))).alias("invented")), " SELECT doc_id, doc_id % 3 = 1 AS invented FROM v", views.RESPONSES)
over("length_filter__FLT07", lambda v: v.where(F.size(F.split("text", " ")) <= 100).select("doc_id"), " SELECT doc_id FROM v WHERE len(string_split(text, ' ')) <= 100")
over("quarantine__FLT03_FLT04_FLT02", lambda v: rt.quarantined(v, C("lang") != "fr")[0].agg(F.count("*").alias("good")).join(F.broadcast(rt.quarantined(v, C("lang") != "fr")[1].agg(F.count("*").alias("bad")))), " SELECT count(*) FILTER (lang <> 'fr') AS good, count(*) FILTER (lang = 'fr') AS bad FROM v")
over("convert_skips__FLT02", lambda v: v.groupBy(rt.first_reason([("no_mapping", C("doc_id") % 4 > 0), ("no_audio", C("doc_id") % 3 > 0), ("no_events", C("lang") != "de")]).alias("reason")).agg(F.count("*").alias("n")), " SELECT CASE WHEN doc_id % 4 = 0 THEN 'no_mapping' WHEN doc_id % 3 = 0 THEN 'no_audio' WHEN lang = 'de' THEN 'no_events' ELSE '' END AS reason, count(*) AS n FROM v GROUP BY 1")

over("composite_counts__AGG01", lambda v: rp.composite_counts(v, "source", "lang"), " SELECT source || '/' || lang AS key, count(*) AS n FROM v GROUP BY 1")
over("rate_tables__AGG03_AGG31", lambda v: rp.rates(v, ["lang", "source"], {"even": C("doc_id") % 2 == 0, "third": F.when(C("doc_id") % 5 > 0, C("doc_id") % 3 == 0)}).select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "n_even", "rate_even", "n_third", "rate_third"),
    " SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_even, round(avg(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END), 6) AS rate_even, CAST(sum(CASE WHEN doc_id % 5 > 0 AND doc_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_third, round(avg(CASE WHEN doc_id % 5 > 0 AND doc_id % 3 = 0 THEN 1 ELSE 0 END), 6) AS rate_third FROM v GROUP BY GROUPING SETS ((), (lang), (source))")
ORD = "SELECT o_orderkey AS id, o_custkey AS uid, o_totalprice AS price, o_orderstatus AS st FROM {orders}"
over("described__AGG04", lambda v: rp.described(v, "price").select(*[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")], "size"), " SELECT round(avg(price), 4) AS mean, round(stddev_pop(price), 4) AS std, round(min(price), 4) AS min, round(max(price), 4) AS max, count(price) AS size FROM v", ORD)
over("upper_medians__AGG05", lambda v: rp.upper_median(v, ["uid"], "price"), ", k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY price) AS k, count(*) OVER (PARTITION BY uid) AS n FROM v) SELECT uid, price AS median FROM k WHERE k = n // 2 + 1", ORD)
over("size_histogram__AGG02", lambda v: rp.histogram(v.groupBy("uid").agg(F.count("*").alias("c")), C("c")), " SELECT c AS value, count(*) AS n FROM (SELECT uid, count(*) AS c FROM v GROUP BY 1) GROUP BY 1", ORD)
MET = "SELECT concat(CASE o_orderkey % 3 WHEN 0 THEN 'max_' WHEN 1 THEN 'min_' ELSE '' END, o_orderstatus) AS name, o_totalprice AS value FROM {orders}"
over("metrics_by_name__AGG20", lambda v: rp.reduced_by_name(v).select("name", F.round("value", 3).alias("value")), " SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 3) AS value FROM v GROUP BY name", MET)
over("majority_votes__AGG22", lambda v: rp.voted(v, ["uid"], "st", "price", "id"), ", c AS (SELECT uid, st, count(*) AS n, min(id) AS f, arg_min(price, id) AS value FROM v GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, f) AS k FROM c) SELECT uid, st AS vote, value FROM k WHERE k = 1", ORD)
over("validation_metrics__AGG21", lambda v: rp.validation(v, "st", "uid", "price").select("st", *[F.round(c, 3).alias(c) for c in ("mean", "std", "best", "worst")]), ", p AS (SELECT st, uid, avg(price) AS m, CASE WHEN count(*) > 1 THEN stddev_pop(price) END AS s, max(price) AS b, min(price) AS w FROM v GROUP BY 1, 2) SELECT st, round(avg(m), 3) AS mean, round(avg(s), 3) AS std, round(avg(b), 3) AS best, round(avg(w), 3) AS worst FROM p GROUP BY 1", ORD)
over("validation_table__AGG21", lambda v: rp.validation_table(v.withColumn("pred", C("id") % 3), "st", "uid", "id", ["price"], "pred", times=20).select("source", "metric", F.round("value", 3).alias("value")),
    """, g AS (SELECT st, uid, list({'x': CAST(price AS DOUBLE), 'p': id % 3} ORDER BY id) AS d, count(*) AS n FROM v GROUP BY ALL), s AS (SELECT DISTINCT n, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512], lambda k: k < n), n)) AS m FROM g WHERE n > 1),
w AS (SELECT n, m, list_transform(range(m), lambda i: CAST('0x' || substr(md5('42_' || m || '_' || b || '_' || i), 1, 8) AS BIGINT) % n) AS i FROM s, range(20) t(b)), k AS (SELECT st, uid, m, list_transform(i, lambda j: d[j + 1]) AS d FROM g JOIN w USING (n)),
e AS (SELECT st, uid, m, d, list_transform(d, lambda r: r.x) AS x, list_transform(d, lambda r: len(list_filter(d, lambda q: q.p = r.p))) AS c FROM k), f AS (SELECT st, uid, m, list_max(x) AS best, list_min(x) AS worst, x[list_position(c, list_max(c))] AS maj FROM e),
p AS (SELECT st, uid, m, avg(best) AS bm, stddev_pop(best) AS bs, avg(worst) AS wm, stddev_pop(worst) AS ws, avg(maj) AS mm, stddev_pop(maj) AS ms FROM f GROUP BY ALL),
u AS (SELECT st, 'mean@' || n AS metric, list_avg(list_transform(d, lambda r: r.x)) AS value FROM g UNION ALL SELECT st, 'std@' || n, list_stddev_pop(list_transform(d, lambda r: r.x)) FROM g WHERE n > 1 UNION ALL SELECT st, 'best@' || m || '/mean', bm FROM p UNION ALL SELECT st, 'best@' || m || '/std', bs FROM p
  UNION ALL SELECT st, 'worst@' || m || '/mean', wm FROM p UNION ALL SELECT st, 'worst@' || m || '/std', ws FROM p UNION ALL SELECT st, 'maj@' || m || '/mean', mm FROM p UNION ALL SELECT st, 'maj@' || m || '/std', ms FROM p) SELECT st AS source, metric, round(avg(value), 3) AS value FROM u GROUP BY ALL""", ORD)  # fmt: skip
over("list_means__AGG23", lambda v: rp.list_means(v, "st", F.array(C("price") / 1000, C("price") / 500)).select("st", F.round("score", 6).alias("score")), " SELECT st, round(avg((price / 1000 + price / 500) / 2), 6) AS score FROM v GROUP BY 1", ORD)
over("batch_metrics__AGG18", lambda v: rp.batch_metrics(v.select(C("reward").alias("score"), (C("reward") * 0.9).alias("value"), C("reward").alias("ret"), "length"), 50).select(*[F.round(c, 5).alias(c) for c in ("score_mean", "score_max", "value_min", "length_mean", "clip_ratio", "explained_variance")]),
    " SELECT round(avg(reward), 5) AS score_mean, round(max(reward), 5) AS score_max, round(min(reward * 0.9), 5) AS value_min, round(avg(length), 5) AS length_mean, round(avg(CASE WHEN length >= 50 THEN 1 ELSE 0 END), 5) AS clip_ratio, round(1 - var_pop(reward - reward * 0.9) / (var_pop(reward) + 1e-5), 5) AS explained_variance FROM v", views.ROLLOUTS)
over("throughput__AGG19", lambda v: rp.throughput(v, "length", 12.5, 4).select("tokens", F.round("tokens_per_second", 6).alias("tokens_per_second"), F.round("ms_per_token", 9).alias("ms_per_token")), " SELECT CAST(sum(length) AS BIGINT) AS tokens, round(sum(length) / 12.5 / 4, 6) AS tokens_per_second, round(12500 / sum(length), 9) AS ms_per_token FROM v", views.ROLLOUTS)
over("component_means__AGG24", lambda v: v.groupBy("st").agg(F.round(F.avg("price"), 3).alias("mean"), F.round(F.avg(F.when(C("price") > 150000, C("price"))), 3).alias("mean_high"), F.round(F.avg((C("price") > 150000).cast("int")), 6).alias("rate_high")), " SELECT st, round(avg(price), 3) AS mean, round(avg(price) FILTER (price > 150000), 3) AS mean_high, round(avg(CASE WHEN price > 150000 THEN 1 ELSE 0 END), 6) AS rate_high FROM v GROUP BY 1", ORD)
over("mix_report__AGG33", lambda v: rp.shares(v, "source"), " SELECT source, count(*) AS n, round(count(*) / (SELECT count(*) FROM v), 4) AS ratio FROM v GROUP BY 1")
over("report_object__SNK03", lambda v: rp.report(v.agg(F.count("*").alias("rows"), F.count_distinct("lang").alias("langs"))), """ SELECT '{"rows":' || count(*) || ',"langs":' || count(DISTINCT lang) || '}' AS report FROM v""")
ACC = "SELECT seq, pos, token AS pred, CASE WHEN mask = 0 THEN -100 ELSE token % 2 END AS label FROM (" + views.TOKENS + ") z"
over("token_accuracy__AGG29", lambda v: rp.token_accuracy(v).select(F.round("token_accuracy", 6).alias("token_accuracy"), F.round("sequence_accuracy", 6).alias("sequence_accuracy")), ", h AS (SELECT *, lag(pred) OVER (PARTITION BY seq ORDER BY pos) AS said FROM v), k AS (SELECT * FROM h WHERE said IS NOT NULL AND label <> -100), p AS (SELECT seq, avg(CASE WHEN said = label THEN 1 ELSE 0 END) AS a FROM k GROUP BY 1) SELECT round((SELECT avg(CASE WHEN said = label THEN 1 ELSE 0 END) FROM k), 6) AS token_accuracy, round(avg(CASE WHEN a = 1 THEN 1 ELSE 0 END), 6) AS sequence_accuracy FROM p", ACC)
over("channel_losses__AGG28", lambda v: rp.channel_means(v, "token", "p", "mask").select("token", F.round("loss", 8).alias("loss")), " SELECT token, round(sum(p * mask) / (sum(mask) + 1e-12), 8) AS loss FROM v GROUP BY 1", views.TOKENS)

VEC = "SELECT vec_id, embedding, label FROM {embeddings}"
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
PAIR = f""", r AS (SELECT a.embedding AS a, b.embedding AS b, a.label % 2 AS y FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0),
s AS (SELECT CAST(y AS DOUBLE) AS y, {DOT.format('a', 'b')} / (sqrt({DOT.format('a', 'a')}) * sqrt({DOT.format('b', 'b')})) AS c, -list_sum(list_transform(list_zip(a, b), lambda z: abs(CAST(z[1] AS DOUBLE) - z[2]))) AS m, -sqrt(list_sum(list_transform(list_zip(a, b), lambda z: pow(CAST(z[1] AS DOUBLE) - z[2], 2)))) AS e, {DOT.format('a', 'b')} AS d FROM r)"""
PAIRED = lambda v: vec.paired(v.withColumn("label", C("label") % 2), "vec_id", "embedding", "label")
over("paired_metrics__AGG26", lambda v: vec.paired_metrics(PAIRED(v)).select(*[F.round(f"{a}_{b}", 6).alias(f"{a}_{b}") for a in ("pearson", "spearman") for b in ("cosine", "manhattan", "euclidean", "dot_product")]),
    PAIR + ", k AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry, rank() OVER (ORDER BY c) AS rc, rank() OVER (ORDER BY m) AS rm, rank() OVER (ORDER BY e) AS re, rank() OVER (ORDER BY d) AS rd FROM s) SELECT round(corr(y, c), 6) AS pearson_cosine, round(corr(y, m), 6) AS pearson_euclidean, round(corr(y, e), 6) AS pearson_manhattan, round(corr(y, d), 6) AS pearson_dot_product, round(corr(ry, rc), 6) AS spearman_cosine, round(corr(ry, rm), 6) AS spearman_manhattan, round(corr(ry, re), 6) AS spearman_euclidean, round(corr(ry, rd), 6) AS spearman_dot_product FROM k", VEC)
over("pair_losses__MTH07", lambda v: vec.pair_losses(PAIRED(v)).select(*[F.round(c, 6).alias(c) for c in ("cosine", "contrastive", "online")]),
    PAIR + ", x AS (SELECT y, 1 - c AS d FROM s), b AS (SELECT max(d) FILTER (y = 1) AS pm, min(d) FILTER (y = 0) AS nm FROM x) SELECT round(avg(pow(1 - d - y, 2)), 6) AS cosine, round(avg(0.5 * (y * d * d + (1 - y) * pow(greatest(0.5 - d, 0), 2))), 6) AS contrastive, round(sum(CASE WHEN y = 1 AND d > nm THEN d * d WHEN y = 0 AND d < pm THEN pow(greatest(0.5 - d, 0), 2) ELSE 0 END), 6) AS online FROM x, b", VEC)
over("group_margins__AGG27", lambda v: vec.group_margins(v.withColumn("g", F.floor(C("vec_id") / 5)), "g", "vec_id", "embedding").select(*[F.round(c, 6).alias(c) for c in ("mean_pos", "mean_neg", "margin")]),
    f", a AS (SELECT x.vec_id // 5 AS g, y.vec_id % 5 AS k, {DOT.format('x.embedding', 'y.embedding')} AS s FROM v x JOIN v y ON x.vec_id % 5 = 0 AND y.vec_id // 5 = x.vec_id // 5 AND y.vec_id % 5 > 0), m AS (SELECT g, max(s) FILTER (k = 1) AS p, max(s) FILTER (k > 1) AS n FROM a GROUP BY 1) SELECT round(avg(s) FILTER (k = 1), 6) AS mean_pos, round(avg(s) FILTER (k > 1), 6) AS mean_neg, round((SELECT avg(p - n) FROM m), 6) AS margin FROM a", VEC)
over("nearest_vectors__JON14", lambda v: vec.nearest_by_product(v.where("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("q")), v.select(C("vec_id").alias("doc_id"), C("embedding").alias("d")), 5).select("query_id", "doc_id", "rank"),
    f", s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({DOT.format('q.embedding', 'd.embedding')}, 6) AS s FROM v q JOIN v d ON q.vec_id % 50 = 0) SELECT query_id, doc_id, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS k FROM s) WHERE k <= 5", VEC)

def _indexed(spark, sf_dir):
    v = views.view(spark, sf_dir, VEC)
    index = vector_index.InvertedFile.build(v.select(C("vec_id").alias("doc_id"), C("embedding").alias("d")), files.scratch(spark, "vectors"))
    return v, index, v.where("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("q"))


@query("indexed_neighbours__JON14", SQL["nearest_vectors__JON14"])
def _neighbours(spark, sf_dir):
    """The same through the inverted file, where its bound makes it exact."""
    _, index, queries = _indexed(spark, sf_dir)
    return index.search(queries, 5, exact=True).select("query_id", "doc_id", "rank")


@query("index_recall__JON14", "SELECT vec_id AS query_id, 5 AS k, true AS recalled FROM embeddings WHERE vec_id % 50 = 0")
def _recall(spark, sf_dir):
    """How many a query finds without that, and whether all find nine in ten of those of a scan."""
    v, index, queries = _indexed(spark, sf_dir)
    found = files.written(index.search(queries, 5).select("query_id", "doc_id"), "found")
    scan = vec.nearest_by_product(queries, v.select(C("vec_id").alias("doc_id"), C("embedding").alias("d")), 5).select("query_id", "doc_id")
    share = found.join(scan, ["query_id", "doc_id"]).agg(F.count("*").alias("hit")).join(scan.agg(F.count("*").alias("all"))).select((C("hit") >= 0.9 * C("all")).alias("recalled"))
    return found.groupBy("query_id").agg(F.count("*").cast("int").alias("k")).join(F.broadcast(share))


@query("bm25_search__JON14", r"""WITH b AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d),
t AS (SELECT doc_id, len, w, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS w FROM d) GROUP BY 1, 2, 3), f AS (SELECT w, count(*) AS df FROM t GROUP BY 1), q AS (SELECT query_id, unnest(w) AS w FROM b),
s AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len / m))), 9) AS s FROM q JOIN t USING (w) JOIN f USING (w), st GROUP BY 1, 2) SELECT query_id, doc_id, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS k FROM s) WHERE k <= 3""")
def _bm25(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words")
    return vec.bm25(views.read(spark, sf_dir, "benchmark").select(C("item_id").alias("query_id"), words), views.read(spark, sf_dir, "documents").select("doc_id", words), 3).select("query_id", "doc_id", "rank")
