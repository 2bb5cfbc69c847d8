"""Advantages, losses and grouped statistics; sequences are orders, tokens their lines, groups customers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from loom import views
from loom.operators import rl as op
from loom.queries import simple

R10 = lambda c: (F.round(c, 10) + 0.0)


def over(name, operator, sql=None, text=views.ROLLOUTS):
    simple(name, text, operator, sql)


def tok(name, operator, sql=None):
    over(name, operator, sql, views.TOKENS)


over("grpo_three_variants__WIN02", lambda v: v.select("rid", R10(op.group_normalised(v, "uid", "reward")).alias("sample"), R10(op.group_normalised(v, "uid", "reward", "population")).alias("population"), R10(op.group_normalised(v, "uid", "reward", "wide")).alias("wide"), R10(op.group_normalised(v, "uid", "reward", by_std=False)).alias("centred")),
    """, w AS (SELECT *, avg(reward) OVER g AS m, stddev_samp(reward) OVER g AS s, stddev_pop(reward) OVER g AS p, count(*) OVER g AS n FROM v WINDOW g AS (PARTITION BY uid))
    SELECT rid, round(CASE WHEN n = 1 THEN reward / (1 + 1e-6) ELSE (reward - m) / (s + 1e-6) END, 10) + 0.0 AS sample, round((reward - m) / greatest(p, 1e-6), 10) + 0.0 AS population, round((reward - m) / (s + 1e-4), 10) + 0.0 AS wide, round(CASE WHEN n = 1 THEN reward ELSE reward - m END, 10) + 0.0 AS centred FROM w""")  # fmt: skip
MANY = views.ROLLOUTS + " WHERE o_custkey IN (SELECT o_custkey FROM {orders} GROUP BY o_custkey HAVING count(*) > 1)"
over("pass_at_k_advantage__WIN03", lambda v: v.select("rid", R10(op.best_only(v, "uid", "reward", "rid")).alias("adv")),
    ", w AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY reward DESC, rid) AS k, lead(reward) OVER (PARTITION BY uid ORDER BY reward DESC, rid) AS n2, stddev_samp(reward) OVER (PARTITION BY uid) AS s FROM v) SELECT rid, CASE WHEN k = 1 THEN round((reward - n2) / (s + 1e-6), 10) + 0.0 ELSE 0.0 END AS adv FROM w", MANY)
over("leave_one_out_advantage__WIN04", lambda v: v.select("rid", R10(op.leave_one_out("uid", "reward")).alias("adv")), ", w AS (SELECT *, avg(reward) OVER (PARTITION BY uid) AS m, count(*) OVER (PARTITION BY uid) AS n FROM v) SELECT rid, round(CASE WHEN n = 1 THEN reward ELSE reward * n / (n - 1) - m * n / (n - 1) END, 10) + 0.0 AS adv FROM w")
over("length_baseline_advantage__WIN05", lambda v: v.select("rid", (F.round(op.length_baseline("uid", "reward", "length"), 7) + 0.0).alias("adv")), ", w AS (SELECT *, sum(length * reward) OVER (PARTITION BY uid) / sum(length) OVER (PARTITION BY uid) AS b, count(*) OVER (PARTITION BY uid) AS n FROM v) SELECT rid, round(CASE WHEN n = 1 THEN reward ELSE reward - b END, 7) + 0.0 AS adv FROM w")
CENTRED = lambda v: op.whitened(v.withColumn("mask", F.lit(1)).withColumn("c", F.col("reward") - F.avg("reward").over(W.Window.partitionBy("uid"))), "c", "mask", "adv")
over("group_centred_whitened__WIN06_AGG16", lambda v: CENTRED(v).select("rid", (F.round("adv", 6) + 0.0).alias("adv")), ", c AS (SELECT rid, reward - avg(reward) OVER (PARTITION BY uid) AS c FROM v) SELECT rid, round((c - (SELECT avg(c) FROM c)) / sqrt((SELECT var_samp(c) FROM c) + 1e-8), 6) + 0.0 AS adv FROM c")
tok("masked_statistics__AGG16", lambda v: op.whitened(v, "q", "mask", "w").agg(F.round(op.masked_mean(F.col("q"), F.col("mask")), 6).alias("mean"), F.round(F.sum(F.col("q") * F.col("mask")), 2).alias("total"), F.round(F.max("w"), 6).alias("top")),
    ", s AS (SELECT sum(q * mask) / (sum(mask) + 1e-8) AS m, sum(mask) AS n, sum(q * mask) AS t FROM v), z AS (SELECT sum((q - m) * (q - m) * mask) / (n + 1e-8) * n / (n - 1) AS va FROM v, s GROUP BY n) SELECT round(any_value(m), 6) AS mean, round(any_value(t), 2) AS total, round(max((q - m) / sqrt(va + 1e-8)), 6) AS top FROM v, s, z")
G1 = "CAST(pow(0.5, pos) AS DOUBLE)"
tok("generalised_advantage__WIN09", lambda v: op.generalised_advantage(v, 0.5, 1.0).select("seq", "pos", (F.round("adv", 13) + 0.0).alias("adv"), (F.round("ret", 13) + 0.0).alias("ret")),
    f""", d AS (SELECT *, r + 0.5 * coalesce(lead(v) OVER (PARTITION BY seq ORDER BY pos), 0) - v AS d FROM v), a AS (SELECT *, sum(d * {G1}) OVER (PARTITION BY seq ORDER BY pos DESC) / {G1} AS a FROM d) SELECT seq, pos, round(a, 13) + 0.0 AS adv, round(a + v, 13) + 0.0 AS ret FROM a""")
tok("discounted_returns__WIN07", lambda v: op.discounted_returns(v, 0.9).select("seq", "pos", R10(F.col("ret")).alias("ret")), ", k AS (SELECT *, sum(1 - mask) OVER (PARTITION BY seq ORDER BY pos) AS k FROM v) SELECT seq, pos, round(sum(r * pow(0.9, pos)) OVER (PARTITION BY seq, k ORDER BY pos DESC) / pow(0.9, pos), 10) + 0.0 AS ret FROM k")
tok("reward_to_go__WIN08", lambda v: op.reward_to_go(v, F.lit(0.05)).select("seq", "pos", R10(F.col("ret")).alias("ret"), R10(F.col("adv")).alias("adv")), ", k AS (SELECT *, sum(r * mask) OVER (PARTITION BY seq ORDER BY pos DESC) AS t FROM v) SELECT seq, pos, round(t, 10) + 0.0 AS ret, round(t - 0.05 * mask, 10) + 0.0 AS adv FROM k")
tok("kl_penalties__WIN10", lambda v: v.select("seq", "pos", *[R10(op.kl(F.col("v"), F.col("r"), k)).alias(k) for k in ("k1", "abs", "k2", "k3")], R10(F.col("q") - 0.1 * op.kl(F.col("v"), F.col("r"), "k1") * F.col("mask")).alias("shaped")),
    " SELECT seq, pos, round(v - r, 10) + 0.0 AS k1, round(abs(v - r), 10) AS abs, round(0.5 * (v - r) * (v - r), 10) AS k2, round(least(10, greatest(-10, exp(r - v) - (r - v) - 1)), 10) + 0.0 AS k3, round(q - 0.1 * (v - r) * mask, 10) + 0.0 AS shaped FROM v")
STEPS = "SELECT o_custkey AS uid, o_orderkey AS step, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS kl, CAST(o_orderkey % 3 + 1 AS DOUBLE) AS n FROM {orders}"
over("adaptive_coefficient__WIN11", lambda v: v.groupBy("uid").agg(R10(op.controller(0.3, 100)(F.transform(F.array_sort(F.collect_list(F.struct("step", "kl", "n"))), lambda s: F.struct(s["kl"].alias("kl"), s["n"].alias("n"))))).alias("coef")),
    " SELECT uid, round(0.1 * product(1 + least(greatest(kl / 0.3 - 1, -0.2), 0.2) * n / 100), 10) AS coef FROM v GROUP BY 1", STEPS)
tok("response_masks__WIN12_WIN13", lambda v: v.withColumn("mask", op.until_end(v, 2)).withColumn("pid", op.positions(v)).select("seq", "pos", F.col("mask").cast("long").alias("m"), F.col("pid").cast("long").alias("pid")),
    ", m AS (SELECT *, CASE WHEN sum(CASE WHEN token = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY pos) - CASE WHEN token = 2 THEN 1 ELSE 0 END = 0 THEN 1 ELSE 0 END AS m FROM v) SELECT seq, pos, CAST(m AS BIGINT) AS m, CAST(CASE WHEN m = 1 THEN sum(m) OVER (PARTITION BY seq ORDER BY pos) - 1 ELSE 0 END AS BIGINT) AS pid FROM m")
tok("policy_loss__WIN15", lambda v: op.policy_loss(v.select("mask", F.col("v").alias("old"), (F.col("r") * 9).alias("logp"), (F.col("p") - 0.3).alias("adv"))).select(*[F.round(c, 6).alias(c) for c in ("loss", "clipped", "kl", "clipped_low")]),
    """, a AS (SELECT mask, exp(r * 9 - v) AS ra, p - 0.3 AS adv, v - r * 9 AS k FROM v), b AS (SELECT *, -adv * ra AS o, -adv * least(greatest(ra, 0.8), 1.2) AS t, -adv * 3.0 AS h FROM a), c AS (SELECT *, greatest(o, t) AS g, (SELECT sum(mask) + 1e-8 FROM v) AS n FROM b)
    SELECT round(sum(CASE WHEN adv < 0 THEN least(h, g) ELSE g END * mask) / any_value(n), 6) AS loss, round(sum(CASE WHEN t > o THEN mask ELSE 0 END) / any_value(n), 6) AS clipped, round(sum(k * mask) / any_value(n), 6) AS kl, round(sum(CASE WHEN g > h AND adv < 0 THEN mask ELSE 0 END) / any_value(n), 6) AS clipped_low FROM c""")  # fmt: skip
tok("value_loss__WIN15_MTH06", lambda v: op.value_loss(v.select("mask", F.col("p").alias("pred"), F.col("v").alias("old_value"), F.col("r").alias("ret")), 0.2).select(F.round("loss", 6).alias("loss"), F.round("clipped", 6).alias("clipped")),
    ", a AS (SELECT mask, pow(p - r, 2) AS a, pow(least(greatest(p, v - 0.2), v + 0.2) - r, 2) AS b FROM v) SELECT round(sum(greatest(a, b) * mask) / (sum(mask) + 1e-8), 6) AS loss, round(sum(CASE WHEN b > a THEN mask ELSE 0 END) / (sum(mask) + 1e-8), 6) AS clipped FROM a")
tok("entropy__WIN15_MTH06", lambda v: v.select("seq", "pos", R10(op.entropy(F.array("q", "v", "p"))).alias("h")), ", a AS (SELECT *, greatest(q, v, p) AS m FROM v), b AS (SELECT *, exp(q - m) + exp(v - m) + exp(p - m) AS s, exp(q - m) * q + exp(v - m) * v + exp(p - m) * p AS t FROM a) SELECT seq, pos, round(m + ln(s) - t / s, 10) + 0.0 AS h FROM b")
tok("loss_aggregates__AGG17", lambda v: op.losses(v, F.col("p"), 12).select(*[F.round(c, 6).alias(c) for c in ("token_mean", "seq_mean_token_sum", "seq_mean_token_mean", "seq_mean_token_sum_norm")]),
    ", s AS (SELECT seq, sum(p * mask) AS s, sum(mask) AS n FROM v GROUP BY 1) SELECT round(sum(s) / (sum(n) + 1e-8), 6) AS token_mean, round(avg(s), 6) AS seq_mean_token_sum, round(avg(s / nullif(n, 0)), 6) AS seq_mean_token_mean, round(sum(s) / 12, 6) AS seq_mean_token_sum_norm FROM s")
SERIES = "SELECT l_orderkey AS seq, pos, q FROM (" + views.TOKENS.replace("AS seq", "AS l_orderkey") + ") z"
over("smoothed_series__WIN16", lambda v: op.smoothed(v, ["seq"], ["pos"], "q", 0.9).select("seq", "pos", F.round("smooth", 6).alias("s")), " SELECT seq, pos, round(sum(q * pow(0.9, -pos)) OVER (PARTITION BY seq ORDER BY pos) * pow(0.9, pos) * 0.1 / (1 - pow(0.9, pos + 1)), 6) AS s FROM v", views.TOKENS)
PAIRS = "SELECT o_orderkey AS rid, o_custkey AS uid, CAST(o_orderkey % 4 AS DOUBLE) AS score, CAST(floor(o_orderkey / 2) AS BIGINT) AS pair FROM {orders}"
over("pair_preferences__WIN17_WIN18", lambda v: v.select("rid", op.preferred("pair", "score", "rid").alias("chosen"), op.bucket(F.col("rid"), 8).alias("bucket")), " SELECT rid, row_number() OVER (PARTITION BY pair ORDER BY score DESC, rid) = 1 AS chosen, CAST(floor(rid / 8) AS BIGINT) AS bucket FROM v", PAIRS)
ACC = "SELECT o_custkey AS uid, o_orderkey AS rid, o_totalprice AS score, CAST(o_orderkey % 3 AS DOUBLE) / 2 AS acc FROM {orders}"
over("preference_accuracy__JON15", lambda v: op.preference_accuracy(v, "uid", "rid", "score", "acc").select("uid", R10(F.col("accuracy")).alias("accuracy")),
    " SELECT a.uid, round(CASE WHEN sum(abs(a.acc - b.acc)) = 0 THEN 0.5 ELSE sum(CASE WHEN (a.score > b.score) = (a.acc > b.acc) THEN abs(a.acc - b.acc) ELSE 0 END) / sum(abs(a.acc - b.acc)) END, 10) AS accuracy FROM v a JOIN v b ON a.uid = b.uid AND a.rid < b.rid GROUP BY 1", ACC)
FLAT = "SELECT o_custkey AS uid, o_orderkey AS rid, CASE WHEN o_custkey % 3 = 0 THEN 1.0E0 ELSE CAST(o_orderkey % 5 AS DOUBLE) END AS reward FROM {orders}"
over("varied_groups__FLT16", lambda v: op.varied(v, "uid", "reward").select("rid"), " SELECT rid FROM (SELECT *, stddev_pop(reward) OVER (PARTITION BY uid) AS s, count(*) OVER (PARTITION BY uid) AS n FROM v) WHERE s > 0 OR n = 1", FLAT)
over("varied_groups_strict__FLT16", lambda v: op.varied(v, "uid", "reward", strict=True).select("rid"), " SELECT rid FROM (SELECT *, stddev_samp(reward) OVER (PARTITION BY uid) AS s FROM v) WHERE s > 0", FLAT)
SCORED = "SELECT o_custkey AS uid, o_orderkey AS rid, o_totalprice / 1000.0E0 AS prm, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS orm FROM {orders}"
over("best_and_worst__SRT06", lambda v: op.best_and_worst(v, "uid", "rid", "prm", "orm").select("rid", "kind"),
    """, w AS (SELECT *, min(prm) OVER g AS lo, max(prm) OVER g AS hi, avg(orm) OVER g AS e FROM v WINDOW g AS (PARTITION BY uid)), s AS (SELECT *, CASE WHEN hi = lo THEN CASE WHEN lo > 0 THEN least(1, lo) ELSE 0 END ELSE (prm - lo) / (hi - lo + 1e-5) END + 10 * orm AS sc FROM w WHERE e < 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY sc DESC, rid) AS b, row_number() OVER (PARTITION BY uid ORDER BY sc, rid DESC) AS x FROM s) SELECT rid, CASE WHEN b <= 1 AND orm > 0 THEN 'best' ELSE 'worst' END AS kind FROM k WHERE (b <= 1 AND orm > 0) OR x = 1""", SCORED)  # fmt: skip
NODES = "SELECT ps AS node, CAST(ps % 50 AS DOUBLE) AS value, ps % 7 AS visits, ps % 7 + 20 AS parents FROM (SELECT p_partkey AS ps FROM {part}) z"
over("uct_scores__MTH08", lambda v: v.select("node", R10(F.coalesce(F.nullif(op.uct(F.col("value"), F.col("visits"), F.col("parents")), F.lit(float("inf"))), F.lit(-1.0))).alias("u")), " SELECT node, CASE WHEN visits = 0 THEN -1.0 ELSE round(value / visits + 1.4 * sqrt(ln(parents) / visits), 10) END AS u FROM v", NODES)
over("weighted_rewards__AGG25", lambda v: v.select("rid", R10(F.coalesce(F.nullif(F.col("prm") * 0.5, F.lit(0.0)), F.lit(0.0)) + F.coalesce(F.when(F.col("rid") % 4 > 0, F.col("orm") * 2), F.lit(0.0))).alias("total")).agg(F.round(F.sum("total"), 3).alias("total"), F.round(F.avg("total"), 6).alias("mean"), F.round(F.stddev_samp("total"), 6).alias("std")),
    ", t AS (SELECT prm * 0.5 + CASE WHEN rid % 4 > 0 THEN orm * 2 ELSE 0 END AS total FROM v) SELECT round(sum(total), 3) AS total, round(avg(total), 6) AS mean, round(stddev_samp(total), 6) AS std FROM t", SCORED)
