"""Batches, samples and splits over customers, orders, lines and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loom import views
from loom.operators import batch as op
from loom.operators import sampling as smp
from loom.queries import query, simple

CUST = "SELECT c_custkey AS id, c_mktsegment AS seg, c_nationkey AS nation, c_acctbal AS bal FROM {customer}"
IDX = ", i AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS row_idx FROM v)"


def over(name, operator, sql=None, text=CUST):
    simple(name, text, operator, sql)


def md5(seed, key="id"):
    return f"md5('{seed}_' || {key})"


over("row_places__SET05", lambda v: op.indexed(v, "id").select("id", "row_idx"), IDX + " SELECT id, row_idx FROM i")
over("slices__SET05_SRT03_SRT08", lambda v: op.sliced(op.indexed(v, "id"), 100, 1200, 7).select("id"), IDX + " SELECT id FROM i WHERE row_idx BETWEEN 100 AND 1199 AND (row_idx - 100) % 7 = 0")
over("chunks__SET06", lambda v: op.chunked(op.indexed(v, "id"), 7, pad=True).groupBy("chunk").agg(F.count("*").alias("n"), F.min("id").alias("first")), IDX + ", n AS (SELECT count(*) AS n FROM v) SELECT CAST(floor(row_idx / ceil(n / 7)) AS BIGINT) AS chunk, count(*) AS n, min(id) AS first FROM i, n GROUP BY 1")
over("repeats__SET07", lambda v: op.repeated(op.indexed(v, "id"), 2).select("id", F.col("place").alias("a")).join(op.repeated(op.indexed(v, "id"), 2, interleave=False).groupBy("id").agg(F.max("place").alias("b")), "id"), IDX + " SELECT id, row_idx * 2 + r AS a, row_idx + (SELECT count(*) FROM v) AS b FROM i, range(2) t(r)")
over("repeats_by_row__SET08", lambda v: op.repeated_by(v.withColumn("n", F.col("nation") % 4), "n").groupBy("id").agg(F.count("*").alias("n")), " SELECT id, CAST(nation % 4 AS BIGINT) AS n FROM v WHERE nation % 4 > 0")
ARR = "SELECT l_orderkey AS id, l_linenumber AS k, CAST(l_quantity AS INT) AS q FROM {lineitem}"
over("unfolded_columns__SET09", lambda v: op.unfolded(v.select("id", F.array("id", "nation", F.lit(1), F.lit(2)).alias("x")), "x", 2).select("id", F.col("part").cast("long").alias("part"), F.col("x")[0].cast("long").alias("a"), F.col("x")[1].cast("long").alias("b")), " SELECT id, CAST(p AS BIGINT) AS part, CASE WHEN p = 0 THEN id ELSE 1 END AS a, CAST(CASE WHEN p = 0 THEN nation ELSE 2 END AS BIGINT) AS b FROM v, range(2) t(p)")
over("folded_batches__SET10_SET19", lambda v: op.folded(op.indexed(v, "id"), 4, "id").select("fold", F.array_join(F.col("id").cast("array<string>"), ",").alias("ids")), IDX + " SELECT CAST(floor(row_idx / 4) AS BIGINT) AS fold, string_agg(id, ',' ORDER BY id) AS ids FROM i GROUP BY 1")
over("padded_batches__SET11", lambda v: op.padded(op.indexed(v, "id"), 64).select("id", "row_idx", "is_pad"), IDX + ", n AS (SELECT count(*) AS n FROM v) SELECT id, row_idx, false AS is_pad FROM i UNION ALL SELECT id, row_idx + n, true FROM i, n WHERE row_idx < (64 - n % 64) % 64")
over("unpadded_batches__SET11", lambda v: op.unpadded(op.padded(op.indexed(v, "id"), 64)).agg(F.count("*").alias("n")), " SELECT count(*) AS n FROM v")
over("united_batches__SET03_JON13_JON06", lambda v: op.united(op.indexed(v, "id").select("row_idx", "id", "seg"), op.indexed(v, "id").select("row_idx", "id", "bal")).select("id", "seg", "bal"), " SELECT id, seg, bal FROM v")
over("reordered_batches__SRT09", lambda v: op.reordered(op.indexed(v, "id"), op.inverse(op.shuffled(v, "id", 3, "place").join(op.indexed(v, "id"), [c for c in ("id",)]).select("place", "row_idx"))).select("id", "place"), IDX + f", p AS (SELECT id, row_idx, row_number() OVER (ORDER BY {md5(3)}, id) - 1 AS place FROM i) SELECT a.id, b.row_idx AS place FROM i a JOIN p b ON a.row_idx = b.place")
over("rank_shards__SRT04_SET20", lambda v: op.indexed(v, "id").select("id", op.shard(F.col("row_idx"), 1500, 7).alias("spread"), op.shard(F.col("row_idx"), 1500, 7, drop_rest=True).alias("even")), IDX + " SELECT id, (SELECT max(r) FROM range(7) t(r) WHERE r * 1500 // 7 <= row_idx) AS spread, CASE WHEN row_idx < 1498 THEN CAST(row_idx // 214 AS BIGINT) END AS even FROM i")
COLS = CUST
over("columns__SET04", lambda v: v.select("id", "seg").withColumnRenamed("seg", "segment"), " SELECT id, seg AS segment FROM v")
over("concatenated__SET01_SET03_SRC04", lambda v: v.select("id").unionByName(v.select("id", "seg"), allowMissingColumns=True).groupBy(F.col("seg").isNull().alias("missing")).agg(F.count("*").alias("n")), " SELECT seg IS NULL AS missing, count(*) AS n FROM (SELECT id, NULL AS seg FROM v UNION ALL SELECT id, seg FROM v) GROUP BY 1")
SEQ = "SELECT c_custkey AS id, c_nationkey AS n FROM {customer}"
_seq = lambda: F.transform(F.sequence(F.lit(0), (F.col("n") % 9).cast("int")), lambda i: i)
over("padding_and_truncation__SET12_SET13", lambda v: v.select("id", *[F.array_join(c, ",").alias(k) for k, c in {"right": op.fitted(_seq(), 9, F.lit(-1)), "left": op.fitted(_seq(), 9, F.lit(-1), left=True), "cut_left": op.truncated(_seq(), 4, "left"), "cut_right": op.truncated(_seq(), 4, "right"), "cut_middle": op.truncated(_seq(), 4, "middle")}.items()]),
    """, s AS (SELECT id, range(0, n % 9 + 1) AS s FROM v), p AS (SELECT id, s, list_transform(range(0, 9 - len(s)), lambda x: -1) AS f FROM s) SELECT id, array_to_string(list_concat(s, f), ',') AS "right", array_to_string(list_concat(f, s), ',') AS "left", array_to_string(CASE WHEN len(s) > 4 THEN s[-4:] ELSE s END, ',') AS cut_left, array_to_string(s[:4], ',') AS cut_right,
    array_to_string(CASE WHEN len(s) > 4 THEN list_concat(s[:2], s[-2:]) ELSE s END, ',') AS cut_middle FROM p""", SEQ)  # fmt: skip
over("loss_masks__SET14", lambda v: v.select("seq", "pos", op.loss_mask(F.col("pos"), F.lit(3), F.count("*").over(op.W.Window.partitionBy("seq"))).alias("m")), " SELECT seq, pos, CASE WHEN pos >= 2 AND pos < count(*) OVER (PARTITION BY seq) - 1 THEN 1 ELSE 0 END AS m FROM v", views.TOKENS)
over("multiturn_loss_masks__SET14_ARR02", lambda v: v.select("conv_id", "turn", F.when(F.col("role") == "assistant", 1).otherwise(0).alias("all_turns"), F.when((F.col("role") == "assistant") & (F.col("turn") == F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(op.W.Window.partitionBy("conv_id"))), 1).otherwise(0).alias("last_round")),
    " SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS all_turns, CASE WHEN role = 'assistant' AND turn = max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) THEN 1 ELSE 0 END AS last_round FROM v", views.MESSAGES)
over("without_padding__SET15", lambda v: v.select("id", F.array_join(op.without_padding(op.fitted(_seq(), 9, F.lit(-1), left=True), op.fitted(F.transform(_seq(), lambda x: F.lit(1)), 9, F.lit(0), left=True)), ",").alias("s")), " SELECT id, array_to_string(range(0, n % 9 + 1), ',') AS s FROM v", SEQ)
over("imbalance__AGG32", lambda v: op.imbalance(v.withColumn("a", F.floor(F.col("rid") / 10000)).withColumn("b", F.col("rid") % 4), "length", "a", "b").select(*[F.round(c, 3).cast("double").alias(c) for c in ("min", "max", "minmax_diff", "balanced_min", "balanced_max", "mean")]),
    """, a AS (SELECT floor(rid / 10000) AS k, sum(length) AS s FROM v GROUP BY 1), b AS (SELECT rid % 4 AS k, sum(length) AS s FROM v GROUP BY 1) SELECT CAST(x.lo AS DOUBLE) AS min, CAST(x.hi AS DOUBLE) AS max, CAST(x.hi - x.lo AS DOUBLE) AS minmax_diff, CAST(y.lo AS DOUBLE) AS balanced_min, CAST(y.hi AS DOUBLE) AS balanced_max, round(x.m, 3) AS mean FROM (SELECT min(s) AS lo, max(s) AS hi, avg(s) AS m FROM a) x, (SELECT min(s) AS lo, max(s) AS hi FROM b) y""", views.ROLLOUTS)  # fmt: skip
over("micro_batch_count__SET18", lambda v: op.rounds_needed(v, "length", 4096, 8), " SELECT CAST(ceil(least(count(*), ceil(sum(length) / 4096)) / 8) * 8 AS BIGINT) AS micro_batches FROM v", views.ROLLOUTS)

def _times_sampled(v):
    """How often each row is drawn: 0 for those that are not."""
    drawn = smp.sampled(v, "id", 4000, 7).groupBy("id").agg(F.count("*").alias("n"))
    return v.select("id").join(drawn, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


over("sample_with_repeats__SMP01", _times_sampled, f", p AS (SELECT id, row_number() OVER (ORDER BY {md5(7)}, id) AS k FROM v) SELECT id, CAST(4000 // c + CASE WHEN k <= 4000 % c THEN 1 ELSE 0 END AS BIGINT) AS n FROM p, (SELECT count(*) AS c FROM v)")
over("train_val_split__SMP02", lambda v: smp.split(v, "id", 0.1, 11, 1200).where("part IS NOT NULL").select("id", "part"), f", p AS (SELECT id, row_number() OVER (ORDER BY {md5(11)}, id) AS k FROM v) SELECT id, CASE WHEN k <= greatest(1, floor(least(c, 1200) * 0.1)) THEN 'val' ELSE 'train' END AS part FROM p, (SELECT count(*) AS c FROM v) WHERE k <= 1200")
over("seeded_shuffle__SMP03", lambda v: op.shuffled(v, "id", 5, "place").select("id", "place"), f" SELECT id, row_number() OVER (ORDER BY {md5(5)}, id) - 1 AS place FROM v")
over("fixed_manifest__SMP04", lambda v: smp.manifest(v, "id", 200, 900, 50, 42).select("id"), IDX + f" SELECT id FROM i WHERE row_idx BETWEEN 200 AND 899 ORDER BY {md5(42)}, id LIMIT 50")
DOCS = "SELECT doc_id AS id, lang, source FROM {documents}"
over("stratified_sample__SMP05_SMP08", lambda v: smp.stratified(v, ["lang", "source"], "id", 3, 42, 150).select("id", "lang"), f", p AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY {md5(42)}, id) AS k FROM v) SELECT id, lang FROM p WHERE k <= 3 ORDER BY {md5(43)}, id LIMIT 150", DOCS)
over("weighted_source_choice__SMP06_SET02", lambda v: v.select("id", smp.weighted_choice(v, "id", F.when(F.col("lang") == "en", 0.25).otherwise(0.8), 9).alias("first")), f" SELECT id, CAST('0x' || left({md5(9)}, 8) AS BIGINT) / 4294967296.0 < CASE WHEN lang = 'en' THEN 0.25 ELSE 0.8 END AS first FROM v", DOCS)
over("range_split__SMP13", lambda v: op.indexed(v, "id").select("id", F.when(F.col("row_idx") < 1500 * 3 // 4, "sft").otherwise("rm").alias("part")), IDX + " SELECT id, CASE WHEN row_idx < 1125 THEN 'sft' ELSE 'rm' END AS part FROM i")
over("resample_weights__SMP10", lambda v: smp.resample_weights(v, "bal", "pow").select("id", F.round("weight", 4).alias("pow")).join(smp.resample_weights(v, "bal", "max_min").select("id", F.round("weight", 4).alias("extreme")), "id").join(smp.resample_weights(v, "bal", "max_random").select("id", F.round("weight", 4).alias("top")), "id"),
    " SELECT id, round(pow(abs(bal), 2) + 1e-8, 4) AS pow, CASE WHEN bal IN ((SELECT max(bal) FROM v), (SELECT min(bal) FROM v)) THEN 1.0 ELSE 0.0 END AS extreme, CASE WHEN bal = (SELECT max(bal) FROM v) THEN 0.4 ELSE 0.1 END AS top FROM v")
def _draws(v):
    """Rows drawn, and whether each row's draws are its share of them to one."""
    weighted = smp.resample_weights(v, "bal", "pow")
    drawn = smp.resampled(weighted, "id", "weight", 3).groupBy("id").agg(F.count("*").alias("k"))
    per = weighted.join(drawn, "id", "left").join(F.broadcast(weighted.agg(F.sum("weight").alias("all"), F.count("*").alias("rows"))))
    return per.agg(F.sum("k").alias("n"), (F.max(F.abs(F.coalesce("k", F.lit(0)) - F.col("weight") * F.col("rows") / F.col("all"))) < 1).alias("fair"))


over("resampled_rows__SMP10", _draws, " SELECT count(*) AS n, true AS fair FROM v")
over("bootstrap__SMP11_AGG21", lambda v: smp.bootstrap(v, ["uid"], "reward", "rid", 4, 50, 42), None, views.ROLLOUTS)
over("interleaved_sources__SET02", lambda v: smp.interleaved([v.where("lang = 'en'"), v.where("lang <> 'en'")], "id", [0.7, 0.3], 1, "all").groupBy("source_no").agg(F.count("*").alias("n")), " SELECT CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS source_no, count(*) AS n FROM v GROUP BY 1", DOCS)
over("filled_batch__SMP12", lambda v: smp.filled([v.where(f"id % 3 = {k}") for k in range(3)], lambda b: b.where("nation > 12"), 400, "id").agg(F.count("*").alias("n")), " SELECT CASE WHEN (SELECT count(*) FROM v WHERE nation > 12) >= 400 THEN 400 ELSE (SELECT count(*) FROM v WHERE id % 3 = 0) END AS n")
