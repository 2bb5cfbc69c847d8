"""Sources, sinks, sequential steps and streams."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loom import views
from loom.operators import sequential as seq
from loom.queries import query, simple
from loom.sources import catalog, files
from loom.streaming import flows

C = F.col


def _jsonl(spark, sf_dir):
    path = files.scratch(spark, "jsonl")
    views.read(spark, sf_dir, "customer").orderBy("c_custkey").select("c_custkey", "c_name").coalesce(1).write.json(path)
    return path


@query("json_lines__SRC01_SNK01_FLT03", "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) AS line_no FROM customer")
def _numbered(spark, sf_dir):
    return files.json_lines(spark, _jsonl(spark, sf_dir), "c_custkey long, c_name string", strict=True).select(C("c_custkey").alias("id"), "line_no")


@query("json_lines_from_zero__SRC02", "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS line_no FROM customer")
def _from_zero(spark, sf_dir):
    return files.json_lines(spark, _jsonl(spark, sf_dir), "c_custkey long, c_name string", first=0).select(C("c_custkey").alias("id"), "line_no")


@query("parquet_folders__SRC03_SRC04_SNK05", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _folders(spark, sf_dir):
    path = files.scratch(spark, "parquet")
    files.write_parquet(views.read(spark, sf_dir, "documents").select("doc_id", "lang").where("lang = 'en'"), f"{path}/a/x", 100)
    files.write_parquet(views.read(spark, sf_dir, "documents").select("doc_id", "lang").where("lang <> 'en'"), f"{path}/b", 100)
    return files.parquet(spark, path, recursive=True).groupBy("lang").agg(F.count("*").alias("n"))


@query("delimited_text__SRC05_SRC06", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, '' AS empty FROM nation")
def _tsv(spark, sf_dir):
    path = files.scratch(spark, "tsv") + ".tsv"
    views.read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit("").alias("e")).write.csv(path, sep="\t", header=True, emptyValue="")
    return files.delimited(spark, path, ["n_nationkey"]).select(C("n_nationkey").cast("long").alias("k"), C("n_name").alias("name"), C("e").alias("empty"))


@query("routed_outputs__SNK02_SNK06", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _routes(spark, sf_dir):
    path = files.scratch(spark, "routes")
    files.write_routes(views.read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", path)
    return spark.read.json(path).groupBy("lang").agg(F.count("*").alias("n"))


@query("merged_lists__SNK10", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _merged(spark, sf_dir):
    """Two sets of list files, of a few hundred rows a list; every row of documents is in one of them."""
    paths, rows = [], views.read(spark, sf_dir, "documents").select("doc_id", "lang")
    for part in (0, 1):
        lists = rows.where(C("doc_id") % 2 == part).groupBy(F.floor(C("doc_id") / 1000).alias("list")).agg(F.to_json(F.collect_list(F.struct("doc_id", "lang"))).alias("value"))
        paths.append(files.scratch(spark, f"list-{part}"))
        lists.write.partitionBy("list").text(paths[-1])
    return files.merged_lists(spark, paths, "struct<doc_id:long,lang:string>").groupBy("item.lang").agg(F.count("*").alias("n"))


@query("finished_files__SRC12", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey IN (1, 3)")
def _finished(spark, sf_dir):
    """A folder per nation, a marker in those of two regions."""
    path, nation = files.scratch(spark, "marked"), views.read(spark, sf_dir, "nation").withColumn("k", C("n_nationkey"))
    nation.select("k", "n_name").write.partitionBy("k").text(path)
    nation.where("n_regionkey IN (1, 3)").select("k", F.lit("").alias("value")).write.mode("append").option("compression", "gzip").partitionBy("k").text(path)
    found = files.finished(spark, path, "part-*.txt", "part-*.gz").select(F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("long").alias("k"))
    return found.join(nation.select(C("k").cast("long").alias("k"), C("n_name").alias("name")), "k").select("k", "name")


@query("catalog_requests__SRC07_SRC08_SRC09_SRC11", "SELECT CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS part, least(count(*), CASE WHEN lang = 'en' THEN 40 ELSE count(*) END) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY lang")
def _catalog(spark, sf_dir):
    c = catalog.Catalog()
    c.register(catalog.Dataset("team/docs", lambda s, subset: views.read(s, sf_dir, "documents").where(C("lang") == subset).select("doc_id", "lang"), subsets=("en", "de", "fr", "es"), weak=("fr", "es")))
    return c.load(spark, ["docs:en#40", "hub::team/docs:de"], "doc_id").groupBy(F.when(C("lang") == "en", "en").otherwise("other").alias("part")).agg(F.count("*").alias("n"))


@query("info_file_requests__SRC10", "SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS query FROM customer UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name FROM nation")
def _info(spark, sf_dir):
    """Two datasets registered from an info text, with their columns renamed; one is asked for by the end of its name."""
    buyers, places = (files.scratch(spark, x) + ".jsonl" for x in ("buyers", "places"))
    views.read(spark, sf_dir, "customer").select("c_custkey", "c_name").write.json(buyers)
    views.read(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.json(places)
    c = catalog.Catalog()
    c.register_info(json.dumps([{"name": "team/buyers", "path": buyers, "columns": {"c_custkey": "id", "c_name": "query"}}, {"name": "team/places", "path": places, "columns": {"n_nationkey": "id", "n_name": "query"}}]))
    return c.load(spark, ["buyers", "team/places"], "id").select(C("id").cast("long").alias("id"), "query")


LEN = "SELECT o_orderkey AS id, o_orderkey % 50 + 1 AS len, CAST(floor(o_orderkey / 64) AS BIGINT) AS batch FROM {orders}"
simple("packed_sequences__SET16", LEN, lambda v: seq.packed_rows(seq.packed(v, "id", "len", 128), "id", "len").groupBy("shard").agg(F.sum("len").alias("tokens"), (F.max(C("offset") + C("len")) <= 128).alias("fits")), " SELECT CAST(floor(id / 128) AS BIGINT) AS shard, CAST(sum(len) AS BIGINT) AS tokens, true AS fits FROM v GROUP BY 1")
simple("balanced_parts__SET17_SET18", LEN, lambda v: seq.balanced_parts(v, "batch", "id", "len", 4).groupBy("batch", "part").agg(F.sum("len").alias("s")).groupBy("batch").agg(F.sum("s").alias("tokens"), (F.max("s") - F.min("s") <= 50).alias("even")), " SELECT batch, CAST(sum(len) AS BIGINT) AS tokens, true AS even FROM v GROUP BY 1")
def _even(v):
    """Every row in one of 64 parts, of sums that differ by less than the longest row."""
    split = files.written(seq.balanced_whole(v, "id", "len", 64, 1000, 4), "parts")
    even = split.groupBy("part").agg(F.sum("len").alias("s")).agg((F.max("s") - F.min("s") < 50).alias("even"), F.count("*").alias("parts"))
    return split.select("id", "len").join(F.broadcast(even))


simple("balanced_whole__SET17", LEN, _even, " SELECT id, len, true AS even, 64 AS parts FROM v")
KINDS = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'gap' WHEN 1 THEN 'order' ELSE 'overlap' END AS a, 'gap' AS b FROM {orders}"
simple("quota_choice__SMP07", KINDS, lambda v: seq.quota_choice(v.withColumn("k", F.array_distinct(F.array("a", "b"))), F.floor(C("id") / 4096), "id", "k", {"gap": 2, "order": 1, "overlap": 1}).groupBy("kind").agg(F.count("*").alias("n")))


MATH = """CASE doc_id % 6 WHEN 0 THEN '\\frac{' || a || '}{' || b || '}' WHEN 1 THEN '\\frac{' || a || '}{' || b || '}' WHEN 2 THEN '\\frac{' || a || '}{' || b || '}' WHEN 3 THEN '\\sqrt{' || b || '}x' WHEN 4 THEN 'ab=' || a ELSE CASE b WHEN 5 THEN '\\frac{1}{2}' ELSE '0.' || b END END"""


@query("parsed_texts__STR08_STR23_STR24_RWD10", f"""SELECT doc_id, '{{"id": ' || doc_id || ', "t": {{"s": "' || source || '}}"}}}}' AS object, {MATH} AS math, 'tool_' || doc_id % 5 AS name,
  CASE WHEN doc_id % 7 = 0 THEN 0.0 ELSE 2.0 * (CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN lang = 'en' THEN 1 ELSE 0 END) / 4 END::DOUBLE AS f1 FROM (SELECT *, doc_id % 9 + 1 AS a, doc_id % 8 + 2 AS b FROM documents)""")
def _parsed(spark, sf_dir):
    """Whole texts with an object, a boxed answer in six spellings, and an action among them."""
    cat, lit = F.concat, F.lit
    v = views.read(spark, sf_dir, "documents").withColumn("a", (C("doc_id") % 9 + 1).cast("string")).withColumn("b", (C("doc_id") % 8 + 2).cast("string"))
    spellings = [cat(lit("\\dfrac"), C("a"), C("b")), cat(lit("\\left "), C("a"), lit("/"), C("b"), lit("\\text{ cm}")), cat(lit("x=\\tfrac{"), C("a"), lit("}{"), C("b"), lit("}")), cat(lit("\\sqrt"), C("b"), lit(" x")), cat(lit("a b = "), C("a")), cat(lit("."), C("b"), lit("\\%"))]
    math = F.element_at(F.array(*spellings), (C("doc_id") % 6 + 1).cast("int"))
    plain = F.translate("text", "{}\\\\", "")
    t = cat(plain, lit("{bad} {"), lit(' "x" {"id": '), C("doc_id").cast("string"), lit(', "t": {"s": "'), C("source"), lit('}"}} '), plain, lit(" \\boxed{1} \\boxed{"), math, lit("} Action: none Action Input: {} Action: tool_"), (C("doc_id") % 5).cast("string"),
            lit('\nAction Input: {"q": '), (C("doc_id") % 3).cast("string"), lit(', "lang": "'), C("lang"), F.when(C("doc_id") % 7 == 0, '"').otherwise('"}'))
    v = v.select("doc_id", t.alias("t"))
    return v.select("doc_id", seq.texts(seq.json_object)("t").alias("object"), seq.texts(lambda x: seq.plain_math(seq.boxed(x) or ""))("t").alias("math"), seq.texts(lambda x: seq.action(x)[0])("t").alias("name"), seq.texts(lambda x: seq.argument_f1(seq.action(x)[1], '{"q": 1, "lang": "en"}'), "double")("t").alias("f1"))


GRAMS = lambda n: f"list_transform(range(1, len({{0}}) - {n} + 2), lambda i: array_to_string({{0}}[i:i + {n - 1}], ' '))"
#: Common n-grams with their lesser counts, per item, and the n-grams of what was said and of what is true.
HITS = " ".join(f""", h{n} AS (SELECT item_id, sum(least(x.c, y.c)) AS h FROM (SELECT item_id, g, count(*) AS c FROM (SELECT item_id, unnest({GRAMS(n).format('s')}) AS g FROM w) GROUP BY ALL) x
  JOIN (SELECT item_id, g, count(*) AS c FROM (SELECT item_id, unnest({GRAMS(n).format('t')}) AS g FROM w) GROUP BY ALL) y USING (item_id, g) GROUP BY 1)""" for n in (1, 2, 3, 4))


@query("generation_metrics__AGG29", f"""WITH w AS (SELECT item_id, t, list_filter(t, lambda x, i: i % 3 > 0) AS s FROM (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM benchmark)) {HITS},
m AS (SELECT item_id, len(s) AS p, len(t) AS r, coalesce(h1.h, 0) AS a, coalesce(h2.h, 0) AS b, coalesce(h3.h, 0) AS c, coalesce(h4.h, 0) AS d FROM w LEFT JOIN h1 USING (item_id) LEFT JOIN h2 USING (item_id) LEFT JOIN h3 USING (item_id) LEFT JOIN h4 USING (item_id)),
z AS (SELECT *, 1 AS z1, CASE WHEN b = 0 THEN 2 ELSE 1 END AS z2 FROM m), y AS (SELECT *, CASE WHEN c = 0 THEN 2 * z2 ELSE z2 END AS z3 FROM z), x AS (SELECT *, CASE WHEN d = 0 THEN 2 * z3 ELSE z3 END AS z4 FROM y)
SELECT round(avg(2 * a / (p + r)) * 100, 6) AS rouge_1, round(avg(CASE WHEN b = 0 THEN 0 ELSE 2 * b / (p + r - 2) END) * 100, 6) AS rouge_2, round(avg(2 * p / (p + r)) * 100, 6) AS rouge_l,
  round(avg(exp((ln(a / p) + ln(CASE WHEN b > 0 THEN b / (p - 1) ELSE 1 / (z2 * greatest(1, p - 1)) END) + ln(CASE WHEN c > 0 THEN c / (p - 2) ELSE 1 / (z3 * greatest(1, p - 2)) END) + ln(CASE WHEN d > 0 THEN d / (p - 3) ELSE 1 / (z4 * greatest(1, p - 3)) END)) / 4) * least(1.0, exp(1 - r / p))) * 100, 6) AS bleu_4 FROM x""")
def _generation(spark, sf_dir):
    """Each text without every third word, against the text."""
    v = views.read(spark, sf_dir, "benchmark").select("text", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    return seq.generation_metrics(v.withColumn("said", F.array_join(F.filter("w", lambda w, i: (i + 1) % 3 > 0), " ")), "said", "text")


simple("accumulated_means__AGG30", "SELECT o_custkey % 10 AS k, o_totalprice AS x FROM {orders}", lambda v: seq.accumulated(v, "k", "x").select("k", F.round("value", 3).alias("value")), " SELECT k, round(avg(x), 3) AS value FROM v GROUP BY 1")
ROLL = "SELECT o_custkey AS request, o_orderkey AS order_no, CASE o_orderkey % 5 WHEN 0 THEN 'answer' ELSE 'seg' END AS reason, CAST(o_orderkey % 7 AS DOUBLE) AS start, CAST(o_orderkey % 7 + 2 AS DOUBLE) AS end, 10.0E0 AS duration FROM {orders}"
simple("rollout_states__STREAM_QA", ROLL, lambda v: seq.rollouts(v, "request", "order_no").select("request", "finish"), ', k AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY order_no) AS k FROM v) SELECT request, CASE WHEN min(CASE WHEN reason = \'answer\' THEN k END) <= 8 THEN \'answer\' WHEN count(*) >= 8 THEN \'finalized\' ELSE \'open\' END AS finish FROM k GROUP BY 1')


def _streamed(spark, sf_dir, columns, table="orders"):
    path = files.scratch(spark, "stream-in")
    files_each = spark.sparkContext.defaultParallelism  # of four batches, so that all cores read one
    views.read(spark, sf_dir, table).select(*columns).repartition(4 * files_each).write.parquet(path)
    return flows.source(spark, path, spark.read.parquet(path).schema, files_per_trigger=files_each)


@query("streamed_profile__SRC14", "SELECT o_orderstatus AS st, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _profile(spark, sf_dir):
    out = flows.run(flows.profile(_streamed(spark, sf_dir, [C("o_orderstatus").alias("st"), C("o_totalprice").alias("x")]), "st", "x"), files.scratch(spark, "stream-out"), files.scratch(spark, "checkpoint"))
    return out.select("st", "n", F.round("total", 2).alias("total"))


@query("streamed_once__SRC13", "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem")
def _once(spark, sf_dir):
    return flows.run(flows.once_by_id(_streamed(spark, sf_dir, [C("l_orderkey").alias("id")], "lineitem"), "id"), files.scratch(spark, "stream-out"), files.scratch(spark, "checkpoint"), "append").agg(F.count("*").alias("n"))


def _in_runs(spark, parts, shard, make, mode="append", end=True):
    """Writes the parts one after the other as a stream's input and runs the query after each, from its checkpoint; then end markers."""
    path, out, checkpoint = (files.scratch(spark, x) for x in ("stream-in", "stream-out", "checkpoint"))
    for part in [*parts, *([flows.end_markers(reduce(DataFrame.unionByName, parts), shard)] if end else [])]:
        part.write.mode("append").parquet(path)
        found = flows.run(make(flows.source(spark, path, part.schema, files_per_trigger=10_000)), out, checkpoint, mode)
    return found


def _halves(rows, key):
    """Rows up to the middle of the key's range, and those above."""
    middle = rows.agg(F.avg(key).alias("m")).first().m or 0
    return [rows.where(C(key) <= middle), rows.where(C(key) > middle)]


@query("streamed_packing__SET16", "SELECT o_orderkey AS id, o_custkey % 4 AS shard, o_orderkey % 50 + 1 AS len, true AS fits FROM orders")
def _packing(spark, sf_dir):
    """Every row once, in a bin of its shard that holds no more than 128; the query is stopped twice on the way."""
    rows = views.read(spark, sf_dir, "orders").select((C("o_custkey") % 4).alias("shard"), C("o_orderkey").alias("id"), (C("o_orderkey") % 50 + 1).alias("len"))
    out = _in_runs(spark, _halves(rows, "id"), "shard", lambda stream: flows.packed(stream, "shard", "id", "len", 128))
    packed = out.select("id", "shard", "bin").join(rows.select("id", "len"), "id")
    held = packed.groupBy("shard", "bin").agg((F.sum("len") <= 128).alias("fits"))
    return packed.join(held, ["shard", "bin"]).select("id", "shard", "len", "fits")


@query("streamed_shuffle__SMP03", "SELECT o_orderkey AS id, o_custkey % 4 AS shard, o_orderstatus AS st, true AS near, true AS placed FROM orders")
def _stream_shuffle(spark, sf_dir):
    """Every row once, at a place of its own, and none a buffer's size or more before the place it came at."""
    rows = views.read(spark, sf_dir, "orders").select((C("o_custkey") % 4).alias("shard"), C("o_orderkey").alias("id"), C("o_orderstatus").alias("st"))
    out = _in_runs(spark, _halves(rows, "id"), "shard", lambda stream: flows.shuffled(stream, "shard", "id", 200, 7))
    came, went = (F.row_number().over(Window.partitionBy("shard").orderBy(c)) - 1 for c in ("id", "at"))
    return out.withColumn("came", came).withColumn("went", went).select("id", "shard", "st", (C("at") > C("came") - 200).alias("near"), (C("went") == C("at")).alias("placed"))


@query("streamed_split__SMP02", "SELECT id, shard, CASE WHEN k <= 20 THEN 'val' ELSE 'train' END AS part FROM (SELECT o_orderkey AS id, o_custkey % 4 AS shard, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 200")
def _stream_split(spark, sf_dir):
    """The first 200 rows of each shard, a tenth of them held out."""
    rows = views.read(spark, sf_dir, "orders").select((C("o_custkey") % 4).alias("shard"), C("o_orderkey").alias("id"))
    return _in_runs(spark, _halves(rows, "id"), "shard", lambda stream: flows.split(stream, "shard", "id", 200, 0.1), end=False).select("id", "shard", "part")


@query("cycled_rows__STREAM", "SELECT CAST(e AS INTEGER) AS epoch, o_orderkey AS id, true AS alike FROM orders, range(3) t(e)")
def _cycled(spark, sf_dir):
    """Two epochs, then one more from the checkpoint; a row has the same place in each."""
    path, out, checkpoint = (files.scratch(spark, x) for x in ("cycle-in", "cycle-out", "checkpoint"))
    views.read(spark, sf_dir, "orders").select(C("o_orderkey").alias("id")).repartitionByRange(4, "id").write.parquet(path)
    for epochs in (2, 3):
        found = flows.run(flows.cycle(spark, path, "id long", epochs), out, checkpoint, "append")
    places = found.groupBy("id").agg((F.count_distinct("place", "row") == 1).alias("alike"))
    return found.join(places, "id").select("epoch", "id", "alike")


LINE = "CASE WHEN o_orderkey % 50 = 7 THEN '{bad' WHEN o_orderkey % 50 = 9 THEN '' ELSE '{\"id\": ' || o_orderkey || ', \"st\": \"' || o_orderstatus || '\", \"labels\": [\"' || o_orderpriority || '\", \"x\"]}' END"
_TAILED = "SELECT *, o_orderkey % 50 NOT IN (7, 9) AS good FROM orders"


@query("tailed_counters__SRC14", f"""WITH o AS ({_TAILED}), c AS (SELECT 'lines' AS counter, NULL AS key, count(*) AS n FROM o UNION ALL SELECT 'bad', NULL, count(*) FILTER (WHERE o_orderkey % 50 = 7) FROM o UNION ALL SELECT 'samples', NULL, count(*) FILTER (WHERE good) FROM o
  UNION ALL SELECT 'ids', NULL, coalesce(sum(o_orderkey) FILTER (WHERE good), 0) FROM o UNION ALL SELECT 'open', NULL, count(*) FILTER (WHERE good AND o_orderstatus = 'O') FROM o UNION ALL SELECT 'status', o_orderstatus, count(*) FROM o WHERE good GROUP BY ALL
  UNION ALL SELECT 'label', o_orderpriority, count(*) FROM o WHERE good GROUP BY ALL UNION ALL SELECT 'label', 'x', count(*) FROM o WHERE good HAVING count(*) > 0) SELECT counter, key, CAST(n AS BIGINT) AS n FROM c""")
def _tailed(spark, sf_dir):
    """JSON lines in eight files that grow between two runs of one query: blank and broken lines among them."""
    path, out, checkpoint = (files.scratch(spark, x) for x in ("grows", "counters", "checkpoint"))
    rows = views.read(spark, sf_dir, "orders")
    for part in _halves(rows, "o_orderkey"):
        files.append_lines(part.select("o_custkey", F.expr(LINE).alias("line")), "line", C("o_custkey") % 8, path)
        found = flows.running_counters(flows.tail(spark, path), "id long, st string, labels array<string>", {"ids": C("r.id"), "open": C("r.st") == "O"}, {"status": C("r.st"), "label": C("r.labels")}, out, checkpoint)
    return found.groupBy("counter", "key").agg(F.sum("n").cast("long").alias("n"))


@query("streamed_rollouts__STREAM", f"""WITH v AS ({views.duck(ROLL)}), k AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY order_no) AS k FROM v)
SELECT request, CASE WHEN min(CASE WHEN reason = 'answer' THEN k END) <= 8 THEN 'answer' WHEN count(*) >= 8 THEN 'finalized' ELSE 'open' END AS finish FROM k GROUP BY 1""")
def _rollouts(spark, sf_dir):
    """Each request's state after the last batch that had outputs of it; every third output comes before its turn."""
    rows = views.view(spark, sf_dir, ROLL).withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy("order_no")) - 1).drop("order_no")
    early = C("place") % 3 == 2
    out = _in_runs(spark, [rows.where(early), rows.where(~early)], "request", lambda stream: flows.rollouts(stream, "request", "place"), "update", end=False)
    return out.groupBy("request").agg(F.max_by("finish", "batch").alias("finish"))
