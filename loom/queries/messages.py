"""Schema normalisation and dataset preprocessors over conversations, documents and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from loom import views
from loom.operators import messages as op
from loom.operators import presets as ps
from loom.queries import simple

C = F.col
TEXT = lambda m: F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
#: Whole texts, in halves.
DOCS = "SELECT doc_id, lang, source, substring(text, 1, CAST(floor(length(text) / 2) AS INT)) AS t, substring(text, CAST(floor(length(text) / 2) AS INT) + 1) AS u FROM {documents}"


def over(name, operator, sql=None, text=DOCS):
    simple(name, text, operator, sql)


def docs(name, operator, sql):
    over(name, operator, sql)


docs("safe_renames__PRJ01_PRJ02_PRJ03", lambda v: op.pruned(op.renamed_twice(v.select("doc_id", C("t").alias("Query"), C("u").alias("answer"), C("lang").alias("output"), C("source").alias("channel")), {"query": "label"}, {"answer": "response", "output": "response"}), ("label", "channel", "answer", "output")),
     " SELECT t AS label, source AS channel, u AS answer, lang AS output FROM v")
docs("prefixes__PRJ04", lambda v: op.unprefixed(v.select(C("doc_id").alias("__@doc_id"), C("t").alias("__#lang"), "lang")).select("doc_id", C("`__#lang`").alias("kept"), "lang"), " SELECT doc_id, t AS kept, lang FROM v")
docs("first_filled__PRJ05", lambda v: v.select("doc_id", op.filled(F.when(C("doc_id") % 3 == 0, " "), F.when(C("doc_id") % 2 == 0, C("lang")), F.concat(F.lit("line_"), C("doc_id").cast("string"))).alias("id")), " SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'line_' || doc_id END AS id FROM v")
docs("rl_fields__PRJ06_PRJ23", lambda v: v.select("doc_id", F.to_json(F.struct(C("doc_id").cast("string").alias("id"), F.when(C("doc_id") % 2 == 0, C("lang")).alias("answer"), F.lit("gap").alias("type"), C("doc_id").alias("original_index")), {"ignoreNullFields": "true"}).alias("row")), """ SELECT doc_id, '{"id":"' || doc_id || '",' || CASE WHEN doc_id % 2 = 0 THEN '"answer":"' || lang || '",' ELSE '' END || '"type":"gap","original_index":' || doc_id || '}' AS row FROM v""")
docs("response_messages__PRJ07_PRJ11", lambda v: op.automatic(v.select("doc_id", F.when(C("doc_id") % 3 == 0, C("source")).alias("system"), C("t").alias("query"), F.when(C("doc_id") % 4 > 0, C("u")).alias("response"), F.array(F.array("lang", F.lit("x"))).alias("history"))).select("doc_id", TEXT(C("messages")).alias("m")),
     " SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 3 = 0 THEN 'system:' || source END, 'user:' || lang, 'assistant:x', 'user:' || t, CASE WHEN doc_id % 4 > 0 THEN 'assistant:' || u END) AS m FROM v")
docs("alpaca_messages__PRJ08_PRJ11", lambda v: op.automatic(v.select("doc_id", F.when(C("doc_id") % 2 == 0, C("t")).otherwise("").alias("instruction"), F.when(C("doc_id") % 3 > 0, C("lang")).alias("input"), C("u").alias("output"))).select("doc_id", TEXT(C("messages")).alias("m")),
     " SELECT doc_id, concat_ws('|', 'user:' || CASE WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 AND t <> '' THEN t || chr(10) || lang WHEN doc_id % 2 = 0 AND t <> '' THEN t WHEN doc_id % 3 > 0 THEN lang END, 'assistant:' || u) AS m FROM v")
CONV = "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS role, text FROM {conversations}"
GROUP = lambda v: v.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.struct(s["role"].alias("role"), s["text"].alias("content"))).alias("messages"))
STD = "CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE role END"
over("standard_messages__PRJ09_PRJ11", lambda v: GROUP(v).select("conv_id", TEXT(op.standard_roles(C("messages"), F.lit("sys"))).alias("m")),
    f", g AS (SELECT conv_id, string_agg({STD} || ':' || text, '|' ORDER BY turn) AS m, first(role ORDER BY turn) AS f FROM v GROUP BY 1) SELECT conv_id, CASE WHEN f = 'system' THEN m ELSE 'system:sys|' || m END AS m FROM g", CONV)
docs("sharegpt_pairs__PRJ10", lambda v: v.select("doc_id", TEXT(op.pairs_to_messages(F.array(F.struct(C("t").alias("user"), C("u").alias("assistant")), F.struct(C("lang").alias("user"), F.lit("y").alias("assistant"))), F.when(C("doc_id") % 2 == 0, C("source")))).alias("m")), " SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 2 = 0 THEN 'system:' || source END, 'user:' || t, 'assistant:' || u, 'user:' || lang, 'assistant:y') AS m FROM v")
over("class_labels__PRJ12", lambda v: v.select("doc_id", C("quality").cast("string").cast("int").alias("label")), " SELECT doc_id, quality AS label FROM v", "SELECT doc_id, quality FROM {labels}")
over("history__PRJ13", lambda v: GROUP(v).select("conv_id", F.size(op.to_history(C("messages"))).alias("n"), F.element_at(F.transform(op.to_history(C("messages")), lambda h: F.coalesce(h[1], F.lit("-"))), -1).alias("last")).where("n > 0"),
    ", r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS c FROM v WHERE role <> 'system') SELECT conv_id, CAST(ceil(any_value(c) / 2) AS INTEGER) AS n, CASE WHEN any_value(c) % 2 = 1 THEN '-' ELSE max(CASE WHEN k = c THEN text END) END AS last FROM r GROUP BY 1", CONV)
PARTS = lambda: F.array(F.struct(F.lit("text").alias("type"), C("t").alias("value")), F.struct(F.lit("image_url").alias("type"), F.lit("a.png").alias("value")), F.struct(F.lit("audio").alias("type"), F.lit("b.wav").alias("value")), F.struct(F.lit("text").alias("type"), C("lang").alias("value")))
docs("content_parts__PRJ14", lambda v: v.select("doc_id", op.parts_to_text(PARTS()).alias("text"), F.array_join(op.media(PARTS(), "image"), ",").alias("images"), F.array_join(op.media(PARTS(), "audio"), ",").alias("audios")), " SELECT doc_id, t || '<image><audio>' || lang AS text, 'a.png' AS images, 'b.wav' AS audios FROM v")
docs("placeholder_parts__PRJ15", lambda v: v.select("doc_id", F.array_join(F.transform(op.text_to_parts(F.concat(F.lit("<image>"), C("lang"), F.lit("<image>")), F.array(F.lit("p"), F.lit("q"))), lambda p: F.concat(p["type"], F.lit("="), p["value"])), ";").alias("parts")), " SELECT doc_id, 'image=p;text=' || lang || ';image=q' AS parts FROM v")
over("leading_system__PRJ16", lambda v: GROUP(v).select("conv_id", op.without_system(op.standard_roles(C("messages"))).alias("s")).select("conv_id", F.coalesce("s.system", F.lit("-")).alias("system"), F.size("s.messages").alias("n")),
    ", g AS (SELECT conv_id, first(role ORDER BY turn) AS f, first(text ORDER BY turn) AS t, count(*) AS n FROM v GROUP BY 1) SELECT conv_id, CASE WHEN f = 'system' THEN t ELSE '-' END AS system, CAST(n - CASE WHEN f = 'system' THEN 1 ELSE 0 END AS INTEGER) AS n FROM g", CONV)
over("boxes__PRJ17", lambda v: v.select("vec_id", op.boxes(F.array(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")), F.transform(F.slice("embedding", 3, 2), lambda x: x.cast("double")))).alias("b")).select("vec_id", *[F.round(F.get(C("b")[0], F.lit(i)), 6).alias(f"x{i}") for i in range(4)], F.round(C("b")[1][0], 6).alias("p")),
    " SELECT vec_id, round(CAST(least(embedding[1], embedding[3]) AS DOUBLE), 6) AS x0, round(CAST(least(embedding[2], embedding[4]) AS DOUBLE), 6) AS x1, round(CAST(greatest(embedding[1], embedding[3]) AS DOUBLE), 6) AS x2, round(CAST(greatest(embedding[2], embedding[4]) AS DOUBLE), 6) AS x3, round(CAST(embedding[3] AS DOUBLE), 6) AS p FROM v", "SELECT vec_id, embedding FROM {embeddings}")
docs("training_rows__PRJ18_PRJ19_PRJ21", lambda v: v.select(*op.training_row("docs", C("t"), C("lang"), "qa", "train", C("doc_id"))).select("data_source", op.nested(C("extra_info"), ["index"]).alias("index"), op.nested(C("reward_model"), ["ground_truth"]).alias("truth"), F.to_json("prompt").alias("prompt")), """ SELECT 'docs' AS data_source, doc_id AS index, lang AS truth, '[{"role":"user","content":' || CAST(to_json(t) AS VARCHAR) || '}]' AS prompt FROM v""")
docs("unpaired_preferences__PRJ20", lambda v: op.unpaired(v.select(C("doc_id").alias("prompt"), C("t").alias("chosen"), C("lang").alias("rejected")), "prompt", "chosen", "rejected"), " SELECT doc_id AS prompt, t AS response FROM v UNION ALL SELECT doc_id, lang FROM v")
over("valid_messages__FLT05", lambda v: GROUP(v.withColumn("role", F.when(C("conv_id") % 7 == 0, "narrator").otherwise(C("role")))).select("conv_id", op.valid(op.standard_roles(C("messages"))).alias("ok")), " SELECT DISTINCT conv_id, conv_id % 7 <> 0 AS ok FROM v", CONV)
MSG = lambda *pairs: F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in pairs])
docs("rejected_responses__FLT06", lambda v: v.select("doc_id", op.rejected(MSG(("user", C("t")), ("assistant", C("lang")), ("user", C("u")), ("assistant", C("source"))), MSG(("user", C("t")), ("assistant", F.lit("en")), ("user", C("u")), ("assistant", F.when(C("doc_id") % 2 == 0, C("source")).otherwise("z")))).alias("r")), " SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'z' WHEN lang <> 'en' THEN 'en' END AS r FROM v")

docs("prefix_strips__DSP01_DSP02", lambda v: ps.stripped_prefix(ps.stripped_prefix(v.select("doc_id", F.concat(F.when(C("doc_id") % 2 == 0, "输入：").otherwise(""), C("lang")).alias("input"), F.concat(F.lit("Answer:  "), C("source")).alias("response")), "input", "输入："), "response", "Answer: "), " SELECT doc_id, lang AS input, source AS response FROM v")
docs("numbered_titles__DSP03", lambda v: ps.numbered_title(v.select("doc_id", F.when(C("doc_id") % 3 == 0, F.concat(F.lit("12. "), C("lang"))).when(C("doc_id") % 3 == 1, C("source")).otherwise("").alias("title"), F.when(C("doc_id") % 3 == 1, C("lang")).alias("abs"))).select("doc_id", "response"), " SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' || lang ELSE source || '，' || lang END AS response FROM v WHERE doc_id % 3 < 2")
over("bench_repairs__DSP05_DSP09", lambda v: GROUP(v).select("conv_id", ps.without_default_system(C("messages"), "x").alias("m")).where(~ps.mentions(C("m"), "the")).select("conv_id", F.size("m").alias("n")), " SELECT conv_id, CAST(count(*) AS INTEGER) AS n FROM v GROUP BY 1 HAVING NOT bool_or(contains(lower(text), 'the'))", CONV)
docs("plugins_and_kinds__DSP06_DSP07", lambda v: v.where(C("lang").isin("en", "de")).select("doc_id", ps.several_plugins(F.concat(F.lit('1. {"plugin_name": "a" 2. {"plugin_name": "'), F.when(C("doc_id") % 2 == 0, "a").otherwise("b"), F.lit('"'))).alias("several")), " SELECT doc_id, doc_id % 2 = 1 AS several FROM v WHERE lang IN ('en', 'de')")
docs("prompt_templates__DSP08_DSP10_DSP16", lambda v: ps.text_to_sql(v.select("doc_id", C("t").alias("sql_context"), C("u").alias("sql_prompt"), C("lang").alias("sql_explanation"), C("source").alias("sql"))).select("doc_id", TEXT(C("messages")).alias("m")).join(ps.with_answer(v.select("doc_id", C("t").alias("query"), C("u").alias("output"), C("lang").alias("answer"))).select("doc_id", TEXT(C("messages")).alias("n")), "doc_id"),
     " SELECT doc_id, 'user:Sql Table information:' || chr(10) || t || chr(10) || u || '|assistant:Let''s think step by step:' || chr(10) || lang || chr(10) || 'So the final sql is:' || chr(10) || source AS m, 'user:' || t || '|assistant:' || u || chr(10) || chr(10) || 'Answer: ' || lang AS n FROM v")
docs("chapters_and_fences__DSP11_DSP12", lambda v: ps.chapters(v.select("doc_id", C("lang").alias("type"), C("source").alias("title"), F.when(C("doc_id") % 2 == 0, "c1").alias("chapter1"), F.lit("c2").alias("chapter2"), C("t").alias("response")), ["chapter1", "chapter2"]).select("doc_id", "response").join(ps.at_fence(v.select("doc_id", F.concat(F.lit("# "), C("t"), F.lit("```python\nx\n``` ")).alias("code_with_problem"), C("lang").alias("explanation_only"))).select("doc_id", TEXT(C("messages")).alias("m")), "doc_id"),
     " SELECT doc_id, lang || chr(10) || source || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'c1' ELSE '' END || 'c2' || t AS response, 'user:' || t || '|assistant:```python' || chr(10) || 'x' || chr(10) || '```' || chr(10) || chr(10) || lang AS m FROM v")
docs("similarity_sets__DSP13", lambda v: ps.similarity_prompt(ps.similarity(v.select("doc_id", C("t").alias("sentence1"), C("u").alias("sentence2"), ((C("doc_id") % 8) / 8).alias("score")), 0.75)).select("doc_id", F.md5(TEXT(C("messages"))).alias("h")), """ SELECT doc_id, md5('user:Task: Based on the given two sentences, provide a similarity score between 0.0 and 1.0.' || chr(10) || 'Sentence 1: ' || t || chr(10) || 'Sentence 2: ' || u || chr(10) || 'Similarity score: |assistant:' || CASE WHEN doc_id % 8 = 6 THEN '0.8' ELSE '0.9' END) AS h FROM v WHERE doc_id % 8 >= 6""")
docs("json_repairs__DSP14_DSP22_DSP20", lambda v: v.select("doc_id", F.array_join(F.transform(F.from_json(ps.repaired_json(F.concat(F.lit('[{"a":'), C("doc_id").cast("string"), F.lit("}"), F.expr("repeat('\\n {\"a\":7}', CAST(doc_id % 4 AS INT))"), F.lit("]"))), "array<struct<a:long>>"), lambda x: x["a"].cast("string")), ",").alias("n"),
    TEXT(ps.tool_calls(F.concat(F.lit('[{"name":"'), C("lang"), F.lit('","arguments":{"x":"'), C("doc_id").cast("string"), F.lit('"}}'), F.when(C("doc_id") % 2 == 0, ',{"name":"g","arguments":{}}').otherwise(""), F.lit("]")))).alias("calls")),
    """ SELECT doc_id, doc_id || repeat(',7', doc_id % 4) AS n, 'tool_call:{"name":"' || lang || '","arguments":{"x":"' || doc_id || '"}}' || CASE WHEN doc_id % 2 = 0 THEN '|tool_call:{"name":"g","arguments":{}}' ELSE '' END AS calls FROM v""")
over("folded_chats__DSP15", lambda v: ps.folded_chat(GROUP(v).where(F.size("messages") > 1).withColumn("messages", op.standard_roles(C("messages"))), "!").select("conv_id", "query", "response"),
    ", g AS (SELECT conv_id, first(role ORDER BY turn) AS f, first(text ORDER BY turn) AS query, last(text ORDER BY turn) AS response, count(*) AS n FROM v GROUP BY 1) SELECT conv_id, query, response FROM g WHERE f = 'human' AND n > 1 AND query <> '' AND response <> ''", CONV)
docs("origin_questions__DSP17", lambda v: ps.human_or_not(v.select(C("t").alias("query"), F.array("lang", "source").alias("human_answers"), F.array("u").alias("chatgpt_answers")), 3).groupBy("response").agg(F.count("*").alias("n")), " SELECT response, n FROM (SELECT unnest(['Human', 'ChatGPT']) AS response, count(*) AS n FROM v)")
docs("question_generation__DSP18", lambda v: ps.question_generation(v.select("doc_id", F.concat(C("lang"), F.lit("[SEP]"), C("t")).alias("text1"), C("u").alias("text2"))).select("doc_id", TEXT(C("messages")).alias("m")), " SELECT doc_id, 'user:Task: Question Generation' || chr(10) || 'Context: ' || t || chr(10) || 'Answer: ' || lang || chr(10) || 'Question:|assistant:' || u AS m FROM v")
docs("transcripts__DSP19_DSP21", lambda v: ps.transcripts(v.where("trim(u) <> '' AND trim(t) <> ''").select("doc_id", F.concat(F.lit("\n\nHuman: "), C("t"), F.lit("\n\nAssistant: "), C("lang"), F.lit("\n\nHum: "), C("u"), F.lit("\n\nAssistant: z")).alias("chosen"), F.concat(F.lit("Human: "), C("t"), F.lit("\n\nAssistant: y")).alias("rejected"))).select("doc_id", TEXT(C("messages")).alias("m"), F.size("rejected_messages").alias("r")), " SELECT doc_id, 'user:' || trim(t) || '|assistant:' || lang || '|user:' || trim(u) || '|assistant:z' AS m, 2::INTEGER AS r FROM v WHERE trim(u) <> '' AND trim(t) <> ''")
docs("emoji_and_sources__DSP23_DSP27", lambda v: ps.without_source(v, "src1").select("doc_id", F.md5(ps.plain_emoji(F.concat(C("t"), F.lit("❤️"), C("u"), F.lit("️")))).alias("n")), " SELECT doc_id, md5(t || '❤' || u) AS n FROM v WHERE source <> 'src1'")
docs("delimited_turns__DSP24", lambda v: ps.delimited(v.select("doc_id", F.when(C("doc_id") % 3 == 0, "").when(C("doc_id") % 3 == 1, "User: a Assistant: b").otherwise("Assistant: x").alias("instruction"), F.concat(F.lit("User: "), C("lang")).alias("input"), C("source").alias("output"))).select("doc_id", TEXT(C("messages")).alias("m")), " SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'user:a|assistant:b|' ELSE '' END || 'user:' || lang || '|assistant:' || source AS m FROM v WHERE doc_id % 3 < 2")
docs("tools_and_context__DSP25_DSP26", lambda v: ps.described_tools(v.select("doc_id", F.lit("a\n\nb").alias("function_description"), MSG(("system", C("lang")), ("user", C("t"))).alias("messages"))).select("doc_id", F.size("tools").alias("tools"), TEXT(C("messages")).alias("m")).join(ps.with_context(v.select("doc_id", F.when(C("doc_id") % 2 == 0, C("lang")).alias("context"), C("t").alias("instruction"), C("u").alias("response"))).select("doc_id", TEXT(C("messages")).alias("n")), "doc_id"),
     " SELECT doc_id, 2::INTEGER AS tools, 'user:' || t AS m, 'user:' || CASE WHEN doc_id % 2 = 0 THEN 'Here gives some useful information:' || chr(10) || lang || chr(10) ELSE '' END || t || '|assistant:' || u AS n FROM v")
docs("filled_names__DSP28_DSP29", lambda v: ps.named(ps.templated(v.select("doc_id", F.lit("I am {{NAME}}").alias("query"), F.lit("by {{AUTHOR}}").alias("response"), F.when(C("lang") == "en", "en").otherwise("zh").alias("tag")), "Q: {{QUERY}}"), {"name": ("甲", "A"), "author": ("乙", "B")}, suffix="?", prefix="> ").select("doc_id", "query", "response"), " SELECT doc_id, CASE WHEN lang = 'en' THEN 'Q: I am A?' ELSE 'Q: I am 甲?' END AS query, CASE WHEN lang = 'en' THEN '> by B' ELSE '> by 乙' END AS response FROM v")
over("classified_prompts__DSP29", lambda v: ps.classified(v.select("doc_id", F.concat(F.lit("row "), C("doc_id").cast("string")).alias("sentence"), C("quality").alias("label")), ["bad", "good"], "Quality").select("doc_id", "query", "response"), " SELECT doc_id, 'Task: Quality' || chr(10) || 'Sentence: row ' || doc_id || chr(10) || 'Category: bad, good' || chr(10) || 'Output:' AS query, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS response FROM v", "SELECT doc_id, quality FROM {labels}")
docs("grounding_prompts__DSP30", lambda v: v.select(ps.grounding_prompt(C("doc_id"), ["a", "b"], ["甲"], 1).alias("p")).groupBy("p").agg(F.count("*").alias("n")), None)
docs("paths_and_letters__DSP31", lambda v: ps.existing(v.select("doc_id", ps.rewritten_path(F.concat(F.lit("coco/"), C("lang")), {"coco/": "/data/coco/"}).alias("p"), ps.option_letter(C("doc_id") % 4).alias("letter")), C("p"), v.sparkSession.createDataFrame([("/data/coco/en",), ("/data/coco/de",)], "path string")), " SELECT doc_id, '/data/coco/' || lang AS p, chr(CAST(65 + doc_id % 4 AS INTEGER)) AS letter FROM v WHERE lang IN ('en', 'de')")
SPANS = lambda: F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end")), F.struct((C("doc_id") % 6 + 1).cast("int").alias("start"), (C("doc_id") % 6 + 3).cast("int").alias("end")))
docs("spliced_spans__DSP32", lambda v: v.where(~ps.spans_overlap(SPANS())).select("doc_id", ps.spliced(C("t"), SPANS()).alias("s")), " SELECT doc_id, left(t, 2) || '<ref-object><bbox>' || substring(t, 6, CAST(doc_id % 6 - 4 AS INTEGER)) || '<ref-object><bbox>' || substring(t, CAST(doc_id % 6 + 4 AS INTEGER)) AS s FROM v WHERE doc_id % 6 >= 4")
docs("cleaned_titles__DSP33", lambda v: v.select("doc_id", ps.cleaned_title(F.concat(F.lit(" A [title]"), C("lang"), F.lit(" [x] b  "), C("source"))).alias("c")), " SELECT doc_id, 'A. ' || lang || ' b ' || source AS c FROM v")
docs("shuffled_options__DSP35", lambda v: v.select("doc_id", ps.shuffled_options(F.array(F.lit("w"), F.lit("x"), F.lit("y"), F.lit("z")), C("doc_id"), 4).alias("s")).select("doc_id", "s.gold"), ", o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY md5('4_' || doc_id || '_' || i)) AS k FROM v, range(4) t(i)) SELECT doc_id, chr(CAST(64 + k AS INTEGER)) AS gold FROM o WHERE i = 0")
over("dated_rows__DSP35", lambda v: ps.dated(v, "d", "1995-03", "1996-01").agg(F.count("*").alias("n")), " SELECT count(*) AS n FROM v WHERE d >= '1995-03' AND d < '1996-01'", "SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM {orders}")
