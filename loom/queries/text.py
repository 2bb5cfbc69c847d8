"""Text scalars and corpus quality over documents, conversations and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from loom import views
from loom.functions import fmt
from loom.functions import text as T
from loom.operators import quality as op
from loom.queries import simple

DOCS = "SELECT doc_id, text, lang, source FROM {documents}"
X = lambda: F.col("text")
WS = r"E' \t\n\r'"
NORM = r"lower(trim(regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')))"
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')"
TOKENS = r"regexp_extract_all(text, '[\p{L}\p{M}\p{N}_'']+|[^\p{L}\p{M}\p{N}_\s]')"
TEMPLATE = r"regexp_replace(regexp_replace({}, '\b\d+\.?\d*\b', 'NUM', 'g'), '<seg>\s*[\d.]+\s*,\s*[\d.]+\s*</seg>', '<seg>SEG</seg>', 'g')"
OPEN = "array_to_string(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')[:5], ' ')"
LINES = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents"


def over(name, operator, sql=None, text=DOCS):
    simple(name, text, operator, sql)


over("normalised_text__STR05", lambda v: v.select("doc_id", F.md5(T.normalised(X())).alias("h")), f" SELECT doc_id, md5({NORM.format('text')}) AS h FROM v")
over("token_counts__STR06_AGG07", lambda v: v.select("doc_id", F.size(T.tokens(X())).alias("n"), F.size(F.array_distinct(T.tokens(X()))).alias("u")), f" SELECT doc_id, CAST(len({TOKENS}) AS INTEGER) AS n, CAST(len(list_distinct({TOKENS})) AS INTEGER) AS u FROM v")
over("compact_text__STR07", lambda v: v.select("doc_id", T.compact(X(), 90).alias("c")), rf", t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM v) SELECT doc_id, CASE WHEN length(t) <= 90 THEN t ELSE regexp_replace(left(t, 90), ' [^ ]*$', '') || '...' END AS c FROM t")
CLEAN = "SELECT doc_id, concat('<think>  ', text, ' × — ', chr(160), '  </think>   <answer>≤3</answer> ') AS text FROM {documents}"
over("cleaned_text__STR09", lambda v: v.select("doc_id", T.cleaned(X()).alias("c")), r""" SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(text, '×', ' times '), '—', '-'), chr(160), ' '), '≤', ' less than or equal to '),
  '</think>\s+<answer>', '</think><answer>', 'g'), '<think>\s+', '<think>', 'g'), '\s+</think>', '</think>', 'g'), '\s{2,}', ' ', 'g')) AS c FROM v""", CLEAN)
FENCE = "SELECT doc_id, text AS inside, concat(CASE doc_id % 4 WHEN 0 THEN concat('```json', chr(10)) WHEN 1 THEN concat('  ```', chr(10)) WHEN 2 THEN '```Python ' ELSE '' END, text, CASE WHEN doc_id % 4 < 3 THEN concat(chr(10), '```') ELSE '' END, chr(10)) AS text FROM {documents}"
over("code_fence__STR08", lambda v: v.select("doc_id", F.md5(T.without_fence(X())).alias("c")), r" SELECT doc_id, md5(regexp_replace(inside, '^\s+|\s+$', '', 'g')) AS c FROM v", FENCE)
OPTIONS = "SELECT item_id AS doc_id, concat('Which ', text, '?', chr(10), 'Options:', chr(10), 'A. yes', chr(10), ' B.  no', chr(10), chr(10), 'other ', CAST(item_id AS STRING)) AS text FROM {benchmark}"
over("option_lists__STR11_STR15", lambda v: v.select("doc_id", T.options(X()).alias("o")).select("doc_id", F.col("o.question").alias("question"), T.prompt(F.col("o.question"), F.col("o.choices")).alias("prompt")),
    """, q AS (SELECT doc_id, replace(split_part(text, chr(10) || 'Options:', 1), chr(10), ' ') AS question FROM v) SELECT doc_id, trim(question) AS question, trim(question) || ' Choose the answer from ["yes", "no", "other ' || doc_id || '"]. Think step-by-step. Refer to the specific audio segments while thinking, and indicate the corresponding timestamps with <seg>start, end</seg>. Answer in the format of <think>...</think><answer>...</answer>.' AS prompt FROM q""", OPTIONS)  # fmt: skip
LISTS = """SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN concat('["', lang, '", "', source, ' ', CAST(doc_id AS STRING), '"]') WHEN doc_id % 3 = 1 THEN concat('[', chr(39), lang, chr(39), ', ', chr(39), source, ' ', CAST(doc_id AS STRING), chr(39), ']') ELSE concat('x ', chr(39), lang, chr(39), ' y ', chr(39), source, ' ', CAST(doc_id AS STRING), chr(39)) END AS text FROM {documents}"""
over("parsed_lists__PRJ22", lambda v: v.select("doc_id", F.array_join(T.parsed_list(X()), "|").alias("l")), " SELECT doc_id, lang || '|' || source || ' ' || doc_id AS l FROM v", LISTS)
QUESTIONS = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'What is the time gap?' WHEN 1 THEN 'Do they overlap?' WHEN 2 THEN 'How many sounds?' WHEN 3 THEN 'Which event first?' WHEN 4 THEN 'Which lasts longer?' WHEN 5 THEN 'What percentage?' WHEN 6 THEN 'How far, in percent?' WHEN 7 THEN 'recurring sound' ELSE 'hm' END AS text FROM {documents}"""
over("question_types__STR12", lambda v: v.groupBy(T.question_type(X()).alias("t")).agg(F.count("*").alias("n")), """ SELECT CASE doc_id % 9 WHEN 0 THEN 'gap' WHEN 1 THEN 'overlap' WHEN 2 THEN 'count_before' WHEN 3 THEN 'order' WHEN 4 THEN 'duration_compare' WHEN 5 THEN 'duration_percentage' WHEN 6 THEN 'start_percentage' WHEN 7 THEN 'repeated_event_gap' ELSE 'unknown' END AS t, count(*) AS n FROM v GROUP BY 1""", QUESTIONS)
VERDICT = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('[QA Valid]: ', CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'No' END, CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' cot valid : YES' END) END AS text FROM {documents}"
over("judge_verdicts__STR18", lambda v: v.select("doc_id", T.judge_verdict(X()).alias("j")).select("doc_id", "j.*"), " SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN doc_id % 2 = 0 END AS qa, CASE WHEN doc_id % 5 > 0 AND doc_id % 3 > 0 THEN true END AS cot, CASE WHEN doc_id % 5 = 0 THEN 'empty response' WHEN doc_id % 3 = 0 THEN 'cot_valid not found' END AS error FROM v", VERDICT)
over("tri_states__STR19", lambda v: v.select("doc_id", T.tri_state(F.col("qa_raw")).alias("qa"), T.tri_state(F.col("cot_raw")).alias("cot")), " SELECT doc_id, CASE WHEN qa_raw = 'True' THEN true WHEN qa_raw = 'no' THEN false END AS qa, CASE WHEN cot_raw = '1' THEN true WHEN cot_raw = 'false' THEN false END AS cot FROM v", views.JUDGED)
IDS = "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN concat('ab_c', CAST(event_id AS STRING)) ELSE concat('x_y_', CAST(event_id * 37 AS STRING)) END AS id FROM {events}"
over("segment_ids__STR20_STR21", lambda v: v.select("event_id", F.array_join(T.segment_ids(F.col("id")), "|").alias("ids"), F.regexp_replace("id", "_[^_]*$", "").alias("head"), T.safe_name(F.concat(F.lit("a/"), F.col("id"), F.lit(".wav"))).alias("name")),
    r""", s AS (SELECT *, CASE WHEN event_id % 4 > 0 THEN CAST(event_id * 37 // 1000 AS STRING) END AS s FROM v) SELECT event_id, CASE WHEN s IS NULL THEN id ELSE concat_ws('|', id, 'x_y_' || lpad(s, CAST(greatest(6, length(s)) AS INTEGER), '0'), 'x_y_' || lpad(s, CAST(greatest(3, length(s)) AS INTEGER), '0'), 'x_y_' || s, 'x_y') END AS ids, regexp_replace(id, '_[^_]*$', '') AS head, id || '_' || left(md5('a/' || id || '.wav'), 8) AS name FROM s""", IDS)  # fmt: skip
STOPS = "SELECT doc_id, text AS text, CASE doc_id % 4 WHEN 0 THEN '</seg>' WHEN 1 THEN '</answer>' WHEN 2 THEN '' END AS stop, CASE doc_id % 3 WHEN 0 THEN 'length' WHEN 1 THEN 'stop' END AS finish FROM {documents}"
over("finish_reasons__STR22", lambda v: v.select("doc_id", T.finish_reason(F.col("stop"), F.col("finish")).alias("r"), T.with_stop(X(), F.col("stop")).alias("t")), " SELECT doc_id, CASE WHEN stop = '</seg>' THEN 'seg' WHEN stop = '</answer>' THEN 'answer' WHEN finish = 'length' THEN 'max_tokens' WHEN finish = 'stop' THEN 'eos' ELSE 'unknown' END AS r, CASE WHEN stop IN ('</seg>', '</answer>') THEN text || stop ELSE text END AS t FROM v", STOPS)
SEGS = "SELECT doc_id, concat('a <seg>1,2</seg> b <seg> 3 , 4.5 </seg>', text) AS text FROM {documents}"
over("audio_placeholders__STR22_STR10", lambda v: v.select("doc_id", T.with_placeholders(X(), F.array((F.col("doc_id") % 3).cast("int"))).alias("t"), F.size(T.kept_split(X(), ["<seg>", "</seg>"])).alias("parts")),
    " SELECT doc_id, 'a <seg>1,2</seg>' || CASE WHEN doc_id % 3 = 0 THEN '<audio>' ELSE '' END || ' b <seg> 3 , 4.5 </seg>' || CASE WHEN doc_id % 3 = 1 THEN '<audio>' ELSE '' END || substring(text, 40) AS t, CAST(CASE WHEN length(text) > 40 THEN 9 ELSE 8 END AS INTEGER) AS parts FROM v", SEGS)
NAMES = "SELECT event_id, concat('f.', CASE event_id % 4 WHEN 0 THEN 'JPG' WHEN 1 THEN 'mp4' WHEN 2 THEN 'flac' ELSE 'bin' END) AS name, CASE event_id % 4 WHEN 0 THEN 'fLaCx' WHEN 1 THEN 'RIFFx' WHEN 2 THEN 'ID3x' ELSE 'zz' END AS head FROM {events}"
over("media_types__SRC16_SRC17", lambda v: v.select("event_id", T.media_type(F.col("name")).alias("kind"), T.sniffed(F.col("head").cast("binary")).alias("ext")), " SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' ELSE 'unknown' END AS kind, CASE event_id % 4 WHEN 0 THEN '.flac' WHEN 1 THEN '.wav' WHEN 2 THEN '.mp3' ELSE '.audio' END AS ext FROM v", NAMES)
SPANS = "SELECT event_id, value, value * 1.7E0 AS pct, event_id % 12 AS n FROM {events}"
over("formats__MTH01", lambda v: v.select("event_id", fmt.time(F.col("value")).alias("t"), fmt.seconds(F.col("value")).alias("s"), fmt.percent(F.col("pct")).alias("p"), fmt.percent(F.col("pct"), floor=True).alias("f")),
    r""" SELECT event_id, regexp_replace(regexp_replace(printf('%.3f', round(value, 3)), '0+$', ''), '\.$', '.0') AS t, CASE WHEN value < 0.05 THEN '0 seconds' WHEN abs(round_even(value, 1) - 1) < 1e-9 THEN '1.0 second' ELSE printf('%.1f seconds', round_even(value, 1)) END AS s, CAST(round_even(least(100, pct) / 5, 0) * 5 AS INTEGER) || '%' AS p, CAST(floor(least(100, pct) / 5) * 5 AS INTEGER) || '%' AS f FROM v""", SPANS)  # fmt: skip
over("choices__MTH02", lambda v: v.select("event_id", F.array_join(F.array_sort(fmt.percent_choices(F.col("pct"))), "|").alias("p"), F.array_join(F.array_sort(fmt.count_choices(F.col("n"))), "|").alias("c"), F.size(fmt.second_choices(F.col("value"))).alias("s")),
    """, b AS (SELECT *, CAST(round_even(least(100, pct) / 5, 0) * 5 AS INTEGER) AS b FROM v), l AS (SELECT *, [b, greatest(0, b - 10), least(100, b + 10), greatest(0, b - 20), least(100, b + 20), 0, 50, 100] AS l, [n, greatest(0, n - 1), n + 1, n + 2, greatest(0, n - 2)] AS m FROM b)
    SELECT event_id, array_to_string(list_sort(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i)[:4], lambda x: x || '%')), '|') AS p, array_to_string(list_sort(list_transform(list_filter(m, lambda x, i: list_position(m, x) = i)[:4], lambda x: CAST(x AS STRING))), '|') AS c, 4::INTEGER AS s FROM l""", SPANS)  # fmt: skip
BAD = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat('Question: ', text) WHEN doc_id % 5 = 1 THEN text WHEN doc_id % 5 = 2 THEN concat('a b c d e ', text) WHEN doc_id % 7 = 0 THEN concat(text, '10001000100010001000') ELSE text END AS text FROM {documents}"
over("bad_descriptions__FLT12", lambda v: v.select("doc_id", T.bad_description(X()).alias("bad")), r""", w AS (SELECT *, lower(trim(text)) AS low, regexp_extract_all(text, '[A-Za-z]+') AS w FROM v) SELECT doc_id, list_bool_or(list_transform(['the human:', 'human:', 'assistant:', 'given the audio', 'question:', 'answer:', '<answer>', '[answer]', '<think>', '[think]', 'the a s t o r y', 'the a b', 'the a v o l u t i o n'], lambda p: contains(low, p))) OR len(w) < 6 OR (length(text) > 200 AND len(w) < 10)
  OR regexp_matches(text, '\b(?:[A-Za-z]\s+){3,}[A-Za-z]\b') OR len(list_filter(w, lambda x: length(x) = 1)) > len(w) * 0.35 OR len(regexp_extract_all(text, '\d')) > 50 OR regexp_matches(text, '(?:1000){5,}') OR regexp_matches(text, '(?:0\s*){20,}') AS bad FROM w""", BAD)  # fmt: skip
GIB = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 9 = 1 THEN repeat('pérdida ', 5) WHEN doc_id % 9 = 2 THEN repeat('zog zog bim ', 40) WHEN doc_id % 9 = 3 THEN concat(repeat('12 ', 25), text) ELSE text END AS text FROM {documents}"
over("gibberish__FLT13", lambda v: op.gibberish(v, "doc_id", "text"), rf""", w AS (SELECT doc_id, text, {WORDS} AS w, regexp_extract_all(text, '\d+') AS d, len(regexp_extract_all(lower(text), 'pérdida')) AS p FROM v), c AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY 1, 2), t AS (SELECT doc_id, first(x ORDER BY n DESC, x) AS x, max(n) AS n FROM c GROUP BY 1),
  e AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(d) AS x FROM w) GROUP BY 1, 2), u AS (SELECT doc_id, first(x ORDER BY n DESC, x) AS x, max(n) AS n FROM e GROUP BY 1)
  SELECT doc_id, CASE WHEN p >= 5 THEN 'loop_word' WHEN len(w) = 0 THEN 'empty' WHEN t.n > len(w) * 0.5 THEN 'dominating_word' WHEN t.n >= 30 AND t.x NOT IN ({', '.join(repr(x) for x in T.FUNCTION_WORDS)}) THEN 'excessive_repeat' WHEN u.n >= 20 AND length(u.x) <= 3 THEN 'number_loop' WHEN {' OR '.join(f"contains(text, repeat(chr({c}), 10))" for c in (*range(33, 127), 32))} THEN 'char_repeat' ELSE 'normal' END AS reason
  FROM w LEFT JOIN t USING (doc_id) LEFT JOIN u USING (doc_id)""", GIB)  # fmt: skip
EVT = "SELECT user_id, event_type, event_id FROM {events}"
over("keyword_triggers__FLT14", lambda v: v.select("event_id", F.exists(F.array(*map(F.lit, ("view", "cart"))), lambda k: F.lower("event_type").contains(k)).alias("hit")), " SELECT event_id, contains(lower(event_type), 'view') OR contains(lower(event_type), 'cart') AS hit FROM v", EVT)
over("ngrams__AGG08", lambda v: op.ngram_stats(v, T.tokens(X())), f""", t AS (SELECT doc_id, {TOKENS} AS w FROM v), g AS (SELECT n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, (VALUES (2), (3), (4), (5)) AS k(n))), c AS (SELECT n, g, count(*) AS c FROM g GROUP BY 1, 2),
  s AS (SELECT n, CAST(sum(c) AS BIGINT) AS total, count(*) AS "unique", sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS r FROM c GROUP BY 1), p AS (SELECT n, string_agg(g, '|' ORDER BY c DESC, g) AS top FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY c DESC, g) AS k FROM c) WHERE k <= 3 GROUP BY 1)
  SELECT n, total, "unique", round("unique" * 100 / total, 1) AS unique_rate, round((total - "unique") * 100 / total, 1) AS repeat_rate, round(r * 100 / total, 1) AS repeated_pct, top FROM s JOIN p USING (n)""")  # fmt: skip
over("exact_duplicates__AGG09", lambda v: op.exact_duplicates(v, X()), " SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT text, count(*) AS n FROM v GROUP BY 1 HAVING count(*) > 1)")
over("loose_duplicates__AGG10", lambda v: op.loose_duplicates(v.select(F.explode(F.split("text", r"[\n.]")).alias("line")), F.col("line")).select(F.md5("norm").alias("h"), "n", "variants"),
    rf", l AS (SELECT unnest(regexp_split_to_array(text, '[\n.]')) AS line FROM v), g AS (SELECT {NORM.format('line')} AS norm, count(*) AS n, count(DISTINCT line) AS variants FROM l GROUP BY 1) SELECT md5(norm) AS h, n, variants FROM g WHERE variants > 1 AND norm <> ''")
over("template_repeats__AGG11", lambda v: op.concentration(v, T.template(X()), 15), f", c AS (SELECT {TEMPLATE.format('text')} AS v, count(*) AS n FROM v GROUP BY 1) SELECT count(*) AS \"unique\", count(*) FILTER (n > 1) AS repeated, round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, v LIMIT 15)) * 100 / sum(n), 1) AS top_pct FROM c")
over("opening_concentration__AGG12", lambda v: op.concentration(v, T.opening(T.template(X())), 5), f", c AS (SELECT {OPEN.format(TEMPLATE.format('text'))} AS v, count(*) AS n FROM v GROUP BY 1) SELECT count(*) AS \"unique\", count(*) FILTER (n > 1) AS repeated, round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, v LIMIT 5)) * 100 / sum(n), 1) AS top_pct FROM c")
over("diversity_by_type__AGG14", lambda v: op.concentration(v, T.opening(X()), 5, ["lang"]), f", c AS (SELECT lang, {OPEN.format('text')} AS v, count(*) AS n FROM v GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, v) AS k FROM c) SELECT lang, count(*) AS \"unique\", count(*) FILTER (n > 1) AS repeated, round(sum(n) FILTER (k <= 5) * 100 / sum(n), 1) AS top_pct FROM k GROUP BY 1")
over("explained_segments__AGG13", lambda v: op.explained(v, F.col("response")), r" SELECT CASE WHEN b AND a THEN 'both' WHEN b THEN 'before' WHEN a THEN 'after' ELSE 'neither' END AS kind, count(*) AS n FROM (SELECT regexp_matches(response, '(?s)\S.{5,40}?\s*<seg>') AS b, regexp_matches(response, '(?s)</seg>\s*.{5,40}?(?:<seg>|$)') AS a FROM v WHERE regexp_matches(response, '<seg>\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*</seg>')) GROUP BY 1", views.RESPONSES)
over("segment_followups__AGG13", lambda v: op.followups(v, F.col("response"), 20), r", f AS (SELECT unnest(regexp_extract_all(response, '(?s)<seg>\s*[\d.]+\s*,\s*[\d.]+\s*</seg>\s*(.{10,60}?)(?:<seg|$)', 1)) AS f FROM v) SELECT trim(f) AS f, count(*) AS n FROM f WHERE length(trim(f)) >= 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", views.RESPONSES)
over("type_token_ratio__AGG07", lambda v: op.type_token_ratio(v, T.tokens(X()), ["lang"]), f", t AS (SELECT lang, unnest({TOKENS}) AS w FROM v) SELECT lang, count(*) AS tokens, count(DISTINCT w) AS types, round(count(DISTINCT w) / count(*), 6) AS ratio FROM t GROUP BY 1")
over("most_common_openings__AGG06", lambda v: op.most_common(v, T.opening(X()), F.col("doc_id"), 20).select("value", "n"), f", c AS (SELECT {OPEN.format('text')} AS value, count(*) AS n, min(doc_id) AS f FROM v GROUP BY 1) SELECT value, n FROM c ORDER BY n DESC, f, value LIMIT 20")
