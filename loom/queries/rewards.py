"""Tags and scorers over tagged responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from loom import views
from loom.functions import rewards, tags
from loom.queries import simple

R, G = (lambda: F.col("response")), (lambda: F.col("gold"))
ANS = r"trim(regexp_extract(response, '(?s)<answer>(.*?)</answer>', 1), E' \t\n\r')"
SEG = r"<seg>\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*</seg>"
NORM = r"trim(regexp_replace(rtrim(regexp_replace(lower(trim({}, E' \t\n\r')), '\s+', ' ', 'g'), '.'), '(\d+(?:\.\d+)?)\s*seconds?', '\1', 'g'))"
RIGHT = f"({ANS} <> '' AND {NORM.format(ANS)} = {NORM.format('gold')})"


def over(name, operator, sql):
    simple(name, views.RESPONSES, operator, sql)


over("answers__STR01", lambda v: v.select("doc_id", tags.answer(R()).alias("first"), tags.answer(R(), 2).alias("second"), tags.answer(R(), -1).alias("last")),
    r""", a AS (SELECT doc_id, list_transform(regexp_extract_all(response, '(?s)<answer>(.*?)</answer>', 1), lambda x: trim(x, E' \t\n\r')) AS a FROM v) SELECT doc_id, coalesce(a[1], '') AS first, coalesce(a[2], '') AS second, coalesce(a[-1], '') AS last FROM a""")  # fmt: skip
over("segments__STR02_FLT11", lambda v: v.select("doc_id", F.posexplode(tags.segments(R())).alias("k", "s")).select("doc_id", F.col("k").cast("long").alias("k"), F.col("s.start").alias("start"), F.col("s.end").alias("stop")),
    f""", a AS (SELECT doc_id, regexp_extract_all(response, '{SEG}', 1) AS s, regexp_extract_all(response, '{SEG}', 2) AS e FROM v) SELECT doc_id, k, CAST(s[k + 1] AS DOUBLE) AS start, CAST(e[k + 1] AS DOUBLE) AS stop FROM (SELECT *, unnest(range(len(s))) AS k FROM a)""")
over("invalid_segments__FLT11", lambda v: v.select("doc_id", tags.segment_count_valid(R(), F.lit(3.5)).alias("invalid")),
    f""", a AS (SELECT doc_id, list_zip(regexp_extract_all(response, '{SEG}', 1), regexp_extract_all(response, '{SEG}', 2)) AS z FROM v) SELECT doc_id, CAST(len(list_filter(z, lambda p: CAST(p[2] AS DOUBLE) < CAST(p[1] AS DOUBLE) OR CAST(p[2] AS DOUBLE) > 3.5)) AS INTEGER) AS invalid FROM a""")
over("normalised_answers__STR03_STR04", lambda v: v.select("doc_id", tags.normalised_answer(tags.answer(R())).alias("norm"), tags.qa_normalised(F.regexp_replace(R(), "[^ -~]", "")).alias("qa")),
    rf" SELECT doc_id, {NORM.format(ANS)} AS norm, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(response, '[^ -~]', '', 'g')), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS qa FROM v")
over("structure__FLT17", lambda v: v.select("doc_id", tags.has_think(R()).alias("think"), tags.has_answer(R()).alias("answer"), tags.opens_think(R()).alias("opens"), tags.structured(R()).alias("structured"), (tags.n_segments(R()) > 0).alias("seg")),
    rf""" SELECT doc_id, regexp_matches(response, '(?s)<think>(.*?)</think>') AS think, regexp_matches(response, '(?s)<answer>(.*?)</answer>') AS answer, contains(response, '<think>') AS opens,
    regexp_matches(response, '(?s)^\s*<think>(.*?)</think>\s*<answer>(.*?)</answer>\s*$') AND regexp_matches(regexp_extract(response, '(?s)^\s*<think>(.*?)</think>\s*<answer>(.*?)</answer>\s*$', 1), '{SEG}')
      AND trim(regexp_extract(response, '(?s)^\s*<think>(.*?)</think>\s*<answer>(.*?)</answer>\s*$', 2), E' \t\n\r') <> '' AS structured, regexp_matches(response, '{SEG}') AS seg FROM v""")  # fmt: skip
CONS = r"least(round(len(list_filter(string_split(response, '</seg>')[2:], lambda x: regexp_matches(x, '^\s*(\p{Lu}|<)'))) * 0.1, 1), 0.5)"
over("total_reward__RWD01_RWD02_RWD03_RWD04_RWD05", lambda v: v.select("doc_id", rewards.total(R(), G(), F.col("logprob")).alias("t")).select("doc_id", *[F.round(f"t.{c}", 8).alias(c) for c in ("format", "consistency", "accuracy", "segment", "total")]),
    rf""", c AS (SELECT doc_id, CASE WHEN regexp_matches(response, '(?s)<think>(.*?)</think>') THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(response, '(?s)<answer>(.*?)</answer>') THEN 0.25 ELSE 0 END AS f, -{CONS} AS k,
    CASE WHEN {ANS} = '' THEN 0 WHEN logprob IS NULL THEN CASE WHEN {RIGHT} THEN 0.5 ELSE 0 END WHEN {RIGHT} THEN 0.5 * (1 - pow(least(1, exp(logprob)) - 1, 2)) ELSE -0.5 * pow(least(1, exp(logprob)), 2) END AS a,
    CASE WHEN {RIGHT} AND regexp_matches(response, '{SEG}') THEN 0.5 ELSE 0 END AS s FROM v)
    SELECT doc_id, CAST(f AS DOUBLE) AS format, round(CAST(k AS DOUBLE), 8) + 0.0 AS consistency, round(CAST(a AS DOUBLE), 8) AS accuracy, CAST(s AS DOUBLE) AS segment, round(CAST(f + k + a + s AS DOUBLE), 8) AS total FROM c""")  # fmt: skip
over("consistency_positive__RWD02", lambda v: v.select("doc_id", F.round(rewards.score_consistency(R(), positive=True), 8).alias("score")), f" SELECT doc_id, round(CAST(0.5 - {CONS} AS DOUBLE), 8) AS score FROM v")
AV = r"<seg>([\d.]+,\s*[\d.]+)</seg>(.?)[^<]?"
over("audio_qa__RWD06_AGG15", lambda v: v.select("doc_id", *[rewards.audio_qa(R(), G(), e).alias(f"e{e}") for e in ("1", "3", "11", "12", "0")]).select("doc_id", *[F.round(f"e{e}.score", 8).alias(f"score_{e}") for e in ("1", "3", "11", "12", "0")], F.col("e1.seg_count").alias("seg_count")),
    rf""", a AS (SELECT doc_id, gold, {ANS} AS ans, len(regexp_extract_all(response, '(?s)<think>(.*?)</think>')) = 1 AND len(regexp_extract_all(response, '(?s)<answer>(.*?)</answer>')) = 1 AS once,
      list_transform(regexp_extract_all(response, '{AV}', 1), lambda x: [CAST(split_part(replace(x, ' ', ''), ',', 1) AS DOUBLE), CAST(split_part(replace(x, ' ', ''), ',', 2) AS DOUBLE)]) AS p, least(5, len(list_filter(regexp_extract_all(response, '{AV}', 2), lambda x: regexp_matches(x, '^(\p{{Lu}}|<)')))) AS bad FROM v),
    i AS (SELECT doc_id, q[1] AS s, q[2] AS e FROM (SELECT doc_id, unnest(p) AS q FROM a)), m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i),
    u AS (SELECT doc_id, sum(e - s) AS tot, sum(CASE WHEN r IS NULL OR s > r THEN e - s ELSE greatest(e - r, 0) END) AS uni FROM m GROUP BY 1),
    b AS (SELECT doc_id, len(p) AS n, CASE WHEN once THEN 0.5 ELSE 0 END AS f, CASE WHEN once AND ans = gold THEN 0.5 ELSE 0 END AS acc, -bad / 10 AS k, CASE WHEN tot > 0 THEN 0.5 * uni / tot ELSE 0 END AS o FROM a LEFT JOIN u USING (doc_id))
    SELECT doc_id, round(f + acc + k, 8) AS score_1, round(f + acc + k + CASE WHEN n > 0 THEN acc ELSE 0 END, 8) AS score_3, round(f + acc + k + o + acc * least(n, 2) / 2, 8) AS score_11, round(f + acc + k + o + acc * least(n, 3) / 3, 8) AS score_12, CAST(f + acc AS DOUBLE) AS score_0, CAST(n AS INTEGER) AS seg_count FROM b""")  # fmt: skip
over("whole_formats__RWD13", lambda v: v.select("doc_id", rewards.whole_format(R()).alias("whole"), rewards.react_format(F.concat(R(), F.lit(" Action: x Action Input: y"))).alias("react")),
    r" SELECT doc_id, CASE WHEN regexp_matches(response, '(?s)^<think>.*?</think>\s*<answer>.*?</answer>\z') THEN 1.0::DOUBLE ELSE 0.0 END AS whole, CASE WHEN regexp_matches(response || ' Action: x Action Input: y', '(?s)^<think>.*?</think>\s*Action:.*?Action Input:.*$') THEN 1.0::DOUBLE ELSE 0.0 END AS react FROM v")
over("answer_exact_match__RWD09", lambda v: v.select("doc_id", rewards.exact_match(R(), F.array(G(), F.lit("the maybe"))).alias("em"), rewards.exact_match(R(), F.array(G(), F.lit("secon")), part=True).alias("sub")),
    r""", a AS (SELECT doc_id, gold, list_transform(regexp_extract_all(response, '(?s)<answer>(.*?)</answer>', 1), lambda x: trim(x, E' \t\n\r'))[-1] AS l FROM v),
    n AS (SELECT doc_id, l, trim(regexp_replace(regexp_replace(regexp_replace(lower(l), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS s, trim(regexp_replace(regexp_replace(lower(gold), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')) AS g FROM a)
    SELECT doc_id, CASE WHEN l IS NOT NULL AND s IN (g, 'maybe') THEN 1.0::DOUBLE ELSE 0.0 END AS em, CASE WHEN l IS NOT NULL AND (contains(s, g) OR contains(s, 'secon')) THEN 1.0::DOUBLE ELSE 0.0 END AS sub FROM n""")  # fmt: skip
CH = lambda: F.array(F.lit("0.7"), F.lit("No"), F.lit("2 seconds"), F.lit("maybe not"))
over("choice_matches__RWD16_RWD17_FLT18", lambda v: v.select("doc_id", rewards.token_match(tags.answer(R()), G(), CH()).alias("tokens"), rewards.first_contained(R(), CH()).alias("fallback"), F.array_contains(CH(), tags.answer(R())).alias("exact"), F.array_contains(F.transform(CH(), F.lower), F.lower(tags.answer(R()))).alias("lower"), F.array_contains(F.transform(CH(), lambda c: F.rtrim(F.lower(c), F.lit("."))), F.rtrim(F.lower(tags.answer(R())), F.lit("."))).alias("loose")),
    rf""", a AS (SELECT doc_id, response, gold, {ANS} AS p, ['0.7', 'No', '2 seconds', 'maybe not'] AS ch FROM v), w AS (SELECT *, list_distinct(regexp_extract_all(lower(p), '\b\w+\b')) AS pw, list_distinct(regexp_extract_all(lower(gold), '\b\w+\b')) AS gw, list_distinct(flatten(list_transform(list_filter(ch, lambda c: c <> gold), lambda c: regexp_extract_all(lower(c), '\b\w+\b')))) AS ww FROM a)
    SELECT doc_id, len(pw) > 0 AND list_has_all(pw, gw) AND NOT list_has_any(list_filter(ww, lambda x: NOT list_contains(gw, x)), pw) AS tokens, coalesce(list_filter(ch, lambda c: contains(response, c))[1], ch[1]) AS fallback, list_contains(ch, p) AS exact,
    list_contains(list_transform(ch, lambda c: lower(c)), lower(p)) AS lower, list_contains(list_transform(ch, lambda c: rtrim(lower(c), '.')), rtrim(lower(p), '.')) AS loose FROM w""")  # fmt: skip
NUM = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(text, ' #### 1,2', CAST(doc_id % 10 AS STRING), '4 .') WHEN doc_id % 3 = 1 THEN concat('x ', CAST(doc_id % 7 AS STRING), '.5 then .') ELSE 'none' END AS t, CAST(doc_id % 10 * 10 + 1204 AS STRING) AS gold FROM {documents}"
simple("final_numbers__RWD08_DSP34", NUM, lambda v: v.select("doc_id", rewards.final_number(F.col("t")).alias("strict"), rewards.final_number(F.col("t"), strict=False).alias("flexible"), rewards.matches(rewards.final_number(F.col("t")), F.col("gold")).alias("score")),
    r""", a AS (SELECT doc_id, gold, replace(nullif(regexp_extract(t, '#### (-?[0-9.,]+)', 1), ''), ',', '') AS strict, regexp_extract_all(t, '-?[0-9.,]+') AS n FROM v) SELECT doc_id, strict, coalesce(list_filter(n, lambda x: x <> '.')[-1], n[-1]) AS flexible, CASE WHEN strict = gold THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM a""")  # fmt: skip
over("length_rewards__MTH05_RWD13", lambda v: v.select("doc_id", F.round(rewards.cosine_length(F.length(R()), rewards.correct(R(), G())), 8).alias("cosine"), F.round(rewards.soft_overlong(F.length(R()), 150, 50), 8).alias("overlong"), F.round(rewards.repetition_penalty(F.concat_ws(" ", F.col("lang"), F.col("lang"), F.col("lang"), F.col("lang"), R())), 8).alias("repetition")),
    rf""", w AS (SELECT *, list_filter(regexp_split_to_array(lower(concat_ws(' ', lang, lang, lang, lang, response)), '\s+'), lambda x: x <> '') AS w, {RIGHT} AS ok FROM v), g AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w)
    SELECT doc_id, round(CASE WHEN ok THEN 1.0 ELSE -0.5 END - (CASE WHEN ok THEN 1.0 ELSE -0.5 END - CASE WHEN ok THEN 0.5 ELSE 0 END) * (1 - cos(length(response) * pi() / 1000)) / 2, 8) AS cosine, round(least(-(length(response) - 100) / 50, 0), 8) AS overlong, round(-(1 - len(list_distinct(g)) / len(g)), 8) + 0.0 AS repetition FROM g""")  # fmt: skip
KK = """SELECT doc_id, concat('<think></think><answer>Ann is a ', CASE WHEN doc_id % 2 = 0 THEN 'knight' ELSE 'knave' END, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '. Bob is a Knave' END, '</answer>', CASE WHEN doc_id % 7 = 0 THEN '<answer>' ELSE '' END) AS response FROM {documents}"""
simple("knights_knaves__RWD12", KK, lambda v: v.select("doc_id", rewards.knights(R(), F.array(F.struct(F.lit("Ann").alias("name"), F.lit("knight").alias("role")), F.struct(F.lit("Bob").alias("name"), F.lit("knave").alias("role")))).alias("score")),
    " SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN -3.0::DOUBLE WHEN doc_id % 5 = 0 THEN -1.0 WHEN doc_id % 2 = 0 THEN 3.0 ELSE -0.5 END AS score FROM v")
YN = "SELECT doc_id, concat(CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN '是' ELSE '否' END, CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' because' END) AS response, CASE WHEN doc_id % 3 = 0 THEN '否' ELSE '是' END AS gold FROM {documents}"
simple("verdicts__RWD12", YN, lambda v: v.select("doc_id", rewards.verdict(R(), G()).alias("score"), rewards.verdict_f1(F.substring(R(), 1, 1), G()).alias("f1")),
    r" SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 5 = 0 THEN -3.0::DOUBLE WHEN left(response, 1) = gold THEN 3.0 ELSE -0.5 END AS score, CASE WHEN left(response, 1) = '是' AND gold = '是' THEN 1.0::DOUBLE ELSE 0.0 END AS f1 FROM v")
over("dispatched_scores__RWD07_RWD15_RWD18", lambda v: v.select("doc_id", rewards.dispatched(F.col("lang"), {"en": rewards.score_format(R()), "de": rewards.whole_format(R()), "fr": rewards.score_accuracy(R(), G()), "es": rewards.score_segment(R(), G())}).alias("score")),
    rf""" SELECT doc_id, CAST(CASE lang WHEN 'en' THEN CASE WHEN regexp_matches(response, '(?s)<think>(.*?)</think>') THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(response, '(?s)<answer>(.*?)</answer>') THEN 0.25 ELSE 0 END WHEN 'de' THEN CASE WHEN regexp_matches(response, '(?s)^<think>.*?</think>\s*<answer>.*?</answer>\z') THEN 1 ELSE 0 END
    WHEN 'fr' THEN CASE WHEN {RIGHT} THEN 0.5 ELSE 0 END WHEN 'es' THEN CASE WHEN {RIGHT} AND regexp_matches(response, '{SEG}') THEN 0.5 ELSE 0 END END AS DOUBLE) AS score FROM v""")  # fmt: skip
