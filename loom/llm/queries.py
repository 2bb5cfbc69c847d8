"""The queries of this subpackage by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import functions as F

from loom.llm.whitening import WHITENED_ROWS_SQL

#: name: (module, function, SQL constant or None)
_NAMES = {
    "op1_source_mix": ("source_mix", "op1_source_mix", None),
    "op2_sentencepiece": ("pieces", "op2_sentencepiece", None),
    "op3_token_counts": ("token_scan", "op3_token_counts", None),
    "op4_near_dedup": ("near_dedup", "op4_near_dedup", "OP4_SQL"),
    "op5_secret_scan": ("secret_scan", "op5_secret_scan", None),
    "op6_backoff_scores": ("backoff_lm", "op6_backoff_scores", "OP6_SQL"),
    "op7_personal_data": ("personal_data", "op7_personal_data", None),
    "op8_sharding": ("sharding", "op8_sharding", None),
    "op9_quality_rules": ("quality_rules", "op9_quality_rules", None),
    "op10_exact_dedup": ("exact_dedup", "op10_exact_dedup", "OP10_SQL"),
    "op11_line_dedup": ("line_dedup", "op11_line_dedup", "OP11_SQL"),
    "op12_merkle_manifest": ("merkle", "op12_merkle_manifest", "OP12_SQL"),
    "op13_whitening": ("whitening", "op13_whitening", None),
}


def _columns(name: str, *columns: str):
    """The columns of an operator's query that SQL can express."""

    def run(spark, sf_dir):
        found = queries()[name](spark, sf_dir)
        return (found.withColumn("target_words", F.round("target").cast("long")) if "target" in found.columns else found).select(*columns)

    return run


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_FOUND = lambda pattern, group=0: f"regexp_extract_all(coalesce(text, ''), '{pattern}', {group})"
_DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"
#: Luhn's sum over the digits of x, every second from the right doubled.
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS.format('x')}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN 2 * c::INT > 9 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"
#: Queries over parts of results, so that SQL holds what it can: name: (query, columns, SQL).
_PARTS = {
    "mix_targets": ("op1_source_mix", ("doc_id", "size", "source_size", "target_words"), f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS n FROM documents), s AS (SELECT source, sum(n) AS size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, sum(w) OVER k AS wk, sum(3 * size) OVER k AS ck FROM s WINDOW k AS (ORDER BY 3 * size / w, source NULLS LAST)),
l AS (SELECT greatest(max((t - ck) / nullif(tw - wk, 0)), any_value(t / tw)) AS level FROM o, (SELECT sum(size) AS t, sum(w) AS tw FROM s))
SELECT doc_id, n AS size, CAST(size AS BIGINT) AS source_size, CAST(round(least(3 * size, w * level)) AS BIGINT) AS target_words FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l"""),
    "secret_counts": ("op5_secret_scan", ("doc_id", "n_assign", "n_access", "n_hex"), rf"""
SELECT doc_id, len(list_filter({_FOUND(r'(?i:(password|passwd|secret|token|api_?key)["'"''"']?\x20*[:=]\x20*["'"''"']?([A-Za-z0-9+/_.=-]+))', 2)}, lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter({_FOUND(r'AKIA[A-Z0-9]+')}, lambda x: length(x) >= 20)) AS n_access, len(list_filter({_FOUND(r'[0-9a-f]+')}, lambda x: length(x) >= 24)) AS n_hex FROM documents"""),
    "personal_counts": ("op7_personal_data", ("doc_id", "n_email", "n_ip", "n_card", "n_phone"), rf"""
SELECT doc_id, len({_FOUND(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')}) AS n_email, len(list_filter({_FOUND(r'[0-9]+(?:\.[0-9]+){3}')}, lambda x: list_max(list_transform(string_split(x, '.'), lambda q: CASE WHEN length(ltrim(q, '0')) > 3 THEN 999 ELSE q::INT END)) <= 255)) AS n_ip,
  len(list_filter({_FOUND(r'[0-9](?:[\x20-]?[0-9])+')}, lambda x: length({_DIGITS.format('x')}) BETWEEN 13 AND 19 AND {_LUHN})) AS n_card,
  len(list_filter({_FOUND(r'\+[0-9][\x20().0-9-]+[0-9]')}, lambda x: length({_DIGITS.format('x')}) BETWEEN 9 AND 15)) AS n_phone FROM documents"""),
    "whitened_rows": ("op13_whitening", ("vec_id", "component", "n", "deviation"), WHITENED_ROWS_SQL),
    "shard_row_sizes": ("op8_sharding", ("doc_id", "size", "law"), "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, 'bytes' AS law FROM documents"),
    "quality_rule_columns": ("op9_quality_rules", ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY 1)
SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)"""),
}


def queries() -> dict:
    found = {name: getattr(import_module(f"loom.llm.{module}"), function) for name, (module, function, _) in _NAMES.items()}
    return found | {name: _columns(of, *columns) for name, (of, columns, _) in _PARTS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"loom.llm.{module}"), sql) for name, (module, _, sql) in _NAMES.items() if sql} | {name: sql for name, (_, _, sql) in _PARTS.items()}
