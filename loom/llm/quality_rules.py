"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Rules are per-text expressions.  The ratio compares two multinomials over hashed words and word
pairs: one of trusted texts, one of the whole raw corpus; a text's score is the mean over its
n-grams of log(trusted / raw), and texts that score below a threshold go.

The trusted texts that fix the multinomial are a bounded sample of labelled rows (``LABELLED``,
smallest hashes first); the raw counts cover all texts, and the threshold all labelled ones.  Texts of
the sample are scored for it by counts without their fold, so none is scored by its own.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loom.llm.common import WORD, materialise, table

#: Hash buckets that words and word pairs share; a table of ratios has so many numbers.
BUCKETS = 1 << 15
#: Labelled texts of either kind, at most.
LABELLED = 20_000
#: Folds of the sample; and so many labels are broadcast at most, more are joined by a shuffle.
FOLDS, BROADCAST_LABELS = 5, 1_000_000
#: Positions that fit beside a hash's upper bits; longer texts are sorted as pairs.
INDEX_BITS = 20
#: Decimals of a ratio.
DIGITS = 4
SYMBOLS = "[#*$%&|<>]"


def _word_hashes(docs: DataFrame) -> DataFrame:
    """Adds words (strings) and w (their hashes) to rows with a text; null counts as empty."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    return docs.withColumn("words", words).withColumn("w", F.transform("words", lambda x: F.xxhash64(x)))


def _after(n: int) -> Column:
    """w from its n-th place on."""
    return F.slice("w", n + 1, F.greatest(F.size("w") - n, F.lit(0)))


def _pairs() -> Column:
    """Hashes of neighbouring words, in order: the words' own ones, shifted apart and combined."""
    return F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), _after(1), lambda a, b: F.shiftleft(a, 1).bitwiseXOR(b))


def _triples() -> Column:
    """The same of three words in a row; two runs of words share one by chance in 2 ** 62."""
    return F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), _after(2), lambda p, c: F.shiftleft(p, 1).bitwiseXOR(c))


def _repeated_positions(grams: Column) -> Column:
    """Sorted positions of the grams that occur twice or more.

    Equal grams are neighbours after sorting.  Position and upper hash bits are packed in one long,
    which sorts as a primitive; neighbours are compared by their full hashes.
    """
    mask = (1 << INDEX_BITS) - 1
    packed = F.sort_array(F.transform(grams, lambda g, i: g.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint"))))
    at = lambda p: p.bitwiseAND(F.lit(mask)).cast("int")

    def same(a: Column, b: Column) -> Column:
        return F.when((a.bitwiseXOR(b).between(0, mask)) & (F.get(grams, at(a)) == F.get(grams, at(b))), F.array(at(a), at(b)))

    short = F.zip_with(packed, F.slice(packed, 2, F.size(packed)), same)
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    long = F.zip_with(pairs, F.slice(pairs, 2, F.size(pairs)), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    some = F.when(F.size(grams) <= mask, short).otherwise(long)
    return F.sort_array(F.array_distinct(F.flatten(F.filter(some, lambda x: x.isNotNull()))))


def rules(docs: DataFrame, keep: str = "doc_id") -> DataFrame:
    """The ``keep`` column, w, p (hashes of words and of pairs) and the rules' columns for rows with a text."""
    text, none = F.coalesce("text", F.lit("")), F.lit("")
    worded = _word_hashes(docs.select(keep, "text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counted = worded.select(
        keep, "w", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"), _pairs().alias("p"),
    )
    counted = counted.withColumn("g3", _triples())
    counted = counted.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    again = F.when(F.size(F.array_distinct("g3")) < F.size("g3"), _repeated_positions(F.col("g3"))).otherwise(F.array().cast("array<int>"))
    counted = counted.withColumn("again", again)
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate("again", start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")), lambda s: s["n"])
    counted = counted.withColumn("n_repeat_words", covered)
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return counted.select(keep, "w", "p", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def _bucket(h: Column) -> Column:
    """The hash's last bits; BUCKETS is a power of two."""
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _ratios(counts: DataFrame) -> DataFrame:
    """(fold, ratios): a table for each fold left out, and one (FOLDS) of all folds; ratios by bucket, add-one smoothed.

    One row a table: it is broadcast, and neither comes to the driver's Python nor stands in a plan.
    """
    folds = [F.coalesce(f"f{k}", F.lit(0)) for k in range(FOLDS)]
    every = counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    every = every.select("bucket", (F.coalesce("raw", F.lit(0)) + 1).alias("raw"), F.array(*folds).alias("folds"), F.explode(F.sequence(F.lit(0), F.lit(FOLDS))).alias("fold"))
    others = F.aggregate("folds", F.lit(1).cast("long"), lambda s, n: s + n) - F.coalesce(F.get("folds", F.col("fold")), F.lit(0))
    cells = F.sort_array(F.collect_list(F.struct("bucket", "raw", "trusted")))
    tables = every.withColumn("trusted", others).groupBy("fold").agg(cells.alias("cells"), F.sum("raw").alias("r"), F.sum("trusted").alias("t"))
    ratio = lambda c: F.when(F.col("t") > BUCKETS, F.round(F.log(c["trusted"] / F.col("t")) - F.log(c["raw"] / F.col("r")), DIGITS)).otherwise(0.0)
    return tables.select("fold", F.transform("cells", ratio).alias("ratios"))


def _mean(ratios: Column) -> Column:
    """The mean ratio over w and p."""
    total = F.aggregate(F.concat("w", "p"), F.lit(0.0), lambda s, h: s + F.get(ratios, _bucket(h)))
    return total / F.nullif(F.size("w") + F.size("p"), F.lit(0))


class LikelihoodRatio:
    """log(trusted / raw) by bucket, and the threshold; fitted by one pass over all texts and one over the labelled."""

    def __init__(self, docs: DataFrame, labels: DataFrame, keep: float = 0.999) -> None:
        """keep: the share of trusted texts that the threshold keeps at least; labels: doc_id, quality, toxic."""
        quality = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        trusted_label = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
        stated = quality.select("doc_id", F.when(trusted_label, 1).when(F.col("quality") == 0, 0).alias("good")).where("good IS NOT NULL")
        every = materialise(stated.groupBy("doc_id").agg(F.min("good").alias("good")), "labels")
        sample = every.where("good = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
        known = materialise(sample.select("doc_id", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "sample")
        marked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left")
        grams = _word_hashes(marked).select("fold", F.explode(F.concat("w", _pairs())).alias("h")).select("fold", _bucket(F.col("h")).alias("bucket"))
        folds = [F.count_if(F.col("fold") == k).alias(f"f{k}") for k in range(FOLDS)]
        counts = materialise(grams.groupBy("bucket").agg(F.count("*").alias("raw"), *folds), "counts")
        self.tables = materialise(_ratios(counts), "ratios")
        # all labelled rows, written once as scores: two statistics are drawn from them
        labelled = every.join(F.broadcast(known), "doc_id", "left").select("doc_id", "good", F.coalesce("fold", F.lit(FOLDS)).alias("fold"))
        if labelled.count() <= BROADCAST_LABELS:
            labelled = F.broadcast(labelled)
        scored = _word_hashes(docs.select("doc_id", "text").join(labelled, "doc_id")).where(F.size("w") >= 50).withColumn("p", _pairs())
        scored = materialise(scored.select("good", "fold", "w", "p").join(F.broadcast(self.tables), "fold").select("good", _mean(F.col("ratios")).alias("score")), "scores")
        of = lambda good, q: F.percentile_approx(F.when(F.col("good") == good, F.col("score")), q, 1_000_000)
        low, middle, tail = scored.agg(F.min(F.when(F.col("good") == 1, F.col("score"))), of(0, 0.5), of(1, 1 - keep)).first()
        self.found = (low, tail, middle)
        #: Halfway between the low end of trusted texts and the middle of rejected ones; never above that low end.
        self.threshold = -math.inf if tail is None or middle is None else min(tail, (tail + middle) / 2)

    def _table(self) -> DataFrame:
        return self.tables.where(F.col("fold") == FOLDS).select("ratios")

    def score(self) -> Column:
        """Of rows with w and p; null for texts without words.  Its table is a literal, 230 KB wherever a plan is kept."""
        return _mean(F.from_json(F.lit(json.dumps(self._table().first().ratios)), "array<double>"))

    def scored(self, rows: DataFrame) -> DataFrame:
        """Adds score as llr, by a broadcast of its table."""
        return rows.crossJoin(F.broadcast(self._table())).withColumn("llr", _mean(F.col("ratios"))).drop("ratios")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row's doc_id, rules and verdict.

    Rows are judged one by one, so repeated rows and null doc_ids are fine; null and empty texts have
    no words and fail.  Without labelled rows the ratio rejects nothing.  Other columns are ignored.
    """
    rows = _verdicts(docs, LikelihoodRatio(docs, labels), "doc_id")
    # as generated columns, for a caller's filter on a verdict would be pushed below the projections and computed anew
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("r")).select("r.*")


def _verdicts(docs: DataFrame, model: LikelihoodRatio, keep: str) -> DataFrame:
    kept = ~F.col("base_failed") & (F.coalesce("llr", F.lit(0.0)) >= F.lit(model.threshold))
    return model.scored(rules(docs, keep)).withColumn("kept", kept).drop("w", "p")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    judged_rows = _verdicts(packed, LikelihoodRatio(docs, labels), "doc")
    # a filter would be pushed below the projections, each of which would then be computed again for it
    passed = judged_rows.select(F.explode(F.when(F.col("kept"), F.array("doc"))).alias("doc"))
    return passed.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
