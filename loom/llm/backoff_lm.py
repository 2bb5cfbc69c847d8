"""Stupid-backoff scores of every document under the n-gram counts of the corpus, by default of all other documents.

Counts cover the whole corpus; a document's own occurrences are taken off before it is scored, so
that no text is likely because it is itself counted.

The tables are those of the relational plan, in packed rows: a row stands for the n-grams of a block
of documents in one hash bucket.

1. Documents are dealt into blocks.  A block's n-grams (all orders) are counted once each, sorted by
   hash, and leave as one row per bucket of the hash: the grams pre-aggregated and delta-coded.
2. The n-gram count table is partitioned by that hash: a bucket's rows from all blocks are added up.
   Each block's grams are joined to it, and their totals go back in the block's order.
3. Blocks meet their totals again, and each document's words are scored and summed.

Grams hot in the corpus are one entry per block, so buckets stay even.  Blocks and buckets both grow
with the square root of a large corpus, so that the packed rows, one per block and bucket, grow with
the corpus and not with its square, and each exchange has a partition per block or bucket.

A gram is known by its bucket and LOW bits of its hash.  With BUCKET_ENTRIES grams in a bucket one of
6 million shares its count with another one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loom.llm.common import n_words, table
from loom.llm.exact_dedup import LOWER, UPPER
from loom.llm.sketch import ODD, U, WordHasher, mix

ORDER, ALPHA = 3, 0.4
#: Words in a block, and gram entries in a bucket, about and at least; and beyond that, of the square root of all words.
BLOCK_WORDS, BUCKET_ENTRIES, ROOT = 1_000_000, 3_000_000, 5
#: Bits of a gram's hash that are kept within its bucket; the bucket's number holds the bits above.
LOW = 44


def packed(sorted_values: np.ndarray) -> bytes:
    """Differences of sorted values in 32 bits, those of 2**32 - 1 and more apart."""
    d = np.diff(sorted_values, prepend=U(0))
    over = d >= U(2**32 - 1)
    return np.minimum(d, U(2**32 - 1)).astype("<u4").tobytes() + d[over].astype("<u8").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    d = np.frombuffer(data, "<u4", n).astype(np.uint64)
    over = d == U(2**32 - 1)
    d[over] = np.frombuffer(data, "<u8", offset=4 * n)
    return np.cumsum(d, dtype=np.uint64)


def small_ints(x: np.ndarray) -> bytes:
    """Counts as bytes, those of 255 and more apart."""
    over = x >= 255
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[over].astype("<u8").tobytes()


def from_small_ints(data: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8, n).astype(np.int64)
    x[x == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return x


class Grams:
    """The n-grams of a block's documents, in order; equal whenever the same documents are given."""

    def __init__(self, texts: list[bytes | None], buckets: int) -> None:
        words, doc, hasher = [], [], WordHasher()
        for k, t in enumerate(texts):
            w, _ = hasher(np.frombuffer(t or b"", np.uint8))
            words.append(w)
            doc.append(np.full(len(w), k))
        self.words = np.concatenate([*words, np.zeros(0, np.uint64)])
        self.doc = np.concatenate([*doc, np.zeros(0, np.int64)]).astype(np.int64)
        values, places = [], []
        for order in range(1, ORDER + 1):
            h = self.words * ODD[1]
            for k in range(1, order):
                h[k:] = h[k:] + mix(self.words[:-k] * ODD[1 + k])
            h = mix(h + U(order * int(ODD[7]) % 2**64))
            inside = np.ones(len(h), bool)
            inside[: order - 1] = False
            inside[order - 1 :] &= self.doc[order - 1 :] == self.doc[: len(h) - order + 1]
            # bucket above, LOW bits below: the values sort by bucket
            h = h[inside]
            values.append(((h >> U(64 - LOW)) % U(buckets) << U(LOW)) | (h & U(2**LOW - 1)))
            places.append(np.flatnonzero(inside))
        # grams of all orders in one table: sorted values and counts
        self.values, index, self.counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        self.of = []  # per order: gram index by position of its last word, -1 where a document has none
        for order, at in enumerate(places):
            self.of.append(np.full(len(self.words), -1))
            self.of[order][at] = index[: len(at)]
            index = index[len(at) :]

    def own(self, order: int) -> np.ndarray:
        """Per position: how often its document has the gram that ends there."""
        at = self.of[order - 1]
        out, ok = np.zeros(len(at), np.int64), at >= 0
        _, index, counts = np.unique(self.doc[ok] * (len(self.values) + 1) + at[ok], return_inverse=True, return_counts=True)
        out[ok] = counts[index]
        return out


def _counted(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        rows = []
        block = group.column("block")[0].as_py()
        grams = Grams(_sorted(group).column("text").cast(pa.large_binary()).to_pylist(), buckets)
        bucket = grams.values >> U(LOW)
        cuts = np.flatnonzero(np.diff(bucket, prepend=~U(0)))
        for a, b in zip(cuts, [*cuts[1:], len(bucket)][: len(cuts)], strict=True):
            rows.append((int(bucket[a]), block, int(b - a), packed(grams.values[a:b] & U(2**LOW - 1)), small_ints(grams.counts[a:b])))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["bucket", "block", "n", "grams", "counts"])

    return run


def _sorted(group: pa.Table) -> pa.Table:
    """In an order that both passes share."""
    return group.sort_by([("row", "ascending")])


def _totals(group: pa.Table) -> pa.Table:
    """Of one bucket: each block's grams with their counts over all blocks."""
    n = group.column("n").to_pylist()
    values = [unpacked(x, k) for x, k in zip(group.column("grams").to_pylist(), n, strict=True)]
    counts = np.concatenate([from_small_ints(x, k) for x, k in zip(group.column("counts").to_pylist(), n, strict=True)])
    _, index = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(index, weights=counts).astype(np.int64)[index]
    ends = np.cumsum([0, *n])
    packed_ = [small_ints(total[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.table([group.column("block"), group.column("bucket"), group.column("n"), pa.array(packed_, pa.binary())], names=["block", "bucket", "n", "totals"])


def _scored(buckets: int, words: int, alpha: float, unseen: float, without_own: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _sorted(docs) if docs.num_rows else docs
        ids = docs.column("doc_id").combine_chunks() if docs.num_rows else pa.array([], pa.int64())
        grams = Grams(docs.column("text").cast(pa.large_binary()).to_pylist() if docs.num_rows else [], buckets)
        answers = answers.sort_by([("bucket", "ascending")]) if answers.num_rows else answers
        found = [from_small_ints(data, n) for n, data in zip(*(answers.column(c).to_pylist() for c in ("n", "totals")), strict=True)]
        total = np.concatenate([*found, np.zeros(0, np.int64)])
        if len(total) != len(grams.values):
            raise ValueError("a block's totals are not those of its grams")
        own_words = np.bincount(grams.doc, minlength=len(ids))
        others = np.maximum(words - own_words * without_own, 1)[grams.doc].astype(float)
        # per order and position: the occurrences that count
        rest = [np.where(at >= 0, (total[at] if len(total) else 0) - (grams.own(k) if without_own else 0), 0) for k, at in enumerate(grams.of, 1)]
        score = np.where(rest[0] > 0, rest[0], unseen) / others
        for order in range(2, ORDER + 1):
            context = np.concatenate((np.zeros(1, np.int64), rest[order - 2][:-1])) if len(score) else score
            seen = rest[order - 1] > 0
            possible = grams.of[order - 1] >= 0
            score = np.where(seen, rest[order - 1] / np.maximum(context, 1), np.where(possible, alpha * score, score))
        total = np.bincount(grams.doc, weights=np.log(score), minlength=len(ids)) if len(ids) else np.zeros(0)
        return pa.table([ids, pa.array(own_words, pa.int64()), pa.array(total, pa.float64())], names=["doc_id", "n_words", "log_score"])

    return run


def backoff_scores(docs: DataFrame, alpha: float = ALPHA, unseen: float = 0.5, without_own: bool = True) -> DataFrame:
    """doc_id, n_words, log_score (natural, summed over words), mean_score for each row of docs.

    A word's score is count(gram) / count(context) for the longest of the three-, two- and one-word
    grams that other documents have, times alpha per step back; a word of no other document counts as
    ``unseen`` occurrences.  Not without_own: a document's own occurrences count as well, as in the plain
    method.  Words are A-Z lower-cased.  Texts without words (null, empty) score 0 with a null mean.
    Rows are documents by themselves, so a repeated row is another document; other columns are
    ignored; no rows give no rows.  Texts are dealt once: both passes read the same exchange, by the
    numbers that the scan gave their rows.  Should a part of it be lost and be made anew from an input
    that is no plain scan and numbers its rows otherwise, a block whose grams are not those that were
    counted is an error, not a wrong score; give such an input as a table.
    """
    row = F.monotonically_increasing_id()
    words, rows = docs.agg(F.coalesce(F.sum(n_words(F.col("text"))), F.lit(0)), F.count("*")).first()
    block_words = max(BLOCK_WORDS, int(ROOT * math.sqrt(words)))
    blocks = max(1, -(-words // block_words), rows // 50_000)
    buckets = max(1, -(-words * 2 // max(BUCKET_ENTRIES, int(2 * ROOT * math.sqrt(words)))))
    dealt = docs.select("doc_id", "text", row.alias("row")).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).repartition(blocks, "block")
    grams = dealt.groupBy("block").applyInArrow(_counted(buckets), "bucket long, block long, n long, grams binary, counts binary")
    totals = grams.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_totals, "block long, bucket long, n long, totals binary")
    scores = dealt.groupBy("block").cogroup(totals.repartition(blocks, "block").groupBy("block")).applyInArrow(_scored(buckets, words, alpha, unseen, without_own), "doc_id long, n_words long, log_score double")
    return scores.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op6_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, log_score (four decimals), mean_score (eight) for every document, against all others."""
    found = backoff_scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_score", 8).alias("mean_score"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, i, CASE WHEN i > 2 THEN w[i - 2] END AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, w[i] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
o1 AS (SELECT doc_id, c, count(*) AS k FROM p GROUP BY ALL), t1 AS (SELECT c, sum(k) AS t FROM o1 GROUP BY 1), r1 AS (SELECT doc_id, c, t - k AS r FROM o1 JOIN t1 USING (c)),
o2 AS (SELECT doc_id, b, c, count(*) AS k FROM p WHERE i > 1 GROUP BY ALL), t2 AS (SELECT b, c, sum(k) AS t FROM o2 GROUP BY 1, 2), r2 AS (SELECT doc_id, b, c, t - k AS r FROM o2 JOIN t2 USING (b, c)),
o3 AS (SELECT doc_id, a, b, c, count(*) AS k FROM p WHERE i > 2 GROUP BY ALL), t3 AS (SELECT a, b, c, sum(k) AS t FROM o3 GROUP BY 1, 2, 3), r3 AS (SELECT doc_id, a, b, c, t - k AS r FROM o3 JOIN t3 USING (a, b, c)),
q AS (SELECT p.doc_id, p.i, CASE WHEN u.r > 0 THEN u.r ELSE 0.5 END / greatest(1, (SELECT count(*) FROM p) - p.n) AS s1, CASE WHEN v.r > 0 THEN v.r / greatest(1, ub.r) END AS s2, CASE WHEN x.r > 0 THEN x.r / greatest(1, vc.r) END AS s3
  FROM p JOIN r1 u ON u.doc_id = p.doc_id AND u.c = p.c LEFT JOIN r1 ub ON ub.doc_id = p.doc_id AND ub.c = p.b LEFT JOIN r2 v ON v.doc_id = p.doc_id AND v.b = p.b AND v.c = p.c
  LEFT JOIN r2 vc ON vc.doc_id = p.doc_id AND vc.b = p.a AND vc.c = p.b LEFT JOIN r3 x ON x.doc_id = p.doc_id AND x.a = p.a AND x.b = p.b AND x.c = p.c),
s AS (SELECT doc_id, count(*) AS n, sum(ln(coalesce(s3, CASE WHEN i > 2 THEN {ALPHA} ELSE 1 END * coalesce(s2, CASE WHEN i > 1 THEN {ALPHA} ELSE 1 END * s1)))) AS l FROM q GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_words, round(coalesce(l, 0.0), 4) AS log_score, round(l / n, 8) AS mean_score FROM documents LEFT JOIN s USING (doc_id)
"""
