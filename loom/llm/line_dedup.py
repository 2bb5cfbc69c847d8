"""Lines that many documents share: two Bloom filters find suspects, and only suspects are shuffled.

Hashes of line keys, eight bytes each and once per chunk of a task, go to shards of the filters by
their leading bits.  A shard's task passes them through two filters, one of hashes seen once and one
of hashes seen again; what leaves it are the words of the second.  Lines whose bits are all set there
are suspects: a word table joins them by broadcast while it is small (its count is checked), and by a
salted shuffle beyond that.  Suspects alone are shuffled, as digests, counted exactly and dropped
where the largest doc_id that holds them is another's.  The filters never miss a repeat, so the
result is exact; what they let through besides costs work only.  Lines are cut in Arrow functions, for
SQL's split makes each text a string of 16-bit characters first (measured: 114 CPU seconds a GB in place of 20).

Odd rows: a null text is one empty line, as an empty one is.  Rows of one doc_id are one document: they
count once, and all of them keep a line that stays.  Null doc_ids are together one document, the
smallest.  Columns of other names pass through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loom.llm.common import discard, materialise, released, small_batches, table, with_groups

#: Stripped at both ends of a line: the blank and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Of the filters: bits set per hash, hashes per 64-bit word on average (16 bits a hash).
PROBES, PER_WORD = 4, 4
#: Words of the second filter that are broadcast at most (16 bytes each); beyond that they are joined by a shuffle in SALTS parts.
BROADCAST_WORDS, SALTS = 1_000_000, 16
#: Hashes that a task gathers before it hands them on, each once.
CHUNK = 1 << 20


def _keys(text: str | None, least_chars: int) -> Iterator[tuple[int, bytes]]:
    """Place and key of each line long enough."""
    for pos, line in enumerate(text.split("\n") if text else ()):
        if len(line) >= least_chars and len(key := line.strip(BLANKS)) >= least_chars:
            yield pos, key.encode().lower()  # of bytes, lower() takes A-Z only


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(k, digest_size=8).digest() for k in keys]), np.uint64)


def _packed(shard_bits: int, least_chars: int):
    """Texts to rows of a shard: the hashes of its lines in this chunk, each once, and those of them that came again."""

    def rows(hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, n = np.unique(hashes, return_counts=True)
        ends = np.searchsorted(h >> np.uint64(64 - shard_bits), np.arange((1 << shard_bits) + 1, dtype=np.uint64))
        parts = [(int(s), h[ends[s] : ends[s + 1]], n[ends[s] : ends[s + 1]] > 1) for s in np.flatnonzero(np.diff(ends))]
        yield pa.RecordBatch.from_pydict({"shard": pa.array([s for s, _, _ in parts], pa.int32()), "n": pa.array([len(x) for _, x, _ in parts], pa.int64()), "seen": pa.array([x.tobytes() for _, x, _ in parts], pa.binary()), "again": pa.array([x[a].tobytes() for _, x, a in parts], pa.binary())})

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch["text"]:
                held.append(_hashes([key for _, key in _keys(text.as_py(), least_chars)]))
                size += len(held[-1])
            if size >= CHUNK:
                yield from rows(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from rows(np.concatenate(held))

    return run


def probes(h: np.ndarray, word_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's word (its leading bits) and the bits that it sets there (from its trailing ones)."""
    mask = np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return (h >> np.uint64(64 - word_bits)).astype(np.int64), mask


class FilterPair:
    """The words ``first`` to ``first + words`` of both Bloom filters."""

    def __init__(self, first: int, words: int, word_bits: int) -> None:
        self.first, self.word_bits = first, word_bits
        self.once, self.twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)

    def add(self, seen: np.ndarray, again: np.ndarray) -> None:
        """seen: different hashes; again: those of them that are repeats already."""
        word, mask = probes(seen, self.word_bits)
        word -= self.first
        met = (self.once[word] & mask) == mask
        np.bitwise_or.at(self.twice, word[met], mask[met])
        np.bitwise_or.at(self.once, word, mask)
        if len(again):
            word, mask = probes(again, self.word_bits)
            np.bitwise_or.at(self.twice, word - self.first, mask)


def _filtered(shard_bits: int, word_bits: int):
    """Rows of ``_packed`` to the words of the second filter that have bits set."""
    per_shard = 1 << (word_bits - shard_bits)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[int, FilterPair] = {}
        for batch in batches:
            for shard, seen, again in zip(batch["shard"].to_pylist(), batch["seen"], batch["again"], strict=True):
                if shard not in pairs:
                    pairs[shard] = FilterPair(shard * per_shard, per_shard, word_bits)
                pairs[shard].add(*(np.frombuffer(x.as_buffer(), np.uint64) for x in (seen, again)))
        for pair in pairs.values():
            at = np.flatnonzero(pair.twice)
            yield pa.RecordBatch.from_pydict({"word": at + pair.first, "bits": pair.twice[at].view(np.int64)})

    return run


def _kept_lines(least_chars: int, word_bits: int, words: Broadcast | None):
    """Texts to doc_id, tid, pos, digest of their lines, with word and mask; given words, only of those that they hold."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, text in enumerate(batch["text"]):
                found = list(_keys(text.as_py(), least_chars))
                word, mask = probes(_hashes([key for _, key in found]), word_bits)
                take = np.ones(len(found), bool)
                if words is not None and len(found):
                    known, bits = words.value
                    near = np.minimum(np.searchsorted(known, word), max(0, len(known) - 1))
                    take = (known[near] == word) & ((bits[near] & mask) == mask) if len(known) else ~take
                rows += [(at, found[i][0], hashlib.sha256(found[i][1]).digest(), int(word[i]), int(mask[i].view(np.int64))) for i in np.flatnonzero(take)]
            at, pos, digest, word, mask = zip(*rows, strict=True) if rows else [()] * 5
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), batch["tid"].take(at), pa.array(pos, pa.int32()), pa.array(digest, pa.binary()), pa.array(word, pa.int64()), pa.array(mask, pa.int64())], ["doc_id", "tid", "pos", "digest", "word", "mask"])

    return run


def _suspects(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, tid, pos, digest of every line whose hash the second filter holds, as a table."""
    spark = docs.sparkSession
    shard_bits = max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    packed = materialise(docs.select("text").mapInArrow(_packed(shard_bits, least_chars), "shard int, n long, seen binary, again binary"), "line-hashes")
    hashes = packed.agg(F.sum("n").alias("n")).first().n or 0
    word_bits = max(shard_bits, (max(1, hashes // PER_WORD) - 1).bit_length())
    dealt = packed.select("shard", "seen", "again").repartition(1 << shard_bits, "shard")
    words = materialise(dealt.mapInArrow(_filtered(shard_bits, word_bits), "word long, bits long"), "line-filter")
    texts = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, tid long, pos int, digest binary, word long, mask long"
    if words.count() <= BROADCAST_WORDS:
        known = words.toArrow().sort_by("word")
        held = spark.sparkContext.broadcast((known["word"].to_numpy(), known["bits"].to_numpy().view(np.uint64)))
        met = texts.mapInArrow(_kept_lines(least_chars, word_bits, held), schema)
    else:
        salted = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        lines = texts.mapInArrow(_kept_lines(least_chars, word_bits, None), schema).withColumn("salt", F.pmod(F.xxhash64("tid", "pos"), F.lit(SALTS)).cast("int"))
        met = lines.join(salted, ["word", "salt"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    found = materialise(met.select("doc_id", "tid", "pos", "digest"), "line-suspects")
    discard(packed, words)
    return found


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, tid, drops: per text that loses lines, their positions from 0; a table."""
    small_batches(docs)
    suspects = _suspects(docs.select("doc_id", "text"), least_chars)
    held = suspects.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    keys = held.groupBy("digest").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    keys = materialise(keys.where(F.col("docs") >= least_docs), "line-keys")
    gone = with_groups(suspects, keys, "digest", suspects.count()).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    drops = materialise(gone.groupBy("doc_id", "tid").agg(F.collect_set("pos").alias("drops")), "line-drops")
    discard(suspects, keys)
    return drops


def without_repeats(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with its text replaced by the lines that stay, and the columns n_lines and n_dropped.

    Lines with a key (blanks stripped at both ends, A-Z lower-cased) of ``least_chars`` code points or
    more that ``least_docs`` documents or more hold are dropped from all but the largest doc_id.  A
    text that loses all lines is empty.  Columns named n_lines or n_dropped are replaced.  Odd rows:
    see the module.
    """
    drops = repeated_lines(docs, least_chars, least_docs).select(F.col("doc_id").alias("_id"), F.col("tid").alias("_tid"), "drops")
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    lines = F.split(text, "\n", -1)
    joined = packed.join(drops, F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("doc.text") == F.col("_tid")), "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), text).otherwise(F.array_join(F.transform(stays, lambda i: F.get(lines, i)), "\n"))
    n_dropped = F.coalesce(F.size("drops"), F.lit(0))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return joined.select(*[(kept if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in names], n_lines.alias("n_lines"), F.when(F.col("drops").isNull(), 0).otherwise(n_dropped).cast("long").alias("n_dropped"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: lines before dropping, lines dropped, and the digest of what stays."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
m AS (SELECT doc_id, pos, line, r.keep_id IS NOT NULL AND r.keep_id <> doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
