"""Token counts of documents in flat, unindexed token files, by a separator scan.

A file is a run of big-endian 16-bit ids: per document its tokens, then one end-of-document id, and
nothing else that says where documents begin.  The scan cuts files of any size into blocks, reads each
by its byte range, finds the separators of a block in one vectorised comparison, and stitches the
documents that cross blocks with a scan over the blocks' first and last separators.

Files that ``write_tokens`` makes carry the doc_id as the first HEADER ids of each document, digits
in ids above the vocabulary, so that counts can be told by document without an index.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loom.llm.common import materialise, new_path, released, remove, small_batches, table

#: The end-of-document id: free in the 50k vocabulary, and its two bytes are the UTF-8 of one character,
#: so that the text sink can write it as its line separator.
END_ID, SEPARATOR = 0xC480, "Ā"
#: doc_ids are HEADER digits to base RADIX, written as ids from FIRST on; a missing doc_id is digits of RADIX.
HEADER, RADIX, FIRST = 5, 15_000, 0xC481
#: Ids in a block, blocks in a task, about, and documents in a file at most.
BLOCK_IDS, TASK_BLOCKS, FILE_DOCS = 1 << 20, 8, 100_000
#: Blocks that one task scans for their closing ends.
GROUP_BLOCKS = 1024
#: Characters tokenised at once, about; longer texts are cut before a single space between words, which no
#: token of these vocabularies holds but as its first character.
PIECE, CUT = 100_000, re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def _encoding(name: str):
    import public_tokenizers as P
    import tiktoken

    with open(P.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if max(ranks.values()) >= END_ID:
        raise ValueError(f"{name} has ids from {END_ID} on, which separate documents here")
    return tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts of about size characters that are tokenised alike apart and together."""
    at = 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def header(doc_id: int | None) -> list[int]:
    if doc_id is None:
        return [FIRST + RADIX] * HEADER
    x, out = doc_id + 2**63, []
    for _ in range(HEADER):
        x, digit = divmod(x, RADIX)
        out.append(FIRST + digit)
    return out[::-1]


def doc_id_of(ids: np.ndarray) -> int | None:
    x = 0
    for i in ids.tolist():
        if i - FIRST == RADIX:
            return None
        x = x * RADIX + i - FIRST
    return x - 2**63


def _tokens(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(name).encode_ordinary
        flat = lambda ids: np.array(ids, ">u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 500).columns)
                rows = [b"".join((flat(header(i)), *(flat(encode(p)) for p in parts(t or "")))) for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_multi_50k.tiktoken") -> None:
    """Writes docs' texts as flat token files; null and empty texts have no tokens but their header."""
    rows = small_batches(docs).select("doc_id", "text").mapInArrow(released(_tokens(tokenizer)), "ids binary")
    rows.select(F.col("ids").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", FILE_DOCS).text(path)


def read_range(path: str, start: int, size: int) -> bytes:
    """Bytes of a file on a shared disk, or in a store that pyarrow opens by its URI."""
    if path.startswith("file:"):
        with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as f:
            f.seek(start)
            return f.read(size)
    from pyarrow.fs import FileSystem

    store, name = FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return f.read_at(size, start)


def _scan(end_id: int, head: int, block: int):
    """Per block: documents that begin and end in it, the last one that begins in it, and its first separator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for batch in (rows.slice(i, 1) for i in range(rows.num_rows)):  # one block's ids at a time
                yield scanned(batch)

    def scanned(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], [], [], [], [], []]
        for path, k, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            size = min(block + head, total - k * block)
            ids = np.frombuffer(read_range(path, 2 * k * block, 2 * size), ">u2")
            if len(ids) != size:
                raise OSError(f"{path} is shorter than when it was listed")
            base, own = k * block, ids[:block]  # the head of a document that begins at the end is read beyond
            ends = np.flatnonzero(own == end_id)
            starts = ends + 1 if k else np.concatenate(([0], ends + 1))
            starts = starts[base + starts < total]  # no document begins at the end of the file
            whole = int(np.searchsorted(starts, ends[-1], "right")) if len(ends) else 0
            closing = ends[np.searchsorted(ends, starts[:whole])]
            docs = [doc_id_of(ids[s : s + head]) if head and s + head <= len(ids) else None for s in starts.tolist()]
            for x, v in zip(out, (path, k, total, docs[:whole], (base + starts[:whole]).tolist(), (closing - starts[:whole] - head).tolist(), docs[whole] if whole < len(starts) else None, base + int(starts[whole]) if whole < len(starts) else None, base + int(ends[0]) if len(ends) else None), strict=True):
                x.append(v)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())
        names = ("file", "block", "total", "docs", "starts", "counts", "open_doc", "open_start", "first_end")
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], list(names))

    return run


def token_counts(spark: SparkSession, path: str, end_id: int = END_ID, head: int = HEADER, block: int = BLOCK_IDS) -> DataFrame:
    """doc_id, n_tokens, file, start (of the document, in ids) for each document in a folder of token files.

    head: ids at a document's begin that are its doc_id and no tokens; 0 for files without them
    (doc_id is then null).  All files count whose names Spark does not take for hidden ones.  Empty
    documents count, an empty file has none.  What follows a file's last separator is a document that
    ends with the file; an odd byte at the end is no id.  Files are listed without their contents and
    read by ranges, so one file may fill many tasks.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.floor(F.col("length") / 2).cast("long").alias("total")).where("total > 0")
    last = F.floor((F.col("total") - 1) / block).cast("long")
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "total")
    tasks = -(-(files.agg(F.coalesce(F.sum(F.ceil(F.col("total") / block)), F.lit(0))).first()[0]) // TASK_BLOCKS)
    schema = "file string, block long, total long, docs array<long>, starts array<long>, counts array<long>, open_doc long, open_start long, first_end long"
    scanned = blocks.repartition(max(1, tasks), "path", "block").mapInArrow(_scan(end_id, head, block), schema)
    scanned = materialise(scanned, "token-blocks")
    inside = scanned.select("file", F.explode(F.arrays_zip("docs", "counts", "starts")).alias("d")).select("file", "d.docs", "d.counts", "d.starts")
    closed = closing_ends(scanned.select("file", "block", "total", "open_doc", "open_start", "first_end")).where("open_start IS NOT NULL")
    across = closed.select("file", F.col("open_doc").alias("docs"), F.greatest(F.col("close") - F.col("open_start") - head, F.lit(0)).alias("counts"), F.col("open_start").alias("starts"))
    rows = inside.unionByName(across)
    return rows.select(F.col("docs").alias("doc_id"), F.col("counts").alias("n_tokens"), F.regexp_extract("file", "[^/]*$", 0).alias("file"), F.col("starts").alias("start"))


def closing_ends(blocks: DataFrame) -> DataFrame:
    """Adds close: the first separator in a later block of the file, else the file's total.

    Blocks hold one narrow row each.  The scan runs backwards, within groups of ``GROUP_BLOCKS`` blocks
    and then over a file's groups, so a task sees one group, or one row per group of a file.
    """
    rows = blocks.withColumn("_g", F.floor(F.col("block") / GROUP_BLOCKS))
    later = lambda *keys: W.Window.partitionBy(*keys).rowsBetween(W.Window.unboundedPreceding, -1)
    groups = rows.groupBy("file", "_g").agg(F.min("first_end").alias("_first"))
    groups = groups.select("file", "_g", F.min("_first").over(later("file").orderBy(F.desc("_g"))).alias("_beyond"))
    near = F.min("first_end").over(later("file", "_g").orderBy(F.desc("block")))
    return rows.withColumn("_near", near).join(groups, ["file", "_g"]).withColumn("close", F.coalesce("_near", "_beyond", "total")).drop("_near", "_beyond", "_g")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in token files of all of ``documents``."""
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    found = token_counts(spark, path)
    remove(spark, path)  # the scan's blocks are a table by now
    return found
