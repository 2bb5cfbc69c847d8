"""Duplicates, n-grams, templates and repetition of a corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loom.functions import text as T
from loom.sources.files import written

#: Grams of up to so many rows are handed to every task to pick their texts out.
BROADCAST_GRAMS = 200_000
#: Words whose grams a task holds at a time, and documents for each cell that grams are dealt to by the first bits of their hashes.
BLOCK_WORDS, CELL_DOCS = 1_000_000, 500
_COUNTED, _TEXTS = "n int, c long, k long, g long", "n int, g long, text string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The words of documents, a block's worth at a time, and how many of its document there are from each on."""
    held: list[pa.Array] = []
    size = 0
    for batch in batches:
        lists, at = batch.column(0), 0
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        while at < len(lists):
            start = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + BLOCK_WORDS - size, "right")))
            held, size, at = [*held, lists.slice(at, to - at)], size + int(ends[to - 1] - start), to
            if size >= BLOCK_WORDS:
                yield _block(held)
                held, size = [], 0
    if size:
        yield _block(held)


def _block(held: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    lists = pa.concat_arrays(held)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    return words, np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))


def _hashes(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    known = b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in coded.dictionary.to_pylist())
    return np.frombuffer(known, "<u8")[coded.indices.to_numpy()]


def _grams(words: pa.Array, left: np.ndarray, sizes: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By size, the hashes of the runs of so many words, and where they begin.

    A run's hash is its first words' turned by seven bits and the last word's hash over it, so each
    size costs one pass over the one below.  The last bits hold the place of the size in ``sizes``.
    """
    if min(sizes) < 2:
        raise ValueError("sizes are 2 or more")
    bits = (len(sizes) - 1).bit_length()
    w, out = _hashes(words), {}
    h = w
    for n in range(2, max(sizes) + 1):
        h = ((h[:-1] << np.uint64(7)) | (h[:-1] >> np.uint64(57))) ^ w[n - 1 :]
        if n in sizes:
            at = np.flatnonzero(left[: len(h)] >= n)
            out[n] = (h[at] >> np.uint64(bits) << np.uint64(bits)) | np.uint64(sizes.index(n)), at
    return out


def _sizes_of(grams: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    return np.array(sizes, np.int32)[(grams & np.uint64((1 << (len(sizes) - 1).bit_length()) - 1)).astype(np.int64)]


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers as their lowest bytes, then the next ones, as far as any is used."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _least(counts: np.ndarray, top: int) -> int:
    """The top-th largest count, 0 if there are fewer."""
    return int(np.partition(counts, -top)[-top]) if len(counts) >= top else 0


def _packed(sizes: tuple[int, ...], top: int, bits: int):
    """A block's grams, each once with its count, as a row per cell: steps from gram to gram, and counts."""
    cell_of = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, left in _blocks(batches):
            every = np.sort(np.concatenate([g for g, _ in _grams(words, left, sizes).values()]))
            if not len(every):
                continue
            at = _runs(every)
            grams, counts = every[at], np.diff(at, append=len(every))
            own = _sizes_of(grams, sizes)
            least = [_least(counts[own == n], top) for n in sizes]
            cells = (grams >> cell_of).astype(np.int64)
            edges = [*_runs(cells).tolist(), len(grams)]
            parts = list(zip(edges, edges[1:], strict=False))
            steps = [_planes(np.diff(grams[a:b], prepend=np.uint64(cells[a]) << cell_of)) for a, b in parts]
            columns = [pa.array(cells[edges[:-1]], pa.int32()), pa.array([b - a for a, b in parts], pa.int32()), pa.array(steps, pa.binary()), pa.array([_planes(counts[a:b]) for a, b in parts], pa.binary()), pa.array([least] * len(parts), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "n", "steps", "counts", "least"])

    return run


def _cell_counts(sizes: tuple[int, ...], top: int, bits: int):
    """Of a cell and per size: how many grams (k) have a count (c); and those (g) that may be among the most common.

    These have at least the top-th largest count of the cell, and of every block, for both are no more than that of all.
    """

    def run(rows: pa.Table) -> pa.Table:
        base = np.uint64(rows["cell"][0].as_py()) << np.uint64(64 - bits)
        ns = rows["n"].to_pylist()
        grams = np.concatenate([base + np.cumsum(_from_planes(x.as_buffer(), n)) for x, n in zip(rows["steps"], ns, strict=True)])
        counts = np.concatenate([_from_planes(x.as_buffer(), n) for x, n in zip(rows["counts"], ns, strict=True)]).astype(np.int64)
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
        at = _runs(grams)
        grams, counts = grams[at], np.add.reduceat(counts, at)
        own, bounds = _sizes_of(grams, sizes), np.max(rows["least"].to_pylist(), axis=0)
        out = []
        for n, bound in zip(sizes, bounds, strict=True):
            g, c = grams[own == n], counts[own == n]
            levels, k = np.unique(c, return_counts=True)
            common = c >= max(_least(c, top), bound)
            out.append((np.full(len(levels) + common.sum(), n, np.int32), np.concatenate([levels, c[common]]), np.concatenate([k, c[common] * 0]), np.concatenate([k * 0, g[common].view(np.int64)])))
        size, count, k, g = map(np.concatenate, zip(*out, strict=True))
        return pa.table([pa.array(size), pa.array(count), pa.array(k, mask=k == 0), pa.array(g, mask=k > 0)], ["n", "c", "k", "g"])

    return run


def _texts(sizes: tuple[int, ...], wanted: list[int] | None):
    """The texts of the wanted grams (of all, for None), once a block."""
    picked = None if wanted is None else np.sort(np.array(wanted, np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, left in _blocks(batches):
            for n, (grams, at) in _grams(words, left, sizes).items():
                if picked is not None:
                    near = np.minimum(np.searchsorted(picked, grams), len(picked) - 1)
                    held = picked[near] == grams if len(picked) else np.zeros(len(grams), bool)
                    grams, at = grams[held], at[held]
                grams, first = np.unique(grams, return_index=True)
                texts = [" ".join(words.slice(i, n).to_pylist()) for i in at[first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), n, np.int32)), pa.array(grams.view(np.int64)), pa.array(texts, pa.string())], ["n", "g", "text"])

    return run


def ngram_stats(docs: DataFrame, words: Column, sizes: tuple[int, ...] = (2, 3, 4, 5), top: int = 3) -> DataFrame:
    """Per n (2 or more): total, unique, repeated occurrences, and the most common grams, ties by their text.

    Grams are 64-bit numbers, of their words' hashes and their size.  A task counts those of a block of
    words and deals them to cells, sorted, as steps from one to the next, so that a gram travels once, in
    about six bytes; a cell holds about CELL_DOCS documents' number of grams and leaves counts of counts
    and its most common grams.  Only grams as common as the top-th one become texts: they are picked out where they stand.
    """
    tokens = docs.select(words.alias("words"))
    bits = min(16, max(6, (docs.count() // CELL_DOCS).bit_length()))
    packed = tokens.mapInArrow(_packed(sizes, top, bits), "cell int, n int, steps binary, counts binary, least array<long>")
    counted = written(packed.groupBy("cell").applyInArrow(_cell_counts(sizes, top, bits), _COUNTED), "grams")
    levels = counted.where("g IS NULL").groupBy("n", "c").agg(F.sum("k").alias("k"))
    picked = written(_most_counted(levels, counted.where("g IS NOT NULL").select("n", "c", "g"), top), "picked")
    few = picked.count() <= BROADCAST_GRAMS
    texts = tokens.mapInArrow(_texts(sizes, [r.g for r in picked.select("g").collect()] if few else None), _TEXTS)
    named = texts.groupBy("n", "g").agg(F.min("text").alias("text")).join(picked, ["n", "g"])
    common = top_counts(named, ["n"], "text", "c", top).groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), F.col("text")))), lambda s: s["text"]), "|").alias("top"))
    of = F.col("c") * F.col("k")
    sums = levels.groupBy("n").agg(F.sum(of).alias("total"), F.sum("k").alias("unique"), F.sum(F.when(F.col("c") > 1, of).otherwise(0)).alias("repeated"))
    pct = lambda x: F.round(x * 100 / F.col("total"), 1)
    return sums.join(common, "n").select("n", "total", "unique", pct(F.col("unique")).alias("unique_rate"), pct(F.col("total") - F.col("unique")).alias("repeat_rate"), pct(F.col("repeated")).alias("repeated_pct"), "top")


def _most_counted(levels: DataFrame, grams: DataFrame, top: int) -> DataFrame:
    """Per n, the grams whose count is at least the top-th largest: that count comes from a histogram of counts."""
    above = F.sum("k").over(W.Window.partitionBy("n").orderBy(F.desc("c")))
    least = levels.withColumn("above", above).where((F.col("above") - F.col("k")) < top).groupBy("n").agg(F.min("c").alias("least"))
    return grams.join(F.broadcast(least), "n").where("c >= least").drop("least")


def top_counts(counts: DataFrame, by: list[str], value: str, count: str, top: int) -> DataFrame:
    """The most common values by key; ties by value."""
    order = W.Window.partitionBy(*by).orderBy(F.desc(count), value)
    return counts.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top).drop("_k")


def most_common(rows: DataFrame, value: Column, first: Column, top: int) -> DataFrame:
    """The ``top`` most common values; ties in the order of first occurrence."""
    counts = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    return counts.orderBy(F.desc("n"), "first", "value").limit(top)


def exact_duplicates(rows: DataFrame, value: Column) -> DataFrame:
    """Groups of equal values: number of groups, and of rows in them."""
    groups = rows.groupBy(value.alias("v")).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def loose_duplicates(rows: DataFrame, value: Column) -> DataFrame:
    """Normalised values that two or more different values share."""
    groups = rows.select(T.normalised(value).alias("norm"), value.alias("v")).groupBy("norm").agg(F.count("*").alias("n"), F.count_distinct("v").alias("variants"))
    return groups.where("variants > 1 AND norm <> ''")


def concentration(rows: DataFrame, value: Column, top: int, by: list[str] | None = None) -> DataFrame:
    """Distinct values, repeated ones, and the share of the ``top`` most common."""
    by = by or []
    counts = rows.groupBy(*by, value.alias("v")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(W.Window.partitionBy(*by).orderBy(F.desc("n"), "v"))) if by else None
    if ranked is None:
        head = counts.orderBy(F.desc("n"), "v").limit(top).agg(F.sum("n").alias("head"))
        return counts.agg(F.sum("n").alias("total"), F.count("*").alias("unique"), F.count_if(F.col("n") > 1).alias("repeated")).join(F.broadcast(head)).select("unique", "repeated", F.round(F.col("head") * 100 / F.col("total"), 1).alias("top_pct"))
    return ranked.groupBy(*by).agg(F.count("*").alias("unique"), F.count_if(F.col("n") > 1).alias("repeated"), F.round(F.sum(F.when(F.col("k") <= top, F.col("n"))) * 100 / F.sum("n"), 1).alias("top_pct"))


#: Counts from which a word that is no function word, or a short number, is too common.
MANY_WORDS, MANY_NUMBERS = 30, 20


def gibberish(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Each row's first reason, in order: loop word, empty, dominating word, repeated content word, number loop, character run, normal.

    Word counts are per row and need no shuffle: words are sorted within the row, once, and a word of
    many places equals the one so many places on; runs are counted among those only.  A word that has
    more than half of the places has the middle one.
    """
    lowered = rows.select(key, F.col(text).alias("t"), F.lower(text).alias("low"))
    found = lambda x, pattern: F.sort_array(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))
    ordered = lowered.select(key, "t", F.regexp_count("low", F.lit("pérdida")).alias("loop"), found("low", T.WORD).alias("words"), found("t", r"\d+").alias("numbers"))
    half = F.shiftright(F.size("words"), 1)
    middle = F.get("words", half)
    beyond = F.get("words", (F.array_position("words", middle) - 1 + half).cast("int"))
    counted = ordered.select(key, "t", "loop", F.size("words").alias("n"), (beyond == middle).alias("dominated"), _top_of_many("words", MANY_WORDS).alias("w"), _top_of_many("numbers", MANY_NUMBERS).alias("d"))
    reason = (
        F.when(F.col("loop") >= 5, "loop_word").when(F.col("n") == 0, "empty").when(F.col("dominated"), "dominating_word")
        .when((F.col("w") != "") & ~F.col("w").isin(*T.FUNCTION_WORDS), "excessive_repeat").when((F.col("d") != "") & (F.length("d") <= 3), "number_loop")
        .when(F.col("t").rlike(r"(.)\1{9,}"), "char_repeat").otherwise("normal")
    )
    return counted.select(key, reason.alias("reason"))


def _top_of_many(ordered: str, least: int) -> Column:
    """The most common value of a sorted array, of equally common ones the first; "" if it is there less than ``least`` times."""
    more = F.greatest(F.size(ordered) - (least - 1), F.lit(0))
    same = F.zip_with(F.slice(ordered, F.lit(1), more), F.slice(ordered, F.lit(least), more), lambda a, b: F.when(a == b, a))
    return _top_run(F.array_compact(same))["v"]


def _top_run(ordered: Column) -> Column:
    """The longest run (v, n) of a sorted array; of equal runs the first."""
    none = F.struct(F.lit("").alias("v"), F.lit(0).alias("n"), F.lit("").alias("now"), F.lit(0).alias("len"))

    def step(a: Column, x: Column) -> Column:
        length = F.when(x == a["now"], a["len"] + 1).otherwise(1)
        return F.struct(F.when(length > a["n"], x).otherwise(a["v"]).alias("v"), F.greatest(length, a["n"]).alias("n"), x.alias("now"), length.alias("len"))

    return F.aggregate(ordered, none, step, lambda a: F.struct(a["v"].alias("v"), a["n"].alias("n")))


def type_token_ratio(rows: DataFrame, words: Column, by: list[str] | None = None) -> DataFrame:
    counted = rows.select(*(by or []), F.explode(words).alias("w")).groupBy(*(by or [])).agg(F.count("*").alias("tokens"), F.count_distinct("w").alias("types"))
    return counted.withColumn("ratio", F.round(F.col("types") / F.col("tokens"), 6))


def explained(rows: DataFrame, text: Column) -> DataFrame:
    """Of texts with segments: whether words stand before, after, both or neither."""
    from loom.functions.tags import SEGMENT

    before, after = text.rlike(r"(?s)\S.{5,40}?\s*<seg>"), text.rlike(r"(?s)</seg>\s*.{5,40}?(?:<seg>|$)")
    kind = F.when(before & after, "both").when(before, "before").when(after, "after").otherwise("neither")
    return rows.where(text.rlike(SEGMENT)).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def followups(rows: DataFrame, text: Column, top: int) -> DataFrame:
    """The most common words right after a segment."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<seg>\s*[\d.]+\s*,\s*[\d.]+\s*</seg>\s*(.{10,60}?)(?:<seg|$)"), F.lit(1))
    said = rows.select(F.explode(found).alias("f")).select(F.trim("f").alias("f")).where(F.length("f") >= 5)
    return said.groupBy("f").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "f").limit(top)
