"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets: sources share all words by weight; a target stops at ``times`` its source's size and the
   excess is reshared by weight until none is above.  The level is found by rounds of two sums over
   the sources' table, which is as long as it may be.
2. One block size holds for the whole mix.  As many seats as the targets have blocks go to the sources
   by the highest quotients target / 1, 3, 5, ...; each source's seats go to its shards by the highest
   quotients of their words.  Only where the seats miss a target by more than ``NEAR`` of it, as they do
   for small sources, is the difference settled in words.
3. A cell (source and shard) lays its documents out in a seeded order and cuts that line into blocks.
   Its quota takes every block in whole passes; of the rest, blocks are drawn in the order of a seeded
   hash, and the last one drawn may be taken in part.  Documents are cut only at the edges of blocks.

Shards are salts: a source of any share of the rows is spread over as many cells as its size asks for.
One task deals the seats of up to ``PART_SOURCES`` sources (of more, first to groups of so many, by the
same rule), and another those of all cells of a source: one row per 10 million words or 50,000 documents,
so that 100 TB of text, a third of it one source's, are some 500,000 rows there.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from loom.llm.common import materialise, n_words, table, with_groups

WEIGHTS = (5, 2, 1)
#: Words of a block, at most, and blocks of the mix, at least (where it has so many words).
BLOCK_WORDS, BLOCKS = 65_536, 4096
#: Seats may miss a source's target by this part of it.
NEAR = 0.005
#: Sources that one task deals seats to.
PART_SOURCES = 50_000
#: A cell holds about so many words and documents.
SHARD_WORDS, SHARD_DOCS = 10_000_000, 50_000
#: Sources of up to so many rows are broadcast; more are joined as groups of which a few may be hot.
BROADCAST_SOURCES = 100_000


def ranked(sources: DataFrame) -> DataFrame:
    """Adds rank, the 0-based place in code point order, null last: numbered in ranges, of which each is a task's."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = max(1, sources.count() // BROADCAST_SOURCES)
    ranges = materialise(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = W.Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(W.Window.partitionBy("part").orderBy(*order)) - 1
    return ranges.join(F.broadcast(offsets), "part").withColumn("rank", (F.col("offset") + number).cast("long")).drop("part", "offset")


def with_targets(sources: DataFrame, weights: Sequence[float], times: float) -> DataFrame:
    """Adds target to a table of rank and words: shares of all words by weight, none above times its words.

    A target is weight * level or the source's bound.  The level rises from round to round as bounds are
    reached, until no further one is; its rounds are few, for each counts all bounds below it at once.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    bound = F.col("words") * F.lit(float(times))
    total = sources.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    level, stopped = 0.0, -1
    while True:
        at = bound <= weight * F.lit(level)
        capped, free, n = sources.agg(F.coalesce(F.sum(F.when(at, bound)), F.lit(0.0)), F.coalesce(F.sum(F.when(~at, weight)), F.lit(0.0)), F.count_if(at)).first()
        if n == stopped or not free:
            return sources.withColumn("target", F.when(at, bound).otherwise(weight * F.lit(level)).cast("double"))
        level, stopped = (total - capped) / free, n


def apportion(seats: int, votes: Sequence[float], most: Sequence[int]) -> list[int]:
    """Sainte-Laguë: seats go one by one to the highest votes / (2 * seats so far + 1); ties to the first.

    Starts at the rounded shares, which differ from the result by half a seat a party on average, so
    the work is in the number of parties, not of seats.  No party gets more than its ``most``.
    """
    total = float(sum(votes))
    if total <= 0:
        return [0] * len(votes)
    got = [min(most[i], int(v * seats / total + 0.5)) for i, v in enumerate(votes)]
    over = sum(got) - seats
    if over > 0:  # take back the lowest quotients
        heap = [(votes[i] / (2 * g - 1), -i) for i, g in enumerate(got) if g]
        heapq.heapify(heap)
        for _ in range(over):
            i = -heapq.heappop(heap)[1]
            got[i] -= 1
            if got[i]:
                heapq.heappush(heap, (votes[i] / (2 * got[i] - 1), -i))
    heap = [(-votes[i] / (2 * g + 1), i) for i, g in enumerate(got) if g < most[i] and votes[i] > 0]
    heapq.heapify(heap)
    for _ in range(max(0, -over)):
        if not heap:
            break
        i = heapq.heappop(heap)[1]
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _source_seats(block: int, times: int):
    def run(sources: pd.DataFrame) -> pd.DataFrame:
        """Of one part of the sources: its seats by their targets."""
        sources = sources.sort_values("rank")
        most = [int(times * w) // block for w in sources["source_size"]]
        return sources.assign(seats=apportion(int(sources["part_seats"].iloc[0]), sources["target"].tolist(), most))[["rank", "seats"]]

    return run


def seated(sources: DataFrame, block: int, times: int) -> DataFrame:
    """rank, seats: the mix's blocks dealt to the sources' targets by the highest quotients."""
    rows = sources.select("rank", "source_size", "target", F.floor(F.col("rank") / PART_SOURCES).alias("part"))
    parts = sorted((r.part, r.target, r.most) for r in rows.groupBy("part").agg(F.sum("target").alias("target"), F.sum(F.floor(F.col("source_size") * times / block)).alias("most")).collect())
    seats = apportion(int(sum(t for _, t, _ in parts) / block + 0.5), [t for _, t, _ in parts], [m for _, _, m in parts])
    dealt = sources.sparkSession.createDataFrame([(p, n) for (p, _, _), n in zip(parts, seats, strict=True)], "part long, part_seats long")
    return rows.join(F.broadcast(dealt), "part").groupBy("part").applyInPandas(_source_seats(block, times), "rank long, seats long")


def _wanted(block: int) -> Column:
    """Words that a source's seats and, where they miss its target, their settlement give it."""
    words = F.col("seats") * block
    return F.when(F.abs(words - F.col("target")) <= F.col("target") * NEAR, words).otherwise(F.round("target").cast("long"))


def _cell_quotas(block: int, times: int):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        """Of one source: words of each cell, whole blocks by the cells' sizes, then what is left or too much, cell by cell."""
        cells = cells.sort_values("shard").reset_index(drop=True)
        words, left = cells["words"].tolist(), int(cells["wanted"].iloc[0])
        seats = apportion(min(int(cells["seats"].iloc[0]), left // block), [float(w) for w in words], [times * w // block for w in words])
        quota = [n * block for n in seats]
        left -= sum(quota)
        for i, w in enumerate(words):
            more = min(left, times * w - quota[i])
            quota[i], left = quota[i] + more, left - more
        return cells.assign(quota=quota)[["rank", "shard", "quota"]]

    return run


def _drawn(cells: DataFrame, block: int, seed: int) -> DataFrame:
    """Adds how each cell's quota is met: passes, the last block drawn (hash and number), and the block taken in part with its words."""
    some = F.col("words") > 0
    cells = cells.withColumn("whole", F.expr(f"words div {block}")).withColumn("passes", F.when(some, F.expr("quota div words")).otherwise(0).cast("int")).withColumn("rest", F.when(some, F.expr("quota % words")).otherwise(0))
    cells = cells.withColumn("draws", F.expr(f"rest div {block}")).withColumn("part_words", F.expr(f"rest % {block}"))
    blocks = cells.where("whole > 0 AND rest > 0").select("rank", "shard", "draws", F.explode(F.expr("sequence(0L, whole - 1)")).alias("b"))
    blocks = blocks.withColumn("h", F.xxhash64(F.lit(seed), "rank", "shard", "b"))
    nth = F.row_number().over(W.Window.partitionBy("rank", "shard").orderBy("h", "b"))
    drawn = blocks.withColumn("nth", nth).groupBy("rank", "shard").agg(F.max(F.when(F.col("nth") == F.col("draws"), F.struct("h", "b"))).alias("last"), F.max(F.when(F.col("nth") == F.col("draws") + 1, F.col("b"))).alias("next"))
    part = F.when(F.col("part_words") > 0, F.coalesce("next", "whole"))
    return cells.join(drawn, ["rank", "shard"], "left").select("rank", "shard", "words", "whole", "passes", F.col("last.h").alias("last_h"), F.col("last.b").alias("last_b"), part.alias("part"), "part_words")


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, times: int = 3, block_words: int = BLOCK_WORDS, seed: int = 1, shard_words: int = SHARD_WORDS, measured: DataFrame | None = None) -> DataFrame:
    """Adds source_size, target, passes, spans and taken to rows of doc_id, source, size (and one more column, doc).

    passes: how often the whole document is taken; spans: word ranges [from, to) taken once more.
    Sources are weighted in code point order, null last, the weights repeating.  The order depends on
    doc_id and size only, so reruns agree; rows that repeat both are interchangeable.  Documents
    without words take nothing; no rows give no rows.  measured: the same rows as a table without doc,
    where rows are dear to compute.
    """
    known = rows if measured is None else measured
    sizes = materialise(known.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "sources")
    sources = with_targets(materialise(ranked(sizes), "ranked"), weights, times)
    shards = F.greatest(F.lit(1), F.ceil(F.col("words") / shard_words), F.ceil(F.col("n") / SHARD_DOCS))
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    sources = materialise(sources.select(key(F.col("source")).alias("key"), "rank", "n", F.col("words").alias("source_size"), "target", shards.cast("long").alias("shards")), "targets")
    count, whole, total = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    few, block = count <= BROADCAST_SOURCES, max(1, min(block_words, whole // BLOCKS))
    seats = materialise(seated(sources, block, times), "seats")

    def placed(of: DataFrame) -> DataFrame:
        keyed = of.withColumn("key", key(F.col("source")))
        joined = keyed.join(F.broadcast(sources), "key") if few else with_groups(keyed, sources, "key", total, "n")
        return joined.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.lit("shard")), F.col("shards"))).drop("key", "n", "shards")

    cells = placed(known).groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    cells = materialise(cells.join(seats, "rank").withColumn("wanted", _wanted(block)), "cells")
    # a source in one cell needs no shares; the seats of others are dealt to their cells, a source at a time
    alone = F.col("words") == F.col("source_size")
    shared = cells.where(~alone).groupBy("rank").applyInPandas(_cell_quotas(block, times), "rank long, shard long, quota long")
    one = cells.where(alone).select("rank", "shard", F.least(F.col("wanted"), F.lit(times) * F.col("words")).alias("quota"))
    quotas = cells.select("rank", "shard", "words").join(one.unionByName(shared), ["rank", "shard"])
    cells = materialise(_drawn(quotas, block, seed), "quotas")

    order = W.Window.partitionBy("rank", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "size")
    begin = F.sum("size").over(order.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)) - F.col("size")
    laid = placed(rows).withColumn("begin", begin).join(cells, ["rank", "shard"])
    hashed = lambda b: f"xxhash64({seed}, rank, shard, {b})"
    taken = lambda b: f"({b} < whole AND coalesce({hashed(b)} < last_h OR ({hashed(b)} = last_h AND {b} <= last_b), false))"
    some = lambda b: f"({taken(b)} OR coalesce({b} = part, false))"
    laid = laid.withColumn("first", F.expr(f"begin div {block}")).withColumn("last", F.expr(f"(begin + size - 1) div {block}"))
    asked = (F.col("size") > 0) & (F.col("last_h").isNotNull() | F.col("part").isNotNull())
    laid = laid.withColumn("chosen", F.when(asked, F.expr(f"filter(sequence(first, last), b -> {some('b')})")).otherwise(F.array().cast("array<bigint>")))
    clip = lambda at: f"least(greatest({at} - begin, 0L), size)"
    # a run of blocks goes on from a block taken whole to the next that is taken
    end = f"CASE WHEN {taken('b')} THEN (b + 1) * {block} ELSE b * {block} + part_words END"
    runs = f"""zip_with(filter(chosen, b -> b = first OR NOT {taken('(b - 1)')}), filter(chosen, b -> b = last OR NOT {taken('b')} OR NOT {some('(b + 1)')}),
        (a, b) -> named_struct('from', {clip(f'a * {block}')}, 'to', {clip(end)}))"""
    laid = laid.withColumn("spans", F.filter(F.expr(runs), lambda s: s["to"] > s["from"]))
    partly = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return laid.withColumn("taken", F.col("passes") * F.col("size") + partly).select(*rows.columns, "source_size", "target", "passes", "spans", "taken")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' rows once per pass, and once more per span with the text cut to its words.

    Keeps all columns of docs, whatever their names; n_chars, where there is one, follows a cut text.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    mixed = plan(rows, measured=materialise(sized, "sizes"), **how)
    words = F.regexp_extract_all(F.col("doc.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = lambda s: F.when(s["to"] - s["from"] == F.col("size"), F.col("doc.text")).otherwise(F.regexp_replace(F.array_join(F.slice(words, s["from"].cast("int") + 1, (s["to"] - s["from"]).cast("int")), ""), r"^[\x20\x09-\x0D]+", ""))
    texts = F.concat(F.array_repeat("doc.text", F.col("passes")), F.transform("spans", cut))
    out = mixed.where("taken > 0").select("doc", F.explode(texts).alias("cut"))
    given = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        given["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return out.select(*[x.alias(c) for c, x in given.items()])


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes, spans for every document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return plan(materialise(rows, "sizes")).select("doc_id", "size", "source_size", "target", "taken", "passes", "spans")
