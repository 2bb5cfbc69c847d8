"""Sharding by balanced label propagation under capacity quotas.

Documents are nodes and equal texts are links; a group's hub stands for its links, so a group of n
has n of them and not n * n / 2.  Links of equal texts are stars: a hub's neighbours have no others, so
one propagation from the start is the fixed point of labels, and what is repeated is the admission.  Documents start at seeded shards, and a hub wishes for the shards
that hold its group's bytes, those that hold most first.  Its documents take the shard it gets; none
holds room at its start, so departures need no counting.  In each round every hub that waits asks for
the first of its wishes with room; a shard admits, in a seeded order, what its quota leaves, and who
is refused asks for the next, until no request is left.  Admission is by thresholds on histograms of
the requests (at most shards * BINS rows on the driver, at any input size), so no task sorts a
shard's requests.  Large groups and long documents, of which there are few, come first, the largest
first: each group gets an ordered run of shards, one where one has room for it, and each document the
emptiest shard.  Short documents without links, and those of groups for which no shard has room, then
fill what capacity is left: each takes its place on the line of free bytes by its place in a seeded
order, where a group's documents are neighbours.

The law is ``bytes``: shards' sizes are near equal, to half a short document where long documents and
groups leave room for it.  Seeded orders rest on doc_id and text, not on the order of a scan, so that
documents which differ in either lie the same way however the input is split.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from loom.llm.common import HOT_SHARE, discard, materialise, table

#: Bins of the seeded order within a shard's requests, and of the fill line.
BINS = 4096
#: Rows of one numbering task, about; and of a large group.
SLOT_ROWS, PART_ROWS = 200_000, 1000
#: A group with more than this part of a shard's capacity is large; a document, long.
LARGE, LONG = 1 / 64, 1 / 512


def _bins(seed: int, *key: str):
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(BINS)).cast("int")


def _loads(placed: DataFrame, shards: int) -> list[int]:
    found = {r.shard: r.size for r in placed.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _wishes(linked: DataFrame, seed: int) -> DataFrame:
    """Each group's shards, those that hold most of its bytes first; of shards that hold as much, in a seeded order."""
    held = linked.groupBy("key", "shard").agg(F.sum("size").alias("held"))
    ranked = F.sort_array(F.collect_list(F.struct("held", F.xxhash64(F.lit(seed), "key", "shard").alias("tie"), "shard")), asc=False)
    return held.groupBy("key").agg(F.transform(ranked, lambda x: x["shard"]).alias("wishes"))


def _runs(large: list, free: list[float]) -> list[tuple]:
    """(key, rows, upto, run) of large groups, the largest first: a run of shards, and how many rows they hold up to each.

    A group goes whole to the first shard of its wishes that has room for it; if none has, it fills
    the emptiest shard and goes on with the rest.  A single document, which has no wishes, goes to the
    emptiest.  free is what the shards have left.
    """
    out = []
    for g in sorted(large, key=lambda g: (-g.group_size * g.size, bytes(g.key))):
        order = [*g.wishes, *(s for s in range(len(free)) if s not in set(g.wishes))] if g.wishes else sorted(range(len(free)), key=free.__getitem__, reverse=True)
        left, upto, run = g.group_size, [], []
        while left:
            s = next((s for s in order if free[s] >= left * g.size), None)
            n = left
            if s is None:
                s = max(order, key=free.__getitem__)
                n = min(left, max(1, int(free[s] // g.size)))  # at least one, for no shard may have room for a whole text
            left -= n
            free[s] -= n * g.size
            upto.append(g.group_size - left)
            run.append(s)
        out.append((bytes(g.key), g.group_size, upto, run))
    return out


def _dealt(linked: DataFrame, runs: list[tuple], seed: int) -> DataFrame:
    """Rows of large groups over their runs, by their numbers within the group, which are counted in parallel parts."""
    table = F.broadcast(linked.sparkSession.createDataFrame(runs, "key binary, rows long, upto array<long>, run array<int>"))
    parts = F.least(F.lit(BINS), F.ceil(F.col("rows") / PART_ROWS))
    cut = linked.drop("shard").join(table, "key").withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 3), "place"), parts).cast("int"))
    before = W.Window.partitionBy("key").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = cut.groupBy("key", "part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.row_number().over(W.Window.partitionBy("key", "part").orderBy("place", "doc_id", "row"))
    placed = cut.withColumn("number", number).join(offsets, ["key", "part"]).withColumn("rank", F.col("offset") + F.col("number") - 1)
    return placed.select("row", "size", F.get("run", F.size(F.filter("upto", lambda u: u <= F.col("rank")))).alias("shard"))


def _settled(hubs: DataFrame, free: list[float], seed: int) -> DataFrame:
    """key and shard of groups (key, bytes, wishes), null where no shard has room for the group.

    In each round the hubs that wait ask for the first of their wishes with room, and then for any
    shard with room.  Rounds end when no request is left.  free is what the shards have left.
    """
    spark, shards = hubs.sparkSession, len(free)
    closed, done, waiting = [False] * shards, [], hubs
    others = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.pmod(F.xxhash64(F.lit(seed), "key") + i, F.lit(shards)).cast("int"))
    for k in itertools.count():
        room = F.array(*(F.lit(-1.0 if c else float(x)) for c, x in zip(closed, free, strict=True)))
        fitting = lambda x: F.get(F.filter(x, lambda s: F.get(room, s) >= F.col("bytes")), F.lit(0))
        asked = materialise(waiting.withColumn("to", F.coalesce(fitting("wishes"), fitting(others))), "asked")
        bin_ = _bins(seed + k, "key")
        # requests by shard and bin: a histogram of bounded size
        inward = asked.where("to IS NOT NULL").groupBy(F.col("to").alias("s"), bin_.alias("bin")).agg(F.sum("bytes").alias("bytes")).collect()
        by_shard: dict[int, list[tuple[int, int]]] = {}
        for r in inward:
            by_shard.setdefault(r.s, []).append((r.bin, r.bytes))
        admit = []
        for s, bins in by_shard.items():
            limit = -1
            for b, size in sorted(bins):
                if size > free[s]:
                    break
                free[s], limit = free[s] - size, b
            closed[s] = limit < 0
            admit.append((s, limit))
        if not admit:
            return reduce(DataFrame.unionByName, [*done, asked.select("key", F.lit(None).cast("int").alias("shard"))])
        limits = F.broadcast(spark.createDataFrame(admit, "to int, upto int"))
        answered = materialise(asked.join(limits, "to", "left").withColumn("ok", F.coalesce(bin_ <= F.col("upto"), F.lit(False))), "answered")
        discard(asked)
        done.append(answered.where("ok").select("key", F.col("to").alias("shard")))
        waiting = answered.where("NOT ok").select("key", "bytes", "wishes")


def _fill(alone: DataFrame, loads: list[int], seed: int) -> DataFrame:
    """Places documents on the free bytes of shards, in a seeded order of bins and, within one, of nodes and rows."""
    spark, shards = alone.sparkSession, len(loads)
    binned = alone.withColumn("bin", _bins(seed, "node"))
    sizes = {r.bin: r.size for r in binned.groupBy("bin").agg(F.sum("size").alias("size")).collect()}
    begins, at = [], 0
    for b in range(BINS):
        begins.append((b, at))
        at += sizes.get(b, 0)
    # the level to which the free bytes are filled: the emptiest shards first
    low, high = 0.0, float(max(loads) + at + 1)
    for _ in range(80):
        level = (low + high) / 2
        low, high = (level, high) if sum(max(0.0, level - x) for x in loads) < at else (low, level)
    ends, end = [], 0.0
    for x in loads:
        end += max(0.0, high - x)
        ends.append(end)
    ends[-1] = float("inf")
    within = W.Window.partitionBy("bin", "sub").orderBy("node", "place", "row")
    # a bin is cut into subs of about SLOT_ROWS rows, whose sums order them on the line
    subs = max(1, alone.count() // (BINS * SLOT_ROWS) + 1)
    binned = binned.withColumn("sub", F.pmod(F.xxhash64(F.lit(seed + 1), "node"), F.lit(subs)).cast("int"))
    before = W.Window.partitionBy("bin").orderBy("sub").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = binned.groupBy("bin", "sub").agg(F.sum("size").alias("bytes")).withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0))).drop("bytes")
    starts = F.broadcast(spark.createDataFrame(begins, "bin int, begin long"))
    placed = binned.join(offsets, ["bin", "sub"]).join(starts, "bin")
    running = F.sum("size").over(within.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)) - F.col("size")
    placed = placed.withColumn("middle", F.col("begin") + F.col("offset") + running + F.col("size") / 2)
    shard = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        shard = F.when(F.col("middle") < ends[s], s).otherwise(shard)
    return placed.withColumn("shard", shard.cast("int"))


def _slots(placed: DataFrame, rows: int, shards: int, seed: int) -> DataFrame:
    """Numbers each shard's rows from 0 without gaps, in parallel parts whose counts give the offsets."""
    parts = max(1, -(-rows // (shards * SLOT_ROWS)))
    cut = placed.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 2), "place"), F.lit(parts)).cast("int"))
    before = W.Window.partitionBy("shard").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = cut.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.row_number().over(W.Window.partitionBy("shard", "part").orderBy("place", "doc_id", "row"))
    return cut.withColumn("number", number).join(offsets, ["shard", "part"]).withColumn("slot", (F.col("offset") + F.col("number") - 1).cast("long"))


def sharded(docs: DataFrame, shards: int = 40, slack: float = 0.0, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    size: the text's UTF-8 bytes (null: none) plus 16.  Rows with equal texts are linked (null texts
    with null texts).  A group larger than a shard's capacity fills shards one after another, as it must.
    Every row counts by itself, so repeated rows and null doc_ids are fine; no rows give no rows;
    other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.concat(F.lit("text "), "text")))).alias("key"),
    )
    # place: the same for rows that are equal in doc_id and text, and only for those (but for collisions, which doc_id tells apart)
    sized = materialise(sized.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "key")), "sized")
    total = sized.count()
    whole = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    capacity = whole / shards * (1 + slack)
    groups = materialise(sized.groupBy("key").agg(F.count("*").alias("group_size"), F.max("size").alias("size")), "groups")
    start = F.pmod(F.col("place"), F.lit(shards)).cast("int").alias("shard")
    # by a broadcast of large groups' keys and a shuffle for the others no partition is hot
    bytes_, free = F.col("group_size") * F.col("size"), [float(capacity)] * shards
    linked, alone = F.col("group_size") > 1, F.col("group_size") == 1
    is_large = linked & ((bytes_ > F.lit(capacity * LARGE)) | (F.col("group_size") > F.lit(max(1, int(total * HOT_SHARE))))) | alone & (F.col("size") > F.lit(capacity * LONG))
    large = groups.where(is_large)  # at most shards * (1 / LARGE + 1 / LONG) + 1 / HOT_SHARE
    columns = ["row", "doc_id", "place", "key", "size"]
    one = materialise(sized.join(F.broadcast(large.select("key")), "key").select(*columns, start), "large")
    others = sized.join(F.broadcast(large.select("key")), "key", "left_anti").select(*columns)
    others = materialise(others.join(groups.where(~is_large).select("key", "group_size"), "key"), "others")
    rest = materialise(others.where(linked).select(*columns, start), "linked")
    wishes = _wishes(one.join(F.broadcast(large.where(linked).select("key")), "key"), seed)
    runs = _runs(large.join(wishes, "key", "left").collect(), free)
    hubs = groups.where(linked & ~is_large).select("key", bytes_.alias("bytes")).join(_wishes(rest, seed), "key")
    settled = materialise(rest.drop("shard").join(_settled(hubs, free, seed), "key"), "settled")
    placed = materialise(_dealt(one, runs, seed).unionByName(settled.where("shard IS NOT NULL").select("row", "size", "shard")), "placed")
    left = others.where(alone).select("row", "place", "size", F.col("place").alias("node"))
    left = left.unionByName(settled.where("shard IS NULL").select("row", "place", "size", F.xxhash64("key").alias("node")))
    filled = _fill(materialise(left, "alone"), _loads(placed, shards), seed)
    found = materialise(placed.select("row", "shard").unionByName(filled.select("row", "shard")), "placed")
    out = _slots(sized.drop("key").join(found, "row"), total, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))


def cut_edges(placed: DataFrame, group: str, shard: str = "shard") -> int:
    """Links to a group's hub that leave its shard: rows of a group outside the shard that holds most of them."""
    held = placed.groupBy(group, shard).agg(F.count("*").alias("n"))
    per = held.groupBy(group).agg((F.sum("n") - F.max("n")).alias("cut"))
    return per.agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard (of 40), slot, grown_shard (null) for every document."""
    return sharded(table(spark, sf_dir, "documents"), 40)
