"""Seeded samples, splits and mixes.

The order of a sample is the md5 of seed and id: the same on any engine, in any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loom.operators import batch


def digest(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("_", F.lit(str(seed)), F.col(key).cast("string")))


def uniform(key: str, seed: int) -> Column:
    """A number in [0, 1) from the digest's first 32 bits."""
    return F.conv(F.substring(digest(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def sampled(df: DataFrame, key: str, n: int, seed: int, shuffle: bool = True) -> DataFrame:
    """n rows: all of them as often as they fit, and a seeded (or leading) remainder."""
    rows = df.count()
    if not rows:
        return df
    whole, rest = divmod(n, rows)
    placed = batch.shuffled(df, key, seed) if shuffle else batch.indexed(df, key)
    times = F.lit(whole) + (F.col("row_idx") < rest).cast("int")
    return batch.repeated_by(placed.withColumn("_times", times), "_times").drop("_times", "row_idx", "copy")


def split(df: DataFrame, key: str, ratio: float, seed: int, n: int | None = None) -> DataFrame:
    """Adds part: "val" for max(1, int(min(rows, n) * ratio)) rows, "train" for n less that, null for others."""
    rows = df.count()
    n = rows if n is None else n
    val = 0 if ratio == 0 else min(rows, n) if ratio == 1 else max(int(min(rows, n) * ratio), 1)
    place = F.col("row_idx")
    part = F.when(place < val, "val").when(place < n, "train")
    return batch.shuffled(df, key, seed).withColumn("part", part).drop("row_idx")


def manifest(df: DataFrame, key: str, start: int, stop: int, n: int, seed: int) -> DataFrame:
    """n of the rows with places in [start, stop), in a seeded order."""
    cut = batch.sliced(batch.indexed(df, key), start, stop).drop("row_idx")
    return batch.sliced(batch.shuffled(cut, key, seed, "row_idx"), 0, n)


def stratified(df: DataFrame, by: list[str], key: str, n: int, seed: int, cap: int | None = None) -> DataFrame:
    """n rows per stratum in digest order; beyond a cap on the whole, those first in another digest order."""
    order = W.Window.partitionBy(*by).orderBy(digest(key, seed), key)
    picked = df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")
    return picked if cap is None else picked.orderBy(digest(key, seed + 1), key).limit(cap)


def weighted_choice(df: DataFrame, key: str, weight: Column, seed: int) -> Column:
    """Whether the first of two paired sources is taken, with the row's probability."""
    return uniform(key, seed) < weight


def interleaved(frames: list[DataFrame], key: str, weights: list[float], seed: int, exhaust: str = "first") -> DataFrame:
    """Sources mixed by weight into one seeded order.

    A source's k-th row stands at the k-th arrival of a process whose rate is its weight, so the
    sources interleave by weight without a draw per place; with "first" the mix ends where the first
    source ends, with "all" it takes every row.
    """
    out, ends = None, []
    for i, (df, w) in enumerate(zip(frames, weights, strict=True)):
        placed = batch.shuffled(df, key, seed + i)
        at = placed.withColumn("at", (F.col("row_idx") + uniform(key, seed + 100 + i)) / w).withColumn("source_no", F.lit(i)).drop("row_idx")
        ends.append(df.count() / w)
        out = at if out is None else out.unionByName(at)
    return out.where(F.col("at") < min(ends)) if exhaust == "first" else out


def resample_weights(df: DataFrame, score: str, method: str, power: float = 2.0) -> DataFrame:
    """Adds weight: |score| ** power, extremes only, or the top at 0.4 and others at 0.1; never below 1e-8."""
    x = F.col(score)
    stats = F.broadcast(df.agg(F.max(x).alias("_hi"), F.min(x).alias("_lo")))
    joined = df.join(stats)
    raw = {"pow": F.pow(F.abs(x), F.lit(power)), "max_min": F.when((x == F.col("_hi")) | (x == F.col("_lo")), 1.0).otherwise(0.0), "max_random": F.when(x == F.col("_hi"), 0.4).otherwise(0.1)}[method]
    return joined.withColumn("weight", F.greatest(raw + 1e-8, F.lit(1e-8))).drop("_hi", "_lo")


def resampled(df: DataFrame, key: str, weight: str, seed: int) -> DataFrame:
    """As many rows as there are, drawn with replacement by weight.

    Systematic: a row is drawn once for every whole number that its stretch of the scaled line of
    weights, shifted by one seeded offset, covers.  The line is a prefix sum over value buckets.
    """
    rows, total = df.agg(F.count("*"), F.sum(weight)).first()
    if not rows:
        return df
    placed = batch.shuffled(df, key, seed).withColumn("_g", F.floor(F.col("row_idx") / batch.BUCKET_ROWS))
    sums = placed.groupBy("_g").agg(F.sum(weight).alias("_s"))
    offsets = sums.select("_g", (F.sum("_s").over(W.Window.orderBy("_g")) - F.col("_s")).alias("_o"))
    run = F.sum(weight).over(W.Window.partitionBy("_g").orderBy("row_idx"))
    line = placed.join(offsets, "_g").withColumn("_b", (F.col("_o") + run) * (rows / total)).withColumn("_a", F.col("_b") - F.col(weight) * (rows / total))
    shift = (seed * 0.6180339887) % 1
    times = F.floor(F.col("_b") + shift) - F.floor(F.col("_a") + shift)
    return batch.repeated_by(line.withColumn("_t", times), "_t").drop("_g", "_o", "_a", "_b", "_t", "row_idx", "copy")


def bootstrap(df: DataFrame, by: list[str], x: str, place: str, size: int, times: int, seed: int) -> DataFrame:
    """Mean and deviation over ``times`` resamples of the best, worst and mean of ``size`` draws a group.

    Groups are a prompt's few responses: their values travel as one array, and draws are indices
    from digests, so nothing is exploded by the number of draws.
    """
    values = F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(x).alias("x")))), lambda s: s["x"])
    groups = df.groupBy(*by).agg(values.alias("v"))
    drawn = groups.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    pick = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("b"), i), F.size("v")).cast("int")
    drawn = drawn.withColumn("d", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get("v", pick(i))))
    each = drawn.select(*by, F.array_max("d").alias("best"), F.array_min("d").alias("worst"), (F.aggregate("d", F.lit(0.0), lambda a, v: a + v) / size).alias("mean"))
    return each.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in ("best", "worst", "mean") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def filled(batches: list[DataFrame], keep, want: int, key: str) -> DataFrame:
    """Rows that ``keep`` lets through from batch after batch until there are enough; else the first batch."""
    got = None
    for df in batches:
        kept = keep(df)
        got = kept if got is None else got.unionByName(kept)
        if got.count() >= want:
            return got.orderBy(key).limit(want)
    return batches[0]


def shuffled_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Adds split ("train" for the first share of a seeded order, else "test") and index, the place within the split."""
    cut = int(df.count() * share)
    placed = batch.shuffled(df, key, seed)
    first = F.col("row_idx") < cut
    return placed.withColumn("split", F.when(first, "train").otherwise("test")).withColumn("index", F.when(first, F.col("row_idx")).otherwise(F.col("row_idx") - cut)).drop("row_idx")
