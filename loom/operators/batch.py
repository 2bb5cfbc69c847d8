"""A batch of rows in a fixed order: slicing, chunking, repeating, padding, joining by place.

Places come from ``indexed``: counts of value buckets give offsets, rows are numbered within their
bucket, so no task holds the whole batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Buckets of a numbering, at least, and the rows of one, about.
BUCKETS, BUCKET_ROWS = 1024, 200_000


def _buckets(rows: int) -> int:
    return max(BUCKETS, -(-rows // BUCKET_ROWS))


def _numbered(df: DataFrame, bucket: Column, order: list, out: str) -> DataFrame:
    marked = df.withColumn("_b", bucket)
    counts = marked.groupBy("_b").agg(F.count("*").alias("_n"))  # one row per bucket
    before = F.coalesce(F.sum("_n").over(W.Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_b", before.alias("_o"))
    number = F.row_number().over(W.Window.partitionBy("_b").orderBy(*order)) - 1
    return marked.join(F.broadcast(offsets), "_b").withColumn(out, (F.col("_o") + number).cast("long")).drop("_b", "_o")


def by_value(df: DataFrame, key: str) -> Column | None:
    """The bucket of a numeric key: equal widths of its range, as many as the rows ask for; null without rows."""
    low, high, rows = df.agg(F.min(key), F.max(key), F.count("*")).first()
    if low is None:
        return None
    width = (high - low) / _buckets(rows)
    return F.floor((F.col(key) - F.lit(low)) / F.lit(float(width))) if width else F.lit(0).cast("long")


def indexed(df: DataFrame, key: str, out: str = "row_idx") -> DataFrame:
    """Adds the 0-based place of a row by a numeric unique key."""
    bucket = by_value(df, key)
    return df.withColumn(out, F.lit(0).cast("long")) if bucket is None else _numbered(df, bucket, [key], out)


def shuffled(df: DataFrame, key: str, seed: int, out: str = "row_idx") -> DataFrame:
    """Adds the 0-based place of a row in a seeded order of its key's digest, whose first digits are its bucket."""
    digest = F.md5(F.concat_ws("_", F.lit(str(seed)), F.col(key).cast("string")))
    digits = next(d for d in range(3, 16) if 16**d >= _buckets(df.count()))
    return _numbered(df.withColumn("_h", digest), F.conv(F.substring("_h", 1, digits), 16, 10).cast("long"), ["_h", key], out).drop("_h")


def running_sum(df: DataFrame, key: str, amount: str, out: str) -> DataFrame:
    """Adds the sum of ``amount`` over rows with smaller keys; keys are numeric and distinct."""
    bucket = by_value(df, key)
    if bucket is None:
        return df.withColumn(out, F.col(amount))
    marked = df.withColumn("_b", bucket)
    first = lambda w: F.coalesce(F.sum(F.col("_n")).over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    offsets = marked.groupBy("_b").agg(F.sum(amount).alias("_n")).select("_b", first(W.Window.partitionBy(F.lit(0)).orderBy("_b")).alias("_o"))
    within = F.sum(amount).over(W.Window.partitionBy("_b").orderBy(key).rowsBetween(W.Window.unboundedPreceding, -1))
    return marked.join(F.broadcast(offsets), "_b").withColumn(out, F.col("_o") + F.coalesce(within, F.lit(0))).drop("_b", "_o")


def sliced(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    start = start or 0
    keep = F.col("row_idx") >= start
    if stop is not None:
        keep = keep & (F.col("row_idx") < stop)
    return df.where(keep & ((F.col("row_idx") - start) % step == 0))


def chunked(df: DataFrame, n: int, pad: bool = False) -> DataFrame:
    """Adds the chunk of n equal ones; without padding, a remainder is an error."""
    rows = df.count()
    if rows % n and not pad:
        raise ValueError(f"{rows} rows do not make {n} equal chunks")
    return df.withColumn("chunk", F.floor(F.col("row_idx") / F.lit(max(1, -(-rows // n)))))


def repeated(df: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """Rows a a b b (interleaved) or a b a b, with their new place."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        return out.withColumn("place", F.col("row_idx") * times + F.col("copy"))
    return out.withColumn("place", F.col("copy") * F.lit(df.count()) + F.col("row_idx"))


def repeated_by(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its own count says."""
    return df.where(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col(times) - 1).cast("int"))))


def unfolded(df: DataFrame, column: str, n: int) -> DataFrame:
    """An array column cut into n rows of equal length; other columns repeat."""
    size = (F.size(column) / n).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.slice(F.col(column), k * size + 1, size))
    return df.select(*[c for c in df.columns if c != column], F.posexplode(parts).alias("part", column))


def folded(df: DataFrame, size: int, column: str) -> DataFrame:
    """Every ``size`` rows as one, their values a list in order."""
    items = F.array_sort(F.collect_list(F.struct("row_idx", column)))
    return df.groupBy(F.floor(F.col("row_idx") / size).alias("fold")).agg(F.transform(items, lambda s: s[column]).alias(column))


def padded(df: DataFrame, divisor: int) -> DataFrame:
    """Appends rows from the head, again and again, until the count divides."""
    rows = df.count()
    missing = -rows % divisor
    if not missing or not rows:
        return df.withColumn("is_pad", F.lit(False))
    extra = df.where(F.col("row_idx") < missing).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit((missing - 1) // rows))))
    extra = extra.withColumn("_at", F.col("row_idx") + F.col("_k") * rows).where(F.col("_at") < missing)
    extra = extra.withColumn("row_idx", F.col("_at") + rows).drop("_k", "_at").withColumn("is_pad", F.lit(True))
    return df.withColumn("is_pad", F.lit(False)).unionByName(extra)


def unpadded(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def zipped(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two batches joined by place; their counts must agree."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"batches of {n} and {m} rows")
    return a.join(b, "row_idx")


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of both; where a column is in both, its values must agree."""
    shared = [c for c in a.columns if c in b.columns and c != "row_idx"]
    joined = zipped(a, b.select("row_idx", *[F.col(c).alias(f"_{c}" if c in shared else c) for c in b.columns if c != "row_idx"]))
    for c in shared:
        joined = joined.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} differs")).cast(a.schema[c].dataType))).drop(f"_{c}")
    return joined


def reordered(df: DataFrame, order: DataFrame) -> DataFrame:
    """Rows in the order of (place, row_idx) rows."""
    return df.join(order, "row_idx")


def inverse(order: DataFrame) -> DataFrame:
    return order.select(F.col("place").alias("row_idx"), F.col("row_idx").alias("place"))


def shard(place: Column, total: int, parts: int, drop_rest: bool = False) -> Column:
    """The part of a row: equal pieces without the remainder (null), or the remainder spread; rows from ``total`` on go to the last part."""
    if drop_rest:
        piece = total // parts
        return F.when(place < piece * parts, F.floor(place / piece))
    return F.least(F.floor(((place + 1) * parts - 1) / total), F.lit(parts - 1).cast("long"))


def fitted(x: Column, length: int, pad: Column, left: bool = False) -> Column:
    """An array padded to a length."""
    fill = F.array_repeat(pad, F.greatest(F.lit(length) - F.size(x), F.lit(0)))
    return F.concat(fill, x) if left else F.concat(x, fill)


def truncated(x: Column, most: int, how: str) -> Column:
    """left drops the head, right the tail, middle what lies between two halves; error refuses."""
    n = F.size(x)
    if how == "error":
        return F.when(n > most, F.raise_error(F.lit("too long")).cast("array<int>")).otherwise(x)
    head = most // 2
    cut = {"left": F.slice(x, n - most + 1, F.lit(most)), "right": F.slice(x, 1, most), "middle": F.concat(F.slice(x, 1, head), F.slice(x, n - (most - head) + 1, F.lit(most - head)))}[how]
    return F.when(n > most, cut).otherwise(x)


def loss_mask(pos: Column, prompt: Column, total: Column) -> Column:
    """0 over the prompt but its last place, and at the last response place."""
    return ((pos >= prompt - 1) & (pos < total - 1)).cast("int")


def without_padding(ids: Column, mask: Column) -> Column:
    """What the mask keeps of left-padded ids."""
    kept = F.aggregate(mask, F.lit(0), lambda a, m: a + m.cast("int"))
    return F.slice(ids, F.size(ids) - kept + 1, kept)


def imbalance(df: DataFrame, length: str, before: str, after: str) -> DataFrame:
    """Sums per part before and after balancing."""
    side = lambda c, a, b: df.groupBy(c).agg(F.sum(length).alias("s")).agg(F.min("s").alias(a), F.max("s").alias(b), F.avg("s").alias(f"mean_{a}"))
    out = side(before, "min", "max").join(F.broadcast(side(after, "balanced_min", "balanced_max")))
    return out.select("min", "max", (F.col("max") - F.col("min")).alias("minmax_diff"), "balanced_min", "balanced_max", F.col("mean_min").alias("mean"))


def rounds_needed(df: DataFrame, length: str, most: int, multiple: int = 1) -> DataFrame:
    """How many micro-batches a token budget asks for, no more than rows, rounded up to a multiple."""
    n = F.least(F.count("*"), F.ceil(F.sum(length) / most))
    return df.agg((F.ceil(n / multiple) * multiple).cast("long").alias("micro_batches"))


def places_of(tokens: Column, part: Column) -> Column:
    """0-based places at which a token list has the list ``part``; overlapping ones count, an empty part has none."""
    starts = F.sequence(F.lit(0), F.size(tokens) - F.size(part))
    found = F.filter(starts, lambda i: F.slice(tokens, i + 1, F.size(part)) == part)
    return F.when((F.size(part) > 0) & (F.size(tokens) >= F.size(part)), found).otherwise(F.array().cast("array<int>"))


def first_filled(nested: Column, depth: int = 1) -> Column:
    """The first value that is neither null nor empty of lists nested ``depth`` times within a list; null if there is none."""
    for _ in range(depth):
        nested = F.flatten(F.filter(nested, lambda x: x.isNotNull()))
    return F.get(F.filter(nested, lambda x: x.isNotNull() & (x.cast("string") != "")), F.lit(0))


def least_by(df: DataFrame, value: str, key: str, n: int = 20) -> DataFrame:
    """The n rows with the least values, null ones left out; ties by key. Each task keeps n."""
    return df.where(F.col(value).isNotNull()).orderBy(value, key).limit(n)
