"""Counts, rates and summaries for reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loom.sources.files import written


def rates(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Overall (null keys) and per key: rows, counts and rates of flags. One pass with grouping sets."""
    flagged = df.select(*by, *[F.coalesce(c, F.lit(False)).cast("int").alias(k) for k, c in flags.items()])
    sets = [[], *[[c] for c in by]]
    out = flagged.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.count("*").alias("n"), *[F.sum(k).alias(f"n_{k}") for k in flags], *[F.round(F.avg(k), 6).alias(f"rate_{k}") for k in flags])
    return out


def composite_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.concat_ws("/", a, b).alias("key")).agg(F.count("*").alias("n"))


def described(df: DataFrame, x: str) -> DataFrame:
    """Mean, population deviation, least, greatest and count; null for no values."""
    return df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("size"))


def upper_median(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """The value at place n div 2 of the sorted values: of an even count the upper one. Found by rank, not by list."""
    w = W.Window.partitionBy(*by)
    placed = df.where(F.col(x).isNotNull()).withColumn("_k", F.row_number().over(w.orderBy(x))).withColumn("_n", F.count("*").over(w))
    return placed.where(F.col("_k") == F.floor(F.col("_n") / 2) + 1).select(*by, F.col(x).alias("median"))


def histogram(df: DataFrame, x: Column) -> DataFrame:
    return df.groupBy(x.alias("value")).agg(F.count("*").alias("n"))


def reduced_by_name(metrics: DataFrame) -> DataFrame:
    """Of (name, value) rows: the greatest where the name says max, the least where it says min, else the mean."""
    v = F.col("value")
    return metrics.groupBy("name").agg(F.when(F.col("name").contains("max"), F.max(v)).when(F.col("name").contains("min"), F.min(v)).otherwise(F.avg(v)).alias("value"))


def voted(df: DataFrame, by: list[str], vote: str, value: str, place: str) -> DataFrame:
    """The first value of the most common vote; of equally common ones the one seen first."""
    votes = df.groupBy(*by, vote).agg(F.count("*").alias("n"), F.min(place).alias("first"), F.min_by(value, place).alias("value"))
    return votes.groupBy(*by).agg(F.max_by(F.struct(F.col(vote).alias("vote"), "value"), F.struct("n", -F.col("first"))).alias("m")).select(*by, "m.vote", "m.value")


def validation(df: DataFrame, source: str, prompt: str, x: str) -> DataFrame:
    """Per source: means over prompts of a prompt's mean and population deviation (those with two values or more)."""
    per = df.groupBy(source, prompt).agg(F.avg(x).alias("mean"), F.when(F.count(x) > 1, F.stddev_pop(x)).alias("std"), F.max(x).alias("best"), F.min(x).alias("worst"))
    return per.groupBy(source).agg(*[F.avg(c).alias(c) for c in ("mean", "std", "best", "worst")])


#: Draws of validation tables are broadcast while they hold no more indices than this (8 MB).
BROADCAST_DRAWS = 1_000_000


def _draw_sizes(n: Column) -> Column:
    """2, 4, 8, ... below n, and n."""
    doubled = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.concat(F.filter(doubled, lambda m: m < n), F.array(n))


def _draws(seed: int, m: Column, b: Column, n: Column) -> Column:
    """m places below n: by the digest of seed, m, the resample's and the draw's number, the same for all prompts."""
    number = lambda i: F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(str(seed)), m.cast("string"), b.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), m - 1), lambda i: (number(i) % n).cast("int"))


def validation_table(df: DataFrame, source: str, prompt: str, place: str, variables: list[str], pred: str | None = None, times: int = 1000, seed: int = 42) -> DataFrame:
    """source, variable, metric, value: means over prompts of mean@N, std@N and of resampled best@n, worst@n and maj@n.

    N is a prompt's number of responses, n runs over 2, 4, 8, ... below it and N; of ``times`` resamples
    of n responses each, the mean ("/mean") and population deviation ("/std") of the best and the worst
    value, and of the value that the commonest ``pred`` has first (ties: the vote drawn first).  A prompt
    with one response has a mean only.  A prompt's responses, which are few, travel as one array; null
    values are left out of extremes and means.  Resamples depend on n and N alone: they are one small
    table, broadcast while it is small, else made beside each prompt.
    """
    given = F.struct(F.col(place).alias("place"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(variables)], (F.col(pred) if pred else F.lit(None)).cast("string").alias("p"))
    groups = df.groupBy(F.col(source).alias("source"), F.col(prompt).alias("prompt")).agg(F.array_sort(F.collect_list(given)).alias("v"), F.count("*").cast("int").alias("n"))
    parts = [groups.select("source", "prompt", "n", F.lit(c).alias("variable"), _values(f"x{k}").alias("d")) for k, c in enumerate(variables)]
    rows = written(reduce(DataFrame.unionByName, parts), "validation")
    label = lambda name, n, end="": F.concat(F.lit(f"{name}@"), n.cast("string"), F.lit(end))
    x = F.filter(F.transform("d", lambda s: s["x"]), lambda v: v.isNotNull())
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(x), F.lit(0))
    spread = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))) / F.nullif(F.size(x), F.lit(0)))
    plain = rows.withColumn("mean", mean).withColumn("std", spread)
    metrics = [plain.select("source", "variable", label("mean", F.col("n")).alias("metric"), F.col("mean").alias("value")), plain.where("n > 1").select("source", "variable", label("std", F.col("n")).alias("metric"), F.col("std").alias("value"))]

    sizes = rows.where("n > 1").select("n").distinct()
    few = (sizes.agg(F.sum(F.aggregate(_draw_sizes(F.col("n")), F.lit(0), lambda a, m: a + m))).first()[0] or 0) * times <= BROADCAST_DRAWS
    drawn = lambda of: of.withColumn("m", F.explode(_draw_sizes(F.col("n")))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("i", _draws(seed, F.col("m"), F.col("b"), F.col("n")))
    many = rows.where("n > 1")
    resampled = many.join(F.broadcast(drawn(sizes)), "n") if few else drawn(many)
    picked = resampled.select("source", "prompt", "variable", "m", F.transform("i", lambda i: F.get("d", i)).alias("d"))
    votes = F.transform("d", lambda s: F.size(F.filter("d", lambda o: o["p"].eqNullSafe(s["p"]))))
    winner = F.get("d", (F.array_position("votes", F.array_max("votes")) - 1).cast("int"))["x"]
    each = picked.withColumn("votes", votes if pred else F.lit(None).cast("array<int>")).select("source", "prompt", "variable", "m", F.array_max(F.transform("d", lambda s: s["x"])).alias("best"), F.array_min(F.transform("d", lambda s: s["x"])).alias("worst"), winner.alias("maj"))
    kinds = ("best", "worst", "maj") if pred else ("best", "worst")
    per = each.groupBy("source", "prompt", "variable", "m").agg(*[f(c).alias(f"{c}/{end}") for c in kinds for end, f in (("mean", F.avg), ("std", F.stddev_pop))])
    pairs = F.array(*[F.struct(label(c, F.col("m"), f"/{end}").alias("metric"), F.col(f"`{c}/{end}`").alias("value")) for c in kinds for end in ("mean", "std")])
    metrics.append(per.select("source", "variable", F.explode(pairs).alias("e")).select("source", "variable", "e.metric", "e.value"))
    return reduce(DataFrame.unionByName, metrics).groupBy("source", "variable", "metric").agg(F.avg("value").alias("value"))


def _values(name: str) -> Column:
    return F.transform("v", lambda s: F.struct(s[name].alias("x"), s["p"].alias("p")))


def list_means(df: DataFrame, source: str, scores: Column) -> DataFrame:
    """A list's mean per row, then the mean per source."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return df.select(source, mean.alias("m")).groupBy(source).agg(F.avg("m").alias("score"))


def batch_metrics(df: DataFrame, most: int) -> DataFrame:
    """One row of score, length and clipping statistics; columns score, value, ret, length."""
    out = []
    for c in ("score", "value", "ret", "length"):
        out += [F.avg(c).alias(f"{c}_mean"), F.max(c).cast("double").alias(f"{c}_max"), F.min(c).cast("double").alias(f"{c}_min")]
    explained = F.lit(1.0) - F.var_pop(F.col("ret") - F.col("value")) / (F.var_pop("ret") + 1e-5)
    return df.agg(*out, F.avg((F.col("length") >= most).cast("double")).alias("clip_ratio"), explained.alias("explained_variance"))


def throughput(df: DataFrame, length: str, seconds: float, workers: int) -> DataFrame:
    return df.agg(F.sum(length).alias("tokens"), (F.sum(length) / seconds / workers).alias("tokens_per_second"), (F.lit(seconds) * 1000 / F.sum(length)).alias("ms_per_token"))


def shares(df: DataFrame, by: str) -> DataFrame:
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(by, "n", F.round(F.col("n") / F.col("total"), 4).alias("ratio"))


def report(row: DataFrame) -> DataFrame:
    """A one-row report as a JSON object."""
    return row.select(F.to_json(F.struct(*row.columns)).alias("report"))


def token_accuracy(df: DataFrame) -> DataFrame:
    """Of (seq, pos, pred, label) with labels of -100 left out: predictions stand one place before their label."""
    prior = F.lag("pred").over(W.Window.partitionBy("seq").orderBy("pos"))
    held = df.withColumn("said", prior).where(F.col("said").isNotNull() & (F.col("label") != -100))
    per = held.groupBy("seq").agg(F.avg((F.col("said") == F.col("label")).cast("double")).alias("acc"), F.count("*").alias("n"), F.sum((F.col("said") == F.col("label")).cast("long")).alias("right"))
    return per.agg((F.sum("right") / F.sum("n")).alias("token_accuracy"), F.avg((F.col("acc") == 1).cast("double")).alias("sequence_accuracy"))


def channel_means(df: DataFrame, channel: str, loss: str, mask: str) -> DataFrame:
    return df.groupBy(channel).agg((F.sum(F.col(loss) * F.col(mask)) / (F.sum(mask) + 1e-12)).alias("loss"))
