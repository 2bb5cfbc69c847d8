"""Advantages, losses and grouped statistics of rollouts.

Token rows: seq, pos (from 0), value columns and a 0/1 mask.  Recurrences over a sequence are closed
forms over windows on seq, so a batch's sequences are spread; whitening needs the whole batch's mean
and variance, which is one row and joined by broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def whole(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Adds aggregates over all rows (one row, broadcast)."""
    return df.join(F.broadcast(df.agg(*[a.alias(k) for k, a in aggregates.items()])))


def masked_mean(x: Column, mask: Column) -> Column:
    return F.sum(x * mask) / (F.sum(mask) + 1e-8)


def whitened(df: DataFrame, x: str, mask: str, out: str, shift: bool = True) -> DataFrame:
    """(x - mean) / sqrt(variance + 1e-8) over the masked, with Bessel's correction; fewer than two are an error."""
    n = F.sum(mask)
    stats = df.agg(masked_mean(F.col(x), F.col(mask)).alias("_m"), F.when(n < 2, F.raise_error(F.lit("whitening needs two masked values")).cast("long")).otherwise(n).alias("_n"))
    centred = df.join(F.broadcast(stats))
    spread = centred.agg((masked_mean((F.col(x) - F.col("_m")) ** 2, F.col(mask)) * F.first("_n") / (F.first("_n") - 1)).alias("_v"))
    value = (F.col(x) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)
    return centred.join(F.broadcast(spread)).withColumn(out, value if shift else value + F.col("_m")).drop("_m", "_n", "_v")


def _by(uid: str) -> W.WindowSpec:
    return W.Window.partitionBy(uid)


def group_normalised(df: DataFrame, uid: str, r: str, variant: str = "sample", by_std: bool = True) -> Column:
    """Rewards normalised in their group.

    "sample": sample deviation + 1e-6, a group of one has mean 0 and deviation 1; "population": the
    population deviation, at least 1e-6; "wide": sample deviation + 1e-4, a group of one gives null.
    """
    w, x = _by(uid), F.col(r)
    mean, n = F.avg(x).over(w), F.count("*").over(w)
    if variant == "population":
        return (x - mean) / F.greatest(F.stddev_pop(x).over(w), F.lit(1e-6))
    if variant == "wide":
        return (x - mean) / (F.stddev_samp(x).over(w) + 1e-4) if by_std else x - mean
    single = x / (1 + 1e-6) if by_std else x
    return F.when(n == 1, single).otherwise((x - mean) / (F.stddev_samp(x).over(w) + 1e-6) if by_std else x - mean)


def best_only(df: DataFrame, uid: str, r: str, key: str, by_std: bool = True) -> Column:
    """Only the group's best reward gets its lead over the second; groups of one are an error."""
    order = _by(uid).orderBy(F.desc(r), key)
    lead = F.col(r) - F.lead(r).over(order)
    scaled = lead / (F.stddev_samp(F.col(r)).over(_by(uid)) + 1e-6) if by_std else lead
    alone = F.count("*").over(_by(uid)) < 2
    return F.when(alone, F.raise_error(F.lit("a group of one")).cast("double")).when(F.row_number().over(order) == 1, scaled).otherwise(0.0)


def leave_one_out(uid: str, r: str) -> Column:
    n, mean = F.count("*").over(_by(uid)), F.avg(r).over(_by(uid))
    return F.when(n == 1, F.col(r)).otherwise(F.col(r) * n / (n - 1) - mean * n / (n - 1))


def length_baseline(uid: str, r: str, length: str) -> Column:
    w = _by(uid)
    return F.when(F.count("*").over(w) == 1, F.col(r)).otherwise(F.col(r) - F.sum(F.col(length) * F.col(r)).over(w) / F.sum(length).over(w))


def _flowing_back(df: DataFrame, x: Column, factor: float, by: list[str], out: str, pos: str = "pos") -> DataFrame:
    """Adds y[pos] = x[pos] + factor * y[pos + 1] within ``by``; pos is gapless and factor within [0, 1].

    A stretch of positions is one window of scaled sums, x * factor ** place / factor ** place, and is
    short enough for the powers to stay above 1e-100.  What flows in from beyond the next stretch is
    below that share, so that the next one's own sum stands for all of it.
    """
    if factor == 0:
        return df.withColumn(out, x)
    place = F.col(pos).cast("long")
    stretch = F.lit(2**62) if factor >= 1 else F.lit(max(1, int(math.log(1e-100) / math.log(factor))))
    cut = df.withColumn("_x", x).withColumn("_s", F.floor(place / stretch)).withColumn("_p", F.pow(F.lit(float(factor)), place % stretch))
    back = W.Window.partitionBy(*by, "_s").orderBy(F.desc(pos)).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    summed = cut.withColumn(out, F.sum(F.col("_x") * F.col("_p")).over(back) / F.col("_p"))
    if factor < 1:
        after = W.Window.partitionBy(*by).orderBy("_s").rangeBetween(1, 1)
        head = F.max(F.when(place % stretch == 0, F.col(out))).over(after)
        summed = summed.withColumn(out, F.col(out) + F.coalesce(head, F.lit(0.0)) * F.lit(float(factor)) ** (stretch - place % stretch))
    return summed.drop("_x", "_s", "_p")


def generalised_advantage(df: DataFrame, gamma: float, lam: float) -> DataFrame:
    """adv and ret per token: discounted differences that flow back over each sequence, of any length."""
    order = W.Window.partitionBy("seq").orderBy("pos")
    delta = F.col("r") + gamma * F.coalesce(F.lead("v").over(order), F.lit(0.0)) - F.col("v")
    return _flowing_back(df.withColumn("_d", delta), F.col("_d"), gamma * lam, ["seq"], "adv").withColumn("ret", F.col("adv") + F.col("v")).drop("_d")


def discounted_returns(df: DataFrame, gamma: float) -> DataFrame:
    """Discounted reward to go; nothing flows back past a masked-out token, which begins a stretch of its own."""
    order = W.Window.partitionBy("seq").orderBy("pos")
    cut = df.withColumn("_k", F.sum(F.lit(1) - F.col("mask")).over(order.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)))
    return _flowing_back(cut, F.col("r"), gamma, ["seq", "_k"], "ret").drop("_k")


def reward_to_go(df: DataFrame, baseline: Column) -> DataFrame:
    back = W.Window.partitionBy("seq").orderBy(F.desc("pos")).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    out = df.withColumn("ret", F.sum(F.col("r") * F.col("mask")).over(back))
    return out.withColumn("adv", F.col("ret") - baseline * F.col("mask"))


def kl(logp: Column, ref: Column, kind: str) -> Column:
    if kind == "k1":
        return logp - ref
    if kind == "abs":
        return F.abs(logp - ref)
    if kind == "k2":
        return (logp - ref) * (logp - ref) * 0.5
    if kind == "k3":
        return F.least(F.lit(10.0), F.greatest(F.lit(-10.0), F.exp(ref - logp) - (ref - logp) - 1))
    raise ValueError(f"unknown kind {kind}")


def losses(df: DataFrame, loss: Column, padded: int) -> DataFrame:
    """One row: the loss under the four ways to aggregate; padded is the batch's padded length."""
    x = loss * F.col("mask")
    per = df.groupBy("seq").agg(F.sum(x).alias("s"), F.sum("mask").alias("n"))
    return per.agg((F.sum("s") / (F.sum("n") + 1e-8)).alias("token_mean"), F.avg("s").alias("seq_mean_token_sum"), F.avg(F.col("s") / F.nullif("n", F.lit(0))).alias("seq_mean_token_mean"), (F.sum("s") / padded).alias("seq_mean_token_sum_norm"))


def policy_loss(df: DataFrame, clip: float = 0.2, c: float = 3.0) -> DataFrame:
    """One row: dual-clip loss, share clipped above and below, approximate KL. Columns old, logp, adv, mask."""
    ratio, adv, mask = F.exp(F.col("logp") - F.col("old")), F.col("adv"), F.col("mask")
    one, two = -adv * ratio, -adv * F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip))
    high, three = F.greatest(one, two), -adv * c
    loss = F.when(adv < 0, F.least(three, high)).otherwise(high)
    return df.agg(masked_mean(loss, mask).alias("loss"), masked_mean((two > one).cast("double"), mask).alias("clipped"), masked_mean(F.col("old") - F.col("logp"), mask).alias("kl"), masked_mean(((high > three) & (adv < 0)).cast("double"), mask).alias("clipped_low"))


def value_loss(df: DataFrame, clip: float) -> DataFrame:
    """Columns pred, old_value, ret, mask."""
    held = F.least(F.greatest(F.col("pred"), F.col("old_value") - clip), F.col("old_value") + clip)
    a, b = (F.col("pred") - F.col("ret")) ** 2, (held - F.col("ret")) ** 2
    return df.agg(masked_mean(F.greatest(a, b), F.col("mask")).alias("loss"), masked_mean((b > a).cast("double"), F.col("mask")).alias("clipped"))


def entropy(logits: Column) -> Column:
    """logsumexp(x) - sum(softmax(x) * x) of an array of logits."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return top + F.log(total) - F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top) * x) / total


def until_end(df: DataFrame, token: int) -> Column:
    """1 up to and including the first end token of the sequence."""
    end = (F.col("token") == token).cast("int")
    before = F.sum(end).over(W.Window.partitionBy("seq").orderBy("pos").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)) - end
    return (before == 0).cast("int")


def positions(df: DataFrame) -> Column:
    """Position ids: places among the unmasked; 0 for padding."""
    return F.when(F.col("mask") == 1, F.sum("mask").over(W.Window.partitionBy("seq").orderBy("pos")) - 1).otherwise(0)


def smoothed(df: DataFrame, by: list[str], order: list[str], x: str, factor: float, out: str = "smooth") -> DataFrame:
    """Adds the exponential average with bias correction of each series so far, for series of any length."""
    series = W.Window.partitionBy(*by)
    placed = df.withColumn("_k", F.row_number().over(series.orderBy(*order))).withColumn("_back", F.count("*").over(series) - F.col("_k"))
    summed = _flowing_back(placed, F.col(x), factor, by, "_sum", "_back")
    return summed.withColumn(out, F.col("_sum") * (1 - factor) / (1 - F.pow(F.lit(factor), F.col("_k")))).drop("_k", "_back", "_sum")


def preferred(pair: str, score: str, place: str) -> Column:
    """Whether a row is its pair's choice: the higher score, the first of equal ones."""
    return F.row_number().over(W.Window.partitionBy(pair).orderBy(F.desc(score), place)) == 1


def bucket(place: Column, n: int) -> Column:
    return F.floor(place / n)


def preference_accuracy(df: DataFrame, uid: str, key: str, score: str, acc: str) -> DataFrame:
    """Per group of two or more: share of pairs, weighted by their difference in accuracy, that scores order alike; 0.5 without a difference.

    No pair is made.  Two rows of different accuracies part at the first binary digit in which the
    accuracies' ranks differ: there the one with a 1 is the better.  So each row joins one run per digit
    (those who share the digits before it), and running counts and sums of the zeros, in the order of
    (score, key), give what each one gains over the zeros before it.  Of equal scores the smaller key
    comes first.  That is n log n work for a group of n, a digit's run being one window.  Rows without an
    accuracy are left out; those without a score count in the whole but never as alike.
    """
    rows = df.select(uid, F.col(key).alias("_k"), F.col(score).alias("_s"), F.col(acc).cast("double").alias("_a")).where(F.col("_a").isNotNull())
    group = W.Window.partitionBy(uid)
    ranked = rows.withColumn("_r", F.dense_rank().over(group.orderBy("_a")) - 1)
    ranked = ranked.withColumn("_most", F.max("_r").over(group)).withColumn("_n", F.count("*").over(group)).where("_n > 1")
    digits = F.when(F.col("_most") > 0, F.sequence(F.lit(0), F.floor(F.log2("_most")).cast("int"))).otherwise(F.array(F.lit(0)))
    runs = ranked.select(uid, "_k", "_s", "_a", "_r", F.explode(digits).alias("_d"))
    runs = runs.withColumn("_run", F.expr("shiftright(_r, _d + 1)")).withColumn("_one", F.expr("shiftright(_r, _d) & 1 = 1")).drop("_r")
    before = W.Window.partitionBy(uid, "_d", "_run").orderBy("_s", "_k").rowsBetween(W.Window.unboundedPreceding, -1)
    zero = ~F.col("_one") & F.col("_s").isNotNull()
    count, total = F.count_if(zero).over(before), F.coalesce(F.sum(F.when(zero, F.col("_a"))).over(before), F.lit(0.0))
    gains = runs.withColumn("_gain", F.when(F.col("_one") & F.col("_s").isNotNull(), F.col("_a") * count - total).otherwise(0.0))
    ones, zeros = F.count_if("_one"), F.count_if(~F.col("_one"))
    sums = lambda one: F.coalesce(F.sum(F.when(F.col("_one") if one else ~F.col("_one"), F.col("_a"))), F.lit(0.0))
    parts = gains.groupBy(uid, "_d", "_run").agg(F.sum("_gain").alias("_gain"), (zeros * sums(True) - ones * sums(False)).alias("_whole"))
    whole = F.sum("_whole")
    return parts.groupBy(uid).agg(F.when(whole == 0, 0.5).otherwise(F.sum("_gain") / whole).alias("accuracy"))


def varied(df: DataFrame, uid: str, r: str, strict: bool = False) -> DataFrame:
    """Groups whose rewards differ; groups of one stay unless strict."""
    w = _by(uid)
    keep = F.stddev_samp(F.col(r)).over(w) > 0 if strict else (F.stddev_pop(F.col(r)).over(w) > 0) | (F.count("*").over(w) == 1)
    return df.withColumn("_keep", keep).where("_keep").drop("_keep")


def controller(target: float, horizon: int, start: float = 0.1):
    """The adaptive coefficient after a list of (kl, steps), in order: an inherently sequential fold over steps."""

    def after(steps: Column) -> Column:
        return F.aggregate(steps, F.lit(start), lambda c, s: c * (1 + F.least(F.greatest(s["kl"] / target - 1, F.lit(-0.2)), F.lit(0.2)) * s["n"] / horizon))

    return after


def best_and_worst(df: DataFrame, uid: str, key: str, prm: str, orm: str, n_best: int = 1, threshold: float = 0.0, easy: float = 1.0) -> DataFrame:
    """Best n and the worst of a group by normalised prm + 10 * orm; groups all right (mean orm >= easy) are skipped."""
    w = _by(uid)
    low, high = F.min(prm).over(w), F.max(prm).over(w)
    scaled = F.when(high == low, F.when(low > 0, F.least(F.lit(1.0), low)).otherwise(0.0)).otherwise((F.col(prm) - low) / (high - low + 1e-5))
    scored = df.withColumn("score", scaled + 10 * F.col(orm)).withColumn("_easy", F.avg(orm).over(w)).where(F.col("_easy") < easy)
    up = scored.withColumn("_b", F.row_number().over(w.orderBy(F.desc("score"), key))).withColumn("_w", F.row_number().over(w.orderBy("score", F.desc(key))))
    kind = F.when((F.col("_b") <= n_best) & (F.col(orm) > threshold), "best").when(F.col("_w") == 1, "worst")
    return up.withColumn("kind", kind).where("kind IS NOT NULL").drop("_b", "_w", "_easy")


def uct(value: Column, visits: Column, parent_visits: Column, c: float = 1.4) -> Column:
    return F.when(visits == 0, F.lit(float("inf"))).otherwise(value / visits + c * F.sqrt(F.log(parent_visits) / visits))


def at_last_token(tokens: DataFrame, scores: DataFrame, score: str = "score", out: str = "reward") -> DataFrame:
    """Adds out to tokens (seq, pos, mask): the sequence's score at its last valid token, else 0.

    The mask covers a head of the sequence; where it covers nothing, the score stands at the last place.
    Sequences without a score have 0 everywhere.
    """
    of = W.Window.partitionBy("seq")
    valid = F.sum("mask").over(of)
    last = F.when(valid > 0, valid - 1).otherwise(F.max("pos").over(of))
    placed = tokens.withColumn("_last", last).join(scores.select("seq", F.col(score).alias("_score")), "seq", "left")
    return placed.withColumn(out, F.when(F.col("pos") == F.col("_last"), F.coalesce(F.col("_score").cast("double"), F.lit(0.0))).otherwise(0.0)).drop("_last", "_score")
