"""Number formats and distractors of question builders, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time(x: Column) -> Column:
    """Three decimals at most, one at least."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", F.round(x, 3)), "0+$", ""), r"\.$", ".0")


def seconds(x: Column) -> Column:
    x = F.greatest(x, F.lit(0.0))
    one = F.bround(x, 1)
    return F.when(x < 0.05, "0 seconds").when(F.abs(one - 1) < 1e-9, "1.0 second").otherwise(F.format_string("%.1f seconds", one))


def nearest_five(x: Column, floor: bool = False) -> Column:
    """Percent to a multiple of five: half to even, or down."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    return ((F.floor(x / 5) if floor else F.bround(x / 5)) * 5).cast("int")


def percent(x: Column, floor: bool = False) -> Column:
    return F.concat(nearest_five(x, floor).cast("string"), F.lit("%"))


def _first_four(values: Column) -> Column:
    return F.slice(F.array_distinct(values), 1, 4)


def second_choices(x: Column) -> Column:
    """The value and its three nearest distractors, by distance, then size."""
    base = F.greatest(F.lit(0.0), F.bround(x, 1))
    near = [base] + [F.greatest(F.lit(0.0), F.bround(base + d, 1)) for d in (-0.3, 0.3, -0.6, 0.6, 1.0)]
    ranked = F.array_sort(F.array(*[F.struct(F.bround(F.abs(v - base), 6).alias("d"), v.alias("v")) for v in near]))
    return _first_four(F.transform(ranked, lambda s: seconds(s["v"])))


def percent_choices(x: Column, floor: bool = False) -> Column:
    base = nearest_five(x, floor)
    low, high = (lambda d: F.greatest(F.lit(0), base - d)), (lambda d: F.least(F.lit(100), base + d))
    return F.transform(_first_four(F.array(base, low(10), high(10), low(20), high(20), F.lit(0), F.lit(50), F.lit(100))), lambda v: F.concat(v.cast("string"), F.lit("%")))


def count_choices(n: Column) -> Column:
    n = n.cast("int")
    return F.transform(_first_four(F.array(n, F.greatest(F.lit(0), n - 1), n + 1, n + 2, F.greatest(F.lit(0), n - 2))), lambda v: v.cast("string"))


def ordinal(n: Column) -> Column:
    names = F.array(*map(F.lit, ("first", "second", "third", "fourth", "fifth", "sixth")))
    return F.when(n <= 6, F.get(names, n.cast("int") - 1)).otherwise(F.concat(n.cast("string"), F.lit("th")))
