"""Exact per-group quantiles by radix selection.

A double has an order-preserving integer image, and the value of a given rank is found
digit by digit: count the rows of every leading digit (a hash aggregation
with map-side partial sums), see in whose range the rank lies, and count the next
digit only among the rows with that prefix.  Four digits of 16 bits settle a
double.  Nothing is sorted but digit counts, at most 2^16 a prefix; equal
values are one row from the start, so neither a group nor a value that
holds most rows can pile up in a task.  One plan serves groups of all sizes.

The result equals numpy's default ``percentile`` (linear interpolation, DuckDB
``quantile_cont``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

KEY_BITS, DIGIT_BITS = 64, 16
# of an IEEE double
MANTISSA, BIAS, TOP_EXPONENT = 52, 1023, 2047
LEAST_NORMAL = 2.0 ** -1022
HALF_SUBNORMAL = 2.0 ** 537  # squared, times the smallest subnormal number, it is 1


def ordered_key(v: Column) -> Column:
    """Order-preserving 64-bit image of a double (its bits, mirrored below zero); both zeros are 0, NULL of NULL or NaN.

    Scaling by a power of two is exact, so the mantissa is what is left after the
    exponent; the logarithm only guesses the exponent, to one.
    """
    a = F.abs(v)
    guess = F.floor(F.log2(a)).cast("double")
    rest = a / F.pow(F.lit(2.0), guess)
    e = guess + F.when(rest >= 2, 1.0).when(rest < 1, -1.0).otherwise(0.0)
    mantissa = (a / F.pow(F.lit(2.0), e) - 1) * F.lit(2.0 ** MANTISSA)
    bits = (F.when(a == 0, F.lit(0)).when(a == math.inf, F.lit(TOP_EXPONENT << MANTISSA))
            .when(a < LEAST_NORMAL, (a * HALF_SUBNORMAL * HALF_SUBNORMAL).cast("bigint"))
            .otherwise(F.shiftleft((e + BIAS).cast("bigint"), MANTISSA) + mantissa.cast("bigint")))
    return F.when(F.isnan(v), F.lit(None)).when(v < 0, -bits).otherwise(bits).cast("bigint")


def value_of_key(k: Column) -> Column:
    """The double whose ``ordered_key`` is ``k``."""
    a = F.abs(k)
    e, m = F.shiftright(a, MANTISSA), a.bitwiseAND((1 << MANTISSA) - 1).cast("double")
    size = (F.when(e == 0, m / HALF_SUBNORMAL / HALF_SUBNORMAL).when(e == TOP_EXPONENT, F.lit(math.inf))
            .otherwise((m / F.lit(2.0 ** MANTISSA) + 1) * F.pow(F.lit(2.0), (e - BIAS).cast("double"))))
    return F.when(k < 0, -size).otherwise(size)


def _on(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in cols), F.lit(True))


def _digit(counts: DataFrame, g: list[str], probs: list[float], shift: int, wanted: DataFrame | None) -> DataFrame:
    """(group, prefix, start, total, ranks): the prefixes of one digit more that hold wanted ranks.

    ``counts``: group, key, c; ``wanted``: what the digits before gave, None for the first.
    """
    prefix = F.shiftright("_key", shift)
    if wanted is None:
        digits = counts.groupBy(*g, prefix.alias("_prefix")).agg(F.sum("_c").alias("_c"))
        before = Window.partitionBy(*g)
        digits = digits.withColumn("_total", F.sum("_c").over(before))
        at = [F.lit(p) * (F.col("_total") - 1) for p in probs]
        low = [F.floor(x).cast("bigint") for x in at]
        ranks = F.array_distinct(F.array(*low, *(F.least(x + 1, F.col("_total") - 1) for x in low)))
        digits = digits.withColumn("_ranks", ranks).withColumn("_base", F.lit(0).cast("bigint"))
    else:
        above = F.shiftright("_key", shift + DIGIT_BITS)
        own = counts.withColumn("_above", above)
        named = wanted.withColumnRenamed("_prefix", "_above").withColumnRenamed("_start", "_base")
        inside = own.join(named.select(*g, "_above"), _on(own, named, [*g, "_above"]), "left_semi")
        digits = inside.groupBy(*g, "_above", prefix.alias("_prefix")).agg(F.sum("_c").alias("_c"))
        digits = digits.join(named, _on(digits, named, [*g, "_above"])).select(
            *(digits[c] for c in [*g, "_above", "_prefix", "_c"]), "_total", "_ranks", "_base")
        before = Window.partitionBy(*g, "_above")
    start = F.col("_base") + F.sum("_c").over(before.orderBy("_prefix")) - F.col("_c")
    held = F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_c")))
    return (digits.withColumn("_start", start).withColumn("_ranks", held).where(F.size("_ranks") > 0)
            .select(*g, "_prefix", "_start", "_total", "_ranks"))


def grouped_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str, probs: Sequence[float],
                      approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Rows (group..., prob, n, value) with the linear-interpolated quantile.

    NULL/NaN values are dropped first; a NULL group is a group.  ``approx=True``
    uses ``percentile_approx`` (one pass, bounded memory, rank error 1/accuracy).
    """
    g = list(group_cols)
    probs = [float(p) for p in probs]
    d = df.select(*g, F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    each = F.array(*(F.lit(p) for p in probs))
    if approx:
        agg = d.groupBy(*g).agg(F.count("*").alias("n"), F.percentile_approx("_v", probs, accuracy).alias("_q"))
        return agg.select(*g, F.posexplode("_q").alias("_i", "value"), "n").select(
            *g, F.element_at(each, F.col("_i") + 1).alias("prob"), F.col("n").cast("bigint").alias("n"), "value")

    # every digit reads the distinct values again: they are computed once, and survive lost executors
    counts = reliable_checkpoint(d.groupBy(*g, ordered_key(F.col("_v")).alias("_key")).agg(F.count("*").alias("_c")))
    wanted = None
    for shift in range(KEY_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        wanted = _digit(counts, g, probs, shift, wanted)
    found = wanted.select(*g, F.col("_total").alias("n"), F.explode("_ranks").alias("_rank"), value_of_key(F.col("_prefix")).alias("_v"))
    # at most two ranks a probability
    found = found.groupBy(*g, "n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    out = found.select(*g, "n", "_at", F.explode(each).alias("prob"))
    place = F.col("prob") * (F.col("n") - 1)
    low = F.floor(place).cast("bigint")
    a, b = F.col("_at")[low], F.col("_at")[F.least(low + 1, F.col("n") - 1)]
    value = F.when((a == b) | (place == low), a).otherwise(a + (b - a) * (place - low))
    return out.select(*g, "prob", F.col("n").cast("bigint").alias("n"), value.alias("value"))


def quantile_columns(q: DataFrame, group_cols: Sequence[str], names: dict[float, str]) -> DataFrame:
    """Pivot (group, prob, n, value) into one column per probability."""
    g = list(group_cols)
    aggs = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(name)
            for p, name in names.items()]
    return q.groupBy(*g).agg(F.max("n").alias("n"), *aggs)
