"""Histogram binning expressions.

Rule (as a numpy histogram): bins are [a, b) except the last, which is closed;
values outside [lo, hi] get no bin (NULL).  Bin indices are 0-based BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uniform_bin(x, lo, hi, n: int) -> Column:
    """Index of x among n equal bins spanning [lo, hi]; lo/hi may be columns."""
    x, lo, hi = _c(x), _c(lo) if not isinstance(lo, (int, float)) else F.lit(float(lo)), \
        _c(hi) if not isinstance(hi, (int, float)) else F.lit(float(hi))
    norm = F.lit(float(n)) / (hi - lo)
    idx = F.floor((x - lo) * norm).cast("bigint")
    return (F.when((x < lo) | (x > hi) | x.isNull() | F.isnan(x), F.lit(None).cast("bigint"))
            .when(hi == lo, F.lit(0).cast("bigint"))          # degenerate range: one bin, no division
            .when(x == hi, F.lit(n - 1).cast("bigint"))
            .otherwise(F.least(idx, F.lit(n - 1).cast("bigint"))))


def uniform_bin_sql(x: str, lo: str, hi: str, n: int) -> str:
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) OR {x} < {lo} OR {x} > {hi} THEN NULL "
            f"WHEN {hi} = {lo} THEN cast(0 AS bigint) "
            f"WHEN {x} = {hi} THEN cast({n - 1} AS bigint) "
            f"ELSE least(cast(floor(({x} - {lo}) * ({float(n)!r} / ({hi} - {lo}))) AS bigint), cast({n - 1} AS bigint)) END")


def bin_index(x, edges, last_closed: bool = True) -> Column:
    """Index of x among the bins between given edges, NULL outside of them.

    ``edges``: a sorted list, or a column of sorted arrays (regular or not, at most
    2^16 edges).  Bins are [a, b); with ``last_closed`` the last one also holds its
    right edge, as a histogram counts, without it that edge is outside, as ``digitize`` has it.
    The number of edges up to x is found by binary search.
    """
    x = _c(x).cast("double")
    if isinstance(edges, (list, tuple)):
        if len(edges) < 2 or any(not a < b for a, b in zip(edges, edges[1:])):
            raise ValueError("bin edges must be at least two, rising")
        steps = [1 << k for k in reversed(range(len(edges).bit_length()))]
        edges = F.lit([float(e) for e in edges])
    else:
        edges, steps = _c(edges), [1 << k for k in reversed(range(17))]
    up_to = F.aggregate(F.lit(steps), F.lit(0), lambda n, s: F.when(F.get(edges, n + s - 1) <= x, n + s).otherwise(n))
    n, last = up_to.cast("bigint"), F.element_at(edges, -1)
    inside = F.when((n >= 1) & (n < F.size(edges)), n - 1)
    if last_closed:
        inside = F.when(x == last, (F.size(edges) - 2).cast("bigint")).otherwise(inside)
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("bigint")).otherwise(inside)


def bin_index_sql(x: str, edges: list[float], last_closed: bool = True) -> str:
    """The same by comparing with every edge."""
    pairs = list(zip(edges, edges[1:]))
    cases = " ".join(f"WHEN {x} >= {a!r} AND {x} < {b!r} THEN {k}" for k, (a, b) in enumerate(pairs))
    closed = f"WHEN {x} = {edges[-1]!r} THEN {len(pairs) - 1} " if last_closed else ""
    return f"cast(CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL {closed}{cases} END AS bigint)"


def log_bin(x, lo, hi, n: int) -> Column:
    """Equal bins in log10 space between positive lo and hi."""
    x = _c(x)
    lx = F.when(x > 0, F.log10(x))
    llo = F.log10(_c(lo) if not isinstance(lo, (int, float)) else F.lit(float(lo)))
    lhi = F.log10(_c(hi) if not isinstance(hi, (int, float)) else F.lit(float(hi)))
    return uniform_bin(lx, llo, lhi, n)


def edge_frame(spark_or_df, lo, hi, n_edges: int, log: bool = False) -> DataFrame:
    """Edges k=0..n_edges-1 of linspace/logspace(lo, hi) as rows (bin_no, edge).

    ``lo``/``hi`` are column names of a one-row DataFrame (data-driven range)
    when ``spark_or_df`` is a DataFrame, else float literals.
    """
    if isinstance(spark_or_df, SparkSession):
        base = spark_or_df.range(1).select(F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi"))
    else:
        base = spark_or_df.select(F.col(lo).cast("double").alias("_lo"), F.col(hi).cast("double").alias("_hi"))
    if log:
        base = base.select(F.log10("_lo").alias("_lo"), F.log10("_hi").alias("_hi"))
    k = F.col("k")
    step = (F.col("_hi") - F.col("_lo")) / float(n_edges - 1)
    lin = F.when(k == n_edges - 1, F.col("_hi")).otherwise(k.cast("double") * step + F.col("_lo"))
    edge = F.pow(F.lit(10.0), lin) if log else lin
    return (base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_edges - 1))).alias("k"))
            .select(F.col("k").cast("bigint").alias("edge_no"), edge.alias("edge")))


def linear_center(lo_edge, hi_edge) -> Column:
    lo, hi = _c(lo_edge), _c(hi_edge)
    return lo + 0.5 * (hi - lo)


def log_center(lo_edge, hi_edge) -> Column:
    lo, hi = F.log10(_c(lo_edge)), F.log10(_c(hi_edge))
    return F.pow(F.lit(10.0), lo + (hi - lo) / 2.0)
