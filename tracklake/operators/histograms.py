"""Histograms, binned statistics and resolution bands.

Binning is a column expression, so a histogram is one hash aggregation with
map-side partial sums: the shuffle carries (bin, partial sums), not rows.
Empty bins come from a right join with the (tiny) bin index range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import bin_index, uniform_bin
from .quantiles import grouped_quantiles, quantile_columns


def finite(c) -> Column:
    """The value, or NULL where it is NaN or infinite: those do not belong to a range."""
    v = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(v.cast("double")) & (F.abs(v) < float("inf")), v)


def overall_min_max(df: DataFrame, *cols: str) -> DataFrame:
    """A2: one-row (lo, hi) over the finite values of several columns."""
    return df.agg(F.least(*[F.min(finite(c)) for c in cols]).alias("lo"),
                  F.greatest(*[F.max(finite(c)) for c in cols]).alias("hi"))


def with_range_bin(df: DataFrame, x: Column, n: int, name: str = "bin", log: bool = False,
                   lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Bin ``x`` into n equal bins over [lo, hi], by default the data range.

    The data-driven range is one aggregation whose two numbers enter the
    plan as literals: one extra pass, no shuffle of rows.
    """
    xv = F.when(x > 0, F.log10(x)) if log else x
    d = df.withColumn("_x", xv)
    if lo is None or hi is None:
        r = d.agg(F.min(finite("_x")).alias("lo"), F.max(finite("_x")).alias("hi")).first()
        lo_c, hi_c = F.lit(r["lo"]).cast("double"), F.lit(r["hi"]).cast("double")
    else:
        lo_c = F.lit(math.log10(lo) if log else float(lo))
        hi_c = F.lit(math.log10(hi) if log else float(hi))
    return d.withColumn(name, uniform_bin(F.col("_x"), lo_c, hi_c, n)).drop("_x", "_lo", "_hi")


def with_range_bins(df: DataFrame, **axes: tuple[Column, int]) -> tuple[DataFrame, dict[str, list[float]]]:
    """Bin several columns, each into equal bins over its data range, and the edges of the bins.

    ``axes`` maps the name of a bin column to (value, number of bins).  The ranges of all axes
    come from one aggregation.  A range without finite values has no edges, its bins are NULL.
    """
    ends = df.agg(*[f(finite(x)).cast("double").alias(f"{k}_{end}") for k, (x, _) in axes.items()
                    for end, f in (("lo", F.min), ("hi", F.max))]).first()
    edges = {}
    for name, (x, n) in axes.items():
        lo, hi = ends[f"{name}_lo"], ends[f"{name}_hi"]
        df = df.withColumn(name, uniform_bin(x, F.lit(lo).cast("double"), F.lit(hi).cast("double"), n))
        edges[name] = [] if lo is None else [lo + k * ((hi - lo) / n) for k in range(n)] + [hi]
    return df, edges


def weighted_hist(df: DataFrame, bin_col: str, n_bins: int, weight: Column | None = None,
                  normed: bool = False, widths: DataFrame | float | None = None) -> DataFrame:
    """Per bin sum of weights, error sqrt(sum w^2), every bin present.

    ``normed`` divides by bin width and the total (density); widths is a
    (bin, width) frame or one uniform width (1 otherwise).
    """
    w = weight if weight is not None else F.lit(1.0)
    agg = (df.where(F.col(bin_col).isNotNull())
           .groupBy(bin_col).agg(F.sum(w).alias("hist"), F.sum(w * w).alias("_w2"), F.count("*").alias("n")))
    full = all_bins(agg, bin_col, n_bins).select(
        bin_col, F.coalesce("hist", F.lit(0.0)).alias("hist"),
        F.sqrt(F.coalesce("_w2", F.lit(0.0))).alias("err"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    if normed:
        # the bin table has n_bins rows: the total is a window over it
        full = full.withColumn("_tot", F.sum("hist").over(Window.partitionBy()))
        if isinstance(widths, DataFrame):
            full = full.join(F.broadcast(widths), bin_col)
        else:
            full = full.withColumn("width", F.lit(float(widths) if widths is not None else 1.0))
        norm = F.when(F.col("_tot") != 0, 1.0 / F.col("width") / F.col("_tot"))
        full = full.select(bin_col, (F.col("hist") * norm).alias("hist"), (F.col("err") * norm).alias("err"), "n")
    return full


def hist2d(df: DataFrame, bx: str, by: str, nx: int, ny: int, dense: bool = True) -> DataFrame:
    """Counts per (bx, by); ``dense`` adds the empty cells (nx*ny rows)."""
    agg = df.where(F.col(bx).isNotNull() & F.col(by).isNotNull()).groupBy(bx, by).agg(
        F.count("*").cast("bigint").alias("n"))
    if not dense:
        return agg
    spark = df.sparkSession
    cells = spark.range(nx * ny).select((F.col("id") / ny).cast("bigint").alias(bx),
                                        (F.col("id") % ny).cast("bigint").alias(by))
    return cells.join(agg, [bx, by], "left").select(bx, by, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


# One-sigma band around the median (0.5 -/+ 0.341).
BAND_PROBS = {0.159: "lower_q", 0.5: "median", 0.841: "upper_q"}


def median_band(df: DataFrame, bin_col: str, value_col: str, n_bins: int, probs: dict[float, str] | None = None,
                approx: bool = False) -> DataFrame:
    """Per bin n, median and the 15.9 / 84.1 % quantiles of ``value_col``; NULL where a bin has no value."""
    probs = probs or BAND_PROBS
    d = df.where(F.col(bin_col).isNotNull())
    q = quantile_columns(grouped_quantiles(d, [bin_col], value_col, list(probs), approx=approx), [bin_col], probs)
    return all_bins(q, bin_col, n_bins).withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def all_bins(per_bin: DataFrame, bin_col: str, n_bins: int) -> DataFrame:
    """``per_bin`` with a row for each of the ``n_bins`` bins, NULL where it has none."""
    return per_bin.sparkSession.range(n_bins).select(F.col("id").alias(bin_col)).join(per_bin, bin_col, "left")


def _centers(edges: list[float], space: str) -> list[float]:
    pairs = list(zip(edges, edges[1:]))
    if space == "linear":
        return [a + 0.5 * (b - a) for a, b in pairs]
    if space == "log":
        return [10 ** (math.log10(a) + (math.log10(b) - math.log10(a)) / 2) for a, b in pairs]
    raise ValueError(f"space must be 'linear' or 'log', not {space!r}")


def gauss_slices(df: DataFrame, x: str, y: str, x_edges: list[float], y_edges: list[float],
                 x_space: str = "linear", y_space: str = "log") -> DataFrame:
    """A10: a Gaussian for each x-slice of the 2-D histogram of ``x`` and ``y`` over the given edges.

    One row a slice: ``xbin``, ``x_center``, ``n`` entries, ``nonzero_bins``, mean, std, norm and their covariances
    (NULL with at most 3 non-empty bins), ``y_values`` (bin centres, the place of the fit) and ``counts``.
    With ``y_space="log"`` centres lie midway in log10 and the fit is done in log10 of y.
    """
    d = df.select(bin_index(x, x_edges).alias("xbin"), bin_index(y, y_edges).alias("ybin"))
    return fit_slices(d, x_edges, y_edges, x_space, y_space)


def fit_slices(binned: DataFrame, x_edges: list[float], y_edges: list[float], x_space: str = "linear",
               y_space: str = "log") -> DataFrame:
    """``gauss_slices`` of rows that have their bins already (xbin, ybin); a fit sees the counts of one slice."""
    from .solvers import GAUSS_SCHEMA, gauss_slices_pdf
    xc, yc = _centers(x_edges, x_space), _centers(y_edges, y_space)
    if y_space == "log":
        yc = [math.log10(c) for c in yc]
    h = hist2d(binned, "xbin", "ybin", len(xc), len(yc))
    at = F.get(F.lit(yc) if yc else F.array().cast("array<double>"), F.col("ybin").cast("int"))
    fits = h.select("xbin", at.alias("yc"), "n").groupBy("xbin").applyInPandas(gauss_slices_pdf, GAUSS_SCHEMA)
    center = F.get(F.lit(xc) if xc else F.array().cast("array<double>"), F.col("xbin").cast("int"))
    return fits.select("xbin", center.alias("x_center"), *[c for c in fits.columns if c != "xbin"])


def band_columns(mean: Column, std: Column):
    """P25: 10**(mean -/+ std), mean -/+ std."""
    return (F.pow(F.lit(10.0), mean - std), F.pow(F.lit(10.0), mean + std), mean - std, mean + std)


def quantile_eligible(counts: DataFrame, slice_col: str, min_nonzero: int = 4) -> DataFrame:
    """Slices of a 2-D histogram with more than 3 non-empty bins."""
    return counts.groupBy(slice_col).agg(F.count_if(F.col("n") > 0).cast("bigint").alias("nonzero_bins")) \
        .withColumn("eligible", F.col("nonzero_bins") >= min_nonzero)
