"""Likelihood-scan operators (L1-L12, W2/W5/W7 on scans, S14/S15, J11).

A fit result is one row: ``(scan, fit_id, is_free, llh, fixed MAP, fitted
MAP)``.  Scans are small (one row per fit), but everything here is still a
DataFrame transformation: one scan of the table, grouped by ``scan``, instead
of one file read per fit point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.energy import delta_llh, mask_above
from .ranks import ranked
from .solvers import not_a_knot_spline, spline_eval, spline_roots

GAMMA, NORM = "gamma_astro", "astro_norm"


def fits_nested(fits: DataFrame) -> DataFrame:
    """Fit-result rows from a rectangular (gamma, norm) grid of fits.

    scan 'gamma_astro' / 'astro_norm': 1-D profile scans (one parameter fixed,
    the other at its best value); 'Freefit': the global best fit; '2d': the
    grid itself with both parameters fixed.
    """
    def pmap(g, n):
        return F.create_map(F.lit(GAMMA), g, F.lit(NORM), n)

    best = F.struct("llh", "fit_id")

    def profile(fixed: str):
        p = fits.groupBy(fixed).agg(F.min_by(F.struct("fit_id", "llh", GAMMA, NORM), best).alias("b"))
        return p.select(F.lit(fixed).alias("scan"), F.col("b.fit_id").alias("fit_id"), F.lit(False).alias("is_free"),
                        F.col("b.llh").alias("llh"), F.create_map(F.lit(fixed), F.col(fixed)).alias("fixed"),
                        pmap(F.col(f"b.{GAMMA}"), F.col(f"b.{NORM}")).alias("fitted"))

    free = fits.agg(F.min_by(F.struct("fit_id", "llh", GAMMA, NORM), best).alias("b")).select(
        F.lit("Freefit").alias("scan"), F.col("b.fit_id").alias("fit_id"), F.lit(True).alias("is_free"),
        F.col("b.llh").alias("llh"), F.create_map().cast("map<string,double>").alias("fixed"),
        pmap(F.col(f"b.{GAMMA}"), F.col(f"b.{NORM}")).alias("fitted"))
    grid = fits.select(F.lit("2d").alias("scan"), "fit_id", F.lit(False).alias("is_free"), "llh",
                       pmap(F.col(GAMMA), F.col(NORM)).alias("fixed"), pmap(F.col(GAMMA), F.col(NORM)).alias("fitted"))
    return profile(GAMMA).unionByName(profile(NORM)).unionByName(free).unionByName(grid)


def scan_fits(nested: DataFrame, param: str) -> DataFrame:
    """The 1-D scan of ``param`` (name pattern + fixed key present)."""
    return nested.where((F.col("scan") == param) & F.map_contains_key("fixed", param))


def peek_fit(nested: DataFrame, param: str) -> DataFrame:
    """One fit of a scan, deterministically the lowest fit_id."""
    return scan_fits(nested, param).orderBy("fit_id").limit(1)


def best_fit(nested: DataFrame, manual_llh: float | None = None) -> DataFrame:
    """One row (min_llh, best_gamma, best_phi).

    Free fit if present, else 0.0 (or the manual value) with NULL parameters.
    """
    spark = nested.sparkSession
    free = nested.where(F.col("is_free")).orderBy("fit_id").limit(1).select(
        F.lit(0).alias("_k"), F.col("llh").alias("_llh"), F.col("fitted")[GAMMA].alias("best_gamma"),
        F.col("fitted")[NORM].alias("best_phi"))
    one = spark.range(1).select(F.lit(0).alias("_k"))
    j = one.join(free, "_k", "left")
    llh = F.lit(float(manual_llh)) if manual_llh is not None else F.coalesce(F.col("_llh"), F.lit(0.0))
    return j.select(llh.alias("min_llh"), "best_gamma", "best_phi")


def with_min(df: DataFrame, best: DataFrame) -> DataFrame:
    """Attach the best-fit LLH (``best`` is exactly one row) as a literal."""
    return df.withColumn("min_llh", F.lit(best.first()["min_llh"]).cast("double"))


def llh_scan_1d(nested: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """L1: gamma and phi profile scans with 2*dLLH and the profiled partner.

    Empty when either scan is missing (the reference returns None).
    """
    best = best if best is not None else best_fit(nested)
    s = nested.where(F.col("scan").isin(GAMMA, NORM))
    s = with_min(s, best)
    partner = F.when(F.col("scan") == GAMMA, F.col("fitted")[NORM]).otherwise(F.col("fitted")[GAMMA])
    point = F.when(F.col("scan") == GAMMA, F.col("fixed")[GAMMA]).otherwise(F.col("fixed")[NORM])
    out = s.select(F.when(F.col("scan") == GAMMA, "gamma").otherwise("phi").alias("scanned"),
                   point.alias("scan_point"), delta_llh("llh", F.col("min_llh")).alias("dllh2"),
                   partner.alias("fitted_partner"), "fitted")
    n_kinds = out.agg(F.countDistinct("scanned").alias("k")).first()["k"]
    return out if n_kinds == 2 else out.where(F.lit(False))


def sorted_scan(scan: DataFrame, part: str = "scanned", order: str = "scan_point") -> DataFrame:
    """Position of every point in the sorted scan (companions move along)."""
    return ranked(scan, [order], [part])


def param_scan(nested: DataFrame, param: str, best: DataFrame | None = None) -> DataFrame:
    """L3: fixed value, 2*dLLH and fitted parameters of a 1-D scan, sorted."""
    best = best if best is not None else best_fit(nested)
    s = with_min(scan_fits(nested, param), best)
    out = s.select(F.col("fixed")[param].alias(f"fixed_{param}"), delta_llh("llh", F.col("min_llh")).alias("dllh2"),
                   "fitted")
    return ranked(out, [f"fixed_{param}"])


def fitted_wide(df: DataFrame, col: str = "fitted", keys=None, check: bool = True) -> DataFrame:
    """L4: map per row -> one column per key; differing key sets raise."""
    if check:
        ks = df.select(F.array_sort(F.map_keys(col)).alias("k")).distinct().limit(2).collect()
        if len(ks) > 1:
            raise ValueError(f"rows have different keys: {[r.k for r in ks]}")
        keys = keys or (ks[0].k if ks else [])
    return df.select(*[c for c in df.columns if c != col], *[F.col(col)[k].alias(k) for k in keys])


def fitted_long(df: DataFrame, keys, id_cols) -> DataFrame:
    """Columns -> (key, value) rows (one map per row exploded)."""
    m = F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))])
    return df.select(*id_cols, F.explode(m).alias("key", "value"))


def segments(points: DataFrame, part: str, x: str, y: str) -> DataFrame:
    """Consecutive point pairs of each curve (x0, y0, x1, y1, seg)."""
    numbered = ranked(points.select(part, F.col(x).alias("x0"), F.col(y).alias("y0")), ["x0"], [part], "seg")
    after = numbered.select(part, (F.col("seg") - 1).alias("seg"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    return numbered.join(after, [part, "seg"]).select(part, "x0", "y0", "x1", "y1", "seg")


def local_maxima(scan: DataFrame, part: str, y: str, factor: float = 1.1) -> DataFrame:
    """W2 on numbered points (``pos``): those above ``factor`` times either neighbour."""
    if factor < 1:
        raise ValueError(f"factor cannot be < 1 but was set to {factor}")
    def beside(step: int, name: str) -> DataFrame:
        return scan.select(part, (F.col("pos") + step).alias("pos"), F.col(y).alias(name))
    both = scan.join(beside(1, "_left"), [part, "pos"]).join(beside(-1, "_right"), [part, "pos"])
    return both.where((F.col(y) > F.col("_left") * factor) & (F.col(y) > F.col("_right") * factor)).drop("_left", "_right")


def covered_nodes(low: Column, high: Column, lo: Column, hi: Column, n: int) -> Column:
    """Grid nodes (k, x) of n equally spaced ones on [lo, hi] that lie in [low, high), or in [low, hi] if high is hi.

    The nodes follow from the ends by arithmetic; one more on either side is
    looked at, so that rounding loses none.
    """
    step = (hi - lo) / float(n - 1)
    near = lambda v, by: F.least(F.greatest((F.floor((v - lo) / step) + by).cast("int"), F.lit(0)), F.lit(n - 1))
    at = lambda k: F.struct(k.cast("bigint").alias("k"), F.when(k == n - 1, hi).otherwise(k.cast("double") * step + lo).alias("x"))
    nodes = F.transform(F.sequence(near(low, -1), near(high, 2)), at)
    return F.when(hi > lo, F.filter(nodes, lambda g: (g["x"] >= low) & ((g["x"] < high) | ((high == hi) & (g["x"] == hi)))))


def interp_linear(points: DataFrame, part: str, x: str, y: str, n: int = 1000) -> DataFrame:
    """N equally spaced points in [min x, max x], linear interpolation; NULL where no segment is defined."""
    rng = points.groupBy(part).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    k = F.col("k")
    grid = rng.select(part, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select(
        part, "k", F.when(k == n - 1, F.col("hi"))
        .otherwise(k.cast("double") * ((F.col("hi") - F.col("lo")) / float(n - 1)) + F.col("lo")).alias("xg"), "hi")
    # every segment emits the grid points that it covers
    seg = segments(points, part, x, y).join(rng, part)
    seg = seg.withColumn("node", F.explode(covered_nodes(F.col("x0"), F.col("x1"), F.col("lo"), F.col("hi"), n)))
    yg = F.col("y0") + (F.col("node.x") - F.col("x0")) * ((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    found = seg.select(part, F.col("node.k").alias("k"), yg.alias("y"))
    return grid.select(part, F.col("k").cast("bigint").alias("k"), F.col("xg").alias("x")).join(found, [part, "k"], "left")


def level_crossings(points: DataFrame, part: str, x: str, y: str, level: float) -> DataFrame:
    """L7 (linear form): x where the piecewise-linear curve reaches ``level``."""
    seg = segments(points, part, x, y)
    a, b = F.col("y0") - level, F.col("y1") - level
    hit = (a == 0) | (a * b < 0) | ((b == 0) & F.col("_last"))
    ends = seg.groupBy(part).agg(F.max("seg").alias("_end"))
    seg = seg.join(ends, part).withColumn("_last", F.col("seg") == F.col("_end"))
    xc = (F.when(a == 0, F.col("x0")).when(b == 0, F.col("x1"))
          .otherwise(F.col("x0") + (level - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))))
    out = seg.where(hit).select(part, xc.alias("x_cross"))
    return ranked(out, ["x_cross"], [part], "n_cross")


def curve_widths(crossings: DataFrame, part: str) -> DataFrame:
    """Distance between the first two crossings of each curve."""
    c = crossings.where(F.col("n_cross") < 2)
    return c.groupBy(part).agg(F.count("*").alias("_n"), (F.max("x_cross") - F.min("x_cross")).alias("width")) \
        .where(F.col("_n") == 2).drop("_n")


# ------------------------------------------------------------------ cubic forms
# A cubic spline is a tridiagonal system in which a row's neighbours weigh at most half of
# it: what lies HALO points away changes a coefficient by less than 2^-HALO of itself.  So
# chunks of a curve are solved on their own, each with HALO points more on either side.
CHUNK, HALO = 256, 64


def _chunks(numbered: DataFrame, part: str, x: str, y: str, chunk: int, halo: int) -> DataFrame:
    """Points (pos from 0) of each chunk with the halo around it; a point is in as many chunks as need it."""
    last = numbered.groupBy(part).agg(F.max("pos").alias("_last"))
    pos = F.col("pos")
    need = F.sequence(F.floor(F.greatest(pos - halo - 1, F.lit(0)) / chunk), F.floor(F.least(pos + halo, F.col("_last")) / chunk))
    return numbered.join(last, part).select(part, "pos", F.col(x).alias("_x"), F.col(y).alias("_y"), F.explode(need).alias("chunk"))


def cubic_crossings(points: DataFrame, part: str, x: str, y: str, level: float, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """L7 cubic: roots of the interpolating cubic spline through each curve (none of fewer than 4 points)."""
    def roots(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        xs, own = pdf["_x"].to_numpy(), pdf["pos"].to_numpy() // chunk == pdf["chunk"].iloc[0]
        rs = np.asarray(spline_roots(xs, pdf["_y"].to_numpy(), level) if len(pdf) >= 4 else [], dtype=float)
        after = np.flatnonzero(own)[-1] + 1  # the chunk ends where the next one starts
        inside = (rs >= xs[own][0]) & (rs < xs[after] if after < len(xs) else True)
        return pd.DataFrame({part: np.full(int(inside.sum()), pdf[part].iloc[0], dtype=object), "x_cross": rs[inside]})

    parts = _chunks(ranked(points.select(part, x, y), [x], [part]), part, x, y, chunk, halo)
    found = parts.groupBy(part, "chunk").applyInPandas(roots, f"{part} string, x_cross double")
    return ranked(found, ["x_cross"], [part], "n_cross").select(part, "n_cross", "x_cross")


def clean_interp(points: DataFrame, part: str, x: str, y: str, bad: DataFrame | None = None,
                 n: int = 1000, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """Drop bad points (W7), interpolating cubic spline, n-point curve over the range of all points."""
    pts = points.select(part, x, y)
    if bad is not None:
        pts = pts.join(bad.select(part, x), [part, x], "left_anti")
    lo_hi = points.groupBy(part).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    parts = _chunks(ranked(pts, [x], [part]), part, x, y, chunk, halo).join(lo_hi, part)

    def curve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        xs, ys, number = pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), pdf["chunk"].iloc[0]
        own = pdf["pos"].to_numpy() // chunk == number
        grid = np.linspace(pdf["_lo"].iloc[0], pdf["_hi"].iloc[0], n)
        after = np.flatnonzero(own)[-1] + 1
        mine = (grid >= xs[own][0] if number else True) & (grid < xs[after] if after < len(xs) else np.full(n, True))
        k = np.flatnonzero(mine)
        yf = spline_eval(xs, ys, not_a_knot_spline(xs, ys), grid[k]) if len(xs) >= 4 else np.full(len(k), np.nan)
        return pd.DataFrame({part: np.full(len(k), pdf[part].iloc[0], dtype=object), "k": k.astype("int64"), "x": grid[k], "y": yf})

    return parts.groupBy(part, "chunk").applyInPandas(curve, f"{part} string, k long, x double, y double")


# ------------------------------------------------------------------ L10 / L11
def llh_surface(points: DataFrame, x: str, y: str, v: str, nx: int = 1000, ny: int = 1002,
                max_value: float = 30.0) -> DataFrame:
    """Linear interpolation of a rectangular scan on an nx x ny grid.

    A cell lies between neighbouring values of both axes; its four corners are
    joined once, on the points of the scan, and it emits the grid nodes that it covers.  The
    cell is split along its lower-left/upper-right diagonal and the value is
    linear on the triangle.  All nodes are kept: NULL where a corner of the cell is missing, and where
    the value is above ``max_value``.
    """
    spark = points.sparkSession
    ends = points.agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max)))).first()

    def axis(col: str, n: int, name: str) -> DataFrame:
        """Neighbouring values (0, 1) of an axis with the nodes between them."""
        numbered = ranked(points.select(F.col(col).alias(f"{name}0")).distinct(), [f"{name}0"], (), "at")
        after = numbered.select((F.col("at") - 1).alias("at"), F.col(f"{name}0").alias(f"{name}1"))
        lo, hi = F.lit(ends[f"lo_{col}"]).cast("double"), F.lit(ends[f"hi_{col}"]).cast("double")
        return numbered.join(after, "at").drop("at").withColumn(
            f"{name}_nodes", covered_nodes(F.col(f"{name}0"), F.col(f"{name}1"), lo, hi, n))

    def corner(cx: str, cy: str, name: str) -> DataFrame:
        return points.select(F.col(x).alias(cx), F.col(y).alias(cy), F.col(v).alias(name))

    cells = (corner("x0", "y0", "v00").join(axis(x, nx, "x"), "x0").join(axis(y, ny, "y"), "y0")
             .join(corner("x1", "y0", "v10"), ["x1", "y0"]).join(corner("x0", "y1", "v01"), ["x0", "y1"])
             .join(corner("x1", "y1", "v11"), ["x1", "y1"]))
    inside = cells.withColumn("gx", F.explode("x_nodes")).drop("x_nodes").withColumn("gy", F.explode("y_nodes")).drop("y_nodes")
    u = (F.col("gx.x") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    t = (F.col("gy.x") - F.col("y0")) / (F.col("y1") - F.col("y0"))
    lower = F.col("v00") + u * (F.col("v10") - F.col("v00")) + t * (F.col("v11") - F.col("v10"))
    upper = F.col("v00") + t * (F.col("v01") - F.col("v00")) + u * (F.col("v11") - F.col("v01"))
    found = inside.select(F.col("gx.k").alias("gi"), F.col("gy.k").alias("gj"), F.when(u >= t, lower).otherwise(upper).alias("ts"))

    def node(col: str, k: Column, n: int) -> Column:
        lo, hi = F.lit(ends[f"lo_{col}"]).cast("double"), F.lit(ends[f"hi_{col}"]).cast("double")
        return F.when(k == n - 1, hi).otherwise(k.cast("double") * ((hi - lo) / float(n - 1)) + lo)

    nodes = spark.range(nx * ny).select((F.col("id") / ny).cast("bigint").alias("gi"), (F.col("id") % ny).cast("bigint").alias("gj"))
    nodes = nodes.select("gi", "gj", node(x, F.col("gi"), nx).alias(x), node(y, F.col("gj"), ny).alias(y))
    return nodes.join(found, ["gi", "gj"], "left").withColumn("ts", mask_above("ts", max_value))


def band_of(ts: Column, levels) -> Column:
    """0 inside 1 sigma, 1 inside 2 sigma, ...; NULL when masked."""
    e = None
    for i, lv in enumerate(levels):
        e = (F.when(ts <= lv, i) if e is None else e.when(ts <= lv, i))
    return e.otherwise(len(levels)).cast("bigint")
