"""Analysis queries: residuals, histograms, quantile bands, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import (bin_index, bin_index_sql, edge_frame, linear_center, log_center, uniform_bin,
                                 uniform_bin_sql)
from ..functions.energy import log_residual, ratio_error, sigma_syst
from ..functions.energy import log_sigma_width as log_sigma_width_col
from ..functions.energy import ratio_single_err as ratio_single_err_cols
from ..functions.stats import metric
from ..operators import features as ft
from ..operators import histograms as hg
from ..operators.common import rounded
from ..session import reliable_checkpoint
from ..sources import fixtures as fx
from .catalog import oracle, query

N_BINS = 20


def residual_frame(spark, sf) -> DataFrame:
    """Physics events with positive true and reconstructed energies:
    x = log10(E_true), y = log10(E_true) - log10(E_truncated) (P18)."""
    f = ft.physics_frames(fx.frames(spark, sf)).where((F.col("e_entry") > 0) & (F.col("e_truncated_gev") > 0))
    return f.select("event_id", "e_entry", "e_truncated_gev", F.log10("e_entry").alias("x"),
                    log_residual("e_entry", "e_truncated_gev").alias("y"))


RESID_SQL = ("SELECT event_id, e_entry, e_truncated_gev, log10(e_entry) AS x, "
             "log10(e_entry) - log10(e_truncated_gev) AS y "
             "FROM frames WHERE stop = 'Physics' AND e_entry > 0 AND e_truncated_gev > 0")


def _band_sql(axis: str, other: str) -> str:
    return _listed("bin", N_BINS, f"SELECT bin, count(*) AS n, quantile_cont({other}, 0.159) AS lower_q, "
                   f"quantile_cont({other}, 0.5) AS median, quantile_cont({other}, 0.841) AS upper_q "
                   f"FROM (SELECT {uniform_bin_sql(axis, 'lo', 'hi', N_BINS)} AS bin, {other} "
                   f"FROM d, (SELECT min({axis}) AS lo, max({axis}) AS hi FROM d) r) b "
                   f"WHERE bin IS NOT NULL GROUP BY bin")


def _listed(bin_col: str, n_bins: int, per_bin: str) -> str:
    """All bins, those without rows too."""
    return (f"SELECT k.{bin_col}, coalesce(a.n, 0) AS n, a.* EXCLUDE ({bin_col}, n) FROM (SELECT cast(range AS bigint) AS {bin_col} "
            f"FROM range(0, {n_bins})) k LEFT JOIN ({per_bin}) a ON a.{bin_col} = k.{bin_col}")


@query("median_band_x", oracle(_band_sql("x", "y"), ["frames"], ["lower_q", "median", "upper_q"], ["bin", "n"],
                               ctes=[("d", RESID_SQL)]), headline=True)
def median_band_x(spark, sf):
    """A9 (flagship): per true-energy bin, median and 1-sigma band of the log residual."""
    d = hg.with_range_bin(residual_frame(spark, sf), F.col("x"), N_BINS)
    return rounded(hg.median_band(d, "bin", "y", N_BINS).select("bin", "n", "lower_q", "median", "upper_q"))


@query("median_band_y", oracle(_band_sql("y", "x"), ["frames"], ["lower_q", "median", "upper_q"], ["bin", "n"],
                               ctes=[("d", RESID_SQL)]))
def median_band_y(spark, sf):
    """Per residual bin, median and band of the true energy."""
    d = hg.with_range_bin(residual_frame(spark, sf), F.col("y"), N_BINS)
    return rounded(hg.median_band(d, "bin", "x", N_BINS).select("bin", "n", "lower_q", "median", "upper_q"))


def _binned_resid(spark, sf, n=N_BINS):
    return hg.with_range_bin(residual_frame(spark, sf), F.col("x"), n)


BINNED_SQL = (f"SELECT d.*, {uniform_bin_sql('x', 'lo', 'hi', N_BINS)} AS bin FROM d, "
              "(SELECT min(x) AS lo, max(x) AS hi FROM d) r")


# ------------------------------------------------------------------ P18
@query("log_residual", oracle("SELECT event_id, y AS residual FROM d", ["frames"], ["residual"], ["event_id"],
                              ctes=[("d", RESID_SQL)]))
def log_residual_q(spark, sf):
    return rounded(residual_frame(spark, sf).select("event_id", F.col("y").alias("residual")))


# ------------------------------------------------------------------ P25
@query("resolution_band", oracle(
    "SELECT bin, mean, std, pow(10.0, mean - std) AS band_lo, pow(10.0, mean + std) AS band_hi, "
    "mean - std AS lin_lo, mean + std AS lin_hi, upper_q - lower_q AS width_1sigma FROM (" + _listed(
        "bin", N_BINS, "SELECT bin, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS std, quantile_cont(y, 0.159) AS lower_q, "
        "quantile_cont(y, 0.841) AS upper_q FROM b WHERE bin IS NOT NULL GROUP BY bin") + ") s", ["frames"],
    ["mean", "std", "band_lo", "band_hi", "lin_lo", "lin_hi", "width_1sigma"], ["bin"],
    ctes=[("d", RESID_SQL), ("b", BINNED_SQL)]))
def resolution_band(spark, sf):
    # read twice, computed once
    b = reliable_checkpoint(_binned_resid(spark, sf).where(F.col("bin").isNotNull()).select("bin", "y"))
    s = b.groupBy("bin").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"))
    lo, hi, llo, lhi = hg.band_columns(F.col("mean"), F.col("std"))
    q = hg.median_band(b, "bin", "y", N_BINS, {0.159: "lower_q", 0.841: "upper_q"})
    out = q.join(s, "bin", "left").select("bin", "mean", "std", lo.alias("band_lo"), hi.alias("band_hi"),
                                  llo.alias("lin_lo"), lhi.alias("lin_hi"),
                                  (F.col("upper_q") - F.col("lower_q")).alias("width_1sigma"))
    return rounded(out)


# ------------------------------------------------------------------ P19
@query("log_sigma_width", oracle(
    "SELECT bin, log10(hi) - log10(lo) AS log_width FROM (" + _listed(
        "bin", N_BINS, "SELECT bin, count(*) AS n, quantile_cont(ratio, 0.841) AS hi, quantile_cont(ratio, 0.159) AS lo FROM "
        "(SELECT bin, e_entry / e_truncated_gev AS ratio FROM b WHERE bin IS NOT NULL) t GROUP BY bin") + ") w",
    ["frames"], ["log_width"], ["bin"], ctes=[("d", RESID_SQL), ("b", BINNED_SQL)]))
def log_sigma_width(spark, sf):
    b = _binned_resid(spark, sf).where(F.col("bin").isNotNull()) \
        .withColumn("ratio", F.col("e_entry") / F.col("e_truncated_gev"))
    q = hg.median_band(b, "bin", "ratio", N_BINS, {0.159: "lower", 0.841: "upper"})
    return rounded(q.select("bin", log_sigma_width_col("upper", "lower").alias("log_width")))


# ------------------------------------------------------------------ P20
RESID2_SQL = RESID_SQL + " AND e_muex_gev > 0"


@query("sigma_syst", oracle(
    "SELECT bin, sigma_tot, sigma_base, CASE WHEN sigma_base <> 0 AND (sigma_tot / sigma_base) * (sigma_tot / sigma_base) - 1 >= 0 "
    "THEN sqrt((sigma_tot / sigma_base) * (sigma_tot / sigma_base) - 1) END AS sigma_syst FROM "
    "(SELECT bin, stddev_pop(y) AS sigma_tot, stddev_pop(log10(e_entry) - log10(e_muex_gev)) AS sigma_base "
    "FROM b WHERE bin IS NOT NULL GROUP BY bin) s", ["frames"], ["sigma_tot", "sigma_base", "sigma_syst"], ["bin"],
    ctes=[("d", RESID2_SQL.replace("SELECT event_id,", "SELECT event_id, e_muex_gev,")), ("b", BINNED_SQL)]))
def sigma_syst_q(spark, sf):
    f = ft.physics_frames(fx.frames(spark, sf)).where(
        (F.col("e_entry") > 0) & (F.col("e_truncated_gev") > 0) & (F.col("e_muex_gev") > 0))
    d = f.select(F.log10("e_entry").alias("x"), log_residual("e_entry", "e_truncated_gev").alias("y"),
                 log_residual("e_entry", "e_muex_gev").alias("y2"))
    b = hg.with_range_bin(d, F.col("x"), N_BINS).where(F.col("bin").isNotNull())
    s = b.groupBy("bin").agg(F.stddev_pop("y").alias("sigma_tot"), F.stddev_pop("y2").alias("sigma_base"))
    return rounded(s.withColumn("sigma_syst", sigma_syst("sigma_tot", "sigma_base")))


# ------------------------------------------------------------------ A2
@query("overall_min_max", oracle(
    "SELECT least(min(e_truncated_gev), min(e_muex_gev), min(e_entry)) AS lo, "
    "greatest(max(e_truncated_gev), max(e_muex_gev), max(e_entry)) AS hi FROM frames WHERE stop = 'Physics'",
    ["frames"], ["lo", "hi"], [], digits=4))
def overall_min_max(spark, sf):
    f = ft.physics_frames(fx.frames(spark, sf))
    return rounded(hg.overall_min_max(f, "e_truncated_gev", "e_muex_gev", "e_entry"), 4)


# ------------------------------------------------------------------ A3 / A4 / A5
E_RANGE_SQL = "SELECT min(e_entry) AS lo, max(e_entry) AS hi FROM frames WHERE stop = 'Physics' AND e_entry > 0"


def _e_range(spark, sf):
    f = ft.physics_frames(fx.frames(spark, sf)).where(F.col("e_entry") > 0)
    return f.agg(F.min("e_entry").alias("lo"), F.max("e_entry").alias("hi"))


def _edges_sql(n_edges: int, log: bool) -> str:
    lo, hi = ("log10(lo)", "log10(hi)") if log else ("lo", "hi")
    lin = (f"CASE WHEN k = {n_edges - 1} THEN {hi} ELSE cast(k AS double) * (({hi} - {lo}) / {float(n_edges - 1)!r}) "
           f"+ {lo} END")
    edge = f"pow(10.0, {lin})" if log else lin
    return f"SELECT cast(k AS bigint) AS edge_no, {edge} AS edge FROM rng, range(0, {n_edges}) t(k)"


@query("log_bin_edges", oracle(_edges_sql(N_BINS + 2, True), ["frames"], ["edge"], ["edge_no"],
                               ctes=[("rng", E_RANGE_SQL)], digits=4))
def log_bin_edges(spark, sf):
    """A3: logspace(lo, hi, n + 2) (n + 1 bins, as the reference's helper)."""
    return rounded(edge_frame(_e_range(spark, sf), "lo", "hi", N_BINS + 2, log=True), 4)


LOG_RANGE_SQL = ("SELECT min(log10(e_entry)) AS lo, max(log10(e_entry)) AS hi FROM frames "
                 "WHERE stop = 'Physics' AND e_entry > 0")


@query("linear_bin_edges", oracle(_edges_sql(N_BINS + 2, False), ["frames"], ["edge"], ["edge_no"],
                                  ctes=[("rng", LOG_RANGE_SQL)]))
def linear_bin_edges(spark, sf):
    """A4: linspace(lo, hi, n + 2) over log10 true energy."""
    f = ft.physics_frames(fx.frames(spark, sf)).where(F.col("e_entry") > 0)
    rng = f.agg(F.min(F.log10("e_entry")).alias("lo"), F.max(F.log10("e_entry")).alias("hi"))
    return rounded(edge_frame(rng, "lo", "hi", N_BINS + 2))


@query("bin_centers", oracle(
    "SELECT a.edge_no AS bin, pow(10.0, log10(a.edge) + (log10(b.edge) - log10(a.edge)) / 2.0) AS log_center, "
    "a.edge + 0.5 * (b.edge - a.edge) AS linear_center FROM e a JOIN e b ON b.edge_no = a.edge_no + 1",
    ["frames"], ["log_center", "linear_center"], ["bin"],
    ctes=[("rng", E_RANGE_SQL), ("e", _edges_sql(N_BINS + 2, True))], digits=4))
def bin_centers(spark, sf):
    """A5: centres of consecutive edges in log10 space and linear space."""
    e = edge_frame(_e_range(spark, sf), "lo", "hi", N_BINS + 2, log=True)
    nxt = e.select((F.col("edge_no") - 1).alias("edge_no"), F.col("edge").alias("next_edge"))
    j = e.join(nxt, "edge_no")
    return rounded(j.select(F.col("edge_no").alias("bin"), log_center("edge", "next_edge").alias("log_center"),
                            linear_center("edge", "next_edge").alias("linear_center")), 4)


# ------------------------------------------------------------------ A6
HIST_BASE_SQL = ("SELECT log10(e_entry) AS x, tint_prob_w AS w FROM frames WHERE stop = 'Physics' AND e_entry > 0")
HIST_BIN_SQL = (f"SELECT {uniform_bin_sql('x', 'lo', 'hi', N_BINS)} AS bin, w FROM hb, "
                "(SELECT min(x) AS lo, max(x) AS hi FROM hb) r")
HIST_SQL = ("SELECT k.bin, coalesce(a.hist, 0.0) AS hist, sqrt(coalesce(a.w2, 0.0)) AS err, "
            "coalesce(a.n, 0) AS n FROM (SELECT cast(range AS bigint) AS bin FROM range(0, " + str(N_BINS) + ")) k "
            "LEFT JOIN (SELECT bin, sum(w) AS hist, sum(w * w) AS w2, count(*) AS n FROM hbin "
            "WHERE bin IS NOT NULL GROUP BY bin) a ON a.bin = k.bin")


def _hist_input(spark, sf):
    f = ft.physics_frames(fx.frames(spark, sf)).where(F.col("e_entry") > 0)
    return hg.with_range_bin(f.select(F.log10("e_entry").alias("x"), F.col("tint_prob_w").alias("w")),
                             F.col("x"), N_BINS)


@query("poisson_hist", oracle(HIST_SQL, ["frames"], ["hist", "err"], ["bin", "n"],
                              ctes=[("hb", HIST_BASE_SQL), ("hbin", HIST_BIN_SQL)]), headline=True)
def poisson_hist(spark, sf):
    """Weighted histogram with sqrt(sum w^2) errors, empty bins kept."""
    return rounded(hg.weighted_hist(_hist_input(spark, sf), "bin", N_BINS, F.col("w")))


@query("poisson_hist_normed", oracle(
    "SELECT bin, hist / width / tot AS hist, err / width / tot AS err, n FROM h, "
    "(SELECT sum(hist) AS tot FROM h) t, (SELECT (max(x) - min(x)) / " + repr(float(N_BINS)) + " AS width FROM hb) wd",
    ["frames"], ["hist", "err"], ["bin", "n"], ctes=[("hb", HIST_BASE_SQL), ("hbin", HIST_BIN_SQL), ("h", HIST_SQL)]))
def poisson_hist_normed(spark, sf):
    """A6 normed: density 1 / width / total."""
    d = _hist_input(spark, sf)
    f = ft.physics_frames(fx.frames(spark, sf)).where(F.col("e_entry") > 0)
    width = f.agg(((F.max(F.log10("e_entry")) - F.min(F.log10("e_entry"))) / float(N_BINS)).alias("w")).first()["w"]
    return rounded(hg.weighted_hist(d, "bin", N_BINS, F.col("w"), normed=True, widths=width))


# Edges given by the caller, wider where events are rare; the range does not reach all events.
EDGES_X = [2.0, 2.2, 2.5, 2.75, 3.0, 3.2, 3.5, 4.0, 4.5, 5.5]
EDGES_Y = [-2.0, -0.75, -0.3, -0.1, 0.0, 0.05, 0.2, 0.6, 1.5]
GIVEN_X, GIVEN_Y = len(EDGES_X) - 1, len(EDGES_Y) - 1


@query("poisson_hist_edges", oracle(
    f"SELECT k.bin, coalesce(hist, 0.0) AS hist, coalesce(err, 0.0) AS err, coalesce(a.n, 0) AS n, coalesce(open_bin_n, 0) AS open_bin_n FROM "
    f"(SELECT cast(range AS bigint) AS bin FROM range(0, {GIVEN_X})) k LEFT JOIN (SELECT bin, sum(w) AS hist, sqrt(sum(w * w)) AS err, "
    f"count(*) AS n FROM (SELECT {bin_index_sql('x', EDGES_X)} AS bin, w FROM hb) z GROUP BY bin) a ON a.bin = k.bin LEFT JOIN "
    f"(SELECT bin, count(*) AS open_bin_n FROM (SELECT {bin_index_sql('x', EDGES_X, False)} AS bin FROM hb) y GROUP BY bin) o "
    "ON o.bin = k.bin", ["frames"], ["hist", "err"], ["bin", "n", "open_bin_n"], ctes=[("hb", HIST_BASE_SQL)]))
def poisson_hist_edges(spark, sf):
    """A6 over edges given by the caller; open_bin_n counts with the right-most edge outside."""
    f = ft.physics_frames(fx.frames(spark, sf)).where(F.col("e_entry") > 0)
    d = f.select(F.log10("e_entry").alias("x"), F.col("tint_prob_w").alias("w"))
    d = d.withColumn("bin", bin_index("x", EDGES_X)).withColumn("open_bin", bin_index("x", EDGES_X, last_closed=False))
    inside = hg.weighted_hist(d, "bin", GIVEN_X, F.col("w"))
    other = d.groupBy(F.col("open_bin").alias("bin")).agg(F.count("*").alias("open_bin_n"))
    return rounded(inside.join(other, "bin", "left").withColumn("open_bin_n", F.coalesce("open_bin_n", F.lit(0)).cast("bigint")))


@query("median_band_edges", oracle(
    _listed("bin", GIVEN_X, "SELECT bin, count(*) AS n, quantile_cont(y, 0.159) AS lower_q, quantile_cont(y, 0.5) AS median, "
            f"quantile_cont(y, 0.841) AS upper_q FROM (SELECT {bin_index_sql('x', EDGES_X)} AS bin, y FROM d) b "
            "WHERE bin IS NOT NULL GROUP BY bin"),
    ["frames"], ["lower_q", "median", "upper_q"], ["bin", "n"], ctes=[("d", RESID_SQL)]))
def median_band_edges(spark, sf):
    """A9 over edges given by the caller: median and band of the residual in each true-energy bin."""
    d = residual_frame(spark, sf).withColumn("bin", bin_index("x", EDGES_X))
    return rounded(hg.median_band(d, "bin", "y", GIVEN_X).select("bin", "n", "lower_q", "median", "upper_q"))


# ------------------------------------------------------------------ A7 / A8
H2_BASE_SQL = ("SELECT log10(e_entry) AS x, log10(e_truncated_gev) AS y FROM frames "
               "WHERE stop = 'Physics' AND e_entry > 0 AND e_truncated_gev > 0")


def _dense2d_sql(nx: int, ny: int, bx_sql: str, by_sql: str, src: str) -> str:
    return (f"SELECT c.xbin, c.ybin, coalesce(a.n, 0) AS n FROM (SELECT cast(i AS bigint) AS xbin, cast(j AS bigint) AS ybin "
            f"FROM range(0, {nx}) t1(i), range(0, {ny}) t2(j)) c LEFT JOIN (SELECT xbin, ybin, count(*) AS n FROM "
            f"(SELECT {bx_sql} AS xbin, {by_sql} AS ybin FROM {src}) z WHERE xbin IS NOT NULL AND ybin IS NOT NULL "
            f"GROUP BY xbin, ybin) a ON a.xbin = c.xbin AND a.ybin = c.ybin")


@query("hist2d", oracle(_dense2d_sql(N_BINS, N_BINS, uniform_bin_sql("x", "xlo", "xhi", N_BINS),
                                     uniform_bin_sql("y", "ylo", "yhi", N_BINS),
                                     "h2, (SELECT min(x) AS xlo, max(x) AS xhi, min(y) AS ylo, max(y) AS yhi FROM h2) r"),
                        ["frames"], [], ["xbin", "ybin", "n"], ctes=[("h2", H2_BASE_SQL)]))
def hist2d_q(spark, sf):
    """Dense 2-D counts of log true energy vs log truncated energy."""
    f = ft.physics_frames(fx.frames(spark, sf)).where((F.col("e_entry") > 0) & (F.col("e_truncated_gev") > 0))
    d = f.select(F.log10("e_entry").alias("x"), F.log10("e_truncated_gev").alias("y"))
    d, _ = hg.with_range_bins(d, xbin=(F.col("x"), N_BINS), ybin=(F.col("y"), N_BINS))
    return hg.hist2d(d, "xbin", "ybin", N_BINS, N_BINS)


@query("hist2d_edges", oracle(_dense2d_sql(GIVEN_X, GIVEN_Y, bin_index_sql("x", EDGES_X), bin_index_sql("y", EDGES_Y), "d"),
                              ["frames"], [], ["xbin", "ybin", "n"], ctes=[("d", RESID_SQL)]))
def hist2d_edges(spark, sf):
    """A7 over edges given by the caller: true energy against residual."""
    d = residual_frame(spark, sf).select(bin_index("x", EDGES_X).alias("xbin"), bin_index("y", EDGES_Y).alias("ybin"))
    return hg.hist2d(d, "xbin", "ybin", GIVEN_X, GIVEN_Y)


# True-energy log bins (Ebins + 1) x residual linear bins (Rbins - 1)
E_BINS, R_BINS = 20, 20
H8_SQL = ("SELECT e_entry AS te, log10(e_entry) - log10(e_truncated_gev) AS res FROM frames "
          "WHERE stop = 'Physics' AND e_entry > 0 AND e_truncated_gev > 0")
H8_SRC = ("(SELECT log10(te) AS lte, res FROM h8) h, (SELECT log10(min(te)) AS xlo, log10(max(te)) AS xhi, "
          "min(res) AS ylo, max(res) AS yhi FROM h8) r")


def _h8(spark, sf):
    f = ft.physics_frames(fx.frames(spark, sf)).where((F.col("e_entry") > 0) & (F.col("e_truncated_gev") > 0))
    d = f.select(F.col("e_entry").alias("te"), log_residual("e_entry", "e_truncated_gev").alias("res"))
    return hg.with_range_bins(d, xbin=(F.log10("te"), E_BINS + 1), ybin=(F.col("res"), R_BINS - 1))


H8_DENSE = _dense2d_sql(E_BINS + 1, R_BINS - 1, uniform_bin_sql("lte", "xlo", "xhi", E_BINS + 1),
                        uniform_bin_sql("res", "ylo", "yhi", R_BINS - 1), H8_SRC)


@query("hist2d_residuals", oracle(H8_DENSE, ["frames"], [], ["xbin", "ybin", "n"], ctes=[("h8", H8_SQL)]))
def hist2d_residuals(spark, sf):
    """Data-driven ranges; log bins in true energy, linear in residual."""
    return hg.hist2d(_h8(spark, sf)[0], "xbin", "ybin", E_BINS + 1, R_BINS - 1)


# ------------------------------------------------------------------ A10 / A11
@query("gauss_slice_eligible", oracle(
    "SELECT xbin, count(*) FILTER (WHERE n > 0) AS nonzero_bins, count(*) FILTER (WHERE n > 0) > 3 AS eligible "
    "FROM h GROUP BY xbin", ["frames"], [], ["xbin", "nonzero_bins", "eligible"], ctes=[("h8", H8_SQL), ("h", H8_DENSE)]))
def gauss_slice_eligible(spark, sf):
    h = hg.hist2d(_h8(spark, sf)[0], "xbin", "ybin", E_BINS + 1, R_BINS - 1)
    return hg.quantile_eligible(h, "xbin")


@query("gauss_slices")
def gauss_slices(spark, sf):
    """A10: per true-energy slice (log x), least-squares Gaussian on the residual
    histogram (linear y; pre-aggregated by Spark, the fit sees only bin counts)."""
    d, edges = _h8(spark, sf)
    return hg.fit_slices(d, [10 ** e for e in edges["xbin"]], edges["ybin"], "log", "linear")


@query("gauss_slices_edges")
def gauss_slices_edges(spark, sf):
    """A10 over edges given by the caller: residual against log10 of the true energy."""
    return hg.gauss_slices(residual_frame(spark, sf), "x", "y", EDGES_X, EDGES_Y, "linear", "linear")


@query("energy_resolution")
def energy_resolution(spark, sf):
    """A10 in log/log space (true vs reconstructed energy), y centres in log10."""
    f = ft.physics_frames(fx.frames(spark, sf)).where((F.col("e_entry") > 0) & (F.col("e_truncated_gev") > 0))
    d = f.select(F.log10("e_entry").alias("te"), F.log10("e_truncated_gev").alias("re"))
    d, edges = hg.with_range_bins(d, xbin=(F.col("te"), N_BINS), ybin=(F.col("re"), N_BINS))
    return hg.fit_slices(d, *([10 ** e for e in edges[k]] for k in ("xbin", "ybin")), "log", "log")


# ------------------------------------------------------------------ P23 / P24
RATIO_BASE_SQL = ("SELECT log10(e_truncated_gev) AS a, CASE WHEN e_muex_gev > 0 THEN log10(e_muex_gev) END AS b "
                  "FROM frames WHERE stop = 'Physics' AND e_truncated_gev > 0")
RATIO_SQL = (
    "SELECT k.bin, coalesce(h.n, 0) AS h, coalesce(bl.n, 0) AS b FROM (SELECT cast(range AS bigint) AS bin FROM range(0, "
    + str(N_BINS) + ")) k LEFT JOIN (SELECT " + uniform_bin_sql("a", "lo", "hi", N_BINS) + " AS bin, count(*) AS n "
    "FROM rb, rr GROUP BY 1) h ON h.bin = k.bin LEFT JOIN (SELECT " + uniform_bin_sql("b", "lo", "hi", N_BINS)
    + " AS bin, count(*) AS n FROM rb, rr WHERE b IS NOT NULL GROUP BY 1) bl ON bl.bin = k.bin")
RATIO_RANGE = "SELECT least(min(a), min(b)) AS lo, greatest(max(a), max(b)) AS hi FROM rb"


def _ratio_hists(spark, sf):
    f = ft.physics_frames(fx.frames(spark, sf)).where(F.col("e_truncated_gev") > 0)
    d = f.select(F.log10("e_truncated_gev").alias("a"), F.when(F.col("e_muex_gev") > 0, F.log10("e_muex_gev")).alias("b"))
    rng = hg.overall_min_max(d, "a", "b").first()
    lo, hi = F.lit(rng["lo"]).cast("double"), F.lit(rng["hi"]).cast("double")
    da = d.withColumn("bin", uniform_bin(F.col("a"), lo, hi, N_BINS))
    db = d.where(F.col("b").isNotNull()).withColumn("bin", uniform_bin(F.col("b"), lo, hi, N_BINS))
    ha = hg.weighted_hist(da, "bin", N_BINS).select("bin", F.col("n").cast("double").alias("h"),
                                                    F.col("err").alias("err_h"))
    hb = hg.weighted_hist(db, "bin", N_BINS).select("bin", F.col("n").cast("double").alias("b"),
                                                    F.col("err").alias("err_b"))
    return ha.join(hb, "bin")


@query("ratio_single_err", oracle(
    "SELECT bin, CASE WHEN b <> 0 THEN h / b END AS ratio, CASE WHEN b <> 0 THEN sqrt(h) / b END AS ratio_err "
    "FROM (" + RATIO_SQL + ") z", ["frames"], ["ratio", "ratio_err"], ["bin"],
    ctes=[("rb", RATIO_BASE_SQL), ("rr", RATIO_RANGE)]))
def ratio_single_err(spark, sf):
    """Ratio of two histograms with the numerator's error only."""
    j = _ratio_hists(spark, sf)
    r, e = ratio_single_err_cols("h", "b", "err_h")
    return rounded(j.select("bin", r.alias("ratio"), e.alias("ratio_err")))


@query("ratio_error", oracle(
    "SELECT bin, CASE WHEN b <> 0 THEN sqrt(b / (b * b) + h * h / (b * b * b * b) * h) END AS ratio_err, "
    "CASE WHEN b <> 0 THEN sqrt(h / (b * b) + h * h / (b * b * b * b) * b) END AS ratio_err_standard "
    "FROM (" + RATIO_SQL + ") z", ["frames"], ["ratio_err", "ratio_err_standard"], ["bin"],
    ctes=[("rb", RATIO_BASE_SQL), ("rr", RATIO_RANGE)]))
def ratio_error_q(spark, sf):
    """Double-error ratio as written (sigma roles as in the reference),
    and the usual propagation; Poisson errors sqrt(n)."""
    j = _ratio_hists(spark, sf)
    return rounded(j.select("bin", ratio_error("h", "b", "err_h", "err_b").alias("ratio_err"),
                            ratio_error("h", "b", "err_h", "err_b", standard=True).alias("ratio_err_standard")))


# ------------------------------------------------------------------ A13
METRIC_BASE_SQL = ("SELECT dataset, coalesce(e_dnn_hive, e_dnn_alt) AS p, log10(e_entry) AS t FROM frames "
                   "WHERE stop = 'Physics' AND e_entry > 0")
_METRIC_SQL = {
    "rmse": "sqrt(avg((p - t) * (p - t)))",
    "pshe": "avg(sqrt(1.0 + (p - t) * (p - t)) - 1.0)",
    "rrmse": "sqrt(avg((p - t) * (p - t) / t))",
}


def _metric_query(name):
    def run(spark, sf):
        f = ft.physics_frames(fx.frames(spark, sf)).where(F.col("e_entry") > 0)
        d = f.select("dataset", ft.dnn_energy().alias("p"), F.log10("e_entry").alias("t"))
        return rounded(d.groupBy("dataset").agg(metric(name, "p", "t").alias("value")))
    sql = oracle(f"SELECT dataset, {_METRIC_SQL[name]} AS value FROM m GROUP BY dataset", ["frames"], ["value"],
                 ["dataset"], ctes=[("m", METRIC_BASE_SQL)])
    return run, sql


for _m in ("rmse", "pshe", "rrmse"):
    _f, _s = _metric_query(_m)
    query(f"metric_{_m}", _s)(_f)


# ------------------------------------------------------------------ W2 / W3 / W4
N_SERIES = 30
EV_BIN_SQL = (f"SELECT event_type, {uniform_bin_sql('value', 'lo', 'hi', N_SERIES)} AS bin FROM events, "
              "(SELECT min(value) AS lo, max(value) AS hi FROM events) r WHERE value IS NOT NULL")
SERIES_SQL = ("SELECT t.event_type, k.bin, coalesce(a.n, 0) AS n FROM (SELECT DISTINCT event_type FROM events) t "
              "CROSS JOIN (SELECT cast(range AS bigint) AS bin FROM range(0, " + str(N_SERIES) + ")) k "
              "LEFT JOIN (SELECT event_type, bin, count(*) AS n FROM eb GROUP BY 1, 2) a "
              "ON a.event_type = t.event_type AND a.bin = k.bin")


def event_series(spark, sf):
    """Per event type, a dense histogram of ``value`` (the series for W2)."""
    ev = fx.table(spark, sf, "events").select("event_type", "value").where(F.col("value").isNotNull())
    b = hg.with_range_bin(ev, F.col("value"), N_SERIES)
    agg = b.groupBy("event_type", "bin").agg(F.count("*").alias("n"))
    types = ev.select("event_type").distinct()
    grid = types.select("event_type", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(N_SERIES - 1).cast("bigint")))
                        .alias("bin"))
    return grid.join(agg, ["event_type", "bin"], "left").select(
        "event_type", "bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def local_maxima(series, key: str, order: str, value: str, factor: float = 1.1):
    """Interior points greater than factor x both neighbours."""
    if factor < 1:
        raise ValueError(f"factor cannot be < 1 but was {factor}")
    w = Window.partitionBy(key).orderBy(order)
    y = F.col(value)
    left, right = F.lag(y).over(w), F.lead(y).over(w)
    return series.withColumn("_l", left).withColumn("_r", right) \
        .where(F.col("_l").isNotNull() & F.col("_r").isNotNull() &
               (y > F.col("_l") * factor) & (y > F.col("_r") * factor)).drop("_l", "_r")


@query("local_maxima", oracle(
    "SELECT event_type, bin, n FROM (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY bin) AS l, "
    "lead(n) OVER (PARTITION BY event_type ORDER BY bin) AS r FROM s) z WHERE l IS NOT NULL AND r IS NOT NULL "
    "AND n > l * 1.1 AND n > r * 1.1", [], [], ["event_type", "bin", "n"], ctes=[("eb", EV_BIN_SQL), ("s", SERIES_SQL)]))
def local_maxima_q(spark, sf):
    return local_maxima(event_series(spark, sf), "event_type", "bin", "n", 1.1)


@query("rolling_windows", oracle(
    "SELECT event_type, bin AS start, avg(n) OVER w AS win_mean, cast(min(n) OVER w AS bigint) AS win_min, "
    "cast(max(n) OVER w AS bigint) AS win_max FROM s "
    "WINDOW w AS (PARTITION BY event_type ORDER BY bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) QUALIFY count(*) OVER w = 3",
    [], ["win_mean"], ["event_type", "start", "win_min", "win_max"], ctes=[("eb", EV_BIN_SQL), ("s", SERIES_SQL)]))
def rolling_windows(spark, sf):
    """Every full length-3 window of each series (mean/min/max)."""
    s = event_series(spark, sf)
    w = Window.partitionBy("event_type").orderBy("bin").rowsBetween(0, 2)
    out = s.select("event_type", F.col("bin").alias("start"), F.avg("n").over(w).alias("win_mean"),
                   F.min("n").over(w).alias("win_min"), F.max("n").over(w).alias("win_max"),
                   F.count("*").over(w).alias("_c"))
    return rounded(out.where(F.col("_c") == 3).drop("_c"))


@query("rolling_windows_2d", oracle(
    "SELECT a.xbin AS wi, a.ybin AS wj, cast(sum(b.n) AS bigint) AS win_sum FROM h a JOIN h b ON b.xbin BETWEEN a.xbin AND a.xbin + 1 "
    "AND b.ybin BETWEEN a.ybin AND a.ybin + 1 WHERE a.xbin <= " + str(E_BINS + 1 - 2) + " AND a.ybin <= " + str(R_BINS - 1 - 2)
    + " GROUP BY a.xbin, a.ybin", ["frames"], [], ["wi", "wj", "win_sum"], ctes=[("h8", H8_SQL), ("h", H8_DENSE)]))
def rolling_windows_2d(spark, sf):
    """Every 2x2 sub-matrix sum of the dense residual histogram
    (each cell is emitted to the windows it belongs to, then summed)."""
    h = hg.hist2d(_h8(spark, sf)[0], "xbin", "ybin", E_BINS + 1, R_BINS - 1)
    offs = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (0, 1) for b in (0, 1)]))
    e = h.select("xbin", "ybin", "n", offs.alias("o")).select(
        (F.col("xbin") - F.col("o.di")).alias("wi"), (F.col("ybin") - F.col("o.dj")).alias("wj"), "n")
    e = e.where((F.col("wi") >= 0) & (F.col("wj") >= 0) & (F.col("wi") <= E_BINS + 1 - 2) &
                (F.col("wj") <= R_BINS - 1 - 2))
    return e.groupBy("wi", "wj").agg(F.sum("n").cast("bigint").alias("win_sum"))
