"""Likelihood-scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.energy import delta_llh, mask_above
from ..functions.stats import chisq_for_sigma, sigma_for_chisq_col, sigma_k2_sql
from ..operators import scans as sc
from ..operators.common import rounded
from ..sources import fixtures as fx
from .catalog import oracle, query

G, N = sc.GAMMA, sc.NORM

FN_CTES = [
    ("g1", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gamma_astro ORDER BY llh, fit_id) AS rn "
           "FROM fits) z WHERE rn = 1"),
    ("n1", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY astro_norm ORDER BY llh, fit_id) AS rn "
           "FROM fits) z WHERE rn = 1"),
    ("ff", "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY llh, fit_id) AS rn FROM fits) z WHERE rn = 1"),
    ("fn", "SELECT 'gamma_astro' AS scan, fit_id, false AS is_free, llh, gamma_astro AS fixed_value, "
           "gamma_astro AS fitted_gamma, astro_norm AS fitted_norm FROM g1 "
           "UNION ALL SELECT 'astro_norm', fit_id, false, llh, astro_norm, gamma_astro, astro_norm FROM n1 "
           "UNION ALL SELECT 'Freefit', fit_id, true, llh, NULL, gamma_astro, astro_norm FROM ff "
           "UNION ALL SELECT '2d', fit_id, false, llh, NULL, gamma_astro, astro_norm FROM fits"),
    ("best", "SELECT coalesce((SELECT llh FROM fn WHERE is_free ORDER BY fit_id LIMIT 1), 0.0) AS min_llh, "
             "(SELECT fitted_gamma FROM fn WHERE is_free ORDER BY fit_id LIMIT 1) AS best_gamma, "
             "(SELECT fitted_norm FROM fn WHERE is_free ORDER BY fit_id LIMIT 1) AS best_phi"),
    ("s1", "SELECT CASE WHEN scan = 'gamma_astro' THEN 'gamma' ELSE 'phi' END AS scanned, fixed_value AS scan_point, "
           "2 * (llh - (SELECT min_llh FROM best)) AS dllh2, CASE WHEN scan = 'gamma_astro' THEN fitted_norm "
           "ELSE fitted_gamma END AS fitted_partner FROM fn WHERE scan IN ('gamma_astro', 'astro_norm')"),
]


def _nested(spark, sf):
    return sc.fits_nested(fx.fits(spark, sf))


def _profiles(spark, sf):
    nested = _nested(spark, sf)
    return sc.llh_scan_1d(nested, sc.best_fit(nested))


@query("scan_fits", oracle("SELECT scan, fit_id, fixed_value, llh FROM fn WHERE scan = 'gamma_astro'", ["fits"],
                           ["fixed_value", "llh"], ["scan", "fit_id"], ctes=FN_CTES))
def scan_fits(spark, sf):
    s = sc.scan_fits(_nested(spark, sf), G)
    return rounded(s.select("scan", "fit_id", F.col("fixed")[G].alias("fixed_value"), "llh"))


@query("peek_fit", oracle("SELECT fit_id, llh FROM fn WHERE scan = 'gamma_astro' ORDER BY fit_id LIMIT 1", ["fits"],
                          ["llh"], ["fit_id"], ctes=FN_CTES))
def peek_fit(spark, sf):
    return rounded(sc.peek_fit(_nested(spark, sf), G).select("fit_id", "llh"))


@query("best_fit", oracle("SELECT * FROM best", ["fits"], ["min_llh", "best_gamma", "best_phi"], [], ctes=FN_CTES))
def best_fit(spark, sf):
    return rounded(sc.best_fit(_nested(spark, sf)))


@query("llh_scan_1d", oracle(
    "SELECT *, cast(row_number() OVER (PARTITION BY scanned ORDER BY scan_point) - 1 AS bigint) AS pos FROM s1",
    ["fits"], ["scan_point", "dllh2", "fitted_partner"], ["scanned", "pos"], ctes=FN_CTES))
def llh_scan_1d(spark, sf):
    """L1 (+W5 order): both profile scans, 2*dLLH and the profiled partner."""
    p = sc.sorted_scan(_profiles(spark, sf))
    return rounded(p.select("scanned", "scan_point", "dllh2", "fitted_partner", "pos"))


@query("sorted_scan", oracle(
    "SELECT scan_point, dllh2, cast(row_number() OVER (ORDER BY scan_point) - 1 AS bigint) AS pos FROM s1 "
    "WHERE scanned = 'phi'", ["fits"], ["scan_point", "dllh2"], ["pos"], ctes=FN_CTES))
def sorted_scan(spark, sf):
    """The phi scan sorted by its scan values, companions carried along."""
    p = sc.sorted_scan(_profiles(spark, sf).where(F.col("scanned") == "phi"))
    return rounded(p.select("scan_point", "dllh2", "pos"))


@query("param_scan", oracle(
    "SELECT fixed_value AS fixed_astro_norm, 2 * (llh - (SELECT min_llh FROM best)) AS dllh2, fitted_gamma, "
    "fitted_norm, cast(row_number() OVER (ORDER BY fixed_value) - 1 AS bigint) AS pos FROM fn WHERE scan = 'astro_norm'",
    ["fits"], ["fixed_astro_norm", "dllh2", "fitted_gamma", "fitted_norm"], ["pos"], ctes=FN_CTES))
def param_scan(spark, sf):
    """L3: any parameter's scan (astro_norm here)."""
    nested = _nested(spark, sf)
    p = sc.param_scan(nested, N, sc.best_fit(nested))
    return rounded(p.select(f"fixed_{N}", "dllh2", F.col("fitted")[G].alias("fitted_gamma"),
                            F.col("fitted")[N].alias("fitted_norm"), "pos"))


@query("fitted_wide", oracle("SELECT scan, fit_id, fitted_gamma AS gamma_astro, fitted_norm AS astro_norm FROM fn",
                             ["fits"], ["gamma_astro", "astro_norm"], ["scan", "fit_id"], ctes=FN_CTES))
def fitted_wide(spark, sf):
    """L4: fitted map -> one column per key (key sets checked equal)."""
    w = sc.fitted_wide(_nested(spark, sf).select("scan", "fit_id", "fitted"))
    return rounded(w.select("scan", "fit_id", G, N))


@query("fitted_long", oracle(
    "SELECT scan, fit_id, 'gamma_astro' AS key, fitted_gamma AS value FROM fn UNION ALL "
    "SELECT scan, fit_id, 'astro_norm' AS key, fitted_norm AS value FROM fn", ["fits"], ["value"],
    ["scan", "fit_id", "key"], ctes=FN_CTES))
def fitted_long(spark, sf):
    """The wide columns back to (key, value) rows."""
    w = sc.fitted_wide(_nested(spark, sf).select("scan", "fit_id", "fitted"), keys=[G, N], check=False)
    return rounded(sc.fitted_long(w, [G, N], ["scan", "fit_id"]))


@query("scan_by_systematic", oracle(
    "SELECT scan, count(*) AS n_points, min(llh) AS min_llh, max(llh) AS max_llh FROM fn GROUP BY scan",
    ["fits"], ["min_llh", "max_llh"], ["scan", "n_points"], ctes=FN_CTES))
def scan_by_systematic(spark, sf):
    """One result group per scan, all in one aggregation."""
    n = _nested(spark, sf)
    return rounded(n.groupBy("scan").agg(F.count("*").alias("n_points"), F.min("llh").alias("min_llh"),
                                         F.max("llh").alias("max_llh")))


# ------------------------------------------------------------------ P26 / P27 / L12
def _grid_ts(spark, sf):
    nested = _nested(spark, sf)
    g = nested.where(F.col("scan") == "2d")
    g = sc.with_min(g, sc.best_fit(nested))
    return g.select("fit_id", F.col("fixed")[G].alias(G), F.col("fixed")[N].alias(N), "llh",
                    delta_llh("llh", F.col("min_llh")).alias("ts"))


GRID_SQL = "SELECT fit_id, fitted_gamma AS gamma_astro, fitted_norm AS astro_norm, llh, " \
           "2 * (llh - (SELECT min_llh FROM best)) AS ts FROM fn WHERE scan = '2d'"
GRID_CTES = FN_CTES + [("gr", GRID_SQL)]


@query("delta_llh", oracle("SELECT fit_id, ts AS dllh_best, 2 * llh AS ts_2d FROM gr", ["fits"],
                           ["dllh_best", "ts_2d"], ["fit_id"], ctes=GRID_CTES))
def delta_llh_q(spark, sf):
    g = _grid_ts(spark, sf)
    return rounded(g.select("fit_id", F.col("ts").alias("dllh_best"), delta_llh("llh").alias("ts_2d")))


@query("mask_outliers", oracle("SELECT fit_id, ts, CASE WHEN ts <= 30.0 THEN ts END AS ts_masked FROM gr",
                               ["fits"], ["ts", "ts_masked"], ["fit_id"], ctes=GRID_CTES))
def mask_outliers(spark, sf):
    g = _grid_ts(spark, sf)
    return rounded(g.select("fit_id", "ts", mask_above("ts", 30.0).alias("ts_masked")))


@query("llh_scan_2d", oracle(
    "SELECT fit_id, gamma_astro, astro_norm, 2 * llh AS ts, b.best_gamma, b.best_phi, 2 * b.min_llh AS best_ts "
    "FROM gr, best b", ["fits"], ["gamma_astro", "astro_norm", "ts", "best_gamma", "best_phi", "best_ts"],
    ["fit_id"], ctes=GRID_CTES))
def llh_scan_2d(spark, sf):
    """Gamma, phi, 2*llh per grid fit (as written: not best-subtracted)
    plus the best-fit point."""
    nested = _nested(spark, sf)
    b = sc.best_fit(nested).first()
    g = nested.where(F.col("scan") == "2d")
    return rounded(g.select("fit_id", F.col("fixed")[G].alias(G), F.col("fixed")[N].alias(N),
                            delta_llh("llh").alias("ts"), F.lit(b["best_gamma"]).cast("double").alias("best_gamma"),
                            F.lit(b["best_phi"]).cast("double").alias("best_phi"),
                            (2.0 * F.lit(b["min_llh"]).cast("double")).alias("best_ts")))


# ------------------------------------------------------------------ P21 / P22
LEVELS_K2 = {s: chisq_for_sigma(s, 2) for s in (1, 2, 3)}


@query("chisq_levels", oracle(
    "SELECT cast(s.sigma AS bigint) AS sigma, s.level_k1, s.level_k2, (SELECT count(*) FROM gr WHERE ts <= s.level_k2) "
    "AS n_within FROM (VALUES " + ", ".join(f"({k}, {float(k * k)!r}, {v!r})" for k, v in LEVELS_K2.items())
    + ") s(sigma, level_k1, level_k2)", ["fits"], ["level_k1", "level_k2"], ["sigma", "n_within"], ctes=GRID_CTES))
def chisq_levels(spark, sf):
    """Chi-square levels for 1-3 sigma (k=1, k=2) and the grid points inside each."""
    g = _grid_ts(spark, sf)
    aggs = [F.count_if(F.col("ts") <= F.lit(v)).alias(f"n{k}") for k, v in LEVELS_K2.items()]
    counts = g.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("sigma"),
                                        F.lit(chisq_for_sigma(k, 1)).alias("level_k1"),
                                        F.lit(v).alias("level_k2"), F.col(f"n{k}").alias("n_within"))
                               for k, v in LEVELS_K2.items()]))
    return rounded(counts.select(rows.alias("r")).select("r.*"))


@query("sigma_of_chisq", oracle(
    "SELECT scanned, scan_point, CASE WHEN dllh2 >= 0 THEN sqrt(dllh2) END AS sigma FROM s1", ["fits"],
    ["scan_point", "sigma"], ["scanned"], ctes=FN_CTES))
def sigma_of_chisq(spark, sf):
    """P22, k=1: the Gaussian sigma of each profile point."""
    p = _profiles(spark, sf)
    return rounded(p.select("scanned", "scan_point", sigma_for_chisq_col("dllh2", 1).alias("sigma")))


@query("sigma_of_chisq_k2", oracle(
    "SELECT fit_id, ts, " + sigma_k2_sql("ts") + " AS sigma FROM gr", ["fits"], ["ts", "sigma"], ["fit_id"], ctes=GRID_CTES))
def sigma_of_chisq_k2(spark, sf):
    """P22, k=2: the normal quantile of the upper tail, as a column expression."""
    g = _grid_ts(spark, sf)
    return rounded(g.select("fit_id", "ts", sigma_for_chisq_col("ts", 2).alias("sigma")))


# ------------------------------------------------------------------ L6 / L7 / L8 / L9 / W7
SEG_SQL = ("SELECT scanned, scan_point AS x0, dllh2 AS y0, lead(scan_point) OVER w AS x1, lead(dllh2) OVER w AS y1, "
           "row_number() OVER w - 1 AS seg FROM s1 WINDOW w AS (PARTITION BY scanned ORDER BY scan_point)")


@query("interp_linear", oracle(
    "SELECT g.scanned, g.k, g.xg AS x, s.y0 + (g.xg - s.x0) * ((s.y1 - s.y0) / (s.x1 - s.x0)) AS y FROM "
    "(SELECT r.scanned, cast(t.k AS bigint) AS k, r.hi, CASE WHEN t.k = 999 THEN r.hi ELSE "
    "cast(t.k AS double) * ((r.hi - r.lo) / 999.0) + r.lo END AS xg FROM (SELECT scanned, min(scan_point) AS lo, "
    "max(scan_point) AS hi FROM s1 GROUP BY scanned) r, range(0, 1000) t(k)) g LEFT JOIN (SELECT * FROM seg "
    "WHERE x1 IS NOT NULL) s ON s.scanned = g.scanned AND g.xg >= s.x0 AND (g.xg < s.x1 OR (s.x1 = g.hi AND g.xg = g.hi))",
    ["fits"], ["x", "y"], ["scanned", "k"], ctes=FN_CTES + [("seg", SEG_SQL)]))
def interp_linear(spark, sf):
    """1000-point linear interpolation of each profile scan."""
    p = _profiles(spark, sf)
    return rounded(sc.interp_linear(p, "scanned", "scan_point", "dllh2", 1000))


CROSS_LEVEL = 1.0


def _cross_sql(level: float, src: str = "seg") -> str:
    a, b = f"(y0 - {level!r})", f"(y1 - {level!r})"
    return (f"SELECT scanned, cast(row_number() OVER (PARTITION BY scanned ORDER BY x_cross) - 1 AS bigint) AS n_cross, "
            f"x_cross FROM (SELECT scanned, CASE WHEN {a} = 0 THEN x0 WHEN {b} = 0 THEN x1 ELSE "
            f"x0 + ({level!r} - y0) * (x1 - x0) / (y1 - y0) END AS x_cross FROM (SELECT *, "
            f"seg = max(seg) OVER (PARTITION BY scanned) AS last FROM {src} WHERE x1 IS NOT NULL) s "
            f"WHERE {a} = 0 OR {a} * {b} < 0 OR ({b} = 0 AND last)) c")


@query("level_crossings", oracle(_cross_sql(CROSS_LEVEL), ["fits"], ["x_cross"], ["scanned", "n_cross"],
                                 ctes=FN_CTES + [("seg", SEG_SQL)]))
def level_crossings(spark, sf):
    """L7 (linear): where each profile crosses 2*dLLH = 1."""
    p = _profiles(spark, sf)
    return rounded(sc.level_crossings(p, "scanned", "scan_point", "dllh2", CROSS_LEVEL))


@query("level_crossings_cubic")
def level_crossings_cubic(spark, sf):
    """L7 (cubic): roots of the interpolating cubic spline per profile."""
    p = _profiles(spark, sf)
    return rounded(sc.cubic_crossings(p, "scanned", "scan_point", "dllh2", CROSS_LEVEL))


CURVES_SQL = ("SELECT 'profile' AS scanned, scan_point, dllh2 FROM s1 WHERE scanned = 'gamma' UNION ALL "
              "SELECT 'slice', gamma_astro, ts FROM gr WHERE astro_norm = (SELECT best_phi FROM best)")
SEG2_SQL = SEG_SQL.replace("FROM s1", "FROM cv")


@query("curve_widths", oracle(
    "SELECT scanned, max(x_cross) - min(x_cross) AS width FROM (" + _cross_sql(CROSS_LEVEL, "seg2")
    + ") c WHERE n_cross < 2 GROUP BY scanned HAVING count(*) = 2", ["fits"], ["width"], ["scanned"],
    ctes=GRID_CTES + [("cv", CURVES_SQL), ("seg2", SEG2_SQL)]))
def curve_widths(spark, sf):
    """Width at 2*dLLH = 1 of the gamma profile and of the slice at the best phi."""
    nested = _nested(spark, sf)
    best = sc.best_fit(nested)
    prof = sc.llh_scan_1d(nested, best).where(F.col("scanned") == "gamma").select(
        F.lit("profile").alias("scanned"), "scan_point", "dllh2")
    best_phi = best.first()["best_phi"]
    g = _grid_ts(spark, sf)
    sl = g.where(F.col(N) == F.lit(best_phi).cast("double")).select(F.lit("slice").alias("scanned"),
                                                        F.col(G).alias("scan_point"), F.col("ts").alias("dllh2"))
    cr = sc.level_crossings(prof.unionByName(sl), "scanned", "scan_point", "dllh2", CROSS_LEVEL)
    return rounded(sc.curve_widths(cr, "scanned"))


# a point counts as a local maximum if it is above this multiple of either neighbour
MAXIMUM_FACTOR = 1.1


def _bad_points(p):
    """The local maxima (W2) of the sorted profiles: the points that are removed before smoothing."""
    return sc.local_maxima(p, "scanned", "dllh2", MAXIMUM_FACTOR)


@query("drop_points", oracle(
    "SELECT scanned, pos, scan_point FROM (SELECT *, cast(row_number() OVER w - 1 AS bigint) AS pos, lag(dllh2) OVER w AS l, "
    "lead(dllh2) OVER w AS r FROM s1 WINDOW w AS (PARTITION BY scanned ORDER BY scan_point)) z "
    f"WHERE NOT coalesce(dllh2 > l * {MAXIMUM_FACTOR!r} AND dllh2 > r * {MAXIMUM_FACTOR!r}, false)", ["fits"], ["scan_point"],
    ["scanned", "pos"], ctes=FN_CTES))
def drop_points(spark, sf):
    """Remove the local maxima of W2 by their positions (left-anti join on (scan, pos))."""
    p = sc.sorted_scan(_profiles(spark, sf))
    bad = _bad_points(p).select("scanned", "pos")
    return rounded(p.join(bad, ["scanned", "pos"], "left_anti").select("scanned", "pos", "scan_point"))


@query("clean_interp")
def clean_interp(spark, sf):
    """Drop the local maxima, interpolating cubic spline, 1000-point curve."""
    p = sc.sorted_scan(_profiles(spark, sf))
    return rounded(sc.clean_interp(p, "scanned", "scan_point", "dllh2", bad=_bad_points(p), n=1000))


# ------------------------------------------------------------------ L10 / L11
NX, NY = 1000, 1002


def _surface(spark, sf):
    return sc.llh_surface(_grid_ts(spark, sf), G, N, "ts", NX, NY, 30.0)


def _axis_sql(col: str, n: int, name: str) -> str:
    return (f"SELECT cast(t.k AS bigint) AS g{name}, CASE WHEN t.k = {n - 1} THEN r.hi ELSE cast(t.k AS double) * "
            f"((r.hi - r.lo) / {float(n - 1)!r}) + r.lo END AS {name}, r.hi FROM (SELECT min({col}) AS lo, max({col}) AS hi "
            f"FROM gr) r, range(0, {n}) t(k)")


def _axis_seg_sql(col: str, name: str) -> str:
    return (f"SELECT a.g{name}, a.{name}, s.v AS {name}0, s.v1 AS {name}1 FROM ax_{name} a LEFT JOIN (SELECT v, v1 FROM "
            f"(SELECT v, lead(v) OVER (ORDER BY v) AS v1 FROM (SELECT DISTINCT {col} AS v FROM gr) d) z "
            f"WHERE v1 IS NOT NULL) s ON a.{name} >= s.v AND (a.{name} < s.v1 OR (s.v1 = a.hi AND a.{name} = a.hi))")


SURF_BODY = (
    "SELECT x.ggx AS gi, y.ggy AS gj, x.gx AS gamma_astro, y.gy AS astro_norm, CASE WHEN ts <= 30.0 THEN ts END AS ts "
    "FROM (SELECT x.*, y.*, CASE WHEN u >= t THEN c00.ts + u * (c10.ts - c00.ts) + t * (c11.ts - c10.ts) "
    "ELSE c00.ts + t * (c01.ts - c00.ts) + u * (c11.ts - c01.ts) END AS ts FROM "
    "(SELECT *, 0 AS z FROM sx_gx) x JOIN (SELECT *, 0 AS z FROM sx_gy) y ON x.z = y.z "
    "CROSS JOIN LATERAL (SELECT (x.gx - x.gx0) / (x.gx1 - x.gx0) AS u, (y.gy - y.gy0) / (y.gy1 - y.gy0) AS t) w "
    "LEFT JOIN gr c00 ON c00.gamma_astro = x.gx0 AND c00.astro_norm = y.gy0 "
    "LEFT JOIN gr c10 ON c10.gamma_astro = x.gx1 AND c10.astro_norm = y.gy0 "
    "LEFT JOIN gr c01 ON c01.gamma_astro = x.gx0 AND c01.astro_norm = y.gy1 "
    "LEFT JOIN gr c11 ON c11.gamma_astro = x.gx1 AND c11.astro_norm = y.gy1) s")
SURF_CTES = GRID_CTES + [("ax_gx", _axis_sql("gamma_astro", NX, "gx")), ("ax_gy", _axis_sql("astro_norm", NY, "gy")),
                         ("sx_gx", _axis_seg_sql("gamma_astro", "gx")), ("sx_gy", _axis_seg_sql("astro_norm", "gy"))]
SURF_SQL = SURF_BODY.replace("SELECT x.ggx AS gi, y.ggy AS gj, x.gx AS gamma_astro, y.gy AS astro_norm, "
                             "CASE WHEN ts <= 30.0 THEN ts END AS ts FROM (SELECT x.*, y.*,",
                             "SELECT ggx AS gi, ggy AS gj, gx AS gamma_astro, gy AS astro_norm, "
                             "CASE WHEN ts <= 30.0 THEN ts END AS ts FROM (SELECT x.ggx, y.ggy, x.gx, y.gy,")


@query("llh_surface", oracle(SURF_SQL, ["fits"], ["gamma_astro", "astro_norm", "ts"], ["gi", "gj"], ctes=SURF_CTES))
def llh_surface(spark, sf):
    """1000 x 1002 linear interpolation of the 2*dLLH surface, masked above 30."""
    return rounded(_surface(spark, sf))


@query("confidence_bands", oracle(
    "SELECT cast(band AS double) AS band, count(*) AS n_cells FROM (SELECT CASE WHEN ts IS NULL THEN NULL "
    + " ".join(f"WHEN ts <= {v!r} THEN {i}" for i, v in enumerate(LEVELS_K2.values()))
    + f" ELSE {len(LEVELS_K2)} END AS band FROM (" + SURF_SQL + ") q) b GROUP BY band", ["fits"], ["band"],
    ["n_cells"], ctes=SURF_CTES))
def confidence_bands(spark, sf):
    """Grid cells inside the 1/2/3 sigma (k=2) contours (area per band)."""
    s = _surface(spark, sf)
    band = F.when(F.col("ts").isNull(), F.lit(None).cast("bigint")).otherwise(
        sc.band_of(F.col("ts"), list(LEVELS_K2.values())))
    # band is DOUBLE: masked cells give a NULL band that both engines hash alike
    return s.select(band.cast("double").alias("band")).groupBy("band").agg(F.count("*").alias("n_cells"))
