"""Small per-group numeric solvers run with grouped ``applyInPandas``.

Every group handed to these functions is pre-aggregated by Spark first (a
histogram slice, or one likelihood scan curve), so a group is bounded by the
number of bins / scan points, never by the number of events.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

SQRT2PI = np.sqrt(2.0 * np.pi)


# ------------------------------------------------------------------ A10
def _gauss(x, loc, scale, norm):
    return norm * np.exp(-0.5 * ((x - loc) / scale) ** 2) / (np.abs(scale) * SQRT2PI)


def fit_gauss(x: np.ndarray, y: np.ndarray, iters: int = 200):
    """Least-squares fit of norm * N(x; loc, scale) (Levenberg-Marquardt).

    Starts from the weighted moments of the slice.  Returns (params, cov) or
    None when the fit does not converge.
    """
    x = np.asarray(x, float)
    y = np.asarray(y, float)
    w = np.clip(y, 0, None)
    if w.sum() <= 0:
        return None
    loc = float((w * x).sum() / w.sum())
    scale = float(np.sqrt(max((w * (x - loc) ** 2).sum() / w.sum(), 1e-12)))
    dx = np.median(np.diff(np.sort(x))) if len(x) > 1 else 1.0
    norm = float(w.sum() * dx)
    p = np.array([loc, scale, norm])
    lam = 1e-3

    def resid(q):
        return _gauss(x, *q) - y

    r = resid(p)
    cost = float(r @ r)
    for _ in range(iters):
        lo, sc, nm = p
        z = (x - lo) / sc
        g = np.exp(-0.5 * z * z) / (abs(sc) * SQRT2PI)
        J = np.column_stack([nm * g * z / sc, nm * g * (z * z - 1.0) / sc, g])
        A = J.T @ J
        b = J.T @ r
        try:
            step = np.linalg.solve(A + lam * np.diag(np.diag(A) + 1e-12), -b)
        except np.linalg.LinAlgError:
            return None
        q = p + step
        rq = resid(q)
        cq = float(rq @ rq)
        if cq < cost:
            converged = abs(cost - cq) <= 1e-12 * max(cost, 1e-300)
            p, r, cost, lam = q, rq, cq, lam / 10
            if converged or np.linalg.norm(step) <= 1e-10 * (np.linalg.norm(p) + 1e-10):
                break
        else:
            lam *= 10
            if lam > 1e12:
                break
    if not np.all(np.isfinite(p)):
        return None
    lo, sc, nm = p
    z = (x - lo) / sc
    g = np.exp(-0.5 * z * z) / (abs(sc) * SQRT2PI)
    J = np.column_stack([nm * g * z / sc, nm * g * (z * z - 1.0) / sc, g])
    dof = max(len(x) - 3, 1)
    try:
        cov = np.linalg.inv(J.T @ J) * (cost / dof)
    except np.linalg.LinAlgError:
        cov = np.full((3, 3), np.nan)
    return np.array([lo, abs(sc), nm]), cov


GAUSS_KEYS = ("mean", "std", "norm", "cov_mm", "cov_ss", "cov_nn", "cov_ms", "cov_mn", "cov_sn")
GAUSS_SCHEMA = ("xbin long, n long, nonzero_bins long, " + ", ".join(f"{k} double" for k in GAUSS_KEYS)
                + ", y_values array<double>, counts array<long>")


def gauss_slices_pdf(pdf: pd.DataFrame) -> pd.DataFrame:
    """One x-slice (xbin, yc, n) of a dense 2-D histogram -> fitted parameters and the slice itself.

    Needs more than 3 non-empty bins; NULL parameters else, and where no fit is found.
    """
    pdf = pdf.sort_values("yc")
    y, n = pdf["yc"].to_numpy(float), pdf["n"].to_numpy()
    row = {"xbin": int(pdf["xbin"].iloc[0]), "n": int(n.sum()), "nonzero_bins": int((n > 0).sum())}
    res = fit_gauss(y, n.astype(float)) if row["nonzero_bins"] > 3 else None
    values = [None] * len(GAUSS_KEYS)
    if res is not None:
        p, c = res
        values = [p[0], p[1], p[2], c[0, 0], c[1, 1], c[2, 2], c[0, 1], c[0, 2], c[1, 2]]
    return pd.DataFrame([row | dict(zip(GAUSS_KEYS, values)) | {"y_values": y.tolist(), "counts": n.tolist()}])


# ------------------------------------------------------------------ L7 / L9 cubic
def not_a_knot_spline(x: np.ndarray, y: np.ndarray):
    """Interpolating cubic spline (not-a-knot ends, the s=0 FITPACK form).

    Returns the second derivatives at the knots.
    """
    x = np.asarray(x, float)
    y = np.asarray(y, float)
    n = len(x)
    if n < 4:
        raise ValueError("cubic spline needs at least 4 points")
    h = np.diff(x)
    d = np.diff(y) / h
    A = np.zeros((n, n))
    rhs = np.zeros(n)
    for i in range(1, n - 1):
        A[i, i - 1], A[i, i], A[i, i + 1] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * (d[i] - d[i - 1])
    A[0, 0], A[0, 1], A[0, 2] = h[1], -(h[0] + h[1]), h[0]
    A[-1, -3], A[-1, -2], A[-1, -1] = h[-1], -(h[-2] + h[-1]), h[-2]
    return np.linalg.solve(A, rhs)


def spline_eval(x, y, M, xq):
    x = np.asarray(x, float)
    y = np.asarray(y, float)
    xq = np.asarray(xq, float)
    i = np.clip(np.searchsorted(x, xq, side="right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    a, b = x[i + 1] - xq, xq - x[i]
    return (M[i] * a ** 3 / (6 * h) + M[i + 1] * b ** 3 / (6 * h)
            + (y[i] / h - M[i] * h / 6) * a + (y[i + 1] / h - M[i + 1] * h / 6) * b)


def spline_roots(x, y, y0: float = 0.0) -> list[float]:
    """All x where the interpolating cubic through (x, y - y0) is zero."""
    x = np.asarray(x, float)
    yr = np.asarray(y, float) - y0
    M = not_a_knot_spline(x, yr)
    out: list[float] = []
    for i in range(len(x) - 1):
        h = x[i + 1] - x[i]
        a = (M[i + 1] - M[i]) / (6 * h)
        b = M[i] / 2
        c = (yr[i + 1] - yr[i]) / h - h * (2 * M[i] + M[i + 1]) / 6
        coef = np.array([a, b, c, yr[i]])
        nz = np.flatnonzero(np.abs(coef) > 0)
        if len(nz) == 0:
            continue
        for t in np.roots(coef[nz[0]:]):
            if abs(t.imag) < 1e-9:
                t = t.real
                last = i == len(x) - 2
                if -1e-12 <= t < h - 1e-12 or (last and -1e-12 <= t <= h + 1e-12):
                    out.append(float(x[i] + min(max(t, 0.0), h)))
    return sorted(set(round(v, 12) for v in out))
