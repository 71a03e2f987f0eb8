"""Chi-square level helpers, losses (gradient/hessian) and error metrics.

Level constants are computed once on the driver from the standard library
(`statistics.NormalDist`, `math`) and enter plans as literals.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_N = NormalDist()


def two_sided_prob(sigma: float) -> float:
    """P(|Z| < sigma) = 1 - 2*sf(sigma)."""
    return 1.0 - 2.0 * (1.0 - _N.cdf(sigma))


def chisq_for_sigma(sigma: float, k: int = 1) -> float:
    """Chi-square value with k dof whose CDF equals the two-sided sigma probability."""
    if k == 1:
        return float(sigma) ** 2
    if k == 2:
        return -2.0 * math.log(1.0 - two_sided_prob(sigma))
    raise ValueError("only k=1 and k=2 are supported")


def sigma_for_chisq(value: float, k: int = 1) -> float:
    """Inverse of chisq_for_sigma."""
    if k == 1:
        return math.sqrt(value)
    if k == 2:
        return -_N.inv_cdf(math.exp(-value / 2.0) / 2.0)  # the upper tail keeps its digits
    raise ValueError("only k=1 and k=2 are supported")


def sigma_for_chisq_col(c, k: int = 1) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    if k == 1:
        return F.when(c >= 0, F.sqrt(c))
    if k == 2:
        return _sigma_k2(c)
    raise ValueError("only k=1 and k=2 are supported")


# Coefficients of the published rational approximations of the
# normal quantile (algorithm AS 241), numerator and denominator, lowest power first.
AS241_CENTRE = ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
                 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
                [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
                 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3])
AS241_NEAR = ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
               1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
              [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
               1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
AS241_FAR = ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
              2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
             [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
              7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])


LN_2PI = math.log(2 * math.pi)


def sigma_k2_sql(v: str) -> str:
    """SQL text of the sigma of a chi-square value with two degrees of freedom.

    The upper tail is q = exp(-v / 2) / 2, so its logarithm -L is linear in v and
    nothing rounds to 1.  Beyond v = 1300 q leaves the range of doubles, and the
    quantile comes from three steps of z^2 = 2 L - ln(2 pi z^2) + 2 ln(tail series).
    """
    def ratio(x: str, coefficients) -> str:
        def poly(cs):
            text = repr(cs[-1])
            for c in reversed(cs[:-1]):
                text = f"({text} * ({x}) + {c!r})"
            return text
        return f"({poly(coefficients[0])} / {poly(coefficients[1])})"

    v = f"cast({v} AS double)"
    tail = f"({v} / 2e0 + {math.log(2.0)!r})"
    q = f"(0.5e0 - exp(-{v} / 2e0) / 2e0)"
    centre = f"{q} * {ratio(f'0.180625e0 - {q} * {q}', AS241_CENTRE)}"
    near, far = (ratio(f"sqrt({tail}) - {k}", c) for k, c in (("1.6e0", AS241_NEAR), ("5e0", AS241_FAR)))
    y = f"(2e0 * {tail} - ln(2e0 * {tail}) - {LN_2PI!r})"
    for _ in range(2):
        y = f"(2e0 * {tail} - ln({y}) - {LN_2PI!r} + 2e0 * ln(1e0 - 1e0 / {y} + 3e0 / ({y} * {y})))"
    z = f"sqrt({y})"
    return (f"CASE WHEN {v} >= 0 THEN CASE WHEN {q} <= 0.425e0 THEN {centre} WHEN {tail} <= 25e0 THEN {near} "
            f"WHEN {v} <= 1300e0 THEN {far} ELSE {z} END END")


def _rational(x: Column, coefficients) -> Column:
    top, bottom = (F.lit(cs[-1]) for cs in coefficients)
    for a, b in zip(reversed(coefficients[0][:-1]), reversed(coefficients[1][:-1])):
        top, bottom = top * x + F.lit(a), bottom * x + F.lit(b)
    return top / bottom


def _sigma_k2(c: Column) -> Column:
    """Column form of ``sigma_k2_sql``."""
    v = c.cast("double")
    tail = v / 2 + F.lit(math.log(2.0))
    q = F.lit(0.5) - F.exp(-v / 2) / 2
    y = tail * 2 - F.log(tail * 2) - F.lit(LN_2PI)
    for _ in range(2):
        y = tail * 2 - F.log(y) - F.lit(LN_2PI) + F.log(1 - 1 / y + 3 / (y * y)) * 2
    z = F.sqrt(y)
    return (F.when(~(v >= 0), F.lit(None)).when(q <= 0.425, q * _rational(0.180625 - q * q, AS241_CENTRE))
            .when(tail <= 25, _rational(F.sqrt(tail) - 1.6, AS241_NEAR))
            .when(v <= 1300, _rational(F.sqrt(tail) - 5, AS241_FAR)).otherwise(z))


# ------------------------------------------------------------- losses (M5)
def grad_hess(objective: str, pred, label, delta: float = 1.0):
    """Per-row first and second derivative of the named objective."""
    p = F.col(pred) if isinstance(pred, str) else pred
    t = F.col(label) if isinstance(label, str) else label
    x = p - t
    if objective == "rmse":
        return x, F.lit(1.0)
    if objective in ("pshe", "pshedelta"):
        d = 1.0 if objective == "pshe" else float(delta)
        scale = 1.0 + (x / d) * (x / d)
        ss = F.sqrt(scale)
        # second derivative as the reference writes it: |delta|^3 / scale^(3/2)
        return x / ss, F.lit(abs(d) ** 3) / scale / ss
    if objective == "rrmse":
        return F.when(t != 0, x / t), F.when(t != 0, 1.0 / t)
    raise ValueError(f"unknown objective {objective!r}")


def metric(objective: str, pred, label, delta: float = 1.0, weight=None) -> Column:
    """Aggregate evaluation metric matching each objective."""
    p = F.col(pred) if isinstance(pred, str) else pred
    t = F.col(label) if isinstance(label, str) else label
    x = p - t
    if objective == "rmse":
        per = x * x
    elif objective in ("pshe", "pshedelta"):
        d = 1.0 if objective == "pshe" else float(delta)
        per = F.lit(d * d) * (F.sqrt(1.0 + (x / d) * (x / d)) - 1.0)
    elif objective == "rrmse":
        per = F.when(t != 0, x * x / t)
    else:
        raise ValueError(f"unknown objective {objective!r}")
    if weight is not None:
        w = F.col(weight) if isinstance(weight, str) else weight
        mean = F.sum(per * w) / F.sum(F.when(per.isNotNull(), w))
    else:
        mean = F.avg(per)
    return F.sqrt(mean) if objective in ("rmse", "rrmse") else mean


OBJECTIVES = ("rmse", "pshe", "pshedelta", "rrmse")
