"""Energy and ratio column expressions (all JVM-side, codegen-able).

Missing values are NULL (the reference's NaN); divisions that would divide by
zero give NULL instead of raising under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    num, den = _c(num), _c(den)
    return F.when(den != 0, num / den)


def log_energy(e) -> Column:
    """log10(E) with the reference's edge rules: 0 -> -inf, <0 or NULL -> NULL."""
    e = _c(e)
    return F.when(e > 0, F.log10(e)).when(e == 0, F.lit(NEG_INF))


def exp_energy(log_e) -> Column:
    """10**log_E (GeV from a log10 energy)."""
    return F.pow(F.lit(10.0), _c(log_e))


def log_residual(true_e, reco_e) -> Column:
    """log10(true) - log10(reco); only for positive energies."""
    t, r = _c(true_e), _c(reco_e)
    return F.when((t > 0) & (r > 0), F.log10(t) - F.log10(r))


def log_sigma_width(upper, lower) -> Column:
    """Width of a quantile band in log10 space."""
    u, lo = _c(upper), _c(lower)
    return F.when((u > 0) & (lo > 0), F.log10(u) - F.log10(lo))


def sigma_syst(sigma_tot, sigma_base) -> Column:
    """sqrt((tot/base)^2 - 1); NULL where undefined."""
    r = safe_div(sigma_tot, sigma_base)
    v = r * r - 1.0
    return F.when(v >= 0, F.sqrt(v))


def ratio_error(h, b, sigma_h, sigma_b, standard: bool = False) -> Column:
    """Error of h/b.

    As written in the reference: sqrt(sb^2/b^2 + h^2/b^4 * sh^2).  With
    ``standard=True`` the usual propagation sqrt(sh^2/b^2 + h^2/b^4 * sb^2).
    """
    h, b, sh, sb = _c(h), _c(b), _c(sigma_h), _c(sigma_b)
    first, second = (sh, sb) if standard else (sb, sh)
    b2 = b * b
    return F.when(b != 0, F.sqrt(first * first / b2 + h * h / (b2 * b2) * second * second))


def ratio_single_err(h, b, err):
    """(h/b, err/b)."""
    return safe_div(h, b), safe_div(err, b)


def delta_llh(llh, min_llh=None) -> Column:
    """2*(llh - min); the 2-D scan form is 2*llh (min_llh=None)."""
    llh = _c(llh)
    return 2.0 * (llh - _c(min_llh)) if min_llh is not None else 2.0 * llh


def mask_above(ts, max_value: float = 30.0) -> Column:
    ts = _c(ts)
    return F.when(ts <= F.lit(max_value), ts)


def hash_uniform(key, scale: float = 1.0, salt: str = "") -> Column:
    """Repeatable uniform [0, scale) from md5 of the key (first 13 hex digits)."""
    s = _c(key).cast("string")
    if salt:
        s = F.concat(s, F.lit(salt))
    h = F.conv(F.substring(F.md5(s), 1, 13), 16, 10).cast("double")
    return h / float(16 ** 13) * scale


def hash_uniform_sql(key_sql: str, scale: float = 1.0, salt: str = "") -> str:
    s = f"cast({key_sql} AS varchar)" + (f" || '{salt}'" if salt else "")
    return (f"cast(('0x' || substr(md5({s}), 1, 13)) AS bigint) "
            f"/ {float(16 ** 13)!r} * {scale!r}")
