"""Shared plan helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Dimension tables broadcast only under this many rows (a detector has ~5k
# sensors, a generator table a handful of rows).
DIM_MAX_ROWS = 200_000


def sized_broadcast(df: DataFrame, max_rows: int = DIM_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only after checking it has at most ``max_rows`` rows.

    The check is a ``limit(max_rows + 1).count()`` job, which stops reading
    once the bound is passed.  Beyond the bound the frame is returned as is,
    so the join falls back to a shuffle join (and AQE may still convert it).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def round_half(c, digits: int = 6):
    """round(x * 10^d) / 10^d with the scaling done in double arithmetic.

    Rounding the scaled double (not the exact decimal expansion of x) gives
    bit-identical results across engines that round the same way, and the
    trailing + 0.0 folds -0.0 into 0.0.
    """
    m = float(10 ** digits)
    return F.round(c * F.lit(m), 0) / F.lit(m) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, skip=()) -> DataFrame:
    """Round every DOUBLE column (stable value hashing across engines)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double" and f.name not in skip:
            cols.append(round_half(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
