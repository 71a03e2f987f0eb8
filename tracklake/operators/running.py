"""Per-group running sums and row numbers that stay bounded under skew.

A window ``partitionBy(key).orderBy(o)`` sorts each group inside one task, so
an event holding a third of all rows would be processed by a single task.
Groups are therefore split in two: one partially aggregated count per group
finds the *hot* groups (more than ``hot_rows`` rows; their number is bounded
by total / hot_rows).  Ordinary groups take the plain window.  Hot groups are
range-partitioned on (key, order) so the sampler spreads each over many
partitions; the per (group, partition) totals are a small table, a window
over it gives each partition's offset inside its group, and the running value
is offset + a window restricted to (group, partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .common import sized_broadcast

HOT_ROWS = 2_000_000


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame | None:
    """Keys of groups with more than ``hot_rows`` rows (default ``HOT_ROWS``),
    or None when there are none.

    The result has at most rows / hot_rows entries, so it can be broadcast.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    k = list(keys)
    counts = df.groupBy(*k).count()
    # one job decides; the key table is only materialised when it is needed
    top = counts.agg(F.max("count").alias("m")).first()["m"]
    if top is None or top <= hot_rows:
        return None
    return reliable_checkpoint(counts.where(F.col("count") > hot_rows).select(*k))


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame):
    """(rows of ordinary groups, rows of hot groups); NULL keys match NULL."""
    k = list(keys)
    # at most rows / HOT_ROWS keys; still size-checked before broadcasting
    h = sized_broadcast(hot.select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(k)]), 1_000_000)
    cond = [df[c].eqNullSafe(h[f"_h{i}"]) for i, c in enumerate(k)]
    return df.join(h, cond, "left_anti"), df.join(h, cond, "left_semi")


def _running_window(df, k, o, v, sum_col, rank_col, with_sum):
    w = Window.partitionBy(*k).orderBy(*o)
    out = df.withColumn(rank_col, F.row_number().over(w).cast("bigint"))
    if with_sum:
        out = out.withColumn(sum_col, F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double"))
    return out


def _running_ranged(df, k, o, v, sum_col, rank_col, with_sum, n):
    d = df.withColumn("_rv", v.cast("double"))
    ranged = d.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in k + o]) \
        .withColumn("_pid", F.spark_partition_id())
    ranged = reliable_checkpoint(ranged)
    tot = ranged.groupBy(*k, "_pid").agg(F.count("*").alias("_pc"), F.sum("_rv").alias("_ps"))
    wp = Window.partitionBy(*k).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(k)], F.col("_pid").alias("_opid"),
                     F.coalesce(F.sum("_pc").over(wp), F.lit(0)).alias("_oc"),
                     F.coalesce(F.sum("_ps").over(wp), F.lit(0.0)).alias("_os"))
    cond = [ranged[c].eqNullSafe(off[f"_k{i}"]) for i, c in enumerate(k)] + [ranged["_pid"] == off["_opid"]]
    out = ranged.join(off, cond).drop(*[f"_k{i}" for i in range(len(k))], "_opid")
    wl = Window.partitionBy(*k, "_pid").orderBy(*o)
    out = out.withColumn(rank_col, (F.col("_oc") + F.row_number().over(wl)).cast("bigint"))
    if with_sum:
        out = out.withColumn(sum_col, F.col("_os") + F.sum("_rv").over(wl.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("_rv", "_pid", "_oc", "_os")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | Column | None = None,
            sum_col: str = "running_sum", rank_col: str = "row_no", num_partitions: int | None = None,
            hot_rows: int | None = None) -> DataFrame:
    """Add ``row_no`` (1-based rank in order) and, with ``value``, the
    inclusive running sum ``running_sum`` within each key group.

    ``order`` must make rows unique inside a group (as a window order would
    need for a deterministic row number).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    k, o = list(keys), list(order)
    with_sum = value is not None
    v = (F.col(value) if isinstance(value, str) else value) if with_sum else F.lit(0.0)
    hot = hot_groups(df, k, hot_rows)
    if hot is None:
        return _running_window(df, k, o, v, sum_col, rank_col, with_sum)
    cold, warm = split_hot(df, k, hot)
    a = _running_window(cold, k, o, v, sum_col, rank_col, with_sum)
    b = _running_ranged(warm, k, o, v, sum_col, rank_col, with_sum, n)
    return a.unionByName(b)
