"""Row numbers in a global or per-group order without a window over a whole group.

Rows are dealt by ranges of the order, so the sampler spreads a group of any size over
tasks; a task numbers its rows, and one count a task gives the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


def ranked(df: DataFrame, order: Sequence[str], part: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """``df`` with gapless numbers from 0 in ``order`` (NULL first) within each group of ``part``."""
    by = [F.col(c).asc_nulls_first() for c in [*part, *order]]
    placed = reliable_checkpoint(df.repartitionByRange(*by).sortWithinPartitions(*by)
                                 .withColumn("_place", F.monotonically_increasing_id()))
    task = F.shiftright("_place", 33)
    offsets, total = [], 0
    for t, n in sorted((r["t"], r["count"]) for r in placed.groupBy(task.alias("t")).count().collect()):
        offsets.append((t, total))
        total += n
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_task long, _before long"))  # a row a task
    within = F.col("_place").bitwiseAND((1 << 33) - 1)
    out = placed.join(starts, task == F.col("_task")).withColumn(name, F.col("_before") + within).drop("_place", "_task", "_before")
    if not part:
        return out
    named = [F.col(c).alias(f"_g{i}") for i, c in enumerate(part)]
    first = out.groupBy(*named).agg(F.min(name).alias("_first"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(part)))
    return out.join(first, same).withColumn(name, F.col(name) - F.col("_first")).drop("_first", *(f"_g{i}" for i in range(len(part))))
