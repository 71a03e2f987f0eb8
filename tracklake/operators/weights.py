"""Simulation weights and train/eval/test splits.

Generator surface: each generator contributes
    nfiles * nevents * E^-gamma / integral(E^-gamma, emin..emax)
inside its energy range (0 outside); the event weight is
    total_weight / (sum over generators * E).
The generator table is a tiny dimension: it is packed into one array per
simulation year, broadcast behind a size check, and summed per event with a
higher-order ``aggregate`` - no shuffle of events, no collect on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.energy import hash_uniform
from .common import sized_broadcast
from .running import running

SIM_YEARS = ("2012", "2019")


def _integral(g: Column) -> Column:
    one_minus = F.lit(1.0) - g["gamma"]
    return F.when(g["gamma"] == 1.0, F.log(g["emax"] / g["emin"])).otherwise(
        (F.pow(g["emax"], one_minus) - F.pow(g["emin"], one_minus)) / one_minus)


def generator_surface(df: DataFrame, generators: DataFrame, sim_year: str, energy: str = "MCPrimaryEnergy",
                      angular: float = 1.0) -> DataFrame:
    """Add ``gen_sum`` (events per unit energy of all generators at E)."""
    if sim_year not in SIM_YEARS:
        raise ValueError(f"invalid weighting option {sim_year!r}: must be 2012 or 2019")
    g = generators.where(F.col("sim_year") == sim_year)
    packed = g.groupBy("sim_year").agg(F.collect_list(F.struct("nevents", "emin", "emax", "gamma", "nfiles"))
                                       .alias("_gens"))
    d = df.withColumn("sim_year", F.lit(sim_year)).join(sized_broadcast(packed, 1000), "sim_year", "left")
    e = F.col(energy)

    def add(acc, gen):
        dens = gen["nfiles"] * gen["nevents"] * F.pow(e, -gen["gamma"]) / _integral(gen) * F.lit(angular)
        return acc + F.when((e >= gen["emin"]) & (e <= gen["emax"]), dens).otherwise(F.lit(0.0))

    gen_sum = F.aggregate(F.coalesce(F.col("_gens"), F.array().cast(packed.schema["_gens"].dataType)),
                          F.lit(0.0), add)
    return d.withColumn("gen_sum", gen_sum).drop("_gens", "sim_year")


def one_weights(df: DataFrame, generators: DataFrame, sim_year: str, energy: str = "MCPrimaryEnergy",
                total_weight: str = "TIntProbW", out: str = "generator_weights") -> DataFrame:
    """M1/M2/M3: OneWeight / E for the given simulation year's generators."""
    d = generator_surface(df, generators, sim_year, energy)
    w = F.when(F.col("gen_sum") > 0, F.col(total_weight) / (F.col("gen_sum") * F.col(energy)))
    return d.withColumn(out, w).drop("gen_sum")


# ------------------------------------------------------------------ M4
def hash_split(df: DataFrame, key: str = "event_id", test: float = 0.1, eval_share: float = 0.2,
               salt: str = "split") -> DataFrame:
    """Repeatable split by a hash-uniform of the key: test share first, then
    ``eval_share`` of the rest."""
    u = hash_uniform(key, 1.0, salt)
    cut2 = test + (1.0 - test) * eval_share
    return df.withColumn("split", F.when(u < test, "test").when(u < cut2, "eval").otherwise("train"))


BUCKET_HEX = 5  # 16^5 rank buckets: the bucket table stays bounded (~1M rows)


def exact_split(df: DataFrame, key: str = "event_id", shares: Sequence[tuple[str, int, int]] = (
        ("test", 1, 10), ("eval", 2, 10)), rest: str = "train", salt: str = "split") -> DataFrame:
    """Exact-size split in hash order: each share is ceil(num/den * remaining).

    The global rank is offset-of-bucket (a window over the bounded bucket
    count table) + rank inside the bucket (partitioned by bucket; hot buckets
    take the range-partitioned path of ``running``), so no single task sorts
    everything.
    """
    s = F.concat(F.col(key).cast("string"), F.lit(salt))
    h = F.md5(s)
    d = df.withColumn("_u", F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)) \
          .withColumn("_b", F.conv(F.substring(h, 1, BUCKET_HEX), 16, 10).cast("bigint"))
    counts = d.groupBy("_b").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_off", F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")) \
                   .withColumn("_n", F.sum("_c").over(Window.partitionBy()))
    # rank inside the bucket; a bucket made hot by many copies of one key is
    # ranked across tasks (the tie-break lets the range sampler split copies)
    d = d.withColumn("_tie", F.monotonically_increasing_id())
    ranked = running(d, ["_b"], ["_u", key, "_tie"], rank_col="_rb")
    r = ranked.join(counts, "_b").withColumn("_r", F.col("_off") + F.col("_rb") - 1)
    # cumulative boundaries: integer ceil of each share of what is left
    label = None
    bound = F.lit(0).cast("bigint")
    left = F.col("_n")
    for name, num, den in shares:
        size = F.floor((left * num + (den - 1)) / den).cast("bigint")
        bound = bound + size
        left = left - size
        label = F.when(F.col("_r") < bound, name) if label is None else label.when(F.col("_r") < bound, name)
    return r.withColumn("split", label.otherwise(rest)).drop("_u", "_b", "_c", "_off", "_n", "_r", "_rb", "_tie")
