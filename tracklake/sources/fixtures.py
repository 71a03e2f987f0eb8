"""Detector-shaped inputs derived from the driver tables.

Each fixture exists twice: as a DataFrame builder (what the library runs) and
as an SQL text (what the DuckDB oracle inlines as a CTE).  Both describe the
same deterministic derivation; the raw tables are read with column pruning so
only the referenced columns reach the scan.

frames        one row per event frame (orders)
dom_hits      one row per (event, hit sensor) (lineitem)
dom_geometry  sensor positions, a small dimension (supplier)
particles     per-event particle tree as an adjacency list (lineitem)
tracks        one muon track per event (orders)
fits          rectangular likelihood scan (part)
generators    literal simulation-generator dimension
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _d(c: Column) -> Column:
    return c.cast("double")


# ---------------------------------------------------------------- frames
def frames(spark: SparkSession, sf_dir: str, by_event: bool = False) -> DataFrame:
    """``by_event`` deals the rows by event while they are narrow, for those who join what belongs to an event."""
    o = table(spark, sf_dir, "orders")
    o = o.repartition("o_orderkey") if by_event else o
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    cog_x = _d((c * 37) % 1001) - 500.0
    cog_y = _d((c * 91) % 1001) - 500.0
    return o.select(
        k.alias("event_id"),
        F.when(F.col("o_orderstatus") == "P", "DAQ").otherwise("Physics").alias("stop"),
        F.concat(F.lit("set_"), (k % 3).cast("string")).alias("dataset"),
        cog_x.alias("cog_x"),
        cog_y.alias("cog_y"),
        (_d((c * 53) % 1001) - 500.0).alias("cog_z"),
        (_d(k % 190) + 10.0).alias("nch"),
        (_d(c % 201) / 100.0 - 1.0).alias("cos_zenith"),
        F.when(k % 17 == 0, F.lit(None).cast("double"))
         .otherwise(p * (0.5 + _d(k % 11) / 10.0)).alias("e_truncated_gev"),
        F.when(k % 23 == 0, F.lit(0.0)).otherwise(p * (0.7 + _d(k % 7) / 10.0)).alias("e_muex_gev"),
        F.when(k % 13 == 0, F.lit(None).cast("double")).otherwise(F.log10(p)).alias("e_dnn_hive"),
        (F.log10(p) + 0.01).alias("e_dnn_alt"),
        F.when(k % 29 == 0, F.lit(0.0)).when(k % 31 == 0, F.lit(None).cast("double"))
         .otherwise(p).alias("e_entry"),
        F.when((k % 29 == 0) | (k % 5 == 0), F.lit(0.0)).when(k % 31 == 0, F.lit(None).cast("double"))
         .otherwise(p * 0.25).alias("e_exit"),
        (p * 1.5).alias("mc_primary_energy"),
        F.when(c % 2 == 0, F.lit(14)).otherwise(F.lit(-14)).alias("mc_primary_type"),
        (_d(c % 314) / 100.0).alias("mc_primary_zenith"),
        (_d(c % 101) / 10000.0 + 0.0001).alias("tint_prob_w"),
        (p * 1000.0).alias("one_weight"),
        F.when(k % 3 == 1, F.lit(250.0)).otherwise(F.lit(10000.0)).alias("n_events"),
        # level-5 reconstruction scalars (extension of the frame shape)
        F.sqrt(cog_x * cog_x + cog_y * cog_y).alias("cog_rho"),
        _d((k * 7) % 1000).alias("lseparation"),
        (_d((c * 13) % 400) / 10.0 - 20.0).alias("bayes_llh_diff"),
        (_d(k % 97) / 10.0 + 5.0).alias("rlogl"),
        _d((k * 11) % 800).alias("ldir_c"),
        _d(k % 60).alias("ndir_c"),
        F.when(k % 19 == 0, F.lit(None).cast("double"))
         .otherwise(_d(c % 50) / 100.0).alias("sigma_paraboloid"),
        (_d(c % 200) / 100.0 - 1.0).alias("sdir_e"),
    )


FRAMES_SQL = """SELECT o_orderkey AS event_id,
  CASE WHEN o_orderstatus = 'P' THEN 'DAQ' ELSE 'Physics' END AS stop,
  concat('set_', cast(o_orderkey % 3 AS varchar(10))) AS dataset,
  cast((o_custkey * 37) % 1001 AS double) - 500.0 AS cog_x,
  cast((o_custkey * 91) % 1001 AS double) - 500.0 AS cog_y,
  cast((o_custkey * 53) % 1001 AS double) - 500.0 AS cog_z,
  cast(o_orderkey % 190 AS double) + 10.0 AS nch,
  cast(o_custkey % 201 AS double) / 100.0 - 1.0 AS cos_zenith,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice * (0.5 + cast(o_orderkey % 11 AS double) / 10.0) END AS e_truncated_gev,
  CASE WHEN o_orderkey % 23 = 0 THEN 0.0 ELSE o_totalprice * (0.7 + cast(o_orderkey % 7 AS double) / 10.0) END AS e_muex_gev,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE log10(o_totalprice) END AS e_dnn_hive,
  log10(o_totalprice) + 0.01 AS e_dnn_alt,
  CASE WHEN o_orderkey % 29 = 0 THEN 0.0 WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice END AS e_entry,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 5 = 0 THEN 0.0 WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice * 0.25 END AS e_exit,
  o_totalprice * 1.5 AS mc_primary_energy,
  CASE WHEN o_custkey % 2 = 0 THEN 14 ELSE -14 END AS mc_primary_type,
  cast(o_custkey % 314 AS double) / 100.0 AS mc_primary_zenith,
  cast(o_custkey % 101 AS double) / 10000.0 + 0.0001 AS tint_prob_w,
  o_totalprice * 1000.0 AS one_weight,
  CASE WHEN o_orderkey % 3 = 1 THEN 250.0 ELSE 10000.0 END AS n_events,
  sqrt((cast((o_custkey * 37) % 1001 AS double) - 500.0) * (cast((o_custkey * 37) % 1001 AS double) - 500.0)
     + (cast((o_custkey * 91) % 1001 AS double) - 500.0) * (cast((o_custkey * 91) % 1001 AS double) - 500.0)) AS cog_rho,
  cast((o_orderkey * 7) % 1000 AS double) AS lseparation,
  cast((o_custkey * 13) % 400 AS double) / 10.0 - 20.0 AS bayes_llh_diff,
  cast(o_orderkey % 97 AS double) / 10.0 + 5.0 AS rlogl,
  cast((o_orderkey * 11) % 800 AS double) AS ldir_c,
  cast(o_orderkey % 60 AS double) AS ndir_c,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE cast(o_custkey % 50 AS double) / 100.0 END AS sigma_paraboloid,
  cast(o_custkey % 200 AS double) / 100.0 - 1.0 AS sdir_e
FROM orders"""


# ---------------------------------------------------------------- hits / geometry
def dom_hits(spark: SparkSession, sf_dir: str, by_event: bool = False) -> DataFrame:
    """``by_event`` deals the rows by event, for those who gather the hits of an event: they shuffle nothing more."""
    li = table(spark, sf_dir, "lineitem")
    hits = li.select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("dom_id"))
    return (hits.repartition("event_id") if by_event else hits).distinct()


DOM_HITS_SQL = "SELECT DISTINCT l_orderkey AS event_id, l_suppkey AS dom_id FROM lineitem"


def dom_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("dom_id"),
        (_d((k * 37) % 1001) - 500.0).alias("x"),
        (_d((k * 91) % 1001) - 500.0).alias("y"),
        (_d((k * 53) % 1001) - 500.0).alias("z"),
    )


DOM_GEOMETRY_SQL = """SELECT s_suppkey AS dom_id,
  cast((s_suppkey * 37) % 1001 AS double) - 500.0 AS x,
  cast((s_suppkey * 91) % 1001 AS double) - 500.0 AS y,
  cast((s_suppkey * 53) % 1001 AS double) - 500.0 AS z FROM supplier"""


# ---------------------------------------------------------------- particle tree
def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    # child order inside one event: a window over a handful of rows per event
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    t = li.select(
        F.col("l_orderkey").alias("event_id"), "l_extendedprice", "l_quantity",
        F.row_number().over(w).cast("bigint").alias("idx"),
    )
    e, i = F.col("event_id"), F.col("idx")
    pdg = (
        F.when(i == 1, F.when(e % 3 == 0, 14).when(e % 3 == 1, -14).otherwise(16))
        .when((i == 2) & (e % 5 == 0), 14)
        .when((i == 2) & (e % 7 == 0), 99)
        .when(i == 2, 13)
        .when((i == 3) & (e % 11 == 0), 11)
        .when((i == 6) & (e % 2 == 0), 12)
        .otherwise(99)
    )
    return t.select(
        "event_id", "idx",
        F.when(i == 1, F.lit(None).cast("bigint")).when(i <= 3, F.lit(1).cast("bigint"))
         .when(i <= 7, F.lit(2).cast("bigint")).otherwise(F.floor(i / 2).cast("bigint")).alias("parent_idx"),
        pdg.cast("int").alias("pdg"),
        F.when((i == 1) & (e % 4 == 0), "Anywhere").otherwise("InIce").alias("location_type"),
        (F.col("l_extendedprice") / 100.0).alias("energy"),
        # losses lie along (0.6, 0, 0.8) from the start of the event's track
        (_d((e * 37) % 2801) - 1400.0 + F.col("l_quantity") * 12.0).alias("x"),
        (_d((e * 91) % 2801) - 1400.0).alias("y"),
        (_d((e * 53) % 2401) - 1200.0 + F.col("l_quantity") * 16.0).alias("z"),
    )


PARTICLES_SQL = """SELECT event_id, cast(idx AS bigint) AS idx,
  CASE WHEN idx = 1 THEN NULL WHEN idx <= 3 THEN 1 WHEN idx <= 7 THEN 2
       ELSE cast(floor(idx / 2) AS bigint) END AS parent_idx,
  CASE WHEN idx = 1 THEN CASE event_id % 3 WHEN 0 THEN 14 WHEN 1 THEN -14 ELSE 16 END
       WHEN idx = 2 AND event_id % 5 = 0 THEN 14
       WHEN idx = 2 AND event_id % 7 = 0 THEN 99
       WHEN idx = 2 THEN 13
       WHEN idx = 3 AND event_id % 11 = 0 THEN 11
       WHEN idx = 6 AND event_id % 2 = 0 THEN 12
       ELSE 99 END AS pdg,
  CASE WHEN idx = 1 AND event_id % 4 = 0 THEN 'Anywhere' ELSE 'InIce' END AS location_type,
  l_extendedprice / 100.0 AS energy,
  cast((event_id * 37) % 2801 AS double) - 1400.0 + l_quantity * 12.0 AS x,
  cast((event_id * 91) % 2801 AS double) - 1400.0 AS y,
  cast((event_id * 53) % 2401 AS double) - 1200.0 + l_quantity * 16.0 AS z
FROM (SELECT l_orderkey AS event_id, l_extendedprice, l_quantity,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx
      FROM lineitem) t"""


# ---------------------------------------------------------------- tracks
def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    x, y, z = _d((k * 37) % 2801) - 1400.0, _d((k * 91) % 2801) - 1400.0, _d((k * 53) % 2401) - 1200.0
    return o.select(
        k.alias("event_id"),
        F.lit(1).alias("track_no"),
        F.lit(2).cast("bigint").alias("particle_idx"),
        x.alias("x"), y.alias("y"), z.alias("z"),
        F.acos(_d(c % 199) / 100.0 - 0.99).alias("zenith"),
        (_d(c % 628) / 100.0).alias("azimuth"),
        p.alias("energy"),
        (500.0 + _d(k % 2500)).alias("length"),
        F.when(k % 7 == 0, F.lit(0.0)).otherwise(p * 0.9).alias("e_i"),
        (x + 60.0).alias("x_i"), y.alias("y_i"), (z + 80.0).alias("z_i"),
        F.when(k % 3 == 0, F.lit(0.0)).otherwise(p * 0.1).alias("e_f"),
        (x + 270.0).alias("x_f"), y.alias("y_f"), (z + 360.0).alias("z_f"),
    )


TRACKS_SQL = """SELECT o_orderkey AS event_id, 1 AS track_no, cast(2 AS bigint) AS particle_idx,
  cast((o_orderkey * 37) % 2801 AS double) - 1400.0 AS x,
  cast((o_orderkey * 91) % 2801 AS double) - 1400.0 AS y,
  cast((o_orderkey * 53) % 2401 AS double) - 1200.0 AS z,
  acos(cast(o_custkey % 199 AS double) / 100.0 - 0.99) AS zenith,
  cast(o_custkey % 628 AS double) / 100.0 AS azimuth,
  o_totalprice AS energy, 500.0 + cast(o_orderkey % 2500 AS double) AS length,
  CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE o_totalprice * 0.9 END AS e_i,
  cast((o_orderkey * 37) % 2801 AS double) - 1340.0 AS x_i, cast((o_orderkey * 91) % 2801 AS double) - 1400.0 AS y_i,
  cast((o_orderkey * 53) % 2401 AS double) - 1120.0 AS z_i,
  CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice * 0.1 END AS e_f,
  cast((o_orderkey * 37) % 2801 AS double) - 1130.0 AS x_f, cast((o_orderkey * 91) % 2801 AS double) - 1400.0 AS y_f,
  cast((o_orderkey * 53) % 2401 AS double) - 840.0 AS z_f
FROM orders"""


# ---------------------------------------------------------------- fits
def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = table(spark, sf_dir, "part")
    i = _d(F.col("p_partkey") % 20)
    j = _d(F.floor(F.col("p_partkey") / 20))
    g = 1.0 + 0.1 * i
    n = 0.1 + 0.1 * j
    return pt.select(
        F.col("p_partkey").alias("fit_id"),
        g.alias("gamma_astro"),
        n.alias("astro_norm"),
        (25.0 * (g - 2.0) * (g - 2.0) + 15.0 * (n - 1.0) * (n - 1.0) + 100.0).alias("llh"),
    )


FITS_SQL = """SELECT p_partkey AS fit_id, 1.0 + 0.1 * i AS gamma_astro, 0.1 + 0.1 * j AS astro_norm,
  25.0 * (1.0 + 0.1 * i - 2.0) * (1.0 + 0.1 * i - 2.0) + 15.0 * (0.1 + 0.1 * j - 1.0) * (0.1 + 0.1 * j - 1.0) + 100.0 AS llh
FROM (SELECT p_partkey, cast(p_partkey % 20 AS double) AS i, cast(floor(p_partkey / 20) AS double) AS j FROM part) t"""


# ---------------------------------------------------------------- generators
# Simulation generator specs (events per file, energy range in GeV,
# spectral index, number of files) for the 2019 sets 21217 and 21220; the 2012
# sets 11029, 11069, 11070 carry their file counts 3190, 3920, 997 with the 2019
# spectra (their spectra need an external lookup).
GENERATOR_ROWS = [
    ("2019", "21217", 10000.0, 100.0, 1e8, 1.5, 21674.0),
    ("2019", "21220", 250.0, 100.0, 1e8, 1.0, 5179.0),
    ("2012", "11029", 10000.0, 100.0, 1e8, 1.5, 3190.0),
    ("2012", "11069", 10000.0, 100.0, 1e8, 1.5, 3920.0),
    ("2012", "11070", 250.0, 100.0, 1e8, 1.0, 997.0),
]
GENERATOR_SCHEMA = "sim_year string, dataset string, nevents double, emin double, emax double, gamma double, nfiles double"


def generators(spark: SparkSession) -> DataFrame:
    """The literal dimension, built JVM-side (no Python RDD behind it)."""
    names = [f.split()[0] for f in GENERATOR_SCHEMA.split(", ")]
    rows = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in GENERATOR_ROWS]
    return spark.range(1).select(F.inline(F.array(*rows)))


GENERATORS_SQL = "SELECT * FROM (VALUES\n" + ",\n".join(
    f"  ('{y}', '{d}', cast({n!r} AS double), cast({lo!r} AS double), cast({hi!r} AS double), "
    f"cast({g!r} AS double), cast({nf!r} AS double))"
    for (y, d, n, lo, hi, g, nf) in GENERATOR_ROWS
) + "\n) AS g(sim_year, dataset, nevents, emin, emax, gamma, nfiles)"


BUILDERS = {
    "frames": frames,
    "dom_hits": dom_hits,
    "dom_geometry": dom_geometry,
    "particles": particles,
    "tracks": tracks,
    "fits": fits,
}

SQL = {
    "frames": FRAMES_SQL,
    "dom_hits": DOM_HITS_SQL,
    "dom_geometry": DOM_GEOMETRY_SQL,
    "particles": PARTICLES_SQL,
    "tracks": TRACKS_SQL,
    "fits": FITS_SQL,
    "generators": GENERATORS_SQL,
}


def with_fixtures(body: str, *names: str) -> str:
    """Prefix an oracle query with the fixture CTEs it reads."""
    ctes = ",\n".join(f"{n} AS (\n{SQL[n]}\n)" for n in names)
    return f"WITH {ctes}\n{body}"
