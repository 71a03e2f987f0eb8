"""Extraction queries: frame scans, projections, the feature table, lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.energy import exp_energy, hash_uniform, hash_uniform_sql, log_energy
from ..operators import features as ft
from ..operators.common import rounded
from ..sources import fixtures as fx
from ..sources import frames as fr
from ..session import checkpoint_dir
from .catalog import oracle, query

FRAME_DOUBLES = ["cog_x", "cog_y", "cog_z", "nch", "cos_zenith", "e_truncated_gev", "e_muex_gev", "e_dnn_hive",
                 "e_dnn_alt", "e_entry", "e_exit", "mc_primary_energy", "mc_primary_zenith", "tint_prob_w", "one_weight", "n_events", "cog_rho", "lseparation",
                 "bayes_llh_diff", "rlogl", "ldir_c", "ndir_c", "sigma_paraboloid", "sdir_e"]
FRAME_OTHERS = ["event_id", "stop", "dataset", "mc_primary_type"]

# SQL forms of the feature expressions (same rules as the column functions)
LOG_SQL = "CASE WHEN {c} > 0 THEN log10({c}) WHEN {c} = 0 THEN cast('-inf' AS double) END"
L5 = ft.L5_SCALARS
FEAT_DOUBLES = L5 + ["E_truncated", "E_muex", "E_dnn", "random_variable", "E_entry", "E_exit", "OneWeight",
                     "NEvent", "TIntProbW", "MCPrimaryEnergy", "MCPrimaryCosZen", "cog_x", "cog_y"]
FEAT_OTHERS = ["event_id", "dataset", "MCPrimaryType"]
FEATURES_SQL = (
    "SELECT event_id, dataset, " + ", ".join(L5) + ", "
    + LOG_SQL.format(c="e_truncated_gev") + " AS E_truncated, "
    + LOG_SQL.format(c="e_muex_gev") + " AS E_muex, "
    "coalesce(e_dnn_hive, e_dnn_alt) AS E_dnn, "
    + hash_uniform_sql("event_id", 10.0) + " AS random_variable, "
    "e_entry AS E_entry, e_exit AS E_exit, one_weight AS OneWeight, n_events AS NEvent, tint_prob_w AS TIntProbW, "
    "mc_primary_energy AS MCPrimaryEnergy, mc_primary_type AS MCPrimaryType, "
    "cos(mc_primary_zenith) AS MCPrimaryCosZen, cog_x, cog_y FROM frames WHERE stop = 'Physics'"
)


def _features(spark, sf):
    return ft.flatten_features(fx.frames(spark, sf))


# ------------------------------------------------------------------ P1
@query("physics_frames", oracle("SELECT * FROM frames WHERE stop = 'Physics'", ["frames"],
                                FRAME_DOUBLES, FRAME_OTHERS))
def physics_frames(spark, sf):
    return rounded(ft.physics_frames(fx.frames(spark, sf)))


# ------------------------------------------------------------------ P2/P3
@query("flatten_features", oracle(FEATURES_SQL, ["frames"], FEAT_DOUBLES, FEAT_OTHERS), headline=True)
def flatten_features(spark, sf):
    return rounded(_features(spark, sf))


# The same table through files of the nested frame shape (map/struct access)
@query("scan_frames", oracle(FEATURES_SQL, ["frames"], FEAT_DOUBLES, FEAT_OTHERS))
def scan_frames(spark, sf):
    """Frame files of two folders, named by a list of paths and a glob; required keys have to be there."""
    nested = fr.nest_frames(fx.frames(spark, sf))
    root = f"{checkpoint_dir(spark).rstrip('/')}/frames-{uuid.uuid4().hex}"
    paths = [f"{root}/even", f"{root}/odd"]
    for part, path in enumerate(paths):
        fr.write_table(nested.where(F.pmod("event_id", F.lit(2)) == part), path, partition_by=())
    return rounded(fr.flatten_nested(fr.read_frames(spark, paths, glob="part-*.parquet")))


# ------------------------------------------------------------------ P4
@query("optional_energy", oracle(
    "SELECT event_id, " + LOG_SQL.format(c="e_truncated_gev") + " AS E_truncated, "
    + LOG_SQL.format(c="e_muex_gev") + " AS E_muex, e_truncated_gev IS NULL AS truncated_missing "
    "FROM frames WHERE stop = 'Physics'", ["frames"], ["E_truncated", "E_muex"], ["event_id", "truncated_missing"]))
def optional_energy(spark, sf):
    f = ft.physics_frames(fx.frames(spark, sf))
    return rounded(f.select("event_id", log_energy("e_truncated_gev").alias("E_truncated"),
                            log_energy("e_muex_gev").alias("E_muex"),
                            F.col("e_truncated_gev").isNull().alias("truncated_missing")))


# ------------------------------------------------------------------ P5
@query("dnn_fallback", oracle(
    "SELECT event_id, coalesce(e_dnn_hive, e_dnn_alt) AS E_dnn, e_dnn_hive IS NULL AS used_fallback "
    "FROM frames", ["frames"], ["E_dnn"], ["event_id", "used_fallback"]))
def dnn_fallback(spark, sf):
    f = fx.frames(spark, sf)
    return rounded(f.select("event_id", ft.dnn_energy().alias("E_dnn"),
                            F.col("e_dnn_hive").isNull().alias("used_fallback")))


# ------------------------------------------------------------------ P6
@query("log_energy", oracle(
    "SELECT event_id, " + LOG_SQL.format(c="e_muex_gev") + " AS log_e_muex, "
    + LOG_SQL.format(c="e_entry") + " AS log_e_entry FROM frames",
    ["frames"], ["log_e_muex", "log_e_entry"], ["event_id"]))
def log_energy_q(spark, sf):
    f = fx.frames(spark, sf)
    return rounded(f.select("event_id", log_energy("e_muex_gev").alias("log_e_muex"),
                            log_energy("e_entry").alias("log_e_entry")))


# ------------------------------------------------------------------ P7
@query("exp_energy", oracle(
    "SELECT event_id, pow(10.0, coalesce(e_dnn_hive, e_dnn_alt)) AS e_dnn_gev FROM frames WHERE stop = 'Physics'",
    ["frames"], ["e_dnn_gev"], ["event_id"], digits=4))
def exp_energy_q(spark, sf):
    f = ft.physics_frames(fx.frames(spark, sf))
    return rounded(f.select("event_id", exp_energy(ft.dnn_energy()).alias("e_dnn_gev")), 4)


# ------------------------------------------------------------------ P8
@query("cos_zenith", oracle("SELECT event_id, cos(zenith) AS cos_zen FROM tracks", ["tracks"],
                            ["cos_zen"], ["event_id"]))
def cos_zenith(spark, sf):
    t = fx.tracks(spark, sf)
    return rounded(t.select("event_id", F.cos("zenith").alias("cos_zen")))


# ------------------------------------------------------------------ P9
@query("noise_feature", oracle(
    "SELECT event_id, " + hash_uniform_sql("event_id", 10.0) + " AS random_variable FROM frames",
    ["frames"], ["random_variable"], ["event_id"]))
def noise_feature(spark, sf):
    f = fx.frames(spark, sf)
    return rounded(f.select("event_id", hash_uniform("event_id", 10.0).alias("random_variable")))


# ------------------------------------------------------------------ P10
@query("override_truth", oracle(
    "SELECT f.event_id, a.e_truth AS E_entry, a.e_predicted AS E_predicted, f.E_dnn FROM ("
    + FEATURES_SQL + ") f LEFT JOIN (SELECT event_id, e_entry AS e_truth, pow(10.0, e_dnn_alt) AS e_predicted "
    "FROM frames WHERE stop = 'Physics') a ON f.event_id = a.event_id",
    ["frames"], ["E_entry", "E_predicted", "E_dnn"], ["event_id"], digits=4))
def override_truth(spark, sf):
    frames = fx.frames(spark, sf)
    ace = ft.physics_frames(frames).select("event_id", F.col("e_entry").alias("e_truth"),
                                           exp_energy("e_dnn_alt").alias("e_predicted"))
    out = ft.override_truth(ft.flatten_features(frames), ace)
    return rounded(out.select("event_id", "E_entry", "E_predicted", "E_dnn"), 4)


# ------------------------------------------------------------------ P12 / P13
_ALL_NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in FEAT_OTHERS + FEAT_DOUBLES)


@query("clean_training", oracle(
    "SELECT * FROM (" + FEATURES_SQL.replace("e_entry AS E_entry", "CASE WHEN e_entry <> 0.0 THEN e_entry END AS E_entry")
    + ") t WHERE " + _ALL_NOT_NULL, ["frames"], FEAT_DOUBLES, FEAT_OTHERS))
def clean_training(spark, sf):
    return rounded(ft.clean_training(_features(spark, sf)))


@query("drop_missing", oracle("SELECT * FROM (" + FEATURES_SQL + ") t WHERE " + _ALL_NOT_NULL,
                              ["frames"], FEAT_DOUBLES, FEAT_OTHERS))
def drop_missing(spark, sf):
    return rounded(ft.drop_missing(_features(spark, sf)))


# ------------------------------------------------------------------ P15 / P17
def _feature_set_query(name: str):
    feats = ft.feature_set(name)
    geo = any(c.startswith("mean_") for c in feats)

    def run(spark, sf):
        df = _features(spark, sf)
        if geo:
            df = ft.with_event_position(df, fx.dom_hits(spark, sf), fx.dom_geometry(spark, sf))
        return rounded(ft.prune_features(df, feats, keep=["event_id"]))

    base = FEATURES_SQL
    if geo:
        base = ("SELECT f.*, p.mean_x, p.mean_y, p.mean_z, p.mean_r FROM (" + FEATURES_SQL + ") f LEFT JOIN ("
                + EVENT_POS_SQL + ") p ON f.event_id = p.event_id")
    # frame order of the feature table is kept (not the configured order)
    order = ft.FEATURE_COLUMNS + (["mean_x", "mean_y", "mean_z", "mean_r"] if geo else [])
    cols = [c for c in order if c in set(feats)]
    body = f"SELECT event_id, {', '.join(cols)} FROM ({base}) t"
    fixtures = ["frames", "dom_hits", "dom_geometry"] if geo else ["frames"]
    return run, oracle(body, fixtures, cols, ["event_id"])


EVENT_POS_SQL = ("SELECT h.event_id, avg(g.x) AS mean_x, avg(g.y) AS mean_y, avg(g.z) AS mean_z, "
                 "avg(sqrt(g.x * g.x + g.y * g.y)) AS mean_r FROM dom_hits h JOIN dom_geometry g "
                 "ON h.dom_id = g.dom_id GROUP BY h.event_id")

for _name in ft.FEATURE_SETS:
    if "n_string_hits" in ft.FEATURE_SETS[_name]:
        continue  # never extracted: these two sets fail validation (tested)
    _fn, _sql = _feature_set_query(_name)
    query(f"feature_set_{_name}", _sql)(_fn)


@query("prune_features", oracle(
    "SELECT event_id, " + ", ".join(c for c in ft.FEATURE_COLUMNS if c in set(ft.FEATURE_SETS["L5_E_no_sigmapar"]))
    + " FROM (" + FEATURES_SQL + ") t", ["frames"],
    [c for c in ft.FEATURE_COLUMNS if c in set(ft.FEATURE_SETS["L5_E_no_sigmapar"])], ["event_id"]))
def prune_features(spark, sf):
    return rounded(ft.prune_features(_features(spark, sf), ft.FEATURE_SETS["L5_E_no_sigmapar"], keep=["event_id"]))


# ------------------------------------------------------------------ J1 / A1
@query("dom_positions", oracle(
    "SELECT h.event_id, h.dom_id, g.x, g.y, g.z, sqrt(g.x * g.x + g.y * g.y) AS r "
    "FROM dom_hits h JOIN dom_geometry g ON h.dom_id = g.dom_id",
    ["dom_hits", "dom_geometry"], ["x", "y", "z", "r"], ["event_id", "dom_id"]))
def dom_positions(spark, sf):
    return rounded(ft.dom_positions(fx.dom_hits(spark, sf), fx.dom_geometry(spark, sf))
                   .select("event_id", "dom_id", "x", "y", "z", "r"))


@query("event_position", oracle(
    "SELECT f.event_id, p.mean_x, p.mean_y, p.mean_z, p.mean_r FROM frames f LEFT JOIN (" + EVENT_POS_SQL
    + ") p ON f.event_id = p.event_id WHERE f.stop = 'Physics'",
    ["frames", "dom_hits", "dom_geometry"], ["mean_x", "mean_y", "mean_z", "mean_r"], ["event_id"]), headline=True)
def event_position(spark, sf):
    f = ft.physics_frames(fx.frames(spark, sf)).select("event_id")
    return rounded(ft.with_event_position(f, fx.dom_hits(spark, sf), fx.dom_geometry(spark, sf)))


# ------------------------------------------------------------------ J2 / J3
def _update_source(spark, sf):
    # new per-event values read again from the frames; MCPrimaryZenith is new
    f = ft.physics_frames(fx.frames(spark, sf))
    return f.select("event_id",
                    F.when(F.col("event_id") % 5 != 0, F.col("tint_prob_w") * 2.0).alias("TIntProbW"),
                    F.col("mc_primary_type").alias("MCPrimaryType"),
                    F.col("cos_zenith").alias("MCPrimaryZenith"))


UPDATE_SRC_SQL = ("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN tint_prob_w * 2.0 END AS TIntProbW, "
                  "mc_primary_type AS MCPrimaryType, cos_zenith AS MCPrimaryZenith FROM frames WHERE stop = 'Physics'")


def update_columns(left, right, key: str = "event_id"):
    """right's non-NULL values overwrite existing columns; no new columns."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    r = right.select(key, *[F.col(c).alias(f"_upd_{c}") for c in shared])
    j = left.join(r, key, "left")
    return j.select(*[F.coalesce(F.col(f"_upd_{c}"), F.col(c)).alias(c) if c in shared else F.col(c)
                      for c in left.columns])


def enrich_columns(left, right, key: str = "event_id"):
    """Add right's columns that the left does not have."""
    new = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(key, *new), key, "left")


@query("update_features", oracle(
    "SELECT f.event_id, coalesce(u.TIntProbW, f.TIntProbW) AS TIntProbW, "
    "coalesce(u.MCPrimaryType, f.MCPrimaryType) AS MCPrimaryType, f.E_dnn FROM (" + FEATURES_SQL
    + ") f LEFT JOIN (" + UPDATE_SRC_SQL + ") u ON f.event_id = u.event_id",
    ["frames"], ["TIntProbW", "E_dnn"], ["event_id", "MCPrimaryType"]))
def update_features(spark, sf):
    out = update_columns(_features(spark, sf), _update_source(spark, sf))
    return rounded(out.select("event_id", "TIntProbW", "MCPrimaryType", "E_dnn"))


@query("enrich_features", oracle(
    "SELECT f.event_id, f.TIntProbW, u.MCPrimaryZenith FROM (" + FEATURES_SQL
    + ") f LEFT JOIN (" + UPDATE_SRC_SQL + ") u ON f.event_id = u.event_id",
    ["frames"], ["TIntProbW", "MCPrimaryZenith"], ["event_id"]))
def enrich_features(spark, sf):
    out = enrich_columns(_features(spark, sf), _update_source(spark, sf))
    return rounded(out.select("event_id", "TIntProbW", "MCPrimaryZenith"))


# ------------------------------------------------------------------ S4 / S5
# geometry per calibration set: 2019 is the 2012 geometry shifted by 1 m in z
def geometry_for_set(spark, sf, sim_set: str):
    geo = fx.dom_geometry(spark, sf)
    sets = {"2012": 0.0, "2019": 1.0}
    if sim_set not in sets:
        raise ValueError(f"unknown simulation set {sim_set!r}: expected 2012 or 2019")
    both = geo.select("dom_id", "x", "y", F.col("z"), F.lit("2012").alias("sim_set")).unionByName(
        geo.select("dom_id", "x", "y", (F.col("z") + 1.0).alias("z"), F.lit("2019").alias("sim_set")))
    return both.where(F.col("sim_set") == sim_set).drop("sim_set")


@query("geometry_for_set", oracle("SELECT dom_id, x, y, z + 1.0 AS z FROM dom_geometry", ["dom_geometry"],
                                  ["x", "y", "z"], ["dom_id"]))
def geometry_for_set_q(spark, sf):
    return rounded(geometry_for_set(spark, sf, "2019"))


def om_key(dom_id_col="dom_id"):
    """(string, om) of a sensor id: 10 sensors per string in the fixture."""
    d = F.col(dom_id_col)
    return (F.floor((d - 1) / 10) + 1).cast("bigint"), ((d - 1) % 10 + 1).cast("bigint")


@query("string_positions", oracle(
    "SELECT cast(floor((dom_id - 1) / 10) + 1 AS bigint) AS string, x, y, z FROM dom_geometry "
    "WHERE (dom_id - 1) % 10 + 1 = 1 AND floor((dom_id - 1) / 10) + 1 BETWEEN 1 AND 78",
    ["dom_geometry"], ["x", "y", "z"], ["string"]))
def string_positions(spark, sf):
    s, om = om_key()
    g = fx.dom_geometry(spark, sf).select(s.alias("string"), om.alias("om"), "x", "y", "z")
    return rounded(g.where((F.col("om") == 1) & F.col("string").between(1, 78)).drop("om"))


# ------------------------------------------------------------------ S7 / S8 / U1
def _batches(spark, sf):
    feats = _features(spark, sf)
    a = feats.where(F.col("dataset") == "set_0")
    b = feats.where(F.col("dataset") == "set_1").withColumn("E_predicted", exp_energy("E_dnn"))
    c = feats.where(F.col("dataset") == "set_2").drop("E_truncated", "E_muex")
    return a, b, c


@query("combine_batches", oracle(
    "SELECT event_id, dataset, E_truncated, E_dnn, E_predicted FROM ("
    "SELECT * FROM (SELECT * FROM f WHERE dataset = 'set_0') "
    "UNION ALL BY NAME SELECT *, pow(10.0, E_dnn) AS E_predicted FROM f WHERE dataset = 'set_1' "
    "UNION ALL BY NAME SELECT * EXCLUDE (E_truncated, E_muex) FROM f WHERE dataset = 'set_2') u",
    ["frames"], ["E_truncated", "E_dnn", "E_predicted"], ["event_id", "dataset"], ctes=[("f", FEATURES_SQL)],
    digits=4))
def combine_batches(spark, sf):
    out = fr.combine(_batches(spark, sf))
    return rounded(out.select("event_id", "dataset", "E_truncated", "E_dnn", "E_predicted"), 4)


@query("combine_tagged", oracle(
    "SELECT event_id, dataset, E_dnn FROM (" + FEATURES_SQL + ") t WHERE dataset = 'set_1'",
    ["frames"], ["E_dnn"], ["event_id", "dataset"]))
def combine_tagged(spark, sf):
    out = fr.combine(_batches(spark, sf)).where(F.col("dataset") == "set_1")
    return rounded(out.select("event_id", "dataset", "E_dnn"))


# ------------------------------------------------------------------ S9 / P28
FILE_SQL = ("SELECT concat('/data/sim/frames/', CASE dataset WHEN 'set_0' THEN '21217' WHEN 'set_1' THEN '21220' "
            "ELSE '11070' END, '/Level5.', lpad(cast(cast(floor(event_id / 1000) AS bigint) AS varchar), 6, '0'), "
            "'.i3.zst') AS file_name, event_id FROM frames")


def frame_files(frames):
    """Per-event source file name (1000 events per file) in the simulation layout."""
    ds = (F.when(F.col("dataset") == "set_0", "21217").when(F.col("dataset") == "set_1", "21220")
          .otherwise("11070"))
    num = F.lpad(F.floor(F.col("event_id") / 1000).cast("bigint").cast("string"), 6, "0")
    return frames.select(F.concat(F.lit("/data/sim/frames/"), ds, F.lit("/Level5."), num,
                                  F.lit(".i3.zst")).alias("file_name"), "event_id")


@query("file_batches", oracle(
    "SELECT file_name, n_events, cast(floor((row_number() OVER (ORDER BY file_name) - 1) / 20) AS bigint) AS batch_id "
    "FROM (SELECT file_name, count(*) AS n_events FROM (" + FILE_SQL + ") t GROUP BY file_name) l",
    ["frames"], [], ["file_name", "n_events", "batch_id"]))
def file_batches(spark, sf):
    files = frame_files(fx.frames(spark, sf)).groupBy("file_name").agg(F.count("*").alias("n_events"))
    return fr.file_batches(files, 20).select("file_name", "n_events", "batch_id")


@query("dataset_tag", oracle(
    "SELECT file_name, regexp_extract(file_name, '/(\\d{5})/', 1) AS dataset_tag, "
    "regexp_extract(file_name, '\\.(\\d{6})\\.i3', 1) AS job_id, "
    "concat('wACE_', regexp_extract(file_name, '[^/]+$', 0)) AS out_name "
    "FROM (SELECT DISTINCT file_name FROM (" + FILE_SQL + ") t) l",
    ["frames"], [], ["file_name", "dataset_tag", "job_id", "out_name"]))
def dataset_tag(spark, sf):
    files = frame_files(fx.frames(spark, sf)).select("file_name").distinct()
    tag, job = fr.tag_from_path("file_name")
    return files.select("file_name", tag.alias("dataset_tag"), job.alias("job_id"),
                        F.concat(F.lit("wACE_"), F.regexp_extract("file_name", r"[^/]+$", 0)).alias("out_name"))


# ------------------------------------------------------------------ S16
# Names of the per-event variables dumped beside those that a fit reads
DUMP_VARIABLES = ["reco_energy", "reco_zenith", "true_energy", "true_zenith", "event_id", "L5_cog_rho", "L5_cog_z",
                  "L5_lseparation", "L5_nch", "L5_bayes_llh_diff", "L5_rlogl", "L5_ldir_c", "L5_ndir_c",
                  "L5_sigma_paraboloid", "L5_sdir_e", "non_reco_ace_energy", "non_reco_dnn_energy", "energy_muex"]
# where the frames have them; angles in radians, energies in GeV
_DUMP_SOURCES = {
    "reco_energy": "e_truncated_gev", "reco_zenith": "acos(cos_zenith)", "true_energy": "mc_primary_energy",
    "true_zenith": "mc_primary_zenith", "event_id": "event_id", "energy_muex": "e_muex_gev",
    "non_reco_ace_energy": "pow(10.0, e_dnn_alt)", "non_reco_dnn_energy": "pow(10.0, coalesce(e_dnn_hive, e_dnn_alt))",
    **{key: c for c, key in fr.L5_KEYS.items()},
    "dataset": "dataset", "one_weight": "one_weight", "n_events": "n_events", "tint_prob_w": "tint_prob_w",
}
WEIGHT_VARIABLES = ["dataset", "one_weight", "n_events", "tint_prob_w"]


def dump(frames, required=(), extra=DUMP_VARIABLES):
    """The union of required and extra variables, each once, in one projection of Physics frames.
    An unknown name is an error."""
    names = list(dict.fromkeys([*required, *extra]))
    unknown = [n for n in names if n not in _DUMP_SOURCES]
    if unknown:
        raise KeyError(f"unknown variables: {unknown}")
    return ft.physics_frames(frames).select(*[F.expr(_DUMP_SOURCES[n]).alias(n) for n in names])


def _dump_oracle(required):
    names = list(dict.fromkeys([*required, *DUMP_VARIABLES]))
    others = [n for n in names if n in ("event_id", "dataset")]
    return oracle("SELECT " + ", ".join(f"{_DUMP_SOURCES[n]} AS {n}" for n in names) + " FROM frames WHERE stop = 'Physics'",
                  ["frames"], [n for n in names if n not in others], others, digits=4)


@query("dump_variables", _dump_oracle(["event_id", "reco_energy", *WEIGHT_VARIABLES]))
def dump_variables(spark, sf):
    """S16 of simulation: with what weights are made of."""
    return rounded(dump(fx.frames(spark, sf), ["event_id", "reco_energy", *WEIGHT_VARIABLES]), 4)


@query("dump_data_variables", _dump_oracle(["event_id", "reco_energy"]))
def dump_data_variables(spark, sf):
    """S16 of data: without weights."""
    return rounded(dump(fx.frames(spark, sf), ["event_id", "reco_energy"]), 4)
