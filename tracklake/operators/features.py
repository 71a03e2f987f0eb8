"""Frame filtering, flattening into the feature table, and per-event positions.

Every function is DataFrame -> DataFrame and composes with ``df.transform``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.energy import hash_uniform, log_energy

# Named feature sets (ordered as configured).
FEATURE_SETS: dict[str, list[str]] = {
    "standard_feat": ["cog_rho", "cog_z", "lseparation", "nch", "bayes_llh_diff", "cos_zenith", "rlogl",
                      "ldir_c", "ndir_c", "sigma_paraboloid", "sdir_e", "n_string_hits", "E_truncated",
                      "E_muex", "E_dnn", "random_variable"],
    "no_E_feat": ["cog_rho", "cog_z", "lseparation", "nch", "bayes_llh_diff", "cos_zenith", "rlogl", "ldir_c",
                  "ndir_c", "sigma_paraboloid", "sdir_e", "n_string_hits", "random_variable"],
    "no_light_feat": ["cog_rho", "cog_z", "lseparation", "bayes_llh_diff", "cos_zenith", "rlogl", "ldir_c",
                      "sigma_paraboloid", "sdir_e", "E_truncated", "E_muex", "E_dnn", "random_variable"],
    "L5_E": ["cog_rho", "cog_z", "lseparation", "nch", "bayes_llh_diff", "cos_zenith", "rlogl", "ldir_c",
             "ndir_c", "sigma_paraboloid", "sdir_e", "E_truncated", "E_muex", "E_dnn", "random_variable"],
    "L5_E_no_sigmapar": ["cog_rho", "cog_z", "lseparation", "nch", "bayes_llh_diff", "cos_zenith", "rlogl",
                         "ldir_c", "ndir_c", "sdir_e", "E_truncated", "E_muex", "E_dnn", "random_variable"],
    "full_info": ["cog_x", "cog_y", "cog_z", "mean_x", "mean_y", "mean_z", "lseparation", "nch",
                  "bayes_llh_diff", "cos_zenith", "rlogl", "ldir_c", "ndir_c", "sdir_e", "E_truncated",
                  "E_muex", "E_dnn", "random_variable"],
    "full_info_no_geo": ["cog_x", "cog_y", "cog_z", "lseparation", "nch", "bayes_llh_diff", "cos_zenith",
                         "rlogl", "ldir_c", "ndir_c", "sdir_e", "E_truncated", "E_muex", "E_dnn",
                         "random_variable"],
    "DNN_full_info": ["cog_x", "cog_y", "cog_z", "mean_x", "mean_y", "mean_z", "lseparation", "nch",
                      "bayes_llh_diff", "cos_zenith", "rlogl", "ldir_c", "ndir_c", "sdir_e", "E_dnn",
                      "random_variable"],
    "topology_only": ["cog_x", "cog_y", "cog_z", "mean_x", "mean_y", "mean_z", "lseparation", "nch",
                      "bayes_llh_diff", "cos_zenith", "rlogl", "ldir_c", "ndir_c", "sdir_e", "random_variable"],
}

# reconstruction scalars copied 1:1 from the frame
L5_SCALARS = ["cog_rho", "cog_z", "lseparation", "nch", "bayes_llh_diff", "cos_zenith", "rlogl",
              "ldir_c", "ndir_c", "sigma_paraboloid", "sdir_e"]

# feature table column order
FEATURE_COLUMNS = (["event_id", "dataset"] + L5_SCALARS +
                   ["E_truncated", "E_muex", "E_dnn", "random_variable", "E_entry", "E_exit", "OneWeight", "NEvent", "TIntProbW",
                    "MCPrimaryEnergy", "MCPrimaryType", "MCPrimaryCosZen", "cog_x", "cog_y"])


def physics_frames(frames: DataFrame) -> DataFrame:
    """Keep Physics frames (pushed down to the Parquet scan)."""
    return frames.where(F.col("stop") == "Physics")


def dnn_energy(hive: str = "e_dnn_hive", fallback: str = "e_dnn_alt") -> Column:
    """P5: first existing of the two DNN keys."""
    return F.coalesce(F.col(hive), F.col(fallback))


def noise_feature(key: str = "event_id", scale: float = 10.0) -> Column:
    """Repeatable uniform control feature in [0, scale)."""
    return hash_uniform(key, scale)


def flatten_features(frames: DataFrame, truth: DataFrame | None = None,
                     w_ace: DataFrame | None = None) -> DataFrame:
    """Flat feature table from Physics frames.

    truth  optional (event_id, e_entry, e_exit) computed truth (P11): an event
           with both stored keys keeps them, any other takes both computed
           energies, so the two of an event have one source.
    w_ace  optional (event_id, e_predicted, e_truth) (P10): the truth replaces
           E_entry and E_predicted is added.
    """
    f = physics_frames(frames)
    if truth is not None:
        f = f.join(truth.select("event_id", F.col("e_entry").alias("_t_entry"),
                                F.col("e_exit").alias("_t_exit")), "event_id", "left")
        stored = F.col("e_entry").isNotNull() & F.col("e_exit").isNotNull()
        e_entry = F.when(stored, F.col("e_entry")).otherwise(F.col("_t_entry"))
        e_exit = F.when(stored, F.col("e_exit")).otherwise(F.col("_t_exit"))
    else:
        e_entry, e_exit = F.col("e_entry"), F.col("e_exit")
    cols = [F.col("event_id"), F.col("dataset")] + [F.col(c) for c in L5_SCALARS] + [
        log_energy("e_truncated_gev").alias("E_truncated"),
        log_energy("e_muex_gev").alias("E_muex"),
        dnn_energy().alias("E_dnn"),
        noise_feature().alias("random_variable"),
        e_entry.alias("E_entry"),
        e_exit.alias("E_exit"),
        F.col("one_weight").alias("OneWeight"),
        F.col("n_events").alias("NEvent"),
        F.col("tint_prob_w").alias("TIntProbW"),
        F.col("mc_primary_energy").alias("MCPrimaryEnergy"),
        F.col("mc_primary_type").alias("MCPrimaryType"),
        F.cos("mc_primary_zenith").alias("MCPrimaryCosZen"),
        F.col("cog_x"), F.col("cog_y"),
    ]
    out = f.select(*cols)
    if w_ace is not None:
        out = override_truth(out, w_ace)
    return out


def override_truth(features: DataFrame, ace: DataFrame) -> DataFrame:
    """P10: E_entry <- stored truth key, add E_predicted (GeV)."""
    a = ace.select("event_id", F.col("e_truth").alias("_ace_truth"), F.col("e_predicted").alias("E_predicted"))
    j = features.join(a, "event_id", "left")
    return j.withColumn("E_entry", F.col("_ace_truth")).drop("_ace_truth")


def clean_training(features: DataFrame, label: str = "E_entry") -> DataFrame:
    """Label 0 -> missing, then drop rows missing any column (-inf survives)."""
    return features.withColumn(label, F.when(F.col(label) != 0.0, F.col(label))).na.drop("any")


def drop_missing(df: DataFrame) -> DataFrame:
    """Drop rows with any missing value."""
    return df.na.drop("any")


def validate_features(df: DataFrame, features: Iterable[str]) -> None:
    """Raise KeyError when a configured feature is absent."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise KeyError(f"features not contained in data: {missing}")


def prune_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Keep only configured features (frame order) plus ``keep`` columns."""
    validate_features(df, features)
    fs = set(features) | set(keep)
    return df.select(*[c for c in df.columns if c in fs])


def feature_set(name: str) -> list[str]:
    if name not in FEATURE_SETS:
        raise KeyError(f"unknown feature set {name!r}")
    return list(FEATURE_SETS[name])


def dom_positions(hits: DataFrame, geometry: DataFrame) -> DataFrame:
    """Hit -> x, y, z, r of its sensor; the optimizer broadcasts the geometry where its bytes allow.
    A hit on a sensor that the geometry lacks is an error."""
    geo = geometry.select("dom_id", "x", "y", "z", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2).alias("r"))
    found = hits.join(geo.withColumn("_known", F.lit(True)), "dom_id", "left")
    unknown = F.raise_error(F.concat(F.lit("hit on unknown sensor "), F.coalesce(F.col("dom_id").cast("string"), F.lit("null"))))
    # a condition on rows, which no choice of columns prunes
    return found.where(F.when(F.col("_known"), F.lit(True)).otherwise(unknown.cast("boolean"))).drop("_known")


def event_position(hits: DataFrame, geometry: DataFrame) -> DataFrame:
    """A1: per-event mean x, y, z and mean cylindrical radius over hit DOMs."""
    pos = dom_positions(hits, geometry)
    return pos.groupBy("event_id").agg(
        F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"),
        F.avg("z").alias("mean_z"), F.avg("r").alias("mean_r"),
    )


def with_event_position(features: DataFrame, hits: DataFrame, geometry: DataFrame) -> DataFrame:
    """Left join of A1 onto the feature table; events without hits get NULL."""
    return features.join(event_position(hits, geometry), "event_id", "left")
