"""Weighting, splitting, losses, training and scoring queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.energy import exp_energy, hash_uniform_sql
from ..functions.stats import grad_hess
from ..operators import boost as bt
from ..operators import features as ft
from ..operators import truth as th
from ..operators import weights as wt
from ..operators.common import rounded
from ..session import checkpoint_dir, passing, stored
from ..sources import fixtures as fx
from ..sources import frames as fr
from ..streaming.scoring import score_files
from .catalog import oracle, query

TRAIN_FEATURES = ft.FEATURE_SETS["L5_E_no_sigmapar"]
# The reference's training job (condor/train/train.submit) boosts 10000 rounds with objective rmse and
# 2019 weights; its trainer stops 1000 rounds after the best one on the eval rows.
ROUNDS = 10_000
PATIENCE = 1000


def _gen_sql(year: str) -> str:
    integral = ("CASE WHEN g.gamma = 1.0 THEN ln(g.emax / g.emin) ELSE (pow(g.emax, 1.0 - g.gamma) - "
                "pow(g.emin, 1.0 - g.gamma)) / (1.0 - g.gamma) END")
    return ("SELECT f.event_id, f.tint_prob_w, f.mc_primary_energy AS e, sum(g.nfiles * g.nevents * "
            f"pow(f.mc_primary_energy, -g.gamma) / {integral}) AS gen_sum FROM frames f LEFT JOIN generators g "
            f"ON g.sim_year = '{year}' AND f.mc_primary_energy BETWEEN g.emin AND g.emax WHERE f.stop = 'Physics' "
            "GROUP BY f.event_id, f.tint_prob_w, f.mc_primary_energy")


def _features(spark, sf):
    return ft.flatten_features(fx.frames(spark, sf))


@query("generator_surface", oracle("SELECT event_id, coalesce(gen_sum, 0.0) AS gen_sum FROM gs", ["frames", "generators"],
                                   ["gen_sum"], ["event_id"], ctes=[("gs", _gen_sql("2019"))]))
def generator_surface(spark, sf):
    """Generator density summed over the 2019 generators."""
    d = wt.generator_surface(_features(spark, sf).select("event_id", "MCPrimaryEnergy"), fx.generators(spark), "2019")
    return rounded(d.select("event_id", "gen_sum"))


def _weights_query(year: str):
    def run(spark, sf):
        d = wt.one_weights(_features(spark, sf).select("event_id", "MCPrimaryEnergy", "TIntProbW"),
                           fx.generators(spark), year)
        return rounded(d.select("event_id", F.log10("generator_weights").alias("log_weight")))
    sql = oracle("SELECT event_id, CASE WHEN gen_sum > 0 THEN log10(tint_prob_w / (gen_sum * e)) END AS log_weight "
                 "FROM gs", ["frames", "generators"], ["log_weight"], ["event_id"], ctes=[("gs", _gen_sql(year))])
    return run, sql


for _y in ("2019", "2012"):
    _f, _s = _weights_query(_y)
    query(f"weights_{_y}", _s)(_f)


# ------------------------------------------------------------------ M4
@query("split_hash", oracle(
    "SELECT event_id, CASE WHEN u < 0.1 THEN 'test' WHEN u < " + repr(0.1 + 0.9 * 0.2) + " THEN 'eval' ELSE 'train' END "
    "AS split FROM (SELECT event_id, " + hash_uniform_sql("event_id", 1.0, "split") + " AS u FROM frames "
    "WHERE stop = 'Physics') t", ["frames"], [], ["event_id", "split"]))
def split_hash(spark, sf):
    """M4: repeatable hash split, 0.1 test then 0.2 of the rest for eval."""
    return wt.hash_split(_features(spark, sf).select("event_id")).select("event_id", "split")


@query("split_exact", oracle(
    "SELECT event_id, CASE WHEN r < nt THEN 'test' WHEN r < nt + ne THEN 'eval' ELSE 'train' END AS split FROM "
    "(SELECT *, (n - nt) * 2 // 10 + CASE WHEN ((n - nt) * 2) % 10 > 0 THEN 1 ELSE 0 END AS ne FROM "
    "(SELECT *, n // 10 + CASE WHEN n % 10 > 0 THEN 1 ELSE 0 END AS nt FROM "
    "(SELECT event_id, row_number() OVER (ORDER BY u, event_id) - 1 AS r, count(*) OVER () AS n FROM "
    "(SELECT event_id, " + hash_uniform_sql("event_id", 1.0, "split") + " AS u FROM frames WHERE stop = 'Physics') a) b) c) d",
    ["frames"], [], ["event_id", "split"]))
def split_exact(spark, sf):
    """M4 exact sizes: ceil(0.1 n) test rows, ceil(0.2 rest) eval rows, in hash order."""
    return wt.exact_split(_features(spark, sf).select("event_id")).select("event_id", "split")


# ------------------------------------------------------------------ M5
GRAD_BASE_SQL = ("SELECT event_id, coalesce(e_dnn_hive, e_dnn_alt) AS p, log10(e_entry) AS t FROM frames "
                 "WHERE stop = 'Physics' AND e_entry > 0")
_GRAD_SQL = {
    "rmse": ("p - t", "1.0"),
    "pshe": ("(p - t) / sqrt(1.0 + (p - t) * (p - t))", "1.0 / (1.0 + (p - t) * (p - t)) / sqrt(1.0 + (p - t) * (p - t))"),
    "pshedelta": ("(p - t) / sqrt(1.0 + ((p - t) / 2.0) * ((p - t) / 2.0))",
                  "8.0 / (1.0 + ((p - t) / 2.0) * ((p - t) / 2.0)) / sqrt(1.0 + ((p - t) / 2.0) * ((p - t) / 2.0))"),
    "rrmse": ("CASE WHEN t <> 0 THEN (p - t) / t END", "CASE WHEN t <> 0 THEN 1.0 / t END"),
}
PSHE_DELTA = 2.0


def _grad_query(name):
    def run(spark, sf):
        f = ft.physics_frames(fx.frames(spark, sf)).where(F.col("e_entry") > 0)
        d = f.select("event_id", ft.dnn_energy().alias("p"), F.log10("e_entry").alias("t"))
        g, h = grad_hess(name, "p", "t", PSHE_DELTA)
        return rounded(d.select("event_id", g.alias("grad"), h.alias("hess")))
    gs, hs = _GRAD_SQL[name]
    return run, oracle(f"SELECT event_id, {gs} AS grad, {hs} AS hess FROM gb", ["frames"], ["grad", "hess"],
                       ["event_id"], ctes=[("gb", GRAD_BASE_SQL)])


for _o in ("rmse", "pshe", "pshedelta", "rrmse"):
    _f, _s = _grad_query(_o)
    query(f"grad_{_o}", _s)(_f)


# ------------------------------------------------------------------ M6 / M7 / S10-S13 / A14
def training_frame(spark, sf):
    """P12 -> label log10(E_entry) -> M1 weights -> M4 split."""
    clean = ft.clean_training(_features(spark, sf))
    w = wt.one_weights(clean, fx.generators(spark), "2019")
    lab = w.withColumn("label", F.log10("E_entry"))
    return wt.hash_split(lab)


def trained(spark, sf, objective: str = "rmse", rounds: int = ROUNDS):
    return bt.train(training_frame(spark, sf), TRAIN_FEATURES, "label", weight="generator_weights", objective=objective,
                    rounds=rounds, eta=0.03, max_depth=6, subsample=0.8, early_stopping=PATIENCE)


@query("train_model")
def train_model(spark, sf):
    """M6: one row per boosting round: tree size and train/eval metric."""
    res = trained(spark, sf)
    ev = {(r, s): v for r, s, _, v in res.curve}
    rows = [(i, t.num_nodes, t.depth, ev.get((i, "train")), ev.get((i, "eval"))) for i, t in enumerate(res.model.trees)]
    return spark.createDataFrame(rows, "round int, num_nodes int, depth int, train_rmse double, eval_rmse double")


@query("loss_curve")
def loss_curve(spark, sf):
    """Per-round train/eval metric table."""
    res = trained(spark, sf)
    return spark.createDataFrame(res.curve, "round int, split string, metric string, value double")


@query("feature_importance")
def feature_importance(spark, sf):
    """Importance per feature summed over the trees."""
    imp = trained(spark, sf).model.importance()
    return spark.createDataFrame(sorted(imp.items()), "feature string, importance double")


@query("grid_search")
def grid_search(spark, sf):
    """M9: every valid point of the reference's grid, five folds, 30 trees, pseudo-Huber objective, weighted rows."""
    # the reference keeps 0.4 for tests before it searches
    data = wt.hash_split(ft.clean_training(_features(spark, sf)).withColumn("label", F.log10("E_entry")), test=0.4, eval_share=0.2)
    data = wt.one_weights(data.where(F.col("split") == "train"), fx.generators(spark), "2019")
    best, table = bt.grid_search(data, TRAIN_FEATURES, "label", weight="generator_weights")
    rows = [(*(float(point[k]) for k in bt.REFERENCE_GRID), score, min(scores), max(scores), point == best) for point, score, scores in table]
    return spark.createDataFrame(rows, ", ".join(f"{k} double" for k in bt.REFERENCE_GRID)
                                 + ", mean_r2 double, least_r2 double, most_r2 double, is_best boolean")


@query("test_predictions")
def test_predictions(spark, sf):
    """Held-out test rows with the log10 prediction (log unit, as the reference saves)."""
    p = trained(spark, sf).predictions.where(F.col("split") == "test")
    return p.select("event_id", "E_entry", "label", "log_e_predicted")


@query("score_events")
def score_events(spark, sf):
    """M7: every Physics frame scored (missing energies allowed), GeV output."""
    model = trained(spark, sf).model
    feats = ft.flatten_features(fx.frames(spark, sf))
    s = model.transform(feats)
    return s.select("event_id", "log_e_predicted", exp_energy("log_e_predicted").alias("e_predicted"))


@query("score_frames")
def score_frames(spark, sf):
    """Files of frames in, files of whole frames out, Physics frames with the truth and prediction keys.

    Two folders with files of the same names; DAQ frames pass through.  What is returned is read
    from the files written: one row a frame, its other columns as JSON, and the names of its file.
    """
    nested = fr.nest_frames(fx.frames(spark, sf, by_event=True), fx.dom_hits(spark, sf, by_event=True))
    root = f"{checkpoint_dir(spark).rstrip('/')}/scored-{uuid.uuid4().hex}"
    side = F.when(F.pmod("event_id", F.lit(2)) == 0, "even").when(F.pmod("event_id", F.lit(2)) == 1, "odd")
    with passing(spark):
        with passing(spark):  # what the truth is made of is deleted before frames are written
            truth = stored(th.truth_column(fx.frames(spark, sf), fx.tracks(spark, sf), fx.particles(spark, sf)), lasting=True)
        model = trained(spark, sf).model
        # one pass writes both folders, so the frames are built once and a task gives its files one name in both
        fr.write_table(nested.withColumn("side", side).where("side IS NOT NULL"), f"{root}/in", partition_by=("side",))
        score_files(spark, [f"{root}/in"], f"{root}/out", model, truth, glob="part-*.parquet")
    kept = ["event_id", "stop", "dataset", "ace_prediction", "ace_truth"]
    out = spark.read.parquet(f"{root}/out")
    rest = F.to_json(F.struct(*[c for c in nested.columns if c not in kept]))
    return out.select(*kept, rest.alias("frame"), F.substring_index("out_folder", "=", -1).alias("folder"), "out_file")
