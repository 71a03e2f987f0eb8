"""Identities on the fixture tables."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL
from tracklake.functions.energy import exp_energy, log_energy
from tracklake.sources import fixtures as fx


def test_exp_of_log_is_identity(spark):
    f = fx.frames(spark, SMALL).where(F.col("e_entry") > 0)
    bad = f.where(F.abs(exp_energy(log_energy("e_entry")) - F.col("e_entry")) > 1e-6 * F.col("e_entry")).count()
    assert bad == 0


def test_cylinder_entry_before_exit(spark):
    q = entry.queries()["cylinder_intersection"](spark, SMALL)
    assert q.where(F.col("first").isNotNull()).count() > 0
    assert q.where(F.col("first") > F.col("second")).count() == 0
    assert q.where(F.col("first").isNull() != F.col("second").isNull()).count() == 0


def test_entry_energy_not_below_exit(spark):
    e = entry.queries()["edge_energies"](spark, SMALL)
    both = e.where(F.col("e_entry").isNotNull() & F.col("e_exit").isNotNull())
    assert both.count() > 0
    assert both.where(F.col("e_entry") < F.col("e_exit")).count() == 0


def test_histogram_total_equals_rows_in_range(spark):
    h = entry.queries()["poisson_hist"](spark, SMALL)
    f = fx.frames(spark, SMALL).where((F.col("stop") == "Physics") & (F.col("e_entry") > 0))
    assert h.agg(F.sum("n")).first()[0] == f.count()


def test_informative_feature_beats_noise(spark):
    imp = {r.feature: r.importance for r in entry.queries()["feature_importance"](spark, SMALL).collect()}
    assert imp["E_dnn"] > imp["random_variable"]
    curve = entry.queries()["loss_curve"](spark, SMALL).where(F.col("split") == "train").orderBy("round").collect()
    assert curve[-1].value < curve[0].value
