"""Hand-computed cases and identities for the operators (model: SURVEY §5)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.functions import binning, energy, geometry, stats
from tracklake.operators import boost, features, histograms, quantiles, scans, solvers, tree, truth, weights


# ------------------------------------------------------------------ T1 cylinder
def _ix(spark, rows):
    df = spark.createDataFrame(rows, "x double, y double, z double, zenith double, azimuth double")
    return [(r.first, r.second) for r in df.select(
        geometry.intersect_cylinder("x", "y", "z", "zenith", "azimuth").alias("i")).select("i.*").collect()]


def test_cylinder_miss_and_vertical(spark):
    c = geometry.CYLINDER_CENTER
    # far outside radius, pointing away in azimuth: d <= 0 -> miss
    (a, b), = _ix(spark, [(c[0] + 5000.0, c[1], 0.0, math.pi / 2, math.pi / 2)])
    assert a is None and b is None
    # nearly vertical down-going track starting above the centre: enters the top cap
    (a, b), = _ix(spark, [(c[0], c[1], 1000.0, 1e-9, 0.0)])
    assert a == pytest.approx(200.0, abs=1e-3) and b == pytest.approx(1800.0, abs=1e-3)


def test_cylinder_horizontal_inside_start(spark):
    c = geometry.CYLINDER_CENTER
    # starts at the centre; zenith pi/2 -> radial pair (-800, 800) before clipping by height
    (a, b), = _ix(spark, [(c[0], c[1], 0.0, math.pi / 2, 0.0)])
    assert a == pytest.approx(-800.0, abs=1e-6) and b == pytest.approx(800.0, abs=1e-6)
    assert a <= b


# ------------------------------------------------------------------ T2/T3 energies
def _moved(spark, e, length, e_i, d_i, e_f, d_f):
    """A track from (1, 2, 3) along (0.6, 0, 0.8), with the positions of its entry and exit."""
    at = lambda d: (1 + 0.6 * d, 2.0, 3 + 0.8 * d)
    return spark.createDataFrame([(1, 2, 1.0, 2.0, 3.0, e, length, e_i, *at(d_i), e_f, *at(d_f))],
                                 "event_id long, particle_idx long, x double, y double, z double, energy double, length double, "
                                 "e_i double, x_i double, y_i double, z_i double, e_f double, x_f double, y_f double, z_f double")


def test_losses_lie_where_their_positions_are(spark):
    tree = spark.createDataFrame([(1, 10, 2, 50.0, 181.0, 2.0, 243.0), (1, 11, 2, 100.0, 1.0, 502.0, 3.0),
                                  (1, 12, 10, 7.0, 0.0, 0.0, 0.0)],
                                 "event_id long, idx long, parent_idx long, energy double, x double, y double, z double")
    t = _moved(spark, 1000.0, 1000.0, 900.0, 100.0, 100.0, 800.0)
    got = truth.cumulative_losses(t, tree).orderBy("idx").collect()
    assert [(r.idx, r.dist, r.elost) for r in got] == [(10, 300.0, 50.0), (11, 500.0, 150.0)]
    cps, losses = truth.loss_tables(t, tree)
    assert [(r.len, r.e) for r in cps.orderBy("k").collect()] == [(0, 1000), (100, 900), (800, 100), (1000, 0)]
    assert [(r.len, r.e) for r in losses.orderBy("j").collect()] == [(0, 0), (300, 50), (500, 150), (800, 0), (1000, 0)]


def _track(spark, e=1000.0, length=1000.0, e_i=900.0, d_i=100.0, e_f=100.0, d_f=800.0):
    t = _moved(spark, e, length, e_i, d_i, e_f, d_f)
    losses = spark.createDataFrame([(1, 10, 300.0, 50.0, 50.0), (1, 11, 500.0, 100.0, 150.0)],
                                   "event_id long, idx long, dist double, energy double, elost double")
    return truth.with_checkpoints(t, losses)


def _energy(df, L):
    e, failed = truth.energy_at(F.lit(float(L)) if L is not None else F.lit(None).cast("double"))
    r = df.select(e.alias("e"), failed.alias("f")).first()
    return r.e, r.f


def test_energy_at_rules(spark):
    t = _track(spark)
    assert _energy(t, -5)[0] == 1000.0           # before start -> initial energy
    assert _energy(t, 1000)[0] == 0.0            # at / past the end -> 0
    assert _energy(t, None) == (None, True)      # missed cylinder -> failure
    # between entry (100 m, 900 GeV) and exit (800 m, 100 GeV): losses 50 @300, 150 @500
    # rate = (900 - 100 - 150) / 700 ; at 400 m the last loss before is 50
    rate = (900 - 100 - 150) / 700
    e, f = _energy(t, 400)
    assert not f and e == pytest.approx(900 - 50 - rate * 300)


def test_energy_assertion_to_null(spark):
    # losses larger than the checkpoint energy -> NULL and failed
    t = _moved(spark, 100.0, 1000.0, 10.0, 100.0, 0.0, 800.0)
    losses = spark.createDataFrame([(1, 10, 300.0, 50.0, 50.0)],
                                   "event_id long, idx long, dist double, energy double, elost double")
    c = truth.with_checkpoints(t, losses)
    e, f = _energy(c, 400)
    assert e is None and f


def test_checkpoints_shape(spark):
    r = _track(spark).select("cps", "losses").first()
    assert [(c.len, c.e, c.off) for c in r.cps] == [(0.0, 1000.0, 0), (100.0, 900.0, 1), (800.0, 100.0, 3),
                                                     (1000.0, 0.0, 4)]
    assert [(x.len, x.e) for x in r.losses] == [(0.0, 0.0), (300.0, 50.0), (500.0, 150.0), (800.0, 0.0),
                                                 (1000.0, 0.0)]


# ------------------------------------------------------------------ J4 DFS order
def _dfs_python(rows):
    kids = {}
    for e, i, p, pdg, loc in rows:
        kids.setdefault(p, []).append((i, pdg, loc))
    byid = {i: (pdg, loc) for e, i, p, pdg, loc in rows}
    stack = [r[1] for r in rows if r[2] is None]
    while stack:
        n = stack.pop()
        pdg, loc = byid[n]
        if abs(pdg) in (12, 14, 16) and loc == "InIce":
            return n
        stack.extend(i for i, _, _ in sorted(kids.get(n, [])))
    return None


def test_dfs_differs_from_bfs(spark):
    # root 1 (not in ice) -> children 2, 3; 2 -> child 4 (neutrino); 3 -> child 5 (neutrino)
    # BFS would find 4 first by idx; LIFO DFS pops 3 first and finds 5.
    rows = [(1, 1, None, 14, "Anywhere"), (1, 2, 1, 13, "InIce"), (1, 3, 1, 13, "InIce"),
            (1, 4, 2, 14, "InIce"), (1, 5, 3, 12, "InIce")]
    p = spark.createDataFrame(rows, "event_id long, idx long, parent_idx long, pdg int, location_type string") \
        .withColumn("energy", F.lit(1.0))
    got = tree.interacting_neutrino(p).first().nu_idx
    assert got == _dfs_python(rows) == 5


def test_search_from_below_equals_the_stack(spark):
    """Random forests, a chain, a node that has most rows as children, circles and lost parents."""
    rng = np.random.default_rng(5)
    events = {}
    for e in range(60):
        n = int(rng.integers(1, 30))
        idx = (rng.permutation(n) + 1).tolist()
        events[e] = [(e, i, idx[int(rng.integers(0, k))] if k and rng.random() > 0.1 else None,
                      int(rng.choice([13, 99, 14, -12])), str(rng.choice(["InIce", "Anywhere"], p=[0.6, 0.4])))
                     for k, i in enumerate(idx)]
    chain, wide, odd = 60, 61, 62
    events[chain] = [(chain, i, i - 1 or None, 16 if i >= 2998 else 13, "InIce") for i in range(1, 3001)]
    events[wide] = [(wide, i, min(i - 1, 2) or None, 14 if i > 4000 else 99, "InIce") for i in range(1, 8001)]
    events[odd] = [(odd, 1, None, 13, "InIce"), (odd, 2, 4, 13, "InIce"), (odd, 3, 2, 13, "InIce"), (odd, 4, 3, 13, "InIce"),
                   (odd, 5, 4, 14, "InIce"), (odd, 6, 77, 14, "InIce"), (odd, 7, 7, 14, "InIce"), (odd, 8, 1, 13, "InIce")]
    p = spark.createDataFrame(sum(events.values(), []), "event_id long, idx long, parent_idx long, pdg int, location_type string") \
        .withColumn("energy", F.col("idx").cast("double"))
    got = {r.event_id: r.nu_idx for r in tree.interacting_neutrino(p).collect()}
    first = {e: min(r[1] for r in rows if r[2] is None) for e, rows in events.items()}
    # the first root alone is searched from
    want = {e: _dfs_python([r for r in rows if r[2] is not None or r[1] == first[e]]) for e, rows in events.items()}
    assert got == {e: nu for e, nu in want.items() if nu is not None}
    assert got[chain] == 2998 and got[wide] == 8000 and odd not in got and len(got) > 30


def test_interaction_cases(spark):
    def case(children):
        rows = [(1, 1, None, 14, "InIce", 1.0)] + [(1, 2 + k, 1, pdg, "InIce", 1.0) for k, pdg in enumerate(children)]
        p = spark.createDataFrame(rows, "event_id long, idx long, parent_idx long, pdg int, location_type string, "
                                        "energy double")
        return tree.interaction_products(p).first().case_no
    assert case([99, 13]) == 1      # hadron + lepton
    assert case([99, 99]) == 2      # no lepton, no outgoing neutrino
    assert case([13, 14]) == 3      # no hadron + outgoing neutrino
    assert case([99, 12]) == 4      # hadron + outgoing neutrino
    assert case([13, 13]) is None   # two leptons: not classified
    assert case([99]) is None       # children != 2


# ------------------------------------------------------------------ A6 / binning
def test_hist_right_edge_included(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,), (2.0,)], "x double")
    b = df.withColumn("bin", binning.uniform_bin(F.col("x"), 0.0, 1.0, 2))
    h = {r.bin: (r.hist, r.err) for r in histograms.weighted_hist(b, "bin", 2).collect()}
    assert h[0] == (1.0, 1.0)
    assert h[1][0] == 3.0 and h[1][1] == pytest.approx(math.sqrt(3))   # 0.5, 1.0, 1.0 (right edge kept)
    np_counts, _ = np.histogram([0.0, 0.5, 1.0, 1.0, 2.0], bins=[0.0, 0.5, 1.0])
    assert list(np_counts) == [1, 3]


def test_edges_match_numpy(spark):
    e = binning.edge_frame(spark, 10.0, 1e5, 7, log=True).orderBy("edge_no").collect()
    assert np.allclose([r.edge for r in e], np.logspace(1, 5, 7))
    e = binning.edge_frame(spark, -1.0, 3.0, 5).orderBy("edge_no").collect()
    assert np.allclose([r.edge for r in e], np.linspace(-1, 3, 5))


# ------------------------------------------------------------------ exact quantiles
def test_quantiles_match_numpy_on_skewed_groups(spark):
    rng = np.random.default_rng(7)
    hot = rng.normal(size=3000)          # one group holds most rows
    cold = rng.exponential(size=40)
    rows = [(0, float(v)) for v in hot] + [(1, float(v)) for v in cold] + [(2, 5.0)]
    df = spark.createDataFrame(rows, "g long, v double")
    q = quantiles.grouped_quantiles(df, ["g"], "v", [0.159, 0.5, 0.841])
    got = {(r.g, round(r.prob, 3)): r.value for r in q.collect()}
    for g, vals in ((0, hot), (1, cold), (2, np.array([5.0]))):
        for p in (0.159, 0.5, 0.841):
            assert got[(g, p)] == pytest.approx(np.percentile(vals, p * 100), rel=1e-12, abs=1e-12)


def test_ordered_key_is_the_order_of_doubles_and_back(spark):
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2**63, 2000, dtype=np.int64).view(np.float64)
    special = [0.0, 5e-324, 1e-310, 2.0**-1022, 1.0, np.nextafter(1, 0), np.nextafter(2, 0), 2.0, 0.1, 1e308, np.finfo(float).max,
               np.inf, *(2.0**k for k in range(-1074, 1024, 37)), *(np.nextafter(2.0**k, 0) for k in range(-1020, 1024, 41))]
    values = [float(v) for v in np.concatenate([bits[~np.isnan(bits)], special])]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", quantiles.ordered_key(F.col("v")).alias("k")).withColumn("back", quantiles.value_of_key(F.col("k"))).collect()
    assert all(r.back == r.v for r in rows)
    assert all(r.k == (1 if r.v > 0 else -1) * int(np.float64(abs(r.v)).view(np.int64)) for r in rows)
    assert spark.range(1).select(quantiles.ordered_key(F.lit(float("nan"))).alias("k")).first().k is None


def test_quantiles_of_ties_nulls_and_infinities(spark):
    vals = [7.25] * 500 + [float(i % 9) for i in range(300)] + [-1e300, 1e-320, float("inf"), float("-inf"), -0.0, 0.0]
    rows = [(None, v) for v in vals] + [(1, None), (1, float("nan")), (2, float("nan")), (2, 3.0), (2, 4.0)]
    df = spark.createDataFrame(rows, "g long, v double")
    probs = [0.0, 0.001, 0.159, 0.5, 0.841, 1.0]
    got = {(r.g, r.prob): (r.n, r.value) for r in quantiles.grouped_quantiles(df, ["g"], "v", probs).collect()}
    assert {g for g, _ in got} == {None, 2}
    ordered = np.sort(vals)
    for p in probs[2:5]:
        assert got[None, p] == (806, pytest.approx(np.percentile(ordered, p * 100)))
    assert got[None, 0.0][1] == float("-inf") and got[None, 1.0][1] == float("inf") and got[2, 0.5] == (2, 3.5)
    empty = quantiles.grouped_quantiles(df.where("g = 9"), ["g"], "v", probs)
    assert empty.collect() == [] and empty.columns == ["g", "prob", "n", "value"]


@pytest.mark.parametrize("closed", [True, False])
def test_bin_index_equals_digitize(spark, closed):
    edges = [-3.0, -0.5, 0.0, 0.1, 2.0, 7.5, 100.0]
    rng = np.random.default_rng(4)
    values = [float(v) for v in rng.uniform(-5, 120, 300)] + edges + [float("inf"), float("-inf"), -3.0000001, 100.0000001]
    df = spark.createDataFrame([(v, edges) for v in values] + [(None, edges), (float("nan"), edges)], "v double, e array<double>")
    rows = df.select("v", binning.bin_index("v", edges, closed).alias("a"), binning.bin_index("v", F.col("e"), closed).alias("b")).collect()
    for r in rows:
        want = None if r.v is None or np.isnan(r.v) else int(np.digitize(r.v, edges)) - 1
        if want is not None:
            want = len(edges) - 2 if closed and r.v == edges[-1] else want if 0 <= want < len(edges) - 1 else None
        assert r.a == r.b == want
    with pytest.raises(ValueError):
        binning.bin_index("v", [1.0, 1.0])


def test_running_hot_and_cold_paths_agree(spark):
    from tracklake.operators.running import running
    rng = np.random.default_rng(11)
    rows = [(0, i, float(x)) for i, x in enumerate(rng.uniform(0, 1, 2000))] + \
           [(k, i, float(i)) for k in (1, 2, None) for i in range(5)]
    df = spark.createDataFrame(rows, "g long, i long, v double")
    a = {(r.g, r.i): (r.row_no, round(r.running_sum, 6)) for r in running(df, ["g"], ["i"], "v", hot_rows=100).collect()}
    b = {(r.g, r.i): (r.row_no, round(r.running_sum, 6)) for r in running(df, ["g"], ["i"], "v", hot_rows=10**9).collect()}
    assert a == b and len(a) == 2015
    assert a[(0, 1999)][0] == 2000 and a[(None, 4)] == (5, 10.0)


# ------------------------------------------------------------------ W2 / P14 / M8
def test_local_maxima_factor_guard(spark):
    from tracklake.plans.analysis import local_maxima
    s = spark.createDataFrame([("a", 0, 1), ("a", 1, 5), ("a", 2, 1), ("a", 3, 2)], "k string, i long, n long")
    assert [r.i for r in local_maxima(s, "k", "i", "n", 1.1).collect()] == [1]
    with pytest.raises(ValueError):
        local_maxima(s, "k", "i", "n", 0.9)


def test_feature_validation_raises(spark):
    df = spark.createDataFrame([(1, 2.0)], "event_id long, cog_z double")
    with pytest.raises(KeyError):
        features.prune_features(df, features.FEATURE_SETS["standard_feat"])
    with pytest.raises(ValueError):
        boost.objective_functions("weightrmse")
    assert boost.model_name("reg:pshe", "m", 10, "L5_E.yaml", 0.1) == "reg_pshe_m_N10_L5_E_0.1.model"


# ------------------------------------------------------------------ chi-square helpers
def test_chisq_inverse_pairs():
    for k in (1, 2):
        for s in (1.0, 2.0, 3.0):
            assert stats.sigma_for_chisq(stats.chisq_for_sigma(s, k), k) == pytest.approx(s, rel=1e-9)
    assert stats.chisq_for_sigma(1.0, 2) == pytest.approx(2.2957489, rel=1e-6)


def test_log_energy_rules(spark):
    df = spark.createDataFrame([(100.0,), (0.0,), (-1.0,), (None,)], "e double")
    assert [r.l for r in df.select(energy.log_energy("e").alias("l")).collect()] == [2.0, float("-inf"), None, None]


# ------------------------------------------------------------------ M4 splits
def test_exact_split_sizes(spark):
    df = spark.range(1, 1234).withColumnRenamed("id", "event_id")
    s = {r.split: r.n for r in weights.exact_split(df).groupBy("split").agg(F.count("*").alias("n")).collect()}
    n = 1233
    nt = math.ceil(n / 10)
    ne = math.ceil((n - nt) * 2 / 10)
    assert s == {"test": nt, "eval": ne, "train": n - nt - ne}


def test_unknown_sim_year(spark):
    from tracklake.sources.fixtures import generators
    df = spark.createDataFrame([(1, 1000.0, 0.01)], "event_id long, MCPrimaryEnergy double, TIntProbW double")
    with pytest.raises(ValueError):
        weights.one_weights(df, generators(spark), "2020")


# ------------------------------------------------------------------ L4/L5, J2 identities
def test_wide_long_roundtrip(spark):
    df = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0}), (2, {"a": 3.0, "b": 4.0})], "fit_id long, fitted map<string,double>")
    w = scans.fitted_wide(df)
    l2 = scans.fitted_long(w, ["a", "b"], ["fit_id"])
    back = {(r.fit_id, r.key): r.value for r in l2.collect()}
    assert back == {(1, "a"): 1.0, (1, "b"): 2.0, (2, "a"): 3.0, (2, "b"): 4.0}
    bad = spark.createDataFrame([(1, {"a": 1.0}), (2, {"b": 2.0})], "fit_id long, fitted map<string,double>")
    with pytest.raises(ValueError):
        scans.fitted_wide(bad)


def test_update_is_idempotent(spark):
    from tracklake.plans.extract import update_columns
    left = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y")], "event_id long, v double, s string")
    right = spark.createDataFrame([(1, 9.0, 5.0), (2, None, 6.0)], "event_id long, v double, new double")
    once = update_columns(left, right)
    twice = update_columns(once, right)
    assert once.columns == left.columns
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.event_id: r.v for r in once.collect()} == {1: 9.0, 2: 2.0}


# ------------------------------------------------------------------ solvers
def test_spline_roots_on_cubic():
    x = np.linspace(-2, 3, 11)
    y = (x - 0.5) * (x + 1.0) * (x - 2.0)          # a cubic is reproduced exactly by the spline
    roots = solvers.spline_roots(x, y, 0.0)
    assert np.allclose(roots, [-1.0, 0.5, 2.0], atol=1e-9)


def test_gauss_slices_in_both_spaces(spark):
    """Parameters against a fine grid around them, counts, centres, slices without enough bins, other names of spaces."""
    rng = np.random.default_rng(8)
    rows = [(float(10 ** rng.uniform(k, k + 1)), float(10 ** rng.normal(2 + 0.3 * k, 0.2))) for k in range(3) for _ in range(1500)]
    rows += [(2000.0, 100.0)] * 5 + [(-1.0, 100.0), (5.0, 1e9), (None, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    xe, ye = [1.0, 10.0, 100.0, 1000.0, 10000.0], [float(10 ** v) for v in np.linspace(1, 4, 31)]
    got = {r.xbin: r for r in histograms.gauss_slices(df, "x", "y", xe, ye, "log", "log").collect()}
    h = np.histogram2d(*np.array([r for r in rows if r[0] is not None]).T, bins=(xe, ye))[0]
    centers = (np.linspace(1, 4, 31)[:-1] + np.linspace(1, 4, 31)[1:]) / 2
    assert sorted(got) == [0, 1, 2, 3]
    for k, r in got.items():
        assert r.x_center == pytest.approx(10 ** (k + 0.5)) and r.counts == h[k].tolist() and r.n == h[k].sum()
        assert r.y_values == pytest.approx(centers.tolist()) and r.nonzero_bins == (h[k] > 0).sum()
    assert got[3].n == 5 and got[3].mean is None and got[3].cov_mm is None
    for k in range(3):
        def cost(m, s, n, k=k):
            return float(((n * np.exp(-0.5 * ((centers - m) / s) ** 2) / s / np.sqrt(2 * np.pi) - h[k]) ** 2).sum())
        r = got[k]
        assert r.mean == pytest.approx(2 + 0.3 * k, abs=0.05) and r.std == pytest.approx(0.2, abs=0.03)
        best = cost(r.mean, r.std, r.norm)
        for dm, ds, dn in np.ndindex(5, 5, 5):
            assert best <= cost(r.mean + (dm - 2) * 1e-4, r.std + (ds - 2) * 1e-4, r.norm * (1 + (dn - 2) * 1e-3)) + 1e-9
    linear = histograms.gauss_slices(df, "x", "y", xe, ye, "linear", "linear").where("xbin = 1").first()
    assert linear.x_center == 55.0 and linear.y_values == pytest.approx([(a + b) / 2 for a, b in zip(ye, ye[1:])])
    for spaces in (("log", "cubic"), ("Log", "linear")):
        with pytest.raises(ValueError):
            histograms.gauss_slices(df, "x", "y", xe, ye, *spaces)


def test_gauss_fit_recovers_parameters():
    x = np.linspace(-3, 5, 40)
    y = 250.0 * np.exp(-0.5 * ((x - 1.2) / 0.7) ** 2) / (0.7 * np.sqrt(2 * np.pi))
    p, cov = solvers.fit_gauss(x, y)
    assert p == pytest.approx([1.2, 0.7, 250.0], rel=1e-6)


# ------------------------------------------------------------------ M6 boosting
def test_boosting_loss_falls_and_informative_feature_wins(spark):
    rng = np.random.default_rng(3)
    n = 1500
    good = rng.uniform(2, 6, n)
    noise = rng.uniform(0, 10, n)
    label = 3.0 + (good - 4.0) / 4.0 + rng.normal(0, 0.02, n)   # log10-energy-like spread
    split = np.where(np.arange(n) % 5 == 0, "eval", "train")
    rows = [(int(i), float(a), float(b), float(c), str(s)) for i, (a, b, c, s) in enumerate(zip(good, noise, label, split))]
    df = spark.createDataFrame(rows, "event_id long, good double, noise double, label double, split string")
    res = boost.train(df, ["good", "noise"], "label", objective="pshe", rounds=6, eta=0.5, max_depth=3,
                      subsample=1.0)
    ev = [v for r, s, m, v in res.curve if s == "eval"]
    assert all(b <= a for a, b in zip(ev, ev[1:]))
    assert ev[-1] < ev[0]
    imp = res.model.importance()
    assert imp["good"] > imp["noise"]
    # same seed, same model
    res2 = boost.train(df, ["good", "noise"], "label", objective="pshe", rounds=6, eta=0.5, max_depth=3,
                       subsample=1.0)
    assert [v for *_, v in res2.curve] == pytest.approx([v for *_, v in res.curve])


def _gradient_sums(objective, p, y, w):
    g, h = boost.gradients(objective, p, y, 1.0)
    return g * w, h * w


def _brute_tree(x, g, h, p, depth):
    """Leaf value of every row of a tree that tries all values of all features as thresholds."""
    score = lambda a, b: a * a / (b + p.reg_lambda)
    best = (1e-10, None)
    if depth < p.max_depth:
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= t
                sums = [(g[s].sum(), h[s].sum()) for s in (left, ~left)]
                if min(b for _, b in sums) >= p.min_child_weight:
                    gain = 0.5 * (sum(score(*s) for s in sums) - score(g.sum(), h.sum())) - p.gamma
                    if gain > best[0] + 1e-9:
                        best = (gain, left)
    if best[1] is None:
        return np.full(len(x), -g.sum() / (h.sum() + p.reg_lambda))
    out = np.empty(len(x))
    for side in (best[1], ~best[1]):
        out[side] = _brute_tree(x[side], g[side], h[side], p, depth + 1)
    return out


@pytest.mark.parametrize("objective", ["rmse", "pshe"])
def test_boosting_equals_a_brute_force_split_finder(spark, objective):
    rng = np.random.default_rng(8)
    n = 160
    x = np.round(rng.uniform(0, 1, (n, 3)), 1)  # few values: every one is an edge of a bin
    y = 2 * x[:, 0] - x[:, 1] * x[:, 2] + rng.normal(0, 0.2, n)
    w = rng.uniform(0.5, 2, n)
    w = w / w.mean()
    df = spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(x, y, w)], "a double, b double, c double, y double, w double")
    models = [boost.Params(3, 0.3, 1.0, gamma, least) for gamma, least in ((0.0, 1.0), (0.2, 6.0))]
    got = boost.boost(df, ["a", "b", "c"], "y", models, "w", None, 1, objective, rounds=4)
    for p, trees in zip(models, got.trees):
        want = np.full(n, (y * w).sum() / w.sum())
        assert got.base == pytest.approx(want[0])
        for tree_no in range(4):
            want = want + p.eta * _brute_tree(x, *_gradient_sums(objective, want, y, w), p, 0)
            mine = got.base + p.eta * boost.Packed(trees[:tree_no + 1]).sums(x)
            assert mine == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("objective", ["rmse", "pshe"])
def test_rounds_in_one_task_equal_those_of_a_job_a_level(spark, monkeypatch, objective):
    rng = np.random.default_rng(21)
    n = 700
    x = rng.uniform(0, 1, (n, 3))
    y = 2 * x[:, 0] - x[:, 1] * x[:, 2] + rng.normal(0, 0.3, n)
    rows = [(*map(float, r), float(a), float(b), ("eval", "train", "train", "test")[i % 4]) for i, (r, a, b) in enumerate(zip(x, y, rng.uniform(0.5, 2, n)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double, w double, split string").repartition(3)
    fit = lambda: boost.train(df, ["a", "b", "c"], "label", "w", objective=objective, rounds=14, eta=0.5, max_depth=4, early_stopping=3)
    monkeypatch.setattr(boost, "ROUNDS_AT_ONCE", 4)  # margins go on from run to run
    inside = fit()
    monkeypatch.setattr(boost, "ROWS_IN_TASK", 0)
    jobs = fit()
    assert 4 < len(inside.model.trees) < 14 and len(inside.model.trees) == len(jobs.model.trees)  # stopped early
    assert [boost._shape(t) for t in inside.model.trees] == [boost._shape(t) for t in jobs.model.trees]
    assert [(r, s) for r, s, *_ in inside.curve] == [(r, s) for r, s, *_ in jobs.curve] and inside.best_round == jobs.best_round
    assert [v for *_, v in inside.curve] == pytest.approx([v for *_, v in jobs.curve], abs=1e-12)
    for one, other in zip(inside.model.trees, jobs.model.trees):
        assert one.value == pytest.approx(other.value, abs=1e-12) and one.threshold == other.threshold


def test_the_model_is_trained_for_all_rounds_of_the_training_job(spark, monkeypatch):
    from tracklake.plans import training
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(a + rng.normal(0, 0.1)), ("eval", "train", "train")[i % 3]) for i, a in enumerate(rng.uniform(0, 1, 120))]
    df = spark.createDataFrame(rows, "event_id long, a double, label double, split string").withColumn("generator_weights", F.lit(1.0))
    monkeypatch.setattr(training, "training_frame", lambda *a: df)
    monkeypatch.setattr(training, "TRAIN_FEATURES", ["a"])
    got = training.train_model(spark, "").orderBy("round").collect()
    # the 10000 rounds of the reference's job, or 1000 after the best one on the eval rows
    best = min(range(len(got)), key=lambda r: (got[r].eval_rmse, r))
    assert training.ROUNDS == 10_000 and [r.round for r in got] == list(range(len(got)))
    assert len(got) == min(10_000, best + 1 + 1000)
    assert got[best].eval_rmse < 0.75 * got[0].eval_rmse


def test_leaf_is_newton_step(spark):
    p = boost.Params(0, 1.0, 1.0, reg_lambda=0.0)
    y, w = np.array([0.5, -1.0, 2.0, 0.25]), np.array([1.0, 2.0, 0.5, 4.0])
    df = spark.createDataFrame([(1.0, float(a), float(b)) for a, b in zip(y, w)], "x double, y double, w double")
    got = boost.boost(df, ["x"], "y", [p], "w", objective="pshe", rounds=1)
    g, h = _gradient_sums("pshe", np.full(4, got.base), y, w / w.mean())
    assert got.trees[0][0].value == pytest.approx([-g.sum() / h.sum()])


def _chained(model):
    """The forest as one nested expression a tree."""
    def node(t, i):
        if t.feature[i] < 0:
            return F.lit(float(t.value[i]))
        return F.when(F.col(model.features[t.feature[i]]) <= t.threshold[i], node(t, t.left[i])).otherwise(node(t, t.left[i] + 1))
    total = F.lit(model.base)
    for t in model.trees:
        total = total + F.lit(model.eta) * node(t, 0)
    return total


def test_packed_forest_equals_the_chained_form_and_its_plan_does_not_grow(spark):
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), float(np.sin(6 * a) + b), "eval" if i % 4 == 0 else "train") for i, (a, b) in enumerate(rng.uniform(0, 1, (500, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, label double, split string")
    model = boost.train(df, ["b", "a"], "label", rounds=6, eta=0.3, max_depth=4).model
    scored = model.transform(df.withColumn("log_e_predicted", F.lit("old"))).withColumn("chained", _chained(model)).collect()
    assert len(scored) == 500 and all(r.log_e_predicted == pytest.approx(r.chained, abs=1e-9) for r in scored)
    odd = spark.createDataFrame([(None, 0.5), (float("nan"), 0.5), (float("inf"), 0.5), (float("-inf"), 0.5)], "a double, b double")
    got = [r.log_e_predicted for r in model.transform(odd).collect()]
    assert got[0] == got[1] == got[2] != got[3]
    plan = lambda m: m.transform(df)._jdf.queryExecution().executedPlan().toString().count("\n")
    large = boost.BoostModel(model.features, model.base, 0.01, model.objective, model.trees * 834)  # over 5000 trees
    assert plan(large) == plan(model)
    total = large.transform(df).agg(F.avg("log_e_predicted").alias("m")).first().m
    few = model.transform(df).agg(F.avg("log_e_predicted").alias("m")).first().m
    assert total - model.base == pytest.approx((few - model.base) / 0.3 * 0.01 * 834)


def test_early_stopping_names_the_best_round(spark):
    rng = np.random.default_rng(12)
    rows = [(float(a), float(rng.normal()), "eval" if i % 3 == 0 else "train") for i, a in enumerate(rng.uniform(0, 1, 90))]
    df = spark.createDataFrame(rows, "a double, label double, split string")  # nothing to learn
    res = boost.train(df, ["a"], "label", rounds=12, eta=1.0, max_depth=5, subsample=1.0, early_stopping=2)
    ev = [v for _, s, _, v in res.curve if s == "eval"]
    assert len(ev) < 12 and res.best_round == int(np.argmin(ev)) and len(res.model.trees) == len(ev)


def test_grid_search_trains_all_points_and_folds_alike(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = rng.uniform(0, 1, n)
    rows = [(float(a), float(b), float(3 * a + 0.1 * b)) for a, b in zip(x, rng.uniform(0, 1, n))]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    grid = {"max_depth": [2, 3], "eta": [0.3], "colsample_bytree": [1.0, 1.1]}
    best, table = boost.grid_search(df, ["a", "b"], "label", grid=grid, folds=2, n_trees=8)
    assert len(table) == 2 and best["max_depth"] in (2, 3)  # no share of the features is above 1
    assert all(len(scores) == 2 and 0.5 < s < 1 for _, s, scores in table)
    alone = boost.grid_search(df, ["a", "b"], "label", grid={"max_depth": [3], "eta": [0.3], "colsample_bytree": [1.0]}, folds=2, n_trees=8)[1]
    together = dict((p["max_depth"], scores) for p, _, scores in table)
    assert alone[0][2] == pytest.approx(together[3])
    with pytest.raises(ValueError):
        boost.Params(colsample_bytree=1.1)


def test_edge_energies_from_sums_equal_those_from_arrays(spark):
    """Tracks with and without checkpoints, losses in any order of distance, all or none beyond the edges."""
    from conftest import SMALL
    from tracklake.sources import fixtures as fx
    p, t = fx.particles(spark, SMALL), fx.tracks(spark, SMALL)
    e = F.col("event_id")
    odd = (t.withColumn("e_i", F.when(F.pmod(F.hash(e), F.lit(3)) > 0, F.col("e_i")).otherwise(0.0))
           .withColumn("e_f", F.when(F.pmod(F.hash(e, F.lit(1)), F.lit(3)) > 0, F.col("energy") * 0.9).otherwise(0.0))
           .withColumn("length", F.col("length") * (1 + F.pmod(F.hash(e, F.lit(2)), F.lit(5)))))
    mixed = p.withColumn("x", F.col("x") + F.pmod(F.hash("event_id", "idx"), F.lit(1500))).withColumn("energy", F.col("energy") / 50.0)
    for tracks, particles, least in ((t, p, 0), (odd, mixed, 50), (odd.withColumn("e_f", F.lit(0.0)), mixed, 50)):
        fast = {r.event_id: (r.e_entry, r.e_exit) for r in truth.edge_energies_tables(tracks, particles).collect()}
        slow = {r.event_id: (r.e_entry, r.e_exit) for r in truth.edge_energies(tracks, particles).collect()}
        assert fast.keys() == slow.keys() and len(fast) > 100
        for k in fast:
            for a, b in zip(fast[k], slow[k]):
                assert a is b is None or a == pytest.approx(b, rel=1e-9, abs=1e-7), k
        assert sum(v[0] is not None for v in fast.values()) >= least


from hypothesis import given, settings, strategies as st  # noqa: E402


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-50, max_value=50, allow_nan=False), min_size=2, max_size=40),
       st.integers(min_value=1, max_value=12))
def test_uniform_bin_matches_numpy_histogram(spark, values, n):
    lo, hi = min(values), max(values)
    if hi - lo < 1e-6:
        return
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [0] * n
    for r in df.select(binning.uniform_bin(F.col("x"), lo, hi, n).alias("b")).collect():
        got[r.b] += 1
    ref, _ = np.histogram(values, bins=n, range=(lo, hi))
    # identical counts except where float rounding moves a value sitting on an edge
    assert sum(got) == len(values) == int(ref.sum())
    assert sum(abs(a - b) for a, b in zip(got, ref)) <= 2 * sum(
        1 for v in values for k in range(1, n) if abs(v - (lo + k * (hi - lo) / n)) < 1e-9 * max(1.0, abs(v)))


def test_write_scored_one_to_one(spark, tmp_path):
    from tracklake.sources.frames import write_scored
    df = spark.createDataFrame([(1, "/d/a/Level5.000001.i3.zst", 1.0, 2.0), (2, "/d/a/Level5.000002.i3.zst", 3.0, 4.0)],
                               "event_id long, source_file string, ace_prediction double, ace_truth double")
    write_scored(df, str(tmp_path / "o"), write_truth=False)
    back = spark.read.parquet(str(tmp_path / "o"))
    assert sorted(r.out_file for r in back.collect()) == ["wACE_Level5.000001.i3.zst", "wACE_Level5.000002.i3.zst"]
    assert "ace_truth" not in back.columns
    with pytest.raises(ValueError):
        write_scored(df, str(tmp_path / "p"), write_prediction=False, write_truth=False)


def test_degenerate_range_bins(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r.b for r in df.select(binning.uniform_bin(F.col("x"), 2.0, 2.0, 5).alias("b")).collect()] == [0, 0]


def test_exact_split_with_hot_duplicates(spark, monkeypatch):
    from tracklake.operators import running as rn
    monkeypatch.setattr(rn, "HOT_ROWS", 50)
    # one id copied 400 times next to 600 distinct ids
    df = spark.range(1, 601).withColumnRenamed("id", "event_id").unionByName(
        spark.range(400).select(F.lit(7).cast("bigint").alias("event_id")))
    s = {r.split: r.n for r in weights.exact_split(df).groupBy("split").agg(F.count("*").alias("n")).collect()}
    n = 1000
    nt = math.ceil(n / 10)
    ne = math.ceil((n - nt) * 2 / 10)
    assert s.get("test", 0) == nt and s.get("eval", 0) == ne and s.get("train", 0) == n - nt - ne


def test_sized_broadcast_falls_back_beyond_bound(spark):
    from tracklake.operators.common import sized_broadcast
    big = spark.range(5000).withColumnRenamed("id", "k")
    small = spark.range(10).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hinted = big.join(sized_broadcast(small, 100), "k")
        plain = big.join(sized_broadcast(big.select("k"), 100), "k")
        plan_h = hinted._jdf.queryExecution().executedPlan().toString()
        plan_p = plain._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan_h
    assert "BroadcastHashJoin" not in plan_p and "SortMergeJoin" in plan_p
    assert hinted.count() == 10 and plain.count() == 5000


def test_dfs_from_marked_primary(spark):
    # two roots: 1 (neutrino, not in ice) -> 3 (in-ice neutrino); 2 (primary) -> 4 (in-ice neutrino)
    rows = [(1, 1, None, 14, "Anywhere"), (1, 2, None, 13, "InIce"), (1, 3, 1, 14, "InIce"), (1, 4, 2, 12, "InIce")]
    p = spark.createDataFrame(rows, "event_id long, idx long, parent_idx long, pdg int, location_type string") \
        .withColumn("energy", F.lit(1.0))
    assert tree.interacting_neutrino(p, primary=F.col("idx") == 2).first().nu_idx == 4
    assert tree.interacting_neutrino(p, primary=F.col("idx") == 1).first().nu_idx == 3
    assert tree.interacting_neutrino(p).collect()[0].nu_idx == 3  # the first root alone


def test_several_roots_and_products_from_the_primary(spark, monkeypatch):
    """Interactions below two roots; neither path, lengths nor hot groups mix them up."""
    from tracklake.operators import running
    rows = []
    for e in range(1, 4):
        rows += [(e, 1, None, 13, "InIce", 1.0), (e, 2, None, 14, "Anywhere", 2.0), (e, 3, 1, 12, "InIce", 3.0),
                 (e, 4, 3, 11, "InIce", 4.0), (e, 5, 3, 99, "InIce", 5.0), (e, 6, 2, 14, "InIce", 6.0),
                 (e, 7, 6, 13, "InIce", 7.0), (e, 8, 6, 99, "InIce", 8.0)]
    rows += [(4, 1, None, 13, "InIce", 1.0), (4, 2, None, 14, "InIce", 2.0)]  # nothing below the first root
    p = spark.createDataFrame(rows, "event_id long, idx long, parent_idx long, pdg int, location_type string, energy double")
    for hot in (running.HOT_ROWS, 1):
        monkeypatch.setattr(running, "HOT_ROWS", hot)
        for primary, nu, lepton in ((None, 3, 4.0), (F.col("idx") == 2, 6, 7.0)):
            got = {r.event_id: (r.nu_idx, r.case_no, r.lepton_energy)
                   for r in tree.interaction_products(p, primary=primary).where("event_id < 4").collect()}
            assert got == {e: (nu, 1, lepton) for e in range(1, 4)}
        assert tree.interacting_neutrino(p).where("event_id = 4").count() == 0


def test_approx_quantiles_close_to_exact(spark):
    rng = np.random.default_rng(13)
    vals = rng.normal(size=5000)
    df = spark.createDataFrame([(0, float(v)) for v in vals], "g long, v double")
    q = quantiles.grouped_quantiles(df, ["g"], "v", [0.159, 0.5, 0.841], approx=True, accuracy=10000)
    for r in q.collect():
        assert abs(r.value - np.percentile(vals, r.prob * 100)) < 0.01
        assert r.n == 5000


def test_sigma_k2_keeps_the_upper_tail(spark):
    import math
    from statistics import NormalDist

    from tracklake.functions.stats import sigma_for_chisq_col
    values = [0.0, 0.5, 3.0, 5.0, 30.0, 74.3, 100.0, 1000.0, 1299.0, 1301.0, 2480.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.s for r in df.select(sigma_for_chisq_col("v", 2).alias("s")).collect()]
    assert all(a < b for a, b in zip(got, got[1:]))
    for v, s in zip(values, got):
        if v < 1300:
            assert abs(s + NormalDist().inv_cdf(math.exp(-v / 2) / 2)) < 1e-8
        else:  # the logarithm of the tail is that of exp(-v / 2) / 2
            log_tail = -s * s / 2 - math.log(s * math.sqrt(2 * math.pi)) + math.log(1 - s**-2 + 3 * s**-4)
            assert abs(log_tail + v / 2 + math.log(2)) < 1e-6


def test_unknown_sensor_is_an_error(spark):
    import pytest as pt

    from tracklake.operators.features import event_position
    hits = spark.createDataFrame([(1, 1), (1, 9)], "event_id long, dom_id long")
    geo = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "dom_id long, x double, y double, z double")
    with pt.raises(Exception, match="unknown sensor 9"):
        event_position(hits, geo).collect()
    from tracklake.operators.features import dom_positions
    for columns in (["event_id"], ["y"], ["dom_id", "r"]):  # also where x is not read
        with pt.raises(Exception, match="unknown sensor 9"):
            dom_positions(hits, geo).select(*columns).collect()
    with pt.raises(Exception, match="unknown sensor 9"):
        dom_positions(hits, geo).count()


def test_frames_of_listed_files_and_required_keys(spark, tmp_path):
    import pytest as pt

    from conftest import SMALL
    from pyspark.sql import functions as F
    from tracklake.sources import fixtures as fx
    from tracklake.sources import frames as fr
    nested = fr.nest_frames(fx.frames(spark, SMALL)).where("stop = 'Physics'").limit(6).coalesce(1)
    fr.write_table(nested, str(tmp_path / "a"), ())
    fr.write_table(nested.withColumn("event_id", F.col("event_id") + 10**9), str(tmp_path / "b"), ())
    name, = [p for p in (tmp_path / "b").iterdir() if p.name.endswith(".parquet")]
    (tmp_path / "b" / "other.txt").write_text("not a frame file")
    whole = fr.read_frames(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert whole.count() == 12 and whole.select("source_file").distinct().count() == 2
    assert fr.read_frames(spark, [str(tmp_path / "a"), str(name)]).count() == 12
    assert fr.read_frames(spark, [str(tmp_path / "b")], glob=name.name).count() == 6
    assert fr.flatten_nested(whole).select("E_exit", "OneWeight", "NEvent", "MCPrimaryCosZen").count() == 12

    def without(m, key):
        return fr.flatten_nested(nested.withColumn(m, F.map_filter(m, lambda k, v: k != key)))

    for m, key in (("scalars", "L5_rlogl"), ("weight_dict", "NEvents")):
        with pt.raises(Exception, match=f"has no {key}"):
            without(m, key).select("cog_x").collect()
    with pt.raises(Exception, match="has no primary"):
        fr.flatten_nested(nested.withColumn("primary", F.expr("CAST(NULL AS " + fr.FRAME_SCHEMA["primary"].dataType.simpleString() + ")"))).count()
    assert without("reco", fr.MUEX_KEY).where("E_muex IS NULL").count() == 6  # energies may be missing
    nan = fr.flatten_nested(nested.withColumn("scalars", F.transform_values("scalars", lambda k, v: F.lit(float("nan")))))
    assert nan.where("rlogl IS NULL AND nch IS NULL").count() == 6


def test_truth_of_an_event_has_one_source(spark):
    from conftest import SMALL
    from pyspark.sql import functions as F
    from tracklake.operators.features import flatten_features
    from tracklake.sources import fixtures as fx
    f = fx.frames(spark, SMALL).where("stop = 'Physics'").limit(3).withColumn("event_id", F.monotonically_increasing_id())
    f = f.withColumn("e_entry", F.when(F.col("event_id") != 1, 5.0)).withColumn("e_exit", F.when(F.col("event_id") != 2, 1.0))
    truth = spark.createDataFrame([(0, 8.0, 7.0), (1, 8.0, 7.0), (2, 8.0, None)], "event_id long, e_entry double, e_exit double")
    got = {r.event_id: (r.E_entry, r.E_exit) for r in flatten_features(f.coalesce(1), truth).collect()}
    assert got == {0: (5.0, 1.0), 1: (8.0, 7.0), 2: (8.0, None)}


def test_range_ignores_values_that_are_not_finite(spark):
    from pyspark.sql import functions as F

    from tracklake.operators.histograms import with_range_bin
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (float("inf"),)], "x double")
    bins = {r.x: r.bin for r in with_range_bin(df, F.col("x"), 2).filter("x < 10").collect()}
    assert bins[1.0] == 0 and bins[3.0] == 1


def test_rows_to_score_stay_whatever_their_features(spark):
    from tracklake.operators import boost
    rows = [(float(i), float(i), "train") for i in range(40)] + [(float("-inf"), 1.0, "test"), (None, 1.0, "test")]
    df = spark.createDataFrame(rows, "a double, label double, split string")
    res = boost.train(df, ["a"], "label", rounds=1, max_depth=2, subsample=1.0)
    assert res.predictions.filter("split = 'test' and log_e_predicted is not null").count() == 2


# ------------------------------------------------------------------ scans without a task for a whole curve
def test_ranked_within_groups_and_overall(spark):
    from tracklake.operators.ranks import ranked
    rng = np.random.default_rng(2)
    rows = [(None if g == 2 else int(g), float(v)) for g, v in zip(rng.integers(0, 3, 400), rng.permutation(400))]
    df = spark.createDataFrame(rows, "g long, v double")
    got = ranked(df, ["v"], ["g"]).collect()
    for g in (0, 1, None):
        mine = sorted((r.v, r.pos) for r in got if r.g == g)
        assert [p for _, p in mine] == list(range(len(mine)))
    assert sorted((r.v, r.n) for r in ranked(df, ["v"], (), "n").collect()) == [(float(i), i) for i in range(400)]
    assert ranked(df.where("v < 0"), ["v"], ["g"]).collect() == []


def test_cubic_spline_in_chunks_equals_the_dense_solve(spark):
    from tracklake.operators.solvers import not_a_knot_spline, spline_eval, spline_roots
    rng = np.random.default_rng(9)
    curves = {"even": np.linspace(0, 30, 700), "uneven": np.cumsum(rng.uniform(0.001, 0.3, 500)), "few": np.array([0.0, 1, 2, 3, 5])}
    ys = {k: np.sin(x) * 2 + 0.1 * x + 0.01 * rng.normal(size=len(x)) for k, x in curves.items()}
    rows = [(k, float(a), float(b)) for k, x in curves.items() for a, b in zip(x, ys[k])]
    df = spark.createDataFrame(rows + [("two", 0.0, 1.0), ("two", 1.0, 0.0)], "c string, x double, y double").repartition(5)
    for chunk in (40, scans.CHUNK):
        roots = scans.cubic_crossings(df, "c", "x", "y", 1.0, chunk=chunk).collect()
        fine = scans.clean_interp(df, "c", "x", "y", n=1000, chunk=chunk).collect()
        for k, x in curves.items():
            want = sorted(spline_roots(x, ys[k], 1.0))
            mine = sorted((r.n_cross, r.x_cross) for r in roots if r.c == k)
            assert [n for n, _ in mine] == list(range(len(want))) and [v for _, v in mine] == pytest.approx(want, abs=1e-9)
            curve = sorted((r.k, r.x, r.y) for r in fine if r.c == k)
            grid = np.linspace(x.min(), x.max(), 1000)
            assert [r[1] for r in curve] == pytest.approx(grid)
            assert [r[2] for r in curve] == pytest.approx(spline_eval(x, ys[k], not_a_knot_spline(x, ys[k]), grid), abs=1e-9)
        assert len([r for r in fine if r.c == "two"]) == 1000 and not [r for r in roots if r.c == "two"]


def test_surface_keeps_nodes_without_a_whole_cell(spark):
    points = [(float(a), float(b), float(a + 10 * b)) for a in range(3) for b in range(3)]
    whole = scans.llh_surface(spark.createDataFrame(points, "g double, n double, v double"), "g", "n", "v", 5, 5, 100.0).collect()
    assert len(whole) == 25 and all(r.ts == pytest.approx(r.g + 10 * r.n) for r in whole)
    part = spark.createDataFrame([p for p in points if p[:2] != (2.0, 2.0)], "g double, n double, v double")
    rows = {(r.gi, r.gj): r.ts for r in scans.llh_surface(part, "g", "n", "v", 5, 5, 100.0).collect()}
    assert len(rows) == 25 and {k for k, v in rows.items() if v is None} == {(i, j) for i in (2, 3, 4) for j in (2, 3, 4)}
    flat = spark.createDataFrame([(1.0, 1.0, 0.0), (1.0, 2.0, 0.0)], "g double, n double, v double")
    assert [r.ts for r in scans.llh_surface(flat, "g", "n", "v", 2, 2).collect()] == [None] * 4


def test_interpolation_keeps_points_without_a_segment(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 4.0, None), ("b", 2.0, 2.0)], "c string, x double, y double")
    rows = sorted(tuple(r) for r in scans.interp_linear(df, "c", "x", "y", 5).select("c", "k", "x", "y").collect())
    assert rows[:2] == [("a", 0, 0.0, 1.0), ("a", 1, 1.0, None)] and len(rows) == 10 and all(r[3] is None for r in rows[2:])


def test_local_maxima_are_those_of_both_neighbours(spark):
    ys = [1.0, 5.0, 1.0, 2.0, 2.1, 2.0, 9.0, 9.5, 3.0, 7.0]
    df = spark.createDataFrame([("s", i, y) for i, y in enumerate(ys)], "c string, pos long, y double")
    assert [r.pos for r in scans.local_maxima(df, "c", "y").collect()] == [1]
    assert sorted(r.pos for r in scans.local_maxima(df, "c", "y", 1.0).collect()) == [1, 4, 7]
    with pytest.raises(ValueError):
        scans.local_maxima(df, "c", "y", 0.9)


def test_dump_is_a_union_of_known_names(spark):
    from conftest import SMALL
    from tracklake.plans.extract import DUMP_VARIABLES, dump
    from tracklake.sources import fixtures as fx
    frames = fx.frames(spark, SMALL)
    assert dump(frames, ["dataset", "true_energy"]).columns == ["dataset", "true_energy"] + [v for v in DUMP_VARIABLES if v != "true_energy"]
    with pytest.raises(KeyError, match="no_such"):
        dump(frames, ["no_such"])


# ------------------------------------------------------------------ models and tables that are shared
def test_models_share_their_sums_until_they_part():
    grid = [boost.Params(6, 0.03, s, g, m, fold=k) for s in (0.8, 1.0) for g in (0.4, 0.5) for m in (8, 10) for k in range(2)]
    opened, nodes, live = [boost.Tree() for _ in grid], [[0] for _ in grid], list(range(len(grid)))
    alike = boost.groups_of(grid, live, [0] * len(grid), opened, nodes)
    assert sorted(len(g.models) for g in alike) == [4] * 4  # one set of sums a fold and sample
    assert sorted(k for g in alike for k in g.models) == live
    opened[0].split(0, 1, 0.5, 3, 1.0, (0.1, 0.2))
    nodes[0] = [1, 2]
    assert len(boost.groups_of(grid, live, [0] * len(grid), opened, nodes)) == 5
    assert len(boost.groups_of(grid, live, list(range(len(grid))), opened, nodes)) == len(grid)


def test_binned_nodes_equal_those_of_the_packed_forest():
    import numpy as np
    rng = np.random.default_rng(4)
    t = boost.Tree()
    left = t.split(0, 2, 0.0, 7, 1.0, (0.0, 0.0))
    t.split(left, 0, 0.0, 3, 1.0, (0.0, 0.0))
    t.depth = 2
    x = rng.integers(0, 12, (300, 3))
    want = boost.Packed([t], binned=True).nodes(x, np.zeros(1, np.int64))[:, 0]
    assert (boost._binned_nodes(t, np.ascontiguousarray(x.T.astype(np.uint8))) == want).all()


def test_rows_of_a_file_are_written_together(spark, tmp_path):
    import glob
    from tracklake.sources.frames import write_scored
    df = spark.range(4000).selectExpr("id AS event_id", "concat('/d/', id % 2, '/', id % 5, '.parquet') AS source_file",
                                      "1.0 AS ace_prediction", "2.0 AS ace_truth").repartition(8, "event_id")
    write_scored(df, str(tmp_path / "o"))
    assert len(glob.glob(str(tmp_path / "o" / "*" / "*" / "*.parquet"))) == 10
    assert spark.read.parquet(str(tmp_path / "o")).select("event_id").distinct().count() == 4000


def test_energies_at_read_the_tree_once_for_all_tables(spark):
    tree_rows = spark.createDataFrame([(1, 10, 2, 50.0, 181.0, 2.0, 243.0), (1, 11, 2, 100.0, 301.0, 2.0, 403.0)],
                                      "event_id long, idx long, parent_idx long, energy double, x double, y double, z double")
    t = _moved(spark, 1000.0, 1000.0, 900.0, 100.0, 100.0, 800.0)
    cps, losses = truth.loss_tables(t, tree_rows)
    lin = spark.createDataFrame([(1, w, L) for w, L in (("a", -5.0), ("b", 50.0), ("c", 400.0), ("d", 900.0), ("e", 1000.0), ("f", None))],
                                "event_id long, which string, L double")
    en = truth.energies_at(lin, t, cps, losses)
    for r in en.collect():
        want = _energy(_track(spark), r.L)
        assert (r.energy_at is None) == (want[0] is None) and (r.energy_at is None or abs(r.energy_at - want[0]) < 1e-9)
        assert r.failed == want[1]
    # the losses are stored, and the brackets come from one join
    assert losses._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    br = truth.bracket_table(lin, cps)._jdf.queryExecution().optimizedPlan().toString()
    assert br.count("Join") == cps._jdf.queryExecution().optimizedPlan().toString().count("Join") + 1


def test_only_features_of_scored_rows_go_to_python(spark):
    t = boost.Tree()
    t.split(0, 0, 1.5, 0, 1.0, (10.0, 20.0))
    t.depth = 1
    model = boost.BoostModel(["x"], 1.0, 0.5, "rmse", [t])
    # an interval has no form outside Spark: a pass of whole rows through Python fails
    df = spark.sql("SELECT id, CASE WHEN id < 3 THEN CAST(id AS int) END AS x, make_interval(0, 1, 0, 2) AS held FROM range(4)")
    got = model.transform(df)
    assert got.columns == ["id", "x", "held", "log_e_predicted"]
    assert [r[0] for r in got.orderBy("id").select("log_e_predicted").collect()] == [6.0, 6.0, 11.0, 11.0]
    assert boost.BoostModel([], 1.0, 0.5, "rmse").transform(df).select("log_e_predicted").distinct().collect()[0][0] == 1.0


def test_truth_from_sums_is_scalar_and_methods_stay_compiled(spark):
    tree_rows = spark.createDataFrame([(1, 1, None, 14, 0.0, 0.0, 0.0, 0.0), (1, 2, 1, 13, 0.0, 0.0, 0.0, 0.0), (1, 3, 2, 99, 50.0, 181.0, 2.0, 243.0)],
                                      "event_id long, idx long, parent_idx long, pdg int, energy double, x double, y double, z double")
    t = _moved(spark, 1000.0, 1000.0, 900.0, 100.0, 100.0, 800.0)
    t = t.withColumns({"track_no": F.lit(1), "particle_idx": F.lit(2).cast("long"), "zenith": F.lit(1.0), "azimuth": F.lit(1.0)})
    plan = truth.edge_energies_tables(t, tree_rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    # beyond this size the virtual machine interprets a method
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_scored_files_of_two_folders_are_written_in_one_pass(spark, tmp_path, monkeypatch):
    from tracklake.plans import training
    from tracklake.sources import frames as fr
    calls, write = [], fr.write_table
    monkeypatch.setattr(fr, "write_table", lambda *a, **k: (calls.append(1), write(*a, **k))[1])
    orders = spark.sql("SELECT id AS o_orderkey, id % 7 AS o_custkey, 'O' AS o_orderstatus, 100.0D + id AS o_totalprice FROM range(1, 40)")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    lines = "SELECT id AS l_orderkey, n AS l_linenumber, n AS l_partkey, n AS l_suppkey, 10.0D * n AS l_extendedprice, 1.0D * n AS l_quantity"
    spark.sql(f"{lines} FROM range(1, 40) CROSS JOIN (SELECT explode(sequence(1L, 4L)) AS n)").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = training.score_frames(spark, str(tmp_path)).collect()
    assert len(calls) == 1
    assert sorted((r.event_id, r.folder) for r in got) == [(k, "odd" if k % 2 else "even") for k in range(1, 40)]
    assert len({r.out_file for r in got if r.folder == "odd"} & {r.out_file for r in got if r.folder == "even"}) > 0


def test_truth_numbers_particles_once_and_frames_are_shuffled_flat(spark, monkeypatch):
    from tracklake.sources import fixtures as fx
    from tracklake.sources import frames as fr
    lines = [(e, n, n, n, 10.0 * n, 1.0 * n) for e in range(1, 30) for n in range(1, 6)]
    cols = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double"
    orders = spark.createDataFrame([(e, e % 7, "O", 100.0 + e) for e in range(1, 30)],
                                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    monkeypatch.setattr(fx, "table", lambda s, d, name: {"orders": orders, "lineitem": spark.createDataFrame(lines, cols)}[name])
    read = []
    for name in ("selected_with_cylinder", "track_losses"):
        monkeypatch.setattr(truth, name, lambda t, p, f=getattr(truth, name), **k: (read.append(p), f(t, p, **k))[1])
    tracks, particles = fx.tracks(spark, ""), fx.particles(spark, "")
    got = {r.event_id: (r.e_entry, r.e_exit) for r in truth.edge_energies_tables(tracks, particles).collect()}
    plans = [p._jdf.queryExecution().optimizedPlan().toString() for p in read]
    assert len(plans) >= 2 and not any("Window" in p for p in plans)
    want = {r.event_id: (r.e_entry, r.e_exit) for r in truth.edge_energies(tracks, particles).collect()}
    assert got.keys() == want.keys() and all(g == pytest.approx(w, nan_ok=True) if None not in g + w else g == w for e, w in want.items() for g in [got[e]])
    flat = fr.nest_frames(fx.frames(spark, ""), fx.dom_hits(spark, "", by_event=True))
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("map(") < plan.index("Join") and "map(" not in plan[plan.index("Join"):]
    assert {r.event_id: r.hit_doms for r in flat.collect()} == {e: [1, 2, 3, 4, 5] for e in range(1, 30)}
    assert fx.dom_hits(spark, "").exceptAll(fx.dom_hits(spark, "", by_event=True)).isEmpty()
