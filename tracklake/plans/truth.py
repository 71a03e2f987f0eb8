"""Particle-tree and truth-energy queries.

The oracles are written relationally (recursive CTE, windows and joins over
exploded checkpoints), not with the array functions the Spark side uses, so
the two sides check each other.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import distance, intersect_cylinder
from ..operators import features as ft
from ..operators import tree as tr
from ..operators import truth as th
from ..operators.common import rounded
from ..session import reliable_checkpoint
from ..sources import fixtures as fx
from .catalog import oracle, query

# ----------------------------------------------------------------- SQL parts
RANKED_SQL = "SELECT *, row_number() OVER (PARTITION BY event_id, parent_idx ORDER BY idx) AS rnk FROM particles"
DFS_SQL = ("SELECT event_id, idx, pdg, location_type, energy, CAST([] AS INTEGER[]) AS path FROM ranked "
           "WHERE parent_idx IS NULL AND rnk = 1 UNION ALL SELECT c.event_id, c.idx, c.pdg, c.location_type, c.energy, "
           "list_append(r.path, CAST(-c.rnk AS INTEGER)) FROM ranked c JOIN r ON c.event_id = r.event_id "
           "AND c.parent_idx = r.idx")
NU_SQL = ("SELECT event_id, min_by(idx, path) AS nu_idx, min_by(pdg, path) AS nu_pdg, min_by(energy, path) AS nu_energy "
          "FROM r WHERE abs(pdg) IN (12, 14, 16) AND location_type = 'InIce' GROUP BY event_id")
NU_CTES = [("ranked", RANKED_SQL), ("r", DFS_SQL), ("nu", NU_SQL)]

NUMU_SQL = ("SELECT t.* FROM tracks t JOIN particles p ON p.event_id = t.event_id AND p.idx = t.particle_idx "
            "JOIN particles q ON q.event_id = p.event_id AND q.idx = p.parent_idx WHERE q.pdg IN (14, -14)")
TR_SQL = ("SELECT * FROM (SELECT n.*, d.n_daughters, row_number() OVER (PARTITION BY n.event_id ORDER BY n.track_no) AS rn "
          "FROM (" + NUMU_SQL + ") n JOIN (SELECT event_id, parent_idx AS pidx, count(*) AS n_daughters FROM particles "
          "WHERE parent_idx IS NOT NULL GROUP BY event_id, parent_idx) d ON d.event_id = n.event_id "
          "AND d.pidx = n.particle_idx) z WHERE rn = 1")


def cyl_sql(src: str) -> str:
    first = ("CASE WHEN NOT (d > 0) THEN NULL WHEN costh = 0 THEN CASE WHEN abs(oz) < 800.0 THEN r0 END "
             "WHEN sinth = 0 THEN CASE WHEN sqrt(ox * ox + oy * oy) < 800.0 THEN h0 END "
             "WHEN NOT (hmin >= rmax OR hmax <= rmin) THEN greatest(rmin, hmin) END")
    second = ("CASE WHEN NOT (d > 0) THEN NULL WHEN costh = 0 THEN CASE WHEN abs(oz) < 800.0 THEN r1 END "
              "WHEN sinth = 0 THEN CASE WHEN sqrt(ox * ox + oy * oy) < 800.0 THEN h1 END "
              "WHEN NOT (hmin >= rmax OR hmax <= rmin) THEN least(rmax, hmax) END")
    return (
        f"SELECT *, {first} AS first, {second} AS second FROM ("
        "SELECT *, least(h0, h1) AS hmin, greatest(h0, h1) AS hmax, least(r0, r1) AS rmin, greatest(r0, r1) AS rmax FROM ("
        "SELECT *, CASE WHEN costh <> 0 THEN (oz - 800.0) / costh END AS h0, "
        "CASE WHEN costh <> 0 THEN (oz + 800.0) / costh END AS h1, "
        "CASE WHEN sinth <> 0 THEN (b - sqrt(CASE WHEN d > 0 THEN d END)) / sinth END AS r0, "
        "CASE WHEN sinth <> 0 THEN (b + sqrt(CASE WHEN d > 0 THEN d END)) / sinth END AS r1 FROM ("
        "SELECT *, b * b + 640000.0 - ox * ox - oy * oy AS d FROM ("
        "SELECT *, ox * cos(azimuth) + oy * sin(azimuth) AS b FROM ("
        f"SELECT *, x - 31.25 AS ox, y - 19.64 AS oy, z - 0.0 AS oz, sin(zenith) AS sinth, cos(zenith) AS costh "
        f"FROM {src}) a1) a2) a3) a4) a5")


def distance_sql(a: str, b: str, edge: str = "") -> str:
    return "sqrt(" + " + ".join(f"({a}.{c}{edge} - {b}.{c}) * ({a}.{c}{edge} - {b}.{c})" for c in "xyz") + ")"


D_I_SQL, D_F_SQL = distance_sql("tr", "tr", "_i"), distance_sql("tr", "tr", "_f")
DL_SQL = ("SELECT p.event_id, row_number() OVER (PARTITION BY p.event_id ORDER BY p.idx) AS j, p.idx, "
          + distance_sql("p", "tr") + " AS dist, " + distance_sql("p", "tr") + " AS len, sum(p.energy) OVER (PARTITION BY p.event_id ORDER BY p.idx ROWS BETWEEN UNBOUNDED PRECEDING "
          "AND CURRENT ROW) AS e FROM particles p JOIN tr ON p.event_id = tr.event_id AND p.parent_idx = tr.particle_idx")
NL_SQL = "SELECT event_id, count(*) AS nd FROM dl GROUP BY event_id"
LOSSES_SQL = (
    "SELECT event_id, 0 AS j, cast(0 AS double) AS len, cast(0 AS double) AS e FROM tr "
    "UNION ALL SELECT event_id, j, len, e FROM dl "
    "UNION ALL SELECT tr.event_id, nl.nd + 1, " + D_F_SQL + ", cast(0 AS double) FROM tr JOIN nl ON tr.event_id = nl.event_id "
    "WHERE tr.e_f > 0 "
    "UNION ALL SELECT tr.event_id, nl.nd + 1 + CASE WHEN tr.e_f > 0 THEN 1 ELSE 0 END, tr.length, cast(0 AS double) "
    "FROM tr JOIN nl ON tr.event_id = nl.event_id")
CPS_SQL = (
    "SELECT event_id, 0 AS k, cast(0 AS double) AS len, energy AS e, 0 AS off FROM tr "
    "UNION ALL SELECT event_id, 1, " + D_I_SQL + ", e_i, 1 FROM tr WHERE e_i > 0 "
    "UNION ALL SELECT tr.event_id, CASE WHEN tr.e_i > 0 THEN 2 ELSE 1 END, " + D_F_SQL + ", tr.e_f, nl.nd + 1 "
    "FROM tr JOIN nl ON tr.event_id = nl.event_id WHERE tr.e_f > 0 "
    "UNION ALL SELECT tr.event_id, 1 + CASE WHEN tr.e_i > 0 THEN 1 ELSE 0 END + CASE WHEN tr.e_f > 0 THEN 1 ELSE 0 END, "
    "tr.length, cast(0 AS double), nl.nd + 1 + CASE WHEN tr.e_f > 0 THEN 1 ELSE 0 END "
    "FROM tr JOIN nl ON tr.event_id = nl.event_id")
TRACK_CTES = [("tr", TR_SQL), ("dl", DL_SQL), ("nl", NL_SQL), ("losses", LOSSES_SQL), ("cps", CPS_SQL),
              ("cyl", cyl_sql("tr"))]

# lengths to evaluate: lin(event_id, which, L)
EVAL_CTES = [
    ("fi", "SELECT l.event_id, l.which, l.L, min(c.k) AS i FROM lin l JOIN cps c ON c.event_id = l.event_id "
           "AND c.len >= l.L GROUP BY l.event_id, l.which, l.L"),
    ("br", "SELECT f.event_id, f.which, f.L, cb.len AS len_b, cb.e AS e_b, cb.off AS off_b, ca.len AS len_a, "
           "ca.e AS e_a, ca.off AS off_a, CASE WHEN cb.off > 0 THEN cb.off - 1 ELSE 0 END AS l1 FROM fi f "
           "JOIN cps cb ON cb.event_id = f.event_id AND cb.k = greatest(f.i - 1, 0) "
           "JOIN cps ca ON ca.event_id = f.event_id AND ca.k = greatest(f.i - 1, 0) + 1"),
    ("fj", "SELECT b.*, (SELECT min(x.j) FROM losses x WHERE x.event_id = b.event_id AND x.j BETWEEN b.l1 "
           "AND b.off_a AND x.len >= b.L) AS jj FROM br b"),
    ("ev", "SELECT f.*, ls.len AS ls_len, ls.e AS ls_e, lr.e AS lr_e FROM fj f JOIN losses ls "
           "ON ls.event_id = f.event_id AND ls.j = CASE WHEN f.jj IS NULL THEN f.l1 ELSE greatest(f.jj - 1, f.l1) END "
           "JOIN losses lr ON lr.event_id = f.event_id AND lr.j = f.off_a - 1"),
    ("en", "SELECT l.event_id, l.which, l.L, "
           "CASE WHEN l.L IS NULL THEN NULL WHEN l.L >= t.length THEN 0.0 WHEN l.L <= 0 THEN t.energy "
           "WHEN ev.ls_e > ev.e_b THEN NULL ELSE ev.e_b - ev.ls_e - (CASE WHEN ev.len_a <> ev.len_b THEN "
           "(ev.e_b - ev.e_a - ev.lr_e) / (ev.len_a - ev.len_b) END) * (l.L - ev.len_b) END AS energy_at, "
           "(l.L IS NULL OR (l.L > 0 AND l.L < t.length AND ev.ls_e > ev.e_b)) AS failed "
           "FROM lin l JOIN tr t ON t.event_id = l.event_id LEFT JOIN ev ON ev.event_id = l.event_id "
           "AND ev.which = l.which"),
]
EDGE_LIN = ("SELECT event_id, 'entry' AS which, first AS L FROM cyl UNION ALL "
            "SELECT event_id, 'exit' AS which, second AS L FROM cyl")
EDGES_SQL = ("SELECT a.event_id, CASE WHEN a.failed OR b.failed THEN NULL ELSE a.energy_at END AS e_entry, "
             "CASE WHEN a.failed OR b.failed THEN NULL ELSE b.energy_at END AS e_exit FROM en a JOIN en b "
             "ON a.event_id = b.event_id AND a.which = 'entry' AND b.which = 'exit'")
EDGE_CTES = TRACK_CTES + [("lin", EDGE_LIN)] + EVAL_CTES + [("edges", EDGES_SQL)]


def _parts(spark, sf):
    """(particles, tracks) fixtures."""
    return fx.particles(spark, sf), fx.tracks(spark, sf)


# ----------------------------------------------------------------- J4 / J5 / J8
@query("interacting_neutrino", oracle("SELECT * FROM nu", ["particles"], ["nu_energy"], ["event_id", "nu_idx", "nu_pdg"],
                                      ctes=NU_CTES, recursive=True))
def interacting_neutrino(spark, sf):
    p, _ = _parts(spark, sf)
    return rounded(tr.interacting_neutrino(p))


@query("daughters", oracle(
    "SELECT p.event_id, nu.nu_idx AS parent, p.idx, p.pdg, p.energy FROM particles p JOIN nu "
    "ON p.event_id = nu.event_id AND p.parent_idx = nu.nu_idx", ["particles"], ["energy"],
    ["event_id", "parent", "idx", "pdg"], ctes=NU_CTES, recursive=True))
def daughters(spark, sf):
    p, _ = _parts(spark, sf)
    d = tr.daughters(p, tr.interacting_neutrino(p))
    return rounded(d.select("event_id", "parent", "idx", "pdg", "energy"))


PRODUCTS_SQL = (
    "SELECT nu.event_id, nu.nu_idx, c.n_children, "
    "CASE WHEN c.n_children = 2 THEN CASE WHEN c.n_had = 1 AND c.lep_idx IS NOT NULL THEN 1 "
    "WHEN c.lep_idx IS NULL AND c.nuo_idx IS NULL THEN 2 WHEN c.n_had = 0 AND c.nuo_idx IS NOT NULL THEN 3 "
    "WHEN c.n_had = 1 AND c.nuo_idx IS NOT NULL THEN 4 END END AS case_no, c.lep_idx, c.lep_e, c.n_had, c.nuo_idx "
    "FROM nu LEFT JOIN (SELECT p.event_id, count(*) AS n_children, count(*) FILTER (WHERE p.pdg = 99) AS n_had, "
    "max(p.idx) FILTER (WHERE p.pdg <> 99 AND abs(p.pdg) NOT IN (12, 14, 16)) AS lep_idx, "
    "arg_max(p.energy, p.idx) FILTER (WHERE p.pdg <> 99 AND abs(p.pdg) NOT IN (12, 14, 16)) AS lep_e, "
    "max(p.idx) FILTER (WHERE p.pdg <> 99 AND abs(p.pdg) IN (12, 14, 16)) AS nuo_idx "
    "FROM particles p JOIN nu ON p.event_id = nu.event_id AND p.parent_idx = nu.nu_idx GROUP BY p.event_id) c "
    "ON c.event_id = nu.event_id")
PRODUCTS_OUT = ("SELECT event_id, nu_idx, cast(n_children AS double) AS n_children, cast(case_no AS double) AS case_no, "
                "cast(CASE WHEN case_no IS NOT NULL THEN lep_idx END AS double) AS lepton_idx, "
                "CASE WHEN case_no IS NOT NULL THEN lep_e END AS lepton_energy, "
                "cast(CASE WHEN case_no IS NOT NULL THEN n_had END AS double) AS n_hadrons, "
                "cast(CASE WHEN case_no IS NOT NULL THEN nuo_idx END AS double) AS nu_out_idx FROM (" + PRODUCTS_SQL + ") z")


@query("interaction_products", oracle(PRODUCTS_OUT, ["particles"],
                                      ["lepton_energy", "n_children", "case_no", "lepton_idx", "n_hadrons",
                                       "nu_out_idx"], ["event_id", "nu_idx"], ctes=NU_CTES, recursive=True))
def interaction_products(spark, sf):
    """J8; nullable counts and indices are DOUBLE so NULLs hash alike in both engines."""
    p, _ = _parts(spark, sf)
    out = tr.interaction_products(p)
    return rounded(out.select("event_id", "nu_idx", *[F.col(c).cast("double").alias(c) for c in
                              ("n_children", "case_no", "lepton_idx", "lepton_energy", "n_hadrons", "nu_out_idx")]))


# ----------------------------------------------------------------- J6 / J7 / W6
@query("numu_tracks", oracle(NUMU_SQL, ["particles", "tracks"], [], ["event_id", "track_no", "particle_idx"]))
def numu_tracks(spark, sf):
    p, t = _parts(spark, sf)
    return tr.numu_tracks(t, p).select("event_id", "track_no", "particle_idx")


@query("orphan_tracks", oracle(
    "SELECT t.event_id, t.track_no FROM tracks t WHERE NOT EXISTS (SELECT 1 FROM particles p "
    "WHERE p.event_id = t.event_id AND p.idx = t.particle_idx)", ["particles", "tracks"], [], ["event_id", "track_no"]))
def orphan_tracks(spark, sf):
    p, t = _parts(spark, sf)
    return tr.orphan_tracks(t, p).select("event_id", "track_no")


@query("first_numu_track", oracle(TR_SQL, ["particles", "tracks"], [],
                                  ["event_id", "track_no", "particle_idx", "n_daughters"]))
def first_numu_track(spark, sf):
    p, t = _parts(spark, sf)
    return tr.first_numu_track(t, p).select("event_id", "track_no", "particle_idx",
                                            F.col("n_daughters").cast("bigint").alias("n_daughters"))


# ----------------------------------------------------------------- W1 / T2
@query("cumulative_losses", oracle("SELECT event_id, idx, dist, e AS elost FROM dl", ["particles", "tracks"],
                                   ["dist", "elost"], ["event_id", "idx"], ctes=TRACK_CTES[:2]))
def cumulative_losses(spark, sf):
    """Running loss sum in tree order (range-partitioned, skew-safe)."""
    p, t = _parts(spark, sf)
    sel = reliable_checkpoint(tr.first_numu_track(t, p))  # read by every table below
    return rounded(th.cumulative_losses(sel, p).select("event_id", "idx", "dist", "elost"))


@query("checkpoints", oracle("SELECT event_id, cast(k AS bigint) AS k, len, e, cast(off AS bigint) AS off FROM cps",
                             ["particles", "tracks"], ["len", "e"], ["event_id", "k", "off"], ctes=TRACK_CTES[:5]))
def checkpoints(spark, sf):
    """Checkpoints (start, entry, exit, end) with their loss offsets, as rows."""
    p, t = _parts(spark, sf)
    sel = reliable_checkpoint(tr.first_numu_track(t, p))  # read by every table below
    cps, _ = th.loss_tables(sel, p)
    return rounded(cps.select("event_id", "k", "len", "e", "off"))


# ----------------------------------------------------------------- T1 / T4
@query("cylinder_intersection", oracle("SELECT event_id, first, second FROM (" + cyl_sql("tracks") + ") c",
                                       ["tracks"], ["first", "second"], ["event_id"]))
def cylinder_intersection(spark, sf):
    t = fx.tracks(spark, sf)
    ix = intersect_cylinder("x", "y", "z", "zenith", "azimuth")
    return rounded(t.select("event_id", ix.alias("ix")).select("event_id", "ix.first", "ix.second"))


@query("track_distance", oracle(
    "SELECT t.event_id, h.dom_id, sqrt((g.x - t.x) * (g.x - t.x) + (g.y - t.y) * (g.y - t.y) + "
    "(g.z - t.z) * (g.z - t.z)) AS distance FROM tracks t JOIN dom_hits h ON h.event_id = t.event_id "
    "JOIN dom_geometry g ON g.dom_id = h.dom_id", ["tracks", "dom_hits", "dom_geometry"], ["distance"],
    ["event_id", "dom_id"]))
def track_distance(spark, sf):
    t = fx.tracks(spark, sf).select("event_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    hits = ft.dom_positions(fx.dom_hits(spark, sf), fx.dom_geometry(spark, sf))
    j = hits.join(t, "event_id")
    return rounded(j.select("event_id", "dom_id", distance("x", "y", "z", "tx", "ty", "tz").alias("distance")))


# ----------------------------------------------------------------- J9 / J10 / T3
BRACKET_LIN = ("SELECT event_id, 'entry' AS which, first AS L FROM cyl WHERE first IS NOT NULL UNION ALL "
               "SELECT event_id, 'exit' AS which, second AS L FROM cyl WHERE second IS NOT NULL")


def _edge_lin(sel):
    """Lengths at which the track enters and leaves the cylinder."""
    edge = lambda which, c: sel.where(F.col(c).isNotNull()).select("event_id", F.lit(which).alias("which"), F.col(c).alias("L"))
    return edge("entry", "first").unionByName(edge("exit", "second"))


@query("checkpoint_bracket", oracle(
    "SELECT event_id, which, len_b AS len_before, e_b AS e_before, len_a AS len_after, e_a AS e_after FROM br",
    ["particles", "tracks"], ["len_before", "e_before", "len_after", "e_after"], ["event_id", "which"],
    ctes=TRACK_CTES + [("lin", BRACKET_LIN)] + EVAL_CTES[:2]))
def checkpoint_bracket(spark, sf):
    """Checkpoints around the cylinder entry and exit (first with len >= L and the one before)."""
    p, t = _parts(spark, sf)
    sel = th.selected_with_cylinder(t, p)
    cps, _ = th.loss_tables(sel, p)
    br = th.bracket_table(_edge_lin(sel), cps)
    return rounded(br.select("event_id", "which", F.col("len_b").alias("len_before"), F.col("e_b").alias("e_before"),
                             F.col("len_a").alias("len_after"), F.col("e_a").alias("e_after")))


@query("last_loss_before", oracle(
    "SELECT event_id, which, ls_len, ls_e FROM ev", ["particles", "tracks"], ["ls_len", "ls_e"], ["event_id", "which"],
    ctes=TRACK_CTES + [("lin", BRACKET_LIN)] + EVAL_CTES[:4]))
def last_loss_before(spark, sf):
    """The last cumulative loss before the cylinder entry and exit (as-of lookup)."""
    p, t = _parts(spark, sf)
    sel = th.selected_with_cylinder(t, p)
    cps, losses = th.loss_tables(sel, p)
    ev = th.last_loss_table(th.bracket_table(_edge_lin(sel), cps), losses)
    return rounded(ev.select("event_id", "which", "ls_len", "ls_e"))


AT_LIN = ("SELECT event_id, 'at300' AS which, cast(300 AS double) AS L FROM tr UNION ALL "
          "SELECT event_id, 'mid' AS which, length / 2.0 AS L FROM tr UNION ALL "
          "SELECT event_id, 'before' AS which, cast(-1 AS double) AS L FROM tr")


@query("energy_at_length", oracle(
    "SELECT a.event_id, a.energy_at AS e_at300, b.energy_at AS e_mid, c.energy_at AS e_before FROM en a "
    "JOIN en b ON a.event_id = b.event_id AND b.which = 'mid' JOIN en c ON a.event_id = c.event_id "
    "AND c.which = 'before' WHERE a.which = 'at300'", ["particles", "tracks"], ["e_at300", "e_mid", "e_before"],
    ["event_id"], ctes=TRACK_CTES + [("lin", AT_LIN)] + EVAL_CTES, digits=4))
def energy_at_length(spark, sf):
    """Energy at 300 m, at half the track length and before the start."""
    p, t = _parts(spark, sf)
    sel = reliable_checkpoint(tr.first_numu_track(t, p))  # read by every table below
    cps, losses = th.loss_tables(sel, p)
    lin = sel.select("event_id", F.lit("at300").alias("which"), F.lit(300.0).alias("L")).unionByName(
        sel.select("event_id", F.lit("mid").alias("which"), (F.col("length") / 2.0).alias("L"))).unionByName(
        sel.select("event_id", F.lit("before").alias("which"), F.lit(-1.0).alias("L")))
    en = th.energies_at(lin, sel, cps, losses)
    piv = en.groupBy("event_id").agg(*[F.max(F.when(F.col("which") == w, F.col("energy_at"))).alias(n)
                                       for w, n in (("at300", "e_at300"), ("mid", "e_mid"), ("before", "e_before"))])
    return rounded(piv, 4)


# ----------------------------------------------------------------- T5 / T6 / T7 / P11
@query("edge_energies", oracle("SELECT * FROM edges", ["particles", "tracks"], ["e_entry", "e_exit"], ["event_id"],
                               ctes=EDGE_CTES, digits=4), headline=True)
def edge_energies(spark, sf):
    """T5: energies where the selected muon enters and leaves the detector volume."""
    p, t = _parts(spark, sf)
    return rounded(th.edge_energies_tables(t, p), 4)


@query("muon_energies", oracle(
    "SELECT f.event_id, e.e_entry, e.e_exit, pr.lepton_energy AS e_interaction FROM frames f "
    "LEFT JOIN edges e ON e.event_id = f.event_id LEFT JOIN (" + PRODUCTS_OUT + ") pr ON pr.event_id = f.event_id "
    "WHERE f.stop = 'Physics'", ["frames", "particles", "tracks"], ["e_entry", "e_exit", "e_interaction"],
    ["event_id"], ctes=NU_CTES + EDGE_CTES, recursive=True, digits=4))
def muon_energies(spark, sf):
    p, t = _parts(spark, sf)
    return rounded(th.muon_energies(fx.frames(spark, sf), t, p), 4)


@query("truth_column", oracle(
    "SELECT f.event_id, e.e_entry AS ace_truth FROM frames f LEFT JOIN edges e ON e.event_id = f.event_id "
    "WHERE f.stop = 'Physics'", ["frames", "particles", "tracks"], ["ace_truth"], ["event_id"],
    ctes=EDGE_CTES, digits=4))
def truth_column(spark, sf):
    p, t = _parts(spark, sf)
    return rounded(th.truth_column(fx.frames(spark, sf), t, p), 4)


@query("truth_source", oracle(
    "SELECT f.event_id, CASE WHEN f.e_entry IS NULL OR f.e_exit IS NULL THEN e.e_entry ELSE f.e_entry END AS E_entry, "
    "CASE WHEN f.e_entry IS NULL OR f.e_exit IS NULL THEN e.e_exit ELSE f.e_exit END AS E_exit FROM frames f "
    "LEFT JOIN edges e ON e.event_id = f.event_id WHERE f.stop = 'Physics'", ["frames", "particles", "tracks"],
    ["E_entry", "E_exit"], ["event_id"], ctes=EDGE_CTES, digits=4))
def truth_source(spark, sf):
    """Both stored truth keys of an event, or both its computed edge energies."""
    p, t = _parts(spark, sf)
    feats = ft.flatten_features(fx.frames(spark, sf), truth=th.edge_energies_tables(t, p))
    return rounded(feats.select("event_id", "E_entry", "E_exit"), 4)
