"""Particle-tree traversal as joins over the adjacency list.

The tree of every event is an adjacency list ``particles(event_id, idx,
parent_idx, pdg, location_type, energy, ...)``; child order is ``idx``.

Depth-first search with a LIFO stack (last child first) visits nodes in the
ascending lexicographic order of their *path*: the array of negated ``idx``
from the start down to the node, a prefix before its extensions, which is
exactly how Spark orders arrays.  The first match of a search is therefore
``min_by(node, path)`` over the matching nodes.  Paths are found from below:
only nodes that have children can lie between a match and the start, and their
links upwards double in length with every join, so a tree of depth d takes
log2(d) joins of that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

# Particle type codes.  |12|, |14|, |16| are neutrinos; 14 / -14
# are the muon neutrino and antineutrino.  99 stands in for the hadron
# cascade type in the fixture data.
NEUTRINO_PDGS = (12, 14, 16, -12, -14, -16)
NUMU_PDGS = (14, -14)
HADRONS_PDG = 99
IN_ICE = "InIce"


def is_neutrino(pdg: Column) -> Column:
    return F.abs(pdg).isin(12, 14, 16)


def start_nodes(particles: DataFrame, primary: Column | None = None) -> DataFrame:
    """(event_id, start): the first particle of each event that ``primary`` marks, by default its first root."""
    marked = F.col("parent_idx").isNull() if primary is None else F.coalesce(primary, F.lit(False))
    return particles.where(marked).groupBy("event_id").agg(F.min("idx").alias("start"))


def inner_paths(particles: DataFrame, starts: DataFrame) -> DataFrame:
    """(event_id, idx, path) of every node with children that is its event's start or below it.

    Every node links to its parent; each round joins the links with themselves, which
    doubles how far they reach, until all end at a start or at a root.  A link that has
    become longer than its event has nodes runs in a circle and is given up.  The
    links of a round are written to the checkpoint folder, leaves never are.  A path is as long as its node is deep.
    """
    nodes = particles.select("event_id", "idx", "parent_idx")
    parents = nodes.where(F.col("parent_idx").isNotNull()).select("event_id", F.col("parent_idx").alias("idx")).distinct()
    inner = nodes.join(parents, ["event_id", "idx"], "left_semi")
    sizes = parents.groupBy("event_id").agg(F.count("*").alias("nodes"))
    here = F.col("idx") == F.col("start")
    links = reliable_checkpoint(inner.join(starts.join(sizes, "event_id"), "event_id").select(
        "event_id", "idx", "nodes", here.alias("found"), F.when(~here, F.col("parent_idx")).alias("up"),
        F.when(here, F.array().cast("array<bigint>")).otherwise(F.array(-F.col("idx"))).alias("path")))
    while not links.where(F.col("up").isNotNull()).isEmpty():
        above = links.select("event_id", F.col("idx").alias("up"), F.col("found").alias("_found"), F.col("up").alias("_up"),
                             F.col("path").alias("_path"))
        path = F.concat(F.coalesce("_path", F.array().cast("array<bigint>")), "path")
        links = reliable_checkpoint(links.join(above, ["event_id", "up"], "left").select(
            "event_id", "idx", "nodes", (F.col("found") | F.coalesce("_found", F.lit(False))).alias("found"),
            F.when(F.size(path) <= F.col("nodes"), F.col("_up")).alias("up"), path.alias("path")))
    return links.where("found").select("event_id", "idx", "path")


def interacting_neutrino(particles: DataFrame, primary: Column | None = None) -> DataFrame:
    """Per event the first in-ice neutrino in DFS order from the primary.

    ``primary`` marks the start particle (a column of ``particles``, the first by ``idx``
    where it marks several); by default it is the event's first root.  Other roots
    of the event and what is below them are not searched.  Events where none exists get no row.
    """
    match = is_neutrino(F.col("pdg")) & (F.col("location_type") == IN_ICE)
    nu = F.struct("idx", "pdg", "energy")
    starts = start_nodes(particles, primary)
    found = particles.where(match)
    at_start = found.join(starts, "event_id").where(F.col("idx") == F.col("start")).select(
        "event_id", nu.alias("nu"), F.array().cast("array<bigint>").alias("path"))
    # of siblings the last one is met first
    last = found.where(F.col("parent_idx").isNotNull()).groupBy("event_id", F.col("parent_idx").alias("idx")).agg(F.max(nu).alias("nu"))
    below = last.join(inner_paths(particles, starts), ["event_id", "idx"]).select(
        "event_id", "nu", F.concat("path", F.array(-F.col("nu.idx"))).alias("path"))
    return at_start.unionByName(below).groupBy("event_id").agg(F.min_by("nu", "path").alias("nu")).select(
        "event_id", F.col("nu.idx").alias("nu_idx"), F.col("nu.pdg").alias("nu_pdg"), F.col("nu.energy").alias("nu_energy"))


def daughters(particles: DataFrame, nodes: DataFrame, node_col: str = "nu_idx") -> DataFrame:
    """Children of the given (event_id, node) rows, in child order."""
    n = nodes.select(F.col("event_id").alias("_ev"), F.col(node_col).alias("_node"))
    return particles.join(n, (particles["event_id"] == n["_ev"]) & (particles["parent_idx"] == n["_node"])) \
        .select(particles["*"], F.col("_node").alias("parent"))


def interaction_products(particles: DataFrame, neutrinos: DataFrame | None = None, primary: Column | None = None) -> DataFrame:
    """Classify the two children of the interacting neutrino.

    case 1: one hadron + lepton; 2: no lepton and no outgoing neutrino;
    3: no hadron + outgoing neutrino; 4: one hadron + outgoing neutrino;
    anything else, or a child count other than two: all NULL.
    Lepton / outgoing neutrino are the last such child in child order.  The neutrino
    is that of ``interacting_neutrino`` from ``primary``, where none are given.
    """
    nu = neutrinos if neutrinos is not None else interacting_neutrino(particles, primary)
    ch = daughters(particles, nu)
    had = F.col("pdg") == HADRONS_PDG
    neu = ~had & is_neutrino(F.col("pdg"))
    lep = ~had & ~neu
    agg = ch.groupBy("event_id").agg(
        F.count("*").alias("n_children"),
        F.count_if(had).alias("n_hadrons"),
        F.max(F.when(lep, F.struct("idx", "pdg", "energy"))).alias("lepton"),
        F.max(F.when(neu, F.struct("idx", "pdg", "energy"))).alias("nu_out"),
    )
    j = nu.join(agg, "event_id", "left")
    two = F.col("n_children") == 2
    has_lep, has_nu = F.col("lepton").isNotNull(), F.col("nu_out").isNotNull()
    nh = F.col("n_hadrons")
    case = (F.when(~two | F.col("n_children").isNull(), F.lit(None))
            .when((nh == 1) & has_lep, 1)
            .when(~has_lep & ~has_nu, 2)
            .when((nh == 0) & has_nu, 3)
            .when((nh == 1) & has_nu, 4)).cast("int")
    ok = case.isNotNull()
    return j.select(
        "event_id", "nu_idx", F.col("n_children").cast("bigint").alias("n_children"), case.alias("case_no"),
        F.when(ok, F.col("lepton.idx")).alias("lepton_idx"),
        F.when(ok, F.col("lepton.energy")).alias("lepton_energy"),
        F.when(ok, nh).cast("bigint").alias("n_hadrons"),
        F.when(ok, F.col("nu_out.idx")).alias("nu_out_idx"),
    )


def numu_tracks(tracks: DataFrame, particles: DataFrame) -> DataFrame:
    """Tracks whose parent particle is a muon (anti)neutrino."""
    node = particles.select("event_id", F.col("idx").alias("particle_idx"), "parent_idx")
    par = particles.where(F.col("pdg").isin(*NUMU_PDGS)).select("event_id", F.col("idx").alias("parent_idx"))
    keys = node.join(par, ["event_id", "parent_idx"], "left_semi").select("event_id", "particle_idx")
    return tracks.join(keys, ["event_id", "particle_idx"], "left_semi")


def orphan_tracks(tracks: DataFrame, particles: DataFrame) -> DataFrame:
    """Tracks whose particle is not in the tree (the reference raises)."""
    node = particles.select("event_id", F.col("idx").alias("particle_idx"))
    return tracks.join(node, ["event_id", "particle_idx"], "left_anti")


def first_numu_track(tracks: DataFrame, particles: DataFrame) -> DataFrame:
    """Per event the first track (track_no order) with a muon-neutrino
    parent and at least one daughter; returns the track row plus n_daughters."""
    t = numu_tracks(tracks, particles)
    nd = particles.where(F.col("parent_idx").isNotNull()).groupBy("event_id", F.col("parent_idx").alias("particle_idx")) \
        .agg(F.count("*").alias("n_daughters"))
    t = t.join(nd, ["event_id", "particle_idx"], "inner")
    cols = [c for c in t.columns if c != "event_id"]
    best = t.groupBy("event_id").agg(F.min_by(F.struct(*cols), F.col("track_no")).alias("_t"))
    return best.select("event_id", "_t.*")
