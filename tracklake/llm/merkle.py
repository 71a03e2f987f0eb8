"""Merkle manifest of a dataset: a content-addressed DAG of runs of 16, and proofs by descent.

Rows are leaves in groups.  Within a group, leaves stand in order; every run of
``FANOUT`` consecutive nodes becomes the hash of its joined digests until one
is left, the group's root.  The roots of the groups, in order of the group's
name, are the leaves of one more such tree.  What is kept is a record per
digest with the digests of its children, so equal subtrees are one record.

A leaf is requested by its place.  Requests descend from the root: at every
level the records are looked up by digest, the digits of the places in base 16
say which children are wanted, and the other children are collected.  A node is
descended into once for all requests below it.  The segments collected, in
reverse, are the proof from the leaf to the root.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, stage

FANOUT, DIGIT_BITS = 16, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest_of(values: list) -> F.Column:
    """Hash of a row: every value as its length in bytes, a colon and the value; a null is ``-``."""
    said = [F.col(v).cast("string") if isinstance(v, str) else v.cast("string") for v in values]
    parts = [F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in said]
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def ranked(df: DataFrame, order: list[str], name: str, label: str) -> DataFrame:
    """Gapless numbers from 0 in the given order, nulls first.

    Rows are dealt by ranges of ``order``, numbered in their task and stored; the
    offsets of the tasks are one number a task.
    """
    spark = df.sparkSession
    placed = stage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("place", F.monotonically_increasing_id()), label)
    part = F.shiftright("place", 33)
    offsets, total = [], 0
    for p, n in sorted((r["p"], r["count"]) for r in placed.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    within = F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.join(starts, part == F.col("part")).withColumn(name, F.col("before") + within).drop("place", "part", "before")


def _next_level(nodes: DataFrame) -> DataFrame:
    """A record for every run of FANOUT nodes (grp, n, at, digest): its digest and its children in order."""
    runs = nodes.groupBy("grp", "n", F.shiftright("at", DIGIT_BITS).alias("at")).agg(
        F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("held"))
    children = F.col("held")["digest"]
    return runs.select("grp", "n", "at", F.sha2(F.array_join(children, ""), 256).alias("digest"), children.alias("children"))


def _tree(leaves: DataFrame, largest: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Records of the levels from the bottom, and the root of every group (grp, n, height, digest)."""
    nodes, levels, roots, width = leaves.select("grp", "n", "at", "digest"), [], None, 1
    while True:
        done = nodes.filter(F.col("n") <= width).select("grp", "n", F.lit(len(levels)).alias("height"), "digest")
        roots = done if roots is None else roots.unionByName(done)
        if largest <= width:
            return levels, stage(roots, f"{name}-roots")
        records = stage(_next_level(nodes.filter(F.col("n") > width)), f"{name}-level")
        levels.append(records)
        nodes, width = records.drop("children"), width * FANOUT


@dataclass
class Manifest:
    """leaves: grp, n, at, digest and what the caller keeps with them; levels and top: records from the bottom;
    groups: grp, its root and height, and its place among the groups."""
    leaves: DataFrame
    levels: list[DataFrame] = field(default_factory=list)
    top: list[DataFrame] = field(default_factory=list)
    groups: DataFrame | None = None
    root: str | None = None

    def store(self) -> DataFrame:
        """The content-addressed records: digest, children; every digest once."""
        records = None
        for level in [*self.levels, *self.top]:
            part = level.select("digest", "children")
            records = part if records is None else records.unionByName(part)
        return records.dropDuplicates(["digest"]) if records is not None else None


def build(rows: DataFrame) -> Manifest:
    """The manifest of rows (grp_name, key, digest, and columns to keep with the leaf).

    Leaves of a group stand by key (null first), equal keys by digest; rows that
    are equal in both are leaves of their own, side by side.  Groups stand by
    name, null first.  No rows: no root.
    """
    salted = stage(rows.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    placed = ranked(salted, ["grp_name", "key", "digest", "salt"], "global_at", "ranked").drop("salt")
    sizes = placed.groupBy("grp_name").agg(F.min("global_at").alias("first"), F.count("*").alias("n"))
    groups = stage(ranked(sizes, ["grp_name"], "grp", "groups"), "group-list")
    largest = groups.agg(F.max("n"), F.count("*")).first()
    if not largest[1]:
        return Manifest(placed)
    named = placed.withColumnRenamed("grp_name", "own_name")
    leaves = named.join(groups, F.col("own_name").eqNullSafe(F.col("grp_name")))
    leaves = stage(leaves.withColumn("at", F.col("global_at") - F.col("first"))
                   .drop("own_name", "grp_name", "global_at", "first", "key"), "placed")
    levels, roots = _tree(leaves, largest[0], "group")
    heads = roots.select(F.lit(0).cast("long").alias("grp"), F.lit(largest[1]).cast("long").alias("n"),
                         F.col("grp").alias("at"), "digest")
    top, root = _tree(heads, largest[1], "top")
    return Manifest(leaves, levels, top, roots, root.first()["digest"])


def _joined(children: F.Column, start, length) -> F.Column:
    return F.array_join(F.slice(children, start, length), "")


def _segment(digit: F.Column) -> F.Column:
    """The children of a record left and right of the one that is descended into."""
    children, place = F.col("children"), digit.cast("int")
    return F.struct(_joined(children, F.lit(1), place).alias("left"),
                    _joined(children, place + 2, F.greatest(F.size(children) - place - 1, F.lit(0))).alias("right"))


def _descend(frontier: DataFrame, records: DataFrame, wanted: DataFrame) -> DataFrame:
    """One level down: the wanted children of the frontier's nodes with one more segment each.

    ``frontier``: grp, at, digest, path, group_root; ``wanted``: grp, at of the
    children to descend into, and ``asked``, at most FANOUT a parent.
    """
    by_parent = wanted.withColumn("parent", F.shiftright("at", DIGIT_BITS)).groupBy("grp", "parent").agg(
        F.collect_list(F.struct("at", "asked")).alias("below"))
    store = records.select("digest", "children").dropDuplicates(["digest"])
    held = frontier.join(by_parent.withColumnRenamed("parent", "at"), ["grp", "at"]).join(store, "digest")
    each = held.select("grp", "path", "group_root", "children", F.explode("below").alias("child"))
    digit = F.col("child.at").bitwiseAND(FANOUT - 1)
    return each.select("grp", F.col("child.at").alias("at"), F.col("child.asked").alias("asked"), "group_root",
                       F.element_at("children", (digit + 1).cast("int")).alias("digest"),
                       F.concat(F.array(_segment(digit)), F.col("path")).alias("path"))


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """grp, at, asked, digest (the leaf), group_root, path of every requested leaf.

    ``requests``: grp, at (each place once), asked (what the caller wants back
    with it, any type).  ``path`` has (left, right) from the leaf to the root.
    """
    asked_type = requests.schema["asked"].dataType
    nothing = F.lit(None).cast("int").alias("asked")

    def above(rows: DataFrame, levels: int) -> DataFrame:
        at = F.shiftright("at", DIGIT_BITS * levels).alias("at")
        return rows.select("grp", at).distinct().select("grp", "at", nothing)

    # the tree of the groups' roots
    own_groups = requests.select("grp").distinct()
    heads = own_groups.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("at"))
    spark = requests.sparkSession
    empty_path = F.lit([]).cast("array<struct<left:string,right:string>>")
    frontier = spark.createDataFrame([(0, 0, manifest.root)], "grp long, at long, digest string")
    frontier = frontier.withColumn("path", empty_path).withColumn("group_root", F.lit(None).cast("string"))
    for level in reversed(range(len(manifest.top))):
        frontier = _descend(frontier, manifest.top[level], above(heads, level)).drop("asked")
    tops = frontier.select(F.col("at").alias("grp"), "digest", "path")
    starts = stage(tops.join(manifest.groups.select("grp", "n", "height"), "grp")
                   .select("grp", F.lit(0).cast("long").alias("at"), "digest", "path", F.col("digest").alias("group_root"),
                           "n", "height"), "descent")
    sized = requests.join(manifest.groups.select("grp", "height"), "grp")
    cols = ["grp", "at", "digest", "path", "group_root"]
    frontier = None
    for level in reversed(range(len(manifest.levels))):
        here = starts.filter(F.col("height") == level + 1).select(cols)
        frontier = here if frontier is None else frontier.unionByName(here)
        of_level = sized.filter(F.col("height") > level)
        wanted = of_level.select("grp", "at", "asked") if level == 0 else above(of_level, level)
        frontier = _descend(frontier, manifest.levels[level], wanted)
        if level:
            frontier = stage(frontier.select(cols), "descent")
    lone = starts.filter("height = 0").join(requests, ["grp", "at"]).select(
        "grp", "at", F.col("asked").cast(asked_type).alias("asked"), "group_root", "digest", "path")
    return lone if frontier is None else frontier.unionByName(lone)


def folded(leaf, path="path") -> F.Column:
    """The root that a leaf and the siblings of a path lead to."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(path="path") -> F.Column:
    """Hash of the siblings of a path, from the leaf to the root and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def document_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``documents``.

    A group is a source.  A row whose crc32(doc_id) is divisible by 5 is checked
    with its text's A-Z lower-cased, so it verifies only if it has none.  Rows
    with a null id have no crc32 and are checked as they are.  Equal rows are
    leaves side by side; other columns are not read.  No rows give no rows.
    """
    changed = crc_of_id() % 5 == 0
    lowered = F.when(changed, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    other = digest_of([lowered if f == "text" else f for f in FIELDS])
    rows = docs.select(F.col("source").alias("grp_name"), F.col("doc_id").alias("key"), digest_of(list(FIELDS)).alias("digest"),
                       F.when(F.coalesce(changed, F.lit(False)), other).alias("other"), "doc_id")
    manifest = build(rows)
    if manifest.root is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, "
                                                     "proof_sha256 string, folded_root string, verified boolean")
    proofs = prove(manifest, manifest.leaves.select("grp", "at", F.struct("doc_id", "other").alias("asked")))
    found = proofs.select(F.col("asked.doc_id").alias("doc_id"), F.col("digest").alias("leaf"),
                          F.col("group_root").alias("subroot"), F.lit(manifest.root).alias("root"),
                          proof_digest().alias("proof_sha256"),
                          folded(F.coalesce("asked.other", "digest")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 6, top_levels: int = 4) -> str:
    """DuckDB text for up to 16^levels documents a source and 16^top_levels sources."""
    def leaf(text: str) -> str:
        values = ["doc_id", "source", "lang", "n_chars", text]
        return "sha256(" + " || ".join(
            f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END" for v in values) + ")"

    crc = ("list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform("
           "string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1)))), "
           "lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1)))")
    lowered = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    out = [f"""leaf0 AS (
      SELECT doc_id, source, {leaf('text')} AS leaf,
             CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(lowered)} END AS other
      FROM documents)""", """p0 AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i0,
             count(*) OVER (PARTITION BY source) AS c0, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g
      FROM leaf0)""", "n0 AS (SELECT g, i0 AS i, leaf AS d, c0 AS c FROM p0)"]

    def grow(pre: str, k: int) -> str:
        return f"""{pre}{k + 1} AS (
      SELECT g, i // 16 AS i, any_value(c + 15) // 16 AS c,
             CASE WHEN any_value(c) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d
      FROM {pre}{k} GROUP BY g, i // 16)"""

    out += [grow("n", k) for k in range(levels)]
    out.append(f"sub AS (SELECT g, d, count(*) OVER () AS c FROM n{levels})")
    out.append("t0 AS (SELECT 0 AS g, g AS i, d, c FROM sub)")
    out += [grow("t", k) for k in range(top_levels)]

    def path(pre: str, k: int) -> str:
        """Siblings left and right of every node of a level; none where one node remains."""
        w = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
        return f"""{pre}p{k} AS (
      SELECT g, i, CASE WHEN c > 1 THEN coalesce(string_agg(d, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l,
             CASE WHEN c > 1 THEN coalesce(string_agg(d, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r
      FROM {pre}{k})"""

    steps = [("n", k) for k in range(levels)] + [("t", k) for k in range(top_levels)]
    out += [path(pre, k) for pre, k in steps]
    last = "f0 AS (SELECT doc_id, g, i0, leaf, '' AS proof, coalesce(other, leaf) AS acc FROM p0)"
    out.append(last)
    for s, (pre, k) in enumerate(steps):
        on = f"p.g = f.g AND p.i = f.i0 // {16 ** k}" if pre == "n" else f"p.i = f.g // {16 ** k}"
        out.append(f"""f{s + 1} AS (
      SELECT f.doc_id, f.g, f.i0, f.leaf, CASE WHEN p.l IS NULL THEN f.proof ELSE f.proof || p.l || p.r END AS proof,
             CASE WHEN p.l IS NULL THEN f.acc ELSE sha256(p.l || f.acc || p.r) END AS acc
      FROM f{s} f JOIN {pre}p{k} p ON {on})""")
    return "WITH " + ",\n    ".join(out) + f"""
    SELECT f.doc_id, f.leaf, sub.d AS subroot, root.d AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root,
           f.acc = root.d AS verified
    FROM f{len(steps)} f JOIN sub ON sub.g = f.g CROSS JOIN t{top_levels} root"""
