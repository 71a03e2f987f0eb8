"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by a pseudo-rotation (three rounds of random signs
and a fast Hadamard transform) and files them under the nearest signed axis.  A
query looks into the buckets of its nearest axes in every table; what it finds
is ranked by exact inner products.

Tables hold directions, so a long vector can be among the best of a query that
it is at a wide angle to.  Vectors have a range of lengths, and the k-th score a
query has found in the tables says at what angle vectors of a range could still
be better.  Where that angle is wider than tables find surely, the query meets
all vectors of the range; where it found too few rows, those of all ranges.

Equal vectors are one class, so a vector that a third of the rows share is
filed once.  Buckets are cut into blocks of bounded size on both sides, and a
pair of blocks is one matrix product in one task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, with_columns_from

TABLES, PROBES = 10, 12
BLOCK = 4096
RATIO = 1.1  # longest over shortest vector of a range of lengths
ANGLE = 1.6  # tables answer for cosines from this many standard deviations of random directions


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@lru_cache(maxsize=4)
def _signs(dim: int, tables: int, seed: int = 2) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, 3, dim))


def signed_axes(x: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """(rows, tables, probes): the nearest signed axes, nearest first; axis 2 k is +k, 2 k + 1 is -k."""
    dim = max(2, 1 << (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), dim))
    padded[:, :x.shape[1]] = x
    out = np.empty((len(x), tables, min(probes, 2 * dim)), dtype=np.int32)
    for t, rounds in enumerate(_signs(dim, tables)):
        y = padded
        for s in rounds:
            y = hadamard(y * s)
        near = np.stack([y, -y], axis=2).reshape(len(x), 2 * dim)
        out[:, t] = np.argsort(-near, axis=1, kind="stable")[:, :out.shape[2]]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def log_length(x: np.ndarray) -> np.ndarray:
    """Logarithms of the lengths of the rows, of numbers of any size."""
    most = np.abs(x).max(axis=1)
    return np.log(most) + np.log(np.linalg.norm(x / most[:, None], axis=1))


def _matrix(cells) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype="<f8").reshape(len(cells), -1)


def _top(scores: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, ties to the smaller first id."""
    if scores.shape[1] > 4 * k:
        # all columns that reach the k-th largest score, then in order
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
        rows, cols = np.nonzero(scores >= kth)
    else:
        rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
    order = np.lexsort((first[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return np.stack([rows[rank < k], cols[rank < k]])


def search(vectors: DataFrame, is_query, k: int = 20, tables: int = TABLES, probes: int = PROBES,
           row_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows found with the largest inner product for
    every row that fulfils ``is_query`` (a column), without the row itself; ties go to the smaller id.

    Vectors that are null, zero, hold a null or non-finite component or have not
    the commonest length take no part, nor do null ids.  Rows equal in id and
    vector count once.  A query has fewer than ``k`` rows only if there are no more
    candidates.  Other columns are not read.
    """
    e = F.col(embedding)
    ok = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    valid = vectors.filter(F.col(row_id).isNotNull() & ok).select(
        F.col(row_id).cast("long").alias("vec_id"), e.cast("array<double>").alias("v"), is_query.alias("asked"))
    sizes = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    valid = valid.filter(F.size("v") == (sizes["d"] if sizes else 0))
    as_bytes = lambda v: {"vec": [(np.array(x, dtype="<f8") + 0.0).tobytes() for x in v]}  # noqa: E731  -0.0 becomes 0.0
    rows = stage(with_columns_from(valid, ["v"], as_bytes, "vec binary", drop=("v",))
                 .withColumn("c", F.unhex(F.md5("vec"))).distinct(), "vectors")
    kinds = rows.groupBy("c").agg(F.min("vec_id").alias("first"), F.first("vec").alias("vec"), F.max("asked").alias("asked"))
    lengths = lambda v: {"length": log_length(_matrix(v)) if v else []}
    range_of = F.floor(F.col("length") / np.log(RATIO) + 0.5).cast("int")  # length 1 is inside a range
    kinds = stage(with_columns_from(kinds, ["vec"], lengths, "length double").withColumn("range", range_of), "classes")
    # of equal vectors only the k + 1 smallest ids can be among k neighbours
    small = rows.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    members = small.groupBy("c").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    asked = kinds.filter("asked").select("c", "vec")
    scored = stage(_scored(_filed(kinds.select("c", "first", "vec"), tables, 1), _filed(asked, tables, probes), k), "scored")
    visits = stage(_visits(kinds, _lists(scored, members, k), k, min(rows.count(), k + 1), sizes["d"] if sizes else 1), "visits")
    if visits.head(1):
        whole = stage(kinds.select("c", "first", "vec", F.lit(-1).alias("t"), F.col("range").alias("axis")), "ranges")
        scored = _best(scored.unionByName(_scored(whole, visits, k)))
    found = _lists(scored, members, k)
    queries = rows.filter("asked").select(F.col("vec_id").alias("query_id"), F.col("c").alias("q"))
    own = queries.join(found, "q").select("query_id", F.posexplode(F.slice(
        F.filter("all", lambda x: x["i"] != F.col("query_id")), 1, k)).alias("n", "x"))
    return own.select("query_id", (F.col("n") + 1).alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _visits(kinds: DataFrame, found: DataFrame, k: int, total: int, dim: int) -> DataFrame:
    """c, vec, t, axis: the ranges (``axis``) of which a query class has to meet all vectors.

    A vector of range r is at most RATIO ** (r + 0.5) long.  To beat the score s of the row k + 1
    (the query is one of these rows) it needs a cosine of s / (length of the query * that).
    """
    ends = kinds.agg(F.min("range").alias("lo"), F.max("range").alias("hi")).first()
    lo, hi = (ends["lo"], ends["hi"]) if ends["lo"] is not None else (0, 0)
    least = ANGLE / np.sqrt(dim)
    n = F.coalesce(F.size("all"), F.lit(0))
    score = -F.element_at("all", k + 1)["s"]
    step = (F.log(score) - F.log(F.lit(least)) - F.col("length")) / np.log(RATIO) - 0.5
    # ranges above step; infinite scores, which numbers cannot tell apart, have none
    start = (F.when(n < total, F.lit(lo)).when(n <= k, F.lit(hi + 1)).when(score <= 0, F.lit(lo))
             .otherwise(F.least(F.greatest(F.floor(step) + 1, F.lit(lo)), F.lit(hi + 1)).cast("int")))
    wanted = (kinds.filter("asked").join(found.withColumnRenamed("q", "c"), "c", "left")
              .select("c", "vec", start.alias("start")).filter(F.col("start") <= hi)
              .select("c", "vec", F.explode(F.sequence("start", F.lit(hi))).alias("axis")))
    # as many ranges as lengths that numbers can have, at most
    there = kinds.select(F.col("range").alias("axis")).distinct()
    return wanted.join(there, "axis", "left_semi").withColumn("t", F.lit(-1))


def _scored(stored: DataFrame, sought: DataFrame, k: int) -> DataFrame:
    """q, c, score, first: the k + 1 best stored classes of every pair of blocks that share a bucket."""
    stored, sought = _blocks(stored, sought), _blocks(sought, stored)
    stored = stored.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)))
    sought = sought.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)))
    left = sought.select("t", "axis", F.col("block").alias("qb"), F.col("other").alias("cb"), "c", "vec")
    right = stored.select("t", "axis", F.col("other").alias("qb"), F.col("block").alias("cb"), "c", "first", "vec")

    def rank(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame({"q": [], "c": [], "first": [], "score": []})
        scores = _matrix(q["vec"]) @ _matrix(s["vec"]).T
        first = s["first"].to_numpy()
        r, c = _top(scores, first, k + 1)
        return pd.DataFrame({"q": q["c"].to_numpy()[r], "c": s["c"].to_numpy()[c], "first": first[c], "score": scores[r, c]})

    key = ["t", "axis", "qb", "cb"]
    found = (left.groupBy(*key).cogroup(right.groupBy(*key))
             .applyInPandas(rank, "q binary, c binary, first long, score double"))
    return _best(found)


def _best(found: DataFrame) -> DataFrame:
    """A class found in several tables once; it has the same score but for rounding."""
    return found.groupBy("q", "c").agg(F.max("score").alias("score"), F.first("first").alias("first"))


def _lists(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """q, all: the rows of the k + 1 best classes of each query class, best first."""
    best = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    near = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    ids = near.join(members, "c").select("q", F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("i"))).alias("part"))
    return ids.groupBy("q").agg(F.sort_array(F.flatten(F.collect_list("part"))).alias("all"))


def _filed(kinds: DataFrame, tables: int, probes: int) -> DataFrame:
    """A row for every table and axis a vector is filed (or sought) under."""

    def axes(vecs: list) -> dict[str, list]:
        if not vecs:
            return {"axes": []}
        a = signed_axes(unit(_matrix(vecs)), tables, probes)
        return {"axes": a.reshape(len(a), -1).tolist()}

    per = F.posexplode("axes").alias("n", "axis")
    out = with_columns_from(kinds, ["vec"], axes, "axes array<int>")
    width = F.size("axes") / tables
    return stage(out.select(*kinds.columns, width.cast("int").alias("width"), per)
                 .withColumn("t", (F.col("n") / F.col("width")).cast("int")).drop("n", "width"), "axes")


def _blocks(side: DataFrame, other: DataFrame) -> DataFrame:
    """``side`` with its block in the bucket and the number of blocks of the other side.
    The counts have a row for each table and axis, whatever the input."""
    count = lambda df, name: df.groupBy("t", "axis").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    counts = count(side, "n_own").join(count(other, "n_other"), ["t", "axis"])
    return (side.join(F.broadcast(counts), ["t", "axis"])
            .withColumn("block", F.pmod(F.xxhash64("c"), F.col("n_own")).cast("int")))
