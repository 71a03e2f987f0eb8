"""Shards of equal row counts by balanced label propagation.

Documents start in shards dealt by row number.  In every round each linked
document asks for the shard that holds most of its group (ties by a fixed
order of the group's shards) among those with room, and a shard accepts as many
as its quota allows.  Unlinked documents are placed last and fill every shard
to its exact size, so counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stage, utf8

ROUNDS = 8


def numbered_within(staged: DataFrame, key: str, name: str) -> DataFrame:
    """Gapless numbers from 0 within each value of ``key`` (few values, any number of rows).

    Rows are numbered per task and value; the offsets are sums over one row for
    each task and value.
    """
    tagged = staged.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_mid", 33))
    counts = tagged.groupBy(F.col("_p").alias("_q"), F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_k").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_p", key).orderBy("_mid")) - 1
    ranked = tagged.withColumn("_local", local)
    return (ranked.join(offsets, (F.col("_p") == F.col("_q")) & (F.col(key) == F.col("_k")))
            .withColumn(name, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_mid", "_p", "_q", "_k", "_off", "_local"))


def _loads(state: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.countDistinct("rid").alias("n")).collect()}
    return [got.get(t, 0) for t in range(shards)]


def propagate(links: DataFrame, targets: list[int], rounds: int = ROUNDS) -> DataFrame:
    """rid, shard of the linked documents; ``links`` has rid and group_id, a document may be in several groups.

    Neighbours are counted as one row per group with a count for every shard, so
    a group of any size costs its rows, never its pairs.  What reaches the
    driver in a round is two numbers per shard.
    """
    shards = len(targets)
    state = stage(links.withColumn("shard", F.pmod("rid", F.lit(shards)).cast("int")), "labels")
    for turn in range(rounds):
        loads = _loads(state, shards)
        room = [max(t - n, 0) for t, n in zip(targets, loads)]
        # a row per group with one count per shard, added up over the groups of a document
        counts = [F.count_if(F.col("shard") == t).alias(f"n{t}") for t in range(shards)]
        votes = (state.join(state.groupBy("group_id").agg(*counts), "group_id").groupBy("rid", "shard")
                 .agg(F.min("group_id").alias("_first"), *(F.sum(f"n{t}").alias(f"n{t}") for t in range(shards))))
        cells = F.array(*(F.struct(F.col(f"n{t}").alias("n"), F.xxhash64("_first", F.lit(t)).alias("order"),
                                   F.lit(t).alias("to")) for t in range(shards)))
        open_to = [t for t in range(shards) if room[t]]
        able = F.filter(cells, lambda c: (c["n"] > 0) & (c["to"].isin(open_to) | (c["to"] == F.col("shard"))))
        wishes = stage(votes.select("rid", "shard", F.array_max(able)["to"].alias("to"))
                       .filter(F.col("to") != F.col("shard")).select("rid", "to"), "wishes")
        demand = {r["to"]: r["count"] for r in wishes.groupBy("to").count().collect()}
        if not demand:
            break
        share = F.array(*(F.lit(min(1.0, room[t] / demand[t]) if demand.get(t) else 0.0) for t in range(shards)))
        luck = F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        moves = wishes.filter(luck < F.get(share, F.col("to")))
        state = stage(state.join(moves, "rid", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "labels")
    return state.select("rid", "shard").distinct()


def shard_rows(rows: DataFrame, total: int, shards: int, group: str) -> DataFrame:
    """``rows`` (rid from 0 to total - 1) with shard and slot; rows with equal non-null ``group`` are linked."""
    targets = [total // shards + (t < total % shards) for t in range(shards)]
    sizes = rows.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    links = rows.join(sizes.filter("_n > 1"), F.col(group) == F.col("_g")).select("rid", F.col("_g").alias("group_id"))
    placed = stage(propagate(links, targets), "placed")
    # a shard that got more than its size gives the rest back
    fits = numbered_within(placed, "shard", "_place").filter(F.col("_place") < F.get(F.array(*map(F.lit, targets)), F.col("shard")))
    placed = stage(fits.select("rid", "shard"), "fits")
    loads = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    ends, last = [], 0
    for t in range(shards):
        last += targets[t] - loads.get(t, 0)
        ends.append(last)
    free, _ = numbered(stage(rows.join(placed, "rid", "left_anti"), "free"), "_free")
    # the k-th free row goes to the first shard whose open places are not used up
    shard = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("_free")))
    filled = rows.join(placed, "rid").unionByName(free.withColumn("shard", shard).drop("_free"))
    return numbered_within(stage(filled, "shards"), "shard", "slot")


def shard_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``.

    Size is the UTF-8 length plus 8 (null text: 8, checksum 0, in no group).
    Equal texts form a group.  Repeated rows are placed each on its own; other
    columns are not read.
    """
    body = utf8(F.col(text))
    base = stage(docs.select(F.col(doc_id).alias("doc_id"),
                             (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
                             F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"),
                             F.md5(body).alias("_group")), "shard-rows")
    rows, total = numbered(base)
    out = shard_rows(rows, total, shards, "_group")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                      "slot", F.lit(None).cast("int").alias("grown_shard"))
