"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

A chromosome is a set of bins.  Crossover injects whole well-filled bins of
one parent into the other, removes the bins that hold a duplicate, and
best-fits the displaced documents.  Pieces are dealt at random into blocks of
bounded size; every block is evolved by several islands, which pass their best
solution on to the next island between epochs.  Bins that are not full after
that are pooled over all blocks and packed again.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, numbered, rows_from, stage
from .words import word_bpe

BLOCK_PIECES = 4096
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 3, 2, 6, 8
ISLANDS_A_TASK, MOST_TASKS = 16, 20_000
BINS_BITS = 20  # a block has far fewer bins than 2^20


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, doc_id: str = "doc_id",
                 text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of the token ids of whole texts, each followed by ``end_id``.

    Only documents longer than ``capacity`` are cut; the last piece may be
    shorter.  Null texts count as empty (one piece, the end id).
    """
    schema = f"doc_id long, piece int, start long, length long, ids_crc32 long{', ids binary' * keep_ids}"

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        bpe, end, step = word_bpe(tokenizer), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for b in batches:
            rows = [(d, k // step, k // 4, ids[k:k + step]) for d, t in zip(b["doc_id"], b["text"])
                    for ids in [bpe.encode(t or "") + end] for k in range(0, len(ids), step)]
            yield {"doc_id": [r[0] for r in rows], "piece": [r[1] for r in rows], "start": [r[2] for r in rows],
                   "length": [len(r[3]) // 4 for r in rows], "ids_crc32": [zlib.crc32(r[3]) for r in rows],
                   "ids": [r[3] for r in rows]}

    return rows_from(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), cut, schema, TEXTS)


class Bins:
    """Bins under construction, with the free room sorted for best fit."""

    def __init__(self, lengths, capacity):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.free: list[tuple[int, int]] = []  # (room, bin), ascending

    def add(self, bin_items: list[int]) -> None:
        self.items.append(bin_items)
        room = self.capacity - sum(self.lengths[i] for i in bin_items)
        if room:
            insort(self.free, (room, len(self.items) - 1))

    def best_fit(self, item: int) -> None:
        size = self.lengths[item]
        at = bisect_left(self.free, (size, -1))
        if at == len(self.free):
            self.add([item])
            return
        room, b = self.free.pop(at)
        self.items[b].append(item)
        if room > size:
            insort(self.free, (room - size, b))


def _filled(lengths, bins, capacity) -> float:
    """Mean of the squared fill: prefers few bins, and full ones among equals."""
    return sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(len(bins), 1)


def _fit(lengths, order, capacity, start=()) -> list[list[int]]:
    bins = Bins(lengths, capacity)
    for b in start:
        bins.add(list(b))
    for i in order:
        bins.best_fit(i)
    return bins.items


def _crossover(lengths, a, b, capacity, rng) -> list[list[int]]:
    ranked = sorted(b, key=lambda x: -sum(lengths[i] for i in x))
    injected = [x for x in ranked[:max(1, len(b) // 2)] if rng.random() < 0.5] or ranked[:1]
    taken = {i for x in injected for i in x}
    kept = [x for x in a if taken.isdisjoint(x)]
    displaced = [i for x in a if not taken.isdisjoint(x) for i in x if i not in taken]
    # mutation: the emptiest bins are dissolved too
    kept.sort(key=lambda x: sum(lengths[i] for i in x))
    gone = rng.randint(1, 3)
    displaced += [i for x in kept[:gone] for i in x]
    displaced.sort(key=lambda i: -lengths[i])
    return _fit(lengths, displaced, capacity, injected + kept[gone:])


def evolve(lengths: list[int], capacity: int, seed: int, start: list[list[list[int]]]) -> list[list[int]]:
    """Best solution of one island after an epoch; ends early when no fewer bins are possible."""
    rng = random.Random(seed)
    least = ceil(sum(lengths) / capacity)
    down = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = [(len(s), -_filled(lengths, s, capacity), s) for s in [*start, _fit(lengths, down, capacity)]]
    people.sort(key=lambda p: p[:2])
    if people[0][0] <= least:
        return people[0][2]
    while len(people) < POPULATION:
        loose = sorted(down, key=lambda i: -lengths[i] * rng.uniform(0.7, 1.0))
        s = _fit(lengths, loose, capacity)
        people.append((len(s), -_filled(lengths, s, capacity), s))
    for _ in range(GENERATIONS):
        people.sort(key=lambda p: p[:2])
        if people[0][0] <= least:
            break
        a, b = sorted(rng.sample(range(POPULATION), 2))
        child = _crossover(lengths, people[a][2], people[b][2], capacity, rng)
        people[-1] = (len(child), -_filled(lengths, child, capacity), child)
    return min(people, key=lambda p: p[:2])[2]


def _bins_of(numbers: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(numbers):
        bins.setdefault(b, []).append(i)
    return list(bins.values())


def _numbers_of(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, items in enumerate(bins):
        for i in items:
            out[i] = k
    return out


def _solve(items: DataFrame, capacity: int, name: str) -> tuple[DataFrame, int]:
    """rid, sequence_id, offset, room for ``items`` (rid, length), and the number of blocks."""
    n = items.count()
    blocks = max(1, ceil(n / BLOCK_PIECES))
    # a block is dealt by hash, so it holds about BLOCK_PIECES pieces at any input size
    dealt = (items.groupBy(F.pmod(F.xxhash64("rid"), F.lit(blocks)).alias("block"))
             .agg(F.sort_array(F.collect_list(F.struct("length", "rid"))).alias("members")))
    state = stage(dealt.select("block", F.col("members.length").alias("lengths"), F.col("members.rid").alias("rids")),
                  f"{name}-blocks")
    # islands are small rows with much work: the number of tasks follows their count, not their bytes
    tasks = min(ceil(blocks * ISLANDS / ISLANDS_A_TASK), MOST_TASKS)
    islands = state.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    elites = None
    for epoch in range(EPOCHS):
        if elites is None:
            todo = islands.withColumn("starts", F.expr("cast(array() as array<array<int>>)"))
        else:
            near = elites.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"),
                                 F.col("solution").alias("migrant"))
            todo = (elites.join(near, ["block", "island"])
                    .select("block", "island", "lengths", "rids", F.array("solution", "migrant").alias("starts")))

        def run(batches, epoch=epoch):
            for b in batches:
                for k, lengths in enumerate(b["lengths"]):
                    seed = (b["block"][k] * ISLANDS + b["island"][k]) * EPOCHS + epoch
                    best = evolve(lengths, capacity, seed, [_bins_of(s) for s in b["starts"][k]])
                    yield {"block": [b["block"][k]], "island": [b["island"][k]], "lengths": [lengths],
                           "rids": [b["rids"][k]], "solution": [_numbers_of(best, len(lengths))], "bins": [len(best)],
                           "fill": [_filled(lengths, best, capacity)]}

        spread = todo.repartition(tasks, "block", "island")
        elites = stage(rows_from(spread, run, "block long, island int, lengths array<bigint>, rids array<bigint>, "
                                 "solution array<int>, bins int, fill double"), f"{name}-epoch")
    best = elites.groupBy("block").agg(F.min_by(F.struct("lengths", "rids", "solution"),
                                                F.struct("bins", -F.col("fill"), "island")).alias("s"))

    def place(batches):
        for b in batches:
            for block, s in zip(b["block"], b["s"]):
                rows = []
                for k, items in enumerate(_bins_of(s["solution"])):
                    at = 0
                    for i in items:
                        rows.append((s["rids"][i], (block << BINS_BITS) + k, at, s["lengths"][i]))
                        at += s["lengths"][i]
                    rows[-len(items):] = [(*r, capacity - at) for r in rows[-len(items):]]
                yield dict(zip(("rid", "sequence_id", "offset", "length", "room"), map(list, zip(*rows))))

    return rows_from(best, place, "rid long, sequence_id long, offset long, length long, room long"), blocks


def pack(pieces: DataFrame, capacity: int, loose: float = 0.01) -> DataFrame:
    """``pieces`` with sequence_id and offset: as few sequences of at most ``capacity`` tokens as found.

    ``pieces`` has a column ``length`` (1 to ``capacity``); other columns pass
    through, but for input columns named sequence_id and offset, which are
    replaced.  Repeated rows are packed each on its own; an empty table gives an
    empty result.  Sequence numbers have gaps.  Bins with more than ``loose``
    of their room free are pooled over all blocks and packed once more, and the
    second packing counts if it has fewer bins.
    """
    rows, _ = numbered(stage(pieces.drop("sequence_id", "offset", "rid"), "pieces"))
    whole = F.col("length") >= capacity
    first, blocks = _solve(rows.filter(~whole).select("rid", "length"), capacity, "pack")
    first = stage(first, "pack-first")
    pool = first.filter(F.col("room") > loose * capacity)
    again, _ = _solve(pool.select("rid", "length"), capacity, "repack")
    again = stage(again.withColumn("sequence_id", F.col("sequence_id") + (blocks << BINS_BITS)), "pack-again")
    count = lambda df: df.select("sequence_id").distinct().count()
    if count(again) < count(pool):
        placed = first.filter(F.col("room") <= loose * capacity).unionByName(again)
    else:
        placed = first
    places = placed.select("rid", "sequence_id", "offset")
    alone = rows.filter(whole).withColumn("sequence_id", -1 - F.col("rid")).withColumn("offset", F.lit(0).cast("long"))
    return rows.filter(~whole).join(places, "rid").unionByName(alone).drop("rid")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary), from pieces that kept their ids.
    A sequence holds at most ``capacity`` pieces, so a group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.col("parts"), F.expr("cast('' as binary)"), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"))
