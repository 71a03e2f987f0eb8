"""Exact join of documents by the Jaccard similarity of their word shingles, in metric space.

One minus the Jaccard similarity is a metric, so distances to a pivot bound all
other distances: two texts within ``r`` differ by at most ``r`` in their distance
to any pivot.

Equal sets are one class.  Texts that share one of their rarest shingles and
have sizes of one window (sizes of linked sets are within the threshold) meet at
a pivot, the first of them; all that meet at a pivot are its region.  As two linked sets
must share one of these shingles, every link lies inside some region.  A region
is joined by recursion: the distances to a pivot give its cell (within r, all linked
to it) and its boundary (within 2r); the cell with its replicated boundary and
what is outside the cell are regions of their own.  Regions that are too large for a
task get a set of pivots at once: members are dealt in chunks against them, those not
yet joined to the region's largest component form blocks by their nearest pivot
(Voronoi), and a block meets the members in its triangle-inequality windows.

What comes out are real links, enough of them to connect whatever is linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_rows, parted, passing, rows_from, stage
from .neardup import classes

WORDS, LEAST = 3, 90          # words of a shingle, per cent of the union
FEATURE_BITS = 20             # features whose document frequencies order the shingles
STEP = 1 << 14                # features of one row of counts
PIECE = 1 << 20               # bytes of text that are hashed at once
REGION, REGION_SHINGLES = 256, 1 << 22   # members and shingles of a region that one task joins
MORE = 32                     # linked sets share one more of their rarest shingles for so many that they have in common
PIVOTS = 16                   # of a larger region (twice as many on average, by hash)
BLOCK = 64                    # members of a block

P, M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SALTS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xBF58476D1CE4E5B9))  # of one and of two words
BLANK = np.zeros(256, dtype=bool)
BLANK[[*range(9, 14), 32]] = True
VALUE = np.arange(1, 257, dtype=np.uint64)
VALUE[65:91] = VALUE[97:123]  # A-Z count as a-z
VALUE[BLANK] = 0
POWERS = 1 << 16
_powers = np.ones(POWERS, dtype=np.uint64)
_powers[1:] = P
_powers = np.cumprod(_powers)


# ---------------------------------------------------------------- shingles
def _word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of joined texts and the number of words before each bound; no word crosses a bound."""
    blank = BLANK[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    inner = bounds[bounds < len(raw)]
    first[inner] = ~blank[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    lead = starts[0]
    begins = starts - lead
    at = np.arange(len(raw) - lead) - np.repeat(begins, np.diff(np.append(begins, len(raw) - lead)))
    terms = VALUE[raw[lead:]] * _powers[at & (POWERS - 1)]
    if at.max() >= POWERS:  # the power goes on beyond the table
        terms *= np.array([pow(int(P), int(k) * POWERS, 1 << 64) for k in range(at.max() // POWERS + 1)],
                          dtype=np.uint64)[at // POWERS]
    h = np.add.reduceat(terms, begins)
    h = (h ^ (h >> np.uint64(32))) * M
    return h ^ (h >> np.uint64(29)), np.searchsorted(starts, bounds)


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a text, cut before blanks."""
    at = 0
    while len(raw) - at > PIECE:
        blanks = np.flatnonzero(BLANK[raw[at + 1:at + PIECE]])
        if len(blanks):
            end = at + 1 + int(blanks[-1])
        else:  # a very long word
            end = at + PIECE
            while end < len(raw) and not BLANK[raw[end]]:
                end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _sets_of(h: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    run = h * M
    run ^= run >> np.uint64(31)
    one, two = run * SALTS[0], None
    for k in range(1, WORDS):
        ahead = len(h) - k
        if ahead <= 0:
            break
        run[:ahead] = (run[:ahead] ^ h[k:]) * P
        run[:ahead] ^= run[:ahead] >> np.uint64(29)
        if k == 1:
            two = run * SALTS[1]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WORDS:
            s = np.sort(run[a:b - WORDS + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        else:
            yield h[:0] if a == b else (one if b - a == 1 else two)[a:a + 1].copy()


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of every text; none of a null or a text without a word."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = texts.fill_null("") if texts.null_count else texts
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(int(np.searchsorted(bounds, bounds[i] + PIECE, side="right")) - 1, i + 1)
        part = raw[bounds[i]:bounds[j]]
        if len(part) <= PIECE:
            yield from _sets_of(*_word_hashes(part, bounds[i:j + 1] - bounds[i]))
        else:
            h = np.concatenate([_word_hashes(p, np.array([0, len(p)]))[0] for p in _pieces(part)])
            yield from _sets_of(h, np.array([0, len(h)]))
        i = j


def feature(s: np.ndarray) -> np.ndarray:
    """Feature of every shingle: the upper bits of its hash, so features of a sorted set are sorted."""
    return (s >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, held, waiting = np.zeros(1 << FEATURE_BITS, dtype=np.int64), [], 0
    for b in batches:
        for s in shingle_sets(b.column(0)):
            f = feature(s)
            held.append(f[np.append(True, f[1:] != f[:-1])] if len(f) else f)
            waiting += len(f)
            if waiting > 1 << 20:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, waiting = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=len(total))
    counts = total.astype("<u8").reshape(-1, STEP)
    at = np.flatnonzero(counts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([counts[i].tobytes() for i in at], pa.binary())],
                                     names=["row", "part"])


def frequencies(texts: DataFrame) -> np.ndarray:
    """Documents that have each feature, over all texts; 2^FEATURE_BITS numbers whatever the input."""
    counts = texts.select("text").mapInArrow(_frequencies, "row int, part binary")
    out = np.zeros(1 << FEATURE_BITS, dtype=np.uint64)
    for i, part in added_rows(counts, "<u8").items():
        out[i * STEP:(i + 1) * STEP] = part
    return np.minimum(out, (1 << FEATURE_BITS) - 1).astype(np.uint32)


def required(n, least: int):
    """Shingles that linked sets have in common among their rarest ones."""
    return 1 + -(-least * n // 100) // MORE


def rarest(s: np.ndarray, df: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set of which every set linked to it has one, and the next rarest.

    The order, by rarity, is that of all texts.  A linked set has at least
    ceil(least % of n) of the n shingles, so one of the n - that + 1 first in the
    order, and k of the n - that + k first, k being the smaller ``required`` of the two
    sets.  Equal places in the order are all taken.
    """
    need = -(-least * len(s) // 100)
    last = len(s) - need
    more = min(last + required(len(s), least), len(s)) - 1
    order = (df[feature(s)].astype(np.uint64) << np.uint64(64 - FEATURE_BITS)) | (s & np.uint64((1 << (64 - FEATURE_BITS)) - 1))
    ends = np.partition(order, (last, more))[[last, more]]
    return s[order <= ends[0]], s[(order > ends[0]) & (order <= ends[1])]


def _measured(df, least: int):
    """What is kept of every text: the size and the hash of its set, and its rarest shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        table = df.value
        for b in batches:
            n, node, lists = [], [], [[np.empty(0, np.uint64)], [np.empty(0, np.uint64)]]
            for s in shingle_sets(b.column(2)):
                n.append(len(s))
                node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                for held, part in zip(lists, rarest(s, table, least) if len(s) else (s, s)):
                    held.append(part)
            rare, more = (pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in held]), pa.int32()),
                                                   pa.array(np.concatenate(held).view(np.int64))) for held in lists)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), rare, more],
                                             names=["doc_id", "same", "n", "node", "rare", "more"])
    return run


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the wanted texts, and their regions; copies of one text in a task give one row."""
    import xxhash
    done = set()
    for b in batches:
        ids, nodes = b.column(0).to_pylist(), b.column(1).to_pylist()
        at, sets = [], []
        for i, (cls, node, s) in enumerate(zip(ids, nodes, shingle_sets(b.column(2)))):
            raw = s.tobytes()
            if cls not in done and xxhash.xxh3_128_digest(raw) == node:
                done.add(cls)
                at.append(i)
                sets.append(raw)
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(3).take(at), pa.array(sets, pa.binary())],
                                         names=["cls", "pivots", "held"])


# ----------------------------------------------------------------- regions
class Region:
    """Members of a region as places of the shingles that at least two of them have."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        _, term, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[term] > 1
        self.terms, self.term, self.owner = len(count), term[shared], owner[shared]

    def only(self, members: np.ndarray) -> Region:
        part = object.__new__(Region)
        to = np.full(len(self.size), -1)
        to[members] = np.arange(len(members))
        keep = to[self.owner] >= 0
        part.size, part.terms, part.term, part.owner = self.size[members], self.terms, self.term[keep], to[self.owner[keep]]
        return part

    def common(self, pivot: int) -> np.ndarray:
        """Shingles that each member has in common with the pivot."""
        mark = np.zeros(self.terms, dtype=bool)
        mark[self.term[self.owner == pivot]] = True
        out = np.bincount(self.owner[mark[self.term]], minlength=len(self.size))
        out[pivot] = self.size[pivot]
        return out


def region_links(sets: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int]]:
    """Links between the members of a region, fewer than it has members, that connect all that is linked."""
    links, label = [], np.arange(len(sets))
    todo = [(Region(sets), np.arange(len(sets)), np.arange(len(sets)))]
    while todo:
        region, names, live = todo.pop()  # names: members of the region, live: places in it that are still to be joined
        while len(live) > 1:
            own = label[names[live]]
            kinds, counts = np.unique(own, return_counts=True)
            if len(kinds) == 1:
                break
            if 2 * len(live) < len(names):
                region, names, live = region.only(live), names[live], np.arange(len(live))
            pivot = int(live[np.argmax(own == kinds[counts.argmin()])])
            common = region.common(pivot)[live]
            union = region.size[pivot] + region.size[live] - common
            others = live != pivot
            cell = (100 * common >= least * union) & others
            near = (100 * common >= (2 * least - 100) * union) & others  # within twice the radius
            me = names[pivot]
            for x in names[live[cell]]:
                if label[x] != label[me]:
                    links.append((int(me), int(x)))
                    label[label == label[x]] = label[me]
            outside = others & ~cell
            if near.sum() + outside.sum() <= 1.25 * len(live):
                todo.append((region, names, live[near]))
                live = live[outside]
            else:
                live = live[others]
    return links


def _runs(batches: Iterator[dict], keys: list[str]) -> Iterator[tuple[tuple, dict]]:
    """(key, columns) of every run of equal keys; rows come sorted by key."""
    now, held = None, None
    for b in batches:
        names = list(b)
        for row in zip(*b.values()):
            r = dict(zip(names, row))
            key = tuple(r[k] for k in keys)
            if key != now:
                if held:
                    yield now, held
                now, held = key, {n: [] for n in names}
            for n in names:
                held[n].append(r[n])
    if held:
        yield now, held


def _partnered(least: int):
    """The members of a region that may be linked with another: by size, and by the rarest shingles in common."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        out = {"pivot": [], "cls": []}
        for (pivot,), held in _runs(batches, ["pivot"]):
            n = np.array(held["n"])
            need = required(n, least)
            region = Region([np.array(x, dtype=np.int64).view(np.uint64) for x in held["shingles"]])
            partner = np.zeros(len(n), dtype=bool)
            for i in range(len(n)):
                if not partner[i]:
                    may = (region.common(i) >= np.minimum(need, need[i])) & (100 * np.minimum(n, n[i]) >= least * np.maximum(n, n[i]))
                    may[i] = False
                    if may.any():
                        partner |= may
                        partner[i] = True
            at = np.flatnonzero(partner)
            out["pivot"] += [pivot] * len(at)
            out["cls"] += [held["cls"][i] for i in at]
            if len(out["cls"]) > 10_000:
                yield out
                out = {"pivot": [], "cls": []}
        yield out
    return run


def _join_regions(least: int):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        a, b = [], []
        for _, held in _runs(batches, ["pivot"]):
            sets = dict(zip(held["cls"], held["held"]))  # a text read twice is one member
            ids = list(sets)
            for i, j in region_links([np.frombuffer(s, dtype=np.uint64) for s in sets.values()], least):
                a.append(min(ids[i], ids[j]))
                b.append(max(ids[i], ids[j]))
            if len(a) > 10_000:
                yield {"a": a, "b": b}
                a, b = [], []
        yield {"a": a, "b": b}
    return run


class Pivots:
    """Overlaps of sets with a few given ones."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def common(self, s: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        many = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        return np.bincount(self.owner[at], minlength=len(self.size))


def _led(batches: Iterator[dict], keys: list[str]) -> Iterator[tuple[dict, Iterator[tuple]]]:
    """Every row that follows the leading rows of its key, with these: (key, leaders, row).  Leaders come first."""
    now, lead, index = None, None, None
    for b in batches:
        names = list(b)
        for row in zip(*b.values()):
            r = dict(zip(names, row))
            key = tuple(r[k] for k in keys)
            if key != now:
                now, lead, index = key, {}, None
            if r["leads"]:
                lead[r["cls"]] = r
            else:
                if index is None:
                    index = Pivots([np.frombuffer(x["held"], dtype=np.uint64) for x in lead.values()])
                yield key, lead, index, r


def _distances(least: int):
    """Distances of the members of a chunk to the pivots of their region, and the pivots that they are linked to."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        out = {"pivot": [], "cls": [], "distances": [], "linked": []}
        for (pivot, _), lead, index, r in _led(batches, ["pivot", "chunk"]):
            common = index.common(np.frombuffer(r["held"], dtype=np.uint64))
            union = index.size + len(r["held"]) // 8 - common
            names = list(lead)
            out["pivot"].append(pivot)
            out["cls"].append(r["cls"])
            out["distances"].append((1 - common / union).tolist())
            out["linked"].append([names[i] for i in np.flatnonzero(100 * common >= least * union) if names[i] != r["cls"]])
            if len(out["cls"]) > 2000:
                yield out
                out = {k: [] for k in out}
        yield out
    return run


def _join_blocks(least: int):
    """Links of the members of a chunk with those of a block, one for each two components that they join."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        a, b, now, up = [], [], None, {}

        def top(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        for key, lead, index, r in _led(batches, ["pivot", "cell", "sub", "chunk"]):
            if key != now:
                now, up = key, {}
            common = index.common(np.frombuffer(r["held"], dtype=np.uint64))
            union = index.size + len(r["held"]) // 8 - common
            names = list(lead)
            for i in np.flatnonzero(100 * common >= least * union):
                x, y = top(lead[names[i]]["root"]), top(r["root"])
                if x != y:
                    up[x] = y
                    a.append(min(names[i], r["cls"]))
                    b.append(max(names[i], r["cls"]))
            if len(a) > 10_000:
                yield {"a": a, "b": b}
                a, b = [], []
        yield {"a": a, "b": b}
    return run


def _dealt(rows: DataFrame, leaders: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, those of a key together and its leaders first."""
    both = leaders.withColumn("leads", F.lit(True)).unionByName(rows.withColumn("leads", F.lit(False)))
    return both.repartition(*keys).sortWithinPartitions(*keys, F.desc("leads"), "cls")


def _spread(rows: DataFrame, keys: list[str], per_task: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a chunk each, and the number of chunks of every key."""
    chunks = stage(rows.groupBy(*keys).agg(F.ceil(F.count("*") / per_task).cast("int").alias("chunks")), "chunks")
    dealt = rows.join(chunks, keys).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    return dealt.drop("chunks"), chunks


def _in_each(leaders: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    each = leaders.join(chunks, keys)
    return each.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")


def _large_region_links(members: DataFrame, sets: DataFrame, links: DataFrame, least: int) -> DataFrame:
    """Links of the regions that one task doesn't join.  ``members``: pivot, cls, members and first of the region."""
    radius = 1 - least / 100 + 1e-9
    sets = stage(sets, "large-sets")
    # pivots of a region: its first member and about 2 * PIVOTS by hash
    share = F.pmod(F.xxhash64("pivot", "cls"), F.lit(1 << 20)) * F.col("members") < F.lit(2 * PIVOTS << 20)
    dealt, chunks = _spread(members.select("pivot", "cls"), ["pivot"], REGION)
    pivots = _in_each(members.filter(share | (F.col("head") == F.col("cls"))).select("pivot", "cls"), chunks, ["pivot"])
    against = _dealt(dealt.join(sets, "cls"), pivots.join(sets, "cls"), ["pivot", "chunk"])
    found = stage(rows_from(against.select("pivot", "chunk", "cls", "held", "leads"), _distances(least),
                            "pivot long, cls long, distances array<double>, linked array<bigint>", at_once=500)
                  .dropDuplicates(["pivot", "cls"]), "distances")
    near = found.select(F.col("cls").alias("x"), F.explode("linked").alias("y"))
    links = stage(links.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))), "pivot-links")
    roots = classes(links).withColumnRenamed("node", "cls")
    held = stage(found.drop("linked").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "labelled")
    parts = held.groupBy("pivot", "root").count()
    main = parts.groupBy("pivot").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    # what is not in the largest component of the region, in blocks of a Voronoi cell
    minor = stage(held.join(main, "pivot").filter("root <> main").drop("main")
                  .withColumn("cell", F.array_position("distances", F.array_min("distances")).cast("int")), "minor")
    per_cell = minor.groupBy("pivot", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("subs"))
    block = ["pivot", "cell", "sub"]
    minor = minor.join(per_cell, ["pivot", "cell"]).withColumn("sub", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("subs")).cast("int"))
    ends = (minor.select(*block, F.posexplode("distances").alias("k", "d")).groupBy(*block, "k")
            .agg((F.min("d") - radius).alias("low"), (F.max("d") + radius).alias("high")))
    windows = ends.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("window"))
    inside = F.forall(F.zip_with("window", "distances", lambda w, d: (d >= w["low"]) & (d <= w["high"])), lambda ok: ok)
    reached = stage(held.join(windows, "pivot").filter(inside).select(*block, "cls", "root"), "reached")
    rows, chunks = _spread(reached, block, REGION)
    leaders = _in_each(minor.select(*block, "cls", "root"), chunks, block)
    keys = [*block, "chunk"]
    meet = _dealt(rows.join(sets, "cls"), leaders.join(sets, "cls"), keys).select(*keys, "cls", "root", "held", "leads")
    return links.unionByName(rows_from(meet, _join_blocks(least), "a long, b long", at_once=500))


def _regions(heads: DataFrame, least: int) -> DataFrame:
    """(pivot, cls): the regions, without members that cannot be linked inside.  ``heads``: cls, n, rare, more."""
    # (cls, s) is dealt once, for those who count a shingle and those who look it up; only shingles that two sets have,
    # a small part of all, go on
    each = heads.select("cls", F.size("rare").alias("rares"), F.posexplode(F.concat("rare", "more")).alias("at", "s"))
    each = each.select("cls", "s", (F.col("at") < F.col("rares")).alias("first")).repartition("s")
    several = each.groupBy("s").agg(F.min("cls").alias("least"), F.max("cls").alias("most"), F.count_if("first").alias("firsts"))
    several = several.filter("least <> most").select("s", (F.col("firsts") > 1).alias("meets"))
    shared = each.join(several, "s").select("cls", "s", (F.col("first") & F.col("meets")).alias("meets")).repartition("cls")
    shared = shared.groupBy("cls").agg(F.collect_list("s").alias("shingles"), F.collect_list(F.when(F.col("meets"), F.col("s"))).alias("rare"))
    shared = stage(shared.filter(F.size("rare") > 0).join(heads.select("cls", "n"), "cls").select("cls", "n", "rare", "shingles"), "shared")
    # sizes of linked sets lie in one window or in neighbouring ones
    window = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / least) * (1 + 1e-9))).cast("int") if least < 100 else F.col("n")
    keyed = shared.select("cls", window.alias("w"), F.explode("rare").alias("s"))
    keyed = keyed.select("cls", F.explode(F.array(F.xxhash64("s", "w"), F.xxhash64("s", F.col("w") - 1))).alias("meet")).repartition("meet")
    meets = keyed.groupBy("meet").agg(F.min("cls").alias("pivot"), F.max("cls").alias("most")).filter("pivot <> most").drop("most")
    members = stage(keyed.join(meets, "meet").select("pivot", "cls").distinct(), "meeting")
    sized = members.join(members.groupBy("pivot").agg((F.count("*") > REGION).alias("large")), "pivot")
    sized = stage(sized, "meeting-sizes")
    small = sized.filter("not large").drop("large")
    small = small.hint("merge").join(parted(shared, "cls", small, "cls")[0], "cls").select("pivot", "cls", "n", "shingles")
    small = small.repartition("pivot").sortWithinPartitions("pivot")
    kept = rows_from(small, _partnered(least), "pivot long, cls long", at_once=500)
    return sized.filter("large").select("pivot", "cls").unionByName(kept)


def _sets(rows: DataFrame, measured: DataFrame, members: DataFrame) -> DataFrame:
    """cls, pivots (the regions it is in) and held (its whole set) of the classes of ``members`` (pivot, cls)."""
    wanted = members.groupBy("cls").agg(F.collect_list("pivot").alias("pivots")).join(measured.withColumnRenamed("row", "cls"), "cls")
    wanted = stage(wanted.select("cls", F.col("doc_id").alias("id"), F.col("same").alias("like"), "node", "pivots"), "wanted")
    texts = parted(rows, "same", wanted, "like")[0].join(
        wanted.hint("merge"), (F.col("same") == F.col("like")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return texts.select("cls", "node", "text", "pivots").mapInArrow(_whole_sets, "cls long, pivots array<bigint>, held binary")


def join_documents(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links) of the join.

    rows: doc_id, n (shingles), node (null without a word) of every row; classes: node, cls, first (smallest id), n
    of every distinct set; links: a, b of classes, each a pair within the threshold, that connect
    whatever is linked.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("same"), F.col(text).alias("text"))
    df = spark.sparkContext.broadcast(frequencies(rows))
    measured = rows.mapInArrow(_measured(df, least),
                               "doc_id long, same long, n long, node binary, rare array<bigint>, more array<bigint>")
    with passing(spark):
        whole = stage(measured.withColumn("row", F.monotonically_increasing_id()), "measured")
        measured = stage(whole.drop("rare", "more"), "measured-rows", lasting=True)
        per_class = stage(measured.filter("n > 0").groupBy("node").agg(
            F.min("row").alias("cls"), F.min("doc_id").alias("first"), F.max("n").alias("n")), "classes", lasting=True)
        heads = whole.join(per_class.select(F.col("cls").alias("row")), "row").select(F.col("row").alias("cls"), "n", "rare", "more")
        members = stage(_regions(heads, least), "members", lasting=True)
    sizes = members.join(per_class.select("cls", "n"), "cls").groupBy("pivot").agg(
        F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("cls").alias("head"))
    sized = stage(members.join(sizes, "pivot"), "sized")
    large = (F.col("members") > REGION) | (F.col("shingles") > REGION_SHINGLES)
    small = _sets(rows, measured, sized.filter(~large).select("pivot", "cls")).select(F.explode("pivots").alias("pivot"), "cls", "held")
    small = small.repartition("pivot").sortWithinPartitions("pivot")
    links = stage(rows_from(small, _join_regions(least), "a long, b long", at_once=500), "links")
    of_large = sized.filter(large).select("pivot", "cls", "members", "head")
    if not of_large.isEmpty():
        sets = _sets(rows, measured, of_large.select("pivot", "cls")).select("cls", "held")
        links = stage(_large_region_links(of_large, sets, links, least), "all-links")
    return measured.select("doc_id", "n", "node"), per_class, links


def components(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    The component is the smallest doc_id reachable by links of at least ``least``
    per cent.  Null texts and texts without a word have no shingles, no links and
    their own id.  Rows with the same text are linked, whatever their ids; null
    ids count as larger than all others, so a component has a null id only if
    all its ids are null.  Other columns are not read.
    """
    with passing(docs.sparkSession):
        rows, per_class, links = join_documents(docs, least, doc_id, text)
        rows = stage(rows, "rows", lasting=True)
        roots = classes(links).withColumnRenamed("node", "cls")
        labelled = per_class.select("node", "cls", "first").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        ids = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
        # stored, so that Spark can split the join below on a set that very many rows share
        per_node = stage(labelled.join(ids, "root").select("node", "component_id"), "components", lasting=True)
    found = rows.join(per_node, "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"),
                        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def oracle(least: int = LEAST) -> str:
    """DuckDB text: all pairs of distinct sets that share a shingle, then reachability."""
    return f"""WITH RECURSIVE worded AS (
      SELECT row_number() OVER () AS row_no, doc_id,
             list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
      FROM documents),
    made AS (
      SELECT row_no, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
      FROM worded),
    hashed AS (SELECT row_no, doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS node, s FROM made),
    sets AS (SELECT node, any_value(n) AS n, any_value(s) AS s FROM hashed WHERE n > 0 GROUP BY node),
    each AS (SELECT node, n, unnest(s) AS x FROM sets),
    shared AS (
      SELECT a.node AS a, b.node AS b, a.n + b.n - count(*) AS u, count(*) AS i
      FROM each a JOIN each b ON a.x = b.x AND a.node <> b.node GROUP BY a.node, b.node, a.n, b.n),
    links AS (SELECT a, b FROM shared WHERE 100 * i >= {least} * u),
    reach AS (SELECT node AS a, node AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    firsts AS (SELECT node, min(doc_id) AS first FROM hashed WHERE n > 0 GROUP BY node),
    ids AS (SELECT r.a AS node, min(f.first) AS component_id FROM reach r JOIN firsts f ON f.node = r.b GROUP BY r.a)
    SELECT h.doc_id, h.n AS n_shingles, CASE WHEN h.n = 0 THEN h.doc_id ELSE i.component_id END AS component_id
    FROM hashed h LEFT JOIN ids i ON i.node = h.node"""
