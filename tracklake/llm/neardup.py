"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words.  They are hashed to a fixed number of
features (as in HashingTF), whose document frequencies over the whole corpus
give the weights.  Every text gets HASHES weighted samples in bands.  Texts that
share a band are compared by a longer signature, block by block inside a task,
so no list of all pairs of a bucket is ever made; what may be similar is
decided by the weighted Jaccard similarity of the shingles, and links of at
least the threshold join to classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, held_by, parted, passing, rows_from, stage
from .words import Memo

WORDS = 5
THRESHOLD = 0.8
FEATURES = 1 << 17
BANDS, ROWS = 12, 3
HASHES = BANDS * ROWS
COMMON = 20          # a shingle in under one document of COMMON has full weight
LEAST_WEIGHT = 0.5
LONG = 128           # samples of the longer signature of texts that share a band
LONG_FEATURES = 1 << 15
MARGIN = 0.16        # 4.5 standard errors of LONG samples; one similar pair in 300,000 that share a band looks less alike
BLOCK = 128          # texts of a bucket on either side of a comparison in a task
CELLS = 64           # cells that are Python objects at a time
CHUNK = 65536        # numbers sampled at once: those of a chunk stay in the processor's cache
MIX = np.uint64(0x9E3779B97F4A7C15)


def runs_of(text: str) -> np.ndarray:
    """Hash of every shingle of a text, in its order."""
    import xxhash
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    # hashing a word is cheaper than finding it among many
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)
    n = max(len(h) - WORDS + 1, 1)
    s = np.zeros(n, dtype=np.uint64)
    for k in range(min(WORDS, len(h))):
        s ^= h[k:k + n]
        s *= MIX
        s ^= s >> np.uint64(29)
    return s


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts; a text of one to four words is one shingle."""
    return np.unique(runs_of(text), return_counts=True)


def feature(s: np.ndarray, features: int = FEATURES) -> np.ndarray:
    return ((s * MIX) >> np.uint64(65 - features.bit_length())).astype(np.int64)


def weights(s: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)) * idf[feature(s)]


def _frequencies(batches: Iterator[dict]) -> Iterator[dict]:
    """(feature, documents that have it) of a task; feature -1 counts the documents."""
    seen, docs = np.zeros(FEATURES, dtype=np.int64), 0
    for b in batches:
        for text in b["text"]:
            s = runs_of(text)
            if len(s):
                seen[feature(s)] += 1  # once, however often the text has it
                docs += 1
    at = np.flatnonzero(seen)
    yield {"feature": np.append(at, -1), "docs": np.append(seen[at], docs)}


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Weight of every feature from all documents; FEATURES numbers, whatever the input.

    1 for features of fewer than one document in COMMON, falling with the
    logarithm of the frequency to LEAST_WEIGHT.
    """
    counts = rows_from(texts.filter("text is not null").select("text"), _frequencies, "feature long, docs long", TEXTS)
    rows = counts.groupBy("feature").agg(F.sum("docs").alias("docs")).toPandas()
    df = np.zeros(FEATURES)
    total = int(rows.loc[rows["feature"] < 0, "docs"].sum())
    rows = rows[rows["feature"] >= 0]
    df[rows["feature"].to_numpy(np.int64)] = rows["docs"].to_numpy(float)
    return np.clip(np.log((total + 1) / np.maximum(df, 1)) / math.log(COMMON), LEAST_WEIGHT, 1.0)


@held_by("neardup")
@lru_cache(maxsize=2)
def _draws(features: int, hashes: int, seed: int = 9) -> tuple[np.ndarray, ...]:
    """The random numbers of every feature and hash: r and c are Gamma(2, 1), beta is uniform; and the logarithm that
    a shingle of weight 1 gets, whose quantised weight is 0."""
    rng = np.random.default_rng(seed)
    shape = (features, hashes)
    r = rng.standard_gamma(2.0, shape, dtype=np.float32) + np.float32(1e-6)
    c = rng.standard_gamma(2.0, shape, dtype=np.float32) + np.float32(1e-9)
    b = rng.random(shape, dtype=np.float32)
    ln_c = np.log(c)
    plain = np.subtract(np.float32(0), b, out=c)
    plain += np.float32(1)
    plain *= r
    np.subtract(ln_c, plain, out=plain)
    return r, b, ln_c, plain


@held_by("neardup")
@lru_cache(maxsize=2)
def _scratch(hashes: int) -> np.ndarray:
    """Room for the numbers of a chunk, the same for every text."""
    return np.empty((4, max(1, CHUNK // hashes), hashes), dtype=np.float32)


def samples(s: np.ndarray, w: np.ndarray, features: int = FEATURES, hashes: int = HASHES) -> np.ndarray:
    """One 64-bit sample (feature and quantised weight) per hash.

    Most shingles are rare and occur once: their weight is 1, and what they draw is read from a table.
    """
    *draws, plain = _draws(features, hashes)
    room = _scratch(hashes)
    f, ln_w = feature(s, features), np.log(w).astype(np.float32)
    best, sample = np.full(hashes, np.inf, dtype=np.float32), np.zeros(hashes, dtype=np.int64)
    cols = np.arange(hashes)
    one = ln_w == 0
    f, ones, ln_w = f[~one], f[one], ln_w[~one, None]
    for at in range(0, len(ones), room.shape[1]):
        g = ones[at:at + room.shape[1]]
        ln_a = plain.take(g, axis=0, out=room[0, :len(g)], mode="clip")
        k = ln_a.argmin(axis=0)
        low = ln_a[k, cols]
        better = low < best
        best = np.where(better, low, best)
        sample = np.where(better, g[k] * 4096, sample)
    for at in range(0, len(f), room.shape[1]):
        g = f[at:at + room.shape[1]]
        r, b, ln_c, t = room[:, :len(g)]
        for numbers, to in zip(draws, (r, b, ln_c)):
            numbers.take(g, axis=0, out=to, mode="clip")
        np.reciprocal(r, out=t)
        t *= ln_w[at:at + len(g)]
        t += b
        np.floor(t, out=t)
        ln_a = np.subtract(t, b, out=b)
        ln_a += np.float32(1)
        ln_a *= r
        np.subtract(ln_c, ln_a, out=ln_a)
        k = ln_a.argmin(axis=0)
        low = ln_a[k, cols]
        better = low < best
        best = np.where(better, low, best)
        sample = np.where(better, g[k] * 4096 + t[k, cols].astype(np.int64) % 4096, sample)
    return sample


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two sets of (hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low)) if len(i) else 0.0


def _bands(idf):
    """Hash of the samples of every band."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        import xxhash
        table = idf.value
        for b in batches:
            out = []
            for text in b["text"]:
                s, n = shingles(text or "")
                if not len(s):
                    out.append(None)
                    continue
                x = samples(s, weights(s, n, table)).reshape(BANDS, ROWS)
                out.append([xxhash.xxh3_64_intdigest(row.tobytes()) - (1 << 63) for row in x])
            yield {"doc_id": b["doc_id"], "node": b["node"], "bands": out}
    return run


def _long_signatures(idf):
    """LONG samples cut to 16 bits each; features in common by chance only make a pair look more alike."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        table = idf.value
        for b in batches:
            out = []
            for text in b["text"]:
                s, n = shingles(text)
                x = samples(s, weights(s, n, table), LONG_FEATURES, LONG).astype(np.uint64) * MIX
                out.append((x >> np.uint64(48)).astype("<u2").tobytes())
            yield {"node": b["node"], "signature": out}
    return run


def _cells(batches: Iterator[dict]) -> Iterator[tuple]:
    """(batch, row, rows of the cell, signatures, indices of either block) of every cell."""
    for b in batches:
        for k, rows in enumerate(b["rows"]):
            block = np.array([r["block"] for r in rows])
            sig = np.frombuffer(b"".join(r["signature"] for r in rows), dtype="<u2").reshape(-1, LONG)
            yield b, k, rows, sig, np.flatnonzero(block == b["bi"][k]), np.flatnonzero(block == b["bj"][k])


def _nearest(least: float):
    """Every text of a cell with the one that looks most like it: at most as many pairs as texts."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        a_out, b_out = [], []
        for _, _, rows, sig, left, right in _cells(batches):
            for i in left:
                others = right[right != i]
                if len(others):
                    share = (sig[others] == sig[i]).mean(axis=1)
                    if share.max() >= least:
                        x, y = bytes(rows[i]["node"]), bytes(rows[others[share.argmax()]]["node"])
                        a_out.append(min(x, y))
                        b_out.append(max(x, y))
            if len(a_out) > 50_000:
                yield {"a": a_out, "b": b_out}
                a_out, b_out = [], []
        yield {"a": a_out, "b": b_out}
    return run


def _open_pairs(rows, sig, left, right, band: int, least: float) -> Iterator[tuple[int, int]]:
    """Pairs of a cell that may be similar, are not in one class yet and share no earlier band."""
    keys = np.array([r["bands"] for r in rows])[:, :band]
    roots = np.array([bytes(r["root"]) for r in rows], dtype=object)
    same = np.array_equal(left, right)
    for i in left:
        others = right[right > i] if same else right
        if len(others):
            near = ((sig[others] == sig[i]).mean(axis=1) >= least) & (roots[others] != roots[i])
            near &= ~(keys[others] == keys[i]).any(axis=1)
            for j in others[near]:
                yield i, j


def _unsettled(least: float):
    """The texts of a cell that have an open pair: at most as many rows as texts."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b, k, rows, sig, left, right in _cells(batches):
            at = sorted({x for pair in _open_pairs(rows, sig, left, right, b["band"][k], least) for x in pair})
            if at:
                yield {n: [b[n][k]] * len(at) for n in ("band", "key", "bi", "bj")} | {
                    n: [rows[i][n] for i in at] for n in ("node", "bands", "signature", "root", "block")}
    return run


def _settle(idf, least: float, threshold: float):
    """Links that join different classes of a cell: fewer than it has texts."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        table = idf.value
        for b, k, rows, sig, left, right in _cells(batches):
            known = Memo(lambda i: (lambda s, n: (s, weights(s, n, table)))(*shingles(rows[i]["text"])))
            up = {bytes(r["root"]): bytes(r["root"]) for r in rows}

            def root(x):
                while up[x] != x:
                    x = up[x]
                return x

            a_out, b_out = [], []
            for i, j in _open_pairs(rows, sig, left, right, b["band"][k], least):
                x, y = root(bytes(rows[i]["root"])), root(bytes(rows[j]["root"]))
                if x != y and similarity(known[i], known[j]) >= threshold:
                    up[x] = y
                    a_out.append(bytes(rows[i]["node"]))
                    b_out.append(bytes(rows[j]["node"]))
            yield {"a": a_out, "b": b_out}
    return run


def _verify(idf, threshold: float):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        table = idf.value
        known = lru_cache(64)(lambda t: (lambda s, n: (s, weights(s, n, table)))(*shingles(t)))
        for b in batches:
            near = [similarity(known(x), known(y)) >= threshold for x, y in zip(b["ta"], b["tb"])]
            yield {"a": [x for x, ok in zip(b["a"], near) if ok], "b": [x for x, ok in zip(b["b"], near) if ok]}
    return run


CELL = ["band", "key", "bi", "bj"]


def _distinct_buckets(every: DataFrame) -> DataFrame:
    """band, key and size of the buckets of two texts and more, one of those that hold the same texts.

    Near copies share most of their bands.  The first band is kept, so that a pair which shares an earlier band than
    that of a bucket has met in a bucket of an earlier band.  Two hashes of 64 bits tell which buckets are equal.
    """
    salted = [F.bit_xor(F.xxhash64("node", F.lit(salt))).alias(f"x{salt}") for salt in (1, 2)]
    sizes = every.groupBy("band", "key").agg(F.count("*").alias("n"), *salted).filter("n > 1")
    return sizes.groupBy("n", "x1", "x2").agg(F.min(F.struct("band", "key")).alias("at")).select("at.*", "n")


def _meet(members: DataFrame) -> DataFrame:
    """A row for every two blocks of a bucket with their texts; a bucket is cut into blocks of about BLOCK."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cells.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))


def _gather(cells: DataFrame, *more: str) -> DataFrame:
    held = F.struct("node", "bands", "signature", "block", *more)
    return cells.groupBy(*CELL).agg(F.collect_list(held).alias("rows")).filter(F.size("rows") > 1)


def _first_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the first rows of the nodes of ``wanted`` (node, first), and of few other nodes; nothing is dealt.

    A row that comes several times stays so.
    """
    want = wanted.select(F.xxhash64("node", "first").alias("_want"))
    return parted(rows.filter("text is not null"), F.xxhash64("node", "doc_id"), want, "_want")[0].select("node", "text")


def _texts(rows: DataFrame, first: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text, once for every node of ``nodes``, and few other nodes."""
    return _first_rows(rows, first.join(nodes.distinct(), "node")).dropDuplicates(["node"])


def _links(shared: DataFrame, rows: DataFrame, first: DataFrame, idf, threshold: float) -> DataFrame:
    """Verified links (a, b) whose classes are those of all similar texts that share a band.

    First every text is compared with the one of its bucket that looks most like
    it, which joins most of a group with as many pairs as texts.  Then the pairs
    of a bucket that may be similar and are not in one class yet are compared
    inside tasks, a cell of two blocks at a time, and only links that join
    classes come out.  So no pair is left out but for errors of the signature
    (MARGIN), and no stage has a row per pair.  Signatures are made where the texts are read; texts are dealt
    only for pairs that look similar, once.
    """
    least = threshold - MARGIN
    signatures = rows_from(_first_rows(rows, first), _long_signatures(idf), "node binary, signature binary", TEXTS)
    signed = stage(signatures.dropDuplicates(["node"]).join(first.select("node", "bands"), "node"), "signatures")
    members = shared.join(signed, "node")
    near = _gather(_meet(members).filter(F.col("bj") - F.col("bi") <= 1)).select("bi", "bj", "rows")
    likely = stage(rows_from(near, _nearest(least), "a binary, b binary", CELLS).distinct(), "likely")
    texts = _texts(rows, first, likely.select(F.explode(F.array("a", "b")).alias("node")))
    body = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"t{n}"))
    links = stage(rows_from(likely.join(body("a"), "a").join(body("b"), "b"), _verify(idf, threshold),
                            "a binary, b binary"), "links")

    labelled = members.join(classes(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = stage(labelled, "labelled")
    mixed = labelled.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    cells = _gather(_meet(labelled.join(mixed.select("band", "key"), ["band", "key"])), "root")
    row = "node binary, bands array<bigint>, signature binary, root binary, block int"
    rest = stage(rows_from(cells, _unsettled(least), f"band int, key long, bi int, bj int, {row}", CELLS), "unsettled")
    full = _gather(rest.join(_texts(rows, first, rest.select("node")), "node"), "root", "text")
    last = rows_from(full, _settle(idf, least, threshold), "a binary, b binary", CELLS)
    return stage(links.unionByName(last), "all-links")


def classes(links: DataFrame) -> DataFrame:
    """node, root of every linked node: the smallest node that links lead to.

    Each round a node takes the smallest label among its own and its
    neighbours', then the label of that label, so paths shorten by halves.
    """
    both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n"))
                   .select("node", F.least("node", "n").alias("root")), "roots")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("near")))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("root").alias("top"))
        step = stage(step.join(up, "low").select("node", F.col("root").alias("old"), F.least("low", "top").alias("root")), "roots")
        labels = step.select("node", "root")
        if step.filter("old <> root").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node, class_id of every row: class_id is the smallest doc_id of the texts linked to it.

    Equal texts are one node (a 16-byte hash of the text) and always one class.
    Null texts and texts without a word are each a class of their own.  Null ids
    count as larger than all others, so a class has a null id only if all
    its ids are null.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))
    with passing(spark):
        idf = spark.sparkContext.broadcast(inverse_frequencies(rows))
        signed = stage(rows_from(rows, _bands(idf), "doc_id long, node binary, bands array<bigint>", TEXTS), "bands")
        nodes = stage(signed.filter("bands is not null").groupBy("node")
                      .agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")), "nodes")
        every = nodes.select("node", F.posexplode("bands").alias("band", "key"))
        shared = stage(every.join(_distinct_buckets(every), ["band", "key"]), "shared")
        first = stage(shared.select("node").distinct().join(nodes, "node"), "first")
        roots = classes(_links(shared, rows, first, idf, threshold))
        labelled = roots.join(nodes.select("node", "first"), "node")
        ids = labelled.join(labelled.groupBy("root").agg(F.min("first").alias("class_id")), "root").select("node", "class_id")
        # stored, so that Spark can split the join below on a text that very many rows share
        per_node = stage(nodes.join(ids, "node", "left").select("node", F.coalesce("class_id", "first").alias("class_id")),
                         "classes", lasting=True)
        each = stage(signed.select("doc_id", "node", F.col("bands").isNull().alias("alone")), "rows", lasting=True)
    return (each.join(per_node, "node", "left")
            .select("doc_id", "node", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")))


def first_of_class(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each class, repeated rows once, all columns.

    Only rows that may go, being repeated or not the first of their class, are dealt with their texts.
    """
    with passing(docs.sparkSession):
        found = near_duplicates(docs, threshold, doc_id, text)
        kinds = found.groupBy(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).agg(
            F.count("*").alias("n"), F.max(~F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("gone"))
        touched = stage(kinds.filter("gone OR n > 1").select("_id", "_node", "gone", F.xxhash64("_id", "_node").alias("_hash")),
                        "touched", lasting=True)
    key = F.unhex(F.md5(F.col(text).cast("binary")))
    keyed = docs.withColumn("_key", key)
    may, stays = parted(keyed, F.xxhash64(F.col(doc_id).cast("long"), F.col("_key")), touched, "_hash")
    left = may.join(touched.filter("gone"), F.col(doc_id).cast("long").eqNullSafe(F.col("_id"))
                    & F.col("_key").eqNullSafe(F.col("_node")), "left_anti")
    return stays.unionByName(left.dropDuplicates([doc_id, "_key"])).drop("_key")
