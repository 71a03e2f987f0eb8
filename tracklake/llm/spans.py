"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences after marks and line ends, and, where no mark is
within NEAR words on either side, after words picked by their hash; so where a
passage is cut depends on the words near the place alone, and passages that
start or end inside a sentence are cut alike in every text.

Every run of at least two consecutive sentences with at least MIN_WORDS words
counts.  Such a run is covered by the shortest ones that start or end at its
sentences, so only these are hashed, from either side.  They are joined
globally on a 128-bit hash of their words, and the sentences that lie in a run
which is not its first occurrence are removed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parted, passing, rows_from, stage, with_columns_from

MIN_SENTENCES, MIN_WORDS = 2, 20
NEAR, CUT_ONE_IN = 8, 4
CHUNK = 1 << 16  # characters of texts that are hashed together
AT_ONCE = 250       # rows that are Python objects at a time
RUN = "h1 long, h2 long, doc_id long, row long, pos int, sentences int"
# bits that say which rows may count; fixed, so larger inputs only pass more rows
SLOTS, BITS_A_ROW = 1 << 27, 1 << 15
STEP = 0x9E3779B97F4A7C15
LANES = [m | 1 for m in np.random.default_rng(8).integers(1 << 62, 1 << 63, 2).tolist()]
OTHER, SPACE, MARK = 0, 1, 2
KINDS = np.array([SPACE if chr(c).isspace() else MARK if chr(c) in ".!?" else OTHER for c in range(0x3002)], dtype=np.int8)


def _powers(base: int, n: int) -> np.ndarray:
    """At least ``n`` powers of ``base`` modulo 2^64."""
    size = max(CHUNK, 1 << (n - 1).bit_length())
    return _all_powers(base, size)


@lru_cache(maxsize=2)
def _all_powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(STEP)
    return x ^ (x >> np.uint64(29))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of the text, first character and end of every word of the texts, and whether a mark or a line ends after it.

    A word ends after white space and after marks that end sentences; the white
    space is part of it but not of its hash, nor is upper case.
    """
    joined = "\n".join(texts)
    low = joined.lower()
    if len(low) != len(joined):  # a letter that becomes two stays
        low = "".join(x if len(x := c.lower()) == 1 else c for c in joined)
    codes = np.frombuffer(low.replace("ς", "σ").encode("utf-32-le"), dtype="<u4")
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    kind = KINDS[np.minimum(codes, len(KINDS) - 1)]
    before = np.concatenate([[np.int8(SPACE)], kind[:-1]])[:len(kind)]
    start = np.flatnonzero((kind != SPACE) & ((before == SPACE) | ((kind == OTHER) & (before == MARK))))
    text = np.searchsorted(first, start, "right") - 1
    # a word is a polynomial of its characters: a difference of sums over the texts, shifted to power 0
    value = np.where(kind == SPACE, np.uint64(0), _mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(LANES[0])))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _powers(STEP, len(codes))[:len(codes)], dtype=np.uint64)])
    bounds = np.append(start, len(codes))
    h = _mixed((sums[bounds[1:]] - sums[start]) * _powers(pow(STEP, -1, 1 << 64), len(codes))[start])
    end = np.minimum(bounds[1:], first[text + 1] - 1)
    ends = np.concatenate([[0], np.cumsum((kind == MARK) | (codes == 10))])
    return h, text, start - first[text], end - first[text], ends[end] > ends[start]


def sentences_of(h: np.ndarray, text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every sentence, with the number of words at the end, and the number of its text."""
    n = len(h)
    if not n:
        return np.zeros(1, np.int64), np.empty(0, np.int64)
    at, stops = np.arange(n), np.flatnonzero(stop)
    known = np.concatenate([[-NEAR - n], stops, [2 * n + NEAR]])
    k = np.searchsorted(stops, at)  # the next stop, maybe the word itself
    before, after = known[k], known[k + 1]
    edge = np.searchsorted(text, text)  # marks of other texts are not near
    last = np.searchsorted(text, text, "right")
    far = ((before < edge) | (at - before > NEAR)) & ((after >= last) | (after - at > NEAR))
    ends = stop | (far & (h % np.uint64(CUT_ONE_IN) == 0)) | (at == last - 1)
    first = np.concatenate([[0], np.flatnonzero(ends) + 1])
    return first, text[first[:-1]]


def runs_of(h: np.ndarray, first: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the hash, the first sentence and the end of the shortest runs that start or end at each sentence."""
    none = np.empty(0, np.int64)
    if len(text) < MIN_SENTENCES:
        return none, none, none, none
    start, end = np.searchsorted(text, text), np.searchsorted(text, text, "right")
    at = np.arange(len(text))
    to = np.maximum(np.searchsorted(first, first[:-1] + MIN_WORDS), at + MIN_SENTENCES)
    since = np.minimum(np.searchsorted(first, first[1:] - MIN_WORDS, "right") - 1, at + 1 - MIN_SENTENCES)
    forth, back = to <= end, since >= start
    n = len(text) + 1
    run = np.unique(np.concatenate([at[forth] * n + to[forth], since[back] * n + at[back] + 1]))
    a, z = run // n, run % n
    halves = []
    for m in LANES:
        x = _mixed(h * np.uint64(m))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _powers(STEP, len(h))[:len(h)], dtype=np.uint64)])
        part = (sums[first[z]] - sums[first[a]]) * _powers(pow(STEP, -1, 1 << 64), len(h) + 1)[first[a]]
        halves.append(_mixed(part).view(np.int64))
    return halves[0], halves[1], a, z


def _chunks(b: dict) -> Iterator[tuple[int, int]]:
    """Rows of a batch in ranges of about CHUNK characters."""
    start, size = 0, 0
    for i, text in enumerate(b["text"]):
        if size and size + len(text) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(b["text"]):
        yield start, len(b["text"])


def _found(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Runs of the texts: halves of the hash, number of the text, first sentence in it, sentences."""
    h, text, _, _, stop = words_of(texts)
    first, of = sentences_of(h, text, stop)
    h1, h2, a, z = runs_of(h, first, of)
    return h1, h2, of[a], a - np.searchsorted(of, of[a]), z - a


def _keys(batches: Iterator[dict]) -> Iterator[dict]:
    """First half of the hash of every run."""
    for b in batches:
        for a, z in _chunks(b):
            yield {"h1": _found(b["text"][a:z])[0]}


def _runs(batches: Iterator[dict], bits: np.ndarray) -> Iterator[dict]:
    """Runs whose bit is set."""
    for b in batches:
        ids, rows = np.array(b["doc_id"], dtype=object), np.array(b["row"], dtype=np.int64)
        for a, z in _chunks(b):
            h1, h2, of, pos, size = _found(b["text"][a:z])
            slot = h1 & (SLOTS - 1)
            keep = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            of = of[keep] + a
            yield {"h1": h1[keep], "h2": h2[keep], "doc_id": ids[of].tolist(), "row": rows[of], "pos": pos[keep], "sentences": size[keep]}


def _bits(slots: DataFrame) -> np.ndarray:
    """SLOTS bits, set where ``slot`` occurs."""
    rows = (slots.groupBy(F.shiftright("slot", 15).alias("at"))
            .agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(BITS_A_ROW - 1)).alias("bits")).collect())
    bits = np.zeros(SLOTS // 8, dtype=np.uint8)
    for r in rows:
        bits[r["at"] * BITS_A_ROW // 8:][:BITS_A_ROW // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits


def dedup_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text left after removal, n_sentences, n_removed and removed_spans
    (start, end: characters of the original text).

    The first occurrence of a run is that of the smallest (doc_id, hash of the
    text, place); null ids come first.  Sentences are removed whole.  Rows equal
    in id and text are one document: they lose the same sentences.  A null text
    stays null, a text may become empty; no row is dropped.  Input columns
    named like the new ones are replaced, all others pass through whatever their names.
    """
    row = F.xxhash64(F.col(text))
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row.alias("row"), F.col(text).alias("text"))
    keyed = keyed.filter("text is not null")
    with passing(docs.sparkSession):
        twice = rows_from(keyed.select("text"), _keys, "h1 long", AT_ONCE).groupBy("h1").count().filter("count > 1")
        bits = docs.sparkSession.sparkContext.broadcast(_bits(twice.select(F.col("h1").bitwiseAND(SLOTS - 1).alias("slot"))))
        runs = stage(rows_from(keyed, lambda batches: _runs(batches, bits.value), RUN, AT_ONCE), "runs")
        place = F.struct("doc_id", "row", "pos")
        repeated = (runs.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                    .filter("first <> last").drop("last"))
        # stored, so that the join below is one of two exchanges, and Spark can split a run that very many texts share
        repeated = stage(repeated, "repeated")
        # one number a mark: place and length
        mark = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("sentences").cast("long"))
        marks = stage(runs.join(repeated, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
                      .groupBy("doc_id", "row").agg(F.collect_set(mark).alias("marks")), "marks", lasting=True)
    # all columns but the text in one, so that no name of theirs can clash
    others = [c for c in docs.columns if c != text]
    held = docs.select(F.struct(*others).alias("held") if others else F.lit(None).alias("held"), F.col(text).alias("text"),
                       F.col(doc_id).cast("long").alias("own_id"), row.alias("own_row"))
    # texts that surely have no mark stay where they are
    may, bare = parted(held, F.xxhash64("own_id", "own_row"), marks, F.xxhash64("doc_id", "row"))
    joined = may.join(marks, F.col("own_row").eqNullSafe(F.col("row")) & F.col("own_id").eqNullSafe(F.col("doc_id")), "left")
    joined = joined.select("held", "text", "marks").unionByName(
        bare.select("held", "text", F.lit(None).cast("array<bigint>").alias("marks")))
    fields = "text string, n_sentences int, n_removed int, removed_spans array<struct<start:int,end:int>>"
    out = with_columns_from(joined, ["text", "marks"], _remove, fields, drop=("marks",), at_once=AT_ONCE)
    new = ["n_sentences", "n_removed", "removed_spans"]
    kept = [F.col("text").alias(text) if c == text else F.col("held")[c].alias(c) for c in docs.columns if c not in new]
    return out.select(*kept, *new)


def _remove(texts: list, marks: list) -> dict[str, list]:
    out, total, removed, spans = list(texts), [], [], []
    plain = [t or "" for t in texts]
    for a, z in _chunks({"text": plain}):
        h, of, start, end, stop = words_of(plain[a:z])
        first, owner = sentences_of(h, of, stop)
        bounds = np.searchsorted(owner, np.arange(z - a + 1))
        for i in range(a, z):
            lo, hi = bounds[i - a], bounds[i - a + 1]
            total.append(int(hi - lo))
            cuts: list[dict] = []
            gone = np.zeros(hi - lo + 1, dtype=np.int64)
            for m in marks[i] or ():
                gone[m >> 32] += 1
                gone[(m >> 32) + (m & 0xFFFFFFFF)] -= 1
            lost = np.cumsum(gone)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]]))).reshape(-1, 2)
            for x, y in edges.tolist():
                cuts.append({"start": int(start[first[lo + x]]), "end": int(end[first[lo + y] - 1])})
            if cuts:
                kept = [0, *(p for c in cuts for p in (c["start"], c["end"])), len(plain[i])]
                out[i] = "".join(plain[i][p:q] for p, q in zip(kept[::2], kept[1::2]))
            removed.append(int(lost.sum()))
            spans.append(cuts)
    return {"text": out, "n_sentences": total, "n_removed": removed, "removed_spans": spans}
