"""Token files of directly addressable codes.

An id is cut into one-byte chunks.  Level 0 holds the low chunk of every
token, level k the k-th chunk of those tokens that need it.  A bitmap per level
tells which of its tokens go on, and a directory holds the number of set bits
before every block of 512, so the place of a token on the next level is one
directory entry plus the bits of part of a block: any token is read without
decoding what stands before it.

A file is a Parquet table written by Spark, one row a segment of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_from
from .words import word_bpe

BLOCK = 512
SEGMENT_TOKENS = 1 << 18
SEGMENT = ("part int, segment int, first long, n_tokens long, doc_ids array<bigint>, doc_starts array<bigint>, "
           "payloads array<binary>, bitmaps array<binary>, ranks array<binary>")


def encode_levels(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Payload, bitmap and rank directory of each level."""
    payloads, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        payloads.append(rest.astype(np.uint8).tobytes())
        rest = rest >> 8
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), dtype=np.uint8)])
        per_block = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1)
        bitmaps.append(bits.tobytes())
        ranks.append(np.concatenate([[0], np.cumsum(per_block)]).astype("<u4").tobytes())
        if not more.any():
            return payloads, bitmaps, ranks
        rest = rest[more]


class Levels:
    """Random access to the tokens of a segment."""

    def __init__(self, payloads, bitmaps, ranks):
        self.payloads = [np.frombuffer(x, dtype=np.uint8) for x in payloads]
        self.bitmaps = [np.frombuffer(x, dtype=np.uint8) for x in bitmaps]
        self.ranks = [np.frombuffer(x, dtype="<u4") for x in ranks]

    def rank(self, level: int, i: int) -> int:
        """Set bits before bit ``i``."""
        block, bitmap = i // BLOCK, self.bitmaps[level]
        n = int(self.ranks[level][block])
        whole = bitmap[block * BLOCK // 8: i >> 3]
        n += int(np.bitwise_count(whole).sum())
        return n + (int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else n

    def token(self, i: int) -> int:
        value = 0
        for level, payload in enumerate(self.payloads):
            value |= int(payload[i]) << (8 * level)
            if not self.bitmaps[level][i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(level, i)
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Tokens ``start`` to ``end``: on every level they are one run."""
        out = np.zeros(end - start, dtype=np.uint32)
        at = np.arange(end - start)
        for level, payload in enumerate(self.payloads):
            if not len(at):
                break
            out[at] |= payload[start:end].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(self.bitmaps[level][start >> 3: (end + 7) >> 3], bitorder="little")
            more = bits[start & 7: (start & 7) + end - start].astype(bool)
            at = at[more]
            start = self.rank(level, start)
            end = start + len(at)
        return out


def _segments(batches: Iterator[dict], tokenizer: str, end_id: int) -> Iterator[dict]:
    """One row of SEGMENT at a time; a document is never cut between segments."""
    bpe = word_bpe(tokenizer)
    part, end = TaskContext.get().partitionId(), np.array([end_id], dtype="<u4").tobytes()
    held, doc_ids, size, first, segment = [], [], 0, 0, 0

    def row() -> dict:
        ids = np.frombuffer(b"".join(held), dtype="<u4")
        payloads, bitmaps, ranks = encode_levels(ids)
        starts = [0, *accumulate(len(h) // 4 for h in held)]
        return {k: [v] for k, v in dict(part=part, segment=segment, first=first, n_tokens=len(ids), doc_ids=doc_ids,
                                        doc_starts=starts, payloads=payloads, bitmaps=bitmaps, ranks=ranks).items()}

    for b in batches:
        for doc_id, text in zip(b["doc_id"], b["text"]):
            ids = bpe.encode(text or "") + end
            held.append(ids)
            doc_ids.append(doc_id)
            size += len(ids) // 4
            if size >= SEGMENT_TOKENS:
                yield row()
                held, doc_ids, first, size, segment = [], [], first + size, 0, segment + 1
    if held:
        yield row()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id",
                 text: str = "text") -> None:
    """Encode whole texts and write them, in ascending order of id, as a table of segments at ``path``.

    Null texts count as empty: their document holds the end id alone.  Null ids
    come first; rows with equal ids follow each other by checksum of the text,
    so repeated rows are kept, each as a document.  Other columns are not read.
    Sorting is a range shuffle, so a task holds a run of the ids.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    check = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    by = [F.col("doc_id"), F.col("_check")]
    ordered = rows.withColumn("_check", check).repartitionByRange(*by).sortWithinPartitions(*by)
    rows_from(ordered.drop("_check"), lambda bs: _segments(bs, tokenizer, end_id), SEGMENT).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a token table: doc_id, start (ids of all documents before it), ids (binary).

    The only rows that reach the driver are the number of ids of each part.
    """
    segments = spark.read.parquet(path)
    parts = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases = spark.createDataFrame(list(zip((p for p, _ in parts), accumulate([0] + [n for _, n in parts]))),
                                  "part int, base long")

    def documents(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for k in range(len(b["part"])):
                levels = Levels(b["payloads"][k], b["bitmaps"][k], b["ranks"][k])
                at, first = b["doc_starts"][k], b["first"][k] + b["base"][k]
                yield {"doc_id": b["doc_ids"][k], "start": [first + s for s in at[:-1]],
                       "ids": [levels.slice(s, e).astype("<u4").tobytes() for s, e in zip(at, at[1:])]}

    return rows_from(segments.join(F.broadcast(bases), "part"), documents, "doc_id long, start long, ids binary")


def read_ranges(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Tokens ``first`` to ``last`` (exclusive, counted from 0 in the document) of documents of a
    token table: doc_id, first, last, ids (binary), one row for each row of ``wanted`` (doc_id, first, last).

    Nothing but the places asked for is decoded.  Ranges end where their document ends; those that
    begin beyond it, or are empty or null, have no ids.  An id with several documents gives a row for each,
    an id without one gives none; null ids match each other.  Other columns of ``wanted`` are not read.
    The requests of one of its tasks for one segment go together, so neither a hot
    document nor a hot segment gathers all requests in one place.
    """
    table = spark.read.parquet(path)
    places = table.select("part", "segment", F.posexplode("doc_ids").alias("k", "doc_id"), "doc_starts").select(
        "part", "segment", F.col("doc_id").alias("id"), F.get("doc_starts", F.col("k")).alias("at"),
        F.get("doc_starts", F.col("k") + 1).alias("end"))
    asked = wanted.select(*(F.col(c).cast("long").alias(c) for c in ("doc_id", "first", "last")),
                          F.spark_partition_id().alias("task"))
    grouped = asked.join(places, F.col("doc_id").eqNullSafe(F.col("id"))).groupBy("part", "segment", "task").agg(
        F.collect_list(F.struct("doc_id", F.coalesce("first", F.lit(0)).alias("lo"), F.coalesce("last", F.lit(0)).alias("hi"),
                                "first", "last", "at", "end")).alias("asked"))

    def answers(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for asked, *stored in zip(b["asked"], b["payloads"], b["bitmaps"], b["ranks"]):
                levels = Levels(*stored)
                out = {k: [r[k] for r in asked] for k in ("doc_id", "first", "last")}
                out["ids"] = []
                for r in asked:
                    lo, hi = r["at"] + max(r["lo"], 0), min(r["at"] + r["hi"], r["end"])
                    out["ids"].append(levels.slice(lo, hi).astype("<u4").tobytes() if lo < hi else b"")
                yield out

    found = grouped.join(table.select("part", "segment", "payloads", "bitmaps", "ranks"), ["part", "segment"])
    return rows_from(found.drop("part", "segment", "task"), answers, "doc_id long, first long, last long, ids binary")
