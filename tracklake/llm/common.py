"""Helpers shared by the corpus operators: shared-folder tables, gapless row numbers, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


ROW_GROUP = 16 << 20   # bytes of a row group of stored tables
TEXTS = 500            # texts that are Python objects at a time, where an operator has no number of its own
SLOTS = 1 << 24        # bits that say which rows may be wanted
_HELD: list[tuple[tuple[str, ...], Callable]] = []


def held_by(*modules: str):
    """Marks a cached function of tasks whose values are given up when a worker turns to another module's work."""
    def mark(cached):
        _HELD.append((modules, cached))
        return cached
    return mark


def _give_up_others(module: str) -> None:
    for owners, cached in _HELD:
        if module.rpartition(".")[2] not in owners:
            cached.cache_clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PASSING: list[list[str]] = []   # paths of the tables of the open ``passing`` blocks


@contextmanager
def passing(spark: SparkSession):
    """Tables staged inside are deleted at the end of the block; those marked as lasting belong to the block around it.

    What leaves the block must read lasting tables only.
    """
    _PASSING.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _PASSING.pop():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def stage(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder of the cluster and read it back.

    Cuts lineage: what follows survives the loss of executors, and a plan that
    uses the rows several times computes them once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tracklake-{name}-{uuid.uuid4().hex}"
    blocks = _PASSING[:-1] if lasting else _PASSING
    if blocks:
        blocks[-1].append(path)
    # small row groups: writers and readers of texts hold one each; zstd works on the heap, with no buffers beside it
    df.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parted(rows: DataFrame, key, wanted: DataFrame, wanted_key) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose key may be one of ``wanted``, and others that surely have none of its keys.

    One bit for each of SLOTS hashes; the words that have a bit set, at most SLOTS / 64
    rows whatever the input, go to all tasks.  A join that follows on the first part deals few
    other rows.
    """
    slot = lambda k: F.pmod(F.xxhash64(k, F.lit(12)), F.lit(SLOTS))
    bits = wanted.select(slot(wanted_key).alias("slot")).select(
        F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 AS int))").alias("bit"))
    words = F.broadcast(bits.groupBy(F.col("word").alias("_wanted_word")).agg(F.bit_or("bit").alias("_wanted_bits")))
    own = rows.withColumn("_own_slot", slot(key))
    hit = (F.shiftright("_own_slot", 6) == F.col("_wanted_word")) & (
        F.expr("shiftright(_wanted_bits, cast(_own_slot & 63 AS int)) & 1") == 1)
    return own.join(words, hit, "left_semi").drop("_own_slot"), own.join(words, hit, "left_anti").drop("_own_slot")


def with_columns_from(df: DataFrame, inputs: list[str], fn: Callable[..., dict[str, object]], fields: str,
                      drop: tuple[str, ...] = (), at_once: int = 0) -> DataFrame:
    """``df`` with columns computed batch by batch in Python (``mapInArrow``).

    ``fn`` gets one Python list per input column and returns one sequence per
    new field.  A column of ``df`` that has the name of a new field is replaced;
    all others pass through, but for those in ``drop``.  ``at_once`` bounds the
    rows that are Python objects at a time.
    """
    from pyspark.sql.types import StructType
    new = StructType.fromDDL(fields)
    kept = [f for f in df.schema.fields if f.name not in drop and f.name not in new.names]
    out_schema = StructType(kept + new.fields)
    arrow = arrow_schema(new)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_up_others(fn.__module__)
        for b in _slices(batches, at_once):
            cols = fn(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in inputs))
            arrays = [b.column(b.schema.get_field_index(n)) for n in names]
            arrays += [pa.array(cols[f.name], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, names=names + new.names)

    return df.select(*dict.fromkeys([*names, *inputs])).mapInArrow(run, out_schema)


def rows_from(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, object]]],
              schema: str, at_once: int = 0) -> DataFrame:
    """``mapInArrow`` over a whole partition: ``fn`` maps an iterator of column
    dictionaries to one of column dictionaries with any number of rows."""
    from pyspark.sql.types import StructType
    out = StructType.fromDDL(schema)
    arrow = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_up_others(fn.__module__)
        for cols in fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
                       for b in _slices(batches, at_once)):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not rows or len(b) <= rows:
            yield b
        else:
            yield from (b.slice(k, rows) for k in range(0, len(b), rows))


def arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def numbered(staged: DataFrame, name: str = "rid") -> tuple[DataFrame, int]:
    """Gapless numbers from 0 for the rows of a stored table, and the number of rows.

    Each task numbers its own rows; the offsets of the tasks come from one count
    per task (one row a task, so the driver's share is bounded by the number of
    tasks).  No shuffle, and no key that could be hot.
    """
    tagged = staged.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftright("_mid", 33)
    counts = sorted((r["p"], r["count"]) for r in tagged.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    spark = staged.sparkSession
    offs = spark.createDataFrame(offsets, "_p long, _off long")
    local = F.col("_mid").bitwiseAND((1 << 33) - 1)
    out = (tagged.withColumn("_p", part).join(F.broadcast(offs), "_p")
           .withColumn(name, F.col("_off") + local).drop("_mid", "_p", "_off"))
    return out, total


def added_rows(parts: DataFrame, dtype) -> dict:
    """Sum of the arrays of each row number: ``parts`` has (row int, part binary), an array each.

    What reaches the driver is one array a row number.
    """
    import numpy as np

    def add(batches: Iterator[dict]) -> Iterator[dict]:
        total = {}
        for b in batches:
            for i, part in zip(b["row"], b["part"]):
                r = np.frombuffer(part, dtype=dtype)
                total[i] = total[i] + r if i in total else r
        if total:
            yield {"row": list(total), "part": [r.tobytes() for r in total.values()]}

    rows = rows_from(parts.repartition("row"), add, "row int, part binary").collect()
    return {r["row"]: np.frombuffer(r["part"], dtype=dtype) for r in sorted(rows)}


def utf8(text) -> F.Column:
    return F.encode(text, "UTF-8")


def crc_of_id(col="doc_id") -> F.Column:
    """crc32 of the id written as decimal text."""
    return F.crc32(F.encode(F.col(col).cast("string"), "UTF-8"))
