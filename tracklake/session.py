"""Session helpers: one place for the Spark settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession


def _driver_memory(cap_gb: int = 16) -> str:
    """About 60 % of physical memory, at most ``cap_gb`` (local mode: the
    driver JVM is the whole cluster)."""
    try:
        with open("/proc/meminfo") as f:
            kb = int(next(line for line in f if line.startswith("MemTotal")).split()[1])
        return f"{max(1, min(cap_gb, int(kb / 1024 / 1024 * 0.6)))}g"
    except (OSError, StopIteration, ValueError):
        return "4g"


def get_spark(master: str | None = None, app: str = "tracklake",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster the master, memory and shuffle partitions come from
    spark-submit; memory is only chosen here for a local master, and shuffle
    partitions only where the caller names a number.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # checkpoint files of frames no longer referenced are deleted
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", _driver_memory())
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


# Session SQL settings the library's plans rely on.  Constraint propagation
# is off: with the wide projections of derived detector columns it makes
# the optimizer's constraint sets grow combinatorially (planning took tens of
# seconds for a plan that runs in one).
# The virtual machine never compiles a method of over 8000 bytes: the fused
# loop of a stage with nested frames or many columns would be interpreted,
# several times slower than the same operators unfused.
SQL_SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SQL_SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


_SHIPPED = "tracklake-package.zip"


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once a context, so that Python workers
    find it wherever the driver was started."""
    sc = spark.sparkContext
    if _SHIPPED in sc._python_includes:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tracklake-"), _SHIPPED)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may leave the setting out (tests); it then gets a
    scratch folder.  Elsewhere a folder of the driver's own would be lost data.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="tracklake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def reliable_checkpoint(df):
    """Cut lineage with a checkpoint in the shared folder, computing ``df`` once.

    An eager ``checkpoint()`` runs the plan for its count and again to write
    the files; persisting first makes the write read the cached blocks.
    Its files are deleted with the tables of a block of ``passing``.
    """
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint()
    cached.unpersist()
    if _PASSING:
        _PASSING[-1] += _files_of(out)
    return out


def _files_of(df) -> list[str]:
    """Where a checkpoint or a stored table is."""
    if hasattr(df, "_stored_at"):
        return [df._stored_at]
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    return [file.get()] if file.isDefined() else []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def give_up(df) -> None:
    """Deletes a checkpoint or a table made in a block of ``passing`` before the block ends."""
    for path in _files_of(df):
        for block in _PASSING:
            if path in block:
                block.remove(path)
                _delete(df.sparkSession, path)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session SQL settings for a block, ``__`` for a point in their names."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_PASSING: list[list[str]] = []   # paths of the tables of the open ``passing`` blocks


@contextmanager
def passing(spark: SparkSession):
    """Tables and checkpoints made inside are deleted at the end of the block, tables marked as lasting belong to the block around it;
    shuffle files go as soon as the job that wrote them has ended.

    What leaves the block must read lasting tables only.
    """
    checkpoint_dir(spark)
    _PASSING.append([])
    try:
        with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
            yield
    finally:
        for path in _PASSING.pop():
            _delete(spark, path)


def stored(df, lasting: bool = False, by: tuple[str, ...] = ()):
    """Cut lineage with a Parquet table in the shared folder, computing ``df`` once; those who read it decode only
    the columns they ask for.  Unlike a checkpoint it keeps no order of rows; it stays until the block of ``passing``
    ends, or, outside of one, until the folder is cleared.  ``by`` are columns whose values have folders of their own.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tracklake-stored-{uuid.uuid4().hex}"
    blocks = _PASSING[:-1] if lasting else _PASSING
    if blocks:
        blocks[-1].append(path)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table
