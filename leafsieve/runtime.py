"""Session helpers: the shared folder, and tables that cut lineage there."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all runs in one
    process, as in tests, is a temporary folder made; elsewhere RuntimeError asks for the setting.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = f"file://{tempfile.mkdtemp(prefix='leafsieve-')}"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for an application; they need not have it on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="leafsieve-"), "leafsieve-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


#: Whether a query's shuffle files go as soon as it ends. What is written is read from its files, so they are of no more use.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    This cuts lineage durably: a lost executor costs a reread, not a recomputation. Shuffle files of the
    write go with its end. The table's files go when the application ends, or earlier with :func:`release`.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/leafsieve-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafsieve_path = path
    for scope in _scopes[-1:]:
        scope.append(out)
    return out


def fresh_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing has; what is put there goes when the application ends."""
    path = f"{shared_dir(spark)}/leafsieve-{name}-{uuid.uuid4().hex}"
    fs, where = _file_system(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def measured(df: DataFrame, name: str, *what: Column) -> tuple[DataFrame, list]:
    """A table of :func:`materialize`, and aggregates of its rows, which are found as it is written."""
    seen = Observation()
    names = [f"m{k}" for k in range(len(what))]
    out = materialize(df.observe(seen, *(c.alias(n) for c, n in zip(what, names, strict=True))), name)
    return out, [seen.get[n] for n in names]


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A stretch of work: tables that are cut in it go at its end, but for those that are handed to what it gives."""
    _scopes.append([])
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        for table in _scopes.pop():
            if not any(table is k for k in kept):
                release(table)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize`; other frames are left alone."""
    path = getattr(df, "_leafsieve_path", None)
    if path:
        fs, where = _file_system(df.sparkSession, path)
        fs.delete(where, True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
