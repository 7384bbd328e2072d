"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webdiag.session import materialize, plain_unions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, read by Spark (any file system)."""
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    It is what the session's ``spark.checkpoint.dir`` names. Where that is
    unset, a folder that the caller gave to ``setCheckpointDir`` is taken;
    without either there is no place that is known to be shared, so this fails.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get().rstrip("/")
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: later steps
    neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    plain_unions(spark)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read from
    there; for rows of numbers a fraction of what `cut` writes.
    ``webdiag.session.drop_intermediate`` deletes such tables."""
    plain_unions(df.sparkSession)
    shared_dir(df.sparkSession)  # fails where no folder is shared
    return materialize(df, name)


def whole_text(text: Column) -> Column:
    """The text as a string, null as the empty one."""
    return F.coalesce(text.cast("string"), F.lit(""))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` whose Python workers find this package where the driver
    found it, as jobs started without it on PYTHONPATH or --py-files need. A
    worker gives back what a task held when the task ends: it stays for later
    tasks, and for a while beside the workers of later stages."""
    _package_on_path(df.sparkSession)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Returns freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def _package_on_path(spark: SparkSession) -> None:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names for further columns of ``df``, each with as many
    underscores after it as tell it from all others (case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def batches_of(batch, size: int):
    """Slices of an Arrow batch of at most ``size`` rows."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def forget_newer(memo: dict) -> None:
    """Drops the newer half of a memory. Dicts keep the order of insertion, and
    what occurs often has come early."""
    for k in list(memo)[len(memo) // 2:]:
        del memo[k]


def groups_of(batches, keys: int):
    """Runs of rows that agree in the first ``keys`` columns, as lists of
    column slices; for partitions sorted by those columns."""
    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*[batch.column(k).to_pylist() for k in range(keys)]))
        begin = 0
        for at in range(len(rows)):
            if rows[at] != last:
                if held or at > begin:
                    if at > begin:
                        held.append(batch.slice(begin, at - begin))
                    yield last, held
                    held = []
                last, begin = rows[at], at
        held.append(batch.slice(begin))
    if held:
        yield last, held
