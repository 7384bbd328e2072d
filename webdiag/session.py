"""Session helpers: a configured SparkSession, the shared checkpoint folder
and a lineage cut that writes to it (never localCheckpoint)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Configuration a job of this library wants; applied only where the session
# (cluster) has not set the key already.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, app: str = "webdiag",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf.update({
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("WEBDIAG_DRIVER_MEMORY", "16g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    })
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain_unions(spark: SparkSession) -> None:
    """Keeps Spark 4.1 from joining the partitions of a union's inputs one by
    one: adaptive execution may have coalesced them to different numbers, and
    the query then fails with "Can't zip RDDs"."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: what the session's
    ``spark.checkpoint.dir`` names, else the folder given to
    ``setCheckpointDir``. Without either no folder is known to be shared."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


# folders written by materialize, by application
_WRITTEN: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` as parquet under the checkpoint folder
    and reading it back. Survives executor loss (the data is on shared
    storage) and lets several later jobs reuse one build. ``drop_intermediate``
    deletes what was written, once the results that read it are out."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def drop_intermediate(spark: SparkSession, keep: int = 0) -> None:
    """Delete the intermediate tables of this application written after the
    first ``keep``; ``intermediate_count`` gives that number beforehand."""
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths[keep:]:
        p = hadoop(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del paths[keep:]


def intermediate_count(spark: SparkSession) -> int:
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))
