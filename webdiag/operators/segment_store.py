"""Decoded source maps kept for many jobs (O4.1, O7.3).

The lookup reads segments as bucket copies and long segments
(``asof.split_segments``). The store keeps both as Parquet tables bucketed and
sorted by the keys of their joins, so a lookup shuffles its positions only: the
stored sides are read bucket by bucket as they lie. A bucket holds many small
keys — a (url, line, column bucket) has at most width + 1 overlapping segments —
so a bundle on a single line is spread over all buckets.

``add`` appends the segments of urls that the store lacks and leaves the others
alone; every url with segments has one in either table (the last one of a line
is open, so it is long), and each table is checked on its own, so an addition
that died between the two is completed by the next one.

A catalog may forget the tables (Spark's own one lives as long as its session);
``SegmentStore`` names them again from the folder, whose ``spec`` records width,
copies and number of buckets. Stores are told apart by their folders.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webdiag.operators import asof

COPY_KEYS = ("s_url", "s_line", "s_bucket")
LONG_KEYS = ("l_s_url", "l_s_line")
_SPEC = "width int, copies int, buckets int"


class SegmentStore:
    """A store at ``path`` (a folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.width, self.copies, self.buckets = spark.read.schema(_SPEC).json(f"{self.path}/spec").first()
        self._name = "webdiag_segments_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]

    @classmethod
    def create(cls, spark: SparkSession, path: str, width: int = asof.DEFAULT_BUCKET_WIDTH,
               copies: int = asof.DEFAULT_MAX_COPIES, buckets: int | None = None) -> SegmentStore:
        """An empty store; an existing one fails. ``buckets``: the session's
        shuffle partitions if not given (fewer would make Spark shuffle the
        stored side as well)."""
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.createDataFrame([(width, copies, buckets)], _SPEC).coalesce(1).write.json(f"{path.rstrip('/')}/spec")
        return cls(spark, path)

    def add(self, segments: DataFrame) -> None:
        """Append the segments(url, gen_line, gen_col…name) of urls not stored yet."""
        split = asof.split_segments(segments, self.width, self.copies)
        self._append("copies", split.copies, COPY_KEYS)
        self._append("long", split.long, LONG_KEYS)

    def split(self) -> asof.SplitSegments:
        """The stored segments, for ``asof.resolve_*`` and ``api.get_errors``."""
        return asof.SplitSegments(self._table("copies", COPY_KEYS), self._table("long", LONG_KEYS), self.width)

    def urls(self) -> DataFrame:
        """The urls stored: maps of the others are to be decoded."""
        return self._table("long", LONG_KEYS).select(F.col("l_s_url").alias("url")).distinct()

    def forget(self) -> None:
        """Take the tables out of the catalog; the files stay."""
        for kind in ("copies", "long"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name}_{kind}")

    def _append(self, kind: str, rows: DataFrame, keys) -> None:
        table = f"{self._name}_{kind}"
        if self._register(kind, keys):
            known = self.spark.table(table).select(F.col(keys[0]).alias("_known")).distinct()
            rows = rows.join(known, rows[keys[0]] == known["_known"], "left_anti")
        # dealt as the buckets are, so a bucket gets one file
        (rows.repartition(self.buckets, *keys).sortWithinPartitions(*keys).write.mode("append").format("parquet")
         .option("path", f"{self.path}/{kind}").bucketBy(self.buckets, *keys).sortBy(*keys).saveAsTable(table))
        self.spark.catalog.refreshTable(table)

    def _table(self, kind: str, keys) -> DataFrame:
        if not self._register(kind, keys):
            raise ValueError(f"nothing was added to the segment store at {self.path}")
        return self.spark.table(f"{self._name}_{kind}")

    def _register(self, kind: str, keys) -> bool:
        """Whether the table is there; one that the catalog forgot is named again."""
        table = f"{self._name}_{kind}"
        if self.spark.catalog.tableExists(table):
            return True
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return False
        fields = self.spark.read.parquet(f"{self.path}/{kind}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        by = ", ".join(keys)
        self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
                       f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}'")
        return True
