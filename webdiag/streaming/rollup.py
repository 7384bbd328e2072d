"""Continuous console rollup.

Each micro-batch is reduced to its own partial groups and written as one load
of a ``RollupStore``, under the batch's number: nothing but the changed groups
is written, a replayed batch replaces itself, and Spark's state store holds
nothing, however long the stream runs. Reports merge the loads on read; loads
are compacted when their bytes have reached a share of the base's.

With ``time_col`` captures that had no entry for ``end_after`` seconds, counted
back from the newest entry stored, are set aside at compaction, so what
compactions rewrite stays as small as the live captures' groups. Their part of
the report stays, and a capture that goes on later is merged with it.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from webdiag.functions import console as C
from webdiag.operators.store import COMPACT_SHARE, RollupStore


def write_batch(entries: DataFrame, batch_id: int, store: RollupStore, time_col: str | None = None,
                end_after: float | None = None, compact_share: float = COMPACT_SHARE, noise_patterns=C.NOISE_PATTERNS) -> None:
    """foreachBatch body."""
    if store.add(batch_id, entries, time_col, noise_patterns):
        store.compact_if_large(compact_share, _ended_before(store, time_col, end_after))


def _ended_before(store: RollupStore, time_col: str | None, end_after: float | None):
    if time_col is None or end_after is None:
        return None
    newest = store.newest()
    return None if newest is None else newest - timedelta(seconds=end_after)


def latest_report(spark: SparkSession, out_dir: str, ended: bool = True) -> DataFrame:
    """Current top-k per capture; without ended captures when asked so."""
    return RollupStore(spark, out_dir).report(ended=ended)


def start(entries: DataFrame, out_dir: str, checkpoint_location: str, severity: str = "error",
          limit: int = 20, by=("capture_id",), trigger: dict | None = None, time_col: str | None = None,
          end_after: float | None = None, compact_share: float = COMPACT_SHARE):
    """Start the continuous rollup; returns the StreamingQuery."""
    spark = entries.sparkSession
    store = RollupStore.create(spark, out_dir, by, severity, limit)
    w = (entries.writeStream
         .foreachBatch(lambda df, bid: write_batch(df, bid, store, time_col, end_after, compact_share))
         .option("checkpointLocation", checkpoint_location))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
