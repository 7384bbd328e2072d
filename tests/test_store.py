"""Mergeable rollup: loads, replays, compaction, ended captures."""

import os
import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webdiag.operators import rollup
from webdiag.operators import store as ST
from webdiag.session import checkpoint_dir
from webdiag.streaming import rollup as SR

T0 = datetime(2024, 1, 1)
SCHEMA = "capture_id string, seq bigint, level string, message string, source string, at timestamp"


def entries(spark, days, captures=4, per_day=40, seed=1):
    """Entries of several days; every capture lives for one day only."""
    rnd = random.Random(seed)
    rows = []
    for d in days:
        for k in range(per_day):
            rows.append((f"d{d}-c{rnd.randrange(captures)}", d * 1000 + k, rnd.choice(["error", "warning", "log"]),
                         f"problem {rnd.randrange(6)} at {rnd.randrange(3)}", rnd.choice([None, "a.js", "b.js"]),
                         T0 + timedelta(days=d, seconds=k)))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def folder(spark):
    return os.path.join(checkpoint_dir(spark), f"store-{uuid.uuid4().hex[:12]}")


def rows(df):
    cols = ["capture_id", "issue_no", "level", "message", "count", "source", "first_seq", "fingerprint"]
    return sorted(tuple(r[c] for c in cols if c in df.columns) for r in df.collect())


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names}


def test_loads_in_any_order_equal_the_full_run(spark):
    store = ST.RollupStore.create(spark, folder(spark), severity="all", limit=5)
    for d in (2, 0, 1):
        assert store.add(d, entries(spark, [d], captures=1, seed=d).withColumn("capture_id", F.lit("one")))
    whole = entries(spark, [0], 1, seed=0).unionByName(entries(spark, [1], 1, seed=1)).unionByName(entries(spark, [2], 1, seed=2))
    want = rows(rollup.error_rollup(whole.withColumn("capture_id", F.lit("one")), severity="all", limit=5))
    assert want and rows(store.report()) == want
    store.compact()
    assert rows(store.report()) == want
    store.add(3, entries(spark, [3], seed=3))
    assert rows(store.report()) == sorted(want + rows(rollup.error_rollup(entries(spark, [3], seed=3), severity="all", limit=5)))


def test_adding_a_load_touches_nothing_else(spark):
    path = folder(spark)
    store = ST.RollupStore.create(spark, path, severity="all")
    store.add(0, entries(spark, [0]))
    store.compact()
    store.add(1, entries(spark, [1]))
    before = files(path)
    store.add(2, entries(spark, [2]))
    after = files(path)
    assert before.items() <= after.items()
    assert all("/loads/2/" in f for f in after.keys() - before.keys())


def test_replays_change_nothing(spark):
    path = folder(spark)
    store = ST.RollupStore.create(spark, path, severity="all")
    store.add(0, entries(spark, [0]))
    store.add(1, entries(spark, [1]))
    want = rows(store.report())
    store.add(1, entries(spark, [1]))  # before the compaction: written again
    assert rows(store.report()) == want
    store.compact()
    before = files(path)
    assert not store.add(1, entries(spark, [1])) and not store.add(0, entries(spark, [0]))
    assert files(path) == before and rows(store.report()) == want


def test_a_compaction_that_died_is_not_seen(spark):
    path = folder(spark)
    store = ST.RollupStore.create(spark, path, severity="all")
    store.add(0, entries(spark, [0]))
    store.compact()
    store.add(1, entries(spark, [1]))
    want = rows(store.report())
    # died before _DONE: its groups are there, the loads too
    store.groups().write.parquet(f"{path}/bases/2/groups")
    assert rows(store.report()) == want
    # died after _DONE: a load that is in the base is still there
    kept = entries(spark, [1])
    assert store.compact() == 2
    ST.partial_groups(kept, "all", ["capture_id"]).write.parquet(f"{path}/loads/1")
    assert rows(store.report()) == want


def test_ended_captures_leave_the_base(spark):
    path = folder(spark)
    store = ST.RollupStore.create(spark, path, severity="all")
    held = []
    for d in range(4):
        store.add(d, entries(spark, [d]), "at")
        store.compact(ended_before=T0 + timedelta(days=d))
        held.append(store.groups(ended=False).count())
    assert {r.capture_id[:2] for r in store.groups(ended=False).select("capture_id").collect()} == {"d3"}
    assert max(held) < 2 * min(held)  # flat
    whole = entries(spark, range(1))
    for d in range(1, 4):
        whole = whole.unionByName(entries(spark, [d]))
    assert rows(store.report()) == rows(rollup.error_rollup(whole, severity="all", limit=20))
    # an ended capture goes on: both parts count
    late = spark.createDataFrame([("d0-c0", 1, "error", "new one", None, T0 + timedelta(days=9))], SCHEMA)
    store.add(9, late, "at")
    assert rows(store.report()) == rows(rollup.error_rollup(whole.unionByName(late), severity="all", limit=20))


def test_compaction_by_size(spark):
    store = ST.RollupStore.create(spark, folder(spark), severity="all")
    assert not store.compact_if_large()
    store.add(0, entries(spark, [0]))
    assert store.compact_if_large()
    store.add(1, entries(spark, [1], per_day=2))
    assert not store.compact_if_large(share=5.0) and store.compact_if_large(share=0.01)


def test_empty_and_hot_loads(spark):
    store = ST.RollupStore.create(spark, folder(spark), by=[], severity="all", limit=3)
    with pytest.raises(ValueError):
        store.report()
    store.add(0, spark.createDataFrame([], SCHEMA))
    assert rows(store.report()) == []
    hot = spark.range(5000).select(F.lit("c").alias("capture_id"), F.col("id").alias("seq"), F.lit("error").alias("level"),
                                   F.lit("the same").alias("message"), F.lit(1).alias("count"), F.lit("x").alias("fingerprint"),
                                   F.lit(2).alias("last_time"))  # clashing names
    store.add(1, hot)
    store.add(2, hot.withColumn("seq", F.col("seq") - 10))
    assert [(r["count"], r["first_seq"]) for r in store.report().collect()] == [(10_000, -10)]


def test_stream_state_stays_flat_and_report_equals_batch(spark):
    base = folder(spark)
    whole = None
    for d in range(4):
        day = entries(spark, [d])
        day.coalesce(1).write.parquet(f"{base}/in/day={d}")
        whole = day if whole is None else whole.unionByName(day)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    q = SR.start(stream, f"{base}/out", f"{base}/ckpt", severity="all", time_col="at", end_after=3600.0, compact_share=0.0)
    q.processAllAvailable()
    state = [s for p in q.recentProgress for s in p["stateOperators"]]
    q.stop()
    assert state == []
    store = ST.RollupStore(spark, f"{base}/out")
    assert len({r.capture_id[:2] for r in store.groups(ended=False).select("capture_id").distinct().collect()}) == 1
    assert rows(SR.latest_report(spark, f"{base}/out")) == rows(rollup.error_rollup(whole, severity="all", limit=20))


def test_compactions_leave_texts_where_they_are(spark):
    path = folder(spark)
    store = ST.RollupStore.create(spark, path, severity="all")
    long = entries(spark, [0], per_day=20).withColumn("message", F.concat(F.col("seq").cast("string"), F.repeat(F.lit(" word"), 4000)))
    long = long.withColumn("capture_id", F.when(F.col("seq") % 2 == 0, F.col("capture_id")))  # null is a capture as well
    store.add(0, long)
    texts = files(f"{path}/texts")
    store.compact()
    store.add(1, long.withColumn("seq", F.col("seq") + 100).withColumn("message", F.concat(F.lit("1"), "message")))
    store.compact()
    whole = long.unionByName(long.withColumn("seq", F.col("seq") + 100).withColumn("message", F.concat(F.lit("1"), "message")))
    assert texts.items() <= files(f"{path}/texts").items()
    assert spark.read.parquet(f"{path}/bases/2/groups").columns == ["capture_id", *ST.NUMBERS]
    key = lambda r: tuple(map(str, r))
    want = rollup.error_rollup(whole, severity="all", limit=20, first_entry="min_by")
    assert sorted(rows_of(store.report()), key=key) == sorted(rows_of(want), key=key)


def rows_of(df):
    return [tuple(r[c] for c in ("capture_id", "issue_no", "level", "message", "count", "source", "first_seq", "fingerprint"))
            for r in df.collect()]


def test_texts_of_replaced_entries_are_dropped(spark):
    path = folder(spark)
    store = ST.RollupStore.create(spark, path, severity="all")
    e = spark.range(6).select(F.lit("c").alias("capture_id"), F.col("id").alias("seq"), F.lit("error").alias("level"),
                              F.concat(F.lit("problem "), F.col("id").cast("string")).alias("message"))
    for k in range(3):  # the same issues, each load earlier
        store.add(k, e.withColumn("seq", F.col("seq") - 10 * k))
        store.compact()
    assert spark.read.parquet(*store._text_folders()).count() == 6
    assert sorted((r["message"], r["count"], r["first_seq"]) for r in store.report().collect()) == [
        (f"problem {i}", 3, i - 20) for i in range(6)]
