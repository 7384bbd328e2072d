"""Continuous rollup equals the batch rollup once the stream is drained."""

import os
import uuid

from pyspark.sql import functions as F

from fixtures import noisy_entries
from webdiag.operators import rollup
from webdiag.session import checkpoint_dir
from webdiag.streaming import rollup as SR


def test_stream_matches_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    e1 = noisy_entries(spark, "p1")
    e2 = noisy_entries(spark, "p2")
    e1.where("seq < 6").write.parquet(f"{src}/part=0")
    base = checkpoint_dir(spark)
    run = uuid.uuid4().hex[:12]
    out = os.path.join(base, f"stream-test-{run}", "out")
    ckpt = os.path.join(base, f"stream-test-{run}", "ckpt")
    stream = spark.readStream.schema(e1.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = SR.start(stream, str(out), str(ckpt), severity="all", limit=20)
    q.processAllAvailable()
    e1.where("seq >= 6").write.parquet(f"{src}/part=1")
    e2.write.parquet(f"{src}/part=2")
    q.processAllAvailable()
    q.stop()
    got = SR.latest_report(spark, str(out)).collect()
    want = rollup.error_rollup(e1.unionByName(e2), severity="all", limit=20).drop("stack").collect()
    key = lambda r: (r.capture_id, r.issue_no)
    assert [tuple(r[c] for c in ("capture_id", "issue_no", "message", "count", "first_seq"))
            for r in sorted(got, key=key)] == \
        [tuple(r[c] for c in ("capture_id", "issue_no", "message", "count", "first_seq"))
         for r in sorted(want, key=key)]


def test_stream_global_group(spark, tmp_path):
    src = str(tmp_path / "in")
    e = noisy_entries(spark, "p1").unionByName(noisy_entries(spark, "p2").withColumn("seq", F.col("seq") + 100))
    e.where("seq < 50").write.parquet(f"{src}/part=0")
    e.where("seq >= 50").write.parquet(f"{src}/part=1")
    base = os.path.join(checkpoint_dir(spark), f"stream-global-{uuid.uuid4().hex[:12]}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = SR.start(stream, f"{base}/out", f"{base}/ckpt", severity="all", limit=3, by=[])
    q.processAllAvailable()
    q.stop()
    got = sorted((r.issue_no, r.message, r["count"]) for r in SR.latest_report(spark, f"{base}/out").collect())
    want = sorted((r.issue_no, r.message, r["count"])
                  for r in rollup.error_rollup(e, severity="all", limit=3, by=[]).collect())
    assert got == want
