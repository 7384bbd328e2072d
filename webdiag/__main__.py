"""Command line: the two operations as batch jobs.

    python -m webdiag get-errors --payloads PATH --out DIR [--severity error|warning|all]
        [--limit 20] [--no-sourcemaps] [--map-files PATH --scripts PATH]
    python -m webdiag diagnose-element --out DIR [--no-box-model] [--single PATH]
        (--payloads PATH | --requests PATH --elements PATH [--dom-tokens PATH])

Inputs are parquet (a directory or file) or JSON lines (``*.json``/``*.jsonl``)
with the columns of ``webdiag.api``; outputs are parquet tables (``summary``,
``issues``/``elements`` with each element's issues, ``batch``, ``quarantine``) and the JSON envelopes as
text (``reports``). Under spark-submit the cluster's session is used.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from webdiag import api
from webdiag.session import drop_intermediate, get_spark, intermediate_count


def _read(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return spark.read.parquet(path)


def main(argv=None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="webdiag")
    sub = p.add_subparsers(dest="cmd", required=True)
    g = sub.add_parser("get-errors")
    g.add_argument("--payloads", required=True)
    g.add_argument("--out", required=True)
    g.add_argument("--severity", default="error", choices=["error", "warning", "all"])
    g.add_argument("--limit", type=int, default=20)
    g.add_argument("--no-sourcemaps", action="store_true")
    g.add_argument("--map-files")
    g.add_argument("--scripts")
    d = sub.add_parser("diagnose-element")
    d.add_argument("--payloads")
    d.add_argument("--requests")
    d.add_argument("--elements")
    d.add_argument("--dom-tokens")
    d.add_argument("--single")
    d.add_argument("--out", required=True)
    d.add_argument("--no-box-model", action="store_true")
    a = p.parse_args(argv)
    if a.cmd == "diagnose-element" and not (a.payloads or a.requests and a.elements):
        p.error("diagnose-element needs --payloads, or --requests with --elements")
    spark = spark or get_spark()
    before = intermediate_count(spark)
    out = a.out.rstrip("/")
    if a.cmd == "get-errors":
        r = api.get_errors(_read(spark, a.payloads), severity=a.severity, limit=a.limit,
                           resolve_sourcemaps=not a.no_sourcemaps,
                           map_files=_read(spark, a.map_files) if a.map_files else None,
                           scripts=_read(spark, a.scripts) if a.scripts else None)
        r.summary.write.mode("overwrite").parquet(f"{out}/summary")
        r.issues.drop("stack").write.mode("overwrite").parquet(f"{out}/issues")
        r.quarantine.write.mode("overwrite").parquet(f"{out}/quarantine")
        r.report.select("report").write.mode("overwrite").text(f"{out}/reports")
    else:
        read = lambda path: _read(spark, path) if path else None
        r = api.diagnose_element(read(a.requests), style_payloads=read(a.payloads), elements=read(a.elements),
                                 dom_tokens=read(a.dom_tokens), single=read(a.single),
                                 include_box_model=not a.no_box_model)
        r.elements.write.mode("overwrite").parquet(f"{out}/elements")
        r.batch.write.mode("overwrite").parquet(f"{out}/batch")
        r.quarantine.write.mode("overwrite").parquet(f"{out}/quarantine")
        r.report.select("report").write.mode("overwrite").text(f"{out}/reports")
    drop_intermediate(spark, before)


if __name__ == "__main__":
    main()
