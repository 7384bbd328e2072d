"""Driver contract: entry() runs, every query has an oracle, and a sample of
queries equals its DuckDB oracle at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from webdiag.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["capture_id", "issue_no", "level"]
    assert df.count() > 0


def test_every_query_has_oracle():
    from webdiag.plans import catalog
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    def n(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}"
        return "\0" if v is None else str(v)
    return sorted(tuple(n(r[i]) for i in order) for r in rows), sorted(cols)


@pytest.mark.parametrize("name", ["error_rollup", "error_summary", "batch_summary", "stack_resolved",
                                  "selector_suggestions", "payload_quarantine", "map_segments"])
def test_oracle_parity_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    assert _norm([tuple(r) for r in df.collect()], df.columns) == \
        _norm(res.fetchall(), [d[0] for d in res.description])
