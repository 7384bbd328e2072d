"""Small helpers shared by the operators."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_keys(by) -> list[str]:
    if by is None:
        return []
    if isinstance(by, str):
        return [by]
    return list(by)


def first_present(df: DataFrame, names: Sequence[str], default: Column | None = None) -> Column:
    """``a ?? b ?? default`` over the columns of ``names`` that exist."""
    cols = [F.col(n) for n in names if n in df.columns]
    if default is not None:
        cols.append(default)
    if not cols:
        return F.lit(None)
    return cols[0] if len(cols) == 1 else F.coalesce(*cols)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None,
          rank_col: str = "issue_no") -> DataFrame:
    """First ``k`` rows per ``by`` group in ``order`` (a total order), with
    their 1-based position in ``rank_col``.

    ``row_number() <= k``: Spark adds a partial WindowGroupLimit before the
    shuffle, so a hot group sends at most k rows per map task. A global
    top-k (``by == []``) runs the same plan on a constant key, so its one
    final task receives at most k rows per map task; a global ranking
    without a limit would put every row into one task and is refused."""
    by = list(by)
    if not by:
        if k is None:
            raise ValueError("a global ranking needs a limit")
        out = top_k(df.withColumn("_top_k_all", F.lit(0)), ["_top_k_all"], order, k, rank_col)
        return out.drop("_top_k_all")
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(rank_col, F.row_number().over(w))
    return out.where(F.col(rank_col) <= k) if k is not None else out


def posexplode_rows(df: DataFrame, keep: Sequence, array: Column, pos: str, value: str) -> DataFrame:
    """``select(*keep, posexplode(array))`` without the ``size(array) > 0``
    filter Spark infers for ``explode``: that filter is pushed below the
    projections and evaluates a costly array expression (a JSON parse, a
    text split) a second time. ``posexplode_outer`` + a null test on the
    position keeps it to one evaluation."""
    x = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return x.where(F.col(pos).isNotNull())


def where_computed(df: DataFrame, cond: Column) -> DataFrame:
    """``df.where(cond)`` for a condition on columns computed by costly
    expressions (JSON parsing). A plain filter is pushed below the
    projections and re-evaluates them inside the filter; selecting through a
    generator keeps one evaluation per row."""
    x = df.select("*", F.posexplode_outer(F.when(cond, F.array(F.lit(True)))).alias("_wc_pos", "_wc_hit"))
    return x.where(F.col("_wc_pos").isNotNull()).drop("_wc_pos", "_wc_hit")


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` whose Python workers find this package where the driver
    found it, as jobs started without it on PYTHONPATH or --py-files need."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return df.mapInArrow(function, schema)
