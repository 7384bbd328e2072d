"""Console rollup: normalise → severity → noise → fingerprint → group/count
→ rank → top-k (SURVEY O2, O3.1–O3.3, O5.1–O5.2)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdiag.functions import console as C
from webdiag.operators.common import as_keys, first_present, top_k

ENTRY_FIELDS = ("level", "message", "source", "stack")


def normalize(entries: DataFrame, by=("capture_id",)) -> DataFrame:
    """Uniform entry columns from whichever raw fields exist:
    level = level ?? type ?? 'log'; message = text ?? message ?? '';
    source = source ?? url; stack = stackTrace ?? stack.
    ``seq`` (arrival order inside a capture) is required."""
    if "seq" not in entries.columns:
        raise ValueError("console entries need a 'seq' column (arrival order)")
    keys = as_keys(by)
    cols = [F.col(k) for k in keys] + [F.col("seq")]
    cols.append(first_present(entries, ["level", "type"], F.lit(C.DEFAULT_LEVEL)).alias("level"))
    msg = first_present(entries, ["text", "message"], F.lit(""))
    cols.append(msg.cast("string").alias("message"))
    cols.append(first_present(entries, ["source", "url"]).cast("string").alias("source"))
    if "stackTrace" in entries.columns or "stack" in entries.columns:
        cols.append(first_present(entries, ["stackTrace", "stack"]).alias("stack"))
    return entries.select(*cols)


def filter_severity(entries: DataFrame, severity: str = "error") -> DataFrame:
    return entries.where(C.severity_predicate(F.col("level"), severity))


def filter_severity_raw(entries: DataFrame, severity: str = "error") -> DataFrame:
    """The severity filter on the raw ``level``/``type`` columns, before
    normalisation, so a parquet scan takes it as a pushed filter:
    level ?? type ?? 'log' passes ⟺ level passes, or level is null and
    (type passes, or type is null and 'log' passes)."""
    lvl = F.col("level") if "level" in entries.columns else None
    typ = F.col("type") if "type" in entries.columns else None
    dflt = C.severity_predicate(F.lit(C.DEFAULT_LEVEL), severity)
    if lvl is None and typ is None:
        return entries.where(dflt)
    if lvl is None:
        lvl, typ = typ, None
    fallback = dflt if typ is None else (
        (typ.isNotNull() & C.severity_predicate(typ, severity)) | (typ.isNull() & dflt))
    return entries.where((lvl.isNotNull() & C.severity_predicate(lvl, severity)) | (lvl.isNull() & fallback))


def drop_noise(entries: DataFrame, patterns: Iterable[str] = C.NOISE_PATTERNS) -> DataFrame:
    return entries.where(~C.is_noise(F.col("message"), patterns))


def with_fingerprint(entries: DataFrame) -> DataFrame:
    return entries.withColumn("fingerprint", C.fingerprint(F.col("level"), F.col("message")))


def with_rank(entries: DataFrame) -> DataFrame:
    return entries.withColumn("severity_rank", C.severity_rank(F.col("level")))


def group_issues(entries: DataFrame, by=("capture_id",)) -> DataFrame:
    """One row per (by, fingerprint): count and the first entry.

    Partial aggregation runs before the shuffle on (by, fingerprint), so a
    fingerprint repeated across a third of all rows costs one row per map
    task. The representative is ``min_by(…, seq)``: first arrival wins,
    whichever partition it landed in."""
    keys = as_keys(by)
    rep_fields = [f for f in ENTRY_FIELDS if f in entries.columns]
    rep = F.struct(*[F.col(f) for f in rep_fields])
    # first arrival; equal seq (bad input) falls back to the text, so a
    # recomputed partition picks the same representative
    order = F.struct(F.col("seq"), F.col("message"), F.col("source") if "source" in entries.columns else F.lit(None))
    g = (entries.groupBy(*keys, "fingerprint")
         .agg(F.count(F.lit(1)).alias("count"),
              F.min("seq").alias("first_seq"),
              F.min_by(rep, order).alias("rep")))
    return g.select(*keys, "fingerprint", "count", "first_seq",
                    *[F.col(f"rep.{f}").alias(f) for f in rep_fields])


def _rank_groups(g: DataFrame, keys, limit) -> DataFrame:
    order = [F.col("severity_rank").desc(), F.col("count").desc(), F.col("first_seq").asc()]
    ranked = top_k(with_rank(g), keys, order, limit)
    cols = [*keys, "issue_no", "level", "message", "count", "source", "first_seq", "fingerprint"]
    if "stack" in ranked.columns:
        cols.append("stack")
    return ranked.select(*cols)


def error_rollup(entries: DataFrame, severity: str = "error", limit: int | None = 20,
                 by=("capture_id",), noise_patterns: Iterable[str] = C.NOISE_PATTERNS,
                 normalized: bool = False, first_entry: str = "join", many_captures: bool = False) -> DataFrame:
    """Ranked unique issues per capture: severity rank desc, count desc,
    first arrival asc; at most ``limit`` per capture.

    ``first_entry``: "join" aggregates count and first seq by hash and
    fetches the ≤ limit representatives per capture by a join back to the
    entries (a second scan, no sort of the entries); "min_by" keeps the
    first entry inside the one aggregation (a SortAggregate: strings in the
    buffer, sorted map-side). Both give the same rows: of entries with equal
    ``seq`` and fingerprint the one with the smallest (message, source).

    ``many_captures``: the issues kept are about as many as the entries, so the
    join back is never a broadcast (Spark would judge by the bytes of files,
    which rows much alike hardly fill).

    Output: by…, issue_no, level, message, count, source, first_seq,
    fingerprint[, stack]."""
    keys = as_keys(by)
    if normalized:
        e = filter_severity(entries, severity)
    else:
        e = normalize(filter_severity_raw(entries, severity), keys)
    e = with_fingerprint(drop_noise(e, noise_patterns))
    if first_entry == "min_by":
        return _rank_groups(group_issues(e, keys), keys, limit)
    if first_entry != "join":
        raise ValueError("first_entry must be 'min_by' or 'join'")
    # hash aggregation of count and first seq only, rank, then fetch the
    # (at most limit per capture) representatives by joining back
    # (the first entry's rank: int and bigint buffers keep this a hash aggregate)
    g = with_rank(e).groupBy(*keys, "fingerprint").agg(
        F.count(F.lit(1)).alias("count"), F.min("seq").alias("first_seq"),
        F.min_by("severity_rank", "seq").alias("severity_rank"))
    ranked = top_k(g, keys, [F.col("severity_rank").desc(), F.col("count").desc(),
                             F.col("first_seq").asc()], limit)
    rep_fields = [f for f in ENTRY_FIELDS if f in e.columns]
    reps = e.select(*keys, F.col("seq").alias("first_seq"), "fingerprint", *rep_fields)
    # of entries with equal seq the one of the smallest texts: grouped by the join's
    # keys in their order, so a sort-merge join's rows need no further sort
    place = [*keys, "first_seq", "fingerprint"]
    order = F.struct("message", *["source"] * ("source" in rep_fields))
    if many_captures:
        ranked = ranked.hint("merge")
    out = ranked.join(reps, place, "inner").groupBy(*place, "issue_no", "count").agg(
        F.min_by(F.struct(*rep_fields), order).alias("rep")).select(*place, "issue_no", "count", "rep.*")
    cols = [*keys, "issue_no", "level", "message", "count", "source", "first_seq", "fingerprint"]
    return out.select(*cols, *(["stack"] if "stack" in out.columns else []))
