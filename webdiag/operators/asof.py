"""As-of lookup of frame positions in source-map segments (O4.1, O7.9–O7.11).

A position (url, line, col) resolves to the segment of the same url and
generated line with the greatest ``gen_col <= col``; segments of a line
are disjoint column ranges [gen_col, next_gen_col), the last one open.
Spark has no as-of join, so it is two equi-joins with a range condition:

1. column buckets of width ``W``: every segment is copied into the buckets
   its range overlaps, at most ``C`` of them; a position joins the copies
   of its own bucket on (url, line, bucket). A bucket holds at most W+1
   overlapping segments, so a minified file whose code sits on one
   generated line still spreads over many small join keys.
2. positions left unmatched by (1) join, on (url, line), only the *long*
   segments — those whose range reaches past their C copied buckets (the
   last, open segment of every line among them). A line has few of them
   (each spans more than C·W columns), so the lookup stays small, and the
   result is exact without an unbounded number of copies.

The lookup runs on distinct positions; joined back, a position hit by a third
of all frames is one skewed key that AQE's skew-join handling splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdiag.functions import frames as FR
from webdiag.operators.common import as_keys

DEFAULT_BUCKET_WIDTH = 256
DEFAULT_MAX_COPIES = 8

SEG_COLS = ("gen_col", "next_gen_col", "source", "orig_line", "orig_col", "name")
RESOLVED_COLS = ("r_source", "r_line", "r_col", "r_name")


@dataclass
class SplitSegments:
    """A segment table as the lookup reads it. ``operators.segment_store`` keeps
    one on disk, bucketed by the join keys, for many lookups."""
    copies: DataFrame  # s_url, s_line, gen_col…name, s_bucket
    long: DataFrame    # l_s_url, l_s_line, l_gen_col…l_name
    width: int         # of a column bucket


def split_segments(segments: DataFrame, bucket_width: int = DEFAULT_BUCKET_WIDTH,
                   max_copies: int = DEFAULT_MAX_COPIES) -> SplitSegments:
    """``segments(url, gen_line, gen_col…name)`` as the lookup reads them."""
    return SplitSegments(*_split_segments(segments, int(bucket_width), int(max_copies)), int(bucket_width))


def _split_segments(segments: DataFrame, W: int, C: int):
    """(bucket copies, long segments)."""
    seg = segments.select(F.col("url").alias("s_url"), F.col("gen_line").alias("s_line"), *SEG_COLS)
    lo = F.floor(F.col("gen_col") / W)
    hi = F.floor((F.col("next_gen_col") - 1) / W)  # null for the open last segment
    top = F.least(F.coalesce(hi, lo + (C - 1)), lo + (C - 1))
    copies = seg.select("*", F.explode(F.sequence(lo, F.greatest(lo, top))).alias("s_bucket"))
    long_ = seg.where(F.col("next_gen_col").isNull() | (hi > lo + (C - 1)))
    long_ = long_.select(*[F.col(c).alias("l_" + c) for c in long_.columns])
    return copies, long_


def _lookup(positions: DataFrame, segments: SplitSegments) -> DataFrame:
    """positions(url, line, col) + gen_col…name of the segment that holds
    each; nulls where none does."""
    copies, long_ = segments.copies, segments.long
    d = positions.select("url", "line", "col", F.floor(F.col("col") / segments.width).alias("_bucket"))
    in_seg = lambda c: (d.col >= c("gen_col")) & (c("next_gen_col").isNull() | (d.col < c("next_gen_col")))
    j1 = d.join(copies, (d.url == copies.s_url) & (d.line == copies.s_line) & (d._bucket == copies.s_bucket) &
                in_seg(lambda c: copies[c]), "left")
    j1 = j1.select(d.url, d.line, d["col"], *[copies[c] for c in SEG_COLS], copies.s_url.isNotNull().alias("_hit1"))
    j2 = j1.join(long_, (j1.url == long_.l_s_url) & (j1.line == long_.l_s_line) & ~j1._hit1 &
                 (j1["col"] >= long_.l_gen_col) & (long_.l_next_gen_col.isNull() | (j1["col"] < long_.l_next_gen_col)),
                 "left")
    pick = [F.when(j2._hit1, j2[c]).otherwise(j2["l_" + c]).alias(c) for c in SEG_COLS]
    return j2.select("url", "line", "col", *pick)


def resolve_positions(positions: DataFrame, segments: DataFrame | SplitSegments, bucket_width: int = DEFAULT_BUCKET_WIDTH,
                      max_copies: int = DEFAULT_MAX_COPIES) -> DataFrame:
    """positions(url, line, col) → + r_source, r_line, r_col, r_name (nulls
    when unresolved: no segment on the line at or before col, or the
    segment has no source). ``segments`` split already keep their own width
    and copies."""
    if not isinstance(segments, SplitSegments):
        segments = split_segments(segments, bucket_width, max_copies)
    r = _lookup(positions.select("url", "line", "col"), segments)
    ok = F.col("source").isNotNull()
    return r.select("url", "line", "col", F.col("source").alias("r_source"),
                    F.when(ok, F.col("orig_line")).alias("r_line"), F.when(ok, F.col("orig_col")).alias("r_col"),
                    F.when(ok, F.col("name")).alias("r_name"))


def resolve_frames(frames: DataFrame, segments: DataFrame | SplitSegments, bucket_width: int = DEFAULT_BUCKET_WIDTH,
                   max_copies: int = DEFAULT_MAX_COPIES) -> DataFrame:
    """frames(…, function_name, url, line, col, raw) → + resolved (bool),
    text (printed frame: the original position when the frame does not
    look minified or does not resolve) and r_source/r_line/r_col/r_name.
    The lookup column is ``col ?? 0``.

    Frames that are not gated never enter a shuffle here: the gated ones'
    distinct positions are looked up and joined back, the others are added
    as they are."""
    col0 = F.coalesce(F.col("col"), F.lit(0))
    gate = F.coalesce(FR.looks_minified(F.col("url"), F.col("line"), F.col("col")) & (F.col("line") >= 1) & (col0 >= 0),
                      F.lit(False))
    gated = frames.where(gate).withColumn("_lookup_col", col0.cast("bigint"))
    places = gated.select("url", "line", F.col("_lookup_col").alias("col")).distinct()
    hits = resolve_positions(places, segments, bucket_width, max_copies).where(F.col("r_source").isNotNull()).select(
        F.col("url").alias("_h_url"), F.col("line").alias("_h_line"), F.col("col").alias("_h_col"),
        F.col("r_source"), F.col("r_line"), F.col("r_col"), F.col("r_name"))
    found = gated.join(hits, (gated.url == hits._h_url) & (gated.line == hits._h_line) &
                       (gated._lookup_col == hits._h_col), "left").select(*[gated[c] for c in frames.columns], *RESOLVED_COLS)
    types = dict(found.dtypes)
    rest = frames.where(~gate).select("*", *[F.lit(None).cast(types[c]).alias(c) for c in RESOLVED_COLS])
    r = found.unionByName(rest)
    resolved = F.col("r_source").isNotNull()
    name = F.coalesce(F.col("r_name"), F.col("function_name"), F.lit(FR.UNKNOWN_NAME))
    frame = F.struct(*[F.col(c) for c in ("function_name", "url", "line", "col", "raw")])
    text = F.when(resolved, FR.resolved_to_string(name, F.col("r_source"), F.col("r_line"), F.col("r_col"))) \
        .otherwise(FR.frame_to_string(frame))
    return r.select(*frames.columns, resolved.alias("resolved"), text.alias("text"), *RESOLVED_COLS)


def _falsy(df: DataFrame, name: str):
    """JavaScript falsiness of a stack: null, '' and, in a VARIANT, null, 0 and false."""
    s = F.col(name)
    kind = df.schema[name].dataType.simpleString()
    if kind == "string":
        return s.isNull() | (s == "")
    if kind == "variant":
        t = F.schema_of_variant(s)
        return F.coalesce(s.isNull() | F.is_variant_null(s) | (t == "STRING") & (F.try_variant_get(s, "$", "string") == "")
                          | (t == "BOOLEAN") & ~F.try_variant_get(s, "$", "boolean")
                          | t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(s, "$", "double") == 0),
                          F.lit(False))
    return s.isNull()


def compress_with_maps(entries: DataFrame, segments: DataFrame | SplitSegments, keys=("capture_id", "seq"),
                       stack_col: str = "stack", bucket_width: int = DEFAULT_BUCKET_WIDTH, keep=None) -> DataFrame:
    """``compress_stacks`` with a resolver: adds ``stack_trace`` (array of
    printed frames, ``[]`` when nothing is kept, null for a falsy stack)
    and ``resolved_count``. Entry rows keep all their columns.
    ``keep(df, name)`` writes the frames, which the lookup reads three times."""
    from webdiag.operators.stacks import explode_frames
    keys = as_keys(keys)
    fr = explode_frames(entries, keys, stack_col)
    if keep is not None:
        fr = keep(fr, "frames")
    r = resolve_frames(fr, segments, bucket_width)
    per = r.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("frame_no", "text"))).alias("_fr"),
        F.count_if("resolved").alias("resolved_count"))
    per = per.select(*keys, F.transform("_fr", lambda x: x["text"]).alias("stack_trace"), "resolved_count")
    falsy = _falsy(entries, stack_col)
    out = entries.join(per, keys, "left")
    return out.select(*entries.columns,
                      F.when(falsy, F.lit(None)).otherwise(
                          F.coalesce(F.col("stack_trace"), F.array().cast("array<string>"))).alias("stack_trace"),
                      F.coalesce(F.col("resolved_count"), F.lit(0)).cast("bigint").alias("resolved_count"))
