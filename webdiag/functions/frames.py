"""Stack-frame expressions: parse, internal test, print, minified test
(SURVEY O7.2, O7.4–O7.10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's for equal results) ---------
# "at NAME (URL:LINE:COL)" or "at URL:LINE:COL", not anchored at the start;
# \z for JavaScript's $ (Java's $ also matches before a final newline).
FRAME_RE = r"at\s+(?:(.+?)\s+\()?([^()\s]+?):(\d+):(\d+)\)?\z"
INTERNAL_RE = r"node_modules|webpack-internal"
MINIFIED_URL_RE = r"\.(min|bundle|chunk)\.js(\?|\z)|/dist/|/build/|/_next/static/chunks/"
MINIFIED_MIN_COLUMN = 200  # line 1 and a column beyond this looks minified
KEEP_FRAMES = 3
UNKNOWN_NAME = "?"
# ------------------------------------------------------------------------
TRIM_CHARS = " \t\n\x0b\f\r"  # ASCII whitespace (JavaScript trim also strips NBSP)
FRAME_WHOLE_RE = r"\A(?s:.*?)" + FRAME_RE  # a text with a frame, from its start

FRAME_TYPE = "struct<function_name:string,url:string,line:bigint,col:bigint,raw:string>"


def trimmed(s: Column) -> Column:
    return F.btrim(s, F.lit(TRIM_CHARS))


def parse_text_frames(texts: Column) -> Column:
    """array of string frames → array of frame structs; blank → null; no
    match → raw only. One search a text: its groups are put in the order
    line, column, url, name, which no space can confuse, after a space, with
    which no trimmed text begins."""
    cut = F.transform(F.transform(texts, trimmed), lambda t: F.struct(
        t.alias("raw"), F.split(F.regexp_replace(t, FRAME_WHOLE_RE, " $3 $4 $2 $1"), " ", 5).alias("p")))

    def frame(x):
        raw, p = x["raw"], x["p"]
        m = p[0] == ""
        return F.when(raw.isNull() | (raw == ""), F.lit(None).cast(FRAME_TYPE)).otherwise(F.struct(
            F.when(m, F.nullif(F.get(p, 4), F.lit(""))).alias("function_name"),
            F.when(m, F.get(p, 3)).alias("url"),
            F.when(m, F.get(p, 1).try_cast("bigint")).alias("line"),
            F.when(m, F.get(p, 2).try_cast("bigint")).alias("col"),
            raw.alias("raw")))
    return F.transform(cut, frame)


def parse_text_frame(s: Column) -> Column:
    """String frame → frame struct; blank → null; no match → raw only."""
    return parse_text_frames(F.array(s))[0]


def object_frame(o: Column, fields: list[str]) -> Column:
    """Object frame (struct with any of url/scriptUrl/source, lineNumber/line,
    columnNumber/column, functionName/name) → frame struct; raw is null."""
    def pick(names, cast):
        cs = [o[n].cast(cast) for n in names if n in fields]
        if not cs:
            return F.lit(None).cast(cast)
        return cs[0] if len(cs) == 1 else F.coalesce(*cs)
    return F.when(o.isNull(), F.lit(None).cast(FRAME_TYPE)).otherwise(F.struct(
        pick(["functionName", "name"], "string").alias("function_name"),
        pick(["url", "scriptUrl", "source"], "string").alias("url"),
        pick(["lineNumber", "line"], "bigint").alias("line"),
        pick(["columnNumber", "column"], "bigint").alias("col"),
        F.lit(None).cast("string").alias("raw")))


def is_internal(f: Column) -> Column:
    s = F.concat(F.coalesce(f["url"], F.lit("")), F.lit(" "), F.coalesce(f["function_name"], F.lit("")),
                 F.lit(" "), F.coalesce(f["raw"], F.lit("")))
    return s.rlike(INTERNAL_RE)


def is_internal_text(t: Column) -> Column:
    """``is_internal`` of a string frame, before it is parsed: its url and
    name are parts of the text."""
    return reduce(lambda a, b: a | b, [t.contains(mark) for mark in INTERNAL_RE.split("|")])


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def frame_to_string(f: Column) -> Column:
    """Printed frame: raw when it has no url; ``at NAME (url:line:col)`` when
    url and line are known (col defaults 0); else raw or ``at NAME``."""
    name = F.coalesce(f["function_name"], F.lit(UNKNOWN_NAME))
    full = F.concat(F.lit("at "), name, F.lit(" ("), f["url"], F.lit(":"), f["line"].cast("string"),
                    F.lit(":"), F.coalesce(f["col"], F.lit(0)).cast("string"), F.lit(")"))
    return (F.when(_truthy(f["raw"]) & ~_truthy(f["url"]), f["raw"])
            .when(_truthy(f["url"]) & f["line"].isNotNull(), full)
            .otherwise(F.coalesce(f["raw"], F.concat(F.lit("at "), name))))


def resolved_to_string(name: Column, source: Column, line: Column, col: Column) -> Column:
    return F.concat(F.lit("at "), name, F.lit(" ("), source, F.lit(":"), line.cast("string"),
                    F.lit(":"), col.cast("string"), F.lit(")"))


def looks_minified(url: Column, line: Column, col: Column) -> Column:
    """Gate for map resolution; no url → false."""
    by_url = url.rlike(MINIFIED_URL_RE)
    by_pos = (line == 1) & (col > MINIFIED_MIN_COLUMN)
    return _truthy(url) & F.coalesce(by_url | by_pos, by_url, F.lit(False))
