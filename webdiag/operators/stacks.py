"""Stack compression: split → parse → drop internal → first 3 → print
(SURVEY O7.1–O7.9, O5.3). Per-row array functions; no shuffle unless
frames are resolved through source maps (see ``webdiag.operators.asof``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webdiag.functions import frames as FR
from webdiag.operators.common import as_keys, posexplode_rows


def parsed_frames(df: DataFrame, stack_col: str = "stack") -> Column:
    """array<frame> of a stack column that is a newline-separated string,
    an array of strings, or an array of frame objects (structs). Blank
    strings and null objects are dropped; a falsy stack (null, '') → null."""
    dt = df.schema[stack_col].dataType
    s = F.col(stack_col)
    if isinstance(dt, T.StringType):
        arr = FR.parse_text_frames(F.split(s, "\n"))
        arr = F.when(s.isNull() | (s == ""), F.lit(None)).otherwise(arr)
    elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StringType):
        arr = FR.parse_text_frames(s)
    elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StructType):
        names = dt.elementType.fieldNames()
        arr = F.transform(s, lambda o: FR.object_frame(o, names))
    elif isinstance(dt, T.VariantType):
        arr = _variant_frames(s)
    else:
        raise TypeError(f"unsupported stack type {dt.simpleString()}")
    return F.filter(arr, lambda f: f.isNotNull())


def _variant_frames(s: Column) -> Column:
    """Frames of a VARIANT stack: a string (split on newlines) or an array
    of strings and frame objects. Any other shape gives no frames."""
    kind = F.schema_of_variant(s)
    text = F.try_variant_get(s, "$", "string")
    from_text = FR.parse_text_frames(F.split(text, "\n"))

    def one(e):
        k = F.schema_of_variant(e)
        g = lambda path, t="string": F.try_variant_get(e, path, t)
        obj = F.struct(F.coalesce(g("$.functionName"), g("$.name")).alias("function_name"),
                       F.coalesce(g("$.url"), g("$.scriptUrl"), g("$.source")).alias("url"),
                       F.coalesce(g("$.lineNumber", "bigint"), g("$.line", "bigint")).alias("line"),
                       F.coalesce(g("$.columnNumber", "bigint"), g("$.column", "bigint")).alias("col"),
                       F.lit(None).cast("string").alias("raw"))
        return (F.when(k == "STRING", FR.parse_text_frame(g("$")))
                .when(k.startswith("OBJECT"), obj))
    from_array = F.transform(F.try_variant_get(s, "$", "array<variant>"), one)
    return (F.when(kind == "STRING", F.when(text != "", from_text))
            .when(kind.startswith("ARRAY"), from_array))


def kept_frames(frames: Column) -> Column:
    """First 3 non-internal frames (unparsed text lines count too)."""
    return F.slice(F.filter(frames, lambda f: ~FR.is_internal(f)), 1, FR.KEEP_FRAMES)


def kept_stack_frames(df: DataFrame, stack_col: str = "stack") -> Column:
    """``kept_frames`` of a stack column. Of string frames only those kept are parsed."""
    dt = df.schema[stack_col].dataType
    if isinstance(dt, T.StringType):
        texts = F.split(F.nullif(F.col(stack_col), F.lit("")), "\n")
    elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StringType):
        texts = F.col(stack_col)
    else:
        return kept_frames(parsed_frames(df, stack_col))
    own = F.filter(F.transform(texts, FR.trimmed), lambda t: (t != "") & ~FR.is_internal_text(t))
    return FR.parse_text_frames(F.slice(own, 1, FR.KEEP_FRAMES))


def with_kept_frames(df: DataFrame, stack_col: str = "stack") -> DataFrame:
    return df.withColumn("frames", kept_stack_frames(df, stack_col))


def compress_stacks(df: DataFrame, stack_col: str = "stack") -> DataFrame:
    """Adds ``stack_trace`` array<string>: the printed kept frames; null when
    the stack is falsy or nothing is kept (no resolver)."""
    # the frames are the one element of an array, so they are made once
    printed = F.transform(F.array(kept_stack_frames(df, stack_col)),
                          lambda k: F.when(F.size(k) > 0, F.transform(k, FR.frame_to_string)))[0]
    return df.withColumn("stack_trace", printed)


def explode_frames(df: DataFrame, keys=("capture_id", "seq"), stack_col: str = "stack") -> DataFrame:
    """Long table of the kept frames: keys…, frame_no (1-based), fields."""
    keys = as_keys(keys)
    x = posexplode_rows(df, keys, kept_stack_frames(df, stack_col), "i", "f")
    return x.select(*keys, (F.col("i") + 1).cast("bigint").alias("frame_no"), "f.*")
