"""Computed-style expressions: property tiers, box-model keys, parseFloat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's for equal results) ---------
# Tier 1: always kept.
TIER1 = (
    "display", "visibility", "opacity", "position", "z-index", "width", "height",
    "min-width", "max-width", "min-height", "max-height", "overflow", "overflow-x",
    "overflow-y", "top", "right", "bottom", "left", "flex", "flex-direction",
    "flex-wrap", "flex-grow", "flex-shrink", "flex-basis", "align-items",
    "align-self", "justify-content", "justify-self", "grid-template-columns",
    "grid-template-rows", "grid-column", "grid-row", "transform", "clip-path",
    "clip", "margin", "margin-top", "margin-right", "margin-bottom", "margin-left",
    "padding", "padding-top", "padding-right", "padding-bottom", "padding-left",
    "border", "border-width", "border-style", "border-color", "box-sizing",
    "pointer-events",
)
# Tier 2: kept unless the value is one of DULL_VALUES.
TIER2 = (
    "color", "background-color", "background", "font-size", "font-weight",
    "line-height", "text-align", "cursor", "box-shadow", "outline",
)
DULL_VALUES = (
    "rgba(0, 0, 0, 0)", "transparent", "none", "normal", "auto", "rgb(0, 0, 0)",
    "0px", "inherit", "initial",
)
# Dropped from the reported styles when include_box_model is false.
BOX_MODEL = (
    "margin", "margin-top", "margin-right", "margin-bottom", "margin-left",
    "padding", "padding-top", "padding-right", "padding-bottom", "padding-left",
    "border", "border-width",
)
# JavaScript parseFloat: the longest leading decimal number, else NaN (null).
PARSE_FLOAT_RE = r"^\s*([+-]?(?:Infinity|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))"
# ------------------------------------------------------------------------


def keep_property(k: Column, v: Column) -> Column:
    return k.isin(list(TIER1)) | (k.isin(list(TIER2)) & ~F.coalesce(v.isin(list(DULL_VALUES)), F.lit(False)))


def filter_styles_map(styles: Column) -> Column:
    """Tier-1 keys, plus tier-2 keys with a non-default value (O8.1–O8.3)."""
    return F.map_filter(styles, keep_property)


def drop_box_model(styles: Column) -> Column:
    return F.map_filter(styles, lambda k, v: ~k.isin(list(BOX_MODEL)))


def parse_float(v: Column) -> Column:
    """Numeric prefix of a CSS value as double; null where JS gives NaN."""
    return F.regexp_extract(v, PARSE_FLOAT_RE, 1).try_cast("double")
