"""Visibility and layout rules over a style map (O8.V1–V7, O8.L1–L5, O8.9).

Each rule yields an issue struct or null; ``issues(styles)`` keeps the
non-null ones in rule order. Rules read only tier-1 properties, so they
give the same result on a raw or a filtered map.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webdiag.functions.css import parse_float

# --- fixed values (must equal the reference's for equal results) ---------
NOTE_FLEX_OVERFLOW = "overflow:hidden on a flex/grid container can clip children unexpectedly"
NOTE_UNANCHORED = "position:{} with no top/right/bottom/left (element position depends on default flow)"
NOTE_Z_INDEX = "z-index has no effect on position:static elements"
ISSUE_SEVERITY_RANK = {"high": 3, "medium": 2, "low": 1}  # anything else 0
# ------------------------------------------------------------------------

ISSUE_TYPE = "struct<type:string,property:string,value:string,severity:string,note:string>"


def _issue(type_: str, prop: str, value: Column, severity: str, note: Column | None = None) -> Column:
    return F.struct(F.lit(type_).alias("type"), F.lit(prop).alias("property"),
                    value.cast("string").alias("value"), F.lit(severity).alias("severity"),
                    (note if note is not None else F.lit(None).cast("string")).alias("note"))


def _truthy(v: Column) -> Column:
    """JavaScript truthiness of a string value: present and non-empty."""
    return v.isNotNull() & (v != "")


def _not_eq(v: Column, lit: str) -> Column:
    """``v !== lit`` where a missing value counts as different."""
    return ~v.eqNullSafe(F.lit(lit))


class Rule:
    """One rule: when ``fired`` (never null), the issue (type, property,
    value, severity, note). Severity and note text are fixed per rule."""

    def __init__(self, fired: Column, type_: str, prop: str, value: Column, severity: str,
                 note: Column | None = None):
        self.fired = F.coalesce(fired, F.lit(False))
        self.type, self.prop, self.value, self.severity, self.note = type_, prop, value, severity, note

    def issue(self, value: Column | None = None) -> Column:
        return _issue(self.type, self.prop, self.value if value is None else value, self.severity, self.note)


def rule_specs(styles: Column) -> list[Rule]:
    """The 12 rules in reference order (visibility V1–V7, layout L1–L5)."""
    g = styles.getItem
    display, visibility, opacity = g("display"), g("visibility"), g("opacity")
    overflow, width, height = g("overflow"), g("width"), g("height")
    clip_path, pointer, position, z = g("clip-path"), g("pointer-events"), g("position"), g("z-index")
    op, w, h = parse_float(opacity), parse_float(width), parse_float(height)
    undefined = F.lit("undefined")
    anchored = None
    for side in ("top", "left", "right", "bottom"):
        v = g(side)
        t = _truthy(v) & (v != "auto")
        anchored = t if anchored is None else (anchored | t)
    return [
        Rule(display == "none", "hidden", "display", F.lit("none"), "high"),
        Rule(visibility.isin("hidden", "collapse"), "hidden", "visibility", visibility, "high"),
        Rule(op == 0, "invisible", "opacity", F.lit("0"), "high"),
        Rule((op != 0) & (op < 0.1), "nearly-invisible", "opacity", opacity, "medium"),
        Rule(_truthy(clip_path) & (clip_path != "none"), "clipped", "clip-path", clip_path, "medium"),
        Rule((overflow == "hidden") & ((w == 0) | (h == 0)), "clipped-zero-size", "overflow+size",
             F.concat(F.lit("overflow:hidden with "), F.coalesce(width, undefined), F.lit("x"),
                      F.coalesce(height, undefined)), "high"),
        Rule(pointer == "none", "unclickable", "pointer-events", F.lit("none"), "low"),
        Rule(display.isin("flex", "grid") & (overflow == "hidden"), "flex-grid-overflow-hidden", "overflow",
             F.lit("hidden"), "low", F.lit(NOTE_FLEX_OVERFLOW)),
        Rule((w == 0) & _not_eq(g("min-width"), "0px") & _not_eq(g("max-width"), "0px"),
             "zero-width", "width", width, "high"),
        Rule((h == 0) & _not_eq(g("min-height"), "0px"), "zero-height", "height", height, "high"),
        Rule(position.isin("absolute", "fixed") & ~F.coalesce(anchored, F.lit(False)),
             "unanchored-positioned", "position", position, "low",
             F.format_string(NOTE_UNANCHORED.replace("{}", "%s"), position)),
        Rule(_truthy(z) & (z != "auto") & (position == "static"), "ineffective-z-index", "z-index", z, "low",
             F.lit(NOTE_Z_INDEX)),
    ]


def rule_columns(styles: Column) -> list[Column]:
    """Per rule: the issue struct, or null when the rule does not fire."""
    return [F.when(r.fired, r.issue()) for r in rule_specs(styles)]


def issues(styles: Column) -> Column:
    """array<issue> in rule order (visibility rules, then layout rules)."""
    return F.filter(F.array(*rule_columns(styles)), lambda x: x.isNotNull())


def issue_rank(severity: Column) -> Column:
    e = None
    for k, v in ISSUE_SEVERITY_RANK.items():
        e = F.when(severity == k, v) if e is None else e.when(severity == k, v)
    return e.otherwise(0)
