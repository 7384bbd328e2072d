"""Style audit: filter computed styles, run the rules, summarise per
element and per batch (SURVEY O8, O9.1–O9.4, O3.5–O3.6).

Element rows are independent, so filtering, rules and element summaries
are narrow projections (no shuffle); the batch report is one grouped
aggregate on the capture key with partial aggregation before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webdiag.functions import css, rules
from webdiag.operators.common import as_keys, posexplode_rows


def filter_styles(elements: DataFrame, include_box_model: bool = True) -> DataFrame:
    s = css.filter_styles_map(F.col("styles"))
    if not include_box_model:
        s = css.drop_box_model(s)
    return elements.withColumn("styles", s)


def style_rows(elements: DataFrame, include_box_model: bool = True, keys=("capture_id", "selector")) -> DataFrame:
    """Long form of the filtered styles: keys…, property, value — explode
    then filter rows, which stays in whole-stage codegen (``map_filter``
    runs an interpreted lambda per map entry)."""
    keys = as_keys(keys)
    # ``explode`` would have Spark make the map once more, to test its size
    x = elements.select(*keys, F.explode_outer("styles").alias("property", "value")).where(F.col("property").isNotNull())
    keep = css.keep_property(F.col("property"), F.col("value"))
    if not include_box_model:
        keep = keep & ~F.col("property").isin(list(css.BOX_MODEL))
    return x.where(keep)


def detect_issues(elements: DataFrame) -> DataFrame:
    """Adds ``issues`` (array of issue structs, rule order). Not-found rows
    (``not_found`` true) get an empty array."""
    iss = rules.issues(F.col("styles"))
    if "not_found" in elements.columns:
        iss = F.when(F.coalesce(F.col("not_found"), F.lit(False)),
                     F.array().cast(f"array<{rules.ISSUE_TYPE}>")).otherwise(iss)
    return elements.withColumn("issues", F.coalesce(iss, F.array().cast(f"array<{rules.ISSUE_TYPE}>")))


def element_issues(elements: DataFrame, keys=("capture_id", "selector")) -> DataFrame:
    """Long form: one row per issue, ``issue_no`` 1-based in rule order."""
    keys = as_keys(keys)
    d = detect_issues(elements)
    x = posexplode_rows(d, keys, F.col("issues"), "i", "issue")
    return x.select(*keys, (F.col("i") + 1).cast("bigint").alias("issue_no"), "issue.*")


def not_found_summary(selector: Column, suggestions: Column) -> Column:
    """O9.3 summary of a selector that matched nothing."""
    return F.when(F.coalesce(F.array_size(suggestions), F.lit(0)) > 0,
                  F.concat(selector, F.lit(": element not found. Closest matches: "),
                           F.array_join(suggestions, ", "))) \
        .otherwise(F.concat(selector, F.lit(": element not found, no similar selectors detected.")))


def _static_report_columns(styles: Column, selector: Column):
    """(n_issues, summary, top) of a found element, straight from the rule
    conditions: each rule's severity and note text are fixed, so the
    summary parts and the top issue are concat_ws / coalesce over the 12
    rules — no array functions, all inside whole-stage codegen."""
    specs = rules.rule_specs(styles)
    pv = lambda r: F.concat(F.lit(r.prop + ":"), r.value)
    high = [r for r in specs if r.severity == "high"]
    other = [r for r in specs if r.severity != "high"]
    any_of = lambda rs: reduce(lambda a, b: a | b, [r.fired for r in rs])
    n = reduce(lambda a, b: a + b, [r.fired.cast("bigint") for r in specs])
    high_part = F.when(any_of(high), F.concat(
        F.concat_ws(", ", *[F.when(r.fired, pv(r)) for r in high]), F.lit(" (likely cause)")))
    other_part = F.when(any_of(other), F.concat_ws("; ", *[
        F.when(r.fired, r.note if r.note is not None else pv(r)) for r in other]))
    clean = F.concat(selector, F.lit(": No obvious visual issues detected. display:"),
                     F.coalesce(styles.getItem("display"), F.lit("?")), F.lit(", opacity:"),
                     F.coalesce(styles.getItem("opacity"), F.lit("?")), F.lit(", visibility:"),
                     F.coalesce(styles.getItem("visibility"), F.lit("?")), F.lit("."))
    summary = F.when(n == 0, clean).otherwise(
        F.concat(selector, F.lit(": "), F.concat_ws("; ", high_part, other_part)))
    # first issue of the highest severity: rules by severity, then rule order
    by_rank = sorted(specs, key=lambda r: -rules.ISSUE_SEVERITY_RANK.get(r.severity, 0))
    top = F.coalesce(*[F.when(r.fired, r.issue()) for r in by_rank])
    return n, summary, top


def element_report(elements: DataFrame, include_box_model: bool = True) -> DataFrame:
    """One row per element: filtered styles, issues, n_issues, summary, top
    issue, is_not_found.

    Input: capture_id, pos, selector, styles map, [not_found, suggestions].
    The rules and the summary read only tier-1 properties, which the filter
    keeps as they are, so they run on the captured map directly; the
    filtered ``styles`` column is only computed where it is used."""
    e = elements
    nf = F.coalesce(F.col("not_found"), F.lit(False)) if "not_found" in e.columns else F.lit(False)
    sugg = F.col("suggestions") if "suggestions" in e.columns else F.array().cast("array<string>")
    n, found_summary, top = _static_report_columns(F.col("styles"), F.col("selector"))
    empty = F.array().cast(f"array<{rules.ISSUE_TYPE}>")
    out = e.select(
        "*", nf.alias("is_not_found"),
        F.when(nf, empty).otherwise(rules.issues(F.col("styles"))).alias("issues"),
        F.when(nf, not_found_summary(F.col("selector"), sugg)).otherwise(found_summary).alias("summary"),
        F.when(nf, F.lit(0).cast("bigint")).otherwise(n).alias("n_issues"),
        F.when(~nf, top).alias("top"))
    styles = css.filter_styles_map(F.col("styles"))
    return out.withColumn("styles", styles if include_box_model else css.drop_box_model(styles))


def batch_report(report: DataFrame, by=("capture_id",), order=("pos", "selector"),
                 captures: DataFrame | None = None) -> DataFrame:
    """One row per capture: counts and the O9.4 batch summary. ``captures``
    (keys only) adds captures whose reply held no element.

    Top issue = highest severity; ties → earliest element in ``order``, then
    earliest issue. ``min_by`` with a struct ordering keeps this a single
    grouped aggregate (partial before the shuffle)."""
    keys = as_keys(by)
    top = F.col("top")
    rank = rules.issue_rank(top["severity"])
    ordering = F.when(top.isNotNull(), F.struct((-rank).alias("r"), *[F.col(c) for c in order],
                                               top["property"].alias("p"), top["value"].alias("v")))
    g = report.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_elements"),
        F.count_if(F.col("n_issues") > 0).alias("n_with_issues"),
        F.count_if(F.col("is_not_found")).alias("n_not_found"),
        F.min_by(F.struct(F.col("selector").alias("selector"), top["property"].alias("property"),
                          top["value"].alias("value")), ordering).alias("top"))
    if captures is not None:
        g = captures.select(*keys).distinct().join(g, keys, "left").fillna(0, ["n_elements", "n_with_issues", "n_not_found"])
    n = F.col("n_elements")
    summary = F.concat(
        n.cast("string"), F.lit(" element"), F.when(n > 1, F.lit("s")).otherwise(F.lit("")),
        F.lit(" diagnosed, "), F.col("n_with_issues").cast("string"), F.lit(" with issues"),
        F.when(F.col("n_not_found") > 0, F.concat(F.lit(", "), F.col("n_not_found").cast("string"),
                                                  F.lit(" not found"))).otherwise(F.lit("")),
        F.when(F.col("top.selector").isNotNull() | F.col("top.property").isNotNull(),
               F.concat(F.lit(". Top: "), F.coalesce(F.col("top.selector"), F.lit("undefined")), F.lit(" "),
                        F.col("top.property"), F.lit(":"), F.coalesce(F.col("top.value"), F.lit("undefined"))))
        .otherwise(F.lit("")),
        F.lit("."))
    return g.select(*keys, "n_elements", "n_with_issues", "n_not_found", summary.alias("summary"))
