"""Style filter and rules: the reference's 6 filter, 6 visibility and 8
layout tests, plus the rules and summaries it leaves untested."""

from pyspark.sql import functions as F

from fixtures import FADED_STYLES, elements
from webdiag.operators import audit


def issues_of(spark, style_maps):
    d = audit.detect_issues(elements(spark, style_maps)).orderBy("pos").collect()
    return [[i.asDict() for i in r.issues] for r in d]


def one(spark, styles):
    return issues_of(spark, [styles])[0]


def filtered(spark, styles, box=True):
    return audit.filter_styles(elements(spark, [styles]), box).collect()[0].styles


# --- filter (css-filter tests) ---------------------------------------------
def test_tiers(spark):
    r = filtered(spark, FADED_STYLES)
    assert {"opacity", "grid-row", "transform", "min-width"} <= set(r)  # tier 1 whatever the value
    assert r["color"] == "rgb(14, 99, 51)" and r["text-align"] == "center"  # tier 2 with something to say
    assert not {"box-shadow", "background", "-webkit-user-drag", "transition-delay", "hyphens"} & set(r)
    assert filtered(spark, {**FADED_STYLES, "background": "url(leaf.png)"})["background"] == "url(leaf.png)"


def test_other_properties_all_dropped(spark):
    assert filtered(spark, {"hyphens": "manual", "tab-size": "3", "caret-color": "green"}) == {}


def test_faded_element(spark):
    assert len(filtered(spark, FADED_STYLES)) == 18
    assert len(filtered(spark, FADED_STYLES, box=False)) == 13
    got = one(spark, FADED_STYLES)
    assert [(i["type"], i["property"], i["value"], i["severity"]) for i in got] == [("invisible", "opacity", "0", "high")]


# --- visibility --------------------------------------------------------------
def test_visibility_rules(spark):
    cases = [
        ({"opacity": "0", "display": "block", "visibility": "visible"}, ("opacity", "high")),
        ({"display": "none", "opacity": "1", "visibility": "visible"}, ("display", "high")),
        ({"visibility": "hidden", "display": "block", "opacity": "1"}, ("visibility", "high")),
        ({"visibility": "collapse"}, ("visibility", "high")),
        ({"overflow": "hidden", "width": "0px", "height": "19px", "opacity": "1"}, ("overflow+size", "high")),
        ({"opacity": "0.05", "display": "block", "visibility": "visible"}, ("opacity", "medium")),
        ({"clip-path": "inset(9px)"}, ("clip-path", "medium")),
        ({"pointer-events": "none"}, ("pointer-events", "low")),
    ]
    got = issues_of(spark, [c for c, _ in cases])
    for (styles, (prop, sev)), iss in zip(cases, got):
        assert any(i["property"] == prop and i["severity"] == sev for i in iss), (styles, iss)


def test_visible_element_has_no_issue(spark):
    assert one(spark, {"display": "block", "opacity": "1", "visibility": "visible", "overflow": "visible",
                       "width": "83px", "height": "19px"}) == []


def test_zero_size_value_prints_undefined(spark):
    got = one(spark, {"overflow": "hidden", "height": "0px"})
    v = [i for i in got if i["type"] == "clipped-zero-size"][0]["value"]
    assert v == "overflow:hidden with undefinedx0px"


def test_parse_float_like_javascript(spark):
    got = issues_of(spark, [{"opacity": " 0.0px"}, {"opacity": "-1"}, {"opacity": "abc"}, {"opacity": ".05"},
                            {"opacity": "1e-3"}])
    assert [[i["type"] for i in g] for g in got] == [["invisible"], ["nearly-invisible"], [], ["nearly-invisible"],
                                                      ["nearly-invisible"]]


# --- layout ------------------------------------------------------------------
def test_layout_rules(spark):
    base = {"position": "static", "z-index": "auto"}
    cases = [
        ({**base, "width": "0px", "height": "19px"}, "zero-width", True),
        ({**base, "width": "83px", "height": "0px"}, "zero-height", True),
        ({"position": "absolute", "top": "auto", "right": "auto", "bottom": "auto", "left": "auto",
          "width": "83px", "height": "19px", "z-index": "auto"}, "unanchored-positioned", True),
        ({"position": "absolute", "top": "0px", "right": "auto", "bottom": "auto", "left": "auto",
          "width": "83px", "height": "19px", "z-index": "auto"}, "unanchored-positioned", False),
        ({"position": "static", "z-index": "6", "width": "83px", "height": "19px"}, "ineffective-z-index", True),
        ({"position": "relative", "z-index": "6", "width": "83px", "height": "19px"}, "ineffective-z-index", False),
        ({**base, "display": "flex", "overflow": "hidden", "width": "83px", "height": "19px"},
         "flex-grid-overflow-hidden", True),
        ({**base, "display": "inline-flex", "overflow": "hidden"}, "flex-grid-overflow-hidden", False),
        ({**base, "width": "0px", "min-width": "0px"}, "zero-width", False),
        ({**base, "width": "0px", "max-width": "0px"}, "zero-width", False),
        ({**base, "height": "0px", "min-height": "0px"}, "zero-height", False),
        ({**base, "height": "0px", "max-height": "0px"}, "zero-height", True),
        ({"position": "fixed"}, "unanchored-positioned", True),
    ]
    got = issues_of(spark, [c for c, _, _ in cases])
    for (styles, typ, expect), iss in zip(cases, got):
        assert any(i["type"] == typ for i in iss) == expect, (styles, iss)


def test_clean_layout(spark):
    assert one(spark, {"display": "block", "position": "static", "z-index": "auto", "width": "311px",
                       "height": "19px", "overflow": "visible"}) == []


def test_issue_order_visibility_then_layout(spark):
    got = one(spark, {"display": "flex", "overflow": "hidden", "width": "0px", "height": "10px",
                      "pointer-events": "none", "position": "static", "z-index": "3"})
    assert [i["type"] for i in got] == ["clipped-zero-size", "unclickable", "flex-grid-overflow-hidden",
                                         "zero-width", "ineffective-z-index"]


# --- summaries -----------------------------------------------------------------
def test_element_summaries(spark):
    maps = [
        {"display": "block", "opacity": "1"},
        {"opacity": "0", "pointer-events": "none", "position": "static", "z-index": "2", "display": "none"},
    ]
    r = audit.element_report(elements(spark, maps)).orderBy("pos").collect()
    assert r[0].summary == "#el0: No obvious visual issues detected. display:block, opacity:1, visibility:?."
    assert r[1].summary == ("#el1: display:none, opacity:0 (likely cause); pointer-events:none; "
                            "z-index has no effect on position:static elements")


def test_batch_summary_and_top_issue(spark):
    maps = [{"pointer-events": "none"}, {"opacity": "0.05"}, {"display": "none"}, {"visibility": "hidden"}, {}]
    r = audit.element_report(elements(spark, maps))
    nf = spark.createDataFrame([("c1", 9, "#gone", {}, True, ["#g1"])],
                               "capture_id string, pos int, selector string, styles map<string,string>, "
                               "not_found boolean, suggestions array<string>")
    r2 = audit.element_report(elements(spark, maps).withColumn("not_found", F.lit(False))
                              .withColumn("suggestions", F.array().cast("array<string>")).unionByName(nf))
    b = audit.batch_report(r).collect()[0]
    assert b.summary == "5 elements diagnosed, 4 with issues. Top: #el2 display:none."
    b2 = audit.batch_report(r2).collect()[0]
    assert b2.summary == "6 elements diagnosed, 4 with issues, 1 not found. Top: #el2 display:none."
    nf_row = [x for x in r2.collect() if x.selector == "#gone"][0]
    assert nf_row.summary == "#gone: element not found. Closest matches: #g1"
    single = audit.batch_report(audit.element_report(elements(spark, [{}]))).collect()[0]
    assert single.summary == "1 element diagnosed, 0 with issues."


def test_box_model_dropped_after_rules(spark):
    r = audit.element_report(elements(spark, [FADED_STYLES]), include_box_model=False).collect()[0]
    assert not {"margin-top", "padding"} & set(r.styles) and "grid-row" in r.styles and r.n_issues == 1
