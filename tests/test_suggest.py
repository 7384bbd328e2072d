"""Element lookup and similar-selector suggestions (untested in the reference)."""

from webdiag.operators import reports, suggest


def tokens(spark, rows):
    return spark.createDataFrame(rows, "capture_id string, kind string, token string, doc_order bigint")


def test_suggestion_order_and_limit(spark):
    dom = tokens(spark, [("p", "id", "Submit-Button", 1), ("p", "id", "submit", 2), ("p", "id", "", 3),
                         ("p", "class", "btn", 4), ("p", "class", "btn-primary", 5), ("p", "class", "btn", 6),
                         ("p", "id", "header", 7), ("p", "class", "submit-row", 8), ("p", "id", "sub", 9)])
    miss = spark.createDataFrame([("p", "#submit-btn.btn")], "capture_id string, selector string")
    got = [r.suggestion for r in suggest.suggest_selectors(miss, dom).orderBy("rank").collect()]
    # ref length 10 ('submit-btn'); distance counts the # or . prefix; ties: ids first.
    # 'Submit-Button' neither contains nor is contained in 'submit-btn'.
    assert got == [".btn-primary", "#submit", "#sub", ".btn"]
    dom5 = tokens(spark, [("p", "class", f"btn{i}", i) for i in range(9)])
    assert suggest.suggest_selectors(miss, dom5).count() == 5


def test_empty_and_kind_rules(spark):
    dom = tokens(spark, [("p", "id", "", 1), ("p", "class", "nav", 2), ("q", "id", "nav", 3)])
    miss = spark.createDataFrame([("p", "#nav"), ("p", "div")], "capture_id string, selector string")
    assert suggest.suggest_selectors(miss, dom).count() == 0  # ids match ids only; '' dropped


def test_diagnose_with_misses(spark):
    req = spark.createDataFrame([("p", 0, "#main"), ("p", 1, "#mian"), ("p", 2, ".zz")],
                                "capture_id string, pos int, selector string")
    els = spark.createDataFrame([("p", "#main", {"display": "none"})],
                                "capture_id string, selector string, styles map<string,string>")
    dom = tokens(spark, [("p", "id", "main", 1), ("p", "id", "mian-x", 2)])
    report, batch = reports.diagnose(req, els, dom)
    by_sel = {r.selector: r.summary for r in report.collect()}
    assert by_sel["#main"] == "#main: display:none (likely cause)"
    assert by_sel["#mian"] == "#mian: element not found. Closest matches: #mian-x"
    assert by_sel[".zz"] == ".zz: element not found, no similar selectors detected."
    assert batch.collect()[0].summary == "3 elements diagnosed, 1 with issues, 2 not found. Top: #main display:none."


def test_batch_size_check(spark):
    req = spark.createDataFrame([("p", i, f"#s{i}") for i in range(21)], "capture_id string, pos int, selector string")
    assert [r.n_selectors for r in suggest.check_batch_size(req).collect()] == [21]


def test_diagnose_first_element_in_document_order(spark):
    req = spark.createDataFrame([("p", 0, ".item")], "capture_id string, pos int, selector string")
    els = spark.createDataFrame([("p", ".item", 7, {"display": "none"}), ("p", ".item", 2, {"opacity": "1"})],
                                "capture_id string, selector string, doc_order bigint, styles map<string,string>")
    report, batch = reports.diagnose(req, els)
    rows = report.collect()
    assert len(rows) == 1 and rows[0].styles == {"opacity": "1"}
    assert batch.collect()[0].summary == "1 element diagnosed, 0 with issues."


def _brute(missing, dom, k=5):
    import re
    out = {}
    for cap, selector in set(missing):
        want = [("id", t.lower()) for t in re.findall(r"#([\w-]+)", selector)] + [("class", t.lower()) for t in re.findall(r"\.([\w-]+)", selector)]
        ref = max((len(t) for _, t in want), default=0)
        first = {}
        for c, kind, token, order in dom:
            if c == cap and token and any(kind == kd and (t in token.lower() or token.lower() in t) for kd, t in want):
                first[kind, token] = min(order, first.get((kind, token), order))
        ranked = sorted((abs(len(t) + 1 - ref), kd == "class", o, ("#" if kd == "id" else ".") + t) for (kd, t), o in first.items())
        out[cap, selector] = [r[3] for r in ranked[:k]]
    return {x: v for x, v in out.items() if v}


def test_index_equals_brute_force(spark):
    """Tokens of all lengths, shorter than a trigram among them, on both sides."""
    import random
    rnd = random.Random(3)

    def token():
        return "".join(rnd.choice("aAbc-") for _ in range(rnd.choice([1, 1, 2, 2, 3, 4, 5, 8])))
    dom = [(rnd.choice("pqr"), rnd.choice(["id", "class"]), token(), k) for k in range(400)] + [("p", "id", "", 1), ("p", "id", None, 2)]
    missing = [(rnd.choice("pqs"), "".join(rnd.choice("#.") + token() for _ in range(rnd.randint(0, 3)))) for _ in range(60)]
    got = {}
    df = suggest.suggest_selectors(spark.createDataFrame(missing, "capture_id string, selector string"), tokens(spark, dom))
    for r in df.orderBy("rank").collect():
        got.setdefault((r.capture_id, r.selector), []).append(r.suggestion)
    assert got == _brute(missing, [d for d in dom if d[2]])


def test_hot_capture(spark):
    """One page with very many tokens and very many misses: no list of either."""
    from pyspark.sql import functions as F
    n, m = 200_000, 15_000
    hot = F.element_at(F.array(F.lit("hot")), (F.col("id") % 1 + 1).cast("int"))  # no constant: a key like any other
    cls = F.element_at(F.array(F.lit("class")), (F.col("id") % 1 + 1).cast("int"))
    dom = spark.range(n).select(hot.alias("capture_id"), cls.alias("kind"),
                                F.concat(F.lit("item-"), F.conv("id", 10, 36), F.lit("-box")).alias("token"), F.col("id").alias("doc_order"))
    miss = spark.range(m).select(hot.alias("capture_id"), F.concat(F.lit("."), F.conv(F.col("id") * 10 + 50_000, 10, 36),
                                                                               F.lit("-box")).alias("selector"))
    got = suggest.suggest_selectors(miss, dom)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "collect_set" not in plan
    assert got.groupBy("selector").count().count() == m  # each is held by item-…-box


def test_rejected_requests_are_rows(spark):
    from webdiag import api
    req = spark.createDataFrame([("big", i, f"#e{i}") for i in range(500)] + [("ok", 0, "#a")],
                                "capture_id string, pos int, selector string")
    els = spark.createDataFrame([("ok", "#a", {"opacity": "1"})], "capture_id string, selector string, styles map<string,string>")
    r = api.diagnose_element(req, elements=els)
    assert sorted((x.pos, x.selector) for x in r.rejected.collect()) == [(i, f"#e{i}") for i in range(500)]
    import json
    warned = [x for x in r.quarantine.collect()]
    assert len(warned) == 1 and json.loads(warned[0].raw) == [f"#e{i}" for i in range(21)]
