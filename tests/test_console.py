"""Console rollup: the reference's 6 dedup tests plus fingerprint, tie,
total and summary cases it leaves untested."""

from pyspark.sql import functions as F

from fixtures import N_ENTRIES, NOISE, OLD_WARNING, PAINT_ERROR, PRICE_ERROR, SLOW_WARNING, STOCK_ERROR, noisy_entries
from webdiag.functions import console as C
from webdiag.operators import reports, rollup


def issues(spark, **kw):
    df = rollup.error_rollup(noisy_entries(spark), **kw)
    return [r.asDict() for r in df.orderBy("issue_no").collect()]


def test_repeated_errors_count_once(spark):
    got = issues(spark, severity="error", limit=20)
    assert [(i["message"], i["count"]) for i in got] == [(STOCK_ERROR, 5), (PRICE_ERROR, 2), (PAINT_ERROR, 1)]
    assert got[0]["source"] == "shelf.mjs"  # source wins over url
    assert got[1]["source"] == "https://seeds.example.org/prices"


def test_every_kind_of_noise_goes(spark):
    assert not {i["message"] for i in issues(spark, severity="all", limit=20)} & set(NOISE)


def test_severities_and_order(spark):
    assert {i["level"] for i in issues(spark, severity="error", limit=20)} == {"error"}
    warn = [(i["message"], i["count"]) for i in issues(spark, severity="warning", limit=20)]
    assert warn[3:] == [(SLOW_WARNING, 2), (OLD_WARNING, 1)]
    every = issues(spark, severity="all", limit=20)
    assert [i["message"] for i in every][:5] == [m for m, _ in warn] and every[5]["level"] == "info"


def test_limit(spark):
    assert [i["message"] for i in issues(spark, severity="all", limit=1)] == [STOCK_ERROR]


def test_summary_and_total(spark):
    _, s = reports.error_report(noisy_entries(spark), severity="error", limit=20)
    row = s.collect()[0]
    assert row["total_log_entries"] == N_ENTRIES and row["unique_issues"] == 3
    assert row["summary"] == f"3 unique issues (from {N_ENTRIES} total log entries). Top: {STOCK_ERROR}"


def test_summary_when_nothing_left(spark):
    e = spark.createDataFrame([("c", 0, "debug", "x")], "capture_id string, seq bigint, level string, text string")
    _, s = reports.error_report(e, severity="all")
    assert s.collect()[0]["summary"] == "No messages found in console."
    _, s = reports.error_report(e, severity="error")
    assert s.collect()[0]["summary"] == "No error messages found in console."


def test_fingerprint_normalisation(spark):
    rows = [("a at 0xDEADbeef",), ("at app.js:12:34",), ("id 123456 and 1234",), ("é12345 x",), ("x" * 300,)]
    df = spark.createDataFrame(rows, "m string").select(C.fingerprint(F.lit("error"), F.col("m")).alias("f"))
    got = [r.f for r in df.collect()]
    assert got[0] == "error::a at 0x?"
    assert got[1] == "error::at app.js:?:?"
    assert got[2] == "error::id ? and 1234"
    assert got[3] == "error::é? x"  # ASCII word boundary, as in JavaScript
    assert got[4] == "error::" + "x" * 200


def test_warn_and_warning_never_merge(spark):
    e = spark.createDataFrame([("c", 0, "warn", "same"), ("c", 1, "warning", "same")],
                              "capture_id string, seq bigint, level string, text string")
    assert rollup.error_rollup(e, severity="warning").count() == 2


def test_ties_keep_first_seen_order(spark):
    e = spark.createDataFrame([("c", i, "error", m) for i, m in enumerate(["b", "a", "c", "a", "b"])],
                              "capture_id string, seq bigint, level string, text string")
    got = [(r.message, r["count"]) for r in rollup.error_rollup(e).orderBy("issue_no").collect()]
    assert got == [("b", 2), ("a", 2), ("c", 1)]


def test_all_still_drops_debug_and_verbose(spark):
    e = spark.createDataFrame([("c", 0, "debug", "d"), ("c", 1, "verbose", "v"), ("c", 2, "custom", "x")],
                              "capture_id string, seq bigint, level string, text string")
    assert [r.message for r in rollup.error_rollup(e, severity="all").collect()] == ["x"]


def test_type_and_message_fallbacks(spark):
    e = spark.createDataFrame([("c", 0, "error", None, "from message"), ("c", 1, None, None, None)],
                              "capture_id string, seq bigint, type string, text string, message string")
    n = rollup.normalize(e).orderBy("seq").collect()
    assert (n[0].level, n[0].message) == ("error", "from message")
    assert (n[1].level, n[1].message) == ("log", "")


def test_severity_filter_is_pushed_to_parquet(spark, tmp_path):
    path = str(tmp_path / "entries")
    noisy_entries(spark).write.parquet(path)
    df = rollup.filter_severity_raw(spark.read.parquet(path), "warning")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(level" in plan
    assert df.count() == 16
    e = spark.createDataFrame([("c", 0, None, "warn"), ("c", 1, None, None), ("c", 2, "info", "error")],
                              "capture_id string, seq bigint, level string, type string")
    for sev, n in (("warning", 1), ("all", 3), ("error", 0)):
        raw = rollup.filter_severity_raw(e, sev).count()
        assert raw == rollup.filter_severity(rollup.normalize(e), sev).count() == n


def test_partition_count_independence(spark):
    e = noisy_entries(spark)
    one = rollup.error_rollup(e.coalesce(1), severity="all").collect()
    many = rollup.error_rollup(e.repartition(7), severity="all").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_global_group_and_invariants(spark):
    e = noisy_entries(spark, "p1").unionByName(noisy_entries(spark, "p2").withColumn("seq", F.col("seq") + 100))
    g = rollup.error_rollup(e, severity="all", by=[]).orderBy("issue_no").collect()
    assert [r["count"] for r in g] == [10, 4, 2, 4, 2, 2]
    per = rollup.error_rollup(e, severity="all", limit=None)
    total = e.count()
    assert per.agg(F.sum("count")).first()[0] <= total


def test_first_entry_modes_agree(spark):
    from webdiag.sources import adapters as A
    for e in (noisy_entries(spark), A.console_entries(spark, "/root/testdata/sf0.001")):
        for sev in ("error", "all"):
            a = rollup.error_rollup(e, severity=sev, limit=7, first_entry="min_by")
            b = rollup.error_rollup(e, severity=sev, limit=7, first_entry="join")
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    tied = spark.createDataFrame([("c", 1, "error", "m 1", "b"), ("c", 1, "error", "m 1", "a"), ("c", 1, "error", "m 1", "a")],
                                 "capture_id string, seq bigint, level string, text string, source string")
    for mode in ("join", "min_by"):
        assert [(r["count"], r.source) for r in rollup.error_rollup(tied, first_entry=mode).collect()] == [(3, "a")]
    plan = rollup.error_rollup(noisy_entries(spark), first_entry="join")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_required_words():
    from webdiag.functions.console import NOISE_PATTERNS, required_words as w
    assert [w(p) for p in NOISE_PATTERNS][2:] == [
        {"hmr"}, {"vite"}, {"download", "the", "react"}, {"warning", "is", "no", "longer"},
        {"deprecated", "and", "will", "be"}, {"webpack"}]
    assert w(NOISE_PATTERNS[1]) == {"warning", "react", "does", "not", "recognize", "the", "prop", "on", "a", "dom"}
    assert w(r"^Rule R12: ") == {"rule", "r12"} and w(r"\(code X3\) seen$") == {"code", "x3", "seen"}
    assert not w("plain") and w("^plain$") == {"plain"}
    # nothing is certain: alternatives, options, classes, escapes that this reader leaves alone, flags
    for p in ("^a b |c", "^(foo )?$", "^ foo? ", "^ [abc] ", r"^\Qfoo\E ", r"^\x41 ", "(?x) foo ", "^( foo | bar )$", r" foo\w ", " f.o ",
              "^ (foo){0,2} ", "\u00e9foo\u00e9", "(", "[", "\\", "*", " foo{"):
        assert not w(p), p
    assert w("^ (?:foo) (?i:BAR2) x*$") == {"foo", "bar2"} and not w(" foo+ ") and w("^ (foo) ") == {"foo"}


def test_many_patterns_equal_one_alternation(spark):
    import random

    from webdiag.functions import console as C
    rnd = random.Random(5)
    words = ["foo", "Bar", "b_z", "42", "\u00e9t\u00e9", "R1", "x"]
    beside = [" ", ": ", "(", ") ", "-", "", "\n", "\u0130"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice(beside) for _ in range(n))
    escape = lambda s: "".join(c if c.isalnum() or c == "_" else "\\" + c if c.isascii() and c != "\n" else c for c in s)
    shapes = ["^%s", "%s$", "(?i:%s)", "%s.%s", "%s\\w+%s", "(?:%s)?%s", "%s|%s x", "[a-f]%s", "%s+", "^%s\\d*$"]
    patterns = []
    for k in range(400):
        shape = shapes[k % len(shapes)]
        patterns.append(shape % tuple(escape(text(rnd.randint(2, 4))) for _ in range(shape.count("%s"))))
    messages = [text(rnd.randint(0, 9)) for _ in range(1500)] + [None, "", "\u0130foo "]
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    assert sum(bool(C.required_words(p)) for p in patterns) > 100
    got = df.select("m", C.is_noise(F.col("m"), patterns).alias("a"),
                    F.col("m").rlike("|".join(f"(?:{p})" for p in patterns)).alias("b")).collect()
    assert all(r.a == r.b for r in got) and 100 < sum(bool(r.b) for r in got) < 1400
