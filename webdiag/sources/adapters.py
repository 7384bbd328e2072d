"""Adapters: derive capture-shaped inputs from the driver tables.

The driver tables hold no browser captures, so these projections make
deterministic ones. Every adapter reads its whole table (no row subsets);
the oracle SQL in ``webdiag.plans.sql`` spells the same projection for
DuckDB. Shapes start from FIXTURES.md §3; README "Adapters" lists them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webdiag.operators.common import posexplode_rows
from webdiag.session import materialize
from webdiag.sources.tables import read_table

# doc_id * stride + line position is unique and in arrival order: no array, and
# so no document, has more lines than the stride
SEQ_STRIDE = 1 << 31


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def console_lines(docs: DataFrame) -> DataFrame:
    """Every line of every document (whole texts), with its position."""
    return posexplode_rows(docs.select("doc_id", "source", "text"), ["doc_id", "source"],
                           F.split("text", "\n"), "pos", "line")


def console_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: console entries, one per document line; capture = document source."""
    return console_entries_of(read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"]))


def console_entries_of(docs: DataFrame) -> DataFrame:
    """A1 over a documents DataFrame (batch or stream)."""
    lines = console_lines(docs)
    d = F.col("doc_id")
    level = (F.when(d % 8 == 0, "error").when(d % 8 == 1, "error")
             .when(d % 8 == 2, "warning").when(d % 8 == 3, "warn")
             .when(d % 8 == 4, "info").when(d % 8 == 5, "log")
             .when(d % 8 == 6, "debug").otherwise("custom"))
    message = (F.when(d % 13 == 0, F.concat(F.lit("[HMR] "), F.col("line")))
               .when(d % 17 == 0, F.concat(F.col("line"), F.lit(" Is Deprecated and will be removed")))
               .otherwise(F.concat(F.col("line"), F.lit(" 0xA"), _s(d), F.lit(" (app.js:"),
                                   _s(F.col("pos") + 1), F.lit(":"), _s(d), F.lit(") id "),
                                   _s(d * 7919))))
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/doc"), _s(d), F.lit(".js"))
    return lines.select(F.col("source").alias("capture_id"),
                        (d * F.lit(SEQ_STRIDE) + F.col("pos")).alias("seq"),
                        level.alias("level"), message.alias("message"), url.alias("url"))


# A6: one element per lineitem row. (css property, SQL expression) — the same
# text runs in Spark and in DuckDB; a null value means "property absent".
A6_PROPERTIES = (
    ("display", "case l_returnflag when 'R' then 'flex' when 'N' then 'none' else 'block' end"),
    ("visibility", "case when l_partkey % 9 = 0 then 'hidden' when l_partkey % 9 = 1 then 'collapse' else 'visible' end"),
    ("opacity", "cast(l_discount as string)"),
    ("position", "case l_linestatus when 'O' then 'static' else 'absolute' end"),
    ("z-index", "case when l_linenumber > 5 then cast(l_linenumber as string) else 'auto' end"),
    ("width", "concat(cast(cast(floor(l_quantity) as bigint) - 1 as string), 'px')"),
    ("height", "concat(cast(l_partkey % 10 as string), 'px')"),
    ("overflow", "case when l_partkey % 3 = 0 then 'hidden' else 'visible' end"),
    ("top", "case when l_partkey % 4 = 0 then 'auto' end"),
    ("left", "case when l_partkey % 8 = 1 then '4px' end"),
    ("min-width", "case when l_partkey % 6 = 0 then '0px' end"),
    ("pointer-events", "case when l_partkey % 7 = 0 then 'none' else 'auto' end"),
    ("clip-path", "case when l_partkey % 11 = 0 then 'circle(50%)' else 'none' end"),
    ("margin", "concat(cast(l_linenumber as string), 'px')"),
    ("border-width", "case when l_linenumber % 2 = 0 then '1px' end"),
    ("border-style", "'solid'"),
    ("cursor", "case when l_linenumber % 3 = 0 then 'pointer' else 'auto' end"),
    ("color", "case when l_partkey % 5 = 0 then 'rgb(0, 0, 0)' else 'rgb(10, 20, 30)' end"),
    ("background-color", "case when l_partkey % 2 = 0 then 'transparent' else 'rgb(255, 0, 0)' end"),
    ("-webkit-font-smoothing", "'antialiased'"),
)
A6_CAPTURE = "cast(l_suppkey as string)"
A6_SELECTOR = ("concat('#o', cast(l_orderkey as string), '-', cast(l_linenumber as string), "
               "'-p', cast(l_partkey as string))")
A6_POS = "l_orderkey * 10 + l_linenumber"
A6_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
              "l_returnflag", "l_linestatus"]


def element_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6: elements (capture_id, pos, selector, styles map) from lineitem."""
    li = read_table(spark, sf_dir, "lineitem", A6_COLUMNS)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.expr(v).alias("value"))
                        for k, v in A6_PROPERTIES])
    styles = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return li.select(F.expr(A6_CAPTURE).alias("capture_id"), F.expr(A6_POS).alias("pos"),
                     F.expr(A6_SELECTOR).alias("selector"), styles.alias("styles"))


# A2: a stack string per event (both dialects). The first frame points into a
# per-user minified bundle (a chunk without any map for every fourth user, a
# query string for another fourth), on generated line 1-3.
A2_BUNDLE_URL = ("case when user_id % 4 = 3 then concat('https://cdn.example.com/dist/vendor', "
                 "cast(user_id as string), '.chunk.js') "
                 "when user_id % 4 = 1 then concat('https://cdn.example.com/dist/app', cast(user_id as string), "
                 "'.min.js?v=2') "
                 "else concat('https://cdn.example.com/dist/app', cast(user_id as string), '.min.js') end")
A2_STACK = ("concat('Error: ', event_type, chr(10), "
            "'at f', cast(user_id as string), ' (', " + A2_BUNDLE_URL + ", ':', cast(event_id % 3 + 1 as string), "
            "':', cast(event_id % 5000 as string), ')', chr(10), "
            "'    at g (webpack-internal:///x.js:3:4)', chr(10), "
            "'    at https://cdn.example.com/src/a.js:', cast(event_id % 90 + 1 as string), ':7', chr(10), "
            "'    at h (/app/node_modules/lib/i.js:1:1)', chr(10), 'tail@x.js:1:2')")


def stack_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: (capture_id, seq, stack) from events."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type"])
    return ev.select(F.col("user_id").cast("string").alias("capture_id"), F.col("event_id").alias("seq"),
                     F.expr(A2_STACK).alias("stack"))


# A4: one source map per customer, one mapping per order (both dialects for
# the facts). Equal generated positions keep the lowest order key.
A4_FACTS = (
    ("cust", "o_custkey"),
    ("okey", "o_orderkey"),
    ("url", "concat('https://cdn.example.com/dist/app', cast(o_custkey as string), '.min.js')"),
    ("gen_line", "o_orderkey % 3 + 1"),
    ("gen_col", "o_orderkey * 37 % 5000 + 1"),
    ("source", "case when o_orderkey % 13 = 0 then null "
               "else concat(case when o_custkey % 4 = 1 then 'webpack:///./src/' else 'src/' end, "
               "lower(replace(o_orderpriority, ' ', '-')), '.jsx') end"),
    ("orig_line", "case when o_orderkey % 13 = 0 then null else o_orderkey % 400 + 1 end"),
    ("orig_col", "case when o_orderkey % 13 = 0 then null else cast(floor(o_totalprice) as bigint) % 120 end"),
    ("name", "case when o_orderkey % 13 = 0 or o_orderstatus = 'P' then null else concat('fn_', o_orderstatus) end"),
)
A4_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
MAP_DIR = "https://cdn.example.com/maps/"
# customers whose map claims version 2 (unsupported) and whose sibling map is not JSON
A4_BAD_VERSION = "cust % 50 = 7"
A4_BROKEN_SIBLING = "cust % 3 = 0 and cust % 7 = 0"


def map_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 facts: the intended (url, gen_line, gen_col) → original positions."""
    o = read_table(spark, sf_dir, "orders", A4_COLUMNS)
    f = o.select(*[F.expr(e).alias(n) for n, e in A4_FACTS])
    f = f.where(F.col("url").isNotNull() & F.col("gen_line").isNotNull() & F.col("gen_col").isNotNull())
    # dealt by map, as ``source_map_docs`` goes on
    first = F.min("okey").over(Window.partitionBy("cust", "url", "gen_line", "gen_col"))
    return f.repartition("cust", "url").withColumn("first", first).where(F.col("okey") == F.col("first")).drop("first")


_B32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # digits of conv(x, 10, 32)


def _vlq(v):
    """Base64 VLQ text of a bigint Column (test-data encoder): base-32
    digits of the sign-folded value, least significant first; every digit
    but the last carries the continuation bit. Up to three digits are looked
    up one by one."""
    from webdiag.functions.vlq import BASE64_ALPHABET
    u = F.when(v < 0, (-v) * 2 + 1).otherwise(v * 2)
    rev = F.reverse(F.conv(u.cast("string"), 10, 32))
    n = F.length(rev)
    head = F.translate(rev.substr(F.lit(1), n - 1), _B32, BASE64_ALPHABET[32:])
    tail = F.translate(rev.substr(n, F.lit(1)), _B32, BASE64_ALPHABET[:32])

    def digit(k, more):
        d = F.shiftright(u, 5 * k).bitwiseAND(31).cast("int")
        return F.substr(F.lit(BASE64_ALPHABET), d + (33 if more else 1), F.lit(1))
    return (F.when(u < 1 << 5, digit(0, False)).when(u < 1 << 10, F.concat(digit(0, True), digit(1, False)))
            .when(u < 1 << 15, F.concat(digit(0, True), digit(1, True), digit(2, False)))
            .otherwise(F.concat(head, tail)))


def map_docs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map documents feed two tables of a query: built once by it, as a
    table in the shared checkpoint folder."""
    return materialize(source_map_docs(spark, sf_dir), "a4_map_docs")


def _base64(text):
    """Unbroken base64 of UTF-8 text (Spark's ``base64`` wraps MIME lines)."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", "")


A4_INDEXED = "cust % 5 = 4"  # these customers' maps are indexed: line 1, then lines 2+


def source_map_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 maps: (cust, url, map_json) — a v3 source map per customer that
    encodes its facts (deltas, VLQ), 'version 2' for some, and an indexed
    map (two sections split before generated line 2) for others. Deltas are
    taken from the row before in the part's order; one grouped aggregation
    per line, part and map. All of it on one shuffle, by map."""
    f = map_facts(spark, sf_dir)
    indexed = F.expr(A4_INDEXED)
    section = F.when(indexed & (F.col("gen_line") >= 2), 1).otherwise(0)
    f = f.withColumn("section", section).withColumn("gen_line", F.col("gen_line") - F.col("section"))
    part = ["cust", "url", "section"]
    w = Window.partitionBy(*part)
    # indexes in the part's sorted sources and names
    f = f.withColumn("src", F.when(F.col("source").isNotNull(), F.dense_rank().over(w.orderBy(F.col("source").asc_nulls_last())) - 1))
    f = f.withColumn("nm", F.when(F.col("name").isNotNull(), F.dense_rank().over(w.orderBy(F.col("name").asc_nulls_last())) - 1))
    o = w.orderBy("gen_line", "gen_col", "source", "orig_line", "orig_col", "name")
    before = o.rowsBetween(Window.unboundedPreceding, -1)
    has_src = F.col("src").isNotNull()
    own = F.when(has_src, F.struct(F.col("src").cast("bigint").alias("src"), (F.col("orig_line") - 1).alias("oline"),
                                   F.col("orig_col").alias("ocol")))
    own_name = F.when(has_src, F.col("nm").cast("bigint"))
    zero = F.lit(0).cast("bigint")
    f = f.select("*", F.row_number().over(o).alias("no"), own.alias("own"), F.last(own, True).over(before).alias("prev"),
                 own_name.alias("own_name"), F.coalesce(F.last(own_name, True).over(before), zero).alias("prev_name"),
                 F.lag("gen_line").over(o).alias("prev_line"), F.lag("gen_col").over(o).alias("prev_col"))
    base = F.when(F.col("gen_line") == F.col("prev_line"), F.col("prev_col")).otherwise(zero)
    f = f.select("*", (F.col("gen_col") - base).alias("d_col"), (F.col("own_name") - F.col("prev_name")).alias("d_name"),
                 *[(F.col(f"own.{c}") - F.when(F.col("prev").isNotNull(), F.col(f"prev.{c}")).otherwise(zero)).alias(f"d_{c}")
                   for c in ("src", "oline", "ocol")])
    f = f.select("*", *[_vlq(F.col(f"d_{c}")).alias(f"v_{c}") for c in ("col", "src", "oline", "ocol", "name")])
    text = F.concat("v_col", F.when(has_src, F.concat("v_src", "v_oline", "v_ocol")).otherwise(F.lit("")),
                    F.when(F.col("own_name").isNotNull(), F.col("v_name")).otherwise(F.lit("")))
    lines = f.withColumn("text", text).groupBy(*part, "gen_line").agg(
        F.array_sort(F.collect_list(F.struct("no", "text"))).alias("segs"),
        F.collect_set("source").alias("sources"), F.collect_set("name").alias("names"))
    lines = lines.select(*part, "sources", "names", F.struct(
        "gen_line", F.array_join(F.transform("segs", lambda x: x["text"]), ",").alias("text")).alias("line"))
    parts = lines.groupBy(*part).agg(
        F.array_sort(F.collect_list("line")).alias("lines"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("sources", "names")])
    mappings = F.array_join(F.transform("lines", lambda x, i: F.concat(
        F.repeat(F.lit(";"), (x["gen_line"] - F.when(i > 0, F.get("lines", i - 1)["gen_line"]).otherwise(F.lit(1))).cast("int")),
        x["text"])), "")
    part_map = F.struct(F.lit(3).alias("version"), F.col("sources"), F.col("names"), mappings.alias("mappings"))
    docs = parts.select(*part, part_map.alias("map")).groupBy("cust", "url").agg(
        F.array_sort(F.collect_list(F.struct("section", "map"))).alias("parts"))
    version = F.when(F.expr(A4_BAD_VERSION), 2).otherwise(3)
    file = F.concat(F.lit("app"), F.col("cust").cast("string"), F.lit(".min.js"))
    first = F.col("parts")[0]["map"]
    plain = F.to_json(F.struct(version.alias("version"), file.alias("file"), first["sources"].alias("sources"),
                               first["names"].alias("names"), first["mappings"].alias("mappings")))
    sections = F.transform("parts", lambda p: F.struct(
        F.struct(p["section"].cast("bigint").alias("line"), F.lit(0).cast("bigint").alias("column")).alias("offset"),
        p["map"].alias("map")))
    index = F.to_json(F.struct(version.alias("version"), file.alias("file"), sections.alias("sections")))
    return docs.select("cust", "url", F.when(indexed, index).otherwise(plain).alias("map_json"))


def map_files_and_scripts(spark: SparkSession, sf_dir: str):
    """A4 hosting: ``map_files(url, map_json)`` and ``scripts(url, body)``.
    cust % 3 = 0: map next to the bundle (not JSON for some) and a
    reference to a second copy; = 1: relative reference to the copy;
    = 2: inline base64 reference."""
    d = map_docs_table(spark, sf_dir)
    c3 = F.col("cust") % 3
    copy_url = F.concat(F.lit(MAP_DIR), F.lit("app"), F.col("cust").cast("string"), F.lit(".js.map"))
    sib_json = F.when(F.expr(A4_BROKEN_SIBLING), F.lit("not json")).otherwise(F.col("map_json"))
    # each map is hosted at up to two places: next to its bundle, and in MAP_DIR
    hosted = F.array(
        F.struct(F.when(c3 == 0, F.concat(F.col("url"), F.lit(".map"))).alias("url"), sib_json.alias("map_json")),
        F.struct(F.when(c3 != 2, copy_url).alias("url"), F.col("map_json").alias("map_json")))
    map_files = d.select(F.explode(F.filter(hosted, lambda h: h["url"].isNotNull())).alias("h")).select("h.*")
    ref = F.when(F.col("cust") % 3 == 2, F.concat(
        F.lit("data:application/json;charset=utf-8;base64,"), _base64(F.col("map_json")))) \
        .otherwise(F.concat(F.lit("../maps/app"), F.col("cust").cast("string"), F.lit(".js.map")))
    body = F.concat(F.lit("/*app "), F.col("cust").cast("string"), F.lit("*/var a=1;"), F.lit("\n"),
                    F.when(F.col("cust") % 2 == 0, F.lit("//# ")).otherwise(F.lit("//@ ")),
                    F.lit("sourceMappingURL="), ref, F.lit("\n"))
    scripts = d.select("url", body.alias("body"))
    return map_files, scripts


# A3: script urls for the minified test (from pages).
A3_URL = ("concat(url, case page_id % 5 when 0 then '/a.min.js' when 1 then '/dist/a.js' when 2 then '/a.js' "
          "when 3 then '/a.chunk.js?v=1' else '/_next/static/chunks/x.js' end)")


def script_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    return p.select("page_id", F.expr(A3_URL).alias("url"), F.lit(1).cast("bigint").alias("line"),
                    F.col("page_id").alias("col"))


# A5: page bodies with a map reference (four kinds, none for some).
A5_BODY = ("concat(html, case page_id % 4 "
           "when 0 then concat('//# sourceMappingURL=a', cast(page_id as string), '.js.map') "
           "when 1 then '//@ sourceMappingURL=data:application/json;base64,eyJ2ZXJzaW9uIjozfQ==' "
           "when 2 then concat(chr(10), '//# sourceMappingURL=../maps/./p', cast(page_id as string), '.map?x=1') "
           "else '' end)")


def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return p.select("page_id", "url", F.expr(A5_BODY).alias("body"))


# A7: a page per part size; every part contributes an element id and a class.
A7_ID = "concat(upper(substr(p_name, 1, 1)), replace(substr(p_name, 2), ' ', '-'))"
A7_CLASS = "replace(p_brand, '#', '-')"
A7_REQUESTS = ("#Small-ring", ".brand-1", "#ring", "#blue-bolt.brand-2", "nav > .zz", "#RED-widget")


def dom_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 tokens (capture_id, kind, token, doc_order) in document order."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_size"])
    both = F.array(F.struct(F.lit("id").alias("kind"), F.expr(A7_ID).alias("token")),
                   F.struct(F.lit("class").alias("kind"), F.expr(A7_CLASS).alias("token")))
    x = p.select(F.col("p_size").cast("string").alias("capture_id"), F.col("p_partkey").alias("doc_order"),
                 F.explode(both).alias("t"))
    return x.select("capture_id", "t.kind", "t.token", "doc_order")


A7_STYLES = (
    ("display", "case when p_partkey % 4 = 0 then 'none' else 'flex' end"),
    ("opacity", "case when p_partkey % 7 = 0 then '0.05' else '1' end"),
    ("visibility", "case when p_type like '%BRASS%' then 'hidden' else 'visible' end"),
    ("overflow", "case when p_partkey % 3 = 0 then 'hidden' else 'visible' end"),
    ("pointer-events", "case when p_size % 2 = 0 then 'none' else 'auto' end"),
)


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 elements: every id of a page is a selectable element (the first
    part carrying it, in document order), with computed styles."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_size"])
    styles = F.create_map(*[x for k, v in A7_STYLES for x in (F.lit(k), F.expr(v))])
    e = p.select(F.col("p_size").cast("string").alias("capture_id"),
                 F.concat(F.lit("#"), F.expr(A7_ID)).alias("selector"), F.col("p_partkey").alias("doc_order"),
                 styles.alias("styles"))
    first = e.groupBy("capture_id", "selector").agg(F.min("doc_order").alias("doc_order"))
    return e.join(first, ["capture_id", "selector", "doc_order"], "inner")


def selector_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 requests: the same selectors asked on every page."""
    p = read_table(spark, sf_dir, "part", ["p_size"])
    caps = p.select(F.col("p_size").cast("string").alias("capture_id")).distinct()
    return caps.select("capture_id", F.posexplode(F.array(*[F.lit(s) for s in A7_REQUESTS])).alias("pos", "selector"))


# A8: console payloads from events, one shape per event_id % 8. Each shape
# is (prefix, suffix) around event_type; None = the payload is the prefix; a
# suffix may be a list of literal pieces and ("sql", expression) pieces. The
# stack of shape 0 points into the A4 bundles.
A8_SHAPES = (
    ('[{"level":"error","text":"', ['","stackTrace":"at f (https://cdn.example.com/dist/app',
                                    ("sql", "cast(event_id % 1500 as string)"), '.min.js:',
                                    ("sql", "cast(event_id % 3 + 1 as string)"), ':',
                                    ("sql", "cast(event_id % 5000 as string)"), ')"}]']),
    ('{"result":[{"type":"warn","message":"', '"},{"type":"warn","message":"0x1F at :3:4"}]}'),
    ('{"logs":[{"text":"', '","url":"https://x.example.com/p"}]}'),
    ('{"messages":[{"level":"info","text":"', '"},{"level":"log"}]}'),
    ('{"content":[{"text":"No console messages found"}]}', None),
    ('{"content":[{"text":"```json [{\\"level\\":\\"error\\",\\"text\\":\\"', '\\"}] ```"}]}'),
    ('{"content":[{"text":"Page log\\n## Console\\n- ', '"}]}'),
    ('not json ', ''),
)
# A9: style payloads from events, one shape per event_id % 6.
A9_SHAPES = (
    ('{"results":[{"selector":"#e-', '","styles":{"display":"none","opacity":"1","color":"red"}}]}'),
    ('{"result":{"results":[{"selector":"#a","styles":{"opacity":"0.05"}},'
     '{"selector":"#', '","notFound":true,"suggestions":["#b1","#b2"]}]}}'),
    ('{"content":[{"text":"```json {\\"results\\":[{\\"selector\\":\\".', '\\",\\"styles\\":{\\"visibility\\":\\"hidden\\"}}]} ```"}]}'),
    ('{"content":[{"text":"null"}]}', None),
    ('{"results":"', '"}'),
    ('<html>', '</html>'),
)


def _shaped(col: Column, key: Column, shapes) -> Column:
    n = len(shapes)
    expr = None
    for i, (pre, suf) in enumerate(shapes):
        pieces = suf if isinstance(suf, list) else [suf]
        tail = [F.expr(x[1]) if isinstance(x, tuple) else F.lit(x) for x in pieces]
        val = F.lit(pre) if suf is None else F.concat(F.lit(pre), col, *tail)
        expr = F.when(key % n == i, val) if expr is None else expr.when(key % n == i, val)
    return expr


def console_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8: (capture_id, payload) per event."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type"])
    return ev.select(F.col("event_id").cast("string").alias("capture_id"),
                     _shaped(F.col("event_type"), F.col("event_id"), A8_SHAPES).alias("payload"))


def element_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9: (capture_id, payload) per event."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type"])
    return ev.select(F.col("event_id").cast("string").alias("capture_id"),
                     _shaped(F.col("event_type"), F.col("event_id"), A9_SHAPES).alias("payload"))


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a capture per customer: a selector per order."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    return o.select(F.col("o_custkey").alias("capture_id"), F.col("o_orderkey").alias("pos"),
                    F.concat(F.lit("#order-"), _s("o_orderkey")).alias("selector"))


def object_stack_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Console payloads whose one entry has a stack of frame objects: the event's
    type, user, value and property name the frame."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value", "props"])
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    fn = F.concat(F.col("event_type"), _s(k))
    url = F.concat(F.lit("https://cdn.example.com/u"), _s("user_id"), F.lit(".js"))
    line, col = F.floor("value").cast("bigint") + 1, k
    none = F.lit(None).cast("string")
    named = F.to_json(F.struct(fn.alias("functionName"), url.alias("scriptUrl"), line.alias("lineNumber"), col.alias("columnNumber")))
    plain = F.to_json(F.struct(url.alias("url"), line.alias("lineNumber"), col.alias("columnNumber"), none.alias("name")))
    short = F.to_json(F.struct(fn.alias("name"), url.alias("source"), line.alias("line"), col.alias("column")))
    inner = F.lit('{"functionName":"i","url":"https://h/node_modules/t.js","lineNumber":1,"columnNumber":1}')
    frame = F.when(i % 3 == 0, named).when(i % 3 == 1, plain).otherwise(short)
    return ev.select(_s(i).alias("capture_id"), F.concat(
        F.lit('[{"level":"error","text":"x","stackTrace":['), F.when(i % 2 == 0, F.concat(inner, F.lit(","))).otherwise(F.lit("")),
        frame, F.lit("]}]")).alias("payload"))


# the eight kinds of noise around a document line (%s) or its first word (%w), the
# line alone, and two near misses
NOISE_FORMS = (
    'Warning: Each child in a list should have a unique "key" prop. %s', "Warning: React does not recognize the `%w` prop on a DOM element",
    "[HMR] %s", "[vite] %s", "Download the React DevTools %s", "Warning: ReactDOM.render is no longer supported %s",
    "%s IS Deprecated and will be removed", "[webpack] %s", "%s", "%s [HMR] [vite]", "warning: each child in a list %s",
)


def _around(form: str) -> Column:
    """A form with the line, or its first word, in its place."""
    mark = "%w" if "%w" in form else "%s"
    before, after = form.split(mark)
    inner = F.split("line", " ", 2)[0] if mark == "%w" else F.col("line")
    return F.concat(F.lit(before), inner, F.lit(after))


def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, line, message): every line of every document in one of the forms."""
    lines = console_lines(read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"]))
    kind = F.pmod(F.col("doc_id") + F.col("pos"), F.lit(len(NOISE_FORMS)))
    message = None
    for k, form in enumerate(NOISE_FORMS):
        message = F.when(kind == k, _around(form)) if message is None else message.when(kind == k, _around(form))
    return lines.select(kind.alias("kind"), "line", message.alias("message"))


# a thousand own patterns: even rule numbers below 1,000, codes that 3 divides below 1,500
MANY_PATTERNS = tuple([rf"^Rule R{2 * k}: " for k in range(500)] + [rf"\(code X{3 * k}\) seen$" for k in range(500)])


def ruled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capture_id, form, line, message): every line of every document, with a
    rule before it, a code after it, or alone."""
    lines = console_lines(read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"]))
    d, pos = F.col("doc_id"), F.col("pos")
    form = F.pmod(d + pos, F.lit(3))
    message = (F.when(form == 0, F.concat(F.lit("Rule R"), _s(d % 2500), F.lit(": "), F.col("line")))
               .when(form == 1, F.concat(F.col("line"), F.lit(" (code X"), _s(pos % 3000), F.lit(") seen")))
               .otherwise(F.col("line")))
    return lines.select(F.col("source").alias("capture_id"), form.alias("form"), "line", message.alias("message"))
