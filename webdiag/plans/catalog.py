"""Registry of named queries (Spark) and their DuckDB oracle SQL.

Each query reads whole driver tables through an adapter and runs one or
more library operators; output columns are flat (strings, bigints,
doubles) and named the same on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webdiag.functions import frames as FR
from webdiag.operators import asof as AS
from webdiag.operators import audit as AU
from webdiag.operators import reports as RP
from webdiag.operators import rollup as R
from webdiag.operators import sourcemaps as SM
from webdiag.operators import stacks as ST
from webdiag.operators import suggest as SG
from webdiag.operators.segment_store import SegmentStore
from webdiag.operators.common import posexplode_rows, where_computed
from webdiag.plans import sql as S
from webdiag.plans import values as V
from webdiag.functions import console as C
from webdiag.session import checkpoint_dir, materialize
from webdiag.sources import adapters as A
from webdiag.sources import captures as CP
from webdiag.sources import payloads as PL
from webdiag.sources import sinks as SK
from webdiag.streaming import rollup as SR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _bigint(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in names else F.col(c)
                       for c in df.columns])


# ---------------------------------------------------------------- console
@register("console_normalized", f"""
with {S.A1_ENTRIES}
select capture_id, seq, level, message, url as source, cast({S.rank_sql()} as bigint) as severity_rank from a1
""")
def console_normalized(spark, sf_dir):
    e = R.with_rank(R.normalize(A.console_entries(spark, sf_dir)))
    return e.select("capture_id", "seq", "level", "message", "source",
                    F.col("severity_rank").cast("bigint").alias("severity_rank"))


def _severity_query(severity):
    def q(spark, sf_dir):
        e = R.filter_severity(R.normalize(A.console_entries(spark, sf_dir)), severity)
        return e.select("capture_id", "seq", "level")
    sql = f"with {S.A1_ENTRIES}\nselect capture_id, seq, level from a1 where {S.severity_where(severity)}"
    return q, sql


for _sev in ("error", "warning", "all"):
    _fn, _sql = _severity_query(_sev)
    register(f"severity_{_sev}", _sql)(_fn)


@register("noise_removed", f"""
with {S.A1_ENTRIES}
select capture_id, seq, level, message from a1 where not regexp_matches(message, {S.NOISE_RE})
""")
def noise_removed(spark, sf_dir):
    e = R.drop_noise(R.normalize(A.console_entries(spark, sf_dir)))
    return e.select("capture_id", "seq", "level", "message")


@register("fingerprints", f"""
with {S.A1_ENTRIES}
select capture_id, seq, {S.fingerprint_sql()} as fingerprint from a1
""")
def fingerprints(spark, sf_dir):
    e = R.with_fingerprint(R.normalize(A.console_entries(spark, sf_dir)))
    return e.select("capture_id", "seq", "fingerprint")


A1_NORMALIZED = S.A1_ENTRIES + """,
n as (select capture_id, seq, level, message, url as source from a1)"""


def _rollup_query(severity, limit, by):
    def q(spark, sf_dir):
        out = R.error_rollup(A.console_entries(spark, sf_dir), severity=severity, limit=limit, by=by)
        return _bigint(out, "issue_no")
    return q, S.rollup_sql(A1_NORMALIZED, "n", severity, limit, list(by))


for _name, _args in {
    "error_rollup": ("error", 20, ["capture_id"]),
    "error_rollup_warning": ("warning", 20, ["capture_id"]),
    "error_rollup_all": ("all", 20, ["capture_id"]),
    "error_rollup_top1": ("all", 1, ["capture_id"]),
    "error_rollup_global": ("warning", 20, []),
}.items():
    _fn, _sql = _rollup_query(*_args)
    register(_name, _sql)(_fn)


# ---------------------------------------------------------------- style audit

_A6_PRESENT = [k for k, _ in A.A6_PROPERTIES]
_A6_ISSUES = f"""with {S.a6_sql()},
fired as ({S.issues_sql('a6', _A6_PRESENT)}),
iss as (select rid, row_number() over (partition by rid order by rule_no) as issue_no, rule_no,
               type, property, value, severity, note from fired)"""


@register("styles_filtered", f"""with {S.a6_sql()}
select capture_id, selector, property, value from a6_long where {S.css_keep_sql()}
""")
def styles_filtered(spark, sf_dir):
    return AU.style_rows(A.element_styles(spark, sf_dir))


@register("styles_no_box", f"""with {S.a6_sql()}
select capture_id, selector, property, value from a6_long where {S.css_keep_sql()} and not {S.box_sql()}
""")
def styles_no_box(spark, sf_dir):
    return AU.style_rows(A.element_styles(spark, sf_dir), include_box_model=False)


@register("element_issues", f"""{_A6_ISSUES}
select a6.capture_id, a6.selector, iss.issue_no, iss.type, iss.property, iss.value, iss.severity, iss.note
from iss join a6 using (rid)
""")
def element_issues(spark, sf_dir):
    return AU.element_issues(A.element_styles(spark, sf_dir))


_HIGH_PART = "string_agg(property || ':' || value, ', ' order by rule_no) filter (where severity = 'high')"
_OTHER_PART = ("string_agg(coalesce(note, property || ':' || value), '; ' order by rule_no) "
               "filter (where severity is distinct from 'high')")


@register("element_summary", f"""{_A6_ISSUES},
per as (
  select rid, count(*) as n_issues, {_HIGH_PART} as high_part, {_OTHER_PART} as other_part
  from iss group by rid
)
select a6.capture_id, a6.selector, coalesce(per.n_issues, 0) as n_issues,
  case when per.rid is null then concat(a6.selector, ': No obvious visual issues detected. display:',
         coalesce(a6."display", '?'), ', opacity:', coalesce(a6."opacity", '?'), ', visibility:',
         coalesce(a6."visibility", '?'), '.')
       else concat(a6.selector, ': ', concat_ws('; ', high_part || ' (likely cause)', other_part)) end as summary
from a6 left join per using (rid)
""")
def element_summary(spark, sf_dir):
    r = AU.element_report(A.element_styles(spark, sf_dir))
    return r.select("capture_id", "selector", "n_issues", "summary")


@register("batch_summary", f"""{_A6_ISSUES},
ranked as (
  select rid, property, value, case severity when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end as r,
         issue_no from iss
),
top_el as (
  select rid, arg_min(property, struct_pack(nr := -r, i := issue_no)) as property,
         arg_min(value, struct_pack(nr := -r, i := issue_no)) as value, max(r) as r
  from ranked group by rid
),
el as (
  select a6.capture_id, a6.pos, a6.selector, t.property, t.value, t.r, t.rid is not null as has_issue
  from a6 left join top_el t using (rid)
),
g as (
  select capture_id, count(*) as n_elements, count(*) filter (where has_issue) as n_with_issues,
         cast(0 as bigint) as n_not_found,
         arg_min(selector || ' ' || property || ':' || value,
                 struct_pack(nr := -r, p := pos, s := selector, pp := property, v := value))
           filter (where has_issue) as top
  from el group by capture_id
)
select capture_id, n_elements, n_with_issues, n_not_found,
  concat(cast(n_elements as varchar), ' element', case when n_elements > 1 then 's' else '' end,
         ' diagnosed, ', cast(n_with_issues as varchar), ' with issues',
         case when n_not_found > 0 then ', ' || cast(n_not_found as varchar) || ' not found' else '' end,
         case when top is not null then '. Top: ' || top else '' end, '.') as summary
from g
""")
def batch_summary(spark, sf_dir):
    r = AU.element_report(A.element_styles(spark, sf_dir))
    return AU.batch_report(r)


# ---------------------------------------------------------------- stack frames


@register("frames_parsed", f"""with {S.a2_frames_sql()}
select capture_id, seq, frame_no, function_name, url, line, col, raw from parsed
""")
def frames_parsed(spark, sf_dir):
    e = A.stack_entries(spark, sf_dir)
    x = posexplode_rows(e, ["capture_id", "seq"], ST.parsed_frames(e), "i", "f")
    return x.select("capture_id", "seq", (F.col("i") + 1).cast("bigint").alias("frame_no"), "f.*")


@register("frames_kept", f"""with {S.a2_frames_sql()}
select capture_id, seq, frame_no, {S.frame_text_sql()} as text from kept
""")
def frames_kept(spark, sf_dir):
    x = ST.explode_frames(A.stack_entries(spark, sf_dir))
    return x.select("capture_id", "seq", "frame_no",
                    FR.frame_to_string(F.struct(*[F.col(c) for c in
                                                  ("function_name", "url", "line", "col", "raw")])).alias("text"))


@register("stack_compressed", f"""with {S.a2_frames_sql()}
select capture_id, seq, count(*) as n_frames, string_agg({S.frame_text_sql()}, chr(10) order by frame_no) as stack_trace
from kept group by capture_id, seq
""")
def stack_compressed(spark, sf_dir):
    c = ST.compress_stacks(A.stack_entries(spark, sf_dir))
    return c.select("capture_id", "seq", F.array_size("stack_trace").cast("bigint").alias("n_frames"),
                    F.array_join("stack_trace", "\n").alias("stack_trace"))


# ---------------------------------------------------------------- source maps


@register("frames_minified", f"""
select page_id, {A.A3_URL} as url, cast(1 as bigint) as line, page_id as col,
  cast({S.minified_sql(A.A3_URL, '1', 'page_id')} as bigint) as is_minified
from pages
""")
def frames_minified(spark, sf_dir):
    p = A.script_positions(spark, sf_dir)
    return p.select("page_id", "url", "line", "col",
                    FR.looks_minified(F.col("url"), F.col("line"), F.col("col")).cast("bigint").alias("is_minified"))


_A5_REF = f"nullif(regexp_extract(body, {S.q(V.MAP_REFERENCE_RE)}, 1), '')"


@register("map_references", f"""
with a5 as (select page_id, url, {A.A5_BODY} as body from pages),
r as (select page_id, url, {_A5_REF} as ref from a5)
select page_id, ref,
  case when ref is null then null when starts_with(ref, 'data:') then 'data' else 'url' end as ref_kind,
  case when starts_with(ref, 'data:') and regexp_matches(ref, {S.q(V.DATA_BASE64_RE)})
       then decode(from_base64(regexp_extract(ref, {S.q(V.DATA_BASE64_RE)}, 1))) end as inline_json,
  case when ref is not null and not starts_with(ref, 'data:') then {S.resolve_url_sql('ref', 'url')} end as ref_url
from r
""")
def map_references(spark, sf_dir):
    r = SM.map_references(A.page_scripts(spark, sf_dir))
    return r.select("page_id", "ref", "ref_kind", "inline_json", "ref_url")


@register("map_segments", f"""
with {S.a4_sql().rstrip()},
-- indexed maps: each section start (generated line 1 and 2, column 0) is a position without source
starts as (
  select distinct url, case when gen_line >= 2 then 2 else 1 end as gen_line, 0 as gen_col
  from a4 where ({A.A4_INDEXED}) and not ({A.A4_BAD_VERSION})
),
allseg as (
  select url, gen_line, gen_col, {S.normalize_source_sql('source')} as source, orig_line, orig_col, name
  from a4 where not ({A.A4_BAD_VERSION})
  union all
  select url, gen_line, gen_col, null, null, null, null from starts
)
select url, gen_line, gen_col, lead(gen_col) over (partition by url, gen_line order by gen_col) as next_gen_col,
  source, orig_line, orig_col, name
from allseg
""")
def map_segments(spark, sf_dir):
    d = A.map_docs_table(spark, sf_dir)
    return SM.build_segments(d.select("url", "map_json"), materialize)


_A2_FIRST = f"""with {S.a2_frames_sql()}, {S.a4_sql().strip()},
gated as (select * from kept where {S.minified_sql()})"""


def _segments_table(frames, map_files, scripts):
    """The segment table of the frames' maps, written to the shared
    checkpoint folder by the query that reads it."""
    return materialize(SM.segments_for_frames(frames, map_files, scripts, materialize), "segments")


def _frames_and_maps(spark, sf_dir, keep=materialize):
    """The frames (written, as a lookup reads them four times), map files and scripts."""
    frames = keep(ST.explode_frames(A.stack_entries(spark, sf_dir)), "frames")
    map_files, scripts = A.map_files_and_scripts(spark, sf_dir)
    return frames, map_files, scripts


@register("map_selected", f"""{_A2_FIRST}, {S.selection_sql('gated').strip()}
select url, map_origin, map_url from sel
""")
def map_selected(spark, sf_dir):
    frames, map_files, scripts = _frames_and_maps(spark, sf_dir, lambda df, _name: df)
    urls = frames.where(FR.looks_minified(F.col("url"), F.col("line"), F.col("col"))).select("url")
    return SM.select_maps(urls, map_files, scripts).select("url", "map_origin", "map_url")


_RESOLVED = f"""{_A2_FIRST}, {S.selection_sql('gated').strip()},
pos as (select distinct url, line, coalesce(col, 0) as col from gated where line >= 1 and coalesce(col, 0) >= 0),
hit as (
  select pos.url, pos.line, pos.col, s.source as r_source, s.orig_line as r_line, s.orig_col as r_col, s.name as r_name
  from pos asof left join segs s on pos.url = s.url and pos.line = s.gen_line and pos.col >= s.gen_col
),
res as (
  select k.capture_id, k.seq, k.frame_no,
    coalesce(h.r_source is not null, false) as resolved,
    case when h.r_source is not null
         then concat('at ', coalesce(h.r_name, k.function_name, '?'), ' (', h.r_source, ':',
                     cast(h.r_line as varchar), ':', cast(h.r_col as varchar), ')')
         else {S.frame_text_sql().replace('raw', 'k.raw').replace('url', 'k.url').replace('line', 'k.line').replace('function_name', 'k.function_name').replace('coalesce(col', 'coalesce(k.col')} end as text
  from kept k left join hit h
    on {S.minified_sql('k.url', 'k.line', 'k.col')} and h.url = k.url and h.line = k.line and h.col = coalesce(k.col, 0)
)"""


@register("frames_resolved", f"""{_RESOLVED}
select capture_id, seq, frame_no, cast(resolved as bigint) as resolved, text from res
""")
def frames_resolved(spark, sf_dir):
    frames, map_files, scripts = _frames_and_maps(spark, sf_dir)
    segs = _segments_table(frames, map_files, scripts)
    r = AS.resolve_frames(frames, segs, bucket_width=64)
    return r.select("capture_id", "seq", "frame_no", F.col("resolved").cast("bigint").alias("resolved"), "text")


@register("frames_resolved_stored", f"""{_RESOLVED}
select capture_id, seq, frame_no, cast(resolved as bigint) as resolved, text from res
""")
def frames_resolved_stored(spark, sf_dir):
    """The frames of ``frames_resolved`` looked up in a segment store."""
    frames, map_files, scripts = _frames_and_maps(spark, sf_dir)
    store = SegmentStore.create(spark, f"{checkpoint_dir(spark).rstrip('/')}/segments-{uuid.uuid4().hex[:12]}", width=64)
    store.add(_segments_table(frames, map_files, scripts))
    r = AS.resolve_frames(frames, store.split())
    return r.select("capture_id", "seq", "frame_no", F.col("resolved").cast("bigint").alias("resolved"), "text")


@register("resolved_counts", f"""{_RESOLVED}
select capture_id, count(*) as n_frames, count(*) filter (where resolved) as resolved_count from res group by capture_id
""")
def resolved_counts(spark, sf_dir):
    frames, map_files, scripts = _frames_and_maps(spark, sf_dir)
    segs = _segments_table(frames, map_files, scripts)
    r = AS.resolve_frames(frames, segs)
    return r.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n_frames"),
                                       F.count_if("resolved").alias("resolved_count"))


@register("stack_resolved", f"""{_RESOLVED}
select capture_id, seq, string_agg(text, chr(10) order by frame_no) as stack_trace,
  count(*) filter (where resolved) as resolved_count
from res group by capture_id, seq
""")
def stack_resolved(spark, sf_dir):
    entries = A.stack_entries(spark, sf_dir)
    frames, map_files, scripts = _frames_and_maps(spark, sf_dir)
    segs = _segments_table(frames, map_files, scripts)
    c = AS.compress_with_maps(entries, segs, keep=lambda *_: frames)
    return c.select("capture_id", "seq", F.array_join("stack_trace", "\n").alias("stack_trace"), "resolved_count")


# ---------------------------------------------------------------- lookup and suggestions


@register("element_lookup", f"""with {S.a7_sql()}
select capture_id, cast(pos as bigint) as pos, selector, cast(found as bigint) as found from looked
""")
def element_lookup(spark, sf_dir):
    r = SG.lookup(A.selector_requests(spark, sf_dir), A.page_elements(spark, sf_dir))
    return r.select("capture_id", F.col("pos").cast("bigint").alias("pos"), "selector",
                    F.col("found").cast("bigint").alias("found"))


@register("selector_suggestions", f"""with {S.a7_sql()}
select capture_id, selector, rank, suggestion from top
""")
def selector_suggestions(spark, sf_dir):
    looked = SG.lookup(A.selector_requests(spark, sf_dir), A.page_elements(spark, sf_dir))
    miss = looked.where(~F.col("found"))
    return SG.suggest_selectors(miss, A.dom_tokens(spark, sf_dir))


@register("not_found_summary", f"""with {S.a7_sql()},
lists as (select capture_id, selector, string_agg(suggestion, ', ' order by rank) as s from top group by all)
select m.capture_id, m.selector,
  case when l.s is not null then m.selector || ': element not found. Closest matches: ' || l.s
       else m.selector || ': element not found, no similar selectors detected.' end as summary
from miss m left join lists l using (capture_id, selector)
""")
def not_found_summary(spark, sf_dir):
    rows = SG.not_found_rows(A.selector_requests(spark, sf_dir), A.page_elements(spark, sf_dir),
                             A.dom_tokens(spark, sf_dir))
    return rows.select("capture_id", "selector",
                       AU.not_found_summary(F.col("selector"), F.col("suggestions")).alias("summary")).distinct()


# ---------------------------------------------------------------- payloads


@register("console_payloads", f"""with {S.console_payloads_sql()}
select capture_id, seq, level, message, source, has_stack from centries
""")
def console_payloads(spark, sf_dir):
    parsed = PL.parse_console_payloads(A.console_payloads(spark, sf_dir))
    e = PL.console_entries(parsed)
    n = R.normalize(e)
    return n.select("capture_id", "seq", "level", "message", "source",
                    F.col("stack").isNotNull().cast("bigint").alias("has_stack"))


@register("console_dump_payloads", f"""with {S.console_payloads_sql()}
select capture_id, seq, level, message, source, has_stack from centries
""")
def console_dump_payloads(spark, sf_dir):
    """The replies of ``console_payloads`` written as dumps of JSON lines and
    read as a stream, to the end of what is there."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/dumps-{uuid.uuid4().hex[:12]}"
    CP.write_captures(A.console_payloads(spark, sf_dir), f"{base}/in")
    q = (CP.stream_captures(spark, f"{base}/in", max_bytes=64 << 20).select("capture_id", "payload")
         .writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt").option("path", f"{base}/out")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    n = R.normalize(PL.console_entries(PL.parse_console_payloads(spark.read.parquet(f"{base}/out"))))
    return n.select("capture_id", "seq", "level", "message", "source",
                    F.col("stack").isNotNull().cast("bigint").alias("has_stack"))


@register("console_payload_kinds", f"""with {S.console_payloads_sql()}
select payload_kind, count(*) as n_payloads from ck group by payload_kind
""")
def console_payload_kinds(spark, sf_dir):
    parsed = PL.parse_console_payloads(A.console_payloads(spark, sf_dir))
    return parsed.groupBy("payload_kind").agg(F.count(F.lit(1)).alias("n_payloads"))


@register("element_payloads", f"""with {S.element_payloads_sql()}
select capture_id, pos, selector, not_found, n_styles, display, n_suggestions from eentries
""")
def element_payloads(spark, sf_dir):
    parsed = PL.parse_element_payloads(A.element_payloads(spark, sf_dir))
    e = PL.element_rows(parsed)
    return e.select("capture_id", F.col("pos").cast("bigint").alias("pos"), "selector",
                    F.col("not_found").cast("bigint").alias("not_found"),
                    F.cardinality("styles").cast("bigint").alias("n_styles"), F.col("styles")["display"].alias("display"),
                    F.coalesce(F.array_size("suggestions"), F.lit(0)).cast("bigint").alias("n_suggestions"))


@register("element_dump_payloads", f"""with {S.element_payloads_sql()}
select capture_id, pos, selector, not_found, n_styles, display, n_suggestions from eentries
""")
def element_dump_payloads(spark, sf_dir):
    """The replies of ``element_payloads`` written as dumps of JSON lines and
    read as a batch."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/dumps-{uuid.uuid4().hex[:12]}"
    CP.write_captures(A.element_payloads(spark, sf_dir), path)
    e = PL.element_rows(PL.parse_element_payloads(CP.read_captures(spark, path).select("capture_id", "payload")))
    return e.select("capture_id", F.col("pos").cast("bigint").alias("pos"), "selector",
                    F.col("not_found").cast("bigint").alias("not_found"),
                    F.cardinality("styles").cast("bigint").alias("n_styles"), F.col("styles")["display"].alias("display"),
                    F.coalesce(F.array_size("suggestions"), F.lit(0)).cast("bigint").alias("n_suggestions"))


@register("payload_quarantine", f"""with {S.console_payloads_sql()}, {S.element_payloads_sql().strip().replace('pl as (', 'pl2 as (', 1).replace('from pl)', 'from pl2)', 1).replace('pj0 as', 'epj0 as').replace('pj1 as', 'epj1 as').replace('pj2 as', 'epj2 as').replace('pp as', 'epp as').replace('from pj0', 'from epj0').replace('from pj1', 'from epj1').replace('from pj2', 'from epj2').replace('from pp', 'from epp')}
{S.quarantine_sql()}
""")
def payload_quarantine(spark, sf_dir):
    c = PL.quarantine(PL.parse_console_payloads(A.console_payloads(spark, sf_dir)), source="console")
    e = PL.quarantine(PL.parse_element_payloads(A.element_payloads(spark, sf_dir)), source="element")
    return c.unionByName(e)


# ---------------------------------------------------------------- reports


def _summary_query(severity, limit):
    def q(spark, sf_dir):
        _, s = RP.error_report(A.console_entries(spark, sf_dir), severity=severity, limit=limit)
        return s
    none = "No " + ("" if severity == "all" else severity + " ") + "messages found in console."
    sql = f"""with {A1_NORMALIZED},
issues as ({S.rollup_body_sql("n", severity, limit, ["capture_id"])}),
totals as (select capture_id, count(*) as total_log_entries from n group by capture_id),
per as (select capture_id, count(*) as unique_issues, max(case when issue_no = 1 then message end) as top_message
        from issues group by capture_id)
select t.capture_id, t.total_log_entries, coalesce(p.unique_issues, 0) as unique_issues,
  case when coalesce(p.unique_issues, 0) = 0 then {S.q(none)}
       else cast(p.unique_issues as varchar) || ' unique issue' || case when p.unique_issues > 1 then 's' else '' end
            || ' (from ' || cast(t.total_log_entries as varchar) || ' total log entries). Top: '
            || substring(p.top_message, 1, 100) end as summary
from totals t left join per p using (capture_id)
"""
    return q, sql


for _name, _args in {"error_summary": ("error", 20), "error_summary_all": ("all", 3)}.items():
    _fn, _sql = _summary_query(*_args)
    register(_name, _sql)(_fn)


@register("diagnose_batch", f"""with {S.a7_sql()}, {S.a7_diagnose_sql().strip()}
select capture_id, n_elements, n_with_issues, n_not_found, summary from diag
""")
def diagnose_batch(spark, sf_dir):
    _, batch = RP.diagnose(A.selector_requests(spark, sf_dir), A.page_elements(spark, sf_dir),
                           A.dom_tokens(spark, sf_dir))
    return batch


@register("diagnose_elements", f"""with {S.a7_sql()}, {S.a7_diagnose_sql().strip()},
lists as (select capture_id, selector, string_agg(suggestion, ', ' order by rank) as s from top group by all),
per as (
  select f.rid, {_HIGH_PART} as high_part, {_OTHER_PART} as other_part, count(*) as n
  from fired f group by f.rid
)
select l.capture_id, cast(l.pos as bigint) as pos, l.selector, cast(not l.found as bigint) as not_found,
  case when l.found and per.rid is null then concat(l.selector, ': No obvious visual issues detected. display:',
         coalesce(e."display", '?'), ', opacity:', coalesce(e."opacity", '?'), ', visibility:',
         coalesce(e."visibility", '?'), '.')
       when l.found then concat(l.selector, ': ', concat_ws('; ', high_part || ' (likely cause)', other_part))
       when li.s is not null then l.selector || ': element not found. Closest matches: ' || li.s
       else l.selector || ': element not found, no similar selectors detected.' end as summary
from looked l
left join fnd e on e.capture_id = l.capture_id and e.pos = l.pos
left join per on per.rid = e.rid
left join lists li on li.capture_id = l.capture_id and li.selector = l.selector
""")
def diagnose_elements(spark, sf_dir):
    report, _ = RP.diagnose(A.selector_requests(spark, sf_dir), A.page_elements(spark, sf_dir),
                            A.dom_tokens(spark, sf_dir))
    return report.select("capture_id", F.col("pos").cast("bigint").alias("pos"), "selector",
                         F.col("is_not_found").cast("bigint").alias("not_found"), "summary")


# ---------------------------------------------------------------- streaming


@register("error_rollup_stream", S.rollup_sql(A1_NORMALIZED, "n", "all", 20, ["capture_id"]))
def error_rollup_stream(spark, sf_dir):
    """The continuous rollup over the documents table read as a file stream
    (one file per trigger), run to the end of the available input."""
    docs_schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = (spark.readStream.schema(docs_schema).option("maxFilesPerTrigger", 1)
            .parquet(f"{sf_dir}/documents*.parquet"))
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"
    q = SR.start(A.console_entries_of(docs), f"{base}/out", f"{base}/ckpt", severity="all", limit=20,
                 trigger={"availableNow": True})
    q.awaitTermination()
    return SR.latest_report(spark, f"{base}/out")


# ---------------------------------------------------------------- sinks, validation


@register("error_report_json", f"""with {A1_NORMALIZED},
issues as ({S.rollup_body_sql("n", "error", 5, ["capture_id"])}),
totals as (select capture_id, count(*) as total_log_entries from n group by capture_id),
per as (
  select capture_id, count(*) as unique_issues, max(case when issue_no = 1 then message end) as top_message,
    to_json(list(json_object('level', level, 'message', message, 'count', count, 'source', source,
                             'stackTrace', null) order by issue_no)) as items
  from issues group by capture_id
)
select t.capture_id,
  json_object('summary',
    case when coalesce(p.unique_issues, 0) = 0 then 'No error messages found in console.'
         else cast(p.unique_issues as varchar) || ' unique issue' || case when p.unique_issues > 1 then 's' else '' end
              || ' (from ' || cast(t.total_log_entries as varchar) || ' total log entries). Top: '
              || substring(p.top_message, 1, 100) end,
    'details', json_object('total_log_entries', t.total_log_entries,
                           'unique_issues', coalesce(p.items, json('[]'))))::varchar as report
from totals t left join per p using (capture_id)
""")
def error_report_json(spark, sf_dir):
    issues, summary = RP.error_report(A.console_entries(spark, sf_dir), severity="error", limit=5)
    return SK.error_report_json(issues, summary)


@register("request_counts", """
select o_custkey as capture_id, count(*) as n_selectors, cast(count(*) > 20 as bigint) as too_many
from orders group by o_custkey
""")
def request_counts(spark, sf_dir):
    """Requests made of the orders: a capture per customer, a selector per order."""
    req = A.order_requests(spark, sf_dir)
    n = req.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n_selectors"))
    bad = SG.check_batch_size(req).select("capture_id", F.lit(1).cast("bigint").alias("too_many"))
    return n.join(bad, "capture_id", "left").select(
        "capture_id", "n_selectors", F.coalesce("too_many", F.lit(0)).cast("bigint").alias("too_many"))


@register("styles_no_box_map", f"""with {S.a6_sql()}
select capture_id, selector, property, value from a6_long where {S.css_keep_sql()} and not {S.box_sql()}
""")
def styles_no_box_map(spark, sf_dir):
    """The box model dropped on the map path, as reports do it."""
    e = AU.filter_styles(A.element_styles(spark, sf_dir), include_box_model=False)
    # ``explode`` would have Spark make and filter the map once more, to test its size
    x = e.select("capture_id", "selector", F.explode_outer("styles").alias("property", "value"))
    return x.where(F.col("property").isNotNull())


@register("payload_error_summary", f"""with {S.console_payloads_sql()},
n as (select capture_id, seq, level, message, source from centries),
issues as ({S.rollup_body_sql("n", "all", 20, ["capture_id"])}),
totals as (select capture_id, count(*) as total_log_entries from n group by capture_id),
per as (select capture_id, count(*) as unique_issues, max(case when issue_no = 1 then message end) as top_message
        from issues group by capture_id)
select c.capture_id, coalesce(t.total_log_entries, 0) as total_log_entries, coalesce(p.unique_issues, 0) as unique_issues,
  case when coalesce(p.unique_issues, 0) = 0 then 'No messages found in console.'
       else cast(p.unique_issues as varchar) || ' unique issue' || case when p.unique_issues > 1 then 's' else '' end
            || ' (from ' || cast(t.total_log_entries as varchar) || ' total log entries). Top: '
            || substring(p.top_message, 1, 100) end as summary
from (select capture_id from ck where payload_kind <> 'failed') c
left join totals t using (capture_id) left join per p using (capture_id)
""")
def payload_error_summary(spark, sf_dir):
    """Raw console payloads → entries → error report per capture; captures
    whose payload held no entries (markdown) report 'No messages found'."""
    # the parsed payloads feed three branches: parse once, write, read back
    parsed = materialize(PL.parse_console_payloads(A.console_payloads(spark, sf_dir)), "console_payloads")
    ok = parsed.where(F.col("payload_kind") != "failed").select("capture_id")
    _, summary = RP.error_report(PL.console_entries(parsed), severity="all", limit=20, captures=ok)
    return summary


_STYLE_JSON = ", ".join(f"'{k}', f.\"{k}\"" for k, _ in A.A7_STYLES)


@register("diagnose_json", f"""with {S.a7_sql()}, {S.a7_diagnose_sql().strip()},
issue_json as (
  select rid, to_json(list(case when note is null
      then json_object('type', type, 'property', property, 'value', value, 'severity', severity)
      else json_object('type', type, 'property', property, 'value', value, 'severity', severity, 'note', note) end
    order by rule_no)) as issues
  from fired group by rid
),
sugg as (select capture_id, selector, list(suggestion order by rank) as lst from top group by all),
det as (
  select l.capture_id, l.pos,
    case when l.found then json_object('selector', l.selector, 'issues', coalesce(ij.issues, json('[]')),
                                       'styles', json_object({_STYLE_JSON}))
         else json_object('selector', l.selector, 'not_found', true,
                          'suggestions', coalesce(to_json(sg.lst), json('[]'))) end as d
  from looked l
  left join fnd f on f.capture_id = l.capture_id and f.pos = l.pos
  left join issue_json ij on ij.rid = f.rid
  left join sugg sg on sg.capture_id = l.capture_id and sg.selector = l.selector
)
select det.capture_id,
  '{{"summary":' || to_json(diag.summary)::varchar || ',"details":{{"results":['
    || string_agg(d::varchar, ',' order by pos) || ']}}}}' as report
from det join diag using (capture_id)
group by det.capture_id, diag.summary
""")
def diagnose_json(spark, sf_dir):
    report, batch = RP.diagnose(A.selector_requests(spark, sf_dir), A.page_elements(spark, sf_dir),
                                A.dom_tokens(spark, sf_dir))
    return SK.diagnose_json(report, batch)


_PAYLOAD_PROPS = ["display", "opacity", "visibility"]


@register("payload_batch_summary", f"""with {S.element_payloads_sql()},
pe as (
  select row_number() over () as rid, capture_id, pos, selector, not_found,
    {", ".join(f"json_extract_string(r, '$.styles.{k}') as \"{k}\"" for k in _PAYLOAD_PROPS)}
  from ee_full
),
fired as ({S.issues_sql('pe', _PAYLOAD_PROPS)}),
iss as (select rid, row_number() over (partition by rid order by rule_no) as issue_no, property, value,
               case severity when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end as r
        from fired join pe using (rid) where not pe.not_found),
top_el as (
  select rid, arg_min(property, struct_pack(nr := -r, i := issue_no)) as property,
         arg_min(value, struct_pack(nr := -r, i := issue_no)) as value, max(r) as r from iss group by rid
),
el as (select pe.capture_id, pe.pos, pe.selector, pe.not_found = 1 as nf, t.rid is not null as has_issue,
              t.property, t.value, t.r
       from pe left join top_el t using (rid)),
g as (
  select capture_id, count(*) as n_elements, count(*) filter (where has_issue) as n_with_issues,
    count(*) filter (where nf) as n_not_found,
    arg_min(coalesce(selector, 'undefined') || ' ' || property || ':' || value,
            struct_pack(nr := -r, p := pos, s := selector, pp := property, v := value)) filter (where has_issue) as top
  from el group by capture_id
),
-- a reply that was understood but holds no element is a batch of none
b as (
  select ek.capture_id, coalesce(n_elements, 0) as n_elements, coalesce(n_with_issues, 0) as n_with_issues,
    coalesce(n_not_found, 0) as n_not_found, top
  from (select distinct capture_id from ek where payload_kind <> 'failed') ek left join g using (capture_id)
)
select capture_id, n_elements, n_with_issues, n_not_found,
  concat(cast(n_elements as varchar), ' element', case when n_elements > 1 then 's' else '' end,
         ' diagnosed, ', cast(n_with_issues as varchar), ' with issues',
         case when n_not_found > 0 then ', ' || cast(n_not_found as varchar) || ' not found' else '' end,
         case when top is not null then '. Top: ' || top else '' end, '.') as summary
from b
""")
def payload_batch_summary(spark, sf_dir):
    """Raw style payloads → elements → rules → batch summary per capture."""
    from webdiag import api
    return api.diagnose_element(style_payloads=A.element_payloads(spark, sf_dir)).batch


_RANK = S.rank_sql()


@register("payload_error_report_json", f"""with {S.console_payloads_sql()}, {S.a4_sql().strip()},
n as (select capture_id, seq, level, message, source, stack from centries),
f as (
  select *, {S.fingerprint_sql()} as fingerprint from n
  where {S.severity_where("all")} and not regexp_matches(message, {S.NOISE_RE})
),
g as (
  select capture_id, fingerprint, count(*) as count, min(seq) as first_seq,
    arg_min_null(level, seq) as level, arg_min_null(message, seq) as message,
    arg_min_null(source, seq) as source, arg_min_null(stack, seq) as stack, max({_RANK}) as severity_rank
  from f group by capture_id, fingerprint
),
issues as (
  select * from (select *, row_number() over (partition by capture_id
                   order by severity_rank desc, count desc, first_seq) as issue_no from g)
  where issue_no <= 20
),
istack as (select capture_id, issue_no as seq, stack from issues),
{S.frames_sql("istack", "i_").strip()},
gated as (select * from i_kept where {S.minified_sql()}),
{S.selection_sql("gated").strip()},
pos as (select distinct url, line, coalesce(col, 0) as col from gated where line >= 1 and coalesce(col, 0) >= 0),
hit as (
  select pos.url, pos.line, pos.col, s.source as r_source, s.orig_line as r_line, s.orig_col as r_col, s.name as r_name
  from pos asof left join segs s on pos.url = s.url and pos.line = s.gen_line and pos.col >= s.gen_col
),
ftext as (
  select k.capture_id, k.seq as issue_no, k.frame_no, h.r_source is not null as resolved,
    case when h.r_source is not null
         then concat('at ', coalesce(h.r_name, k.function_name, '?'), ' (', h.r_source, ':',
                     cast(h.r_line as varchar), ':', cast(h.r_col as varchar), ')')
         else {S.frame_text_sql().replace('raw', 'k.raw').replace('url', 'k.url').replace('line', 'k.line').replace('function_name', 'k.function_name').replace('coalesce(col', 'coalesce(k.col')} end as text
  from i_kept k left join hit h
    on {S.minified_sql('k.url', 'k.line', 'k.col')} and h.url = k.url and h.line = k.line and h.col = coalesce(k.col, 0)
),
st as (
  select capture_id, issue_no, to_json(list(text order by frame_no)) as frames,
         count(*) filter (where resolved) as resolved_count
  from ftext group by capture_id, issue_no
),
items as (
  select i.capture_id, i.issue_no, i.message,
    json_object('level', i.level, 'message', i.message, 'count', i.count, 'source', i.source,
                'stackTrace', case when coalesce(i.stack, '') = '' then null
                                   else coalesce(st.frames, json('[]')) end) as item,
    coalesce(st.resolved_count, 0) as resolved_count
  from issues i left join st on st.capture_id = i.capture_id and st.issue_no = i.issue_no
),
per as (
  select capture_id, count(*) as unique_issues, max(case when issue_no = 1 then message end) as top_message,
    to_json(list(item order by issue_no)) as lst, sum(resolved_count) as resolved
  from items group by capture_id
),
totals as (select capture_id, count(*) as total_log_entries from n group by capture_id),
caps as (select capture_id from ck where payload_kind <> 'failed')
select c.capture_id,
  json_object('summary',
    case when coalesce(p.unique_issues, 0) = 0 then 'No messages found in console.'
         else cast(p.unique_issues as varchar) || ' unique issue' || case when p.unique_issues > 1 then 's' else '' end
              || ' (from ' || cast(coalesce(t.total_log_entries, 0) as varchar) || ' total log entries). Top: '
              || substring(p.top_message, 1, 100) end,
    'details', json_object('total_log_entries', coalesce(t.total_log_entries, 0),
                           'unique_issues', coalesce(p.lst, json('[]')),
                           '_sourcemap_resolved', coalesce(p.resolved, 0)))::varchar as report
from caps c left join totals t using (capture_id) left join per p using (capture_id)
union all
select capture_id, '{{"_warning":' || to_json('Log extraction failed: ' || case when has_text and pj is null
      then 'invalid JSON in text payload' else 'Unrecognized console log response shape: ' || substring(payload, 1, 200) end)::varchar
    || ',"raw":' || case when json_valid(payload) then payload else to_json(payload)::varchar end || '}}' as report
from ck where payload_kind = 'failed'
""")
def payload_error_report_json(spark, sf_dir):
    """api.get_errors end to end: raw console payloads, severity all, stacks
    resolved through the A4 maps, one JSON envelope per capture."""
    from webdiag import api
    map_files, scripts = A.map_files_and_scripts(spark, sf_dir)
    r = api.get_errors(A.console_payloads(spark, sf_dir), severity="all", limit=20,
                       map_files=map_files, scripts=scripts)
    return r.report


@register("error_rollup_join", S.rollup_sql(A1_NORMALIZED, "n", "error", 20, ["capture_id"]))
def error_rollup_join(spark, sf_dir):
    """The flagship rollup with hash aggregation only: the representatives
    are fetched by a join back to the entries (first_entry="join")."""
    out = R.error_rollup(A.console_entries(spark, sf_dir), severity="error", limit=20, first_entry="join")
    return _bigint(out, "issue_no")


@register("object_stacks", """
with f as (
  select event_id, concat(event_type, json_extract_string(props, '$.k')) as fn,
    concat('https://cdn.example.com/u', cast(user_id as varchar), '.js') as url,
    cast(floor(value) as bigint) + 1 as line, cast(json_extract_string(props, '$.k') as bigint) as col from events
)
select cast(event_id as varchar) as capture_id,
  case event_id % 3
    when 1 then concat('at ? (', url, ':', cast(line as varchar), ':', cast(col as varchar), ')')
    else concat('at ', fn, ' (', url, ':', cast(line as varchar), ':', cast(col as varchar), ')') end as stack_trace
from f
""")
def object_stacks(spark, sf_dir):
    """Stacks of frame objects: with functionName/scriptUrl/lineNumber, without
    a name, and with name/url/line keys; internal frames beside them."""
    e = PL.console_entries(PL.parse_console_payloads(A.object_stack_payloads(spark, sf_dir)))
    c = AS.compress_with_maps(e, spark.createDataFrame([], "url string, gen_line bigint, gen_col bigint, next_gen_col bigint, "
                                                           "source string, orig_line bigint, orig_col bigint, name string"))
    return c.select("capture_id", F.array_join("stack_trace", "\n").alias("stack_trace"))


@register("noise_kinds", f"""
with l as (
  select (doc_id + generate_subscripts(string_split(text, chr(10)), 1) - 1) % 11 as kind,
         unnest(string_split(text, chr(10))) as line
  from documents
),
m as (
  select kind, line, case kind
    when 0 then concat('Warning: Each child in a list should have a unique "key" prop. ', line)
    when 1 then concat('Warning: React does not recognize the `', split_part(line, ' ', 1), '` prop on a DOM element')
    when 2 then concat('[HMR] ', line) when 3 then concat('[vite] ', line) when 4 then concat('Download the React DevTools ', line)
    when 5 then concat('Warning: ReactDOM.render is no longer supported ', line)
    when 6 then concat(line, ' IS Deprecated and will be removed') when 7 then concat('[webpack] ', line)
    when 8 then line when 9 then concat(line, ' [HMR] [vite]') else concat('warning: each child in a list ', line) end as message
  from l
)
select kind, count(*) as n, cast(sum(length(line)) as bigint) as chars from m where not regexp_matches(message, {S.NOISE_RE}) group by kind
""")
def noise_kinds(spark, sf_dir):
    """Every document line in one of eleven forms: the eight kinds of noise,
    alone, and two near misses. Lines that are no noise, by form."""
    e = R.drop_noise(A.noise_lines(spark, sf_dir))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("line").cast("bigint")).alias("chars"))


@register("noise_many_patterns", f"""
with l as (
  select source as capture_id, doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos,
         unnest(string_split(text, chr(10))) as line
  from documents
)
select capture_id, (doc_id + pos) % 3 as form, count(*) as n, cast(sum(length(line)) as bigint) as chars from l
where not case (doc_id + pos) % 3 when 0 then doc_id % 2500 < 1000 and doc_id % 2500 % 2 = 0
                                  when 1 then pos % 3000 < 1500 and pos % 3 = 0 else false end
  and not regexp_matches(case (doc_id + pos) % 3 when 0 then concat('Rule ', line) when 1 then concat(line, ' (code') else line end,
                         {S.NOISE_RE})
group by all
""")
def noise_many_patterns(spark, sf_dir):
    """A thousand patterns besides the eight, over every document line."""
    e = R.drop_noise(A.ruled_lines(spark, sf_dir), [*C.NOISE_PATTERNS, *A.MANY_PATTERNS])
    return e.groupBy("capture_id", "form").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("line").cast("bigint")).alias("chars"))
