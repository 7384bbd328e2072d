"""DuckDB spellings of the adapters and expressions, for the oracle side.

The oracle SQL re-derives each result from the parquet tables with plain
SQL, independently of the Spark code, so a match checks the Spark plan; the
fixed values are its own (``webdiag.plans.values``). Only the adapters'
expressions, which make the input, are shared.
"""

from __future__ import annotations

from webdiag.plans import values as V


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


NOISE_RE = q("|".join(V.NOISE_PATTERNS))

A1_ENTRIES = """
a1_lines as (
  select doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos,
         unnest(string_split(text, chr(10))) as line
  from documents
),
a1 as (
  select source as capture_id, doc_id * 2147483648 + pos as seq,
    case doc_id % 8 when 0 then 'error' when 1 then 'error' when 2 then 'warning' when 3 then 'warn'
                    when 4 then 'info' when 5 then 'log' when 6 then 'debug' else 'custom' end as level,
    case when doc_id % 13 = 0 then concat('[HMR] ', line)
         when doc_id % 17 = 0 then concat(line, ' Is Deprecated and will be removed')
         else concat(line, ' 0xA', cast(doc_id as varchar), ' (app.js:', cast(pos + 1 as varchar), ':',
                     cast(doc_id as varchar), ') id ', cast(doc_id * 7919 as varchar)) end as message,
    concat('https://', source, '.example.com/doc', cast(doc_id as varchar), '.js') as url
  from a1_lines
)"""


def rank_sql(level: str = "level") -> str:
    parts = " ".join(f"when {level} = {q(k)} then {v}" for k, v in V.SEVERITY_RANK.items())
    return f"(case {parts} else {V.UNKNOWN_RANK} end)"


def fingerprint_sql(level: str = "level", message: str = "message") -> str:
    n = (f"regexp_replace(regexp_replace(regexp_replace({message}, '0x[0-9a-f]+', '0x?', 'gi'), "
         f"':\\d+:\\d+', ':?:?', 'g'), '\\b\\d{{5,}}\\b', '?', 'g')")
    return f"concat({level}, '::', substring({n}, 1, {V.FINGERPRINT_CHARS}))"


def severity_where(severity: str, level: str = "level") -> str:
    return f"{rank_sql(level)} >= {V.SEVERITY_RANK.get(severity, V.UNKNOWN_RANK)}"


def rollup_sql(source_cte: str, source: str, severity: str, limit: int, by: list[str]) -> str:
    """Top-k issue groups (O3.1, O3.3, O5.1, O5.2) over a normalised entry
    relation ``source`` with columns by…, seq, level, message, source."""
    return f"with {source_cte},\n" + _rollup_steps(source, severity, limit, by)


def rollup_body_sql(source: str, severity: str, limit: int, by: list[str]) -> str:
    """The rollup query over relation ``source`` as a nested query (its own
    WITH, no outer CTEs), usable inside another CTE."""
    return "with " + _rollup_steps(source, severity, limit, by)


def _rollup_steps(source: str, severity: str, limit: int, by: list[str]) -> str:
    keys = ", ".join(by)
    kc = keys + ", " if by else ""
    part = f"partition by {keys} " if by else ""
    return f"""f as (
  select *, {fingerprint_sql()} as fingerprint from {source}
  where {severity_where(severity)} and not regexp_matches(message, {NOISE_RE})
),
g as (
  select {kc}fingerprint, count(*) as count, min(seq) as first_seq,
         arg_min_null(level, seq) as level, arg_min_null(message, seq) as message, arg_min_null(source, seq) as source,
         max({rank_sql()}) as severity_rank
  from f group by {kc}fingerprint
),
r as (
  select *, row_number() over ({part}order by severity_rank desc, count desc, first_seq) as issue_no from g
)
select {kc}issue_no, level, message, count, source, first_seq, fingerprint
from r where issue_no <= {limit}
"""


def a6_sql() -> str:
    """A6 in long form: base rows with a row id, and one row per present
    property (DuckDB)."""
    from webdiag.sources import adapters as A
    props = ",\n    ".join(f"{v} as \"{k}\"" for k, v in A.A6_PROPERTIES)
    longs = "\n  union all ".join(
        f"select rid, capture_id, pos, selector, {i} as prop_no, {q(k)} as property, \"{k}\" as value "
        f"from a6 where \"{k}\" is not null" for i, (k, _) in enumerate(A.A6_PROPERTIES))
    return f"""
a6 as (
  select row_number() over () as rid, {A.A6_CAPTURE} as capture_id, {A.A6_POS} as pos,
    {A.A6_SELECTOR} as selector,
    {props}
  from lineitem
),
a6_long as (
  {longs}
)"""


def css_keep_sql(prop: str = "property", value: str = "value") -> str:
    t1 = ", ".join(q(x) for x in V.TIER1)
    t2 = ", ".join(q(x) for x in V.TIER2)
    dull = ", ".join(q(x) for x in V.DULL_VALUES)
    return f"({prop} in ({t1}) or ({prop} in ({t2}) and {value} not in ({dull})))"


def box_sql(prop: str = "property") -> str:
    return f"{prop} in ({', '.join(q(x) for x in V.BOX_MODEL)})"


def pf_sql(v: str) -> str:
    """parseFloat in DuckDB."""
    return f"try_cast(nullif(regexp_extract({v}, {q(V.PARSE_FLOAT_RE)}, 1), '') as double)"


def issues_sql(src: str, present) -> str:
    """The 12 rules over a wide relation ``src`` (one column per property,
    quoted css names; ``present`` lists them, others are absent), one row
    per fired rule with ``rule_no``."""
    present = set(present)
    c = lambda k: f'"{k}"' if k in present else "cast(null as varchar)"
    op, w, h = pf_sql(c("opacity")), pf_sql(c("width")), pf_sql(c("height"))
    anch = " or ".join(f"(coalesce({c(s)}, '') <> '' and {c(s)} <> 'auto')" for s in ("top", "left", "right", "bottom"))
    rl = [
        (f"{c('display')} = 'none'", "'hidden'", "'display'", "'none'", "'high'", "null"),
        (f"{c('visibility')} in ('hidden', 'collapse')", "'hidden'", "'visibility'", c("visibility"), "'high'", "null"),
        (f"{op} = 0", "'invisible'", "'opacity'", "'0'", "'high'", "null"),
        (f"{op} <> 0 and {op} < 0.1", "'nearly-invisible'", "'opacity'", c("opacity"), "'medium'", "null"),
        (f"coalesce({c('clip-path')}, '') <> '' and {c('clip-path')} <> 'none'", "'clipped'", "'clip-path'", c("clip-path"), "'medium'", "null"),
        (f"{c('overflow')} = 'hidden' and ({w} = 0 or {h} = 0)", "'clipped-zero-size'", "'overflow+size'",
         f"concat('overflow:hidden with ', coalesce({c('width')}, 'undefined'), 'x', coalesce({c('height')}, 'undefined'))", "'high'", "null"),
        (f"{c('pointer-events')} = 'none'", "'unclickable'", "'pointer-events'", "'none'", "'low'", "null"),
        (f"{c('display')} in ('flex', 'grid') and {c('overflow')} = 'hidden'", "'flex-grid-overflow-hidden'", "'overflow'", "'hidden'", "'low'", q(V.NOTE_FLEX_OVERFLOW)),
        (f"{w} = 0 and {c('min-width')} is distinct from '0px' and {c('max-width')} is distinct from '0px'", "'zero-width'", "'width'", c("width"), "'high'", "null"),
        (f"{h} = 0 and {c('min-height')} is distinct from '0px'", "'zero-height'", "'height'", c("height"), "'high'", "null"),
        (f"{c('position')} in ('absolute', 'fixed') and not coalesce({anch}, false)", "'unanchored-positioned'", "'position'", c("position"), "'low'",
         "concat('position:', " + c("position") + ", " + q(V.NOTE_UNANCHORED.split("{}")[1]) + ")"),
        (f"coalesce({c('z-index')}, '') <> '' and {c('z-index')} <> 'auto' and {c('position')} = 'static'", "'ineffective-z-index'", "'z-index'", c("z-index"), "'low'", q(V.NOTE_Z_INDEX)),
    ]
    parts = [f"select rid, {i} as rule_no, {t} as type, {p} as property, {v} as value, {s} as severity, "
             f"cast({n} as varchar) as note from {src} where coalesce({cond}, false)"
             for i, (cond, t, p, v, s, n) in enumerate(rl)]
    return "\n  union all ".join(parts)


def a2_frames_sql() -> str:
    """A2 stacks split, trimmed and parsed (DuckDB): relation ``parsed``
    (capture_id, seq, frame_no, function_name, url, line, col, raw)."""
    from webdiag.sources import adapters as A
    return f"""
a2 as (select cast(user_id as varchar) as capture_id, event_id as seq, {A.A2_STACK} as stack from events),
{frames_sql("a2")}"""


def frames_sql(src: str, prefix: str = "") -> str:
    """Split, trim, parse and keep the first 3 non-internal frames of the
    stacks of relation ``src(capture_id, seq, stack)`` (DuckDB): relations
    ``{prefix}parsed`` and ``{prefix}kept``."""
    RE = q(V.FRAME_RE)
    return f"""
{prefix}a2_lines as (
  select capture_id, seq, generate_subscripts(string_split(stack, chr(10)), 1) as lpos,
         unnest(string_split(stack, chr(10))) as line
  from {src} where coalesce(stack, '') <> ''
),
{prefix}a2_trim as (select capture_id, seq, lpos, regexp_replace(line, {q(V.TRIM_RE)}, '', 'g') as t
                   from {prefix}a2_lines),
{prefix}a2_m as (select *, regexp_matches(t, {RE}) as m from {prefix}a2_trim where t <> ''),
{prefix}parsed as (
  select capture_id, seq, row_number() over (partition by capture_id, seq order by lpos) as frame_no,
    case when m then nullif(regexp_extract(t, {RE}, 1), '') end as function_name,
    case when m then regexp_extract(t, {RE}, 2) end as url,
    case when m then try_cast(regexp_extract(t, {RE}, 3) as bigint) end as line,
    case when m then try_cast(regexp_extract(t, {RE}, 4) as bigint) end as col,
    t as raw
  from {prefix}a2_m
),
{prefix}kept as (
  select capture_id, seq, row_number() over (partition by capture_id, seq order by frame_no) as frame_no,
         function_name, url, line, col, raw
  from {prefix}parsed
  where not regexp_matches(concat(coalesce(url, ''), ' ', coalesce(function_name, ''), ' ', coalesce(raw, '')),
                           {q(V.INTERNAL_RE)})
  qualify row_number() over (partition by capture_id, seq order by frame_no) <= {V.KEEP_FRAMES}
)"""


def frame_text_sql() -> str:
    return ("case when coalesce(raw, '') <> '' and coalesce(url, '') = '' then raw "
            "when coalesce(url, '') <> '' and line is not null then concat('at ', coalesce(function_name, '?'), "
            "' (', url, ':', cast(line as varchar), ':', cast(coalesce(col, 0) as varchar), ')') "
            "else coalesce(raw, concat('at ', coalesce(function_name, '?'))) end")


def fold_sql(p: str) -> str:
    body = "string_split(" + p + ", '/')[2:]"
    folded = (f"list_reduce({body}, "
              "lambda acc, x: case when x = '.' then acc when x = '..' then acc[1:len(acc) - 1] "
              "else list_append(acc, x) end, []::varchar[])")
    folded = f"(case when {body}[-1] in ('.', '..') then list_append({folded}, '') else {folded} end)"
    return f"('/' || array_to_string({folded}, '/'))"


def resolve_url_sql(ref: str, base: str) -> str:
    """DuckDB form of ``webdiag.functions.urls.resolve_url``."""
    origin = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"
    bpath = f"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
    bdir = f"coalesce(nullif(regexp_extract({bpath}, '^(.*/)', 1), ''), '/')"
    rpath = f"regexp_extract({ref}, '^([^?#]*)', 1)"
    rrest = f"regexp_extract({ref}, '^[^?#]*(.*)\\z', 1)"
    return f"""(case when {ref} is null or {base} is null then null
  when regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') then {ref}
  when starts_with({ref}, '//') then regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1) || ':' || {ref}
  when starts_with({ref}, '/') then {origin} || {fold_sql(rpath)} || {rrest}
  when starts_with({ref}, '?') then regexp_replace({base}, '[?#].*\\z', '') || {ref}
  when starts_with({ref}, '#') then regexp_replace({base}, '#.*\\z', '') || {ref}
  when {ref} = '' then regexp_replace({base}, '#.*\\z', '')
  else {origin} || {fold_sql(f"{bdir} || {rpath}")} || {rrest} end)"""


def minified_sql(url: str = "url", line: str = "line", col: str = "col") -> str:
    return (f"(coalesce({url}, '') <> '' and coalesce(regexp_matches({url}, {q(V.MINIFIED_URL_RE)}) "
            f"or ({line} = 1 and {col} > {V.MINIFIED_MIN_COLUMN}), regexp_matches({url}, {q(V.MINIFIED_URL_RE)}), false))")


def a4_sql() -> str:
    """A4 facts deduplicated on the generated position, hosting tables, and
    which frame url resolves through which customer's map (DuckDB)."""
    from webdiag.sources import adapters as A
    facts = ",\n    ".join(f"{e} as {n}" for n, e in A.A4_FACTS)
    copy = f"'{A.MAP_DIR}app' || cast(cust as varchar) || '.js.map'"
    return f"""
a4_all as (select {facts} from orders),
a4 as (select * from a4_all qualify okey = min(okey) over (partition by url, gen_line, gen_col)),
a4_docs as (select distinct cust, url, ({A.A4_BAD_VERSION}) as bad_version from a4),
hosted as (
  select case when cust % 3 = 0 then url || '.map' end as murl, cust, ({A.A4_BROKEN_SIBLING}) as not_json from a4_docs
  union all
  select case when cust % 3 <> 2 then {copy} end as murl, cust, false as not_json from a4_docs
),
map_files as (select * from hosted where murl is not null),
scripts as (
  select url as surl, cust, case when cust % 3 = 2 then 'data' else 'url' end as ref_kind,
    case when cust % 3 <> 2 then {resolve_url_sql("'../maps/app' || cast(cust as varchar) || '.js.map'", 'url')} end as ref_url
  from a4_docs
)"""


def selection_sql(urls: str) -> str:
    """Map selection for the distinct urls of relation ``urls`` (DuckDB):
    relation ``sel(url, map_origin, map_url, cust, usable)``."""
    return f"""
sel as (
  select u.url,
    case when m1.murl is not null then 'sibling' when s.ref_kind = 'data' then 'inline'
         when m2.murl is not null then 'reference' end as map_origin,
    case when m1.murl is not null then m1.murl when s.ref_kind = 'url' and m2.murl is not null then m2.murl end as map_url,
    case when m1.murl is not null then m1.cust when s.ref_kind = 'data' then s.cust else m2.cust end as cust,
    case when m1.murl is not null then not m1.not_json else true end as parses
  from (select distinct url from {urls}) u
  left join map_files m1 on m1.murl = regexp_replace(u.url, '\\?.*\\z', '') || '.map'
  left join scripts s on m1.murl is null and s.surl = u.url
  left join map_files m2 on m1.murl is null and s.ref_kind = 'url' and m2.murl = s.ref_url
),
usable as (
  select sel.url, sel.cust from sel join a4_docs d on d.cust = sel.cust
  where sel.parses and not d.bad_version
),
segs as (
  select usable.url, a4.gen_line, a4.gen_col, {normalize_source_sql('a4.source')} as source,
    a4.orig_line, a4.orig_col, a4.name
  from usable join a4 on a4.cust = usable.cust
)"""


def a7_sql() -> str:
    """A7 tokens, elements, requests, misses and candidate suggestions (DuckDB)."""
    from webdiag.sources import adapters as A
    reqs = "[" + ", ".join(q(s) for s in A.A7_REQUESTS) + "]"
    ids = f"list_transform(regexp_extract_all(selector, {q(V.ID_TOKEN_RE)}, 1), lambda t: lower(t))"
    cls = f"list_transform(regexp_extract_all(selector, {q(V.CLASS_TOKEN_RE)}, 1), lambda t: lower(t))"
    return f"""
a7_raw as (
  select cast(p_size as varchar) as capture_id, 'id' as kind, {A.A7_ID} as token, p_partkey as doc_order from part
  union all
  select cast(p_size as varchar), 'class', {A.A7_CLASS}, p_partkey from part
),
dom as (
  select capture_id, kind, token, lower(token) as lc, min(doc_order) as doc_order
  from a7_raw where length(coalesce(token, '')) > 0 group by capture_id, kind, token
),
els as (select distinct capture_id, '#' || token as selector from a7_raw where kind = 'id'),
caps as (select distinct cast(p_size as varchar) as capture_id from part),
req as (
  select capture_id, generate_subscripts({reqs}, 1) - 1 as pos, unnest({reqs}) as selector from caps
),
looked as (
  select r.capture_id, r.pos, r.selector, e.selector is not null as found
  from req r left join els e on e.capture_id = r.capture_id and e.selector = r.selector
),
miss as (select distinct capture_id, selector from looked where not found),
toks0 as (
  select capture_id, selector, {ids} as ids, {cls} as cls,
    coalesce(list_max(list_transform(list_concat({ids}, {cls}), lambda t: length(t))), 0) as ref_len
  from miss
),
toks as (
  select distinct capture_id, selector, ref_len, 'id' as kind, unnest(ids) as want from toks0
  union
  select distinct capture_id, selector, ref_len, 'class' as kind, unnest(cls) as want from toks0
),
cand as (
  select distinct t.capture_id, t.selector, t.ref_len, d.kind, d.token, d.doc_order
  from dom d join toks t on d.capture_id = t.capture_id and d.kind = t.kind
    and (d.lc = t.want or contains(d.lc, t.want) or contains(t.want, d.lc))
),
ranked as (
  select capture_id, selector,
    (case when kind = 'id' then '#' else '.' end) || token as suggestion,
    row_number() over (partition by capture_id, selector
      order by abs(length((case when kind = 'id' then '#' else '.' end) || token) - ref_len),
               kind = 'class', doc_order, (case when kind = 'id' then '#' else '.' end) || token) as rank
  from cand
),
top as (select * from ranked where rank <= 5)"""


def shaped_sql(shapes, col: str, key: str) -> str:
    n = len(shapes)
    def tail(suf):
        pieces = suf if isinstance(suf, list) else [suf]
        return " || ".join(f"({x[1]})" if isinstance(x, tuple) else q(x) for x in pieces)
    parts = " ".join(f"when {i} then " + (q(pre) if suf is None else f"{q(pre)} || {col} || {tail(suf)}")
                     for i, (pre, suf) in enumerate(shapes))
    return f"(case {key} % {n} {parts} end)"


def _truthy_sql(j: str, path: str) -> str:
    t = f"json_type({j}, {q(path)})"
    return (f"(case when {t} is null or {t} = 'NULL' then false "
            f"when {t} = 'BOOLEAN' then cast(json_extract({j}, {q(path)}) as boolean) "
            f"when {t} = 'VARCHAR' then json_extract_string({j}, {q(path)}) <> '' "
            f"when {t} in ('BIGINT', 'UBIGINT', 'DOUBLE') then cast(json_extract({j}, {q(path)}) as double) <> 0 "
            f"else true end)")


def payloads_sql(shapes, kind: str) -> str:
    """Parsed payload relation ``pp`` (DuckDB): capture_id, payload, j, text, pj."""
    return f"""
pl as (select cast(event_id as varchar) as capture_id, {shaped_sql(shapes, 'event_type', 'event_id')} as payload from events),
pj0 as (select *, case when json_valid(payload) then payload end as j from pl),
pj1 as (select *, json_extract_string(j, '$.content[0].text') as text from pj0),
pj2 as (select *, case when regexp_matches(text, {q(V.FENCE_RE)}) then regexp_extract(text, {q(V.FENCE_RE)}, 1) else text end as jt from pj1),
pp as (select *, case when json_valid(jt) then jt end as pj, coalesce(text, '') <> '' as has_text from pj2)"""


def console_payloads_sql() -> str:
    from webdiag.sources import adapters as A
    return payloads_sql(A.A8_SHAPES, "console") + f""",
ck as (
  select *, case
    when json_type(j) = 'ARRAY' then 'array'
    when json_type(j, '$.result') = 'ARRAY' then 'result'
    when json_type(j, '$.logs') = 'ARRAY' then 'logs'
    when json_type(j, '$.messages') = 'ARRAY' then 'messages'
    when has_text and (regexp_matches(text, {q(V.NO_MESSAGES_RE)}) or regexp_matches(text, {q(V.MARKDOWN_HEADING_RE)})) then 'markdown'
    when has_text and (json_type(pj) = 'ARRAY' or json_type(pj, '$.result') = 'ARRAY'
                       or json_type(pj, '$.messages') = 'ARRAY' or json_type(pj, '$.logs') = 'ARRAY') then 'text'
    else 'failed' end as payload_kind
  from pp
),
cl as (
  select *, case payload_kind when 'array' then j when 'result' then json_extract(j, '$.result')
    when 'logs' then json_extract(j, '$.logs') when 'messages' then json_extract(j, '$.messages')
    when 'text' then case when json_type(pj) = 'ARRAY' then pj
                          when json_type(pj, '$.result') = 'ARRAY' then json_extract(pj, '$.result')
                          when json_type(pj, '$.messages') = 'ARRAY' then json_extract(pj, '$.messages')
                          else json_extract(pj, '$.logs') end end as logs
  from ck
),
ce as (
  select capture_id, generate_subscripts(json_extract(logs, '$[*]'), 1) - 1 as seq,
         unnest(json_extract(logs, '$[*]')) as e
  from cl where logs is not null
),
centries as (
  select capture_id, cast(seq as bigint) as seq,
    coalesce(json_extract_string(e, '$.level'), json_extract_string(e, '$.type'), 'log') as level,
    coalesce(json_extract_string(e, '$.text'), json_extract_string(e, '$.message'), '') as message,
    coalesce(json_extract_string(e, '$.source'), json_extract_string(e, '$.url')) as source,
    cast(coalesce(json_type(e, '$.stackTrace'), 'NULL') <> 'NULL' or coalesce(json_type(e, '$.stack'), 'NULL') <> 'NULL' as bigint) as has_stack,
    case when json_type(e, '$.stackTrace') = 'VARCHAR' then json_extract_string(e, '$.stackTrace') end as stack
  from ce
)"""


def element_payloads_sql() -> str:
    from webdiag.sources import adapters as A
    return payloads_sql(A.A9_SHAPES, "element") + f""",
ek as (
  select *, case
    when has_text and pj is null then 'failed'
    when has_text and json_type(pj) = 'NULL' then 'failed'
    when has_text and {_truthy_sql('pj', '$.results')} then 'text'
    when has_text and {_truthy_sql('pj', '$.result.results')} then 'text_result'
    when {_truthy_sql('j', '$.results')} then 'direct'
    when {_truthy_sql('j', '$.result.results')} then 'result'
    else 'failed' end as payload_kind
  from pp
),
er as (
  select *, case payload_kind when 'text' then json_extract(pj, '$.results') when 'text_result' then json_extract(pj, '$.result.results')
    when 'direct' then json_extract(j, '$.results') when 'result' then json_extract(j, '$.result.results') end as res
  from ek
),
ee as (
  select capture_id, generate_subscripts(json_extract(res, '$[*]'), 1) - 1 as pos, unnest(json_extract(res, '$[*]')) as r
  from er where json_type(res) = 'ARRAY'
),
ee_full as (
  select capture_id, cast(pos as bigint) as pos, r, json_extract_string(r, '$.selector') as selector,
    cast({_truthy_sql('r', '$.notFound')} as bigint) as not_found
  from ee
),
eentries as (
  select capture_id, cast(pos as bigint) as pos, json_extract_string(r, '$.selector') as selector,
    cast({_truthy_sql('r', '$.notFound')} as bigint) as not_found,
    cast(coalesce(len(json_keys(r, '$.styles')), 0) as bigint) as n_styles,
    json_extract_string(r, '$.styles.display') as display,
    cast(coalesce(json_array_length(r, '$.suggestions'), 0) as bigint) as n_suggestions
  from ee
)"""


def quarantine_sql() -> str:
    return """
select capture_id, 'console' as source,
  'Log extraction failed: ' || case when has_text and pj is null then 'invalid JSON in text payload'
    else 'Unrecognized console log response shape: ' || substring(payload, 1, 200) end as warning,
  payload as raw
from ck where payload_kind = 'failed'
union all
select capture_id, 'element' as source,
  'Style extraction failed: ' || case when has_text and pj is null then 'invalid JSON in text payload'
    when has_text and json_type(pj) = 'NULL' then 'Script returned null'
    else 'Unrecognized response shape: ' || substring(payload, 1, 200) end as warning,
  payload as raw
from ek where payload_kind = 'failed'"""


def a7_diagnose_sql() -> str:
    """Element diagnosis of the A7 requests (DuckDB): relation ``diag``
    (capture_id, n_elements, n_with_issues, n_not_found, summary)."""
    from webdiag.sources import adapters as A
    cols = ",\n    ".join(f"{v} as \"{k}\"" for k, v in A.A7_STYLES)
    return f"""
a7_el as (
  select cast(p_size as varchar) as capture_id, '#' || {A.A7_ID} as selector, p_partkey as doc_order,
    {cols}
  from part
  qualify p_partkey = min(p_partkey) over (partition by cast(p_size as varchar), '#' || {A.A7_ID})
),
fnd as (
  select row_number() over () as rid, l.capture_id, l.pos, l.selector, e.*
  from looked l join a7_el e on e.capture_id = l.capture_id and e.selector = l.selector
),
fired as ({issues_sql('fnd', [k for k, _ in A.A7_STYLES])}),
iss as (select rid, row_number() over (partition by rid order by rule_no) as issue_no, property, value,
               case severity when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end as r from fired),
top_el as (
  select rid, arg_min(property, struct_pack(nr := -r, i := issue_no)) as property,
         arg_min(value, struct_pack(nr := -r, i := issue_no)) as value, max(r) as r from iss group by rid
),
el as (
  select l.capture_id, l.pos, l.selector, not l.found as nf, t.rid is not null as has_issue, t.property, t.value, t.r
  from looked l left join fnd f on f.capture_id = l.capture_id and f.pos = l.pos
  left join top_el t on t.rid = f.rid
),
g as (
  select capture_id, count(*) as n_elements, count(*) filter (where has_issue) as n_with_issues,
    count(*) filter (where nf) as n_not_found,
    arg_min(selector || ' ' || property || ':' || value,
            struct_pack(nr := -r, p := pos, s := selector, pp := property, v := value)) filter (where has_issue) as top
  from el group by capture_id
),
diag as (
  select capture_id, n_elements, n_with_issues, n_not_found,
    concat(cast(n_elements as varchar), ' element', case when n_elements > 1 then 's' else '' end,
           ' diagnosed, ', cast(n_with_issues as varchar), ' with issues',
           case when n_not_found > 0 then ', ' || cast(n_not_found as varchar) || ' not found' else '' end,
           case when top is not null then '. Top: ' || top else '' end, '.') as summary
  from g
)"""


def normalize_source_sql(src: str) -> str:
    """DuckDB form of ``webdiag.functions.urls.normalize_source``."""

    def norm(p):
        folded = ("array_to_string(list_reduce(regexp_split_to_array(" + p + ", '/+'), "
                  "lambda acc, x: case when x = '.' then acc "
                  "when x = '..' and len(acc) > 0 and acc[-1] <> '..' and acc[-1] <> '' then acc[1:len(acc) - 1] "
                  "when x = '..' and len(acc) > 0 and acc[-1] = '' then acc "
                  "else list_append(acc, x) end, []::varchar[]), '/')")
        return (f"(case when {folded} = '' then (case when starts_with({p}, '/') then '/' else '.' end) "
                f"else {folded} end)")
    re_ = q(V.SOURCE_URL_RE)
    rest = f"regexp_extract({src}, {re_}, 2)"
    return (f"(case when {src} is null then null "
            f"when regexp_matches({src}, {re_}) and {rest} = '' then {src} "
            f"when regexp_matches({src}, {re_}) then regexp_extract({src}, {re_}, 1) || {norm(rest)} "
            f"else {norm(src)} end)")
