"""Source maps as tables: pick the map of each script url (O1.8–O1.11,
O4.4) and decode maps into position segments (O7.3).

``map_files(url, map_json)`` plays the part of fetchable map documents and
``scripts(url, body)`` the part of fetchable script bodies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webdiag.operators.common import map_arrow
from webdiag.functions import urls as U
from webdiag.functions import vlq

# --- fixed values (must equal the reference's for equal results) ---------
MAP_REFERENCE_RE = r"//[#@]\s*sourceMappingURL=(\S+)"
DATA_BASE64_RE = r";base64,(.*)\z"
SUPPORTED_VERSION = 3
XSSI_RE = r"\A\)\]\}'[^\n]*\n"
SECTION_START = "A,"  # a 1-field segment at column 0: where a section begins
# ------------------------------------------------------------------------

BLOCK = 1 << 19  # characters of mappings that are decoded together
LEAD_COLUMNS = 16384  # columns of a line whose positions are sorted together

_MAP_FIELDS = "version:int,sourceRoot:string,sources:array<string>,names:array<string>,mappings:string"
MAP_SCHEMA = (f"struct<{_MAP_FIELDS},file:string,"
              f"sections:array<struct<offset:struct<line:bigint,column:bigint>,url:string,map:struct<{_MAP_FIELDS}>>>>")


def map_references(scripts: DataFrame) -> DataFrame:
    """Per script: the first ``sourceMappingURL`` reference, its kind, the
    decoded inline map (``data:…;base64,``) and the absolute map url."""
    ref = F.nullif(F.regexp_extract("body", MAP_REFERENCE_RE, 1), F.lit(""))
    is_data = ref.startswith("data:")
    b64 = F.regexp_extract(ref, DATA_BASE64_RE, 1)
    inline = F.when(is_data & ref.rlike(DATA_BASE64_RE),
                    F.try_to_binary(b64, F.lit("base64")).cast("string"))
    return scripts.select(
        "*", ref.alias("ref"),
        F.when(ref.isNull(), F.lit(None)).when(is_data, F.lit("data")).otherwise(F.lit("url")).alias("ref_kind"),
        inline.alias("inline_json"),
        F.when(ref.isNotNull() & ~is_data, U.resolve_url(ref, F.col("url"))).alias("ref_url"))


def select_maps(urls: DataFrame, map_files: DataFrame, scripts: DataFrame) -> DataFrame:
    """For each distinct script ``url``: the map text to use, and where it
    came from. ``<url without query>.map`` wins when that file exists (even
    if it is broken); else the script's reference: inline data, or the
    referenced file. No map → nulls (the url stays unresolved).

    Choosing works on urls alone: only scripts that need it are searched for
    a reference, and the texts of the chosen files join last."""
    u = (urls.select("url").where(F.col("url").isNotNull()).distinct()
         .withColumn("sib_url", F.concat(U.strip_query(F.col("url")), F.lit(".map"))))
    files = map_files.select(F.col("url").alias("file_url")).distinct()
    u = u.join(files, u.sib_url == files.file_url, "left").select("url", "sib_url", F.col("file_url").isNotNull().alias("has_sib"))
    need = u.where(~F.col("has_sib")).select("url")
    refs = (map_references(scripts.select("url", "body").join(need, "url", "left_semi"))
            .groupBy("url").agg(F.min(F.struct("ref_kind", "inline_json", "ref_url")).alias("r"))  # few rows per url
            .select("url", "r.*"))
    refs = refs.join(files, refs.ref_url == files.file_url, "left").select(
        "url", "ref_kind", "inline_json", "ref_url", F.col("file_url").isNotNull().alias("has_ref"))
    out = u.join(refs, "url", "left")
    origin = (F.when(F.col("has_sib"), F.lit("sibling"))
              .when(F.col("ref_kind") == "data", F.when(F.col("inline_json").isNotNull(), F.lit("inline")))
              .when(F.col("has_ref"), F.lit("reference")))
    map_url = F.when(F.col("has_sib"), F.col("sib_url")).when(
        F.col("ref_kind") == "url", F.when(F.col("has_ref"), F.col("ref_url")))
    picked = out.select("url", origin.alias("map_origin"), map_url.alias("map_url"),
                        F.when(~F.col("has_sib") & (F.col("ref_kind") == "data"), F.col("inline_json")).alias("inline_json"))
    # a file hosted twice under one url: one of them, the same one on every run
    texts = (map_files.select(F.col("url").alias("text_url"), "map_json")
             .join(picked.select(F.col("map_url").alias("text_url")).distinct(), "text_url", "left_semi")
             .groupBy("text_url").agg(F.min("map_json").alias("file_json")))
    return picked.join(texts, picked.map_url == texts.text_url, "left").select(
        "url", "map_origin", "map_url", F.coalesce("inline_json", "file_json").alias("map_json"))


def _map_parts(maps: DataFrame) -> DataFrame:
    """(map_id, parts) from one parse of each map of ``maps(map_id, map_json)``:
    a plain map is one part at offset (0, 0); an indexed map (``sections``)
    one part per section with its generated offset. A section given by ``url``
    instead of an inline map fails the whole map (null)."""
    m = maps.select("map_id", F.from_json(F.regexp_replace("map_json", XSSI_RE, ""), MAP_SCHEMA).alias("m"))
    valid = F.coalesce((F.col("m.version") == SUPPORTED_VERSION) &
                       ~F.coalesce(F.exists("m.sections", lambda x: x["url"].isNotNull()), F.lit(False)),
                       F.lit(False))
    fields = ["version", "sourceRoot", "sources", "names", "mappings"]
    zero = F.lit(0).cast("bigint")

    def part(sec_no, line, col, src, is_section):
        return F.struct(sec_no.cast("bigint").alias("section_no"), line.alias("off_line"), col.alias("off_col"),
                        F.lit(is_section).alias("is_section"), *[src[c].alias(c) for c in fields])
    plain = F.array(part(zero, zero, zero, F.col("m"), False))
    sections = F.transform("m.sections", lambda x, i: part(
        i, F.coalesce(x["offset"]["line"], zero), F.coalesce(x["offset"]["column"], zero), x["map"], True))
    arr = F.when(~valid, F.lit(None)).when(F.col("m.sections").isNull(), plain).otherwise(sections)
    return m.select("map_id", F.filter(arr, lambda p: p["version"] == SUPPORTED_VERSION).alias("parts"))


_POSITIONS = ("map_id string, section_no bigint, seg_no bigint, gen_line bigint, gen_col bigint, src_idx bigint, "
              "orig_line bigint, orig_col bigint, name_idx bigint, blocker int")


def _positions(parts: DataFrame) -> DataFrame:
    """The decoded positions of ``parts(map_id, parts)``, none of a map with a
    malformed segment. Mappings are decoded ``BLOCK`` characters at a time, of
    many small maps or of a piece of a large one, so a task holds one map's
    text and one block of numbers."""
    block = BLOCK
    own = parts.select("map_id", F.transform("parts", lambda p: F.struct(
        p["section_no"].alias("section_no"), p["off_line"].alias("off_line"), p["off_col"].alias("off_col"),
        p["is_section"].alias("is_section"), F.encode(F.concat(
            # a section starts with a 1-field segment at its column 0 (changes no VLQ state)
            F.when(p["is_section"], F.lit(SECTION_START)).otherwise(F.lit("")),
            F.coalesce(p["mappings"], F.lit(""))), "UTF-8").alias("mappings"))).alias("parts"))

    def run(batches):
        names = [c.split()[0] for c in _POSITIONS.split(", ")]
        for batch in batches:
            small, held = [], 0
            for map_id, secs in zip(batch.column(0), batch.column(1)):
                secs = secs.as_py() or []
                size = sum(len(p["mappings"]) for p in secs)
                if size > block:
                    if all(good for p in secs for *_, good in _pieces(p["mappings"], block)):
                        for p in secs:
                            for table, _ in _pieces(p["mappings"], block):
                                yield _rows([map_id.as_py()], [p], table, names)
                    continue
                if held + size > block:
                    yield _small(small, names)
                    small, held = [], 0
                small.append((map_id.as_py(), secs))
                held += size
            yield _small(small, names)
    return map_arrow(own, run, _POSITIONS)


def _pieces(text: bytes, block: int):
    """(segments, well-formed) of mappings, piece by piece, each with what the
    pieces before it add up to."""
    at, carried = 0, [0] * 7  # line, place in the line, column, four sums
    while at <= len(text):
        cut = min(at + block, len(text))
        while cut < len(text) and text[cut] not in b",;":
            cut += 1
        table, ending, good = vlq.decode_pieces([text[at:cut]])
        first = table[1] == 0
        table[4] = table[4] + np.where(first, carried[2], 0)
        table[2] = table[2] + np.where(first, carried[1], 0)
        table[1] = table[1] + carried[0]
        for i in range(4):
            table[5 + i] = table[5 + i] + carried[3 + i]
        yield table, bool(good[0])
        ending = [int(x[0]) for x in ending]
        if ending[0] == 0:
            ending[1:3] = ending[1] + carried[1], ending[2] + carried[2]
        carried = [ending[0] + carried[0], *ending[1:3], *[x + y for x, y in zip(ending[3:], carried[3:])]]
        if text[cut:cut + 1] == b";":
            carried[:3] = carried[0] + 1, 0, 0
        at = cut + 1


def _small(maps, names) -> pa.RecordBatch:
    """Positions of maps whose mappings are decoded together."""
    ids = [map_id for map_id, secs in maps for _ in secs]
    secs = [p for _, secs in maps for p in secs]
    if not secs:
        return _rows([], [], [np.zeros(0, np.int64)] * 9, names)
    table, _, good = vlq.decode_pieces([p["mappings"] for p in secs])
    if not good.all():
        bad = {ids[i] for i in np.flatnonzero(~good)}
        return _small([m for m in maps if m[0] not in bad], names)
    return _rows(ids, secs, table, names)


def _rows(ids, secs, table, names) -> pa.RecordBatch:
    piece, line, place, fields, column, *sums = table
    of = lambda name: np.array([p[name] for p in secs], np.int64)[piece] if secs else piece
    src = fields < 4
    opt = lambda x, null: pa.array(x, pa.int64(), mask=null)
    first = (line == 0) & (of("is_section") == 1)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.string()).take(pa.array(piece)) if ids else pa.array([], pa.string()), pa.array(of("section_no"), pa.int64()),
        pa.array(place, pa.int64()), pa.array(line + 1 + of("off_line"), pa.int64()),
        pa.array(column + np.where(line == 0, of("off_col"), 0), pa.int64()),
        opt(sums[0], src), opt(sums[1] + 1, src), opt(sums[2], src), opt(sums[3], fields < 5),
        pa.array((first & (place == 0)).astype(np.int32), pa.int32())], names)


def _texts(parts: DataFrame) -> DataFrame:
    """(map_id, section_no, kind, idx, text): source names (kind 0, joined to
    ``sourceRoot`` and normalised) and names (kind 1) of the map parts."""
    root = F.col("sourceRoot")

    def full_name(src):
        joined = F.when(F.coalesce(root, F.lit("")) == "", src).otherwise(F.concat(
            root, F.when(root.endswith("/") | src.startswith("/"), F.lit("")).otherwise(F.lit("/")), src))
        return U.normalize_source(joined)
    both = F.concat(_numbered(F.transform("sources", full_name), 0), _numbered(F.col("names"), 1))
    parts = parts.select("map_id", F.explode("parts").alias("p")).select("map_id", "p.*")
    return parts.select("map_id", "section_no", F.explode(both).alias("t")).select("map_id", "section_no", "t.*")


def _numbered(texts, kind: int):
    return F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t, i: F.struct(
        F.lit(kind).alias("kind"), i.cast("bigint").alias("idx"), t.alias("text")))


def with_next_position(d: DataFrame) -> DataFrame:
    """Positions (map_id, gen_line, gen_col, col_range, …) without those that
    repeat a generated position, with the next one's column on the line.

    Of equal generated positions a mapping comes before a section start; among
    mappings the first by (source, line, column, name), those without last.
    Ranges of ``LEAD_COLUMNS`` columns are sorted apart, so a line that holds a
    whole minified file is many groups; the last position of a range takes the
    first one of the next range that has any, carried over from one row per
    range."""
    line = ["map_id", "gen_line"]
    group = Window.partitionBy(*line, "col_range")
    order = ["gen_col", "blocker", *[F.col(c).asc_nulls_last() for c in ("src_idx", "orig_line", "orig_col", "name_idx")],
             "section_no", "seg_no"]
    borders = d.groupBy(*line, "col_range").agg(F.min("gen_col").alias("first_col"))
    carried = borders.select(*line, "col_range", F.lead("first_col").over(
        Window.partitionBy(*line).orderBy("col_range")).alias("carried_col"))
    d = d.withColumn("repeated", F.lag("gen_col").over(group.orderBy(*order)).eqNullSafe(F.col("gen_col")))
    d = d.where(~F.col("repeated")).drop("repeated").withColumn("in_range", F.lead("gen_col").over(group.orderBy("gen_col")))
    return (d.join(carried, [*line, "col_range"]).withColumn("next_gen_col", F.coalesce("in_range", "carried_col"))
            .drop("in_range", "carried_col"))


def build_segments(source_maps: DataFrame, keep=None) -> DataFrame:
    """Decode ``source_maps(url, map_json)`` into one row per generated
    position: url, gen_line (1-based), gen_col, next_gen_col (start of the
    next position on the line, null for the last), source, orig_line
    (1-based), orig_col, name. 1-field segments stay with a null source
    (they end the previous segment and resolve to nothing). Source names
    are joined to ``sourceRoot`` and normalised like paths.

    A map that is not valid JSON (after a first line ``)]}'``, which is
    dropped), not version 3, or holds any malformed segment yields no rows at
    all (every lookup of it fails). Indexed maps decode each section on its
    own and shift it by the section offset (the column only on the section's
    first line); the start of every section is a position without source (a
    leading 1-field segment), so a lookup never falls back into the previous
    section.

    A map used under several urls is parsed and decoded once. Only integers go
    through the windows; source names and names join afterwards, by index. A
    large map is decoded a block at a time; no task sorts a whole map for the
    next position on a line (``with_next_position``). ``keep(df, name)`` writes
    the parsed maps and the decoded positions, which are read twice."""
    keyed = source_maps.select("url", "map_json", F.sha2("map_json", 256).alias("map_id")).where(F.col("map_json").isNotNull())
    of_url = keyed.groupBy("url").agg(F.min("map_id").alias("map_id"))
    parts = _map_parts(keyed.groupBy("map_id").agg(F.min("map_json").alias("map_json")))
    if keep is not None:
        parts = keep(parts, "map_parts")
    d = _positions(parts)
    d = d.withColumn("col_range", F.floor(F.col("gen_col") / LEAD_COLUMNS))
    if keep is not None:
        d = keep(d, "positions")
    d = with_next_position(d).drop("blocker", "seg_no", "col_range")
    texts = _texts(parts)
    for kind, idx, name in ((0, "src_idx", "src"), (1, "name_idx", "name")):
        t = texts.where(F.col("kind") == kind).select(
            F.col("map_id").alias("t_map"), F.col("section_no").alias("t_section"), F.col("idx").alias("t_idx"), F.col("text").alias(name))
        d = d.join(t, (d.map_id == t.t_map) & (d.section_no == t.t_section) & (d[idx] == t.t_idx), "left").drop(
            "t_map", "t_section", "t_idx")
    # a name index outside ``names`` makes the lookup fail: no source then
    bad_name = F.col("name_idx").isNotNull() & F.col("name").isNull()
    return d.join(of_url, "map_id").select(
        "url", "gen_line", "gen_col", "next_gen_col", F.when(~bad_name, F.col("src")).alias("source"),
        "orig_line", "orig_col", "name")


def segments_for_frames(frames: DataFrame, map_files: DataFrame, scripts: DataFrame, keep=None) -> DataFrame:
    """Segments of the maps of every minified-looking frame url, keyed by
    the frame url (as the lookup uses it)."""
    from webdiag.functions.frames import looks_minified
    urls = frames.where(looks_minified(F.col("url"), F.col("line"), F.col("col"))).select("url")
    maps = select_maps(urls, map_files, scripts).where(F.col("map_json").isNotNull())
    return build_segments(maps.select("url", "map_json"), keep)
