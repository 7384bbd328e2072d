"""URL expressions: resolve a reference against a base url (the common
cases of the WHATWG ``new URL(ref, base)``), query stripping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
ORIGIN_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
PATH_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
QUERY_RE = r"\?.*\z"


def fold_path(path: Column) -> Column:
    """Fold '.' and '..' segments of an absolute path ('/a/./b/../c' → '/a/c')."""
    parts = F.split(path, "/")
    body = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    folded = F.aggregate(body, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc)
                         .when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                         .otherwise(F.concat(acc, F.array(x))))
    # a path ending in '.' or '..' names a directory: keep the trailing '/'
    last = F.try_element_at(body, F.lit(-1))
    folded = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, QUERY_RE, "")


def resolve_url(ref: Column, base: Column) -> Column:
    """Absolute url of ``ref`` relative to ``base``: absolute refs as is;
    '//host…' takes the base scheme; '/path' the base origin; '?q' and '#f'
    replace the base query/fragment; otherwise the base directory + ref,
    with '.' and '..' folded."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, ORIGIN_RE, 1)
    bpath = F.regexp_extract(base, PATH_RE, 1)
    bdir = F.regexp_extract(bpath, r"^(.*/)", 1)
    bdir = F.when(bdir == "", F.lit("/")).otherwise(bdir)
    rpath = F.regexp_extract(ref, r"^([^?#]*)", 1)
    rrest = F.regexp_extract(ref, r"^[^?#]*(.*)\z", 1)
    no_frag = F.regexp_replace(base, r"#.*\z", "")
    no_query = F.regexp_replace(base, r"[?#].*\z", "")
    return (F.when(ref.isNull() | base.isNull(), F.lit(None).cast("string"))
            .when(ref.rlike(SCHEME_RE), ref)
            .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
            .when(ref.startswith("/"), F.concat(origin, fold_path(rpath), rrest))
            .when(ref.startswith("?"), F.concat(no_query, ref))
            .when(ref.startswith("#"), F.concat(no_frag, ref))
            .when(ref == "", no_frag)
            .otherwise(F.concat(origin, fold_path(F.concat(bdir, rpath)), rrest)))


# --- fixed values (source-map path normalisation) ---------------------------
# url-shaped source: scheme, //, optional user:pass@, host, optional :port, path
SOURCE_URL_RE = r"^((?:[\w+\-.]+:)?//(?:\w+:\w+@)?[\w.\-]*(?::\d+)?)(.*)\z"
# ---------------------------------------------------------------------------


def normalize_path(path: Column) -> Column:
    """Normalise a source path as source maps do: runs of '/' collapse, '.'
    segments go, '..' folds into the segment before it (and is dropped at
    the root of an absolute path, kept at the start of a relative one); an
    empty result is '/' for an absolute path, '.' for a relative one."""
    parts = F.split(path, "/+")
    absolute = path.startswith("/")

    def step(acc, x):
        top = F.element_at(acc, -1)
        can_pop = (F.size(acc) > 0) & (top != "..") & (top != "")
        at_root = (F.size(acc) > 0) & (top == "")
        return (F.when(x == ".", acc)
                .when((x == "..") & can_pop, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                .when((x == "..") & at_root, acc)
                .otherwise(F.concat(acc, F.array(x))))
    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(folded == "", F.when(absolute, F.lit("/")).otherwise(F.lit("."))).otherwise(folded)


def normalize_source(src: Column) -> Column:
    """``normalize_path`` of a source name, applied to the path part only
    when the name is url-shaped ('webpack:///./src/a.js' → 'webpack:///src/a.js')."""
    prefix = F.regexp_extract(src, SOURCE_URL_RE, 1)
    rest = F.regexp_extract(src, SOURCE_URL_RE, 2)
    is_url = src.rlike(SOURCE_URL_RE)
    return (F.when(src.isNull(), F.lit(None).cast("string"))
            .when(is_url & (rest == ""), src)
            .when(is_url, F.concat(prefix, normalize_path(rest)))
            .otherwise(normalize_path(src)))
