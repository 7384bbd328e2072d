"""Element lookup and similar-selector suggestions (O4.2, O4.3, O5.4, O9.3).

``requests(capture_id, pos, selector)`` are looked up among captured
``elements(capture_id, selector, …)``; for a miss, the selector's id and
class tokens are matched against the page's ``dom_tokens(capture_id, kind,
token, doc_order)``: a token is similar when, lower-cased, it equals,
contains or is contained in a selector token of the same kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webdiag.operators.common import as_keys

# --- fixed values (must equal the reference's for equal results) ---------
ID_TOKEN_RE = r"#([\w-]+)"
CLASS_TOKEN_RE = r"\.([\w-]+)"
MAX_SUGGESTIONS = 5
MAX_SELECTORS = 20  # per request batch
PREFIX = {"id": "#", "class": "."}
# ------------------------------------------------------------------------

GRAM = 3  # code points of the index's substrings


def selector_tokens(selector: Column) -> Column:
    """array<struct<kind, token>>: lower-cased id tokens, then class tokens."""
    ids = F.transform(F.regexp_extract_all(selector, F.lit(ID_TOKEN_RE), 1),
                      lambda t: F.struct(F.lit("id").alias("kind"), F.lower(t).alias("token")))
    classes = F.transform(F.regexp_extract_all(selector, F.lit(CLASS_TOKEN_RE), 1),
                          lambda t: F.struct(F.lit("class").alias("kind"), F.lower(t).alias("token")))
    return F.concat(ids, classes)


def reference_length(tokens: Column) -> Column:
    """Longest token (without its # or .), 0 without tokens."""
    return F.coalesce(F.array_max(F.transform(tokens, lambda t: F.length(t["token"]))), F.lit(0))


def lookup(requests: DataFrame, elements: DataFrame, keys=("capture_id",)) -> DataFrame:
    """requests + ``found`` (bool): is there a captured element with that
    selector. Elements are reduced to distinct (keys, selector) first."""
    keys = as_keys(keys)
    have = elements.select(*keys, "selector").distinct().withColumn("_hit", F.lit(True))
    j = requests.join(have, [*keys, "selector"], "left")
    return j.select(*requests.columns, F.coalesce("_hit", F.lit(False)).alias("found"))


def _grams(token: Column, size: int) -> Column:
    """The distinct substrings of ``size`` code points; a shorter token is its own one."""
    n = F.length(token)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))),
                                        lambda i: F.substr(token, i, F.lit(size))))


def _anchors(tokens: DataFrame, name: str, postings: DataFrame, keys) -> DataFrame:
    """The rarest gram, by ``postings``, of each of ``tokens``; tokens with a
    gram that no posting has are contained in nothing and drop out."""
    place = [*keys, "kind"]
    often = postings.groupBy(*place, "gram").agg(F.count(F.lit(1)).alias("often"))
    grams = tokens.select(*place, name, F.explode(_grams(F.col(name), GRAM)).alias("gram"))
    return (grams.join(often, [*place, "gram"]).groupBy(*place, name)
            .agg(F.count(F.lit(1)).alias("present"), F.min_by("gram", F.struct("often", "gram")).alias("gram"))
            .where(F.col("present") == F.size(_grams(F.col(name), GRAM))).drop("present"))


def _postings(tokens: DataFrame, name: str, columns, short: DataFrame, keys) -> DataFrame:
    """A row per gram of each token; grams of less than GRAM code points only
    on pages where ``short`` says that the other side has so short a token."""
    t = tokens.join(short, [*keys, "kind"])
    grams = F.concat(_grams(F.col(name), GRAM), F.when(F.col("short"), F.flatten(F.array(*[
        F.filter(_grams(F.col(name), k), lambda g: F.length(name) >= GRAM) for k in range(1, GRAM)]))).otherwise(
            F.array().cast("array<string>")))
    # a token shorter than GRAM holds shorter ones, too
    grams = F.when((F.length(name) < GRAM) & F.col("short"), F.array_distinct(F.flatten(F.array(*[
        _grams(F.col(name), k) for k in range(1, GRAM + 1)])))).otherwise(grams)
    return t.select(*keys, "kind", *columns, F.explode(grams).alias("gram"))


def similar_tokens(wanted: DataFrame, dom: DataFrame, keys=("capture_id",)) -> DataFrame:
    """(keys…, kind, want, token, doc_order): the tokens ``lc`` of ``dom(keys…,
    kind, token, lc, doc_order)`` that equal, contain or lie in a wanted token
    of the same page and kind.

    An inverted index of trigrams: a token lies in another one only if the
    other has all its trigrams, so it is looked up under the rarest of them
    alone, and ``contains`` verifies what is found. Postings meet by (page,
    kind, gram): a page with very many tokens is many groups, and no list of
    a page's tokens is built."""
    keys = as_keys(keys)
    place = [*keys, "kind"]
    # pages of one side without the other side find nothing
    of_wanted = wanted.groupBy(*place).agg((F.min(F.length("want")) < GRAM).alias("short"))
    of_dom = dom.groupBy(*place).agg((F.min(F.length("lc")) < GRAM).alias("short"))
    held = _postings(dom, "lc", ["token", "lc", "doc_order"], of_wanted, keys)
    asked = _postings(wanted, "want", ["want"], of_dom, keys)
    inside = _anchors(wanted, "want", held, keys).join(held, [*place, "gram"]).where(F.contains("lc", F.col("want")))
    around = (_anchors(dom.select(*place, "lc").distinct(), "lc", asked, keys).join(asked, [*place, "gram"])
              .where(F.contains("want", F.col("lc")) & (F.col("lc") != F.col("want"))).drop("gram")
              .join(dom, [*place, "lc"]))
    columns = [*place, "want", "token", "doc_order"]
    return inside.select(*columns).unionByName(around.select(*columns))


def suggest_selectors(missing: DataFrame, dom_tokens: DataFrame, k: int = MAX_SUGGESTIONS,
                      keys=("capture_id",)) -> DataFrame:
    """Long form: keys…, selector, rank (1..k), suggestion.

    Order: distance |len(candidate) − reference length| (the candidate keeps
    its # or .), then ids before classes, then document order. Empty DOM
    tokens are dropped (an empty id would match every selector)."""
    keys = as_keys(keys)
    sel = missing.select(*keys, "selector").distinct()
    toks = sel.select(*keys, "selector", F.explode(selector_tokens(F.col("selector"))).alias("t"),
                      reference_length(selector_tokens(F.col("selector"))).alias("ref_len"))
    toks = toks.select(*keys, "selector", "ref_len", F.col("t.kind").alias("kind"),
                       F.col("t.token").alias("want")).distinct()
    # a page's token once, at its first position (partial aggregation first)
    dom = (dom_tokens.where(F.coalesce(F.length("token"), F.lit(0)) > 0)
           .groupBy(*keys, "kind", "token").agg(F.min("doc_order").alias("doc_order"))
           .withColumn("lc", F.lower("token")))
    # several tokens of a selector may be similar to one token of the page
    cand = (similar_tokens(toks.select(*keys, "kind", "want").distinct(), dom, keys).join(toks, [*keys, "kind", "want"])
            .groupBy(*keys, "selector", "kind", "token").agg(F.min("doc_order").alias("doc_order"), F.min("ref_len").alias("ref_len")))
    text = F.concat(F.when(F.col("kind") == "id", F.lit("#")).otherwise(F.lit(".")), F.col("token"))
    cand = cand.select(*keys, "selector", "kind", "doc_order", text.alias("suggestion"),
                       F.abs(F.length(text) - F.col("ref_len")).alias("dist"))
    w = Window.partitionBy(*keys, "selector").orderBy(
        "dist", (F.col("kind") == "class").asc(), "doc_order", "suggestion")
    r = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return r.select(*keys, "selector", F.col("rank").cast("bigint").alias("rank"), "suggestion")


def suggestion_lists(suggestions: DataFrame, keys=("capture_id",)) -> DataFrame:
    """keys…, selector, suggestions array<string> in rank order."""
    keys = as_keys(keys)
    g = suggestions.groupBy(*keys, "selector").agg(
        F.array_sort(F.collect_list(F.struct("rank", "suggestion"))).alias("_s"))
    return g.select(*keys, "selector", F.transform("_s", lambda x: x["suggestion"]).alias("suggestions"))


def not_found_rows(requests: DataFrame, elements: DataFrame, dom_tokens: DataFrame,
                   keys=("capture_id",), k: int = MAX_SUGGESTIONS) -> DataFrame:
    """Requests that match no element, with ``not_found`` true and their
    suggestion list (empty when nothing is similar) — the element rows
    ``audit.element_report`` expects for misses."""
    keys = as_keys(keys)
    looked = lookup(requests, elements, keys)
    miss = looked.where(~F.col("found")).drop("found")
    lists = suggestion_lists(suggest_selectors(miss, dom_tokens, k, keys), keys)
    out = miss.join(lists, [*keys, "selector"], "left")
    return out.select(*miss.columns, F.lit(True).alias("not_found"),
                      F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))


def check_batch_size(requests: DataFrame, keys=("capture_id",), max_selectors: int = MAX_SELECTORS) -> DataFrame:
    """Captures asking for more than ``max_selectors`` selectors (the
    reference's 1–20 bound), for validation."""
    keys = as_keys(keys)
    return (requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_selectors"))
            .where(F.col("n_selectors") > max_selectors))
