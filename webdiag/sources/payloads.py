"""Capture payloads → silver tables (O1.1–O1.7).

A payload is the JSON text of one reply: console messages of a page, or
the computed styles of requested selectors. It is parsed once into a
VARIANT; its shape decides where the list is. Payloads whose shape is not
understood are kept whole in a quarantine table with a warning; only the
message quotes no more than their first 200 characters.

Of equal keys in an object the last counts. Texts that the VARIANT parser
refuses for their size are read with ``from_json`` without a length limit,
element by element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webdiag.operators.common import as_keys, posexplode_rows, where_computed

# --- fixed values (must equal the reference's for equal results) ---------
FENCE_RE = r"```(?:json)?\s*([\s\S]*?)\s*```"
NO_MESSAGES_RE = r"(?i)no console messages"
MARKDOWN_HEADING_RE = r"(?m)^##\s"
QUOTED_CHARS = 200  # of the payload in a message
CONSOLE_WARNING = "Log extraction failed: "
CONSOLE_UNRECOGNIZED = "Unrecognized console log response shape: "
STYLE_WARNING = "Style extraction failed: "
STYLE_UNRECOGNIZED = "Unrecognized response shape: "
STYLE_NULL = "Script returned null"
INVALID_JSON = "invalid JSON in text payload"
NULL_ENTRY = "null entry in the log"
NO_ELEMENT = "no element in the reply"
TOO_MANY = "too many selectors in one request"
# ------------------------------------------------------------------------

_ARR = "array<variant>"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, _ARR)


def _truthy(v: Column, path: str) -> Column:
    """JavaScript truthiness of the value at ``path``."""
    x = F.try_variant_get(v, path, "variant")
    t = _kind(x)
    return (F.when(x.isNull() | F.is_variant_null(x), F.lit(False))
            .when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
            .when(t == "STRING", F.try_variant_get(x, "$", "string") != "")
            .when(t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"),
                  F.try_variant_get(x, "$", "double") != 0)
            .otherwise(F.lit(True)))


_NO_LIMIT = {"maxStringLen": str((1 << 31) - 1), "maxNumLen": "100000"}
_LISTS = "struct<result:array<string>,logs:array<string>,messages:array<string>,results:array<string>>"


def _long_array(text: Column, v: Column, field: str | None) -> Column:
    """array<variant> at the top (``field`` None) or in a field of a text that
    is JSON but too large for one VARIANT: its elements parsed one by one."""
    if field is None:
        got = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>", _NO_LIMIT))
    else:
        got = F.when(F.ltrim(text).startswith("{"), F.from_json(text, _LISTS, _NO_LIMIT)[field])
    parsed = F.transform(got, lambda x: F.try_parse_json(x))
    return F.when(v.isNull() & ~F.exists(parsed, lambda x: x.isNull()), parsed)


def _list(text: Column, v: Column, field: str | None) -> Column:
    return F.coalesce(_array(v, "$" if field is None else f"$.{field}"), _long_array(text, v, field))


def _text_payload(raw: Column, v: Column):
    """(text, json text) of ``content[0].text``: the first ```json fence
    if any, else the whole text."""
    long = F.when(v.isNull() & F.ltrim(raw).startswith("{"),
                  F.from_json(raw, "struct<content:array<struct<text:string>>>", _NO_LIMIT)["content"])
    text = F.coalesce(F.try_variant_get(v, "$.content[0].text", "string"), F.try_element_at(long, F.lit(1))["text"])
    fenced = text.rlike(FENCE_RE)
    return text, F.when(fenced, F.regexp_extract(text, FENCE_RE, 1)).otherwise(text)


def _stage(payloads: DataFrame, keys, payload_col: str) -> DataFrame:
    """Parse once: _raw, _v (variant), _text (content[0].text), _p (its JSON)."""
    payloads.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    x = payloads.select(*keys, F.col(payload_col).alias("_raw"))
    x = x.select("*", F.try_parse_json("_raw").alias("_v"))
    text, jt = _text_payload(F.col("_raw"), F.col("_v"))
    x = x.select("*", text.alias("_text"), jt.alias("_jt"))
    return x.select("*", F.try_parse_json("_jt").alias("_p"))


def parse_console_payloads(payloads: DataFrame, keys=("capture_id",), payload_col: str = "payload") -> DataFrame:
    """One row per payload: keys…, payload_kind, logs (array<variant>, null
    on failure), warning, raw. Kinds: array, result, logs, messages, text,
    markdown (a 'no console messages' or '## …' text → no entries), failed."""
    keys = as_keys(keys)
    staged = _stage(payloads, keys, payload_col)
    raw, v, text, p = F.col("_raw"), F.col("_v"), F.col("_text"), F.col("_p")
    staged = staged.select("*", *[_list(raw, v, f).alias(f"_a{i}") for i, f in enumerate((None, "result", "logs", "messages"))])
    from_text = F.coalesce(*[_list(F.col("_jt"), p, f) for f in (None, "result", "messages", "logs")])
    has_text = text.isNotNull() & (text != "")
    markdown = has_text & (text.rlike(NO_MESSAGES_RE) | text.rlike(MARKDOWN_HEADING_RE))
    kind = (F.when(F.col("_a0").isNotNull(), F.lit("array"))
            .when(F.col("_a1").isNotNull(), F.lit("result"))
            .when(F.col("_a2").isNotNull(), F.lit("logs"))
            .when(F.col("_a3").isNotNull(), F.lit("messages"))
            .when(markdown, F.lit("markdown"))
            .when(has_text & from_text.isNotNull(), F.lit("text"))
            .otherwise(F.lit("failed")))
    staged = staged.select("*", kind.alias("payload_kind"), from_text.alias("_ft"))
    kind = F.col("payload_kind")
    logs = (F.when(kind == "array", F.col("_a0")).when(kind == "result", F.col("_a1"))
            .when(kind == "logs", F.col("_a2")).when(kind == "messages", F.col("_a3"))
            .when(kind == "markdown", F.array().cast(_ARR)).when(kind == "text", F.col("_ft")))
    # an entry that is null fails the whole capture, as reading its fields would
    staged = staged.select("*", logs.alias("logs"))
    null_entry = F.coalesce(F.exists("logs", lambda e: F.is_variant_null(e)), F.lit(False))
    failed = (kind == "failed") | null_entry
    reason = (F.when(null_entry, F.lit(NULL_ENTRY)).when(has_text & p.isNull(), F.lit(INVALID_JSON))
              .otherwise(F.concat(F.lit(CONSOLE_UNRECOGNIZED), F.substring(raw, 1, QUOTED_CHARS))))
    return staged.select(*keys, F.when(failed, "failed").otherwise(kind).alias("payload_kind"),
                         F.when(~failed, F.col("logs")).alias("logs"),
                         F.when(failed, F.concat(F.lit(CONSOLE_WARNING), reason)).alias("warning"),
                         F.when(failed, raw).alias("raw"))


def console_entries(parsed: DataFrame, keys=("capture_id",)) -> DataFrame:
    """Entries of parsed payloads: keys…, seq (array index), level, type,
    text, message, source, url (strings as found), stack (variant)."""
    keys = as_keys(keys)
    x = posexplode_rows(parsed, keys, F.col("logs"), "seq", "e")
    s = lambda path: F.try_variant_get(F.col("e"), path, "string")
    stack = F.coalesce(*[F.when(~F.is_variant_null(F.try_variant_get(F.col("e"), p, "variant")),
                                F.try_variant_get(F.col("e"), p, "variant")) for p in ("$.stackTrace", "$.stack")])
    return x.select(*keys, F.col("seq").cast("bigint").alias("seq"), s("$.level").alias("level"),
                    s("$.type").alias("type"), s("$.text").alias("text"), s("$.message").alias("message"),
                    s("$.source").alias("source"), s("$.url").alias("url"), stack.alias("stack"))


def quarantine(parsed: DataFrame, keys=("capture_id",), source: str = "console") -> DataFrame:
    keys = as_keys(keys)
    return where_computed(parsed, F.col("warning").isNotNull()).select(
        *keys, F.lit(source).alias("source"), "warning", "raw")


def parse_element_payloads(payloads: DataFrame, keys=("capture_id",), payload_col: str = "payload") -> DataFrame:
    """One row per style payload: keys…, payload_kind, results
    (array<variant>; a non-array ``results`` gives []), warning, raw."""
    keys = as_keys(keys)
    staged = _stage(payloads, keys, payload_col)
    raw, v, text, p = F.col("_raw"), F.col("_v"), F.col("_text"), F.col("_p")
    has_text = text.isNotNull() & (text != "")
    # lists of texts too large for one VARIANT
    staged = staged.select("*", _long_array(F.col("_jt"), p, "results").alias("_lt"), _long_array(raw, v, "results").alias("_lv"))
    kind = (F.when(has_text & p.isNull() & F.col("_lt").isNull(), F.lit("failed"))
            .when(has_text & F.is_variant_null(p), F.lit("failed"))
            .when(has_text & (_truthy(p, "$.results") | F.col("_lt").isNotNull()), F.lit("text"))
            .when(has_text & _truthy(p, "$.result.results"), F.lit("text_result"))
            .when(_truthy(v, "$.results") | F.col("_lv").isNotNull(), F.lit("direct"))
            .when(_truthy(v, "$.result.results"), F.lit("result"))
            .otherwise(F.lit("failed")))
    staged = staged.select("*", kind.alias("payload_kind"))
    kind = F.col("payload_kind")
    results = (F.when(kind == "text", F.coalesce(_array(p, "$.results"), F.col("_lt")))
               .when(kind == "text_result", _array(p, "$.result.results"))
               .when(kind == "direct", F.coalesce(_array(v, "$.results"), F.col("_lv")))
               .when(kind == "result", _array(v, "$.result.results")))
    results = F.when(kind != "failed", F.coalesce(results, F.array().cast(_ARR)))
    reason = (F.when(has_text & p.isNull(), F.lit(INVALID_JSON))
              .when(has_text & F.is_variant_null(p), F.lit(STYLE_NULL))
              .otherwise(F.concat(F.lit(STYLE_UNRECOGNIZED), F.substring(raw, 1, QUOTED_CHARS))))
    warning = F.when(kind == "failed", F.concat(F.lit(STYLE_WARNING), reason))
    return staged.select(*keys, kind.alias("payload_kind"), results.alias("results"), warning.alias("warning"),
                         F.when(kind == "failed", raw).alias("raw"))


def element_rows(parsed: DataFrame, keys=("capture_id",)) -> DataFrame:
    """Elements of parsed style payloads: keys…, pos, selector, styles
    (map<string,string>, {} when absent), not_found, suggestions, error."""
    keys = as_keys(keys)
    x = posexplode_rows(parsed, keys, F.col("results"), "pos", "r")
    r = F.col("r")
    styles = F.coalesce(F.try_variant_get(r, "$.styles", "map<string,string>"),
                        F.create_map().cast("map<string,string>"))
    return x.select(*keys, "pos", F.try_variant_get(r, "$.selector", "string").alias("selector"),
                    styles.alias("styles"), _truthy(r, "$.notFound").alias("not_found"),
                    F.try_variant_get(r, "$.suggestions", "array<string>").alias("suggestions"),
                    F.try_variant_get(r, "$.error", "string").alias("error"))
