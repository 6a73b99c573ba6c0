"""Nested JSON of any shape, walked as VARIANT: canonical text and its hash, and redaction of raw payloads. Built-in expressions only.

Objects hold their keys in the order of their names, so that is the order everywhere; numbers are in their shortest form
(1.50 is 1.5). Text that is no JSON, and null, give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys whose values are raw payloads, and endings of such keys.
RAW_KEYS = (
    "body", "blob", "bytes", "code", "content", "content_base64", "contract_errors", "error", "error_log", "errors", "exception", "file_text", "full_text", "payload", "prompt", "raw", "request",
    "request_body", "response", "response_body", "snippet", "source_text", "system_prompt", "traceback",
)
RAW_ENDINGS = ("_raw", "_content", "_blob", "_prompt", "_request", "_response")
#: How much of a document is shown.
DEPTH, KEYS, ITEMS, CHARS, SIGNATURE = 4, 80, 50, 512, 240

_SPACE = r"(?U)^\s+|\s+$"
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def canonical(text: Column) -> Column:
    """The JSON text with sorted keys at every depth and no spaces."""
    return F.to_json(parsed(text))


def semantic_hash(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON of an object with these fields; text fields as they are, VARIANT ones whole."""
    parts = []
    for k in sorted(fields):
        parts += [F.lit(f'"{k}":'), F.coalesce(F.to_json(fields[k].cast("variant")), F.lit("null")), F.lit(",")]
    return F.sha2(F.concat(F.lit("{"), *parts[:-1], F.lit("}")), 256)


def is_raw(key: Column) -> Column:
    low = F.lower(key)
    out = low.isin(*RAW_KEYS)
    for e in RAW_ENDINGS:
        out = out | low.endswith(e)
    return out


def _quoted(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def signature(text: Column) -> Column:
    """The first line of a text, without white space around it, cut after SIGNATURE characters; null for an empty text."""
    line = F.regexp_replace(F.split(F.regexp_replace(text, _SPACE, ""), _LINE_END)[0], _SPACE, "")
    cut = F.concat(F.substring(line, 1, SIGNATURE), F.lit("... [truncated chars="), F.length(text).cast("string"), F.lit("]"))
    return F.when(text != "", F.when(F.length(line) > SIGNATURE, cut).otherwise(line))


def _value(v: Column, key: Column, depth: int, low_keys: bool) -> Column:
    """The JSON text of a value under a key; signature is known by its exact name, or in any case where keys are lowered first."""
    text = F.to_json(v)
    kind = F.substring(text, 1, 1)
    plain = F.try_variant_get(v, "$", "string")
    named = (F.lower(key) if low_keys else key) == "signature"
    excerpt = F.when(kind == '"', F.coalesce(_quoted(signature(plain)), F.lit("null"))).otherwise("null")
    out = F.when(named, excerpt).when(is_raw(key), F.lit('{"omitted":"raw_payload"}'))
    if depth >= DEPTH:
        return out.otherwise('{"omitted":"max_depth"}')
    long = F.concat(F.lit('{"omitted":"large_string","chars":'), F.length(plain).cast("string"), F.lit("}"))
    items = F.try_variant_get(v, "$", "array<variant>")
    rest = F.size(items) - ITEMS
    shown = F.transform(F.slice(items, 1, ITEMS), lambda x: _value(x, key, depth + 1, low_keys))
    more = F.when(rest > 0, F.array(F.concat(F.lit('{"__truncated_items__":'), rest.cast("string"), F.lit("}")))).otherwise(F.array().cast("array<string>"))
    array = F.concat(F.lit("["), F.array_join(F.concat(shown, more), ","), F.lit("]"))
    return (
        out.when((kind == '"') & (F.length(plain) > CHARS), long).when(kind == "[", array).when(kind == "{", _object(v, depth + 1, KEYS, False)).otherwise(F.coalesce(text, F.lit("null")))
    )


def _object(v: Column, depth: int, most: int | None, low_keys: bool) -> Column:
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    first = F.slice(entries, 1, most) if most else entries
    shown = F.transform(first, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _value(e["value"], e["key"], depth, low_keys)))
    if most:
        rest = F.size(entries) - most
        more = F.when(rest > 0, F.array(F.concat(F.lit('"__truncated_keys__":'), rest.cast("string")))).otherwise(F.array().cast("array<string>"))
        shown = F.concat(shown, more)
    return F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}"))


def redacted(text: Column) -> Column:
    """An object's JSON text without raw payloads, long texts, and what lies too deep or is too much; null for anything but an object.

    All keys of the outermost object are shown; KEYS of those within, ITEMS of a list, with the number of the others.
    """
    v = parsed(text)
    return F.when(F.substring(F.to_json(v), 1, 1) == "{", _object(v, 0, None, True))
