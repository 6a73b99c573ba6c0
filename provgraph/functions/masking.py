"""Masking by column name and by value, with checked number formats. Plan-time decisions, built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import origins

#: Column names that are masked whole, and in part.
FULL = r"\b(password|token|secret|api[_-]?key|ssn|rrn)\b"
PARTIAL = r"\b(email|phone|name|address|mobile)\b|이름|주소|전화|휴대폰|주민|이메일"
#: Value formats, masked in this order.
VALUES = [
    ("EMAIL", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
    ("PHONE_KR", r"\b01[016789]-?\d{3,4}-?\d{4}\b"),
    ("PHONE", r"\b\d{2,3}-?\d{3,4}-?\d{4}\b"),
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
]
#: Number formats that carry a check.
NUMERIC_ID = r"\b\d{6}-?\d{7}\b"
CARD = r"\b(?:\d{4}[- ]?){3}\d{4}\b"
LICENCE = r"\b\d{2}-?\d{2}-?\d{6}-?\d{2}\b"
#: Weights of the resident number's check digit.
RRN_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)


def column_rule(name: str, full: str = FULL, partial: str = PARTIAL) -> str:
    """full, partial or value: full goes before partial."""
    if re.search(full, name, re.I):
        return "full"
    return "partial" if re.search(partial, name, re.I) else "value"


def mask_partial(c: Column) -> Column:
    s = c.cast("string")
    return F.when(F.length(s) <= 3, F.lit("***")).otherwise(F.concat(F.substring(s, 1, 3), F.lit("***")))


def labelled(c: Column, pattern: str, label) -> Column:
    """c with every match replaced by label(match): matches are bracketed, and the parts relabelled."""
    clean = F.translate(c, "\x01\x02", "\x03\x03")
    parts = F.split(F.regexp_replace(clean, F.lit("(?U)" + pattern), F.lit("\x01$0\x02")), "\x01", -1)
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    relabelled = F.transform(rest, lambda p: F.concat(label(F.substring_index(p, "\x02", 1)), F.substring_index(p, "\x02", -1)))
    return F.when(c.rlike("[0-9]"), F.concat(parts[0], F.array_join(relabelled, ""))).otherwise(c)


def mask_formats(c: Column) -> Column:
    """Every format's matches become its label. Only texts with an @ or a digit are searched; labels hold neither."""
    text = c.cast("string")
    (email, address), *numbers = VALUES
    out = F.when(text.contains("@"), F.regexp_replace(text, "(?U)" + address, f"[{email}]")).otherwise(text)
    masked_numbers = out
    for label, pattern in numbers:
        masked_numbers = F.regexp_replace(masked_numbers, "(?U)" + pattern, f"[{label}]")
    return F.when(text.rlike(r"(?U)\d"), masked_numbers).otherwise(out)


def mask_values(c: Column) -> Column:
    """Formats, then numbers with a check: named if it holds, else marked as unverified."""
    out = mask_formats(c)
    out = labelled(out, NUMERIC_ID, lambda m: F.when(rrn(m), "[RRN]").when(foreigner(m), "[FOREIGNER_ID]").otherwise("[UNVERIFIED_NUMERIC_ID]"))
    out = labelled(out, CARD, lambda m: F.when(luhn(m), "[CARD]").otherwise("[UNVERIFIED_CARD]"))
    return labelled(out, LICENCE, lambda m: F.when(licence(m), "[LICENSE]").otherwise("[UNVERIFIED_LICENSE]"))


def _spans(c: Column, pattern: str, label) -> Column:
    """Matches that label(match) gives a name: label, start and end (code points, end exclusive), in order."""
    clean = F.translate(c, "\x01\x02", "\x03\x03")
    parts = F.split(F.regexp_replace(clean, F.lit("(?U)" + pattern), F.lit("\x01$0\x02")), "\x01", -1)
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    none = F.array().cast("array<struct<label:string,start:int,end:int>>")

    def step(acc: Column, p: Column) -> Column:
        match = F.substring_index(p, "\x02", 1)
        found = F.struct(label(match).alias("label"), acc["at"].alias("start"), (acc["at"] + F.length(match)).alias("end"))
        return F.struct((acc["at"] + F.length(p) - 1).alias("at"), F.array_append(acc["found"], found).alias("found"))

    found = F.aggregate(rest, F.struct(F.length(parts[0]).alias("at"), none.alias("found")), step, lambda acc: acc["found"])
    return F.filter(found, lambda x: x["label"].isNotNull())


def scan(c: Column) -> Column:
    """Numbers whose check holds, as label, start and end: resident and foreigner numbers, then cards, then licences. Null: null."""
    s = c.cast("string")
    ids = _spans(s, NUMERIC_ID, lambda m: F.when(rrn(m), "RRN").when(foreigner(m), "FOREIGNER_ID"))
    cards = _spans(s, CARD, lambda m: F.when(luhn(m), "CARD"))
    licences = _spans(s, LICENCE, lambda m: F.when(licence(m), "DRIVERS_LICENSE"))
    nothing = F.array().cast("array<struct<label:string,start:int,end:int>>")
    return F.when(s.rlike("[0-9]"), F.concat(ids, cards, licences)).when(s.isNotNull(), nothing)


def masked(c: Column, name: str) -> Column:
    return masked_as(c, column_rule(name))


def masked_as(c: Column, rule: str) -> Column:
    if rule == "full":
        return F.when(c.isNotNull(), F.lit("***"))
    return F.when(c.isNotNull(), mask_partial(c)) if rule == "partial" else mask_values(c)


def masked_by(c: Column, name: Column) -> Column:
    """c masked by the rule of a name that is data, such as an attribute's key."""
    s = c.cast("string")
    by_name = F.when(name.rlike("(?iu)" + FULL), F.lit("***")).when(name.rlike("(?iu)" + PARTIAL), mask_partial(c))
    return F.when(s.isNotNull(), F.coalesce(by_name, mask_values(c)))


def mask_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The masked rows, and one row of flags: which columns changed anywhere."""
    out = df.select(*[masked(F.col(c), c).alias(c) for c in df.columns])
    flags = df.agg(*[F.coalesce(F.bool_or(~masked(F.col(c), c).eqNullSafe(F.col(c).cast("string"))), F.lit(False)).alias(c) for c in df.columns])
    return out, flags


def mask_by_origin(df: DataFrame) -> DataFrame:
    """df with each column masked by the strictest rule of its own name and of all names that it comes from, whatever it is called now."""
    names = [{c} | found for c, found in zip(df.columns, origins(df))]
    strictest = [next((r for r in ("full", "partial") if r in rules), "value") for rules in ({column_rule(n) for n in ns} for ns in names)]
    once = df.toDF(*[f"_{i}" for i in range(len(names))])  # names may repeat
    return once.select(*[masked_as(F.col(f"_{i}"), rule).alias(c) for i, (c, rule) in enumerate(zip(df.columns, strictest))])


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d).between(12, 19), F.call_function("luhn_check", d)).otherwise(False)


def _weighted(d: Column) -> Column:
    total = F.lit(0)
    for i, w in enumerate(RRN_WEIGHTS):
        total = total + w * F.substring(d, i + 1, 1).cast("int")
    return total


def rrn(c: Column) -> Column:
    """Thirteen digits that begin with a month and a day after the year, and whose last is (11 - weighted sum mod 11) mod 10."""
    d = digits(c)
    dated = F.substring(d, 3, 2).cast("int").between(1, 12) & F.substring(d, 5, 2).cast("int").between(1, 31)
    return F.when(F.length(d) == 13, dated & ((11 - _weighted(d) % 11) % 10 == F.substring(d, 13, 1).cast("int"))).otherwise(False)


def foreigner(c: Column) -> Column:
    """As rrn, two more, with a seventh digit of 5 to 8."""
    d = digits(c)
    return F.when(F.length(d) == 13, F.substring(d, 7, 1).between("5", "8") & (((11 - _weighted(d) % 11) % 10 + 2) % 10 == F.substring(d, 13, 1).cast("int"))).otherwise(False)


def licence(c: Column) -> Column:
    """Twelve digits of a region from 11 to 28."""
    d = digits(c)
    return F.when(F.length(d) == 12, F.substring(d, 1, 2).cast("int").between(11, 28)).otherwise(False)
