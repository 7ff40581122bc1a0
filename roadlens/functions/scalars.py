"""Scalar functions as column expressions, all within generated code."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole with two decimals, rounded half up exactly, as whole numbers; 0 of nothing."""
    a, b = part.cast("long"), whole.cast("long")
    return F.when(b > 0, _div(a * 20000 + b, b * 2) / F.lit(100.0)).otherwise(F.lit(0.0))


def mean2(total: Column, n: Column) -> Column:
    """total / n with two decimals, rounded half up exactly; 0 over nothing."""
    t, k = total.cast("long"), n.cast("long")
    return F.when(k > 0, _div(t * 200 + k, k * 2) / F.lit(100.0)).otherwise(F.lit(0.0))


def growth(now: Column, before: Column) -> Column:
    """Change from ``before`` to ``now`` in percent; the magnitude is rounded, then the sign put back."""
    change = now.cast("long") - before.cast("long")
    return F.signum(change.cast("double")) * percent(F.abs(change), before)


def blank_to_null(text: Column, null_word: str = "NA") -> Column:
    return F.when(~text.isin("", null_word), text)


def compact_date(text: Column, *, strict: bool = True) -> Column:
    """DDMMYYYY to a date; null for anything else, days the calendar lacks included. Strict: after trimming,
    eight digits; lenient: eight characters as they are."""
    t = F.trim(text) if strict else text
    shaped = t.rlike("^[0-9]{8}$") if strict else F.length(t) == 8
    return F.when(shaped, F.try_to_timestamp(t, F.lit("ddMMyyyy")).cast("date"))


def leading_int(text: Column) -> Column:
    """The whole number a text begins with, after blanks; null if there is none or it is too large."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def loose_date(text: Column) -> Column:
    """The day of an ISO instant or of a date without leading zeros such as 2013-3-25."""
    return F.coalesce(F.try_to_timestamp(text).cast("date"), F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date"))


def clock(text: Column, otherwise: str) -> Column:
    """HH:mm:ss of an ISO instant in the session's zone, which is UTC."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "HH:mm:ss"), F.lit(otherwise))


def merged_instant(day: Column, hour: Column) -> Column:
    """The date part of ``day`` with the time part of ``hour`` (what follows T, or all of it)."""
    time = F.when(F.contains(hour, F.lit("T")), F.split_part(hour, F.lit("T"), F.lit(2))).otherwise(hour)
    return F.concat(F.split_part(day, F.lit("T"), F.lit(1)), F.lit("T"), time)


def sha256_mark(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def json_int(document: Column, key: str) -> Column:
    return F.get_json_object(document, f"$.{key}").try_cast("int")


def json_text(document: Column, key: str) -> Column:
    return F.get_json_object(document, f"$.{key}")


def _holds(value: Column, wanted: object) -> Column:
    """Whether a variant holds ``wanted``, at any depth: objects by key, arrays by elements in any order."""
    kind = F.schema_of_variant(value)
    if isinstance(wanted, dict):
        return reduce(operator.and_, [_holds(F.try_variant_get(value, f"$['{k}']", "variant"), v) for k, v in wanted.items()], F.startswith(kind, F.lit("OBJECT")))
    if isinstance(wanted, (list, tuple)):
        held = F.try_variant_get(value, "$", "array<variant>")
        each = lambda w: F.exists(held, lambda e: F.coalesce(_holds(e, w), F.lit(False)))
        return reduce(operator.and_, map(each, wanted), F.startswith(kind, F.lit("ARRAY")))
    if wanted is None:
        return F.is_variant_null(value)
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == wanted)
    if isinstance(wanted, (int, float)):
        return kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.try_variant_get(value, "$", "double") == float(wanted))
    return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == str(wanted))


def json_contains(document: Column, **wanted: object) -> Column:
    """Whether an object has each key, with a value that holds the wanted one: numbers by value, text as text, truth
    values and null as such, objects and arrays by what is in them. False for no document and for what is none."""
    return F.coalesce(_holds(F.try_parse_json(document), wanted), F.lit(False))


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the sphere (haversine)."""
    p, q = F.radians(lat1.cast("double")), F.radians(lat2.cast("double"))
    u, v = F.sin((q - p) / 2), F.sin((F.radians(lon2.cast("double")) - F.radians(lon1.cast("double"))) / 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), u * u + F.cos(p) * F.cos(q) * v * v)))


def text_case(text: Column, style: str) -> Column:
    """A name as kebab-case, snake_case, camelCase or PascalCase: words part at marks, blanks and capitals."""
    parted = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    words = F.filter(F.split(F.lower(F.regexp_replace(parted, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    if style == "kebab":
        return F.array_join(words, "-")
    if style == "snake":
        return F.array_join(words, "_")
    pascal = F.array_join(F.transform(words, lambda w: F.initcap(w)), "")
    if style == "pascal":
        return pascal
    if style == "camel":
        return F.concat(F.lower(F.substring(pascal, 1, 1)), F.substr(pascal, F.lit(2)))
    raise ValueError(f"unknown style {style!r}")


def valid_name(text: Column) -> Column:
    """A name fit for a project: small letters, digits and hyphens, a letter first, no hyphen last or doubled."""
    return text.rlike("^[a-z][a-z0-9]*(-[a-z0-9]+)*$")


def fill_template(template: Column, **values: Column) -> Column:
    """``{{name}}`` marks of a template replaced by values."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value.cast("string"))
    return template
