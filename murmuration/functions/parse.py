"""Column parsers for numbers, relative dates and page text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def human_number(text: Column) -> Column:
    """Counts as people write them: '1,5 mil', '3.2K', '1.500', '2 millones'; null or no number: 0.

    One separator before exactly three digits, with no unit, parts thousands; else it is a decimal mark.
    """
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    number = F.regexp_extract(t, r"(\d+(?:[.,]\d+)*)", 1)
    unit = F.when(t.rlike(r"\d\s*(m\b|mill)"), 1e6).when(t.rlike(r"\d\s*(k\b|mil\b)"), 1e3).otherwise(1.0)
    thousands = number.rlike(r"^\d{1,3}([.,]\d{3})+$") & (unit == 1.0)
    plain = F.when(thousands, F.regexp_replace(number, "[.,]", "")).otherwise(F.regexp_replace(number, ",", "."))
    return F.coalesce((plain.try_cast("double") * unit).cast("long"), F.lit(0))


#: Units of relative times (fixed values, in order): pattern of the unit's name, seconds.
UNITS = [(r"s|se[cg]\w*", 1), (r"min\w*|m", 60), (r"h\w*", 3600), (r"d(?:ay|ía|ia)?s?|d", 86400), (r"sem\w*|w\w*", 604800), (r"mes(?:es)?|month\w*", 2592000), (r"a(?:ño|no)s?|y\w*", 31536000)]


def relative_micros(text: Column, now_us: Column) -> Column:
    """'5 min', 'hace 3 horas', '2 days ago', 'ayer', 'yesterday', 'ahora', 'just now' against a reference instant; else null."""
    t = F.lower(F.trim(text))
    out = F.when(t.rlike(r"^(ahora|just now|now)"), now_us).when(t.rlike(r"^(ayer|yesterday)"), now_us - 86_400_000_000)
    n = F.regexp_extract(t, r"^(?:hace\s+)?(\d+)", 1).try_cast("long")
    for name, seconds in UNITS:
        out = out.when(t.rlike(rf"^(?:hace\s+)?\d+\s*(?:{name})\.?(?:\s+ago)?$"), now_us - n * seconds * 1_000_000)
    return out


def visible_text(html: Column) -> Column:
    """Page text without scripts, styles and tags, blanks squeezed; null: empty."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def deep_value(json: Column, *paths: str) -> Column:
    """The first of several JSON paths that holds anything."""
    v = F.try_parse_json(json)
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])
