"""Integer-exact ratios, qualities and small parsers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigurationError


def scaled_ratio(n: Column, d: Column, scale: int) -> Column:
    """n / d in units of 1/scale, rounded half up in integers."""
    n, d = n.cast("bigint"), d.cast("bigint")
    return F.call_function("div", n * F.lit(scale).cast("bigint") + F.call_function("div", d, F.lit(2).cast("bigint")), d)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a.cast("bigint"), F.lit(b).cast("bigint"))


def fixed_point(units: Column, digits: int) -> Column:
    """An integer of 10 ** -digits units as decimal text."""
    whole, part = _div(units, 10**digits), units % F.lit(10**digits)
    return F.concat_ws(".", whole.cast("string"), F.lpad(part.cast("string"), digits, "0"))


def observation_error(base_quality: Column, mapping_quality: Column) -> Column:
    """Chance that a base is wrong, from both qualities (each at most 60), at most 3/4."""
    wrong = lambda q: F.pow(F.lit(10.0), -F.least(q, F.lit(60)) / F.lit(10.0))
    return F.least(F.lit(0.75), F.lit(1.0) - (F.lit(1.0) - wrong(base_quality)) * (F.lit(1.0) - wrong(mapping_quality)))


def phred(p: Column, most: float) -> Column:
    return F.when(p <= 0, F.lit(most)).otherwise(F.least(F.greatest(F.lit(-10.0) * F.log10(p), F.lit(0.0)), F.lit(most)))


def rounded_phred(p: Column, most: int) -> Column:
    """Half away from zero, as integer."""
    return F.least(F.floor(phred(p, float(most)) + 0.5), F.lit(most)).cast("int")


def parts_per_billion(text: Column) -> Column:
    """A decimal in 0..1 with at most nine places as integer; null if it is not one."""
    ok = text.rlike(r"^(0(\.[0-9]{1,9})?|1(\.0{1,9})?|\.[0-9]{1,9})$")
    return F.when(ok, (F.concat(F.lit("0"), F.regexp_replace(text, r"^0(?=\.)", "")).cast("decimal(20,10)") * F.lit(1_000_000_000)).cast("bigint"))


def region_parts(text: Column) -> tuple[Column, Column, Column]:
    """contig, start, end of ``CONTIG:START-END`` (1-based, inclusive, thousands commas allowed) as a
    half-open interval; the last colon counts. Null where the text is no region."""
    pattern = r"^(.+):([0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)-([0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)$"
    ok = text.rlike(pattern)
    number = lambda k: F.regexp_replace(F.regexp_extract(text, pattern, k), ",", "")
    start, end = F.when(ok, number(2)).cast("bigint"), F.when(ok, number(3)).cast("bigint")
    valid = ok & (start >= 1) & (end >= start)
    return F.when(valid, F.regexp_extract(text, pattern, 1)), F.when(valid, start - 1), F.when(valid, end)


def ppb(text: str) -> int:
    """``parts_per_billion`` for options."""
    if not re.fullmatch(r"(0(\.\d{1,9})?|1(\.0{1,9})?|\.\d{1,9})", text):
        raise ConfigurationError(f"not a probability of at most nine places: {text!r}")
    whole, _, part = text.partition(".")
    return int(whole or 0) * 1_000_000_000 + int(part.ljust(9, "0") or 0)


def required_samples(n: int, min_prop_ppb: int) -> int:
    """At least one, and the proportion of ``n`` rounded up, in integers."""
    return max(1, -(-n * min_prop_ppb // 1_000_000_000))
