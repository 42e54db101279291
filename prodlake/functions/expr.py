"""Column helpers.  Everything here is a built-in expression and stays in the JVM."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

OIL, GAS = "O", "G"


def commodity_value(group: str, value: str | Column = "production") -> Column:
    """``value`` on rows of one commodity, null on all others."""
    measure = F.col(value) if isinstance(value, str) else value
    return F.when(F.col("oil_and_gas_group") == group, measure)


def normalize_key(col: str) -> Column:
    """Upper case without surrounding spaces.  A blank key becomes '' and stays."""
    return F.trim(F.upper(F.col(col)))


def number_or_null(col: str) -> Column:
    """Text to double; anything unreadable (thousands commas included) is null."""
    return F.col(col).try_cast("double")


def grouped_number_or_null(col: str) -> Column:
    """Text to double after dropping thousands commas."""
    return F.regexp_replace(F.col(col), ",", "").try_cast("double")


def date_or_null(col: str) -> Column:
    """Text of the form ``yyyy-MM-dd`` to date, anything else is null.

    The pattern rules out what a plain cast would also take (``2020-1-1``, ``2020``, a time
    behind the date); pattern and cast together cost about half of ``try_to_date``.
    """
    strict = F.col(col).rlike(r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    return F.when(strict, F.col(col).try_cast("date"))


def quarter_label(col: str) -> Column:
    return F.concat(F.lit("Q"), F.quarter(F.col(col)).cast("string"))


def period_label(col: str) -> Column:
    """Year-qualified quarter such as ``2018Q1``."""
    return F.concat(F.year(F.col(col)).cast("string"), quarter_label(col))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` where the denominator is positive, else null."""
    return F.when(denominator > 0, numerator / denominator)


def growth_pct(value: Column, previous: Column) -> Column:
    """Percent change against a positive previous value, else null."""
    return safe_ratio(value - previous, previous) * 100


def share_pct(part: Column, other: Column) -> Column:
    return safe_ratio(part, part + other) * 100


# The thresholds of the classes below.
def flaring_category(ratio_pct: Column) -> Column:
    """Low below 5 %, Medium up to and including 15 %, otherwise High (null too)."""
    return (
        F.when(ratio_pct < 5, "Low").when(ratio_pct.between(5, 15), "Medium").otherwise("High")
    )


def basin_category(ratio: Column, threshold: float = 0.3) -> Column:
    """Liquid-Rich strictly above the threshold, otherwise Dry Gas (null too)."""
    return F.when(ratio > threshold, "Liquid-Rich").otherwise("Dry Gas")


def percentile_tier(value: Column, low: Column, high: Column) -> Column:
    """High from ``high`` upwards, Low up to ``low``, Medium between and for null."""
    return F.when(value >= high, "High").when(value <= low, "Low").otherwise("Medium")


def title_case(col: Column) -> Column:
    """Capitalise the first letter of every run of letters, lower-case the rest.

    ``initcap`` only starts a word after white space; here any non-letter does.
    """
    runs = F.regexp_extract_all(F.lower(col), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    capital = F.transform(
        runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.substr(run, F.lit(2)))
    )
    return F.array_join(capital, "")


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rounding_error(x: Column, factor: float) -> Column:
    """What ``x * factor`` loses to rounding, exactly (Dekker's product)."""
    splitter = 134217729.0  # 2**27 + 1
    f_high = factor * splitter - (factor * splitter - factor)
    f_low = factor - f_high
    x_high = x * splitter - (x * splitter - x)
    x_low = x - x_high
    return ((x_high * f_high - x * factor) + x_high * f_low + x_low * f_high) + x_low * f_low


def _whole(x: Column) -> Column:
    """The exact digits of a non-negative whole double below 1e38.

    A cast to decimal goes through the shortest text of the double; parts of 35 bits do not.
    """
    low_bits, high_bits = float(2**35), float(2**70)
    high = F.floor(x / high_bits)
    rest = x - high.cast("double") * high_bits
    middle = F.floor(rest / low_bits)
    low = F.floor(rest - middle.cast("double") * low_bits)

    def exact(part: Column, unit: int) -> Column:
        return part.cast("decimal(17,0)") * F.lit(Decimal(unit)).cast("decimal(21,0)" if unit == 1 else "decimal(22,0)")

    small = low.cast("decimal(38,0)") + (middle.cast("decimal(11,0)") * F.lit(Decimal(2**35)).cast("decimal(11,0)")).cast("decimal(38,0)")
    big = exact(high, 2**70).cast("decimal(38,0)")
    return F.when(x < low_bits, x.cast("bigint").cast("string")).otherwise((big + small).cast("decimal(38,0)").cast("string"))


def fixed_point(value: Column, places: int = 1) -> Column:
    """Text with ``places`` decimals, rounding the exact binary value half to even.

    ``format_string`` rounds the shortest decimal form half up, which differs on
    ties: 0.25 must print as 0.2 and 1.15 (in binary just below) as 1.1.  From 2**52 on a double
    is whole and prints all of its digits; infinity prints as ``inf``, values of 1e38 and more
    in exponent form.
    """
    factor = float(10**places)

    def units(x: Column) -> Column:
        floor = F.floor(x * factor).cast("double")
        over = x * factor - floor - 0.5
        lost = _rounding_error(x, factor)
        odd = F.pmod(floor, F.lit(2.0)) == 1
        up = (over > 0) | ((over == 0) & ((lost > 0) | ((lost == 0) & odd)))
        return (floor + up.cast("double")).cast("decimal(38,0)").cast("string")

    def with_point(digits: Column) -> Column:
        padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(places + 1)), F.lit("0"))
        return F.regexp_replace(padded, f"(\\d{{{places}}})$", ".$1") if places else padded

    zeros = "." + "0" * places if places else ""

    def text(x: Column) -> Column:
        return (
            F.when(x == float("inf"), "inf")
            .when(x >= 1e38, x.cast("string"))
            # below, x times the factor stays within the 53 bits of a double
            .when(x >= 2.0**52 / factor, _bind(x, _split_text(zeros, places)))
            .otherwise(_bind(_bind(x, units), with_point))
        )

    sign = F.when(value < 0, "-").otherwise("")
    return F.concat(sign, _bind(F.abs(value), text))


def _split_text(zeros: str, places: int):
    """Whole part and decimals apart, for values whose scaled form does not fit a double."""

    def text(x: Column) -> Column:
        whole = F.when(x < 2.0**52, F.floor(x).cast("double")).otherwise(x)
        # a multiple of a power of two above 2**-14 here: the decimal form is exact
        rest = F.bround((x - whole).cast("decimal(38,30)"), places)
        carried = F.when(rest >= 1, whole + 1).otherwise(whole)
        decimals = F.when(rest >= 1, rest - 1).otherwise(rest)
        shown = F.substr(F.format_number(decimals, places), F.lit(2)) if places else F.lit("")
        return F.when(x >= 2.0**52, F.concat(_whole(x), F.lit(zeros))).otherwise(F.concat(_whole(carried), shown))

    return text


def humanize(value: Column, suffix: str = "", places: int = 1) -> Column:
    """Short magnitude text: 1.2K, 3.4M, 5.6B; a dash for null and NaN."""

    def scaled(divisor: float, unit: str):
        return lambda x: F.concat(fixed_point(x / divisor, places), F.lit(unit + suffix))

    def text(x: Column) -> Column:
        size = F.abs(x)
        return (
            F.when(size.isNull() | F.isnan(size), "—")
            .when(size >= 1e9, scaled(1e9, "B")(x))
            .when(size >= 1e6, scaled(1e6, "M")(x))
            .when(size >= 1e3, scaled(1e3, "K")(x))
            .otherwise(scaled(1.0, "")(x))
        )

    return _bind(value.cast("double"), text)


def short_name(name: Column, identifier: Column, length: int = 20) -> Column:
    """The first characters of the name, or of the identifier where there is none."""
    chosen = F.when(name.isNull() | (name == ""), identifier).otherwise(name)
    return F.substring(chosen, 1, length)


def id_tail(identifier: Column, length: int = 6) -> Column:
    return F.right(identifier, F.lit(length))


def without_country(place: Column) -> Column:
    return F.replace(place, F.lit(", US"), F.lit(""))


def month_year(date: Column) -> Column:
    return F.date_format(date, "MMM yyyy")
