"""Exact money and rounding as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,9)"


def to_minor(text: Column, decimals: int = 2, decimal_sep: str = ".", thousands_sep: str = ",") -> tuple[Column, Column]:
    """(minor units or null, error or null) of an amount as text.

    A currency sign or code before the number is dropped, (1.50) is negative, digits may be grouped, halves round to
    even. Debit and credit marks are refused, as their sign depends on the account. Null and blank text is an error.
    """
    raw = F.trim(F.coalesce(text, F.lit("")))
    bare = F.trim(F.regexp_replace(raw, r"^\(?\s*(?:[A-Z]{3}|Rs\.?|[\p{Sc}])\s*", ""))
    negative = raw.rlike(r"^\(.*\)$") | raw.rlike(r"^-|^[A-Z]{3}\s*-|^[\p{Sc}]\s*-|^Rs\.?\s*-")
    digits = F.regexp_replace(bare, r"[()\-+\s]", "")
    if thousands_sep:
        digits = F.replace(digits, F.lit(thousands_sep), F.lit(""))
    digits = F.replace(digits, F.lit(decimal_sep), F.lit("."))
    value = F.regexp_extract(digits, r"^(\d+(\.\d*)?|\.\d+)$", 0).try_cast(WIDE)  # other texts give "", which is no number
    minor = F.bround(value * (10**decimals), 0).try_cast("long") * F.when(negative, -1).otherwise(1)  # the text is read once
    refused = raw.rlike(r"(?i)\b(dr|cr)\.?$")
    error = F.when(raw == "", "amount is empty").when(refused, "debit or credit mark in amount").when(minor.isNull(), F.concat(F.lit("not an amount: "), raw))
    return F.when(~refused, minor), error


def basis_points(diff: Column, a: Column, b: Column) -> Column:
    """|diff| in ten-thousandths of the larger of |a| and |b|; infinite where both are 0 and diff is not."""
    base = F.greatest(F.abs(a), F.abs(b))
    return F.when(diff == 0, F.lit(0.0)).when(base == 0, F.lit(float("inf"))).otherwise(F.abs(diff) * 10000.0 / base)


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Halves towards positive infinity, as read models show rates."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def round_half_even(x: Column, digits: int = 0) -> Column:
    """Halves to even, as scores are shown."""
    return F.bround(x, digits)


def line_amounts(price_minor: Column, qty_milli: Column, tax_rate_bp: Column) -> tuple[Column, Column]:
    """(amount, tax within it) of a line whose price includes tax; halves to even."""
    amount = F.bround((price_minor * qty_milli).cast("decimal(30,0)") / F.lit(1000).cast("decimal(5,0)"), 0).cast("long")
    tax = F.bround((amount * tax_rate_bp).cast("decimal(25,0)") / (F.lit(10000) + tax_rate_bp).cast("decimal(10,0)"), 0).cast("long")
    return amount, tax


def per_hundred(bills: Column, visitors: Column) -> Column:
    """Bills per 100 visitors with one decimal; null without visitors."""
    return F.when(visitors > 0, F.floor(bills * 1000.0 / visitors + 0.5) / 10.0)
