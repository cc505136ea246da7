"""Money: integer cents everywhere; text only at the edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def wide_sum(cents: Column) -> Column:
    """A sum that no number of 64-bit rows overflows."""
    return F.sum(cents.cast(WIDE))


def narrow(total: Column) -> Column:
    """A wide total as a 64-bit number; out of range raises (ANSI cast)."""
    return total.cast("bigint")


def from_double(amount: Column) -> Column:
    """Cents of a two-decimal amount held as a double."""
    return F.round(amount * 100).cast("bigint")


def format_cents(cents: Column) -> Column:
    """-?D.DD"""
    wide = cents.cast(WIDE)
    size = F.abs(wide)
    whole, rest = F.floor(size / 100).cast(WIDE), (size % 100).cast("int")
    return F.concat(F.when(wide < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 2, "0"))


def parse_money(text: Column) -> Column:
    """Cents of report money: blank and '-' are 0; parentheses or a sign, '$', commas and blanks may stand
    around digits with up to two decimals. Null if malformed or out of range."""
    bare = F.trim(text)
    paren = bare.rlike(r"^\(.*\)$")
    inner = F.regexp_replace(bare, r"^\((.*)\)$", "$1")
    minus = paren | inner.startswith("-")
    digits = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(inner, r"^[-+]", "")), r"^\$", ""), "[, ]", "")
    good = digits.rlike(r"^[0-9]+(\.[0-9]{0,2})?$")
    whole, fraction = F.split_part(digits, F.lit("."), F.lit(1)), F.rpad(F.split_part(digits, F.lit("."), F.lit(2)), 2, "0")
    cents = F.concat(whole, fraction).try_cast("bigint")
    return F.when((bare == "") | (bare == "-"), F.lit(0).cast("bigint")).when(good, F.when(minus, -cents).otherwise(cents))


def parse_integer_cents(text: Column) -> Column:
    """Strict integer cents; blank is null (as is anything else that is no 64-bit integer)."""
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast("bigint"))


def debit(signed: Column) -> Column:
    return F.when(signed > 0, signed)


def credit(signed: Column) -> Column:
    return F.when(signed < 0, -signed)


def signed(side: Column, cents: Column) -> Column:
    return F.when(side == "debit", cents).when(side == "credit", -cents)
