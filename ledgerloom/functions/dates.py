"""Dates as numbers: accounting days, posting minutes and catalog days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first accounting day; catalog days from 1970-01-01; the days a line item may carry.
EPOCH, CATALOG_SHIFT, CATALOG_CEILING, LINE_CEILING = "1600-02-29", 4017, 80_000, 30_000


def accounting_day(date: Column) -> Column:
    """Days since 1600-02-29."""
    return F.datediff(date.cast("date"), F.lit(EPOCH).cast("date"))


def date_of(day: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), day)


def minutes_of(date: Column) -> Column:
    """The stored posting date: minutes at midnight of an accounting day."""
    return accounting_day(date) * 1440


def date_of_minutes(minutes: Column) -> Column:
    """The date of stored minutes; null unless they are a midnight."""
    return F.when(F.pmod(minutes, F.lit(1440)) == 0, date_of((minutes / 1440).cast("int")))


def catalog_to_unix_day(day: Column) -> Column:
    """Days since 1970-01-01 of a plausible catalog day, else null."""
    return F.when((day > 0) & (day < CATALOG_CEILING), day - CATALOG_SHIFT)


def unix_to_catalog_day(day: Column) -> Column:
    moved = day + CATALOG_SHIFT
    return F.when((moved > 0) & (moved < CATALOG_CEILING), moved)


def line_item_unix_day(day: Column) -> Column:
    return F.when((day > 0) & (day < LINE_CEILING), day - CATALOG_SHIFT)


def iso_of_unix_day(day: Column) -> Column:
    return F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd")


def parse_iso(text: Column) -> Column:
    """Strict yyyy-MM-dd, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def parse_desktop(text: Column, start: Column, end: Column) -> Column:
    """The accounting day of m/d/yy or m/d/yyyy: of both centuries that a two-digit year may mean, the one in
    [start, end]. Null if the form is wrong, either century lacks the date, or not exactly one fits."""
    parts = F.split(F.trim(text), "/", -1)
    m, d, y = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    form = (F.size(parts) == 3) & m.rlike(r"^\d{1,2}$") & d.rlike(r"^\d{1,2}$") & y.rlike(r"^(\d{2}|\d{4})$")

    def day(year: Column) -> Column:
        written = F.format_string("%04d-%02d-%02d", year.cast("int"), F.try_to_number(m, F.lit("99")).cast("int"), F.try_to_number(d, F.lit("99")).cast("int"))
        return accounting_day(F.try_to_date(written, "yyyy-MM-dd"))

    number = F.when(form, y.cast("int"))
    four = day(number)
    old, new = day(number + 1900), day(number + 2000)
    first, second = old.between(start, end), new.between(start, end)
    two = F.when(old.isNotNull() & new.isNotNull() & (first != second), F.when(first, old).otherwise(new))
    return F.when(form, F.when(F.length(y) == 4, F.when(four.between(start, end), four)).otherwise(two))
