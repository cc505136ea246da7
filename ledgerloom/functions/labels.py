"""Account labels, transaction types and other report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.schemas import BROAD_TYPE, CLASSIFICATIONS, CREDIT_TYPES

#: Spellings that mean one transaction type when reports are compared.
COMPARED = {
    "journal": "general journal", "vendor credit": "credit",
    "bill payment check": "bill pmt-check", "bill pmt -check": "bill pmt-check",
}
#: Types that may prove a payables control section, by their letters and digits alone.
PAYABLES = {
    "bill": "bill", "billpmtcheck": "bill-pmt-check", "billpaymentcheck": "bill-pmt-check", "credit": "credit",
    "vendorcredit": "credit", "generaljournal": "general-journal", "check": "check", "deposit": "deposit",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def without_number(label: Column) -> Column:
    """An account label without its 'digits · ' prefix."""
    return F.regexp_replace(F.trim(label), r"^[0-9]+\s+·\s+", "")


def has_number(label: Column) -> Column:
    return F.trim(label).rlike(r"^[0-9]+\s+·\s")


def leaf(label: Column) -> Column:
    return F.substring_index(label, ":", -1)


def is_total_row(label: Column) -> Column:
    return F.lower(F.trim(label)).rlike("^total($|[ :])")


def is_total_label(label: Column) -> Column:
    return F.lower(F.trim(label)).rlike("^total($| )")


def compared_type(kind: Column) -> Column:
    """A transaction type as two reports compare it."""
    plain = F.lower(F.regexp_replace(F.trim(kind), r"\s+", " "))
    return F.coalesce(lookup(COMPARED, plain), plain)


def payables_type(kind: Column) -> Column:
    """A type of the closed payables set, else null."""
    return lookup(PAYABLES, F.lower(F.regexp_replace(kind, "[^A-Za-z0-9]", "")))


def stem(column: Column) -> Column:
    """What a column named <stem>_id or <stem>_id_h refers to, else null."""
    found = F.regexp_extract(column, r"^(.+?)_id(_h)?$", 1)
    return F.when(found != "", found)


def header_type(table: Column) -> Column:
    """The transaction type that a header table's name says."""
    return F.regexp_replace(F.regexp_replace(table, "^abmc_", ""), "_header$", "")


def classification_of_code(code: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, CLASSIFICATIONS)), code.cast("int") + 1)


def broad_type(classification: Column) -> Column:
    return lookup(BROAD_TYPE, classification)


def normal_balance(account_type: Column) -> Column:
    return F.when(account_type.isin(*CREDIT_TYPES), "credit").otherwise("debit")


def csv_field(text: Column) -> Column:
    """RFC 4180 quoting where a comma, quote or line end asks for it."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(F.coalesce(text, F.lit("")))


def spreadsheet_safe(text: Column) -> Column:
    """A field that no spreadsheet takes for a formula."""
    return F.when(text.rlike("^[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)


def activity_flag(activity: Column) -> Column:
    """The older three-state flag: 1, 0 or null."""
    return F.when(activity == "active", 1).when(activity == "inactive", 0)
