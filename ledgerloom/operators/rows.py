"""Typed rows of accounting tables: which tables carry what, fields of partial rows, and rows to postings or exclusions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.gates import require

#: Ids of the accounting tables.
TABLES = {
    "account_internal": 3025, "account_user": 3026, "bill_payment_check_header": 3038, "bill_payment_check_line": 3039, "bill_header": 3040, "bill_line": 3042,
    "check_header": 3045, "check_line": 3047, "deposit_header": 3068, "deposit_line": 3069, "general_journal_header": 3076, "general_journal_line": 3078,
}
#: Widths that a column of each domain may have; domains that are not named take any.
WIDTHS = {"small_int": (2,), "integer": (1, 2, 4, 8), "uint64": (8,), "int64": (8,), "uint32": (4,), "date": (4,), "datetime": (8,), "enum": (1, 2, 4, 8)}
#: The transaction type of a line table's postings; a bill's depends on its view, 1 a bill and 2 a vendor credit.
KINDS = {"bill_payment_check_line": "bill-pmt-check", "check_line": "check", "deposit_line": "deposit", "general_journal_line": "general-journal"}
BILL_VIEWS = {1: "bill", 2: "vendor-credit"}


def is_posting_table(table_id: Column) -> Column:
    return table_id.isin(*(v for k, v in TABLES.items() if k.endswith("_line")))


def is_header_table(table_id: Column) -> Column:
    return table_id.isin(*(v for k, v in TABLES.items() if k.endswith("_header")))


def field(values: Column, columns: Column, name: str) -> Column:
    """The value of a named column in a row that was read as far as its values go; null if it lies beyond, or is no column."""
    at = F.array_position(columns, name).cast("int")
    return F.when(at > 0, F.get(values, at - 1))


def boolean_field(values: Column, columns: Column, name: str) -> Column:
    """The same of a boolean column, whose stored forms are 0 and 1; any other form is null."""
    found = field(values, columns, name)
    return F.when(found == "1", True).when(found == "0", False)


def invalid_widths(columns: DataFrame) -> DataFrame:
    """(table_id, column_id): columns whose width does not go with their domain; a numeric needs a positive width of at
    least its scale, which is not negative. All widths fit 16 bits."""
    width, domain = F.col("width"), F.col("domain")
    good = reduce(lambda a, kv: a.when(domain == kv[0], width.isin(*kv[1])), WIDTHS.items(), F.when(~width.between(0, 65535), False))
    good = good.when(domain == "numeric", (width > 0) & (F.col("scale") >= 0) & (width >= F.col("scale"))).otherwise(True)
    return columns.where(~good).select("table_id", "column_id")


def complete_schema(columns: DataFrame, allowed: DataFrame) -> DataFrame:
    """(table_id, complete): whether a table's column ids run from 1 without gap, all its widths are valid, and each column's
    default envelope is one of those allowed for it (allowed: domain, envelope; a null envelope is always allowed)."""
    ids = columns.groupBy("table_id").agg((F.countDistinct("column_id") == F.max("column_id")).alias("whole"), (F.count("*") == F.countDistinct("column_id")).alias("once"))
    bad = invalid_widths(columns).select("table_id")
    odd = columns.where("envelope is not null").join(allowed, ["domain", "envelope"], "left_anti").select("table_id")
    broken = bad.union(odd).distinct().withColumn("broken", F.lit(True))
    return ids.join(broken, "table_id", "left").select("table_id", (F.col("whole") & F.col("once") & F.col("broken").isNull()).alias("complete"))


def account_shape(columns: DataFrame, wanted: list[tuple[int, str, str]]) -> None:
    """Raises unless an account table has exactly the wanted columns (column id, name, domain), no fewer and no more."""
    found = {tuple(r) for r in columns.select("column_id", "name", "domain").limit(len(wanted) + 1).collect()}
    require(found == set(wanted), "account_schema", ",".join(sorted(str(x) for x in found ^ set(wanted))))


def exact_accounts(rows: DataFrame) -> DataFrame:
    """Accounts of whole rows only (remaining: bytes left over after the last column); a row with bytes left or without a
    name is left out by `inexact_accounts`, not repaired."""
    return rows.where("remaining = 0 and trim(name) <> ''").drop("remaining")


def inexact_accounts(rows: DataFrame) -> DataFrame:
    return rows.where("not (remaining = 0 and trim(coalesce(name, '')) <> '')").select("record")


def with_hierarchy(accounts: DataFrame, names: DataFrame) -> DataFrame:
    """accounts with their full and display names; blank or missing names raise."""
    both = accounts.join(names, "account_id", "left")
    blank = both.where("coalesce(trim(account_full_name), '') = '' or coalesce(trim(account_display_name), '') = ''").select("account_id").first()
    require(blank is None, "blank_account_name", blank and blank[0])
    return both


def posting_type(table_id: Column, view: Column) -> Column:
    """The transaction type of a line; null for a bill of an unknown view and for tables without postings."""
    line = reduce(lambda a, kv: a.when(table_id == TABLES[kv[0]], kv[1]), KINDS.items(), F.when(table_id == TABLES["bill_line"], reduce(lambda a, kv: a.when(view == kv[0], kv[1]), BILL_VIEWS.items(), F.when(view.isNull(), None))))
    return line


def adapted(rows: DataFrame) -> DataFrame:
    """rows (table_id, target_id, transaction_id, account_id, date, view, cents, is_source, is_no_post, is_memorized) with
    transaction_type and disposition.

    Flags come first: no_post, memorized, source (without amount). Then what a posting needs: a known view (unknown_view),
    a day (invalid_date), an amount (invalid_amount) and an account (invalid_account). A zero is canonical but in a journal,
    where it is invalid. Null flags, of rows read in part, count as unset.
    """
    kind, cents, flag = posting_type(F.col("table_id"), F.col("view")), F.col("cents"), lambda c: F.coalesce(F.col(c), F.lit(False))
    journal = F.col("table_id") == TABLES["general_journal_line"]
    outcome = (
        F.when(flag("is_no_post"), "no_post").when(flag("is_memorized"), "memorized").when(flag("is_source") & cents.isNull(), "source")
        .when(kind.isNull(), "unknown_view").when(F.col("date").isNull(), "invalid_date").when(cents.isNull() | (journal & (cents == 0)), "invalid_amount")
        .when(F.col("account_id").isNull(), "invalid_account").when(cents == 0, "canonical_zero").otherwise("posting")
    )
    return rows.withColumns({"transaction_type": kind, "disposition": outcome})
