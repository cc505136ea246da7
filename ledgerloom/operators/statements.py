"""Profit & Loss and Balance Sheet: account rows by section, subtotals and calculated rows, in report order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import narrow, wide_sum
from ledgerloom.operators.gates import require_none
from ledgerloom.operators.ledger import Ledger
from ledgerloom.operators.reports import AccrualPolicy, balances
from ledgerloom.schemas import BROAD_TYPE, CREDIT_TYPES, PROFIT_AND_LOSS_TYPES

#: Derived rows in report order as (sections they add up, with sign; kind; section; key; label).
PROFIT_AND_LOSS = (
    ({"income": 1}, "subtotal", "income", "total_income", "Total Income"),
    ({"cost_of_goods_sold": 1}, "subtotal", "cost_of_goods_sold", "total_cost_of_goods_sold", "Total Cost of Goods Sold"),
    ({"income": 1, "cost_of_goods_sold": -1}, "calculated", "profit", "gross_profit", "Gross Profit"),
    ({"expense": 1}, "subtotal", "expense", "total_expense", "Total Expense"),
    ({"income": 1, "cost_of_goods_sold": -1, "expense": -1}, "calculated", "profit", "net_operating_income", "Net Operating Income"),
    ({"other_income": 1}, "subtotal", "other_income", "total_other_income", "Total Other Income"),
    ({"other_expense": 1}, "subtotal", "other_expense", "total_other_expense", "Total Other Expense"),
    ({"other_income": 1, "other_expense": -1}, "calculated", "profit", "net_other_income", "Net Other Income"),
    (
        {"income": 1, "cost_of_goods_sold": -1, "expense": -1, "other_income": 1, "other_expense": -1},
        "calculated", "profit", "net_income", "Net Income",
    ),
)
BALANCE_SHEET = (
    ({"assets": 1}, "subtotal", "assets", "total_assets", "Total Assets"),
    ({"liabilities": 1}, "subtotal", "liabilities", "total_liabilities", "Total Liabilities"),
    ({"current_income": 1}, "calculated", "equity", "current_year_net_income", "Current Year Net Income"),
    ({"equity": 1, "current_income": 1}, "subtotal", "equity", "total_equity", "Total Equity"),
    (
        {"liabilities": 1, "equity": 1, "current_income": 1},
        "subtotal", "liabilities_and_equity", "total_liabilities_and_equity", "Total Liabilities and Equity",
    ),
)
#: Where each section's account rows stand: before the derived row of this key.
BEFORE = {
    "income": "total_income", "cost_of_goods_sold": "total_cost_of_goods_sold", "expense": "total_expense",
    "other_income": "total_other_income", "other_expense": "total_other_expense",
    "assets": "total_assets", "liabilities": "total_liabilities", "equity": "current_year_net_income",
}


def section_of(account_type: Column, classification: Column) -> Column:
    """The statement section of an account; its classification decides over its type."""
    plain = F.when(account_type == "asset", "assets").when(account_type == "liability", "liabilities").otherwise(account_type)
    return F.when(classification == "OtherIncome", "other_income").when(classification == "OtherExpense", "other_expense").otherwise(plain)


def chart_violations(accounts: DataFrame) -> DataFrame:
    """(rank, check, key): accounts without classification, or with one of another type; the whole chart counts."""
    broad = F.try_element_at(F.create_map(*(F.lit(x) for kv in BROAD_TYPE.items() for x in kv)), F.col("classification"))
    bad = F.when(F.col("classification").isNull() | broad.isNull(), "unclassified_account").when(broad != F.col("account_type"), "classification_disagrees")
    return accounts.select(F.lit(0).alias("rank"), bad.alias("check"), F.col("account_id").alias("key")).where("check is not null")


def _statement(nets: DataFrame, accounts: DataFrame, derived: tuple, zero_accounts: bool) -> DataFrame:
    """nets: (account_id, net). Sections are summed once, before zero rows drop out; derived rows are sums of sections."""
    net = F.coalesce(F.col("net"), F.lit(0).cast("decimal(38,0)"))
    kind = F.col("account_type")
    rows = accounts.join(nets, "account_id", "left").withColumn("net", net)
    rows = rows.withColumn("section", section_of(kind, F.col("classification")))
    rows = rows.withColumn("amount", F.when(kind.isin(*CREDIT_TYPES), -F.col("net")).otherwise(F.col("net")))
    places = {key: i for i, (_, _, _, key, _) in enumerate(derived)}
    shown = [s for s, key in BEFORE.items() if key in places]
    if derived is BALANCE_SHEET:
        rows = rows.withColumn("section", F.when(kind.isin(*PROFIT_AND_LOSS_TYPES), "current_income").otherwise(F.col("section")))
        rows = rows.withColumn("amount", F.when(F.col("section") == "current_income", -F.col("net")).otherwise(F.col("amount")))
    place = F.create_map(*(F.lit(x) for s in shown for x in (s, places[BEFORE[s]])))
    listed = rows.where(F.col("section").isin(*shown))
    listed = listed if zero_accounts else listed.where("net <> 0")
    own = listed.select(
        F.element_at(place, F.col("section")).alias("place"), F.lit(0).alias("after"), F.lit("account").alias("row_kind"), "section",
        F.concat(F.lit("account:"), "account_id").alias("row_key"), F.col("account_name").alias("label"), "account_id",
        narrow(F.col("net")).alias("net_cents"), narrow(F.col("amount")).alias("amount_cents"),
    )
    sums = rows.groupBy("section").agg(wide_sum(F.col("amount")).alias("amount"))
    table = [(s, w, i, k, sec, key, label) for i, (parts, k, sec, key, label) in enumerate(derived) for s, w in parts.items()]
    parts = rows.sparkSession.createDataFrame(table, "section string, weight int, place int, row_kind string, row_section string, row_key string, label string")
    lines = F.broadcast(parts).join(sums, "section", "left").groupBy("place", "row_kind", "row_section", "row_key", "label")
    lines = lines.agg(F.coalesce(wide_sum(F.col("amount") * F.col("weight")), F.lit(0)).alias("amount"))
    lines = lines.select(
        "place", F.lit(1).alias("after"), "row_kind", F.col("row_section").alias("section"), "row_key", "label",
        F.lit(None).cast("string").alias("account_id"), F.lit(None).cast("bigint").alias("net_cents"), narrow(F.col("amount")).alias("amount_cents"),
    )
    order = Window.orderBy("place", "after", "account_id")
    return own.unionByName(lines).withColumn("row_index", F.row_number().over(order) - 1).drop("place", "after")


def profit_and_loss(ledger: Ledger, start: int, through: int, zero_accounts: bool = False, validate: bool = True) -> DataFrame:
    """Income statement of [start, through], inclusive. Everything through the end is validated, not the period alone."""
    if validate:
        require_none(chart_violations(ledger.accounts))
        ledger.validate(through)
    rows = ledger.current(through).where(F.col("date") >= start)
    nets = rows.groupBy("account_id").agg(wide_sum(F.col("signed_minor_units")).alias("net"))
    return _statement(nets, ledger.accounts, PROFIT_AND_LOSS, zero_accounts)


def balance_sheet(ledger: Ledger, as_of: int, policy: AccrualPolicy, zero_accounts: bool = False, validate: bool = True) -> DataFrame:
    """Assets, liabilities and equity from the accrual Trial Balance; the year's income is one calculated row.

    A validated ledger's transactions balance, so assets equal liabilities and equity.
    """
    if validate:
        require_none(chart_violations(ledger.accounts))
        ledger.validate(as_of)
        policy.check(ledger, as_of)
    return _statement(balances(ledger, as_of, policy), ledger.accounts, BALANCE_SHEET, zero_accounts)
