"""General Ledger and Trial Balance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import credit, debit, narrow, wide_sum
from ledgerloom.operators.gates import bounded_broadcast, require
from ledgerloom.operators.ledger import Ledger
from ledgerloom.schemas import PROFIT_AND_LOSS_TYPES


@dataclass(frozen=True)
class AccrualPolicy:
    """Income and expense from before the fiscal year belong to the retained-earnings account."""

    fiscal_start: int
    retained_account: str

    def check(self, ledger: Ledger, as_of: int) -> None:
        require(self.fiscal_start <= as_of, "fiscal_start_after_as_of")
        found = ledger.accounts.where(F.col("account_id") == self.retained_account).select("account_type").first()
        require(found is not None, "unknown_retained_account", self.retained_account)
        require(found[0] == "equity", "retained_account_not_equity", self.retained_account)


def _quiet(ledger: Ledger, as_of: int) -> DataFrame:
    own = ledger.zero_activity.where((F.col("current_state") == "Current") & (F.col("date") <= as_of))
    return own.withColumn("signed_minor_units", F.lit(None).cast("bigint"))


def zero_activity(ledger: Ledger, as_of: int, validate: bool = True) -> DataFrame:
    """Only the non-monetary rows in force through as_of, with their accounts."""
    if validate:
        ledger.validate(as_of, zero_activity=True)
    rows = _quiet(ledger, as_of) if ledger.zero_activity is not None else ledger.current(as_of).limit(0)
    return ledger.with_accounts(rows)


def general_ledger(ledger: Ledger, as_of: int, start: int | None = None, validate: bool = True, zero_activity: bool = False) -> DataFrame:
    """Postings through as_of with their accounts, from `start` on if given; order by ORDER for presentation.

    Everything through as_of is validated, also what `start` trims. With zero_activity the
    non-monetary rows in force are added with a null amount.
    """
    if validate:
        ledger.validate(as_of, zero_activity)
    rows = ledger.current(as_of)
    if zero_activity and ledger.zero_activity is not None:
        rows = rows.unionByName(_quiet(ledger, as_of), allowMissingColumns=True)
    if start is not None:
        rows = rows.where(F.col("date") >= start)
    return ledger.with_accounts(rows)


#: The order in which a General Ledger is shown.
ORDER = ("date", "account_id", "transaction_id", "posting_id")


def balances(ledger: Ledger, as_of: int, policy: AccrualPolicy | None = None) -> DataFrame:
    """(account_id, net): wide sums, combined map-side; the key is the account, or retained earnings
    for income and expense before the fiscal year."""
    rows = ledger.current(as_of).select("account_id", "date", "signed_minor_units")
    if policy:
        kind = bounded_broadcast(ledger.accounts.select("account_id", "account_type"))
        earlier = F.col("account_type").isin(*PROFIT_AND_LOSS_TYPES) & (F.col("date") < policy.fiscal_start)
        rows = rows.join(kind, "account_id").withColumn("account_id", F.when(earlier, F.lit(policy.retained_account)).otherwise(F.col("account_id")))
    return rows.groupBy("account_id").agg(wide_sum(F.col("signed_minor_units")).alias("net"))


def trial_balance(ledger: Ledger, as_of: int, policy: AccrualPolicy | None = None, zero_accounts: bool = False, validate: bool = True) -> DataFrame:
    """One row per account: net, debit and credit cents; accounts without balance only if asked for.

    A balance beyond 64 bits raises; with validation the ledger and the policy are checked first, which
    also proves that the nets add up to nothing.
    """
    if validate:
        ledger.validate(as_of)
        if policy:
            policy.check(ledger, as_of)
    net = F.coalesce(F.col("net"), F.lit(0).cast("decimal(38,0)"))
    rows = ledger.accounts.join(balances(ledger, as_of, policy), "account_id", "left").withColumn("net", narrow(net))
    if not zero_accounts:
        rows = rows.where("net <> 0")
    rows = rows.withColumnRenamed("net", "net_cents")
    return rows.withColumns({"debit_cents": debit(F.col("net_cents")), "credit_cents": credit(F.col("net_cents"))})


def totals(report: DataFrame) -> DataFrame:
    """(debit_cents, credit_cents) of a whole Trial Balance, wide."""
    return report.agg(*(F.coalesce(wide_sum(F.col(c)), F.lit(0)).alias(c) for c in ("debit_cents", "credit_cents")))
