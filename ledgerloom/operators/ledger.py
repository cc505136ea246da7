"""The ledger: accounts, postings and non-monetary activity, with its gates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import wide_sum
from ledgerloom.operators.gates import bounded_broadcast, require, require_none
from ledgerloom.operators.hierarchy import hierarchy_violations

#: An amount that has no opposite counts as none, like zero.
LEAST = -(1 << 63)
#: What the gates call their findings, in the order in which they are reported.
CHECKS = (
    "duplicate_account", "self_parent", "unknown_parent", "hierarchy_cycle", "zero_amount", "unknown_account",
    "duplicate_posting", "duplicate_source_row", "ambiguous_state", "unbalanced_transaction",
)


def _finding(check: str, key: Column) -> Column:
    return F.struct(F.lit(CHECKS.index(check)).alias("rank"), F.lit(check).alias("check"), key.cast("string").alias("key"))


@dataclass
class Ledger:
    """accounts: schemas.ACCOUNT; postings: schemas.POSTING (columns used: transaction_id, posting_id, account_id,
    date, signed_minor_units, current_state, source_row); zero_activity: the same without amount, never added to money.
    Its ids and source rows must not meet those of postings or of each other, and its accounts must be known."""

    accounts: DataFrame
    postings: DataFrame
    zero_activity: DataFrame | None = None
    complete: bool = True

    def violations(self, as_of: int | None = None, zero_activity: bool = False) -> DataFrame:
        """(rank, check, key) of every broken rule. With as_of also those of the selection through that day, and with
        zero_activity those of the non-monetary rows that are shown by then.

        Rows of a posting are dealt to their keys once: its id, its source row and its transaction meet
        in a single shuffle, combined map-side; nothing is sorted.
        """
        accounts = self.accounts.groupBy("account_id").agg(F.count("*").alias("n")).where("n > 1")
        found = [accounts.select(_finding("duplicate_account", F.col("account_id")).alias("v"))]
        found.append(hierarchy_violations(self.accounts).select(F.struct(F.lit(None).cast("int").alias("rank"), "check", "key").alias("v")))
        known = bounded_broadcast(self.accounts.select(F.col("account_id").alias("known_id")).distinct())
        used = ["transaction_id", "posting_id", "account_id", "date", "current_state", "source_row"]
        rows = self.postings.select(*used, "signed_minor_units", F.lit(False).alias("quiet"))
        if zero_activity and self.zero_activity is not None and as_of is not None:
            through = (F.col("date") <= as_of) & F.col("current_state").isin("Current", "Ambiguous")
            rows = rows.unionByName(self.zero_activity.where(through).select(*used, F.lit(None).cast("bigint").alias("signed_minor_units"), F.lit(True).alias("quiet")))
        rows = rows.join(known, F.col("account_id") == F.col("known_id"), "left")
        one, nil = F.lit(1).cast("bigint"), F.lit(None).cast("bigint")

        def dealt(check: str, key: str, n: Column, cents: Column) -> Column:
            return F.struct(F.lit(check).alias("check"), F.col(key).alias("key"), n.alias("n"), cents.alias("cents"))

        tests = [
            dealt("duplicate_posting", "posting_id", one, nil),
            dealt("duplicate_source_row", "source_row", one, nil),
            F.when(F.col("signed_minor_units").isin(0, LEAST), dealt("zero_amount", "posting_id", one, nil)),
            F.when(F.col("known_id").isNull(), dealt("unknown_account", "posting_id", one, nil)),
        ]
        if as_of is not None:
            through = F.col("date") <= as_of
            tests.append(F.when(through & (F.col("current_state") == "Ambiguous"), dealt("ambiguous_state", "posting_id", one, nil)))
            tests.append(F.when(through & ~F.col("quiet") & (F.col("current_state") == "Current"), dealt("unbalanced_transaction", "transaction_id", nil, F.col("signed_minor_units"))))
        each = rows.select(F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("t")).select("t.*")
        sums = each.groupBy("check", "key").agg(F.sum("n").alias("n"), wide_sum(F.col("cents")).alias("cents"))
        twice = F.col("check").isin("duplicate_posting", "duplicate_source_row") & (F.col("n") > 1)
        alone = F.col("check").isin("zero_amount", "unknown_account", "ambiguous_state")
        broken = sums.where(twice | alone | (F.col("cents") != 0))
        found.append(broken.select(F.struct(F.lit(None).cast("int").alias("rank"), "check", "key").alias("v")))
        rank = F.array_position(F.array(*map(F.lit, CHECKS)), F.col("check")).cast("int") - 1
        return reduce(DataFrame.unionByName, found).select("v.*").select(rank.alias("rank"), "check", "key")

    def validate(self, as_of: int | None = None, zero_activity: bool = False) -> Ledger:
        """Raises the first violation; the ledger itself otherwise."""
        require(self.complete, "incomplete_extraction")
        require_none(self.violations(as_of, zero_activity))
        return self

    def current(self, as_of: int) -> DataFrame:
        """Postings in force through a day, inclusive; superseded and deleted rows drop out silently."""
        return self.postings.where((F.col("current_state") == "Current") & (F.col("date") <= as_of))

    def with_accounts(self, postings: DataFrame) -> DataFrame:
        return postings.join(bounded_broadcast(self.accounts), "account_id")


def transaction_nets(postings: DataFrame) -> DataFrame:
    """(transaction_id, net): transactions whose current postings do not add up to nothing."""
    nets = postings.groupBy("transaction_id").agg(wide_sum(F.col("signed_minor_units")).alias("net"))
    return nets.where("net <> 0").select("transaction_id", F.col("net").cast("bigint").alias("net"))
