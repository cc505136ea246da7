"""What is checked before a report is written: its own rows, whatever ledger they came from, and the options asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import wide_sum
from ledgerloom.operators.gates import require, require_none

LEAST = -(1 << 63)
GENERAL_LEDGER_CHECKS = (
    "duplicate_posting", "duplicate_source_row", "account_mismatch", "non_current", "zero_amount", "undisplayable_amount", "after_as_of", "unbalanced_transaction",
)
TRIAL_BALANCE_CHECKS = ("duplicate_account", "inconsistent_row", "unbalanced")
REPORTS = ("trial_balance", "general_ledger", "profit_and_loss", "balance_sheet")


def general_ledger_violations(report: DataFrame, as_of: int) -> DataFrame:
    """(check, key) of a General Ledger's rows: transaction_id, posting_id, account_id, entry_account_id (the account
    joined to it), date, signed_minor_units (null: non-monetary), current_state, source_row.

    Rows are dealt to their keys once, so all checks share one shuffle with map-side counts.
    """
    one, nil, cents = F.lit(1).cast("bigint"), F.lit(None).cast("bigint"), F.col("signed_minor_units")

    def dealt(check, key, n=one, amount=nil):
        return F.struct(F.lit(check).alias("check"), F.col(key).alias("key"), n.alias("n"), amount.alias("cents"))

    tests = [
        dealt("duplicate_posting", "posting_id"), dealt("duplicate_source_row", "source_row"),
        F.when(~F.col("account_id").eqNullSafe(F.col("entry_account_id")), dealt("account_mismatch", "posting_id")),
        F.when(F.col("current_state") != "Current", dealt("non_current", "posting_id")),
        F.when(cents == 0, dealt("zero_amount", "posting_id")), F.when(cents == LEAST, dealt("undisplayable_amount", "posting_id")),
        F.when(F.col("date") > as_of, dealt("after_as_of", "posting_id")),
        dealt("unbalanced_transaction", "transaction_id", nil, F.coalesce(cents, F.lit(0).cast("bigint"))),
    ]
    each = report.select(F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("t")).select("t.*")
    sums = each.groupBy("check", "key").agg(F.sum("n").alias("n"), wide_sum(F.col("cents")).alias("cents"))
    counted = F.col("check").isin("duplicate_posting", "duplicate_source_row")
    return sums.where((counted & (F.col("n") > 1)) | (~counted & F.col("n").isNotNull()) | (F.col("cents") != 0)).select("check", "key")


def trial_balance_violations(report: DataFrame) -> DataFrame:
    """(check, key) of a Trial Balance's rows: account_id, net_cents, debit_cents, credit_cents."""
    twice = report.groupBy("account_id").count().where("count > 1").select(F.lit("duplicate_account").alias("check"), F.col("account_id").alias("key"))
    net, debit, credit = F.col("net_cents"), F.col("debit_cents"), F.col("credit_cents")
    shown = F.when(net > 0, debit.eqNullSafe(net) & credit.isNull()).when(net < 0, debit.isNull() & credit.cast("decimal(38,0)").eqNullSafe(-net.cast("decimal(38,0)")))
    odd = report.where(~shown.otherwise(debit.isNull() & credit.isNull())).select(F.lit("inconsistent_row").alias("check"), F.col("account_id").alias("key"))
    sums = report.agg(*(F.coalesce(wide_sum(c), F.lit(0)).alias(n) for c, n in ((debit, "d"), (credit, "c")))).where("d <> c")
    return reduce(DataFrame.unionByName, (twice, odd, sums.select(F.lit("unbalanced").alias("check"), F.concat_ws(" ", "d", "c").alias("key"))))


def _raise_first(found: DataFrame, checks: tuple[str, ...]) -> None:
    require_none(found.withColumn("rank", F.array_position(F.array(*map(F.lit, checks)), F.col("check")).cast("int")))


def validate_general_ledger(report: DataFrame, as_of: int) -> None:
    _raise_first(general_ledger_violations(report, as_of), GENERAL_LEDGER_CHECKS)


def validate_trial_balance(report: DataFrame) -> None:
    _raise_first(trial_balance_violations(report), TRIAL_BALANCE_CHECKS)


def account_conflicts(*reports: DataFrame) -> DataFrame:
    """(account_id): accounts that the reports of one bundle describe in several ways; the reports share their metadata columns."""
    columns = [c for c in reports[0].columns if c != "account_id"]
    rows = reduce(DataFrame.union, (r.select("account_id", F.struct(*columns).alias("m")).distinct() for r in reports)).distinct()
    return rows.groupBy("account_id").count().where("count > 1").select("account_id")


def merged_chart(catalog: DataFrame, report: DataFrame) -> DataFrame:
    """Catalog accounts and those a report names, each once; an id with two descriptions raises."""
    rows = catalog.unionByName(report.select(*catalog.columns)).distinct()
    require_none(rows.groupBy("account_id").count().where("count > 1").select(F.lit(0).alias("rank"), F.lit("conflicting_account").alias("check"), F.col("account_id").alias("key")))
    return rows


def check_options(
    kind: str, as_of: int, start: int | None = None, fiscal_start: int | None = None, retained_account: str | None = None, retained_name: str | None = None,
    zero_activity: bool = False, zero_accounts: bool = False,
) -> None:
    """Which options a report takes: a Profit & Loss needs a start; Trial Balance and Balance Sheet need the fiscal policy;
    a General Ledger takes a start with zero activity only, and no accounts without balance."""
    require(kind in REPORTS, "unknown_report", kind)
    require(not zero_activity or kind == "general_ledger", "zero_activity_is_for_the_general_ledger", kind)
    require(kind != "profit_and_loss" or start is not None, "start_is_required", kind)
    require(start is None or kind == "profit_and_loss" or zero_activity, "start_does_not_apply", kind)
    require(start is None or start <= as_of, "start_after_as_of", str(start))
    if kind in ("trial_balance", "balance_sheet"):
        require(fiscal_start is not None and retained_account is not None, "fiscal_policy_is_required", kind)
        require(fiscal_start <= as_of, "fiscal_start_after_as_of", str(fiscal_start))
        require(bool(retained_account.strip()) and (retained_name is None or bool(retained_name.strip())), "blank_retained_account", kind)
    else:
        require(fiscal_start is None and retained_account is None and retained_name is None, "fiscal_policy_does_not_apply", kind)
    require(not zero_accounts or kind != "general_ledger", "zero_accounts_do_not_apply", kind)


def report_audit(reports: DataFrame, accounts: int) -> DataFrame:
    """(report, rows, debit_cents, credit_cents, outcome) of native Trial Balances (report, cents): ok, unbalanced, or more
    rows than the oracle has accounts."""
    cents = F.col("cents")
    sums = reports.groupBy("report").agg(
        F.count("*").alias("rows"), wide_sum(F.when(cents > 0, cents).otherwise(0)).cast("bigint").alias("debit_cents"), wide_sum(F.when(cents < 0, -cents).otherwise(0)).cast("bigint").alias("credit_cents"),
    )
    outcome = F.when(F.col("debit_cents") != F.col("credit_cents"), "unbalanced").when(F.col("rows") > accounts, "exceeds_accounts").otherwise("ok")
    return sums.withColumn("outcome", outcome)


def verdict(compared: DataFrame) -> DataFrame:
    """One row: the one-line verdict of a Trial Balance comparison (label, outcome, reference_cents, actual_cents, variance_cents)."""
    zero = F.lit(0)

    def side(c: str, sign: int):
        return F.coalesce(wide_sum(F.greatest(F.col(c) * sign, zero)), zero)

    rd, rc, ad, ac = side("reference_cents", 1), side("reference_cents", -1), side("actual_cents", 1), side("actual_cents", -1)
    count = lambda o: F.count_if(F.col("outcome") == o)
    n = compared.agg(
        count("missing").alias("missing"), count("extra").alias("extra"), count("mismatch").alias("mismatched"), (rd == rc).alias("rb"), (ad == ac).alias("ab"),
        (ad - rd).cast("bigint").alias("dv"), (ac - rc).cast("bigint").alias("cv"), F.coalesce(wide_sum(F.col("variance_cents")), zero).cast("bigint").alias("nv"), F.coalesce(F.max(F.abs("variance_cents")), zero).alias("mv"),
    )
    good = (F.col("missing") + F.col("extra") + F.col("mismatched") == 0) & F.col("rb") & F.col("ab")
    names = {"missing": "missing", "extra": "extra", "mismatched": "mismatched", "reference_balanced": "rb", "actual_balanced": "ab", "debit_variance_cents": "dv", "credit_variance_cents": "cv", "net_variance_cents": "nv", "max_account_variance_cents": "mv"}
    bad = F.concat_ws(" ", F.lit("FAIL:"), *(F.concat(F.lit(f"{k}="), F.col(v).cast("string")) for k, v in names.items()))
    return n.select(F.when(good, "PASS: all accounts and totals reconcile exactly to $0.00").otherwise(bad).alias("line"))
