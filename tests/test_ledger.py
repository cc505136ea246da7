"""A bakery's small ledger: reports worked out by hand, gates and hierarchies."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import hierarchy, reports, statements
from ledgerloom.operators.gates import LedgerError
from ledgerloom.operators.ledger import Ledger
from ledgerloom.operators.reports import AccrualPolicy
from ledgerloom.schemas import ACCOUNT, BROAD_TYPE, POSTING

#: account: classification, number, parent.
CHART = {
    "sales": ("Income", "40", None), "bread": ("Income", None, "sales"), "cakes": ("Income", "42", "sales"), "flour": ("CostOfGoodsSold", None, None),
    "wages": ("Expense", "60", None), "rent": ("Expense", None, None), "interest": ("OtherIncome", None, None), "fines": ("OtherExpense", None, None),
    "till": ("Bank", None, None), "stock": ("OtherCurrentAsset", None, None), "oven": ("FixedAsset", None, None), "supplier": ("AccountsPayable", None, None),
    "mortgage": ("LongTermLiability", None, None), "owner": ("Equity", None, None), "kept": ("Equity", "39", None),
}
START, END = 500, 560
#: day, debit, credit, cents; two years, and one sale after the reports' last day.
DAYBOOK = [
    (430, "till", "owner", 75000), (455, "till", "bread", 8800), (470, "wages", "till", 3100),
    (500, "oven", "mortgage", 41000), (503, "till", "bread", 12050), (509, "till", "cakes", 4475), (517, "flour", "supplier", 3990), (524, "wages", "till", 5200),
    (531, "supplier", "till", 2500), (538, "fines", "till", 85), (544, "till", "interest", 36), (552, "bread", "till", 640), (560, "stock", "till", 1775),
    (571, "till", "cakes", 9999),
]


def accounts(spark, **parents):
    rows = [(k, number, k.title(), parents.get(k, parent), BROAD_TYPE[c], c, "active") for k, (c, number, parent) in CHART.items()]
    return spark.createDataFrame(rows, ACCOUNT)


def entries(daybook, state="Current", prefix="e"):
    out = []
    for i, (day, debit, credit, amount) in enumerate(daybook):
        for side, account, cents in (("d", debit, amount), ("c", credit, -amount)):
            p = f"{prefix}{i}-{side}"
            out.append((f"{prefix}{i}", p, account, day, cents, state, f"row-{p}", None, None, "test", "Journal", None))
    return out


@pytest.fixture(scope="module")
def book(spark):
    void = entries([(540, "till", "bread", 333)], "Deleted", "gone") + entries([(541, "wages", "till", 77)], "Superseded", "old")
    return Ledger(accounts(spark), spark.createDataFrame(entries(DAYBOOK) + void, POSTING))


def amounts(report):
    return {r.row_key: r.amount_cents for r in report.collect()}


def test_profit_and_loss(book):
    found = amounts(statements.profit_and_loss(book, START, END))
    assert {k: v for k, v in found.items() if not k.startswith("account:")} == {
        "total_income": 15885, "total_cost_of_goods_sold": 3990, "gross_profit": 11895, "total_expense": 5200, "net_operating_income": 6695,
        "total_other_income": 36, "total_other_expense": 85, "net_other_income": -49, "net_income": 6646,
    }
    assert found["account:bread"] == 11410 and found["account:cakes"] == 4475 and "account:rent" not in found
    for (a, b), net in {(538, 538): -85, (455, 470): 5700, (571, 571): 9999}.items():
        assert amounts(statements.profit_and_loss(book, a, b, validate=False))["net_income"] == net


def test_balance_sheet(book):
    found = amounts(statements.balance_sheet(book, END, AccrualPolicy(START, "kept")))
    assert found["account:kept"] == 5700 and found["current_year_net_income"] == 6646 and found["account:till"] == 87061
    assert (found["total_assets"], found["total_liabilities"], found["total_equity"]) == (129836, 42490, 87346)
    assert found["total_liabilities_and_equity"] == found["total_assets"]
    later = amounts(statements.balance_sheet(book, 571, AccrualPolicy(571, "kept"), validate=False))
    assert later["account:kept"] == 12346 and later["current_year_net_income"] == 9999


def test_statement_rows_are_in_report_order(book):
    rows = statements.profit_and_loss(book, START, END, zero_accounts=True, validate=False).orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(len(rows)))
    keys = [r.row_key for r in rows]
    assert keys.index("account:rent") < keys.index("total_expense") < keys.index("net_operating_income") and keys[-1] == "net_income"


def test_trial_balance(book):
    rows = {r.account_id: r for r in reports.trial_balance(book, END).collect()}
    assert sum(r.net_cents for r in rows.values()) == 0 and rows["till"].debit_cents == 87061 and rows["owner"].credit_cents == 75000
    assert "rent" in {r.account_id for r in reports.trial_balance(book, END, zero_accounts=True, validate=False).collect()}
    debit, credit = reports.totals(reports.trial_balance(book, END, validate=False)).first()
    assert debit == credit == 87061 + 41000 + 1775 + 3990 + 8300 + 85


def test_general_ledger_trims_but_validates_all(book):
    assert reports.general_ledger(book, END, 531).count() == 2 * 5
    cut = book.postings.where("posting_id <> 'e0-c'")
    with pytest.raises(LedgerError, match="unbalanced_transaction: e0"):
        reports.general_ledger(Ledger(book.accounts, cut), END, 531)


@pytest.mark.parametrize(
    "change, check",
    [
        (lambda p: p.withColumn("signed_minor_units", F.when(p.posting_id == "e3-d", 0).otherwise(p.signed_minor_units)), "zero_amount"),
        (lambda p: p.withColumn("account_id", F.when(p.posting_id == "e3-d", "cellar").otherwise(p.account_id)), "unknown_account"),
        (lambda p: p.union(p.where("posting_id = 'e3-d'")), "duplicate_posting"),
        (lambda p: p.withColumn("source_row", F.when(p.posting_id == "e3-d", "row-e3-c").otherwise(p.source_row)), "duplicate_source_row"),
        (lambda p: p.withColumn("current_state", F.when(p.transaction_id == "e3", "Ambiguous").otherwise(p.current_state)), "ambiguous_state"),
        (lambda p: p.withColumn("date", F.when(p.posting_id == "e13-c", 559).otherwise(p.date)), "unbalanced_transaction"),
    ],
)
def test_gates(book, change, check):
    with pytest.raises(LedgerError) as e:
        Ledger(book.accounts, change(book.postings)).validate(END)
    assert e.value.check == check


def test_ambiguous_rows_after_the_cutoff_do_not_block(book):
    later = book.postings.withColumn("current_state", F.when(book.postings.date == 571, "Ambiguous").otherwise(book.postings.current_state))
    Ledger(book.accounts, later).validate(END)


def test_incomplete_and_policy(book):
    with pytest.raises(LedgerError, match="incomplete"):
        Ledger(book.accounts, book.postings, complete=False).validate()
    for policy, check in ((AccrualPolicy(561, "kept"), "fiscal_start"), (AccrualPolicy(START, "none"), "unknown_retained"), (AccrualPolicy(START, "till"), "not_equity")):
        with pytest.raises(LedgerError, match=check):
            policy.check(book, END)


def test_names(spark):
    rows = {r.account_id: r for r in hierarchy.names(accounts(spark)).collect()}
    assert rows["bread"].account_full_name == "Sales:Bread" and rows["bread"].account_display_name == "40 · Sales:Bread"
    assert rows["cakes"].account_display_name == "42 · Sales:Cakes" and rows["till"].account_display_name == "Till"


@pytest.mark.parametrize("parents, check", [({"oven": "oven"}, "self_parent"), ({"oven": "cellar"}, "unknown_parent"), ({"sales": "bread"}, "hierarchy_cycle")])
def test_hierarchy_gates(spark, parents, check):
    with pytest.raises(LedgerError) as e:
        hierarchy.names(accounts(spark, **parents))
    assert e.value.check == check


@pytest.mark.parametrize("levels", [30, 1000])
def test_deep_charts_are_valid(spark, levels):
    rows = [(f"a{i}", "7" if i == 0 else None, f"n{i}", f"a{i - 1}" if i else None, "asset", "Bank", "active") for i in range(levels)]
    chart = spark.createDataFrame(rows, ACCOUNT)
    assert hierarchy.hierarchy_violations(chart).count() == 0
    leaf = hierarchy.names(chart).where(F.col("account_id") == f"a{levels - 1}").first()
    assert leaf.account_full_name == ":".join(f"n{i}" for i in range(levels)) and leaf.account_display_name.startswith("7 · n0:n1:")


def test_cycles_are_told_from_what_hangs_below_and_beside(spark):
    parents = {"a": "b", "b": "c", "c": "a", "below": "a", "lower": "below", "root": None, "leaf": "root", "own": "own", "lost": "nowhere"}
    chart = spark.createDataFrame([(k, None, k.upper(), p, "asset", "Bank", "active") for k, p in parents.items()], ACCOUNT)
    assert {r.account_id for r in hierarchy.cyclic_accounts(chart).collect()} == {"a", "b", "c", "below", "lower"}
    found = {(r.check, r.key) for r in hierarchy.hierarchy_violations(chart).collect()}
    assert found == {("hierarchy_cycle", k) for k in ("a", "b", "c", "below", "lower")} | {("self_parent", "own"), ("unknown_parent", "lost")}
    loose = {r.account_id: r.account_full_name for r in hierarchy.names(chart, validate=False).collect()}
    assert loose["leaf"] == "ROOT:LEAF" and loose["lower"] == "LOWER" and loose["lost"] == "LOST" and len(loose) == len(parents)


def test_empty_ledger(spark):
    empty = Ledger(accounts(spark), spark.createDataFrame([], POSTING))
    assert reports.trial_balance(empty, END).count() == 0 and amounts(statements.profit_and_loss(empty, 1, END))["net_income"] == 0


def test_sums_beyond_64_bits(spark):
    big = (1 << 62) + 5
    moves = [(500, "till", "bread", big), (500, "oven", "till", big), (501, "till", "bread", big), (501, "oven", "till", big)]
    over = Ledger(accounts(spark), spark.createDataFrame(entries(moves), POSTING))
    with pytest.raises(Exception, match="(?i)overflow|cannot be represented|CAST"):
        reports.trial_balance(over, END, validate=False).collect()
