"""Ledger report and reconciliation queries over the warehouse fixtures, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, labels, money
from ledgerloom.operators import hierarchy, reconcile, reports, statements
from ledgerloom.operators.ledger import Ledger, transaction_nets
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.fixtures import AS_OF, EARLIER, FISCAL_START, JUNE, JUNE_END, POLICY, SQL

CURRENT = f"current_state = 'Current' AND date <= {AS_OF}"
_REPORT = ("account_id", "account_name", "account_type", "net_cents", "debit_cents", "credit_cents")
_TB_SQL = "CASE WHEN net_cents > 0 THEN net_cents END AS debit_cents, CASE WHEN net_cents < 0 THEN -net_cents END AS credit_cents"
_ACCRUAL = f"CASE WHEN account_type IN ('income', 'expense', 'cost_of_goods_sold') AND date < {FISCAL_START} THEN 'RE' ELSE p.account_id END"
_NETS = f"{SQL}, nets AS (SELECT account_id, CAST(sum(amount) AS BIGINT) AS net_cents FROM postings WHERE {CURRENT} GROUP BY account_id)"
_ACCRUED = f"""{SQL}, nets AS (SELECT {_ACCRUAL} AS account_id, CAST(sum(amount) AS BIGINT) AS net_cents
  FROM postings p JOIN accounts a ON p.account_id = a.account_id WHERE {CURRENT} GROUP BY 1)"""


def gl_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.general_ledger(fx.ledger(spark, sf_dir), JUNE_END, JUNE)
    return rows.select("date", "account_id", "account_name", "transaction_id", "posting_id", "signed_minor_units", "transaction_type")


GL_AS_OF = f"""{SQL} SELECT date, p.account_id, account_name, transaction_id, posting_id, amount AS signed_minor_units, transaction_type
FROM postings p JOIN accounts a ON p.account_id = a.account_id WHERE current_state = 'Current' AND date BETWEEN {JUNE} AND {JUNE_END}"""


def tb_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.trial_balance(fx.ledger(spark, sf_dir), AS_OF).select(*_REPORT)


TB_PLAIN = f"""{_NETS} SELECT a.account_id, account_name, account_type, net_cents, {_TB_SQL}
FROM accounts a JOIN nets ON a.account_id = nets.account_id WHERE net_cents <> 0"""


def tb_accrual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the validated accrual Trial Balance."""
    return reports.trial_balance(fx.ledger(spark, sf_dir), AS_OF, POLICY).select(*_REPORT)


TB_ACCRUAL = f"""{_ACCRUED} SELECT a.account_id, account_name, account_type, net_cents, {_TB_SQL}
FROM accounts a JOIN nets ON a.account_id = nets.account_id WHERE net_cents <> 0"""


def tb_zero_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.trial_balance(fx.ledger(spark, sf_dir), AS_OF, zero_accounts=True).select(*_REPORT)


TB_ZERO_ACCOUNTS = f"""{_NETS}, t AS (SELECT a.*, coalesce(net_cents, 0) AS net_cents FROM accounts a LEFT JOIN nets ON a.account_id = nets.account_id)
SELECT account_id, account_name, account_type, net_cents, {_TB_SQL} FROM t"""


def tb_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.totals(reports.trial_balance(fx.ledger(spark, sf_dir), AS_OF, POLICY))
    return found.select(F.col("debit_cents").cast("bigint"), F.col("credit_cents").cast("bigint"))


TB_TOTALS = f"""{_ACCRUED} SELECT CAST(sum(CASE WHEN net_cents > 0 THEN net_cents ELSE 0 END) AS BIGINT) AS debit_cents,
  CAST(sum(CASE WHEN net_cents < 0 THEN -net_cents ELSE 0 END) AS BIGINT) AS credit_cents FROM nets"""

_STATEMENT = ("row_index", "row_kind", "section", "row_key", "label", "account_id", "net_cents", "amount_cents")


def pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.profit_and_loss(fx.ledger(spark, sf_dir), FISCAL_START, AS_OF).select(*_STATEMENT)


def balance_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.balance_sheet(fx.ledger(spark, sf_dir), AS_OF, POLICY).select(*_STATEMENT)


def _statement_sql(derived: tuple, nets: str) -> str:
    """nets: a WITH head that ends in nets(account_id, net_cents). One branch per kind of row, ordered by place."""
    sheet = derived is statements.BALANCE_SHEET
    places = {d[3]: i for i, d in enumerate(derived)}
    shown = {s: places[k] for s, k in statements.BEFORE.items() if k in places}
    section = "CASE WHEN classification = 'OtherIncome' THEN 'other_income' WHEN classification = 'OtherExpense' THEN 'other_expense' WHEN account_type = 'asset' THEN 'assets' WHEN account_type = 'liability' THEN 'liabilities' ELSE account_type END"
    pl = "account_type IN ('income', 'expense', 'cost_of_goods_sold')"
    section = f"CASE WHEN {pl} THEN 'current_income' ELSE {section} END" if sheet else section
    amount = "CASE WHEN account_type IN ('liability', 'equity', 'income') THEN -net ELSE net END"
    amount = f"CASE WHEN {pl} THEN -net ELSE {amount} END" if sheet else amount
    place = " ".join(f"WHEN '{s}' THEN {p}" for s, p in shown.items())
    lines = " UNION ALL ".join(
        f"SELECT {i}, 1, '{kind}', '{sec}', '{key}', '{label}', NULL, NULL, CAST(coalesce(sum(CASE section "
        + " ".join(f"WHEN '{s}' THEN {w} * amount" for s, w in parts.items()) + " ELSE 0 END), 0) AS BIGINT) FROM rows"
        for i, (parts, kind, sec, key, label) in enumerate(derived)
    )
    return f"""{nets}, base AS (SELECT a.*, coalesce(net_cents, 0) AS net FROM accounts a LEFT JOIN nets ON a.account_id = nets.account_id),
rows AS (SELECT *, {section} AS section, {amount} AS amount FROM base),
listed AS (
  SELECT CASE section {place} END AS place, 0 AS after, 'account' AS row_kind, section, 'account:' || account_id AS row_key, account_name AS label, account_id, net AS net_cents, amount AS amount_cents
  FROM rows WHERE section IN ({", ".join(f"'{s}'" for s in shown)}) AND net <> 0
  UNION ALL {lines})
SELECT CAST(row_number() OVER (ORDER BY place, after, account_id) - 1 AS INTEGER) AS row_index, row_kind, section, row_key, label, account_id, net_cents, amount_cents FROM listed"""


PNL = _statement_sql(statements.PROFIT_AND_LOSS, f"{SQL}, nets AS (SELECT account_id, CAST(sum(amount) AS BIGINT) AS net_cents FROM postings WHERE {CURRENT} AND date >= {FISCAL_START} GROUP BY account_id)")
BALANCE = _statement_sql(statements.BALANCE_SHEET, _ACCRUED)


def pnl_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income, expense and net income of every month: one grouped sum, not one statement a month."""
    book = fx.ledger(spark, sf_dir).validate(AS_OF)
    rows = book.with_accounts(book.current(AS_OF)).where(F.col("account_type").isin("income", "expense", "cost_of_goods_sold"))
    month = F.date_format(dates.date_of(F.col("date")), "yyyy-MM")
    part = lambda *kinds: money.wide_sum(F.when(F.col("account_type").isin(*kinds), F.col("signed_minor_units")).otherwise(0)).cast("bigint")
    found = rows.groupBy(month.alias("month")).agg((-part("income")).alias("income_cents"), part("expense", "cost_of_goods_sold").alias("expense_cents"))
    return found.withColumn("net_cents", F.col("income_cents") - F.col("expense_cents"))


PNL_BY_MONTH = f"""{SQL}, m AS (SELECT strftime(DATE '1600-02-29' + CAST(date AS INTEGER), '%Y-%m') AS month,
  CAST(-sum(CASE WHEN account_type = 'income' THEN amount ELSE 0 END) AS BIGINT) AS income_cents,
  CAST(sum(CASE WHEN account_type IN ('expense', 'cost_of_goods_sold') THEN amount ELSE 0 END) AS BIGINT) AS expense_cents
  FROM postings p JOIN accounts a ON p.account_id = a.account_id
  WHERE {CURRENT} AND account_type IN ('income', 'expense', 'cost_of_goods_sold') GROUP BY 1)
SELECT *, income_cents - expense_cents AS net_cents FROM m"""


def unbalanced_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.perturbed(spark, sf_dir).where("current_state = 'Current' and posting_id not like '%7-C'")
    return transaction_nets(rows)


UNBALANCED = f"""{SQL} SELECT transaction_id, CAST(sum(amount) AS BIGINT) AS net FROM perturbed
WHERE current_state = 'Current' AND posting_id NOT LIKE '%7-C' GROUP BY transaction_id HAVING sum(amount) <> 0"""


def ledger_gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gates find in a spoiled ledger: accounts missing from the chart, postings twice, legs lost."""
    chart = fx.accounts(spark, sf_dir).where("account_id <> 'AR-7'")
    rows = fx.perturbed(spark, sf_dir).where("posting_id not like '%11-C'").drop("entity_id")
    return Ledger(chart, rows).violations(AS_OF).select("check", "key")


GATES = f"""{SQL}, rows AS (SELECT * FROM perturbed WHERE posting_id NOT LIKE '%11-C')
SELECT DISTINCT 'unknown_account' AS check, posting_id AS key FROM rows WHERE account_id = 'AR-7'
UNION ALL SELECT 'duplicate_posting', posting_id FROM rows GROUP BY posting_id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_source_row', 'row:' || posting_id FROM rows GROUP BY posting_id HAVING count(*) > 1
UNION ALL SELECT 'unbalanced_transaction', transaction_id FROM rows WHERE {CURRENT} GROUP BY transaction_id HAVING sum(amount) <> 0"""


def account_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.names(fx.accounts(spark, sf_dir))


ACCOUNT_NAMES = f"""{SQL.replace("WITH accounts", "WITH RECURSIVE accounts", 1)}, walk AS (
  SELECT account_id, account_name AS full_name, account_number AS number, parent_account_id AS next FROM accounts
  UNION ALL SELECT w.account_id, a.account_name || ':' || w.full_name, coalesce(w.number, a.account_number), a.parent_account_id
  FROM walk w JOIN accounts a ON w.next = a.account_id)
SELECT account_id, full_name AS account_full_name, CASE WHEN number IS NULL THEN full_name ELSE number || ' · ' || full_name END AS account_display_name
FROM walk WHERE next IS NULL"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Per-account balances of the invoices and of their perturbed copy; two accounts lack on one side each."""
    def side(rows: DataFrame, without: str) -> DataFrame:
        rows = rows.where((F.col("current_state") == "Current") & (F.col("date") <= AS_OF) & (F.col("account_id") != without))
        return rows.groupBy(F.col("account_id").alias("label")).agg(money.wide_sum(F.col("signed_minor_units")).cast("bigint").alias("cents"))

    return side(fx.invoice_postings(spark, sf_dir), "AR-3"), side(fx.perturbed(spark, sf_dir), "AR-5")


_SIDES = f"""{SQL}, r AS (SELECT account_id AS label, CAST(sum(amount) AS BIGINT) AS cents FROM invoices WHERE {CURRENT} AND account_id <> 'AR-3' GROUP BY 1),
a AS (SELECT account_id AS label, CAST(sum(amount) AS BIGINT) AS cents FROM perturbed WHERE {CURRENT} AND account_id <> 'AR-5' GROUP BY 1),
c AS (SELECT coalesce(r.label, a.label) AS label, CASE WHEN a.cents IS NULL THEN 'missing' WHEN r.cents IS NULL THEN 'extra' WHEN a.cents <> r.cents THEN 'mismatch' ELSE 'match' END AS outcome,
  r.cents AS reference_cents, a.cents AS actual_cents, coalesce(a.cents, 0) - coalesce(r.cents, 0) AS variance_cents FROM r FULL JOIN a ON r.label = a.label)"""


def tb_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.trial_balances(*_sides(spark, sf_dir))


def tb_reconcile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.totals(reconcile.trial_balances(*_sides(spark, sf_dir)))


TB_RECONCILE_TOTALS = f"""{_SIDES} SELECT count(*) FILTER (outcome = 'match') AS n_match, count(*) FILTER (outcome = 'missing') AS n_missing,
count(*) FILTER (outcome = 'extra') AS n_extra, count(*) FILTER (outcome = 'mismatch') AS n_mismatch, CAST(coalesce(sum(reference_cents), 0) AS BIGINT) AS reference_cents,
CAST(coalesce(sum(actual_cents), 0) AS BIGINT) AS actual_cents, CAST(coalesce(sum(variance_cents), 0) AS BIGINT) AS variance_cents, coalesce(max(abs(variance_cents)), 0) AS max_abs_variance FROM c"""


def tb_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.diagnostics(reconcile.trial_balances(*_sides(spark, sf_dir)))


TB_DIAGNOSTICS = f"""{_SIDES} SELECT CASE outcome WHEN 'missing' THEN 0 WHEN 'extra' THEN 1 ELSE 2 END AS class, label,
outcome || ' ' || label || ' variance=' || variance_cents AS line FROM c WHERE outcome <> 'match'"""

_KEYS = ["account_id", "date", "signed_minor_units", "transaction_type"]


def gl_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = reconcile.multiset_match(fx.invoice_postings(spark, sf_dir), fx.perturbed(spark, sf_dir), _KEYS)
    return matched.where("missing > 0 or extra > 0")


_COUNTED = f"""{SQL}, c AS (SELECT {{keys}}, count(*) FILTER (side = 0) AS reference_n, count(*) FILTER (side = 1) AS actual_n FROM (
  SELECT account_id, date, amount AS signed_minor_units, transaction_type, 0 AS side FROM invoices
  UNION ALL SELECT account_id, date, amount, transaction_type, 1 FROM perturbed) GROUP BY {{keys}}),
m AS (SELECT *, least(reference_n, actual_n) AS matched, greatest(reference_n - actual_n, 0) AS missing, greatest(actual_n - reference_n, 0) AS extra FROM c)"""
GL_MULTISET = _COUNTED.format(keys=", ".join(_KEYS)) + " SELECT * FROM m WHERE missing > 0 OR extra > 0"


def gl_multiset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.multiset_totals(reconcile.multiset_match(fx.invoice_postings(spark, sf_dir), fx.perturbed(spark, sf_dir), _KEYS))


_SUMS = " SELECT CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(extra) AS BIGINT) AS extra FROM m"


def gl_date_amount_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.multiset_totals(reconcile.multiset_match(fx.invoice_postings(spark, sf_dir), fx.perturbed(spark, sf_dir), ["date", "signed_minor_units"]))


def gl_account_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.distinct_overlap(fx.invoice_postings(spark, sf_dir).where("account_id <> 'AR-3'"), fx.perturbed(spark, sf_dir).where("account_id <> 'AR-5'"), "account_id")


GL_ACCOUNT_OVERLAP = f"""{SQL}, l AS (SELECT DISTINCT account_id FROM invoices WHERE account_id <> 'AR-3'), r AS (SELECT DISTINCT account_id FROM perturbed WHERE account_id <> 'AR-5')
SELECT (SELECT count(*) FROM l SEMI JOIN r USING (account_id)) AS shared, (SELECT count(*) FROM l ANTI JOIN r USING (account_id)) AS left_only, (SELECT count(*) FROM r ANTI JOIN l USING (account_id)) AS right_only"""


def gl_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset difference both ways with the built-in operators."""
    pick = lambda rows: rows.select("account_id", "date", "signed_minor_units")
    a, b = pick(fx.invoice_postings(spark, sf_dir)), pick(fx.perturbed(spark, sf_dir))
    return a.exceptAll(b).withColumn("side", F.lit("missing")).union(b.exceptAll(a).withColumn("side", F.lit("extra")))


_PICK = "SELECT account_id, date, amount AS signed_minor_units FROM "
GL_EXCEPT_ALL = f"""{SQL} SELECT *, 'missing' AS side FROM ({_PICK} invoices EXCEPT ALL {_PICK} perturbed) UNION ALL SELECT *, 'extra' FROM ({_PICK} perturbed EXCEPT ALL {_PICK} invoices)"""


def gl_label_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    chart = fx.accounts(spark, sf_dir).join(hierarchy.names(fx.accounts(spark, sf_dir)), "account_id")
    base = fx.table(spark, sf_dir, "nation")
    forms = F.array(
        F.concat(F.lit("Accounts Receivable:"), "n_name"), F.concat(F.lit("1200 · Accounts Receivable:"), "n_name"), F.concat(F.lit("77 · "), "n_name"),
        F.concat(F.lit("Old:"), "n_name"), F.concat("n_name", F.lit(" - Other")), F.concat(F.lit("Nowhere "), "n_nationkey"),
    )
    return reconcile.resolve_labels(base.select(F.explode(forms).alias("label")), chart)


GL_LABEL_RESOLUTION = """WITH f AS (SELECT n_name, n_nationkey, unnest([0, 1, 2, 3, 4, 5]) AS i FROM nation)
SELECT CASE i WHEN 0 THEN 'Accounts Receivable:' || n_name WHEN 1 THEN '1200 · Accounts Receivable:' || n_name WHEN 2 THEN '77 · ' || n_name
 WHEN 3 THEN 'Old:' || n_name WHEN 4 THEN n_name || ' - Other' ELSE 'Nowhere ' || n_nationkey END AS label,
 CASE WHEN i < 5 THEN 'AR-' || n_nationkey END AS account_id,
 CASE i WHEN 0 THEN 'full_name' WHEN 1 THEN 'display_name' WHEN 2 THEN 'account_name' WHEN 3 THEN 'leaf_name' WHEN 4 THEN 'other_suffix' ELSE 'unresolved' END AS resolved_by FROM f"""


def tb_gl_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = fx.ledger(spark, sf_dir)
    trial = reports.trial_balance(book, AS_OF, validate=False)
    return reconcile.report_agreement(trial, book.current(AS_OF).where("transaction_type = 'Invoice'"))


TB_GL_AGREEMENT = f"""{_NETS}, gl AS (SELECT account_id, CAST(sum(amount) AS BIGINT) AS gl_cents FROM postings WHERE {CURRENT} AND transaction_type = 'Invoice' GROUP BY 1)
SELECT coalesce(nets.account_id, gl.account_id) AS account_id, coalesce(net_cents, 0) AS tb_cents, coalesce(gl_cents, 0) AS gl_cents
FROM nets FULL JOIN gl ON nets.account_id = gl.account_id WHERE coalesce(net_cents, 0) <> coalesce(gl_cents, 0)"""


def batch_tb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Trial Balance per entity: the same plan with the entity as a further key."""
    rows = fx.ledger(spark, sf_dir).validate(AS_OF).current(AS_OF)
    net = rows.groupBy("entity_id", "account_id").agg(money.wide_sum(F.col("signed_minor_units")).cast("bigint").alias("net_cents")).where("net_cents <> 0")
    return net.withColumns({"debit_cents": money.debit(F.col("net_cents")), "credit_cents": money.credit(F.col("net_cents"))})


BATCH_TB = f"""{SQL}, n AS (SELECT entity_id, account_id, CAST(sum(amount) AS BIGINT) AS net_cents FROM postings WHERE {CURRENT} GROUP BY 1, 2)
SELECT *, {_TB_SQL} FROM n WHERE net_cents <> 0"""


def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals written in the ways that reports write money, read back."""
    cents = money.from_double(F.col("o_totalprice"))
    text = money.format_cents(cents)
    grouped = F.regexp_replace(text, r"(\d)(?=(\d{3})+\.)", "$1,")
    form = F.expr("cast(o_orderkey % 6 as int)")
    forms = F.array(text, F.concat(F.lit("$"), grouped), F.concat(F.lit("("), grouped, F.lit(")")), F.concat(F.lit(" -$"), grouped), F.lit(" - "), F.concat(text, F.lit("7")))
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(forms, form + 1).alias("written"))
    return rows.select("o_orderkey", "written", money.parse_money(F.col("written")).alias("cents"), money.format_cents(money.parse_money(F.col("written"))).alias("again"))


MONEY_PARSE = """WITH c AS (SELECT o_orderkey, o_orderkey % 6 AS form, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
t AS (SELECT *, (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS plain, format('{:,}', cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS grouped FROM c)
SELECT o_orderkey, CASE form WHEN 0 THEN plain WHEN 1 THEN '$' || grouped WHEN 2 THEN '(' || grouped || ')' WHEN 3 THEN ' -$' || grouped WHEN 4 THEN ' - ' ELSE plain || '7' END AS written,
 CASE form WHEN 0 THEN cents WHEN 1 THEN cents WHEN 2 THEN -cents WHEN 3 THEN -cents WHEN 4 THEN 0 END AS cents,
 CASE form WHEN 0 THEN plain WHEN 1 THEN plain WHEN 2 THEN '-' || plain WHEN 3 THEN '-' || plain WHEN 4 THEN '0.00' END AS again FROM t"""


def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written m/d/yy or m/d/yyyy, resolved inside the years 1995 to 2001."""
    d = F.col("o_orderdate").cast("date")
    short = F.concat_ws("/", F.month(d), F.dayofmonth(d), F.date_format(d, "yy"))
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, short).otherwise(F.date_format(d, "M/d/yyyy")).alias("written"))
    day = dates.parse_desktop(F.col("written"), F.lit(144212), F.lit(146768))
    return rows.select("o_orderkey", "written", day.alias("day"), F.date_format(dates.date_of(day), "yyyy-MM-dd").alias("iso"))


DATE_PARSE = """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), w AS (SELECT *, month(d) || '/' || day(d) || '/' || CASE WHEN o_orderkey % 2 = 0 THEN strftime(d, '%y') ELSE CAST(year(d) AS VARCHAR) END AS written,
 CASE WHEN o_orderkey % 2 = 0 AND month(d) = 2 AND day(d) = 29 AND year(d) = 2000 THEN NULL ELSE d END AS e FROM d)
SELECT o_orderkey, written, CASE WHEN date_diff('day', DATE '1600-02-29', e) BETWEEN 144212 AND 146768 THEN date_diff('day', DATE '1600-02-29', e) END AS day,
 CASE WHEN date_diff('day', DATE '1600-02-29', e) BETWEEN 144212 AND 146768 THEN strftime(e, '%Y-%m-%d') END AS iso FROM w"""


def label_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit(" "), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, " · ").otherwise("· "), "p_name", F.lit(":"), "p_brand")
    rows = fx.table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))
    return rows.select("p_partkey", labels.without_number(F.col("label")).alias("bare"), labels.has_number(F.col("label")).alias("numbered"), labels.leaf(F.col("label")).alias("leaf"))


LABEL_CANONICAL = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ':' || p_brand ELSE p_partkey || '· ' || p_name || ':' || p_brand END AS bare, p_partkey % 3 = 0 AS numbered, p_brand AS leaf FROM part"""


def type_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("Journal", " General   Journal", "Vendor Credit", "Bill Pmt -Check", "Bill Payment Check", "Invoice", "Deposit")))
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(kinds, F.expr("cast(o_orderkey % 7 as int) + 1")).alias("kind"))
    return rows.select("o_orderkey", labels.compared_type(F.col("kind")).alias("compared"), labels.payables_type(F.col("kind")).alias("payables"))


TYPE_NORMALIZE = """SELECT o_orderkey, ['general journal', 'general journal', 'credit', 'bill pmt-check', 'bill pmt-check', 'invoice', 'deposit'][o_orderkey % 7 + 1] AS compared,
 [NULL, 'general-journal', 'credit', 'bill-pmt-check', 'bill-pmt-check', NULL, 'deposit'][o_orderkey % 7 + 1] AS payables FROM orders"""


def day_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    catalog = dates.unix_to_catalog_day(F.unix_date(d))
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", catalog.alias("catalog_day"), dates.catalog_to_unix_day(catalog).alias("unix_day"), dates.iso_of_unix_day(dates.line_item_unix_day(catalog)).alias("iso"),
        dates.minutes_of(d).alias("minutes"), F.date_format(dates.date_of_minutes(dates.minutes_of(d)), "yyyy-MM-dd").alias("iso_of_minutes"),
    )


DAY_ROUNDTRIP = """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, date_diff('day', DATE '1970-01-01', d) + 4017 AS catalog_day, date_diff('day', DATE '1970-01-01', d) AS unix_day, strftime(d, '%Y-%m-%d') AS iso,
 date_diff('day', DATE '1600-02-29', d) * 1440 AS minutes, strftime(d, '%Y-%m-%d') AS iso_of_minutes FROM d"""

QUERIES = {
    "tb_accrual": (tb_accrual, TB_ACCRUAL), "tb_plain": (tb_plain, TB_PLAIN), "tb_zero_accounts": (tb_zero_accounts, TB_ZERO_ACCOUNTS), "tb_totals": (tb_totals, TB_TOTALS),
    "gl_as_of": (gl_as_of, GL_AS_OF), "pnl": (pnl, PNL), "pnl_by_month": (pnl_by_month, PNL_BY_MONTH), "balance_sheet": (balance_sheet, BALANCE),
    "unbalanced_transactions": (unbalanced_transactions, UNBALANCED), "ledger_gate_violations": (ledger_gate_violations, GATES), "account_names": (account_names, ACCOUNT_NAMES),
    "tb_reconcile": (tb_reconcile, f"{_SIDES} SELECT * FROM c"), "tb_reconcile_totals": (tb_reconcile_totals, TB_RECONCILE_TOTALS), "tb_diagnostics": (tb_diagnostics, TB_DIAGNOSTICS),
    "gl_multiset": (gl_multiset, GL_MULTISET), "gl_multiset_totals": (gl_multiset_totals, _COUNTED.format(keys=", ".join(_KEYS)) + _SUMS),
    "gl_date_amount_overlap": (gl_date_amount_overlap, _COUNTED.format(keys="date, signed_minor_units") + _SUMS), "gl_account_overlap": (gl_account_overlap, GL_ACCOUNT_OVERLAP),
    "gl_except_all": (gl_except_all, GL_EXCEPT_ALL), "gl_label_resolution": (gl_label_resolution, GL_LABEL_RESOLUTION), "tb_gl_agreement": (tb_gl_agreement, TB_GL_AGREEMENT),
    "batch_tb": (batch_tb, BATCH_TB), "money_parse": (money_parse, MONEY_PARSE), "date_parse": (date_parse, DATE_PARSE), "label_canonical": (label_canonical, LABEL_CANONICAL),
    "type_normalize": (type_normalize, TYPE_NORMALIZE), "day_roundtrip": (day_roundtrip, DAY_ROUNDTRIP),
}
