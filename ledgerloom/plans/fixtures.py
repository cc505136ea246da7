"""Ledgers, catalogs and byte pages derived from the warehouse tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.dates import accounting_day
from ledgerloom.functions.money import from_double
from ledgerloom.operators.ledger import Ledger
from ledgerloom.operators.reports import AccrualPolicy

#: 2000-12-31 and 2000-01-01 as accounting days, 1999-01-01 and the month of June 2000.
AS_OF, FISCAL_START, EARLIER, JUNE, JUNE_END = 146403, 146038, 145673, 146190, 146219
POLICY = AccrualPolicy(FISCAL_START, "RE")
ROOTS = (
    ("AR", "1200", "Accounts Receivable", None, "asset", "AccountsReceivable"),
    ("INC", "4000", "Income", None, "income", "Income"),
    ("COGS", "5000", "Cost of Goods", None, "cost_of_goods_sold", "CostOfGoodsSold"),
    ("EXP", "6000", "Tax Expense", None, "expense", "Expense"),
    ("TAX", "2200", "Tax Payable", None, "liability", "OtherCurrentLiability"),
    ("RE", "3900", "Retained Earnings", None, "equity", "Equity"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "account_id string, account_number string, account_name string, parent_account_id string, account_type string, classification string"
    roots = spark.createDataFrame(list(ROOTS), schema)
    none = F.lit(None).cast("string")
    nations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("AR-"), "n_nationkey"), none, "n_name", F.lit("AR"), F.lit("asset"), F.lit("AccountsReceivable")
    )
    kinds = table(spark, sf_dir, "orders").select("o_orderpriority").distinct().select(
        F.concat(F.lit("INC-"), F.substring_index("o_orderpriority", "-", 1)), none, "o_orderpriority", F.lit("INC"), F.lit("income"), F.lit("Income")
    )
    return roots.union(nations).union(kinds).withColumn("activity", F.lit("active"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", accounting_day(F.col("o_orderdate")).alias("date"), F.when(F.col("o_orderstatus") == "P", "Superseded").otherwise("Current").alias("current_state"),
        from_double(F.col("o_totalprice")).alias("cents"), F.concat(F.lit("AR-"), "c_nationkey").alias("receivable"),
        F.concat(F.lit("INC-"), F.substring_index("o_orderpriority", "-", 1)).alias("income"), F.col("c_mktsegment").alias("entity_id"),
    )


def _taxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax per order, summed before it meets the orders."""
    cents = F.expr("cast(round(l_extendedprice * 100) as bigint) * cast(round(l_tax * 100) as bigint) div 100")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(cents).alias("tax")).where("tax > 0")


def _legs(rows: DataFrame, prefix: str, kind: str, debit: str, credit: str, cents: str) -> DataFrame:
    """Two postings per row, by one explode instead of two scans."""
    leg = lambda side, account, amount: F.struct(F.lit(side).alias("side"), account.alias("account_id"), amount.alias("signed_minor_units"))
    txn = F.concat(F.lit(prefix), F.col("o_orderkey"))
    each = rows.withColumn("leg", F.explode(F.array(leg("D", F.col(debit), F.col(cents)), leg("C", F.col(credit), -F.col(cents)))))
    posting = F.concat(txn, F.lit("-"), F.col("leg.side"))
    return each.select(
        txn.alias("transaction_id"), posting.alias("posting_id"), "leg.account_id", "date", "leg.signed_minor_units", "current_state",
        F.concat(F.lit("row:"), posting).alias("source_row"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("int").alias("slot_number"),
        F.lit("warehouse").alias("decoder"), F.lit(kind).alias("transaction_type"), F.lit(None).cast("string").alias("memo"), "entity_id",
    )


def invoice_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legs(_orders(spark, sf_dir), "O", "Invoice", "receivable", "income", "cents")


def tax_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).join(_taxes(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.withColumns({"expense": F.lit("EXP"), "payable": F.lit("TAX")})
    return _legs(rows, "T", "Tax", "expense", "payable", "tax")


def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    return Ledger(accounts(spark, sf_dir).cache(), invoice_postings(spark, sf_dir).unionByName(tax_postings(spark, sf_dir)))


def perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice postings with orders dropped (key % 97 = 0), a cent added (% 101) or posted twice (% 103)."""
    rows = _orders(spark, sf_dir).where("o_orderkey % 97 <> 0").withColumn("cents", F.col("cents") + (F.col("o_orderkey") % 101 == 0).cast("bigint"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("o_orderkey") % 103 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return _legs(rows, "O", "Invoice", "receivable", "income", "cents")


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a catalog entry; those whose key 97 divides have a root page, some a last page, and many share a name or an object id."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("nth"))
    n = F.col("nth")
    return rows.select(
        "nth", n.alias("table_id"), F.expr("nth div 2").alias("object_id"), F.concat(F.lit("t"), F.expr("nth div 3")).alias("name"),
        F.when(n % 97 == 0, n).otherwise(F.lit(0)).alias("data_root_page"), F.when(n % 2 == 0, n + 40).when(n % 5 == 0, n - 1).alias("last_page"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_number"))


#: The warehouse's own schema as a catalog: (table, columns as name:width:nulls).
SCHEMA = (
    ("region", "r_regionkey:4:0 r_name:25:0"),
    ("nation", "n_nationkey:4:0 n_name:25:0 n_regionkey:4:0 region_id:4:1"),
    ("customer", "c_custkey:8:0 c_name:25:0 c_nationkey:4:0 c_acctbal:8:1 c_mktsegment:10:1 nation_id_h:4:1"),
    ("supplier", "s_suppkey:8:0 s_name:25:0 nation_id:4:1"),
    ("part", "p_partkey:8:0 p_name:55:0 p_brand:10:1 supplier_id:8:1"),
    ("abmc_orders", "o_orderkey:8:0 customer_id:8:1 o_orderdate:8:0 orders_id:8:1"),
    ("lineitem", "l_orderkey:8:0 part_id:8:1 orders_id:8:1 item_id:8:1 line_id:8:1 missing_id:8:1"),
    ("v_orders_part", "o_id:8:1 part_id_h:8:1"),
)


def schema_catalog(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    tables = [(i, i, name, len(cols.split())) for i, (name, cols) in enumerate(SCHEMA)]
    columns = [(i, j + 1, *_column(c), 100 * i + j) for i, (_, cols) in enumerate(SCHEMA) for j, c in enumerate(cols.split())]
    return (
        spark.createDataFrame(tables, "nth int, table_id int, name string, col_count int"),
        spark.createDataFrame(columns, "table_id int, column_id int, name string, width int, nulls int, nth int"),
    )


def _column(text: str) -> tuple[str, int, int]:
    name, width, nulls = text.split(":")
    return name, int(width), int(nulls)


#: Columns of a line item that make it physically ordered; equal ones are interchangeable.
_ALL = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.selectExpr(
        "concat('O', l_orderkey) AS invoice_id", "l_orderkey AS page_number",
        f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ALL}) AS page_offset",
        "concat('P', l_partkey) AS item_id", "CASE l_returnflag WHEN 'N' THEN 2 WHEN 'A' THEN 1 ELSE 3 END AS amount_type",
        "CASE WHEN l_linenumber % 7 <> 0 THEN cast(round(l_extendedprice * 100) AS bigint) END AS amount_cents",
        "CASE WHEN l_linenumber % 7 <> 0 THEN CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END * cast(round(l_extendedprice * 100) AS bigint) END AS amount_cents_signed",
        "CASE WHEN l_linenumber % 3 <> 0 THEN datediff(l_shipdate, DATE'1970-01-01') + 4017 END AS txn_date_raw",
        "CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS counter", "concat('abmc_', lower(l_returnflag), '_line') AS source_table",
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").selectExpr(
        "concat('O', o_orderkey) AS qb_id", "concat('abmc_', lower(o_orderstatus), '_header') AS source_table",
        "datediff(o_orderdate, DATE'1970-01-01') + 4017 AS txn_date_raw", "cast(o_orderkey % 100 AS int) AS counter",
        "o_orderkey AS page_number", "1 AS page_offset",
    )


_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in ROOTS)
#: The fixtures in SQL, as the head of a WITH clause.
SQL = f"""
WITH accounts AS (
  SELECT * FROM (VALUES {_VALUES}) t(account_id, account_number, account_name, parent_account_id, account_type, classification)
  UNION ALL SELECT 'AR-' || n_nationkey, NULL, n_name, 'AR', 'asset', 'AccountsReceivable' FROM nation
  UNION ALL SELECT DISTINCT 'INC-' || split_part(o_orderpriority, '-', 1), NULL, o_orderpriority, 'INC', 'income', 'Income' FROM orders
), o AS (
  SELECT o_orderkey, date_diff('day', DATE '1600-02-29', CAST(o_orderdate AS DATE)) AS date,
         CASE WHEN o_orderstatus = 'P' THEN 'Superseded' ELSE 'Current' END AS current_state,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents, 'AR-' || c_nationkey AS receivable,
         'INC-' || split_part(o_orderpriority, '-', 1) AS income, c_mktsegment AS entity_id
  FROM orders JOIN customer ON o_custkey = c_custkey
), taxes AS (
  SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) // 100) AS BIGINT) AS tax
  FROM lineitem GROUP BY l_orderkey HAVING tax > 0
), invoices AS (
  SELECT 'O' || o_orderkey AS transaction_id, 'O' || o_orderkey || '-D' AS posting_id, receivable AS account_id, date, cents AS amount, current_state, entity_id, 'Invoice' AS transaction_type FROM o
  UNION ALL SELECT 'O' || o_orderkey, 'O' || o_orderkey || '-C', income, date, -cents, current_state, entity_id, 'Invoice' FROM o
), postings AS (
  SELECT * FROM invoices
  UNION ALL SELECT 'T' || o_orderkey, 'T' || o_orderkey || '-D', 'EXP', date, tax, current_state, entity_id, 'Tax' FROM o JOIN taxes ON o_orderkey = l_orderkey
  UNION ALL SELECT 'T' || o_orderkey, 'T' || o_orderkey || '-C', 'TAX', date, -tax, current_state, entity_id, 'Tax' FROM o JOIN taxes ON o_orderkey = l_orderkey
), po AS (
  SELECT o_orderkey, date, current_state, entity_id, receivable, income, cents + CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE 0 END AS cents
  FROM o, (VALUES (0), (1)) c(copy) WHERE o_orderkey % 97 <> 0 AND (copy = 0 OR o_orderkey % 103 = 0)
), perturbed AS (
  SELECT 'O' || o_orderkey AS transaction_id, 'O' || o_orderkey || '-D' AS posting_id, receivable AS account_id, date, cents AS amount, current_state, 'Invoice' AS transaction_type FROM po
  UNION ALL SELECT 'O' || o_orderkey, 'O' || o_orderkey || '-C', income, date, -cents, current_state, 'Invoice' FROM po
)"""
#: Line items and headers in SQL.
LINES = f"""
WITH items AS (
  SELECT 'O' || l_orderkey AS invoice_id, l_orderkey AS page_number, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ALL}) AS page_offset,
    'P' || l_partkey AS item_id, CASE l_returnflag WHEN 'N' THEN 2 WHEN 'A' THEN 1 ELSE 3 END AS amount_type,
    CASE WHEN l_linenumber % 7 <> 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS amount_cents,
    CASE WHEN l_linenumber % 7 <> 0 THEN CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT) END AS amount_cents_signed,
    CASE WHEN l_linenumber % 3 <> 0 THEN date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + 4017 END AS txn_date_raw,
    CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS counter, 'abmc_' || lower(l_returnflag) || '_line' AS source_table
  FROM lineitem
), headers AS (
  SELECT 'O' || o_orderkey AS qb_id, 'abmc_' || lower(o_orderstatus) || '_header' AS source_table,
    date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 4017 AS txn_date_raw, CAST(o_orderkey % 100 AS INTEGER) AS counter, o_orderkey AS page_number
  FROM orders WHERE o_orderkey % 5 <> 0
)"""
