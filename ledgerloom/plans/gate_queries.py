"""Queries over output gates, decoder contracts, candidate agreement and row families, each with its SQL oracle.

Rows that break a rule are made from whole tables by arithmetic on their keys, alike in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import labels, money
from ledgerloom.operators import candidates, contract, families, outputs, reconcile, rows
from ledgerloom.operators.ledger import Ledger
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.fixtures import AS_OF, SQL
from ledgerloom.plans.ledger_queries import _SIDES, _sides


def _orders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").selectExpr(*columns)


def _lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return fx.table(spark, sf_dir, "lineitem").selectExpr(*columns)


def gl_output_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spoiled General Ledger: postings twice, cents added, and entries under another account."""
    report = fx.perturbed(spark, sf_dir).withColumn("entry_account_id", F.expr("CASE WHEN posting_id LIKE '%13-C' THEN 'AR' ELSE account_id END"))
    cents = F.expr("CASE WHEN posting_id LIKE '%17-D' THEN 0 ELSE signed_minor_units END")
    return outputs.general_ledger_violations(report.withColumn("signed_minor_units", cents), AS_OF)


GL_OUTPUT = f"""{SQL}, r AS (SELECT *, CASE WHEN posting_id LIKE '%17-D' THEN 0 ELSE amount END AS cents FROM perturbed)
SELECT 'duplicate_posting' AS check, posting_id AS key FROM r GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'duplicate_source_row', 'row:' || posting_id FROM r GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'account_mismatch', posting_id FROM r WHERE posting_id LIKE '%13-C' AND account_id <> 'AR'
UNION ALL SELECT DISTINCT 'non_current', posting_id FROM r WHERE current_state <> 'Current' UNION ALL SELECT DISTINCT 'zero_amount', posting_id FROM r WHERE cents = 0
UNION ALL SELECT DISTINCT 'after_as_of', posting_id FROM r WHERE date > {AS_OF}
UNION ALL SELECT 'unbalanced_transaction', transaction_id FROM r GROUP BY 2 HAVING sum(cents) <> 0"""


def tb_output_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spoiled Trial Balance: one account twice, one shown on the wrong side."""
    net = fx.invoice_postings(spark, sf_dir).groupBy("account_id").agg(money.wide_sum(F.col("signed_minor_units")).cast("bigint").alias("net_cents"))
    wrong = F.col("account_id") == "AR-5"
    report = net.withColumns({"debit_cents": F.when((F.col("net_cents") > 0) & ~wrong, F.col("net_cents")), "credit_cents": F.when((F.col("net_cents") < 0) | wrong, F.abs("net_cents"))})
    return outputs.trial_balance_violations(report.union(report.where("account_id = 'AR-7'")))


TB_OUTPUT = f"""{SQL}, n AS (SELECT account_id, CAST(sum(amount) AS BIGINT) AS net FROM invoices GROUP BY 1), r AS (SELECT * FROM n UNION ALL SELECT * FROM n WHERE account_id = 'AR-7'),
s AS (SELECT *, CASE WHEN net > 0 AND account_id <> 'AR-5' THEN net END AS d, CASE WHEN net < 0 OR account_id = 'AR-5' THEN abs(net) END AS c FROM r),
t AS (SELECT CAST(coalesce(sum(d), 0) AS BIGINT) AS d, CAST(coalesce(sum(c), 0) AS BIGINT) AS c FROM s)
SELECT 'duplicate_account' AS check, account_id AS key FROM r GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'inconsistent_row', account_id FROM s WHERE account_id = 'AR-5' AND net > 0 UNION ALL SELECT 'unbalanced', d || ' ' || c FROM t WHERE d <> c"""


def zero_activity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-monetary rows beside the invoices: some take a posting's id or source row, some an unknown account, some are ambiguous."""
    postings = fx.invoice_postings(spark, sf_dir).drop("entity_id")
    quiet = _orders(
        spark, sf_dir, "concat('Z', o_orderkey) AS transaction_id", "CASE WHEN o_orderkey % 11 = 0 THEN concat('O', o_orderkey, '-D') ELSE concat('Z', o_orderkey) END AS posting_id",
        "CASE WHEN o_orderkey % 13 = 0 THEN 'nowhere' ELSE 'AR' END AS account_id", f"CASE WHEN o_orderkey % 3 = 0 THEN {AS_OF} + 1 ELSE {AS_OF} END AS date",
        "CASE WHEN o_orderkey % 17 = 0 THEN 'Ambiguous' WHEN o_orderkey % 19 = 0 THEN 'Deleted' ELSE 'Current' END AS current_state",
        "CASE WHEN o_orderkey % 23 = 0 THEN concat('row:O', o_orderkey, '-C') ELSE concat('z', o_orderkey) END AS source_row",
    )
    return Ledger(fx.accounts(spark, sf_dir), postings, quiet).violations(AS_OF, zero_activity=True).select("check", "key")


ZERO_ACTIVITY = f"""{SQL}, z AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'O' || o_orderkey || '-D' ELSE 'Z' || o_orderkey END AS id FROM orders
  WHERE o_orderkey % 3 <> 0 AND (o_orderkey % 17 = 0 OR o_orderkey % 19 <> 0))
SELECT 'duplicate_posting' AS check, id AS key FROM z WHERE k % 11 = 0 UNION ALL SELECT 'duplicate_source_row', 'row:O' || k || '-C' FROM z WHERE k % 23 = 0
UNION ALL SELECT 'unknown_account', id FROM z WHERE k % 13 = 0 UNION ALL SELECT 'ambiguous_state', id FROM z WHERE k % 17 = 0"""


def account_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chart = fx.accounts(spark, sf_dir)
    return outputs.account_conflicts(chart, chart.withColumn("account_name", F.expr("CASE WHEN account_id LIKE 'AR-1%' THEN upper(concat(account_name, '!')) ELSE account_name END")))


CONFLICTS = f"{SQL} SELECT account_id FROM accounts WHERE account_id LIKE 'AR-1%'"


def report_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One native Trial Balance for each entity of the perturbed invoices, against a chart of 31 accounts."""
    rows = fx.perturbed(spark, sf_dir).groupBy(F.col("entity_id").alias("report"), "account_id").agg(money.wide_sum(F.col("signed_minor_units")).cast("bigint").alias("cents"))
    lost = rows.where("not (report = 'BUILDING' and account_id = 'AR-3')")
    return outputs.report_audit(lost, 29)


REPORT_AUDIT = f"""{SQL}, b AS (SELECT entity_id AS report, receivable AS a, CAST(sum(cents) AS BIGINT) AS cents FROM po GROUP BY 1, 2 UNION ALL SELECT entity_id, income, CAST(-sum(cents) AS BIGINT) FROM po GROUP BY 1, 2),
s AS (SELECT report, count(*) AS rows, CAST(sum(CASE WHEN cents > 0 THEN cents ELSE 0 END) AS BIGINT) AS debit_cents, CAST(sum(CASE WHEN cents < 0 THEN -cents ELSE 0 END) AS BIGINT) AS credit_cents FROM b WHERE NOT (report = 'BUILDING' AND a = 'AR-3') GROUP BY 1)
SELECT *, CASE WHEN debit_cents <> credit_cents THEN 'unbalanced' WHEN rows > 29 THEN 'exceeds_accounts' ELSE 'ok' END AS outcome FROM s"""


def tb_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.verdict(reconcile.trial_balances(*_sides(spark, sf_dir)))


TB_VERDICT = f"""{_SIDES}, t AS (SELECT count(*) FILTER (outcome = 'missing') AS m, count(*) FILTER (outcome = 'extra') AS e, count(*) FILTER (outcome = 'mismatch') AS x,
 CAST(sum(greatest(coalesce(reference_cents, 0), 0)) AS BIGINT) AS rd, CAST(sum(greatest(-coalesce(reference_cents, 0), 0)) AS BIGINT) AS rc, CAST(sum(greatest(coalesce(actual_cents, 0), 0)) AS BIGINT) AS ad,
 CAST(sum(greatest(-coalesce(actual_cents, 0), 0)) AS BIGINT) AS ac, CAST(sum(variance_cents) AS BIGINT) AS nv, max(abs(variance_cents)) AS mv FROM c)
SELECT CASE WHEN m + e + x = 0 AND rd = rc AND ad = ac THEN 'PASS: all accounts and totals reconcile exactly to $0.00' ELSE 'FAIL: missing=' || m || ' extra=' || e || ' mismatched=' || x || ' reference_balanced=' || (rd = rc) ||
 ' actual_balanced=' || (ad = ac) || ' debit_variance_cents=' || (ad - rd) || ' credit_variance_cents=' || (ac - rc) || ' net_variance_cents=' || nv || ' max_account_variance_cents=' || mv END AS line FROM t"""


def coverage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decoded rows of seven tables: one table is registered twice, one handles less, one attests less than came."""
    rows = _orders(spark, sf_dir, "o_custkey % 7 AS table_id", "concat('r', o_orderkey) AS source_row")
    rows = rows.union(rows.where("source_row like '%500'"))
    n = rows.groupBy("table_id").agg(F.count("*").alias("recognized"))
    cover = n.select("table_id", "recognized", F.expr("recognized - CASE table_id WHEN 3 THEN 1 ELSE 0 END").alias("handled"))
    cover = cover.union(n.where("table_id = 5").selectExpr("table_id", "0", "0"))
    return contract.coverage_violations(cover, rows)


COVERAGE = """WITH o AS (SELECT o_custkey % 7 AS t, 'r' || o_orderkey AS s FROM orders)
SELECT 'duplicate_table' AS check, '5' AS key WHERE EXISTS (FROM o WHERE t = 5) UNION ALL SELECT 'coverage_mismatch', '3' WHERE EXISTS (FROM o WHERE t = 3)
UNION ALL SELECT 'materialized_count', '3' WHERE EXISTS (FROM o WHERE t = 3) UNION ALL SELECT 'duplicate_provenance', s FROM o WHERE s LIKE '%500'"""


def table_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tables with counters of all kinds, and their line of text."""
    k = "c_custkey"
    rows = fx.table(spark, sf_dir, "customer").selectExpr(
        k, f"CASE {k} % 3 WHEN 0 THEN 3042 WHEN 1 THEN 3047 ELSE 3069 END AS table_id", f"{k} % 31 = 0 AS unsupported", f"{k} % 37 = 0 AS layout_pending", f"CASE WHEN {k} % 5 = 0 THEN 1 ELSE 0 END AS unresolved",
        "0 AS decode_failures", f"CASE WHEN {k} % 41 = 0 THEN 2 ELSE 0 END AS disagreements", f"CASE WHEN {k} % 11 <> 0 THEN {k} % 100 END AS expected", f"{k} % 100 - {k} % 2 AS resolved", f"{k} % 2 AS row_carriers",
        f"CASE WHEN {k} % 7 = 0 THEN 1 ELSE 0 END AS surplus_groups", f"{k} % 13 + CASE WHEN {k} % 7 = 0 THEN 1 ELSE 0 END AS page_groups", f"CASE WHEN {k} % 17 <> 0 THEN {k} % 13 END AS pages", "0 AS external_pages",
    )
    lines = contract.coverage_lines(rows.withColumn("table_id", F.col(k))).select(F.col("table_id").alias(k), "line")
    return rows.select(k, contract.is_complete().alias("complete")).join(lines, k)


_DONE = """k % 31 <> 0 AND k % 37 <> 0 AND k % 5 <> 0 AND k % 41 <> 0 AND k % 11 <> 0 AND (k % 2 = 0 OR t = 3042) AND (k % 7 <> 0 OR (t = 3047 AND k % 100 - k % 2 > 0))"""
COMPLETENESS = f"""WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 3042 WHEN 1 THEN 3047 ELSE 3069 END AS t FROM customer)
SELECT k AS c_custkey, {_DONE} AS complete, 'table=' || k || CASE WHEN {_DONE.replace("OR t = 3042", "OR k = 3042").replace("t = 3047", "k IN (3047, 3078)")} THEN ' complete' ELSE ' incomplete' END || ' expected=' ||
 CASE WHEN k % 11 <> 0 THEN CAST(k % 100 AS VARCHAR) ELSE 'unknown' END || ' resolved=' || (k % 100 - k % 2) || ' unresolved=' || CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END || ' decode_failures=0 disagreements=' || CASE WHEN k % 41 = 0 THEN 2 ELSE 0 END AS line FROM c"""


def selection_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _orders(spark, sf_dir, "concat('c', o_custkey) AS account_id", "o_custkey AS k")
    return contract.selection_audit(ids.where("k % 5 <> 0"), ids.where("k % 7 <> 0"))


SELECTION = """WITH c AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT CASE WHEN k % 5 <> 0 THEN 'only_active' ELSE 'only_reference' END AS side, 'c' || k AS account_id FROM c WHERE (k % 5 <> 0) <> (k % 7 <> 0)"""


def snapshot_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, "o_orderkey AS k", "concat('f', o_orderkey) AS path", "o_custkey AS size", "o_orderstatus AS digest")
    after = rows.selectExpr("k", "path", "size", "CASE WHEN k % 7 = 0 THEN 'x' ELSE digest END AS digest").where("k % 11 <> 0")
    return contract.stable_snapshots(rows.where("k % 13 <> 0"), after)


STABILITY = """SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'gone' WHEN o_orderkey % 13 = 0 THEN 'new' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'stable' END AS outcome
FROM orders WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 13 = 0)"""


def directory_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages, their orders as candidates; each candidate lacks one record."""
    rows = _orders(spark, sf_dir, "o_custkey AS page", "o_orderkey AS candidate", "o_orderkey % 2 + 3 AS record_count")
    rows = rows.withColumn("records", F.expr("filter(sequence(0, cast(record_count as int) - 1), x -> x <> candidate % 3)"))
    found = candidates.directory_consensus(rows)
    return found.withColumn("common", F.array_join("common", ","))


DIRECTORY = """WITH c AS (SELECT o_custkey AS page, o_orderkey AS k, o_orderkey % 2 + 3 AS n FROM orders), s AS (SELECT page, count(*) AS all_n, min(n) AS low, max(n) AS high FROM c GROUP BY 1),
r AS (SELECT page, r, (SELECT 1) AS x FROM s, (VALUES (0), (1), (2), (3)) v(r) WHERE r < low),
h AS (SELECT r.page, r.r, count(c.k) AS held FROM r LEFT JOIN c ON r.page = c.page AND r.r < c.n AND r.r <> c.k % 3 GROUP BY 1, 2)
SELECT s.page, coalesce(string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) FILTER (held = all_n), '') AS common, count(*) FILTER (held = 0) AS agreed_empty,
 CAST(max(high - low) + count(*) FILTER (held > 0 AND held < all_n) AS BIGINT) AS disagreements FROM s JOIN h ON s.page = h.page GROUP BY 1"""


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "l_orderkey AS page", "l_linenumber % 2 AS candidate", "l_linenumber div 2 AS record", "CASE WHEN l_suppkey % 6 <> 0 THEN l_returnflag END AS value", "l_orderkey % 10 AS master").groupBy("page", "candidate", "record").agg(
        F.min("value").alias("value"), F.min("master").alias("master"))


_DECODED = """WITH d AS (SELECT l_orderkey AS page, l_linenumber % 2 AS candidate, l_linenumber // 2 AS record, min(CASE WHEN l_suppkey % 6 <> 0 THEN l_returnflag END) AS value FROM lineitem GROUP BY 1, 2, 3),
n AS (SELECT page, count(DISTINCT candidate) AS n FROM d GROUP BY 1), r AS (SELECT page, record, count(*) AS held, count(value) AS good, min(value) AS low, max(value) AS high FROM d GROUP BY 1, 2),
j AS (SELECT r.*, n, held = n AND good = n AND low = high AS same FROM r JOIN n USING (page))"""


def collected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on which all candidates of an order agree, of the masters that a header bears out."""
    heads = _orders(spark, sf_dir, "o_custkey AS page", "o_orderkey % 3 AS record", "o_orderkey AS candidate", "o_orderkey % 10 AS master").where("master < 4")
    return candidates.collect_table(_decoded(spark, sf_dir), heads.select("master"))[0].select("page", "record", "value")


COLLECTED = f"{_DECODED} SELECT page, record, low AS value FROM j WHERE same AND page % 10 IN (SELECT o_orderkey % 10 FROM orders WHERE o_orderkey % 10 < 4)"


def collection_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.collection_counters(_decoded(spark, sf_dir))


COUNTERS = f"""{_DECODED} SELECT (SELECT count(*) FROM n) AS page_groups, count(*) FILTER (coalesce(same, false)) AS resolved, count(*) FILTER (held = n AND NOT coalesce(same, false)) AS unresolved,
count(*) FILTER (held = n AND good < held) AS decode_failures, count(*) FILTER (held <> n) AS disagreements FROM j"""


def key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages; a page whose lines allow several keys bears out none."""
    return candidates.key_candidates(_lines(spark, sf_dir, "l_orderkey AS page", "l_suppkey % 3 AS key"))


KEYS = "WITH p AS (SELECT l_orderkey AS page, min(l_suppkey % 3) AS key FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 3) = 1) SELECT key, count(*) AS pages FROM p GROUP BY 1"


def balanced_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.perturbed(spark, sf_dir).where("posting_id not like '%777-C'")
    return candidates.balanced_candidates(rows.select((F.col("date") % 40).alias("candidate"), "transaction_id", F.col("signed_minor_units").alias("cents")))


BALANCED = f"""{SQL}, n AS (SELECT date % 40 AS candidate, transaction_id, sum(amount) AS net FROM perturbed WHERE posting_id NOT LIKE '%777-C' GROUP BY 1, 2) SELECT candidate FROM n GROUP BY 1 HAVING max(abs(net)) = 0"""


def layout_attestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layouts of one axis each that decode all suppliers' rows: a layout fails on the rows that its number divides, but for three."""
    layouts = candidates.storage_layouts(spark, {"booleans": range(1, 3), "null_bitmap": range(1, 4)})
    tried = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), F.explode(F.expr("sequence(0, 5)")).alias("layout"))
    tried = tried.join(F.broadcast(layouts), "layout").withColumn("ok", F.expr("layout in (1, 4) or row % (layout + 2) <> 0"))
    return candidates.attested_layouts(tried)


LAYOUTS = "SELECT CAST(layout AS INTEGER) AS layout, count(*) AS rows FROM supplier, range(0, 6) t(layout) GROUP BY 1 HAVING bool_and(layout IN (1, 4) OR s_suppkey % (layout + 2) <> 0)"


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.page_tables(_lines(spark, sf_dir, "l_orderkey AS page", "l_linenumber AS candidate", "CASE WHEN l_linestatus = 'F' THEN l_suppkey % 2 END AS table_id"))


PAGE_TABLES = """WITH e AS (SELECT l_orderkey AS page, min(CASE WHEN l_linestatus = 'F' THEN l_suppkey % 2 END) AS low, max(CASE WHEN l_linestatus = 'F' THEN l_suppkey % 2 END) AS high FROM lineitem GROUP BY 1)
SELECT page, CASE WHEN low = high THEN low END AS table_id, CASE WHEN low IS NULL THEN 'unclassified' WHEN low = high THEN 'single' ELSE 'conflict' END AS outcome FROM e"""


def carrier_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.carrier_census(_lines(spark, sf_dir, "l_returnflag AS carrier", "l_orderkey AS page", "l_linenumber AS record", "CASE WHEN l_partkey % 2 = 0 THEN l_suppkey END AS table_id", "l_partkey % 3 <> 0 AS parsed"))


CENSUS = """SELECT l_returnflag AS carrier, count(DISTINCT l_orderkey) AS pages, count(*) AS records, count(*) FILTER (l_partkey % 3 <> 0) AS parsed, count(*) FILTER (l_partkey % 3 = 0) AS unparsed,
count(*) FILTER (l_partkey % 3 = 0 AND l_partkey % 2 = 0 AND l_suppkey IS NOT NULL) AS identified FROM lineitem GROUP BY 1"""


def page_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, "concat('t', o_orderkey) AS trace_id", "o_orderkey AS nth", "o_custkey AS snapshot", "o_orderkey AS page", "o_orderstatus AS digest")
    raw = rows.where("page % 4 <> 0").select("snapshot", "page", F.expr("CASE WHEN page % 5 = 0 THEN 'other' ELSE digest END").alias("digest"))
    return candidates.correlate_traces(rows, raw)


TRACES = "SELECT 't' || o_orderkey AS trace_id, o_orderkey AS nth, CASE WHEN o_orderkey % 4 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'digest_mismatch' ELSE 'matched' END AS outcome FROM orders"


def post_name_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, "o_orderstatus", "o_orderpriority", "CASE WHEN o_custkey % 3 = 0 THEN o_custkey END AS tab_page_list", "CASE WHEN o_custkey % 5 = 0 THEN o_custkey END AS ext_page_list")
    return candidates.value_histograms(rows, ["o_orderstatus", "o_orderpriority"], ["tab_page_list", "ext_page_list"])


HISTOGRAMS = """SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'tab_page_list', '', count(*) FROM orders WHERE o_custkey % 3 = 0 HAVING count(*) > 0 UNION ALL SELECT 'ext_page_list', '', count(*) FROM orders WHERE o_custkey % 5 = 0 HAVING count(*) > 0"""


def index_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries of orders by the customer that owns them; some owners have two names, some pages are no extents."""
    tables = _orders(spark, sf_dir, "o_custkey AS object_id", "o_custkey AS table_id", "CASE WHEN o_custkey % 9 = 0 THEN o_orderstatus ELSE 't' END AS name").where("object_id % 4 <> 0")
    indexes = _orders(spark, sf_dir, "o_custkey AS owner_object_id", "o_orderkey % 50 AS page", "concat('ix', o_orderpriority) AS index")
    return candidates.index_groups(indexes, tables, indexes.where("page % 3 <> 0").select("page"))


INDEX_GROUPS = """WITH t AS (SELECT o_custkey AS k, min(CASE WHEN o_custkey % 9 = 0 THEN o_orderstatus ELSE 't' END) AS name FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1 HAVING count(DISTINCT CASE WHEN o_custkey % 9 = 0 THEN o_orderstatus ELSE 't' END) = 1),
i AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 50 AS page, 'ix' || o_orderpriority AS ix FROM orders)
SELECT CASE WHEN name IS NULL THEN 'orphan' WHEN page % 3 = 0 THEN 'invalid_page' ELSE 'candidate' END AS outcome, t.k AS table_id, name, page, string_agg(DISTINCT ix, ',' ORDER BY ix) AS indexes FROM i LEFT JOIN t ON i.k = t.k GROUP BY 1, 2, 3, 4"""


def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables, their lines as columns; each should have four."""
    tables = _orders(spark, sf_dir, "o_orderkey AS table_id", "cast(4 as bigint) AS col_count")
    return candidates.column_counts(_lines(spark, sf_dir, "l_orderkey AS table_id", "l_linenumber AS column_id"), tables)


COLUMN_COUNTS = """SELECT o_orderkey AS table_id, CAST(4 AS BIGINT) AS expected, count(DISTINCT l_linenumber) AS actual FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(DISTINCT l_linenumber) <> 4"""


def alias_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, "o_custkey AS page", "o_orderkey AS record", "o_orderstatus <> 'P' AS is_posting")
    aliases = _orders(spark, sf_dir, "-o_custkey AS page", "o_orderkey div 2 AS record", "o_custkey AS to_page", "o_orderkey - CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS to_record")
    return families.alias_violations(aliases, rows)


ALIASES = """WITH a AS (SELECT -o_custkey AS p, o_orderkey // 2 AS r, o_custkey AS tp, o_orderkey - CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS tr FROM orders)
SELECT 'duplicate_source' AS check, p || ':' || r AS key FROM a GROUP BY p, r HAVING count(*) > 1 UNION ALL SELECT 'duplicate_destination', tp || ':' || tr FROM a GROUP BY tp, tr HAVING count(*) > 1
UNION ALL SELECT 'no_posting_there', p || ':' || r FROM a LEFT JOIN orders ON o_custkey = tp AND o_orderkey = tr WHERE o_orderkey IS NULL OR o_orderstatus = 'P'"""


def _bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bills of two rows that net to nothing; every eleventh is off by a cent, every seventh of one account."""
    each = _orders(spark, sf_dir, "o_orderkey AS master", "cast(round(o_totalprice * 100) as bigint) AS cents", "o_custkey", "explode(array(0, 1)) AS side")
    return each.selectExpr(
        "master", "master * 10 + side AS target", "CASE WHEN master % 7 = 0 THEN o_custkey ELSE o_custkey * 2 + side END AS account", "master % 50 AS date", "1 AS view",
        "CASE WHEN side = 0 THEN cents ELSE -cents + CASE WHEN master % 11 = 0 THEN 1 ELSE 0 END END AS cents",
    )


def bill_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.bill_families(_bills(spark, sf_dir), _orders(spark, sf_dir, "o_orderkey AS master").where("master % 5 <> 0"))


_PROVEN = "o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND round(o_totalprice * 100) <> 0"
BILL_FAMILIES = f"SELECT o_orderkey AS master, o_orderkey % 50 AS date, 1 AS view FROM orders WHERE {_PROVEN}"


def bill_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three carriers for each bill: the first leads to the second, that one to a row, to the first (a cycle) or nowhere; the third lacks a flag."""
    each = _orders(spark, sf_dir, "o_orderkey AS master", "o_custkey", "explode(array(2, 3, 4)) AS i")
    carriers = each.selectExpr(
        "master", "master * 10 + i AS target", "o_custkey * 2 AS sibling", "master % 50 AS date", "1 AS view", "cast(null as bigint) AS account", "cast(null as bigint) AS cents",
        "CASE WHEN i = 2 THEN master * 10 + 3 WHEN master % 3 = 0 THEN master * 10 + 2 WHEN master % 13 = 0 THEN master * 10 + 9 ELSE master * 10 END AS next",
        "false AS is_source", "false AS is_no_post", "false AS is_memorized", "true AS is_split", "i <> 4 AS is_arap",
    )
    return families.bill_carrier_targets(carriers, _bills(spark, sf_dir), _orders(spark, sf_dir, "o_orderkey AS master").where("master % 5 <> 0"))


BILL_CARRIERS = f"SELECT o_orderkey * 10 + i AS target FROM orders, (VALUES (2), (3)) v(i) WHERE {_PROVEN} AND o_orderkey % 3 <> 0 AND o_orderkey % 13 <> 0"


def check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as checks of two rows: every sixth is void, with a companion; others have a compact link, some of another day."""
    each = _orders(spark, sf_dir, "o_orderkey AS master", "o_custkey", "o_orderkey % 6 = 0 AS void", "cast(round(o_totalprice * 100) as bigint) AS amount", "explode(array(0, 1)) AS side")
    rows = each.selectExpr("master * 10 + side AS target", "master", "master % 90 AS date", "o_custkey * 2 + side AS account", "CASE WHEN void THEN 0 WHEN side = 0 THEN amount ELSE -amount + CASE WHEN master % 19 = 0 THEN 5 ELSE 0 END END AS cents")
    companions = _orders(spark, sf_dir, "o_orderkey * 10 + 2 AS target", "o_orderkey AS master").where("master % 6 = 0 or master % 23 = 0")
    links = _orders(spark, sf_dir, "o_orderkey * 10 + 3 AS target", "o_orderkey AS master", "o_orderkey % 90 + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS date", "o_orderkey * 10 AS next", "o_custkey * 2 + 1 AS sibling").where("master % 6 <> 0")
    return families.check_violations(rows, companions, links, rows.select("account").where("account % 31 <> 0"))


CHECKS = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT 'unbalanced_check' AS check, CAST(k AS VARCHAR) AS key FROM o WHERE k % 6 <> 0 AND k % 19 = 0 UNION ALL SELECT 'companion_without_void', CAST(k * 10 + 2 AS VARCHAR) FROM o WHERE k % 6 <> 0 AND k % 23 = 0
UNION ALL SELECT 'link_leads_nowhere', CAST(k * 10 + 3 AS VARCHAR) FROM o WHERE k % 6 <> 0 AND k % 17 = 0 UNION ALL SELECT 'sibling_of_another_day', CAST(k * 10 + 3 AS VARCHAR) FROM o WHERE k % 6 <> 0 AND k % 17 = 0
UNION ALL SELECT 'unknown_sibling', CAST(k * 10 + 3 AS VARCHAR) FROM o WHERE k % 6 <> 0 AND (c * 2 + 1) % 31 = 0"""


def deposit_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as deposits: a wide header with three rows, or a narrow one with one; some lack a row, some do not net to nothing."""
    each = _orders(spark, sf_dir, "o_orderkey AS master", "o_orderkey % 2 = 0 AS wide", "explode(CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 10 = 0 THEN array(0, 1, 2) ELSE array(0, 1, 2, 3) END ELSE array(0, 1) END) AS i")
    rows = each.selectExpr(
        "master", "master * 10 + i AS target", "CASE WHEN i = 0 THEN CASE WHEN wide THEN 112 ELSE 113 END WHEN i = 1 THEN 225 ELSE 241 END AS envelope", "CASE WHEN i > 0 THEN i END AS account",
        "CASE WHEN i = 0 OR NOT wide THEN NULL WHEN i = 1 THEN 20 + CASE WHEN master % 14 = 0 THEN 1 ELSE 0 END ELSE -10 END AS cents", "i = 1 AND master % 9 <> 0 AS is_source", "false AS is_no_post", "false AS is_memorized", "wide AS is_split",
    )
    return families.deposit_headers(rows)


DEPOSITS = "SELECT o_orderkey AS master, CASE WHEN o_orderkey % 9 <> 0 AND (o_orderkey % 2 = 1 OR (o_orderkey % 10 <> 0 AND o_orderkey % 14 <> 0)) THEN 'header' ELSE 'broken' END AS outcome FROM orders"


def journal_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _orders(spark, sf_dir, "o_orderkey AS target", "o_orderkey AS master", "o_orderkey % 100 AS date", "o_orderkey AS group")
    heads = _orders(spark, sf_dir, "o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS id", "o_orderkey % 100 AS date", "o_orderkey - o_orderkey % 11 % 2 AS group").where("id % 5 <> 0")
    return families.journal_witnesses(sources, heads)


JOURNAL = """WITH h AS (SELECT o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS id, o_orderkey % 100 AS d, o_orderkey - o_orderkey % 11 % 2 AS g FROM orders),
n AS (SELECT d, g, count(*) AS n, min(id) AS id FROM h WHERE id % 5 <> 0 GROUP BY 1, 2)
SELECT o_orderkey AS target, CASE WHEN n IS NULL THEN 'no_header' WHEN n > 1 THEN 'several_headers' WHEN id = o_orderkey + 1 THEN 'proven' ELSE 'other_master' END AS outcome FROM orders LEFT JOIN n ON d = o_orderkey % 100 AND g = o_orderkey"""


def auxiliary_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contexts of one to six auxiliary rows in a chain that ends in a row, in itself every fifth time."""
    each = _orders(spark, sf_dir, "o_orderkey AS master", "o_orderkey % 6 + 1 AS n", "explode(sequence(1, cast(o_orderkey % 6 + 1 as int))) AS i")
    nodes = each.selectExpr("master", "1 AS date", "1 AS view", "master * 10 + i AS target", "CASE WHEN i < n THEN master * 10 + i + 1 WHEN master % 5 = 0 THEN master * 10 + 1 ELSE master * 10 END AS next", "master % 4 AS account")
    rows = _orders(spark, sf_dir, "o_orderkey AS master", "1 AS date", "1 AS view", "o_orderkey * 10 AS target", "cast(0 as bigint) AS account", "cast(CASE WHEN o_orderkey % 8 = 3 THEN 1 ELSE 0 END as bigint) AS cents")
    return families.auxiliary_chains(nodes, rows)


CHAINS = """SELECT o_orderkey AS master, 1 AS date, 1 AS view, CASE WHEN o_orderkey % 6 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'metadata' ELSE 'broken' END
 WHEN o_orderkey % 6 IN (1, 3, 5) AND o_orderkey % 5 <> 0 AND o_orderkey % 8 <> 3 THEN 'chain' ELSE 'broken' END AS outcome FROM orders"""


def adapted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as typed rows of accounting tables, by type and outcome."""
    cents = "CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 0 ELSE cast(round(l_extendedprice * 100) as bigint) END AS cents"
    made = _lines(spark, sf_dir, "element_at(array(3039, 3042, 3047, 3069, 3078, 3040), cast(l_partkey % 6 as int) + 1) AS table_id", "cast(l_suppkey % 3 as int) AS view", cents, "l_suppkey % 4 = 0 AS is_source",
                  "CASE WHEN l_partkey % 13 <> 1 THEN l_partkey % 13 = 0 END AS is_no_post", "l_partkey % 17 = 0 AS is_memorized", "CASE WHEN l_suppkey % 19 <> 0 THEN 1 END AS date", "CASE WHEN l_suppkey % 23 <> 0 THEN 1 END AS account_id")
    named = made.withColumns({"is_line": rows.is_posting_table(F.col("table_id")), "is_header": rows.is_header_table(F.col("table_id"))})
    return rows.adapted(named).groupBy("is_line", "is_header", "transaction_type", "disposition").agg(F.count("*").alias("n"))


ADAPTED = """WITH x AS (SELECT *, [3039, 3042, 3047, 3069, 3078, 3040][l_partkey % 6 + 1] AS t, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 0 ELSE 1 END AS cents FROM lineitem),
y AS (SELECT *, CASE t WHEN 3039 THEN 'bill-pmt-check' WHEN 3047 THEN 'check' WHEN 3069 THEN 'deposit' WHEN 3078 THEN 'general-journal' WHEN 3042 THEN CASE l_suppkey % 3 WHEN 1 THEN 'bill' WHEN 2 THEN 'vendor-credit' END END AS transaction_type FROM x)
SELECT t <> 3040 AS is_line, t = 3040 AS is_header, transaction_type, CASE WHEN l_partkey % 13 = 0 THEN 'no_post' WHEN l_partkey % 17 = 0 THEN 'memorized' WHEN l_suppkey % 4 = 0 AND cents IS NULL THEN 'source' WHEN transaction_type IS NULL THEN 'unknown_view'
 WHEN l_suppkey % 19 = 0 THEN 'invalid_date' WHEN cents IS NULL OR (t = 3078 AND cents = 0) THEN 'invalid_amount' WHEN l_suppkey % 23 = 0 THEN 'invalid_account' WHEN cents = 0 THEN 'canonical_zero' ELSE 'posting' END AS disposition, count(*) AS n FROM y GROUP BY 1, 2, 3, 4"""


def field_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named fields of rows that were read as far as their third or fourth column."""
    row = "CASE WHEN c_custkey % 2 = 0 THEN array(cast(c_custkey as string), c_mktsegment, cast(c_custkey % 3 as string)) ELSE array(cast(c_custkey as string), c_mktsegment, '1', 'last') END AS v"
    made = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey", row, "array('id', 'segment', 'flag', 'tail') AS c")
    v, c = F.col("v"), F.col("c")
    return made.select("c_custkey", rows.field(v, c, "segment").alias("segment"), rows.field(v, c, "tail").alias("tail"), rows.field(v, c, "none").alias("absent"), rows.boolean_field(v, c, "flag").alias("flag"))


FIELDS = """SELECT c_custkey, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 1 THEN 'last' END AS tail, CAST(NULL AS VARCHAR) AS absent, CASE WHEN c_custkey % 2 = 1 OR c_custkey % 3 = 1 THEN true WHEN c_custkey % 3 = 0 THEN false END AS flag FROM customer"""


def schema_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as columns of tables, complete or not."""
    domains = "element_at(array('small_int', 'integer', 'uint64', 'date', 'numeric', 'char'), cast(l_suppkey % 6 as int) + 1) AS domain"
    columns = _lines(spark, sf_dir, "l_orderkey AS table_id", "l_linenumber AS column_id", domains, "element_at(array(2, 4, 8), cast(l_partkey % 3 as int) + 1) AS width", "cast(l_partkey % 5 as int) AS scale", "CASE WHEN l_partkey % 4 = 0 THEN cast(l_partkey % 3 as string) END AS envelope")
    allowed = columns.select("domain").distinct().select("domain", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("envelope"))
    return rows.complete_schema(columns, allowed)


WIDTHS = """WITH c AS (SELECT l_orderkey AS t, l_linenumber AS c, l_suppkey % 6 AS d, [2, 4, 8][l_partkey % 3 + 1] AS w, l_partkey % 5 AS s, CASE WHEN l_partkey % 4 = 0 THEN l_partkey % 3 END AS e FROM lineitem),
j AS (SELECT *, CASE d WHEN 0 THEN w = 2 WHEN 1 THEN w IN (1, 2, 4, 8) WHEN 2 THEN w = 8 WHEN 3 THEN w = 4 WHEN 4 THEN w >= s ELSE true END AND coalesce(e, 0) < 2 AS good FROM c)
SELECT t AS table_id, count(DISTINCT c) = max(c) AND count(*) = count(DISTINCT c) AND bool_and(good) AS complete FROM j GROUP BY 1"""


def label_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifications of codes, their types and sides, and total rows."""
    k = F.col("c_custkey")
    made = fx.table(spark, sf_dir, "customer").select(
        k, labels.classification_of_code(k % 17).alias("classification"), F.element_at(F.array(*map(F.lit, ("Total", "TOTAL:", "Total Bank", "Bank", "total "))), (k % 5).cast("int") + 1).alias("label"),
    )
    return made.select(
        "c_custkey", "classification", labels.broad_type(F.col("classification")).alias("broad"), labels.normal_balance(labels.broad_type(F.col("classification"))).alias("side"),
        labels.is_total_row(F.col("label")).alias("total_row"), labels.is_total_label(F.col("label")).alias("total_label"),
    )


LABEL_FORMS = """WITH c AS (SELECT c_custkey AS k, ['Bank', 'AccountsReceivable', 'OtherCurrentAsset', 'FixedAsset', 'OtherAsset', 'AccountsPayable', 'CreditCard', 'OtherCurrentLiability', 'LongTermLiability', 'Equity', 'Income', 'CostOfGoodsSold', 'Expense', 'OtherIncome', 'OtherExpense'][c_custkey % 17 + 1] AS classification FROM customer),
b AS (SELECT *, CASE WHEN k % 17 < 5 THEN 'asset' WHEN k % 17 < 9 THEN 'liability' WHEN k % 17 = 9 THEN 'equity' WHEN k % 17 IN (10, 13) THEN 'income' WHEN k % 17 = 11 THEN 'cost_of_goods_sold' WHEN k % 17 IN (12, 14) THEN 'expense' END AS broad FROM c)
SELECT k AS c_custkey, classification, broad, CASE WHEN broad IN ('liability', 'equity', 'income') THEN 'credit' ELSE 'debit' END AS side, k % 5 <> 3 AS total_row, k % 5 IN (0, 2, 4) AS total_label FROM b"""

QUERIES = {
    "gl_output_violations": (gl_output_violations, GL_OUTPUT), "tb_output_violations": (tb_output_violations, TB_OUTPUT), "zero_activity_violations": (zero_activity_violations, ZERO_ACTIVITY),
    "account_conflicts": (account_conflicts, CONFLICTS), "report_audit": (report_audit, REPORT_AUDIT), "tb_verdict": (tb_verdict, TB_VERDICT), "coverage_violations": (coverage_violations, COVERAGE),
    "table_completeness": (table_completeness, COMPLETENESS), "selection_audit": (selection_audit, SELECTION), "snapshot_stability": (snapshot_stability, STABILITY), "directory_consensus": (directory_consensus, DIRECTORY),
    "collected_rows": (collected_rows, COLLECTED), "collection_counters": (collection_counters, COUNTERS), "key_candidates": (key_candidates, KEYS), "balanced_candidates": (balanced_candidates, BALANCED),
    "layout_attestation": (layout_attestation, LAYOUTS), "page_tables": (page_tables, PAGE_TABLES), "carrier_census": (carrier_census, CENSUS), "page_traces": (page_traces, TRACES), "post_name_histograms": (post_name_histograms, HISTOGRAMS),
    "index_groups": (index_groups, INDEX_GROUPS), "column_counts": (column_counts, COLUMN_COUNTS), "alias_violations": (alias_violations, ALIASES), "bill_families": (bill_families, BILL_FAMILIES), "bill_carriers": (bill_carriers, BILL_CARRIERS),
    "check_violations": (check_violations, CHECKS), "deposit_headers": (deposit_headers, DEPOSITS), "journal_witnesses": (journal_witnesses, JOURNAL), "auxiliary_chains": (auxiliary_chains, CHAINS), "adapted_rows": (adapted_rows, ADAPTED),
    "field_projection": (field_projection, FIELDS), "schema_widths": (schema_widths, WIDTHS), "label_forms": (label_forms, LABEL_FORMS),
}
