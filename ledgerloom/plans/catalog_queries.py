"""Catalog, export, verification and forensic queries over the warehouse fixtures, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import catalog, discovery
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.fixtures import LINES, SCHEMA

_CATALOG = """WITH tables AS (SELECT o_orderkey AS nth, o_orderkey // 2 AS object_id, 't' || (o_orderkey // 3) AS name, CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey ELSE 0 END AS data_root_page,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 40 WHEN o_orderkey % 5 = 0 THEN o_orderkey - 1 END AS last_page FROM orders)"""
_OWNER = "CASE WHEN t.last_page >= t.data_root_page AND p.page_number > t.last_page THEN NULL ELSE t.name END"
_ASOF = "ASOF LEFT JOIN (SELECT * FROM tables WHERE data_root_page > 0) t ON p.page_number >= t.data_root_page"


def page_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.attribute_pages(fx.pages(spark, sf_dir), fx.catalog_tables(spark, sf_dir))


PAGE_ATTRIBUTION = f"{_CATALOG} SELECT p.page_number, {_OWNER} AS owner FROM (SELECT l_orderkey AS page_number FROM lineitem) p {_ASOF}"


def pages_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.group_pages(catalog.attribute_pages(fx.pages(spark, sf_dir), fx.catalog_tables(spark, sf_dir)))


PAGES_BY_OWNER = f"""{_CATALOG}, a AS (SELECT p.page_number, {_OWNER} AS owner FROM (SELECT l_orderkey AS page_number FROM lineitem) p {_ASOF})
SELECT coalesce(owner, '') AS owner, count(*) AS n_pages, min(page_number) AS first_page, max(page_number) AS last_page FROM a GROUP BY 1"""


def _indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").selectExpr(
        "concat('ix', o_orderkey) AS name", "o_orderkey div 3 AS owner_object_id", "o_orderkey AS catalog_page_candidate"
    )


def index_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.index_audit(_indexes(spark, sf_dir), fx.catalog_tables(spark, sf_dir))


_AUDIT = f"""{_CATALOG}, p AS (SELECT 'ix' || o_orderkey AS name, o_orderkey // 3 AS owner_object_id, o_orderkey AS page_number FROM orders),
ids AS (SELECT object_id, min(name) AS name, count(DISTINCT name) AS n FROM tables GROUP BY 1),
placed AS (SELECT p.*, {_OWNER} AS owner FROM p {_ASOF}),
audit AS (SELECT placed.name, owner_object_id, page_number, CASE WHEN n = 1 THEN ids.name END AS owner_by_id, owner AS owner_by_page,
 CASE WHEN n IS NULL THEN 'orphan' WHEN n > 1 THEN 'ambiguous' WHEN owner IS NULL THEN 'unattributed' WHEN owner = ids.name THEN 'agree' ELSE 'disagree' END AS outcome
 FROM placed LEFT JOIN ids ON owner_object_id = object_id)"""


def agreement_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.agreement_rate(index_audit(spark, sf_dir))


AGREEMENT = f"""{_AUDIT}, n AS (SELECT count(*) FILTER (outcome = 'agree') AS agree, count(*) FILTER (outcome IN ('agree', 'disagree', 'unattributed')) AS compared FROM audit)
SELECT agree, compared, CASE WHEN compared > 0 THEN agree * 1000000 // compared ELSE 0 END AS rate_ppm FROM n"""

_TABLES = "tables(nth, table_id, name, col_count) AS (VALUES " + ", ".join(f"({i}, {i}, '{n}', {len(c.split())})" for i, (n, c) in enumerate(SCHEMA)) + ")"
_COLUMNS = "columns(table_id, column_id, name, width, nulls, nth) AS (VALUES " + ", ".join(
    f"({i}, {j + 1}, '{c.split(':')[0]}', {c.split(':')[1]}, {c.split(':')[2]}, {100 * i + j})" for i, (_, cols) in enumerate(SCHEMA) for j, c in enumerate(cols.split())
) + ")"
_SCHEMA = f"WITH {_TABLES}, {_COLUMNS}"


def fk_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, columns = fx.schema_catalog(spark)
    return catalog.fk_graph(columns, tables)


_FK = f"""{_SCHEMA}, c AS (SELECT t.name AS source_table, c.name AS source_column, column_id AS source_column_id, regexp_extract(c.name, '^(.+?)_id(_h)?$', 1) AS stem
  FROM columns c JOIN tables t ON c.table_id = t.table_id WHERE regexp_matches(c.name, '^.+_id(_h)?$')),
b AS (SELECT name, nth, regexp_replace(lower(name), '^(abmc_|es_|i_|v_|mv_|ix_)', '') AS bare FROM tables),
s AS (SELECT c.*, b.name AS target, nth, CASE WHEN lower(b.name) = stem THEN 1000 WHEN bare = stem THEN 900 WHEN suffix(bare, '_' || stem) THEN 700 WHEN prefix(bare, stem || '_') THEN 600 WHEN contains(bare, stem) THEN 300 ELSE 0 END AS score FROM c, b),
r AS (SELECT *, row_number() OVER (PARTITION BY source_table, source_column_id ORDER BY score DESC, nth) AS place FROM s),
edges AS (SELECT source_table, source_column, source_column_id, stem, CASE WHEN score > 0 THEN target END AS target_table, score FROM r WHERE place = 1)"""


def fk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fk_stats(fk_graph(spark, sf_dir))


def nullability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.nullability(fx.schema_catalog(spark)[1])


NULLABILITY = f"""{_SCHEMA}, n AS (SELECT nulls, name, count(*) AS n, min(nth) AS first FROM columns GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY nulls ORDER BY first, name) AS place FROM n)
SELECT nulls, CAST(sum(n) AS BIGINT) AS n, string_agg(name, ',' ORDER BY place) FILTER (place <= 4) AS samples FROM r GROUP BY nulls"""


def width_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, columns = fx.schema_catalog(spark)
    return catalog.width_bands(columns.where("name <> 'p_brand'"), tables)


WIDTH_BANDS = f"""{_SCHEMA}, s AS (SELECT table_id, count(DISTINCT column_id) AS n_columns, max(column_id) AS top, CAST(sum(width) AS BIGINT) AS most,
  CAST(sum(CASE WHEN nulls = 0 THEN width ELSE 0 END) AS BIGINT) AS least FROM columns WHERE name <> 'p_brand' GROUP BY 1)
SELECT name, n_columns, least, most FROM s JOIN tables t ON s.table_id = t.table_id WHERE n_columns = col_count AND top = col_count"""


def conflict_free_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").selectExpr("o_custkey AS table_id", "concat('n', o_custkey % 1400 + CASE WHEN o_orderkey % 50 = 0 THEN 7 ELSE 0 END) AS name", "o_orderkey AS page_number")
    return catalog.conflict_free(rows, ["table_id", "name"])


CONFLICT_FREE = """WITH d AS (SELECT DISTINCT o_custkey AS table_id, 'n' || (o_custkey % 1400 + CASE WHEN o_orderkey % 50 = 0 THEN 7 ELSE 0 END) AS name FROM orders)
SELECT table_id, name FROM d QUALIFY count(*) OVER (PARTITION BY table_id) = 1 AND count(*) OVER (PARTITION BY name) = 1"""


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").selectExpr("o_custkey AS table_id", "o_orderpriority AS name", "o_orderkey AS nth")
    return catalog.first_of(rows, ["table_id", "name"], "nth")


FIRST_WINS = "SELECT o_custkey AS table_id, o_orderpriority AS name, min(o_orderkey) AS nth FROM orders GROUP BY 1, 2"


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page_number", "CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS value")
    return catalog.consensus(rows, "page_number", "value")


CONSENSUS = """SELECT l_orderkey AS page_number, min(l_returnflag) AS value FROM lineitem WHERE l_linenumber <> 2
GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1"""


def owner_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.owners_by_vote(fx.table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag")


OWNER_VOTES = """WITH v AS (SELECT l_partkey, l_returnflag, count(*) AS votes FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_returnflag, votes FROM v QUALIFY rank() OVER (PARTITION BY l_partkey ORDER BY votes DESC) = 1
AND count(*) OVER (PARTITION BY l_partkey, votes) = 1"""


def median_row_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents").select("source", F.octet_length("text").alias("bytes"))
    return catalog.upper_median(rows, "source", "bytes")


MEDIAN = """WITH s AS (SELECT source, list_sort(list(strlen(text))) AS l FROM documents GROUP BY 1) SELECT source, l[len(l) // 2 + 1] AS median FROM s"""

_EXPORT = f"""{LINES}, l AS (SELECT invoice_id, count(*) AS line_count, CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS total_cents, max(CASE WHEN amount_type = 1 THEN 1 ELSE 0 END) AS has_deferred,
  first(txn_date_raw ORDER BY page_offset) FILTER (txn_date_raw IS NOT NULL) AS d, first(counter ORDER BY page_offset) FILTER (counter IS NOT NULL) AS c,
  first(source_table ORDER BY page_offset) AS s, min(page_number) AS p FROM items GROUP BY 1),
transactions AS (SELECT coalesce(qb_id, invoice_id) AS qb_id, CASE WHEN qb_id IS NULL THEN 'unknown' ELSE replace(replace(source_table, 'abmc_', ''), '_header', '') END AS type,
  CASE WHEN qb_id IS NULL THEN s ELSE source_table END AS source_table, CASE WHEN qb_id IS NULL THEN d ELSE txn_date_raw END AS txn_date_raw,
  CASE WHEN qb_id IS NULL THEN c ELSE counter END AS counter, coalesce(line_count, 0) AS line_count, coalesce(total_cents, 0) AS total_cents,
  coalesce(has_deferred, 0) AS has_deferred, CASE WHEN qb_id IS NULL THEN p ELSE page_number END AS source_page FROM headers FULL JOIN l ON qb_id = invoice_id)"""


def export_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.export_transactions(fx.headers(spark, sf_dir), fx.line_items(spark, sf_dir))


def export_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.export_stats(export_transactions(spark, sf_dir))


EXPORT_STATS = f"{_EXPORT} SELECT count(*) AS transactions, CAST(sum(line_count) AS BIGINT) AS lines, CAST(sum(total_cents) AS BIGINT) AS total_cents, count(*) FILTER (type = 'unknown') AS synthesized FROM transactions"


def export_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = discovery.export_line_items(fx.line_items(spark, sf_dir))
    return rows.select("invoice_id", "line_number", "item_id", "amount_type", "amount_cents", "amount_cents_signed", "source_table", "page_number", "page_offset")


EXPORT_LINE_ITEMS = f"""{LINES} SELECT invoice_id, CAST(row_number() OVER (PARTITION BY invoice_id, source_table ORDER BY page_number, page_offset) AS INTEGER) AS line_number,
item_id, amount_type, amount_cents, amount_cents_signed, source_table, page_number, page_offset FROM items"""


def verify_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.counts_by(fx.line_items(spark, sf_dir), "source_table", "amount_cents")


def verify_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.counts_by(export_transactions(spark, sf_dir), "type", "total_cents")


def verify_grand_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.grand_totals(fx.line_items(spark, sf_dir))


def verify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.parent_pairs(fx.line_items(spark, sf_dir))


VERIFY_PAIRS = f"""{LINES}, e AS (SELECT invoice_id, count(*) AS n, count(DISTINCT amount_type) AS types, coalesce(sum(amount_cents_signed), 0) AS net FROM items GROUP BY 1)
SELECT count(*) FILTER (n = 2 AND types = 1) AS pairs, count(*) FILTER (n = 2 AND types = 1 AND net = 0) AS balanced_pairs, count(*) AS parents, count(*) FILTER (net = 0) AS balanced_parents FROM e"""


def verify_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten items that stand in most transactions."""
    rows = fx.line_items(spark, sf_dir).select("invoice_id", F.col("item_id").alias("source_table"))
    return discovery.top_sources(rows)


VERIFY_TOP10 = f"{LINES} SELECT item_id AS source_table, count(DISTINCT invoice_id) AS parents FROM items GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.orphans(fx.headers(spark, sf_dir), fx.line_items(spark, sf_dir))


ORPHANS = f"""{LINES} SELECT (SELECT count(DISTINCT invoice_id) FROM items WHERE invoice_id NOT IN (SELECT qb_id FROM headers)) AS parents_without_header,
(SELECT count(DISTINCT qb_id) FROM headers WHERE qb_id NOT IN (SELECT invoice_id FROM items)) AS headers_without_lines,
(SELECT count(DISTINCT qb_id) FROM headers WHERE qb_id IN (SELECT invoice_id FROM items)) AS complete"""


def iif_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.interchange_lines(fx.line_items(spark, sf_dir))


_MONEY = "CASE WHEN {x} < 0 THEN '-' ELSE '' END || (abs({x}) // 100) || '.' || lpad(CAST(abs({x}) % 100 AS VARCHAR), 2, '0')"
IIF_LINES = f"""{LINES}, i AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY page_offset) AS nth, -coalesce(amount_cents_signed, 0) AS v FROM items),
e AS (SELECT invoice_id, count(*) AS n, CAST(-sum(v) AS BIGINT) AS t, first(source_table ORDER BY page_offset) AS s FROM i GROUP BY 1)
SELECT invoice_id AS parent, CAST(nth AS INTEGER) AS nth, 'SPL' || chr(9) || nth || chr(9) || source_table || chr(9) || {_MONEY.format(x="v")} AS line FROM i
UNION ALL SELECT invoice_id, 0, 'TRNS' || chr(9) || invoice_id || chr(9) || s || chr(9) || {_MONEY.format(x="t")} FROM e
UNION ALL SELECT invoice_id, CAST(n + 1 AS INTEGER), 'ENDTRNS' FROM e"""

QUERIES = {
    "page_attribution": (page_attribution, PAGE_ATTRIBUTION), "pages_by_owner": (pages_by_owner, PAGES_BY_OWNER), "index_audit": (index_audit, f"{_AUDIT} SELECT * FROM audit"),
    "agreement_rate": (agreement_rate, AGREEMENT), "fk_graph": (fk_graph, f"{_FK} SELECT * FROM edges"),
    "fk_stats": (fk_stats, f"{_FK} SELECT count(*) AS total, count(*) FILTER (score > 0) AS resolved, count(*) FILTER (score >= 900) AS strong FROM edges"),
    "nullability": (nullability, NULLABILITY), "width_bands": (width_bands, WIDTH_BANDS), "conflict_free_catalog": (conflict_free_catalog, CONFLICT_FREE), "first_wins": (first_wins, FIRST_WINS),
    "consensus": (consensus, CONSENSUS), "owner_votes": (owner_votes, OWNER_VOTES), "median_row_length": (median_row_length, MEDIAN),
    "export_transactions": (export_transactions, f"{_EXPORT} SELECT * FROM transactions"), "export_stats": (export_stats, EXPORT_STATS), "export_line_items": (export_line_items, EXPORT_LINE_ITEMS),
    "verify_by_source": (verify_by_source, f"{LINES} SELECT source_table, count(*) AS n, CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS total_cents FROM items GROUP BY 1"),
    "verify_by_type": (verify_by_type, f"{_EXPORT} SELECT type, count(*) AS n, CAST(coalesce(sum(total_cents), 0) AS BIGINT) AS total_cents FROM transactions GROUP BY 1"),
    "verify_grand_totals": (verify_grand_totals, f"{LINES} SELECT count(DISTINCT invoice_id) AS parents, CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS total_cents FROM items"),
    "verify_pairs": (verify_pairs, VERIFY_PAIRS), "verify_top10": (verify_top10, VERIFY_TOP10), "orphans": (orphans, ORPHANS), "iif_lines": (iif_lines, IIF_LINES),
}
