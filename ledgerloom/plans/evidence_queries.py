"""Queries of structural evidence over the warehouse fixtures, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import catalog, evidence
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.catalog_queries import _SCHEMA


def width_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as measured rows; half of the sources have a band, from their least to their median length."""
    docs = fx.table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("length"))
    banded = docs.where("cast(substr(name, 4) as int) % 2 = 0 and length is not null")
    bands = banded.groupBy("name").agg(F.min("length").alias("least")).join(catalog.upper_median(banded, "name", "length"), "name")
    return evidence.width_outcomes(docs, bands.select("name", "least", F.col("median").alias("most")))


WIDTHS = """WITH d AS (SELECT source AS name, CASE WHEN doc_id % 11 <> 0 THEN n_chars END AS length FROM documents),
l AS (SELECT name, list_sort(list(length)) AS v FROM d WHERE CAST(substr(name, 4) AS INTEGER) % 2 = 0 AND length IS NOT NULL GROUP BY 1),
b AS (SELECT name, v[1] AS least, v[len(v) // 2 + 1] AS most FROM l)
SELECT CASE WHEN least IS NULL THEN 'no_band' WHEN length IS NULL THEN 'unmeasured' WHEN length BETWEEN least AND most THEN 'pass' ELSE 'fail' END AS outcome, count(*) AS n
FROM d LEFT JOIN b USING (name) GROUP BY 1"""


def attribution_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages: owner by customer, content by the first bytes of the priority; roots are each customer's first order."""
    rows = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("t"), F.col("o_orderkey") % 7)).alias("owner"),
        evidence.row_signature(F.encode(F.concat("o_orderpriority", F.lit("-"), F.col("o_orderkey") % 800), "UTF-8")).alias("signature"),
    )
    roots = rows.groupBy("o_custkey").agg(F.min_by(F.struct("signature", F.concat(F.lit("t"), F.col("o_orderkey") % 7).alias("name")), "o_orderkey").alias("r")).select("r.*")
    return evidence.attribution_agreement(rows, evidence.unique_signatures(roots))


AGREEMENT = """WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 <> 0 THEN 't' || (o_orderkey % 7) END AS owner, substr(lower(hex(encode(o_orderpriority || '-' || (o_orderkey % 800)))), 1, 24) AS signature FROM orders),
s AS (SELECT signature, min('t' || (o_orderkey % 7)) AS content FROM r WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_custkey) GROUP BY 1 HAVING count(*) = 1),
b AS (SELECT owner, content FROM r LEFT JOIN s USING (signature))
SELECT count(*) FILTER (owner = content) AS agree, count(*) FILTER (owner <> content) AS disagree, count(*) FILTER (owner IS NOT NULL AND content IS NULL) AS only_position,
count(*) FILTER (owner IS NULL AND content IS NOT NULL) AS only_content, count(*) FILTER (owner IS NULL AND content IS NULL) AS neither FROM b"""


def _columns(spark: SparkSession) -> DataFrame:
    columns = fx.schema_catalog(spark)[1]
    return columns.withColumns({"domain_id": F.col("width") % 5, "scale": F.lit(0), "marker": F.lit(67), "row_flags": F.lit(1), "post_name_bytes": F.lit(b"\x01\x02")})


def schema_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.schema_fingerprints(_columns(spark))


_LE = "printf('%02X000000', {x})"
_PART = f"{_LE.format(x='column_id')} || hex(encode(name)) || {_LE.format(x='width % 5')} || {_LE.format(x='width')} || '00000000' || printf('%02X', nulls) || '43' || '01' || '0102'"
FINGERPRINTS = f"""{_SCHEMA}, p AS (SELECT table_id, string_agg({_PART}, '' ORDER BY column_id) AS h FROM columns GROUP BY 1),
b AS (SELECT table_id, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, i * 2 + 1, 2) AS UHUGEINT)) AS bytes FROM p)
SELECT table_id, CAST(list_reduce(bytes, lambda s, x: xor((s * 1099511628211) % 18446744073709551616, x), CAST(14695981039346656037 AS UHUGEINT)) AS VARCHAR) AS fingerprint FROM b"""


def complete_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, columns = fx.schema_catalog(spark)
    return evidence.complete_columns(columns.where("name <> 'p_brand' and name <> 'r_name'"), tables.select("table_id", "col_count"))


COMPLETE = f"""{_SCHEMA}, s AS (SELECT table_id, count(*) AS n, max(column_id) AS top FROM columns WHERE name NOT IN ('p_brand', 'r_name') GROUP BY 1)
SELECT t.table_id, coalesce(n = col_count AND top = n, false) AS complete FROM tables t LEFT JOIN s ON t.table_id = s.table_id"""


def manifest_attestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog against a manifest in which one table has changed and one is unknown."""
    found = schema_fingerprints(spark, sf_dir)
    manifest = found.select(F.when(F.col("table_id") == 2, 99).otherwise(F.col("table_id")).alias("table_id"), F.when(F.col("table_id") == 5, "0").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return evidence.attest_manifest(found, manifest)


MANIFEST = f"""{_SCHEMA} SELECT CASE WHEN table_id = 2 THEN 99 ELSE table_id END AS table_id, CASE WHEN table_id = 2 THEN 'missing' WHEN table_id = 5 THEN 'changed' ELSE 'ok' END AS outcome FROM tables"""


def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "part").select((F.col("p_partkey") * 37).alias("number"))
    return rows.select("number", F.explode(evidence.number_forms(F.col("number"))).alias("f")).select("number", "f.label", "f.form")


_B = ["number % 256", "number // 256 % 256", "number // 65536 % 256", "number // 16777216"]
_F = {
    "u16le": f"CASE WHEN number < 65536 THEN printf('%02X%02X', {_B[0]}, {_B[1]}) END", "u16be": f"CASE WHEN number < 65536 THEN printf('%02X%02X', {_B[1]}, {_B[0]}) END",
    "low16le": f"printf('%02X%02X', {_B[0]}, {_B[1]})", "low16be": f"printf('%02X%02X', {_B[1]}, {_B[0]})",
    "u24le": f"printf('%02X%02X%02X', {_B[0]}, {_B[1]}, {_B[2]})", "u24be": f"printf('%02X%02X%02X', {_B[2]}, {_B[1]}, {_B[0]})",
    "u32le": f"printf('%02X%02X%02X%02X', {', '.join(_B)})", "u32be": "printf('%08X', number)",
    "leb128": "CASE WHEN number < 128 THEN printf('%02X', number) WHEN number < 16384 THEN printf('%02X%02X', number % 128 + 128, number // 128) ELSE printf('%02X%02X%02X', number % 128 + 128, number // 128 % 128 + 128, number // 16384) END",
    "be_base128": "CASE WHEN number < 128 THEN printf('%02X', number) WHEN number < 16384 THEN printf('%02X%02X', number // 128 + 128, number % 128) ELSE printf('%02X%02X%02X', number // 16384 + 128, number // 128 % 128 + 128, number % 128) END",
}
NUMBER_FORMS = "WITH x AS (SELECT p_partkey * 37 AS number FROM part), f AS (" + " UNION ALL ".join(f"SELECT number, '{k}' AS label, {v} AS form FROM x" for k, v in _F.items()) + ") SELECT * FROM f WHERE form IS NOT NULL"


def carrier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as pages of a file, with directories and prefixes by their keys."""
    rows = fx.table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 100").alias("file"), F.col("o_orderkey").alias("page_number"), (F.col("o_custkey") % 2 == 0).alias("has_directory"), (F.col("o_custkey") % 3 == 0).alias("has_prefix"))
    return evidence.carrier_pairs(rows.where("page_number % 13 <> 0"), "file")


CARRIERS = """WITH p AS (SELECT o_orderkey // 100 AS file, o_orderkey AS n, o_custkey % 2 = 0 AS d, o_custkey % 3 = 0 AS p FROM orders WHERE o_orderkey % 13 <> 0),
w AS (SELECT lag(d) OVER v AS l, d AS r, p, n - lag(n) OVER v AS gap FROM p WINDOW v AS (PARTITION BY file ORDER BY n))
SELECT count(*) AS consecutive_pairs, count(*) FILTER (l AND r) AS both_have_directory, count(*) FILTER (p) AS right_has_prefix, count(*) FILTER (r AND p) AS right_has_both, count(*) FILTER (l AND p) AS left_directory_right_prefix FROM w WHERE gap = 1"""


def name_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System and foreign-key names among names made from customers."""
    name = F.element_at(F.array(*map(F.lit, ("SYSX", "ISYSX", "RS_a", "dbo.t", "fkey_a", "customer", "mySYS"))), F.expr("cast(c_custkey % 7 as int) + 1"))
    rows = fx.table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    return rows.select("c_custkey", evidence.is_system_name(F.col("name")).alias("is_system"), evidence.is_foreign_key(F.col("name")).alias("is_foreign_key"))


PREDICATES = "SELECT c_custkey, c_custkey % 7 < 4 AS is_system, c_custkey % 7 = 4 AS is_foreign_key FROM customer"

QUERIES = {
    "width_outcomes": (width_outcomes, WIDTHS), "attribution_agreement": (attribution_agreement, AGREEMENT), "schema_fingerprints": (schema_fingerprints, FINGERPRINTS), "complete_columns": (complete_columns, COMPLETE),
    "manifest_attestation": (manifest_attestation, MANIFEST), "number_forms": (number_forms, NUMBER_FORMS), "carrier_pairs": (carrier_pairs, CARRIERS), "name_predicates": (name_predicates, PREDICATES),
}
