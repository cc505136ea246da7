"""Queries over byte pages, codecs, section carry-forward and dispositions, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import codecs
from ledgerloom.functions.money import from_double
from ledgerloom.operators import dispositions, pages, snapshots
from ledgerloom.plans import fixtures as fx

MARKERS = ["token", "License", "the ", "und ", "que ", "###", " | ", "password"]
#: The edit that makes the second snapshot: every third document in capitals where it says 'the', every seventh lengthened.
_EDIT = "CASE WHEN doc_id % 3 = 0 THEN replace(text, 'the', 'THE') WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", "text")


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.expr(_EDIT).alias("text"))


def _pages(docs: DataFrame) -> DataFrame:
    return pages.split_pages(docs.select("doc_id", F.encode("text", "UTF-8").alias("content")))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changed_pages(_pages(_docs(spark, sf_dir)), _pages(_edited(spark, sf_dir)), ["doc_id", "page_number"])


def page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir)


def _sql_pages(name: str, text: str) -> str:
    return f"""{name} AS (SELECT doc_id, unnest(range(0, CAST(ceil(strlen({text}) / 4096.0) AS BIGINT))) AS page_number, hex(encode({text})) AS h FROM documents)"""


_HASH = "sha256(unhex(substr(h, page_number * 8192 + 1, 8192)))"
_DIFF = f"""WITH {_sql_pages("b", "text")}, {_sql_pages("a", _EDIT)},
c AS (SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, b.hash AS before_hash, a.hash AS after_hash
 FROM (SELECT doc_id, page_number, {_HASH} AS hash FROM b) b JOIN (SELECT doc_id, page_number, {_HASH} AS hash FROM a) a USING (doc_id, page_number) WHERE b.hash <> a.hash)"""


def control_subtraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of odd documents are noise; what stays of all changes after taking off that multiset."""
    changed = _changed(spark, sf_dir)
    return snapshots.subtract_control(changed, changed.where("doc_id % 2 = 1"), ["doc_id", "page_number"])


CONTROL = f"""{_DIFF}, noise AS (SELECT before_hash, after_hash, count(*) AS n FROM c WHERE doc_id % 2 = 1 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY before_hash, after_hash ORDER BY doc_id, page_number) AS nth FROM c)
SELECT doc_id, page_number, r.before_hash, r.after_hash FROM r LEFT JOIN noise ON r.before_hash = noise.before_hash AND r.after_hash = noise.after_hash WHERE n IS NULL OR nth > n"""


def marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.marker_counts(_docs(spark, sf_dir), "text", MARKERS)


_MARKERS = "(VALUES " + ", ".join(f"('{m}')" for m in MARKERS) + ") m(marker)"
MARKER_COUNTS = f"""WITH n AS (SELECT marker, (length(text) - length(replace(text, marker, ''))) // length(marker) AS n FROM documents, {_MARKERS})
SELECT marker, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS holders FROM n WHERE n > 0 GROUP BY marker"""


def marker_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.marker_clusters(_docs(spark, sf_dir), "text", MARKERS)


MARKER_CLUSTERS = f"""WITH c AS (SELECT doc_id, string_agg(marker, '+' ORDER BY marker) AS cluster FROM documents, {_MARKERS} WHERE contains(text, marker) GROUP BY doc_id)
SELECT cluster, count(*) AS n FROM c GROUP BY cluster"""


def removed_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.removed_markers(_docs(spark, sf_dir), _edited(spark, sf_dir), "doc_id", "text", ["the ", "THE", "!"])


REMOVED = f"""WITH x AS (SELECT marker, contains(text, marker) AS b, contains({_EDIT}, marker) AS a FROM documents, (VALUES ('the '), ('THE'), ('!')) m(marker))
SELECT marker, count(*) FILTER (b AND NOT a) AS removed, count(*) FILTER (b AND a) AS kept, count(*) FILTER (a AND NOT b) AS added FROM x GROUP BY marker"""


def entropy_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of every page in thousandths of a bit, and whether it counts as opaque."""
    bits = pages.entropy_bits(F.col("bytes"))
    rows = _pages(_docs(spark, sf_dir)).select("doc_id", "page_number", bits.alias("bits"))
    return rows.select("doc_id", "page_number", F.round(F.col("bits") * 1000).cast("int").alias("millibits"), (F.col("bits") >= pages.OPAQUE_BITS).alias("opaque"))


ENTROPY = f"""WITH {_sql_pages("b", "text")}, p AS (SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, substr(h, page_number * 8192 + 1, 8160) AS h FROM b),
e AS (SELECT doc_id, page_number, list_aggregate(list_transform(range(0, length(h) // 2), lambda i: substr(h, i * 2 + 1, 2)), 'entropy') AS bits FROM p)
SELECT doc_id, page_number, CAST(round(bits * 1000) AS INTEGER) AS millibits, bits >= {pages.OPAQUE_BITS} AS opaque FROM e"""


def adjacent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of neighbouring pages of a document, in kilobytes."""
    rows = _pages(_docs(spark, sf_dir)).select("doc_id", "page_number", F.ceil(F.length("bytes") / 1024).cast("int").alias("kb"))
    return pages.adjacent_pairs(rows, "doc_id", "kb")


ADJACENT = """WITH p AS (SELECT doc_id, strlen(text) AS s, unnest(range(0, CAST(ceil(strlen(text) / 4096.0) AS BIGINT))) AS n FROM documents),
k AS (SELECT doc_id, n, CAST(ceil(least(4096, s - n * 4096) / 1024.0) AS INTEGER) AS kb FROM p),
w AS (SELECT lag(kb) OVER (PARTITION BY doc_id ORDER BY n) AS before, kb AS after FROM k)
SELECT before, after, count(*) AS n FROM w WHERE before IS NOT NULL GROUP BY 1, 2"""


def carry_forward_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation under the last heading: the turns of the user, numbered."""
    rows = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    heading = F.when(F.col("role") == "user", F.concat(F.lit("user-"), "turn"))
    return snapshots.carry_forward(rows, ["conv_id"], ["turn"], heading, "section")


CARRY = """SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN 'user-' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations"""


def amount_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line amounts packed into four bytes and decoded, unsigned and signed."""
    cents, kind = from_double(F.col("l_extendedprice")), F.when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "A", 1).otherwise(3)
    raw = F.concat(codecs.hex_bytes(kind, 1), codecs.hex_bytes(cents % (1 << 24), 3, little=True))
    rows = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (cents % (1 << 24)).alias("low"), raw.alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", "low", codecs.line_amount(F.col("raw")).alias("cents"), codecs.line_amount_signed(F.col("raw")).alias("signed"))


AMOUNT = """WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) % 16777216 AS low FROM lineitem)
SELECT l_orderkey, l_linenumber, low, CASE WHEN l_returnflag IN ('N', 'A') THEN low END AS cents,
CASE WHEN l_returnflag IN ('N', 'A') THEN CASE WHEN low % 256 >= 128 THEN -(low - 128) ELSE low END END AS signed FROM x"""


def balance_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances through the six-byte and the base-100 codec and back."""
    cents = from_double(F.col("c_acctbal"))
    rows = fx.table(spark, sf_dir, "customer").select("c_custkey", cents.alias("cents"))
    legacy, token = codecs.legacy_bytes(F.col("cents")), codecs.base100_token(F.col("cents"))
    made = rows.select("c_custkey", "cents", legacy.alias("legacy"), token.alias("token"))  # made once; decoding reads them many times
    return made.select("c_custkey", "cents", codecs.legacy_cents(F.col("legacy")).alias("legacy_cents"), codecs.base100_cents(F.col("token")).alias("base100_cents"), F.hex("legacy").alias("legacy"))


BALANCES = """WITH x AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer)
SELECT c_custkey, cents, cents AS legacy_cents, cents AS base100_cents,
printf('%02X', abs(cents) % 100) || CASE WHEN cents < 0 THEN '02' ELSE '00' END || printf('%08X', abs(cents) // 100) AS legacy FROM x"""


def leb128_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "part").select((F.col("p_partkey") * 37).alias("number"))
    return rows.select("number", F.hex(codecs.leb128(F.col("number"))).alias("leb128"), F.hex(codecs.hex_bytes(F.col("number"), 4)).alias("big"), F.hex(codecs.hex_bytes(F.col("number"), 4, True)).alias("little"))


LEB128 = """WITH x AS (SELECT p_partkey * 37 AS number FROM part)
SELECT number, CASE WHEN number < 128 THEN printf('%02X', number) WHEN number < 16384 THEN printf('%02X%02X', number % 128 + 128, number // 128)
 ELSE printf('%02X%02X%02X', number % 128 + 128, number // 128 % 128 + 128, number // 16384) END AS leb128, printf('%08X', number) AS big,
 printf('%02X%02X%02X%02X', number % 256, number // 256 % 256, number // 65536 % 256, number // 16777216) AS little FROM x"""


def sparse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sparse records (flag, key, name, end mark), parsed back; every eleventh is cut short."""
    rows = fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    data = F.concat(F.lit(b"\x00"), F.lit(b"\x01\x00"), codecs.hex_bytes(F.col("s_suppkey"), 4, True), F.lit(b"\x03\x00"), F.encode("s_name", "UTF-8"), F.lit(b"\x00\xff\xff"))
    cut = F.when(F.col("s_suppkey") % 11 == 0, F.substring(data, F.lit(1), F.length(data) - 1)).otherwise(data)
    parse = codecs.records_of({1: codecs.Field("L"), 3: codecs.Field("S", 64)})
    found = rows.select("s_suppkey", parse(cut).alias("r"))
    return found.select("s_suppkey", F.col("r")[1].alias("key"), F.col("r")[3].alias("name"))


RECORDS = "SELECT s_suppkey, CASE WHEN s_suppkey % 11 <> 0 THEN CAST(s_suppkey AS VARCHAR) END AS key, CASE WHEN s_suppkey % 11 <> 0 THEN s_name END AS name FROM supplier"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.expr("CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 0 ELSE cast(round(l_extendedprice * 100) AS bigint) * CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END END")
    rows = fx.table(spark, sf_dir, "lineitem").withColumn("amount", amount)
    return rows.withColumn("disposition", dispositions.disposition(F.col("l_partkey") % 13 == 0, F.col("l_partkey") % 17 == 0, F.col("l_suppkey") % 2 == 0, F.col("amount")))


def disposition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispositions.coverage(_rows(spark, sf_dir))


DISPOSITIONS = """WITH x AS (SELECT *, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 0 ELSE 1 END AS amount FROM lineitem)
SELECT CASE WHEN l_partkey % 13 = 0 THEN 'no_post' WHEN l_partkey % 17 = 0 THEN 'memorized' WHEN l_suppkey % 2 = 0 AND amount IS NULL THEN 'source'
 WHEN amount IS NULL THEN 'invalid' WHEN amount = 0 THEN 'canonical_zero' ELSE 'posting' END AS disposition, count(*) AS n FROM x GROUP BY 1"""


def family_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select(F.col("l_orderkey").alias("master"), F.expr("l_orderkey % 9 + CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END").alias("date"), F.col("l_linestatus").alias("kind"), F.col("l_returnflag").alias("flags"), F.coalesce("amount", F.lit(0)).alias("amount"))
    return dispositions.family_gates(rows, "master")


FAMILIES = """WITH x AS (SELECT l_orderkey AS master, l_orderkey % 9 + CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END AS date, l_linestatus AS kind, l_returnflag AS flags,
 CASE WHEN l_linenumber IN (3, 4) THEN 0 ELSE CAST(round(l_extendedprice * 100) AS BIGINT) * CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END END AS amount FROM lineitem),
e AS (SELECT master, count(*) AS lines, count(DISTINCT date) = 1 AS one_date, count(DISTINCT kind) = 1 AS one_kind, count(DISTINCT flags) = 1 AS one_flags, bool_or(amount = 0) AS has_zero, CAST(sum(amount) AS BIGINT) AS net FROM x GROUP BY 1)
SELECT *, one_flags AND (NOT has_zero OR (one_date AND one_kind AND net = 0)) AS ok FROM e"""


def link_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chains: node n of a customer links to the next order of that customer; the last one is terminal unless its key is odd."""
    nodes = fx.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS master", "o_orderkey AS node", "lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next"
    ).selectExpr("master", "node", "next", "next IS NULL AND node % 2 = 0 AS is_terminal")
    return dispositions.resolve_links(nodes)


CHAINS = """SELECT o_custkey AS master, o_orderkey AS node, CASE WHEN max(o_orderkey) OVER (PARTITION BY o_custkey) % 2 = 0 THEN max(o_orderkey) OVER (PARTITION BY o_custkey) END AS terminal FROM orders"""

QUERIES = {
    "page_diff": (page_diff, f"{_DIFF} SELECT * FROM c"), "control_subtraction": (control_subtraction, CONTROL), "marker_counts": (marker_counts, MARKER_COUNTS),
    "marker_clusters": (marker_clusters, MARKER_CLUSTERS), "removed_markers": (removed_markers, REMOVED), "entropy_opaque": (entropy_opaque, ENTROPY), "adjacent_pages": (adjacent_pages, ADJACENT),
    "carry_forward_sections": (carry_forward_sections, CARRY), "amount_decode": (amount_decode, AMOUNT), "balance_codecs": (balance_codecs, BALANCES), "leb128_forms": (leb128_forms, LEB128),
    "sparse_records": (sparse_records, RECORDS), "disposition_counts": (disposition_counts, DISPOSITIONS), "family_gates": (family_gates, FAMILIES), "link_chains": (link_chains, CHAINS),
}
