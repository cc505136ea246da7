"""Line items and transaction headers: export, verification, forensics and interchange text.

Line items: invoice_id, page_number, page_offset, item_id, amount_type (0 none, 1 deferred, 2 positive, 3 negative),
amount_cents, amount_cents_signed, txn_date_raw, counter, source_table. Headers: qb_id, source_table, txn_date_raw,
counter, page_number, page_offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.labels import header_type
from ledgerloom.functions.money import format_cents

DEFERRED = 1


def _at():
    return F.struct("page_number", "page_offset")


def _first(column: str):
    """The first non-null value in physical order, by a map-side arg-min."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), _at()))


def first_headers(headers: DataFrame) -> DataFrame:
    """One header per id, the first in physical order."""
    row = F.struct("source_table", "txn_date_raw", "counter", "page_number")
    return headers.groupBy("qb_id").agg(F.min_by(row, _at()).alias("h")).select("qb_id", "h.*")


def export_transactions(headers: DataFrame, items: DataFrame) -> DataFrame:
    """A row per transaction: headers with the sums of their lines, and synthesised `unknown` rows for lines without header."""
    lines = items.groupBy("invoice_id").agg(
        F.count("*").alias("line_count"), F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("total_cents"),
        F.max((F.col("amount_type") == DEFERRED).cast("int")).alias("has_deferred"), _first("txn_date_raw").alias("l_date"),
        _first("counter").alias("l_counter"), _first("source_table").alias("l_source"), F.min_by("page_number", _at()).alias("l_page"),
    )
    both = first_headers(headers).join(lines, F.col("qb_id") == F.col("invoice_id"), "full_outer")
    known = F.col("qb_id").isNotNull()
    pick = lambda h, li: F.when(known, F.col(h)).otherwise(F.col(li))
    zero = F.lit(0)
    return both.select(
        F.coalesce("qb_id", "invoice_id").alias("qb_id"), F.when(known, header_type(F.col("source_table"))).otherwise("unknown").alias("type"),
        F.coalesce(pick("source_table", "l_source"), F.lit("")).alias("source_table"), pick("txn_date_raw", "l_date").alias("txn_date_raw"),
        pick("counter", "l_counter").alias("counter"), F.coalesce("line_count", zero).cast("bigint").alias("line_count"),
        F.coalesce("total_cents", zero).cast("bigint").alias("total_cents"), F.coalesce("has_deferred", zero).alias("has_deferred"),
        pick("page_number", "l_page").alias("source_page"),
    )


def export_line_items(items: DataFrame) -> DataFrame:
    """items with line_number: 1, 2, ... in physical order within (parent, source table)."""
    order = Window.partitionBy("invoice_id", F.coalesce("source_table", F.lit(""))).orderBy("page_number", "page_offset")
    return items.withColumn("line_number", F.row_number().over(order))


def export_stats(transactions: DataFrame) -> DataFrame:
    return transactions.agg(
        F.count("*").alias("transactions"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"),
        F.coalesce(F.sum("total_cents"), F.lit(0)).alias("total_cents"), F.count_if(F.col("type") == "unknown").alias("synthesized"),
    )


def counts_by(rows: DataFrame, key: str, cents: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.coalesce(F.sum(cents), F.lit(0)).alias("total_cents"))


def grand_totals(items: DataFrame) -> DataFrame:
    """(parents, total_cents): distinct parents are counted over pre-aggregated ones."""
    each = items.groupBy("invoice_id").agg(F.sum("amount_cents").alias("t"))
    return each.agg(F.count("*").alias("parents"), F.coalesce(F.sum("t"), F.lit(0)).alias("total_cents"))


def top_sources(items: DataFrame, n: int = 10) -> DataFrame:
    """The n source tables with most distinct parents; ties by name."""
    each = items.select("source_table", "invoice_id").distinct().groupBy("source_table").agg(F.count("*").alias("parents"))
    return each.orderBy(F.desc("parents"), "source_table").limit(n)


def parent_pairs(items: DataFrame) -> DataFrame:
    """One row: parents with exactly two lines of one type, and how many of these net to nothing; the same for all parents."""
    each = items.groupBy("invoice_id").agg(
        F.count("*").alias("n"), F.min("amount_type").alias("low"), F.max("amount_type").alias("high"), F.coalesce(F.sum("amount_cents_signed"), F.lit(0)).alias("net"),
    )
    pair = (F.col("n") == 2) & (F.col("low") == F.col("high"))
    return each.agg(
        F.count_if(pair).alias("pairs"), F.count_if(pair & (F.col("net") == 0)).alias("balanced_pairs"),
        F.count("*").alias("parents"), F.count_if(F.col("net") == 0).alias("balanced_parents"),
    )


def orphans(headers: DataFrame, items: DataFrame) -> DataFrame:
    """One row: parents without header, headers without lines, and both together."""
    tagged = headers.select(F.col("qb_id").alias("id"), F.lit(1).alias("h"), F.lit(0).alias("l")).union(items.select("invoice_id", F.lit(0), F.lit(1)))
    each = tagged.groupBy("id").agg(F.max("h").alias("h"), F.max("l").alias("l"))
    return each.agg(
        F.count_if(F.expr("h = 0")).alias("parents_without_header"), F.count_if(F.expr("l = 0")).alias("headers_without_lines"),
        F.count_if(F.expr("h = 1 and l = 1")).alias("complete"),
    )


def interchange_lines(items: DataFrame) -> DataFrame:
    """(parent, nth, line): tab-separated TRNS, SPL and ENDTRNS lines of every parent, splits in physical order.

    Written as text with lineSep '\\r\\n' in order of parent and nth.
    """
    w = Window.partitionBy("invoice_id").orderBy("page_number", "page_offset", "amount_cents_signed")
    spl = items.withColumn("nth", F.row_number().over(w))
    cents = F.coalesce("amount_cents_signed", F.lit(0).cast("bigint"))
    lines = spl.select(F.col("invoice_id").alias("parent"), "nth", F.concat_ws("\t", F.lit("SPL"), F.col("nth").cast("string"), F.coalesce("source_table", F.lit("")), format_cents(-cents)).alias("line"))
    each = items.groupBy(F.col("invoice_id").alias("parent")).agg(F.count("*").alias("n"), F.sum(cents).alias("t"), F.min_by("source_table", _at()).alias("s"))
    head = each.select("parent", F.lit(0).alias("nth"), F.concat_ws("\t", F.lit("TRNS"), F.col("parent"), F.coalesce("s", F.lit("")), format_cents(F.col("t"))).alias("line"))
    tail = each.select("parent", (F.col("n") + 1).cast("int").alias("nth"), F.lit("ENDTRNS").alias("line"))
    return head.unionByName(lines).unionByName(tail)
