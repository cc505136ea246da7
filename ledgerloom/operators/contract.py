"""The contract between a decoder and the ledger: complete coverage, unique provenance, one snapshot.

coverage: one row per decoded table (table_id, recognized, handled): candidate rows found, and rows that came out as
postings or typed exclusions. dispositions: every row handled (table_id, source_row, disposition, ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.gates import require, require_none
from ledgerloom.operators.ledger import Ledger

CHECKS = ("duplicate_table", "coverage_mismatch", "materialized_count", "duplicate_provenance")
#: Tables whose lines may be carriers without a row, and those that may end in one empty surplus page.
CARRIER_TABLES, SURPLUS_TABLES = (3042,), (3047, 3078)


def coverage_violations(coverage: DataFrame, dispositions: DataFrame) -> DataFrame:
    """(check, key): tables registered twice, tables that did not handle all they recognized, tables whose rows are
    not as many as they attest, and source rows that came out twice. Each is a grouped count, combined map-side."""
    twice = coverage.groupBy("table_id").count().where("count > 1")
    short = coverage.where("recognized <> handled")
    rows = dispositions.groupBy("table_id").agg(F.count("*").alias("rows"))
    attested = coverage.groupBy("table_id").agg(F.sum("handled").alias("handled")).join(rows, "table_id", "full_outer")
    counts = attested.where("coalesce(handled, 0) <> coalesce(rows, 0)")
    again = dispositions.groupBy("source_row").count().where("count > 1")
    keyed = {"duplicate_table": twice.select("table_id"), "coverage_mismatch": short.select("table_id"), "materialized_count": counts.select("table_id"), "duplicate_provenance": again.select("source_row")}
    return reduce(DataFrame.unionByName, (rows.select(F.lit(check).alias("check"), F.col(rows.columns[0]).cast("string").alias("key")) for check, rows in keyed.items()))


def ledger_of(accounts: DataFrame, dispositions: DataFrame, coverage: DataFrame, snapshots: tuple[str, str]) -> Ledger:
    """The ledger of decoded accounts and dispositions, once their contract holds.

    snapshots: the digests of the file that accounts and dispositions were read from, which must be one. Postings become
    the ledger's postings, canonical zeros its non-monetary activity; other exclusions leave it.
    """
    require(snapshots[0] == snapshots[1], "snapshot_mismatch", f"{snapshots[0]} {snapshots[1]}")
    rank = F.array_position(F.array(*map(F.lit, CHECKS)), F.col("check")).cast("int")
    require_none(coverage_violations(coverage, dispositions).withColumn("rank", rank))
    rest = [c for c in dispositions.columns if c not in ("table_id", "disposition")]
    quiet = [c for c in rest if c != "signed_minor_units"]
    return Ledger(accounts, dispositions.where("disposition = 'posting'").select(*rest), dispositions.where("disposition = 'canonical_zero'").select(*quiet))


def is_complete() -> Column:
    """Whether a table's counters prove that it was read as a whole.

    Columns: table_id, unsupported, layout_pending, unresolved, decode_failures, disagreements, expected, resolved,
    row_carriers, surplus_groups, page_groups, pages and external_pages; expected and pages may be unknown (null), an
    unknown number of rows is never complete.
    """
    c = F.col
    rows = F.coalesce(c("resolved") + c("row_carriers") == c("expected"), F.lit(False))
    carriers = (c("row_carriers") == 0) | c("table_id").isin(*CARRIER_TABLES)
    surplus = (c("surplus_groups") == 0) | (c("table_id").isin(*SURPLUS_TABLES) & (c("surplus_groups") == 1) & (c("resolved") > 0))
    pages = c("pages").isNull() | (c("pages") + F.coalesce("external_pages", F.lit(0)) + c("surplus_groups") == c("page_groups"))
    clean = ~c("unsupported") & ~c("layout_pending") & (c("unresolved") == 0) & (c("decode_failures") == 0) & (c("disagreements") == 0)
    return clean & rows & carriers & surplus & pages


def coverage_lines(coverage: DataFrame) -> DataFrame:
    """(table_id, line): the counters of each table as one line of text."""
    names = ("expected", "resolved", "unresolved", "decode_failures", "disagreements")
    parts = [F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("unknown"))) for n in names]
    state = F.when(is_complete(), "complete").otherwise("incomplete")
    return coverage.select("table_id", F.concat_ws(" ", F.concat(F.lit("table="), "table_id"), state, *parts).alias("line"))


def selection_audit(active: DataFrame, reference: DataFrame) -> DataFrame:
    """(side, account_id): accounts that only the decoded active ones or only the reference has; none if the sets are the same."""
    a, b = active.select("account_id").distinct(), reference.select("account_id").distinct()
    one = a.join(b, "account_id", "left_anti").select(F.lit("only_active").alias("side"), "account_id")
    return one.unionByName(b.join(a, "account_id", "left_anti").select(F.lit("only_reference").alias("side"), "account_id"))


def same_set(left: DataFrame, right: DataFrame) -> bool:
    """Whether two frames with the same columns hold the same distinct rows."""
    return left.subtract(right).isEmpty() and right.subtract(left).isEmpty()


def stable_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, outcome): files read again: stable, changed (other digest or size), gone or new; sides: (path, size, digest)."""
    a, b = (side.select("path", F.struct("size", "digest").alias(n)) for side, n in ((before, "a"), (after, "b")))
    both = a.join(b, "path", "full_outer")
    outcome = F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "new").when(F.col("a") == F.col("b"), "stable").otherwise("changed")
    return both.select("path", outcome.alias("outcome"))
