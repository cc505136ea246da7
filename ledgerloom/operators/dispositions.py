"""Recognised rows to postings or typed exclusions, family gates, and link chains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import wide_sum
from ledgerloom.operators.lineage import cut


def disposition(no_post: Column, memorized: Column, is_source: Column, amount: Column) -> Column:
    """The first that applies: no_post, memorized, source (without amount), invalid (no amount), canonical_zero, posting."""
    return (
        F.when(F.coalesce(no_post, F.lit(False)), "no_post").when(F.coalesce(memorized, F.lit(False)), "memorized")
        .when(F.coalesce(is_source, F.lit(False)) & amount.isNull(), "source").when(amount.isNull(), "invalid").when(amount == 0, "canonical_zero").otherwise("posting")
    )


def account_lifecycle(deleted: Column, delete_pending: Column, internal: Column) -> Column:
    return F.when(deleted, "deleted").when(delete_pending, "delete_pending").when(internal, "internal").otherwise("included")


def normalized(rows: DataFrame, identity: DataFrame, table: str) -> DataFrame:
    """Postings with synthetic ids from rows of (record, transaction_number, account_number, amount, disposition);
    identity: (account_number, account_id). An account number that is not in it is left to `unidentified`."""
    kept = rows.where("disposition = 'posting'").join(identity, "account_number")
    txn = F.concat(F.lit("txn-"), "transaction_number")
    return kept.select(
        txn.alias("transaction_id"), F.concat(F.lit("line-"), F.lit(table), F.lit("-"), "record").alias("posting_id"), "account_id",
        F.when(F.col("amount") > 0, "debit").otherwise("credit").alias("side"), F.abs("amount").alias("cents"),
        F.concat_ws(":", F.lit(table), F.col("page").cast("string"), F.col("record").cast("string")).alias("source_row"),
    )


def unidentified(rows: DataFrame, identity: DataFrame) -> DataFrame:
    return rows.where("disposition = 'posting'").join(identity, "account_number", "left_anti").select("record", "account_number")


def coverage(rows: DataFrame) -> DataFrame:
    """(disposition, n)."""
    return rows.groupBy("disposition").agg(F.count("*").alias("n"))


def family_gates(rows: DataFrame, master: str) -> DataFrame:
    """One row per master: lines, whether dates, kinds and flags agree, whether any line is a zero, the net, and ok:
    families with zeros must have one date and kind and net to nothing; all must agree in their flags."""
    each = rows.groupBy(master).agg(
        F.count("*").alias("lines"), (F.min("date") == F.max("date")).alias("one_date"), (F.min("kind") == F.max("kind")).alias("one_kind"),
        (F.min("flags") == F.max("flags")).alias("one_flags"), F.bool_or(F.col("amount") == 0).alias("has_zero"), wide_sum(F.col("amount")).cast("bigint").alias("net"),
    )
    settled = F.col("one_date") & F.col("one_kind") & (F.col("net") == 0)
    return each.withColumn("ok", F.col("one_flags") & (~F.col("has_zero") | settled))


def resolve_links(nodes: DataFrame) -> DataFrame:
    """(master, node, terminal): follows `next` links inside a master until a terminal node (is_terminal); null if a link
    leaves the master, ends elsewhere or runs in a cycle. Pointers double, so a chain of n takes log n joins; a link
    that is open after as many steps as there are nodes is in a cycle."""
    base = nodes.select("master", "node", "is_terminal", F.when(~F.col("is_terminal"), F.col("next")).alias("to"))
    table = cut(base.select("master", "node", F.when(F.col("is_terminal"), F.col("node")).alias("terminal"), "to"))
    longest = table.groupBy("master").count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(2, longest))) + 1):
        if table.where("to is not null").isEmpty():
            break
        ahead = table.select("master", F.col("node").alias("to"), F.col("terminal").alias("t2"), F.col("to").alias("to2"))
        moved = table.where("to is not null").join(ahead, ["master", "to"], "left")
        moved = moved.select("master", "node", F.col("t2").alias("terminal"), F.col("to2").alias("to"))
        table = cut(table.where("to is null").unionByName(moved))
    return table.select("master", "node", "terminal")
