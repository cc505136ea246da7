"""Account hierarchies: validation, full names and display names.

Parents are followed for all accounts at once by doubling pointers: after k steps every account holds its next
2**k ancestors, so a chart of depth d takes about log d joins of a table as small as the chart. Whoever still has an
ancestor to follow after as many steps as the number of accounts needs stands in a cycle or below one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.gates import require_none
from ledgerloom.operators.lineage import cut


def _doubled(table: DataFrame, carried: dict[str, str]) -> DataFrame:
    """table (account_id, next, ...) with next followed until it is null, or as often as its rows allow.

    carried: an expression for each further column, from its own value and that of the account at next, named up_<column>.
    """
    table = cut(table)
    rounds = math.ceil(math.log2(max(2, table.count()))) + 1
    for _ in range(rounds):
        moving = table.where("next is not null")
        if moving.isEmpty():
            break
        ahead = table.select(F.col("account_id").alias("next"), F.col("next").alias("up_next"), *(F.col(c).alias(f"up_{c}") for c in carried))
        moved = moving.join(ahead, "next").select("account_id", F.col("up_next").alias("next"), *(F.expr(e).alias(c) for c, e in carried.items()))
        table = cut(table.where("next is null").unionByName(moved))
    return table


def _parents(accounts: DataFrame) -> DataFrame:
    """(account_id, next): the parent of each account, null if it is none of the chart's other accounts."""
    known = accounts.select(F.col("account_id").alias("next")).distinct()
    own = accounts.groupBy("account_id").agg(F.min("parent_account_id").alias("next"))
    return own.where("next is null or next = account_id").select("account_id", F.lit(None).cast("string").alias("next")).unionByName(
        own.where("next <> account_id").join(known.withColumn("met", F.lit(True)), "next", "left").select("account_id", F.when(F.col("met"), F.col("next")).alias("next"))
    )


def cyclic_accounts(accounts: DataFrame) -> DataFrame:
    """(account_id): accounts in a cycle of parents, or below one; an account that is its own parent is not meant."""
    return _doubled(_parents(accounts), {}).where("next is not null").select("account_id")


def hierarchy_violations(accounts: DataFrame) -> DataFrame:
    """(check, key): accounts that are their own parent, name an unknown one, or stand in a cycle or below one."""
    base = accounts.select("account_id", "parent_account_id").where("parent_account_id is not null")
    known = accounts.select(F.col("account_id").alias("parent_account_id")).distinct()
    itself = base.where("account_id = parent_account_id").select(F.lit("self_parent").alias("check"), F.col("account_id").alias("key"))
    unknown = base.join(known, "parent_account_id", "left_anti").select(F.lit("unknown_parent").alias("check"), F.col("account_id").alias("key"))
    return itself.unionByName(unknown).unionByName(cyclic_accounts(accounts).select(F.lit("hierarchy_cycle").alias("check"), F.col("account_id").alias("key")))


def names(accounts: DataFrame, validate: bool = True) -> DataFrame:
    """(account_id, account_full_name, account_display_name).

    The full name joins the names from the root with ':'. The display name puts the account's number, or that
    of its nearest numbered ancestor, before it. Without validation a name starts below a parent that is unknown, and
    accounts in a cycle or below one are named by themselves alone.
    """
    if validate:
        rank = F.when(F.col("check") == "self_parent", 0).when(F.col("check") == "unknown_parent", 1).otherwise(2)
        require_none(hierarchy_violations(accounts).withColumn("rank", rank))
    parents = _parents(accounts)
    if not validate:
        endless = cyclic_accounts(accounts).withColumn("endless", F.lit(True))
        parents = parents.join(endless, "account_id", "left").select("account_id", F.when(F.col("endless").isNull(), F.col("next")).alias("next"))
    base = accounts.groupBy("account_id").agg(F.min(F.struct("account_name", "account_number")).alias("a"))
    table = base.join(parents, "account_id").select("account_id", "next", F.array("a.account_name").alias("names"), F.col("a.account_number").alias("number"))
    table = _doubled(table, {"names": "concat(up_names, names)", "number": "coalesce(number, up_number)"})
    full = F.array_join("names", ":")
    shown = F.when(F.col("number").isNotNull(), F.concat("number", F.lit(" · "), full)).otherwise(full)
    return table.select("account_id", full.alias("account_full_name"), shown.alias("account_display_name"))
