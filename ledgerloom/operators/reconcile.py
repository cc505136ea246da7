"""Reconciliation: account by account, posting by posting as multisets, and the resolution of report labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import leaf, without_number
from ledgerloom.functions.money import wide_sum
from ledgerloom.operators.gates import bounded_broadcast, require_none


def trial_balances(reference: DataFrame, actual: DataFrame) -> DataFrame:
    """(label, outcome, reference_cents, actual_cents, variance_cents) of every account of either side.

    Sides: (label, cents). outcome: match, missing (not in actual), extra (not in reference) or mismatch;
    variance is actual less reference, an absent side counting as 0. A repeated label on one side raises.
    """
    for side in (reference, actual):
        twice = side.groupBy("label").count().where("count > 1")
        require_none(twice.select(F.lit(0).alias("rank"), F.lit("duplicate_label").alias("check"), F.col("label").alias("key")))
    a, b = reference.select("label", F.col("cents").alias("reference_cents")), actual.select("label", F.col("cents").alias("actual_cents"))
    both = a.join(b, "label", "full_outer")
    outcome = (
        F.when(F.col("actual_cents").isNull(), "missing").when(F.col("reference_cents").isNull(), "extra")
        .when(F.col("actual_cents") != F.col("reference_cents"), "mismatch").otherwise("match")
    )
    zero = F.lit(0).cast("bigint")
    variance = F.coalesce("actual_cents", zero) - F.coalesce("reference_cents", zero)
    return both.select("label", outcome.alias("outcome"), "reference_cents", "actual_cents", variance.alias("variance_cents"))


def totals(compared: DataFrame) -> DataFrame:
    """One row: accounts by outcome, both sides' totals and the largest absolute variance."""
    count = {f"n_{o}": F.count_if(F.col("outcome") == o) for o in ("match", "missing", "extra", "mismatch")}
    return compared.agg(
        *(c.alias(n) for n, c in count.items()),
        *(F.coalesce(wide_sum(F.col(c)), F.lit(0)).cast("bigint").alias(c) for c in ("reference_cents", "actual_cents", "variance_cents")),
        F.coalesce(F.max(F.abs("variance_cents")), F.lit(0)).alias("max_abs_variance"),
    )


def passes(compared: DataFrame) -> bool:
    return compared.where("outcome <> 'match'").isEmpty()


def diagnostics(compared: DataFrame) -> DataFrame:
    """(class, line): one text line per deviation; missing accounts first, then extra ones, then mismatches, by label."""
    rank = F.when(F.col("outcome") == "missing", 0).when(F.col("outcome") == "extra", 1).otherwise(2)
    line = F.concat_ws(" ", "outcome", "label", F.concat(F.lit("variance="), "variance_cents"))
    return compared.where("outcome <> 'match'").select(rank.alias("class"), "label", line.alias("line")).orderBy("class", "label")


def multiset_match(reference: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reference_n, actual_n, matched, missing, extra) per distinct key with multiplicity.

    Both sides are tagged and counted in one shuffle with map-side sums, so a very common key is one row per task.
    """
    tagged = reference.select(*keys, F.lit(1).alias("r"), F.lit(0).alias("a")).union(actual.select(*keys, F.lit(0), F.lit(1)))
    n = tagged.groupBy(*keys).agg(F.sum("r").alias("reference_n"), F.sum("a").alias("actual_n"))
    r, a = F.col("reference_n"), F.col("actual_n")
    return n.withColumns({"matched": F.least(r, a), "missing": F.greatest(r - a, F.lit(0)), "extra": F.greatest(a - r, F.lit(0))})


def multiset_totals(matched: DataFrame) -> DataFrame:
    return matched.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matched", "missing", "extra")))


def posting_keys(reference: DataFrame, actual: DataFrame) -> list[str]:
    """Keys of a posting comparison: the transaction type takes part only if every row of both sides has one."""
    typed = all(not side.isEmpty() and side.where("transaction_type is null").isEmpty() for side in (reference, actual))
    return ["account_full_name", "date", "signed_minor_units", *(["transaction_type"] if typed else [])]


def distinct_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(shared, left_only, right_only): distinct values of key."""
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(key, F.lit(0), F.lit(1)))
    each = tagged.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return each.agg(
        F.count_if(F.expr("l = 1 and r = 1")).alias("shared"), F.count_if(F.expr("l = 1 and r = 0")).alias("left_only"),
        F.count_if(F.expr("l = 0 and r = 1")).alias("right_only"),
    )


def _unique(chart: DataFrame, key: Column, name: str) -> DataFrame:
    """(key, n, id): how many accounts a label means, and one of them."""
    return chart.groupBy(key.alias(f"{name}_key")).agg(F.count("*").alias(f"{name}_n"), F.min("account_id").alias(f"{name}_id")).where(F.col(f"{name}_key").isNotNull())


def resolve_labels(labels: DataFrame, chart: DataFrame) -> DataFrame:
    """(label, account_id, resolved_by) for each distinct label.

    chart: account_id, account_name, account_full_name, account_display_name. Tried in turn: the full name, the
    display name, the account name (without number prefix; then its leaf), that name without ' - Other', the
    leaf as a full name. A display or account name that means several accounts is `ambiguous`; an ambiguous
    ' - Other' or leaf leaves the label `unresolved`, for the control-section proof.
    """
    rows = labels.select("label").distinct().withColumn("bare", without_number(F.col("label")))
    rows = rows.withColumns({"leaf": leaf(F.col("bare")), "other": F.when(F.col("bare").endswith(" - Other"), F.regexp_replace("bare", " - Other$", "")), "raw_leaf": leaf(F.col("label"))})
    name = F.col("account_name")
    for col, by, at in (
        ("full", F.col("account_full_name"), "label"), ("shown", F.col("account_display_name"), "label"), ("name", name, "bare"),
        ("leafname", name, "leaf"), ("othername", name, "other"), ("leaffull", F.col("account_full_name"), "raw_leaf"),
    ):
        rows = rows.join(bounded_broadcast(_unique(chart, by, col)), F.col(at) == F.col(f"{col}_key"), "left")
    has = lambda c: F.col(f"{c}_n").isNotNull()
    one = lambda c: F.coalesce(F.col(f"{c}_n") == 1, F.lit(False))
    by = (
        F.when(has("full"), "full_name")
        .when(has("shown"), F.when(one("shown"), "display_name").otherwise("ambiguous"))
        .when(has("name"), F.when(one("name"), "account_name").otherwise("ambiguous"))
        .when(has("leafname"), F.when(one("leafname"), "leaf_name").otherwise("ambiguous"))
        .when(one("othername"), "other_suffix")
        .when(one("leaffull"), "leaf_full_name")
        .otherwise("unresolved")
    )
    ids = {"full_name": "full", "display_name": "shown", "account_name": "name", "leaf_name": "leafname", "other_suffix": "othername", "leaf_full_name": "leaffull"}
    found = F.coalesce(*(F.when(F.col("resolved_by") == k, F.col(f"{c}_id")) for k, c in ids.items()))
    return rows.withColumn("resolved_by", by).select("label", found.alias("account_id"), "resolved_by")


def control_sections(unresolved: DataFrame, generated: DataFrame) -> DataFrame:
    """(label, account_id): unresolved sections whose movements are exactly those of one payables account.

    Both: (section or account id as `owner`, date, kind, cents). A section must hold both a bill and a bill payment, and
    match one account. Candidates are found by the number and the summed hashes of the counted movements, which
    combine map-side whatever an owner's size; a candidate stands if both sides' counted movements are the same rows.
    """
    item = ["date", "kind", "cents"]

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("owner", *item).agg(F.count("*").alias("n"))

    def digests(rows: DataFrame) -> DataFrame:
        sums = [F.sum(F.xxhash64(F.lit(k), *item, "n").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
        return rows.groupBy("owner").agg(
            F.count("*").alias("items"), *sums, F.max((F.col("kind") == "bill").cast("int")).alias("bill"),
            F.max((F.col("kind") == "bill-pmt-check").cast("int")).alias("paid"), F.bool_and(F.col("kind").isNotNull()).alias("known"),
        )

    left, right, key = counted(unresolved), counted(generated), ["items", "s1", "s2"]
    wanted = digests(left).where("bill = 1 and paid = 1 and known").select(F.col("owner").alias("label"), *key)
    found = wanted.join(digests(right).where("known").select(F.col("owner").alias("account_id"), *key), key)
    same = found.join(left.withColumnRenamed("owner", "label"), "label").join(right.withColumnRenamed("owner", "account_id"), ["account_id", *item, "n"])
    proven = same.groupBy("label", "account_id", "items").agg(F.count("*").alias("met")).where("met = items")
    return proven.groupBy("label").agg(F.count("*").alias("n"), F.min("account_id").alias("account_id")).where("n = 1").select("label", "account_id")


def report_agreement(trial: DataFrame, ledger_rows: DataFrame) -> DataFrame:
    """(account_id, tb_cents, gl_cents): accounts whose Trial Balance and General Ledger disagree; absent is 0."""
    gl = ledger_rows.groupBy("account_id").agg(wide_sum(F.col("signed_minor_units")).cast("bigint").alias("gl_cents"))
    zero = F.lit(0).cast("bigint")
    both = trial.select("account_id", F.col("net_cents").alias("tb_cents")).join(gl, "account_id", "full_outer")
    both = both.select("account_id", F.coalesce("tb_cents", zero).alias("tb_cents"), F.coalesce("gl_cents", zero).alias("gl_cents"))
    return both.where("tb_cents <> gl_cents")
