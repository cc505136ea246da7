"""Snapshots: page differences, control subtraction, transitions, markers and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed_pages(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, before_hash, after_hash of pages that differ; both sides are digests by the time they are shuffled."""
    digest = lambda rows, name: rows.select(*keys, F.sha2("bytes", 256).alias(name))
    return digest(before, "before_hash").join(digest(after, "after_hash"), keys).where("before_hash <> after_hash")


def transitions(changed: DataFrame, before: str, after: str) -> DataFrame:
    return changed.groupBy(before, after).agg(F.count("*").alias("n"))


#: Values of the first ordering column that one task orders together.
RANGE = 4096


def subtract_control(changed: DataFrame, control: DataFrame, order: list[str]) -> DataFrame:
    """changed without min(observed, control) rows per hash pair, taken off in the order of `order` (the first of it a number).

    A pair that very many pages share, as zeroed pages do, is ranked range by range: rows are numbered inside
    ranges of the first ordering column, and the ranges before a range count on. Only pairs in the control are ranked.
    """
    pair = ["before_hash", "after_hash"]
    noise = control.groupBy(*pair).agg(F.count("*").alias("__noise"))
    rows = changed.join(noise, pair, "left").withColumn("__range", F.floor(F.col(order[0]) / RANGE))
    kept, noisy = rows.where("__noise is null"), rows.where("__noise is not null")
    sizes = noisy.groupBy(*pair, "__range").agg(F.count("*").alias("__rows"))
    ahead = Window.partitionBy(*pair).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__ahead", F.coalesce(F.sum("__rows").over(ahead), F.lit(0))).drop("__rows")
    nth = F.row_number().over(Window.partitionBy(*pair, "__range").orderBy(*order)) + F.col("__ahead")
    left = noisy.join(offsets, [*pair, "__range"]).withColumn("__nth", nth).where("__nth > __noise")
    return kept.select(*changed.columns).unionByName(left.select(*changed.columns))


def occurrences(text: Column, marker: Column) -> Column:
    """How often a marker stands in a text, without overlap."""
    return F.when(F.length(marker) > 0, ((F.length(text) - F.length(F.replace(text, marker, F.lit("")))) / F.length(marker)).cast("bigint")).otherwise(0)


def marker_counts(texts: DataFrame, text: str, markers: list[str]) -> DataFrame:
    """(marker, occurrences, holders) of a stated, short list of markers; one pass over the texts."""
    each = texts.select(F.explode(F.array(*(F.struct(F.lit(m).alias("marker"), occurrences(F.col(text), F.lit(m)).alias("n")) for m in markers))).alias("m"))
    return each.where("m.n > 0").groupBy("m.marker").agg(F.sum("m.n").alias("occurrences"), F.count("*").alias("holders"))


def marker_clusters(texts: DataFrame, text: str, markers: list[str]) -> DataFrame:
    """(cluster, n): which markers stand together, and in how many texts."""
    held = F.filter(F.array(*map(F.lit, sorted(markers))), lambda m: F.contains(F.col(text), m))
    return texts.select(F.array_join(held, "+").alias("cluster")).where("cluster <> ''").groupBy("cluster").agg(F.count("*").alias("n"))


def removed_markers(before: DataFrame, after: DataFrame, key: str, text: str, markers: list[str]) -> DataFrame:
    """(marker, removed, kept, added): keys whose text loses, keeps or gains each marker."""
    both = before.select(key, F.col(text).alias("b")).join(after.select(key, F.col(text).alias("a")), key)
    each = both.select(F.explode(F.array(*(F.struct(F.lit(m).alias("marker"), F.contains("b", F.lit(m)).alias("b"), F.contains("a", F.lit(m)).alias("a")) for m in markers))).alias("m"))
    return each.groupBy("m.marker").agg(
        F.count_if(F.expr("m.b and not m.a")).alias("removed"), F.count_if(F.expr("m.b and m.a")).alias("kept"), F.count_if(F.expr("m.a and not m.b")).alias("added"),
    )


def carry_forward(rows: DataFrame, partition: list[str], order: list[str], heading: Column, name: str) -> DataFrame:
    """rows with the last heading at or before them in their group, ordered by `order` (the first of it a number).

    Rows are ordered inside ranges of the first ordering column; a range without a heading of its own takes the last
    one of the ranges before it, so a group of any size is dealt over many tasks.
    """
    rows = rows.withColumns({"__own": heading, "__range": F.floor(F.col(order[0]) / RANGE)})
    inside = Window.partitionBy(*partition, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where("__own is not null").groupBy(*partition, "__range").agg(F.max_by("__own", F.struct(*order)).alias("__last"))
    ranges = rows.select(*partition, "__range").distinct().join(last, [*partition, "__range"], "left")
    before = Window.partitionBy(*partition).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    lead = ranges.withColumn("__lead", F.last("__last", ignorenulls=True).over(before)).drop("__last")
    found = rows.withColumn("__in", F.last("__own", ignorenulls=True).over(inside)).join(lead, [*partition, "__range"])
    return found.withColumn(name, F.coalesce("__in", "__lead")).drop("__own", "__range", "__in", "__lead")
