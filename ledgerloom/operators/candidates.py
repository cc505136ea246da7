"""Agreement among the candidate decodings of a page or row, and what is proven by it.

A page may decode under several candidate keys or layouts. Nothing is chosen by preference: a record, a key, a layout or
a ledger stands only if all candidates agree on it or exactly one passes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.gates import LedgerError, require, require_none

#: Distinct pages that must bear out a key before it is taken.
WITNESSES = 3
#: The finite layouts under which rows are tried.
LAYOUTS = {"booleans": range(1, 6), "enum_width": (1,), "null_bitmap": range(1, 5), "coverage": range(1, 3), "prefix": range(1, 5), "variable_length": range(1, 7)}


def directory_consensus(candidates: DataFrame) -> DataFrame:
    """(page, common, agreed_empty, disagreements) per page.

    candidates: (page, candidate, record_count, records: the record numbers present). Up to the least record count a
    number present in every candidate is common, in none agreed empty, in some a disagreement; numbers beyond the
    least count are disagreements too.
    """
    sizes = candidates.groupBy("page").agg(F.count("*").alias("n"), F.min("record_count").alias("low"), F.max("record_count").alias("high"))
    seen = candidates.select("page", "candidate", F.explode(F.array_distinct("records")).alias("record")).groupBy("page", "record").agg(F.count("*").alias("held"))
    met = seen.join(sizes, "page").where("record < low").groupBy("page").agg(
        F.sort_array(F.collect_list(F.when(F.col("held") == F.col("n"), F.col("record")))).alias("common"), F.count("*").alias("met"),
        F.count_if(F.col("held") < F.col("n")).alias("part"),
    )
    both = sizes.join(met, "page", "left")
    none = F.array().cast(seen.select(F.array("record")).schema[0].dataType)
    return both.select(
        "page", F.coalesce("common", none).alias("common"), (F.col("low") - F.coalesce("met", F.lit(0))).cast("bigint").alias("agreed_empty"),
        (F.col("high") - F.col("low") + F.coalesce("part", F.lit(0))).cast("bigint").alias("disagreements"),
    )


def resolved_rows(candidates: DataFrame, value: str = "value") -> DataFrame:
    """(page, record, value): rows that every candidate of their page decodes, and alike.

    candidates: (page, candidate, record, value), value null where the decoding failed.
    """
    n = candidates.groupBy("page").agg(F.countDistinct("candidate").alias("n"))
    rows = candidates.groupBy("page", "record").agg(F.count("*").alias("held"), F.count(value).alias("good"), F.min(value).alias("low"), F.max(value).alias("high"))
    good = (F.col("held") == F.col("n")) & (F.col("good") == F.col("n")) & (F.col("low") == F.col("high"))
    return rows.join(n, "page").where(good).select("page", "record", F.col("low").alias(value))


def collection_counters(candidates: DataFrame, value: str = "value") -> DataFrame:
    """One row: page groups, resolved and unresolved rows, and rows with a failed decoding."""
    n = candidates.groupBy("page").agg(F.countDistinct("candidate").alias("n"))
    rows = candidates.groupBy("page", "record").agg(F.count("*").alias("held"), F.count(value).alias("good"), F.min(value).alias("low"), F.max(value).alias("high")).join(n, "page")
    common, failed = F.col("held") == F.col("n"), F.col("good") < F.col("held")
    same = common & ~failed & (F.col("low") == F.col("high"))
    found = rows.agg(F.count_if(same).alias("resolved"), F.count_if(common & ~same).alias("unresolved"), F.count_if(common & failed).alias("decode_failures"), F.count_if(~common).alias("disagreements"))
    return n.agg(F.count("*").alias("page_groups")).crossJoin(F.broadcast(found))  # one row each


def collect_table(candidates: DataFrame, masters: DataFrame | None = None, value: str = "value", master: str = "master") -> tuple[DataFrame, DataFrame]:
    """(rows, counters) of one table; with masters (those that a header bears out) only rows of these are kept."""
    rows = resolved_rows(candidates, value)
    if masters is not None:
        own = candidates.groupBy("page", "record").agg(F.min(master).alias(master), F.max(master).alias("__other")).where(f"{master} = __other").drop("__other")
        rows = rows.join(own, ["page", "record"]).join(masters.select(master).distinct(), master, "left_semi")
    return rows, collection_counters(candidates, value)


def header_masters(headers: DataFrame) -> DataFrame:
    """(master): ids on which all candidates of a header row agree; headers: (page, record, candidate, master)."""
    return resolved_rows(headers, "master").select("master").distinct()


def key_candidates(witnesses: DataFrame) -> DataFrame:
    """(key, pages): distinct pages that bear out each candidate key; a page with several keys bears out none.

    witnesses: (page, key), one row for each key that a page allows.
    """
    single = witnesses.distinct().groupBy("page").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1")
    return single.groupBy("key").agg(F.count("*").alias("pages"))


def the_key(witnesses: DataFrame, least: int = WITNESSES) -> int:
    """The one key that all decisive pages agree on; several, or fewer than `least` pages, raise."""
    found = key_candidates(witnesses).orderBy(F.desc("pages"), "key").limit(2).collect()
    require(len(found) < 2, "conflicting_keys", ",".join(str(r["key"]) for r in found))
    require(bool(found) and found[0]["pages"] >= least, "too_few_witnesses", str(found[0]["pages"] if found else 0))
    return found[0]["key"]


def balanced_candidates(postings: DataFrame) -> DataFrame:
    """(candidate): candidates all of whose transactions net to nothing; postings: (candidate, transaction_id, cents)."""
    nets = postings.groupBy("candidate", "transaction_id").agg(F.sum(F.col("cents").cast("decimal(38,0)")).alias("net"))
    return nets.groupBy("candidate").agg(F.max((F.col("net") != 0).cast("int")).alias("off")).where("off = 0").select("candidate")


def only_candidate(passed: DataFrame, what: str = "candidate"):
    """The single row of a frame with one column; none or several raise."""
    found = passed.distinct().limit(2).collect()
    require(len(found) == 1, f"no_unique_{what}", str(len(found)))
    return found[0][0]


def try_in_turn(*plans: Callable[[], DataFrame]) -> DataFrame:
    """The first plan whose gates hold for the whole table; plans are never mixed row by row. Only gates are caught."""
    last = None
    for plan in plans:
        try:
            return plan()
        except LedgerError as e:
            last = e
    raise last or LedgerError("no_plan")


def storage_layouts(spark, axes: dict = LAYOUTS) -> DataFrame:
    """(layout, one column for each axis): every combination of the axes, numbered in order."""
    rows = [(i, *map(int, x)) for i, x in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, ", ".join(["layout int", *(f"{a} int" for a in axes)]))


def attested_layouts(outcomes: DataFrame) -> DataFrame:
    """(layout, rows): layouts that decode every row tried; outcomes: (layout, row, ok). Each layout must have seen all rows."""
    rows = outcomes.select("row").distinct().agg(F.count("*").alias("all"))
    tried = outcomes.groupBy("layout").agg(F.countDistinct("row").alias("rows"), F.bool_and("ok").alias("ok")).where("ok")
    return tried.join(F.broadcast(rows), F.col("rows") == F.col("all")).select("layout", "rows")  # one row


def page_tables(pages: DataFrame) -> DataFrame:
    """(page, table_id, outcome): the table of a page if its materialised candidates name one (single), else null
    (conflict, or unclassified where all of them failed). pages: (page, candidate, table_id or null)."""
    each = pages.groupBy("page").agg(F.min("table_id").alias("low"), F.max("table_id").alias("high"), F.count("table_id").alias("n"))
    outcome = F.when(F.col("n") == 0, "unclassified").when(F.col("low") == F.col("high"), "single").otherwise("conflict")
    return each.select("page", F.when(outcome == "single", F.col("low")).alias("table_id"), outcome.alias("outcome"))


def for_table(pages: DataFrame, tables: DataFrame, table_id: int) -> DataFrame:
    """The candidate pages of one table, from the pages and their `page_tables`; nothing is decoded again."""
    return pages.join(tables.where(F.col("table_id") == table_id).select("page"), "page", "left_semi")


def carrier_census(records: DataFrame) -> DataFrame:
    """(carrier, pages, records, parsed, unparsed, identified): what catalog carrier pages hold.

    records: (carrier, page, record, table_id or null if only a fixed prefix could be read, parsed boolean).
    """
    return records.groupBy("carrier").agg(
        F.countDistinct("page").alias("pages"), F.count("*").alias("records"), F.count_if(F.col("parsed")).alias("parsed"), F.count_if(~F.col("parsed")).alias("unparsed"),
        F.count_if(~F.col("parsed") & F.col("table_id").isNotNull()).alias("identified"),
    )


def correlate_traces(traces: DataFrame, witnesses: DataFrame) -> DataFrame:
    """(trace_id, nth, outcome): page traces against raw pages of the same snapshot and number: matched, missing or
    digest_mismatch. A repeated trace or raw page raises."""
    for rows, key, check in ((witnesses, ["snapshot", "page"], "duplicate_raw_page"), (traces, ["trace_id"], "duplicate_trace")):
        twice = rows.groupBy(*key).count().where("count > 1")
        require_none(twice.select(F.lit(0).alias("rank"), F.lit(check).alias("check"), F.concat_ws(" ", *(F.col(k).cast("string") for k in key)).alias("key")))
    both = traces.join(witnesses.select("snapshot", "page", F.col("digest").alias("__raw")), ["snapshot", "page"], "left")
    outcome = F.when(F.col("__raw").isNull(), "missing").when(F.col("__raw") != F.col("digest"), "digest_mismatch").otherwise("matched")
    return both.select("trace_id", "nth", outcome.alias("outcome"))


def value_histograms(rows: DataFrame, columns: list[str], present: list[str]) -> DataFrame:
    """(field, value, n): how often each value of some columns occurs, and under value '' how often others are there at all."""
    marks = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]
    marks += [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("field"), F.lit("").alias("value"))) for c in present]
    each = rows.select(F.explode(F.array(*marks)).alias("m")).where("m is not null")
    return each.groupBy("m.field", "m.value").agg(F.count("*").alias("n"))


def required_tables(catalog: DataFrame, unparsed: DataFrame, required: list[int]) -> DataFrame:
    """(check, key) for required table ids: unknown, in conflict (several names), or maybe in conflict because an unparsed
    carrier record starts with that id; a record that names no id at all (null) stands against them all."""
    wanted = catalog.sparkSession.createDataFrame([(t,) for t in sorted(set(required))], "table_id int")
    names = catalog.groupBy("table_id").agg(F.countDistinct("name").alias("n"))
    both = wanted.join(names, "table_id", "left")
    found = [both.where("n is null").select(F.lit("unknown_table").alias("check"), "table_id"), both.where("n > 1").select(F.lit("conflicting_table").alias("check"), "table_id")]
    found.append(wanted.join(unparsed.select("table_id").distinct(), "table_id", "left_semi").select(F.lit("may_conflict").alias("check"), "table_id"))
    loose = unparsed.where("table_id is null").limit(1).select(F.lit("unidentified_records").alias("check"), F.lit(None).cast("int").alias("table_id"))
    return reduce(DataFrame.unionByName, [*found, loose]).select("check", F.col("table_id").cast("string").alias("key"))


def column_counts(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_id, expected, actual): tables whose columns are not as many as their catalog row says; tables: (table_id, col_count)."""
    n = columns.groupBy("table_id").agg(F.countDistinct("column_id").alias("actual"))
    both = tables.select("table_id", F.col("col_count").alias("expected")).join(n, "table_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("bigint")))
    return both.where("expected <> actual")


def schema_of(columns: DataFrame, tables: DataFrame, name: str) -> DataFrame:
    """The columns of the table of that name, in order; a name that no or several tables have raises."""
    ids = tables.where(F.col("name") == name).select("table_id").distinct()
    return columns.where(F.col("table_id") == only_candidate(ids, "table")).orderBy("column_id")


def index_groups(indexes: DataFrame, tables: DataFrame, extents: DataFrame) -> DataFrame:
    """(outcome, table_id, name, page, indexes): index entries by owner and page.

    An owner id that names one table makes an entry a `candidate` of it, if its page is an extent page (extents: page),
    else an `invalid_page`; owners that name no or several tables give `orphan` and no table. Repeated entries count once.
    """
    owner = tables.groupBy("object_id").agg(F.countDistinct("table_id", "name").alias("n"), F.min(F.struct("table_id", "name")).alias("t")).where("n = 1")
    rows = indexes.select("owner_object_id", "page", "index").distinct().join(owner.select(F.col("object_id").alias("owner_object_id"), "t"), "owner_object_id", "left")
    rows = rows.join(extents.select("page").distinct().withColumn("__extent", F.lit(True)), "page", "left")
    outcome = F.when(F.col("t").isNull(), "orphan").when(F.col("__extent").isNull(), "invalid_page").otherwise("candidate")
    each = rows.select(outcome.alias("outcome"), F.col("t.table_id").alias("table_id"), F.col("t.name").alias("name"), "page", "index")
    return each.groupBy("outcome", "table_id", "name", "page").agg(F.array_join(F.sort_array(F.collect_set("index")), ",").alias("indexes"))


def first_disagreements(audit: DataFrame, order: str, n: int = 16) -> DataFrame:
    """The first n rows of an audit, in input order, whose outcome is disagree."""
    return audit.where("outcome = 'disagree'").orderBy(order).limit(n)


def presence_gate(counts: DataFrame, needed: Column) -> DataFrame:
    """(check, key): markers that must be in a snapshot and are not; counts: (marker, holders)."""
    return counts.where(needed & (F.coalesce("holders", F.lit(0)) == 0)).select(F.lit("marker_absent").alias("check"), F.col("marker").alias("key"))
