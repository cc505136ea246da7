"""Catalog operators: as-of attribution of pages, foreign-key inference, audits, bands and conflict-free catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.labels import stem
from ledgerloom.operators.gates import bounded_broadcast

#: Prefixes that a table name may carry before what a column's stem refers to.
PREFIXES = ("abmc_", "es_", "i_", "v_", "mv_", "ix_")
#: Pages of one span of the as-of join, and spans of one block in which the last root before each span is looked up.
SPAN, BLOCK = 64, 1 << 12


def attribution_map(tables: DataFrame) -> DataFrame:
    """(root, name, last, nth): catalog entries with a root page; of equal roots the last in catalog order (nth) counts."""
    rooted = tables.where("data_root_page > 0").select(F.col("data_root_page").alias("root"), "name", F.col("last_page").alias("last"), "nth")
    return rooted.groupBy("root").agg(F.max_by(F.struct("name", "last", "nth"), F.struct("nth")).alias("t")).select("root", "t.name", "t.last", "t.nth")


def attribution_gap(tables: DataFrame) -> str | None:
    """Why nothing can be attributed, if so."""
    n, rooted = tables.agg(F.count("*"), F.count_if(F.col("data_root_page") > 0)).first()
    return "NoCatalogRows" if not n else "AllRootsZeroed" if not rooted else None


def attribute_pages(pages: DataFrame, tables: DataFrame, page: str = "page_number") -> DataFrame:
    """pages with `owner`: the table of the largest root at or before the page, null before the first root or
    beyond a last page that is not less than the root.

    As-of join without sorting the pages: both sides fall into short spans of the page range. A span's roots, at most
    SPAN, come as one sorted array, headed by the last root before the span, and each page takes the last one that is not
    after it. The last root before a span is looked up inside blocks of spans, and then among the blocks' own last roots.
    """
    roots = attribution_map(tables).withColumn("span", F.floor(F.col("root") / SPAN))
    spans = pages.select(F.floor(F.col(page) / SPAN).alias("span")).distinct()
    own = roots.groupBy("span").agg(F.sort_array(F.collect_list(F.struct("root", "name", "last"))).alias("own"))
    every = spans.join(own, "span", "full_outer").select("span", "own", F.element_at("own", -1).alias("top"), F.floor(F.col("span") / BLOCK).alias("block"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = every.groupBy("block").agg(F.max("top").alias("top"))  # one row for SPAN * BLOCK pages
    tops = tops.select("block", F.last("top", ignorenulls=True).over(ahead(Window.orderBy("block"))).alias("carried"))
    table = every.withColumn("lead", F.last("top", ignorenulls=True).over(ahead(Window.partitionBy("block").orderBy("span")))).join(tops, "block")
    lead = F.coalesce("lead", "carried")
    roots_of = F.concat(F.when(lead.isNotNull(), F.array(lead)).otherwise(F.array()), F.coalesce("own", F.array()))
    table = bounded_broadcast(table.select("span", roots_of.alias("__roots")))
    joined = pages.withColumn("span", F.floor(F.col(page) / SPAN)).join(table, "span", "left")
    hit = F.try_element_at(F.filter("__roots", lambda r: r["root"] <= F.col(page)), F.lit(-1))
    owner = F.when(hit.isNotNull() & ~F.coalesce((hit["last"] >= hit["root"]) & (F.col(page) > hit["last"]), F.lit(False)), hit["name"])
    return joined.withColumn("owner", owner).drop("span", "__roots")


def group_pages(attributed: DataFrame, page: str = "page_number") -> DataFrame:
    """(owner, n_pages, first_page, last_page); pages of nobody under ''."""
    return attributed.groupBy(F.coalesce("owner", F.lit("")).alias("owner")).agg(F.count("*").alias("n_pages"), F.min(page).alias("first_page"), F.max(page).alias("last_page"))


def match_score(wanted: Column, table: Column) -> Column:
    """How well a table name fits a stem: 1000 the same, 900 but for a prefix, 700 as its end, 600 as its start, 300 inside."""
    s, t = F.lower(wanted), F.lower(table)
    bare = F.regexp_replace(t, "^(" + "|".join(PREFIXES) + ")", "")
    return (
        F.when(t == s, 1000).when(bare == s, 900).when(F.endswith(bare, F.concat(F.lit("_"), s)), 700)
        .when(F.startswith(bare, F.concat(s, F.lit("_"))), 600).when(F.contains(bare, s), 300).otherwise(0)
    )


def fk_graph(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """(source_table, source_column, source_column_id, stem, target_table, score): the best table for each
    *_id or *_id_h column; ties go to the first in catalog order (nth), no fit gives null and 0.

    Every case asks that the name hold the stem, so a stem meets its tables by equality with one of the parts of their
    names; each pair is scored once, by map-side arg-max.
    """
    named = tables.groupBy("table_id").agg(F.min_by("name", "nth").alias("source_table"))
    cols = columns.join(bounded_broadcast(named), "table_id").withColumn("stem", stem(F.col("name"))).where("stem is not null")
    edges = cols.select("source_table", F.col("name").alias("source_column"), F.col("column_id").alias("source_column_id"), "stem").distinct()
    names = tables.groupBy(F.col("name").alias("target_table")).agg(F.min("nth").alias("nth"))
    low, n = F.lower("target_table"), F.length("target_table")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(low, i, k))))
    parts = names.where(n > 0).select("target_table", "nth", F.explode(F.array_distinct(parts)).alias("__part"))
    stems = edges.select("stem").distinct().withColumn("__part", F.lower("stem"))
    scored = stems.join(parts, "__part").drop("__part").withColumn("score", match_score(F.col("stem"), F.col("target_table"))).where("score > 0")
    best = scored.groupBy("stem").agg(F.max_by(F.struct("target_table", "score"), F.struct("score", -F.col("nth"))).alias("b"))
    found = edges.join(best, "stem", "left")
    return found.select("source_table", "source_column", "source_column_id", "stem", F.col("b.target_table").alias("target_table"), F.coalesce("b.score", F.lit(0)).alias("score"))


def fk_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("total"), F.count_if(F.col("score") > 0).alias("resolved"), F.count_if(F.col("score") >= 900).alias("strong"))


def index_audit(indexes: DataFrame, tables: DataFrame) -> DataFrame:
    """indexes with outcome: orphan, ambiguous, unattributed, agree or disagree: the owner by object id against the
    owner by catalog page; owners are sets of distinct names."""
    names = tables.groupBy(F.col("object_id").alias("owner_object_id")).agg(F.sort_array(F.collect_set("name")).alias("owners"))
    placed = attribute_pages(indexes.withColumnRenamed("catalog_page_candidate", "page_number"), tables)
    rows = placed.join(names, "owner_object_id", "left").withColumn("n", F.coalesce(F.size("owners"), F.lit(0)))
    outcome = (
        F.when(F.col("n") < 1, "orphan").when(F.col("n") > 1, "ambiguous").when(F.col("owner").isNull(), "unattributed")
        .when(F.col("owner") == F.col("owners")[0], "agree").otherwise("disagree")
    )
    return rows.select("name", "owner_object_id", "page_number", F.when(F.col("n") == 1, F.col("owners")[0]).alias("owner_by_id"), F.col("owner").alias("owner_by_page"), outcome.alias("outcome"))


def agreement_rate(audit: DataFrame) -> DataFrame:
    """(agree, compared, rate_ppm): agreements among agreements, disagreements and missing pages; 0 of none is 0."""
    n = audit.agg(F.count_if(F.col("outcome") == "agree").alias("agree"), F.count_if(F.col("outcome").isin("agree", "disagree", "unattributed")).alias("compared"))
    return n.withColumn("rate_ppm", F.when(F.col("compared") > 0, F.expr("agree * 1000000 div compared")).otherwise(F.lit(0).cast("bigint")))


def nullability(columns: DataFrame) -> DataFrame:
    """(nulls, n, samples): columns by their null byte with the first four distinct names in catalog order."""
    named = columns.groupBy("nulls", "name").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    first = F.row_number().over(Window.partitionBy("nulls").orderBy("first", "name"))  # each task keeps four before the shuffle
    sample = named.withColumn("place", first).where("place <= 4").groupBy("nulls").agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("s"))
    counts = named.groupBy("nulls").agg(F.sum("n").alias("n"))
    return counts.join(sample, counts["nulls"].eqNullSafe(sample["nulls"])).select(counts["nulls"], "n", F.array_join(F.transform("s", lambda x: x["name"]), ",").alias("samples"))


def width_bands(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """(name, n_columns, least, most): possible row widths of tables whose columns are complete; a nullable column may be absent."""
    sums = columns.groupBy("table_id").agg(
        F.countDistinct("column_id").alias("n_columns"), F.max("column_id").alias("top"), F.sum("width").alias("most"),
        F.sum(F.when(F.col("nulls") == 0, F.col("width")).otherwise(0)).alias("least"),
    )
    both = tables.join(sums, "table_id").where("n_columns = col_count and top = col_count")
    return both.select("name", "n_columns", "least", "most")


def upper_median(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): element n div 2 of the sorted values; ranks come from a count per distinct value, so a
    large group is never gathered into one array."""
    counts = values.groupBy(group, value).count()
    w = Window.partitionBy(group).orderBy(value)
    cum = counts.withColumn("upto", F.sum("count").over(w)).withColumn("all", F.sum("count").over(Window.partitionBy(group)))
    hit = cum.where(F.col("upto") > F.floor(F.col("all") / 2))
    return hit.groupBy(group).agg(F.min(value).alias("median"))


def conflict_free(catalog: DataFrame, identity: list[str], keys: tuple[str, ...] = ("table_id", "name")) -> DataFrame:
    """Distinct identities, without any that takes part in a conflict: a key value that several identities share."""
    rows = catalog.select(*identity).distinct()
    for key in keys:
        rows = rows.withColumn(f"__{key}", F.count("*").over(Window.partitionBy(key)))
    return rows.where(" and ".join(f"__{k} = 1" for k in keys)).select(*identity)


def first_of(rows: DataFrame, keys: list[str], nth: str) -> DataFrame:
    """One row per key, the first in catalog order."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), nth).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*rows.columns)


def consensus(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): keys on whose value all candidates agree; null candidates (failed decodes) have no say."""
    seen = candidates.where(F.col(value).isNotNull()).groupBy(key)
    return seen.agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low = high").select(key, F.col("low").alias(value))


def owners_by_vote(votes: DataFrame, owner: str, name: str) -> DataFrame:
    """(owner, name, votes): the name with strictly most votes; a tie leaves the owner out."""
    n = votes.groupBy(owner, name).agg(F.count("*").alias("votes"))
    top = n.groupBy(owner).agg(F.max("votes").alias("votes"))
    return n.join(top, [owner, "votes"]).groupBy(owner).agg(F.min(name).alias(name), F.min("votes").alias("votes"), F.count("*").alias("n")).where("n = 1").drop("n")
