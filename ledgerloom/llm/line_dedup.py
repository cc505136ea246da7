"""Site-relative line deduplication.

A line is boilerplate for a host if the share of the host's pages that hold it
exceeds a ratio. Pages are reduced to their distinct line hashes where they are
read and counts combine map-side, so a hot host or line costs one counter per
task. The boilerplate lines of a host are at most (lines per page) / ratio, so
they travel as one small array per host; the texts themselves are not shuffled
unless that table's bytes, summed before the join, outgrow the broadcast bound. A page
looks its own lines up in its host's array once, by a hash set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, small_by

#: Share of a host's pages from which a line goes, and the least number of such pages.
RATIO, LEAST_PAGES = 0.1, 4


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    """A line's identity: the hash of it without surrounding blanks. Blank lines have none."""
    bare = F.trim(line)
    return F.when(bare != "", F.xxhash64(bare))


def _host(host: Column) -> Column:
    """The host of a URL, in small letters; any other value is a host itself, null the host ''."""
    text = host.cast("string")
    named = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.when(named != "", F.lower(named)).otherwise(text), F.lit(""))


def boilerplate(df: DataFrame, host: str, text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(__host, __lines: array of line hashes): the boilerplate of each host that has any. Materialised."""
    own = df.select(_host(F.col(host)).alias("__host"), F.array_distinct(F.transform(_lines(F.col(text)), _key)).alias("__keys"))
    pages = own.groupBy("__host").agg(F.count("*").alias("__pages"))
    seen = own.select("__host", F.explode("__keys").alias("__key")).where("__key is not null")
    seen = seen.groupBy("__host", "__key").agg(F.count("*").alias("__seen")).where(F.col("__seen") >= least_pages)
    over = seen.join(pages, "__host").where(F.col("__seen") > F.col("__pages") * F.lit(float(ratio)))
    return cut(over.groupBy("__host").agg(F.sort_array(F.collect_list("__key")).alias("__lines")))


def drop_boilerplate(df: DataFrame, host: str, text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """df with `text` freed of its host's boilerplate lines, and n_lines, n_dropped (long) added.

    host: a column of URLs or of plain names. Pages of a host are rows; repeated rows are pages each; lines repeated in a
    page count once for the page and are dropped together. Blank lines stay. A null text has no line and stays null
    (n_lines 0); an empty one has one blank line. A null host is the host ''. Texts of any length are read whole. All other
    columns pass through; columns named n_lines or n_dropped are replaced, columns named __lines, __keys, __hits or __kept
    are not returned. An empty table gives an empty result.
    """
    found = boilerplate(df, host, text, ratio, least_pages).withColumnRenamed("__host", "__site")
    lines = small_by(found, F.size("__lines").cast("long") * 8 + F.octet_length("__site") + 64)
    rows = df.drop("n_lines", "n_dropped", "__lines", "__keys", "__hits", "__kept", "__site")
    joined = rows.join(lines, _host(rows[host]) == lines["__site"], "left")
    hit = F.col("__lines").isNotNull() & F.col(text).isNotNull()
    joined = joined.withColumn("__keys", F.when(hit, F.transform(_lines(F.col(text)), _key)))
    joined = joined.withColumn("__hits", F.array_intersect("__keys", "__lines"))
    kept = F.filter(_lines(F.col(text)), lambda x, i: ~F.coalesce(F.array_contains(F.col("__hits"), F.get("__keys", i)), F.lit(False)))
    joined = joined.withColumn("__kept", F.when(hit, kept))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(F.col(text)))).cast("long")
    new = {c: F.col(c) for c in rows.columns} | {text: F.when(hit, F.array_join("__kept", "\n")).otherwise(F.col(text))}
    return joined.select(
        *(x.alias(c) for c, x in new.items()), n.alias("n_lines"), F.coalesce(n - F.size("__kept"), F.lit(0)).cast("long").alias("n_dropped")
    )


#: The query's result in SQL: op6 over `documents`, host = source.
ORACLE = f"""
WITH own AS (
  SELECT doc_id, coalesce(source, '') AS host, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), seen AS (
  SELECT host, line, count(*) AS n
  FROM (SELECT host, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ')))) AS line FROM own)
  WHERE line <> '' GROUP BY host, line
), bad AS (
  SELECT seen.host, list(line) AS bad
  FROM seen JOIN (SELECT host, count(*) AS pages FROM own GROUP BY host) p ON seen.host = p.host
  WHERE n >= {LEAST_PAGES} AND n > pages * CAST({RATIO} AS DOUBLE) GROUP BY seen.host
), kept AS (
  SELECT doc_id, own.host, text, lines,
         list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []::VARCHAR[]), trim(x, ' '))) AS kept
  FROM own LEFT JOIN bad ON own.host = bad.host
)
SELECT doc_id, host, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines,
       CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END AS n_dropped,
       CASE WHEN text IS NOT NULL THEN sha256(array_to_string(kept, chr(10))) END AS kept_sha256
FROM kept
"""
