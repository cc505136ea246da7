"""Evidence about structure: width outcomes, row signatures, schema fingerprints, identifier forms and byte scans."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.codecs import be_base128, hex_bytes, leb128
from ledgerloom.operators.gates import bounded_broadcast

#: Prefixes of system tables; start state and multiplier of the schema fingerprint.
SYSTEM = ("SYS", "ISYS", "RS_", "dbo")
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def is_system_name(name: Column) -> Column:
    return name.rlike("^(" + "|".join(SYSTEM) + ")")


def is_foreign_key(index: Column) -> Column:
    return index.startswith("fkey_")


def width_outcomes(measured: DataFrame, bands: DataFrame) -> DataFrame:
    """(outcome, n): measured (name, length) against bands (name, least, most): pass, fail, no_band or unmeasured (null length)."""
    rows = measured.join(bounded_broadcast(bands), "name", "left")
    outcome = (
        F.when(F.col("least").isNull(), "no_band").when(F.col("length").isNull(), "unmeasured")
        .when(F.col("length").between(F.col("least"), F.col("most")), "pass").otherwise("fail")
    )
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def row_signature(row: Column, size: int = 12) -> Column:
    """The first bytes of a row, in hex; null for an empty or missing one."""
    return F.when(F.length(row) > 0, F.lower(F.hex(F.substring(row, 1, size))))


def unique_signatures(roots: DataFrame) -> DataFrame:
    """(signature, name): signatures of root pages that one catalog entry alone has."""
    seen = roots.where("signature is not null").groupBy("signature").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    return seen.where("n = 1").select("signature", "name")


def attribution_agreement(pages: DataFrame, signatures: DataFrame) -> DataFrame:
    """One row: pages (owner by position, signature) whose owners by position and by content agree, disagree or lack."""
    both = pages.join(bounded_broadcast(signatures.withColumnRenamed("name", "content")), "signature", "left")
    p, c = F.col("owner").isNotNull(), F.col("content").isNotNull()
    return both.agg(
        F.count_if(p & c & (F.col("owner") == F.col("content"))).alias("agree"), F.count_if(p & c & (F.col("owner") != F.col("content"))).alias("disagree"),
        F.count_if(p & ~c).alias("only_position"), F.count_if(~p & c).alias("only_content"), F.count_if(~p & ~c).alias("neither"),
    )


def complete_columns(columns: DataFrame, expected: DataFrame) -> DataFrame:
    """(table_id, complete): whether a table's column ids are 1..n without gap or repeat, n as expected (table_id, col_count)."""
    seen = columns.groupBy("table_id").agg(F.count("*").alias("n"), F.countDistinct("column_id").alias("d"), F.min("column_id").alias("low"), F.max("column_id").alias("top"))
    both = expected.join(seen, "table_id", "left")
    same = (F.col("n") == F.col("col_count")) & (F.col("d") == F.col("n")) & (F.col("low") == 1) & (F.col("top") == F.col("n"))
    return both.select("table_id", F.coalesce(same, F.col("col_count") == 0).alias("complete"))


@F.pandas_udf(T.StringType())
def _fold(parts: pd.Series) -> pd.Series:
    def fold(data: bytes) -> str:
        state = FNV_START
        for b in data:
            state = (state * FNV_PRIME & 0xFFFFFFFFFFFFFFFF) ^ b
        return str(state)

    return pd.Series([fold(bytes(x)) for x in parts])


def schema_fingerprints(columns: DataFrame) -> DataFrame:
    """(table_id, fingerprint): an ordered 64-bit fold over a table's columns in order of id.

    Each column adds its id, name, domain, width and scale (four bytes each, least first, but the name), then
    its null, marker and flag bytes and whatever follows its name.
    """
    four = lambda c: hex_bytes(F.col(c).cast("bigint"), 4, little=True)
    one = lambda c: hex_bytes(F.col(c).cast("bigint"), 1)
    part = F.concat(four("column_id"), F.encode("name", "UTF-8"), four("domain_id"), four("width"), four("scale"), one("nulls"), one("marker"), one("row_flags"), F.col("post_name_bytes"))
    rows = columns.select("table_id", "column_id", F.hex(part).alias("part"))
    whole = rows.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("column_id", "part"))).alias("parts"))
    return whole.select("table_id", _fold(F.unhex(F.array_join(F.transform("parts", lambda x: x["part"]), ""))).alias("fingerprint"))


def attest_manifest(fingerprints: DataFrame, manifest: DataFrame) -> DataFrame:
    """(table_id, outcome): ok, missing, or changed against the manifest (table_id, fingerprint)."""
    both = manifest.withColumnRenamed("fingerprint", "wanted").join(fingerprints, "table_id", "left")
    return both.select("table_id", F.when(F.col("fingerprint").isNull(), "missing").when(F.col("fingerprint") == F.col("wanted"), "ok").otherwise("changed").alias("outcome"))


def number_forms(value: Column) -> Column:
    """array<struct<label, form>>: the ways a record number may be stored, in hex."""
    big = F.hex(hex_bytes(value, 4))
    flip = lambda h, n: F.concat(*(F.substring(h, 2 * i - 1, 2) for i in range(n, 0, -1)))
    cut = lambda n: F.substring(big, 9 - 2 * n, 2 * n)
    forms = {"u16le": F.when(value < 65536, flip(cut(2), 2)), "u16be": F.when(value < 65536, cut(2)), "low16le": flip(cut(2), 2), "low16be": cut(2), "u24le": flip(cut(3), 3),
             "u24be": cut(3), "u32le": flip(big, 4), "u32be": big, "leb128": F.hex(leb128(value)), "be_base128": F.hex(be_base128(value))}
    return F.filter(F.array(*(F.struct(F.lit(k).alias("label"), v.alias("form")) for k, v in forms.items())), lambda x: x["form"].isNotNull())


def identifier_forms(identifier: str) -> list[bytes]:
    """Byte forms of an ASCII identifier: itself, its letters and digits, UTF-16, and for hexadecimal ones the
    binary, its GUID order and its 4- and 8-byte windows both ways round."""
    if not identifier or not identifier.isascii():
        raise ValueError("identifiers are non-empty ASCII")
    bare = re.sub("[^0-9A-Za-z]", "", identifier)
    found = {identifier.encode(), identifier.encode("utf-16-le")} | ({bare.encode()} if bare else set())
    if len(bare) >= 2 and len(bare) % 2 == 0 and re.fullmatch("[0-9a-fA-F]+", bare):
        raw = bytes.fromhex(bare)
        found.add(raw)
        if len(raw) == 16:
            found.add(raw[3::-1] + raw[5:3:-1] + raw[7:5:-1] + raw[8:])
        for width in (4, 8):
            for i in range(len(raw) - width + 1):
                found |= {raw[i : i + width], raw[i : i + width][::-1]}
    return sorted(found)


def form_hits(pages: DataFrame, forms: dict[str, list[bytes]]) -> DataFrame:
    """(name, pages, hits) of a stated set of identifiers over pages of bytes; hits do not overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, n) for data in pdf["bytes"] for k, own in forms.items() if (n := sum(bytes(data).count(f) for f in own))]
            yield pd.DataFrame(out, columns=["name", "hits"])

    found = pages.select("bytes").mapInPandas(run, "name string, hits long")
    return found.groupBy("name").agg(F.count("*").alias("pages"), F.sum("hits").alias("hits"))


def page_tuples(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(offset, first, second, ordinal, derived) of 16-byte tuples with derived = first + ordinal + 1, at any offset."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(raw) - 15
    if n <= 0:
        return []
    le = lambda at, size: sum(raw[at + i : at + i + n] << (8 * i) for i in range(size))
    first, second, ordinal, derived = le(0, 4), le(4, 4), le(8, 2), le(12, 4)
    hit = np.flatnonzero((first != 0) & (second != 0) & (first + ordinal + 1 == derived))
    return [(int(i), int(first[i]), int(second[i]), int(ordinal[i]), int(derived[i])) for i in hit]


#: Fixed values of a line-item anchor: its prefix, the id's length, the four bytes after it, and the mark before an item id.
ID = rb"[0-9A-Za-z]{16}"
ANCHOR = re.compile(rb"\x00\x00\x00\x00\x10(" + ID + rb")\x00\x00\x80\x3f", re.S)
ITEM = b"\x04\x00\x10"
DATES, COUNTERS = (13_000, 20_000), (1, 1_000_000)


def line_items_of(body: bytes) -> list[tuple[str, int, str | None, bytes, int | None, int | None]]:
    """(invoice_id, offset, item_id, amount_raw, date, counter) of each anchor of a page: the four amount bytes follow it,
    a plausible date and counter are looked for in the next 64, an item id in the 96 before."""
    out = []
    for m in ANCHOR.finditer(body):
        at = m.end()
        amount = body[at : at + 4] if at + 4 <= len(body) else bytes(4)
        date = counter = None
        for i in range(at + 4, min(at + 64, max(0, len(body) - 8))):
            d, c = struct.unpack_from("<II", body, i)
            if DATES[0] <= d < DATES[1] and COUNTERS[0] <= c < COUNTERS[1]:
                date, counter = d, c
                break
        before = body[max(0, m.start() - 96) : m.start()]
        k = before.find(ITEM)
        item = before[k + 3 : k + 19] if k >= 0 else b""
        out.append((m[1].decode(), m.start(), item.decode() if re.fullmatch(ID, item) else None, amount, date, counter))
    return out


def scan_line_items(pages: DataFrame) -> DataFrame:
    """Line items of pages (page_number, bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(n, *r) for n, data in zip(pdf["page_number"], pdf["bytes"], strict=True) for r in line_items_of(bytes(data))]
            frame = pd.DataFrame(out, columns=["page_number", "invoice_id", "page_offset", "item_id", "amount_raw", "txn_date_raw", "counter"])
            yield frame.astype({"txn_date_raw": "Int32", "counter": "Int32"})

    schema = "page_number long, invoice_id string, page_offset int, item_id string, amount_raw binary, txn_date_raw int, counter int"
    return pages.select("page_number", "bytes").mapInPandas(run, schema)


def carrier_pairs(pages: DataFrame, file: str) -> DataFrame:
    """One row: consecutive pages of a file by whether each has a directory and the right one a continuation prefix.

    A page meets the one before it by an equality join on file and number, so a file of any size is dealt over all tasks.
    """
    left = pages.select(file, (F.col("page_number") + 1).alias("page_number"), F.col("has_directory").alias("l"))
    rows = pages.select(file, "page_number", F.col("has_directory").alias("r"), F.col("has_prefix").alias("p")).join(left, [file, "page_number"])
    names = {"both_have_directory": "l and r", "right_has_prefix": "p", "right_has_both": "r and p", "left_directory_right_prefix": "l and p"}
    return rows.agg(F.count("*").alias("consecutive_pairs"), *(F.count_if(F.expr(e)).alias(k) for k, e in names.items()))
