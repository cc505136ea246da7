"""Page-structured files: splitting, trailers, slots, entropy and the additive overlay."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.codecs import byte, entropy

#: Fixed values of the page format.
PAGE, DATA_END, TYPE_AT, CRC_AT, SECTOR = 4096, 0xFF0, 0xFF2, 0xFFC, 512
OPAQUE_BITS = 7.5


def split_pages(files: DataFrame, content: str = "content", size: int = PAGE) -> DataFrame:
    """One row per page: the other columns of files, page_number from 0, bytes. Byte slices in the engine, no Python."""
    rest = [c for c in files.columns if c != content]
    n = F.ceil(F.length(content) / size).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = files.select(*rest, F.col(content).cast("binary").alias("__c"), F.explode(numbers).alias("page_number"))
    return rows.select(*rest, "page_number", F.substring("__c", F.col("page_number") * size + 1, F.lit(size)).alias("bytes"))


def trailer(data: Column) -> dict[str, Column]:
    """page_type (a letter), stored_crc and true_crc of a whole page."""
    stored = sum((byte(data, CRC_AT + i).cast("bigint") * (1 << (8 * i)) for i in range(1, 4)), byte(data, CRC_AT).cast("bigint"))
    return {"page_type": F.chr(byte(data, TYPE_AT)), "stored_crc": stored, "true_crc": F.crc32(F.substring(data, 1, CRC_AT))}


def page_integrity(pages: DataFrame) -> DataFrame:
    """(page_type, n, crc_ok): whole pages by type, and how many match their checksum."""
    rows = pages.where(F.length("bytes") == PAGE).withColumns(trailer(F.col("bytes")))
    return rows.groupBy("page_type").agg(F.count("*").alias("n"), F.count_if(F.col("stored_crc") == F.col("true_crc")).alias("crc_ok"))


#: How far into a page its slot directory may begin, and the slots that make one.
DIRECTORY, LEAST_SLOTS = 1024, 2


def slots_of(page: bytes) -> tuple[str, list[tuple[int, int, int]]]:
    """(outcome, [(slot, start, end)]) of an extent page with a slot directory.

    The directory is an array of 16-bit row offsets, falling but for zeros, which are free slots; it may begin at an
    odd byte and be of either byte order. Of the words before it the last is zero, the third-last is the number of slots and
    the fourth-last the least live offset; the first place where all this holds, and the array ends before the
    first row, is the directory. Rows run to the next live offset in physical order, the last one to the end of the data.
    """
    if len(page) != PAGE or page[TYPE_AT : TYPE_AT + 1] != b"E":
        return "not_extent", []
    for start in range(12, DIRECTORY):
        if page[start - 2] or page[start - 1]:
            continue
        for order in "<>":
            least, count = struct.unpack_from(f"{order}HH", page, start - 8)
            if count < LEAST_SLOTS or start + 2 * count > least or least >= DATA_END:
                continue
            offsets = struct.unpack_from(f"{order}{count}H", page, start)
            live = [(o, i) for i, o in enumerate(offsets) if o]
            falling = all(a > b for (a, _), (b, _) in zip(live, live[1:], strict=False))
            if not live or not falling or live[-1][0] != least or live[0][0] >= DATA_END:
                continue
            live.reverse()
            ends = [o for o, _ in live[1:]] + [DATA_END]
            return "rows", [(i, o, e) for (o, i), e in zip(live, ends, strict=True)]
    return "no_slot_directory", []


def scan_rows(pages: DataFrame, first: int = 1, end: int | None = None) -> DataFrame:
    """(page_number, outcome, slot, start, row): row events of pages in [first, end), page 0 aside; a page
    without rows gives one event that says why. The range is filtered before the bytes reach Python."""
    chosen = pages.where((F.col("page_number") >= max(1, first)) & (F.lit(True) if end is None else F.col("page_number") < end))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for number, data in zip(pdf["page_number"], pdf["bytes"], strict=True):
                outcome, rows = slots_of(bytes(data))
                out += [(number, "row", s, a, bytes(data[a:b])) for s, a, b in rows] or [(number, outcome, None, None, None)]
            yield pd.DataFrame(out, columns=["page_number", "outcome", "slot", "start", "row"]).astype({"slot": "Int32", "start": "Int32"})

    return chosen.select("page_number", "bytes").mapInPandas(run, "page_number int, outcome string, slot int, start int, row binary")


@F.pandas_udf(T.DoubleType())
def entropy_bits(data: pd.Series) -> pd.Series:
    """Bits per byte of the data area of a page."""
    return pd.Series([None if x is None else entropy(bytes(x)[:DATA_END]) for x in data], dtype="float64")


def is_opaque(data: Column) -> Column:
    return entropy_bits(data) >= OPAQUE_BITS


def deobfuscate(page: bytes, number: int, key: int) -> bytes:
    """A page without its overlay: per 512-byte sector an arithmetic progression is taken off. Its base follows from
    key, page and sector; its step is the most frequent difference of neighbours (the least of equals)."""
    raw = np.frombuffer(page, np.uint8)
    out = raw.copy()
    bias = (number % 16) // 2 * 4
    for s in range(PAGE // SECTOR):
        a, b = s * SECTOR, min((s + 1) * SECTOR, DATA_END)
        base = (key + number + s - bias) % 256
        step = int(np.bincount(np.diff(raw[a:b]), minlength=256).argmax())
        out[a:b] = raw[a:b] - ((base + step * np.arange(b - a)) % 256).astype(np.uint8)
    return out.tobytes()


def recover_key(page: bytes, number: int) -> int | None:
    """The key byte that leaves most zero bytes, if one is best alone."""
    zeros = [deobfuscate(page, number, k)[:DATA_END].count(0) for k in range(256)]
    best = max(zeros)
    return zeros.index(best) if zeros.count(best) == 1 else None


def adjacent_pairs(pages: DataFrame, file: str, value: str) -> DataFrame:
    """(before, after, n): values of neighbouring pages of a file, met by an equality join on file and page number."""
    left = pages.select(file, (F.col("page_number") + 1).alias("page_number"), F.col(value).alias("before"))
    rows = pages.select(file, "page_number", F.col(value).alias("after")).join(left, [file, "page_number"])
    return rows.groupBy("before", "after").agg(F.count("*").alias("n"))
