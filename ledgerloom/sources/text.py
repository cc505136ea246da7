"""Strict CSV and legacy text, per file.

Report files are small and stateful (preambles, headings that carry forward), so a file is one
unit of work and Spark spreads the files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


class SourceError(ValueError):
    """A file that does not have the form it must have."""


#: A field: quoted (group 1) or bare (group 2), and what ends it.
_FIELD = re.compile(r'(?:"((?:[^"]|"")*)"|([^",\r\n]*))(,|\r\n|\n|\r|\Z)')


def decode(data: bytes) -> str:
    """UTF-8 (a leading mark aside), else Windows-1252 with undefined bytes as the code points of the same number."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)


def records(text: str) -> list[list[str]]:
    """RFC 4180 records with LF, CRLF or CR after a quote; bare quotes, text after a closing quote and
    unclosed quotes raise."""
    out, row, at = [], [], 0
    while at < len(text):
        m = _FIELD.match(text, at)
        if m is None:
            raise SourceError("malformed_csv")
        row.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        at = m.end()
        if m[3] != ",":
            out.append(row)
            row = []
        elif at == len(text):
            out.append([*row, ""])
            row = []
    return out


def money(text: str) -> int:
    """Cents, as functions.money.parse_money has them."""
    bare = text.strip()
    if bare in ("", "-"):
        return 0
    inner = re.fullmatch(r"\((.*)\)", bare)
    body = inner[1] if inner else bare
    minus = bool(inner) or body.startswith("-")
    body = re.sub("[, ]", "", re.sub(r"^[-+]", "", body).strip().removeprefix("$"))
    m = re.fullmatch(r"([0-9]+)(?:\.([0-9]{0,2}))?", body)
    if not m:
        raise SourceError("invalid_amount")
    cents = int(m[1]) * 100 + int((m[2] or "").ljust(2, "0"))
    if cents >= 1 << 63:
        raise SourceError("amount_overflow")
    return -cents if minus else cents


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file; one row a file, so that each is parsed as a whole."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def parse_files(files: DataFrame, parse, schema: str) -> DataFrame:
    """Rows of parse(bytes) -> list of tuples for every file, with the path first; an error fails the job, naming the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", *(c.split()[0] for c in schema.split(", "))]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = parse(bytes(content))
                except SourceError as e:
                    raise SourceError(f"{path}: {e}") from None
                yield pd.DataFrame([(path, *r) for r in rows], columns=columns)

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")
