"""Fail-closed gates: every violation is found before a report is handed out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LedgerError(ValueError):
    """A violated invariant: which one, and the first key that violates it."""

    def __init__(self, check: str, key: str | None = None):
        super().__init__(f"{check}: {key}" if key is not None else check)
        self.check, self.key = check, key


def require_none(violations: DataFrame) -> None:
    """violations: (rank, check, key). Raises the first by rank, then key; one job, one row to the driver."""
    found = violations.agg(F.min(F.struct("rank", "check", "key")).alias("v")).first()
    if found and found["v"] is not None:
        raise LedgerError(found["v"]["check"], found["v"]["key"])


def require(condition: bool, check: str, key: str | None = None) -> None:
    if not condition:
        raise LedgerError(check, key)


#: Rows and bytes up to which a counted side may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows and their bytes, both counted, stay within the bounds; else as it is, for a shuffle join.

    Columns of a fixed width count eight bytes; of all others the text form is measured.
    """
    fixed = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType | T.BooleanType | T.DateType | T.TimestampType)]
    loose = [F.coalesce(F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, T.StringType) else F.to_json(F.struct(F.col(f"`{f.name}`"))), F.lit("")) for f in df.schema.fields if f not in fixed]
    width = F.lit(8 * len(fixed)) + sum((F.octet_length(c) + 16 for c in loose), F.lit(0))
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df
