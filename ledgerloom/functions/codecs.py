"""Binary codecs as column expressions, and the sparse record codec as an Arrow function."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the base-100 amount token: marker of a zero, exponent marker of cents, the largest one, sign bit.
ZERO_MARKER, CENTS_MARKER, MOST_MARKER, POSITIVE = 0x81, 0x3F, 0x45, 0x80
#: Fixed values of a sparse record: longest body, end mark, bytes of each class with a fixed width.
RECORD_LIMIT, END = 30_000, 0xFFFF
WIDTHS = {"F": 4, "I": 4, "L": 4, "H": 2, "U": 2, "M": 6, "Z": 9}


def byte(data: Column, at: Column | int) -> Column:
    """The byte at an offset from 0, as an int (null beyond the end)."""
    at = F.lit(at) if isinstance(at, int) else at
    one = F.hex(F.substring(data, at + 1, F.lit(1)))
    return F.when(one != "", F.conv(one, 16, 10).cast("int"))


def line_amount(raw: Column) -> Column:
    """Unsigned cents of a four-byte amount: types 1 and 2 hold 24 bits, least byte first; others no amount."""
    value = byte(raw, 1) + byte(raw, 2) * 256 + byte(raw, 3) * 65536
    return F.when(byte(raw, 0).isin(1, 2), value)


def line_amount_signed(raw: Column) -> Column:
    """The same with the high bit of the first amount byte as the sign."""
    low = byte(raw, 1)
    value = low.bitwiseAND(0x7F) + byte(raw, 2) * 256 + byte(raw, 3) * 65536
    return F.when(byte(raw, 0).isin(1, 2), F.when(low >= 0x80, -value).otherwise(value))


def hex_bytes(value: Column, width: int, little: bool = False) -> Column:
    """A non-negative number as so many bytes."""
    digits = F.lpad(F.hex(value), 2 * width, "0")
    parts = [F.substring(digits, 2 * i + 1, 2) for i in range(width)]
    return F.unhex(F.concat(*(reversed(parts) if little else parts)))


#: Flag bits of the six-byte balance.
QUANTITY, NEGATIVE, ERROR, PERCENT, EMPTY = 0x01, 0x02, 0x04, 0x08, 0x10


def legacy_cents(data: Column) -> Column:
    """Signed cents of [cents, flags, dollars (four bytes, most first)]; null if not plain money."""
    cents, flags = byte(data, 0), byte(data, 1)
    dollars = F.conv(F.hex(F.substring(data, 3, 4)), 16, 10).cast("bigint")
    plain = (F.length(data) == 6) & (cents <= 99) & flags.isin(0, NEGATIVE)
    value = dollars * 100 + cents
    return F.when(plain, F.when(flags == NEGATIVE, -value).otherwise(value))


def legacy_bytes(cents: Column) -> Column:
    size = F.abs(cents)
    return F.unhex(F.concat(F.lpad(F.hex(size % 100), 2, "0"), F.when(cents < 0, f"{NEGATIVE:02X}").otherwise("00"), F.lpad(F.hex(F.floor(size / 100).cast("bigint")), 8, "0")))


#: Base-100 digits of the largest 64-bit amount.
DIGITS = 10


def base100_cents(token: Column) -> Column:
    """Signed cents of [n, marker, n base-100 digits, least first]; null if malformed or out of range.

    token should be a column that is already made: it is read several times.
    """
    n, marker = byte(token, 0), byte(token, 1)
    power = marker.bitwiseAND(0x7F) - CENTS_MARKER
    digits = F.hex(F.substring(token, F.lit(3), n))
    good = power.between(0, MOST_MARKER - CENTS_MARKER) & (F.length(token) >= n + 2) & digits.rlike(f"^(?:[0-5][0-9A-F]|6[0-3]){{0,{DIGITS}}}(?:00)*$")
    digit = lambda i: F.coalesce(F.conv(F.nullif(F.substring(digits, 2 * i + 1, 2), F.lit("")), 16, 10).cast("bigint"), F.lit(0))
    low = reduce(lambda a, i: a + digit(i) * 100**i, range(1, DIGITS - 1), digit(0))
    wide = low.cast("decimal(38,0)") + digit(DIGITS - 1).cast("decimal(38,0)") * F.lit(100 ** (DIGITS - 1)).cast("decimal(19,0)")
    scale = reduce(lambda a, k: a.when(power == k, 100**k), range(1, MOST_MARKER - CENTS_MARKER + 1), F.when(power == 0, F.lit(1).cast("bigint")))
    value = (wide * scale.cast("decimal(19,0)")).try_cast("bigint")
    zero = F.when(marker == ZERO_MARKER, F.lit(0).cast("bigint"))
    return F.when(n == 0, zero).when(good, F.when(marker >= POSITIVE, value).otherwise(-value))


def base100_token(cents: Column) -> Column:
    """The token of an amount, without trailing powers of 100."""
    size = F.abs(cents.cast("bigint"))
    digit = lambda i: F.call_function("div", size, F.lit(100**i).cast("bigint")) % 100
    used = F.greatest(F.lit(1), F.ceil(F.length(size.cast("string")) / 2)).cast("int")
    body = F.substring(F.concat(*(F.lpad(F.hex(digit(i)), 2, "0") for i in range(DIGITS))), F.lit(1), used * 2)
    sign = F.when(cents < 0, f"{CENTS_MARKER:02X}").otherwise(f"{CENTS_MARKER | POSITIVE:02X}")
    return F.when(cents == 0, F.unhex(F.lit(f"00{ZERO_MARKER:02X}"))).otherwise(F.unhex(F.concat(F.lpad(F.hex(used), 2, "0"), sign, body)))


def _sevens(value: Column) -> tuple[list[Column], Column]:
    """The groups of seven bits of a number, least first, and how many of them it needs."""
    value = value.cast("bigint")
    return [F.shiftrightunsigned(value, 7 * i).bitwiseAND(0x7F) for i in range(10)], F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("int")


def _two_digits(value: Column) -> Column:
    return F.lpad(F.hex(value), 2, "0")


def leb128(value: Column) -> Column:
    """Seven bits a byte, least first, the high bit set while more follow."""
    groups, used = _sevens(value)
    body = F.concat(*(_two_digits(g + F.when(used > i + 1, 128).otherwise(0)) for i, g in enumerate(groups)))
    return F.unhex(F.substring(body, F.lit(1), used * 2))


def be_base128(value: Column) -> Column:
    """Seven bits a byte, highest first, the high bit set while more follow."""
    groups, used = _sevens(value)
    body = F.concat(*(_two_digits(g + (128 if i else 0)) for i, g in reversed(list(enumerate(groups)))))
    return F.unhex(F.substring(body, F.lit(21) - used * 2, used * 2))


@dataclass(frozen=True)
class Field:
    """A field of a sparse record: class letter and, for S and B, its bound or length."""

    kind: str
    length: int = 0


def parse_record(data: bytes, schema: dict[int, Field], big: bool = False) -> dict[int, bytes | int] | None:
    """ordinal -> value of a sparse record (flag, then ordinals in rising order with their values, an end mark), or None."""
    order, at, out, last = (">" if big else "<"), 1, {}, -1
    if not 3 <= len(data) <= RECORD_LIMIT:
        return None
    while at + 2 <= len(data):
        (ordinal,) = struct.unpack_from(order + "H", data, at)
        at += 2
        if ordinal == END:
            return out if at == len(data) else None
        field = schema.get(ordinal)
        if field is None or ordinal <= last:
            return None
        if field.kind == "S":
            stop = data.find(b"\0", at, at + field.length)
            if stop < 0:
                return None
            out[ordinal], at = data[at:stop], stop + 1
        else:
            width = WIDTHS.get(field.kind, field.length)
            if at + width > len(data):
                return None
            raw, at = data[at : at + width], at + width
            out[ordinal] = int.from_bytes(raw, "big" if big else "little") if field.kind in "FILHU" else raw
        last = ordinal
    return None


def encode_record(fields: dict[int, bytes | int], schema: dict[int, Field], flag: int = 0, big: bool = False) -> bytes:
    order, out = (">" if big else "<"), [bytes([flag])]
    for ordinal in sorted(fields):
        value, field = fields[ordinal], schema[ordinal]
        out.append(struct.pack(order + "H", ordinal))
        if field.kind in "FILHU":
            out.append(int(value).to_bytes(WIDTHS[field.kind], "big" if big else "little"))
        elif field.kind == "S":
            if len(value) + 1 > field.length or b"\0" in value:
                raise ValueError("string does not fit its field")
            out.append(value + b"\0")
        else:
            if len(value) != WIDTHS.get(field.kind, field.length):
                raise ValueError("bytes do not fit their field")
            out.append(value)
    out.append(struct.pack(order + "H", END))
    body = b"".join(out)
    if len(body) > RECORD_LIMIT:
        raise ValueError("record too large")
    return body


def records_of(schema: dict[int, Field]):
    """A pandas function: binary records -> map of ordinal to value as text (hex for bytes), null if malformed."""

    def text(value: bytes | int, kind: str) -> str:
        return str(value) if isinstance(value, int) else value.decode("utf-8", "replace") if kind == "S" else value.hex()

    @F.pandas_udf("map<int,string>")
    def parse(data: pd.Series) -> pd.Series:
        found = (parse_record(bytes(x), schema) if x is not None else None for x in data)
        return pd.Series([None if r is None else {k: text(v, schema[k].kind) for k, v in r.items()} for r in found])

    return parse


def entropy(data: bytes) -> float:
    """Shannon entropy of the bytes, in bits per byte."""
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / max(1, n.sum())
    return float(-(p * np.log2(p)).sum())


def date_type32(data: Column) -> Column:
    """A date of four bytes, the year in two of them, highest first, then month and day; all zeros, a date that does not
    exist and other lengths are null."""
    year, month, day = byte(data, 0) * 256 + byte(data, 1), byte(data, 2), byte(data, 3)
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when((F.length(data) == 4) & (year > 0), F.try_to_date(text, "yyyy-MM-dd"))


def date_type32_bytes(date: Column) -> Column:
    return F.concat(hex_bytes(F.year(date), 2), hex_bytes(F.month(date), 1), hex_bytes(F.dayofmonth(date), 1))


def amount_type(data: Column) -> Column:
    """The type byte of an amount: 0 to 3, any other as null."""
    kind = byte(data, 0)
    return F.when(kind.between(0, 3), kind)


#: A long-value locator's length.
LOCATOR = 14


def long_value_locator(data: Column, marker: int, page_count: Column) -> Column:
    """struct<payload: bigint, page: bigint> of a locator of exactly LOCATOR bytes: its marker, the payload's length and the
    page it is on, least byte first; null unless the marker is this one, the length is not zero and the page is one of the file's."""
    word = lambda at: sum((byte(data, at + i).cast("bigint") * (1 << (8 * i)) for i in range(1, 4)), byte(data, at).cast("bigint"))
    mark, payload, page = byte(data, 0) + byte(data, 1) * 256, word(2), word(6)
    good = (F.length(data) == LOCATOR) & (mark == marker) & (payload > 0) & (page > 0) & (page < page_count)
    return F.when(good, F.struct(payload.alias("payload"), page.alias("page")))


def with_defaults(fields: Column, defaults: Column) -> Column:
    """A sparse record's fields (map) with the schema's defaults for those that it does not store."""
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(fields, k)), fields)


def table_id_of(page: Column, at: int) -> Column:
    """The table id in a materialised page's header, four bytes at a place, least first; zero is none."""
    found = sum((byte(page, at + i).cast("bigint") * (1 << (8 * i)) for i in range(1, 4)), byte(page, at).cast("bigint"))
    return F.when(found != 0, found)
