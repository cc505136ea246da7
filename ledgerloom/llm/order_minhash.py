"""Order MinHash fingerprints, and the pairing of every document with the next one.

A text's k-mers are numbered by occurrence, so repeats count. Each of m hash
functions picks the l least (k-mer, number) pairs; these are put back into text
order and hashed as one tuple. Two signatures agree in a place if the same
k-mers were picked and stand in the same order, which follows edit distance and
not just the k-mer sets.

Neighbours by id are found without a global sort: ids sampled by hash cut the id
range into buckets whose upper ends are ids that exist, so the document that
follows a bucket's last one is known by its id and travels to both buckets. The
texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K, FUNCTIONS, PICKED = 8, 24, 2
#: Pairs looked at together by all hash functions.
PAIRS = 1 << 14
#: Text bytes aimed at in a bucket of neighbours: this much, more for inputs of many buckets.
BUCKET_BYTES, MOST_BUCKET_BYTES, BUCKETS = 4 << 20, 64 << 20, 4096
OVERSAMPLE = 8
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MULTIPLIERS = _mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def kmer_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each k-mer of code points; a shorter non-empty text is one k-mer."""
    h = _mix((points.astype(np.uint64) + np.uint64(1)) * GOLDEN)
    k = min(k, len(h))
    out, done, power = None, 0, np.uint64(0x2545F4914F6CDD1D)
    width, block, factor = 1, h, power
    while k:  # doubling: hashes of 1, 2, 4, ... points; those whose width is in k's binary form are joined
        if k & 1:
            if out is None:
                out, done = block, width
            else:
                n = len(h) - done - width + 1
                out = out[:n] * factor + block[done : done + n]
                done += width
        k >>= 1
        if k:
            block = block[:-width] * factor + block[width:]
            width, factor = width * 2, np.uint64(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF)
    return out


def signature(points: np.ndarray) -> np.ndarray:
    """FUNCTIONS 32-bit numbers; all zero for an empty text."""
    if not len(points):
        return np.zeros(FUNCTIONS, np.uint32)
    h = kmer_hashes(points)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    first = np.ones(len(h), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    start = np.flatnonzero(first)
    number = np.empty(len(h), np.uint64)
    number[order] = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    z = _mix(h + number * GOLDEN)
    best, at = None, None
    for base in range(0, len(z), PAIRS):
        values = MULTIPLIERS[:, None] * z[None, base : base + PAIRS]
        least = min(PICKED, values.shape[1])
        rows = np.arange(FUNCTIONS)
        some_best, some_at = [], []
        for _ in range(least):
            i = values.argmin(axis=1)
            some_best.append(values[rows, i])
            some_at.append(i + base)
            values[rows, i] = np.uint64(0xFFFFFFFFFFFFFFFF)
        some_best, some_at = np.stack(some_best, 1), np.stack(some_at, 1)
        if best is not None:
            some_best, some_at = np.concatenate((best, some_best), 1), np.concatenate((at, some_at), 1)
        keep = np.argsort(some_best, axis=1, kind="stable")[:, :PICKED]
        best, at = np.take_along_axis(some_best, keep, 1), np.take_along_axis(some_at, keep, 1)
    picked = z[np.sort(at, axis=1)]
    out = np.full(FUNCTIONS, GOLDEN)
    for c in range(picked.shape[1]):
        out = _mix(out * np.uint64(31) + picked[:, c])
    return (out >> np.uint64(32)).astype(np.uint32)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of places in which two signatures agree."""
    return float((a == b).mean())


def hex_of(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprints(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of df with fingerprint (hex string). A null text counts as empty. No shuffle."""
    kept = df.select(*(F.col(c) for c in keep), F.coalesce(F.col(text), F.lit("")).cast("string").alias("__text"))
    fields = [*kept.schema.fields[:-1], T.StructField("fingerprint", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hex_of(signature(points_of(x.as_py()))) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=[f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields))


def neighbour_buckets(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(bucket, tail, __id, __text): every row once in its bucket, and with tail set the rows that hold
    the id that follows a bucket's least. Larger ids are in later buckets; null ids count as the least id."""
    own = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("__id"), F.coalesce(F.col(text), F.lit("")).cast("string").alias("__text"))
    rows, size, most = own.agg(F.count("*"), F.sum(F.octet_length("__text").cast("long")), F.max("__id")).first()
    size = (size or 0) + 64 * rows
    target = max(BUCKET_BYTES, min(MOST_BUCKET_BYTES, size // BUCKETS))
    wanted = size // target
    cuts = np.zeros(0, np.int64)
    if wanted > 1:
        step = max(1, rows // (wanted * OVERSAMPLE))
        some = own.where(F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(step)) == 0).select("__id").distinct().toArrow()
        ids = np.sort(some.column(0).to_numpy())
        cuts = ids[:: max(1, len(ids) // wanted)] if len(ids) else cuts

    @F.pandas_udf("bucket int, follows int")
    def place(ids: pd.Series) -> pd.DataFrame:
        x = ids.to_numpy()
        bucket = np.searchsorted(cuts, x, side="left")
        is_cut = (bucket < len(cuts)) & (cuts[np.minimum(bucket, len(cuts) - 1)] == x) if len(cuts) else np.zeros(len(x), bool)
        return pd.DataFrame({"bucket": bucket.astype("int32"), "follows": np.where(is_cut, bucket + 1, -1).astype("int32")})

    placed = own.withColumn("__place", place("__id"))
    to = F.array(
        F.struct(F.col("__place.bucket").alias("bucket"), F.lit(False).alias("tail")),
        F.struct(F.col("__place.follows").alias("bucket"), F.lit(True).alias("tail")),
        F.struct(F.when(F.col("__id") == F.lit(most), 0).otherwise(-1).alias("bucket"), F.lit(True).alias("tail")),
    )
    sent = placed.select("__id", "__text", F.explode(F.filter(to, lambda x: x["bucket"] >= 0)).alias("__to"))
    return sent.select("__to.bucket", "__to.tail", "__id", "__text")


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text replaces the last floor(n/2) code points by the first as many (or
    all) of the next document, descending by id; after the last comes the first. Columns:
    id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.
    A null text counts as empty; ties of the id are ordered by text, equal rows come back
    each; a null id counts as the least id; a lone document is its own next. An empty
    table gives an empty result.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, texts, tail = pdf["__id"].to_numpy(), pdf["__text"].to_numpy(), pdf["tail"].to_numpy()
        order = sorted(np.flatnonzero(~tail).tolist(), key=lambda i: (-int(ids[i]), texts[i]))
        after = min(np.flatnonzero(tail).tolist(), key=lambda i: texts[i], default=None)
        known: dict[str, np.ndarray] = {}

        def sig(t: str) -> np.ndarray:
            found = known.get(t)
            if found is None:
                found = known[t] = signature(points_of(t))
            return found

        rows = []
        for k, i in enumerate(order):
            own, then = texts[i], texts[order[k + 1] if k + 1 < len(order) else after]
            half = len(own) // 2
            edited = own[: len(own) - half] + then[:half]
            a, b, c = sig(own), signature(points_of(edited)), sig(then)
            rows.append((int(ids[i]), len(own), edited, hex_of(a), hex_of(b), likeness(a, b), likeness(a, c)))
        return pd.DataFrame(rows, columns=["__id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "__id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    found = neighbour_buckets(df, id_col, text).groupBy("bucket").applyInPandas(run, schema)
    none = F.col("__id") == F.lit(-(1 << 63)).cast("long")
    return found.select(F.when(~none, F.col("__id")).alias(id_col), *found.columns[1:])


