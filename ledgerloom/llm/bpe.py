"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens are merged on a linked list of byte offsets. A queue holds, for each
merge rank, a bucket of the offsets whose pair currently has that rank; a
three-level bitmap over the ranks gives the lowest non-empty bucket by
find-first-set. Entries that a neighbouring merge has outdated stay in their
bucket and are skipped when they come up. The work for a pre-token of n bytes is
O(n log n) at worst, so pre-tokens of megabytes are no problem; many short ones
share one run of the queue.

Rows are encoded where they are read: no shuffle, one Arrow batch at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-tokens whose ids a Python worker remembers; the table is emptied when full.
CACHE_ENTRIES = 400_000
#: Texts of more characters than this are pre-tokenised piecewise.
LONG_TEXT = 1 << 18
#: Bytes of pre-tokens that share one run of the queue.
RUN_BYTES = 1 << 17


class RankQueue:
    """Ranks 0..64**3-1 with buckets of offsets and find-first-set over three bitmap levels."""

    def __init__(self, ranks: int):
        words = (ranks >> 6) + 1
        self.low, self.mid, self.top = [0] * words, [0] * ((words >> 6) + 1), 0
        self.bucket: dict[int, list[int]] = {}

    def open(self, rank: int, at: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.bucket[rank] = at
        word, group = rank >> 6, rank >> 12
        self.low[word] |= 1 << (rank & 63)
        self.mid[group] |= 1 << (word & 63)
        self.top |= 1 << group

    def first(self) -> int:
        """The lowest rank that has a bucket, or -1."""
        if not self.top:
            return -1
        group = (self.top & -self.top).bit_length() - 1
        bits = self.mid[group]
        word = (group << 6) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return (word << 6) + (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """The bucket's offsets from left to right; the rank has no bucket any more."""
        word, group = rank >> 6, rank >> 12
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.mid[group] &= ~(1 << (word & 63))
            if not self.mid[group]:
                self.top &= ~(1 << group)
        held = self.bucket.pop(rank)
        held.sort()
        return held


class Encoder:
    """Encodes by the ranks of one file; remembers the ids of pre-tokens it has met."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.split = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.double = np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        self.known: dict[str, bytes] = {}

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each non-empty piece. All pieces share one list and one queue, with a wall after each.

        A pair that holds a merged token always ranks after that token, so a whole
        bucket can be worked off, left to right, before the next rank is looked for.
        """
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        buf = b"\0".join(pieces) + b"\0"
        n, rank_of, queue = len(buf), self.ranks.get, self.queue
        bucket = queue.bucket
        walls = np.cumsum(size + 1) - 1
        raw = np.frombuffer(buf, np.uint8)
        initial = np.full(n, -1, np.int64)
        initial[:-1] = self.double[raw[:-1], raw[1:]]
        initial[walls] = initial[walls - 1] = -1
        found = np.flatnonzero(initial >= 0)
        found = found[np.argsort(initial[found], kind="stable")]
        for some in np.split(found, np.flatnonzero(np.diff(initial[found])) + 1) if len(found) else []:
            queue.open(int(initial[some[0]]), some.tolist())
        wall = np.zeros(n + 1, bool)
        wall[walls] = wall[n] = True
        wall = bytearray(wall.tobytes())
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # offsets of the neighbouring tokens
        pair = initial.tolist()  # the rank of the pair that begins at an offset; -1: none, or no token begins there
        token = self.single[raw].tolist()
        while (rank := queue.first()) >= 0:
            for at in queue.take(rank):
                if pair[at] != rank:  # stale
                    continue
                gone = after[at]
                end = after[at] = after[gone]
                token[at], token[gone], pair[gone] = rank, -1, -1
                new = None
                if not wall[end]:
                    before[end] = at
                    new = rank_of(buf[at : after[end]])
                if new is None:
                    pair[at] = -1
                else:
                    pair[at] = new
                    held = bucket.get(new)
                    if held is None:
                        queue.open(new, [at])
                    else:
                        held.append(at)
                prior = before[at]
                if prior >= 0 and not wall[prior]:
                    new = rank_of(buf[prior:end])
                    if new is None:
                        pair[prior] = -1
                    elif pair[prior] != new:
                        pair[prior] = new
                        held = bucket.get(new)
                        if held is None:
                            queue.open(new, [prior])
                        else:
                            held.append(prior)
        ids = np.array(token, np.int64)
        ids[walls] = -1
        blob, ends = ids[ids >= 0].astype("<u4").tobytes(), (np.cumsum(ids >= 0)[walls] * 4).tolist()
        return [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, tokens: list[str]) -> None:
        start, held = 0, 0
        encoded = [x.encode() for x in tokens]
        whole = [self.ranks.get(x) for x in encoded]
        self.known.update((x, r.to_bytes(4, "little")) for x, r in zip(tokens, whole, strict=True) if r is not None)
        rest = [i for i, r in enumerate(whole) if r is None]
        for k, i in enumerate(rest):
            held += len(encoded[i])
            if held >= RUN_BYTES or k == len(rest) - 1:
                some, start, held = rest[start : k + 1], k + 1, 0
                self.known.update(zip([tokens[j] for j in some], self.merged([encoded[j] for j in some]), strict=True))

    def pieces(self, text: str) -> Iterator[list[str]]:
        """A very long text's pre-tokens, some at a time."""
        found = (m[0] for m in self.split.finditer(text))
        while some := list(islice(found, 50_000)):
            yield some

    def encode(self, texts: list[str]) -> list[bytes]:
        short = [self.split.findall(x) if len(x) <= LONG_TEXT else None for x in texts]
        self.prepare({p for own in short if own for p in own})
        out = [b"".join(map(self.known.__getitem__, own or ())) for own in short]
        for i, own in enumerate(short):
            if own is None:
                out[i] = b"".join(self.encode_some(some) for some in self.pieces(texts[i]))
        return out

    def encode_some(self, tokens: list[str]) -> bytes:
        self.prepare(set(tokens))
        return b"".join(map(self.known.__getitem__, tokens))

    def prepare(self, tokens: set[str]) -> None:
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        self.learn(list(tokens.difference(self.known)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker and vocabulary."""
    return Encoder(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", decoded: bool = False) -> DataFrame:
    """The columns `keep` of df with n_tokens (long), token_ids (binary: packed little-endian uint32)
    and, if asked for, the decoded bytes of those ids (binary).

    path: a rank file (base64 token, rank per line), readable on every executor.
    A null text counts as empty: no tokens, empty ids. Repeated rows are encoded each;
    an empty table gives an empty result. Other columns of df are not looked at.
    """
    kept = df.select(*(F.col(c) for c in keep), F.coalesce(F.col(text), F.lit("")).cast("string").alias("__text"))
    fields = [*kept.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]
    fields += [T.StructField("decoded", T.BinaryType())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        try:
            for batch in batches:
                rows = max(1, batch.num_rows * (1 << 20) // max(1, batch.nbytes))  # about 1 MB of input at a time
                for start in range(0, batch.num_rows, rows):
                    part = batch.slice(start, rows)
                    ids = own.encode(part.column(part.num_columns - 1).to_pylist())
                    out = [*part.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                    if decoded:
                        out.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])
        finally:
            own.known.clear()  # Spark keeps the worker for later stages; what it learned from these texts would stay with it

    return kept.mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, path: str, pattern: str, keep: list[str], ids: str = "token_ids") -> DataFrame:
    """The columns `keep` of df with the decoded bytes (binary) of packed ids; null ids decode to no bytes."""
    kept = df.select(*(F.col(c) for c in keep), F.coalesce(F.col(ids), F.lit(b"")).alias("__ids"))
    fields = [*kept.schema.fields[:-1], T.StructField("decoded", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            found = pa.array([own.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields))
