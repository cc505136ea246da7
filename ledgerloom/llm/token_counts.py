"""Token counts by rank-synchronous array merging.

The pre-tokens that a batch of texts needs are laid out as one ragged numpy
array of symbols. In each round every sequence finds its own lowest-rank
adjacent pair, and all sequences merge theirs at once (leftmost first where
occurrences overlap). A merge rank's token can only take part in pairs of
higher ranks, so merging every occurrence in one round gives what merging them
one by one gives. Sequences without a mergeable pair leave the array with their
number of symbols as their count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-tokens whose count a Python worker remembers; the table is emptied when full.
CACHE_ENTRIES = 500_000
#: Symbols merged in one ragged array.
ARRAY_SYMBOLS = 1 << 20
#: How the byte-level pre-tokeniser of such vocabularies splits text (a fixed value of the format).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_PAIR = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes for code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Counter:
    """Counts for one vocabulary file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(key)
        self.key = key[self.order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.symbol = np.array([vocab[c] for c in byte_symbols()], np.int64)
        special = sorted((a["content"] for a in spec["added_tokens"] if a["content"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(BYTE_LEVEL)
        self.known: dict[str, int] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.order[at], NO_PAIR).astype(np.int32)

    def merged_sizes(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols left of each non-empty piece."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.symbol[np.frombuffer(b"".join(pieces), np.uint8)]
        counts, active = size.copy(), np.arange(len(pieces))
        last = np.zeros(len(sym), bool)
        last[np.cumsum(size) - 1] = True
        rank = np.full(len(sym), NO_PAIR, np.int32)
        inner = np.flatnonzero(~last)
        rank[inner] = self.pair_ranks(sym[inner], sym[inner + 1])
        while len(active):
            starts = np.concatenate(([0], np.cumsum(size)[:-1]))
            least = np.minimum.reduceat(rank, starts)
            live = least < NO_PAIR
            if not live.all():
                counts[active[~live]] = size[~live]
                keep = np.repeat(live, size)
                sym, rank, last = sym[keep], rank[keep], last[keep]
                active, size, least = active[live], size[live], least[live]
                if not len(active):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            fresh = np.ones(len(hit), bool)
            fresh[1:] = np.diff(hit) > 1
            run = np.flatnonzero(fresh)  # in a run of overlapping occurrences, every other one merges
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            last[hit] = last[hit + 1]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            owner = np.repeat(np.arange(len(size)), size)[hit]
            size = size - np.bincount(owner, minlength=len(size))
            moved = np.cumsum(keep) - 1
            sym, rank, last = sym[keep], rank[keep], last[keep]
            at = moved[hit]
            left = at[at > 0] - 1
            at = np.concatenate((at, left))
            inside = ~last[at]
            rank[at[~inside]] = NO_PAIR
            at = at[inside]
            rank[at] = self.pair_ranks(sym[at], sym[at + 1])
        return counts

    def learn(self, pieces: list[str]) -> None:
        encoded = [p.encode() for p in pieces]
        start = symbols = 0
        for i, e in enumerate(encoded):
            symbols += len(e)
            if symbols >= ARRAY_SYMBOLS or i == len(encoded) - 1:
                self.known.update(zip(pieces[start : i + 1], self.merged_sizes(encoded[start : i + 1]).tolist(), strict=True))
                start, symbols = i + 1, 0

    def counts(self, texts: list[str]) -> list[int]:
        """Special strings count one token each, as the library's default has it; the rest is split and merged."""
        found, extra = [], []
        for text in texts:
            parts, n = [text], 0
            if self.special and self.special.search(text):
                parts, n = self.special.split(text), len(self.special.findall(text))
            found.append([p for part in parts for p in self.split.findall(part)])
            extra.append(n)
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        if new := list({p for own in found for p in own}.difference(self.known)):
            self.learn(new)
        return [n + sum(map(self.known.__getitem__, own)) for own, n in zip(found, extra, strict=True)]


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One per Python worker and vocabulary."""
    return Counter(path)


def count_tokens(df: DataFrame, path: str, keep: list[str], text: str = "text", limit: int = 1024) -> DataFrame:
    """The columns `keep` of df with n_bytes, n_tokens (long) and over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens). Rows are counted where they are
    read; repeated rows are counted each. Other columns of df are not looked at.
    """
    kept = df.select(*(F.col(c) for c in keep), F.coalesce(F.col(text), F.lit("")).cast("string").alias("__text"))
    kept = kept.withColumn("n_bytes", F.octet_length("__text").cast("long")).select(*kept.columns[:-1], "n_bytes", "__text")
    fields = [*kept.schema.fields[:-1], T.StructField("n_tokens", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            rows = max(1, batch.num_rows * (4 << 20) // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                n = pa.array(own.counts(part.column(part.num_columns - 1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], n], names=[f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields)).withColumn("over_limit", F.col("n_tokens") > limit)
