"""SimHash near-duplicate detection over a Gray-ordered hierarchical index.

1. Fingerprints: one pass over the texts where they lie; only (id, fingerprint) leaves the tasks.
2. Equal fingerprints collapse to one row (map-side combined), so copies of a text cost nothing more.
3. Two fingerprints at most three bits apart agree on all but three of any blocks their bits are cut
   into: on one of four 16-bit blocks, on two of five, on three of six. Each distinct fingerprint goes to one
   bucket for every such choice, by the bits of the chosen blocks; blocks and buckets follow the number of
   fingerprints, so buckets stay small at any size. A bucket that is still large is dealt into chunks, and
   each pair of chunks is one task: exact, whatever the skew.
4. In a task the fingerprints are sorted by Gray rank and indexed as a tree: a node keeps the mask
   and the pattern of the bits that all below it share and that no upper node holds. A search adds
   up the differences on the way down and drops a whole group once they exceed the radius.
5. A task returns, for each fingerprint with a neighbour, one link to the least fingerprint of its
   local component: as many rows as fingerprints, never all pairs. Links are joined into global
   components by alternating large-star and small-star steps.

The pipeline's stage asks for more than three bits can hold: pairs whose sets of five-word shingles have a
Jaccard similarity of 0.8 differ by about ten bits. `drop_near_duplicates` therefore takes its candidates first
from this index, over fingerprints of five-word shingles, and then, for the pairs beyond three bits, from MinHash
bands. Pairs that share a band are first held against bit maps of their sets, which differ in at most as many bits as the
sets do in elements: what they rule out is ruled out for certain. What is left is confirmed by the exact sets; the
components are joined as above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import batches_of, cut, cut_narrow, small

RADIUS = 3
#: Most fingerprints for which they are cut into so many blocks; beyond the last, into one more. All give the same links.
BLOCKS = ((4, 1 << 27), (5, 1 << 37), (6, 1 << 63))
#: A fingerprint with more than this share of all rows is hot; there are fewer than 1 / HOT of them.
HOT = 1 / 4096
#: Children of an index node.
FAN = 16
#: Distinct fingerprints aimed at in a bucket, and from which a bucket is dealt into chunks.
BUCKET, CHUNK = 4096, 16384
#: Shingles hashed and summed at a time.
SHINGLES = 1 << 14
#: Rows with texts in one batch.
WIDE = 512
#: Fingerprints looked up in an index at a time.
QUERIES = 128
SEED = 42
#: The pipeline's stage: words of a shingle, and least Jaccard similarity of the sets of two near copies.
STAGE_WIDTH, STAGE_JACCARD = 5, 0.8
#: MinHash bands and values in each: a pair at 0.8 shares no band with a probability of (1 - 0.8**4)**20 = 2.7e-5.
BANDS, BAND_ROWS = 20, 4
#: Members of a MinHash bucket from which it is dealt into chunks, and members aimed at in a task's group of small buckets.
MEMBERS, GROUP = 4096, 8192
#: Pairs for each member up to which all pairs of a bucket are tested, in the first turns; from then on, whatever their number.
PAIRS = (1, 8, 8, 8)
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: str | None) -> list[bytes]:
    """ASCII letters lower-cased, words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The hashes of the word shingles in order, repeats included, some at a time; a shorter sequence is one shingle."""
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=ends[1:])
    width = min(width, len(words))
    for at in range(0, len(words) - width + 1 if words else 0, SHINGLES):
        some = zip(ends[at : at + SHINGLES].tolist(), ends[at + width : at + width + SHINGLES].tolist(), strict=False)
        yield np.fromiter((digest(joined[a : b - 1], SEED) for a, b in some), np.uint64)


def majority(parts: Iterator[np.ndarray] | list[np.ndarray]) -> int:
    """The SimHash of shingle hashes, as a signed number: bits that are set in over half of them; none gives 0."""
    total, count = np.zeros(64, np.int64), 0
    for hashes in parts:
        total += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        count += len(hashes)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big", signed=True)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles: ASCII letters lower-cased, words between ASCII
    white space, repeated shingles counted each; a shorter sequence is one shingle; no word gives 0."""
    return majority(shingle_hashes(_words(text), width))


def fingerprints(df: DataFrame, keep: list[str], text: str = "text", width: int = 3) -> DataFrame:
    """The columns `keep` of df with fp (long, the 64 bits). A null text counts as empty: 0."""
    kept = df.select(*(F.col(c) for c in keep), F.coalesce(F.col(text), F.lit("")).cast("string").alias("__text"))
    fields = [*kept.schema.fields[:-1], T.StructField("fp", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), width) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=[f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray order (the prefix parity of its bits)."""
    out = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """levels[0]: the fingerprints; above, for each group of FAN: the residual mask and pattern of shared bits."""

    def __init__(self, fps: np.ndarray, turn: int):
        """turn: the codes are rotated left by so many bits before they are ranked."""
        turned = (fps << np.uint64(turn)) | (fps >> np.uint64(64 - turn)) if turn else fps
        self.order = np.argsort(gray_rank(turned), kind="stable")
        self.fps = fps[self.order]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        masks, patterns = [np.full(len(fps), full)], [self.fps]
        while len(masks[-1]) > FAN:
            starts = np.arange(0, len(masks[-1]), FAN)
            both = np.bitwise_and.reduceat(masks[-1], starts)
            both &= ~(np.bitwise_or.reduceat(patterns[-1], starts) ^ np.bitwise_and.reduceat(patterns[-1], starts))
            masks.append(both)
            patterns.append(patterns[-1][starts] & both)
        self.levels = []
        for k, (mask, pattern) in enumerate(zip(masks, patterns, strict=True)):
            own = mask & ~np.repeat(masks[k + 1], FAN)[: len(mask)] if k + 1 < len(masks) else mask
            self.levels.append((own, pattern & own))

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into queries, index into self.fps) at most radius bits apart."""
        top = len(self.levels[-1][0])
        q, node = np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries))
        gone = np.zeros(len(q), np.uint8)
        for k in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[k]
            gone = gone + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            left = gone <= radius
            q, node, gone = q[left], node[left], gone[left]
            if k:
                below = len(self.levels[k - 1][0])
                q, gone = np.repeat(q, FAN), np.repeat(gone, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = node < below
                q, node, gone = q[inside], node[inside], gone[inside]
        return q, node


def least_of_component(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label: each node's root, a node whose own label is itself; roots of linked nodes merge into the least."""
    while True:
        x, y = label[a], label[b]
        if not (apart := x != y).any():
            return label
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def local_links(left: np.ndarray, right: np.ndarray | None, turn: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint of its component) for those with a neighbour: among left, or
    between left and right. Unsigned input; nodes are numbered by value, so the least is the least value."""
    nodes = np.unique(left if right is None else np.concatenate((left, right)))
    label = np.arange(len(nodes))
    index = GrayIndex(np.unique(left if right is None else right), turn)
    place = np.searchsorted(nodes, index.fps)
    queries = index.fps if right is None else np.unique(left)
    for at in range(0, len(queries), QUERIES):
        some = queries[at : at + QUERIES]
        q, found = index.near(some, radius)
        a, b = np.searchsorted(nodes, some)[q], place[found]
        label = least_of_component(label, a[a != b], b[a != b])
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def agreements(blocks: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(mask, turn) for each choice of blocks on which two codes at most radius bits apart may agree: the blocks' bits, and
    how far left the codes are rotated to begin with them."""
    edges = [64 * i // blocks for i in range(blocks + 1)]  # from the highest bit
    block = [((1 << (b - a)) - 1) << (64 - b) for a, b in zip(edges, edges[1:], strict=False)]
    return [(sum(block[i] for i in chosen), edges[chosen[0]]) for chosen in combinations(range(blocks), blocks - radius)]


def links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Links (a, b), a > b as unsigned numbers, whose components are those of all pairs of the distinct
    non-null `fp` of fps at most radius (3 or fewer) bits apart. Materialised. blocks: 4 or more, by default as many as
    the number of fingerprints asks for; the links do not depend on it.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("the blocks find pairs that differ in three bits at most")
    count = fps.count()
    blocks = blocks or next(b for b, most in BLOCKS if count <= most)
    choices = agreements(blocks)
    n = 1 << max(0, (count // BUCKET)).bit_length()
    masks, turns = F.array(*(F.lit(_long(m)) for m, _ in choices)), [t for _, t in choices]
    dealt = fps.select("fp", F.posexplode(masks).alias("block", "mask"))
    value = F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), F.col("block"))
    dealt = dealt.select("fp", "block", (F.col("block").cast("long") * n + F.pmod(value, F.lit(n))).alias("bucket"))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("rows"))
    large = sizes.where(F.col("rows") > CHUNK).select("bucket", F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks"))
    dealt = dealt.join(small(cut_narrow(large), 16), "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int"))
    other = F.explode(F.expr("sequence(0, chunks - 1)")).alias("other")
    dealt = dealt.select("fp", "block", "bucket", "chunk", other).select(
        "fp", "block", "bucket", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, chunk, i, j = pdf["fp"].to_numpy().view(np.uint64), pdf["chunk"].to_numpy(), pdf["i"].iat[0], pdf["j"].iat[0]
        left, right = fp[chunk == i], (fp[chunk == j] if i != j else None)
        if not len(left) or right is not None and not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        a, b = local_links(left, right, turns[int(pdf["block"].iat[0])], radius)
        return pd.DataFrame({"a": _signed(a), "b": _signed(b)})

    return cut_narrow(dealt.groupBy("bucket", "i", "j").applyInPandas(search, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the edges (a, b: long) the least node, in signed order, of its component.

    Large-star and small-star steps alternate until nothing changes; each step sends an
    edge to one neighbour's least node, so the number of rows never grows. Joins on a
    node with many neighbours are left to adaptive skew handling; minima combine map-side.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    both, before = cut_narrow(both), None
    while True:
        around = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(down, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        both = cut_narrow(small.union(down.select("a", F.col("m").alias("b"))).distinct())
        now = both.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return both.select(F.col("a").alias("node"), F.col("b").alias("root")).union(both.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) of every row of df: component_id is the least id reachable over links of
    fingerprints at most radius bits apart, the row's own included.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows come
    back each. A null id keeps its row; it never names a component unless all ids there are null.
    An empty table gives an empty result. Other columns of df are not looked at.
    """
    marked = cut(fingerprints(df, [id_col], text, width))
    groups = cut(marked.groupBy("fp").agg(F.min(id_col).alias("own"), F.count("*").alias("rows")))
    roots = components(links(groups.select("fp"), radius))
    linked = groups.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("own").alias("least"))
    named = linked.join(least, "root").select("fp", "least")
    table = cut(groups.join(named, "fp", "left").select("fp", "rows", F.coalesce("least", "own").alias("component_id")))
    # rows of a hot fingerprint stay where they are: fewer than 1 / HOT fingerprints are broadcast; no other holds more rows
    edge = F.lit(max(1.0, HOT * (groups.agg(F.sum("rows")).first()[0] or 0)))
    hot, rest = F.broadcast(table.where(F.col("rows") > edge).drop("rows")), table.where(F.col("rows") <= edge).drop("rows")
    cold = marked.join(hot.select("fp"), "fp", "left_anti").join(rest, "fp")
    return marked.join(hot, "fp").unionByName(cold).select(id_col, "fp", "component_id")


def shingle_set(text: str | None, width: int = STAGE_WIDTH) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; a shorter sequence is one shingle, no word none."""
    parts = list(shingle_hashes(_words(text), width))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are the same."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key for each band of BAND_ROWS MinHash values of a set; no key of an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 1 << 10):
        least = np.minimum(least, (hashes[at : at + (1 << 10), None] * FACTORS).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


def bit_map(hashes: np.ndarray) -> bytes:
    """A map of a set's hashes in two to four bits for each, every hash turning one bit over. Common hashes turn the same
    bits, so the maps of two sets differ in at most as many bits as the sets in elements; a map folds to half its size."""
    bits = max(64, 2 << max(0, len(hashes) - 1).bit_length())
    turned = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(turned.astype(np.uint8), bitorder="little").tobytes()


class BitMaps:
    """The maps of some sets, by length; a set without a map is near to all."""

    def __init__(self, sizes: np.ndarray, maps: list[bytes | None], least: float):
        self.sizes, self.least = sizes.astype(np.float64), least
        self.words = np.array([len(m) // 8 if m else 0 for m in maps])
        self.place, self.tables = np.zeros(len(maps), np.int64), {}
        for n in np.unique(self.words[self.words > 0]).tolist():
            own = np.flatnonzero(self.words == n)
            self.place[own] = np.arange(len(own))
            self.tables[n] = np.frombuffer(b"".join(maps[i] for i in own), np.uint64).reshape(-1, n)

    def apart(self, one: int, others: np.ndarray) -> np.ndarray:
        """For each of the others the least share that the difference may have of both sets' elements; over 1: ruled out.
        A Jaccard similarity of `least` allows sizes in that ratio and a difference of (1 - least) / (1 + least)."""
        a, b = self.sizes[one], self.sizes[others]
        out = np.where(np.minimum(a, b) >= self.least * np.maximum(a, b) * (1 - 1e-9), 0.0, np.inf)
        for n, table in self.tables.items():
            some = np.flatnonzero((self.words[others] == n) & (out == 0))
            if not len(some) or not self.words[one]:
                continue
            x, y = self.tables[int(self.words[one])][self.place[one]][None], table[self.place[others[some]]]
            while x.shape[1] != y.shape[1]:
                if x.shape[1] > y.shape[1]:
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                else:
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            out[some] = differ / np.maximum((a + b[some]) * (1 - self.least) / (1 + self.least) * (1 + 1e-9), 1e-9)
        out[(self.words[others] == 0) | (self.words[one] == 0)] = 0
        return out


def forest(maps: BitMaps, root: np.ndarray, side: np.ndarray | None, order: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs that the maps allow, of different roots (and sides): as many as join all roots that such pairs join."""
    open_ = np.ones(len(root), bool)
    for start in order.tolist():
        queue = []
        if open_[start]:
            queue = np.flatnonzero(root == root[start]).tolist()
            open_[queue] = False
        while queue:
            x = queue.pop()
            others = np.flatnonzero(open_ if side is None else open_ & (side != side[x]))
            if not len(others):
                continue
            apart = maps.apart(x, others)
            hit = np.argsort(apart, kind="stable")[: int((apart <= 1).sum())]
            for r, first in zip(*np.unique(root[others[hit]], return_index=True), strict=True):
                yield x, int(others[hit[first]])
                new = np.flatnonzero(open_ & (root == r))
                open_[new] = False
                queue += new.tolist()


def across(maps: BitMaps, root: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """All pairs that the maps allow, of different roots (and sides)."""
    for x in range(len(root) - 1):
        others = np.arange(x + 1, len(root))
        others = others[(root[others] != root[x]) & (True if side is None else side[others] != side[x])]
        yield from ((x, int(y)) for y in others[maps.apart(x, others) <= 1])


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _banded(df: DataFrame, text: str) -> DataFrame:
    """The other columns of df with, of the text's five-word shingles, node (long, the hash of their set), fp (long, their
    SimHash), bands (array<long>), size (long, of the set) and map (binary, its bit map)."""
    rest = [c for c in df.columns if c != text]
    kept = df.select(*rest, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    made = [T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    fields = [*kept.schema.fields[:-1], *made, T.StructField("size", T.LongType()), T.StructField("map", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, bands, sizes, maps = [], [], [], [], []
            for x in batch.column(batch.num_columns - 1):
                parts = list(shingle_hashes(_words(x.as_py()), STAGE_WIDTH))
                hashes = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
                nodes.append(_long(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)))
                fps.append(majority(parts))
                bands.append([_long(k) for k in band_keys(hashes)])
                sizes.append(len(hashes))
                maps.append(bit_map(hashes))
            columns = [*batch.columns[:-1], pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            columns += [pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields))


def _confirmed(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts have at least so large a Jaccard similarity. Materialised.

    texts_of: (node, text) of the nodes of a frame; only texts that stand in a pair are moved.
    """
    wanted = cut_narrow(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    texts = texts_of(wanted)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b").select("a", "b", "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, of_hub = None, shingle_set(None)
        for batch in batches:
            good = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != hub:  # rows come sorted by b
                    hub, of_hub = b, shingle_set(y.as_py())
                good.append(jaccard(shingle_set(x.as_py()), of_hub) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    with batches_of(pairs.sparkSession, WIDE):
        return cut_narrow(both.mapInArrow(run, "a long, b long"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _allowed(members: DataFrame, least: float, most: int | None, turn: int = 0) -> DataFrame:
    """(key, a, b, more): pairs of the members (key, node, size, map, chunks, root) of a bucket, of different roots, that their
    bit maps allow: all of them, or if these are over `most` for each member a spanning forest, another one in each turn;
    more: others may be left. Materialised.

    Small buckets are gathered into groups; one of several chunks is dealt into pairs of chunks.
    """
    n = members.count() // GROUP + 1
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")
    dealt = members.withColumn("chunk", chunk).withColumn("deal", F.when(F.col("chunks") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(n))))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    dealt = dealt.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other"), "one": F.col("chunks") == 1})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found, two = [], pdf["i"].iat[0] != pdf["j"].iat[0]
        for key, own in pdf.groupby("key", sort=False):
            root = own["root"].to_numpy()
            if (root == root[0]).all():
                continue
            node, maps = own["node"].to_numpy(), BitMaps(own["size"].fillna(0).to_numpy(), own["map"].tolist(), least)
            side = own["chunk"].to_numpy() if two else None
            bound = None if most is None else most * len(node)
            pairs = list(islice(across(maps, root, side), None if bound is None else bound + 1))
            if more := bound is not None and len(pairs) > bound:
                pairs = forest(maps, root, side, np.argsort(node * np.int64(2 * turn + 1), kind="stable"))
            found += [(key, node[x], node[y], more) for x, y in pairs]
        return pd.DataFrame(found, columns=["key", "a", "b", "more"]).astype({"key": "int64", "a": "int64", "b": "int64", "more": "bool"})

    columns = ["deal", "one", "i", "j", "key", "node", "root", "size", "map", "chunk"]
    return cut_narrow(dealt.select(*columns).groupBy("deal", "one", "i", "j").applyInPandas(search, "key long, a long, b long, more boolean"))


def jaccard_components(marked: DataFrame, texts_of: Callable[[DataFrame], DataFrame], least: float = STAGE_JACCARD) -> DataFrame:
    """(node, root) of the nodes linked over pairs of at least so large a Jaccard similarity; nodes without a link are left out.

    marked: (node, fp, bands), one row each, and where there are any (size, map), without which no pair is ruled out before
    its texts are compared. Candidates are tested in turns, so that few texts are compared: first those that the index over fp
    links; then those that the bit maps allow in buckets, one for a band, across the components that a bucket holds: all, or where
    they are many as few as would join these components, and again in the next turn. A pair is tested once, and every pair that
    is allowed is tested or has its nodes in one component in the end.
    """
    alike = marked.groupBy("fp").agg(F.min("node").alias("b"))
    same = marked.join(alike, "fp").select(F.col("node").alias("a"), "b")
    near = links(marked.select("fp").distinct()).select(F.col("a").alias("fp"), F.col("b").alias("fp2"))
    near = near.join(alike.withColumnRenamed("b", "a"), "fp").join(alike.select(F.col("fp").alias("fp2"), "b"), "fp2").select("a", "b")
    tested = cut_narrow(_ordered(same.union(near)))
    roots = components(_confirmed(tested, texts_of, least))

    described = [F.col(c) if c in marked.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("size", "long"), ("map", "binary"))]
    members = marked.select("node", *described, F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut_narrow(shared.select("key", F.ceil(F.col("n") / MEMBERS).cast("int").alias("chunks")))
    members = cut(members.join(small(shared, 16), "key"))  # the others can have no partner
    for turn, most in enumerate([*PAIRS, None]):
        rooted = members.join(small(roots, 16), "node", "left").withColumn("root", F.coalesce("root", "node"))
        allowed = _allowed(rooted, least, most, turn)
        if allowed.isEmpty():
            break
        new = cut_narrow(_ordered(allowed).join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(new)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_confirmed(new, texts_of, least)))
        left = allowed.where("more").select("key").distinct()
        if left.isEmpty():
            break
        members = members.join(small(left, 8), "key", "left_semi")
    return roots


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = STAGE_JACCARD) -> DataFrame:
    """One row of each group of near copies, all columns as they are: the one with the least id.

    Near copies are linked over pairs whose sets of STAGE_WIDTH-word shingles have a Jaccard similarity of
    at least `least`; candidates come from the SimHash index and from BANDS MinHash bands and are confirmed by their exact
    sets. A null id comes after all others and means nothing: rows are told apart by two hashes of all columns, the
    lesser of which settles ties of the id. An id may stand in several groups; each keeps its own row. Texts without a word
    are one group. An empty table gives an empty result.
    """
    values = [*(F.col(f"`{c}`") for c in df.columns), F.concat(*(F.col(f"`{c}`").isNull().cast("string") for c in df.columns))]
    marks = {f"__h{k}": F.xxhash64(F.lit(k), *values) for k in (1, 2)}
    rows = df.withColumns(marks)
    with batches_of(df.sparkSession, WIDE):
        marked = cut(_banded(rows.select(F.col(id_col).alias("__id"), *marks, F.col(text).alias("__t")), "__t"))
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", *marks)).alias("own")
    groups = cut(marked.groupBy("node").agg(first, *(F.first(c).alias(c) for c in ("fp", "bands", "size", "map"))))

    counted = cut_narrow(marked.groupBy(*marks).agg(F.count("*").alias("__rows")))
    repeats = not counted.where("__rows > 1").isEmpty()

    def texts_of(nodes: DataFrame) -> DataFrame:
        owners = cut_narrow(groups.join(nodes, "node", "left_semi").select("node", *(F.col(f"own.{m}").alias(m) for m in marks)))
        found = rows.select(*marks, F.col(text).alias("text")).join(small(owners, 32), [*marks]).select("node", "text")
        return found.dropDuplicates(["node"]) if repeats else found

    roots = jaccard_components(groups.drop("own"), texts_of, least)
    named = groups.select("node", "own").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min("own").alias("own")).select(*(F.col(f"own.{m}").alias(m) for m in marks))
    each = counted.join(best.withColumn("__best", F.lit(True)), [*marks], "left")
    each = cut_narrow(each.where("__best is null or __rows > 1"))  # all other rows stay as they are
    stay = rows.join(small(each.select(*marks), 32), [*marks], "left_anti")
    if not (more := each.where("__best")).isEmpty():
        stay = stay.unionByName(rows.join(small(more.select(*marks), 32), [*marks], "left_semi").dropDuplicates([*marks]))
    return stay.select(*(F.col(f"`{c}`") for c in df.columns))
