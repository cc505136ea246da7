"""Language identification by hierarchical discrimination.

First the language family is predicted, then one-versus-one linear support vector
machines tell the languages of that family apart. Features are relative counts
of hashed byte trigrams around letters, so a text of any length is scored by one
lookup and one sum per trigram, in Arrow batches, where it is read.

Beside the language a text gets its familiarity: the share of its trigrams that the
labelled rows have. Machines must choose one of the languages they know; familiarity tells
texts of none of them, and letters without any. The bound under which a text is rejected
is fixed on labelled rows: half of them against the trigrams of the other half, beside the same
texts with their letters shuffled.

The model is fitted on a sample of labelled rows whose size is bounded by
`sample_rows`; only sparse trigram counts of that sample reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The families of common language codes. Any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "turkic": "tr az kk uz ky tk tt",
    "indo-aryan": "hi bn mr gu pa ne ur",
    "sinitic": "zh yue wuu",
    "semitic": "ar he mt am",
    "uralic": "fi et hu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"
DIMENSIONS = 4096
#: Bytes scored at a time, and bytes of a batch that are looked at together.
PIECE, SLICE = 1 << 18, 1 << 20
#: Labelled rows that training may use, over all languages together.
SAMPLE_ROWS = 1600
#: Pieces of so many bytes of each sampled text are trained on too, so that short texts are at home in the model.
SHORT = 120
#: Bits of a trigram in the table of familiar ones, and trigrams below which a text is too short to be unfamiliar.
KNOWN_BITS, LEAST_TRIGRAMS = 20, 24
#: One sampled text in so many is shuffled.
NOISE = 4
#: The share of labelled texts whose familiarity may lie under the bound, and of shuffled ones that may lie above theirs.
TAIL = 0.002
#: ASCII other than letters is a boundary.
_ASCII = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang, lang)


def trigrams(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash of 32 bits) of each byte trigram with a letter in its middle; blob: UTF-8 of lower-case text."""
    raw = np.frombuffer(blob.translate(_ASCII), np.uint8)
    place = np.flatnonzero(raw[1:-1] != 32) + 1
    code = (raw[place - 1].astype(np.uint32) << 16) | (raw[place].astype(np.uint32) << 8) | raw[place + 1]
    return place, code * np.uint32(2654435761)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint32(32 - DIMENSIONS.bit_length() + 1)


def known_place(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint32(32 - KNOWN_BITS)


def _blob(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass") + b" "


def counts(blob: bytes) -> np.ndarray:
    return np.bincount(bucket(trigrams(blob)[1]), minlength=DIMENSIONS) if len(blob) > 2 else np.zeros(DIMENSIONS, np.int64)


def shuffled(text: str) -> str:
    """The text with its letters in another order, each word as long as before."""
    at = [i for i, ch in enumerate(text) if ch.isalpha()]
    out, order = list(text), np.random.default_rng(len(at)).permutation(len(at))
    for i, j in zip(at, order.tolist(), strict=True):
        out[i] = text[at[j]]
    return "".join(out)


def places_of(text: str) -> np.ndarray:
    """The distinct places of a text's trigrams in the table of familiar ones."""
    blob = _blob(text)
    return np.unique(known_place(trigrams(blob)[1])) if len(blob) > 2 else np.zeros(0, np.uint32)


@dataclass
class Machines:
    """One-versus-one machines over some classes: weights (DIMENSIONS, pairs), margins' scale and shift."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weight: np.ndarray
    bias: np.ndarray
    slope: np.ndarray
    shift: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class with most votes, the sum of margins deciding ties, and its mean calibrated probability."""
        n, k = len(margins), len(self.classes)
        if k == 1:
            return np.zeros(n, np.int64), np.ones(n)
        votes, total, prob = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
        for c, (i, j) in enumerate(self.pairs):
            m = margins[:, c]
            p = 1 / (1 + np.exp(-np.clip(self.slope[c] * m + self.shift[c], -40, 40)))
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            total[:, i] += np.tanh(m)
            total[:, j] -= np.tanh(m)
            prob[:, i] += p
            prob[:, j] += 1 - p
        best = np.argmax(votes + total / (4 * k), axis=1)
        return best, prob[np.arange(n), best] / (k - 1)


def fit_pair(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 120) -> tuple[np.ndarray, float, float, float]:
    """A linear machine (squared hinge, ridge) by accelerated gradient descent on y = +-1, and its
    calibration: the logistic curve over margins that fits held-in labels best, smoothed as Platt does."""
    n = len(y)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    z = np.random.default_rng(0).normal(size=x.shape[1]).astype(np.float32)
    for _ in range(8):
        z = x.T @ (share * (x @ z))
        norm = float(np.linalg.norm(z)) or 1.0
        z /= norm
    rate = 1 / (2 * 1.2 * (norm + 1.0) + penalty)
    w, b, pw, pb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    for step in range(steps):
        speed = step / (step + 3)
        vw, vb = w + speed * (w - pw), b + speed * (b - pb)
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * share * -2 * y
        pw, pb = w, b
        w, b = vw - rate * (x.T @ slack + penalty * vw), vb - rate * float(slack.sum())
    m = x @ w + b
    plus, minus = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (plus + 1) / (plus + 2), 1 / (minus + 2))
    slope, shift = 2.0, 0.0
    for _ in range(100):  # Newton steps, damped
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -40, 40)))
        g, h = np.array([((p - goal) * m).sum(), (p - goal).sum()]) / n, p * (1 - p) / n
        hess = np.array([[(h * m * m).sum() + 1e-4, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-4]])
        delta = np.linalg.solve(hess, g)
        slope, shift = max(0.1, slope - 0.5 * delta[0]), shift - 0.5 * delta[1]
    return w, b, float(slope), float(shift)


def fit_machines(x: np.ndarray, labels: np.ndarray) -> Machines:
    classes = sorted(set(labels.tolist()))
    pairs = list(combinations(range(len(classes)), 2))
    found = []
    for i, j in pairs:
        own = (labels == classes[i]) | (labels == classes[j])
        found.append(fit_pair(x if own.all() else x[own], np.where(labels[own] == classes[i], 1, -1).astype(np.float32)))
    weight = np.stack([f[0] for f in found], 1) if found else np.zeros((DIMENSIONS, 0), np.float32)
    rest = np.array([f[1:] for f in found], np.float64).reshape(-1, 3)
    return Machines(classes, pairs, weight, rest[:, 0], rest[:, 1], rest[:, 2])


@dataclass
class Model:
    families: Machines | None = None
    within: dict[str, Machines] = field(default_factory=dict)
    known: np.ndarray = field(default_factory=lambda: np.zeros(1 << KNOWN_BITS, bool))
    #: Texts of lower familiarity are in none of the languages.
    bound: float = 0.0

    def parts(self) -> list[Machines]:
        return [self.families, *self.within.values()] if self.families else []

    def table(self) -> np.ndarray:
        """All machines' weights side by side, so that one lookup serves them all."""
        return np.ascontiguousarray(np.concatenate([m.weight for m in self.parts()] or [np.zeros((DIMENSIONS, 0))], 1).astype(np.float32))

    def predict(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score from the mean table row of each text."""
        n = len(means)
        if not self.families:
            return np.full(n, UNKNOWN, object), np.zeros(n)
        at = self.families.weight.shape[1]
        family, score = self.families.decide(means[:, :at] + self.families.bias)
        out = np.empty(n, object)
        for f, (name, machines) in enumerate(self.within.items()):
            width, own = machines.weight.shape[1], family == f
            best, prob = machines.decide(means[own, at : at + width] + machines.bias)
            out[own] = np.array(machines.classes, object)[best]
            score[own] *= prob
            at += width
        return out, np.clip(score, 0, 1)


#: language, trigram buckets, their counts, and of a whole text the places of its trigrams and, of one in NOISE, of those of its shuffled letters.
Sample = list[tuple[str, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]


def familiar_bound(texts: list[tuple[np.ndarray, np.ndarray | None]]) -> float:
    """Halfway between the familiarity of labelled texts and of shuffled ones, each against the other half's trigrams.

    Here distinct trigrams count once each, which puts the labelled texts a little lower than scoring does. The lowest TAIL of the labelled texts and the highest TAIL of the shuffled ones are left aside; the bound is never above
    the labelled texts' end, so it rejects next to none of them.
    """
    long = [(a, b) for a, b in texts if len(a) >= LEAST_TRIGRAMS]
    if len(long) < 4:
        return 0.0
    good, noise = [], []
    for half in (0, 1):
        known = np.zeros(1 << KNOWN_BITS, bool)
        for a, _ in long[1 - half :: 2]:
            known[a] = True
        for a, b in long[half::2]:
            good.append(known[a].mean())
            if b is not None and len(b):
                noise.append(known[b].mean())
    if not noise:
        return 0.0
    low, high = float(np.quantile(good, TAIL)), float(np.quantile(noise, 1 - TAIL))
    return (low + min(low, high)) / 2


def fit(rows: Sample) -> Model:
    """The model of sampled rows."""
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return Model()
    langs = np.array([r[0] for r in rows], object)
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, (_, at, n, *_) in enumerate(rows):
        x[i, at] = n / n.sum()
    mean, square = x.mean(axis=0), np.einsum("ij,ij->j", x, x) / len(x)
    scale = 1 / np.sqrt(mean + 1e-5)  # rare trigrams count for more; folded into the weights below
    scale /= np.sqrt((np.maximum(0, square - mean**2) * scale**2).sum() + 1e-12) + 1e-6
    x *= scale
    family = np.array([family_of(lang) for lang in langs], object)
    whole = [(r[3], r[4]) for r in rows if r[3] is not None]
    model = Model(fit_machines(x, family), bound=familiar_bound(whole))
    for places, _ in whole:
        model.known[places] = True
    for name in model.families.classes:
        model.within[name] = fit_machines(x[family == name], langs[family == name])
    for m in model.parts():
        m.weight = m.weight * scale[:, None]
    return model


def sample_counts(df: DataFrame, text: str, lang: str, id_col: str, sample_rows: int = SAMPLE_ROWS) -> Sample:
    """Trigram counts of a sample of labelled rows: about equally many of each language, sample_rows of them in all.

    A row is drawn if a hash of its id falls under its language's rate, so copies of one text are not drawn together. Each
    gives the counts of its whole text and of two short pieces of it. Ids that repeat may draw more rows than meant;
    beyond twice as many the rates are halved until they do not, the same way every time. More languages than
    sample_rows raise.
    """
    own = df.where(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    own = own.select(F.col(lang).alias("__lang"), F.col(text).alias("__text"), F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 30)).alias("__u"))
    sizes = {r[0]: r[1] for r in own.groupBy("__lang").count().limit(sample_rows + 1).collect()}
    if len(sizes) > sample_rows:
        raise ValueError("more languages than rows to sample")
    if not sizes:
        return []
    each = max(1, sample_rows // len(sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {"lang": [], "packed": [], "places": [], "noise": []}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blob = _blob(text)
                third = len(blob) // 3
                for i, piece in enumerate((blob, blob[third : third + SHORT], blob[2 * third : 2 * third + SHORT // 3])):
                    c = counts(piece)
                    at = np.flatnonzero(c)
                    made["lang"].append(lang)
                    made["packed"].append(np.stack((at, c[at])).astype("<u4").tobytes())
                    made["places"].append(places_of(text).astype("<u4").tobytes() if i == 0 else None)
                    made["noise"].append(places_of(shuffled(text)).astype("<u4").tobytes() if i == 0 and len(blob) % NOISE == 0 else None)
            yield pa.RecordBatch.from_arrays([pa.array(made["lang"], pa.string()), *(pa.array(made[c], pa.binary()) for c in ("packed", "places", "noise"))], names=list(made))

    share = 1.0
    while True:
        rate = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(share * min(1.0, each / n) * (1 << 30))))))
        drawn = own.where(F.col("__u") < F.try_element_at(rate, F.col("__lang"))).select("__lang", "__text")
        found = drawn.mapInArrow(run, "lang string, packed binary, places binary, noise binary").limit(3 * 2 * sample_rows + 1).collect()
        if len(found) <= 3 * 2 * sample_rows:
            break
        share /= 2
    read = lambda x: None if x is None else np.frombuffer(x, "<u4").astype(np.int64)
    out = []
    for lang, packed, places, noise in sorted(map(tuple, found), key=lambda r: (r[0], bytes(r[1]))):
        at, n = np.frombuffer(packed, "<u4").reshape(2, -1)
        out.append((lang, at.astype(np.int64), n.astype(np.float32), read(places), read(noise)))
    return out


def sums(blobs: list[bytes], table: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean table row over each text's trigrams (zeros for none), and the share of them that is known (1 for few)."""
    width = table.shape[1]
    out, seen = np.zeros((len(blobs), width + 1)), np.zeros(len(blobs))
    start = 0
    while start < len(blobs):
        if len(blobs[start]) > PIECE:  # a long text is scored piecewise; neighbours share two bytes
            for at in range(0, len(blobs[start]) - 2, PIECE):
                _, hashes = trigrams(blobs[start][at : at + PIECE + 2])
                out[start, :width] += table[bucket(hashes)].sum(axis=0, dtype=np.float64)
                out[start, width] += known[known_place(hashes)].sum()
                seen[start] += len(hashes)
            start += 1
            continue
        end, size = start, 0
        while end < len(blobs) and size + len(blobs[end]) <= PIECE:
            size += len(blobs[end])
            end += 1
        place, hashes = trigrams(b"".join(blobs[start:end]))
        edges = np.searchsorted(place, np.cumsum([0, *map(len, blobs[start:end])]))
        n = np.diff(edges)
        full = np.flatnonzero(n)
        if len(full):
            rows = table[bucket(hashes)]
            for c in range(width):
                out[start + full, c] = np.add.reduceat(rows[:, c].astype(np.float64), edges[:-1][full])
            out[start + full, width] = np.add.reduceat(known[known_place(hashes)].astype(np.int64), edges[:-1][full])
        seen[start:end] = n
        start = end
    out /= np.maximum(seen, 1)[:, None]
    return out[:, :width], np.where(seen < LEAST_TRIGRAMS, 1.0, out[:, width])


def predict(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of df with lang_pred (string), score and familiar (double, 0 to 1).

    Texts that are null or hold no letter get `und`, 0 and 0; so do all if nothing could be learned. familiar is 1 for
    texts of fewer than LEAST_TRIGRAMS trigrams, which are too short to tell. Columns of keep that bear these names are
    replaced. Texts of any length are scored whole, rows where they are read, repeated rows each; a tie of votes goes to the
    larger sum of margins, then to the first in alphabetical order. An empty table gives an empty result.
    """
    lettered = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    made = {"lang_pred": T.StringType(), "score": T.DoubleType(), "familiar": T.DoubleType()}
    kept = df.select(*(F.col(c) for c in keep if c not in made), F.when(lettered, F.col(text)).cast("string").alias("__text"))
    fields = [*kept.schema.fields[:-1], *(T.StructField(c, t) for c, t in made.items())]
    table, known = model.table(), model.known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                texts = part.column(part.num_columns - 1).to_pylist()
                has = np.array([t is not None for t in texts], bool)
                langs, scores, shares = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts))
                if has.any() and model.families:
                    means, shares[has] = sums([_blob(t) for t in texts if t is not None], table, known)
                    langs[has], scores[has] = model.predict(means)
                found = [pa.array(langs.tolist(), pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], names=[f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields))


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32 leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model fitted on labelled rows that are not held out (a null id is not learned from)."""
    return fit(sample_counts(df.where(~held_out(id_col) & F.col(id_col).isNotNull()), text, lang, id_col, sample_rows))
