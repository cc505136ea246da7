r"""Secret scanning with built-in SQL functions only.

Base kinds are found by pattern: assignments of credentials, access keys, long
hexadecimal runs. On top of these, candidate strings are judged by the Shannon
entropy of a window that slides over them: each character class has its own window
and bound. The window's symbol counts are kept, a byte for each symbol, in a few longs;
as a character leaves and one enters, two counts and the sum of c*log2(c) are changed,
so a candidate costs the same for each of its characters, however long it is. A
candidate whose highest window entropy reaches the bound of its class becomes a span of
kind `entropy`. Candidates on the allow-list (UUIDs, alphabets and digit ladders,
placeholders, one word in capitals or small letters) are suppressed; base spans never are.

Everything is one projection over the rows where they are read: no shuffle, no Python.
Positions are code points, the end exclusive. They are running sums of the lengths of the
matches and of the pieces between them, summed by doubling steps over the whole array, so
n matches of one text cost n log n.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Kind, pattern, group that must have so many characters.
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: Cheap tests that hold for every text with a base match of that kind.
GATES = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Class, what the whole candidate is made of and must hold, window, least entropy in bits; the first class that takes
#: a candidate judges it. Windows are no longer than a candidate must be; bounds lie between the values that windows of
#: text and of random draws have. Windows of glued words reach the entropy of random letters, so the classes without
#: base64's mixture also ask for digits between letters, or for capitals between small letters, as words do not have them.
CLASSES = (
    ("hexadecimal", r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$", 20, 3.05),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", 20, 3.45),
    ("lower", r"^(?=.*[0-9][a-z]+[0-9]+[a-z])[0-9a-z]+$", 20, 3.45),
    ("upper", r"^(?=.*[0-9][A-Z]+[0-9]+[A-Z])[0-9A-Z]+$", 20, 3.45),
    ("letters", r"^(?=.*[A-Z][a-z]{1,2}[A-Z]+[a-z]{1,2}[A-Z])[A-Za-z]+$", 20, 3.55),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+=*$", 20, 3.65),
)
#: Symbols with a count of their own; any other character counts as one more symbol.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Candidates that are no secrets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)(0123456789|1234567890|abcdefghij|example|placeholder|changeme|x{6}|lorem)",
    r"^[a-z]+$|^[A-Z]+$|^[0-9]+$",
    r"(.)\1{7}",
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lengths: Column) -> Column:
    """The running sums of an array: in step j each place adds what stands 2**j places before it."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(1)).cast("double"))).cast("int"))

    def doubled(sums: Column, j: Column) -> Column:
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), j)), F.lit(0)))

    return F.aggregate(steps, lengths, doubled)


def _marked(between: Column, whole: Column, rank: int, hits: Callable[[Column], Column], **more: Column) -> Column:
    """array<struct<s, k, e>> of the matches for which hits holds; between: the pieces before, between and behind them."""
    lengths = F.transform(F.arrays_zip(between.alias("b"), whole.alias("w")), lambda x: F.length(x["b"]) + F.coalesce(F.length(x["w"]), F.lit(0)))

    def spans(ends: Column) -> Column:
        found = F.arrays_zip(whole.alias("w"), F.slice(ends, F.lit(1), F.size(whole)).alias("e"), *(v.alias(k) for k, v in more.items()))
        kept = F.filter(found, lambda x: F.coalesce(hits(x), F.lit(False)))
        return F.transform(kept, lambda x: F.struct((x["e"] - F.length(x["w"])).alias("s"), F.lit(rank).alias("k"), x["e"].alias("e")))

    return _let(_let(lengths, _running), spans)


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<s, k, e>> of the matches of pattern whose group has at least so many characters."""
    rank = [k for k, *_ in BASE].index(kind)
    whole, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    if not group:
        return _marked(between, whole, rank, lambda x: F.length(x["w"]) >= least)
    return _marked(between, whole, rank, lambda x: F.length(x["t"]) >= least, t=F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def window_entropy(word: Column, width: int) -> Column:
    """The highest Shannon entropy, in bits, of the windows of `width` (at most 255) characters of word (-1: it is shorter).

    The accumulator holds the symbols' counts, eight to a long, and s, the sum of c*log2(c) over them; a step
    looks up and changes the counts of the character that leaves and of the one that enters.
    """
    if not 0 < width < 256:
        raise ValueError("a count has one byte")
    weigh = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 1)))
    code = F.transform(F.split(word, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    place = F.transform(code, lambda c: F.struct(F.call_function("shiftright", c, F.lit(3)).alias("slot"), F.call_function("shiftleft", c.bitwiseAND(7), F.lit(3)).alias("shift")))
    none = F.array(F.lit(None).cast("struct<slot:int,shift:int>"))
    slides = _let(place, lambda p: F.arrays_zip(p.alias("enters"), F.slice(F.concat(F.array_repeat(F.get(none, F.lit(0)), width), p), F.lit(1), F.size(p)).alias("leaves")))

    def count(counts: Column, at: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, at["slot"]), at["shift"]).bitwiseAND(255).cast("int")

    def unit(i: Column, at: Column) -> Column:
        return F.when(i == at["slot"], F.call_function("shiftleft", F.lit(1).cast("long"), at["shift"])).otherwise(F.lit(0).cast("long"))

    def step(acc: Column, x: Column) -> Column:
        enters, leaves, counts = x["enters"], x["leaves"], acc["counts"]
        same = F.coalesce(enters == leaves, F.lit(False))
        out, new = count(counts, leaves), count(counts, enters)
        less = F.when(leaves.isNotNull(), F.get(weigh, out - 1) - F.get(weigh, out)).otherwise(F.lit(0.0))
        s = F.when(same, acc["s"]).otherwise(acc["s"] + less + F.get(weigh, new + 1) - F.get(weigh, new))
        moved = F.transform(counts, lambda n, i: n - unit(i, leaves) + unit(i, enters))
        full = acc["seen"] + 1 >= width
        return F.struct(
            (acc["seen"] + 1).alias("seen"), s.alias("s"), F.when(full, F.least(acc["least"], s)).otherwise(acc["least"]).alias("least"),
            F.when(same, counts).otherwise(moved).alias("counts"),
        )

    zeros = F.array_repeat(F.lit(0).cast("long"), len(ALPHABET) // 8 + 1)
    start = F.struct(F.lit(0).alias("seen"), F.lit(0.0).alias("s"), F.lit(float("inf")).alias("least"), zeros.alias("counts"))
    found = F.aggregate(slides, start, step, lambda acc: acc["least"])
    return F.when(F.length(word) >= width, F.lit(math.log2(width)) - found / F.lit(float(width))).otherwise(F.lit(-1.0))


def is_random(word: Column) -> Column:
    """Whether the class that takes the candidate finds a window of enough entropy, and no allow-list entry holds."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | word.rlike(pattern)
    found = F.lit(False)
    for width in sorted({w for _, _, w, _ in CLASSES}):
        bound = F.lit(None).cast("double")
        for _, pattern, w, least in reversed(CLASSES):
            bound = F.when(word.rlike(pattern), F.lit(least if w == width else None)).otherwise(bound)
        highest = window_entropy(word, width)
        found = found | _let(bound, lambda b: F.when(b.isNotNull(), highest >= b).otherwise(False))  # noqa: B023, called at once
    return ~allowed & found


def _entropy_spans(text: Column) -> Column:
    whole, between = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)
    return _marked(between, whole, len(BASE), lambda x: is_random(x["w"]))


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """df with base_spans and spans: arrays of (s, k, e) in order of start, then kind (0 assign, 1 access,
    2 hex, 3 entropy). A null text counts as empty. Spans of different kinds may overlap. Columns of df pass
    through, but for ones named base_spans or spans, which are replaced; repeated rows are scanned each. Texts and
    candidates of any length are scanned whole, in time that grows with their length. An empty table gives an empty result.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    found = [F.when(t.rlike(GATES[kind]), _spans(t, kind, *rest)).otherwise(none) for kind, *rest in BASE]
    rows = df.drop("base_spans", "spans").withColumn("__base", F.array_sort(F.concat(*found)))
    extra = F.when(t.rlike(r"[A-Za-z0-9+/_-]{20}"), _entropy_spans(t)).otherwise(none)
    rows = rows.withColumn("__all", F.array_sort(F.concat("__base", extra)))
    return rows.select(*(c for c in rows.columns if c not in ("__base", "__all")), F.col("__base").alias("base_spans"), F.col("__all").alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k, *_ in BASE), F.lit("entropy"))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def how_many(spans: Column, kind: str) -> Column:
    rank = [k for k, *_ in BASE].index(kind)
    return F.size(F.filter(spans, lambda x: x["k"] == rank)).cast("long")


def _sql_spans(words: str, between: str, rank: int, keep: str) -> str:
    """The SQL list of spans (s, k, e) of aligned lists of matches and of the pieces before them; keep is said of i."""
    upto = lambda of, end: f"coalesce(list_sum(list_transform({of}[1:{end}], lambda x: length(x))), 0)"
    start = f"({upto(between, 'i')} + {upto(words, 'i - 1')})"
    ids = f"list_filter(range(1, len({words}) + 1), lambda i: {keep})"
    return f"list_transform({ids}, lambda i: {{'s': CAST({start} AS BIGINT), 'k': {rank}, 'e': CAST({start} + length({words}[i]) AS BIGINT)}})"


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def oracle() -> str:
    """op3 over `documents` in SQL; the entropy of each window is counted afresh."""
    parts, lists = [], []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        p = _sql_text(pattern)
        parts.append(f"regexp_extract_all(t, {p}, 0) AS {kind}_w, regexp_extract_all(t, {p}, {group}) AS {kind}_g, string_split_regex(t, {p}) AS {kind}_b")
        lists.append(_sql_spans(f"{kind}_w", f"{kind}_b", rank, f"length({kind}_g[i]) >= {least}"))
    c = _sql_text(CANDIDATE)
    parts.append(f"regexp_extract_all(t, {c}, 0) AS cand_w, string_split_regex(t, {c}) AS cand_b")
    w, holds = "cand_w[i]", lambda p: f"regexp_matches(cand_w[i], {_sql_text(p)})"
    full = lambda p: f"regexp_full_match({w}, '{p}')"
    made_of = {
        "hexadecimal": f"{full('[0-9a-f]+|[0-9A-F]+')} AND {holds('[0-9]')} AND {holds('[a-fA-F]')}",
        "base32": f"{full('[A-Z2-7]+=*')} AND {holds('[2-7]')} AND {holds('[A-Z]')}",
        "lower": f"{full('[0-9a-z]+')} AND {holds('[0-9][a-z]+[0-9]+[a-z]')}",
        "upper": f"{full('[0-9A-Z]+')} AND {holds('[0-9][A-Z]+[0-9]+[A-Z]')}",
        "letters": f"{full('[A-Za-z]+')} AND {holds('[A-Z][a-z]{1,2}[A-Z]+[a-z]{1,2}[A-Z]')}",
        "base64": f"{full('[A-Za-z0-9+/_-]+=*')} AND {holds('[0-9]')} AND {holds('[a-z]')} AND {holds('[A-Z]')}",
    }
    best = f"list_max(list_transform(range(1, length({w}) - 18), lambda j: list_aggregate(string_split(substr({w}, j, 20), ''), 'entropy')))"
    random = "CASE " + " ".join(f"WHEN {made_of[k]} THEN {best} >= {bound}" for k, _, _, bound in CLASSES) + " ELSE false END"
    repeats = f"len(list_filter(range(1, length({w}) - 6), lambda j: substr({w}, j, 8) = repeat(substr({w}, j, 1), 8))) > 0"
    allowed = " OR ".join([*(holds(p) for p in ALLOWED[:3]), repeats])
    lists.append(_sql_spans("cand_w", "cand_b", len(BASE), f"NOT ({allowed}) AND ({random})"))
    names = "['" + "', '".join([*(k for k, *_ in BASE), "entropy"]) + "']"
    text = lambda spans: f"array_to_string(list_transform(list_sort({spans}), lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    base = " || ".join(f"coalesce({k}_s, [])" for k, *_ in BASE)
    counts = ", ".join(f"CAST(len({k}_s) AS BIGINT) AS n_{k}" for k, *_ in BASE)
    spans = ", ".join(f"{s} AS {k}_s" for s, k in zip(lists, [*(k for k, *_ in BASE), "cand"], strict=True))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {", ".join(parts)} FROM d),
s AS (SELECT doc_id, {spans} FROM m)
SELECT doc_id, {counts}, sha256({text(base)}) AS base_sha256, {text(base + " || coalesce(cand_s, [])")} AS spans FROM s"""
