"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (one per combination of the raked dimensions), and the cells' token weights are raked
until every dimension's marginals meet their targets. A cell cannot give more tokens than it has: with `share` of all
tokens to be kept, its weight ends at natural / share. A step takes one dimension and scales the cells of each value
by what the value still lacks over what its cells below their bound weigh, so the kept tokens meet the marginals, and a
round over all dimensions leaves an error that soon falls by a factor of five or more.

Sums of a step are grouped sums that combine map-side, so a value that holds a third of all cells is one row per task;
a cell table whose counted rows fit one partition takes the same steps inside one task.
Documents are then kept with the probability share * weight / natural. The draw is a hash of the id, so it is
repeatable and needs no shuffle; the documents' texts never move.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import batches_of, cut, small

#: Most rounds of raking, and the relative error of a marginal at which they end.
ROUNDS, TOLERANCE = 40, 1e-9
#: Largest relative error of a kept share against its target that counts as met, the step down to a smaller share, and most steps.
KEPT, STEP, STEPS = 1e-3, 0.9, 20
#: Rounds between two looks at the error; raking also ends when they leave more than this share of it.
CHECK, STALL = 4, 29 / 30
#: Share of the tokens to keep at most, and the salt of the draw.
BUDGET, SALT = 0.7, "mix-1"
#: Targets are the natural marginals to this power: below 1 small sources and languages gain.
TEMPERATURE = {"source": 0.7, "lang": 0.7, "topic": 0.8}
#: What a value lacks, or has in loose cells, below this share of its target is rounding: its cells are scaled as a whole.
LOOSE = 1e-6
#: A cell at this share of its bound is full.
FULL = 1 - 1e-9
#: Cells of one partition of the cell table.
CELLS = 100_000

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, (9, 10, 11, 12, 13, 32))
_UPPER, _DIGIT = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 48) & (_BYTES <= 57)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: Bytes of a text looked at together, and rows with texts in one batch.
PIECE, WIDE = 1 << 20, 512


def kind_and_tokens(text: str | None) -> tuple[str, int]:
    """A coarse kind of text by the shares of its bytes, and its tokens, the runs of other than ASCII white space.

    No marker of a certain corpus is read: `empty` has no other byte, in `symbols` letters and digits make up less than
    four fifths of them, in `numbers` digits a fifth or more of letters and digits, in `capitals` A-Z half or more, all else
    is `prose`. Bytes of characters beyond ASCII count as letters.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    counts, tokens, before = np.zeros(256, np.int64), 0, True
    for at in range(0, len(raw), PIECE):
        part = raw[at : at + PIECE]
        counts += np.bincount(part, minlength=256)
        space = _SPACE[part]
        tokens += int((space[:-1] & ~space[1:]).sum()) + int(before and not space[0])
        before = bool(space[-1])
    seen, upper, digits, words = (int(counts[m].sum()) for m in (~_SPACE, _UPPER, _DIGIT, _LETTER | _DIGIT))
    if not seen:
        return "empty", 0
    if words * 5 < seen * 4:
        return "symbols", tokens
    if digits * 5 >= words:
        return "numbers", tokens
    return ("capitals" if upper * 2 >= words else "prose"), tokens


@F.pandas_udf(T.StructType([T.StructField("topic", T.StringType()), T.StructField("tokens", T.LongType())]))
def _facts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for some in texts:
        yield pd.DataFrame([kind_and_tokens(t) for t in some], columns=["topic", "tokens"])


def tempered(cells: DataFrame, dims: Mapping[str, float], budget: float = BUDGET) -> dict[str, DataFrame]:
    """(value, share) for each dimension: its token marginal to a power, normalised, with no share above what all tokens
    of the value make up of the budget; the others then share the rest in proportion. A rare value would otherwise hold the
    whole mixture down to a few times its own tokens."""
    whole = F.lit(cells.agg(F.sum("tokens")).first()[0] or 1).cast("double")
    sums = [cells.groupBy(d).agg(F.sum("tokens").alias("n")).where("n > 0").select(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"), (F.col("n") / whole).alias("natural"), F.pow(F.col("n").cast("double"), F.lit(float(p))).alias("w")) for d, p in dims.items()]
    rows = cut(reduce(DataFrame.union, sums))
    scale = {r[0]: budget / r[1] for r in rows.groupBy("dim").agg(F.sum("w")).collect()}
    while scale:  # more values meet their bound as the scale grows; it ends when no further one does
        c = F.element_at(F.create_map(*(F.lit(x) for kv in scale.items() for x in kv)), F.col("dim"))
        full = F.col("w") * c >= F.col("natural")
        capped, loose = F.sum(F.when(full, F.col("natural")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))
        found = {r[0]: (budget - r[1]) / r[2] if r[2] > 0 and budget > r[1] else scale[r[0]] for r in rows.groupBy("dim").agg(capped, loose).collect()}
        if all(found[d] <= scale[d] * (1 + 1e-12) for d in scale):
            break
        scale = found
    c = F.element_at(F.create_map(*(F.lit(x) for kv in scale.items() for x in kv)), F.col("dim")) if scale else F.lit(1.0)
    rows = cut(rows.withColumn("share", F.least("natural", F.col("w") * c)))
    return {d: rows.where(F.col("dim") == d).select("value", "share") for d in dims}


def count_cells(df: DataFrame, dims: list[str], tokens: str) -> DataFrame:
    """(dims, tokens, docs): one row for each combination; combined map-side, so hot values cost nothing."""
    return df.groupBy(*dims).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("docs"))


def _named(value: Column) -> Column:
    """A value as a string that is never null, so that null is a value of its own in an equality join."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def marginals(table: DataFrame, dims: list[str], weight: Column) -> DataFrame:
    """(dim, value, goal, w): wanted and present weight of each value that has cells to weigh."""
    rows = table.where("live").select(weight.alias("__x"), F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"), F.col(f"__v_{d}").alias("v"), F.col(f"__goal_{d}").alias("goal")) for d in dims))).alias("m"))
    return rows.groupBy("m.dim", "m.v").agg(F.first("m.value").alias("value"), F.max("m.goal").alias("goal"), F.sum("__x").alias("w")).drop("v")


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], share: float = 0.0, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells with `weight`, the raked share of each, `natural`, its share of all tokens, and `off`, the largest relative
    error of a marginal that is left.

    targets: per dimension a frame (value, share); shares are taken in proportion among the values that have tokens. A cell
    with a value without target, or without tokens, gets weight 0; no cell gets more than natural / share. Raking stops
    at the tolerance or after so many rounds; `off` tells whether targets contradict each other or the bounds.
    """
    dims, parts = list(targets), max(1, -(-cells.count() // CELLS))
    table = cells.coalesce(parts).withColumn("__t", F.col("tokens").cast("double"))
    for dim, target in targets.items():
        goal = target.groupBy(_named(F.col("value")).alias(f"__v_{dim}")).agg(F.sum("share").alias(f"__goal_{dim}"))
        table = table.withColumn(f"__v_{dim}", _named(F.col(dim))).join(small(goal, 64), f"__v_{dim}", "left")
    lives = reduce(lambda a, b: a & b, (F.coalesce(F.col(f"__goal_{d}"), F.lit(0.0)) > 0 for d in dims)) & (F.col("__t") > 0)
    whole = F.lit(cells.agg(F.sum("tokens")).first()[0] or 1).cast("double")
    table = cut(table.withColumns({"live": lives, "natural": F.col("__t") / whole}).coalesce(parts))
    sums = {r[0]: r[1] for r in marginals(table, dims, F.lit(1.0)).groupBy("dim").agg(F.sum("goal")).collect()}
    bound = F.col("natural") / F.lit(share) if share > 0 else F.lit(float("inf"))
    table = table.withColumns({f"__goal_{d}": F.col(f"__goal_{d}") / F.lit(sums.get(d, 1.0)) for d in dims} | {"__cap": bound, "__u": F.when(F.col("live"), F.col("natural")).otherwise(0.0)})
    weight = F.least("__u", "__cap")
    if parts == 1:  # one partition of counted size: the same steps without a job for each
        fields = [*table.schema.fields, T.StructField("off", T.DoubleType())]
        run = lambda batches: _raked(batches, dims, rounds, tolerance)
        table = cut(table.coalesce(1).mapInPandas(run, T.StructType(fields)))
    else:
        table = _raked_by_sums(table, dims, rounds, tolerance, parts)
    return table.select(*cells.columns, F.when(F.col("live"), weight).otherwise(0.0).alias("weight"), "natural", "off")


def _done(errors: list[float], tolerance: float) -> bool:
    return errors[-1] <= tolerance or len(errors) > 2 and errors[-1] > errors[-2] * STALL


def _raked_by_sums(table: DataFrame, dims: list[str], rounds: int, tolerance: float, parts: int) -> DataFrame:
    """table (live, __cap, __u, __v_<dim>, __goal_<dim>) with __u raked and off: a grouped sum and a join for each step."""
    errors = [0.0]
    for at in range(rounds):
        for d in dims:
            full = F.col("__u") >= F.col("__cap") * F.lit(FULL)
            got = table.where("live").groupBy(f"__v_{d}").agg(
                F.sum(F.when(full, F.col("__cap")).otherwise(0.0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(F.col("__u"))).alias("loose"), F.max(f"__goal_{d}").alias("goal"),
            )
            rest = F.col("goal") - F.col("capped")
            edge = F.col("goal") * F.lit(LOOSE)
            factor = F.when((F.col("loose") > edge) & (rest > edge), rest / F.col("loose")).otherwise(F.col("goal") / (F.col("capped") + F.col("loose")))
            table = table.join(got.select(f"__v_{d}", factor.alias("__f")), f"__v_{d}", "left").withColumn("__u", F.when(F.col("live"), F.col("__u") * F.col("__f")).otherwise(0.0)).drop("__f")
            table = cut(table.coalesce(parts))
        if at % CHECK == CHECK - 1 or at == rounds - 1:
            w = marginals(table, dims, F.least("__u", "__cap"))
            errors.append(w.agg(F.max(F.abs(F.col("w") - F.col("goal")) / F.col("goal"))).first()[0] or 0.0)
            if _done(errors[1:], tolerance):
                break
    return table.withColumn("off", F.lit(errors[-1]))


def _raked(batches: Iterator[pd.DataFrame], dims: list[str], rounds: int, tolerance: float) -> Iterator[pd.DataFrame]:
    """The same of a table that one partition holds."""
    whole = [b for b in batches if len(b)]
    if not whole:
        return
    out = pd.concat(whole, ignore_index=True)
    live = out["live"].to_numpy(bool)
    cap, u, errors = out["__cap"].to_numpy(float)[live], out["__u"].to_numpy(float)[live], [0.0]
    codes, goals = [], []
    for d in dims:
        values, code = np.unique(out[f"__v_{d}"].to_numpy(str)[live], return_inverse=True)
        goal = np.zeros(len(values))
        goal[code] = out[f"__goal_{d}"].to_numpy(float)[live]
        codes.append(code)
        goals.append(goal)
    for at in range(rounds if live.any() else 0):
        for code, goal in zip(codes, goals, strict=True):
            full = u >= cap * FULL
            capped, loose = np.bincount(code, np.where(full, cap, 0), len(goal)), np.bincount(code, np.where(full, 0, u), len(goal))
            rest = goal - capped
            free = (loose > goal * LOOSE) & (rest > goal * LOOSE)
            u = u * np.where(free, rest / np.where(free, loose, 1), goal / (capped + loose))[code]
        if at % CHECK == CHECK - 1 or at == rounds - 1:
            errors.append(max(float((np.abs(np.bincount(code, np.minimum(u, cap), len(goal)) - goal) / goal).max()) for code, goal in zip(codes, goals, strict=True)))
            if _done(errors[1:], tolerance):
                break
    out.loc[live, "__u"] = u
    yield out.assign(off=errors[-1])


def kept_marginals(rates: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """(dim, value, target, kept): shares of each value that has tokens, wanted and among the tokens expected to be kept."""
    parts = []
    for dim, target in targets.items():
        goal = target.groupBy(_named(F.col("value")).alias("v")).agg(F.sum("share").alias("g"))
        have = rates.groupBy(_named(F.col(dim)).alias("v")).agg(F.first(F.col(dim).cast("string")).alias("value"), F.sum(F.col("natural") * F.col("rate")).alias("k"), F.sum("natural").alias("n")).where("n > 0")
        both = have.join(goal, "v", "left").select("value", F.coalesce("g", F.lit(0.0)).alias("g"), "k")
        whole = both.agg(F.sum("g").alias("all_g"), F.sum("k").alias("all_k"))  # one row
        parts.append(both.crossJoin(F.broadcast(whole)).select(F.lit(dim).alias("dim"), "value", F.expr("try_divide(g, all_g)").alias("target"), F.expr("try_divide(k, all_k)").alias("kept")))
    return reduce(DataFrame.union, parts)


def keep_rates(cells: DataFrame, targets: Mapping[str, DataFrame], budget: float = BUDGET) -> DataFrame:
    """cells raked, with `rate`, the probability that a token of the cell is kept.

    The share of tokens that is kept is the largest of budget, budget * STEP, ... for which the bounded cells meet all
    targets within KEPT; it begins below what the scarcest value allows. Targets that no share meets are warned of, and
    met as nearly as the last one leaves them.
    """
    whole = cells.agg(F.sum("tokens")).first()[0] or 1
    found, share = None, budget
    for dim, target in targets.items():
        goal = target.groupBy(_named(F.col("value")).alias("v")).agg(F.sum("share").alias("g")).where("g > 0")
        have = cells.groupBy(_named(F.col(dim)).alias("v")).agg(F.sum("tokens").alias("n")).where("n > 0").join(goal, "v")
        least, total = have.agg(F.min(F.col("n") / F.col("g")), F.sum("g")).first()
        share = min(share, (least or whole) * (total or 1.0) / whole)
    for step in range(STEPS):
        found = cut(rake(cells, targets, share))
        off = found.agg(F.max("off")).first()[0] or 0.0
        if off <= KEPT or step == 0 and (rake(cells, targets).agg(F.max("off")).first()[0] or 0.0) > KEPT:
            break  # without bounds the targets contradict each other, and no share helps
        share *= STEP
    rates = found.withColumn("rate", F.least(F.lit(1.0), F.when(F.col("natural") > 0, F.col("weight") / F.col("natural") * F.lit(share)).otherwise(0.0)))
    if off > KEPT:
        worst = F.abs(F.col("kept") - F.col("target"))
        missed = kept_marginals(rates, targets).where(worst > KEPT * F.col("target")).orderBy(F.desc(worst)).limit(20).collect()
        warnings.warn("targets not met: " + ", ".join(f"{r.dim} {r.value} {r.target:.4f} kept {r.kept:.4f}" for r in missed), stacklevel=2)
    return rates


def draw(id_col: str, salt: str = SALT) -> Column:
    """A number in [0, 1) that depends on the id alone (null: as the empty string)."""
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(
    df: DataFrame, targets: Mapping[str, DataFrame] | None = None, id_col: str = "doc_id", text: str = "text",
    source: str = "source", lang: str = "lang", budget: float = BUDGET, salt: str = SALT, topic: Column | None = None,
) -> DataFrame:
    """df with __topic, __tokens, __weight (raked share of the document's cell), __rate and __kept.

    The kept tokens meet the targets; the budget, a share of all tokens, is an upper limit. targets: frames (value, share) for
    source, lang and topic; without them the natural marginals to the powers of TEMPERATURE, made attainable within the
    budget. topic: any column; by default the kind of text (`kind_and_tokens`).

    Null sources or languages are a value of their own. Documents without tokens carry no weight and are not kept. Rows of
    one id are kept or dropped together; ties cannot occur, as each document is drawn by itself. Texts of any length are read
    whole, piece by piece. An empty table gives an empty result. Columns of df pass through, but for ones that bear
    the names above, which are replaced.
    """
    rows = df.drop("__topic", "__tokens", "__weight", "__rate", "__kept", "__facts").withColumn("__facts", _facts(F.col(text)))
    rows = rows.withColumns({"__topic": F.col("__facts.topic") if topic is None else topic.cast("string"), "__tokens": F.col("__facts.tokens")}).drop("__facts")
    facts = rows.select(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n"))
    with batches_of(df.sparkSession, WIDE):
        cells = cut(count_cells(facts, ["source", "lang", "topic"], "n"))
    rates = cut(keep_rates(cells, targets or tempered(cells, TEMPERATURE, budget), budget))
    key = F.concat_ws("\x1f", *(_named(F.col(c)) for c in ("source", "lang", "topic")))
    table = small(rates.select(key.alias("__key"), F.col("weight").alias("__weight"), F.col("rate").alias("__rate")), 256)
    joined = rows.withColumn("__key", F.concat_ws("\x1f", _named(F.col(source)), _named(F.col(lang)), _named(F.col("__topic")))).join(table, "__key", "left").drop("__key")
    return joined.withColumn("__kept", draw(id_col, salt) < F.col("__rate"))


def oracle(rounds: int = ROUNDS) -> str:
    """op1 over `documents` in SQL: the same steps of raking, unrolled, to tempered targets solved in closed form."""
    goals, steps, last = [], [], "w0"
    for d, p in TEMPERATURE.items():
        goals.append(f"""n_{d} AS (SELECT {d}, sum(given) AS n, pow(sum(tokens), {p}) AS g FROM base GROUP BY 1),
o_{d} AS (SELECT *, coalesce(sum(n) OVER (ORDER BY g / n DESC, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, sum(g) OVER (ORDER BY g / n DESC, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM n_{d}),
c_{d} AS (SELECT ({BUDGET} - ahead) / rest AS c FROM o_{d} WHERE ({BUDGET} - ahead) / rest * g <= n ORDER BY g / n DESC LIMIT 1),
a_{d} AS (SELECT {d}, least(n, g * (SELECT c FROM c_{d})) AS s FROM n_{d}), t_{d} AS (SELECT {d} AS v_{d}, s / (SELECT sum(s) FROM a_{d}) AS goal_{d} FROM a_{d})""")
    for i in range(rounds):
        for d in TEMPERATURE:
            name = f"u{i}_{d}"
            steps.append(
                f"{name}s AS (SELECT *, sum(CASE WHEN u >= cap * {FULL!r} THEN cap ELSE 0 END) OVER (PARTITION BY {d}) AS k, sum(CASE WHEN u >= cap * {FULL!r} THEN 0 ELSE u END) OVER (PARTITION BY {d}) AS l FROM {last}), "
                f"{name} AS (SELECT * EXCLUDE (k, l) REPLACE (u * CASE WHEN l > goal_{d} * {LOOSE} AND goal_{d} - k > goal_{d} * {LOOSE} THEN (goal_{d} - k) / l ELSE goal_{d} / (k + l) END AS u) FROM {name}s)"
            )
            last = name
    ascii_of = lambda chars: f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"
    joins = " ".join(f"JOIN t_{d} ON {d} IS NOT DISTINCT FROM v_{d}" for d in TEMPERATURE)
    return f"""WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, strlen(t) - {ascii_of(" \\t\\n\\x0B\\f\\r")} AS seen, {ascii_of("A-Z")} AS upper, {ascii_of("0-9")} AS digits, {ascii_of("A-Za-z0-9")} + strlen(t) - {ascii_of("\\x00-\\x7F")} AS words FROM d),
facts AS (SELECT doc_id, source, lang, CAST(len(regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_tokens,
  CASE WHEN seen = 0 THEN 'empty' WHEN words * 5 < seen * 4 THEN 'symbols' WHEN digits * 5 >= words THEN 'numbers' WHEN upper * 2 >= words THEN 'capitals' ELSE 'prose' END AS topic FROM b),
cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM facts GROUP BY 1, 2, 3 HAVING sum(n_tokens) > 0),
base AS (SELECT *, tokens / (SELECT sum(tokens) FROM cells) AS given FROM cells),
{", ".join(goals)},
w0 AS (SELECT base.*, given AS u, given / {BUDGET} AS cap, {", ".join(f"goal_{d}" for d in TEMPERATURE)} FROM base {joins}),
{", ".join(steps)},
rates AS (SELECT source, lang, topic, least(u, cap) AS weight, least(1.0, least(u, cap) / given * {BUDGET}) AS rate FROM {last})
SELECT doc_id, f.source, f.lang, f.topic, n_tokens, round(coalesce(weight, 0), 7) AS cell_weight, round(coalesce(rate, 0), 5) AS rate,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SALT}'), 1, 12) AS BIGINT) / 281474976710656.0 < coalesce(rate, 0) AS kept
FROM facts f LEFT JOIN rates r ON f.source IS NOT DISTINCT FROM r.source AND f.lang IS NOT DISTINCT FROM r.lang AND f.topic = r.topic"""
