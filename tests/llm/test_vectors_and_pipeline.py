"""op8 against brute force, and the pipeline's stages against plain Python."""

import hashlib
import importlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import language, line_dedup, mixing, permutation_index, queries
from tests.llm.test_near_duplicates import groups_of, jaccard_pairs
from tests.llm.test_text_operators import brute_language, brute_rates, kind_by_characters

DATA = "/root/testdata/sf0.001"


def exact(rows, k=20):
    """rows: (id, vector); the k nearest of every id divisible by 20."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            scored = sorted((-(float((v * w).sum())), i) for i, w in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want, got = exact(rows), {}
    for r in queries.op8_permutation_index(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit / (20 * len(want)) >= 0.9
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert all(s == pytest.approx(float((vectors[q] * vectors[i]).sum()), abs=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_blocks_and_tiles_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = df.where("vec_id % 20 = 0")
    monkeypatch.setattr(permutation_index, "BLOCK", 50)
    monkeypatch.setattr(permutation_index, "TILE", 7)
    got = {}
    for r in permutation_index.search(df, ask, rerank=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in v] for q, v in exact(rows).items()}


def test_vector_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [1.0, None]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [-1.0, 0.0]), (120, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in permutation_index.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 3, -1.0)]
    assert permutation_index.search(df.limit(0), df).count() == 0 and permutation_index.search(df, df.limit(0)).count() == 0


def test_footrule_by_definition():
    rng = np.random.default_rng(4)
    order = np.stack([rng.permutation(20)[:6] for _ in range(40)]).astype(np.int16)
    index, query = permutation_index.Block(order, 20), rng.permutation(20)[:6]

    def footrule(a, b):
        place = lambda o, p: list(o).index(p) if p in o else 6
        return sum(abs(place(a, p) - place(b, p)) for p in range(20))

    want = sorted(range(40), key=lambda i: (footrule(order[i], query), i))[:9]
    assert index.nearest(query, 9).tolist() == sorted(want)


def fixture_docs():
    rng = random.Random(3)
    words = {la: [f"{rng.choice(x)}{rng.choice(x)}" for _ in range(80)] for la, x in {"en": ["the", "ing", "wh", "er", "on"], "de": ["sch", "ung", "ein", "ch", "pf"], "fr": ["eau", "oi", "qu", "é", "eux"], "es": ["ción", "que", "os", "ado", "ñ"]}.items()}
    docs = []
    for i in range(240):
        la = rng.choice(list(words))
        body = "\n".join(" ".join(rng.choice(words[la]) for _ in range(rng.randrange(6, 30))) for _ in range(4))
        docs.append((i, f"HOME | ABOUT\n{body}" if i % 4 == 0 else body, la, f"s{i % 3}", 0))
    docs += [(300 + i, docs[i * 5][1], docs[i * 5][2], "s0", 0) for i in range(20)]
    docs += [(400, None, "en", "s1", None), (401, "12 34 !", "en", "s1", 8), (402, "", "de", "s2", 0)]
    return [(d, t, la, s, len(t) if t is not None else None) for d, t, la, s, _ in docs]


def test_stages_against_plain_python(spark, tmp_path):
    rows = fixture_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in docs.collect()}
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    judged = {d: brute_language(t, model) for d, t, *_ in rows if t and any(c.isalpha() for c in t)}
    left = {d: lang for d, (lang, _, familiar) in judged.items() if familiar >= model.bound}
    assert {d: r.lang for d, r in seen["language_id"].items()} == left and 0 < model.bound < 1
    count, pages = {}, {}
    for d, r in seen["language_id"].items():
        pages[r.source] = pages.get(r.source, 0) + 1
        for line in {x.strip(" ") for x in r.text.split("\n")} - {""}:
            count[r.source, line] = count.get((r.source, line), 0) + 1
    bad = {k for k, n in count.items() if n >= line_dedup.LEAST_PAGES and n > pages[k[0]] * line_dedup.RATIO}
    assert bad
    for d, r in seen["language_id"].items():
        text = "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in bad)
        assert seen["line_dedup"][d].text == text and seen["line_dedup"][d].n_chars == len(text)
    cleaned = [(d, r.text) for d, r in sorted(seen["line_dedup"].items())]
    assert set(seen["near_dedup"]) == {cleaned[i][0] for i in groups_of(cleaned, jaccard_pairs(cleaned))} and len(seen["near_dedup"]) < len(cleaned)
    facts = {d: (r.source, r.lang, *kind_by_characters(r.text)) for d, r in seen["near_dedup"].items()}
    rates = brute_rates(list(facts.values()))
    u = lambda d: int(hashlib.md5(f"{d}:{mixing.SALT}".encode()).hexdigest()[:12], 16) / 2**48
    assert set(seen["mixing"]) == {d for d, f in facts.items() if u(d) < rates[f[:3]]}
    import tiktoken

    from ledgerloom.llm.bpe import Encoder

    ranks = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(seen["byte_bpe"]) == set(seen["mixing"])
    for d, r in seen["byte_bpe"].items():
        ids = library.encode_ordinary(seen["mixing"][d].text)
        assert bytes(r.token_ids) == struct.pack(f"<{len(ids)}I", *ids) and r.decoded_sha256 == hashlib.sha256(seen["mixing"][d].text.encode()).hexdigest()


def test_run_keeps_clean_documents(spark):
    found = corpus_pipeline.run(spark, DATA)
    total = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert 0.4 * total < found.count() < total and found.select("doc_id").distinct().count() == found.count()


def test_entry_works_without_the_subpackage(monkeypatch):
    import sys

    import __spark_entry__

    assert {"pipeline", "op1_mixing", "op10_token_counts"} <= set(__spark_entry__.queries())
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    importlib.reload(__spark_entry__)
    names = set(__spark_entry__.queries())
    assert "pipeline" not in names and not any(n.startswith("op1_") for n in names) and "tb_accrual" in names
    assert not any(n.startswith("op") and n[2].isdigit() for n in __spark_entry__.oracle_sql())


FOREIGN = {
    "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "russian": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "japanese": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
}


def test_language_stage_rejects_foreign_texts_and_gibberish(spark):
    """Next to all labelled held-out documents stay, also in pairs of two languages; planted foreign and random texts go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, rng = docs.collect(), random.Random(6)
    planted = [(10_000 + i, t, "en", "src0", len(t)) for i, t in enumerate(FOREIGN.values())]
    planted += [(10_100 + i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 10))) for _ in range(60)), "en", "src0", 0) for i in range(40)]
    planted += [(10_200 + i, language.shuffled(r.text), r.lang, "src0", 0) for i, r in enumerate(r for r in rows[:120] if r.n_chars > 200)]
    mixed = [(20_000 + i, a.text + "\n" + b.text, a.lang, "src0", 0) for i, (a, b) in enumerate(zip(rows[:100], rows[100:200], strict=True))]
    every = docs.unionByName(spark.createDataFrame(planted + mixed, docs.schema))
    model = language.learn(docs)
    found = language.predict(every, model, ["doc_id"]).where(F.col("familiar") >= model.bound)
    kept = {r.doc_id for r in found.collect()}
    lettered = {r.doc_id for r in rows if r.text and any(c.isalpha() for c in r.text)}
    assert len(lettered & kept) >= 0.998 * len(lettered) and len([d for d in kept if d >= 20_000]) == 100
    gone = [d for d, *_ in planted if d not in kept]
    print("bound", model.bound, "kept", len(lettered & kept), "of", len(lettered), "planted gone", len(gone), "of", len(planted))
    assert len(gone) >= 0.9 * len(planted)


def test_language_stage_has_the_columns_and_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    kept = corpus_pipeline.language_id(spark, docs, DATA)
    assert kept.columns == docs.columns and kept.where("lang is null or lang = 'und'").count() == 0
    assert corpus_pipeline.language_id(spark, docs.limit(0), DATA).count() == 0


def test_stages_of_an_empty_table_and_null_ids(spark, tmp_path):
    rows = [(None, "the words of one text", None, None, None), (None, None, None, "s", None), (None, "the words of one text", None, None, None), (1, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs.limit(0), docs):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, some, str(tmp_path))
            assert out.count() <= 4
            assert name == "byte_bpe" or out.columns == docs.columns
