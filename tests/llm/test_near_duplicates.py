"""op5, op6 and op9 against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup, order_minhash, queries, simhash

DATA = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: list of (id, fingerprint); the least id reachable for each row."""
    own = list(range(len(fps)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                a, b = find(i), find(j)
                own[max(a, b)] = min(a, b)
    best = defaultdict(list)
    for i, (d, _) in enumerate(fps):
        best[find(i)].append(d)
    return [min(best[find(i)]) for i in range(len(fps))]


def test_simhash_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    fps = [(d, brute_fingerprint(t)) for d, t in docs]
    want = {d: (format(f, "016x"), c) for (d, f), c in zip(fps, brute_components(fps), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, DATA).collect()}
    assert got == want


def near_family(rng, n, centres=6):
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        out += [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for _ in range(n // centres)]
    return out + [rng.getrandbits(64) for _ in range(n)]


@pytest.mark.parametrize("chunk, bucket, blocks", [(16384, 4096, None), (40, 64, 4), (16384, 8, 5), (20, 8, 6)])
def test_links_and_components_of_random_fingerprints(spark, monkeypatch, chunk, bucket, blocks):
    """Also with buckets so small that hot ones are dealt into pairs of chunks, and with the blocks of larger inputs."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    fps = sorted(set(near_family(random.Random(3), 240)))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, blocks=blocks)).collect()}
    got = defaultdict(set)
    for f in signed:
        got[roots.get(f, f)].add(f)
    want = defaultdict(set)
    for f, c in zip(signed, brute_components(list(zip(signed, fps, strict=True))), strict=True):
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_gray_index_finds_all_neighbours():
    fps = np.unique(np.array(near_family(random.Random(9), 300), np.uint64))
    for turn in (0, 16, 48):
        index = simhash.GrayIndex(fps, turn)
        q, node = index.near(fps, 3)
        got = {(int(fps[a]), int(index.fps[b])) for a, b in zip(q, node, strict=True)}
        want = {(int(a), int(b)) for a in fps for b in fps[np.bitwise_count(fps ^ a) <= 3]}
        assert got == want


def test_long_chain_is_one_component(spark):
    chain = [(i + 1, i) for i in range(60)] + [(100, 99), (7, 7)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {roots[i] for i in range(61)} == {0} and roots[100] == 99 and 7 in roots


def test_simhash_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "one"), (5, "ONE"), (5, "ONE"), (None, "one"), (6, "a b c d " * 5000), (7, "Ünï cödé ß")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = sorted(((r.doc_id or 0), r.component_id, format(r.fp & (2**64 - 1), "016x")) for r in simhash.near_duplicates(df).collect())
    assert len(got) == len(rows)
    for d, c, f in got:
        text = next(t for i, t in rows if (i or 0) == d)
        assert f == format(brute_fingerprint(text), "016x")
        assert c == (1 if d in (1, 2, 3) else 4 if d in (0, 4, 5) else d)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7]
    twice = spark.createDataFrame([(1, "x y"), (1, "x y"), (2, "q w e r")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(twice).collect()) == [1, 2]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_signature(text):
    """Order MinHash by its definition, over the same hash values."""
    points = order_minhash.points_of(text)
    if not len(points):
        return np.zeros(order_minhash.FUNCTIONS, np.uint32)
    seen, z = Counter(), []
    for h in order_minhash.kmer_hashes(points).tolist():
        z.append((h + seen[h] * int(order_minhash.GOLDEN)) & (2**64 - 1))
        seen[h] += 1
    z = order_minhash._mix(np.array(z, np.uint64))
    out = []
    for a in order_minhash.MULTIPLIERS.tolist():
        least = sorted(range(len(z)), key=lambda i: (a * int(z[i])) & (2**64 - 1))[: order_minhash.PICKED]
        v = np.array([order_minhash.GOLDEN], np.uint64)
        for i in sorted(least):
            v = order_minhash._mix(v * np.uint64(31) + z[i])
        out.append(int(v[0]) >> 32)
    return np.array(out, np.uint32)


@pytest.mark.parametrize("text", ["", "a", "short", "abcabcabcabcabcabc", "aaaaaaaaaaaaaaaaaaaa", "é日本😀 " * 9, "the quick brown fox jumps over the lazy dog"])
def test_signature_by_definition(text, monkeypatch):
    assert (order_minhash.signature(order_minhash.points_of(text)) == brute_signature(text)).all()
    monkeypatch.setattr(order_minhash, "PAIRS", 5)
    assert (order_minhash.signature(order_minhash.points_of(text)) == brute_signature(text)).all()


def test_signature_follows_order():
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    near = words[:150] + ["x"] + words[150:]
    shuffled = rng.sample(words, len(words))
    sig = lambda w: order_minhash.signature(order_minhash.points_of(" ".join(w)))
    assert order_minhash.likeness(sig(words), sig(near)) > 0.7 > 0.5 > order_minhash.likeness(sig(words), sig(shuffled))


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((d, len(t), t[: len(t) - half] + n[:half], order_minhash.hex_of(order_minhash.signature(order_minhash.points_of(t))), n))
    return out


@pytest.mark.parametrize("size", [4 << 20, 300])
def test_compare_with_edits(spark, monkeypatch, size):
    monkeypatch.setattr(order_minhash, "BUCKET_BYTES", size)
    rng = random.Random(2)
    rows = [(i * 7, "".join(rng.choice("abcé日 ") for _ in range(rng.randrange(40)))) for i in range(60)] + [(5, None), (7, "tie"), (7, "tie"), (None, "nobody")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(0))
    got = sorted((str(r.doc_id), r.n_chars, r.edited_text, r.fingerprint) for r in order_minhash.compare_with_edits(df).collect())
    assert got == sorted((str(d), n, e, f) for d, n, e, f, _ in brute_edits(rows))
    lone = order_minhash.compare_with_edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert lone.edited_text == "abcabc" and lone.near_next == 1.0
    assert order_minhash.compare_with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op5_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (n, hashlib.sha256(e.encode()).hexdigest(), f) for d, n, e, f, _ in brute_edits(rows)}
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint) for r in queries.op5_order_minhash(spark, DATA).collect()}
    assert got == want


def test_line_dedup(spark):
    rows = [(i, "a", f"HEAD\nown line {i}\n\n  FOOT ") for i in range(20)] + [(i, "b", "HEAD\nb" + str(i)) for i in range(20, 23)]
    rows += [(30, None, "x\nx"), (31, None, None), (32, "a", ""), (33, "a", "own line 1\nHEAD\nHEAD")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_lines", F.lit("clash"))
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, "source").collect()}
    assert len(got) == len(rows)
    assert got[3].text == "own line 3\n" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert got[20].text == "HEAD\nb20" and got[30].text == "x\nx" and got[31].text is None and (got[31].n_lines, got[31].n_dropped) == (0, 0)
    assert got[32].text == "" and got[33].text == "own line 1" and got[33].n_dropped == 2
    assert line_dedup.drop_boilerplate(df.limit(0), "source").count() == 0


def test_line_dedup_by_host_of_urls(spark):
    """URLs of one host are one site whatever their scheme, port, user or path."""
    urls = ["http://Site.example/a", "https://site.example:8080/b?c=d", "ftp://me@site.EXAMPLE#x", "https://site.example", "http://other.example/a"]
    rows = [(i, u, f"MENU\npage {i}") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "doc_id long, url string, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_boilerplate(df, "url").collect()}
    assert got == {i: (f"page {i}", 1) for i in range(4)} | {4: ("MENU\npage 4", 0)}


def test_line_dedup_by_shuffle_join(spark, monkeypatch):
    from ledgerloom.llm import common

    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = lambda: sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.drop_boilerplate(df, "source", ratio=0.01, least_pages=2).collect())
    want = rows()
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert rows() == want and any(n for *_, n in want)


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard_pairs(docs):
    """Pairs (i, j), j < i, of places in docs at 0.8 or more, by brute force over an inverted index."""
    sets, shared, where = [five_words(t) for _, t in docs], Counter(), defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            for j in where[x]:
                shared[i, j] += 1
            where[x].append(i)
    found = {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    empty = [i for i, s in enumerate(sets) if not s]
    return found | {(i, empty[0]) for i in empty[1:]}


def groups_of(docs, pairs):
    own = list(range(len(docs)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        own[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(docs))]


def edited_families(rng, families=40, copies=4):
    """Texts and near copies: a few words replaced, most of them beyond three bits of SimHash."""
    docs = []
    for _ in range(families):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(120, 400))]
        docs.append(" ".join(words))
        for _ in range(copies):
            near = list(words)
            for at in rng.sample(range(len(words)), rng.randrange(1, max(2, len(words) // 60))):
                near[at] = f"v{rng.randrange(5000)}"
            docs.append(" ".join(near))
    rng.shuffle(docs)
    return list(enumerate(docs))


def survivors(spark, docs):
    return sorted(r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_stage_drops_all_copies_at_four_fifths(spark):
    docs = edited_families(random.Random(5))
    pairs = jaccard_pairs(docs)
    fps = [simhash.fingerprint(t) for _, t in docs]
    apart = sum(((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() > 3 for i, j in pairs)
    assert len(pairs) > 200 and apart > len(pairs) / 2
    assert survivors(spark, docs) == sorted(set(groups_of(docs, pairs)))


def test_stage_against_brute_force_over_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    docs = [(r.doc_id, r.text) for r in rows]
    assert survivors(spark, docs) == sorted({docs[i][0] for i in groups_of(docs, jaccard_pairs(docs))})


def test_stage_finds_pairs_across_components_of_a_bucket(spark):
    """One bucket for all: chains whose ends are unlike, and texts that only share words, are told apart by exact sets."""
    rng, docs = random.Random(8), []
    for _ in range(6):
        words = [f"w{rng.randrange(9000)}" for _ in range(200)]
        for _ in range(5):
            docs.append(" ".join(words))
            words = words[15:] + [f"w{rng.randrange(9000)}" for _ in range(15)]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    marked = spark.createDataFrame([(i, simhash.fingerprint(t, 5), [1]) for i, t in docs], "node long, fp long, bands array<long>")
    texts = spark.createDataFrame(docs, "node long, text string")
    roots = {r.node: r.root for r in simhash.jaccard_components(marked, lambda nodes: texts.join(nodes, "node", "left_semi")).collect()}
    assert [roots.get(i, i) for i, _ in docs] == groups_of(docs, jaccard_pairs(docs))


def test_stage_keeps_one_row_of_each_group_whatever_the_ids(spark):
    """Null ids, an id of two unrelated texts, and a near copy whose id also names another group."""
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, b + " x"), (None, None), (None, None), (1, c), (1, d), (2, d), (3, e), (3, e), (3, c + " y"), (None, e)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = Counter((r.doc_id, r.text) for r in got)
    b_row = next(r for r in got if r.text and r.text.startswith(b))
    assert kept == Counter([(None, a), (None, b_row.text), (None, None), (1, c), (1, d), (3, e)])


def test_bit_maps_rule_out_no_near_copy():
    """Pairs about 0.8, of sets whose maps have the same length or not, and pairs far below."""
    rng, kept, gone = np.random.default_rng(6), 0, 0
    for n in (0, 1, 5, 30, 120, 128, 129, 700, 5000):
        for share in (0.0, 0.3, 0.5, 0.75, 0.79, 0.8, 0.82, 0.9, 1.0):
            for longer in (0.0, 0.1, 0.2, 0.5):
                both, more = round(n * share), round(n * longer * (1 - share) * 2)
                a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
                b = np.unique(np.concatenate((a[:both], rng.integers(0, 1 << 63, more, np.uint64))))
                maps = simhash.BitMaps(np.array([len(a), len(b)]), [simhash.bit_map(a), simhash.bit_map(b)], 0.8)
                likeness, allowed = simhash.jaccard(a, b), maps.apart(0, np.array([1]))[0] <= 1
                assert allowed == (maps.apart(1, np.array([0]))[0] <= 1)
                assert allowed or likeness < 0.8
                kept, gone = kept + (likeness >= 0.8), gone + (not allowed)
                assert not allowed or n < 120 or likeness > 0.6
    assert kept > 50 and gone > 100


@pytest.mark.parametrize("pairs, members, group", [((0, 0), 4096, 8192), ((0, 1), 3, 8), ((), 3, 8)])
def test_stage_deals_large_buckets(spark, monkeypatch, pairs, members, group):
    """Forests before all pairs, and buckets dealt into pairs of chunks: the same survivors."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    monkeypatch.setattr(simhash, "MEMBERS", members)
    monkeypatch.setattr(simhash, "GROUP", group)
    docs = edited_families(random.Random(15), families=12, copies=9)
    assert survivors(spark, docs) == sorted(set(groups_of(docs, jaccard_pairs(docs))))


def test_stage_moves_no_texts_of_pairs_that_only_share_a_band(spark, monkeypatch):
    rng = random.Random(7)
    common = [f"w{i}" for i in range(160)]
    docs = [(i, " ".join(common + [f"v{rng.randrange(10**6)}" for _ in range(100)])) for i in range(60)]
    docs += [(60 + i, docs[i][1] + " tail") for i in range(5)]
    confirmed, tested = simhash._confirmed, []

    def counted(pairs, *rest):
        tested.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(simhash, "_confirmed", counted)
    assert survivors(spark, docs) == list(range(60))
    assert sum(tested) < 3 * len(docs)


def test_checkpoints_of_small_rows_have_few_files(spark):
    few = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    found = simhash.cut_narrow(spark.range(1000, numPartitions=211))
    assert found.rdd.getNumPartitions() <= few and found.count() == 1000
