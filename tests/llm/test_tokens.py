"""op7 and op10 against the libraries, and an exact round trip."""

import base64
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, queries, token_counts

RANKS, VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"
HARD = [
    None, "", " ", "a" * 6000, "ab" * 3000, "  x  \n\n y\t", "<|endoftext|>a<|endoftext|><|endoftext|>", "😀é 日本語テキスト" * 60, "I'M don't we'll 's", "²³½Ⅷ 12345",
    "\x1c\x1d a\x85b c", "aaaa aaa aa a", "\x00\x00", "퟿￿", "the the the",
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    mixed = ["".join(rng.choice("ab c\n'é日x1.") for _ in range(rng.randrange(60))) for _ in range(200)]
    return HARD + mixed + mixed[:3]


def test_encodes_and_decodes_like_the_library(spark, library):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").withColumn("token_ids", F.lit("clash"))
    rows = bpe.encode(df, RANKS, public_tokenizers.PATTERN, ["doc_id"], decoded=True).collect()
    assert len(rows) == len(texts())
    for r in rows:
        text = texts()[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids) and bytes(r.token_ids) == struct.pack(f"<{len(ids)}I", *ids) and bytes(r.decoded) == text.encode()
    again = bpe.decode(spark.createDataFrame([(1, bytes(rows[3].token_ids)), (2, None)], "i long, token_ids binary"), RANKS, public_tokenizers.PATTERN, ["i"]).collect()
    assert bytes(again[0].decoded) == bytes(rows[3].decoded) and bytes(again[1].decoded) == b""


def test_long_texts_are_encoded_piecewise(library, monkeypatch):
    own = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    text = " ".join(f"word{i} é" for i in range(3000))
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "RUN_BYTES", 64)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    ids = library.encode_ordinary(text)
    assert own.encode([text, "x"])[0] == struct.pack(f"<{len(ids)}I", *ids)


def test_rank_queue_finds_the_lowest_rank():
    queue, ranks = bpe.RankQueue(1 << 16), [5, 64, 4096, 63, 65535, 0]
    for r in ranks:
        queue.open(r, [r])
    assert [queue.take(queue.first()) for _ in ranks] == [[r] for r in sorted(ranks)] and queue.first() == -1


def test_counts_like_the_library(spark):
    own = Tokenizer.from_file(VOCAB)
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    rows = token_counts.count_tokens(df, VOCAB, ["doc_id"], limit=40).collect()
    for r in rows:
        text = texts()[r.doc_id] or ""
        n = len(own.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 40), ascii(text[:40])


def test_queries_on_whole_tables(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    own = Tokenizer.from_file(VOCAB)
    for r in queries.op10_token_counts(spark, DATA).collect():
        assert r.n_tokens == len(own.encode(docs[r.doc_id], add_special_tokens=False).ids)
    for r in queries.op7_byte_bpe(spark, DATA).collect():
        assert r.n_tokens == len(library.encode_ordinary(docs[r.doc_id]))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN, ["doc_id"]).count() == 0 and token_counts.count_tokens(none, VOCAB, ["doc_id"]).count() == 0
