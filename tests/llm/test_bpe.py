import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from larkspur.llm import bpe
from tests.llm.fixtures import TEXTS, documents, empty

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
CODER = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return bpe.Vocabulary.from_path(PATH, P.PATTERN)


@pytest.mark.parametrize("chunk, overlap", [(32_768, 1_024), (64, 16), (40, 20)])
def test_ids_and_bytes(spark, words, chunk, overlap):
    df = documents(spark)
    out = bpe.decode(bpe.encode(df, words, out="own_ids", chunk_chars=chunk, overlap=overlap), words, "own_ids", "raw").collect()
    assert len(out) == len(TEXTS)
    for r in out:
        text = r["text"] or ""
        assert r["own_ids"] == CODER.encode_ordinary(text)
        assert bytes(r["raw"]) == text.encode()
        assert r["ids"] == "ids"


def test_contractions_and_spaces_at_cuts(spark, words):
    texts = [(" " * k + "it's we'll they're  \n\n a'b 's" * 9,) for k in range(24)]
    df = spark.createDataFrame(texts, "text string")
    for r in bpe.encode(df, words, chunk_chars=24, overlap=12).collect():
        assert r["ids"] == CODER.encode_ordinary(r["text"])


def test_empty_table_and_null_ids(spark, words):
    assert bpe.encode(empty(spark), words).count() == 0
    assert bytes(bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), words).first()["bytes"]) == b""


def test_query(spark):
    from larkspur.llm.queries import op1_bpe

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: r for r in op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    for d in docs:
        ids = CODER.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_texts_of_several_default_chunks(spark, words):
    """Words, runs without white space, white space and digits over many chunks of the default size."""
    rng = random.Random(4)
    prose = " ".join(rng.choice(["don't", "Straße", "東京", "x", "12345", "(a,b)", "\n\n"]) * rng.randrange(1, 4) for _ in range(40_000))
    texts = [prose, "a" * 70_000 + " b " + "c" * 40_000, "7" * 90_000, " " * 80_000 + "end", "\n \t" * 30_000, prose[:40_000] + "\u3000" * 5_000 + prose[:50_000]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for r in bpe.encode(df, words).collect():
        assert r["ids"] == CODER.encode_ordinary(texts[r["k"]])
    assert len(bpe.starts(prose, 32_768, 1_024)) > 5


def test_neighbours_meet_wherever_chunks_begin(spark, words):
    """No text of the usual pattern is out of step: in each overlap there is a boundary of both chunks."""
    pattern = bpe.regex.compile(P.PATTERN)
    rng = random.Random(5)
    for _ in range(60):
        t = "".join(rng.choice(["ab", "'s", "1", "22", " ", "  ", "\n", ",.", "é", "\u2003", "'"]) * rng.randrange(1, 12) for _ in range(120))
        at = bpe.starts(t, 40, 16)
        for a, b, stop in zip(at, at[1:], [*(x + 16 for x in at[2:]), len(t)]):
            sure = {a + m.end() for m in pattern.finditer(t[a : b + 16]) if m.end() <= b + 16 - a - bpe.MARGIN}
            assert sure & {b, *(b + m.end() for m in pattern.finditer(t[b:stop]))}


def test_a_pattern_over_white_space_is_taken_as_one_chunk(spark):
    pattern = r"(?s).{1,7}"
    ranks = open(PATH, "rb").read()
    own = tiktoken.Encoding("seven", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    texts = [("some words of a text that goes on " * k,) for k in range(1, 9)]
    for r in bpe.encode(spark.createDataFrame(texts, "text string"), bpe.Vocabulary(ranks, pattern), chunk_chars=40, overlap=12).collect():
        assert r["ids"] == own.encode_ordinary(r["text"])
