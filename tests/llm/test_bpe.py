import base64
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from cuelake.llm import bpe
from cuelake.llm.queries import TOKENIZER, op8_byte_bpe


@pytest.fixture(scope="module")
def both():
    with open(public_tokenizers.path(TOKENIZER), "rb") as f:
        content = f.read()
    vocabulary = bpe.Vocabulary(content, public_tokenizers.PATTERN)
    return bpe.Encoder(vocabulary), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.rank, special_tokens={})


def ids(encoder, text):
    b = encoder.encode(text)
    return list(struct.unpack(f"<{len(b) // 4}I", b))


def test_same_as_the_library(both):
    encoder, library = both
    rng = random.Random(1)
    tokens = [t.decode("utf8", "ignore") for t in rng.sample(list(encoder.v.rank), 3000)]
    for _ in range(4000):
        s = "".join(rng.choice(tokens) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.4:
            s = "".join(rng.choice("abcdeth ingé漢字あいう'.s\n\x1c\x85　\U0001f600") for _ in range(rng.randint(1, 40)))
        s = s.replace(" ", "") if rng.random() < 0.5 else s
        assert ids(encoder, s) == library.encode_ordinary(s)
        assert encoder.decode(encoder.encode(s)) == s.encode()


@pytest.mark.parametrize("text", ["", " ", "a" * 30000, "ab" * 15000, "漢" * 8000, "<|endoftext|>", "x\n\n\n  y", "\x00\x7f"])
def test_edges(both, text):
    encoder, library = both
    assert ids(encoder, text) == library.encode_ordinary(text)


def test_merges_decide_not_length():
    """A vocabulary in which the longest match first is wrong."""
    tokens = [bytes([i]) for i in range(97, 104)] + [b"bc", b"ab", b"abc", b"cd", b"bcd"]
    content = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    encoder = bpe.Encoder(bpe.Vocabulary(content, r"\p{L}+"))
    ranks = encoder.v.rank
    for n in range(1, 8):
        for code in range(4**min(n, 5)):
            s = "".join("abcd"[code // 4**i % 4] for i in range(n))
            want = [ranks[s.encode()]] if s.encode() in ranks else [ranks[p] for p in bpe.merged(s.encode(), ranks, 1 << 30)]
            assert ids(encoder, s) == want


def test_column(spark, small):
    docs = spark.createDataFrame([(1, "the the", "x"), (None, None, "y"), (1, "the the", "x"), (2, "", None)], "doc_id long, text string, ids string")
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    out = bpe.encode_documents(docs, tokenizer).collect()
    assert [bytes(r.decoded) for r in out] == [b"the the", b"", b"the the", b""] and out[0].ids == out[2].ids and len(out[1].ids) == 0
    assert bpe.encode_documents(docs.limit(0), tokenizer).count() == 0
    from pyspark.sql import functions as F

    found = op8_byte_bpe(spark, small).join(spark.read.parquet(f"{small}/documents.parquet"), "doc_id")
    assert found.where(F.col("decoded_sha256") != F.sha2(F.coalesce("text", F.lit("")), 256)).count() == 0
