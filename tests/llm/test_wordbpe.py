import hashlib
import json
import random
import struct

import public_tokenizers
import pytest
import tokenizers

from cuelake.llm import bpe, wordbpe
from cuelake.llm.queries import WORD_TOKENIZER, op11_word_bpe

PATH = public_tokenizers.path(WORD_TOKENIZER)


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return wordbpe.WordVocabulary(f.read()).encoder(), tokenizers.Tokenizer.from_file(PATH)


def ids(encoder, text):
    b = encoder.encode(text)
    return list(struct.unpack(f"<{len(b) // 4}I", b))


def check(both, text):
    encoder, library = both
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(encoder, text) == want
    assert encoder.decode(encoder.encode(text)).decode() == library.decode(want, skip_special_tokens=False)


def test_same_as_the_library(both):
    rng = random.Random(2)
    tokens = [t.decode().replace("</w>", rng.choice(["", " "])) for t in rng.sample(both[0].v.token, 5000)]
    for _ in range(4000):
        check(both, "".join(rng.choice(tokens) for _ in range(rng.randint(1, 7))))
        check(both, "".join(rng.choice("abcdeth ingé漢字あいう'.s\n\x1c\x85　\U0001f600ΣİẞḉȺé") for _ in range(rng.randint(1, 40))))


@pytest.mark.parametrize("text", ["", " ", "a" * 30000, "ab" * 15000, "漢" * 8000, "x<|endoftext|>y<|startoftext|>", "<|ENDOFTEXT|>", "<|end<|endoftext|>", "</w>", "ΟΔΟΣ ΣΣ", "it's 'Sue'LL", "x\n\n\n  y", "\x00\x7f", "Ɤ Ɤ Ᲊ"])
def test_edges(both, text):
    check(both, text)


def test_every_kind_of_character(both):
    """A character of each block of 37 code points, between letters and alone."""
    for c in range(0, 0x110000, 37):
        if not 0xD800 <= c < 0xE000:
            check(both, f"A{chr(c)}b {chr(c)}")


def tiny(merges, letters="abcd"):
    spec = json.load(open(PATH))
    names = [*(wordbpe.byte_letters()), *(c + "</w>" for c in wordbpe.byte_letters())]
    names += list(dict.fromkeys(a + b for a, b in merges))
    spec["model"] |= {"vocab": {n: i for i, n in enumerate(names)}, "merges": merges}
    spec["added_tokens"] = []
    return json.dumps(spec).encode()


def test_random_merges():
    """Vocabularies in which the longest match is often wrong, tokens can't be reached or have two ways to arise, against the merges one by one."""
    rng = random.Random(5)
    for _ in range(60):
        known, merges = [*"abc", *(c + "</w>" for c in "abc")], []
        for _ in range(rng.randint(1, 14)):
            a, b = rng.choice(known), rng.choice(known)
            if not a.endswith("</w>") and [a, b] not in merges:
                merges.append([a, b])
                known += [a + b] * (a + b not in known)
        encoder = wordbpe.WordVocabulary(tiny(merges)).encoder()
        rank = {tuple(m): i for i, m in enumerate(merges)}
        two_ways = len({a + b for a, b in merges}) < len(merges)
        for _ in range(150):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
            parts = [*text[:-1], text[-1] + "</w>"]
            while len(parts) > 1 and (best := min((rank.get((parts[i], parts[i + 1]), 999), i) for i in range(len(parts) - 1)))[0] < 999:
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if not two_ways:
                assert [encoder.v.token[i].decode() for i in ids(encoder, text)] == parts, (merges, text)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        wordbpe.WordVocabulary(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())


def test_column(spark):
    docs = spark.createDataFrame([(1, "The the", "x"), (None, None, "y"), (1, "The the", "x"), (2, "", None)], "doc_id long, text string, ids string")
    tokenizer = wordbpe.WordTokenizer(spark, PATH)
    out = bpe.encode_documents(docs, tokenizer).collect()
    assert [bytes(r.decoded) for r in out] == [b"the</w> the</w>", b"", b"the</w> the</w>", b""] and out[0].ids == out[2].ids and len(out[1].ids) == 0
    assert bpe.encode_documents(docs.limit(0), tokenizer).count() == 0


def test_query_by_the_library(spark, small, both):
    found = {r.doc_id: r for r in op11_word_bpe(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        want = both[1].encode(r.text or "", add_special_tokens=False).ids
        text = both[1].decode(want, skip_special_tokens=False)
        assert tuple(found[r.doc_id]) == (r.doc_id, len(want), hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
