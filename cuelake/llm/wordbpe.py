"""BPE with word ends by dynamic programming over the prefixes of a word.

The tokens of a prefix are those of a shorter prefix and one last token more, and that last token
is unique: of all tokens that the prefix ends with, it is the one that the merges can leave beside
the last token of the prefix before it (van Antwerpen and Neubeck, 2024). One pass of an automaton
yields the tokens that end at each place; one number a prefix is kept, and following them back from
the end gives the word's tokens. A word's last byte is a symbol of its own, as the vocabulary marks
ends of words.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import ahocorasick
import regex
from pyspark.sql import SparkSession

from cuelake.llm import bpe
from cuelake.llm.workdir import bounded_batches

#: What is added to the last byte of a word.
FINAL = 256


def byte_letters() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte: itself if it is a visible Latin-1 character, else the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(free)) for b in range(256)]


class WordVocabulary:
    """What a tokenizer file says; made on the driver, broadcast, bounded by the file's size.

    Tokens have numbers of their own: the 256 bytes, the 256 last bytes, then one a merge in order
    of rank. Files of another kind (other normalisation, fallbacks, dropout) are refused.
    """

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, steps = spec["model"], (spec["normalizer"] or {}).get("normalizers", [])
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        unused = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        plain = [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        by_pattern = [s.get("type") for s in splits] == ["Split", "ByteLevel"] and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        whole = all(t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or any(model.get(k) for k in unused) or not (plain and by_pattern and whole) or spec.get("post_processor") or spec.get("decoder"):
            raise ValueError("not a lower-case BPE file with word ends")
        self.pattern, self.special = splits[0]["pattern"]["Regex"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        names = [*letters, *(c + end for c in letters)]
        number = {name: n for n, name in enumerate(names)}
        self.joined: dict[int, int] = {}
        symbols = [chr(n) for n in range(len(names))]
        for pair in model["merges"]:
            a, b = (number[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            n = number.setdefault(names[a] + names[b], len(names))
            if n == len(names):
                names.append(names[a] + names[b])
                symbols.append(symbols[a] + symbols[b])
            self.joined.setdefault(a << bpe.PAIR_BITS | b, n)
        self.symbols, self.id = symbols, array("i", (ids[name] for name in names))
        self.token = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for name, i in {**ids, **self.special}.items():
            self.token[i] = name.encode()
        #: of each token that merges can reach: the two tokens merged last (a single symbol's are itself), else -1
        self.left, self.right = array("i", range(len(names))), array("i", range(len(names)))
        for n in range(2 * FINAL, len(names)):
            self.left[n], self.right[n] = self.last_merge(n)

    def last_merge(self, n: int) -> tuple[int, int]:
        """The two tokens that the merges of a token's own symbols join last; (-1, -1) if they end elsewhere."""
        parts, last = [ord(c) for c in self.symbols[n]], (-1, -1)
        while len(parts) > 1:
            best, at = min((self.joined.get(parts[i] << bpe.PAIR_BITS | parts[i + 1], bpe.NEVER), i) for i in range(len(parts) - 1))
            if best == bpe.NEVER:
                return -1, -1
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [best]
        return last if parts == [n] else (-1, -1)

    def encoder(self) -> WordEncoder:
        return WordEncoder(self)

    def decoded(self, ids: bytes) -> bytes:
        """The tokens as the file writes them, with a space between each two: the file names no decoder."""
        return b" ".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


class WordEncoder(bpe.Encoder):
    """The automaton of a worker process and the memos of its task."""

    def __init__(self, vocabulary: WordVocabulary):
        self.v = vocabulary
        self.regex = regex.compile(vocabulary.pattern)
        self.joined, self.left, self.right = vocabulary.joined, vocabulary.left, vocabulary.right
        self.length = [len(s) for s in vocabulary.symbols]
        self.automaton = ahocorasick.Automaton()
        for n, s in enumerate(vocabulary.symbols):
            if self.left[n] >= 0:
                self.automaton.add_word(s, n)
        self.automaton.make_automaton()
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) or r"(?!)")
        self.library = None
        self.pairs: dict[int, bool] = {}
        self.memo = bpe._Memo(self)

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one word, by the last token of each of its prefixes."""
        word = piece.decode("latin-1")
        word = word[:-1] + chr(ord(word[-1]) + FINAL)
        length, pairs, ids = self.length, self.pairs, self.v.id
        if len(pairs) > bpe.MEMO:
            pairs.clear()
        last = [-1] * (len(word) + 1)
        for end, n in self.automaton.iter(word):
            end += 1
            start = end - length[n]
            if last[end] >= 0:
                continue
            if start:
                pair = last[start] << bpe.PAIR_BITS | n
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.together(last[start], n)
                if not fits:
                    continue
            last[end] = n
        out, at = [], len(word)
        while at:
            out.append(ids[last[at]])
            at -= length[last[at]]
        return out[::-1]

    def words(self, text: str) -> list[str]:
        """Composed, in lower case (character by character, so that no sigma is a final one), cut by the pattern; white space is in no word, so that it need not be replaced. Texts with a character that Python's tables don't have yet are normalised and cut by the library's."""
        if text.isascii():
            return self.regex.findall(text.lower())
        if all(unicodedata.category(c) != "Cn" for c in set(text)):
            return self.regex.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if self.library is None:
            import tokenizers as lib

            steps = lib.normalizers
            self.library = steps.Sequence([steps.NFC(), steps.Replace(lib.Regex(r"\s+"), " "), steps.Lowercase()]), lib.pre_tokenizers.Split(lib.Regex(self.v.pattern), "removed", invert=True)
        return [word for word, _ in self.library[1].pre_tokenize_str(self.library[0].normalize_str(text))]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Special tokens that a text spells are themselves, as the library takes them."""
        out, at = [], 0
        for m in self.special.finditer(text):
            out += map(self.memo.__getitem__, self.words(text[at : m.start()]))
            out.append(self.v.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        return b"".join([*out, *map(self.memo.__getitem__, self.words(text[at:] if at else text))])


class WordTokenizer(bpe.Tokenizer):
    """Encoding and decoding of columns with the tokenizer file at ``path`` (read on the driver); for ``bpe.encode_documents``.

    Null and empty texts have no ids. Decoding gives the tokens with a space between each two.
    """

    def __init__(self, spark: SparkSession, path: str):
        bounded_batches(spark)
        with open(path, "rb") as f:
            content = f.read()
        self._share(spark, content, WordVocabulary(content))
