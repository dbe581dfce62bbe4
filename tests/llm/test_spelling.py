import random
import re
import zlib
from collections import Counter

import pytest

from cuelake.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(counts, times=5):
    """(word: form, root, n, n_near, form_n) by comparing all words."""
    out = {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        best = near[0] if near and -near[0][0] >= times * n else (None, None)
        out[w] = [best[1], w, n, len(near), best[0] and -best[0]]
    for row in out.values():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return out


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: [r.form, r.root, r.n, r.n_near, r.form_n] for r in rows}


def near_by_index(words):
    count = Counter(g for w in words for g in {w[i : i + 2] for i in range(len(w) - 1)})
    kept, asked = {}, {}
    for w in words:
        k, a = spelling.entries(w, count)
        kept[w], asked[w] = set(k), set(a)
    return {(a, b) for a in words for b in words if a < b and (kept[a] & asked[b] or kept[b] & asked[a])}


@pytest.mark.parametrize("letters", ["ab", "abc", "aéz", "abcdefgh"])
def test_no_pair_is_lost(letters):
    """Among words over few letters (many repeated grams), every pair of one edit meets in the index."""
    rng = random.Random(len(letters))
    for _ in range(12):
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(70)}
        for w in rng.sample(sorted(words), 20):
            i = rng.randrange(len(w))
            words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]}
        words = sorted(w for w in words if len(w) >= 4)
        assert {(a, b) for a in words for b in words if a < b and one_edit(a, b)} <= near_by_index(words)


def test_long_runs_of_one_letter():
    words = ["a" * n for n in range(4, 40)] + ["a" * n + "b" + "a" * m for n in range(12) for m in range(12) if n + m > 3]
    assert {(a, b) for a in words for b in words if a < b and one_edit(a, b)} <= near_by_index(words)
    assert max(len(spelling.entries(w, {})[0]) for w in ["a" * 5000, "ab" * 2500]) <= 14


def test_pivots_are_the_lightest_disjoint_pair():
    rng = random.Random(3)
    for _ in range(500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(4, 9)))
        count = {a + b: rng.randint(1, 9) for a in "abcd" for b in "abcd"}
        prefix = spelling.ranked_prefix(word, count)
        i, j = spelling.pivots(prefix)
        weight = {p: n for n, _, p in prefix[:3]}
        assert j - i >= 2 and weight[i] + weight[j] == min(weight[x] + weight[y] for x in weight for y in weight if y - x >= 2)


def test_groups_against_all_pairs(spark):
    rng = random.Random(11)
    words = {}
    for _ in range(150):
        w = "".join(rng.choice("aeinrstlé") for _ in range(rng.randint(4, 8)))
        words[w] = rng.choice([1, 5, 30, 200, 5000])
        for _ in range(3):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeé") + w[i:], w[:i] + "n" + w[i + 1 :]])
            if len(v) >= 4:
                words[v] = rng.choice([1, 5, 30, 1000])
    out = found(spelling.spelling_groups(spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, form string")))
    assert out == brute(words) and any(r[0] and r[1] != r[0] for r in out.values())


def test_chain_of_forms(spark):
    """A chain of eight forms ends at one root."""
    words = {"abcdefgh"[:k] + "zyxwvutq"[k:]: 5**k for k in range(9)}
    out = found(spelling.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {r[1] for r in out.values()} == {"abcdefgh"} and out == brute(words)


def test_ties_and_empty(spark):
    words = {"bbbbbb": 1, "abbbbb": 7, "bbbbba": 7, "cccccc": 3}
    out = found(spelling.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert out == brute(words) and out["bbbbbb"][0] == "abbbbb" and out["cccccc"] == [None, "cccccc", 3, 0, None]
    assert spelling.spelling_groups(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_groups(spark.createDataFrame([], "word string, n long"), times=1)


def counted(rows, every=199, least=6, often=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= often}


def test_word_counts(spark, small):
    rows = [(i, "Grüße ÉCOLE×x wordé " * 3 + "a" * (i % 9) + "Ωmega lettersÿ") for i in range(60)] + [(None, "lettersÿ " * 9), (1, None), (2, ""), (3, "q" * 50_000), (3, "q" * 50_000)]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, run string")
    for every, often in ((199, 5), (3, 1), (1, 2)):
        assert dict(spelling.word_counts(docs, spoil_every=every, least_count=often).collect()) == counted(rows, every, 6, often)
    assert spelling.word_counts(docs.limit(0)).count() == 0
    real = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert dict(spelling.word_counts(spark.read.parquet(f"{small}/documents.parquet")).collect()) == counted(real)
