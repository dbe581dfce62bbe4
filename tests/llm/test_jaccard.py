import itertools
import random
import re

import numpy as np
import pytest

from cuelake.llm import components
from cuelake.llm import jaccard as J
from cuelake.llm.components import connected_components
from cuelake.llm.workdir import Scratch


def sets_of(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, num, den):
    sets = [(i, sets_of(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        both = len(a & b)
        if both and den * both >= num * (len(a) + len(b) - both) and find(i) != find(j):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def edited(rng, words, share):
    return [rng.choice("zyxw") + str(rng.randint(0, 99)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_same_as_brute_force(spark, n, num, den):
    rng = random.Random(n)
    rows, word = [], lambda: "w" + str(rng.randint(0, 3000))
    passage = [word() for _ in range(60)]
    for size in (4, 5, 7, 9, 12, 16, 18, 22, 30, 45, 90, 200):
        base = [word() for _ in range(size)]
        for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05):
            rows.append(" ".join(edited(rng, base, share)).upper() if share == 0.01 else " ".join(edited(rng, base, share)))
        rows.append(" ".join(base[: max(1, size * 9 // 10)]))
        rows.append(" ".join(base + base[: size // 8]))
    rows += [" ".join([word() for _ in range(40)] + passage) for _ in range(20)] + ["a b", "a  b", "a\tb c", "", "  ", "one"]
    ids = list(range(100, 100 + len(rows)))
    rng.shuffle(ids)
    rows = list(zip(ids, rows, strict=True))
    out = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=n, num=num, den=den).collect()
    want = brute(rows, n, num, den)
    assert len({c for _, c in want.values()}) < len(want) - 30
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_edges(spark):
    rows = [(5, None, "k"), (3, "", "k"), (7, "a b c d e", None), (7, "a b c d e", None), (None, "a b c d e", "x"), (None, "q r s t u", "x"), (2, "A B  c\nd E", "x"), (9, " ".join(f"w{i}" for i in range(60000)), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()), key=repr)
    assert out == sorted([(5, 0, 5), (3, 0, 3), (7, 2, 2), (7, 2, 2), (None, 2, 2), (None, 2, None), (2, 2, 2), (9, 59997, 9)], key=repr)
    assert J.jaccard_components(df.limit(0)).count() == 0


def test_versions_of_one_id(spark):
    """A row with the id of another set's first document doesn't count as that document's set."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (7, a), (7, b), (9, b + " x"), (11, a + " y"), (12, "y " + a)]
    out = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(3, 3), (7, 3), (7, 7), (9, 7), (11, 3), (12, 3)]


def test_group_of_near_copies_makes_no_pairs(spark):
    """Of many near copies each meets few others; the component is whole."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(w if k != i % 150 else f"u{i}" for k, w in enumerate(base))) for i in range(600)]
    out = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in out} == {0} and rng


def thue_morse(length):
    out = "a"
    while len(out) < length:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_words_of_one_sum_are_not_one_word(spark):
    """Words whose polynomials vanish modulo powers of two, long and short, have hashes of their own."""
    rows = []
    for k, n in enumerate((16, 256, 512, 1024, 4096)):
        rows += [(2 * k + 1, thue_morse(n)), (2 * k + 2, thue_morse(n).translate(str.maketrans("ab", "ba")))]
    rows.append((50, " ".join(t for _, t in rows)))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=1).collect()}
    assert out == {i: (1, i) for i, _ in rows[:-1]} | {50: (10, 50)}


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(3)
    for size, gone in ((40, 3), (300, 60), (5000, 900)):
        a = rng.integers(0, 2**64, size, dtype=np.uint64)
        b = np.concatenate((a[gone:], rng.integers(0, 2**64, gone, dtype=np.uint64)))
        x = np.frombuffer(J.parity(np.concatenate((a, b)), np.repeat([0, 1], size), 2).tobytes(), np.uint64).reshape(2, -1)
        assert 0 < np.bitwise_count(x[0] ^ x[1]).sum() <= 2 * gone


def test_passage_of_many_unlike_documents(spark):
    """Documents that are mostly one passage, a little too unlike to link, meet in blocks; the links among them are found."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(80)]
    rows = [(i, " ".join(passage + [f"u{i}_{k}" for k in range(10)])) for i in range(300)]
    rows += [(1000 + i, rows[7 * i][1] + f" t{i}") for i in range(40)]
    rng.shuffle(rows)
    J.BLOCK_ROWS, before = 64, J.BLOCK_ROWS
    out = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    J.BLOCK_ROWS = before
    assert out == {i: (i if i < 1000 else 7 * (i - 1000)) for i, _ in rows}


def test_light_sets_share_a_subset_key():
    for num, den in ((85, 100), (4, 5)):
        for b in range(1, 20):
            for a in range(1, b + 1):
                for gone in range(a):
                    both = a - gone
                    if den * both < num * (a + b - both) or J.missing(b, num, den) > 2:
                        continue
                    x = np.arange(a, dtype=np.uint64)
                    y = np.concatenate((x[gone:], np.arange(1000, 1000 + b - both, dtype=np.uint64)))
                    assert set(J.subset_keys(x, num, den)) & set(J.subset_keys(y, num, den))


def test_boundary_follows_the_sizes():
    assert J.boundary({}, 85, 100) >= 1
    assert 1 <= J.boundary({n: 100 for n in range(1, 41)}, 85, 100) <= 20
    assert J.boundary({7: 1000}, 85, 100) > 7 and J.boundary({30: 1000}, 85, 100) <= 30


@pytest.mark.parametrize("many", [1_000_000, 0])
def test_components(spark, monkeypatch, many):
    monkeypatch.setattr(components, "MANY_EDGES", many)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, rng.randint(101, 160)) for _ in range(80)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(c == 100 for n, c in found.items() if 100 <= n < 200) and found[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
