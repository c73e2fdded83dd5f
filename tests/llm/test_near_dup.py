import random
import re

import numpy as np
import pytest

from textquarry.llm import near_dup as N
from textquarry.llm.components import components


def brute(rows):
    sets = []
    for _, text in rows:
        words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    parent = {d: d for d, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b, both = rows[j][0], len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                lo, hi = sorted((top(a), top(b)))
                parent[hi] = lo
    return {d: (len(s), top(d)) for (d, _), s in zip(rows, sets, strict=True)}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    texts = [None, "", " \n\t", "one", "ONE", "a b c d", "A b  c d", "a b c d e", "wort " * 3000]
    for length in (12, 60, 200):
        for _ in range(4):
            base = [word() for _ in range(length)]
            for _ in range(9):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, length // 30))):
                    copy[rng.randrange(length)] = word()
                texts.append(" ".join(copy))
    # A chain: each differs from the last a little, the ends a lot.
    chain = [word() for _ in range(150)]
    for k in range(30):
        chain[(k * 37) % 150] = word()
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [256, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = corpus()
    want = brute(rows)
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, a int")
    found = N.near_duplicates(frame).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1]), rows[r.doc_id]


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A B c d e f"), (10, None)]
    found = sorted(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in found) == sorted([("None", 2, None, True), ("None", 0, None, True), ("4", 2, 4, True), ("4", 2, 4, True), ("9", 2, 4, False), ("10", 0, 10, True)])
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_corrected_estimate_is_close():
    rng = np.random.default_rng(1)
    for similarity in (0.5, 0.85, 0.95):
        shared = int(2000 * similarity / (1 + similarity) * 2 / 2)
        pool = rng.integers(0, 2**63, 2 * 2000, np.uint64)
        a, b = np.sort(pool[:2000]), np.sort(np.concatenate([pool[:shared], pool[2000 : 4000 - shared]]))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (N.packed(N.minima_of(v, np.array([0, len(v)])))[0] for v in (a, b))
        unequal = sum(((int(i) >> s) & 15) != ((int(j) >> s) & 15) for i, j in zip(x, y, strict=True) for s in range(0, 64, 4))
        match = 1 - unequal / N.MINIMA
        assert abs((match - 1 / 16) / (1 - 1 / 16) - exact) < 0.15


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(300, k) for k in range(301, 400)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}
    top = lambda x: x if parent.setdefault(x, x) == x else top(parent[x])
    for a, b in links:
        lo, hi = sorted((top(a), top(b)))
        parent[hi] = lo
    assert found == {x: top(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def thue_morse(n, a, b):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return "".join((a, b)[x] for x in out[:n])


def test_words_that_collide_under_a_polynomial_are_not_linked(spark):
    one, two = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    rows = [(1, one), (2, two), (3, one), (4, f"{one} x y z w"), (5, f"{two} x y z w")]
    found = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_rows_of_one_doc_id_with_different_texts(spark):
    rng = random.Random(12)
    rows, copies = [], {}
    for k in range(20):
        for half in (0, 1):
            words = ["".join(rng.choices("abcdefg", k=5)) for _ in range(120)]
            rows.append((k, " ".join(words)))
            words[60] = "other"
            copies[100 + 2 * k + half] = k
            rows.append((100 + 2 * k + half, " ".join(words)))
    rng.shuffle(rows)
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found} == copies | {k: k for k in range(20)}
