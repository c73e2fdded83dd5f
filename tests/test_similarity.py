import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textquarry.functions.text import bigram_hashes, tokens
from textquarry.operators import similarity as M
from textquarry.plans.tables import shared_root

WORDS = ["".join(random.Random(1).choices("abcdefghij", k=5)) + str(k) for k in range(4000)]


def brute(rows, least=100, strict=False):
    """Pairs of a cohort in plain Python: template of a sample, sets without it, Jaccard similarity."""
    grams = lambda t: {f"{a}_{b}" for a, b in zip(t.split(), t.split()[1:])}
    out = {}
    for cohort in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == cohort and r[3] is not None), key=lambda r: r[1])
        if len(own) < 3:
            continue
        n = len(own)
        stride = max(1, n // 60)
        sample = own if n <= 60 else [r for i, r in enumerate(own) if i % stride == 0 and i / stride < 60]
        counts = {}
        for r in sample:
            for g in grams(r[3]):
                counts[g] = counts.get(g, 0) + 1
        template = {g for g, c in counts.items() if c >= max(3, -(-min(n, 60) // 3))}
        sets = {r[1]: grams(r[3]) - template for r in own if r[2] == "analysed" and (len(r[3].encode()) > least if strict else len(r[3].encode()) >= least)}
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b]:
                    s = round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 4)
                    if s >= 0.35:
                        out[cohort, a, b] = s
    return out


def found(spark, rows, **kind):
    frame = spark.createDataFrame(rows, "cohort string, id long, status string, normtext string")
    return {(r.cohort, r.a, r.b): r.similarity for r in M.pairs(frame, **kind).collect()}


def cohorts(seed):
    rng = random.Random(seed)
    text = lambda n: rng.choices(WORDS, k=n)
    rows, k = [], 0
    for cohort, n in (("ring", 75), ("two", 2), ("three", 3), ("wide", 130)):
        form, ring = text(40), text(60)
        for i in range(n):
            k += 1
            body = form + text(50) if cohort != "ring" or i % 9 else form + ring[: 40 + i % 20] + text(i % 30)
            if cohort == "wide" and i in (5, 6, 7):
                body = form + ring + text(3 * i)
            rows.append((cohort, k, "analysed" if k % 11 else "pending", " ".join(body)))
    return rows + [("ring", 900, "analysed", None), ("ring", 901, "analysed", ""), ("three", 902, "analysed", "short text"), (None, 903, "analysed", "x " * 80)]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, seed):
    rows = cohorts(seed)
    want = brute(rows)
    assert len({c for c, *_ in want}) >= 2 and found(spark, rows) == want
    assert found(spark, rows, strict=True) == brute(rows, strict=True)


def test_strict_floor_is_above_the_least_length(spark):
    both = [("d", 1, "analysed", "a b c d " + "x" * 92), ("d", 2, "analysed", "a b c d " + "x" * 92), ("d", 3, "analysed", "p q r s " + "y" * 100)]
    assert len(both[0][3].encode()) == 100
    assert found(spark, both) == {("d", 1, 2): 1.0} and found(spark, both, strict=True) == {}


def test_only_pairs_with_new_rows(spark):
    rows = cohorts(3)
    every = found(spark, rows)
    new = {k for k in range(1, 60, 4)}
    some = found(spark, rows, new=spark.createDataFrame([(k,) for k in new], "id long"))
    assert some == {p: s for p, s in every.items() if p[1] in new or p[2] in new} and some


def test_hashed_sets_have_the_size_of_string_sets(spark):
    text = " ".join(random.Random(4).choices(WORDS[:200], k=3000))
    row = spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t")).alias("toks"))
    (n,) = row.select(F.size(bigram_hashes(F.col("toks")))).first()
    assert n == len({(a, b) for a, b in zip(text.split(), text.split()[1:])})


def test_shared_bigrams_and_groups_of_candidates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "COUNTED", 50)
    sets = {(c, k): sorted({(7 * k + j * (k % 5 + 1)) % 400 - 200 for j in range(30)}) for c in "ab" for k in range(12)}
    frame = spark.createDataFrame([(c, k, hs, len(hs)) for (c, k), hs in sets.items()], "cohort string, id long, hs array<long>, size int")
    want = sorted((k, sum(h in other for (x, _), other in sets.items() if x == c)) for (c, k), hs in sets.items() for h in hs)
    assert sorted((r.id, r.df) for r in M.shared_bigrams(frame).collect()) == [x for x in want if x[1] > 1]
    # Parts of a few candidates and of few bigrams find the same pairs.
    monkeypatch.setattr(M, "TRIED", 3)
    monkeypatch.setattr(M, "GROUPED", 100)
    rows = [r for r in cohorts(5) if r[0] in ("ring", "three")]
    assert found(spark, rows) == brute(rows) != {}


def test_pairs_leave_one_table(spark):
    root = Path(shared_root(spark))
    before = set(root.glob("*"))
    assert found(spark, [r for r in cohorts(6) if r[0] in ("ring", "three")])
    assert [p.name.split("-")[0] for p in set(root.glob("*")) - before] == ["pairs"]


def test_hashed_bigrams_of_texts_equal_pairs_of_tokens(spark):
    texts = ["a b a b", "", "x", "a b ", "ab 漢字x b", "á é è é", "ไทย b", "b  a", "漢 字 x"]
    rows = spark.createDataFrame([("c", k, x) for k, x in enumerate(texts)], "cohort string, id long, normtext string")
    want = {r.id: {*zip(r.t, r.t[1:])} for r in rows.select("id", tokens(F.col("normtext")).alias("t")).collect()}
    got = {r.id: set(r.hs) for r in M.bigram_sets(rows).collect()}
    assert all(len(got[a] & got[b]) == len(want[a] & want[b]) for a in want for b in want) and len(got) == len(texts)
