import math
import random
import re
from collections import Counter
from functools import cache

import numpy as np

from textquarry.llm import arrays as A
from textquarry.llm import quality as Q
from textquarry.llm.common import table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def words_of(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def base(text):
    text, words = text or "", words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed


@cache
def hash_of(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return A.segment_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


@cache
def bucket(*words):
    return int(A.shingle_hashes(np.array([hash_of(w) for w in words], np.uint64), len(words))[0]) >> (64 - Q.BUCKET_BITS)


def brute(rows, labels):
    """(base counts, kept) of each row, with counts, ratios and threshold in plain Python."""
    met = {}
    for d, q in labels:
        if d is not None and q is not None:
            met[d] = min(met.get(d, 1), int(q > 0))
    found = []
    for _, text in rows:
        words = words_of(text)
        found.append([bucket(w) for w in words] + [bucket(*p) for p in zip(words, words[1:])])
    raw, target, bad = Counter(), Counter(), Counter()
    for (d, _), own in zip(rows, found, strict=True):
        raw.update(own)
        if d in met:
            (target if met[d] else bad).update(own)
    share = lambda c, b: math.log((c[b] + 1) / (c.total() + 2**Q.BUCKET_BITS))
    units = {b: round((share(target, b) - share(raw, b)) * Q.UNIT) for b in raw}
    mean = lambda c: sum(units[b] * n for b, n in c.items()) / c.total()
    least = (mean(target) + mean(bad)) / 2 if target and bad else None
    out = []
    for (_, text), own in zip(rows, found, strict=True):
        counts = base(text)
        out.append((*counts, not counts[-1] and (least is None or sum(units[b] for b in own) >= least * len(own))))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    good, junk = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)], ["".join(rng.choices("stuvwxyz#", k=4)) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \n\t\n"), (3, "wort " * 400), (4, "Ä|é <b>\n" * 30), (5, "x\n x\nx\n" + " ".join(good)), (None, " ".join(good))]
    for k in range(10, 60):
        pool = good if k % 3 else junk
        rows.append((k, " ".join(rng.choice(pool if rng.random() < 0.8 else good + junk) + rng.choice(["", "", "", "\n"]) for _ in range(rng.randint(40, 300)))))
    rows.append((11, " ".join(rng.choices(junk, k=90))))  # one doc_id, another text
    rows.append(rows[-2])
    return rows, [(k, int(k % 3 > 0)) for k in range(10, 40)] + [(10, 0), (None, 1), (41, None), (999, 1)]


def as_rows(frame):
    return sorted((str(r.doc_id), *(r[c] for c in COUNTS), r.kept) for r in frame.collect())


def test_query_equals_brute_force(spark, monkeypatch):
    rows, labels = corpus()
    want = sorted((str(d), *x) for (d, _), x in zip(rows, brute(rows, labels), strict=True))
    assert {x[-1] for x in want if not x[-2]} == {True, False}
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, good int, quality string").repartition(3)
    marks = spark.createDataFrame([(d, q, 0, "y") for d, q in labels], "doc_id long, quality int, toxic int, text string")
    assert as_rows(Q.quality(docs, marks)) == want
    kept = Q.accepted(docs, Q.fit(docs, marks))
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(x[0] for x in want if x[-1])
    monkeypatch.setattr(Q, "SENT_LABELS", 0)
    assert as_rows(Q.quality(docs, marks)) == want


def test_labels_of_one_kind_and_empty_tables(spark):
    rows, labels = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    only_base = sorted((str(d), *base(t), not base(t)[-1]) for d, t in rows)
    for some in ([x for x in labels if x[1] == 1 and x[0] != 10], []):
        assert as_rows(Q.quality(docs, spark.createDataFrame(some, "doc_id long, quality int"))) == only_base
    assert Q.quality(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_lines_that_collide_under_a_polynomial_differ(spark):
    from tests.llm.test_near_dup import thue_morse

    one, two = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    frame = spark.createDataFrame([(1, f"{one}\n{two}\n{one} c d\n{two} c d"), (2, f"{one} c d {one} c d")], "doc_id long, text string")
    assert as_rows(Q.quality(frame, spark.createDataFrame([], "doc_id long, quality int"))) == sorted((str(d), *base(t), False) for d, t in ((r.doc_id, r.text) for r in frame.collect()))


def test_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    labels = [(r.doc_id, r.quality) for r in table(spark, sf, "labels").collect()]
    assert as_rows(Q.op8_quality_rules(spark, sf)) == sorted((str(d), *x) for (d, _), x in zip(rows, brute(rows, labels), strict=True))
