import hashlib
import random

import numpy as np

from textquarry.llm import suffix_dedup as D


def brute(rows):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for k in range(len(b) - 49):
                w = b[k : k + 50]
                least[w] = min(d, least.get(w, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if d is not None and least[b[k : k + 50]] < d:
                gone[k : k + 50] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffixes_are_sorted():
    rng = np.random.default_rng(1)
    for text in (rng.integers(97, 99, 3000).astype(np.uint8), np.tile(np.frombuffer(b"abcab", np.uint8), 300), np.full(400, 65, np.uint8)):
        starts = np.arange(len(text) - 50)
        got = np.concatenate(list(D.sorted_suffixes(text, starts)))
        keys = [text[i : i + 50].tobytes() for i in got]
        assert keys == sorted(keys) and sorted(got) == starts.tolist()


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "FREQUENT", 6)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcdé 𝕏", k=n))
    shared = [text(n) for n in (30, 49, 50, 51, 90, 400)]
    rows = [(k, "".join(rng.choice(shared) if rng.random() < 0.4 else text(rng.randint(1, 80)) for _ in range(rng.randint(0, 8)))) for k in range(120)]
    rows += [(200, rows[7][1]), (201, rows[7][1]), (202, "a" * 500), (203, "a" * 300), (204, "ab" * 300), (205, None), (206, ""), (None, rows[7][1]), (207, "x" + rows[9][1]), (5, rows[9][1])]
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, p int")
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.suffix_dedup(frame).collect()]
    assert sorted(found, key=str) == sorted(brute(rows), key=str)
    assert D.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_order_equals_lexsort_with_and_without_room_for_the_rank():
    rng = np.random.default_rng(2)
    high, low = rng.integers(0, 40, 3000).astype(np.uint64) << np.uint64(50), rng.integers(0, 30, 3000).astype(np.uint64)
    for bits in (40, 63):
        order, step = D._order(high, low, bits)
        want = np.lexsort((low, high))
        assert (high[order] == high[want]).all() and (low[order] == low[want]).all()
        assert (np.flatnonzero(step) == np.flatnonzero(np.append(False, (np.diff(high[want]) != 0) | (np.diff(low[want].astype(np.int64)) != 0)))).all()
    assert all(len(x) == 0 for x in D._order(high[:0], low[:0], 40))
