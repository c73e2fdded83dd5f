import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from textquarry.llm import decontaminate as D
from textquarry.llm.common import table

SLOT = dict.fromkeys(D.NUMBERS, "<num>") | dict.fromkeys(D.NAMES, "<name>") | dict.fromkeys(D.UNITS, "<unit>")


def words_of(text):
    found = []
    for w in re.split("[ \t-\r]+", (text or "").lower()):
        while w and not w[0].isalnum():
            w = w[1:]
        while w and not w[-1].isalnum():
            w = w[:-1]
        if w:
            found.append(w)
    return found, ["<num>" if re.fullmatch(r"[0-9]+([.,:/-][0-9]+)*", w) else SLOT.get(w, w) for w in found]


def brute(docs, benchmark):
    """(items, changed) of each contaminated doc_id."""
    out = defaultdict(lambda: [[], False])
    for d in {d for d, _ in docs if d is not None}:
        texts = [words_of(t) for e, t in set(docs) if e == d]
        for item in sorted({i for i, _ in benchmark if i is not None}):
            parts = [words_of(t) for i, t in sorted(set(benchmark), key=str) if i == item]
            met = set()
            for part, (raw, canon) in enumerate(parts):
                width = min(len(raw), D.WINDOW)
                for at in range(len(raw) - width + 1) if width else ():
                    asked, form = raw[at : at + width], canon[at : at + width]
                    for own, plain in texts:
                        for k in range(len(own) - width + 1):
                            if plain[k : k + width] == form and not all(c in D.SLOTS for c in form):
                                met.add((part, at, tuple(zip(form, asked, own[k : k + width]))))
            seen = defaultdict(set)
            for part, at, window in met:
                for c, a, g in window:
                    if c in D.SLOTS:
                        seen[a, g].add((part, at))
            count = Counter({p: len(x) for p, x in seen.items()})
            rank = lambda p, v: (count[p], p[0] == p[1], v)
            one = {a: max((p for p in count if p[0] == a), key=lambda p: rank(p, p[1])) for a in {p[0] for p in count}}
            two = {g: max((p for p in one.values() if p[1] == g), key=lambda p: rank(p, p[0])) for g in {p[1] for p in one.values()}}
            usual = set(two.values())
            covered, changed = set(), False
            for part, at, window in met:
                equal = all(a == g for _, a, g in window)
                if equal or all((a, g) in usual for c, a, g in window if c in D.SLOTS):
                    covered |= {(part, at + k) for k in range(len(window))}
                    changed |= not equal
            if covered and len(covered) >= D.COVERAGE * sum(len(raw) for raw, _ in parts):
                out[d][0].append(str(item))
                out[d][1] |= changed
    return {d: (",".join(i), c) for d, (i, c) in out.items()}


def found(spark, docs, benchmark):
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, item_id int, n_words int")
    asked = spark.createDataFrame([(i, t, "x") for i, t in benchmark], "item_id long, text string, doc_id string")
    rows = D.contaminated(frame, asked).collect()
    assert all(r.n_items == len(r["items"].split(",")) for r in rows)
    return {r.doc_id: (r["items"], r.reparameterised) for r in rows}


def by_sql(docs, benchmark):
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", benchmark)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    return {d: (items, changed) for d, hit, _, items, changed in con.execute(D.SQL).fetchall() if hit}


def test_a_conflicting_slot_costs_only_its_windows(spark):
    item = "a farmer with 2 dogs walks past the mill and sees 2 cats that sleep on the warm wall beside the old garden gate all day long"
    twice = "there are 3 apples on the long wooden table and also 3 pears in the blue bowl that stands right beside the window over there"
    docs = [
        (0, f"before it {item} after it"), (1, item.replace("2 cats", "5 cats")), (2, item.replace("2", "7")), (3, twice.replace("3 apples", "4 apples").replace("3 pears", "5 pears")),
        (4, "nothing of the kind is written in this text of 2 lines"), (5, "3 apples on the long road"), (6, None),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(10, item), (11, twice)], "item_id long, text string")
    found = {r.doc_id: (r["items"], r.reparameterised) for r in D.contaminated(frame, benchmark).collect()}
    assert found == {0: ("10", False), 1: ("10", True), 2: ("10", True), 3: ("11", True)}


def test_probes(spark):
    halves = "if Tom buys pens quickly then Tom leaves work now"
    benchmark = [(1, halves), (2, "alpha beta"), (3, "add 1 2 3 4 5 6"), (4, "gamma"), (5, "give 3 coins"), (6, "7 8"), (7, ""), (8, None), (None, "seven green hills rise"), (9, "Ann met Tom and Tim at noon today there")]
    docs = [
        (1, "if James buys pens quickly and much later then Anna leaves work now"), (2, "so alpha, BETA it is"), (3, "the table 4 8 15 16 23 42 rows"), (4, "one Gamma."), (5, "give 9 coins"),
        (6, "7 8"), (7, ""), (8, None), (None, "alpha beta"), (9, "if James buys pens quickly then James leaves work now"), (10, "seven green hills rise"), (11, "add 9 2 3 4 5 6"), (12, "give\x0b3\x0ccoins!"),
        (13, "Ann met Bob and Bob at noon today there"), (14, "alpha"), (14, "beta"),
    ]
    got = found(spark, docs, benchmark)
    assert got == brute(docs, benchmark) == by_sql(docs, benchmark)
    assert 1 not in got and 3 not in got and 6 not in got and 10 not in got and 14 not in got
    assert got[2] == ("2", False) and got[4] == ("4", False) and got[5] == ("5", True) and got[9] == ("1", True) and got[12] == ("5", False)


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force_and_sql(spark, monkeypatch, seed):
    rng = random.Random(seed)
    vocabulary = "mill gate wall road tom anna james 2 3 14 3.5 miles days two kg".split()
    line = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "!"]) for _ in range(n))
    benchmark = [(k, line(rng.choice([1, 2, 3, 4, 5, 8, 12, 20]))) for k in range(25)] + [(3, line(9)), (4, "tom 2"), (4, "tom 2")]
    swap = {"2": "9", "3": "8", "tom": "jack", "anna": "emma", "14": "2", "james": "jack"}
    docs = []
    for k in range(60):
        text = f"{line(rng.randint(0, 6))} {rng.choice(benchmark)[1]} {line(rng.randint(0, 6))}"
        if k % 2:
            text = " ".join(swap.get(w, w) if rng.random() < 0.8 else w for w in text.split())
        docs.append((k % 50, text))
    docs += docs[:3]
    want = brute(docs, benchmark)
    assert len(want) > 20 and found(spark, docs, benchmark) == want == by_sql(docs, benchmark)
    monkeypatch.setattr(D, "SENT_WINDOWS", 0)
    monkeypatch.setattr(D, "SENT_IDS", 0)
    assert found(spark, docs, benchmark) == want


def test_empty_tables_long_text_and_stage(spark):
    item = "who walks past the old mill every day"
    assert found(spark, [], [(1, item)]) == {} == found(spark, [(1, item)], [])
    long = "wort " * 30000
    docs = [(1, f"{long} {item}"), (2, long), (3, None), (None, item), (2, "clean")]
    assert found(spark, docs, [(1, item)]) == {1: ("1", False)}
    frame = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, item_id string")
    left = frame.join(D.contaminated(frame, spark.createDataFrame([(1, item)], "item_id long, text string")).select("doc_id"), "doc_id", "left_anti")
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "2", "3", "None"]


def test_small_table_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    asked = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    want = by_sql(docs, asked)
    got = {r.doc_id: (r["items"], r.reparameterised) for r in D.op7_decontamination(spark, sf).where("contaminated").collect()}
    assert got == want and want


def test_words_are_made_once_and_as_before(spark):
    texts = [
        "", None, "...", " -- ?! ", "...a", "a...", "(A-b) --c-- d", "!!\t?x?\x0b..5..", "\u0130x \u00bfQu\u00e9? \u2014 \u2160.", "\U0001f600a\U0001f600 \U0001f600", "3.5, 3..5 1,000; x3 3x 7/8. -2-",
        "Seven second Mark, mm. ten's", "a\u00a0b .\u00a0. \u0301e", "_a_ __ `1`",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.raw, r.canon) for r in D.words(frame, "doc_id").collect()}
    assert got == {k: words_of(t) for k, t in enumerate(texts) if words_of(t)[0]}
    plan = D.hashes(D.words(frame, "doc_id"), [5], "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(lower(") == 1
