import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm import pii as P

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": "[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = {}
    for kind, pattern in PLAIN.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "phone" and 8 <= len(digits) <= 15 or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits):
                out[kind].append((m.start(), m.end()))
    return out


CASES = [
    None, "", "é a@b.c_d@e.f x@y z@w..v a@b@c.d 𝕏 +1 (017) 555-7713-", "1.2.3.4.5.6.7.8 0001.02.3.255 1.2.3.256 1.2.3", "4111 1111-1111 1111 4111  1111 4111111111111111 4111111111111112 1-2-3",
    "+12345678+1234567 +1((((2 +1 2345678901234567 +49.30.1234567)", "aaa" * 40_000, "12 " * 40_000, "a@b" + ".c" * 30_000, "1" * 50_000, "." * 1000 + "@" * 1000, "٣@x.y ¹²³ a@é.fr",
]


def check(spark, texts):
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, email string")
    for r in P.base(frame).collect():
        want = brute(texts[r.doc_id] or "")
        assert {k: [(s.start, s.end) for s in r[k]] for k in P.BASE} == want, texts[r.doc_id]


def test_cases(spark):
    check(spark, CASES)


@given(st.lists(st.text(alphabet="a.@_-+1 2()é𝕏", max_size=60) | st.text(alphabet="1234 -", max_size=60), min_size=30, max_size=60))
@settings(max_examples=8, deadline=None)
def test_random_texts(spark, texts):
    check(spark, texts)


def test_classifier_adds_and_spares(spark):
    rows = [
        (0, "my name is Robert Miller and more"), (1, "Anean Tiondor went on"), (2, "SSN 123-45-6789, é call me on 212-555-0182 now"),
        (3, "IBAN DE89 3704 0044 0532 0130 00 end"), (4, None), (5, "+1 (212) 555-0182 is a phone"), (6, "Dear Klaus Wagner"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = P.fit(P.vote_counts(P.spans(docs)))
    found = {r.doc_id: [(s.kind, rows[r.doc_id][1][s.start : s.end]) for s in r.added] for r in P.find(docs, model).collect()}
    assert found == {0: [("name", "Robert Miller")], 1: [], 2: [("tel", "212-555-0182"), ("ssn", "123-45-6789")], 3: [("iban", "DE89 3704 0044 0532 0130 00")], 4: [], 5: [], 6: [("name", "Klaus Wagner")]}
    assert {r.doc_id: r.text for r in P.redacted(P.find(docs, model)).collect()}[2] == "SSN [SSN], é call me on [TEL] now"
    assert P.find(spark.createDataFrame([], "doc_id long, text string"), P.fit({})).count() == 0


def test_reliable_labelers_are_found():
    """Votes drawn from known reliabilities: EM comes near them, and the classifier agrees with the truth."""
    import random

    rng, counts, truth = random.Random(4), {}, {}
    for _ in range(5000):
        true = rng.random() < 0.4
        votes = tuple(int(rng.random() < p) for p in ((0.95, 0.8, 0.7) if true else (0.4, 0.05, 0.05)))
        counts["tel", *votes] = counts.get(("tel", *votes), 0) + 1
        truth.setdefault(votes, [0, 0])[true] += 1
    model = P.fit(counts)
    right = sum(n[(model.bias["tel"] + sum(model.weight["tel", k] * v for k, v in zip(P.LABELERS, votes, strict=True))) > 0] for votes, n in truth.items())
    assert right / 5000 > 0.9


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = P.op2_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(docs) and sum(r.n_email for r in found) > 0 and sum(r.n_card for r in found) > 0
    for r in found:
        want = brute(docs[r.doc_id])
        plain = [f"{k}:{a}:{b}" for k in P.BASE for a, b in want[k]]
        assert [r[f"n_{k}"] for k in P.BASE] == [len(want[k]) for k in P.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(plain).encode()).hexdigest()
        assert r.spans.split(",")[: len(plain)] == plain or not plain


def test_names_after_capitalised_words(spark):
    rows = [
        (0, "Contact Anna Smith about it"), (1, "The Patient John Brown was seen by customer service"), (2, "unser Kollege Hans Schmidt"), (3, "signed Kevin Brian Miller"),
        (4, "é Author Anna Smith Wrote To Customer John Brown-"), (5, "Great Western Railway Company Limited"), (6, "Dear Klaus Wagner"), (7, "signed: Contact Peter Jones, Signed Maria Klein"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = {r.doc_id: [rows[r.doc_id][1][s.start : s.end] for s in r.extra] for r in P.candidates(P.base(docs)).collect()}
    assert pairs[0] == ["Contact Anna", "Anna Smith"] and pairs[6] == ["Klaus Wagner"]
    assert pairs[4] == ["Author Anna", "Anna Smith", "Smith Wrote", "Wrote To", "Customer John"]
    found = {r.doc_id: [rows[r.doc_id][1][s.start : s.end] for s in r.added] for r in P.find(docs, P.fit({})).collect()}
    assert "Anna Smith" in found[0] and "John Brown" in found[1] and "Hans Schmidt" in pairs[2] and "Anna Smith" in found[4] and found[5] == []
    assert len(found[3]) == 1 and "Peter Jones" in found[7] and "Maria Klein" in found[7]


def test_many_candidates_in_one_text(spark):
    import time

    one = "signed Anna Smith, call 212-555-0182 or write to a@b.cd and 1.2.3.4 now. "
    took = []
    for n in (2000, 16000):
        docs = spark.createDataFrame([(1, one * (n // 2))], "doc_id long, text string")
        began = time.perf_counter()
        (row,) = P.find(docs, P.fit({})).select(P.F.size("email").alias("e"), P.F.size("ip").alias("i"), P.F.size("added").alias("a")).collect()
        took.append(time.perf_counter() - began)
        assert (row.e, row.i, row.a) == (n // 2, n // 2, n)
    assert took[1] < 30


def test_scan_and_overlaps_against_brute_force(spark):
    import random

    rng = random.Random(6)
    rows = []
    for k in range(40):
        own, at = [], 0
        while at < 3000 * (k % 4):
            at += rng.randint(1, 9)
            own.append((at, at + rng.randint(1, 8), "x"))
            at = own[-1][1]
        others = [(a, a + rng.randint(1, 12), "y") for a in rng.choices(range(3000), k=rng.choice([0, 1, 5, 300]))]
        rows.append((k, own, others))
    frame = spark.createDataFrame(rows, f"id long, own {P._SPAN}, others {P._SPAN}")
    for r in frame.select("id", P._clear(P.F.col("own"), P.F.col("others")).alias("left")).collect():
        _, own, others = rows[r.id]
        assert [(s.start, s.end) for s in r.left] == [(a, b) for a, b, _ in own if not any(c < b and a < d for c, d, _ in others)]


def test_reliabilities_follow_the_data():
    """The more data, the less the priors weigh; and features decide where votes are silent."""
    import random

    rng, gaps = random.Random(5), []
    for size in (100, 1000, 30000):
        counts = {}
        for _ in range(size):
            true = rng.random() < 0.5
            votes = tuple(int(rng.random() < p) for p in ((0.99, 0.9, 0.9) if true else (0.1, 0.1, 0.1)))
            p = ("tel", *votes, 0, 0, 0, 0 if true else 3, 0)
            counts[p] = counts.get(p, 0) + 1
        model = P.fit(counts)
        gaps.append(abs(model.reliability["tel"]["gazetteer"][0] - 0.9) + abs(model.reliability["tel"]["shape"][1] - 0.1))
        assert model.values["tel", "behind"][0] > model.values["tel", "behind"][3]
    assert gaps[2] < 0.05 and gaps[2] < gaps[0]
