import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import findings as FI
from textquarry.operators import prose as P
from textquarry.operators import sections as S


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("Hello, World!", "hello world"), ("co-op 19.99", "coop 1999"), ("  a\t\nb  ", "a b"), ("Café É", "café é"), ("日本 語", "日本 語"), (None, ""), ("", ""), ("a b", "a b")],
)
def test_normalise(spark, text, want):
    assert one(spark, T.normalise(F.col("t")), t=text) == want


def test_tokens_and_bigrams(spark):
    grams = lambda t: one(spark, T.bigrams(T.tokens(T.normalise(F.col("t")))), t=t)
    assert grams("the quick brown fox") == ["the_quick", "quick_brown", "brown_fox"]
    assert sorted(grams("a b a b a b")) == ["a_b", "b_a"]
    assert grams("single") == [] and grams("") == []
    assert one(spark, T.tokens(F.col("t")), t="ab 日本 c") == ["ab", "日", "本", "c"]


@pytest.mark.parametrize(("a", "b", "want"), [("the cat sat on the mat", "the cat sat on the mat", 1.0), ("the cat sat on the mat", "the cat sat on the rug", 0.6667), ("a b c", "x y z", 0.0), ("", "a b", 0.0), ("one", "one", 0.0)])
def test_jaccard(spark, a, b, want):
    sets = lambda c: T.bigrams(T.tokens(T.normalise(F.col(c))))
    assert one(spark, T.jaccard(sets("a"), sets("b")), a=a, b=b) == one(spark, T.jaccard(sets("b"), sets("a")), a=a, b=b) == want


@pytest.mark.parametrize(("score", "want"), [(0.0, "low"), (34.9, "low"), (35.0, "medium"), (64.9, "medium"), (65.0, "high"), (100.0, "high")])
def test_band(spark, score, want):
    assert one(spark, T.band(F.col("s")), s=score) == want


@pytest.mark.parametrize(("n", "want"), [(1, 3), (9, 3), (12, 4), (30, 10), (40, 14), (100, 34)])
def test_template_threshold(spark, n, want):
    assert one(spark, T.template_threshold(F.col("n")), n=n) == want


BODY = " with an answer that is long enough to be kept here\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"intro\nQuestion 1: Describe{BODY}Q.2{BODY.upper()}", [("Question 1", 1), ("Q. 2", 2)]),
        (f"  Task 1:{BODY.upper()}\f task 2 Explain{BODY}", [("Task 1", 1), ("task 2", 2)]),
        (f"Section 28 of the Act{BODY}Section 3 of it{BODY}", [("Full Document", 0)]),
        (f"1. First{BODY} 2) Second{BODY}", [("Question 1", 1), ("Question 2", 2)]),
        (f"123. First{BODY}124. Second{BODY}", [("Full Document", 0)]),
        ("short", [("Full Document", 0)]), ("", []), (None, []), (" \r\n", []),
    ],
)
def test_sections(spark, text, want):
    frame = spark.createDataFrame([(1, text)], "id int, text string")
    for variant in (text, text and text.replace("\n", "\r\n")):
        rows = S.section_rows(frame.withColumn("text", F.lit(variant).cast("string")), "id").orderBy("section_num").collect()
        assert [(r.label, r.num) for r in rows] == want


def test_sections_take_time_in_proportion(spark):
    import time

    took = []
    for n in (2000, 32000):
        text = "".join(f"Question {k}: Explain\n{'an answer of some length to be kept'}\n" for k in range(n))
        frame = spark.createDataFrame([(1, text)], "id int, text string")
        began = time.perf_counter()
        assert S.section_rows(frame, "id").count() in (n, 1)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 + 16 * took[0]


def test_prose(spark):
    long_words = " ".join(f"word{chr(97 + k)}" for k in range(25))
    keep = " ".join(f"own{chr(97 + k)}" for k in range(26)) * 3
    def run(t):
        row = P.own_prose(spark.createDataFrame([(t,)], "text string")).first()
        return row.prose, row.excluded_words, row.excluded_reason
    assert run(f'{keep} "{long_words}" end') == (f'{keep} " " end', 25, "quoted material")
    assert run(f"{keep} “{long_words}” end")[1:] == (25, "quoted material")
    assert run(f'{keep} "short" one and " a mark')[1:] == (0, "")
    assert run(f"{keep}\nReferences\nSmith, J. (2019). Title.")[1] == 5 - 1
    assert run(f"Smith, J. (2019). {long_words}\nown words")[0] == ""
    assert run(None) == ("", 0, "")


def test_findings(spark):
    text = "As an AI language model I cannot. " * 60 + "\n   ## Heading\n* point one **bold** and *thin* here\nPrivacy Act 1989 and of the Privacy Act 1988, the Imaginary Things Act 2001."
    rows = FI.text_findings(spark.createDataFrame([(1, text), (2, "Plain honest text - with hyphens."), (3, None)], "id int, text string"), "id").collect()
    found = {r.id: [(f.check, f.label, f.severity, f["count"]) for f in r.findings] for r in rows}
    strong = [f for f in found[1] if f[2] == "strong"]
    assert len([f for f in strong if f[0] == "assistant_artefact"]) == 12 and ("reference_wrong_year", "real Act, year does not exist", "strong", None) in strong
    assert {f[1] for f in found[1] if f[0] == "markdown_contamination"} == {"markdown heading", "markdown bold", "markdown italic", "markdown bullet"}
    assert [f[0] for f in found[1] if f[0] == "reference_unrecognised"] == ["reference_unrecognised"]
    assert found[2] == [] and found[3] == []


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 59, 60, 61, 200, 800])
def test_evidence_is_valid_and_quotes_the_match(n):
    text = "é日" * n + " MATCH here " + "𝕏" * 90
    quoted = FI.window_of(text, len(text[: text.index("MATCH")].encode()))
    assert "MATCH" in quoted and len(quoted.encode()) <= 190
