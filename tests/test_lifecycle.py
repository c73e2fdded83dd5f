import json

from pyspark.sql import functions as F

from textquarry.operators import analysis as AN
from textquarry.operators import lifecycle as L

NOW = 1_000_000


def test_queue_has_one_budget(spark):
    subs = spark.createDataFrame([(k, "pending", NOW - 300 - (k > 2) * k) for k in range(12)], "id long, status string, timecreated long")
    files = spark.createDataFrame([(100 + k, k % 3 != 0, 10 * k) for k in range(40)], "fileid long, supported boolean, timemodified long")
    rows = L.process_pending(subs, files, NOW).collect()
    one, two = [r for r in rows if r.phase == 1], sorted((r for r in rows if r.phase == 2), key=lambda r: r.fileid)
    # Ids 0 to 2 have waited for exactly the grace time.
    assert sorted(r.id for r in one) == list(range(3, 12)) and {r.action for r in one} == {"analyse"}
    assert [(r.fileid, r.action) for r in two] == [(100, "marker"), (101, "analyse"), (102, "analyse"), (103, "marker"), (104, "analyse"), (105, "analyse"), (106, "marker"), (107, "analyse"), (108, "analyse")]
    assert {r.phase for r in L.process_pending(subs, files, NOW, with_backfill=False).collect()} == {1}


def test_scan_defers(spark):
    files = spark.createDataFrame([("c", 1, f"h{k}", k % 5 != 0, k // 2, 50 - k, k) for k in range(40)], "cohort string, userid long, contenthash string, supported boolean, submissionid long, timemodified long, fileid long")
    tracked = files.where("fileid IN (1, 2)")
    taken, state = L.scan_step(files, tracked)
    assert [r.fileid for r in taken.orderBy("place").collect()] == [k for k in range(40) if k % 5 and k not in (1, 2)][:20]
    assert state.first()[:] == (20, True)
    assert L.scan_step(files.where("fileid < 9"), tracked)[1].first()[:] == (5, False)
    assert L.scan_step(files.limit(0), tracked)[1].first()[:] == (0, False)


def test_retention_of_sections_and_counters(spark):
    subs = spark.createDataFrame([(1, NOW - 91 * 86400, "t"), (2, NOW - 90 * 86400, "t"), (3, NOW - 91 * 86400, None)], "id long, timecreated long, normtext string")
    secs = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "b"), (3, 1, "c"), (4, 1, "d")], "subid long, section_num int, section_text string")
    assert sorted(L.prune_sections(secs, subs, NOW).collect(), key=str) == sorted([(1, 1, None), (1, 2, None), (2, 1, "b"), (3, 1, None), (4, 1, "d")], key=str)
    assert L.prune_counts(subs, secs, NOW).first()[:] == (1, 2)
    assert L.prune_sections(secs, subs, NOW, 0).collect() == secs.collect()


def test_visibility(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", 3), (4, "b", 3), (5, "c", 3)], "id long, cohort string, userid long")
    members = spark.createDataFrame([("a", 1, 9), ("a", 2, 9), ("a", 3, 8)], "cohort string, userid long, groupid long")
    named = lambda *x: spark.createDataFrame([(n,) for n in x], "cohort string")
    ids = lambda *more: sorted(r.id for r in L.visible(rows, members, 1, *more).collect())
    assert ids() == [1, 2] and ids(named("a", "b")) == [1, 2, 5] and ids(named("a", "b"), named("b")) == [1, 2, 4, 5]


def test_analysis_of_files(spark):
    answer = "I wrote this answer on my own after reading the act and then I asked my supervisor about it twice. "
    quoted = '"' + "word " * 25 + '" and little more'
    texts = {
        1: f"Question 1: What\n{answer * 4}\nQuestion 2: Why\n{quoted}\nAs an AI language model I hope this helps", 2: " short ", 3: "Это длинный текст на другом языке для проверки порогов.", 4: None,
        5: answer, 6: "x" * 39, 7: "x" * 40,
    }
    docs = spark.createDataFrame([(k, t, "damaged" if k == 4 else None, "docx", {"creator": "A", "last_modified_by": "B" * 300}) for k, t in texts.items()], "id long, text string, error string, method string, fields map<string,string>")
    rows, sections = AN.analysed(docs)
    found = {r.id: r for r in rows.collect()}
    assert {k: r.status for k, r in found.items()} == {1: "analysed", 2: "error", 3: "error", 4: "error", 5: "analysed", 6: "error", 7: "analysed"}
    assert (found[2].errormsg, found[3].errormsg, found[4].errormsg) == (AN.SHORT, AN.SCRIPT, "damaged")
    assert found[3].normtext.startswith("это длинный") and json.loads(found[3].analysisjson) == {"unsupported_script": True, "latin_letter_ratio": 0.0}
    assert found[2].normtext is None and found[2].analysisjson is None
    whole = json.loads(found[1].analysisjson)
    assert whole["section_count"] == 2 and whole["score_model"] == 3 and whole["extraction_chars"] == len(texts[1].encode()) and whole["extraction_method"] == "docx"
    kinds = [f["check"] for f in whole["authenticity"]["findings"]]
    assert kinds.count("assistant_artefact") == 2 and kinds[-1] == "file_provenance" and whole["authenticity"]["tally"] == {"n_strong": 2, "n_notable": 0, "n_context": 1}
    assert len(whole["authenticity"]["provenance"]["fields"]["last_modified_by"]) == 257 and whole["authenticity"]["questions"]
    described = {(r.id, r.section_num): r for r in sections.collect()}
    assert set(described) == {(1, 1), (1, 2), (5, 1), (7, 1)}
    first, second = described[1, 1], described[1, 2]
    assert (first.excluded_words, first.note, first.signalsjson) == (0, "", "[]")
    assert second.excluded_words >= 25 and json.loads(second.signalsjson)["_scope"]["reason"] in ("quoted material", "mostly not own prose")
    assert described[7, 1].note == "insufficient_text"


def test_store_keeps_what_is_analysed(spark):
    subs = spark.createDataFrame(
        [(1, 7, "c", "h1", "analysed", 10, 60.0), (2, 7, "c", "h2", "pending", 11, 0.0), (3, 7, "c", "h2", "error", 5, 0.0), (4, 8, "c", "h1", "error", 12, 0.0)],
        "id long, userid long, cohort string, contenthash string, status string, timecreated long, score double",
    )
    files = subs.select("userid", "cohort", "contenthash").distinct()
    todo = {r.id for r in AN.to_analyse(files, subs).collect()}
    assert todo == {2, 4}
    results = spark.createDataFrame([(2, "analysed", None, 0.0, "low", "t", "{}")], "id long, status string, errormsg string, score double, level string, normtext string, analysisjson string")
    after = {r.id: r for r in AN.stored(subs, results, NOW).collect()}
    assert (after[2].status, after[2].timecreated, after[2].timemodified, after[2].normtext) == ("analysed", 11, NOW, "t")
    assert (after[1].status, after[1].score, after[1].timemodified) == ("analysed", 60.0, None) and after[4].status == "error"


def test_reanalysis_drops_sections(spark):
    subs = spark.createDataFrame([(1, "a", "analysed", 50.0, "medium"), (2, "b", "analysed", 50.0, "medium")], "id long, cohort string, status string, score double, level string")
    secs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "subid long, section_num int")
    rows, left = L.reanalysed(subs, secs, F.col("cohort") == "a")
    assert {r.id: (r.status, r.score, r.level) for r in rows.collect()} == {1: ("pending", 0.0, "low"), 2: ("analysed", 50.0, "medium")}
    assert [r.subid for r in left.collect()] == [2]
