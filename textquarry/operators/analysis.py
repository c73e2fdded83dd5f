"""The analysis of a submission, from its extracted text to the rows that are stored.

A document passes four gates (it was read, has 40 bytes of text, is half in Latin letters, has sections); one that fails
becomes a row with an error. Of the others come a submission row, with the normalised own prose that similarity compares and
a JSON document of findings, provenance and questions, and a row for each section. The score of a new row is 0: it is set by
what similarity finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.config import DEFAULT, Thresholds
from textquarry.functions.text import latin_ratio, normalise, text_or_empty, trimmed, word_count
from textquarry.operators import findings as FI
from textquarry.operators import prose as P
from textquarry.operators import provenance as PV
from textquarry.operators.sections import section_rows, split_sections

#: Version of the checks, stored with their results.
CHECKS = 1
SHORT = "The text is too short or empty; the file may hold only images."
SCRIPT = "The script of this document is not one that the checks can read."
NO_SECTIONS = "No sections were found in the document."
KEY = ("userid", "cohort", "contenthash")


def described_sections(docs: DataFrame, key: str = "id", t: Thresholds = DEFAULT) -> DataFrame:
    """Section rows with what is their author's own: words of own prose, excluded words and why, a note, and their JSON."""
    rows = section_rows(docs, key, t).select(key, "section_num", "label", "num", "text")
    own = P.own_prose(rows, t).withColumn("wordcount", word_count(F.col("prose")))
    note = F.when(F.col("wordcount") >= t.prose_words, "").when(F.col("excluded_words") > 0, "mostly_not_own_prose").otherwise("insufficient_text")
    scope = F.struct(F.col("excluded_words").alias("excluded"), F.col("excluded_reason").alias("reason"), F.col("note"))
    signals = F.when((F.col("excluded_words") > 0) | (F.col("note") != ""), F.to_json(F.struct(scope.alias("_scope")))).otherwise("[]")
    described = own.withColumn("note", note).withColumn("signalsjson", signals)
    return described.select(key, "section_num", "label", "num", F.substring("text", 1, t.text_chars).alias("section_text"), "wordcount", "excluded_words", "excluded_reason", "note", F.lit(0.0).alias("score"), F.lit("low").alias("level"), "signalsjson")


def _json(t: Thresholds) -> Column:
    tally = F.struct(*FI.tally(F.col("findings")))
    provenance = F.struct((F.size("fields") > 0).alias("available"), PV.cut_fields(F.col("fields"), t).alias("fields"))
    authenticity = F.struct("findings", tally.alias("tally"), provenance.alias("provenance"), "questions", F.lit(CHECKS).alias("checks_version"))
    return F.to_json(
        F.struct(
            F.col("n_sections").alias("section_count"), F.lit(0).alias("overall_score"), F.lit("low").alias("overall_level"), F.octet_length("text").alias("extraction_chars"),
            F.col("method").alias("extraction_method"), F.lit(False).alias("extraction_is_ocr"), authenticity.alias("authenticity"), F.lit(t.score_model).alias("score_model"),
        )
    )


def analysed(docs: DataFrame, t: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(rows, sections) of ``docs`` (id, text, error, method, fields): id, status, errormsg, score, level, normtext, analysisjson.

    A script that the checks can't read is refused, but its whole text stays comparable.
    """
    docs = docs.select("id", text_or_empty(F.col("text")).alias("text"), "error", "method", F.coalesce("fields", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("fields"))
    gate = lambda other_script: F.when(F.col("error").isNotNull(), F.col("error")).when(F.octet_length(trimmed(F.col("text"))) < t.document_bytes, SHORT).when(other_script, SCRIPT)
    sections = described_sections(docs.where(gate(latin_ratio(F.col("text")) < t.latin_floor).isNull()).select("id", "text"), "id", t)
    gated = docs.withColumn("_marks", FI.marks(F.col("text"))).withColumn("errormsg", gate(FI.below_latin(F.col("text"), F.col("_marks"), t.latin_floor)))
    # All of a row is found from its own text, row by row; what failed a gate has no text there.
    passed = gated.withColumn("_whole", F.col("text")).withColumn("text", F.when(F.col("errormsg").isNull(), F.col("text")))
    counted = split_sections(passed, t).withColumn("n_sections", F.nullif(F.size("sections"), F.lit(0)).cast("long")).drop("sections")
    rows = FI.with_questions(FI.with_findings(FI.noted(counted), t)).drop("_law")
    observed = F.when(F.size("fields") > 0, F.transform(PV.labels(F.col("fields"), word_count(F.col("text")), t), lambda x: FI.context(x))).otherwise(F.array().cast(FI.FINDING))
    rows = rows.withColumn("_observed", observed)
    rows = rows.withColumn("findings", F.when(F.size("_observed") > 0, FI.sorted_findings(F.concat("findings", "_observed"))).otherwise(F.col("findings"))).drop("_observed")
    refused = F.col("errormsg") == SCRIPT
    errormsg = F.coalesce("errormsg", F.when(F.col("n_sections").isNull(), NO_SECTIONS))
    whole = P.normal_text(rows, t, FI.headed(F.col("_marks"))).withColumn("errormsg", errormsg)
    json = F.when(refused, F.to_json(F.struct(F.lit(True).alias("unsupported_script"), F.round(latin_ratio(F.col("_whole")), 3).alias("latin_letter_ratio")))).when(F.col("errormsg").isNull(), _json(t))
    normtext = F.when(refused, F.substring(normalise(F.col("_whole")), 1, t.text_chars)).when(F.col("errormsg").isNull(), F.col("normtext"))
    status = F.when(F.col("errormsg").isNull(), "analysed").otherwise("error")
    return whole.select("id", status.alias("status"), "errormsg", F.lit(0.0).alias("score"), F.lit("low").alias("level"), normtext.alias("normtext"), json.alias("analysisjson")), sections


def to_analyse(files: DataFrame, subs: DataFrame) -> DataFrame:
    """Files (userid, cohort, contenthash) whose newest row is not analysed yet, with the id and creation time that they keep."""
    newest = subs.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("timecreated"), F.desc("id")))).where("_n = 1")
    return files.join(newest.select(*KEY, "id", "status", "timecreated"), list(KEY)).where("status <> 'analysed'").drop("status")


def stored(subs: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """``subs`` with the results of an analysis (id, ...): status, error, score, level, text and JSON are new, timecreated stays."""
    fresh = ("status", "errormsg", "score", "level", "normtext", "analysisjson")
    renamed = results.select("id", *[F.col(c).alias(f"_{c}") for c in fresh], F.lit(True).alias("_done"))
    joined = subs.join(renamed, "id", "left")
    done = F.coalesce("_done", F.lit(False))
    own = lambda c: F.col(c) if c in subs.columns else F.lit(None)
    kept = [c for c in subs.columns if c not in (*fresh, "timemodified")]
    return joined.select(*kept, *[F.when(done, F.col(f"_{c}")).otherwise(own(c)).alias(c) for c in fresh], F.when(done, F.lit(now).cast("long")).otherwise(own("timemodified")).alias("timemodified"))
