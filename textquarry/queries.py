"""Queries of the library over the test bed, and for each the SQL that gives the same rows.

Names match between the two: every computed column is aliased. Counts are 64-bit, scores are doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import analysis as AN
from textquarry.operators import findings as FI
from textquarry.operators import lifecycle as L
from textquarry.operators import prose as P
from textquarry.operators import provenance as PV
from textquarry.operators import reports as R
from textquarry.operators import sections as S
from textquarry.operators import similarity as M
from textquarry.plans.tables import written
from textquarry.plans.testbed import NOW, SUBS_SQL, submissions
from textquarry.streaming import scores as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def comparable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions with their normalised own prose, as similarity takes them."""
    return written(P.normal_text(submissions(spark, sf_dir)).select("cohort", "id", "status", "normtext"), "normalised")


_CTE = f"WITH {SUBS_SQL}"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[^\\pL\\pN\\pM\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^\\pL\\pN\\pM'']+'), lambda w: length(w) >= 2)"


def _count(c: str, pattern: str, options: str = "") -> str:
    """How many matches."""
    return f"len(regexp_extract_all({c}, '{pattern}'{options}))"


@query("normalised_text", f"{_CTE} SELECT id, {_norm('text')} AS normtext FROM subs")
def normalised_text(spark, sf_dir):
    return submissions(spark, sf_dir).select("id", T.normalise(F.col("text")).alias("normtext"))


@query("word_counts", f"{_CTE} SELECT id, len({_words('text')})::BIGINT AS n_words FROM subs")
def word_counts(spark, sf_dir):
    return submissions(spark, sf_dir).select("id", T.word_count(F.col("text")).cast("long").alias("n_words"))


@query(
    "latin_ratio_guard",
    f"""{_CTE}, r AS (SELECT id, {_count('text', '\\p{Latin}')} AS l, {_count('text', '\\pL')} AS n FROM subs)
    SELECT id, round(CASE WHEN n = 0 THEN 1.0 ELSE l / n END, 6)::DOUBLE AS ratio, (CASE WHEN n = 0 THEN 1.0 ELSE l / n END) >= 0.5 AS accepted FROM r""",
)
def latin_ratio_guard(spark, sf_dir):
    ratio = T.latin_ratio(F.col("text"))
    return submissions(spark, sf_dir).select("id", F.round(ratio, 6).alias("ratio"), (ratio >= 0.5).alias("accepted"))


_GARBLED = "CASE WHEN id % 6 = 0 THEN repeat('%&/()=?#', 20) WHEN id % 6 = 1 THEN concat(text, repeat('�', 1 + length(text) // 50)) WHEN id % 6 = 2 THEN 'short' ELSE text END"


@query(
    "readability_gate",
    f"""{_CTE}, g AS (SELECT id, {_GARBLED} AS t FROM subs),
    c AS (SELECT id, t, {_count('t', '[^\\s]')} AS solid, {_count('t', '[\\pL\\pM\\pN]')} AS good, length(t) - length(replace(t, '�', '')) AS bad FROM g)
    SELECT id, strlen(trim(t)) >= 20 AND solid > 0 AND good / solid > 0.45 AND bad <= 0.01 * length(t) AS readable FROM c""",
)
def readability_gate(spark, sf_dir):
    garbled = submissions(spark, sf_dir).select("id", F.expr(_GARBLED.replace("length(text) // 50", "length(text) div 50")).alias("t"))
    return garbled.select("id", T.readable(F.col("t")).alias("readable"))


_TOKENS = f"""tok AS (SELECT cohort, id, status, normtext, string_split(normtext, ' ') AS t FROM norm),
  grams AS (SELECT cohort, id, unnest(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))) AS g FROM tok WHERE len(t) >= 2)"""
#: References off, straight and typographic quotations of enough words off, then the rule on little prose.
_PROSE = f"""cut AS (SELECT id, cohort, status, text, regexp_replace(text, '(?ims)^[ \\t]*(references|reference list|bibliography|works cited|citations)[ \\t:]*$.*', '') AS c FROM subs),
  refs AS (SELECT *, array_to_string(list_filter(string_split(c, chr(10)), lambda l: NOT regexp_matches(l, '^\\s*[A-Z][\\pL''-]+,\\s*[A-Z]\\.(\\s*[A-Z]\\.)*.*\\([0-9]{{4}}[a-z]?\\)')), chr(10)) AS r FROM cut),
  parts AS (SELECT *, string_split(r, '"') AS q FROM refs),
  straight AS (SELECT *, array_to_string(list_transform(q, lambda x, i: CASE WHEN i % 2 = 0 AND i <= len(q) - 1 AND len({_words('x')}) >= 20 THEN ' ' ELSE x END), '"') AS s FROM parts),
  typed AS (SELECT *, list_reduce(list_prepend(s, list_distinct(regexp_extract_all(s, '“[^”]*”'))), lambda acc, x: CASE WHEN len({_words("x[2:-2]")}) >= 20 THEN replace(acc, x, ' ') ELSE acc END) AS w FROM straight),
  counted AS (SELECT *, len({_words('text')}) AS before, len({_words('w')}) AS after FROM typed),
  own AS (SELECT id, cohort, status, CASE WHEN before > 0 AND after < 40 AND after < before * 0.5 THEN '' ELSE w END AS prose, greatest(0, before - after) AS excluded, r <> text AS no_refs, w <> r AS no_quotes, before > 0 AND after < 40 AND after < before * 0.5 AS little FROM counted)"""
_NORM = f"{_CTE}, {_PROSE}, norm AS (SELECT cohort, id, status, left({_norm('prose')}, 65000) AS normtext FROM own), {_TOKENS}"
_SIMILAR = f"""{_NORM}, ranked AS (SELECT cohort, id, row_number() OVER (PARTITION BY cohort ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n FROM norm),
  sample AS (SELECT cohort, id, least(n, 60) AS n FROM ranked WHERE n <= 60 OR (i % greatest(1, n // 60) = 0 AND i // greatest(1, n // 60) < 60)),
  template AS (SELECT g.cohort, g.g FROM grams g JOIN sample s ON g.cohort = s.cohort AND g.id = s.id GROUP BY g.cohort, g.g HAVING any_value(s.n) >= 3 AND count(*) >= greatest(3, ceil(any_value(s.n) / 3))),
  big AS (SELECT cohort FROM norm GROUP BY cohort HAVING count(*) >= 3),
  mine AS (SELECT g.cohort, g.id, g.g FROM grams g JOIN norm n ON g.cohort = n.cohort AND g.id = n.id JOIN big ON big.cohort = g.cohort
    WHERE n.status = 'analysed' AND strlen(n.normtext) >= 100 AND NOT EXISTS (SELECT 1 FROM template t WHERE t.cohort = g.cohort AND t.g = g.g)),
  sizes AS (SELECT cohort, id, count(*) AS n FROM mine GROUP BY ALL),
  common AS (SELECT a.cohort, a.id AS a, b.id AS b, count(*) AS c FROM mine a JOIN mine b ON a.cohort = b.cohort AND a.g = b.g AND a.id < b.id GROUP BY ALL),
  pair AS (SELECT c.cohort, a, b, similarity FROM (SELECT c.*, round(c / (x.n + y.n - c), 4)::DOUBLE AS similarity FROM common c JOIN sizes x ON x.cohort = c.cohort AND x.id = a JOIN sizes y ON y.cohort = c.cohort AND y.id = b) c WHERE similarity >= 0.35),
  both_ways AS (SELECT cohort, a AS id, b AS other, similarity FROM pair UNION ALL SELECT cohort, b, a, similarity FROM pair)"""


@query("token_bigrams", f"{_NORM} SELECT id, count(*) AS n_bigrams, min(g) AS first_bigram, max(g) AS last_bigram FROM grams GROUP BY id")
def token_bigrams(spark, sf_dir):
    rows = comparable_rows(spark, sf_dir).select("id", F.explode(T.bigrams(T.tokens(F.col("normtext")))).alias("g"))
    return rows.groupBy("id").agg(F.count("*").alias("n_bigrams"), F.min("g").alias("first_bigram"), F.max("g").alias("last_bigram"))


@query("bigram_document_frequency", f"{_NORM} SELECT cohort, df, count(*) AS n_bigrams FROM (SELECT cohort, g, count(*) AS df FROM grams GROUP BY ALL) GROUP BY ALL")
def bigram_document_frequency(spark, sf_dir):
    return M.document_frequency(comparable_rows(spark, sf_dir)).groupBy("cohort", "df").agg(F.count("*").alias("n_bigrams"))


@query("template_size_per_cohort", f"{_SIMILAR} SELECT cohort, count(*) AS n_template FROM template GROUP BY cohort")
def template_size_per_cohort(spark, sf_dir):
    return M.template(comparable_rows(spark, sf_dir)).groupBy("cohort").agg(F.count("*").alias("n_template"))


@query("stride_sample_template", f"{_SIMILAR} SELECT cohort, count(*) AS n_sampled, min(id) AS first_id, max(id) AS last_id, sum(id)::BIGINT AS id_sum FROM sample GROUP BY cohort")
def stride_sample_template(spark, sf_dir):
    sample = M.stride_sample(comparable_rows(spark, sf_dir).select("cohort", "id"))
    return sample.groupBy("cohort").agg(F.count("*").alias("n_sampled"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("id").alias("id_sum"))


@query("pair_similarity", f"{_SIMILAR} SELECT * FROM pair")
def pair_similarity(spark, sf_dir):
    return M.pairs(comparable_rows(spark, sf_dir))


_BAND = "CASE WHEN {0} >= 65 THEN 'high' WHEN {0} >= 35 THEN 'medium' ELSE 'low' END"


@query("pair_similarity_banded", f"{_SIMILAR} SELECT cohort, a, b, similarity, round(similarity * 100)::INT AS percent, {_BAND.format('similarity * 100')} AS band FROM pair")
def pair_similarity_banded(spark, sf_dir):
    return R.pair_report(M.pairs(comparable_rows(spark, sf_dir)))


@query("match_topk", f"{_SIMILAR} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cohort, id ORDER BY similarity DESC, other)::INT AS rank FROM both_ways) WHERE rank <= 10")
def match_topk(spark, sf_dir):
    return M.matches(M.pairs(comparable_rows(spark, sf_dir)))


@query(
    "submission_scores",
    f"""{_SIMILAR}, s AS (SELECT n.cohort, n.id, round(coalesce(max(similarity), 0) * 100, 2)::DOUBLE AS score FROM norm n LEFT JOIN both_ways b ON n.cohort = b.cohort AND n.id = b.id WHERE n.status = 'analysed' GROUP BY ALL)
    SELECT *, {_BAND.format('score')} AS level FROM s""",
)
def submission_scores(spark, sf_dir):
    rows = comparable_rows(spark, sf_dir)
    return M.scores(rows, M.pairs(rows))


@query("strict_pairs", f"{_SIMILAR} SELECT * FROM pair".replace("strlen(n.normtext) >= 100", "strlen(n.normtext) > 100"))
def strict_pairs(spark, sf_dir):
    """Pairs as the class report makes them: of documents with more than the least length."""
    return M.pairs(comparable_rows(spark, sf_dir), strict=True)


_USERS = "users AS (SELECT c_custkey AS userid, 'user' || c_custkey AS username, c_name AS name FROM customer WHERE c_custkey % 3 <> 0)"


def _users(spark, sf_dir):
    """``customer`` stands in for the users; a third of them are left out, as deleted users are."""
    return read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("userid"), F.concat(F.lit("user"), F.col("c_custkey")).alias("username"), F.col("c_name").alias("name"))


@query("match_names", f"{_SIMILAR}, {_USERS}, best AS (SELECT *, row_number() OVER (PARTITION BY cohort, id ORDER BY similarity DESC, other)::INT AS rank FROM both_ways) SELECT b.cohort, b.id, other, similarity, rank, coalesce(username, '?') AS username, coalesce(name, 'Unknown') AS fullname, s.level AS other_level FROM best b JOIN subs s ON s.id = b.other LEFT JOIN users u ON u.userid = s.userid WHERE rank <= 10")
def match_names(spark, sf_dir):
    best = M.matches(M.pairs(comparable_rows(spark, sf_dir)))
    return R.named_matches(best, submissions(spark, sf_dir), _users(spark, sf_dir))


@query("pair_names", f"{_SIMILAR}, {_USERS} SELECT p.*, coalesce(x.name, 'unknownuser') AS name_a, coalesce(y.name, 'unknownuser') AS name_b FROM pair p JOIN subs s ON s.id = a JOIN subs t ON t.id = b LEFT JOIN users x ON x.userid = s.userid LEFT JOIN users y ON y.userid = t.userid")
def pair_names(spark, sf_dir):
    return R.named_pairs(M.pairs(comparable_rows(spark, sf_dir)), submissions(spark, sf_dir), _users(spark, sf_dir))


@query("cohort_floor", f"{_SIMILAR} SELECT cohort, count(DISTINCT id) AS n_compared FROM mine GROUP BY cohort")
def cohort_floor(spark, sf_dir):
    return M.own_sets(comparable_rows(spark, sf_dir)).groupBy("cohort").agg(F.countDistinct("id").alias("n_compared"))


@query(
    "raise_only_merge",
    f"""{_SIMILAR}, ev AS (SELECT id, other, similarity FROM both_ways WHERE id % 2 = 0),
    own_score AS (SELECT id, round(max(similarity) * 100, 2) AS own FROM ev GROUP BY id), raised AS (SELECT other AS id, round(max(similarity) * 100, 2) AS up FROM ev WHERE other <> id AND other > 0 GROUP BY other),
    m AS (SELECT s.id, greatest(coalesce(o.own, s.score), coalesce(r.up, 0))::DOUBLE AS score FROM subs s LEFT JOIN own_score o USING (id) LEFT JOIN raised r USING (id))
    SELECT id, score, {_BAND.format('score')} AS level FROM m""",
)
def raise_only_merge(spark, sf_dir):
    new = M.both_ways(M.pairs(comparable_rows(spark, sf_dir))).where("id % 2 = 0").select("id", "other", "similarity")
    return M.raise_only(submissions(spark, sf_dir).select("id", "score"), new)


_MARKER = "^[ \\t\\f]*((?i:question|activity|task|section|part|answer|response)\\s+|(?i:q)\\.?\\s*)([0-9]+)[\\s:.\\-)]*"
_LINES = f"""{_CTE}, flat AS (SELECT id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM subs),
  numbered AS (SELECT id, i, lines[i] AS line FROM (SELECT id, string_split(t, chr(10)) AS lines, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM flat)),
  hits AS (SELECT *, regexp_matches(line, '{_MARKER}') AND NOT regexp_matches(regexp_replace(line, '{_MARKER}', ''), '^[a-z]') AS labelled, regexp_matches(line, '^[ \\t]*[0-9]{{1,2}}[.)]\\s') AS numbered FROM numbered),
  runs AS (SELECT *, sum(labelled::INT) OVER (PARTITION BY id ORDER BY i) AS lk, sum(numbered::INT) OVER (PARTITION BY id ORDER BY i) AS nk FROM hits),
  lab AS (SELECT id, lk AS k, string_agg(line, chr(10) ORDER BY i) AS body, arg_min(line, i) AS head FROM runs WHERE lk > 0 GROUP BY ALL),
  num AS (SELECT id, nk AS k, string_agg(line, chr(10) ORDER BY i) AS body, arg_min(line, i) AS head FROM runs WHERE nk > 0 GROUP BY ALL),
  lab_ok AS (SELECT * FROM lab WHERE strlen(trim(body, ' ' || chr(9) || chr(10) || chr(13))) >= 40), num_ok AS (SELECT * FROM num WHERE strlen(trim(body, ' ' || chr(9) || chr(10) || chr(13))) >= 40),
  chosen AS (
    SELECT id, k, body, regexp_extract(head, '^[ \\t\\f]*((?i:question|q\\.?|activity|task|section|part|answer|response))\\s*([0-9]+)', 1) || ' ' || regexp_extract(head, '^[ \\t\\f]*((?i:question|q\\.?|activity|task|section|part|answer|response))\\s*([0-9]+)', 2)::INT AS label,
      regexp_extract(head, '([0-9]+)', 1)::INT AS num FROM lab_ok WHERE id IN (SELECT id FROM lab_ok GROUP BY id HAVING count(*) >= 2)
    UNION ALL
    SELECT id, k, body, 'Question ' || regexp_extract(head, '([0-9]+)', 1)::INT, regexp_extract(head, '([0-9]+)', 1)::INT FROM num_ok
      WHERE id IN (SELECT id FROM num_ok GROUP BY id HAVING count(*) >= 2) AND id NOT IN (SELECT id FROM lab_ok GROUP BY id HAVING count(*) >= 2)
    UNION ALL
    SELECT id, 1, t, 'Full Document', 0 FROM flat WHERE trim(t, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND id NOT IN (SELECT id FROM lab_ok GROUP BY id HAVING count(*) >= 2) AND id NOT IN (SELECT id FROM num_ok GROUP BY id HAVING count(*) >= 2)),
  secs AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k)::INT AS section_num, label, num, body, len({_words('body')})::BIGINT AS wordcount FROM chosen)"""


_MARKER_OF = "CASE WHEN label = 'Full Document' THEN 'whole' WHEN regexp_matches(body, '^[ \\t]*[0-9]') THEN 'numbered' ELSE 'labelled' END"


def _sections_by(spark, sf_dir, kind: str | None = None):
    """Sections of all submissions with the kind of marker that was chosen for them."""
    rows = S.section_rows(submissions(spark, sf_dir), "id")
    marker = F.when(F.col("label") == "Full Document", "whole").when(F.col("text").rlike("^[ \\t]*[0-9]"), "numbered").otherwise("labelled")
    found = rows.select("id", marker.alias("marker"), "section_num", "label", "num", F.md5("text").alias("body_md5"))
    return found.where(F.col("marker") == kind).drop("marker") if kind else found


@query("labelled_sections", f"{_LINES} SELECT id, section_num, label, num, md5(body) AS body_md5 FROM secs WHERE {_MARKER_OF} = 'labelled'")
def labelled_sections(spark, sf_dir):
    return _sections_by(spark, sf_dir, "labelled")


@query("numbered_sections", f"{_LINES} SELECT id, section_num, label, num, md5(body) AS body_md5 FROM secs WHERE {_MARKER_OF} = 'numbered'")
def numbered_sections(spark, sf_dir):
    return _sections_by(spark, sf_dir, "numbered")


@query("document_sections", f"{_LINES} SELECT id, {_MARKER_OF} AS marker, section_num, label, num, md5(body) AS body_md5 FROM secs")
def document_sections(spark, sf_dir):
    return _sections_by(spark, sf_dir)


_SECTION_PROSE = _PROSE.replace("FROM subs)", "FROM (SELECT id * 100000 + section_num AS id, NULL AS cohort, NULL AS status, body AS text FROM secs WHERE id IN (SELECT id FROM passed)))")
_GATES = f"""gates AS (SELECT id, text, strlen(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11))) < 40 AS short, CASE WHEN n = 0 THEN 1.0 ELSE l / n END AS ratio
    FROM (SELECT id, text, {_count('text', '\\p{Latin}')} AS l, {_count('text', '\\pL')} AS n FROM subs)),
  passed AS (SELECT id FROM gates WHERE NOT short AND ratio >= 0.5)"""


def _extracted(spark, sf_dir):
    """The test bed's texts as a reader gives them."""
    method, error = F.lit("docx").alias("method"), F.lit(None).cast("string").alias("error")
    return submissions(spark, sf_dir).select("id", "text", error, method, F.lit(None).cast("map<string,string>").alias("fields"))


@query(
    "section_rows",
    f"""{_LINES}, {_GATES}, {_SECTION_PROSE}, k AS (SELECT *, id // 100000 AS doc, (id % 100000)::INT AS section_num, len({_words('prose')}) AS wc FROM own)
    SELECT k.doc AS id, k.section_num, s.label, md5(s.body) AS text_md5, wc::BIGINT AS wordcount, excluded::BIGINT AS excluded_words, CASE WHEN little THEN 'mostly not own prose' ELSE concat_ws(' and ', CASE WHEN no_refs THEN 'reference list' END, CASE WHEN no_quotes THEN 'quoted material' END) END AS reason,
      CASE WHEN wc >= 8 THEN '' WHEN excluded > 0 THEN 'mostly_not_own_prose' ELSE 'insufficient_text' END AS note FROM k JOIN secs s ON s.id = k.doc AND s.section_num = k.section_num""",
)
def analysed_sections(spark, sf_dir):
    """Sections of the submissions that pass the gates, with their own prose."""
    _, rows = AN.analysed(_extracted(spark, sf_dir))
    return rows.select("id", "section_num", "label", F.md5("section_text").alias("text_md5"), F.col("wordcount").cast("long").alias("wordcount"), F.col("excluded_words").cast("long").alias("excluded_words"), F.col("excluded_reason").alias("reason"), "note")


@query("section_fallback", f"{_LINES} SELECT label = 'Full Document' AS whole, count(*) AS n_sections, count(DISTINCT id) AS n_documents FROM secs GROUP BY 1")
def section_fallback(spark, sf_dir):
    rows = S.section_rows(submissions(spark, sf_dir), "id")
    return rows.groupBy((F.col("label") == "Full Document").alias("whole")).agg(F.count("*").alias("n_sections"), F.countDistinct("id").alias("n_documents"))


@query("section_word_notes", f"{_LINES} SELECT id, section_num, wordcount, CASE WHEN wordcount < 8 THEN 'insufficient_text' END AS note FROM secs")
def section_word_notes(spark, sf_dir):
    rows = S.section_rows(submissions(spark, sf_dir), "id")
    return rows.select("id", "section_num", F.col("wordcount").cast("long").alias("wordcount"), "note")


@query("strip_references", f"{_CTE}, {_PROSE} SELECT id, md5(r) AS left_md5, r <> text AS changed FROM refs")
def strip_references(spark, sf_dir):
    rows = submissions(spark, sf_dir).select("id", "text", P.strip_references(F.col("text")).alias("r"))
    return rows.select("id", F.md5("r").alias("left_md5"), (F.col("r") != F.col("text")).alias("changed"))


@query("strip_straight_quotes", f"{_CTE}, {_PROSE} SELECT id, md5(s) AS left_md5, s <> r AS changed FROM straight")
def strip_straight_quotes(spark, sf_dir):
    rows = submissions(spark, sf_dir).select("id", P.strip_references(F.col("text")).alias("r")).withColumn("s", P.strip_straight_quotes(F.col("r")))
    return rows.select("id", F.md5("s").alias("left_md5"), (F.col("s") != F.col("r")).alias("changed"))


@query("own_prose", f"{_CTE}, {_PROSE} SELECT id, md5(prose) AS prose_md5, excluded::BIGINT AS excluded_words, CASE WHEN little THEN 'mostly not own prose' ELSE concat_ws(' and ', CASE WHEN no_refs THEN 'reference list' END, CASE WHEN no_quotes THEN 'quoted material' END) END AS reason FROM own")
def own_prose(spark, sf_dir):
    rows = P.own_prose(submissions(spark, sf_dir).select("id", "text"))
    return rows.select("id", F.md5("prose").alias("prose_md5"), F.col("excluded_words").cast("long").alias("excluded_words"), F.col("excluded_reason").alias("reason"))


def _hits(patterns: list[tuple[str, str]]) -> str:
    """Rows (id, place of the pattern, label, number of matches) for DuckDB."""
    return " UNION ALL ".join(f"SELECT id, {k} AS p, '{label}' AS label, len(regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}')) AS n FROM subs" for k, (pattern, label) in enumerate(patterns))


_ASSISTANT = f"hit AS ({_hits([(('(?im)' if p.startswith('(?m)') else '(?i)') + p.removeprefix('(?m)'), x) for p, x in FI.ASSISTANT])}), upto AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hit WHERE n > 0), taken AS (SELECT id, label, least(n, greatest(0, 12 - before)) AS n FROM upto)"


@query("assistant_findings", f"{_CTE}, {_ASSISTANT} SELECT id, label, sum(n)::BIGINT AS n FROM taken WHERE n > 0 GROUP BY ALL")
def assistant_findings(spark, sf_dir):
    rows = submissions(spark, sf_dir).select("id", F.explode(FI.assistant(F.col("text"))).alias("f"))
    return rows.groupBy("id", F.col("f.label").alias("label")).agg(F.count("*").alias("n"))


#: Italics need a look-behind, which DuckDB's matcher lacks. No match holds a star inside, so a match is what stands between
#: two neighbouring stars; of a row of neighbouring ones every other counts, as the first takes the star of the second.
_ITALIC = """star AS (SELECT id, list_transform(string_split(text, '*'), lambda x: x) AS seg FROM subs),
  inner_ AS (SELECT id, unnest(range(2, len(seg))) AS i, seg FROM star),
  italic_ok AS (SELECT id, i, seg[i] AS m, list_sum(list_transform(seg[1:i - 1], lambda x: strlen(x) + 1)) - 1 AS pos FROM inner_
    WHERE length(seg[i]) BETWEEN 2 AND 60 AND NOT contains(seg[i], chr(10))
      AND ((i = 2 AND seg[1] = '') OR regexp_matches(seg[i - 1], '[^0-9A-Za-z_]$')) AND ((i = len(seg) - 1 AND seg[i + 1] = '') OR regexp_matches(seg[i + 1], '^[^0-9A-Za-z_]'))),
  italic_run AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS run FROM italic_ok),
  italic AS (SELECT id, '*' || m || '*' AS m, pos::BIGINT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY id, run ORDER BY i) AS k FROM italic_run) WHERE k % 2 = 1)"""
_MARKDOWN = f"""{_ITALIC}, hit AS ({_hits([(p, label) for label, p in FI.MARKDOWN if label != 'markdown italic'])}
  UNION ALL SELECT id, 2, 'markdown italic', count(*) FROM italic GROUP BY id)"""


@query("markdown_findings", f"{_CTE}, {_MARKDOWN} SELECT id, label, n::BIGINT AS n FROM hit WHERE n > 0")
def markdown_findings(spark, sf_dir):
    rows = submissions(spark, sf_dir).select("id", F.explode(FI.markdown(F.col("text"))).alias("f"))
    return rows.select("id", F.col("f.label").alias("label"), F.col("f.count").cast("long").alias("n"))


_KNOWN = ", ".join(f"('{title}', [{', '.join(map(str, years))}])" for title, years, _ in FI.REGISTRY)
_LAW = f"""law AS (SELECT id, unnest(regexp_extract_all(text, '{FI.CITATION.replace("'", "''")}')) AS m FROM subs),
  cite AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(m, '\\s+(Act|Regulations?|Law)\\s+(\\(\\s*[A-Za-z]{{2,3}}\\s*\\)\\s*)?[0-9]{{4}}$', ''), '\\s+', ' ', 'g'), '(?i)^((of|the|under|in|to|by|per|with|a|an|and|see|from)\\s+)+', '')) AS short,
    regexp_replace(regexp_extract(m, '\\s(Act|Regulations?|Law)\\s+(\\(\\s*[A-Za-z]{{2,3}}\\s*\\)\\s*)?[0-9]{{4}}$', 1), '^Regulations?$', 'Regulations') AS kind, right(m, 4)::INT AS year FROM law),
  titles AS (SELECT DISTINCT id, lower(short || ' ' || kind) AS title, year FROM cite WHERE short <> ''),
  known(title, years) AS (VALUES {_KNOWN}),
  judged AS (SELECT t.id, t.title, t.year, CASE WHEN k.title IS NULL THEN 'reference_unrecognised' ELSE 'reference_wrong_year' END AS "check" FROM titles t LEFT JOIN known k ON t.title = k.title WHERE k.title IS NULL OR NOT list_contains(k.years, t.year))"""


@query("legislation_findings", f'{_CTE}, {_LAW} SELECT id, "check", count(*) AS n FROM judged GROUP BY ALL')
def legislation_findings(spark, sf_dir):
    rows = FI.legislation(submissions(spark, sf_dir).select("id", "text"), "id")
    return rows.groupBy("id", F.col("finding.check").alias("check")).agg(F.count("*").alias("n"))


def _placed(patterns: list[tuple[int, str, str]]) -> str:
    """Rows (id, p, label, k, m, at) for DuckDB: each match with its number and its offset in bytes."""
    quoted = lambda p: p.replace("'", "''")
    parts = " UNION ALL ".join(
        f"SELECT id, {k} AS p, '{label}' AS label, regexp_extract_all(text, '{quoted(p)}') AS ms, regexp_split_to_array(text, '{quoted(p)}') AS gaps FROM subs WHERE regexp_matches(text, '{quoted(p)}')" for k, p, label in patterns
    )
    return f"""(SELECT id, p, label, k, ms[k] AS m, (list_sum(list_transform(gaps[1:k], lambda x: strlen(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: strlen(x))), 0))::BIGINT AS pos
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM ({parts})))"""


_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
_ASSISTANT_AT = _placed([(k, ("(?im)" if p.startswith("(?m)") else "(?i)") + p.removeprefix("(?m)"), x) for k, (p, x) in enumerate(FI.ASSISTANT)])
_MARKDOWN_AT = _placed([(k, p, label) for k, (label, p) in enumerate(FI.MARKDOWN) if label != "markdown italic"])
_LAW_AT = _placed([(0, FI.CITATION, "law")])
#: All findings: assistant phrases up to twelve, one of each kind of Markdown, and citations, each title and year once.
_FINDINGS = f"""{_ITALIC}, phrase AS (SELECT id, 'assistant_artefact' AS "check", label, 'strong' AS severity, trim(m, {_TRIM}) AS matched, pos, NULL::BIGINT AS n FROM
    (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, k) AS rn FROM {_ASSISTANT_AT}) WHERE rn <= 12),
  mark AS (SELECT id, 'markdown_contamination' AS "check", label, 'notable' AS severity, trim(arg_min(m, k), {_TRIM}) AS matched, arg_min(pos, k) AS pos, count(*) AS n FROM
    (SELECT id, label, k, m, pos FROM {_MARKDOWN_AT} UNION ALL SELECT id, 'markdown italic', pos, m, pos FROM italic) GROUP BY id, label),
  cited AS (SELECT id, k AS place, pos, m, trim(regexp_replace(regexp_replace(regexp_replace(m, '\\s+(Act|Regulations?|Law)\\s+(\\(\\s*[A-Za-z]{{2,3}}\\s*\\)\\s*)?[0-9]{{4}}$', ''), '\\s+', ' ', 'g'), '(?i)^((of|the|under|in|to|by|per|with|a|an|and|see|from)\\s+)+', '')) AS short,
    regexp_replace(regexp_extract(m, '\\s(Act|Regulations?|Law)\\s+(\\(\\s*[A-Za-z]{{2,3}}\\s*\\)\\s*)?[0-9]{{4}}$', 1), '^Regulations?$', 'Regulations') AS kind, right(m, 4)::INT AS year FROM {_LAW_AT}),
  titled AS (SELECT id, lower(short || ' ' || kind) AS title, year, min(place) AS place, arg_min(pos, place) AS pos, trim(arg_min(m, place), {_TRIM}) AS matched FROM cited WHERE short <> '' GROUP BY 1, 2, 3),
  known(title, years) AS (VALUES {', '.join(f"('{t}', [{', '.join(map(str, y))}])" for t, y, _ in FI.REGISTRY)}),
  law AS (SELECT t.id, t.place, CASE WHEN k.title IS NULL THEN 'reference_unrecognised' ELSE 'reference_wrong_year' END AS "check", CASE WHEN k.title IS NULL THEN 'not in the recognised list' ELSE 'real Act, year does not exist' END AS label,
    CASE WHEN k.title IS NULL THEN 'notable' ELSE 'strong' END AS severity, matched, pos, NULL::BIGINT AS n FROM titled t LEFT JOIN known k ON t.title = k.title WHERE k.title IS NULL OR NOT list_contains(k.years, t.year)),
  every AS (SELECT * FROM phrase UNION ALL SELECT * FROM mark UNION ALL SELECT id, "check", label, severity, matched, pos, n FROM law)"""
_TALLY = "SELECT id, count(*) FILTER (severity = 'strong') AS n_strong, count(*) FILTER (severity = 'notable') AS n_notable, count(*) FILTER (severity = 'context') AS n_context FROM every GROUP BY id"


@query("findings_tally", f"{_CTE}, {_FINDINGS}, t AS ({_TALLY}) SELECT s.id, coalesce(n_strong, 0)::BIGINT AS n_strong, coalesce(n_notable, 0)::BIGINT AS n_notable, coalesce(n_context, 0)::BIGINT AS n_context FROM subs s LEFT JOIN t USING (id)")
def findings_tally(spark, sf_dir):
    rows = FI.text_findings(submissions(spark, sf_dir).select("id", "text"), "id")
    return rows.select("id", *FI.tally(F.col("findings")))


@query("findings_sorted", f"""{_CTE}, {_FINDINGS} SELECT id, (row_number() OVER (PARTITION BY id ORDER BY CASE severity WHEN 'strong' THEN 0 WHEN 'notable' THEN 1 ELSE 2 END, pos, "check", label, matched) - 1)::INT AS place, "check", label, severity, matched, pos::INT AS "offset", n::INT AS "count" FROM every""")
def findings_sorted(spark, sf_dir):
    """Every finding with its place in the list, its matched text and its offset in bytes."""
    rows = FI.text_findings(submissions(spark, sf_dir).select("id", "text"), "id")
    # The inner form adds a filter on the list, which makes it a second time.
    flat = rows.select("id", F.posexplode_outer("findings").alias("place", "f")).where("place IS NOT NULL")
    return flat.select("id", "place", "f.check", "f.label", "f.severity", "f.matched", "f.offset", "f.count")


@query("findings_evidence")
def findings_evidence(spark, sf_dir):
    """The quoted evidence of every finding (byte windows are not SQL; tests hold them against brute force)."""
    rows = FI.text_findings(submissions(spark, sf_dir).select("id", "text"), "id")
    flat = rows.select("id", "text", F.posexplode("findings").alias("place", "f"))
    return flat.select("id", "place", FI.evidence("text", "f.offset").alias("evidence"))


@query(
    "analysed_submissions",
    f"""{_LINES}, {_GATES}, {_PROSE}, {_FINDINGS}, t AS ({_TALLY}), n AS (SELECT id, count(*) AS n_sections FROM secs GROUP BY id)
    SELECT g.id, CASE WHEN short OR ratio < 0.5 OR n_sections IS NULL THEN 'error' ELSE 'analysed' END AS status, CASE WHEN short THEN '{AN.SHORT}' WHEN ratio < 0.5 THEN '{AN.SCRIPT}' WHEN n_sections IS NULL THEN '{AN.NO_SECTIONS}' END AS errormsg, 0.0::DOUBLE AS score, 'low' AS level,
      CASE WHEN short THEN NULL WHEN ratio < 0.5 THEN md5(left({_norm('g.text')}, 65000)) ELSE md5(left({_norm('prose')}, 65000)) END AS normtext_md5,
      CASE WHEN NOT short AND ratio >= 0.5 THEN n_sections END::BIGINT AS n_sections, CASE WHEN NOT short AND ratio >= 0.5 THEN strlen(g.text) END::BIGINT AS n_bytes, CASE WHEN NOT short AND ratio >= 0.5 THEN coalesce(n_strong, 0) END::BIGINT AS n_strong,
      CASE WHEN NOT short AND ratio >= 0.5 THEN coalesce(n_notable, 0) END::BIGINT AS n_notable, CASE WHEN NOT short AND ratio >= 0.5 THEN 3 END::INT AS score_model, CASE WHEN NOT short AND ratio < 0.5 THEN round(ratio, 3) END::DOUBLE AS latin_ratio
    FROM gates g JOIN own USING (id) LEFT JOIN t USING (id) LEFT JOIN n USING (id)""",
)
def analysed_submissions(spark, sf_dir):
    """The whole analysis of every submission; what its JSON holds is read back from it."""
    rows, _ = AN.analysed(_extracted(spark, sf_dir))
    get = lambda path, kind: F.get_json_object("analysisjson", f"$.{path}").cast(kind)
    return rows.select(
        "id", "status", "errormsg", "score", "level", F.md5("normtext").alias("normtext_md5"), get("section_count", "long").alias("n_sections"), get("extraction_chars", "long").alias("n_bytes"),
        get("authenticity.tally.n_strong", "long").alias("n_strong"), get("authenticity.tally.n_notable", "long").alias("n_notable"), get("score_model", "int").alias("score_model"), get("latin_letter_ratio", "double").alias("latin_ratio"),
    )


_TERMS = "[" + ", ".join(f"'{t}'" for t in FI.TERMS) + "]"


@query("verification_terms", f"{_CTE} SELECT id, array_to_string(list_filter({_TERMS}, lambda p: contains(lower(text), p))[1:2], ',') AS terms FROM subs")
def verification_terms(spark, sf_dir):
    return submissions(spark, sf_dir).select("id", F.array_join(FI.known_terms(F.col("text")), ",").alias("terms"))


_EDGE_A, _EDGE_B = "(^|[^\\pL\\pN_])", "($|[^\\pL\\pN_])"
_BARE = lambda p: p.removeprefix("(?i)").removeprefix("\\b").removesuffix("\\b").replace("'", "''")
#: The longest fitting sentence of each text; after the white space is collapsed a sentence ends at its mark and one space.
_SENTENCE = f"""flat_text AS (SELECT id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM subs),
  sentences AS (SELECT id, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT id, string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM flat_text)),
  fitting AS (SELECT * FROM sentences WHERE len(regexp_extract_all(s, '[A-Za-z''](?:[A-Za-z''-]*[A-Za-z''])?')) BETWEEN 18 AND 60
    AND regexp_matches(s, '(?i){_EDGE_A}{_BARE(FI.FIRST_PERSON)}{_EDGE_B}') AND NOT regexp_matches(s, '{_EDGE_A}[A-Z]{{3,}}{_EDGE_B}') AND NOT regexp_matches(s, '(?i){_EDGE_A}{_BARE(FI.FORM)}{_EDGE_B}')),
  longest AS (SELECT u.id, coalesce((SELECT f.s FROM fitting f WHERE f.id = u.id ORDER BY strlen(f.s) DESC, f.i LIMIT 1), '') AS sentence FROM subs u)"""


@query("longest_sentence", f"{_CTE}, {_SENTENCE} SELECT id, sentence FROM longest")
def longest_sentence(spark, sf_dir):
    return submissions(spark, sf_dir).select("id", FI.longest_sentence(F.col("text")).alias("sentence"))


_ASKED = f"""{_SENTENCE}, first_law AS (SELECT id, arg_min(matched, place) AS cited FROM law GROUP BY id),
  known_terms AS (SELECT id, list_filter({_TERMS}, lambda p: contains(lower(text), p))[1:2] AS terms FROM subs),
  asked AS (SELECT s.id, terms, cited, sentence, len(terms) = 0 AND cited IS NULL AND regexp_matches(text, '{_EDGE_A}(?:Act|Regulations?|Standard|Code of Practice)\\s+\\d{{4}}{_EDGE_B}') AS legal
    FROM subs s JOIN known_terms USING (id) JOIN longest USING (id) LEFT JOIN first_law USING (id)),
  listed AS (SELECT id, list_concat(list_transform(terms, lambda p: {{'question': 'Please explain the term ' || p || ' in your own words, with an example from your own work.', 'basis': 'term used in the submission'}}),
    CASE WHEN cited IS NULL THEN [] ELSE [{{'question': 'Where did you find the requirement of ' || cited || ', and what does it ask for?', 'basis': 'reference cited in the submission'}}] END,
    CASE WHEN legal THEN [{{'question': 'Which source did you use for the legal requirement?', 'basis': 'legal requirement referred to'}}] ELSE [] END,
    CASE WHEN sentence = '' THEN [] ELSE [{{'question': 'What did you mean by this sentence, and why does it matter: ' || sentence, 'basis': 'sentence taken from the submission'}}] END,
    [{{'question': 'How did you go about this work: what did you read, draft first, and who helped?', 'basis': 'general'}}])[1:4] AS q FROM asked)"""


@query("verification_questions", f"{_CTE}, {_FINDINGS}, {_ASKED} SELECT id, (i - 1)::INT AS place, q[i].question AS question, q[i].basis AS basis FROM (SELECT id, q, unnest(range(1, len(q) + 1)) AS i FROM listed)")
def verification_questions(spark, sf_dir):
    rows = FI.questions(submissions(spark, sf_dir).select("id", "text"), "id")
    return rows.select("id", F.posexplode("questions").alias("place", "q")).select("id", "place", "q.question", "q.basis")


_FIELDS = """CASE WHEN id % 5 = 0 THEN '3' WHEN id % 5 = 1 THEN '94' END AS editing_minutes, CASE WHEN id % 3 = 0 THEN '1' ELSE '7' END AS revision,
  CASE WHEN id % 2 = 0 THEN '2024-03-01T10:00:00Z' END AS created, CASE WHEN id % 4 = 0 THEN '2024-03-01T10:00:30Z' ELSE '2024-03-01T10:02:00Z' END AS modified,
  'A. Writer' AS creator, CASE WHEN id % 7 = 0 THEN 'B. Writer' ELSE 'A. Writer' END AS last_modified_by, CASE WHEN id % 11 = 0 THEN 'Skia/PDF m120' ELSE 'Writer' END AS producer, (id * 13) % 900 AS words"""


@query(
    "provenance_rules",
    f"""{_CTE}, f AS (SELECT id, {_FIELDS} FROM subs)
    SELECT id, concat_ws(',', CASE WHEN words >= 200 AND editing_minutes IS NOT NULL AND editing_minutes::INT < words / 60 THEN 'short editing time' END,
      CASE WHEN words >= 200 AND revision = '1' THEN 'single save' END,
      CASE WHEN words >= 200 AND epoch(modified::TIMESTAMP) - epoch(created::TIMESTAMP) BETWEEN 0 AND 119 THEN 'lifespan under two minutes' END,
      CASE WHEN creator <> last_modified_by THEN 'different names' END, CASE WHEN lower(producer) LIKE 'skia%' THEN 'produced by a browser engine' END) AS labels FROM f""",
)
def provenance_rules(spark, sf_dir):
    names = ("editing_minutes", "revision", "created", "modified", "creator", "last_modified_by", "producer")
    rows = submissions(spark, sf_dir).selectExpr("id", *[x.strip() for x in _split_fields()])
    fields = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names)), lambda _, v: v.isNotNull())
    return rows.select("id", F.array_join(PV.labels(fields, F.col("words")), ",").alias("labels"))


def _split_fields() -> list[str]:
    from textquarry.plans.testbed import _split

    return _split(_FIELDS)


@query("stat_cards", f"{_CTE} SELECT cohort, count(*) AS n, {', '.join(f'''count(*) FILTER (status = '{s}') AS n_{s}''' for s in ('analysed', 'pending', 'error', 'unsupported'))}, {', '.join(f'''count(*) FILTER (status = 'analysed' AND level = '{s}') AS n_{s}''' for s in ('low', 'medium', 'high'))} FROM subs GROUP BY cohort")
def stat_cards(spark, sf_dir):
    return R.stat_cards(submissions(spark, sf_dir))


@query("legacy_scores", f"{_CTE} SELECT cohort, count(*) AS n_legacy FROM subs WHERE status = 'analysed' AND coalesce(json_extract_string(analysisjson, '$.score_model')::INT, 1) < 3 GROUP BY cohort")
def legacy_scores(spark, sf_dir):
    return L.legacy(submissions(spark, sf_dir)).groupBy("cohort").agg(F.count("*").alias("n_legacy"))


@query("class_report", f"{_CTE} SELECT s.cohort, s.id, coalesce(c.c_name, '#' || s.userid) AS name, s.status, floor(score)::INT AS percent, level, timemodified FROM subs s LEFT JOIN customer c ON c.c_custkey = s.userid AND c.c_custkey % 3 <> 0 WHERE status <> 'unsupported'")
def class_report(spark, sf_dir):
    """``customer`` stands in for the users; a third of them are left out, as deleted users are."""
    users = read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("userid"), F.col("c_name").alias("name"))
    return R.class_report(submissions(spark, sf_dir), users)


@query(
    "badge_view",
    f"""{_CTE} SELECT id, CASE WHEN status = 'analysed' THEN floor(score)::INT || '% ' || level WHEN status = 'pending' AND timemodified <= {NOW} - 600 THEN 'stuck' WHEN status = 'pending' THEN 'waiting'
      WHEN status = 'error' THEN 'error: ' || left(errormsg, 120) END AS badge FROM subs WHERE status <> 'unsupported'""",
)
def badge_view(spark, sf_dir):
    return L.badge(submissions(spark, sf_dir), NOW)


@query("pending_queue", f"{_CTE} SELECT id, timecreated FROM subs WHERE status = 'pending' AND timecreated < {NOW} - 300 ORDER BY timecreated, id LIMIT 15")
def pending_queue(spark, sf_dir):
    return L.pending(submissions(spark, sf_dir), NOW).select("id", "timecreated")


@query("scan_batch", f"{_CTE} SELECT id, status FROM subs WHERE id > 40 ORDER BY id LIMIT 20")
def scan_batch(spark, sf_dir):
    return L.scan_batch(submissions(spark, sf_dir), 40).select("id", "status")


def _files(spark, sf_dir):
    """Orders stand in for stored files: a customer is a user, a ship priority class an activity."""
    orders = read(spark, sf_dir, "orders")
    return orders.select(
        (F.col("o_custkey") % 500).alias("userid"), F.col("o_orderpriority").alias("cohort"), F.sha1((F.col("o_orderkey") % 4000).cast("string")).alias("contenthash"),
        F.concat(F.lit("file"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 9 == 0, ".xyz").when(F.col("o_orderkey") % 9 == 1, ".PDF").otherwise(".docx")).alias("filename"),
        F.unix_timestamp("o_orderdate").alias("timemodified"),
    ).withColumn("supported", _supported())


def _supported():
    from textquarry.sources.files import supported

    return supported(F.col("filename"), F.lit(None).cast("string"))


_FILES = """files AS (SELECT *, NOT ends_with(filename, '.xyz') AS supported FROM (SELECT o_custkey % 500 AS userid, o_orderpriority AS cohort, sha1((o_orderkey % 4000)::VARCHAR) AS contenthash,
  'file' || o_orderkey || CASE WHEN o_orderkey % 9 = 0 THEN '.xyz' WHEN o_orderkey % 9 = 1 THEN '.PDF' ELSE '.docx' END AS filename, epoch(o_orderdate)::BIGINT AS timemodified FROM orders)),
  tracked AS (SELECT userid, cohort, contenthash FROM files WHERE userid % 2 = 0)"""


@query("mark_pending", f"WITH {_FILES} SELECT DISTINCT userid, cohort, contenthash, 'pending' AS status, {NOW}::BIGINT AS timecreated FROM files f WHERE supported AND NOT EXISTS (SELECT 1 FROM tracked t WHERE t.userid = f.userid AND t.cohort = f.cohort AND t.contenthash = f.contenthash)")
def mark_pending(spark, sf_dir):
    files = _files(spark, sf_dir)
    return L.mark_pending(files, files.where("userid % 2 = 0"), NOW)


@query(
    "backfill_candidates",
    f"""WITH {_FILES}, attempts AS (SELECT DISTINCT cohort, userid FROM files WHERE userid > 0 AND userid % 3 = 0)
    SELECT f.userid, f.cohort, f.contenthash, f.filename FROM files f JOIN attempts a ON a.userid = f.userid AND a.cohort = f.cohort
    WHERE f.cohort <> '5-LOW' AND f.timemodified < {NOW} - 3600 AND NOT EXISTS (SELECT 1 FROM tracked t WHERE t.userid = f.userid AND t.cohort = f.cohort AND t.contenthash = f.contenthash)""",
)
def backfill_candidates(spark, sf_dir):
    files = _files(spark, sf_dir)
    activities = files.select("cohort").distinct().withColumn("enabled", F.col("cohort") != "5-LOW")
    attempts = files.where("userid % 3 = 0").select("cohort", "userid").distinct().withColumn("status", F.lit("submitted"))
    return L.backfill(files, activities, attempts, files.where("userid % 2 = 0"), NOW).select("userid", "cohort", "contenthash", "filename")


_CANDIDATES = f"""numbered AS (SELECT o_custkey % 500 AS userid, o_orderpriority AS cohort, sha1((o_orderkey % 4000)::VARCHAR) AS contenthash, o_orderkey AS fileid, o_orderkey % 9 <> 0 AS supported, epoch(o_orderdate)::BIGINT AS timemodified, o_custkey AS submissionid FROM orders),
  tracked2 AS (SELECT DISTINCT userid, cohort, contenthash FROM numbered WHERE userid % 2 = 0),
  candidates AS (SELECT n.* FROM numbered n WHERE userid > 0 AND userid % 3 = 0 AND cohort <> '5-LOW' AND timemodified < {NOW} - 3600 AND NOT EXISTS (SELECT 1 FROM tracked2 t WHERE t.userid = n.userid AND t.cohort = n.cohort AND t.contenthash = n.contenthash))"""


def _numbered(spark, sf_dir):
    files = read(spark, sf_dir, "orders")
    return files.select(
        (F.col("o_custkey") % 500).alias("userid"), F.col("o_orderpriority").alias("cohort"), F.sha1((F.col("o_orderkey") % 4000).cast("string")).alias("contenthash"),
        F.col("o_orderkey").alias("fileid"), (F.col("o_orderkey") % 9 != 0).alias("supported"), F.unix_timestamp("o_orderdate").alias("timemodified"), F.col("o_custkey").alias("submissionid"),
    )


def _candidates(spark, sf_dir):
    files = _numbered(spark, sf_dir)
    activities = files.select("cohort").distinct().withColumn("enabled", F.col("cohort") != "5-LOW")
    attempts = files.where("userid % 3 = 0").select("cohort", "userid").distinct().withColumn("status", F.lit("submitted"))
    return L.backfill(files, activities, attempts, files.where("userid % 2 = 0"), NOW)


@query("backfill_queue", f"WITH {_CANDIDATES} SELECT fileid, timemodified FROM candidates ORDER BY timemodified, fileid LIMIT 50")
def backfill_queue(spark, sf_dir):
    return L.backfill_queue(_candidates(spark, sf_dir), 10).select("fileid", "timemodified")


@query(
    "process_pending",
    f"""{_CTE}, {_CANDIDATES}, one AS (SELECT id FROM subs WHERE status = 'pending' AND timecreated < {NOW} - 300 ORDER BY timecreated, id LIMIT 9),
  left_ AS (SELECT 15 - count(*) AS n FROM one), queue AS (SELECT *, row_number() OVER (ORDER BY timemodified, fileid) AS k FROM candidates),
  used AS (SELECT *, coalesce(sum(supported::INT) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM queue WHERE k <= 5 * (SELECT n FROM left_))
  SELECT 1 AS phase, id, NULL::BIGINT AS fileid, 'analyse' AS action FROM one UNION ALL
  SELECT 2, NULL, fileid, CASE WHEN supported THEN 'analyse' ELSE 'marker' END FROM used WHERE u < (SELECT n FROM left_)""",
)
def process_pending(spark, sf_dir):
    """The queue is cut to nine rows, so that both phases have something to do."""
    few = L.pending(submissions(spark, sf_dir), NOW).limit(9)
    return L.process_pending(few, _candidates(spark, sf_dir), NOW)


@query("scan_activity", f"WITH {_CANDIDATES}, open_ AS (SELECT n.* FROM numbered n WHERE cohort = '1-URGENT' AND supported AND NOT EXISTS (SELECT 1 FROM tracked2 t WHERE t.userid = n.userid AND t.cohort = n.cohort AND t.contenthash = n.contenthash)) SELECT least(count(*), 20)::BIGINT AS n_taken, count(*) > 20 AS deferred FROM open_")
def scan_activity(spark, sf_dir):
    files = _numbered(spark, sf_dir)
    return L.scan_step(files.where("cohort = '1-URGENT'"), files.where("userid % 2 = 0"))[1]


@query("supported_counts", f"WITH {_CANDIDATES} SELECT cohort, userid, count(*) FILTER (supported) AS n_supported FROM numbered GROUP BY ALL")
def supported_counts(spark, sf_dir):
    return L.supported_counts(_numbered(spark, sf_dir))


@query("content_hash_lookup", "SELECT CASE WHEN o_orderkey % 4000 = 7 THEN '' ELSE sha1((o_orderkey % 4000)::VARCHAR) END AS contenthash, max(o_orderkey) AS id FROM orders WHERE o_orderkey % 4000 <> 7 AND o_orderkey % 5 <> 0 GROUP BY 1")
def content_hash_lookup(spark, sf_dir):
    files = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4000 == 7, "").otherwise(F.sha1((F.col("o_orderkey") % 4000).cast("string"))).alias("contenthash"), F.when(F.col("o_orderkey") % 5 == 0, ".").otherwise("file").alias("filename"))
    return L.newest_files(files)


@query("backup_eligible", "SELECT n_nationkey AS cohort FROM nation WHERE n_regionkey = 2")
def backup_eligible(spark, sf_dir):
    activities = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cohort"), F.when(F.col("n_regionkey") == 2, "assign").otherwise("quiz").alias("modname"))
    return L.in_backup(activities).select("cohort")


@query("unsupported_markers", f"WITH {_FILES} SELECT userid, cohort, contenthash, left(filename, 512) AS filename, 'unsupported' AS status FROM files WHERE NOT supported")
def unsupported_markers(spark, sf_dir):
    return L.unsupported_markers(_files(spark, sf_dir))


@query("file_types", f"WITH {_FILES} SELECT CASE WHEN ends_with(filename, '.xyz') THEN 'unsupported' WHEN ends_with(filename, '.PDF') THEN 'pdf' ELSE 'docx' END AS filetype, count(*) AS n FROM files GROUP BY 1")
def file_types(spark, sf_dir):
    from textquarry.sources.files import file_type

    return _files(spark, sf_dir).groupBy(file_type(F.col("filename"), F.lit(None).cast("string")).alias("filetype")).agg(F.count("*").alias("n"))


@query("latest_duplicate", f"{_CTE} SELECT userid, cohort, contenthash, id FROM (SELECT *, row_number() OVER (PARTITION BY userid % 10, cohort, contenthash ORDER BY timemodified DESC, id DESC) AS n FROM subs) WHERE n = 1")
def latest_duplicate(spark, sf_dir):
    rows = submissions(spark, sf_dir).withColumn("person", F.col("userid")).withColumn("userid", F.col("userid") % 10)
    return L.latest_duplicate(rows).select(F.col("person").alias("userid"), "cohort", "contenthash", "id")


@query("latest_attempt", "SELECT conv_id AS cohort, userid, turn AS attemptnumber FROM (SELECT conv_id, role AS userid, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1")
def latest_attempt(spark, sf_dir):
    """Turns of a conversation stand in for attempts."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("cohort"), F.col("role").alias("userid"), F.col("turn").alias("attemptnumber"), F.lit(0).alias("id"))
    return L.latest_attempt(rows).select("cohort", "userid", "attemptnumber")


@query("retention_prune", f"{_CTE} SELECT cohort, count(*) AS n, count(CASE WHEN NOT timecreated < {NOW} - 90 * 86400 THEN text END) AS n_text, round(sum(score), 2)::DOUBLE AS total FROM subs GROUP BY cohort")
def retention_prune(spark, sf_dir):
    rows = L.prune(submissions(spark, sf_dir), ["text"], NOW)
    return rows.groupBy("cohort").agg(F.count("*").alias("n"), F.count("text").alias("n_text"), F.round(F.sum("score"), 2).alias("total"))


@query("section_prune", f"{_LINES} SELECT s.id AS subid, section_num, CASE WHEN u.timecreated < {NOW} - 90 * 86400 THEN NULL ELSE md5(body) END AS text_md5 FROM secs s JOIN subs u ON u.id = s.id")
def section_prune(spark, sf_dir):
    subs = submissions(spark, sf_dir)
    secs = S.section_rows(subs, "id").select(F.col("id").alias("subid"), "section_num", F.col("text").alias("section_text"))
    return L.prune_sections(secs, subs, NOW).select("subid", "section_num", F.md5("section_text").alias("text_md5"))


@query("prune_counters", f"{_LINES}, old AS (SELECT id FROM subs WHERE timecreated < {NOW} - 90 * 86400) SELECT (SELECT count(*) FROM old JOIN subs USING (id) WHERE text IS NOT NULL) AS n_submissions, (SELECT count(*) FROM secs WHERE id IN (SELECT id FROM old)) AS n_sections")
def prune_counters(spark, sf_dir):
    subs = submissions(spark, sf_dir)
    secs = S.section_rows(subs, "id").select(F.col("id").alias("subid"), F.col("text").alias("section_text"))
    return L.prune_counts(subs.withColumn("normtext", F.col("text")), secs, NOW)


@query("reanalysed_sections", f"{_LINES} SELECT u.cohort, count(*) AS n_sections FROM secs s JOIN subs u USING (id) WHERE u.cohort <> 'src1' GROUP BY 1")
def reanalysed_sections(spark, sf_dir):
    """The sections that stay when one activity is analysed again."""
    subs = submissions(spark, sf_dir)
    secs = S.section_rows(subs, "id").select(F.col("id").alias("subid"), "section_num")
    _, left = L.reanalysed(subs, secs, F.col("cohort") == "src1")
    return left.join(subs.select(F.col("id").alias("subid"), "cohort"), "subid").groupBy("cohort").agg(F.count("*").alias("n_sections"))


@query("orphan_purge", "SELECT o_orderkey AS id FROM orders WHERE o_custkey % 1000 = 0 OR o_custkey % 1000 IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def orphan_purge(spark, sf_dir):
    """Orders stand in for rows, customers of some nations for activities that still exist."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 1000).alias("cohort"))
    activities = read(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("cohort"))
    return L.without_orphans(rows, activities).select("id")


@query("activity_deleted", f"{_CTE} SELECT cohort, count(*) AS n FROM subs WHERE cohort <> 'src3' GROUP BY cohort")
def activity_deleted(spark, sf_dir):
    return L.without_activity(submissions(spark, sf_dir), "src3").groupBy("cohort").agg(F.count("*").alias("n"))


@query("model_retraction", f"""{_CTE} SELECT id, CASE WHEN r THEN 'pending' ELSE status END AS status, CASE WHEN r THEN 0.0::DOUBLE ELSE score END AS score, CASE WHEN r THEN 'low' ELSE level END AS level
  FROM (SELECT *, status = 'analysed' AND coalesce(analysisjson LIKE '%"score_model":2%', false) AS r FROM subs)""")
def model_retraction(spark, sf_dir):
    return L.retract_model_two(submissions(spark, sf_dir)).select("id", "status", "score", "level")


@query("reanalyse_reset", f"{_CTE} SELECT status, count(*) AS n, round(sum(score), 2)::DOUBLE AS total FROM (SELECT CASE WHEN cohort = 'src1' THEN 'pending' ELSE status END AS status, CASE WHEN cohort = 'src1' THEN 0 ELSE score END AS score FROM subs) GROUP BY status")
def reanalyse_reset(spark, sf_dir):
    rows = L.reset(submissions(spark, sf_dir), F.col("cohort") == "src1")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"))


@query("legacy_marker_delete", f"{_CTE} SELECT status, count(*) AS n FROM subs WHERE NOT (status = 'unsupported' AND id % 2 = 0) GROUP BY status")
def legacy_marker_delete(spark, sf_dir):
    rows = submissions(spark, sf_dir).withColumn("contenthash", F.when(F.col("id") % 2 == 0, "").otherwise(F.col("contenthash")))
    return L.without_legacy_markers(rows).groupBy("status").agg(F.count("*").alias("n"))


@query("privacy_contexts", f"{_CTE} SELECT DISTINCT cohort FROM subs WHERE userid = 7 UNION SELECT DISTINCT cohort FROM subs WHERE (userid + 1) % 997 = 7")
def privacy_contexts(spark, sf_dir):
    subs = submissions(spark, sf_dir).select("cohort", "userid")
    return L.privacy_contexts(subs, subs.withColumn("userid", (F.col("userid") + 1) % 997), 7)


@query("privacy_users", f"{_CTE} SELECT DISTINCT userid FROM subs WHERE cohort = 'src2' UNION SELECT DISTINCT (userid + 1) % 997 FROM subs WHERE cohort = 'src2'")
def privacy_users(spark, sf_dir):
    subs = submissions(spark, sf_dir).select("cohort", "userid")
    return L.privacy_users(subs, subs.withColumn("userid", (F.col("userid") + 1) % 997), "src2")


@query(
    "privacy_export",
    f"""{_LINES}, parts AS (SELECT id, string_agg('{{"section_num":' || section_num || ',"label":' || to_json(label) || ',"wordcount":' || wordcount || '}}', ',' ORDER BY section_num) AS p FROM secs GROUP BY id)
    SELECT s.id, '{{"id":' || s.id || ',"cohort":' || to_json(s.cohort) || ',"status":' || to_json(s.status) || ',"score":' || s.score || ',"sections":[' || coalesce(p, '') || ']}}' AS json FROM subs s LEFT JOIN parts p ON p.id = s.id WHERE userid = 7""",
)
def privacy_export(spark, sf_dir):
    subs = submissions(spark, sf_dir)
    secs = S.section_rows(subs, "id").withColumnRenamed("id", "subid")
    return L.privacy_export(subs, secs, 7)


@query("privacy_erase", f"{_CTE} SELECT cohort, count(*) AS n FROM subs WHERE NOT (userid = 7) AND NOT (userid = 8 AND cohort IN ('src8')) GROUP BY cohort")
def privacy_erase(spark, sf_dir):
    rows = L.erase_user(L.erase_user(submissions(spark, sf_dir), 7), 8, ["src8"])
    return rows.groupBy("cohort").agg(F.count("*").alias("n"))


@query(
    "group_visibility",
    f"""{_CTE}, members AS (SELECT DISTINCT cohort, userid, userid % 4 AS g FROM subs)
    SELECT id FROM subs s WHERE userid = 21 OR EXISTS (SELECT 1 FROM members a JOIN members b ON a.cohort = b.cohort AND a.g = b.g AND b.userid = 21 WHERE a.cohort = s.cohort AND a.userid = s.userid)""",
)
def group_visibility(spark, sf_dir):
    subs = submissions(spark, sf_dir).select("id", "cohort", "userid")
    members = subs.select("cohort", "userid", (F.col("userid") % 4).alias("groupid")).distinct()
    return L.visible(subs, members, 21).select("id")


@query(
    "visibility_arms",
    f"""{_CTE}, members AS (SELECT DISTINCT cohort, userid, userid % 4 AS g FROM subs)
    SELECT id FROM subs s WHERE userid = 21 OR s.cohort NOT IN ('src1', 'src2', 'src3') OR s.cohort = 'src3' OR EXISTS (SELECT 1 FROM members a JOIN members b ON a.cohort = b.cohort AND a.g = b.g AND b.userid = 21 WHERE a.cohort = s.cohort AND a.userid = s.userid)""",
)
def visibility_arms(spark, sf_dir):
    """Three activities have separate groups; in one of them the viewer may see all."""
    subs = submissions(spark, sf_dir).select("id", "cohort", "userid")
    members = subs.select("cohort", "userid", (F.col("userid") % 4).alias("groupid")).distinct()
    named = lambda *names: spark.createDataFrame([(n,) for n in names], "cohort string")
    return L.visible(subs, members, 21, named("src1", "src2", "src3"), named("src3")).select("id")


@query("report_permission", "SELECT c_custkey AS userid FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0")
def report_permission(spark, sf_dir):
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("userid"))
    roles = users.where("userid % 3 = 0").withColumn("permission", F.lit(1)).union(users.where("userid % 5 = 0").withColumn("permission", F.lit(-1000)))
    return L.may_report(users, roles)


_ACTIVITY = "n_nationkey AS cohort, CASE WHEN n_nationkey % 3 = 0 THEN true WHEN n_nationkey % 3 = 1 THEN false END AS explicit, n_regionkey < 3 AS supported"


@query("enabled_activities", f"SELECT cohort, coalesce(explicit, supported) AS enabled FROM (SELECT {_ACTIVITY} FROM nation)")
def enabled_activities(spark, sf_dir):
    from textquarry.plans.testbed import _split

    return L.enabled(read(spark, sf_dir, "nation").selectExpr(*_split(_ACTIVITY)), True, True).select("cohort", "enabled")


@query("restored_flags", "SELECT (n_nationkey + 1000)::BIGINT AS cohort, n_nationkey % 2 = 0 AS enabled FROM nation WHERE n_regionkey <> 1")
def restored_flags(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    flags = nation.select(F.col("n_nationkey").alias("cohort"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))
    ids = nation.where("n_regionkey <> 1").select(F.col("n_nationkey").alias("old"), (F.col("n_nationkey") + 1000).cast("long").alias("new"))
    return L.remapped(flags, ids)


@query("display_text", """SELECT page_id, left(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')), 600) AS preview FROM pages""")
def display_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", R.display_text(F.col("html")).alias("preview"))


@query("score_bands", f"SELECT o_orderkey AS id, round(least(greatest(o_totalprice / 400000, 0), 1) * 100, 2)::DOUBLE AS score, {_BAND.format('round(least(greatest(o_totalprice / 400000, 0), 1) * 100, 2)')} AS level FROM orders")
def score_bands(spark, sf_dir):
    score = T.submission_score(F.col("o_totalprice") / 400000)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), score.alias("score"), T.band(score).alias("level"))


@query("submission_events", "SELECT time_bucket(INTERVAL 1 day, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def submission_events(spark, sf_dir):
    return ST.events_per_window(read(spark, sf_dir, "events"))


@query("docx_extract")
def docx_extract(spark, sf_dir):
    """Documents packed as .docx files and read again through the extractor."""
    from textquarry.plans.made_files import as_docx
    from textquarry.sources.files import extract

    return extract(as_docx(submissions(spark, sf_dir).select("id", "text"))).select("path", "method", "text", "error")


@query("pdf_extract")
def pdf_extract(spark, sf_dir):
    """Documents set as simple .pdf files and read again through the extractor."""
    from textquarry.plans.made_files import as_pdf
    from textquarry.sources.files import extract

    return extract(as_pdf(submissions(spark, sf_dir).select("id", "text"))).select("path", "method", "text", "error")


@query(
    "stream_scores",
    f"""{_CTE}, arrival AS (SELECT *, row_number() OVER (PARTITION BY userid, cohort, contenthash ORDER BY timecreated, id) AS k FROM subs),
  kept AS (
    SELECT id, userid, cohort, contenthash, k, timecreated AS last_kept, true AS keep FROM arrival WHERE k = 1
    UNION ALL
    SELECT a.id, a.userid, a.cohort, a.contenthash, a.k, CASE WHEN a.timecreated - p.last_kept >= 86400 THEN a.timecreated ELSE p.last_kept END, a.timecreated - p.last_kept >= 86400
    FROM arrival a JOIN kept p ON a.userid = p.userid AND a.cohort IS NOT DISTINCT FROM p.cohort AND a.contenthash = p.contenthash AND a.k = p.k + 1),
  firsts AS (SELECT * FROM subs WHERE id IN (SELECT id FROM kept WHERE keep)), {_SIMILAR.removeprefix(_CTE + ", ").replace("FROM subs", "FROM firsts")}
    SELECT f.id, round(coalesce(max(similarity), 0) * 100, 2)::DOUBLE AS score, {_BAND.format('round(coalesce(max(similarity), 0) * 100, 2)')} AS level FROM firsts f LEFT JOIN both_ways b ON b.id = f.id GROUP BY f.id""".replace("WITH ", "WITH RECURSIVE ", 1),
)
def stream_scores(spark, sf_dir):
    """All submissions through the streaming path, in two files; the merged scores."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="textquarry-stream-")
    root = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows = P.normal_text(submissions(spark, sf_dir)).select("cohort", "id", "userid", "contenthash", "normtext", "status", F.timestamp_seconds("timecreated").alias("ts"))
    rows.repartition(2, "cohort").write.parquet(f"{root}/in")
    ST.start(ST.source(spark, f"{root}/in"), f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return ST.current_scores(spark, f"{root}/state")
