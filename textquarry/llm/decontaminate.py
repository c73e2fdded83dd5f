"""Benchmark decontamination (operator 7) by template canonicalisation, in DataFrame functions only.

Words lose the punctuation around them and their case; numbers, names and units become typed placeholders. Windows of
``WINDOW`` such words of every text are hashed and joined with those of the benchmark. An item with fewer words is one
window of its own length, however short. A window of placeholders alone is no evidence and is not compared.

Slots of all windows that a text and an item share are then compared together. An item's value must stand for one
value of the text wherever it stands, and a value of the text for one of the item's: of several, the pair that stands in
most of the item's windows counts, then the one that is the item's own value, then the greatest. Windows with another
pair are left out, save those equal word for word. So a question asked again with other numbers or names is found, also
where the text changes only one of them, and parts that contradict each other do not add up. A document is contaminated
by an item if the windows left cover at least ``COVERAGE`` of the item's words.

The first pass over the texts makes nothing but the hashes of their windows; the words of those few documents with a hit
are then read again, and hits are compared word for word, so hashes decide nothing. The benchmark's windows are broadcast
if there are at most ``SENT_WINDOWS``, the ids of documents with a hit if at most ``SENT_IDS``; beyond, both sides are
shuffled.

Cases: null or empty texts and items match nothing; rows with the same doc_id are judged together, each window in its own
text; rows of the benchmark with the same item_id are one item, whose words are counted over all of them; rows without
doc_id or item_id are kept out of matching, the former come out clean; an empty benchmark leaves everything clean. A text of
any length is one row of work. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm.common import table, written

WINDOW, COVERAGE = 5, 0.6
SENT_WINDOWS, SENT_IDS = 100_000, 500_000
#: Words that are slots.
NUMBERS = "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg lb lbs pound pounds ounce ounces ton tons second seconds sec minute minutes min hour hours hr hrs day days week weeks"
    " month months year years l ml liter liters litre litres gallon gallons meter meters metre metres kilometer kilometers kilogram kilograms gram grams dollar dollars cent cents euro euros"
    " usd eur percent degree degrees celsius fahrenheit watt watts volt volts joule joules newton newtons mph kmh"
).split()
NAMES = (
    "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen daniel matthew anthony"
    " mark paul steven andrew peter anna emma laura maria julia sophie alice bob carol dave eve tom tim sam jack jill kate jane kevin brian george edward henry lucy ben amy"
    " lisa nina oscar leo max mia noah olivia liam ethan sophia ava isabella ryan jason eric adam"
).split()
_WS = r" \t-\r"
_PUNCTUATION = rf"[^\p{{L}}\p{{N}}{_WS}]"
SLOTS = ("<num>", "<name>", "<unit>")


def words(docs: DataFrame, *keys: str) -> DataFrame:
    """The keys, ``raw`` (words without outer punctuation, lower case) and ``canon`` (with placeholders), aligned."""
    lower = F.lower(F.coalesce("text", F.lit("")))
    # Both patterns first look at the next character, as most begin no match.
    bare = F.regexp_replace(lower, rf"(?![a-z0-9 ])(?={_PUNCTUATION})(?:(?<!{_PUNCTUATION}){_PUNCTUATION}++(?![^{_WS}])|(?<![^{_WS}]){_PUNCTUATION}++)", "")
    numbered = lambda s: F.regexp_replace(s, rf"(?=[0-9])(?<![^{_WS}])[0-9]++(?:[.,:/-][0-9]++)*+(?![^{_WS}])", SLOTS[0])
    split = lambda s: F.split(F.btrim(s, F.lit(" \t\n\x0b\f\r")), f"[{_WS}]+")
    typed = lambda w: F.when(~w.isin(*NUMBERS, *NAMES, *UNITS), w).when(w.isin(*NUMBERS), SLOTS[0]).when(w.isin(*NAMES), SLOTS[1]).otherwise(SLOTS[2])
    # Not by ``bare``, which has the same letters and digits: the optimiser would make it once more for the filter.
    found = docs.where(lower.rlike(r"[\p{L}\p{N}]")).select(*keys, bare.alias("bare"))
    return found.select(*keys, split(F.col("bare")).alias("raw"), F.transform(split(numbered(F.col("bare"))), typed).alias("canon"))


def hashes(found: DataFrame, widths: list[int], *keys: str) -> DataFrame:
    """The keys, ``width``, ``pos`` (from 1) and ``hash`` of every window of each width."""

    n = F.size("canon")

    def listed(width: int) -> Column:
        window = lambda i: F.struct(F.lit(width).alias("width"), i.alias("pos"), F.xxhash64(F.slice("canon", i, width)).alias("hash"))
        return F.when(n >= width, F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), window))

    every = listed(widths[0]) if len(widths) == 1 else F.flatten(F.filter(F.array(*map(listed, widths)), F.isnotnull))
    # The outer form: for the inner one the optimiser would filter by the list's size and so build every list twice.
    return found.select(*keys, F.inline_outer(every)).where("hash IS NOT NULL")


def _plain(window: Column) -> Column:
    return F.exists(window, lambda w: ~w.isin(*SLOTS))


def _best(of: str, value: str) -> Column:
    """The place of a pair among those of one value: most windows first, then the item's own value, then the greatest."""
    return F.row_number().over(Window.partitionBy("doc_id", "item_id", of).orderBy(F.desc("n"), F.desc(F.col("asked") == F.col("given")), F.desc(value)))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, covered, changed) of every document and item that share consistent windows."""
    spark = docs.sparkSession
    # ``part`` tells rows of one item from each other.
    items = words(benchmark.where("item_id IS NOT NULL").select("item_id", "text", F.xxhash64("text").alias("part")).dropDuplicates(), "item_id", "part").withColumn("n_words", F.size("canon"))
    items = written(items, "benchmark-words")
    # At most WINDOW widths, mostly one.
    widths = sorted(r[0] for r in items.select(F.least("n_words", F.lit(WINDOW)).alias("w")).distinct().collect())
    if not widths:
        return spark.createDataFrame([], "doc_id long, item_id long, n_words long, covered long, changed boolean")
    own = items.withColumn("width", F.least("n_words", F.lit(WINDOW)))
    asked = own.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("width") + 1)))
    piece = lambda c, at: F.slice(c, at, F.col("width"))
    asked = asked.select("item_id", "part", "width", "at", piece("raw", F.col("at")).alias("asked"), piece("canon", F.col("at")).alias("canon")).where(_plain(F.col("canon")))
    asked = written(asked.withColumn("hash", F.xxhash64("canon")), "benchmark-windows")
    known = asked.select("width", "hash").distinct()
    known = F.broadcast(known) if known.count() <= SENT_WINDOWS else known

    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("row"))
    hits = hashes(words(texts, "doc_id", "row"), widths, "doc_id", "row").join(known, ["width", "hash"], "left_semi")
    hits = written(hits.distinct(), "window-hits")
    wanted = hits.select("doc_id", "row").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted
    again = words(texts.join(wanted, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"]), "doc_id", "row")
    places = hits.groupBy("doc_id", "row").agg(F.collect_list(F.struct("width", "pos", "hash")).alias("places"))
    given = again.join(places, ["doc_id", "row"]).select("doc_id", F.explode(F.transform("places", lambda p: F.struct(p["width"].alias("width"), p["hash"].alias("hash"), F.slice("raw", p["pos"], p["width"]).alias("given"), F.slice("canon", p["pos"], p["width"]).alias("canon")))).alias("w")).select("doc_id", "w.*").distinct()
    met = given.join(asked, ["width", "hash", "canon"]).select("doc_id", "item_id", "part", "at", "width", "asked", "given", "canon")
    met = written(met.distinct(), "windows-met")

    slot = met.where("asked <> given").select("doc_id", "item_id").distinct().join(met, ["doc_id", "item_id"])
    pairs = slot.select("doc_id", "item_id", "part", "at", F.explode(F.filter(F.arrays_zip("asked", "given", "canon"), lambda p: p["canon"].isin(*SLOTS))).alias("p"))
    counted = pairs.select("doc_id", "item_id", "part", "at", "p.asked", "p.given").distinct().groupBy("doc_id", "item_id", "asked", "given").agg(F.count("*").alias("n"))
    usual = counted.withColumn("k", _best("asked", "given")).where("k = 1").withColumn("k", _best("given", "asked")).where("k = 1")
    usual = usual.groupBy("doc_id", "item_id").agg(F.map_from_entries(F.collect_list(F.struct("asked", "given"))).alias("usual"))
    judged = met.join(usual, ["doc_id", "item_id"], "left")
    fits = F.forall(F.arrays_zip("asked", "given", "canon"), lambda p: ~p["canon"].isin(*SLOTS) | F.coalesce(F.col("usual")[p["asked"]] == p["given"], F.lit(False)))
    sound = judged.where((F.col("asked") == F.col("given")) | fits)
    covered = sound.select("doc_id", "item_id", "part", (F.col("asked") != F.col("given")).alias("changed"), F.explode(F.sequence(F.col("at"), F.col("at") + F.col("width") - 1)).alias("place"))
    covered = covered.groupBy("doc_id", "item_id", "part", "place").agg(F.bool_or("changed").alias("changed")).groupBy("doc_id", "item_id").agg(F.count("*").alias("covered"), F.bool_or("changed").alias("changed"))
    lengths = items.groupBy("item_id").agg(F.sum("n_words").alias("n_words"))
    return covered.join(lengths, "item_id").select("doc_id", "item_id", "n_words", "covered", "changed")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_items, items, reparameterised) of the contaminated documents; items: ascending ids joined by commas."""
    hits = matches(docs, benchmark).where(F.col("covered") >= COVERAGE * F.col("n_words"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda i: i.cast("string")), ",")
    return hits.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), ids.alias("items"), F.bool_or("changed").alias("reparameterised"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id").join(contaminated(docs, table(spark, sf_dir, "benchmark")), "doc_id", "left")
    return found.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.lit("")).alias("items"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go."""
    return docs.join(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def _sql_list(words_: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words_)


SQL = rf"""
WITH texts AS (
  SELECT DISTINCT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 'b', item_id, text FROM benchmark),
raw AS (
  SELECT side, id, hash(text) AS part, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'),
    lambda w: regexp_replace(w, '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g')), lambda w: w <> '') AS raw FROM texts WHERE id IS NOT NULL),
canon AS (
  SELECT side, id, part, len(raw) AS n, raw, list_transform(raw, lambda w: CASE
    WHEN regexp_full_match(w, '[0-9]+([.,:/-][0-9]+)*') OR w IN ({_sql_list(NUMBERS)}) THEN '<num>'
    WHEN w IN ({_sql_list(NAMES)}) THEN '<name>' WHEN w IN ({_sql_list(UNITS)}) THEN '<unit>' ELSE w END) AS canon FROM raw WHERE len(raw) > 0),
lengths AS (SELECT id AS item_id, sum(n) AS n FROM canon WHERE side = 'b' GROUP BY id),
widths AS (SELECT DISTINCT least(n, {WINDOW}) AS w FROM canon WHERE side = 'b'),
placed AS (
  SELECT side, id, part, n, w, i AS pos, array_to_string(canon[i:i + w - 1], ' ') AS key, raw[i:i + w - 1] AS raw, canon[i:i + w - 1] AS canon
  FROM (SELECT *, unnest(range(1, n - w + 2)) AS i FROM canon, widths WHERE n >= w AND (side = 'd' OR w = least(n, {WINDOW})))),
met AS (
  SELECT DISTINCT d.id AS doc_id, b.id AS item_id, b.part, b.pos AS place, b.w, b.raw AS asked, d.raw AS given, b.canon
  FROM placed d JOIN placed b ON d.side = 'd' AND b.side = 'b' AND d.key = b.key AND d.w = b.w
  WHERE len(list_filter(b.canon, lambda c: c NOT IN ('<num>', '<name>', '<unit>'))) > 0),
numbered AS (SELECT *, row_number() OVER () AS m FROM met),
slots AS (
  SELECT doc_id, item_id, part, place, m, asked[k] AS asked, given[k] AS given
  FROM (SELECT *, unnest(range(1, w + 1)) AS k FROM numbered) WHERE canon[k] IN ('<num>', '<name>', '<unit>')),
counted AS (SELECT doc_id, item_id, asked, given, count(DISTINCT (part, place)) AS n FROM slots GROUP BY ALL),
one_way AS (
  SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, asked ORDER BY n DESC, asked = given DESC, given DESC) = 1),
usual AS (
  SELECT * FROM one_way QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, given ORDER BY n DESC, asked = given DESC, asked DESC) = 1),
odd AS (
  SELECT DISTINCT m FROM slots s WHERE NOT EXISTS (
    SELECT 1 FROM usual u WHERE u.doc_id = s.doc_id AND u.item_id = s.item_id AND u.asked = s.asked AND u.given = s.given)),
sound AS (SELECT * FROM numbered WHERE asked = given OR m NOT IN (SELECT m FROM odd)),
cover AS (
  SELECT doc_id, item_id, count(DISTINCT (part, place + k)) AS covered, bool_or(asked <> given) AS changed
  FROM (SELECT *, unnest(range(0, w)) AS k FROM sound) GROUP BY doc_id, item_id),
hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, bool_or(changed) AS reparameterised
  FROM cover JOIN lengths USING (item_id) WHERE covered >= {COVERAGE} * n GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, '') AS items,
       coalesce(reparameterised, false) AS reparameterised
FROM documents LEFT JOIN hit USING (doc_id)
"""
