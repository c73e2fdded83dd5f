"""Incremental scoring on Structured Streaming.

Submissions arrive as files, in any order of their times; a repeat of (user, cohort, content) less than a day from a
stored one is dropped, and nothing else. Each micro-batch's rows are compared with each other and with what is stored of
their cohorts; stored rows are not compared with each other again. Scores merge by the raise-only rule.

State lies in two folders of Parquet versions under the batch's number, so a repeated batch writes the same version again.
A version holds only what its batch brought: new submissions, and new or changed scores, of which the one of the highest
number holds. Disk grows with the submissions, not with the number of batches times the state. After ``MERGED`` versions
all but the last are written as one, and replaced only when that is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textquarry.config import DEFAULT, Thresholds
from textquarry.operators.similarity import both_ways, pairs, raise_only

SCHEMA = "cohort string, id long, userid long, contenthash string, normtext string, status string, ts timestamp"
KEY = ("userid", "cohort", "contenthash")
#: In microseconds.
DAY = 86_400_000_000
#: Versions from which they are merged.
MERGED = 64
_SCORES = "id long, score double, level string"


def source(spark: SparkSession, folder: str, per_batch: int = 20) -> DataFrame:
    """New submissions in ``folder`` as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(folder)


def without_repeats(batch: DataFrame, held: DataFrame) -> DataFrame:
    """The rows of a batch, by time and id, that lie a day or more from each stored or earlier row of the same key.

    Rows without a time repeat nothing.
    """
    micros = lambda ts: F.unix_micros(ts)
    stored = held.where("ts IS NOT NULL").select(*[F.col(k).alias(f"held_{k}") for k in KEY], micros(F.col("ts")).alias("at"))
    stored = stored.groupBy(*[f"held_{k}" for k in KEY]).agg(F.collect_list("at").alias("stored"))
    # The columns that order rows stand first.
    order = ["ts", "id", *[c for c in batch.columns if c not in ("ts", "id")]]
    grouped = batch.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("rows"))
    same = [grouped[k].eqNullSafe(stored[f"held_{k}"]) for k in KEY]
    both = grouped.join(stored, same[0] & same[1] & same[2], "left").select("rows", F.coalesce("stored", F.array().cast("array<bigint>")).alias("stored"))

    def add(acc: Column, row: Column) -> Column:
        at = micros(row["ts"])
        near = F.coalesce(F.exists(acc["at"], lambda a: F.abs(a - at) < DAY), F.lit(False))
        longer = F.when(at.isNull(), acc["at"]).otherwise(F.concat(acc["at"], F.array(at)))
        return F.when(near, acc).otherwise(F.struct(longer.alias("at"), F.concat(acc["out"], F.array(row)).alias("out")))

    kept = F.aggregate("rows", F.struct(F.col("stored").alias("at"), F.slice("rows", 1, 0).alias("out")), add, lambda acc: acc["out"])
    return both.select(F.explode(kept).alias("r")).select(*[F.col("r")[c].alias(c) for c in batch.columns])


def _folder(spark: SparkSession, root: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str, below: int) -> list[int]:
    """Numbers of the complete versions below a batch's, as of the last merged one."""
    at, fs = _folder(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    numbers = sorted(n for n in (int(x[2:]) for x in names if x.startswith("v=")) if n < below)
    merged = max((n for n in numbers if fs.exists(path(f"{root}/v={n}/_MERGED"))), default=-1)
    return [n for n in numbers if n >= merged]


def stored(spark: SparkSession, root: str, below: int, schema: str) -> DataFrame:
    """All rows of the versions below a batch's number, with that of their version (``v``)."""
    numbers = _versions(spark, root, below)
    if not numbers:
        return spark.createDataFrame([], f"{schema}, v long")
    return spark.read.option("basePath", root).schema(f"{schema}, v long").parquet(*[f"{root}/v={n}" for n in numbers])


def _newest(scores: DataFrame) -> DataFrame:
    return scores.groupBy("id").agg(F.max_by(F.struct("score", "level"), "v").alias("s")).select("id", "s.score", "s.level")


def _merge(spark: SparkSession, root: str, below: int, schema: str, newest: bool) -> None:
    """Write many versions as one, under the highest of their numbers but the last; then delete them."""
    numbers = _versions(spark, root, below)[:-1]
    if len(numbers) < MERGED:
        return
    every = stored(spark, root, numbers[-1] + 1, schema)
    whole = _newest(every) if newest else every.drop("v")
    at, fs = _folder(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    whole.write.mode("overwrite").parquet(f"{root}/merging")
    fs.create(path(f"{root}/merging/_MERGED")).close()
    # The merged version lies beside the old ones until it stands in the last one's place.
    fs.rename(path(f"{root}/v={numbers[-1]}"), path(f"{root}/replaced"))
    fs.rename(path(f"{root}/merging"), path(f"{root}/v={numbers[-1]}"))
    for old in (f"{root}/replaced", *[f"{root}/v={n}" for n in numbers[:-1]]):
        fs.delete(path(old), True)


def merge_batch(spark: SparkSession, batch: DataFrame, number: int, state: str, t: Thresholds = DEFAULT) -> None:
    """Add a batch to the stored submissions and merge what it shows into the stored scores."""
    held = stored(spark, f"{state}/submissions", number, SCHEMA).select(*batch.columns)
    # Several steps read the batch; it is written once, as the version of the submissions, and read from there.
    without_repeats(batch, held).write.mode("overwrite").parquet(f"{state}/submissions/v={number}")
    batch = spark.read.schema(SCHEMA).parquet(f"{state}/submissions/v={number}")
    if batch.isEmpty():
        batch.select("id", F.lit(0.0).alias("score"), F.lit("low").alias("level")).write.mode("overwrite").parquet(f"{state}/scores/v={number}")
        return
    scores = _newest(stored(spark, f"{state}/scores", number, _SCORES))
    cohort = held.join(batch.select("cohort").distinct(), "cohort", "left_semi").select(*batch.columns).union(batch)
    new = batch.select("id").distinct()
    evidence = both_ways(pairs(cohort, t, new=new)).join(new, "id", "left_semi").select("id", "other", "similarity")
    met = evidence.select(F.col("other").alias("id")).union(new).distinct()
    start = scores.select("id", "score").join(met, "id", "left_semi").union(new.join(scores.select("id"), "id", "left_anti").select("id", F.lit(0.0)))
    raise_only(start, evidence, t).write.mode("overwrite").parquet(f"{state}/scores/v={number}")
    _merge(spark, f"{state}/submissions", number, SCHEMA, False)
    _merge(spark, f"{state}/scores", number, _SCORES, True)


def start(rows: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there and stop; call again for what came since."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: merge_batch(batch.sparkSession, batch, number, state)).start()


def current_scores(spark: SparkSession, state: str) -> DataFrame:
    return _newest(stored(spark, f"{state}/scores", 2**62, _SCORES))


def events_per_window(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Submission events a window and type, for batch and streaming tables (ts, event_type)."""
    return events.withWatermark("ts", "1 day").groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
