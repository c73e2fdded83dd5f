"""The life of a submission: queue, backfill, duplicates, retention, orphans, retraction and privacy.

Every function takes tables and an explicit ``now`` (epoch seconds) and returns a table; nothing reads a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.config import DEFAULT, Thresholds
from textquarry.plans.tables import written

DAY = 86_400


def pending(subs: DataFrame, now: int, t: Thresholds = DEFAULT) -> DataFrame:
    """The oldest fifteen rows pending for more than the grace time; exactly 300 seconds still wait."""
    ready = subs.where((F.col("status") == "pending") & (F.col("timecreated") < now - t.grace_seconds))
    return ready.orderBy("timecreated", "id").limit(t.pending_batch)


def scan_batch(subs: DataFrame, after: int, t: Thresholds = DEFAULT) -> DataFrame:
    """The next twenty rows of an activity's scan after an id."""
    return subs.where(F.col("id") > after).orderBy("id").limit(t.scan_batch)


def mark_pending(files: DataFrame, subs: DataFrame, now: int) -> DataFrame:
    """New pending rows (userid, cohort, contenthash): supported files that are not tracked yet, one each."""
    fresh = files.where("supported").dropDuplicates(["userid", "cohort", "contenthash"]).join(subs.select("userid", "cohort", "contenthash"), ["userid", "cohort", "contenthash"], "left_anti")
    return fresh.select("userid", "cohort", "contenthash", F.lit("pending").alias("status"), F.lit(now).cast("long").alias("timecreated"))


def supported_counts(files: DataFrame) -> DataFrame:
    """(cohort, userid, n_supported): readable files, tracked ones too; without any no analysis is queued."""
    return files.groupBy("cohort", "userid").agg(F.count_if("supported").alias("n_supported"))


def newest_files(files: DataFrame) -> DataFrame:
    """(contenthash, id): the newest stored file of each content, directories (".") and empty hashes left out."""
    return files.where("contenthash <> '' AND filename <> '.'").groupBy("contenthash").agg(F.max("id").alias("id"))


def in_backup(activities: DataFrame) -> DataFrame:
    """Activities of a kind (modname) that is analysed, and so goes into a backup."""
    return activities.where(F.col("modname").isin("assign"))


def backfill(files: DataFrame, activities: DataFrame, latest: DataFrame, subs: DataFrame, now: int, t: Thresholds = DEFAULT) -> DataFrame:
    """Files of submitted latest attempts in enabled activities that no row tracks, once they are an hour old."""
    rows = files.join(activities.where("enabled").select("cohort"), "cohort").join(latest.where("status = 'submitted' AND userid > 0").select("cohort", "userid"), ["cohort", "userid"])
    untracked = rows.join(subs.select("cohort", "userid", "contenthash"), ["cohort", "userid", "contenthash"], "left_anti")
    return untracked.where(F.col("timemodified") < now - t.backfill_grace_seconds)


def backfill_queue(candidates: DataFrame, remaining: int, t: Thresholds = DEFAULT) -> DataFrame:
    """The oldest candidates, five times as many as may still be analysed, as some of them can't be read."""
    return candidates.orderBy("timemodified", "fileid").limit(max(0, remaining) * t.head_room)


def process_pending(subs: DataFrame, candidates: DataFrame, now: int, with_backfill: bool = True, t: Thresholds = DEFAULT) -> DataFrame:
    """One run of the queue: (phase, id, fileid, action). Both phases share one budget of fifteen.

    First pending rows are analysed, then, with what is left, untracked files; those that can't be read get a marker and
    cost nothing of the budget, but only as far as the last file that is analysed.
    """
    first = written(pending(subs, now, t).select(F.lit(1).alias("phase"), "id", F.lit(None).cast("long").alias("fileid"), F.lit("analyse").alias("action")), "phase-one")
    remaining = t.pending_batch - first.count()
    if not with_backfill or remaining <= 0:
        return first
    queue = backfill_queue(candidates, remaining, t)
    # At most five times fifteen rows are left here, so one window over all of them is small.
    before = Window.orderBy("timemodified", "fileid").rowsBetween(Window.unboundedPreceding, -1)
    taken = queue.withColumn("used", F.coalesce(F.sum(F.col("supported").cast("int")).over(before), F.lit(0))).where(F.col("used") < remaining)
    return first.union(taken.select(F.lit(2), F.lit(None).cast("long"), "fileid", F.when(F.col("supported"), "analyse").otherwise("marker")))


def scan_step(files: DataFrame, subs: DataFrame, t: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """One pass over an activity: the next twenty readable, untracked files, and (n_taken, deferred): whether another pass is due."""
    untracked = files.where("supported").join(subs.select("cohort", "userid", "contenthash"), ["cohort", "userid", "contenthash"], "left_anti")
    listed = untracked.orderBy("submissionid", F.desc("timemodified"), "fileid").limit(t.scan_batch + 1)
    order = Window.orderBy("submissionid", F.desc("timemodified"), "fileid")
    step = written(listed.withColumn("place", F.row_number().over(order)), "scan-step")
    return step.where(F.col("place") <= t.scan_batch), step.agg(F.count_if(F.col("place") <= t.scan_batch).alias("n_taken"), F.coalesce(F.max("place") > t.scan_batch, F.lit(False)).alias("deferred"))


def unsupported_markers(files: DataFrame) -> DataFrame:
    """Rows that record a file that can't be read, with its name cut to 512 characters."""
    return files.where("NOT supported").select("userid", "cohort", "contenthash", F.substring("filename", 1, 512).alias("filename"), F.lit("unsupported").alias("status"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_duplicate(subs: DataFrame) -> DataFrame:
    """Of rows with the same user, activity and content the newest, then the highest id."""
    return latest(subs, ["userid", "cohort", "contenthash"], [F.desc("timemodified"), F.desc("id")])


def latest_attempt(attempts: DataFrame) -> DataFrame:
    return latest(attempts, ["cohort", "userid"], [F.desc("attemptnumber"), F.desc("id")])


def prune(subs: DataFrame, columns: list[str], now: int, days: int = DEFAULT.retention_days) -> DataFrame:
    """Texts older than the retention time become null; scores stay. No days or fewer: nothing is pruned."""
    if days <= 0:
        return subs
    old = F.col("timecreated") < now - days * DAY
    return subs.withColumns({c: F.when(~old, F.col(c)) for c in columns})


def prune_sections(secs: DataFrame, subs: DataFrame, now: int, days: int = DEFAULT.retention_days) -> DataFrame:
    """Section texts of submissions older than the retention time become null; a section's age is that of its submission."""
    if days <= 0:
        return secs
    old = subs.where(F.col("timecreated") < now - days * DAY).select(F.col("id").alias("subid")).distinct().withColumn("_old", F.lit(True))
    return secs.join(old, "subid", "left").withColumn("section_text", F.when(F.col("_old").isNull(), F.col("section_text"))).select(*secs.columns)


def prune_counts(subs: DataFrame, secs: DataFrame, now: int, days: int = DEFAULT.retention_days) -> DataFrame:
    """(n_submissions, n_sections) whose text a prune would clear."""
    old = subs.where(F.col("timecreated") < now - days * DAY)
    count = lambda table, *names: table.agg(*[(F.count("*") if n else F.lit(0).cast("long")).alias(k) for k, n in names])
    rows = count(old.where("normtext IS NOT NULL"), ("n_submissions", 1), ("n_sections", 0))
    sections = count(secs.where("section_text IS NOT NULL").join(old.select(F.col("id").alias("subid")), "subid", "left_semi"), ("n_submissions", 0), ("n_sections", 1))
    return rows.union(sections).agg(F.sum("n_submissions").alias("n_submissions"), F.sum("n_sections").alias("n_sections"))


def without_orphans(rows: DataFrame, activities: DataFrame) -> DataFrame:
    """Rows whose activity still exists, and rows of no activity (0)."""
    kept = rows.where("cohort <> 0").join(activities.select("cohort"), "cohort", "left_semi")
    return kept.select(*rows.columns).union(rows.where("cohort = 0"))


def orphans(rows: DataFrame, activities: DataFrame) -> DataFrame:
    return rows.where("cohort > 0").join(activities.select("cohort"), "cohort", "left_anti")


def without_activity(rows: DataFrame, cohort: int) -> DataFrame:
    return rows.where(F.col("cohort") != cohort)


def reset(subs: DataFrame, chosen: Column) -> DataFrame:
    """Chosen rows go back to pending with no score; the time of their creation stays."""
    return subs.withColumns({"status": F.when(chosen, "pending").otherwise(F.col("status")), "score": F.when(chosen, 0.0).otherwise(F.col("score")), "level": F.when(chosen, "low").otherwise(F.col("level"))})


def reanalysed(subs: DataFrame, secs: DataFrame, chosen: Column) -> tuple[DataFrame, DataFrame]:
    """Chosen rows reset, and the sections that stay: those of the other rows. The next run analyses the former again."""
    ids = subs.where(chosen).select(F.col("id").alias("subid"))
    return reset(subs, chosen), secs.join(ids, "subid", "left_anti")


def model_of(json: Column) -> Column:
    return F.coalesce(F.get_json_object(json, "$.score_model").cast("int"), F.lit(1))


def retract_model_two(subs: DataFrame) -> DataFrame:
    return reset(subs, (F.col("status") == "analysed") & F.coalesce(F.col("analysisjson").ilike('%"score_model":2%'), F.lit(False)))


def legacy(subs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Analysed rows whose score stems from an older model."""
    return subs.where((F.col("status") == "analysed") & (model_of(F.col("analysisjson")) < t.score_model))


def without_legacy_markers(subs: DataFrame) -> DataFrame:
    return subs.where(~((F.col("status") == "unsupported") & (F.coalesce("contenthash", F.lit("")) == "")))


def visible(rows: DataFrame, members: DataFrame, viewer: int, separate: DataFrame | None = None, access_all: DataFrame | None = None) -> DataFrame:
    """Rows of the viewer, and of users in one of the viewer's groups of the same activity.

    ``separate`` lists the activities (cohort) with separate groups; in all others every row is seen (without the table all
    have separate groups). ``access_all`` lists the activities in which the viewer may see all groups.
    """
    mine = members.where(F.col("userid") == viewer).select("cohort", "groupid")
    shared = members.join(mine, ["cohort", "groupid"], "left_semi").select("cohort", "userid").distinct().withColumn("_shared", F.lit(True))
    mark = lambda table, name: table.select("cohort").distinct().withColumn(name, F.lit(True))
    seen = (F.col("userid") == viewer) | F.col("_shared").isNotNull()
    out = rows.join(shared, ["cohort", "userid"], "left")
    if separate is not None:
        out, seen = out.join(mark(separate, "_separate"), "cohort", "left"), seen | F.col("_separate").isNull()
    if access_all is not None:
        out, seen = out.join(mark(access_all, "_all"), "cohort", "left"), seen | F.col("_all").isNotNull()
    return out.where(seen).select(*rows.columns)


def may_report(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with a role that allows reports and none that prohibits them (permission 1 and -1000)."""
    return users.join(roles.where("permission = 1"), "userid", "left_semi").join(roles.where("permission = -1000"), "userid", "left_anti")


def enabled(activities: DataFrame, site: bool, default: bool) -> DataFrame:
    """Activities that are switched on: the site is, and their own value decides, or else the default for supported kinds."""
    own = F.coalesce(F.col("explicit"), F.lit(default) & F.col("supported"))
    return activities.withColumn("enabled", F.lit(site) & own)


def remapped(flags: DataFrame, ids: DataFrame) -> DataFrame:
    """Restored per-activity flags under new ids (old, new)."""
    return flags.join(ids, flags.cohort == ids.old).select(F.col("new").alias("cohort"), "enabled")


def privacy_contexts(subs: DataFrame, secs: DataFrame, userid: int) -> DataFrame:
    """Activities with data of a user, from either table, each once."""
    return subs.where(F.col("userid") == userid).select("cohort").union(secs.where(F.col("userid") == userid).select("cohort")).distinct()


def privacy_users(subs: DataFrame, secs: DataFrame, cohort: object) -> DataFrame:
    return subs.where(F.col("cohort") == cohort).select("userid").union(secs.where(F.col("cohort") == cohort).select("userid")).distinct()


def privacy_export(subs: DataFrame, secs: DataFrame, userid: int) -> DataFrame:
    """One JSON document a submission of a user, with its sections in order."""
    listed = secs.groupBy("subid").agg(F.array_sort(F.collect_list(F.struct("section_num", "label", "wordcount"))).alias("sections"))
    rows = subs.where(F.col("userid") == userid).join(listed, subs.id == listed.subid, "left")
    return rows.select("id", F.to_json(F.struct("id", "cohort", "status", "score", F.coalesce("sections", F.array().cast("array<struct<section_num:int,label:string,wordcount:int>>")).alias("sections"))).alias("json"))


def erase_user(rows: DataFrame, userid: int, cohorts: list | None = None) -> DataFrame:
    """Rows that stay when a user's data go, in all activities or in some."""
    gone = (F.col("userid") == userid) & (F.lit(True) if cohorts is None else F.col("cohort").isin(cohorts))
    return rows.where(~gone)


def badge(subs: DataFrame, now: int) -> DataFrame:
    """(id, badge) for every row but unsupported ones: a percentage cut to whole, waiting, stuck after ten minutes, or the error."""
    shown = (
        F.when(F.col("status") == "analysed", F.concat(F.floor("score").cast("string"), F.lit("% "), F.col("level")))
        .when((F.col("status") == "pending") & (F.col("timemodified") <= now - 600), "stuck")
        .when(F.col("status") == "pending", "waiting")
        .when(F.col("status") == "error", F.concat(F.lit("error: "), F.substring(F.coalesce("errormsg", F.lit("")), 1, 120)))
    )
    return subs.where("status <> 'unsupported'").select("id", shown.alias("badge"))
