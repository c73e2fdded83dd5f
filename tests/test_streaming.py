import datetime as dt
import random

from textquarry.streaming import scores as ST

NOON = dt.datetime(2024, 6, 1, 12)


def test_old_rows_are_kept_and_only_repeats_dropped(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(80))
    texts = [text() for _ in range(8)]
    row = lambda k, days, user, n: ("c", k, user, f"h{n}", texts[n], "analysed", NOON + dt.timedelta(days=days))
    files = [
        [row(1, 0, 1, 0), row(2, 0, 2, 1), row(3, 1, 3, 2)],
        # Much older than what came before; 6 and 7 repeat 1 on the day and days later, 5 is another user's.
        [row(4, -200, 4, 3), row(5, -100, 5, 0), row(6, 0.5, 1, 0), row(7, 3, 1, 0)],
        [row(8, -230, 8, 4), row(9, -0.9, 2, 1), row(10, -229.5, 8, 4), row(11, -150, 11, 5)],
        [("c", 12, 12, "h3", texts[3], "analysed", None), ("c", 13, None, "h7", texts[7], "analysed", NOON)],
        [("c", 14, None, "h7", texts[7], "analysed", NOON)],
    ]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, ST.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        made = next((tmp_path / "in" / str(k)).glob("*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        made.rename(tmp_path / "all" / f"{k}.parquet")
        # Each file comes as a run of its own.
        ST.start(ST.source(spark, f"{tmp_path}/all", 1), f"{tmp_path}/state", f"{tmp_path}/checkpoint").awaitTermination()
    want = {1, 2, 3, 4, 5, 7, 8, 11, 12, 13}
    assert sorted(r.id for r in ST.stored(spark, f"{tmp_path}/state/submissions", 2**62, ST.SCHEMA).collect()) == sorted(want)
    found = {r.id: r.score for r in ST.current_scores(spark, f"{tmp_path}/state").collect()}
    assert set(found) == want and found[12] == found[4] == 100.0


def test_batches_equal_all_pairs_and_versions_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "MERGED", 2)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(60)]
    rows = []
    for k in range(24):
        text = " ".join((base[:40] if k in (0, 3, 5, 12, 15, 16, 17) else []) + [word() for _ in range(30 + k)])
        rows.append((f"c{k % 2}", k, k, f"h{k}", text, "analysed" if k % 7 else "pending", NOON + dt.timedelta(days=k)))
    want: dict[int, float] = {}
    for number, at in enumerate(range(0, 24, 6)):
        batch = spark.createDataFrame(rows[at : at + 6], ST.SCHEMA)
        ST.merge_batch(spark, batch, number, f"{tmp_path}/state")
        # A repeated batch changes nothing.
        if at == 12:
            ST.merge_batch(spark, batch, number, f"{tmp_path}/state")
        # The same by all pairs of what has come so far.
        new = {r[1] for r in rows[at : at + 6]}
        best = {k: 0.0 for k in new}
        for r in ST.both_ways(ST.pairs(spark.createDataFrame(rows[: at + 6], ST.SCHEMA))).collect():
            score = round(r.similarity * 100, 2)
            if r.id in new:
                best[r.id] = max(best[r.id], score)
                if r.other not in new:
                    want[r.other] = max(want[r.other], score)
        want |= best
    found = {r.id: r.score for r in ST.current_scores(spark, f"{tmp_path}/state").collect()}
    assert found == want and sum(s > 0 for s in want.values()) > 3
    assert len(list((tmp_path / "state" / "scores").glob("v=*"))) < 4
