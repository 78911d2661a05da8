"""Stalled runs by timer, and upserts that replays do not repeat."""

import datetime
import random

from pyspark.sql import functions as F

from lexilake.schemas import ENTRIES
from lexilake.streaming import watch

MINUTE = 60_000


def test_sessions_merge_in_any_order():
    rng = random.Random(1)
    for _ in range(200):
        times = [rng.randint(0, 200) for _ in range(rng.randint(1, 30))]
        want = watch.merge_sessions([], times, 10)
        cut = rng.randint(0, len(times))
        assert watch.merge_sessions(watch.merge_sessions([], times[:cut], 10), times[cut:], 10) == want
        assert sum(n for *_, n in want) == len(times) and all(b[0] - a[1] > 10 for a, b in zip(want, want[1:]))


def test_timers_report_silent_runs(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    batches = [[(1, 0), (1, 5), (2, 1)], [(2, 8), (1, 6)], [(3, 60)], [(3, 65)], [(3, 200)]]
    for i, batch in enumerate(batches):
        spark.createDataFrame([(p, start + datetime.timedelta(minutes=m)) for p, m in batch], "project int, updated_at timestamp_ntz").coalesce(1).write.parquet(
            str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema("project int, updated_at timestamp_ntz").option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = watch.start_with_state(spark, lambda: watch.watch_runs(stream, 10, "1 minute").writeStream.foreachBatch(
        lambda rows, i: rows.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={i}"))).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    query.awaitTermination()
    minutes = lambda c: ((F.unix_millis(c) - F.lit(int(start.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000))) / MINUTE).cast("int")
    got = {tuple(r) for r in spark.read.schema(watch.STALLED).parquet(str(tmp_path / "out")).select(
        "project", minutes("started_at"), minutes("stalled_at"), "reports").collect()}
    # The last report's run is still open.
    assert got == {(1, 0, 16, 3), (2, 1, 18, 2), (3, 60, 75, 2)}
    assert spark.conf.get(watch.PROVIDER, "none") != watch.ROCKSDB


def test_a_batch_goes_in_once(spark, tmp_path):
    path = str(tmp_path / "entries")

    def rows(*items):
        at = datetime.datetime(2024, 1, 1)
        return spark.createDataFrame([(p, loc, k, t, False, False, "h", "p", "m", at) for p, loc, k, t in items], ENTRIES)

    rows((0, "de", "a", "old"), (0, "de", "b", "old"), (0, "es", "a", "old"), (1, "de", "a", "old")).write.partitionBy("project", "locale").parquet(path)
    untouched = sorted((tmp_path / "entries" / "project=1").rglob("*.parquet"))
    assert watch.upsert_into(spark, path, rows((0, "de", "a", "new"), (2, "fr", "c", "new")), 7)
    assert not watch.upsert_into(spark, path, rows((0, "de", "a", "replayed")), 7)
    assert watch.upsert_into(spark, path, rows((0, "es", "a", "newer")), 8)
    got = {(r.project, r.locale, r.key, r.text) for r in spark.read.parquet(path).collect()}
    assert got == {(0, "de", "a", "new"), (0, "de", "b", "old"), (0, "es", "a", "newer"), (1, "de", "a", "old"), (2, "fr", "c", "new")}
    assert sorted((tmp_path / "entries" / "project=1").rglob("*.parquet")) == untouched


def test_a_project_has_one_timer_however_many_sessions(monkeypatch):
    calls, held, timers = [], [], set()

    class State:
        exists = lambda self: bool(held)
        get = lambda self: iter(held)
        clear = lambda self: held.clear()

        def put(self, rows):
            held[:] = list(rows)

    class Handle:
        getListState = lambda self, *a: State()

        def registerTimer(self, at):
            calls.append(at)
            timers.add(at)

        deleteTimer = lambda self, at: timers.remove(at)

    class At:
        def __init__(self, ms):
            self.ms = ms

        getExpiryTimeInMs = getCurrentWatermarkInMs = lambda self: self.ms

    import pandas as pd

    w = watch.RunWatch(1000)
    w.init(Handle())
    list(w.handleInputRows((1,), iter([pd.DataFrame({"micros": [i * 10_000 for i in range(5, 55)]})]), At(0)))
    assert timers == {51} and len(calls) == 1
    # An older session comes in: the timer moves to it.
    list(w.handleInputRows((1,), iter([pd.DataFrame({"micros": [0]})]), At(0)))
    assert timers == {1} and len(held) == 51
    timers.clear()
    out = [df for df in w.handleExpiredTimer((1,), At(500), At(1))]
    assert sum(map(len, out)) == 46 and len(held) == 5 and timers == {501}
    timers.clear()
    assert sum(map(len, w.handleExpiredTimer((1,), At(541), At(501)))) == 5 and not held and not timers
