"""Writers that fail, repeat themselves and meet: outputs by batch, and the alert log with versions."""

import threading

import pytest
from pyspark.sql import functions as F

from paceline.operators import alertlog
from paceline.sources import ledger, sinks
from paceline.sources.ledger import AlertLog

ALERT = "timestamp double, stream_id string, zone_id string, density_count bigint, threshold int, dwell_seconds double, notes string"


def alerts(spark, times, stream="cam0", zone="z"):
    return spark.createDataFrame([(float(t), stream, zone, 5, 3, 2.0, f"n{t}") for t in times], ALERT)


def recorded(rows):
    return alertlog.record_density_alerts(rows, created_at=F.lit("2024-01-01").cast("timestamp"))


def test_outputs_are_completed_not_doubled(spark, tmp_path):
    source = str(tmp_path / "tracks")
    schema = "stream_id string, frame_idx bigint, track_id bigint, conf double, crossed boolean"
    for k in range(3):
        spark.createDataFrame([("cam0", k, t, t / 4, t == k) for t in range(4)], schema).coalesce(1).write.mode("append").parquet(source)
    calls = []

    def counting(name, make, fail_at=None):
        def run(batch):
            calls.append(name)
            if fail_at is not None and calls.count(name) == fail_at:
                raise RuntimeError("no room")
            return make(batch)
        return run

    out = str(tmp_path / "out")
    handler = ledger.outputs_sink(out, {
        "a_displayed": counting("a_displayed", lambda b: b.filter("conf >= 0.25")),
        "b_counts": counting("b_counts", lambda b: b.groupBy("stream_id", "frame_idx").count(), fail_at=2),
        "c_crossings": counting("c_crossings", lambda b: b.filter("crossed")),
    })

    def start():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return sinks.results_sink(stream, handler, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="no room"):
        start().awaitTermination()
    # the second batch has displayed tracks only: none of it is shown
    assert {n: ledger.read_output(spark, out, n).select("batch").distinct().count() for n in ("a_displayed", "b_counts", "c_crossings")} == {
        "a_displayed": 1, "b_counts": 1, "c_crossings": 1}
    start().awaitTermination()
    assert calls == ["a_displayed", "b_counts", "c_crossings", "a_displayed", "b_counts", "b_counts", "c_crossings"] + [
        "a_displayed", "b_counts", "c_crossings"]
    assert sorted(map(tuple, ledger.read_output(spark, out, "a_displayed").select("frame_idx", "track_id").collect())) == [
        (k, t) for k in range(3) for t in (1, 2, 3)]
    assert sorted(map(tuple, ledger.read_output(spark, out, "b_counts").select("frame_idx", "count").collect())) == [(0, 4), (1, 4), (2, 4)]
    assert sorted(map(tuple, ledger.read_output(spark, out, "c_crossings").select("frame_idx", "track_id").collect())) == [(0, 0), (1, 1), (2, 2)]
    assert len(ledger._Folder(spark, f"{out}/_ledger").names()) == 1
    handler(spark.createDataFrame([], schema), 2)  # handed over again
    assert ledger.read_output(spark, out, "c_crossings").count() == 3
    assert ledger.read_output(spark, str(tmp_path / "nothing"), "x") is None


def test_log_of_batch_and_stream_writers(spark, tmp_path):
    path = str(tmp_path / "log")
    log = AlertLog(spark, path)
    assert log.read() is None and log.recent() is None and not log.compact()
    assert log.append(recorded(alerts(spark, [3, 1, 2])))
    sink = ledger.alert_log_sink(path, recorded, "live", compact_at=100)
    sink(alerts(spark, [10, 11]), 0)
    sink(alerts(spark, [10, 11]), 0)
    sink(alerts(spark, []), 1)
    sink(alerts(spark, [20], "cam1", "other"), 2)
    rows = lambda: [tuple(r) for r in log.read().select("id", "timestamp", "stream_id", "clip_path").orderBy("id").collect()]
    plain = [(1, 1.0, "cam0", None), (2, 2.0, "cam0", None), (3, 3.0, "cam0", None), (4, 10.0, "cam0", None),
             (5, 11.0, "cam0", None), (6, 20.0, "cam1", None)]
    assert rows() == plain
    clips = lambda *of: spark.createDataFrame(of, "id bigint, clip_path string, clip_url string")
    log.attach(clips((2, "old", "u"), (5, "five", "u")))
    log.attach(clips((2, "new", "u"), (99, "nobody", "u")))
    clipped = [r[:3] + ({2: "new", 5: "five"}.get(r[0]),) for r in plain]
    assert rows() == clipped
    assert log.compact() and rows() == clipped
    log.attach(clips((5, "again", "u")))
    sink(alerts(spark, [30]), 3)
    assert rows() == [r[:3] + ({2: "new", 5: "again"}.get(r[0]),) for r in plain] + [(7, 30.0, "cam0", None)]
    log.vacuum(keep_versions=1)
    assert len(rows()) == 7
    assert len(ledger._Folder(spark, f"{path}/parts").names()) == 2
    assert len(ledger._Folder(spark, f"{path}/_manifest").names()) == 1
    newest = alertlog.recent_density_alerts(log.read(), "z", 2)
    assert [tuple(r) for r in newest.select("id").collect()] == [tuple(r) for r in log.recent("z", 2).select("id").collect()] == [(7,), (5,)]


def test_concurrent_writers_get_ids_of_their_own(spark, tmp_path):
    path = str(tmp_path / "log")
    failed = []

    def work(k):
        try:
            for batch in range(3):
                AlertLog(spark, path).append(recorded(alerts(spark, range(100 * k + 10 * batch, 100 * k + 10 * batch + 4))), f"w{k}", batch)
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed, failed
    ids = sorted(r["id"] for r in AlertLog(spark, path).read().select("id").collect())
    assert ids == list(range(1, 49))
    assert AlertLog(spark, path).read().select("timestamp").distinct().count() == 48


def test_a_slower_writer_claims_the_next_version(spark, tmp_path, monkeypatch):
    log = AlertLog(spark, str(tmp_path / "log"))
    log.append(recorded(alerts(spark, [1])))
    behind, load, looks = AlertLog(spark, log.path), AlertLog._load, []

    def stale(self, version=None):
        now = load(self, version)
        looks.append(now["version"])
        if len(looks) == 2:  # after it looked and before it claims, another one commits
            monkeypatch.setattr(AlertLog, "_load", load)
            log.append(recorded(alerts(spark, [2])))
        return now

    monkeypatch.setattr(AlertLog, "_load", stale)
    behind.append(recorded(alerts(spark, [3])), "w", 0)
    assert sorted(map(tuple, log.read().select("id", "timestamp").collect())) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert log._load()["version"] == 3


def test_times_prune_parts(spark, tmp_path):
    log = AlertLog(spark, str(tmp_path / "log"))
    for k in range(6):
        log.append(recorded(alerts(spark, range(1000 * k, 1000 * k + 5))))
    found = log.read(since=4000.0, until=5003.0)
    assert len(found.inputFiles()) < len(log.read().inputFiles())
    assert sorted(r["timestamp"] for r in found.collect()) == [4000.0 + t for t in range(5)] + [5000.0, 5001.0, 5002.0]
    assert log.read(since=10_000.0).count() == 0
    last = log.recent(limit=3)
    assert len(last.inputFiles()) == 1 and [r["timestamp"] for r in last.collect()] == [5004.0, 5003.0, 5002.0]
    same = alertlog.recent(log.read(), limit=28)
    assert [tuple(r) for r in log.recent(limit=28).select("id", "timestamp").collect()] == [tuple(r) for r in same.select("id", "timestamp").collect()]
