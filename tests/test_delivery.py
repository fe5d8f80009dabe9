from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException

from gneiss.operators import causes
from gneiss.streaming import alerts, delivery, events


def feed(spark, tmp_path, batches, schema="id long, at timestamp, v double"):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return events.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)


T0 = datetime(2024, 1, 1)
BATCHES = [[(10 * b + k, T0 + timedelta(hours=b), float(k)) for k in range(3)] for b in range(4)]


def doubled(batch, n):
    return batch.selectExpr("id", "2 * v AS v")


def out(spark, folder):
    return sorted((r.id, r.v) for r in delivery.delivered(spark, str(folder), "id long, v double").collect())


WANT = sorted((i, 2 * v) for b in BATCHES for i, _, v in b)


def test_each_message_once(spark, tmp_path):
    stream = feed(spark, tmp_path, BATCHES)
    delivery.pull(stream, doubled, str(tmp_path / "d"))
    assert out(spark, tmp_path / "d") == WANT
    delivery.pull(stream, doubled, str(tmp_path / "d"))
    assert out(spark, tmp_path / "d") == WANT


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    stream = feed(spark, tmp_path, BATCHES)
    calls = []

    def counted(batch, n):
        calls.append(n)
        return doubled(batch, n)

    delivery.pull(stream, counted, str(tmp_path / "d"))
    batch = spark.createDataFrame([(99, T0, 1.0)], "id long, at timestamp, v double")
    delivery.handle(batch, calls[0], counted, str(tmp_path / "d"))
    assert out(spark, tmp_path / "d") == WANT and calls.count(calls[0]) == 1


def test_a_crash_between_write_and_mark(spark, tmp_path, monkeypatch):
    stream = feed(spark, tmp_path, BATCHES)
    mark, failed = delivery.acknowledge, []

    def crash(spark, folder, batch_id, rows):
        if batch_id == 2 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost before the mark")
        mark(spark, folder, batch_id, rows)

    monkeypatch.setattr(delivery, "acknowledge", crash)
    with pytest.raises(StreamingQueryException, match="lost before the mark"):
        delivery.pull(stream, doubled, str(tmp_path / "d"))
    assert failed == [2] and len(out(spark, tmp_path / "d")) == 6  # the third batch is written but not shown
    delivery.pull(stream, doubled, str(tmp_path / "d"))
    assert out(spark, tmp_path / "d") == WANT


def test_an_error_of_the_callback_is_tried_again(spark, tmp_path):
    stream, failed = feed(spark, tmp_path, BATCHES), []

    def flaky(batch, n):
        if n == 1 and not failed:
            failed.append(n)
            raise ValueError("no thanks")
        return doubled(batch, n)

    with pytest.raises(StreamingQueryException, match="no thanks"):
        delivery.pull(stream, flaky, str(tmp_path / "d"))
    assert not delivery.is_acknowledged(spark, str(tmp_path / "d"), 1)
    delivery.pull(stream, flaky, str(tmp_path / "d"))
    assert out(spark, tmp_path / "d") == WANT


def test_ids_that_come_twice(spark, tmp_path):
    again = [*BATCHES, BATCHES[3], [(0, T0 + timedelta(hours=3), 7.0)]]  # an id in another message within the watermark
    stream = delivery.once(feed(spark, tmp_path, again), ["id"], "at", "1 day")
    delivery.pull(stream, doubled, str(tmp_path / "d"))
    assert out(spark, tmp_path / "d") == WANT
    batch = spark.createDataFrame(BATCHES[0] * 2, "id long, at timestamp, v double")
    assert delivery.once(batch, ["id"], "at", "1 day").count() == 3


def test_timeout_and_latest(spark, tmp_path):
    stream = feed(spark, tmp_path, BATCHES[:1])
    assert delivery.pull(stream, doubled, str(tmp_path / "d"), timeout=1.0) is False
    rows = spark.createDataFrame([("a", 1, 0), ("a", 5, 3), ("b", 2, 1)], "k string, v int, batch long")
    assert sorted(map(tuple, delivery.latest(rows, ["k"]).collect())) == [("a", 5), ("b", 2)]


MONTHS = [datetime(2023 + m // 12, m % 12 + 1, 15) for m in range(16)]
VALUES = {"a": [10, 12, 11, 13, 12, 11, 10, 12, 13, 11, 12, 13, 12, 11, 13, 40], "b": [5.0] * 16, "c": [9, None, 7, 3] + [None] * 12}
FIELDS = ["change", "last_z", "recent", "low", "high", "drop", "spike", "outlier", "shift"]


def test_alert_stream_equals_batch(spark, tmp_path):
    rows = [(k, at, None if v is None else v / 2) for k, vs in VALUES.items() for at, v in zip(MONTHS, vs) for _ in range(2)] + [(None, MONTHS[0], 1.0)]
    rows.sort(key=lambda r: r[1])
    schema = "k string, at timestamp, v double"
    stream = feed(spark, tmp_path, [rows[i : i + 12] for i in range(0, len(rows), 12)], schema)
    found = alerts.alert_stream(stream, "k", "at", "v", late="20 days")
    delivery.pull(found, lambda batch, n: batch, str(tmp_path / "d"), "update")
    told = delivery.delivered(spark, str(tmp_path / "d"), ", ".join(f"`{c}` {t}" for c, t in found.dtypes))
    got = {r.k: r for r in delivery.latest(told, ["k"]).collect()}
    monthly = spark.createDataFrame(rows, schema).where("k is not null").selectExpr("k", "trunc(at, 'month') AS month", "v").groupBy("k", "month").agg({"v": "sum"}).withColumnRenamed("sum(v)", "total")
    want = {r.k: r for r in causes.alert_rules(monthly, ["k"], "month", "total").collect()}
    assert set(got) == set(want) == {"a", "b", "c"}
    for k in want:
        for f in FIELDS:
            assert got[k][f] == (pytest.approx(want[k][f]) if isinstance(want[k][f], float) else want[k][f]), (k, f)
    assert got["a"].spike and got["a"].outlier and not got["b"].outlier and got["c"].drop
    assert told.where("k = 'a'").count() > 5


def test_idle_keys_are_forgotten(spark, tmp_path):
    schema = "k string, at timestamp, v double"
    early = [("a", datetime(2020, 1, 5), 1.0), ("a", datetime(2020, 2, 5), 2.0)]
    batches = [early, [("b", datetime(2023, 1, 5), 1.0)], [("b", datetime(2023, 6, 5), 1.0)], [("a", datetime(2023, 6, 6), 10.0)]]
    found = alerts.alert_stream(feed(spark, tmp_path, batches, schema), "k", "at", "v", late="1 day", idle_days=365)
    delivery.pull(found, lambda batch, n: batch, str(tmp_path / "d"), "update")
    told = delivery.delivered(spark, str(tmp_path / "d"), ", ".join(f"`{c}` {t}" for c, t in found.dtypes))
    last = delivery.latest(told, ["k"]).where("k = 'a'").first()
    assert last.change is None and last.low == last.high == 10.0


def test_state_has_a_partition_a_core_at_most(spark, tmp_path):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        query = delivery.subscribe(delivery.once(feed(spark, tmp_path, BATCHES), ["id"], "at", "1 day"), doubled, str(tmp_path / "d"))
        query.processAllAvailable()
        told = [p.stateOperators[0].numShufflePartitions for p in query.recentProgress if p.stateOperators]
        query.stop()
        assert told and max(told) <= spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == "11"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert out(spark, tmp_path / "d") == WANT
