import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallygrid.streaming import envelope, jobs, windows

T0 = dt.datetime(2024, 1, 1, 12)


def event_line(i, kind, when=T0, **data):
    return json.dumps({"event_id": f"e{i}", "event_type": kind, "timestamp": when.isoformat(), "data": data})


def events_frame(spark, rows):
    return spark.createDataFrame([(f"e{i}", k, t, json.dumps(d)) for i, k, t, d in rows],
                                 "event_id string, event_type string, timestamp timestamp, data string")


def test_parse_defaults_and_quarantine(spark):
    lines = [event_line(1, "stock.low", product_id="P1"), '{"event_id": ', event_line(2, "mystery.event"), "null"]
    parsed = envelope.parse_events(spark.createDataFrame([(l,) for l in lines], "value string"))
    good = envelope.valid_events(parsed).collect()
    assert [(r.event_id, r.source, r.version) for r in good] == [("e1", "inventory-manager", "1.0")]
    assert {r.raw for r in envelope.quarantined(parsed).collect()} == set(lines[1:])


def test_encode_and_parse_again(spark):
    first = envelope.valid_events(envelope.parse_events(spark.createDataFrame([(event_line(1, "order.created", product_id="P9", quantity=2),)], "value string")))
    wire = envelope.encode_events(first).first()
    assert (wire.key, wire.topic) == ("P9", "inventory.orders")
    again = envelope.valid_events(envelope.parse_events(spark.createDataFrame([(wire.value,)], "value string"))).first()
    assert json.loads(again.data) == {"product_id": "P9", "quantity": 2} and again.timestamp == first.first().timestamp


@pytest.mark.parametrize("kind, topic, name", [
    ("order.updated", "inventory.orders", "orders"), ("stock.out", "inventory.stock", "stock"), ("alert.low_stock", "inventory.alerts", "alerts"),
    ("model.retrained", "inventory.forecasts", "forecasts"), ("analytics.daily_summary", "inventory.alerts", "analytics"), ("other", "inventory.alerts", None)])
def test_routes(spark, kind, topic, name):
    row = spark.range(1).select(envelope.route_topic(F.lit(kind)).alias("t"), envelope.channel(F.lit(kind)).alias("c")).first()
    assert (row.t, row.c) == (topic, name)


def test_sample_alert_payload(spark):
    frame = spark.createDataFrame([("warning", "Low", "Check", [("TEST-001", 5, 10)])],
                                  "alert_level string, title string, message string, affected_products array<struct<product_id:string,current_stock:int,reorder_threshold:int>>")
    event = envelope.decode(envelope.alert_events(frame, "alert.low_stock", F.lit(T0)), "alert").first()
    assert event.payload.affected_products[0].asDict() == {"product_id": "TEST-001", "current_stock": 5, "reorder_threshold": 10}


def test_same_content_gives_the_same_event_id(spark):
    frame = spark.createDataFrame([("O1", "P1", 2, 9.5, "C1", T0)], "order_id string, product_id string, quantity int, total_amount double, customer_id string, order_date timestamp")
    assert envelope.order_events(frame).first().event_id == envelope.order_events(frame).first().event_id


def movements(spark, rows):
    return spark.createDataFrame([(p, q, T0 + dt.timedelta(minutes=m), i) for i, (p, q, m) in enumerate(rows)],
                                 "product_id string, quantity int, changed_at timestamp, seq int")


def levels(spark, stock):
    return spark.createDataFrame([("P", "Name", 10, stock)], "product_id string, product_name string, reorder_threshold int, stock int")


def test_stock_path_low_out_replenished(spark):
    moves = movements(spark, [("P", -2, 0), ("P", -10, 0), ("P", 50, 5)])
    got = envelope.decode(jobs.transitions(jobs.level_changes(moves, levels(spark, 12), ["seq"])), "stock").orderBy("timestamp", F.desc("payload.previous_stock"))
    assert [(r.event_type, r.payload.previous_stock, r.payload.current_stock) for r in got.collect()] == [
        ("stock.low", 12, 10), ("stock.out", 10, 0), ("stock.replenished", 0, 50)]


def test_stock_state_survives_batches_restart_and_replay(spark, tmp_path):
    """Levels stay between batches and runs; a batch writes the keys it touches; a replayed batch gives the same events."""
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), tmp_path / "check"
    known = spark.createDataFrame([("P", "Name", 10, 12), ("Q", "Other", 5, 6), ("R", "Still", 5, 100)],
                                  "product_id string, product_name string, reorder_threshold int, stock int")

    def run(rows):
        if rows:
            movements(spark, rows).coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(movements(spark, []).schema).parquet(str(inbox))
        return jobs.stock_alerts(stream, known, ["seq"], out, str(check))

    def events():
        rows = envelope.decode(spark.read.parquet(out), "stock").orderBy("timestamp", "payload.product_id", F.desc("payload.previous_stock"))
        return [(r.payload.product_id, r.event_type, r.payload.previous_stock, r.payload.current_stock) for r in rows.collect()]

    run([("P", -2, 0), ("unknown", -5, 0)])
    query = run([("P", -10, 1), ("Q", -1, 1)])
    assert query.lastProgress["stateOperators"][0]["numRowsUpdated"] == 2
    run([("P", 50, 2)])
    want = [("P", "stock.low", 12, 10), ("P", "stock.out", 10, 0), ("Q", "stock.low", 6, 5), ("P", "stock.replenished", 0, 50)]
    assert events() == want
    (check / "commits" / "2").unlink()  # as after a failure: the last batch was planned and not committed
    (check / "commits" / ".2.crc").unlink(missing_ok=True)
    run([])
    assert events() == want


def test_failing_handler_does_not_stop_the_rest(spark):
    seen, failures = [], []

    def broken(rows, batch_id):
        raise RuntimeError("no")

    sink = jobs.dispatch_events({"stock.low": [broken, lambda rows, b: seen.append(("low", rows.count()))]},
                                [lambda rows, b: seen.append(("all", rows.count()))], lambda kind, b, e: failures.append((kind, str(e))))
    sink(events_frame(spark, [(1, "stock.low", T0, {}), (2, "order.created", T0, {})]), 0)
    assert seen == [("low", 1), ("all", 2)] and failures == [("stock.low", "no")]


def test_failure_without_callback_stops_the_batch(spark):
    seen = []

    def broken(rows, batch_id):
        raise RuntimeError("no")

    sink = jobs.dispatch_events({"stock.low": [broken]}, [lambda rows, b: seen.append(rows.count())])
    with pytest.raises(RuntimeError):
        sink(events_frame(spark, [(1, "stock.low", T0, {})]), 0)
    assert seen == [1]


def test_quarantine_drains_in_batches(spark, tmp_path):
    def down(rows, batch_id):
        raise ConnectionError("broker down")

    kept, done = str(tmp_path / "kept"), str(tmp_path / "done")
    rows = [(i, "order.created", T0 + dt.timedelta(minutes=i), {}) for i in range(5)]
    jobs.publish_or_quarantine(down, kept)(events_frame(spark, rows), 0)
    first = jobs.drain_quarantine(spark, kept, done, 3)
    assert [r.event_id for r in first.collect()] == ["e0", "e1", "e2"]
    jobs.confirm_replay(first, done)
    assert [r.event_id for r in jobs.drain_quarantine(spark, kept, done, 3).collect()] == ["e3", "e4"]


def test_late_rows_are_counted(spark, tmp_path):
    path = str(tmp_path / "audit")
    sink = jobs.late_audit_sink(path, "1 HOURS")
    sink(events_frame(spark, [(1, "order.created", T0, {})]), 0)
    sink(events_frame(spark, [(2, "order.created", T0 - dt.timedelta(hours=2), {}), (3, "order.created", T0, {})]), 1)
    assert [(r.rows, r.late) for r in spark.read.parquet(path).orderBy("batch").collect()] == [(1, 0), (2, 1)]


def write_lines(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_stream_equals_batch_and_restarts_from_checkpoint(spark, tmp_path):
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def lines(days, start):
        return [event_line(start + i, "order.created", T0 + dt.timedelta(days=d), product_id="P", value=1) for i, d in enumerate(days)]

    def run():
        parsed = envelope.valid_events(envelope.parse_events(spark.readStream.text(str(inbox))))
        valued = parsed.withColumn("value", F.get_json_object("data", "$.value").cast("double"))
        jobs.run_available(windows.daily_summary(valued), jobs.write_batches(out), check)
        return {(r.period_start, r.events) for r in jobs.latest_by_key(spark, out, ["period_start", "event_type"]).collect()}

    write_lines(inbox, "a.txt", lines([0, 0, 1], 0) + ["broken"])
    first = run()
    write_lines(inbox, "b.txt", lines([1, 2], 10))
    second = run()
    day = lambda n: (T0 + dt.timedelta(days=n)).date()
    assert first == {(day(0), 2), (day(1), 1)} and second == {(day(0), 2), (day(1), 2), (day(2), 1)}


def test_events_past_the_watermark_are_dropped(spark, tmp_path):
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        parsed = envelope.valid_events(envelope.parse_events(spark.readStream.text(str(inbox)))).withColumn("value", F.lit(1.0))
        jobs.run_available(windows.daily_summary(parsed, delay="1 hour"), jobs.write_batches(out), check)

    write_lines(inbox, "a.txt", [event_line(1, "order.created", T0 + dt.timedelta(days=5))])
    run()
    write_lines(inbox, "b.txt", [event_line(2, "order.created", T0)])
    run()
    got = jobs.latest_by_key(spark, out, ["period_start", "event_type"]).collect()
    assert [r.period_start for r in got] == [(T0 + dt.timedelta(days=5)).date()]


def test_duplicates_across_files_are_dropped(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    for name in ("a.txt", "b.txt"):
        write_lines(inbox, name, [event_line(1, "order.created"), event_line(name, "order.created")])
    parsed = envelope.valid_events(envelope.parse_events(spark.readStream.option("maxFilesPerTrigger", 1).text(str(inbox))))
    jobs.run_available(windows.dedupe_events(parsed), jobs.write_batches(out), str(tmp_path / "check"), "append")
    assert spark.read.parquet(out).count() == 3


def test_channel_folders(spark, tmp_path):
    inbox = tmp_path / "in"
    write_lines(inbox, "a.txt", [event_line(1, "stock.low"), event_line(2, "analytics.daily_summary")])
    parsed = envelope.valid_events(envelope.parse_events(spark.readStream.text(str(inbox))))
    envelope_query = jobs.write_channels(parsed, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    envelope_query.awaitTermination()
    assert {p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("channel")} == {"channel=stock", "channel=analytics"}


def test_weeks_start_on_monday(spark):
    frame = spark.createDataFrame([("a", "k", dt.datetime(2024, 1, 7, 23), 1.0), ("b", "k", dt.datetime(2024, 1, 8), 2.0)],
                                  "event_id string, event_type string, timestamp timestamp, value double")
    assert {(r.period_start.day, r.total) for r in windows.weekly_summary(frame).collect()} == {(1, 1.0), (8, 2.0)}


def test_stock_levels_of_many_products_take_few_states(spark, tmp_path):
    """Products share states by hash; later batches keep the first opening level; missing times come last."""
    inbox, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    known = spark.range(20000).select(F.col("id").cast("string").alias("product_id"), F.lit("N").alias("product_name"),
                                      F.lit(10).alias("reorder_threshold"), F.lit(12).alias("stock"))

    def run(quantities, opening):
        moves = spark.range(20000).select(F.col("id").cast("string").alias("product_id"), F.posexplode(F.array(*[
            F.struct(F.lit(q).cast("int").alias("quantity"), F.lit(at).cast("timestamp").alias("changed_at")) for q, at in quantities])))
        moves.select("product_id", "col.quantity", "col.changed_at", F.col("pos").alias("seq")).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(movements(spark, []).schema).parquet(inbox)
        query = jobs.stock_alerts(stream, opening, ["seq"], out, check)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024

    run([(50, None), (-2, T0)], known)
    run([(-60, T0)], known.withColumn("stock", F.lit(500)))
    rows = envelope.decode(spark.read.parquet(out), "stock").groupBy("event_type", "payload.previous_stock", "payload.current_stock").count()
    assert sorted(map(tuple, rows.collect())) == [
        ("stock.low", 12, 10, 20000), ("stock.out", 60, 0, 20000), ("stock.replenished", 10, 60, 20000)]
