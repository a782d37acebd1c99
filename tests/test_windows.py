from tessitura.streaming import windows


def test_stream_run_has_the_windows_still_open_at_the_end(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m}:00", "a", 1.0) for h in range(3) for m in (10, 50)]
    e = spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("ts::timestamp ts", "event_type", "value")
    e.coalesce(1).write.parquet(f"{tmp_path}/in/events.parquet")
    got = windows.run_available(spark, f"{tmp_path}/in/events.parquet", "*.parquet", e.schema, windows.tumbling, "w", f"file://{tmp_path}/out")
    assert sorted(got.collect()) == sorted(windows.tumbling(e).collect()) and got.count() == 3
