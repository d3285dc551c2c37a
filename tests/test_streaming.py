from folioscope.streaming.limits import window_counts


def test_window_counts(spark, tmp_path):
    rows = "('a', timestamp'2024-01-01 00:00:01'), ('a', timestamp'2024-01-01 00:00:02'), ('b', timestamp'2024-01-01 00:00:03'), ('b', timestamp'2024-01-01 00:30:00')"
    spark.sql(f"select * from values {rows} as t(client, ts)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client string, ts timestamp").parquet(str(tmp_path / "in"))
    query = window_counts(stream, "client", "ts", limit=1).writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.client, r.request_count, r.limited) for r in spark.table("limits").collect()} >= {("a", 2, True), ("b", 1, False)}
