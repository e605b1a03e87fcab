from cobbler.streaming.changes import change_writer, late_free

SCHEMA = "k string, at timestamp, v int"


def test_changes_of_a_stream(spark, tmp_path):
    import datetime as dt

    t = lambda m: dt.datetime(2025, 1, 1, 0, m, tzinfo=dt.UTC)
    batches = [[("a", t(0), 1), ("a", t(1), 1), ("b", t(1), 5)], [("a", t(2), 1), ("a", t(3), 2), ("b", t(3), None)], [("b", t(4), None), ("a", t(5), 1)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = late_free(stream, "at", "1 hour", ["k"]).writeStream.foreachBatch(change_writer(str(tmp_path / "out"), ["k"], "at", "v")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.k, r["at"].minute, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0, 1), ("a", 3, 2), ("a", 5, 1), ("b", 1, 5), ("b", 3, None)]
