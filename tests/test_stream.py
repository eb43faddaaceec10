from verdigraph.streaming.walks import confirmed


def test_confirmed_walks(spark, tmp_path):
    rows = [("a", 0, i, x) for i, x in enumerate(("TP", "FP", "FP", "FP", "TP"), 1)] + [("b", 0, 1, "TP"), ("b", 0, 2, "TP"), ("b", 0, 3, None), ("c", 1, 3, "FP"), ("c", 1, 1, "FP")]
    schema = "warning_id string, walk int, level int, label string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame([("c", 1, 2, "FP"), ("a", 0, 6, "TP")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = confirmed(stream).writeStream.format("memory").queryName("walks").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["warning_id"], r["stable_label"], r["base_level"], r["confirmed_at_level"]) for r in spark.table("walks").collect()}
    assert got == {("a", "FP", 2, 4), ("c", "FP", 1, 3)}
