from plumbline.streaming.worst_case import streaming_worst_case


def test_worst_case_follows_the_stream(spark, tmp_path):
    schema = "video_id int, failed_checks array<string>, ts timestamp_ntz"
    rows = spark.createDataFrame([(1, [], None), (1, ["b", "a"], None), (2, [], None)], schema)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streaming_worst_case(stream).writeStream.outputMode("complete").format("memory").queryName("worst").start()
    q.processAllAvailable()
    q.stop()
    out = {r["video_id"]: r for r in spark.table("worst").collect()}
    assert list(out[1]["failed_checks"]) == ["a", "b"] and out[1]["verdict"] == "NO_GO" and out[2]["verdict"] == "GO"


def test_watermarked_by_hour(spark, tmp_path):
    spark.sql("select 1 as video_id, array('a') as failed_checks, timestamp_ntz'2024-01-01 10:05:00' as ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video_id int, failed_checks array<string>, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    q = streaming_worst_case(stream, "ts").writeStream.outputMode("update").format("memory").queryName("hourly_worst").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hourly_worst").count() == 1
