"""Videos that end: late and repeated frames, one result each, and state that is gone afterwards."""

from plumbline.streaming import sessions

SCHEMA = "video_id string, frame_index long, failed_checks array<string>, ts timestamp"


def test_results_when_videos_end(spark, tmp_path):
    def arrive(name, *rows):
        data = ", ".join(f"('{v}', {i}L, array({', '.join(repr(c) for c in checks)}), timestamp'2024-01-01 {t}')" for v, i, checks, t in rows)
        frame = spark.sql(f"select col1 as video_id, col2 as frame_index, cast(col3 as array<string>) as failed_checks, col4 as ts from values {data}")
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def results():
        return sorted((r["video_id"], r["n_frames"], r["n_no_go"], tuple(r["failed_checks"]), r["verdict"]) for r in spark.table("ended").collect())

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.PROVIDER)
    try:
        arrive("a", ("v1", 0, [], "10:00:00"), ("v1", 1, ["score", "diameter"], "10:00:01"), ("v1", 1, ["score"], "10:00:01"), ("v2", 0, [], "10:00:05"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        query = sessions.worst_case_of_ended_videos(stream, "ts", "1 minute", 120_000).writeStream.outputMode("append").format("memory").queryName("ended").start()
        query.processAllAvailable()
        assert results() == []
        arrive("b", ("v1", 1, ["other"], "10:00:01"), ("v1", 2, ["score"], "10:00:40"), ("v3", 0, ["score"], "10:02:30"))  # a repeated frame, a late but timely one
        query.processAllAvailable()
        arrive("c", ("v3", 1, [], "10:09:00"))
        query.processAllAvailable()
        arrive("d", ("v1", 9, ["score"], "10:00:02"), ("v3", 2, [], "10:09:01"))  # too late: dropped
        query.processAllAvailable()
        assert results()[:2] == [("v1", 3, 2, ("diameter", "score"), "NO_GO"), ("v2", 1, 0, (), "GO")]
        assert [r[0] for r in results()].count("v1") == 1
        arrive("e", ("v9", 0, [], "11:00:00"))
        query.processAllAvailable()
        arrive("f", ("v9", 1, [], "11:00:01"))
        query.processAllAvailable()
        assert [r[0] for r in results()][:2] == ["v1", "v2"] and {r[0] for r in results()} == {"v1", "v2", "v3"}
        rows = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        query.stop()
        assert rows <= 8  # the rows of v9 alone: two frames, its time and its timer
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
