import datetime

from pyspark.sql import functions as F

from chromatile.streaming import paint as live

SCHEMA = "session_id string, seq long, ts timestamp, kind string, x double, y double, pressure double"


def at(s):
    return datetime.datetime(2024, 5, 1, 12, 0, 0) + datetime.timedelta(seconds=s)


def test_strokes_of_a_stream(spark, tmp_path):
    batches = [
        [("a", 1, at(0), "begin", 1.0, 1.0, 0.5), ("a", 2, at(1), "extend", 2.0, 1.0, 0.5), ("b", 1, at(1), "extend", 9.0, 9.0, 0.5), ("c", 1, at(1), "begin", 5.0, 5.0, 0.5), ("d", 1, at(2), "begin", 0.0, 0.0, 1.0)],
        [("a", 5, at(4), "commit", None, None, None), ("a", 3, at(2), "extend", 2.005, 1.0, 0.9), ("a", 4, at(3), "extend", 3.0, 1.0, 0.25), ("b", 2, at(3), "commit", None, None, None), ("d", 2, at(4), "abort", None, None, None), ("d", 3, at(4), "commit", None, None, None)],
        [("a", 6, at(100), "begin", 7.0, 7.0, 0.5), ("a", 7, at(101), "begin", 8.0, 8.0, 0.5), ("a", 8, at(102), "commit", None, None, None)],
        [("z", 1, at(200), "extend", 0.0, 0.0, 0.5)],  # the watermark passes: c never ended
        [("c", 2, at(201), "commit", None, None, None), ("d", 4, at(202), "begin", 4.0, 4.0, 1.0), ("d", 5, at(203), "commit", None, None, None)],
    ]
    source = str(tmp_path / "in")
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source) if not spark.createDataFrame([], SCHEMA).write.parquet(source) else None
    query = live.strokes(events.withWatermark("ts", "5 seconds"), patience_ms=20_000).writeStream.format("memory").queryName("strokes_out").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
        got = sorted((r.session_id, r.stroke, r.began, [(p.x, p.pressure) for p in r.points]) for r in spark.table("strokes_out").select("*").collect())
    finally:
        query.stop()
    assert got == [("a", 0, 1, [(1.0, 0.5), (2.0, 0.5), (3.0, 0.25)]), ("a", 1, 7, [(8.0, 0.5)]), ("d", 0, 4, [(4.0, 1.0)])]
    assert spark.table("strokes_out").filter(F.col("session_id") == "c").count() == 0
