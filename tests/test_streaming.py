"""The stream gives what the batch gives."""

from linkloom.streaming import events as E


def test_windows_and_sessions(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "in")
    batch.repartition(3).write.parquet(folder)
    whole = batch.withColumn("ts", batch.ts.cast("timestamp"))
    for name, f in (("windows", lambda d: E.windowed_counts(d, late="400 days")), ("sessions", lambda d: E.user_sessions(d, late="400 days"))):
        run = f(E.read_events(spark, folder)).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination()
        rows = lambda d: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d.collect())
        assert rows(spark.table(name)) == rows(f(whole))
