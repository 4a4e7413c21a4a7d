from datetime import datetime

from siftwork.streaming.windows import ledger_writer, windowed_kpis


def test_windowed_counts_drop_nothing_in_time(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 1), "view", 2.0), (2, datetime(2024, 1, 1, 23), "view", 3.0), (3, datetime(2024, 1, 9), "click", 1.0)]
    df = spark.createDataFrame(rows, "item_id long, occurred_at timestamp, track string, value double")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = windowed_kpis(stream).writeStream.format("memory").queryName("kpis").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert sorted((r.track, r["items"], r.value) for r in spark.table("kpis").collect()) == [("click", 1, 1.0), ("view", 2, 5.0)]


def test_ledger_adds_changed_content_only(spark, tmp_path):
    write = ledger_writer(f"{tmp_path}/ledger", "id", "hash")
    write(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, hash string"), 0)
    write(spark.createDataFrame([(1, "a"), (2, "c")], "id long, hash string"), 1)
    write(spark.createDataFrame([(1, "a"), (2, "c")], "id long, hash string"), 1)
    assert sorted((r.id, r.hash) for r in spark.read.parquet(f"{tmp_path}/ledger").collect()) == [(1, "a"), (2, "b"), (2, "c")]
