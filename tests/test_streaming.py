"""Live runs equal batch runs once the stream has passed them."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chronograft.operators import snapshots
from chronograft.streaming import runs


def test_live_runs(spark, tmp_path):
    base = datetime(2024, 1, 1)
    data = [(1, 2, 0), (1, 2, 1), (1, 2, 1), (1, 2, 4), (3, 4, 2), (9, 9, 60)]
    rows = [(u, v, base + timedelta(minutes=10 * t + 1)) for u, v, t in data]
    for i in range(3):  # three files, three micro-batches
        spark.createDataFrame(rows[2 * i : 2 * i + 2], "src long, dst long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = runs.live_runs(runs.bucketed(stream, "ts", 10, "10 minutes"), 10)
    query = live.writeStream.format("memory").queryName("live_runs").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    first = int(base.timestamp()) // 600
    batch = spark.createDataFrame(rows, "src long, dst long, ts timestamp")
    occ = batch.select("src", "dst", F.floor(F.unix_timestamp("ts") / 600).cast("int").alias("t"))
    want = {tuple(r) for r in snapshots.islands(snapshots.dedup(occ)).collect() if r["src"] != 9}
    assert {tuple(r) for r in spark.table("live_runs").collect()} == want
    assert (1, 2, first, first + 1) in want
