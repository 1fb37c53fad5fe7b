import os
import shutil

from tesselune.plans.queries import frame_counts
from tesselune.streaming.timeline import frame_stream, ticks_by_window, totals

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def run(spark, df, name, mode, checkpoint):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_stream_totals_equal_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in" / "events.parquet")
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    got = run(spark, totals(frame_stream(spark, str(tmp_path / "in"), schema)), "totals", "complete", str(tmp_path / "c1"))
    assert sorted(got.collect()) == sorted(frame_counts(spark, SF).collect())
    windows = run(spark, ticks_by_window(frame_stream(spark, str(tmp_path / "in"), schema), "1 day"), "windows", "complete", str(tmp_path / "c2"))
    assert sum(r.frames for r in windows.collect()) == spark.read.parquet(f"{SF}/events.parquet").count()
