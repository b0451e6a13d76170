import time

import pytest
from pyspark.sql import functions as F

from tagloom import config
from tagloom.operators import tracking
from tagloom.plans import fixtures as fx
from tagloom.streaming.cascade import cascade_stream, merged_boxes
from tagloom.streaming.progress import Progress, counted


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    return fx.view(spark, sf_dir, fx.DET).withColumn("video_id", F.floor(F.col("frame_id") / 20)).withColumn("tag_type", F.lit("")).cache()


@pytest.fixture(autouse=True)
def batches_with_data_only(spark):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    for name in ("spark.sql.streaming.noDataMicroBatches.enabled", "spark.sql.streaming.stateStore.providerClass"):
        spark.conf.unset(name)


def written(rows, path, frames):
    """Files in frame order, one for each micro-batch."""
    for low, high in frames:
        rows.where((F.col("frame_id") >= low) & (F.col("frame_id") < high)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)


def run(spark, rows, path, tmp_path, name, **options):
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = counted(cascade_stream(stream, config.Settings(), **options)).writeStream.format("parquet").queryName(name).outputMode("append")
    query = query.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)


def test_stream_equals_batch_and_is_counted(spark, found, tmp_path):
    rows = found.select("video_id", "frame_id", "det_ord", "x1", "y1", "x2", "y2", "conf", "source")
    # a frame whose boxes are gone comes as a row without an ordinal
    empty = rows.where("frame_id % 10 = 7").select("video_id", "frame_id").distinct()
    rows = rows.where("frame_id % 10 <> 7").unionByName(empty, allowMissingColumns=True)
    written(rows, str(tmp_path / "in"), [(0, 13), (13, 27), (27, 1000)])
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        run(spark, rows, str(tmp_path / "in"), tmp_path, "cascade")
        for _ in range(100):
            if "cascade" in progress.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    batch = tracking.cascade(rows.where("det_ord is not null").withColumn("tag_type", F.lit("")), rows.select("video_id", "frame_id").distinct())
    columns = ["video_id", "frame_id", "track_id", "det_ord", "is_new", "missed", "tag_type", "ran_model", "n_seen", F.round("conf", 6).alias("conf")]
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = batch.select(*columns).collect()
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(map(tuple, expected), key=str)
    totals = progress.totals["cascade"]
    counts = tracking.counters(batch).agg(F.sum("tracked_hits").alias("h"), F.sum("new_tracks").alias("n")).first()
    assert (totals["tracked_hits"], totals["new_tracks"], totals["rows"]) == (counts.h, counts.n, len(expected))
    assert totals["input_rows"] == rows.count() and progress.per_second("cascade") > 0


def test_state_of_a_silent_video_goes(spark, found, tmp_path):
    rows = found.select("video_id", "frame_id", "det_ord", "x1", "y1", "x2", "y2", "conf", "source")
    path, low = str(tmp_path / "in"), found.agg(F.min("video_id")).first()[0]
    one, other = rows.where(F.col("video_id") == low), rows.where(F.col("video_id") == low + 1)
    one.coalesce(1).write.mode("append").parquet(path)
    run(spark, rows, path, tmp_path, "first", idle=0.001)
    state = lambda: {r.key.video_id for r in spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "at").load().select("key").collect()}
    assert state() == {low}
    other.coalesce(1).write.mode("append").parquet(path)
    run(spark, rows, path, tmp_path, "second", idle=3600.0)
    assert state() == {low + 1}


def test_late_frames_are_left_out(spark, found, tmp_path):
    rows = found.where("video_id = 0").select("video_id", "frame_id", "det_ord", "x1", "y1", "x2", "y2", "conf", "source")
    written(rows, str(tmp_path / "in"), [(5, 15), (0, 8), (15, 18)])
    run(spark, rows, str(tmp_path / "in"), tmp_path, "late")
    assert {r.frame_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == set(range(5, 18))


def test_merged_boxes_of_a_frame():
    rows = [(0, 0.9, 0, 100, 100, 0.5, "yolo"), (1, 5, 5, 100, 100, 0.9, "color"), (2, 200, 200, 250, 250, 0.4, "color"), (3, 201, 201, 250, 250, 0.8, "color")]
    assert merged_boxes(rows, True, 0.45) == [(0, 0.0, 0.0, 100.0, 100.0, 0.5, "yolo"), (1, 201.0, 201.0, 250.0, 250.0, 0.8, "color")]
    assert [r[5] for r in merged_boxes(rows, False, 0.45)] == [0.9, 0.8]
