import csv
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import pixels
from tagloom.schema import EXPORT_COLUMNS
from tagloom.sources.export_sink import ExportSink
from tagloom.sources import stacks as stack_source
from tagloom.streaming.lookup import named_batches


@pytest.fixture(scope="module")
def stacks(tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("stacks"), np.random.default_rng(1)
    made = {"a": rng.integers(0, 256, (25, 6, 7, 3), dtype=np.uint8), "b": rng.integers(0, 256, (11, 5, 4), dtype=np.uint8)}
    for name, stack in made.items():
        np.save(path / f"{name}.npy", stack)
    return str(path), made


def read(spark, path, **options):
    stack_source.register(spark)
    return spark.read.format("frame_stacks").options(**options).load(path)


def test_every_pixel_of_sampled_frames(spark, stacks):
    path, made = stacks
    got = {(r.video_id, r.frame_id, r.y, r.x): (r.b, r.g, r.r, r.gray) for r in read(spark, path, skip=3, frames=4, seconds=2, fps=10).collect()}
    expected = {}
    for name, stack in made.items():
        for frame in range(3, min(len(stack), 20) + 1, 3):
            for y, x in np.ndindex(stack.shape[1:3]):
                v = stack[frame - 1][y, x]
                b, g, r = map(int, v) if stack.ndim == 4 else [int(v)] * 3
                expected[name, frame, y, x] = (b, g, r, int(0.114 * b + 0.587 * g + 0.299 * r + 0.5) if stack.ndim == 4 else b)
    assert got == expected


def test_ranges_and_filters(spark, stacks):
    df = read(spark, stacks[0], frames=2)
    some = df.where((F.col("frame_id") > 4) & (F.col("frame_id") <= 7) & (F.col("video_id") == "a"))
    assert {(r.video_id, r.frame_id) for r in some.select("video_id", "frame_id").distinct().collect()} == {("a", 5), ("a", 6), ("a", 7)}
    assert df.count() == 25 * 42 + 11 * 20 and df.where("frame_id = 400").count() == 0
    part = read(spark, stacks[0], frames=2, first=3, last=6)
    assert part.rdd.getNumPartitions() == 4 and {r.frame_id for r in part.select("frame_id").distinct().collect()} == {3, 4, 5, 6}


def test_stream_of_frames_equals_batch(spark, stacks, tmp_path):
    stack_source.register(spark)
    stream = spark.readStream.format("frame_stacks").option("frames_per_batch", 7).option("skip", 2).load(stacks[0])
    query = stream.select("video_id", "frame_id", "y", "x", "gray").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.parquet(str(tmp_path / "o"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, read(spark, stacks[0], skip=2).select("video_id", "frame_id", "y", "x", "gray").collect()))
    keys = ("video_id", "frame_id")
    assert pixels.otsu_threshold(got, "gray", keys).count() == 12 + 5


def rows(spark, n):
    return spark.range(n, numPartitions=3).select(*(F.concat(F.lit(f"{c},\""), F.col("id")).alias(c) for c in EXPORT_COLUMNS))


def sink(df, path, **options):
    df.sparkSession.dataSource.register(ExportSink)
    df.write.format("tagloom_export").mode(options.pop("mode", "append")).option("path", path).options(**options).save()


def test_export_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    sink(rows(spark, 20), path, name="tags")
    assert sorted(os.listdir(path)) == ["tags-0.csv", "tags-1.csv", "tags-2.csv"]
    sink(rows(spark, 20).coalesce(1), path, name="one")
    sink(rows(spark, 0), path, name="none")
    with open(f"{path}/one.csv", "rb") as f:
        assert f.read(3) == b"\xef\xbb\xbf"
    got = [row for k in range(3) for row in csv.reader(open(f"{path}/tags-{k}.csv", encoding="utf-8-sig", newline=""))]
    head = list(EXPORT_COLUMNS)
    assert got.count(head) == 3 and sorted(r for r in got if r != head) == sorted([list(map(str, r)) for r in rows(spark, 20).collect()])
    assert list(csv.reader(open(f"{path}/none.csv", encoding="utf-8-sig", newline=""))) == [head]


def test_failed_export_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = rows(spark, 20).withColumn("barcode", F.when(F.col("sku_id" if "sku_id" in EXPORT_COLUMNS else EXPORT_COLUMNS[0]).endswith("17"), F.raise_error(F.lit("broken"))).otherwise("x"))
    with pytest.raises(Exception, match="broken"):
        sink(bad, path, name="tags")
    assert not os.path.exists(path) or os.listdir(path) == []
    sink(rows(spark, 3).coalesce(1), path, name="tags")
    before = open(f"{path}/tags.csv", "rb").read()
    with pytest.raises(Exception, match="there already"):
        sink(rows(spark, 9).coalesce(1), path, name="tags")
    assert open(f"{path}/tags.csv", "rb").read() == before and os.listdir(path) == ["tags.csv"]
    sink(rows(spark, 9).coalesce(1), path, name="tags", mode="overwrite")
    assert open(f"{path}/tags.csv", "rb").read() != before


def test_changed_catalog_is_used_from_the_next_batch_on(spark, tmp_path):
    folder = str(tmp_path / "in")
    made = [spark.createDataFrame([(k, "4600000000017", "")], "n int, barcode string, product_name string").coalesce(1) for k in range(3)]
    version, got = {"v": "old name"}, []

    def catalog():
        return spark.createDataFrame([(1, version["v"], "4600000000017")], "row_no int, fullname string, code string")

    def write(df, number):
        got.append([tuple(r) for r in df.select("n", "product_name", "batch").collect()])
        version["v"] = f"name after {number}"

    def run():
        stream = spark.readStream.schema(made[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
        named_batches(stream, catalog, write, "batch").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)

    for df in made[:2]:
        df.write.mode("append").parquet(folder)
    run()
    made[2].write.mode("append").parquet(folder)
    run()
    assert sorted(x[0][1:] for x in got) == [("name after 0", 1), ("name after 1", 2), ("old name", 0)]
