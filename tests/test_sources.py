from pathlib import Path

from pyspark.sql import functions as F

from tagloom import config
from tagloom.operators import export, labels
from tagloom.schema import EXPORT_COLUMNS
from tagloom.sources import catalog, files


def test_settings(tmp_path):
    s = config.settings({"tracker": {"max_frames_missed": 7, "nonsense": 1}, "video": {"skip_frames": 2}, "tiling": {"scales": [1.0]}})
    assert s.tracker.max_frames_missed == 7 and s.tracker.center_dist_thresh == 10.0 and s.video_skip_frames == 2 and s.tiling.scales == (1.0,)
    assert config.settings("no mapping") == config.Settings() == config.load(str(tmp_path / "missing.yaml"))
    assert config.lookup({"a": {"b": None, "c": 0}}, "a.b", 5) == 5 and config.lookup({"a": {"c": 0}}, "a.c", 5) == 0 and config.lookup({}, "a.b") is None


def test_catalog_file(spark, tmp_path):
    path = tmp_path / "db.csv"
    path.write_bytes("name;code\nМолоко;0123\nХлеб; 77 \nshort\n;5\nЧай;77\n".encode("windows-1251"))
    cat = catalog.read(spark, str(path))
    assert {r.code: r.fullname for r in catalog.entries(cat).collect()} == {"0123": "Молоко", "77": "Чай"}
    probes = spark.createDataFrame([("0123",), ("0077",), ("9",), (None,)], "code string")
    assert {r.code: r.fullname for r in catalog.lookup(probes, cat).collect()} == {"0123": "Молоко", "0077": "Чай", "9": None, None: None}


def test_label_files_round_trip(spark, tmp_path):
    folder = tmp_path / "labels"
    folder.mkdir()
    (folder / "a.txt").write_text("0 0.5 0.5 0.1 0.1\nbroken\n1 0.2 0.2 0.1 0.1\n")
    (folder / "b.rf.x.txt").write_text("0 0.5 0.5 0.0001 0.1\n")
    parsed = labels.parse(files.read_labels(spark, str(folder), "train"))
    judged = labels.deduplicated(parsed)
    assert sorted((r.file, r.line_no, r.reason) for r in judged.collect()) == [("a.txt", 0, None), ("a.txt", 1, "invalid"), ("a.txt", 2, None), ("b.rf.x.txt", 0, "small")]
    images = spark.createDataFrame([("train", "b.png"), ("train", "a.jpg")], "split string, image string")
    assert [r.image for r in labels.orphan_images(images, judged).collect()] == ["b.png"]
    kept = judged.where("reason is null").withColumn("line", labels.label_text(None))
    files.write_labels(kept.select("split", "file", "line_no", "line"), str(tmp_path / "out"), per_file=True)
    [written] = (tmp_path / "out/split=train/file=a.txt").glob("*.txt")
    files.write_labels(kept.select("split", "file", "line_no", "line"), str(tmp_path / "table"))
    assert [r.value for r in spark.read.parquet(str(tmp_path / "table")).where("split = 'train' and file = 'a.txt'").collect()] == [written.read_text().rstrip("\n")]
    assert written.read_text().split("\n")[:2] == ["0 0.500000 0.500000 0.100000 0.100000", "1 0.200000 0.200000 0.100000 0.100000"]


def test_export_file(spark, tmp_path):
    rows = export.blank_rows(spark.range(2), ["id"], filename="f", tracker_id=F.col("id"))
    files.write_export(rows, str(tmp_path / "csv"), single=True, bom=True)
    [part] = (tmp_path / "csv").glob("*.csv")
    head, *body = part.read_text(encoding="utf-8-sig").splitlines()
    assert head.split(",") == list(EXPORT_COLUMNS) and len(body) == 2 and body[0].startswith("0,f,")


def test_list_file(spark, tmp_path):
    files.write_list(spark.createDataFrame([(f"p{i:03}",) for i in range(500)], "path string"), str(tmp_path / "l"))
    [part] = (tmp_path / "l").glob("*.txt")
    assert part.read_text().split() == [f"p{i:03}" for i in range(300)]


def test_image_paths(spark, tmp_path):
    (tmp_path / "x.jpg").write_bytes(b"abc")
    (tmp_path / "x.txt").write_bytes(b"abc")
    assert [Path(r.path).name for r in files.image_paths(spark, str(tmp_path)).collect()] == ["x.jpg"]
