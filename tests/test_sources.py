import struct
import zlib

import pytest
from pyspark.sql import functions as F

from emberline.sources import readers, sinks
from emberline.streaming import alerts as ST


def test_front_matter(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nkb_id: KB-1\ntitle: \"A title: with colon\"\ntags: [x, 'y']\napproval: Yes\n---\n# Body\n## One\ntext\n")
    (tmp_path / "b.md").write_text("no head\n")
    got = {r.path.rsplit("/")[-1]: r for r in readers.front_matter(spark, str(tmp_path)).collect()}
    assert got["a.md"].fields == {"kb_id": "KB-1", "title": "A title: with colon", "tags": "[x, 'y']", "approval": "Yes"}
    assert got["a.md"].body.startswith("# Body") and got["b.md"].fields == {} and got["b.md"].body == "no head\n"
    lists = spark.createDataFrame([("[x, 'y']",), ("a,b",), ("",), (None,)], "v string").select(readers.listed(F.col("v")).alias("l"), readers.truthy(F.lit("Yes")).alias("t")).collect()
    assert [r.l for r in lists] == [["x", "y"], ["a", "b"], [], []] and lists[0].t


def test_yolo_coco_and_png(spark, tmp_path):
    (tmp_path / "l.txt").write_text("0 0.5 0.5 0.2 0.4\n1 0.5 0.5\n2 0.5 0.5 1 1 0.7\n")
    got = [tuple(round(x, 6) for x in r[1:]) for r in readers.yolo_labels(spark, str(tmp_path / "l.txt"), 100, 50).orderBy("class_id").collect()]
    assert got == [(0, 1.0, 40.0, 15.0, 60.0, 35.0), (2, 0.7, 0.0, 0.0, 100.0, 50.0)]
    (tmp_path / "c.json").write_text('{"images": [{"id": 1, "file_name": "a.png"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 2, "name": "switch"}]}')
    assert tuple(readers.coco(spark, str(tmp_path / "c.json")).first()) == ("a.png", "switch", 1.0, 2.0, 4.0, 6.0)
    head = struct.pack(">II5B", 640, 480, 8, 2, 0, 0, 0)
    (tmp_path / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head)))
    assert tuple(readers.png_sizes(spark, str(tmp_path / "p.png")).select("width", "height").first()) == (640, 480)


def test_broken_records_and_fallbacks(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "r.jsonl"), "a long").where("a is not null").collect()) == [1, 3]
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "r.jsonl"), "a long", strict=True).collect()
    a, b = spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert sorted(tuple(r) for r in readers.first_valid([a, b], "k", "v is not null").collect()) == [(1, "y"), (2, "x")]
    p = spark.createDataFrame([("C:\\data\\train\\s1\\g.json",)], "path string")
    assert tuple(readers.with_path_keys(p, r"data/(\w+)/(\w+)/", ["split", "scenario"]).first())[1:] == ("train", "s1")


def test_guards_look_at_all_depths(spark):
    df = spark.createDataFrame([(1, [{"root_cause": "x"}])], "a int, b array<struct<root_cause:string>>")
    with pytest.raises(ValueError, match="root_cause"):
        sinks.guarded(df)
    assert sinks.guarded(df.select("a")).columns == ["a"]
    assert sinks.stripped(spark.createDataFrame([(1, 2)], "a int, impacted_nodes int")).columns == ["a"]
    with pytest.raises(ValueError, match="missing"):
        sinks.required(df, ["zz"])


def test_anchored_clusters_of_a_stream(spark, tmp_path):
    minutes = [0, 60, 61, 121, 122, 300]
    base = 1_704_067_200
    rows = spark.createDataFrame([("k", base + 60 * m) for m in minutes], "key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ST.anchored_clusters(stream, "key").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(((r.s - base) / 60, r.n) for r in spark.read.parquet(str(tmp_path / "out")).withColumn("s", F.unix_timestamp("window_start")).collect())
    assert got[:3] == [(0.0, 2), (61.0, 2), (122.0, 1)]
