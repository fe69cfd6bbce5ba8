"""Files in, snapshots out, and the job streams."""

import json

import pytest
from pyspark.sql import functions as F

from codexmill.sources import markdown, snapshots
from codexmill.streaming import queue


def test_manifest(spark, tmp_path):
    (tmp_path / "01-first-part").mkdir()
    (tmp_path / "01-first-part" / "a.md").write_text("# Title A\nbody")
    (tmp_path / "01-first-part" / "b.md").write_text("plain")
    (tmp_path / "01-first-part" / "empty.md").write_text("  \n")
    files = [{"filename": "a.md", "source_ranges": "[[1, 5]]"}, {"filename": "missing.md"}, {"filename": "empty.md"}, {"filename": "b.md", "title": "B"}]
    (tmp_path / "manifest.json").write_text(json.dumps({"source": "s.pdf", "files": files}))
    pages, chain = markdown.load(spark, str(tmp_path), True)
    got = [(r["title"], r["cluster"], [tuple(x) for x in r["ranges"]]) for r in pages.orderBy("ord").collect()]
    assert got == [("Title A", "First Part", [(1, 5)]), ("B", "First Part", [])]
    assert [tuple(r) for r in chain.collect()] == [("a.md", "b.md")]


def test_planning_folder(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "_planning").mkdir()
    for name, body in (("10-z.md", "---\ntitle: Own\n---\nx"), ("2-y.md", "text"), ("3-w.md", "# Head\nt")):
        (tmp_path / "docs" / name).write_text(body)
    (tmp_path / "_planning" / "metadata.json").write_text(json.dumps({"original_file_name": "orig.md", "files": [{"name": "2-y.md", "header": "H"}]}))
    (tmp_path / "_planning" / "coverage.json").write_text(json.dumps({"files": [{"filename": "10-z.md", "source_start": 1, "source_end": 9, "title": "C", "summary": "S", "header": "G"}]}))
    pages, chain = markdown.load(spark, str(tmp_path), False)
    assert [(r["name"], r["title"], r["summary"], r["cluster"]) for r in pages.orderBy("ord").collect()] == [("2-y.md", "H", "", "H"), ("3-w.md", "Head", "", "General"), ("10-z.md", "Own", "S", "G")]
    assert chain.count() == 2


def test_pending_markdown_and_pdfs(spark, tmp_path):
    for name in ("a.md", "a.described.md", "b.md"):
        (tmp_path / name).write_text("x")
    rows = {r["path"].rsplit("/", 1)[1]: r["skipped"] for r in markdown.pending_markdown(markdown.markdown_files(spark, str(tmp_path))).collect()}
    assert rows == {"a.md": "described output exists", "a.described.md": "is a described output", "b.md": None}
    (tmp_path / "1.pdf").write_bytes(b"one")
    (tmp_path / "2.pdf").write_bytes(b"two")
    done = spark.createDataFrame([(__import__("hashlib").sha256(b"one").hexdigest(),)], "hash string")
    out = {r["path"].rsplit("/", 1)[1]: (r["status"], r["content"]) for r in markdown.convert_pdfs(spark, str(tmp_path), done, lambda b: b.decode().upper()).collect()}
    assert out == {"1.pdf": ("skipped", None), "2.pdf": ("completed", "TWO")}


def test_images(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"abc")
    (tmp_path / "b.png").write_bytes(b"a")
    (tmp_path / "c.txt").write_bytes(b"")
    images = markdown.image_files(spark, str(tmp_path))
    assert images.filter(F.col("size") == 3).first()["url"] == "data:image/jpeg;base64,YWJj"
    assert markdown.smallest_image(images).first()["path"].endswith("b.png")


def test_snapshots_show_whole_versions(spark, tmp_path):
    root = str(tmp_path / "graph")
    assert snapshots.current_version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root, "nodes")
    one = spark.createDataFrame([("a", "active"), ("b", "stale")], "id string, status string")
    assert snapshots.write({"nodes": one}, root, {"nodes": "status"}) == 1
    assert snapshots.write({"nodes": one.filter("id = 'a'")}, root) == 2
    assert snapshots.read(spark, root, "nodes").count() == 1 and snapshots.read(spark, root, "nodes", 1).count() == 2
    assert snapshots.stale_steps(spark.createDataFrame([("dim", "64")], "key string, value string"), {"dim": "64", "model": "m"}) == ["model"]


def test_cache(spark):
    hits, misses = snapshots.cached(spark.createDataFrame([("h1", "r")], "hash string, result string"), spark.createDataFrame([("h1",), ("h2",)], "hash string"))
    assert hits.count() == 1 and misses.first()["hash"] == "h2"


def test_queue_is_idempotent(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("1", "recluster", "{}", 1), ("2", "dance", "{}", 2)], "id string, type string, payload string, seq long").write.parquet(source)
    handlers = {"recluster": lambda df: df.withColumns({"status": F.lit("done"), "error": F.lit(None).cast("string")})}
    for _ in range(2):
        stream = spark.readStream.schema("id string, type string, payload string, seq long").parquet(source)
        assert queue.run_queue(stream, handlers, out, str(tmp_path / "cp")).awaitTermination(60)
    assert {r["id"]: r["status"] for r in queue.outcomes(spark, out).collect()} == {"1": "done", "2": "failed"}


def test_counters(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(23).select((F.col("id") % 2).alias("key")).coalesce(1).write.parquet(source)
    seen = []
    stream = queue.counters(spark.readStream.schema("key long").parquet(source), 10)
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(seen) == [(0, 1, 2), (1, 1, 1)]
