"""Sources and sinks on files of their own."""

import gzip
import json

from sparkloom.sources import readers as R
from sparkloom.sources import writers as W


def test_json_lines_skip_what_is_no_json(spark, tmp_path):
    good = {"parent_asin": "A", "user_id": "u", "rating": 5.0, "timestamp": 7, "helpful_vote": 1, "verified_purchase": True}
    odd = {"parent_asin": "B", "user_id": "u", "rating": "five"}
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.write(json.dumps(good) + "\n{broken\n\n" + json.dumps(odd) + "\n")
    got = {r.parent_asin: r for r in R.project_reviews(R.read_json_lines(spark, str(tmp_path / "r.jsonl.gz"), "raw_review", 2)).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"].rating, got["A"].timestamp_ms, got["B"].rating, got["B"].timestamp_ms) == (5.0, 7, 0.0, 0)


def test_item_projection(spark, tmp_path):
    rec = {"main_category": "M", "parent_asin": "A", "title": " T ", "features": ["x", "y"], "categories": ["a"], "images": [{"thumb": "t"}, {"large": "l"}]}
    (tmp_path / "i.jsonl").write_text(json.dumps(rec) + "\n")
    r = R.project_items(R.read_json_lines(spark, str(tmp_path / "i.jsonl"), "raw_item")).first()
    assert (r.title, r.features, r.sub_category, r.image_url, r.description, r.rating_number) == ("T", "x | y", "", "l", "", 0)


def test_file_flags(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"x" * 101)
    (tmp_path / "b.jpg").write_bytes(b"x" * 100)
    items = spark.createDataFrame([(0, str(tmp_path / "a.jpg")), (1, str(tmp_path / "b.jpg")), (2, str(tmp_path / "c.jpg"))], "item_id int, path string")
    got = {r.item_id: (r.has_image, r.path != "") for r in R.add_file_flags(items, R.list_files(spark, str(tmp_path)), "path").collect()}
    assert got == {0: (True, True), 1: (False, False), 2: (False, False)}


def test_fetch_retries_server_errors_only(spark):
    def fetch(url):
        if url == "ok":
            return 200, b"x" * 200
        if url == "boom":
            raise TimeoutError
        return {"gone": (404, b""), "busy": (503, b""), "short": (200, b"x")}[url]

    todo = spark.createDataFrame([("ok",), ("boom",), ("gone",), ("busy",), ("short",), (None,)], "url string")
    got = {r.url: (r.ok, r.reason) for r in R.fetch_files(todo, fetch, backoff=0).collect()}
    assert got == {"ok": (True, ""), "boom": (False, "TimeoutError"), "gone": (False, "http 404"), "busy": (False, "http 503"), "short": (False, "short body"), None: (False, "no url")}


def test_fetches_run_together_and_wait_longer_each_time(spark):
    import time

    def slow(url):
        time.sleep(0.4)
        return 200, b"x" * 200

    began = time.time()
    todo = spark.createDataFrame([(str(i),) for i in range(40)], "url string").coalesce(1)
    assert R.fetch_files(todo, slow, in_flight=20).filter("ok").count() == 40 and time.time() - began < 10
    busy = spark.createDataFrame([("u",)], "url string")
    began = time.time()
    assert R.fetch_files(busy, lambda u: (503, b""), attempts=3, backoff=1.5).first().reason == "http 503" and time.time() - began >= 2.5


def test_images_decode_or_become_grey(spark, tmp_path):
    import struct
    import zlib

    def png(w, h, rgb):
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress((b"\0" + bytes(rgb) * w) * h)) + chunk(b"IEND", b"")

    (tmp_path / "a.jpg").write_bytes(png(3, 2, (10, 20, 30)))
    (tmp_path / "b.jpg").write_bytes(b"<html>gone</html>" * 20)
    items = spark.createDataFrame([(i, str(tmp_path / f"{n}.jpg")) for i, n in enumerate("abc")], "item_id int, path string")
    got = {r.item_id: r for r in R.decode_images(items, str(tmp_path), "path", 4).collect()}
    a = got[0].image
    assert (a.height, a.width, a.n_channels, bytes(a.data), got[0].placeholder) == (2, 3, 3, bytes((30, 20, 10)) * 6, False)
    assert all((got[i].image.height, set(got[i].image.data), len(got[i].image.data), got[i].placeholder) == (4, {128}, 48, True) for i in (1, 2))


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    assert W.write_if_rows(df, str(tmp_path / "t")) and not W.write_if_rows(df.limit(0), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3 and not (tmp_path / "none").exists()
    W.write_results(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    best = W.keep_best(df, 0.5, None, str(tmp_path / "m"))
    assert W.keep_best(df.limit(1), 0.5, best, str(tmp_path / "m")) == 0.5
    assert spark.read.parquet(str(tmp_path / "m/best")).count() == 3 and spark.read.parquet(str(tmp_path / "m/latest")).count() == 1


def test_streaming_histories(spark, tmp_path):
    from sparkloom.streaming.histories import stream_last_events

    src = tmp_path / "in"
    spark.createDataFrame([(1, 10, 100, 0), (1, 11, 50, 1), (2, 20, 5, 2)], "user_id bigint, item_id bigint, timestamp_ms bigint, ordinal bigint").write.parquet(str(src))
    stream = spark.readStream.schema("user_id bigint, item_id bigint, timestamp_ms bigint, ordinal bigint").parquet(str(src))
    q = stream_last_events(stream, 2).writeStream.outputMode("update").format("memory").queryName("chains").start()
    q.processAllAvailable()
    q.stop()
    assert {r.user_id: r.chain for r in spark.sql("SELECT * FROM chains").collect()} == {1: [11, 10], 2: [20]}
