"""The REST source's push-down, the stored graph, image files, second passes."""

import json
import struct
import threading
import urllib.parse
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import graph, images, moments
from verdigris.sources import pictures, rest
from verdigris.storage import shared_dir


@pytest.fixture()
def service():
    """A graph service that answers with two edges a term, and fails for terms that begin with x."""
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            term = urllib.parse.unquote(self.path.split("?")[0].rsplit("/", 1)[1])
            asked.append(term)
            ok = not term.startswith("x")
            edge = lambda other, w: {"start": {"@id": f"/c/en/{term}"}, "end": {"@id": f"/c/en/{other}"}, "rel": {"label": "IsA"}, "weight": w}
            body = json.dumps({"edges": [edge("thing", 1.0), edge("other", 2.5)]}).encode() if ok else b"no"
            self.send_response(200 if ok else 404)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_filters_say_what_is_asked(spark, service):
    url, asked = service
    edges = rest.read_api(spark, url)
    rows = edges.where(F.col("term").isin("cat", "dog") & (F.col("weight") > 2)).select("term", "end").collect()
    assert sorted(map(tuple, rows)) == [("cat", "other"), ("dog", "other")] and sorted(asked) == ["cat", "dog"]
    asked.clear()
    assert edges.where("term = 'cat' AND term IN ('cat', 'dog')").count() == 2 and asked == ["cat"]
    asked.clear()
    assert edges.where("term = 'cat' AND term = 'dog'").count() == 0 and asked == []
    assert rest.read_api(spark, url, terms="cat,dog").where("term IN ('dog', 'owl')").count() == 2 and asked == ["dog"]
    with pytest.raises(Exception, match="filter by term"):
        edges.where("weight > 1").collect()


def test_terms_are_dealt_to_tasks_that_give_up(spark, service):
    url, asked = service
    edges = rest.read_api(spark, url, terms_per_task="5")
    terms = ["a", "xb", "c", "xd", "xe", "xf", "xg", "h", "i"]
    found = edges.where(F.col("term").isin(*terms))
    assert found.rdd.getNumPartitions() == 2
    # In the second task three calls fail in a row, so later ones are not made; `i` is lost with them.
    partitions = rest.GraphReader({"url": url, "terms": ",".join(["xa", "xb", "xc", "d"])})
    assert list(partitions.read(partitions.partitions()[0])) == [] and asked[-3:] == ["xa", "xb", "xc"]
    assert {r.term for r in found.collect()} == {"a", "c", "h", "i"}


EDGES = [("IsA", "cat", "animal", 2.0, ""), ("IsA", "dog", "animal", 1.0, ""), ("Near", "dog", "cat", 3.0, ""), ("Near", "dog", "dog", 9.0, "")]
SCHEMA = "rel string, start string, end string, weight double, surface string"


def test_stored_graph_is_looked_up_without_moving_it(spark, monkeypatch):
    name = "stored_" + shared_dir(spark, "g").rpartition("-")[2]
    with pytest.raises(FileNotFoundError, match="save_graph"):
        graph.load_graph(spark, name)
    many = spark.createDataFrame(EDGES, SCHEMA).unionByName(spark.range(2000).select(F.lit("IsA").alias("rel"), F.concat(F.lit("n"), "id").alias("start"), F.lit("animal").alias("end"), F.lit(1.0).alias("weight"), F.lit("").alias("surface")))
    graph.save_graph(many, name, buckets=8, folder=shared_dir(spark, "graph"))
    stored = graph.load_graph(spark, name)
    terms = spark.createDataFrame([("cat",), ("dog",), ("none",)], "term string")
    want = {(r.term, r.other, r.rel, r.edge_rank) for r in graph.neighbours(many, terms, 2).collect()}
    assert {(r.term, r.other, r.rel, r.edge_rank) for r in graph.neighbours(stored, terms, 2).collect()} == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = graph.touching(stored, terms)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        joined.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Each direction shuffles the terms to the graph's buckets; the graph itself stays.
    assert plan.count("Bucketed: true") == 2 and "SelectedBucketsCount: 8 out of 8" in plan
    assert plan.count("Exchange hashpartitioning(term") == 2 and plan.count("Exchange") == 2


def test_open_graph(spark):
    none = "none_" + shared_dir(spark, "g").rpartition("-")[2]
    with pytest.warns(UserWarning, match="offline"):
        assert rest.open_graph(spark, "auto", none, "http://127.0.0.1:9", lambda: False).isEmpty()
    with pytest.warns(UserWarning, match="not there"):
        assert rest.open_graph(spark, "local", none, "http://127.0.0.1:9").isEmpty()
    assert rest.open_graph(spark, "offline", none, "").isEmpty()
    assert "term" in rest.open_graph(spark, "api", none, "http://127.0.0.1:9").columns
    graph.save_graph(spark.createDataFrame(EDGES, SCHEMA), none, 2, shared_dir(spark, "graph"))
    assert isinstance(rest.open_graph(spark, "auto", none, "", lambda: False), graph.StoredGraph)


# ------------------------------------------------------------------------- images


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels, colour, filters, palette=None):
    """A PNG file whose lines use the given filters in turn, by their definitions."""
    h, w, c = pixels.shape
    lines, raw = pixels.reshape(h, w * c).astype(int), b""
    for i in range(h):
        up, kind = lines[i - 1] if i else np.zeros(w * c, int), filters[i % len(filters)]
        row = []
        for j in range(w * c):
            left, above, corner = (lines[i][j - c] if j >= c else 0), up[j], (up[j - c] if j >= c else 0)
            p = left + above - corner
            paeth = left if abs(p - left) <= abs(p - above) and abs(p - left) <= abs(p - corner) else above if abs(p - above) <= abs(p - corner) else corner
            row.append((lines[i][j] - (0, left, above, (left + above) // 2, paeth)[kind]) % 256)
        raw += bytes([kind, *row])
    extra = chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    z = zlib.compress(raw)
    return pictures.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + extra + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", z[:9]) + chunk(b"IDAT", z[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour, channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_filters(colour, channels):
    pixels = np.random.default_rng(colour).integers(0, 256, (11, 7, channels)).astype(np.uint8)
    pixels[3:6] = pixels[2:3]  # equal lines, so that predictors tie
    for filters in ([0], [1], [2], [3], [4], [4, 0, 3, 1, 2]):
        assert np.array_equal(pictures.read_png(png(pixels, colour, filters)), pixels)
    rgb = pictures.read_picture(png(pixels, colour, [4]))
    assert rgb.shape == (11, 7, 3) and np.array_equal(rgb[:, :, 0], pixels[:, :, 0])


def test_palette_and_netpbm():
    palette = np.arange(12, dtype=np.uint8).reshape(4, 3)
    index = np.array([[[0], [3]], [[2], [1]]], np.uint8)
    assert np.array_equal(pictures.read_png(png(index, 3, [0], palette)), palette[index[:, :, 0]])
    assert pictures.read_netpbm(b"P5 # size\n2 1\n255\n\x07\x08").tolist() == [[[7], [8]]]
    assert pictures.read_netpbm(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert pictures.read_netpbm(b"P5\n2 1\n65535\n\xff\xff\x00\x00").tolist() == [[[255], [0]]]
    assert pictures.to_bytes([0.0, 0.5, 1.0]).tolist() == [0, 128, 255]


def test_damaged_files_stay_apart(spark):
    good = png(np.full((4, 4, 3), 9, np.uint8), 2, [2])
    files = [good, good[:-20], good[:40] + b"?" + good[41:], b"", None, b"GIF89a", b"P6\n0 9\n255\n", b"P5\n9", b"P5\n2 2\n255\nabc", pictures.PNG, b"P6\n1 1\n255\n\x05\x06\x07"]
    df = spark.createDataFrame([(i, bytearray(f) if f is not None else None) for i, f in enumerate(files)], "id int, content binary").coalesce(1)
    rows = {r.id: r for r in pictures.decode(df).collect()}
    assert {i for i, r in rows.items() if r.error is None} == {0, 10}
    assert (rows[0].height, rows[0].width, rows[0].channels, set(rows[0].pixels)) == (4, 4, 3, {9}) and list(rows[10].pixels) == [5, 6, 7]
    assert all(r.pixels is None and r.height is None for r in rows.values() if r.error)
    assert rows[4].error == rows[3].error == "empty" and "unknown" in rows[5].error and "cut off" in rows[8].error
    told = {r.id: r for r in images.assess(pictures.decode(df)).collect()}
    assert told[0].brightness == 9.0 and told[0].contrast == 0.0 and told[1].brightness is None


def test_pictures_of_a_folder(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(png(np.zeros((2, 3, 1), np.uint8), 0, [0]))
    (tmp_path / "b.ppm").write_bytes(b"P6 broken")
    (tmp_path / "c.txt").write_bytes(b"no image")
    rows = {r.path.rpartition("/")[2]: (r.height, r.width, r.error is None) for r in pictures.read_pictures(spark, str(tmp_path)).collect()}
    assert rows == {"a.PNG": (2, 3, True), "b.ppm": (None, None, False)}


def test_second_pass_renumbers(spark):
    chosen = spark.createDataFrame([("c", i, 10 * i, i * 1.2345, 0.0, 9.999, 5.5555) for i in range(4)] + [("d", 0, 7, 1.0, 0.0, 2.0, 1.0)], "clip_id string, moment int, k int, time_s double, begin_s double, end_s double, sharpness double")
    frames = spark.createDataFrame([("c", 0, "ok"), ("c", 10, "bad"), ("c", 20, None), ("c", 30, "ok"), ("c", 5, "ok")], "clip_id string, k int, content string")
    found = moments.moment_frames(chosen, frames, lambda c: c == "ok")
    assert sorted((r.clip_id, r.moment, r.k, r.time_s, r.end_s) for r in found.collect()) == [("c", 0, 0, 0.0, 10.0), ("c", 1, 30, 3.7, 10.0)]
    samples = spark.createDataFrame([("c", 0, 4.005, 2.5), ("c", 1, 4.005, 2.5), ("d", 0, 1.0, 1.0)], "clip_id string, k int, duration double, fps double")
    assert sorted((r.clip_id, r.samples, r.moments) for r in moments.clip_info(samples, found).collect()) == [("c", 2, 2), ("d", 1, 0)]


def test_newest_of_a_cache_with_any_columns(spark):
    from verdigris import sinks
    from verdigris.sources import dump

    rows = [("a", 1, "x", {"m": 1}), ("a", 2, "b", {"m": 2}), ("a", 2, "c", None), ("b", None, "z", None), ("b", 0, "y", None), (None, 5, "n", None)]
    df = spark.createDataFrame(rows, "id string, ts int, `__rank` string, more map<string,int>")
    assert sorted((r.id or "", r.ts, r["__rank"]) for r in dump.newest(df, "id", "ts").collect()) == [("", 5, "n"), ("a", 2, "c"), ("b", 0, "y")]
    assert dump.newest(df, "id", "ts").columns == df.columns
    assert [(r.id, r.ts) for r in sinks.history(df, 2).collect()] == [(None, 5), ("a", 2)]
