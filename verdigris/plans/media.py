"""Queries of image files, second passes over frames, and the stored graph."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F

from verdigris.operators import graph, images, moments
from verdigris.plans import bindings as B
from verdigris.plans import catalogue as C
from verdigris.session import bounded_batches
from verdigris.sources import pictures
from verdigris.storage import cut, shared_dir

query = C.query

WIDE = 32  # pixels of a line


def _png(height: pd.Series, data: pd.Series) -> pd.Series:
    """Gray PNG files of rows of bytes, each line stored as differences to the one above."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    def file(h: int, b: bytes) -> bytes:
        lines = [bytes(WIDE), *(b[i : i + WIDE] for i in range(0, len(b), WIDE))]
        raw = b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(line, above, strict=True)) for above, line in zip(lines, lines[1:], strict=False))
        header = WIDE.to_bytes(4, "big") + int(h).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
        return pictures.PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    return pd.Series([file(h, bytes(b)) for h, b in zip(height, data, strict=True)])


@query(f"""WITH b AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE text IS NOT NULL), n AS (
  SELECT doc_id, x, len(x) // 2 AS n, greatest(1, (len(x) // 2 + {WIDE - 1}) // {WIDE}) AS h FROM b), v AS (
  SELECT doc_id, n, h, list_transform(range(n), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS v FROM n), s AS (
  SELECT doc_id, h, {WIDE} * h AS p, coalesce(list_sum(v), 0)::BIGINT AS s, coalesce(list_sum(list_transform(v, lambda y: y * y)), 0)::BIGINT AS q FROM v)
SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN h::INTEGER END AS height, CASE WHEN doc_id % 10 <> 3 THEN s END AS total,
  CASE WHEN doc_id % 10 <> 3 THEN round(sqrt(greatest(0, q / p - (s / p) * (s / p))), 1) END AS contrast, CASE WHEN doc_id % 10 = 3 THEN CASE WHEN doc_id % 4 = 1 THEN 'a damaged chunk' ELSE 'cut off' END END AS error FROM s""")
def picture_stats(spark, d):
    """Texts as the pixels of PGM and PNG files, some of them damaged, read back and measured."""
    bounded_batches(spark)
    docs = B.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("b"))
    n = F.octet_length("b")
    sized = docs.withColumn("height", F.greatest(F.lit(1), F.floor((n + WIDE - 1) / WIDE)).cast("int"))
    padded = sized.withColumn("b", F.concat("b", F.unhex(F.repeat(F.lit("00"), (F.col("height") * WIDE - n).cast("int")))))
    pgm = F.concat(F.concat(F.lit(f"P5\n{WIDE} "), F.col("height").cast("string"), F.lit("\n255\n")).cast("binary"), F.col("b"))
    files = padded.withColumn("content", F.when(F.col("doc_id") % 4 == 1, F.pandas_udf(_png, "binary")("height", "b")).otherwise(pgm))
    # Of every tenth file a byte is missing: the last pixel, or one inside a chunk.
    size = F.octet_length("content")
    cut = F.when(F.col("doc_id") % 4 == 1, F.concat(F.substring("content", 1, 40), F.substring(F.col("content"), F.lit(42), size))).otherwise(F.substring(F.col("content"), F.lit(1), size - 1))
    broken = files.select("doc_id", F.when(F.col("doc_id") % 10 == 3, cut).otherwise(F.col("content")).alias("content"))
    found = pictures.decode(broken)
    stats = F.pandas_udf(images.pixel_stats, "struct<brightness:double,contrast:double,sharpness:double>")
    measured = found.withColumn("s", stats("pixels", "height", "width", "channels"))
    return measured.select("doc_id", "height", F.round(F.col("s.brightness") * F.col("height") * WIDE).cast("long").alias("total"), F.round("s.contrast", 1).alias("contrast"), "error")


_MOMENTS = C.ORACLES["key_moments"].strip()


def _second_pass(spark, d):
    samples = cut(B.samples(spark, d))
    chosen = moments.key_moments(samples, moments.scene_segments(samples.select("clip_id", "k", "value")))
    # The wide table: a frame's content, of which every fifth is not readable.
    content = F.concat(F.when(F.col("k") % 5 == 2, "XX").otherwise("P5"), F.repeat(F.col("k").cast("string"), 50))
    frames = samples.select("clip_id", "k", content.alias("content"))
    path = shared_dir(spark, "frames")
    frames.write.parquet(path)
    return samples, moments.moment_frames(chosen, spark.read.parquet(path), lambda c: F.left(c, F.lit(2)) == "P5")


@query(f"""WITH m AS ({_MOMENTS})
SELECT clip_id, (row_number() OVER (PARTITION BY clip_id ORDER BY time_s, k) - 1)::INTEGER AS moment, k, round(time_s, 2) AS time_s, round(begin_s, 2) AS begin_s, round(end_s, 2) AS end_s, round(sharpness, 2) AS sharpness, 2 + 50 * length(k::VARCHAR) AS size FROM m WHERE k % 5 <> 2""")
def moment_frames(spark, d):
    """Frames of key moments, fetched in a second pass; unreadable ones have dropped out."""
    return _second_pass(spark, d)[1].withColumn("size", F.length("content").cast("long")).drop("content")


@query(f"""WITH m AS ({_MOMENTS}), taken AS (SELECT clip_id, count(*) AS moments FROM m WHERE k % 5 <> 2 GROUP BY clip_id), {B.SAMPLES_SQL}
SELECT clip_id, round(max(duration), 2) AS duration, round(max(fps), 2) AS fps, count(*) AS samples, coalesce(max(moments), 0) AS moments FROM samples LEFT JOIN taken USING (clip_id) GROUP BY clip_id""")
def clip_infos(spark, d):
    return moments.clip_info(*_second_pass(spark, d))


@query(f"""WITH {B.NEAR_SQL}, asked AS (SELECT 'part_' || {B.spelt_sql("p_partkey")} AS term FROM part WHERE p_size % 5 = 0 UNION ALL SELECT 'nation_' || {B.spelt_sql("n_nationkey")} FROM nation UNION ALL SELECT 'not_there')
SELECT term, other, rel, weight, edge_rank::INTEGER AS edge_rank FROM near JOIN asked USING (term) WHERE edge_rank <= 25""")
def stored_neighbours(spark, d):
    """Neighbours of some terms, looked up in the stored graph's two tables."""
    folder = shared_dir(spark, "graph")
    name = "graph_" + folder.rpartition("-")[2]
    graph.save_graph(B.graph(spark, d), name, buckets=16, folder=folder)
    asked = B.table(spark, d, "part").where("p_size % 5 = 0").select(B._named("part_", "p_partkey").alias("term"))
    asked = asked.unionByName(B.table(spark, d, "nation").select(B._named("nation_", "n_nationkey").alias("term"))).unionByName(spark.range(1).select(F.lit("not_there").alias("term")))
    return graph.neighbours(graph.load_graph(spark, name), asked, 25).select("term", "other", "rel", "weight", "edge_rank")
