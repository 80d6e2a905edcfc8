"""Media columns: payloads stored as progressive JPEG, and read back as RGB tensors.

A payload's bytes become coefficients of 8x8 blocks, 64 bytes each, in zigzag order;
coefficients are the unit that the format keeps without loss.  The bytes that texts have
most get the smallest coefficients: 2, -2, 3, -3, ... in order of COMMON and then of
value.  No magnitude is under 2, so that every scan of a block is full.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import jpeg
from verdigris.llm._shared import bounded_batches, byte_slices, ranges, store, utf8

UNIT = 64
#: Payload bytes that are coded at once.
STEP = 1 << 21
#: The bytes that get the smallest coefficients (any order is read back without loss).
COMMON = b" etaoinsrhldcumfpgwybvkxjqz"
_RANKED = np.array([*COMMON, *(b for b in range(256) if b not in COMMON)], np.uint8)
_COEFFICIENT = np.zeros(256, np.int32)
_COEFFICIENT[_RANKED] = (2 + np.arange(256) // 2) * np.where(np.arange(256) % 2, -1, 1)


def padded_sizes(n_bytes: np.ndarray) -> np.ndarray:
    """Sizes after padding with zero bytes to a positive multiple of UNIT."""
    return np.maximum(1, -(-n_bytes // UNIT)) * UNIT


def encode(data: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A JPEG file for each of the texts whose bytes lie end to end in `data`."""
    padded = padded_sizes(sizes)
    frames = [jpeg.square_frame(int(n) // UNIT) for n in padded]
    place = np.cumsum([0, *(64 * f.blocks for f in frames)])
    raw = np.zeros(int(padded.sum()), np.uint8)
    raw[ranges(np.cumsum(padded) - padded, sizes)] = data
    values = np.zeros(int(place[-1]), np.int32)
    values[ranges(place[:-1], padded)] = _COEFFICIENT[raw]
    return jpeg.write(frames, values.reshape(-1, 64), [struct.pack("<qq", a, b) for a, b in zip(sizes.tolist(), padded.tolist(), strict=True)])


def payload(image: jpeg.Image, coefficients: np.ndarray) -> tuple[int, bytes]:
    """Unpadded size and padded payload that an image's coefficients hold."""
    n_bytes, padded = struct.unpack("<qq", image.comment)
    values = coefficients.reshape(-1)[:padded]
    return n_bytes, _RANKED[2 * (np.abs(values) - 2) + (values < 0)].tobytes()


def describe(tensor: np.ndarray) -> str:
    """Size, channel means, contrast and edge strength of an RGB tensor, from integer sums."""
    height, width, _ = tensor.shape
    sums = tensor.reshape(-1, 3).sum(0, dtype=np.int64)
    # Exact in single precision: sums of products under 2^24.
    gray = (tensor.reshape(-1, 3).astype(np.float32) @ np.array([299, 587, 114], np.float32)).astype(np.int32).reshape(height, width) // 1000
    n = gray.size
    spread = n * int(np.square(gray).sum(dtype=np.int64)) - int(gray.sum(dtype=np.int64)) ** 2
    edges = int(np.abs(np.diff(gray, axis=1)).sum(dtype=np.int64))
    return f"{width}x{height};rgb={','.join(str(int(s) // n) for s in sums)};contrast={int(max(spread, 0) ** 0.5) // n};edges={edges // n}"


def stored(spark: SparkSession) -> Column:
    """A function of a text column: its JPEG file (null is the empty text)."""
    bounded_batches(spark)

    @F.arrow_udf("binary")
    def files(text: pa.Array) -> pa.Array:
        data, offsets = utf8(text)
        sizes, out = np.diff(offsets), []
        for a, b in byte_slices(padded_sizes(sizes), STEP):
            out += encode(data[offsets[a] : offsets[b]], sizes[a:b])
        return pa.array(out, pa.binary())

    return files


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary"
_KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}


def digest(spark: SparkSession) -> Column:
    """A function of a JPEG column: what the stored bytes give when read back, with the
    full-resolution RGB tensor (height, width, bytes).  Null gives a struct of nulls."""
    bounded_batches(spark)
    fields = [f.split() for f in _DIGEST.split(", ")]

    @F.arrow_udf(_DIGEST)
    def describe_files(media: pa.Array) -> pa.Array:
        rows: list[tuple] = []
        known = [m for m in media.to_pylist() if m is not None]
        for a, b in byte_slices(np.array([len(m) for m in known], np.int64), STEP):
            files = known[a:b]
            images, coefficients, first = jpeg.read(files)
            pixels = jpeg.samples(images, coefficients)
            for image, file, at, end in zip(images, files, first[:-1], first[1:], strict=True):
                n_bytes, raw = payload(image, coefficients[at:end])
                tensor = jpeg.rgb(image, pixels[at:end])
                rows.append((n_bytes, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), describe(tensor), *tensor.shape[:2], tensor.tobytes()))
        found = iter(rows)
        every = [next(found) if m.is_valid else (None,) * len(fields) for m in media]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in every], _KINDS[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])

    return describe_files


def tensors(spark: SparkSession) -> Column:
    """A function of a JPEG column: struct<height, width, rgb> at full resolution."""
    bounded_batches(spark)

    @F.arrow_udf("height int, width int, rgb binary")
    def decode(media: pa.Array) -> pa.Array:
        found = []
        for file in media.to_pylist():
            if file is None:
                found.append((None, None, None))
                continue
            images, coefficients, _ = jpeg.read([file])
            tensor = jpeg.rgb(images[0], jpeg.samples(images, coefficients))
            found.append((tensor.shape[0], tensor.shape[1], tensor.tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.binary())
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["height", "width", "rgb"])

    return decode


def media_column(docs: DataFrame) -> DataFrame:
    """`docs` with a column `media`, the text stored as JPEG; one of that name is replaced."""
    return docs.withColumn("media", stored(docs.sparkSession)("text"))


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the digest and the RGB tensor of every row of `docs` (doc_id, text).

    The media table (doc_id, media) is written to the shared folder first; all else comes
    from the bytes that are read back.  A null or empty text is stored as 64 zero bytes;
    equal texts have equal digests; repeated rows stay.
    """
    kept, _ = store(media_column(docs.select("doc_id", "text")).select("doc_id", "media"), "media")
    return kept.select("doc_id", digest(docs.sparkSession)("media").alias("digest")).select("doc_id", "digest.*")
