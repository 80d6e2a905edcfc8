"""Image files to pixels, with numpy: PPM and PGM, and PNG without interlacing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources.dump import read_media

PNG = b"\x89PNG\r\n\x1a\n"
#: Channels of PNG's colour types (the format's values): gray, RGB, palette, gray and alpha, RGBA.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MOST_PIXELS = 1 << 26


class Unreadable(ValueError):
    """An image file that is cut off, damaged, too large or of another kind."""


def _sized(height: int, width: int) -> None:
    if not 0 < height * width <= MOST_PIXELS:
        raise Unreadable(f"{width} x {height} pixels")


def read_netpbm(content: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of a binary PGM (P5) or PPM (P6) file."""
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(content) and (content[at : at + 1].isspace() or content[at : at + 1] == b"#"):
            at = content.find(b"\n", at) + 1 or len(content) if content[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(content) and content[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise Unreadable("no size in the header")
        fields.append(int(content[at:end]))
        at = end
    width, height, top = fields
    channels = 3 if content[:2] == b"P6" else 1
    _sized(height, width)
    if not 0 < top < 65536:
        raise Unreadable("no greatest value")
    kind = np.dtype(np.uint8 if top < 256 else ">u2")
    data = content[at + 1 : at + 1 + height * width * channels * kind.itemsize]
    if len(data) < height * width * channels * kind.itemsize:
        raise Unreadable("cut off")
    values = np.frombuffer(data, kind).reshape(height, width, channels)
    return values if top == 255 else to_bytes(values / top)


def read_png(content: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of a PNG file of 8 bits a sample; chunks are checked
    against their CRC."""
    at, data, palette, header = len(PNG), [], None, None
    while True:
        if at + 12 > len(content):
            raise Unreadable("cut off")
        (length,), kind = struct.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + length]
        if len(content) < at + 12 + length or struct.unpack(">I", content[at + 8 + length : at + 12 + length])[0] != zlib.crc32(kind + body):
            raise Unreadable("a damaged chunk")
        at += 12 + length
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    if header is None or header[2] != 8 or header[3] not in CHANNELS or header[6]:
        raise Unreadable("a kind of PNG that is not read")
    width, height, _, colour, *_ = header
    _sized(height, width)
    channels = CHANNELS[colour]
    stride = width * channels
    try:
        raw = zlib.decompressobj().decompress(b"".join(data), height * (stride + 1))
    except zlib.error as error:
        raise Unreadable(str(error)) from None
    if len(raw) < height * (stride + 1):
        raise Unreadable("cut off")
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    pixels = _unfiltered(lines[:, 0], lines[:, 1:], channels).reshape(height, width, channels)
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise Unreadable("no palette")
        return palette[pixels[:, :, 0]]
    return pixels


def _unfiltered(kinds: np.ndarray, lines: np.ndarray, channels: int) -> np.ndarray:
    """The samples of lines that PNG stores as differences to the left, above, or both."""
    out = np.zeros((len(lines) + 1, lines.shape[1]), np.uint8)
    for i, (kind, line) in enumerate(zip(kinds.tolist(), lines, strict=True)):
        above = out[i]
        if kind == 0:
            out[i + 1] = line
        elif kind == 1:
            out[i + 1] = np.cumsum(line.reshape(-1, channels), 0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            out[i + 1] = line + above
        elif kind in (3, 4):
            left, corner = [0] * channels, [0] * channels
            values, up, done = line.tolist(), above.tolist(), []
            for j, v in enumerate(values):
                c = j % channels
                a, b, d = left[c], up[j], corner[c]
                if kind == 3:
                    near = (a + b) // 2
                else:  # the one of the three that is nearest to left + above - corner
                    near = min(((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d)))[2]
                left[c], corner[c] = (v + near) & 255, b
                done.append(left[c])
            out[i + 1] = done
        else:
            raise Unreadable("an unknown filter")
    return out[1:]


def to_bytes(values: np.ndarray) -> np.ndarray:
    """Samples from 0 to 1 as bytes."""
    return np.clip(np.rint(np.asarray(values, np.float64) * 255), 0, 255).astype(np.uint8)


def as_rgb(pixels: np.ndarray) -> np.ndarray:
    """Gray images get three channels, alpha goes."""
    if pixels.shape[2] in (1, 2):
        return np.repeat(pixels[:, :, :1], 3, axis=2)
    return pixels[:, :, :3]


def read_picture(content: bytes | None) -> np.ndarray:
    """RGB pixels of a file's bytes; Unreadable if it is damaged or of another kind."""
    if not content:
        raise Unreadable("empty")
    try:
        if content.startswith(PNG):
            return as_rgb(read_png(content))
        if content[:2] in (b"P5", b"P6"):
            return as_rgb(read_netpbm(content))
    except (struct.error, ValueError, IndexError) as error:
        raise error if isinstance(error, Unreadable) else Unreadable(str(error)) from None
    raise Unreadable("an unknown kind of file")


DECODED = "pixels binary, height int, width int, channels int, error string"


def decoder() -> Callable[..., Column]:
    """A function of a column of file contents: struct<pixels, height, width, channels, error>.

    A file that cannot be read has its error, and nulls for the rest; other rows of its
    batch are not touched.
    """

    @F.pandas_udf(", ".join(DECODED.split(", ")))
    def decoded(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                p = read_picture(bytes(c) if c is not None else None)
                rows.append((np.ascontiguousarray(p).tobytes(), *p.shape, None))
            except Unreadable as error:
                rows.append((None, None, None, None, str(error)))
        return pd.DataFrame(rows, columns=["pixels", "height", "width", "channels", "error"]).astype({"height": "Int32", "width": "Int32", "channels": "Int32"})

    return decoded


def decode(files: DataFrame) -> DataFrame:
    """`files` (content, ...) with pixels, height, width, channels and error in its place."""
    return files.withColumn("__d", decoder()("content")).select(*[c for c in files.columns if c != "content"], "__d.*")


def read_pictures(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".png", ".ppm", ".pgm")) -> DataFrame:
    """The images of a folder (path, pixels, height, width, channels, error)."""
    return decode(read_media(spark, path, suffixes).select("path", "content"))
