import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import jpeg, media


def plain_decode(file):
    """Coefficients of a file by the format's rules, one bit at a time."""
    image = jpeg.parse(file)
    out = np.zeros((image.frame.blocks, 64), np.int64)
    for scan in image.scans:
        low, high, sent, left, tables, _ = scan.kind
        codes = []
        for counts, symbols in tables:
            code, length = jpeg._codes(counts, symbols)
            codes.append({(int(length[s]), int(code[s])): s for s in range(256) if length[s]})
        blocks, owner, sizes = jpeg._lanes(scan.frame.width, scan.frame.height, scan.frame.sampling, scan.components, scan.interval)
        raw, at = file[scan.begin : scan.end], 0
        pieces, part = [], bytearray()
        while at < len(raw):
            if raw[at] == 0xFF and raw[at + 1] == 0:
                part.append(0xFF)
                at += 2
            elif raw[at] == 0xFF:
                pieces.append(bytes(part))
                part = bytearray()
                at += 2
            else:
                part.append(raw[at])
                at += 1
        pieces.append(bytes(part))
        first = 0
        for data, n in zip(pieces, sizes.tolist(), strict=True):
            bits = iter("".join(f"{b:08b}" for b in data) + "1" * 32)
            take = lambda n, bits=bits: int("".join(next(bits) for _ in range(n)) or "0", 2)

            def symbol(table, take=take):
                length, code = 0, 0
                while True:
                    length, code = length + 1, code << 1 | take(1)
                    if (length, code) in table:
                        return table[length, code]

            extend = lambda v, s: v if s == 0 or v >= 1 << (s - 1) else v - (1 << s) + 1
            last, ends = {}, 0
            for i in range(first, first + n):
                row = out[blocks[i]]
                if low == 0 and sent:
                    row[0] |= take(1) << left
                elif low == 0:
                    c = int(owner[i])
                    s = symbol(codes[list(scan.components).index(c)])
                    last[c] = last.get(c, 0) + extend(take(s), s)
                    row[0] = last[c] << left
                elif not sent:
                    k = low
                    if ends:
                        ends -= 1
                        continue
                    while k <= high:
                        rs = symbol(codes[0])
                        run, s = rs >> 4, rs & 15
                        if s == 0 and run < 15:
                            ends = (1 << run) + take(run) - 1
                            break
                        k += run
                        if s:
                            row[k] = extend(take(s), s) << left
                        k += 1
                else:
                    k = low
                    while k <= high and not ends:
                        rs = symbol(codes[0])
                        run, s = rs >> 4, rs & 15
                        new = 0
                        if s:
                            new = (1 if take(1) else -1) << left
                        elif run < 15:
                            ends = (1 << run) + take(run)
                            break
                        while k <= high:
                            if row[k]:
                                row[k] += (1 if row[k] > 0 else -1) * (take(1) << left)
                            else:
                                if run == 0:
                                    break
                                run -= 1
                            k += 1
                        if new and k <= high:
                            row[k] = new
                        k += 1
                    if ends:
                        while k <= high:
                            if row[k]:
                                row[k] += (1 if row[k] > 0 else -1) * (take(1) << left)
                            k += 1
                        ends -= 1
            first += n
    return out


TEXTS = ["", "a", "x" * 64, "y" * 65, "é漢😀" * 60, "\0" * 100, "".join(map(chr, range(1, 300))), "word " * 3000]


def encoded(texts):
    raw = [t.encode() for t in texts]
    return media.encode(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64))


def test_payloads_come_back_whole():
    files = encoded(TEXTS)
    images, coefficients, first = jpeg.read(files)
    for text, image, a, b in zip(TEXTS, images, first, first[1:]):
        n, raw = media.payload(image, coefficients[a:b])
        want = text.encode()
        assert n == len(want)
        assert raw == want + bytes(max(1, -(-len(want) // 64)) * 64 - len(want))


def test_decoder_agrees_with_a_plain_one():
    for file in encoded(TEXTS[:5]):
        assert np.array_equal(plain_decode(file), jpeg.read([file])[1])


class Bits:
    """A scan's bits, written one at a time by the format's rules."""

    def __init__(self, table):
        code, length = jpeg._codes(*table)
        self.codes, self.bits = {s: f"{code[s]:0{length[s]}b}" for s in range(256) if length[s]}, ""

    def put(self, symbol, extra=""):
        self.bits += self.codes[symbol] + extra

    def data(self):
        whole = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(whole[i : i + 8], 2) for i in range(0, len(whole), 8)).replace(b"\xff", b"\xff\0")


def hand_made(blocks, table, low=1, high=63):
    """A gray image of rows of coefficients: DC, a first AC scan without the last two bits,
    and two refinements in which coefficients become non-zero."""
    dc = Bits(jpeg._own_table(True))
    last = 0
    for row in blocks:
        diff = int(row[0]) - last
        size = abs(diff).bit_length()
        dc.put(size, f"{diff if diff >= 0 else diff + (1 << size) - 1:0{size}b}" if size else "")
        last = int(row[0])
    scans = [(0, 0, 0, 0, dc.data())]
    first = Bits(table)
    for row in blocks:
        run = 0
        shifted = [int(np.sign(v)) * (abs(int(v)) >> 2) for v in row]
        for k in range(low, high + 1):
            v = shifted[k]
            if not v:
                run += 1
                continue
            while run > 15:
                first.put(0xF0)
                run -= 16
            size = abs(v).bit_length()
            first.put(run << 4 | size, f"{v if v > 0 else v + (1 << size) - 1:0{size}b}")
            run = 0
        if run:
            first.put(0)
    scans.append((low, high, 0, 2, first.data()))
    for left in (1, 0):
        out, ended, waiting = Bits(table), 0, ""

        def end_run(out=out):
            nonlocal ended, waiting
            if ended:
                n = ended.bit_length() - 1
                out.put(n << 4, (f"{ended - (1 << n):0{n}b}" if n else "") + waiting)
            ended, waiting = 0, ""

        for row in blocks:
            size = [abs(int(v)) >> left for v in row]
            fresh = [k for k in range(low, high + 1) if size[k] == 1]
            run, corrections = 0, ""
            for k in range(low, high + 1):
                if size[k] > 1:
                    corrections += str(size[k] & 1)
                elif size[k] == 0 or k > (fresh[-1] if fresh else 0):
                    run += 1
                    if run == 16 and fresh and k < fresh[-1]:
                        end_run()
                        out.put(0xF0, corrections)
                        run, corrections = 0, ""
                else:
                    end_run()
                    out.put(run << 4 | 1, ("1" if row[k] > 0 else "0") + corrections)
                    run, corrections = 0, ""
            if run or corrections or not fresh:
                ended += 1
                waiting += corrections
        end_run()
        scans.append((low, high, left + 1, left, out.data()))
    segment = jpeg._segment
    tables = b"".join(bytes([kind << 4]) + t[0] + t[1] for kind, t in ((0, jpeg._own_table(True)), (1, table)))
    file = b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes([1] * 64)) + segment(0xC2, bytes([8, 0, 8, 0, 8 * len(blocks), 1, 1, 0x11, 0])) + segment(0xC4, tables)
    for a, b, sent, left, data in scans:
        file += segment(0xDA, bytes([1, 1, 0, a, b, sent << 4 | left])) + data
    return file + b"\xff\xd9"


def test_refinements_that_bring_new_coefficients():
    rng = np.random.default_rng(5)
    symbols = [run << 4 | size for run in range(16) for size in range(11) if size or run < 15 or run == 15]
    table = (bytes([0] * 8 + [len(symbols)] + [0] * 7), bytes(symbols))
    for density in (0.02, 0.15, 0.5, 1.0):
        blocks = rng.integers(-9, 10, (9, 64)) * (rng.random((9, 64)) < density)
        blocks[4, 1:] = 0  # blocks within a run of ended ones
        blocks[5, 1:] = np.where(rng.random(63) < 0.5, 8, 0)
        blocks[6, 1:] = 0
        file = hand_made(blocks, table)
        assert np.array_equal(plain_decode(file), blocks)
        assert np.array_equal(jpeg.read([file])[1], blocks)
    files = [hand_made(rng.integers(-3, 4, (5, 64)), table) for _ in range(3)]
    assert np.array_equal(jpeg.read(files)[1], np.concatenate([plain_decode(f) for f in files]))


def test_transform_and_colours():
    frame = jpeg.square_frame(6)
    blocks = np.zeros((6, 64), np.int32)
    blocks[:4, 0] = 8 * 50  # gray 178
    (file,) = jpeg.write([frame], blocks, [b""])
    images, coefficients, _ = jpeg.read([file])
    tensor = jpeg.rgb(images[0], jpeg.samples(images, coefficients))
    assert tensor.shape == (16, 16, 3) and (tensor == 178).all()
    x = np.arange(8)
    blocks[0, 1] = 100  # first horizontal wave
    (file,) = jpeg.write([frame], blocks, [b""])
    images, coefficients, _ = jpeg.read([file])
    wave = 178 + 100 * np.cos((2 * x + 1) * np.pi / 16) * 0.5 * np.sqrt(1 / 8)
    assert np.abs(jpeg.rgb(images[0], jpeg.samples(images, coefficients))[0, :8, 0] - wave).max() <= 1


def test_damage_is_found():
    (file,) = encoded(["some text that is long enough to have a few blocks" * 9])
    for bad in (file[:50], b"no image", file[: len(file) // 2] + b"\xff\xd9"):
        with pytest.raises(jpeg.BadJpeg):
            jpeg.read([bad])


def test_digests(spark, documents):
    docs = documents("same", "same", None, "", "z" * 200)
    rows = media.media_digests(docs.withColumnRenamed("lang", "media")).orderBy("doc_id").collect()
    assert rows[0][1:] == rows[1][1:] and rows[2][1:] == rows[3][1:]
    padded = b"z" * 200 + bytes(56)
    assert (rows[4].n_bytes, rows[4].payload_bytes) == (200, 256)
    assert rows[4].payload_sha256 == hashlib.sha256(padded).hexdigest()
    assert rows[4].tail_crc32 == zlib.crc32(padded[-64:])
    (file,) = encoded(["z" * 200])
    assert (rows[4].media_bytes, rows[4].media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    assert rows[4].height * rows[4].width * 3 == len(rows[4].rgb) and rows[4].feature.startswith(f"{rows[4].width}x{rows[4].height};")
    assert media.media_digests(docs.limit(0)).count() == 0
    mixed = docs.select(F.when(F.col("doc_id") == 4, media.stored(spark)("text")).alias("media"))
    digests = [r.d for r in mixed.select(media.digest(spark)("media").alias("d")).collect()]
    assert [d.n_bytes for d in digests].count(None) == 4 and rows[4].media_sha256 in {d.media_sha256 for d in digests}
    shapes = media.media_column(docs).select(media.tensors(spark)("media").alias("t")).select("t.*").collect()
    assert all(len(r.rgb) == r.height * r.width * 3 for r in shapes)
