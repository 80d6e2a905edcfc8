"""Progressive JPEG in numpy: whole batches of images advance together.

Entropy-coded data is sequential only between restart markers, so the restart intervals
of all images of a batch are lanes that decode in lockstep: each step reads one Huffman
symbol in every lane.  Spectral-selection and successive-approximation scans accumulate
in coefficient arrays; then all blocks are inverse-transformed by one matrix product,
chroma is upsampled, and images become full-resolution RGB tensors.

The writer stores given coefficients, so what it writes is read back without loss.
"""

from __future__ import annotations

import functools
import itertools
import struct
from dataclasses import dataclass, field

import numpy as np

from verdigris.llm._shared import ranges

#: Restart interval of written images: MCUs of an interleaved scan, blocks of another.
INTERVAL = 8
#: Scans of a written image: (components, first and last coefficient, bits already
#: sent, bits left out).  None of the refinements meets a coefficient of magnitude 1.
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    *(((c,), 1, 5, 0, 1) for c in range(3)),
    *(((c,), 6, 63, 0, 1) for c in range(3)),
    ((0, 1, 2), 0, 0, 1, 0),
    *(((c,), 1, 63, 1, 0) for c in range(3)),
)


class BadJpeg(ValueError):
    """The bytes are no progressive JPEG that this decoder reads."""


@functools.cache
def zigzag() -> np.ndarray:
    """Raster place of the k-th coefficient: diagonals, alternately up and down."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


@functools.cache
def _inverse_transform() -> np.ndarray:
    """Matrix that takes 64 zigzag coefficients to 64 samples in raster order."""
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    full = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return full[zigzag()]


# -------------------------------------------------------------------- Huffman tables


@functools.cache
def _own_table(dc: bool) -> tuple[bytes, bytes]:
    """Code lengths (count of each of 1..16) and symbols that the writer uses."""
    if dc:
        return bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12))
    # Small coefficients without a run, the end of a block, and larger ones.
    return bytes([1, 1, 1, 0, 2, 1, 1, 1, 1, 1, 1] + [0] * 5), bytes([1, 2, 3, 4, 0, 5, 6, 7, 8, 9, 10])


def _codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol (0 where it has none): the canonical code."""
    code_of, length_of = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code, at = 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            code_of[symbols[at]], length_of[symbols[at]] = code, length
            code, at = code + 1, at + 1
        code <<= 1
    return code_of, length_of


@functools.lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length by the next 16 bits; length 0 where no code fits."""
    code_of, length_of = _codes(counts, symbols)
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s in np.flatnonzero(length_of):
        low = int(code_of[s]) << (16 - int(length_of[s]))
        symbol[low : low + (1 << (16 - int(length_of[s])))], length[low : low + (1 << (16 - int(length_of[s])))] = s, length_of[s]
    return symbol, length


# --------------------------------------------------------------------------- geometry


@dataclass
class Frame:
    width: int
    height: int
    sampling: tuple[tuple[int, int], ...]  # horizontal and vertical factor of each component
    quant: tuple[int, ...] = ()

    @property
    def mcus(self) -> tuple[int, int]:
        """Rows and columns of MCUs."""
        h, v = max(s[0] for s in self.sampling), max(s[1] for s in self.sampling)
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))

    def grid(self, component: int) -> tuple[int, int, int]:
        """First block, rows and columns of a component's stored blocks."""
        rows, columns = self.mcus
        first = sum(rows * columns * h * v for h, v in self.sampling[:component])
        return first, rows * self.sampling[component][1], columns * self.sampling[component][0]

    @property
    def blocks(self) -> int:
        rows, columns = self.mcus
        return rows * columns * sum(h * v for h, v in self.sampling)

    def order(self, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of a scan in coding order (MCU, block of the MCU), and each one's component."""
        if len(components) == 1:
            first, _, stride = self.grid(components[0])
            h, v = self.sampling[components[0]]
            high, wide = max(s[1] for s in self.sampling), max(s[0] for s in self.sampling)
            rows, columns = -(-(-(-self.height * v // high)) // 8), -(-(-(-self.width * h // wide)) // 8)
            blocks = first + (np.arange(rows)[:, None] * stride + np.arange(columns)).reshape(-1, 1)
            return blocks, np.full(1, components[0])
        rows, columns = self.mcus
        parts, owner = [], []
        for c in components:
            first, _, stride = self.grid(c)
            h, v = self.sampling[c]
            for y in range(v):
                for x in range(h):
                    parts.append(first + (np.arange(rows)[:, None] * v + y) * stride + np.arange(columns) * h + x)
                    owner.append(c)
        return np.stack([p.reshape(-1) for p in parts], 1), np.array(owner)


def square_frame(blocks: int) -> Frame:
    """A nearly square 4:2:0 frame with room for so many blocks (six per MCU)."""
    mcus = max(1, -(-blocks // 6))
    columns = int(np.ceil(np.sqrt(mcus)))
    return Frame(16 * columns, 16 * -(-mcus // columns), ((2, 2), (1, 1), (1, 1)), (0, 0, 0))


@functools.lru_cache(256)
def _lanes(width: int, height: int, sampling: tuple, components: tuple[int, ...], interval: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of a scan in coding order, each one's component, blocks of each interval."""
    blocks, owner = Frame(width, height, sampling).order(components)
    per = interval or len(blocks)
    sizes = np.full(-(-len(blocks) // per), per)
    sizes[-1] = len(blocks) - per * (len(sizes) - 1)
    return blocks.reshape(-1), np.tile(owner, len(blocks)), sizes * blocks.shape[1]


# ---------------------------------------------------------------------------- writing


#: Bits of each magnitude up to 4095.
_SIZE = np.array([n.bit_length() for n in range(4096)])


def _bits(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(values < 0, values + (1 << size) - 1, values)


def _pack(value: np.ndarray, bits: np.ndarray, lane: np.ndarray, n_lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (up to 32 bits, by lane in order) as bytes padded with ones; bytes per lane."""
    ends = np.cumsum(bits)
    cut = np.searchsorted(lane, np.arange(n_lanes + 1))
    before = np.concatenate([[0], ends])[cut]
    length = np.diff(before)
    size = -(-length // 8)
    first = np.cumsum(size) - size
    at = ends - bits + np.repeat(8 * first - before[:-1], np.diff(cut))
    total = int(size.sum())
    pad, last = 8 * size - length, 8 * first + length
    words = np.zeros(total // 4 + 3, np.uint64)
    for v, n, place in ((value, bits, at), ((1 << pad) - 1, pad, last)):
        some = n > 0
        if not some.all():
            v, n, place = v[some], n[some], place[some]
        word = place >> 5
        wide = v.astype(np.uint64) << (64 - n - (place & 31)).astype(np.uint64)
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        if len(heads):
            words[word[heads]] |= np.bitwise_or.reduceat(wide >> np.uint64(32), heads)
            words[word[heads] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), heads)
    return words.astype(">u4").view(np.uint8)[:total], size


def _marked(data: np.ndarray, size: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`data` with a zero byte after each 0xFF and a restart marker after each lane; where
    the lanes end (behind the marker).  `counter` numbers the lanes of each scan."""
    full = data == 0xFF
    lane = np.repeat(np.arange(len(size)), size)
    shift = np.cumsum(full) - full + 2 * lane
    place = np.arange(len(data)) + shift
    ends = np.cumsum(size + np.bincount(lane[full], minlength=len(size)) + 2)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[place] = data
    out[ends - 2], out[ends - 1] = 0xFF, 0xD0 + counter % 8
    return out, ends


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(frame: Frame, comment: bytes) -> bytes:
    dht = b"".join(bytes([kind << 4]) + counts + symbols for kind in (0, 1) for counts, symbols in [_own_table(kind == 0)])
    sof = struct.pack(">BHHB", 8, frame.height, frame.width, len(frame.sampling)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(frame.sampling))
    return b"\xff\xd8" + _segment(0xFE, comment) + _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC2, sof) + _segment(0xC4, dht) + _segment(0xDD, struct.pack(">H", INTERVAL))


def write(frames: list[Frame], coefficients: np.ndarray, comments: list[bytes]) -> list[bytes]:
    """JPEG files of images whose blocks (zigzag order, quantiser 1) lie end to end.

    Every block is zero throughout or free of the values -1, 0 and 1 (but for its DC).
    """
    first = np.cumsum([0, *(f.blocks for f in frames)])
    parts: list[list[bytes]] = [[_head(f, c)] for f, c in zip(frames, comments, strict=True)]
    for (low, high, sent, left), scans in itertools.groupby(SCRIPT, key=lambda s: s[1:]):
        group = [components for components, *_ in scans]
        for components in [group] if low else [[c] for c in group]:
            _write_scans(frames, coefficients, first, parts, components, low, high, sent, left)
    return [b"".join(p) + b"\xff\xd9" for p in parts]


def _write_scans(frames: list[Frame], coefficients: np.ndarray, first: np.ndarray, parts: list[list[bytes]], scans: list[tuple[int, ...]], low: int, high: int, sent: int, left: int) -> None:
    """Code scans of the same kind of all images together and append them to `parts`."""
    layout = [_lanes(f.width, f.height, f.sampling, c, INTERVAL) for f in frames for c in scans]
    base = np.repeat(first[:-1], len(scans))
    blocks = np.concatenate([b + at for (b, _, _), at in zip(layout, base, strict=True)])
    sizes = np.concatenate([s for _, _, s in layout])
    lane = np.repeat(np.arange(len(sizes)), sizes)
    own = coefficients[blocks, low : high + 1]
    if low == 0:
        value = own[:, 0] >> left
        if sent:
            code, bits = value & 1, np.ones(len(own), np.int64)
        else:
            owner = np.concatenate([o for _, o, _ in layout])
            diff = value.copy()
            for c in scans[0]:
                mine = np.flatnonzero(owner == c)
                diff[mine[1:]] -= np.where(lane[mine[1:]] == lane[mine[:-1]], value[mine[:-1]], 0)
            code, bits = _coded(diff, *_codes(*_own_table(True)))
        of = lane
    else:
        code, bits, of = _ac_codes(own, lane, sent, left)
    counter = np.concatenate([np.arange(len(s)) for _, _, s in layout])
    data, ends = _marked(*_pack(code, bits, of, len(sizes)), counter)
    raw = data.tobytes()
    cuts = ends[np.cumsum([len(s) for _, _, s in layout]) - 1].tolist()
    here = 0
    for number, cut in enumerate(cuts):
        image, c = divmod(number, len(scans))
        sos = bytes([len(scans[c]), *(x for i in scans[c] for x in (i + 1, 0)), low, high, sent << 4 | left])
        parts[image] += [_segment(0xDA, sos), raw[here : cut - 2]]
        here = cut


def _coded(values: np.ndarray, code_of: np.ndarray, length_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each value's size with its magnitude bits behind, and how many bits that is."""
    n = _SIZE[np.abs(values)]
    return code_of[n] << n | _bits(values, n), length_of[n] + n


def _ac_codes(own: np.ndarray, lane: np.ndarray, sent: int, left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, lengths and lanes of an AC scan's blocks (rows), several coefficients in one."""
    ac_code, ac_length = _codes(*_own_table(False))
    full = own[:, 0] != 0
    rows, width = own[full], own.shape[1]
    if sent:  # an end of block, and then a correction bit of every coefficient
        runs = [slice(a, min(width, a + 24)) for a in range(0, width, 24)]
        bit = np.abs(rows) >> left & 1
        some = [bit[:, r] @ (1 << np.arange(r.stop - r.start)[::-1]) for r in runs]
        code = np.stack([np.full(len(rows), ac_code[0]), *some], 1)
        bits = np.broadcast_to(np.array([ac_length[0], *(r.stop - r.start for r in runs)]), code.shape)
    else:
        code, bits = _coded(np.sign(rows) * (np.abs(rows) >> left), ac_code, ac_length)
        even = width // 2 * 2
        pair = code[:, 0:even:2] << bits[:, 1:even:2] | code[:, 1:even:2], bits[:, 0:even:2] + bits[:, 1:even:2]
        code, bits = np.concatenate([pair[0], code[:, even:]], 1), np.concatenate([pair[1], bits[:, even:]], 1)
    many = np.where(full, code.shape[1], 1)
    all_code, all_bits = np.full(int(many.sum()), ac_code[0]), np.full(int(many.sum()), ac_length[0])
    place = ranges((np.cumsum(many) - many)[full], many[full])
    all_code[place], all_bits[place] = code.reshape(-1), bits.reshape(-1)
    return all_code, all_bits, np.repeat(lane, many)


# ---------------------------------------------------------------------------- reading


@dataclass
class _Scan:
    kind: tuple  # what must be equal for scans to advance together
    frame: Frame
    components: tuple[int, ...]
    interval: int
    begin: int
    end: int


@dataclass
class Image:
    frame: Frame
    tables: dict[int, np.ndarray]
    comment: bytes
    scans: list[_Scan] = field(default_factory=list)


def parse(file: bytes) -> Image:
    """Walk the markers of a file."""
    if file[:2] != b"\xff\xd8":
        raise BadJpeg("no start of image")
    data = np.frombuffer(file, np.uint8)
    full = np.flatnonzero(data[:-1] == 0xFF)
    nxt = data[full + 1]
    markers = full[(nxt != 0) & (nxt != 0xFF) & ((nxt < 0xD0) | (nxt > 0xD7))]
    huffman: dict[int, tuple[bytes, bytes]] = {}
    quant: dict[int, np.ndarray] = {}
    frame, comment, interval, ids, scans = None, b"", 0, [], []
    at = 2
    try:
        while True:
            while file[at + 1] == 0xFF:
                at += 1
            marker = file[at + 1]
            if file[at] != 0xFF:
                raise BadJpeg("a marker is missing")
            if marker == 0xD9:
                break
            (size,) = struct.unpack_from(">H", file, at + 2)
            body, at = file[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC2:
                precision, height, width, n = struct.unpack_from(">BHHB", body)
                if precision != 8 or not width or not height or n not in (1, 3):
                    raise BadJpeg("only 8-bit images of one or three components are read")
                ids = [body[6 + 3 * i] for i in range(n)]
                sampling = tuple((body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n))
                frame = Frame(width, height, sampling if n > 1 else ((1, 1),), tuple(body[8 + 3 * i] for i in range(n)))
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)) and marker != 0xCC:
                raise BadJpeg("not a progressive Huffman-coded image")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                (interval,) = struct.unpack(">H", body)
            elif marker == 0xFE:
                comment = body
            elif marker == 0xDA:
                if frame is None:
                    raise BadJpeg("a scan comes before the frame")
                n = body[0]
                components = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
                low, high, sent, left = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
                if high > 63 or low > high or (low == 0) != (high == 0) or (low and n > 1):
                    raise BadJpeg("a scan's range is wrong")
                tables = tuple(huffman.get((16 if low else 0) + (body[2 + 2 * i] & 15 if low else body[2 + 2 * i] >> 4), (b"", b"")) for i in range(n)) if not (low == 0 and sent) else ()
                end = int(markers[np.searchsorted(markers, at)])
                scans.append(_Scan((low, high, sent, left, tables, () if low else components), frame, components, interval, at, end))
                at = end
    except (IndexError, ValueError, struct.error, KeyError) as error:
        if isinstance(error, BadJpeg):
            raise
        raise BadJpeg(f"the file is cut or damaged: {error}") from error
    if frame is None:
        raise BadJpeg("no frame")
    return Image(frame, quant, comment, scans)


class _Reader:
    """Bits of many lanes in one buffer."""

    def __init__(self, data: np.ndarray) -> None:
        padded = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.int64)
        self.window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
        self.last = len(self.window) - 1

    def peek(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """The next n (up to 25) bits of each place."""
        return self.window[np.minimum(at >> 3, self.last)] >> (32 - (at & 7) - n) & (1 << n) - 1


def _entropy(files: np.ndarray, scans: list[_Scan], base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scan data without stuffing and markers, where each interval begins, intervals per scan."""
    begin = np.array([s.begin for s in scans]) + base
    size = np.array([s.end - s.begin for s in scans])
    data = files[ranges(begin, size)]
    owner = np.repeat(np.arange(len(scans)), size)
    after = np.concatenate([[False], data[:-1] == 0xFF]) & np.concatenate([[False], owner[1:] == owner[:-1]])
    restart = after & (data >= 0xD0) & (data <= 0xD7)
    drop = after & (data == 0) | restart | np.concatenate([restart[1:], [False]])
    kept = np.cumsum(~drop)
    starts = np.sort(np.concatenate([np.cumsum(size) - size, np.flatnonzero(restart) + 1]))
    place = np.concatenate([[0], kept])[np.minimum(starts, len(data))]
    return data[~drop], place, 1 + np.bincount(owner[restart], minlength=len(scans))


def _dc(reader: _Reader, kind: tuple, at: np.ndarray, first: np.ndarray, sizes: np.ndarray, owner: np.ndarray, blocks: np.ndarray, coefficients: np.ndarray) -> None:
    _, _, sent, left, tables, components = kind
    if sent:
        lane = np.repeat(np.arange(len(sizes)), sizes)
        bit = reader.peek(at[lane] + np.arange(len(blocks)) - first[lane], 1)
        coefficients[blocks, 0] |= (bit << left).astype(coefficients.dtype)
        return
    looks = {c: _lookup(*t) for c, t in zip(components, tables, strict=True)}
    diff, at = np.zeros(len(blocks), np.int64), at.copy()
    for step in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > step)
        place = first[on] + step
        bits = reader.peek(at[on], 16)
        symbol, length = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64)
        for c in components:
            mine = owner[place] == c
            symbol[mine], length[mine] = looks[c][0][bits[mine]], looks[c][1][bits[mine]]
        if not length.all() or symbol.max(initial=0) > 15:
            raise BadJpeg("no code fits")
        here = at[on] + length
        extra = reader.peek(here, symbol)
        diff[place] = np.where(extra < (1 << symbol) >> 1, extra - (1 << symbol) + 1, extra)
        at[on] = here + symbol
    lane = np.repeat(np.arange(len(sizes)), sizes)
    for c in components:
        mine = np.flatnonzero(owner == c)
        run = np.cumsum(diff[mine])
        starts = np.concatenate([[True], lane[mine[1:]] != lane[mine[:-1]]]) if len(mine) else np.zeros(0, bool)
        before = (run - diff[mine])[starts]
        coefficients[blocks[mine], 0] = (run - before[np.cumsum(starts) - 1]) << left


def _ac_first(reader: _Reader, kind: tuple, at: np.ndarray, first: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, coefficients: np.ndarray) -> None:
    low, high, _, left, tables, _ = kind
    symbols, lengths = _lookup(*tables[0])
    at, block, last = at.copy(), first.copy(), first + sizes
    k = np.full(len(at), low)
    flat = coefficients.reshape(-1)
    base = blocks * 64
    alive = np.flatnonzero(block < last)
    at, block, last, k = at[alive], block[alive], last[alive], k[alive]
    while len(at):
        bits = reader.peek(at, 16)
        symbol, length = symbols[bits], lengths[bits]
        if not length.all():
            raise BadJpeg("no code fits")
        run, size = symbol >> 4, symbol & 15
        at = at + length
        some = size > 0
        n = np.where(some, size, np.where(run < 15, run, 0))
        extra = reader.peek(at, n)
        at += n
        k = k + np.where(some | (run == 15), run, 0)
        value = np.where(extra < (1 << n) >> 1, extra - (1 << n) + 1, extra) << left
        if some.all():
            flat[base[block] + np.minimum(k, 63)] = value
        else:
            w = np.flatnonzero(some)
            flat[base[block[w]] + np.minimum(k[w], 63)] = value[w]
        if (k[some] > high).any():
            raise BadJpeg("a run leaves the block")
        k += 1  # past the coefficient, or the sixteenth zero
        ended = ~some & (run < 15)
        over = ended | (k > high)
        block = block + np.where(ended, (1 << n) + extra, over)
        k = np.where(over, low, k)
        if over.any() and (block >= last).any():
            go = block < last
            at, block, last, k = at[go], block[go], last[go], k[go]


def _ac_refine(reader: _Reader, kind: tuple, at: np.ndarray, first: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, coefficients: np.ndarray) -> None:
    low, high, _, left, tables, _ = kind
    symbols, lengths = _lookup(*tables[0])
    band = np.arange(low, high + 1)
    at, block, last = at.copy(), first.copy(), first + sizes
    k, ends = np.full(len(at), low), np.zeros(len(at), np.int64)
    while len(at):
        fresh = ends == 0  # lanes that are not within a run of ended blocks read a symbol
        bits = reader.peek(at, 16)
        symbol, length = symbols[bits], lengths[bits]
        if not length[fresh].all():
            raise BadJpeg("no code fits")
        run, size = symbol >> 4, symbol & 15
        at = at + np.where(fresh, length, 0)
        ended = fresh & (size == 0) & (run < 15)
        n = np.where(ended, run, np.where(fresh & (size > 0), 1, 0))
        extra = reader.peek(at, n)
        at = at + n
        ends = np.where(ended, (1 << np.where(ended, run, 0)) + extra, ends)
        new = fresh & (size > 0)
        rows = coefficients[blocks[block], low : high + 1]
        ahead = band >= k[:, None]
        old = (rows != 0) & ahead
        if (ends > 0).all():
            stop = np.full(len(at), high + 1)
            touched = old
        else:
            zeros = np.cumsum(ahead & (rows == 0), axis=1)
            reached = zeros > run[:, None]
            stop = np.where(ends > 0, high + 1, np.where(reached.any(1), low + reached.argmax(1), high + 1))
            touched = old & (band < stop[:, None])
            if (new & (stop > high)).any():
                raise BadJpeg("a run leaves the block")
        many = np.cumsum(touched, axis=1, dtype=np.int64)
        correction = reader.peek(at[:, None] + many - 1, 1) * touched
        rows = rows + (np.sign(rows) * correction << left).astype(rows.dtype)
        at = at + many[:, -1]
        w = np.flatnonzero(new)
        rows[w, stop[w] - low] = np.where(extra[w] == 1, 1 << left, -(1 << left))
        coefficients[blocks[block], low : high + 1] = rows
        k = stop + 1
        over = k > high
        ends = np.where(ends > 0, ends - 1, ends)
        block, k = block + over, np.where(over, low, k)
        if (block >= last).any():
            go = block < last
            at, block, last, k, ends = at[go], block[go], last[go], k[go], ends[go]


def read(files: list[bytes]) -> tuple[list[Image], np.ndarray, np.ndarray]:
    """Images, their coefficients (zigzag order, blocks end to end) and first blocks."""
    images = [parse(f) for f in files]
    first = np.cumsum([0, *(i.frame.blocks for i in images)])
    coefficients = np.zeros((int(first[-1]), 64), np.int32)
    base = np.cumsum([0, *map(len, files)])
    whole = np.frombuffer(b"".join(files), np.uint8)
    rounds = [_rounds(i.scans) for i in images]
    for number in range(max(map(len, rounds), default=0)):
        together: dict[tuple, list[tuple[int, _Scan]]] = {}
        for at, own in enumerate(rounds):
            if number < len(own):
                together.setdefault(own[number][0].kind, []).extend((at, s) for s in own[number])
        for kind, members in together.items():
            scans, of = [s for _, s in members], np.array([m for m, _ in members])
            data, begin, intervals = _entropy(whole, scans, base[of])
            layout = [_lanes(s.frame.width, s.frame.height, s.frame.sampling, s.components, s.interval) for s in scans]
            sizes = np.concatenate([x[2] for x in layout])
            if not np.array_equal(intervals, [len(x[2]) for x in layout]):
                raise BadJpeg("restart markers are missing")
            blocks = np.concatenate([x[0] + first[m] for x, m in zip(layout, of, strict=True)])
            reader, starts = _Reader(data), np.cumsum(sizes) - sizes
            if kind[0] == 0:
                _dc(reader, kind, 8 * begin, starts, sizes, np.concatenate([x[1] for x in layout]), blocks, coefficients)
            else:
                (_ac_refine if kind[2] else _ac_first)(reader, kind, 8 * begin, starts, sizes, blocks, coefficients)
    return images, coefficients, first


def _rounds(scans: list[_Scan]) -> list[list[_Scan]]:
    """Consecutive AC scans of one kind over different components, which are independent."""
    found: list[list[_Scan]] = []
    for scan in scans:
        if found and scan.kind[0] and found[-1][0].kind == scan.kind and all(scan.components != s.components for s in found[-1]):
            found[-1].append(scan)
        else:
            found.append([scan])
    return found


def samples(images: list[Image], coefficients: np.ndarray) -> np.ndarray:
    """The samples (0 to 255) of all blocks: dequantised and inverse-transformed at once."""
    tables = [np.concatenate([np.broadcast_to(i.tables[q], (grid[1] * grid[2], 64)) for q, grid in ((q, i.frame.grid(c)) for c, q in enumerate(i.frame.quant))]) for i in images if any((i.tables[q] != 1).any() for q in set(i.frame.quant))]
    if tables and len(tables) < len(images):
        return np.concatenate([samples([i], coefficients[a : a + i.frame.blocks]) for i, a in zip(images, np.cumsum([0, *(i.frame.blocks for i in images)]).tolist()[:-1], strict=True)])
    scaled = coefficients * np.concatenate(tables) if tables else coefficients.astype(np.float64)
    out = scaled @ _inverse_transform()
    # The tiny shift takes exact halves away from the border, so equal images give equal
    # samples whatever the order of summation in the product.
    out += 128.5 + 1e-6
    np.floor(out, out=out)
    return np.clip(out, 0, 255, out=out).astype(np.float32)


def rgb(image: Image, own: np.ndarray) -> np.ndarray:
    """Full-resolution (height, width, 3) tensor of one image from its blocks' samples."""
    frame, planes = image.frame, []
    wide, high = max(s[0] for s in frame.sampling), max(s[1] for s in frame.sampling)
    for c, (h, v) in enumerate(frame.sampling):
        first, rows, columns = frame.grid(c)
        plane = own[first : first + rows * columns].reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(8 * rows, 8 * columns)
        plane = np.repeat(np.repeat(plane, high // v, 0), wide // h, 1)
        planes.append(plane[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for channel, value in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        out[:, :, channel] = np.clip(np.floor(value + np.float32(0.5)), 0, 255)
    return out
