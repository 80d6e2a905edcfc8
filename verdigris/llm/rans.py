"""Token files: tokenizer ids in a static range asymmetric numeral system (rANS).

A segment is one self-contained file image: a header, the documents' ids and lengths,
one frequency table that all its blocks share, and blocks of BLOCK ids.  A block has
LANES interleaved coders; lane l codes ids l, l + LANES, ...  Blocks are independent:
each has a checkpoint (where its words begin, the lanes' states) and a checksum, so any
of them can be decoded alone, and here all blocks and lanes advance together in numpy.

Segments are rows of a Parquet table in the shared folder, written by Spark's committer
in ascending doc_id order, so a lost executor's part is written again and never seen
twice.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.llm._shared import bounded_batches, byte_slices, ranges, store

#: Ids of a block, coders of a block, blocks that advance together.
BLOCK, LANES, TOGETHER = 1 << 14, 64, 64
#: Frequencies sum to 2^PRECISION; states stay in [2^31, 2^63) and move 32 bits at once.
PRECISION = 20
_LOW = np.uint64(1 << 31)
#: Ids after which a segment is closed (at a document's end).
SEGMENT = 1 << 19
END_ID = 1
_MAGIC = b"VRNS\x01"
_HEAD = struct.Struct("<5sqqqqqq")  # magic, documents, ids, blocks, bytes of the tables, of the checkpoints, of the words


class CorruptSegment(ValueError):
    """A checksum of a segment does not hold."""


# ----------------------------------------------------------------------- rANS


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2^PRECISION, at least 1 for what occurs; ties by place."""
    whole = 1 << PRECISION
    if len(counts) > whole:
        raise ValueError("more distinct ids than the precision has room for")
    share = counts / counts.sum() * whole
    scaled = np.maximum(1, np.floor(share).astype(np.int64))
    missing = whole - int(scaled.sum())
    if missing > 0:
        scaled[int(np.argmax(counts))] += missing
    while missing < 0:  # take back from the most frequent, a little from each
        able = np.argsort(-scaled, kind="stable")
        able = able[scaled[able] > 1][: max(1, -missing)]
        cut = np.minimum(scaled[able] - 1, max(1, -missing // len(able)))
        cut[np.cumsum(cut) > -missing] = 0
        cut[0] = max(cut[0], 1)
        scaled[able] -= cut
        missing = whole - int(scaled.sum())
    return scaled


def _grid(n: int, blocks: int) -> np.ndarray:
    """Which (block, step, lane) of the full grid hold an id."""
    return (np.arange(blocks * BLOCK) < n).reshape(blocks, BLOCK // LANES, LANES)


def _encode_blocks(symbols: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Final states (block, lane) and each block's words in decoding order."""
    n, blocks = len(symbols), -(-len(symbols) // BLOCK)
    held = _grid(n, blocks)
    grid = np.zeros(blocks * BLOCK, np.int64)
    grid[:n] = symbols
    grid = grid.reshape(held.shape)
    state = np.full((blocks, LANES), _LOW, np.uint64)
    words, emitted = np.zeros(held.shape, np.uint32), np.zeros(held.shape, bool)
    for step in range(held.shape[1] - 1, -1, -1):
        on = held[:, step]
        if not on.any():
            continue
        f, c = freq[grid[:, step]], start[grid[:, step]]
        full = on & (state >= f << np.uint64(63 - PRECISION))
        words[:, step], emitted[:, step] = (state & np.uint64(0xFFFFFFFF)).astype(np.uint32), full
        x = np.where(full, state >> np.uint64(32), state)
        state = np.where(on, (x // f << np.uint64(PRECISION)) + x % f + c, state)
    return state, [words[b][emitted[b]] for b in range(blocks)]


def _decode_blocks(n: int, state: np.ndarray, words: np.ndarray, begin: np.ndarray, freq: np.ndarray, start: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The n symbols of consecutive blocks whose words begin at `begin`."""
    blocks = len(state)
    held = _grid(n, blocks)
    out = np.zeros(held.shape, np.int32)
    mask, at = np.uint64((1 << PRECISION) - 1), begin.astype(np.int64).copy()
    padded = np.append(words, np.zeros(1, np.uint32)).astype(np.uint64)
    state = state.copy()
    for step in range(held.shape[1]):
        on = held[:, step]
        if not on.any():
            break
        slot = (state & mask).astype(np.int64)
        symbol = slots[slot]
        out[:, step] = symbol
        x = freq[symbol] * (state >> np.uint64(PRECISION)) + slot.astype(np.uint64) - start[symbol]
        need = on & (x < _LOW)
        order = np.cumsum(need, axis=1)
        word = padded[np.where(need, at[:, None] + order - 1, len(words))]
        state = np.where(on, np.where(need, x << np.uint64(32) | word, x), state)
        at += order[:, -1]
    return out.reshape(-1)[:n]


@dataclass
class Segment:
    doc_ids: np.ndarray
    known: np.ndarray  # False where the doc_id is null
    counts: np.ndarray
    ids: np.ndarray


def pack(segment: Segment) -> bytes:
    """The file image of a segment."""
    ids = np.asarray(segment.ids, np.int32)
    counts = np.bincount(ids)
    names = np.flatnonzero(counts)
    number = np.zeros(len(counts), np.int32)
    number[names] = np.arange(len(names))
    symbols = number[ids]
    freq = frequencies(counts[names]) if len(ids) else np.zeros(0, np.int64)
    start = np.cumsum(freq) - freq
    tables = zlib.compress(np.concatenate([[len(names)], np.diff(names, prepend=0), freq]).astype("<u4").tobytes(), 6)
    listing = zlib.compress(np.asarray(segment.doc_ids, "<i8").tobytes() + np.asarray(segment.known, np.uint8).tobytes() + np.asarray(segment.counts, "<i8").tobytes(), 6)
    states, words = [], []
    for a in range(0, len(ids), BLOCK * TOGETHER):
        s, w = _encode_blocks(symbols[a : a + BLOCK * TOGETHER], freq.astype(np.uint64), start.astype(np.uint64))
        states.append(s)
        words += w
    body = [w.astype("<u4").tobytes() for w in words]
    offsets = np.cumsum([0, *map(len, body)])
    sums = np.array([zlib.crc32(b) for b in body], "<u4")
    checkpoints = offsets.astype("<i8").tobytes() + sums.tobytes() + (np.concatenate(states).astype("<u8").tobytes() if states else b"")
    data = struct.pack("<q", len(listing)) + listing + tables
    head = _HEAD.pack(_MAGIC, len(segment.counts), len(ids), len(body), len(data), len(checkpoints), int(offsets[-1]))
    front = head + data + checkpoints
    return front + struct.pack("<I", zlib.crc32(front)) + b"".join(body)


def unpack(image: bytes, check: bool = True) -> Segment:
    """Decode a file image; CorruptSegment if a checksum fails."""
    magic, docs, n, blocks, data_size, point_size, body_size = _HEAD.unpack_from(image)
    front = _HEAD.size + data_size + point_size
    if magic != _MAGIC or len(image) != front + 4 + body_size or zlib.crc32(image[:front]) != struct.unpack_from("<I", image, front)[0]:
        raise CorruptSegment("the header or a table is damaged")
    (listing_size,) = struct.unpack_from("<q", image, _HEAD.size)
    at = _HEAD.size + 8
    listing = zlib.decompress(image[at : at + listing_size])
    doc_ids, known, counts = np.frombuffer(listing, "<i8", docs), np.frombuffer(listing, np.uint8, docs, 8 * docs), np.frombuffer(listing, "<i8", docs, 9 * docs)
    table = np.frombuffer(zlib.decompress(image[at + listing_size : _HEAD.size + data_size]), "<u4").astype(np.int64)
    names, freq = np.cumsum(table[1 : 1 + table[0]]), table[1 + table[0] :]
    slots = np.repeat(np.arange(len(names), dtype=np.int32), freq)
    point = _HEAD.size + data_size
    offsets = np.frombuffer(image, "<i8", blocks + 1, point)
    sums = np.frombuffer(image, "<u4", blocks, point + 8 * (blocks + 1))
    states = np.frombuffer(image, "<u8", blocks * LANES, point + 8 * (blocks + 1) + 4 * blocks).reshape(blocks, LANES)
    body = memoryview(image)[front + 4 :]
    if check and any(zlib.crc32(body[a:b]) != s for a, b, s in zip(offsets[:-1], offsets[1:], sums, strict=True)):
        raise CorruptSegment("a block is damaged")
    words = np.frombuffer(body, "<u4")
    parts, f, c = [np.zeros(0, np.int64)], freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    for a in range(0, blocks, TOGETHER):
        b = min(blocks, a + TOGETHER)
        symbols = _decode_blocks(min(n, b * BLOCK) - a * BLOCK, states[a:b], words, offsets[a:b] // 4, f, c, slots)
        parts.append(names[symbols])
    return Segment(doc_ids, known.astype(bool), counts, np.concatenate(parts))


# ------------------------------------------------------------------ tokenising


class _Growing:
    """An array that grows at its end."""

    def __init__(self, values: np.ndarray | None = None) -> None:
        self._data, self._n = np.zeros(1 << 16, np.int32), 0
        if values is not None:
            self.extend(values)

    def extend(self, values: np.ndarray) -> None:
        need = self._n + len(values)
        if need > len(self._data):
            self._data = np.concatenate([self._data, np.zeros(max(need, len(self._data) // 2), np.int32)])
        self._data[self._n : need] = values
        self._n = need

    @property
    def values(self) -> np.ndarray:
        return self._data[: self._n]


#: A word of plain letters with punctuation after it: the pre-tokenizer parts the two,
#: and its lower-casing is that of every library.
_PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,;:!?|]*)$"


class WordEncoder:
    """A tokenizer that drops white space and case, applied to distinct words.

    Its pre-tokenizer never joins text across white space, nor letters and punctuation,
    so a text's ids are those of its parts one after another.  Parts met before are
    remembered, up to a bound and one batch more; new plain words are encoded many at a time.
    """

    REMEMBERED, TOGETHER, LEARNED = 1 << 19, 200, 1 << 14

    def __init__(self, definition: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for every core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(definition)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        # The parts of each kind and their numbers; part i has ids begin[i], ..., begin[i] + size[i] - 1.
        self._known = {kind: pa.array([""], pa.string()) for kind in ("word", "tail", "odd")}
        self._number = {kind: _Growing(np.zeros(1)) for kind in self._known}
        self._begin, self._size, self._ids = _Growing(np.zeros(1)), _Growing(np.zeros(1)), _Growing()

    def _learn(self, parts: pa.Array, plain: bool) -> None:
        """Encode the new distinct parts and remember their ids."""
        fresh, sizes, ids = parts.to_pylist(), None, None
        if plain:
            texts = [" ".join(fresh[i : i + self.TOGETHER]) for i in range(0, len(fresh), self.TOGETHER)]
            ids = np.concatenate([np.array(e.ids, np.int64) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            last = np.flatnonzero(self._ends[ids])
            if len(last) == len(fresh) and last[-1] == len(ids) - 1:
                sizes = np.diff(last, prepend=-1)
        if sizes is None:
            each = [e.ids for e in self._tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
            sizes, ids = np.array([len(e) for e in each], np.int64), np.array([i for e in each for i in e], np.int64)
        first = len(self._ids.values)
        self._begin.extend(first + np.cumsum(sizes) - sizes)
        self._size.extend(sizes)
        self._ids.extend(ids)

    def _places(self, parts: pa.Array, kind: str) -> np.ndarray:
        """Where the distinct parts are remembered; new ones are encoded first."""
        at = pc.index_in(parts, value_set=self._known[kind])
        new = parts.filter(pc.is_null(at))
        place = self._number[kind].values[pc.fill_null(at, 0).to_numpy(zero_copy_only=False)]
        if len(new):
            numbers = len(self._size.values) + np.arange(len(new))
            place[pc.is_null(at).to_numpy(zero_copy_only=False)] = numbers
            for a in range(0, len(new), self.LEARNED):
                self._learn(new[a : a + self.LEARNED], kind == "word")
            self._known[kind] = pa.concat_arrays([self._known[kind], new])
            self._number[kind].extend(numbers)
        return place

    def encode(self, text: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with `end_id` after it, and their numbers."""
        lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        if len(self._size.values) > self.REMEMBERED:
            self._forget()
        parted = pc.extract_regex(words, pattern=_PLAIN)
        plain = pc.is_valid(parted)
        head, tail = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        of = plain.to_numpy(zero_copy_only=False)
        for out, kind, part in ((head, "word", pc.utf8_lower(pc.struct_field(parted, "word").filter(plain))), (tail, "tail", pc.struct_field(parted, "tail").filter(plain))):
            distinct = part.dictionary_encode()
            if len(distinct):
                out[of] = self._places(distinct.dictionary, kind)[distinct.indices.to_numpy(zero_copy_only=False)]
        if not of.all():
            head[~of] = self._places(words.filter(pc.invert(plain)), "odd")
        pairs = np.stack([head, tail], 1).reshape(-1)
        size, begin = self._size.values[pairs].astype(np.int64), self._begin.values[pairs]
        of_words = self._ids.values[ranges(begin, size)]
        size = size.reshape(-1, 2).sum(1)
        begin = np.cumsum(size) - size
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        count = size[which]
        total = np.concatenate([[0], np.cumsum(count)])
        ends = np.cumsum(per_text)
        counts = total[ends] - total[ends - per_text]
        # The end of a text is one more word behind its own.
        place = np.arange(len(which)) + np.repeat(np.arange(len(per_text)), per_text)
        from_, many = np.full(len(which) + len(per_text), len(of_words)), np.ones(len(which) + len(per_text), np.int64)
        from_[place], many[place] = begin[which], count
        return np.append(of_words, end_id).astype(np.int32)[ranges(from_, many)], counts + 1


#: The encoder of this worker process, by the digest of its definition: its memory of
#: words serves all tasks that the process runs.
_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(definition: str) -> WordEncoder:
    digest = hashlib.sha256(definition.encode()).hexdigest()
    if digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[digest] = WordEncoder(definition)
    return _ENCODERS[digest]


#: Bytes of text whose distinct words are encoded at once.
STEP = 1 << 22


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in larger batches of about STEP bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= STEP:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


_ROWS = "part int, seq int, n_docs long, n_ids long, image binary"


def write_segments(docs: DataFrame, definition: str, end_id: int = END_ID) -> DataFrame:
    """Encode `docs` (doc_id, text) into segments in ascending doc_id order; returns
    the table of segments (part, seq, n_docs, n_ids, image), read back from storage.

    Null texts are empty.  Null ids come first; rows of one id follow each other in the
    order of their texts' hashes, and may fill several parts however many they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(definition)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = word_encoder(shared.value), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            doc_ids, known, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            image = pack(Segment(doc_ids, known, counts, ids))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(counts)]), pa.array([len(ids)]), pa.array([image])], names=["part", "seq", "n_docs", "n_ids", "image"])

        size = 0
        for batch in _gathered(batches):
            length = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in byte_slices(length, STEP):
                own = batch.slice(a, b - a)
                ids, counts = encoder.encode(own.column(1), end_id)
                held.append((pc.fill_null(own.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(own.column(0)).to_numpy(zero_copy_only=False), counts, ids))
                size += len(ids)
                if size >= SEGMENT:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Rows of one id are told apart by their text and place, so that no id makes a hot part.
    keyed = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = ("doc_id", "tie", "place")
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return store(ordered.mapInArrow(encode, _ROWS), "segments")[0]


def read_segments(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of `write_segments`' table.

    `start` counts the ids of all documents before it: segments' numbers of ids are
    added up within their part, and the parts' (one row each) over all.
    """
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    before = F.coalesce(F.sum("all_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = segments.select("part", "seq", "n_ids").withColumn("inner", inner).join(parts.select("part", before.alias("before")), "part")
    # Written down, so that Spark knows its size and need not shuffle the images to join.
    first, _ = store(placed.select("part", "seq", (F.col("before") + F.col("inner")).alias("first")), "starts")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment = unpack(image.as_py())
                ends = np.cumsum(segment.counts)
                raw = memoryview(segment.ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), segment.counts.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(segment.doc_ids, mask=~segment.known), pa.array(first + ends - segment.counts), pa.array(segment.counts), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    images = segments.select("part", "seq", "image").join(first, ["part", "seq"])
    return images.select("first", "image").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, definition: str) -> DataFrame:
    """Write the token files of `docs` and describe every document as read back."""
    return read_segments(write_segments(docs, definition))
