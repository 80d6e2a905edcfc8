"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

A text is split before each run of the space mark (no piece holds one after another
character), so its segmentation is that of its words.  The distinct words of a batch
are sorted by length; words of equal length advance together: at every end position,
the hashes of all substrings ending there probe the sorted hashes of the pieces, and
a vectorised maximum keeps score and backpointer of every word.  A long word (a text in
a script without spaces) is first cut wherever no piece holds its two neighbours, which
changes no segmentation; what no such cut shortens is searched alone.  Hashes only
propose: the characters of words and pieces are compared as well.

Of equal scores the longest last piece wins.  Null and empty texts have no ids; equal
texts have equal ids, and repeated rows stay.  The functions take one column, so other
columns of a table do not matter, whatever their names.

For a unigram model the maximum is over total scores.  A BPE model's encoding is no
maximum of a sum, but it is a path as well: every prefix of it is the encoding of the
prefix, and a sequence of pieces is the encoding exactly if each pair of neighbours
is, i.e. if replaying the merges of both never joins them across their border.  There
a piece that does not fit the one its backpointer leads to scores minus infinity.  Both
give the library's ids.  A character without a piece becomes its UTF-8 byte pieces.
"""

from __future__ import annotations

import weakref
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from verdigris.llm._shared import bounded_batches, byte_slices, ranges

SPACE = "▁"
#: Words beyond this length are cut where no piece can cross, and those that stay longer
#: are searched one at a time, with all their probes at once.
LONG_WORD = 48
#: Bytes of text that are encoded at once.
STEP = 1 << 21
#: An uncovered character costs so much more than the worst piece.
UNKNOWN_PENALTY = 10.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BEGINNING = 20  # bits of a hash that sort out most substrings before the sorted keys are probed
_NEIGHBOURS = 20  # bits of the table of characters that stand together in some piece


@dataclass(eq=False)
class PieceModel:
    keys: np.ndarray  # sorted hashes of the pieces
    begun: np.ndarray  # by the first bits of a hash: whether a key begins so
    ids: np.ndarray  # piece id of each key
    scores: np.ndarray  # score of each key
    longest: int
    unknown: float
    byte_ids: np.ndarray  # id of each byte's piece
    spelling: np.ndarray  # the bytes of all pieces, end to end
    spelled: np.ndarray  # offsets into `spelling`
    points: np.ndarray  # the characters of all pieces that a search can give, end to end
    pointed: np.ndarray  # offsets into `points`
    together: np.ndarray  # by the mix of two characters: whether a piece may hold both, side by side
    space: int  # id of the lone space mark
    runs: list[list[int]]  # BPE: the pieces of a run of n space marks, n up to the longest
    bpe: bool = False
    rank: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # by id: place in the order of merges
    parts: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))  # by id: the pieces it is merged from
    joins: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted pairs that merge
    join_rank: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A scattered 64-bit value of each code point."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums along the last axis of value x base^place, modulo 2^64."""
    terms = _mixed(codes) * _powers(_BASE, codes.shape[-1])
    return np.concatenate([np.zeros((*codes.shape[:-1], 1), np.uint64), np.cumsum(terms, axis=-1, dtype=np.uint64)], axis=-1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Place of two neighbouring characters in the table `together`."""
    return ((left.astype(np.uint64) * np.uint64(0x9E3779B1) + right) * _BASE >> np.uint64(64 - _NEIGHBOURS)).astype(np.int64)


def load(path: str) -> PieceModel:
    """Read pieces, scores and kind from a SentencePiece model file with byte pieces."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    return from_pieces([(p.piece, p.score, p.type) for p in proto.pieces], proto.trainer_spec.model_type == 2)


_NORMAL, _USER, _BYTE = 1, 4, 6  # piece types of the file format (fixed values)


def from_pieces(table: list[tuple[str, float, int]], bpe: bool) -> PieceModel:
    """A model of (piece, score, type) rows in order of their ids."""
    spelling, byte_ids = [b""] * len(table), np.zeros(256, np.int32)
    known: dict[str, int] = {}
    for number, (piece, _, kind) in enumerate(table):
        if kind == _BYTE:
            byte_ids[int(piece[3:5], 16)] = number
            spelling[number] = bytes([int(piece[3:5], 16)])
        elif kind in (_NORMAL, _USER):
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {number} holds a space mark after another character")
            known[piece] = number
            spelling[number] = piece.replace(SPACE, " ").encode()
    score = {piece: table[number][1] for piece, number in known.items()}
    least = min(score.values())
    parts = np.full((len(table), 2), -1)
    runs: list[list[int]] = []
    usable = dict(known)
    if bpe:
        # Pieces of space marks alone share one score: runs are merged by themselves.
        if any(p.startswith(2 * SPACE) and p.strip(SPACE) for p in known):
            raise ValueError("a piece holds letters after several space marks")
        longest = max(len(p) for p in known if not p.strip(SPACE))
        runs = [[known[p] for p in _merge(SPACE * n, score)[0]] for n in range(2 * longest)]
        if any(runs[n] != runs[longest] + runs[n - longest] for n in range(longest, 2 * longest)):
            raise ValueError("long runs of space marks do not repeat")
        usable = {}
        for piece, number in known.items():
            got, last = _merge(piece, score)
            if len(got) == 1 and (len(piece) == 1 or piece.strip(SPACE)):
                usable[piece] = number
                if last:
                    parts[number] = [known[last[0]], known[last[1]]]
    order = {piece: at for at, piece in enumerate(sorted(usable, key=lambda p: -score[p]))}
    rank = np.full(len(table), -1)
    for piece, number in usable.items():
        rank[number] = order[piece] if len(piece) > 1 else -1
    pairs = sorted((known[p[:i]] * len(table) + known[p[i:]], order[p]) for p in usable for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable) if bpe else []
    names = list(usable)
    shown = [""] * len(table)
    for piece, number in usable.items():
        shown[number] = piece
    together = np.zeros(1 << _NEIGHBOURS, bool)
    inner = _codes("\0".join(known))
    together[_slot(inner[:-1], inner[1:])] = True
    keys = np.array([_sums(_codes(p))[-1] for p in names], np.uint64)
    if len(np.unique(keys)) != len(keys):
        raise ValueError("two pieces have one hash")
    by_key = np.argsort(keys)
    begun = np.zeros(1 << _BEGINNING, bool)
    begun[keys >> np.uint64(64 - _BEGINNING)] = True
    return PieceModel(
        keys[by_key], begun, np.array([usable[p] for p in names], np.int32)[by_key], np.array([score[p] for p in names])[by_key], max(map(len, names)), least - UNKNOWN_PENALTY, byte_ids,
        np.frombuffer(b"".join(spelling), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in spelling])]),
        _codes("".join(shown)), np.concatenate([[0], np.cumsum([len(p) for p in shown])]), together, known.get(SPACE, -1), runs, bpe,
        rank, parts, np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64),
    )


def _merge(text: str, score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """BPE of a short string by its definition, and the last merge: best score first, then leftmost."""
    parts, last = list(text), None
    while True:
        best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score), default=None)
        if best is None:
            return parts, last
        i = -best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def fits(model: PieceModel, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the BPE of each two pieces' joint text is those two pieces.

    Going back in time, whichever piece was made later is undone, and the parts that
    then met at the border must not have had a merge that came before its making.
    """
    if not len(left):
        return np.zeros(0, bool)
    pair = left.astype(np.int64) * len(model.rank) + right
    pair, number = np.unique(pair, return_inverse=True)
    a, b = pair // len(model.rank), pair % len(model.rank)
    limit = np.full(len(pair), np.iinfo(np.int64).max)
    good, at = np.ones(len(pair), bool), np.arange(len(pair))
    while len(at):
        key = a[at] * len(model.rank) + b[at]
        row = np.minimum(np.searchsorted(model.joins, key), len(model.joins) - 1)
        joined = (model.joins[row] == key) & (model.join_rank[row] < limit[at]) if len(model.joins) else np.zeros(len(at), bool)
        good[at[joined]] = False
        at = at[~joined]
        ra, rb = model.rank[a[at]], model.rank[b[at]]
        undo = np.maximum(ra, rb) >= 0  # of two single characters nothing can be undone
        at, ra, rb = at[undo], ra[undo], rb[undo]
        first = ra > rb
        limit[at] = np.where(first, ra, rb + 1)
        a[at], b[at] = np.where(first, model.parts[a[at], 1], a[at]), np.where(first, b[at], model.parts[b[at], 0])
    return good[number]


def _probe(model: PieceModel, hashes: np.ndarray) -> np.ndarray:
    """Row of each hash among the keys, or -1."""
    row = np.full(hashes.shape, -1)
    likely = model.begun[hashes >> np.uint64(64 - _BEGINNING)]
    some = hashes[likely]
    at = np.minimum(np.searchsorted(model.keys, some), len(model.keys) - 1)
    row[likely] = np.where(model.keys[at] == some, at, -1)
    return row


def _together(model: PieceModel, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of words of equal length (rows): tokens end to end, and how many.

    An uncovered character is the token -1 - code point.
    """
    n, length = codes.shape
    sums, back = _sums(codes), _powers(_INVERSE, length + 1)
    every = np.arange(n)
    best, came, token = np.zeros((n, length + 1)), np.zeros((n, length + 1), np.int32), np.zeros((n, length + 1), np.int64)
    for end in range(1, length + 1):
        low = max(0, end - model.longest)
        row = _probe(model, (sums[:, end : end + 1] - sums[:, low:end]) * back[low:end])
        covered = row >= 0
        bare = ~covered[:, -1]
        score = np.where(covered, best[:, low:end] + (0.0 if model.bpe else model.scores[row]), -np.inf)
        if model.bpe:
            word, at = np.nonzero(covered & (np.arange(low, end) > 0) & (token[:, low:end] >= 0))
            misfit = ~fits(model, token[word, low + at], model.ids[row[word, at]])
            score[word[misfit], at[misfit]] = -np.inf
        score[bare, -1] = best[bare, end - 1] + model.unknown
        top = score.argmax(1)  # of equal scores the longest piece
        best[:, end], came[:, end] = score[every, top], low + top
        token[:, end] = np.where(bare & (low + top == end - 1), -1 - codes[:, end - 1].astype(np.int64), model.ids[row[every, top]])
    at, steps, lines = np.full(n, length), [], []
    while at.any():
        steps.append(token[every, at])
        lines.append(at > 0)
        at = np.where(at > 0, came[every, at], 0)
    kept = np.stack(lines[::-1], 1)
    return np.stack(steps[::-1], 1)[kept], kept.sum(1)


def _alone(model: PieceModel, codes: np.ndarray) -> np.ndarray:
    """Best segmentation of one long word: the probes of all its substrings first."""
    length = len(codes)
    out: list[int] = []
    sums = _sums(codes)
    back = _powers(_INVERSE, length + 1)
    by_end: list[list[tuple[int, float, int]]] = [[] for _ in range(length + 1)]
    for size in range(model.longest, 0, -1):
        if size <= length:
            row = _probe(model, (sums[size:] - sums[:-size]) * back[: length - size + 1])
            for start in np.flatnonzero(row >= 0).tolist():
                by_end[start + size].append((start, float(model.scores[row[start]]), int(model.ids[row[start]])))
    best, came, token = [0.0] * (length + 1), [0] * (length + 1), [0] * (length + 1)
    fit: dict[tuple[int, int], bool] = {}
    for end in range(1, length + 1):
        top = -np.inf
        choices = by_end[end]
        if not choices or choices[-1][0] != end - 1:
            choices = [*choices, (end - 1, model.unknown, -1 - int(codes[end - 1]))]
        for start, score, piece in choices:
            if model.bpe:
                score = 0.0 if start == 0 or piece < 0 or token[start] < 0 or _fit(model, fit, token[start], piece) else -np.inf
            if best[start] + score > top:
                top, came[end], token[end] = best[start] + score, start, piece
        best[end] = top
    at = length
    while at:
        out.append(token[at])
        at = came[at]
    return np.array(out[::-1], np.int64)


def _fit(model: PieceModel, seen: dict[tuple[int, int], bool], left: int, right: int) -> bool:
    if (left, right) not in seen:
        seen[left, right] = bool(fits(model, np.array([left]), np.array([right]))[0])
    return seen[left, right]


def _spelt(model: PieceModel, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of tokens end to end, and how many each has."""
    size = np.where(tokens < 0, 1, np.diff(model.pointed)[tokens])
    at = np.where(tokens < 0, 0, model.pointed[tokens])
    out = model.points[ranges(at, size)]
    bare = tokens < 0
    out[(np.cumsum(size) - size)[bare]] = -1 - tokens[bare]
    return out, size


def _plainly(model: PieceModel, codes: np.ndarray) -> np.ndarray:
    """Best segmentation by spelling, for the rare words that hashes mislead."""
    text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    spelling = {model.points[model.pointed[i] : model.pointed[i + 1]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"): (i, s) for i, s in zip(model.ids.tolist(), model.scores.tolist(), strict=True)}
    if model.bpe:
        parts = _merge(text, {p: -float(model.rank[i]) for p, (i, _) in spelling.items() if len(p) > 1})[0]
    else:
        best: list[tuple[float, list[str]]] = [(0.0, [])]
        for end in range(1, len(text) + 1):
            options = [(best[a][0] + spelling[text[a:end]][1], best[a][1] + [text[a:end]]) for a in range(max(0, end - model.longest), end) if text[a:end] in spelling]
            if text[end - 1] not in spelling:
                options.append((best[end - 1][0] + model.unknown, best[end - 1][1] + [text[end - 1]]))
            best.append(max(options, key=lambda o: o[0]))
        parts = best[-1][1]
    return np.array([spelling[p][0] if p in spelling else -1 - ord(p) for p in parts], np.int64)


def _checked(model: PieceModel, codes: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' tokens, after a comparison with the words (rows of equal length)."""
    spelt, size = _spelt(model, tokens)
    ends = np.cumsum(counts)
    whole = np.concatenate([[0], np.cumsum(size)])
    good = whole[ends] - whole[ends - counts] == codes.shape[1]
    if good.all():
        good = (spelt.reshape(codes.shape) == codes).all(1)
        if good.all():
            return tokens, counts
    parts = [tokens[e - c : e] if g else _plainly(model, w) for e, c, g, w in zip(ends, counts, good, codes, strict=True)]
    return np.concatenate(parts), np.array([len(p) for p in parts])


def _distinct(codes: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """First place and number of each distinct word, and how many of them may be remembered.

    Long words are all distinct, and so are those that only share their hash with the
    first word of it.
    """
    short, apart = np.flatnonzero(length <= LONG_WORD), np.flatnonzero(length > LONG_WORD)
    _, first, inverse = np.unique(hashes[short], return_index=True, return_inverse=True)
    first = short[first]
    number = np.empty(len(hashes), np.int64)
    number[short] = inverse
    like = first[inverse]
    same = length[short] == length[like]
    size = np.where(same, length[short], 0)
    differs = codes[ranges(start[short], size)] != codes[ranges(start[like], size)]
    if differs.any() or not same.all():
        same &= np.bincount(np.repeat(np.arange(len(short)), size), differs, len(short)) == 0
        apart = np.concatenate([apart, short[~same]])
    number[apart] = len(first) + np.arange(len(apart))
    return np.concatenate([first, apart]), number, len(first)


@dataclass
class _Memory:
    """Words of recent batches and their tokens."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    ends: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # offsets into `tokens`
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    spelt: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # offsets into `codes`
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))


#: A bounded memory of each worker for each living model, which spares it the search for
#: words that come again.
_MEMORY: weakref.WeakKeyDictionary[PieceModel, _Memory] = weakref.WeakKeyDictionary()
MEMORY_WORDS = 1 << 18
#: A batch with fewer new words than this share of the remembered ones adds none.
MEMORY_GROWS = 1 / 64


def encode(model: PieceModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts end to end, and the number of ids of each text."""
    marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    sizes = np.array([len(m) for m in marked], np.int64)
    codes = _codes("".join(marked))
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    is_space = codes == ord(SPACE)
    begins = is_space & ~np.concatenate([[False], is_space[:-1]])
    begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    start = np.flatnonzero(begins)
    length = np.diff(np.append(start, len(codes)))
    inner = ranges(start[length > LONG_WORD] + 1, length[length > LONG_WORD] - 1)
    if len(inner):
        inner = inner[~is_space[inner] & ~is_space[inner - 1]]
        begins[inner[~model.together[_slot(codes[inner - 1], codes[inner])]]] = True
        start = np.flatnonzero(begins)
    owner = np.searchsorted(np.cumsum(sizes), start, side="right")
    length = np.diff(np.append(start, len(codes)))
    extra = np.zeros(len(start), np.int64)
    if model.bpe:  # marks before a word's own one are merged apart, and all marks of a word without letters
        marks = np.add.reduceat(is_space.astype(np.int64), start)
        extra = np.where(marks == length, marks, np.maximum(marks - 1, 0))
    start, length = start + extra, length - extra
    flat, begin, per_word = _words(model, codes, start, length)

    run = extra.copy()
    skip = np.zeros(len(start), np.int64)
    many = np.flatnonzero((extra > 0) & (per_word > 0))
    lone = many[flat[begin[many]] == model.space]
    run[lone] += 1
    skip[lone] = 1
    spaces = {n: _run(model, n) for n in np.unique(run).tolist()}
    before = np.array([len(spaces[n]) for n in run.tolist()], np.int64) if len(spaces) > 1 else np.zeros(len(run), np.int64) + len(spaces[int(run[0])])
    count = before + per_word - skip
    place = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int32)
    out[ranges(place + before, per_word - skip)] = flat[ranges(begin + skip, per_word - skip)]
    for n, ids in spaces.items():
        for i, one in enumerate(ids):
            out[place[run == n] + i] = one
    return out, np.bincount(owner, count, len(texts)).astype(np.int64)


def _run(model: PieceModel, marks: int) -> list[int]:
    """The pieces of so many space marks in a row (BPE)."""
    if marks < len(model.runs):
        return model.runs[marks]
    if not model.runs:
        return []
    half = len(model.runs) // 2  # load() saw that longer runs repeat this one
    return model.runs[half] * (marks // half) + model.runs[marks % half]


def _words(model: PieceModel, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the distinct words, and where each word's begin and how many they are."""
    sums = _sums(codes)
    hashes = (sums[start + length] - sums[start]) * _powers(_INVERSE, len(codes) + 1)[start]
    first, number, keepable = _distinct(codes, start, length, hashes)
    own, size = hashes[first], length[first]
    past = _MEMORY.get(model) or _Memory()
    at = np.minimum(np.searchsorted(past.keys, own), max(len(past.keys) - 1, 0))
    old = np.zeros(len(own), bool)
    if len(past.keys):
        old[:keepable] = (past.keys[at] == own)[:keepable] & (np.diff(past.spelt)[at] == size)[:keepable]
        hit = np.flatnonzero(old)
        differs = codes[ranges(start[first[hit]], size[hit])] != past.codes[ranges(past.spelt[at[hit]], size[hit])]
        if differs.any():
            old[hit[np.unique(np.repeat(np.arange(len(hit)), size[hit])[differs])]] = False
    new = np.flatnonzero(~old)

    order = new[np.argsort(size[new], kind="stable")]
    tokens, counts = [np.zeros(0, np.int64)], np.zeros(len(first), np.int64)
    edges = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        n = int(size[order[a]])
        if n > LONG_WORD:
            for w in order[a:b]:
                word = codes[start[first[w]] : start[first[w]] + n]
                alone = _alone(model, word)
                got, many = _checked(model, word[None], alone, np.array([len(alone)]))
                tokens.append(got)
                counts[w] = many[0]
        elif n:
            for c in range(a, b, 1 << 14):
                part = order[c : min(b, c + (1 << 14))]
                words = codes[start[first[part]][:, None] + np.arange(n)]
                got, many = _checked(model, words, *_together(model, words))
                tokens.append(got)
                counts[part] = many
    flat, counts[order] = _with_bytes(model, np.concatenate(tokens), counts[order])
    begin = np.zeros(len(first), np.int64)
    begin[order] = np.cumsum(counts[order]) - counts[order]
    counts[old] = np.diff(past.ends)[at[old]]
    begin[old] = len(flat) + past.ends[at[old]]
    both = np.concatenate([flat, past.tokens])

    if len(new) > MEMORY_GROWS * len(past.keys):
        kept = np.arange(keepable)
        key, where, many, spelt, letters = own[kept], begin[kept], counts[kept], start[first[kept]], size[kept]
        text = codes
        if len(past.keys) + len(new) <= MEMORY_WORDS:  # else start anew from this batch
            stale = np.flatnonzero(~np.isin(past.keys, key))
            key = np.concatenate([key, past.keys[stale]])
            where = np.concatenate([where, len(flat) + past.ends[stale]])
            many = np.concatenate([many, np.diff(past.ends)[stale]])
            spelt = np.concatenate([spelt, len(codes) + past.spelt[stale]])
            letters = np.concatenate([letters, np.diff(past.spelt)[stale]])
            text = np.concatenate([codes, past.codes])
        by_key = np.argsort(key)
        many, letters = many[by_key], letters[by_key]
        _MEMORY[model] = _Memory(key[by_key], np.concatenate([[0], np.cumsum(many)]), both[ranges(where[by_key], many)], np.concatenate([[0], np.cumsum(letters)]), text[ranges(spelt[by_key], letters)])
    return both, begin[number], counts[number]


def _with_bytes(model: PieceModel, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each uncovered character by the pieces of its UTF-8 bytes."""
    bare = np.flatnonzero(flat < 0)
    if not len(bare):
        return flat, counts
    points, which = np.unique(-1 - flat[bare], return_inverse=True)
    spelled = [np.frombuffer(chr(p).encode("utf-8", "surrogatepass"), np.uint8) for p in points.tolist()]
    sizes = np.array([len(s) for s in spelled])
    repeats = np.ones(len(flat), np.int64)
    repeats[bare] = sizes[which]
    total, ends = np.concatenate([[0], np.cumsum(repeats)]), np.cumsum(counts)
    grown = total[ends] - total[ends - counts]
    out = np.repeat(flat, repeats)
    begin = (np.cumsum(sizes) - sizes)[which]
    out[ranges((np.cumsum(repeats) - repeats)[bare], sizes[which])] = model.byte_ids[np.concatenate(spelled)[ranges(begin, sizes[which])]]
    return out, grown


def decode(model: PieceModel, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of ids laid end to end; bytes that are no UTF-8 become U+FFFD."""
    size = np.diff(model.spelled)[ids]
    raw = model.spelling[ranges(model.spelled[:-1][ids], size)].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    # The first piece begins with the space mark that encoding put before the text.
    return [raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _lists(model: PieceModel, texts: list[str]) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """Ids of all texts as a list array, end to end, and their numbers."""
    flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for a, b in byte_slices(np.array([4 * len(t) for t in texts]), STEP * 4):
        f, c = encode(model, texts[a:b])
        flat.append(f)
        counts.append(c)
    ids, many = np.concatenate(flat), np.concatenate(counts)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(ids)), ids, many


def encoder(spark: SparkSession, model: PieceModel) -> Column:
    """A function of a text column: its piece ids (array<int>).

    Null and empty texts give an empty array.  A space mark in a text is read as a
    space, as in SentencePiece itself.
    """
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        return _lists(shared.value, [t or "" for t in text.to_pylist()])[0]

    return ids


def coder(spark: SparkSession, model: PieceModel) -> Column:
    """A function of a text column: struct<ids, back>, its piece ids and the text that
    decoding them gives, each text encoded once."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("ids array<int>, back string")
    def both(text: pa.Array) -> pa.Array:
        lists, ids, counts = _lists(shared.value, [t or "" for t in text.to_pylist()])
        return pa.StructArray.from_arrays([lists, pa.array(decode(shared.value, ids, counts), pa.string())], ["ids", "back"])

    return both


def decoder(spark: SparkSession, model: PieceModel) -> Column:
    """A function of an array<int> column: the text (empty for null)."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def texts(ids: pa.Array) -> pa.Array:
        rows = [np.array(r or [], np.int64) for r in ids.to_pylist()] if ids.null_count else None
        if rows is None:
            offsets = ids.offsets.to_numpy()
            flat, counts = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)
        else:
            flat, counts = np.concatenate([*rows, np.zeros(0, np.int64)]), np.array([len(r) for r in rows], np.int64)
        return pa.array(decode(shared.value, flat, counts), pa.string())

    return texts
