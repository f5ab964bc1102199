"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on whole slices of text as arrays, without a regular expression. Every code point gets a
class: its kind (letter, number, blank, other white space, apostrophe, other) and what the array says of its
neighbours (whether it is the last white space before text, whether letters of a contraction follow an apostrophe). Every class is a
function from the state before a code point to the state behind it. Blocks of text are reduced to composed functions,
composition being associative those are scanned over all blocks by doubling, and with each block's first state known, all
blocks run at once and tell where pieces begin.

Pieces are hashed where they stand; those not in the worker's cache are merged pair by pair, all at once, long ones by a heap in time
that grows with their length alone, but for a logarithm. A piece that the cache knows is compared with it byte by byte; if two pieces share a hash, the
task goes on with another hash function. Byte offsets of pieces and tokens are kept, so ids decode to the same bytes.

Null text counts as empty and encodes to no tokens; rows keep their other columns, repeated rows and null ids included.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import FIRST, U64, map_batches, mix, ranges, slice_hashes, small_batches, text_slices, words_of_eight

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Unicode White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows an apostrophe in a piece of its own.
SHORT, LONG = "stmd", ("re", "ve", "ll")
#: Pieces that a task keeps; beyond that it starts anew, which changes no result.
CACHE = 1 << 17
#: Pieces of more bytes are merged one by one, with a heap.
LONG_PIECE = 64


@lru_cache(1)
def classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    out[WHITE_SPACE] = SPACE
    return out


#: States: between pieces, in letters, numbers, other text, white space, behind a blank that text takes, one or two letters before the end of a contraction.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, TAKEN, ONE_LEFT, TWO_LEFT = range(8)
#: Classes of code points beside their kinds: apostrophes before contractions, and white space before text (a blank, or other).
APOSTROPHE_ONE, APOSTROPHE_TWO, LAST_BLANK, LAST_SPACE = range(4, 8)
#: Added to the class of a text's first code point.
HEAD = 8
#: Code points of a block.
BLOCK = 128


def _table() -> tuple[np.ndarray, np.ndarray]:
    """For each class and state: the state behind, and whether a piece begins."""
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, APOSTROPHE_ONE: IN_OTHER, APOSTROPHE_TWO: IN_OTHER}
    fresh = {APOSTROPHE_ONE: ONE_LEFT, APOSTROPHE_TWO: TWO_LEFT, SPACE: IN_SPACE, LAST_BLANK: TAKEN, LAST_SPACE: FREE}
    to, begins = np.zeros((2 * HEAD, 8), np.uint8), np.ones((2 * HEAD, 8), bool)
    for kind in range(HEAD):
        new = fresh.get(kind, run.get(kind))
        to[kind], to[kind + HEAD] = new, new  # a text's first code point begins a piece in any state
        if kind in run:
            for state in (run[kind], TAKEN):
                to[kind, state], begins[kind, state] = run[kind], False
        if kind == SPACE:
            begins[kind, IN_SPACE] = False
        to[kind, TWO_LEFT], to[kind, ONE_LEFT] = ONE_LEFT, FREE
        begins[kind, [TWO_LEFT, ONE_LEFT]] = False
    return to, begins


TO, BEGINS = _table()


def code_classes(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Class of each code point; rows holds the places where texts begin, and the end."""
    n = len(codes)
    kind = classes()[codes]
    head = np.zeros(n + 1, bool)
    head[rows] = True
    white = kind == SPACE
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~head[1:n]
    out = kind.copy()
    out[last] = np.where(codes[last] == 0x20, LAST_BLANK, LAST_SPACE)
    at = np.flatnonzero(codes == 0x27)
    if len(at):
        padded, ends = np.concatenate([codes, np.zeros(2, codes.dtype)]), np.concatenate([head, [True, True]])
        one, two = padded[at + 1], padded[at + 2]
        inside = ~ends[at + 1]
        short = np.isin(one, [ord(c) for c in SHORT]) & inside
        longer = np.zeros(len(at), bool)
        for a, b in LONG:
            longer |= (one == ord(a)) & (two == ord(b))
        out[at[longer & inside & ~ends[at + 2]]] = APOSTROPHE_TWO
        out[at[short]] = APOSTROPHE_ONE
    return out + HEAD * head[:n].astype(np.uint8)


def piece_starts(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where pieces begin in code points; rows holds the places where texts begin, and the end."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    kind = np.zeros(blocks * BLOCK, np.uint8)
    kind[:n] = code_classes(codes, rows)
    step = np.ascontiguousarray(kind.reshape(blocks, BLOCK).T).astype(np.intp) * 8
    to, begins = TO.ravel(), BEGINS.ravel()
    # each block as a function: the state behind it for every state before it
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (blocks, 8))
    for k in range(BLOCK):
        whole = to[step[k][:, None] + whole]
    # composed with all blocks before, by doubling
    span = 1
    while span < blocks:
        whole = np.concatenate([whole[:span], np.take_along_axis(whole[span:], whole[:-span], 1)])
        span *= 2
    state = np.concatenate([[FREE], whole[:-1, FREE]]).astype(np.uint8)
    out = np.zeros((BLOCK, blocks), bool)
    for k in range(BLOCK):
        at = step[k] + state
        out[k] = begins[at]
        state = to[at]
    return np.flatnonzero(out.T.ravel()[:n])


class Vocabulary:
    """Ranks as arrays: bytes of each token, and for pairs of tokens the token they merge to."""

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        by_id = {v: k for k, v in ranks.items()}
        self.tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        # open addressing; about a quarter of the places is used
        size = 1 << (4 * len(pairs)).bit_length()
        self.mask = U64(size - 1)
        self.keys = np.full(size, ~U64(0), U64)
        self.values = np.full(size, -1, np.int64)
        key = np.fromiter(pairs.keys(), U64, len(pairs))
        value = np.fromiter(pairs.values(), np.int64, len(pairs))
        place = mix(key) & self.mask
        self.probes = 0
        while len(key):
            self.probes += 1
            free = self.keys[place] == ~U64(0)
            _, first = np.unique(np.where(free, place, ~U64(0)), return_index=True)
            first = first[free[first]]
            self.keys[place[first]] = key[first]
            self.values[place[first]] = value[first]
            left = np.ones(len(key), bool)
            left[first] = False
            key, value, place = key[left], value[left], (place[left] + U64(1)) & self.mask
        self.pairs = pairs
        self.cache: dict[int, int] = {}
        self.seed = 0
        self.reset()

    def reset(self) -> None:
        self.cache.clear()
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.byte_at, self.byte_size, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token of each pair, or -1."""
        key = a.astype(U64) << U64(32) | b.astype(U64)
        place = mix(key) & self.mask
        out = np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            found = self.keys[place]
            hit = found == key[open_]
            out[open_[hit]] = self.values[place[hit]]
            more = ~hit & (found != ~U64(0))
            open_, place = open_[more], (place[more] + U64(1)) & self.mask
            if not len(open_):
                break
        return out

    def merge_long(self, data: bytes) -> list[int]:
        """Tokens of one piece: the lowest pair is taken from a heap, neighbours are linked."""
        token, pairs = [int(self.single[b]) for b in data], self.pairs.get
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pairs(token[i] << 32 | token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if token[i] < 0 or j >= n or pairs(token[i] << 32 | token[j]) != rank:
                continue
            token[i], token[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pairs(rank << 32 | token[k])) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := pairs(token[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h))
        return [t for t in token if t >= 0]

    def merge(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many pieces, and their number in each: the lowest pair of every piece is merged, again and again."""
        piece = np.repeat(np.arange(len(start)), size)
        token = self.single[buf[ranges(start, size)]]
        done_piece, done_token, done_place = [], [], []
        place = ranges(np.zeros(len(start), np.int64), size)
        pair = np.full(len(token), -1, np.int64)
        same = np.flatnonzero(piece[1:] == piece[:-1])
        pair[same] = self.merged(token[same], token[same + 1])
        high = np.int64(1) << 62
        while len(token):
            head = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            worth = np.where(pair >= 0, pair << 31 | np.arange(len(pair)), high)
            best = np.minimum.reduceat(worth, head)
            live = best < high
            if not live.all():
                rest = np.repeat(~live, np.diff(np.concatenate([head, [len(token)]])))
                done_piece.append(piece[rest]), done_token.append(token[rest]), done_place.append(place[rest])
                if not live.any():
                    break
                keep = np.cumsum(~rest) - 1
                at = keep[best[live] & ((1 << 31) - 1)]
                token, piece, place, pair = token[~rest], piece[~rest], place[~rest], pair[~rest]
            else:
                at = best & ((1 << 31) - 1)
            token[at] = pair[at]
            stay = np.ones(len(token), bool)
            stay[at + 1] = False
            keep = np.cumsum(stay) - 1
            token, piece, place, pair = token[stay], piece[stay], place[stay], pair[stay]
            at = keep[at]
            for k in (at, at[at > 0] - 1):
                ok = k + 1 < len(token)
                ok[ok] = piece[k[ok]] == piece[k[ok] + 1]
                pair[k[~ok]] = -1
                pair[k[ok]] = self.merged(token[k[ok]], token[k[ok] + 1])
        piece, token, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_piece, done_token, done_place))
        order = np.lexsort([place, piece])
        return token[order], np.bincount(piece, minlength=len(start))

    def learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, names: np.ndarray) -> None:
        """Adds pieces that differ from each other to the cache."""
        data, size = buf.tobytes(), end - start
        whole = np.fromiter((self.ranks.get(data[x:y], -1) for x, y in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(start))
        part, long = np.flatnonzero((whole < 0) & (size <= LONG_PIECE)), np.flatnonzero((whole < 0) & (size > LONG_PIECE))
        ids, counts = [whole[whole >= 0]], np.ones(len(start), np.int64)
        slots = np.concatenate([np.flatnonzero(whole >= 0), part, long])
        if len(part):
            tokens, counts[part] = self.merge(buf, start[part], size[part])
            ids.append(tokens)
        for k in long.tolist():
            tokens = np.array(self.merge_long(data[start[k] : end[k]]), np.int64)
            counts[k] = len(tokens)
            ids.append(tokens)
        at = np.cumsum(counts[slots]) - counts[slots] + len(self.ids)
        self.cache.update(zip(names[slots].tolist(), range(len(self.at), len(self.at) + len(slots)), strict=True))
        self.at, self.size = np.concatenate([self.at, at]), np.concatenate([self.size, counts[slots]])
        self.ids = np.concatenate([self.ids, *ids])
        self.byte_at = np.concatenate([self.byte_at, np.cumsum(size[slots]) - size[slots] + len(self.known)])
        self.byte_size = np.concatenate([self.byte_size, size[slots]])
        self.known = np.concatenate([self.known, buf[ranges(start[slots], size[slots])]])

    def encode(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the pieces buf[start:end] one behind the other, and their number in each."""
        while True:
            names, first, which = np.unique(slice_hashes(buf, start, end, self.seed), return_index=True, return_inverse=True)
            if same_content(buf, start, end, buf, start[first[which]], end[first[which]]):
                if len(self.cache) > CACHE:
                    self.reset()
                get = self.cache.get
                use = np.fromiter((get(x, -1) for x in names.tolist()), np.int64, len(names))
                old, new = np.flatnonzero(use >= 0), np.flatnonzero(use < 0)
                at, size = self.byte_at[use[old]], self.byte_size[use[old]]
                if same_content(buf, start[first[old]], end[first[old]], self.known, at, at + size):
                    break
            self.seed += 1  # two pieces share a hash: another function tells them apart
            self.reset()
        if len(new):
            self.learn(buf, start[first[new]], end[first[new]], names[new])
            use[new] = np.fromiter((get(x) for x in names[new].tolist()), np.int64, len(new))
        use = use[which]
        return self.ids[ranges(self.at[use], self.size[use])], self.size[use]


def same_content(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> bool:
    """Whether buf[start:end] and other[begin:stop] are equal for all of them. Seven bytes or less that share a hash are."""
    size = end - start
    if not np.array_equal(size, stop - begin):
        return False
    at = np.flatnonzero(size > 7)
    if not len(at):
        return True
    left, x, y, a, b = size[at], start[at], begin[at], words_of_eight(buf), words_of_eight(other)
    while len(left):
        if not np.array_equal(a[x] & FIRST[np.minimum(left, 8)], b[y] & FIRST[np.minimum(left, 8)]):
            return False
        more = left > 8
        left, x, y = left[more] - 8, x[more] + 8, y[more] + 8
        if len(left) < 4:  # a few long ones
            return all(np.array_equal(buf[i : i + k], other[j : j + k]) for i, j, k in zip(x.tolist(), y.tolist(), left.tolist(), strict=True))
    return True


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_slice(vocab: Vocabulary, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows, and where each row's begin (with the end)."""
    codes = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    byte = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(size, out=byte[1:])
    start = byte[piece_starts(codes, np.searchsorted(byte, offsets))]
    end = np.append(start[1:], len(buf))
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ids, counts = vocab.encode(buf, start, end)
    before = np.concatenate([[0], np.cumsum(counts)])
    return ids, before[np.searchsorted(start, offsets)]


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids, and the byte offset of each id (with the end)."""
    size = vocab.length[ids]
    return vocab.bytes[ranges(vocab.start[ids], size)], np.concatenate([[0], np.cumsum(size)])


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """All columns of docs, and input_ids (array of int): the tokens of the column's whole texts."""
    names = [f.name for f in docs.schema.fields if f.name != "input_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        vocab.reset()
        for batch in batches:
            for row, to, buf, offsets in text_slices(batch.column(batch.schema.get_field_index(column))):
                ids, before = encode_slice(vocab, buf, offsets)
                lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(ids.astype(np.int32)))
                part = batch.slice(row, to - row)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), lists], names=[*names, "input_ids"])
        vocab.reset()

    small_batches(docs.sparkSession)
    kept = docs.select(*(docs[n] for n in names))
    return map_batches(kept, run, kept.withColumn("input_ids", _null_ids()).schema)


def _null_ids():
    from pyspark.sql import functions as F

    return F.lit(None).cast("array<int>")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each row: encodes, then decodes those ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        vocab.reset()
        for batch in batches:
            for row, to, buf, offsets in text_slices(batch.column(1)):
                ids, before = encode_slice(vocab, buf, offsets)
                data, place = decode_ids(vocab, ids)
                packed, data = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
                spans = list(zip(before[:-1].tolist(), before[1:].tolist(), place[before[:-1]].tolist(), place[before[1:]].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, to - row),
                    pa.array(np.diff(before), pa.int64()),
                    pa.array([hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b, _, _ in spans]),
                    pa.array([hashlib.sha256(data[c:d]).hexdigest() for _, _, c, d in spans]),
                ], names=["k", "n_tokens", "ids_sha256", "decoded_sha256"])
        vocab.reset()

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    out = map_batches(docs.select(docs[key], docs[column]), run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("k", key)
