"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points become classes through a lookup array. Each class is a transition function between the
scanner's states; functions compose associatively, and the few functions that compositions can give
are numbered once, so a composition is one lookup. The boundaries of all texts of a batch come from
one scan: blocks of code points are composed side by side, block results are scanned, and the
states inside the blocks follow. The resulting slices feed a cache of merged pairs. Slices keep
their offsets and the number of their ids, so that any range of characters is decoded from the ids of its slices alone.

The scanner splits as the public pattern does: contractions, then letters, numbers or other
signs with one optional space before, then white space.

Defined results: a null or empty text gives no ids; lone surrogates cannot occur in Spark strings;
repeated rows are encoded each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from dwellspark.llm.common import frames, texts_of, workers

# Classes of code points once their neighbours are known.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACES, LAST_SPACE, LAST_WHITE = range(8)
# States: what the code point before ended in. END: whatever comes next starts a slice.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, AFTER_SPACE, ONE_LEFT, TWO_LEFT, END = range(8)
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 64


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a slice starts before this code point."""
    if kind == LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return (END if state == ONE_LEFT else ONE_LEFT), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if kind in (OTHER, SHORT, LONG):
        if kind == OTHER or state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, state not in (IN_OTHERS, AFTER_SPACE)
        return (ONE_LEFT if kind == SHORT else TWO_LEFT), True
    if kind == SPACES:
        return IN_SPACES, state != IN_SPACES
    return (AFTER_SPACE if kind == LAST_SPACE else END), True


@functools.cache
def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """generator (class, first of a text) -> function number; function x function -> function;
    function -> state it leads to from END; state x class -> next state; state x class -> start."""
    nxt = np.array([[_step(s, k)[0] for k in range(8)] for s in range(8)], np.uint8)
    starts = np.array([[_step(s, k)[1] for k in range(8)] for s in range(8)], bool)
    number: dict[tuple[int, ...], int] = {tuple(range(8)): 0}
    generator = np.empty((2, 8), np.uint16)
    for k in range(8):
        for first in (0, 1):
            f = tuple([int(nxt[END, k])] * 8) if first else tuple(map(int, nxt[:, k]))
            generator[first, k] = number.setdefault(f, len(number))
    grown = True
    while grown:
        grown = False
        for f in list(number):
            for g in list(number):
                h = tuple(g[s] for s in f)
                if h not in number:
                    number[h] = len(number)
                    grown = True
    functions = list(number)
    compose = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    return generator, compose, np.array(functions, np.uint8), nxt, starts


@functools.cache
def base_classes() -> np.ndarray:
    """Letter, number, other or white space for every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[_WHITE] = SPACES
    return table


def classes(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Class of each code point of joined texts; a text ends white space and contractions."""
    kind = base_classes()[points]
    n = len(points)
    end = np.zeros(n, bool)
    if n:
        end[np.cumsum(lengths[lengths > 0]) - 1] = True
    after = np.append(kind[1:], SPACES)
    last = (kind == SPACES) & ~end & (after != SPACES)
    out = kind.copy()
    out[last] = np.where(points[last] == 32, LAST_SPACE, LAST_WHITE)
    for at in np.flatnonzero(points == 39).tolist():
        if end[at]:
            continue
        a = points[at + 1]
        if a in (115, 116, 109, 100):  # 's 't 'm 'd
            out[at] = SHORT
        elif not end[at + 1] and (a, points[at + 2]) in ((114, 101), (118, 101), (108, 108)):  # 're 've 'll
            out[at] = LONG
    return out


def starts_of(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a slice starts at each code point of the joined texts."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    generator, compose, functions, nxt, starts = machine()
    kind = classes(points, lengths)
    first = np.zeros(n, np.uint8)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = 1
    f = np.zeros(-(-n // BLOCK) * BLOCK, np.uint16)
    f[:n] = generator[first, kind]
    f = f.reshape(-1, BLOCK).T.copy()
    for i in range(1, BLOCK):  # composed from each block's start, all blocks at once
        f[i] = compose[f[i - 1], f[i]]
    whole, reach = f[-1].copy(), 1
    while reach < len(whole):  # and over the blocks, doubling the reach
        whole[reach:] = compose[whole[:-reach], whole[reach:]]
        reach *= 2
    entry = np.full(len(whole), END, np.uint8)
    entry[1:] = functions[whole[:-1], END]
    state = functions[f, entry[None, :]].T.ravel()[:n]
    before = np.concatenate([[END], state[:-1]]).astype(np.uint8)
    return starts[before, kind] | (first == 1)


class Encoder:
    """Ranks of byte strings and a cache of merged slices, bounded in entries."""

    def __init__(self, ranks: dict[bytes, int], cache: int = 400_000):
        self.ranks, self.limit = ranks, cache
        self.merged: dict[str, bytes] = {}
        self.tokens = {i: t for t, i in ranks.items()}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the pair of the lowest rank is joined until none has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def long_merge(self, piece: bytes) -> list[int]:
        """As `merge`, for long slices: a heap of pairs over a linked list."""
        import heapq
        n, ranks = len(piece), self.ranks
        parts: list[bytes | None] = [piece[i:i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            joined = parts[i] + parts[j]
            parts[i], parts[j], right[i] = joined, None, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := ranks.get(joined + parts[right[i]])) is not None:
                    heapq.heappush(heap, (r, i, size + len(parts[right[i]])))
            if left[i] >= 0 and (r := ranks.get(parts[left[i]] + joined)) is not None:
                heapq.heappush(heap, (r, left[i], len(parts[left[i]]) + size))
        return [ranks[p] for p in parts if p is not None]

    def packed(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = self.merge(raw) if len(raw) < 60 else [self.ranks[raw]] if raw in self.ranks else self.long_merge(raw)
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [ids for ids, _, _ in self.slices(texts)]

    def slices(self, texts: list[str]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
        """Of each text: its ids, and of each slice the character it starts at and the number of its ids."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        at = np.flatnonzero(starts_of(points, lengths))
        bounds = np.append(at, len(points)).tolist()
        edge = np.searchsorted(at, np.append(0, np.cumsum(lengths))).tolist()
        if len(self.merged) > self.limit:
            self.merged.clear()
        merged, out = self.merged, []
        base = 0
        for lo, hi, length in zip(edge, edge[1:], lengths.tolist()):
            ids = []
            for a, b in zip(bounds[lo:hi], bounds[lo + 1:hi + 1]):
                piece = joined[a:b]
                got = merged.get(piece)
                if got is None:
                    got = self.packed(piece)
                    if b - a < 60:
                        merged[piece] = got
                ids.append(got)
            out.append((b"".join(ids), at[lo:hi] - base, np.fromiter(map(len, ids), np.int64, len(ids)) // 4))
            base += length
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_range(self, ids: bytes, starts: np.ndarray, counts: np.ndarray, lo: int, hi: int) -> str:
        """Characters lo to hi (exclusive) of the text, from the ids of the slices that hold them."""
        if lo >= hi or not len(starts):
            return ""
        first, last = int(np.searchsorted(starts, lo, "right")) - 1, int(np.searchsorted(starts, hi))
        held = np.append(0, np.cumsum(counts))
        text = self.decode(ids[4 * int(held[first]):4 * int(held[last])]).decode()
        return text[lo - int(starts[first]):hi - int(starts[first])]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}


@functools.cache
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    return Encoder(read_ranks(path))


def encoded(docs: DataFrame, path: str, chars: int = 200_000) -> DataFrame:
    """doc_id, packed ids, and of each slice the character it starts at and the number of its ids. Texts are scanned together until they
    hold `chars` code points."""
    workers(docs.sparkSession)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in frames(batches):
            got = _in_groups(enc, pdf["text"].tolist(), chars)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": [g[0] for g in got],
                                "slice_start": [g[1] for g in got], "slice_ids": [g[2] for g in got]})
    return texts_of(docs).mapInPandas(one, "doc_id long, ids binary, slice_start array<int>, slice_ids array<int>")


def decoded_range(rows: DataFrame, path: str, lo: int, hi: int) -> DataFrame:
    """doc_id and characters lo to hi (exclusive) of the texts that `encoded` rows stand for."""
    workers(rows.sparkSession)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in frames(batches):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"),
                                "text": [enc.decode_range(*g, lo, hi) for g in zip(pdf["ids"], pdf["slice_start"], pdf["slice_ids"])]})
    return rows.select("doc_id", "ids", "slice_start", "slice_ids").mapInPandas(one, "doc_id long, text string")


def _in_groups(enc: Encoder, texts: list[str], chars: int) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    out, group, size = [], [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chars:
            out += enc.slices(group)
            group, size = [], 0
    return out + (enc.slices(group) if group else [])


def round_trip(docs: DataFrame, path: str, chars: int = 200_000) -> DataFrame:
    """doc_id, n_tokens, digest of the ids and digest of what they decode to, and the number of slices, for every document."""
    workers(docs.sparkSession)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in frames(batches):
            got = _in_groups(enc, pdf["text"].tolist(), chars)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "n_tokens": [int(n.sum()) for _, _, n in got],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x, _, _ in got],
                "decoded_sha256": [hashlib.sha256(enc.decode(x)).hexdigest() for x, _, _ in got], "n_slices": [len(n) for _, _, n in got]})
    return texts_of(docs).mapInPandas(one, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_slices long")
