"""Encoding and decoding with a SentencePiece BPE vocabulary, with seeded merge dropout.

Merges are taken from an agenda, best score first; each candidate that comes up is skipped with the
chance `dropout`, independently for every occurrence of a word: hashes keyed by seed, document and
place give the distances from one skip to the next. A skipped pair may come up again once a
neighbour has changed. What is not in the vocabulary is written in byte pieces, so every
segmentation decodes to the same text.

The agendas of all words of about the same length go forward together in numpy, one candidate of
each word at a time, so nothing is kept from word to word and every occurrence has its own draws.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Code points of texts that a worker handles at a time, about; a longer text is cut before a space.
SLICE = 1 << 19
#: Documents that a worker handles at a time, at most.
ROWS = 256
#: Words go forward with others of up to the next of these lengths; longer ones alone, with a heap.
LENGTHS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 26, 32, 40)
#: A draw covers so many candidates; a distance of as many is no skip yet.
REACH = 64
#: Symbols are pieces by number, and from here on single characters that are no pieces.
OTHER = 1 << 21
_PAD, _NONE = (1 << 22) - 1, np.int32((1 << 31) - 1)
_MASK = (1 << 64) - 1
_GOLDEN = 0x9E3779B97F4A7C15


def _mix(x: int) -> int:
    x = (x ^ (x >> 31)) * 0x7FB5D329728EA185 & _MASK
    x = (x ^ (x >> 27)) * 0x81DADEF4BC2DD44D & _MASK
    return x ^ (x >> 33)


def _mix_all(x: np.ndarray) -> np.ndarray:
    """_mix for an array of uint64."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class PairTable:
    """Ranks of pairs of symbols, by open addressing: the arrays are four times as long as the pairs."""

    def __init__(self, ranks: dict[tuple[int, int], int]):
        bits = max(4, (4 * len(ranks)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.rank = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for (a, b), r in ranks.items():
            at = ((a << 22 | b) * _GOLDEN & _MASK) >> 64 - bits
            while self.key[at] >= 0:
                at = at + 1 & self.last
            self.key[at], self.rank[at] = a << 22 | b, r

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 if it is no piece."""
        key = a.astype(np.int64) << 22 | b
        at = (key.view(np.uint64) * np.uint64(_GOLDEN) >> self.shift).view(np.int64)
        there = self.key[at]
        out = np.where(there == key, self.rank[at], -1)
        rest = np.flatnonzero((there != key) & (there >= 0))
        while len(rest):
            at[rest] = at[rest] + 1 & self.last
            there = self.key[at[rest]]
            out[rest] = np.where(there == key[rest], self.rank[at[rest]], -1)
            rest = rest[(there != key[rest]) & (there >= 0)]
        return out


class Codec:
    """One vocabulary with its merges; encode(text, key) and decode(ids), or many texts at once.

    The chance of a skip is `dropout`. Units (a word with the spaces before it, cut at line ends too)
    are segmented one by one; each occurrence has a key of its own, from the document's key and its
    place.
    """

    def __init__(self, path: str, *, seed: int = 42, dropout: float = 0.1):
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [(i, p.id_to_piece(i)) for i in range(p.get_piece_size())]
        plain = [(i, s) for i, s in names if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.ids = {s: i for i, s in plain}
        order = sorted(plain, key=lambda x: (-p.get_score(x[0]), x[0]))
        self.rank = {s: r for r, (_, s) in enumerate(order) if len(s) > 1}
        self.piece = np.array([i for i, _ in order], np.int32)
        self.bytes = {int(s[1:-1], 16): i for i, s in names if p.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError("the vocabulary has no piece for every byte, so that texts could not be restored")
        text = {i: s.replace(SPACE, " ").encode() for i, s in plain} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.text = pa.array([text.get(i, " ⁇ ".encode() if p.is_unknown(i) else b"") for i, _ in names], pa.large_binary())
        # a space is the space sign; a space sign of the text's own is another character
        self.symbol = np.arange(0x110000, dtype=np.int32) + OTHER
        for s, i in self.ids.items():
            if len(s) == 1:
                self.symbol[ord(" " if s == SPACE else s)] = i
        halves = ((s, s[:k], s[k:]) for s in self.rank for k in range(1, len(s)))
        self.pairs = PairTable({(self._of(a), self._of(b)): self.rank[s] for s, a, b in halves if all(len(x) == 1 or x in self.ids for x in (a, b))})
        self.whole = any(SPACE in s.lstrip(SPACE) for s in self.ids)  # pieces go across spaces, so units can't
        self.lines = not any("\n" in s and len(s) > 1 for s in self.ids)
        self.limit, self.seed = int(dropout * (1 << 32)), _mix(seed * _GOLDEN + 1 & _MASK)
        # of 2 ** 32 draws, those with a skip among the first 1, 2, ... candidates; later ones draw again
        self.gaps, left = [], 1 << 64
        for _ in range(REACH):
            left = left * ((1 << 32) - self.limit) >> 32
            self.gaps.append((1 << 32) - (left >> 32))
        self.edges = np.array(self.gaps, np.uint64)

    def _of(self, s: str) -> int:
        return self.ids[s] if s in self.ids else OTHER + ord(" " if s == SPACE else s)

    def skips(self, key: int | None) -> Iterator[int]:
        """The numbers, from 0, of the candidates that an occurrence skips; -1 if it skips none."""
        if key is None or not self.limit:
            yield -1
            return
        at = 0
        while True:
            gap = bisect_right(self.gaps, key >> 32)
            at += gap
            if gap < REACH:
                yield at
                at += 1
            key = _mix(key + _GOLDEN & _MASK)

    def _next_skips(self, keys: np.ndarray, at: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The next skip at or after candidate `at` of each occurrence, and the key of the draw after it."""
        gap = np.searchsorted(self.edges, keys >> np.uint64(32), "right")
        found, keys = at + gap, _mix_all(keys + np.uint64(_GOLDEN))
        while len(far := np.flatnonzero(gap == REACH)):
            gap[far] = np.searchsorted(self.edges, keys[far] >> np.uint64(32), "right")
            found[far] += gap[far]
            keys[far] = _mix_all(keys[far] + np.uint64(_GOLDEN))
        return found, keys

    def segment(self, unit: str, key: int | None) -> list[str]:
        """Pieces of one unit of any length, with a heap; no merge is skipped without a key."""
        symbols: list[str | None] = list(unit)
        n, rank, came, skips = len(symbols), self.rank, 0, self.skips(key)
        skip = next(skips)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, p) for i, p in enumerate(map("".join, zip(unit, unit[1:], strict=False))) if (r := rank.get(p)) is not None]
        heapq.heapify(agenda)
        while agenda:
            r, i, p = heapq.heappop(agenda)
            j = right[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != p:
                continue
            came += 1
            if came - 1 == skip:
                skip = next(skips)
                continue
            symbols[i], symbols[j] = p, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (s := rank.get(q := p + symbols[k])) is not None:
                    heapq.heappush(agenda, (s, i, q))
            h = left[i]
            if h >= 0 and (s := rank.get(q := symbols[h] + p)) is not None:
                heapq.heappush(agenda, (s, h, q))
        return [s for s in symbols if s is not None]

    def _segment_all(self, symbols: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """symbols (length + 1, units), padded, the last row all padding -> the same with pieces at
        their first places and -1 at the others.

        Step t takes the candidate number t of every unit that still has one: the least rank, then
        the leftmost. Ranks hold their place in the low 6 bits.
        """
        rows, n = symbols.shape
        place = np.arange(rows, dtype=np.int32)[:, None]
        ranks = np.full((rows, n), _NONE)
        found = self.pairs(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(rows - 1, n)
        ranks[:-1] = np.where(found >= 0, found << 6 | place[:-1], _NONE)
        right, left = (np.broadcast_to(x, (rows, n)).flatten() for x in (place + 1, (place - 1) % np.int32(rows)))
        flat, rank = symbols.reshape(-1), ranks.reshape(-1)
        skip, keys = self._next_skips(keys, 0) if self.limit else (np.full(n, -1), keys)
        t = 0
        while len(u := np.flatnonzero((least := ranks.min(0)) < _NONE)):
            least = least[u]
            i = least & 63
            at = i * n + u
            if len(hit := np.flatnonzero(skip[u] == t)):
                rank[at[hit]] = _NONE
                skip[u[hit]], keys[u[hit]] = self._next_skips(keys[u[hit]], t + 1)
                on = np.ones(len(u), bool)
                on[hit] = False
                u, least, i, at = u[on], least[on], i[on], at[on]
            j = right[at] * n + u
            made = self.piece[least >> 6]
            flat[at], flat[j], rank[j] = made, -1, _NONE
            k, h = right[j], left[at]
            right[at], left[k * n + u] = k, i
            beside = self.pairs(np.concatenate([made, flat[h * n + u]]), np.concatenate([flat[k * n + u], made]))
            beside = np.where(beside >= 0, beside << 6 | np.concatenate([i, h]), _NONE)
            rank[at], rank[h * n + u] = beside[: len(u)], beside[len(u) :]
            t += 1
        return symbols

    def encode_all(self, texts: list[str], doc_keys: list[int]) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text in turn. Without dropout the keys make no difference."""
        state = [_mix((k & _MASK) ^ self.seed) for k in doc_keys]
        at, n = 0, len(texts)
        while at < n:
            to, size = at + 1, len(texts[at])
            while to < n and size + len(texts[to]) <= SLICE:
                size += len(texts[to])
                to += 1
            if size <= SLICE or self.whole:
                yield from self._slice([t and " " + t for t in texts[at:to]], state[at:to])[0]
            else:
                yield self._long_text(" " + texts[at], state[at])
            at = to

    def _long_text(self, text: str, state: int) -> np.ndarray:
        """Part by part; a part ends where a space follows something else, which is between units."""
        out, at, units, cut = [], 0, 0, re.compile("(?<=[^ ])(?= )")
        while at < len(text):
            m = cut.search(text, at + SLICE)
            to = m.start() if m else len(text)
            (ids,), more = self._slice([text[at:to]], [state], units)
            out.append(ids)
            at, units = to, units + more
        return np.concatenate(out)

    def _slice(self, texts: list[str], states: list[int], before: int = 0) -> tuple[list[np.ndarray], int]:
        """The ids of each text, and the number of units; `before` units of the first are behind it."""
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        if not len(chars):
            return [np.empty(0, np.uint32) for _ in texts], 0
        first = np.zeros(len(chars), bool)  # where units begin
        sign = chars == ord(SPACE)
        space = chars == 32
        first[1:] = space[1:] & ~space[:-1] | sign[1:] | sign[:-1] if not self.whole else sign[1:] | sign[:-1]
        if self.lines and not self.whole:
            line = chars == 10
            first |= line
            first[1:] |= line[:-1]
        starts_of_texts = np.concatenate([[0], ends[:-1]])
        first[starts_of_texts[ends > starts_of_texts]] = True
        starts = np.flatnonzero(first)
        length = np.diff(starts, append=len(chars))
        text = np.searchsorted(ends, starts, "right")
        place = np.arange(len(starts)) - np.searchsorted(starts, starts_of_texts[text]) + 1 + np.where(text == 0, before, 0)
        keys = _mix_all(np.array(states, np.uint64)[text] + place.astype(np.uint64) * np.uint64(_GOLDEN))
        symbols = self.symbol[chars]
        done = symbols.copy()
        for low, high in zip((1, *LENGTHS[1:-1]), LENGTHS[1:], strict=True):
            units = np.flatnonzero((length > low) & (length <= high))
            if len(units):
                at = starts[units] + np.arange(high + 1)[:, None]
                inside = np.arange(high + 1)[:, None] < length[units]
                made = self._segment_all(np.where(inside, symbols[np.minimum(at, len(chars) - 1)], _PAD).astype(np.int32), keys[units])
                done[at[inside]] = made[inside]
        for n in np.flatnonzero(length > LENGTHS[-1]):
            at, to = int(starts[n]), int(starts[n] + length[n])
            done[at:to] = -1
            for s in self.segment(chars[at:to].tobytes().decode("utf-32-le").replace(" ", SPACE), int(keys[n])):
                done[at] = self._of(s)
                at += len(s)
        there = done >= 0
        ids, counts = done[there], np.concatenate([[0], np.cumsum(there)])[ends]
        if len(other := np.flatnonzero(ids >= OTHER)):
            raw = [[self.bytes[b] for b in chr(x - OTHER).encode()] for x in ids[other].tolist()]
            each = np.ones(len(ids), np.int64)
            each[other] = [len(x) for x in raw]
            counts = np.concatenate([[0], np.cumsum(each)])[counts]
            to = np.cumsum(each)[other]
            ids = np.repeat(ids, each)
            ids[np.concatenate([np.arange(e - len(x), e) for e, x in zip(to, raw, strict=True)])] = np.concatenate(raw)
        return np.split(ids.astype(np.uint32), counts[:-1]), len(starts)

    def encode(self, text: str, doc_key: int = 0) -> bytes:
        """Ids as native unsigned 32-bit numbers."""
        return next(self.encode_all([text], [doc_key])).tobytes()

    def decode_all(self, parts: list[np.ndarray]) -> list[str]:
        """What each list of ids stands for. Control pieces stand for nothing; a number that is no
        piece is an error; bytes that are no UTF-8 become U+FFFD."""
        if not parts:
            return []
        taken = self.text.take(pa.array(np.concatenate(parts), pa.uint32()))
        _, offsets, data = taken.buffers()
        raw = memoryview(data if data is not None else b"")
        at = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        at = at[np.concatenate([[0], np.cumsum([len(x) for x in parts])])].tolist()
        return [str(raw[a + (raw[a : a + 1] == b" ") : b], "utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: bytes) -> str:
        return self.decode_all([np.frombuffer(ids, np.uint32)])[0]


@cache
def codec(path: str, seed: int, dropout: float) -> Codec:
    """The codec of this process: a worker keeps it from task to task."""
    return Codec(path, seed=seed, dropout=dropout)


def encode(docs: DataFrame, path: str, *, seed: int = 42, dropout: float = 0.1, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary) for every row of docs; with dropout 0 the library's own ids.

    ids are little-endian unsigned 32-bit numbers on the usual machines. The segmentation depends on
    seed, id and text alone. decoded: adds what the ids decode to. Null and empty texts have no ids.
    Rows that repeat an id each have a row, null ids too. Other columns are not read. An empty table
    gives an empty result. A vocabulary without a piece for every byte is refused.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, seed, dropout)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # little is held at a time
                part = batch.slice(at, ROWS)
                ids = list(own.encode_all([t or "" for t in part.column(1).to_pylist()], part.column(2).to_pylist()))
                more = [pa.array(own.decode_all(ids), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), *more], names=["__id", "ids", *["decoded"] * decoded])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("__key"))
    made = source.mapInArrow(run, f"__id {kind}, ids binary" + ", decoded string" * decoded)
    return made.withColumnRenamed("__id", id_col)


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """encoded with the text of its ids in a further column; null ids give an empty text.

    A column that already has this name is replaced. Control pieces stand for nothing; a number that
    is no piece of the vocabulary is an error.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, 0, 0.0)
        for ids in batches:
            yield pd.Series(own.decode_all([np.frombuffer(x or b"", np.uint32) for x in ids]), dtype=object)

    return encoded.withColumn(name, run(F.col(ids_col)))
