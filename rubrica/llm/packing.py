"""Packing of token pieces into fixed-length sequences: first-fit decreasing over a tournament tree.

Documents are tokenised in Arrow batches and cut into full sequences and one remainder each. Pieces
are then dealt into random groups of bounded size, and each group is packed by itself.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

LENGTH = 4096
#: Characters of texts whose pieces make up a group, about (some 2 million ids, 8 MB).
GROUP = 1 << 23
#: Words and parts whose ids one worker keeps; the store starts anew beyond that.
MOST_WORDS = 200_000
#: Documents that a worker handles at a time.
SLICE = 256

#: Texts of these characters alone are the same in NFC, and white space always ends a word in them.
_PLAIN = re.compile("[^\t\n\x0b\x0c\r -~¡-įı-ňŊ-ž]")
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: The rules of the vocabulary that WordStore knows by heart. With any other the
#: tokenizer itself does the work.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None,
}


#: What the vocabulary's own rules make of a lower-cased word of such characters.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿĀ-ž]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿĀ-ž0-9²³¹¼½¾]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a visible character: itself, or one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordStore(dict):
    """Ids of words and of their parts as bytes (little-endian, 32 bits each), made on demand.

    Where a vocabulary has _RULES, these never look across white space, so a text's ids are those of
    its words, and a word's ids are those of its parts. Any other vocabulary is asked for whole texts.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.most, self.letters = self.tokenizer.model, most, _byte_letters()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.known = all(rules.get(k) == v for k, v in _RULES.items()) and {t["content"] for t in rules["added_tokens"]} == set(_SPECIAL) and rules["model"].get("dropout") is None

    def __missing__(self, word: str) -> bytes:
        parts = _PARTS.findall(word)
        if parts == [word]:
            shown = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            made = _bytes([t.id for t in self.model.tokenize(shown)])
        else:
            made = b"".join([self[p] for p in parts])
        self[word] = made
        return made

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text: the same as the tokenizer's own without special tokens."""
        if not text:
            return b""
        if len(self) > self.most:
            self.clear()
        if self.known and _PLAIN.search(text) is None and not any(s in text for s in _SPECIAL):
            return b"".join(map(self.__getitem__, text.lower().split()))
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)


@cache
def word_store(path: str) -> WordStore:
    """The store of this process: a worker keeps it from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordStore(path)


def _bytes(ids: list[int]) -> bytes:
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids binary, doc_tokens): each text's ids and end_id, cut every `length` ids.

    ids are little-endian unsigned 32-bit numbers. Null texts count as empty and have the end id
    alone. Rows that repeat an id are cut each by itself; a null id stays null. Only the two named
    columns are read. An empty table gives an empty result.
    """
    size = 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, end = word_store(tokenizer_path), _bytes([end_id])
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):  # little is held at a time
                part = batch.slice(at, SLICE)
                rows, starts, ids, totals = [], [], [], []
                for n, text in enumerate(part.column(1).to_pylist()):
                    whole = store.encode(text) + end
                    for start in range(0, len(whole), size):
                        rows.append(n)
                        starts.append(start // 4)
                        ids.append(whole[start : start + size])
                        totals.append(len(whole) // 4)
                made = [starts, [len(x) // 4 for x in ids], ids, totals]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *map(pa.array, made, kinds)], names=["__id", "start", "length", "ids", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    made = source.mapInArrow(run, f"__id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint")
    return made.select(F.col("__id").alias(id_col), "start", "length", "ids", "doc_tokens")


class Bins:
    """Room left in each bin of `length`, with the most room of every subtree above it."""

    def __init__(self, length: int, most: int):
        self.length, self.leaves = length, 1 << max(0, most - 1).bit_length()
        self.room = [length] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """The first bin with room for size, and the offset that the piece gets there."""
        room, at = self.room, 1
        while at < self.leaves:
            at = 2 * at if room[2 * at] >= size else 2 * at + 1
        offset = self.length - room[at]
        room[at] -= size
        leaf = at - self.leaves
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return leaf, offset


def first_fit_decreasing(sizes: list[int], length: int) -> list[tuple[int, int]]:
    """(bin, offset) for each size; ties are taken in the order given."""
    bins, out = Bins(length, len(sizes)), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.put(sizes[i])
    return out


def groups_for(docs: DataFrame, group: int = GROUP, *, text_col: str = "text") -> int:
    """How many groups to deal the pieces of docs into: one for each `group` characters, 1 at least."""
    chars = docs.agg(F.coalesce(F.sum(F.length(text_col).cast("bigint") + 1), F.lit(0))).first()[0]
    return max(1, round(chars / group))


def pack(made: DataFrame, groups: int, *, length: int = LENGTH, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Pieces with sequence_id and offset; all rows and other columns of `made` stay (columns that have
    these two names are replaced).

    made has the columns id, start, length and whatever else is to travel. Documents go to random
    groups by a hash of their ids; their full pieces, which fill a sequence each and need no partner,
    by a hash of id and start, so that a very long document is no group by itself. Null ids, which
    nothing tells apart, go to a group by a seeded random number. A group's pieces are taken by falling
    length, then id and start. A sequence's pieces follow each other without gaps; sequence_id is
    unique over all groups, and rows of equal id and start are packed each. An empty table gives an
    empty result.
    """
    # ids travel as text through pandas, where a null would turn the others into floats
    kind, made = made.schema[id_col].dataType, made.drop("sequence_id", "offset")
    full = F.when(F.col("length") >= length, F.col("start")).otherwise(-1)
    group = F.when(F.col(id_col).isNull(), F.floor(F.rand(seed) * groups)).otherwise(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), full), F.lit(groups)))
    wide = made.select(group.alias("group"), *[(F.col(f"`{c}`").cast("string") if c == id_col else F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(made.columns)])
    at = {c: f"_{i}" for i, c in enumerate(made.columns)}
    schema = T.StructType([f for f in wide.schema.fields if f.name != "group"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def solve(key, frame):
        frame = frame.drop(columns="group").sort_values([at[id_col], at["start"]], kind="stable")
        placed = first_fit_decreasing([int(x) for x in frame[at["length"]]], length)
        return frame.assign(sequence_id=[(int(key[0]) << 32) + b for b, _ in placed], offset=[o for _, o in placed])

    packed = wide.groupBy("group").applyInPandas(solve, schema)
    return packed.select(*[(F.col(at[c]).cast(kind) if c == id_col else F.col(at[c])).alias(c) for c in made.columns], "sequence_id", "offset")
