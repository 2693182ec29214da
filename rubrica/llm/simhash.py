"""SimHash near-duplicate groups, compared bit plane by bit plane.

Fingerprints are made once per document in Arrow batches. Distinct fingerprints then meet in blocks
(see `pigeonhole_keys` and `anchors`), and inside a block the distances of one fingerprint to 64
others at a time are counted with carry-save adders over vertical bit planes; words of 64 lanes
whose lanes have all passed the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubrica.llm.common import cut
from rubrica.llm.components import connected

#: Rows of one block that one task compares; larger blocks are dealt out as pairs of pieces.
PIECE = 8192
#: Lanes (pairs) of small blocks that are counted at once.
LANES = 1 << 18


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `width` words (repeats included), of all words where there are fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    one, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(words[i:] for i in range(width)), strict=False)
    return np.fromiter((one(join(x), seed) for x in runs), np.uint64, len(words) - width + 1)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash that follows from h (splitmix finaliser)."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _majority(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = np.ascontiguousarray(h[at : at + 65536]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


def sketches(docs: DataFrame, *, width: int = 3, seed: int = 42, words: int = 1, anchors: int = 0, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp array of `words` longs, anchors array of longs) for every row of docs.

    A bit is 1 if it is set in over half of the shingle hashes; word 0 uses the XXH64 values
    themselves, word k values mixed from them. Anchors are minima of differently mixed hashes: two
    texts share one with a probability that is their Jaccard similarity. distinct: a shingle that
    repeats counts once. Null and empty texts have a zero fingerprint and the anchor 0.
    """

    @F.pandas_udf("fp array<bigint>, anchors array<bigint>")
    def made(texts: pd.Series) -> pd.DataFrame:
        fps, mins = [], []
        for text in texts:
            h = shingle_hashes(text, width, seed)
            if distinct:
                h = np.unique(h)
            if not len(h):
                fps.append([0] * words)
                mins.append([0] * anchors)
                continue
            fps.append([_majority(h if not k else _mixed(h, k)) for k in range(words)])
            mins.append([int(_mixed(h, 100 + k).min().view(np.int64)) for k in range(anchors)])
        return pd.DataFrame({"fp": fps, "anchors": mins})

    # ids stay in the JVM, so that a null among them doesn't turn the others into floats
    found = docs.select(F.col(id_col).alias("__id"), made(F.col(text_col)).alias("s"))
    return found.select("__id", "s.fp", "s.anchors")


def pigeonhole_keys(fp: Column, radius: int) -> Column:
    """Block keys under which any two fingerprints of 64 bits within the radius meet at least once.

    The bits are cut into radius + 2 pieces; at least two pieces are free of differing bits.
    """
    cuts = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(signed(masks[i] | masks[j]))).alias("key")) for t, (i, j) in enumerate(combinations(range(radius + 2), 2))])


def planes(fps: np.ndarray) -> np.ndarray:
    """Fingerprints (n, words) of uint64 -> bit planes (64 * words, ceil(n / 64)) of uint64."""
    n, words = fps.shape
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8 * words), axis=1, bitorder="little")
    bits = np.vstack([bits, np.zeros((-n % 64, 64 * words), np.uint8)])
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _added(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two numbers per lane, each a list of planes, lowest bit first (ripple of full adders)."""
    out, carry = [], None
    for a, b in zip(x, y, strict=True):
        half = a ^ b
        if carry is None:
            out.append(half)
            carry = a & b
        else:
            out.append(half ^ carry)
            carry = (a & b) | (half & carry)
    return [*out, carry]


def _counted(block: np.ndarray) -> list[np.ndarray]:
    """Ones per lane over 2 ** k planes, as k + 1 planes: a tree of carry-save adders."""
    number = [block]
    while number[0].shape[0] > 1:
        half = number[0].shape[0] // 2
        number = _added([x[:half] for x in number], [x[half:] for x in number])
    return [x[0] for x in number]


def within(differ, n_planes: int, n_words: int, radius: int, step: int = 16) -> np.ndarray:
    """Lanes with at most `radius` ones over the planes that `differ(first plane, last, words)` gives.

    Each `step` planes (a power of two that divides n_planes) are summed by carry-save adders and
    added to the bitwise counters; then the words in which every lane has passed the radius are
    abandoned. Returns a uint64 mask for each word.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out, live = np.zeros(n_words, np.uint64), np.arange(n_words)
    depth = max(radius.bit_length(), step.bit_length()) + 1
    counters = np.zeros((depth, n_words), np.uint64)
    beyond = np.zeros(n_words, np.uint64)
    for at in range(0, n_planes, step):
        number = _counted(differ(at, at + step, live))
        carry = None
        for k in range(depth):
            a, b = counters[k], number[k] if k < len(number) else None
            if b is None and carry is None:
                break
            if carry is None or b is None:
                b = carry if b is None else b
                counters[k], carry = a ^ b, a & b
            else:
                half = a ^ b
                counters[k], carry = half ^ carry, (a & b) | (half & carry)
        if carry is not None:
            beyond |= carry
        over, same = beyond.copy(), np.full(len(live), full)
        for k in reversed(range(depth)):  # counter > radius, from the top bit down
            if radius >> k & 1:
                same &= counters[k]
            else:
                over |= same & counters[k]
                same &= ~counters[k]
        if at + step >= n_planes:
            out[live] = ~over
        elif not (keep := over != full).all():
            live, counters, beyond = live[keep], np.ascontiguousarray(counters[:, keep]), beyond[keep]
            if not len(live):
                break
    return out


def _lanes(mask: np.ndarray) -> np.ndarray:
    return np.unpackbits(mask.view(np.uint8), bitorder="little").astype(bool)


class _Overlap:
    """Jaccard similarities of one row's shingle set with all rows of a block, by its postings."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        _, self.names = np.unique(flat, return_inverse=True)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        order = np.argsort(self.names, kind="stable")
        self.rows = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(self.names))])

    def __call__(self, q: int) -> np.ndarray:
        own = self.names[self.ends[q] : self.ends[q + 1]]
        parts = [self.rows[self.at[s] : self.at[s + 1]] for s in own]
        shared = np.bincount(np.concatenate(parts), minlength=len(self.sizes)) if parts else np.zeros(len(self.sizes))
        return shared / np.maximum(1, self.sizes[q] + self.sizes - shared)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def block_links(fps: np.ndarray, side: np.ndarray | None, radius: int, sets: list[np.ndarray] | None = None, least: float = 0.0) -> list[tuple[int, int]]:
    """Links that span every group of rows within the radius of each other in one block.

    Lanes that already hang together with the asking row are not counted again. side: for a pair of
    pieces, rows of side 0 ask and those of side 1 answer (rows of one side meet elsewhere). sets:
    shingle sets, of which a link needs a Jaccard similarity of `least`. Rows near the block's
    majority ask first: copies of one text gather round it, and then need no further comparison.
    """
    n, found = len(fps), []
    own, label = planes(fps), np.arange(len(fps))
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, -1), axis=1, bitorder="little").astype(bool)
    order = np.argsort((bits != (bits.mean(0) > 0.5)).sum(1), kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    full, none = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    asked = np.zeros(own.shape[1] * 64, bool)
    overlap = None
    for q in order if side is None else order[side[order] == 0]:
        asked[:n] = (label != label[q]) & (place > place[q] if side is None else side == 1)
        words = np.flatnonzero(asked.reshape(-1, 64).any(1))
        if not len(words):
            continue
        flip = np.where(bits[q], full, none)[:, None]
        near = within(lambda a, b, w, flip=flip, words=words: own[a:b, words[w]] ^ flip[a:b], own.shape[0], len(words), radius)
        lanes = (words[:, None] * 64 + np.arange(64)).ravel()[_lanes(near)]
        lanes = lanes[asked[lanes]]
        if len(lanes) and sets is not None:
            overlap = overlap or _Overlap(sets)
            lanes = lanes[overlap(q)[lanes] >= least]
        if len(lanes):
            groups, first = np.unique(label[lanes], return_index=True)
            found += [(int(q), int(lanes[i])) for i in first]
            label[np.isin(label, groups)] = label[q]
    return found


class _Forest:
    """Union-find over the rows of many blocks; tells which links join two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def small_links(fps: np.ndarray, starts: np.ndarray, radius: int, sets: list[np.ndarray] | None = None, least: float = 0.0) -> list[tuple[int, int]]:
    """The same for many small blocks at once: rows starts[i] to starts[i + 1] make up a block."""
    found, forest = [], _Forest(len(fps))
    sizes = np.diff(starts)
    for size in np.unique(sizes[sizes > 1]):
        a, b = np.triu_indices(size, 1)
        bases = starts[:-1][sizes == size]
        each = max(1, LANES // len(a))
        for at in range(0, len(bases), each):
            base = bases[at : at + each, None]
            left, right = (base + a).ravel(), (base + b).ravel()
            p = planes(fps[left] ^ fps[right])
            near = within(lambda a, b, w, p=p: p[a:b, w], p.shape[0], p.shape[1], radius)
            hits = np.flatnonzero(_lanes(near))
            for i in hits[hits < len(left)]:
                x, y = int(left[i]), int(right[i])
                if forest.root(x) != forest.root(y) and (sets is None or jaccard(sets[x], sets[y]) >= least):
                    forest.link(x, y)
                    found.append((x, y))
    return found


def _compare(radius: int, least: float):
    """Links in the blocks of a partition that is sorted by (t, key, piece)."""

    def solve(ids, fps, side, starts, sets) -> pd.DataFrame:
        links = []
        small = np.diff(starts) <= 64
        mixed = np.array([side[a:b].max() >= 0 for a, b in zip(starts, starts[1:], strict=False)], bool)
        easy = small & ~mixed
        if easy.any():
            rows = np.concatenate([np.arange(a, b) for a, b in zip(starts[:-1][easy], starts[1:][easy], strict=True)])
            at = np.concatenate([[0], np.cumsum(np.diff(starts)[easy])])
            links += [(rows[x], rows[y]) for x, y in small_links(fps[rows], at, radius, sets and [sets[r] for r in rows], least)]
        for i in np.flatnonzero(~easy):
            a, b = starts[i], starts[i + 1]
            s = side[a:b]
            links += [(a + x, a + y) for x, y in block_links(fps[a:b], s if s.max() >= 0 else None, radius, sets and sets[a:b], least)]
        return pd.DataFrame({"a": [ids[x] for x, _ in links], "b": [ids[y] for _, y in links]}, dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: list[pd.DataFrame] = []  # rows of one block that may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            k = batch[["t", "key", "pair"]].to_numpy()
            if carry and (k[0] != last).any():  # noqa: F821
                yield finish(pd.concat(carry))
                carry = []
            if len(change := np.flatnonzero((k[1:] != k[:-1]).any(1))):
                yield finish(pd.concat([*carry, batch[: change[-1] + 1]]))
                carry = [batch[change[-1] + 1 :]]
            else:
                carry.append(batch)
            last = k[-1]
        if carry:
            yield finish(pd.concat(carry))

    def finish(x: pd.DataFrame) -> pd.DataFrame:
        if len(x) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        fps = np.array(x["fp"].tolist(), np.int64).view(np.uint64)
        t, key, pair = (x[c].to_numpy() for c in ("t", "key", "pair"))
        new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        sets = list(x["shingles"]) if "shingles" in x else None
        return solve(x["node"].to_numpy(), fps, x["side"].to_numpy(), np.concatenate([[0], new, [len(x)]]), sets)

    return run


def links_in_blocks(nodes: DataFrame, radius: int, least: float = 0.0, sets: DataFrame | None = None) -> DataFrame:
    """nodes(node long, fp, keys array<struct<t, key>>) -> (a, b): links that join all nodes which
    meet in a block within the radius, directly or through others of that block.

    With sets(node, shingles: distinct longs) a link also needs a Jaccard similarity of `least`;
    sets join last, and of blocks with the same nodes only one is compared. A block of over PIECE rows is dealt out whole: its rows fall into pieces by hash, and every two
    pieces (and each with itself) meet in a task of their own.
    """
    payload = [c for c in nodes.columns if c != "keys"]
    rows = nodes.select(*payload, F.explode("keys").alias("k")).select(*payload, "k.t", "k.key")
    if sets is None:
        sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    else:
        members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
        sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size"), *members).where("size > 1")
        sizes = sizes.groupBy("size", "x1", "x2").agg(F.min(F.struct("t", "key")).alias("k")).select("k.t", "k.key", "size")
    sizes = cut(sizes)  # both sides of the join are plain exchanges then, and a hot block can be split
    rows = rows.join(sizes, ["t", "key"])
    pieces = F.ceil(F.col("size") / PIECE).cast("int")
    mine = F.pmod(F.xxhash64("node"), pieces).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda j: F.struct(
        (F.least("mine", j) * F.col("pieces") + F.greatest("mine", j)).alias("pair"),
        F.when(F.col("mine") == j, -1).when(F.col("mine") < j, 0).otherwise(1).alias("side")))
    rows = rows.withColumn("pieces", pieces).withColumn("mine", mine).withColumn("met", F.explode(met))
    rows = rows.select("t", "key", F.col("met.pair").alias("pair"), F.col("met.side").alias("side"), *payload)
    if sets is not None:
        rows = rows.join(sets, "node")
    rows = rows.repartition("t", "key", "pair").sortWithinPartitions("t", "key", "pair")
    return rows.mapInPandas(_compare(radius, least), "a bigint, b bigint").distinct()


def _shingles(docs: DataFrame, linked: DataFrame, width: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles): the distinct shingles of the text behind each node of linked."""

    @F.pandas_udf("array<bigint>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, width, seed)).view(np.int64) for t in texts], dtype=object)

    wanted = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("__text")).join(linked.select("node"), "node", "left_semi")
    return wanted.select("node", made("__text").alias("shingles")).dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, *, width: int = 3, radius: int = 2, words: int = 1, anchors: int = 0, seed: int = 42, least: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp array<bigint>, component_id) for every row of docs, dropped by nobody.

    Fingerprints of 64 * words bits link at `radius` or fewer differing bits; component_id is the
    smallest id that links reach. With anchors = 0 the blocks are those of `pigeonhole_keys` and no
    link is lost (words must be 1). With anchors > 0 a link is found if the two shingle sets share
    one of so many minima, with probability 1 - (1 - J) ** anchors at Jaccard similarity J.

    least: links also need this exact Jaccard similarity of the shingle sets, and the fingerprints
    are made of these sets, so that repeats within a text do not matter. Then the search runs twice:
    first by fingerprints alone, which leaves few rows, and again over those with their sets.

    Ids are whole numbers; others are refused. Null and empty texts have the fingerprint 0 and link
    like any others. Rows that repeat an id each have a row (with `least`, one of their texts speaks
    for all); a null id keeps its row and never names a component unless all of its group are null (then component_id is null). Columns of
    docs other than the two named are not read. An empty table gives an empty result.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} has to be a whole number")
    made = cut(sketches(docs, width=width, seed=seed, words=words, anchors=anchors, distinct=least is not None, id_col=id_col, text_col=text_col))
    nodes = made.groupBy("fp", "anchors").agg(F.min("__id").alias("node"))
    real = nodes.where("node is not null")
    if anchors:
        keys = F.transform("anchors", lambda x, i: F.struct(i.alias("t"), x.alias("key")))
    elif words == 1:
        keys = pigeonhole_keys(F.col("fp")[0], radius)
    else:
        raise ValueError("without anchors a fingerprint has 64 bits")
    blocked = real.select("node", "fp", keys.alias("keys"))
    links = links_in_blocks(blocked, radius)
    if least is not None:
        links = cut(links)
        linked = blocked.join(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
        links = links_in_blocks(linked, radius, least, _shingles(docs, linked, width, seed, id_col, text_col))
    roots = connected(links)
    named = nodes.join(roots, "node", "left").select("fp", "anchors", F.coalesce("root", "node").alias("component_id"))
    return made.join(named, ["fp", "anchors"], "left").select(F.col("__id").alias(id_col), "fp", "component_id")
