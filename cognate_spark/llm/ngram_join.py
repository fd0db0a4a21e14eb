"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A document is the set of its shingles of `size` words (white space between, A-Z lower-cased; a text of fewer words is
one shingle). Documents with equal sets are copies and form one class, which is worked on once. A class has a
signature of TREES x DEPTH minimum hashes: in each tree of the forest its DEPTH values are a path, and the paths of a
tree, in order, are a prefix trie. Classes that share the first LEAST_DEPTH values meet once, in one task; there they are matched
by whole paths first and then by ever shorter prefixes. Each edge is marked with the depth at which it came up.

How short prefixes have to be is measured. Documents chosen by a hash, at most `QUERIES` with at most `QUERY_SHINGLES` shingles in all, are
compared exactly with all documents while these are sketched. Edges of whole paths are used first, then those of shorter prefixes, until
the components hold the target share of the queries' links and the share expected at the links' similarities,
1 - (1 - s ** depth) ** TREES, reaches it too. What sketches, crowded nodes and the like lose is in that measure. A query of more than
`LONG` shingles is compared by a sample of them (those whose hash has so many zero bits), so long texts are measured as well. The
measure is logged, with a warning if the shortest prefixes do not reach the target; below `least_recall` the join raises an error.

In a node, classes are compared with pivots by a small sketch, and what leaves it is one edge a class at most, to the
class with the least hash of its group: so the edges of different trees coincide. A node of more than CHUNK classes is
compared with its class of the least hash first; those that are not near copies of it are split by length (classes whose
lengths cannot be linked do not meet; that loses nothing) and go through in order of their paths, prolonged by the next tree's, so that
those with the longest common prefixes stay together.

What the forest loses, there or elsewhere, `rest` finds by an exact way. All shingles have one order, the same for all documents: those seen more than once among
the queries come last, by how often, and ties go by the hash. Of two linked sets each has one of the other's first n - ceil(threshold * n) + 1
shingles in this order among its own first ones; before the hash go counts of all documents' shingles (`counted`), so that
the order tells seldom ones from others as well in a large corpus as in a small one. So classes of different components that share a first shingle are compared, all with all,
crowds by tiles; what rules pairs out are bounds that no link exceeds: lengths, places in the order, and parities of
the shingles in cells, of which no more can differ than shingles do. The order decides only how many pairs meet.

The components of all edges
are then verified exactly: every pair of a component whose lengths allow a link, by tiles of at most TILE x TILE classes, from
the whole texts. So no link is lost.

Result per document: class_id (least id of its component of links), copy_id (least id of equal sets), n_links
(documents with similarity >= threshold, copies included). Documents without words have no links and are classes by
themselves. Ids of any type that can be ordered; null ids are ids like others; null texts are empty. Repeated rows are
documents by themselves and copies. Other columns stay out.
"""

from __future__ import annotations

import hashlib
import logging
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_map, bounded, kind_of, may_be_in, text_of, unused, written
from .components import components

TREES, DEPTH, LEAST_DEPTH = 32, 8, 5
#: Hashes in the sketch, four bits each.
SKETCH = 128
CHUNK, TILE = 256, 512
#: Sketch similarity from which classes are put into one component, and from which a pivot stands for a class.
NEAR, SAME = 0.55, 0.86
#: Documents that are compared with all others to measure recall, their shingles in all (32 MB in a worker), those of one query, and of
#: how many queries a document's links are noted.
QUERIES, QUERY_SHINGLES, LONG, NOTED = 2048, 1 << 20, 8192, 64
#: A long query's similarity is estimated, so what it counts as a link is this much above the threshold.
MARGIN = 0.02
#: Rows (40 bytes) that may be broadcast to fetch the texts of candidates.
BROADCAST_ROWS = 200_000
#: The bit map of shared nodes has 2^26 bits, in at most 2^20 rows of 64 (16 MB), which are broadcast.
FILTER_BITS = 26
#: Parities by which pairs of `rest` are compared first; those of more than half as many shingles are compared again by all of their own.
PARITIES = 1 << 11
#: Counters of shingles, 2^COUNT_BITS (one byte each where they are sent to), in COUNT_BLOCKS blocks; a level is so many times the one before.
COUNT_BITS, COUNT_BLOCKS, LEVEL = 22, 64, 1.06
#: Classes on a side of a tile of `rest`.
SIDE = 1024

_LOG = logging.getLogger(__name__)
_R = np.random.default_rng(42)
_A = (_R.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) << 1) | 1
_X = _R.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_P = [np.uint64(int(x) | 1) for x in _R.integers(0, 1 << 63, 16, dtype=np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the runs without ASCII white space, in order. Nothing is remembered: most words of a corpus are seldom."""
    import xxhash

    words = raw.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Distinct 64-bit shingle hashes of the whole text, sorted."""
    h = _word_hashes(text.encode().lower())  # bytes: ASCII letters and blanks only
    if not len(h):
        return h
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        s = np.zeros(len(h) - n + 1, np.uint64) + np.uint64(n)
        for k in range(n):
            s = s * _P[0] + h[k : k + len(s)]
    s = np.sort(_mixed(s))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signature(s: np.ndarray, block: int = 4096) -> np.ndarray:
    """16 bits of each of the TREES x DEPTH minimum hashes, tree by tree."""
    x = (s >> np.uint64(16)).astype(np.uint32)
    low = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), block):
        np.minimum(low, ((x[at : at + block, None] ^ _X) * _A).min(0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


@dataclass(frozen=True)
class Query:
    """digest and number of a set's shingles, and those of them whose lowest `zeros` bits are zero."""

    digest: bytes
    n: int
    zeros: int
    some: np.ndarray

    @classmethod
    def of(cls, s: np.ndarray, most: int = LONG) -> Query:
        zeros = 0
        while len(some := s[s & np.uint64((1 << zeros) - 1) == 0]) > most:
            zeros += 1
        return cls(digest(s), len(s), zeros, some)


class Queries:
    """Shingle sets of some documents, with which others are compared."""

    BITS = 24

    def __init__(self, queries: list[Query], threshold: float) -> None:
        self.threshold, self.sizes = threshold, np.array([q.n for q in queries], np.int64)
        self.times = np.array([1 << q.zeros for q in queries], np.int64)
        self.least = threshold + np.where(self.times > 1, MARGIN, -1e-12)
        owner = np.repeat(np.arange(len(queries), dtype=np.int32), [len(q.some) for q in queries])
        all_ = np.concatenate([*(q.some for q in queries), np.empty(0, np.uint64)])
        order = np.argsort(all_, kind="stable")
        self.owner = owner[order]
        self.keys, first = np.unique(all_[order], return_index=True)
        self.first = np.append(first, len(all_)).astype(np.int32)
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - self.BITS)] = True

    def links(self, s: np.ndarray) -> list[dict]:
        """Queries that have a similarity of the threshold or more with the set s, the first NOTED of them."""
        few = s[self.maybe[s >> np.uint64(64 - self.BITS)]]
        if not len(few):
            return []
        at = np.minimum(np.searchsorted(self.keys, few), len(self.keys) - 1)
        at = at[self.keys[at] == few]
        times = self.first[at + 1] - self.first[at]
        place = np.repeat(self.first[at] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        common = np.bincount(self.owner[place], minlength=len(self.sizes)) * self.times
        score = common / np.maximum(self.sizes + len(s) - common, 1)
        return [{"q": int(q), "s": min(float(score[q]), 1.0)} for q in np.flatnonzero(score >= self.least)[:NOTED]]


class Order:
    """An order of all shingles: by how often they occur among the queries, if more than once, then by their level, then by the hash."""

    def __init__(self, queries: list[Query], levels: np.ndarray | None = None) -> None:
        keys, times = np.unique(np.concatenate([*(q.some for q in queries), np.empty(0, np.uint64)]), return_counts=True)
        self.keys, self.times = keys[times > 1], times[times > 1].astype(np.int32)
        self.levels = np.zeros(1 << COUNT_BITS, np.uint8) if levels is None else levels

    def first(self, s: np.ndarray, threshold: float) -> np.ndarray:
        """The first shingles of the sorted set s: a set linked to it has one of these among its own."""
        place = self.levels[s >> np.uint64(64 - COUNT_BITS)].astype(np.int32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
            place += np.where(self.keys[at] == s, self.times[at], 0) << 8
        return s[np.argsort(place, kind="stable")[: len(s) - math.ceil(threshold * len(s) - 1e-9) + 1]]


def parities(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles in cells, 2^k bits, two to four a shingle. Sets that differ in d shingles differ in at most d of them, also
    when both are folded."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of parities with so many bytes a row: those that the sets have in fewer cells."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _may_differ(n: np.ndarray, m: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of linked sets of n and m shingles: how many they have in common at least, and in how many they differ at most."""
    common = np.ceil(threshold / (1 + threshold) * (n + m) - 1e-6)
    return common, n + m - 2 * common


_NEAR_TYPE = pa.list_(pa.struct([("q", pa.int32()), ("s", pa.float64())]))


def _sketched(size: int, sent) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, order = sent.value
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, len(whole), 1024)):
            digests, signs, sketches, sizes, near, first, odd, whole = [], [], [], [], [], [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py(), size)
                sizes.append(len(s))
                if not len(s):
                    digests.append(None), signs.append(None), sketches.append(None), near.append([]), first.append(None), odd.append(None), whole.append(None)
                    continue
                first.append(order.first(s, queries.threshold).view(np.int64))
                bits = parities(s)
                odd.append(folded(bits, PARITIES // 8).tobytes()), whole.append(bits.tobytes() if len(bits) > PARITIES // 8 else None)
                sign = signature(s)
                nibbles = (sign[: SKETCH] & 15).astype(np.uint8)
                digests.append(digest(s)), signs.append(sign.tobytes()), sketches.append((nibbles[::2] << 4 | nibbles[1::2]).tobytes()), near.append(queries.links(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in (digests, signs, sketches)), pa.array(sizes, pa.int32()), pa.array(near, _NEAR_TYPE), pa.array(first, pa.list_(pa.int64())), *(pa.array(x, pa.binary()) for x in (odd, whole))], ["doc_id", "print", "set", "signature", "sketch", "n", "near", "first", "odd", "whole"])

    return run


def text_print(text: Column) -> Column:
    return F.xxhash64(text)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of sketches, row by row; four bits agree by chance."""
    out = np.empty(len(a))
    for at in range(0, len(a), 1 << 16):
        x = a[at : at + (1 << 16)] ^ b[at : at + (1 << 16)]
        out[at : at + (1 << 16)] = ((x & 15 == 0).sum(1) + (x >> 4 == 0).sum(1)) / SKETCH
    return (out - 1 / 16) / (15 / 16)


class _Groups:
    """Groups that edges hold together; the root of a group is its first member."""

    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def top(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        """Joins a with b; the new and the old roots of the groups that have got another one."""
        old = set()
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.top(x), self.top(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                old.add(max(x, y))
        ordered = sorted(old)
        return [self.top(x) for x in ordered], ordered

    def joining(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins a with b; which of these pairs have made one group of two."""
        out = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = self.top(x), self.top(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                out[i] = True
        return out


def _forest(node: np.ndarray, path: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, depth) between rows of a node whose sketches are near, by whole paths first, then by ever shorter
    prefixes. Rows come by node and, in it, by their hash; a row leaves at most one edge."""
    n = len(node)
    groups, alive = _Groups(n), np.arange(n)
    out: list[tuple[list[int], list[int], int]] = []
    level = np.unique(node, return_inverse=True)[1]
    prefixes = {LEAST_DEPTH: level}
    for d in range(LEAST_DEPTH + 1, DEPTH + 1):  # numbers of the prefixes, each from the shorter one and a value
        level = prefixes[d] = np.unique(level.astype(np.int64) << 16 | path[:, d - 1], return_inverse=True)[1]
    for d in range(DEPTH, LEAST_DEPTH - 1, -1):
        key = prefixes[d]
        left = alive[np.argsort(key[alive], kind="stable")]
        gone, a, b = np.zeros(n, bool), [], []
        while len(left) > 1:
            own = key[left]
            first = np.concatenate([[True], own[1:] != own[:-1]])
            pivot = left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))]
            here, its = left[~first], pivot[~first]
            if not len(here):
                break
            near = _agreement(raw[here], raw[its])
            hit = near >= NEAR
            a.append(its[hit]), b.append(here[hit])
            gone[here[near >= SAME]] = True
            left = here[near < SAME]
        if a:
            new, old = groups.join(np.concatenate(a), np.concatenate(b))
            out.append((new, old, d))
        alive = alive[~gone[alive]]
    return tuple(np.array([x for part in out for x in (part[i] if i < 2 else [part[2]] * len(part[0]))], np.int64) for i in range(3))


_EDGES = "a binary, b binary, depth int"


def _table(parts: list) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """node, sets, paths and sketches of rows (node, set, path, sketch, ...)."""
    table = parts[0] if isinstance(parts[0], pa.Table) else pa.Table.from_batches(parts).combine_chunks()
    n = len(table)
    fixed = lambda i, kind: np.frombuffer(b"".join(table.column(i).to_pylist()), kind).reshape(n, -1)
    return table.column(0).to_numpy(), table.column(1).combine_chunks(), fixed(2, "<u2").astype(np.int64), fixed(3, np.uint8)


def _found(sets: pa.Array, edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([sets.take(pa.array(edges[0])), sets.take(pa.array(edges[1])), pa.array(edges[2].astype(np.int32))], ["a", "b", "depth"])


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches put together so that rows of one node (the first column, sorted) are never parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        node = batch.column(0).to_numpy()
        cut = int(np.flatnonzero(node != node[-1])[-1]) + 1 if (node != node[-1]).any() else 0
        if held and (cut or held[-1].column(0)[-1].as_py() != node[0]):
            yield [*held, batch.slice(0, cut)]
            held = []
        elif cut:
            yield [batch.slice(0, cut)]
        held.append(batch.slice(cut))
    if held:
        yield held


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between classes of a node. Rows (node, set, path, sketch) come sorted by node and hash; a node has at most CHUNK."""
    for parts in _whole_nodes(batches):
        node, sets, path, raw = _table(parts)
        yield _found(sets, _forest(node, path, raw))


def _crowded_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of crowded nodes. Rows (node, set, path, sketch, rank, head, head path, head sketch) come by node and path. Classes that
    are far apart in this order do not meet here; `rest` compares those that may be linked."""
    tail: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        both = pa.Table.from_batches([*tail, batch]).combine_chunks()
        node, sets, path, raw = _table([both])
        ranks, n = both.column(4).to_numpy(), len(both)
        heads, head_raw = (np.frombuffer(b"".join(both.column(i).to_pylist()), kind).reshape(n, -1) for i, kind in ((6, "<u2"), (7, np.uint8)))
        near = _agreement(raw, head_raw)
        hit = np.flatnonzero(near >= NEAR)
        depth = np.maximum(np.cumprod(path[hit, :DEPTH] == heads[hit, :DEPTH], 1).sum(1), LEAST_DEPTH)
        yield pa.RecordBatch.from_arrays([both.column(5).combine_chunks().take(pa.array(hit)), sets.take(pa.array(hit)), pa.array(depth.astype(np.int32))], ["a", "b", "depth"])
        rest = np.flatnonzero(near < SAME)
        for at in range(0, len(rest), CHUNK // 2):  # blocks overlap by half, so neighbours in the order meet
            mine = rest[at : at + CHUNK]
            mine = mine[np.lexsort((ranks[mine], node[mine]))]
            a, b, d = _forest(node[mine], path[mine], raw[mine])
            yield _found(sets, (mine[a], mine[b], d))
        tail = both.take(pa.array(rest[-(CHUNK // 2) :])).to_batches()


def _unlike(odd: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many parities the rows a and b differ, in as many cells as both have."""
    sizes = np.array([len(x) for x in odd], np.int64)
    out, least = np.zeros(len(a), np.int64), np.minimum(sizes[a], sizes[b])
    for size in np.unique(least).tolist():
        mine = np.flatnonzero(least == size)
        used, place = np.unique(np.concatenate([a[mine], b[mine]]), return_inverse=True)
        rows = np.stack([folded(np.frombuffer(odd[i], np.uint8), size) for i in used.tolist()]).view(np.uint64)
        step = max(1, (1 << 22) // size)
        for at in range(0, len(mine), step):
            end = min(at + step, len(mine))
            out[mine[at:end]] = np.bitwise_count(rows[place[at:end]] ^ rows[place[len(mine) + at : len(mine) + end]]).sum(1)
    return out


def _rest_pairs(threshold: float) -> Callable:
    """Pairs (a, b) of a node's classes that have different roots and may be linked. Rows (node, id, root, n, pos, side, odd) come sorted by
    node; sides 1 and 2 meet only each other. Rows of crowds have parities, and pairs of short sets there are as few as hold the
    same classes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _whole_nodes(batches):
            table = pa.Table.from_batches(parts).combine_chunks()
            node, ids, root, n, pos, side = (table.column(i).to_numpy() for i in range(6))
            n, left, odd = n.astype(np.int64), n.astype(np.int64) - pos, table.column(6)
            crowd, odd = odd.is_valid().to_numpy(), [x or b"" for x in odd.to_pylist()]
            groups, held = _Groups(len(node)), []

            def made() -> pa.RecordBatch:
                a, b = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                few = crowd[a]  # a node's rows are all of one kind
                x, y = a[few], b[few]
                hit = _unlike(odd, x, y) <= _may_differ(n[x], n[y], threshold)[1]
                x, y = x[hit], y[hit]
                large = np.maximum(n[x], n[y]) > PARITIES // 2
                large[~large] = groups.joining(x[~large], y[~large])  # pairs as compared: their roots may be unlike
                a, b = (ids[np.concatenate([u[~few], v[large]])] for u, v in ((a, x), (b, y)))
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

            a = np.arange(len(node))
            for d in range(1, len(node)):
                a = a[a < len(node) - d]
                a = a[node[a] == node[a + d]]
                if not len(a):
                    break
                b = a + d
                ok = (root[a] != root[b]) & ((side[a] != side[b]) | (side[a] == 0))
                x, y = a[ok], b[ok]
                ok = np.minimum(left[x], left[y]) >= _may_differ(n[x], n[y], threshold)[0]
                ok &= np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-6
                held.append((x[ok], y[ok]))
                if sum(len(x) for x, _ in held) > 1 << 18:
                    yield made()
            if held:
                yield made()

    return run


def _alike(threshold: float) -> Callable:
    """a, b and sets of the rows (a, b, set of a, set of b, n, m, parities of a, parities of b) that may be linked; long: not all their parities are here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (4, 5))
            place = np.arange(len(n))
            hit = _unlike([*batch.column(6).to_pylist(), *batch.column(7).to_pylist()], place, place + len(n)) <= _may_differ(n, m, threshold)[1]
            long = pa.array(np.maximum(n, m) > PARITIES // 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], long], ["a", "b", "one", "two", "long"]).filter(pa.array(hit))

    return run


def _tops(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row that links lead to from it."""
    top = np.full(len(linked), -1)
    for r in range(len(linked)):
        front = np.array([r] if top[r] < 0 else [], np.int64)
        while len(front):
            top[front] = r
            front = np.flatnonzero(linked[front].any(0) & (top < 0))
    return top


def _tile(rows: pd.DataFrame, size: int, threshold: float) -> pd.DataFrame:
    """Exact links in the tiles of a pack: per class of a tile its linked documents, a class that links in the tile lead to (the same
    for all that they hold together) and the number of its links."""
    out: list[tuple] = []
    for (_, k1, i, k2, j), tile in rows.groupby(["comp", "k1", "i", "k2", "j"], sort=False):
        sets = {}
        for t in tile.itertuples():
            if t.set not in sets:
                s = shingles(t.text, size)
                if digest(s) == t.set:
                    sets[t.set] = (s, t.docs, t.k == k1 and t.block == i)
        if len(sets) < 2:
            continue
        keys = list(sets)
        left = np.array([sets[k][2] for k in keys])
        lens = np.array([len(sets[k][0]) for k in keys], np.float64)
        common = _common([sets[k][0] for k in keys])
        linked = common / (lens[:, None] + lens - common) >= threshold - 1e-12
        np.fill_diagonal(linked, False)
        if (k1, i) != (k2, j):  # pairs within a block belong to its own tile
            linked &= left[:, None] != left
        docs, top = np.array([sets[k][1] for k in keys], np.int64), _tops(linked)
        for r in np.flatnonzero(linked.any(1)):
            others = np.flatnonzero(linked[r])
            out.append((keys[r], keys[top[r]], int(docs[others].sum()), len(others)))
    return pd.DataFrame(out, columns=["set", "other", "linked", "links"])


def _common(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 blocks over shingles that two or more sets have."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    all_ = np.concatenate(sets)
    _, place, times = np.unique(all_, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    mine = shared[place]
    owner, place = owner[mine], number[place[mine]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((n, n), np.float32)
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(place, [at, at + width])
        m = np.zeros((n, width), np.float32)
        m[owner[lo:hi], place[lo:hi] - at] = 1
        common += m @ m.T
    common[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return common.astype(np.float64)


def found_share(similarity: float, depth: int) -> float:
    """Share of links of a similarity that prefixes of this depth find in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def query_sets(docs: DataFrame, size: int = 5, queries: int = QUERIES, most_shingles: int = QUERY_SHINGLES) -> list[Query]:
    """The distinct sets of the documents with the least hashes of id and text, as many as the bounds allow; texts without words stay out."""
    most = 1 << 40
    share = max(1, min(most, 4 * queries * most // max(docs.count(), 1)))
    mark = F.xxhash64(F.col("doc_id").cast("string"), text_of("text"))
    some = docs.select(mark.alias("h"), text_of("text").alias("text")).where(F.pmod("h", F.lit(most)) < share)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, Query.of(s)) for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if len(s := shingles(t.as_py(), size))]
            columns = [pa.array([h for h, _ in found], pa.int64()), pa.array([q.digest for _, q in found], pa.binary()), pa.array([q.n for _, q in found], pa.int64()), pa.array([q.zeros for _, q in found], pa.int32()), pa.array([q.some.tobytes() for _, q in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "digest", "n", "zeros", "some"])

    made = written(some.mapInArrow(sets, "h long, digest binary, n long, zeros int, some binary"), "queries")
    kept, held = set(), 0
    for r in made.select("h", F.length("some").alias("b")).groupBy("h").agg(F.max("b").alias("b")).orderBy("h").limit(queries).collect():
        held += r.b // 8
        if held > most_shingles:
            break
        kept.add(r.h)
    last = max(kept, default=None)
    rows = [] if last is None else made.where(F.col("h") <= last).dropDuplicates(["h"]).orderBy("h").collect()
    return list({bytes(r.digest): Query(bytes(r.digest), r.n, r.zeros, np.frombuffer(r.some, np.uint64)) for r in rows}.values())


def counted(docs: DataFrame, size: int = 5) -> np.ndarray:
    """Levels (logarithms of the counts) of all documents' shingles, by the first COUNT_BITS bits of these: the counters are as many
    whatever the corpus, and what other shingles add to a counter is about the same for all."""
    width, schema = (1 << COUNT_BITS) // COUNT_BLOCKS, "block int, counts binary"

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            for t in batch.column(0):
                np.add.at(n, (shingles(t.as_py(), size) >> np.uint64(64 - COUNT_BITS)).astype(np.intp), 1)
        packed = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in n.reshape(COUNT_BLOCKS, width)] if n.any() else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(packed)), pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(pa.decompress(packed, 4 * width, "zstd", asbytes=True), np.uint32).astype(np.int64)
        levels = [np.minimum(np.log1p(x) / math.log(LEVEL), 255).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["block", "counts"])

    rows = docs.select(text_of("text").alias("text")).mapInArrow(counts, schema).repartition("block").mapInArrow(summed, schema).collect()
    levels = np.zeros((COUNT_BLOCKS, width), np.uint8)
    for r in rows:  # COUNT_BLOCKS rows, 4 MB in all
        levels[r.block] = np.frombuffer(r.counts, np.uint8)
    return levels.ravel()


def sketched(docs: DataFrame, queries: Queries, order: Order, size: int = 5) -> DataFrame:
    """doc_id, print (hash of the text), set (digest, null without words), signature, sketch, n (shingles), near (linked queries), first (shingles by
    the order), odd (parities, at most PARITIES), whole (all of them where they are more); written."""
    text, sent = text_of("text"), docs.sparkSession.sparkContext.broadcast((queries, order))
    made = docs.select("doc_id", text_print(text).alias("print"), text.alias("text")).mapInArrow(_sketched(size, sent), f"doc_id {kind_of(docs, 'doc_id')}, print long, set binary, signature binary, sketch binary, n int, near array<struct<q:int,s:double>>, first array<bigint>, odd binary, whole binary")
    return written(made, "sketches")


def _bucket(n: Column, threshold: float) -> Column:
    """Lengths of linked classes are in the same or in neighbouring buckets."""
    return F.floor(F.log(n.cast("double")) / (math.log(1 / threshold) * (1 + 1e-6))).cast("int")


def _path(tree: Column, values: int = DEPTH) -> Column:
    """The tree's values, and the next trees' where more are asked for."""
    whole = F.concat("signature", F.substring("signature", 1, 4 * DEPTH))
    return F.substring(whole, tree * 2 * DEPTH + 1, F.lit(2 * values))


def candidates(made: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Edges (a, b, depth) between classes that meet in some tree and look near; depth: the longest prefix at which; written.

    Rows of `sketched`, copies among them. Most nodes hold one class. A bit map of 2^FILTER_BITS bits, of the same size whatever the corpus, tells
    the nodes that may hold more before anything but (node, least and greatest class hash) is shuffled; those that it lets through
    needlessly make no edge.
    """
    rank = F.xxhash64("set")
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring("signature", t * 2 * DEPTH + 1, F.lit(2 * LEAST_DEPTH))))).alias("tree", "node")
    some = made.where("set is not null")
    ends = some.select(rank.alias("rank"), at).groupBy("node").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    word = F.shiftrightunsigned("node", 70 - FILTER_BITS).alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("node", 64 - FILTER_BITS).bitwiseAND(F.lit(63)).cast("int"))
    shared = written(ends.where("low <> high").select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "nodes")
    rows = some.select("set", "signature", "sketch", "n", at).withColumn("word", word).join(F.broadcast(shared), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    rows = rows.select("node", "set", _path(F.col("tree"), 2 * DEPTH).alias("path"), "sketch", "n")
    rows = written(rows.groupBy("node", "set").agg(*[F.first(c).alias(c) for c in ("path", "sketch", "n")]), "met")
    crowded = bounded(written(rows.groupBy("node").agg(F.count("*").alias("m")).where(F.col("m") > CHUNK).select("node"), "crowded"), BROADCAST_ROWS)
    usual = rows.join(crowded.withColumn("crowded", F.lit(True)), "node", "left").where("crowded is null").select("node", "set", F.substring("path", 1, 2 * DEPTH).alias("path"), "sketch")
    edges = usual.repartition("node").sortWithinPartitions("node", rank).mapInArrow(_edges, _EDGES)
    crowd = rows.join(crowded, "node")
    if not crowd.isEmpty():
        heads = crowd.groupBy("node").agg(F.min(F.struct(rank.alias("rank"), "set", "path", "sketch")).alias("h")).select("node", F.col("h.set").alias("head"), F.col("h.path").alias("head_path"), F.col("h.sketch").alias("head_sketch"))
        of_length = F.explode(F.array(_bucket(F.col("n"), threshold), _bucket(F.col("n"), threshold) + 1)).alias("bucket")
        crowd = crowd.join(bounded(written(heads, "heads"), BROADCAST_ROWS), "node").select("node", "set", "path", "sketch", "head", "head_path", "head_sketch", of_length)
        order = ["node", "bucket", "path", "set"]
        edges = edges.unionByName(crowd.repartitionByRange(*order).sortWithinPartitions(*order).select(F.xxhash64("node", "bucket").alias("node"), "set", "path", "sketch", F.xxhash64("set").alias("rank"), "head", "head_path", "head_sketch").mapInArrow(_crowded_edges, _EDGES))
    return written(edges.where("a <> b").groupBy("a", "b").agg(F.max("depth").alias("depth")), "candidates")


def rest(made: DataFrame, classes: DataFrame, comp: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Edges (a, b) between classes of different components, with which every link is inside a component; written.

    made, classes: rows of `sketched`, and their sets with the least document of each. First shingles that one component alone has are left out
    by a bit map before anything but (shingle, least and greatest component) is shuffled. Pairs of up to CHUNK classes that a shingle has are made distinct
    and compared by parities. More classes meet by lengths and in tiles of SIDE x SIDE, where parities are compared at once;
    those of the shingle's largest component are not dealt against each other.
    """
    copied = classes.where("docs > 1").select("set", F.col("doc_id").alias("head_id"), F.col("print").alias("head_print"))
    known = written(comp.select(F.col("node").alias("set"), F.xxhash64("root").alias("its")).join(copied.withColumn("copied", F.lit(True)), "set", "full"), "known")
    head = F.col("copied").isNull() | (F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("print") == F.col("head_print")))
    mine = made.where("set is not null").join(bounded(known, BROADCAST_ROWS), "set", "left").where(head)
    mine = mine.withColumn("id", F.xxhash64("set")).withColumn("root", F.coalesce("its", "id"))
    each = lambda *columns: mine.select(*columns, F.posexplode("first").alias("pos", "shingle")).withColumn("node", F.xxhash64("shingle"))
    shared = each("root").groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("node")
    columns = ("id", "root", "n", "pos")
    rows = written(may_be_in(each("id", "root", "n"), "node", bit_map(shared, "node")).select("node", *columns), "beside")
    crowded = bounded(written(rows.groupBy("node").agg(F.count("*").alias("m")).where(F.col("m") > CHUNK).select("node"), "crowded"), BROADCAST_ROWS)
    dealt = rows.join(crowded.withColumn("crowded", F.lit(True)), "node", "left").where("crowded is null").select("node", *columns, F.lit(0).alias("side"), F.lit(None).cast("binary").alias("odd"))
    crowd = rows.join(crowded, "node", "left_semi")
    if not crowd.isEmpty():
        bucket = _bucket(F.col("n"), threshold)
        crowd = crowd.withColumn("bucket", F.explode(F.array(bucket, bucket + 1))).withColumn("node", F.xxhash64("node", "bucket"))
        crowd = written(crowd.groupBy("node", "id").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.min("pos").alias("pos")), "crowd")
        cells = crowd.groupBy("node", "root").agg(F.count("*").alias("m")).groupBy("node").agg(F.sum("m").alias("all"), F.max(F.struct("m", "root")).alias("top"))
        sides = lambda n: F.ceil(n / SIDE).cast("int")
        cells = written(cells.where(F.col("all") > F.col("top.m")).select("node", F.col("top.root").alias("top"), sides(F.col("top.m")).alias("own"), sides(F.col("all") - F.col("top.m")).alias("others")), "cells")
        own, others, block, x = (F.col(c) for c in ("own", "others", "block", "x"))
        placed = crowd.join(bounded(cells, BROADCAST_ROWS), "node").withColumn("block", F.when(F.col("root") == F.col("top"), others + F.pmod("id", own)).otherwise(F.pmod("id", others)).cast("int"))
        placed = placed.join(mine.select("id", "odd"), "id").withColumn("x", F.explode(F.sequence(F.lit(0), F.when(block < others, others + own).otherwise(others) - 1)))
        side = F.when(block == x, 0).when(block < x, 1).otherwise(2)
        dealt = dealt.unionByName(placed.select(F.xxhash64("node", F.least(block, x), F.greatest(block, x)).alias("node"), *columns, side.alias("side"), "odd"))
    found = dealt.repartition("node").sortWithinPartitions("node").mapInArrow(_rest_pairs(threshold), "a long, b long")

    def alike(pairs: DataFrame, bits: DataFrame) -> DataFrame:
        a, b = (bits.select(F.col("id").alias(c), F.col("set").alias(f"{c}_set"), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")) for c in "ab")
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "a_set", "b_set", "a_n", "b_n", "a_bits", "b_bits")
        return written(both.mapInArrow(_alike(threshold), "a long, b long, one binary, two binary, long boolean"), "alike")

    near = alike(written(found.distinct(), "pairs"), mine.select("id", "set", "n", F.col("odd").alias("bits")))
    long = near.where("long").select("a", "b").distinct()
    whole = mine.where(F.col("n") >= int(threshold * PARITIES / 2)).select("id", "set", "n", F.coalesce("whole", "odd").alias("bits"))
    edges = near.where("not long") if long.isEmpty() else near.where("not long").unionByName(alike(long, whole))
    return written(edges.select(F.col("one").alias("a"), F.col("two").alias("b")).distinct(), "missed")


def _asked(classes: DataFrame, queries: list[Query]) -> DataFrame:
    """set, own, s: the queries' links to other classes (own: the query's class); written."""
    asked = classes.sparkSession.createDataFrame([(i, bytearray(q.digest)) for i, q in enumerate(queries)], "q int, own binary")
    each = classes.where(F.size("near") > 0).select("set", F.explode("near").alias("x")).select("set", "x.q", "x.s")
    return written(each.join(F.broadcast(asked), "q").where("own <> set").select("set", "own", "s"), "asked")  # at most QUERIES rows


def _recall(asked: DataFrame, comp: DataFrame, depth: int) -> tuple[float, float, int]:
    """Of the queries' links to other classes: the share inside the components, the share expected at this depth, their number."""
    one, two = (comp.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("set", "own"))
    placed = asked.join(one, "set", "left").join(two, "own", "left")
    inside = F.coalesce(F.col("set_root") == F.col("own_root"), F.lit(False)).cast("int")
    expected = 1 - F.pow(1 - F.pow("s", F.lit(float(depth))), F.lit(float(TREES)))
    r = placed.agg(F.avg(inside).alias("inside"), F.avg(expected).alias("expected"), F.count("*").alias("n")).first()
    return (r.inside, r.expected, r.n) if r.n else (1.0, 0.0, 0)


def _verified(docs: DataFrame, classes: DataFrame, comp: DataFrame, size: int, threshold: float) -> DataFrame:
    """(set, other, linked, links) of all linked classes, tile by tile; written.

    A component of at most TILE classes is one tile. The classes of a larger one are dealt by length and hash into blocks, and
    two blocks make a tile if their lengths allow a link.
    """
    placed = comp.select(F.col("node").alias("set"), F.col("root").alias("comp")).join(classes.select("set", "doc_id", "print", "docs", "n"), "set")
    placed = written(placed.withColumn("k", _bucket(F.col("n"), threshold)).drop("n"), "placed")
    lengths = written(placed.groupBy("comp", "k").agg(F.count("*").alias("m")), "lengths")
    large = lengths.groupBy("comp").agg(F.sum("m").alias("m")).where(F.col("m") > TILE).select("comp")
    blocks = written(lengths.join(large, "comp", "left_semi").select("comp", "k", F.ceil(F.col("m") / TILE).cast("int").alias("blocks")), "blocks")
    beside = lambda by, name: blocks.select("comp", (F.col("k") + by).alias("k"), F.col("blocks").alias(name))
    grid = written(blocks.join(beside(1, "below"), ["comp", "k"], "left").join(beside(-1, "above"), ["comp", "k"], "left").fillna(0, ["below", "above"]), "grid")
    placed = written(placed.join(bounded(grid, BROADCAST_ROWS), ["comp", "k"], "left"), "dealt")
    packs = max(1, placed.count() // TILE)

    texts = docs.select(F.col("doc_id").alias("d"), text_print(text_of("text")).alias("p"), text_of("text").alias("text"))
    mine = texts.join(bounded(placed, BROADCAST_ROWS), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("p") == F.col("print"))).dropDuplicates(["set"])
    k, block = F.col("k"), F.col("block")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda k1, i, k2, j: F.struct(k1.alias("k1"), i.alias("i"), k2.alias("k2"), j.alias("j"))
    tiles = F.concat(
        F.transform(upto(F.col("blocks")), lambda x: tile(k, F.least(block, x), k, F.greatest(block, x))),
        F.transform(upto(F.col("above")), lambda x: tile(k, block, k + 1, x)),
        F.transform(upto(F.col("below")), lambda x: tile(k - 1, x, k, block)),
    )
    alone = F.array(tile(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    dealt = mine.withColumn("block", F.coalesce(F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"), F.lit(0)))
    spread = dealt.withColumn("t", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(tiles))).withColumn("k", F.when(F.col("blocks").isNull(), 0).otherwise(k))
    pack = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("comp"), F.lit(packs))).otherwise(F.xxhash64("comp", "t"))
    found = spread.select("set", "comp", "docs", "text", "k", "block", "t.*", pack.alias("pack")).groupBy("pack").applyInPandas(lambda rows: _tile(rows, size, threshold), "set binary, other binary, linked long, links long")
    return written(found, "links")


def join(docs: DataFrame, size: int = 5, threshold: float = 0.8, target_recall: float = 0.9999, least_recall: float = 0.9, report: dict | None = None) -> DataFrame:
    """doc_id, print, set, class_id, copy_id, class_print, n_links for every document; written.

    report gets the depth of the prefixes, the recall of the forest on the queries' links, their number, the number of queries and that of the
    edges that `rest` added. A recall of the forest below least_recall raises a RuntimeError.
    """
    queries = query_sets(docs, size)
    made = sketched(docs, Queries(queries, threshold), Order(queries, counted(docs, size)), size)
    head = F.min(F.struct("doc_id", "print"))
    classes = made.where("set is not null").groupBy("set").agg(head.alias("head"), F.count("*").alias("docs"), *[F.first(c).alias(c) for c in ("n", "near")])
    classes = written(classes.select("set", "head.doc_id", "head.print", "docs", "n", "near"), "classes")
    edges, asked = candidates(made, threshold), _asked(classes, queries)
    comp = None
    for depth in range(DEPTH, LEAST_DEPTH - 1, -1):
        comp = components(edges.where(F.col("depth") == depth), comp)
        recall, expected, n = _recall(asked, comp, depth)
        if recall >= target_recall and (expected if n else found_share(threshold, depth)) >= target_recall:
            break
    measured = f"{n} links of {len(queries)} queries: {recall:.6f} found by prefixes of {depth} values"
    if report is not None:
        report |= {"depth": depth, "recall": recall, "links": n, "queries": len(queries)}
    if recall < least_recall:
        raise RuntimeError(f"the join would be incomplete, {measured}")
    _LOG.log(logging.WARNING if recall < target_recall else logging.INFO, measured)
    missed = rest(made, classes, comp, threshold)
    if report is not None:
        report["rest"] = missed.count()
    comp = components(missed, comp)
    links = _verified(docs, classes, comp, size, threshold)
    total = links.groupBy("set").agg(F.sum("linked").alias("linked"))
    roots = components(links.select(F.col("set").alias("a"), F.col("other").alias("b")))
    keyed = classes.select("set", F.struct("doc_id", "print").alias("head"), "docs").join(total, "set", "left").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    keyed = written(keyed, "keyed")
    lowest = written(keyed.groupBy("root").agg(F.min("head").alias("low")), "lowest")
    placed = keyed.join(lowest, "root").select("set", F.col("head.doc_id").alias("copy_id"), F.col("low.doc_id").alias("class_id"), F.col("low.print").alias("class_print"), (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = made.select("doc_id", "print", "set").join(placed, "set", "left")
    alone = F.col("set").isNull()
    return written(out.select("doc_id", "print", "set", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.when(alone, F.col("print")).otherwise(F.col("class_print")).alias("class_print"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "joined")


def deduplicated(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each class of linked documents: the one with the least (id, hash of the text).

    Documents without words have no shingles, and all of them stay. Of rows alike in id and text one stays, whatever
    their other columns. Other columns may have any names.
    """
    joined = join(docs, size, threshold)
    own_print, key_id, key_print, empty, row = unused(docs, "print", "key_id", "key_print", "empty", "row")
    head = F.col("class_id").eqNullSafe(F.col("doc_id")) & (F.col("class_print") == F.col("print"))
    keep = written(joined.where(head).select("doc_id", "print", F.col("set").isNull().alias("empty")).groupBy("doc_id", "print").agg(F.count("*").alias("rows"), F.max("empty").alias("empty")), "kept")
    again = not keep.where("rows > 1 and not empty").isEmpty()  # rows alike in id and text: one stays
    keep = keep.select(F.col("doc_id").alias(key_id), F.col("print").alias(key_print), F.col("empty").alias(empty))
    out = docs.withColumn(own_print, text_print(text_of("text"))).join(keep, F.col("doc_id").eqNullSafe(F.col(key_id)) & (F.col(own_print) == F.col(key_print)))
    if again:
        out = out.withColumn(row, F.when(F.col(empty), F.monotonically_increasing_id()).otherwise(F.lit(-1))).dropDuplicates([key_id, own_print, row])
    return out.select(*docs.columns)
