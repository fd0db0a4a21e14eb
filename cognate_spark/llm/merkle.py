"""Merkle manifest of a table of documents, and versions of it for documents that were changed.

A document's leaf is the SHA-256 of its fields. Per source, leaves stand in order of their ids; every FAN consecutive nodes of a
level (the last run may be shorter) have a parent, the hash of their digests, until one node remains, the source's subroot.
Subroots in order of their sources are the leaves of one more such tree, whose top is the root.

The tree is cut at aligned blocks of FAN ** BLOCK_LEVELS leaves. A block is small enough for a task, so a source of any size is
many blocks; the nodes above them are made by a grouping a level, of FAN rows a group at most. On the way back every
block gets its `path`: for each level above it what stands left and right of its ancestor's digest, handed down from parents to
children.

The tree is persistent: a changed leaf makes a version that shares all nodes but the leaf's ancestors with the first one.
`Block.version` copies the ancestors inside the block, and the version goes on upward along the block's path, in whatever task the
block is. Its root is what the proof of the changed leaf folds to. Documents that were not changed share version zero as a whole, so
their root is folded once a block.

Null fields have a mark of their own (`-`), so they differ from empty ones; a null source is a source and comes first, a null id
stands before all others. Rows of one id stand in the order of their leaves; repeated rows are leaves by themselves. An empty table
has no rows and no root. Other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, written

FAN_BITS = 4
FAN = 1 << FAN_BITS
#: Levels inside a block: 4096 leaves, some 100 bytes each.
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<l:string,r:string>>"


def field(col: Column) -> Column:
    """A field as it is hashed: `-`, or its bytes' number, a colon and its value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The leaf of a row as 32 bytes, with other values in some fields."""
    return F.unhex(F.sha2(F.concat(*[field(changed.get(name, F.col(name))) for name in FIELDS]), 256))


def _hash(digests: Column) -> Column:
    """The parent of an array of digests: the hash of their lower-case hex digits."""
    return F.unhex(F.sha2(_hex(digests), 256))


def _hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "")


class Block:
    """The nodes over some consecutive leaves, as lower-case hex digits, level by level: so many levels, or (None) until one node
    remains, if the leaves are a whole tree."""

    def __init__(self, leaves: list[bytes], height: int | None) -> None:
        self.levels = [leaves]
        while (len(self.levels[-1]) > 1) if height is None else (len(self.levels) <= height):
            below = self.levels[-1]
            self.levels.append([_sha(b"".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
        self.runs = [[b"".join(level[i : i + FAN]) for i in range(0, len(level), FAN)] for level in self.levels[:-1]]

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def beside(self, level: int, i: int) -> tuple[bytes, bytes]:
        """What stands left and right of a node's digest in its run."""
        run, at = self.runs[level][i >> FAN_BITS], 64 * (i & (FAN - 1))
        return run[:at], run[at + 64 :]

    def version(self, i: int, digest: bytes) -> list[bytes]:
        """The nodes that a version with another leaf i has copies of, from the leaf upward; it shares all others."""
        copied = [digest]
        for level in range(len(self.runs)):
            left, right = self.beside(level, i)
            copied.append(_sha(left + copied[-1] + right))
            i >>= FAN_BITS
        return copied


def _sha(x: bytes) -> bytes:
    return sha256(x).hexdigest().encode()


def _folded(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        digest = _sha(left + digest + right)
    return digest


@dataclass(frozen=True)
class Manifest:
    """leaves: source_key, doc_id, leaf, changed (null if the document was not), pos, block; subroots: source_key, top, source_path;
    blocks: source_key, block, alone, path; root: None for an empty table."""

    spark: SparkSession
    leaves: DataFrame
    subroots: DataFrame
    blocks: DataFrame
    root: bytes | None
    block_levels: int = BLOCK_LEVELS


def _upward(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level above nodes (key, idx, digest, m: nodes of the key's level, more than one), and the tops (key, top)."""
    runs: list[DataFrame] = []
    tops = nodes.select("key", F.col("digest").alias("top")).limit(0)
    most = nodes.agg(F.max("m")).first()[0] or 1
    while most > 1:
        row = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        made = nodes.groupBy("key", F.shiftright("idx", FAN_BITS).alias("run")).agg(F.transform(row, lambda x: x["digest"]).alias("digests"), F.max("m").alias("m"))
        made = written(made, "runs")
        runs.append(made)
        above = made.select("key", F.col("run").alias("idx"), _hash(F.col("digests")).alias("digest"), F.ceil(F.col("m") / FAN).cast("long").alias("m"))
        tops = tops.unionByName(above.where("m = 1").select("key", F.col("digest").alias("top")))
        nodes, most = above.where("m > 1"), -(-most // FAN)
    return runs, tops


def _downward(runs: list[DataFrame], ends: DataFrame) -> DataFrame | None:
    """key, idx, path of the nodes below the lowest runs; ends: key, path of the keys' tops. Paths go from parents to children, of which each has FAN at most."""
    paths = None
    for level in reversed(runs):
        top = level.where(F.col("m") <= FAN).join(ends.select("key", "path"), "key")
        if paths is not None:
            top = top.unionByName(level.where(F.col("m") > FAN).join(paths.withColumnRenamed("idx", "run"), ["key", "run"]).select(top.columns))
        each = top.select("key", "run", "digests", "path", F.posexplode("digests").alias("i", "_"))
        beside = F.struct(_hex(F.slice("digests", 1, F.col("i"))).alias("l"), _hex(F.expr("slice(digests, i + 2, size(digests))")).alias("r"))
        paths = written(each.select("key", (F.col("run") * FAN + F.col("i")).alias("idx"), F.concat(F.array(beside), "path").alias("path")), "paths")
    return paths


def build(docs: DataFrame, changed: dict[str, Column] | None = None, when: Column | None = None, block_levels: int = BLOCK_LEVELS) -> Manifest:
    """The manifest of docs (doc_id, source, lang, n_chars, text). changed: fields as they are found now, of the rows of `when`."""
    spark = docs.sparkSession
    other = F.when(when, leaf(**changed)) if changed else F.lit(None).cast("binary")
    rows = docs.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("source_key"), "doc_id", leaf().alias("leaf"), other.alias("changed"))
    placed = ranked(rows, "source_key", [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], "pos")
    leaves = placed.withColumn("block", F.shiftright("pos", FAN_BITS * block_levels))
    made = written(leaves.select("source_key", "block", "pos", "leaf").groupBy("source_key", "block").applyInArrow(lambda rows: _tops(rows, block_levels), "source_key string, block long, top binary, own_top binary"), "blocks")
    number = made.groupBy("source_key").agg((F.max("block") + 1).alias("m"))
    blocks = written(made.join(number, "source_key"), "blocks-numbered")
    runs, tops = _upward(blocks.where("m > 1").select(F.col("source_key").alias("key"), F.col("block").alias("idx"), F.col("top").alias("digest"), "m"))
    subroots = tops.select(F.col("key").alias("source_key"), "top").unionByName(blocks.where("m = 1").select("source_key", F.col("own_top").alias("top")))
    subroots = ranked(subroots.withColumn("key", F.lit("")), "key", [F.col("source_key").asc()], "idx")
    n = subroots.count()
    if n > 1:
        over, root = _upward(subroots.select("key", "idx", F.col("top").alias("digest"), F.lit(n).cast("long").alias("m")))
        ends = _downward(over, spark.createDataFrame([("", [])], f"key string, path {_PATH}"))
        subroots = written(subroots.join(ends, ["key", "idx"]).select("source_key", "top", F.col("path").alias("source_path")), "subroots")
        top = root.first()["top"]
    else:
        one = subroots.first()
        top = one["top"] if one else None
        subroots = subroots.select("source_key", "top", F.array().cast(_PATH).alias("source_path"))
    ends = subroots.select(F.col("source_key").alias("key"), F.array().cast(_PATH).alias("path"))
    paths = _downward(runs, ends)
    alone = blocks.where("m = 1").select("source_key", "block", F.lit(True).alias("alone"), F.array().cast(_PATH).alias("path"))
    if paths is not None:
        alone = alone.unionByName(paths.select(F.col("key").alias("source_key"), F.col("idx").alias("block"), F.lit(False).alias("alone"), "path"))
    return Manifest(spark, leaves, subroots, alone, None if top is None else bytes(top), block_levels)


def _tops(rows: pa.Table, height: int) -> pa.Table:
    """A block's node `height` levels above its leaves; the first block also has its top as a tree by itself."""
    hexed = [x.hex().encode() for x in rows.sort_by("pos").column("leaf").to_pylist()]
    key, block = rows.column("source_key")[0].as_py(), rows.column("block")[0].as_py()
    own = bytes.fromhex(Block(hexed, None).top.decode()) if block == 0 else None
    cols = [pa.array([key], pa.string()), pa.array([block], pa.int64()), pa.array([bytes.fromhex(Block(hexed, height).top.decode())], pa.binary()), pa.array([own], pa.binary())]
    return pa.table(cols, ["source_key", "block", "top", "own_top"])


def proofs(manifest: Manifest) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256 (of all siblings on the way to the root, level by level), folded_root (of the
    document's version) and verified (whether that is the root)."""
    id_type = manifest.leaves.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if manifest.root is None:
        return manifest.spark.createDataFrame([], schema)
    root, height = manifest.root.hex().encode(), manifest.block_levels
    ways = manifest.blocks.join(manifest.subroots, "source_key").select("source_key", "block", "alone", "path", "source_path")
    both = manifest.leaves.groupBy("source_key", "block").cogroup(ways.groupBy("source_key", "block"))
    return both.applyInArrow(lambda rows, way: _proven(rows, way, root, height), schema)


def _proven(rows: pa.Table, way: pa.Table, root: bytes, height: int) -> pa.Table:
    rows, way = rows.sort_by("pos"), way.to_pylist()[0]
    hexed = [x.hex().encode() for x in rows.column("leaf").to_pylist()]
    block = Block(hexed, None if way["alone"] else height)
    inner, outer = ([(x["l"].encode(), x["r"].encode()) for x in way[c]] for c in ("path", "source_path"))
    subroot = _folded(block.top, inner)
    first = _folded(subroot, outer)  # version zero, which all unchanged documents share
    rest = [b"".join(left + right for left, right in inner + outer)]
    for level in range(len(block.runs) - 1, 0, -1):  # siblings from this level upward, of each node
        rest = [b"".join(block.beside(level, i)) + rest[i >> FAN_BITS if len(rest) > 1 else 0] for i in range(len(block.levels[level]))]
    proof, folded = [], []
    for i, changed in enumerate(rows.column("changed").to_pylist()):
        siblings = b"".join(block.beside(0, i)) + rest[i >> FAN_BITS if len(rest) > 1 else 0] if block.runs else rest[0]
        proof.append(_sha(siblings).decode())
        folded.append(first if changed is None else _folded(_folded(block.version(i, changed.hex().encode())[-1], inner), outer))
    n = len(hexed)
    text = lambda values: pa.array([v.decode() for v in values], pa.string())
    cols = [rows.column("doc_id"), text(hexed), text([subroot] * n), text([root] * n), pa.array(proof, pa.string()), text(folded), pa.array([x == root for x in folded])]
    return pa.table(cols, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
