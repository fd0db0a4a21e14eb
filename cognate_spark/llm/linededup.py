"""Line dedup that can be undone: exact reference counts of lines, with a sharded cuckoo filter over the hot ones.

A line's key is the line without blanks at both ends, A-Z lower-cased; a key of at least `min_chars` code points
in at least `min_docs` documents is hot and loses all its lines everywhere. `LineIndex.counts` holds for every
key, as a 128-bit hash, the number of documents it is in: inserting documents adds to it, deleting them takes
away, so deletion restores exactly what the lines were before. Keys whose count crosses the threshold go into
or out of the cuckoo filter of their shard; a cuckoo filter, unlike a Bloom filter, can forget.

`drop` asks the filters first and then the exact counts of the few keys that pass. Up to `BROADCAST_KEYS` hot keys
(16 bytes each) are sent to all tasks and documents are rewritten where they are read; beyond it the lines that the filters let
pass are joined with the hot keys by a shuffle, and beyond `FILTER_KEYS`, whose filters are too large to be sent, all lines.
All ways give the same rows.

Null and empty texts have one empty line, which stays. Repeated rows are documents by themselves. Other
columns pass through under any names; `n_lines`, `n_dropped` and `kept_text` are replaced if present.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, text_of, unused, written

#: Hot keys that may be sent to every task: 16 MB of hashes and 3 MB of filters.
BROADCAST_KEYS = 1 << 20
#: Hot keys whose filters, 2 to 5 bytes a key, may be sent to every task.
FILTER_KEYS = 1 << 24
#: Hot keys a shard is planned for.
SHARD_KEYS = 50_000
SLOTS = 4
MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """16-bit fingerprints, four a bucket; each has two buckets, and either follows from the other and the fingerprint."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(np.zeros((1 << max(2, int(np.ceil(np.log2(max(keys, 1) / SLOTS / 0.8)))), SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys given as two 64-bit hashes."""
        mask = np.uint64(len(self.table) - 1)
        print_ = (h2.astype(np.uint64) >> np.uint64(48)).astype(np.uint16)
        print_ = np.where(print_ == 0, np.uint16(1), print_)
        first = (h1.astype(np.uint64) >> np.uint64(20)) & mask
        return print_, first.astype(np.int64), (first ^ (self._step(print_) & mask)).astype(np.int64)

    @staticmethod
    def _step(print_: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (print_.astype(np.uint64) * MIX) >> np.uint64(32)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        p, a, b = self.places(h1, h2)
        return (self.table[a] == p[:, None]).any(1) | (self.table[b] == p[:, None]).any(1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if there is no room: then build a larger one from the exact counts."""
        table, mask = self.table, len(self.table) - 1
        for p, a, b in zip(*(x.tolist() for x in self.places(h1, h2)), strict=True):
            at = a if not table[a].all() else b
            for _ in range(500):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = p
                    break
                slot = (p + at + _) % SLOTS  # evicts one, which moves to its other bucket
                p, table[at, slot] = int(table[at, slot]), p
                at = at ^ (int(self._step(np.uint16(p))) & mask)
            else:
                return False
        return True

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for p, a, b in zip(*(x.tolist() for x in self.places(h1, h2)), strict=True):
            for at in (a, b):
                found = np.flatnonzero(self.table[at] == p)
                if len(found):
                    self.table[at, found[0]] = 0
                    break


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(text: Column) -> Column:
    return F.transform(lines(ascii_lower(text)), lambda x: F.trim(x, F.lit(BLANKS)))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def _key_docs(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, n: in how many of the documents each key is."""
    h1, h2 = _hashes(F.col("k"))
    each = docs.select(F.explode(F.array_distinct(_keys(text_of("text")))).alias("k")).where(F.length("k") >= min_chars)
    return each.select(h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class LineIndex:
    """counts (h1, h2, n: documents) and filters (shard, raw), both written tables."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> LineIndex:
        counts = written(_key_docs(docs, min_chars), "line-counts")
        return cls._filtered(counts, min_docs, min_chars)

    @classmethod
    def _filtered(cls, counts: DataFrame, min_docs: int, min_chars: int) -> LineIndex:
        hot = counts.where(F.col("n") >= min_docs)
        shards = max(1, -(-hot.count() // SHARD_KEYS))
        filters = hot.select("h1", "h2", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(_new_filter, "shard int, raw binary")
        return cls(counts, written(filters, "line-filters"), shards, min_docs, min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """docs must have been inserted; a ValueError tells if a line's count would fall below 0."""
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        change = _key_docs(docs, self.min_chars).select("h1", "h2", F.lit(0).cast("long").alias("old"), (F.col("n") * sign).alias("by"))
        both = self.counts.select("h1", "h2", F.col("n").alias("old"), F.lit(0).cast("long").alias("by")).unionByName(change)
        merged = written(both.groupBy("h1", "h2").agg(F.sum("old").alias("old"), F.sum(F.col("old") + F.col("by")).alias("n")), "line-changes")
        if not merged.where("n < 0").isEmpty():
            raise ValueError("documents to delete must have been inserted: some lines would be in fewer than no documents")
        counts = merged.where("n > 0").select("h1", "h2", "n")
        was, is_ = F.col("old") >= self.min_docs, F.col("n") >= self.min_docs
        if counts.where(is_).count() > 2 * SHARD_KEYS * self.shards:
            return self._filtered(counts, self.min_docs, self.min_chars)
        crossed = merged.where(was != is_).select("h1", "h2", is_.alias("now"), _shard(self.shards).alias("shard"))
        # a filter that overflows is built anew from the hot keys of its shard
        hot = counts.where(is_).select("h1", "h2", F.lit(None).cast("boolean").alias("now"), _shard(self.shards).alias("shard"))
        touched = crossed.unionByName(hot.join(crossed.select("shard").distinct(), "shard", "left_semi").select("h1", "h2", "now", "shard"))
        updated = self.filters.groupBy("shard").cogroup(touched.groupBy("shard")).applyInPandas(_updated_filter, "shard int, raw binary")
        return replace(self, counts=counts, filters=written(updated, "line-filters"))

    def drop(self, docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS, filter_keys: int = FILTER_KEYS) -> DataFrame:
        """docs with n_lines, n_dropped and kept_text."""
        hot = self.counts.where(F.col("n") >= self.min_docs).select("h1", "h2")
        keys, flags, uid, gone, kept = unused(docs, "line_keys", "line_flags", "line_uid", "line_gone", "line_kept")
        text, n_hot = text_of("text"), hot.count()
        marked = docs
        if n_hot <= filter_keys:
            probe = self._probe(hot if n_hot <= broadcast_keys else None, docs.sparkSession)
            marked = docs.withColumn(keys, _keys(text)).withColumn(flags, probe(*_hash_columns(F.col(keys), self.min_chars))).drop(keys)
        if n_hot <= min(broadcast_keys, filter_keys):
            marked = marked.withColumn(gone, F.array_compact(F.transform(flags, lambda x, i: F.when(x, i)))).drop(flags)
        else:
            # rows are numbered once and written: both sides of the join below read the same numbers
            marked = written(marked.withColumn(uid, F.monotonically_increasing_id()), "line-numbered")
            h1, h2 = _hashes(F.col("l.k"))
            flag = (lambda i: F.get(F.col(flags), i)) if n_hot <= filter_keys else (lambda i: F.lit(True))
            pairs = F.filter(F.transform(_keys(text), lambda k, i: F.struct(i.alias("i"), k.alias("k"), flag(i).alias("may"))), lambda x: x["may"])
            each = marked.select(uid, F.explode(pairs).alias("l"))
            asked = each.where(F.length("l.k") >= self.min_chars).select(uid, "l.i", h1.alias("h1"), h2.alias("h2"))
            found = asked.join(hot, ["h1", "h2"], "left_semi").groupBy(uid).agg(F.collect_list("i").alias(gone))
            marked = marked.drop(flags).join(found, uid, "left").drop(uid)
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines(text)) - 1), F.coalesce(F.col(gone), F.array().cast("array<int>")))
        out = marked.withColumn("n_lines", F.size(lines(text)).cast("long"))
        out = out.withColumn(kept, F.get(F.transform(F.array(lines(text)), lambda x: F.transform(stay, lambda i: F.get(x, i))), F.lit(0)))
        return out.withColumn("n_dropped", F.col("n_lines") - F.size(kept)).withColumn("kept_text", F.array_join(kept, "\n")).drop(gone, kept)

    def _probe(self, hot: DataFrame | None, spark: SparkSession):  # noqa: ANN202
        """A pandas UDF: which lines are hot, by the filters and then by the exact keys; without these, which may be."""
        pairs = None
        if hot is not None:
            exact = hot.toPandas()  # at most BROADCAST_KEYS rows
            order = np.lexsort((exact.h2.to_numpy(np.int64), exact.h1.to_numpy(np.int64)))
            pairs = np.empty(len(order), [("a", np.int64), ("b", np.int64)])
            pairs["a"], pairs["b"] = exact.h1.to_numpy(np.int64)[order], exact.h2.to_numpy(np.int64)[order]
        sent = spark.sparkContext.broadcast(({r.shard: bytes(r.raw) for r in self.filters.collect()}, pairs))
        shards = self.shards

        @F.pandas_udf("array<boolean>")
        def probe(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            raw, known = sent.value
            filters = {k: CuckooFilter.from_bytes(v) for k, v in raw.items()}
            for first, second in parts:
                ends = np.cumsum([len(x) for x in first])
                h1, h2 = np.concatenate([*first, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*second, np.empty(0, np.int64)]).astype(np.int64)
                maybe, shard = np.zeros(len(h1), bool), h1 % shards
                for k, f in filters.items():
                    mine = np.flatnonzero(shard == k)
                    maybe[mine] = f.contains(h1[mine], h2[mine])
                if known is not None:
                    at = np.flatnonzero(maybe)
                    asked = np.empty(len(at), known.dtype)
                    asked["a"], asked["b"] = h1[at], h2[at]
                    maybe[at] = _among(known, asked)
                yield pd.Series(np.split(maybe, ends[:-1])[: len(first)] if len(first) else [], dtype=object)

        return probe


def _among(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of the asked pairs are among the known ones, sorted by both parts."""
    if not len(known):
        return np.zeros(len(asked), bool)
    starts = np.searchsorted(known["a"], asked["a"], "left")
    ends = np.searchsorted(known["a"], asked["a"], "right")
    found = np.zeros(len(asked), bool)
    for k in range(int((ends - starts).max(initial=0))):  # as many rounds as keys share a first hash: one
        here = np.minimum(starts + k, len(known) - 1)
        found |= (starts + k < ends) & (known["b"][here] == asked["b"])
    return found


def _hash_columns(keys: Column, min_chars: int) -> list[Column]:
    def of(n: int) -> Column:
        return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, _hashes(k)[n]).otherwise(F.lit(0).cast("long")))

    return [of(0), of(1)]


def _shard(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


def _new_filter(rows: pd.DataFrame) -> pd.DataFrame:
    h1, h2, room = rows.h1.to_numpy(np.int64), rows.h2.to_numpy(np.int64), len(rows)
    while not (made := CuckooFilter.sized(room)).insert(h1, h2):
        room *= 2
    return pd.DataFrame({"shard": rows.shard.iloc[:1].astype("int32"), "raw": [made.to_bytes()]})


def _updated_filter(filters: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """changes: keys with now true (went hot), false (no longer), null (all hot keys, to build anew from)."""
    if not len(changes):
        return filters
    all_ = changes[changes.now.isna()]
    on, off = (changes[changes.now.notna() & (changes.now.fillna(False).astype(bool) == x)] for x in (True, False))
    if len(filters):
        made = CuckooFilter.from_bytes(bytes(filters.raw.iloc[0]))
        made.delete(off.h1.to_numpy(np.int64), off.h2.to_numpy(np.int64))
        if made.insert(on.h1.to_numpy(np.int64), on.h2.to_numpy(np.int64)):
            return pd.DataFrame({"shard": changes.shard.iloc[:1].astype("int32").tolist(), "raw": [made.to_bytes()]})
    return _new_filter(all_.assign(shard=changes.shard.iloc[0])) if len(all_) else filters.iloc[:0]
