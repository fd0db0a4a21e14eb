"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

A store is a folder of Parquet tables, so any file system that Spark knows will do:

* `payload`: part, shard, payload (raw little-endian ids, unsigned 16 bits if the vocabulary allows, else 32), doc_ids
  and lens (ids per document, the end id included), documents in ascending id order through (part, shard).
* `starts`: part, shard, start: ids in all shards before it.
* `index`: for keys hashed to an index shard, a minimal perfect hash (hash and displace): the key's bucket gives a
  displacement, both give its slot; slots hold a 32-bit fingerprint of the key, part, shard, offset and length. A
  lookup computes one slot and compares the fingerprint: constant time, and a foreign key is told apart
  but for one in 2^32.

A key is (doc_id, k): k numbers the rows that repeat an id, in the order of their texts. Null ids form an id of
their own that sorts first; ids that are no whole numbers raise a TypeError. Null texts are empty and have the end id alone. Rows of one id come from one range
partition; texts are sorted and encoded in a stream, so a partition holds one shard at a time. Other columns stay out.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded, byte_groups, shared_dir, text_of

END_ID = 0
#: Seeds that an index shard tries until its keys have different hashes; two of distinct keys are hardly ever needed.
SEEDS = 16
SHARD_BYTES = 4 << 20
#: Rows (16 bytes, one a shard) of the shards' starts that may be broadcast.
BROADCAST_ROWS = 500_000
#: Keys an index shard is planned for.
INDEX_KEYS = 30_000
#: Chunks whose ids an encoder remembers, about 40 bytes each; then it starts anew. It changes no result.
CACHE = 1_000_000
#: Marks that are a piece by themselves between letters and a blank, line feed or end.
MARKS = ".,;:!?"
#: Letters, with \0 or \x02 perhaps before them, and one mark after them.
_MARKED = "^[\\x00\\x02]?[A-Za-zÀ-ÖØ-öø-ʯА-я]+[.,;:!?]$"
#: White space beside blank and line feed, and characters that mark chunks: texts with them are encoded whole.
_RARE = re.compile("[\0\x02\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library, remembered by chunk.

    The byte-level pre-tokenizer always cuts between a character and a blank or line feed after it, so a text with single
    blanks and line feeds between words is encoded word by word, each with the one before it; other texts, and
    those with an added token's string, are encoded whole. It also cuts between letters and a mark that ends a word, so
    such words are put together from both. New words are encoded together, with line feeds between, which are
    tokens of their own there. Equal to encoding every text whole.
    """

    def __init__(self, path: str, wide: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u4" if wide or self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        line = self._ids("\n")
        self.line = line[0] if len(line) == 1 and self._ids("a\n b\nc").count(line[0]) == 2 else None
        self.marks = [self._ids(x)[0] for x in MARKS] if all(self._ids(f"a{x}\n") == [*self._ids("a"), *self._ids(x), self.line] and len(self._ids(x)) == 1 for x in MARKS) else []
        self._forget()

    def _forget(self) -> None:
        """Known chunks, their ids one after the other, and where those of each begin and how many they are."""
        self.known, self.flat = pa.array([], pa.large_string()), np.empty(0, self.kind)
        self.first = self.size = np.empty(0, np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with `before` (a blank or nothing) in front, one after the other, and how many they are."""
        parts: list[np.ndarray] = []
        line = np.array([self.line or 0], self.kind)
        for at in range(0, len(words), 5_000):
            lists = ["\n".join([before + w for w in words[i : i + 50]]) for i in range(at, min(at + 5_000, len(words)), 50)]
            for e in self.tokenizer.encode_batch_fast(lists, add_special_tokens=False):
                parts += [np.array(e.ids, self.kind), line]
        ids = np.concatenate([*parts, line[:0]])
        ends = np.flatnonzero(ids == line[0])
        if len(ends) != len(words):
            raise ValueError("the tokenizer joins line feeds with words")
        return ids[ids != line[0]], np.diff(ends, prepend=-1) - 1

    def _plain(self, t: str) -> bool:
        return self.line is not None and not ("  " in t or "\n\n" in t or "\n " in t or " \n" in t or t[:1] in (" ", "\n") or t[-1:] in (" ", "\n") or _RARE.search(t) or any(a in t for a in self.added))

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """Places of distinct chunks among the known ones, after learning those that are new: \0 stands before a first
        word, \x02 before one after a line feed, others follow a blank."""
        at = pc.index_in(chunks, value_set=self.known)
        if len(self.known) > CACHE and at.null_count:
            self._forget()  # all chunks of these texts are learned again, so frequent ones stay known
            at = pa.nulls(len(chunks), pa.int32())
        if at.null_count:
            new = chunks.filter(pc.is_null(at)).to_pylist()
            order = np.argsort([x[0] in "\0\x02" for x in new], kind="stable")  # those after a blank first
            new = [new[i] for i in order.tolist()]
            spaced = sum(x[0] not in "\0\x02" for x in new)
            (ids, n), (more, m) = self._words(new[:spaced], " "), self._words([x[1:] for x in new[spaced:]], "")
            line = np.array([x[0] == "\x02" for x in new[spaced:]], bool)
            more = np.insert(more, (np.cumsum(m) - m)[line], self.line or 0)
            size = np.concatenate([n, m + line])
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, ids, more])
            self.known = pa.concat_arrays([self.known, pa.array(new, pa.large_string())])
            at = pc.index_in(chunks, value_set=self.known)
        return at.to_numpy()

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: each distinct chunk is looked up once, and its ids are copied to all its places."""
        chunks = pc.split_pattern(pa.array(["\0" + t.replace("\n", " \x02") for t in texts], pa.large_string()), " ")
        coded = chunks.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        marked = pc.match_substring_regex(words, _MARKED) if self.marks else pa.array(np.zeros(len(words), bool))
        bases = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        place = self._places(bases.dictionary)[bases.indices.to_numpy()]
        marked = marked.to_numpy(zero_copy_only=False)
        mark = np.zeros(len(words), self.kind)
        for x, id_ in zip(MARKS, self.marks, strict=False):
            mark[pc.ends_with(words, x).to_numpy(zero_copy_only=False)] = id_
        lens = (self.size[place] + marked)[at]
        ends = np.cumsum(lens)
        source = np.arange(ends[-1], dtype=np.int32 if ends[-1] + len(self.flat) < 1 << 31 else np.int64)
        source += np.repeat((self.first[place][at] - (ends - lens)).astype(source.dtype), lens)
        out = np.append(self.flat, self.kind.type(0))[source]
        ends_marked = marked[at]
        out[ends[ends_marked] - 1] = mark[at[ends_marked]]
        raw = out.tobytes()
        cuts = np.concatenate([[0], ends])[chunks.offsets.to_numpy()] * self.kind.itemsize
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [bool(t) and self._plain(t) for t in texts]
        by_words = iter(self._by_words([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else ())
        odd = iter(self.whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(by_words if p else odd) for p in plain]


def _splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(ids: np.ndarray, null: np.ndarray, k: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of each key (a null id is any number, marked); the mixing is a bijection of the id, so of keys with equal k at most a
    null one meets another."""
    with np.errstate(over="ignore"):
        x = _splitmix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed) * np.uint64(0x9FB21C651E98DF25))
    return _splitmix(np.where(null, np.uint64(0x5851F42D4C957F2D), x) + _splitmix(k.astype(np.uint64) << np.uint64(1)))


def _hashed(keys: pd.DataFrame, seed: int) -> np.ndarray:
    """key_hash of rows with id, no_id and k, none of which is ever null: pandas has no nulls beside whole numbers."""
    return key_hash(keys.id.to_numpy(np.int64), keys.no_id.to_numpy(bool), keys.k.to_numpy(np.int64), seed)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys. A displacement below 0 names the slot of a lone key."""

    def __init__(self, shifts: np.ndarray, n: int) -> None:
        self.shifts, self.n = shifts, n

    @staticmethod
    def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
        return ((x >> np.uint64(32)) % np.uint64(max(buckets, 1))).astype(np.int64)

    @staticmethod
    def _slot(x: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
        return (_splitmix(x ^ (shift.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, x: np.ndarray) -> PerfectHash:
        n = len(x)
        if len(np.unique(x)) < n:
            raise ValueError("keys to be hashed must differ")
        buckets = n // 4 + 1
        of = cls._bucket(x, buckets)
        order = np.argsort(of, kind="stable")
        size = np.bincount(of, minlength=buckets)
        first = np.concatenate([[0], np.cumsum(size)])
        taken, shifts = np.zeros(n, bool), np.zeros(buckets, np.int32)
        for b in np.argsort(-size, kind="stable"):
            if size[b] < 2:
                break
            keys = x[order[first[b] : first[b + 1]]]
            begin = 1
            while True:
                tries = np.arange(begin, begin + 32)
                slots = cls._slot(keys[None, :], tries[:, None], n)
                ok = ~taken[slots].any(1)
                if len(keys) > 1:
                    s = np.sort(slots, 1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(1)
                if ok.any():
                    at = int(np.argmax(ok))
                    shifts[b], taken[slots[at]] = tries[at], True
                    break
                begin += 32
        lone = np.flatnonzero(size == 1)
        shifts[lone] = -np.flatnonzero(~taken)[: len(lone)] - 1
        return cls(shifts, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Slots; for keys not among those built from, some slot."""
        shift = self.shifts[self._bucket(x, len(self.shifts))]
        return np.where(shift < 0, -shift.astype(np.int64) - 1, self._slot(x, np.maximum(shift, 0), max(self.n, 1)))


@dataclass(frozen=True)
class TokenStore:
    spark: SparkSession
    path: str
    index_shards: int
    kind: str

    def payload(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/payload")

    def starts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/starts")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """For keys (doc_id, k): doc_id, k, start, n_tokens, ids_crc32 of those in the store, read from its shards."""
        asked = keys.select(*_key(), "k", _index_shard(self.index_shards).alias("index_shard"))
        index = self.spark.read.parquet(f"{self.path}/index")
        where = asked.groupBy("index_shard").cogroup(index.groupBy("index_shard")).applyInPandas(_locate, "id long, no_id boolean, k long, part int, shard int, offset int, n int")
        kind = self.kind
        shards = self.payload().select("part", "shard", "payload").join(bounded(self.starts(), BROADCAST_ROWS), ["part", "shard"])
        found = where.groupBy("part", "shard").cogroup(shards.groupBy("part", "shard"))
        cut = found.applyInPandas(lambda at, shard: _cut(at, shard, kind), "id long, no_id boolean, k long, start long, n_tokens long, ids_crc32 long")
        return cut.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "k", "start", "n_tokens", "ids_crc32")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, k of every row: the keys of a store of these documents."""
    same = W.partitionBy("doc_id").orderBy("doc_id")
    return docs.select("doc_id").withColumn("k", (F.row_number().over(same) - 1).cast("long"))


def _key() -> tuple[Column, Column]:
    """An id as two columns without nulls."""
    return F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id")


def _index_shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "k"), F.lit(shards)).cast("int")


def write_store(docs: DataFrame, tokenizer_path: str, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> TokenStore:
    spark = docs.sparkSession
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("a token store is keyed by whole numbers: doc_id is " + docs.schema["doc_id"].dataType.simpleString())
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    kind = Encoder(tokenizer_path).kind.str
    ordered = docs.select("doc_id", text_of("text").alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    encoded = ordered.mapInArrow(_shards(tokenizer_path, shard_bytes), "part int, shard int, payload binary, doc_ids array<long>, ks array<long>, lens array<int>")
    encoded.write.parquet(f"{path}/payload")
    payload = spark.read.parquet(f"{path}/payload")

    sizes = payload.select("part", "shard", F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(W.orderBy("part")).alias("base"))  # one row a task of the writing job
    sizes.withColumn("inside", before(W.partitionBy("part").orderBy("shard"))).join(parts, "part").select("part", "shard", (F.col("base") + F.col("inside")).alias("start")).write.parquet(f"{path}/starts")

    entries = payload.select("part", "shard", "doc_ids", "ks", "lens").mapInArrow(_entries, "doc_id long, k long, part int, shard int, offset int, n int")
    n = payload.agg(F.sum(F.size("lens"))).first()[0] or 0
    index_shards = max(1, -(-n // INDEX_KEYS))
    entries.select(*_key(), "k", "part", "shard", "offset", "n", _index_shard(index_shards).alias("index_shard")).groupBy("index_shard").applyInPandas(_index, "index_shard int, seed int, shifts binary, prints binary, part binary, shard binary, offset binary, n binary").write.parquet(f"{path}/index")
    return TokenStore(spark, path, index_shards, kind)


def _shards(tokenizer_path: str, shard_bytes: int):  # noqa: ANN202
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("ks", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, encoder = TaskContext.get().partitionId(), 0, _encoder(tokenizer_path)
        end, last, k = np.array([END_ID], encoder.kind).tobytes(), object(), 0
        ids: list = []
        ks: list[int] = []
        raw: list[bytes] = []
        held = 0

        def made() -> pa.RecordBatch:
            rows = [[part], [shard], [b"".join(raw)], [ids], [ks], [[len(x) // encoder.kind.itemsize for x in raw]]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for begin, stop in byte_groups(texts):
                for doc, x in zip(doc_ids[begin:stop], encoder(texts[begin:stop].to_pylist()), strict=True):
                    k = k + 1 if doc == last else 0
                    last = doc
                    ids.append(doc), ks.append(k), raw.append(x + end)
                    held += len(x) + len(end)
                    if held >= shard_bytes:
                        yield made()
                        shard, ids, ks, raw, held = shard + 1, [], [], [], 0
        if raw:
            yield made()

    return run


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder, whose memory of chunks outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, shard, ids, ks, lens in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            n = len(ids)
            offsets = np.concatenate([[0], np.cumsum(lens)[:-1]])
            cols = [pa.array(ids, pa.int64()), pa.array(ks, pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(offsets.astype(np.int32)), pa.array(lens, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "k", "part", "shard", "offset", "n"])


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    for seed in range(SEEDS):
        x = _hashed(rows, seed)
        if len(np.unique(x)) == len(x):  # else two keys have one hash, and another seed parts them
            break
    else:
        raise ValueError(f"keys of index shard {rows.index_shard.iloc[0]} are not parted by {SEEDS} seeds: there are equal ones")
    hash_ = PerfectHash.build(x)
    slot = hash_(x)
    out = {"index_shard": [int(rows.index_shard.iloc[0])], "seed": [seed], "shifts": [hash_.shifts.tobytes()]}
    for name, values in (("prints", _fingerprint(x)), *((c, rows[c].to_numpy(np.int32)) for c in ("part", "shard", "offset", "n"))):
        held = np.empty(len(x), values.dtype)
        held[slot] = values
        out[name] = [held.tobytes()]
    return pd.DataFrame(out)


def _fingerprint(x: np.ndarray) -> np.ndarray:
    return (_splitmix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def _cut(at: pd.DataFrame, shard: pd.DataFrame, kind: str) -> pd.DataFrame:
    """The documents asked for, cut out of one shard."""
    out = {"id": at.id, "no_id": at.no_id, "k": at.k}
    if not len(at) or not len(shard):
        return pd.DataFrame(out | {c: pd.Series([], dtype="int64") for c in ("start", "n_tokens", "ids_crc32")}).iloc[:0]
    ids = np.frombuffer(shard.payload.iloc[0], kind).astype("<u4")
    crc = [zlib.crc32(ids[a : a + n].data) for a, n in zip(at.offset.tolist(), at.n.tolist(), strict=True)]
    return pd.DataFrame(out | {"start": at.offset.astype("int64") + int(shard.start.iloc[0]), "n_tokens": at.n.astype("int64"), "ids_crc32": crc})


def _locate(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    names = ["part", "shard", "offset", "n"]
    if not len(keys) or not len(index):
        return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("id", "int64"), ("no_id", "bool"), ("k", "int64"))} | {c: pd.Series([], dtype="int32") for c in names})
    row = index.iloc[0]
    x = _hashed(keys, int(row.seed))
    slot = PerfectHash(np.frombuffer(row.shifts, np.int32), len(row.prints) // 4)(x)
    own = np.frombuffer(row.prints, np.uint32)[slot] == _fingerprint(x)
    found = pd.DataFrame({"id": keys.id, "no_id": keys.no_id, "k": keys.k} | {c: np.frombuffer(row[c], np.int32)[slot] for c in names})
    return found[own]
