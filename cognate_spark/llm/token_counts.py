"""Token counts of texts, by lengths of pre-tokens that are looked up where the texts are read.

A byte-level tokenizer cuts a text into pre-tokens (a word with the blank before it, digits, marks, white space) and encodes
each by itself, so a text's count is the sum of its pre-tokens' counts. There are two tiers of known ones:

* a `Table`, the same in every task: frequent pre-tokens with their lengths in a hash table of numpy arrays (open addressing over
  64-bit hashes; the characters are kept too, and every hit is compared with them). It is made by the driver from a bounded
  sample, at most `SAMPLE_DOCS` texts of at most `SAMPLE_CHARS` characters chosen by a hash, holds at most `TABLE_ROWS` entries and is
  broadcast: some 10 MB at most. The sample decides where a length comes from and no result.
* a cache of each worker for what the table misses: the tokenizer is asked once, and the cache begins anew at `CACHE` entries.

Pre-tokens never leave the task that reads their text, so there is no shuffle at all. Classes of characters are asked of the
tokenizer's own pre-tokenizer, once a worker and character. Texts that hold an added token's string, and all texts of tokenizers of
another kind (a normalizer, other pre-tokenizers, sentencepiece models), are encoded whole by the library.

Null texts are empty: no token. Texts are read in pieces of about `PIECE` characters, cut where white space follows another
character, so very long ones need no more memory (a single pre-token is never cut). Rows pass through as they are, repeated ones
too; columns of the names that are added are replaced.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_groups, text_of

SAMPLE_DOCS, SAMPLE_CHARS = 1000, 20_000
TABLE_ROWS = 1 << 17
#: Entries of a worker's cache, of at most CACHED_CHARS characters: about 100 MB.
CACHE, CACHED_CHARS = 500_000, 64
PIECE = 1 << 20
SPACE, LETTER, DIGIT, MARK, UNKNOWN = 0, 1, 2, 3, 255
_MULT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Endings that are pre-tokens of their own after an apostrophe: fixed values.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


class Library:
    """The library's counts for a tokenizer file: .json of tokenizers, .model of sentencepiece."""

    def __init__(self, path: str) -> None:
        self.added: list[str] = []
        self.byte_level = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.counts = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.counts = lambda texts: [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.byte_level = self.tokenizer.normalizer is None and self._cuts_as_expected()

    def pieces(self, text: str) -> list[tuple[int, int]]:
        return [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _cuts_as_expected(self) -> bool:
        """Whether pre-tokens are those of `Splitter`, on texts with all that it distinguishes."""
        if self.tokenizer.pre_tokenizer is None:
            return False
        probes = ["a b  c\n\n d\t", "  x1y22 3-4", "don't 'tis 's ''s we're'll I've\n'd x'sy'tz", "é1ßж,中文!?  　x\x1c \U0001f600\U0001f600a", " \n ", "'", "a'rea 'r 'l"]
        return all(Splitter(self).spans(p) == self.pieces(p) for p in probes)


class Splitter:
    """Cuts code points into pre-tokens, with numpy over many texts at once."""

    def __init__(self, library: Library) -> None:
        self.library = library
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)

    def kind(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point; those not met before are asked of the pre-tokenizer: a character that stays with what
        is before it is of the same class."""
        kinds = self.kinds[points]
        if (kinds == UNKNOWN).any():
            new = np.unique(points[kinds == UNKNOWN])
            self.kinds[new] = SPACE
            for before, kind in (("a", LETTER), ("1", DIGIT), ("#", MARK)):
                starts = {a for a, _ in self.library.pieces("".join("\n" + before + chr(c) for c in new.tolist()))}
                self.kinds[new[[3 * i + 2 not in starts for i in range(len(new))]]] = kind
            kinds = self.kinds[points]
        return kinds

    def starts(self, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin; firsts: where texts begin (of at least one character each)."""
        n, kind = len(points), self.kind(points)
        first = np.zeros(n + 1, bool)
        first[firsts] = first[n] = True
        run = first[:-1].copy()
        run[1:] |= kind[1:] != kind[:-1]
        space, last = kind == SPACE, first[1:]  # last: of its text
        ends_run = np.append(run[1:], True)
        follows = space & ends_run & ~last  # the white space right before another character
        blank = follows & (points == 32)  # which goes with that character, if it is a blank
        cut = run.copy()
        cut[1:] &= ~blank[:-1]
        cut |= blank
        cut |= follows & ~run  # the last of several stands alone, or with what follows
        quote = np.flatnonzero((points == 39) & run & ends_run & cut & ~last)
        if len(quote):
            padded = np.append(points, [0, 0, 0])
            here = np.append(first, [True, True, True])
            one, two = padded[quote + 1], np.where(here[quote + 2], 0, padded[quote + 2])
            for ending in ENDINGS:
                is_it = (one == ord(ending[0])) & (two == ord(ending[1]) if len(ending) > 1 else True)
                at = quote[is_it]
                cut[at + 1] = False
                after = at + 1 + len(ending)
                cut[after[after < n]] = True
        return np.flatnonzero(cut)

    def spans(self, text: str) -> list[tuple[int, int]]:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return []
        at = self.starts(points, np.array([0]))
        return list(zip(at.tolist(), [*at[1:].tolist(), len(points)], strict=True))


_POWERS = np.array([1], np.uint64)


def hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits of each pre-token: a polynomial over its code points, mixed."""
    global _POWERS
    sizes = np.diff(np.append(starts, len(points)))
    longest = int(sizes.max(initial=1))
    with np.errstate(over="ignore"):
        while len(_POWERS) < longest:
            _POWERS = np.concatenate([_POWERS, _POWERS * _POWERS[-1] * _MULT])
        place = np.arange(len(points)) - np.repeat(starts, sizes)
        h = np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * _POWERS[place], starts)
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))


@dataclass
class Table:
    """Hashes of pre-tokens by slot (open addressing), their lengths in tokens, and where their characters are."""

    slots: np.ndarray
    counts: np.ndarray
    firsts: np.ndarray
    sizes: np.ndarray
    points: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> Table:
        """Of distinct pre-tokens; one whose hash another has already is left out."""
        h = hashes(points, starts) if len(starts) else np.zeros(0, np.uint64)
        _, one = np.unique(h, return_index=True)
        n = 1 << max(2, int(2 * len(one)).bit_length())
        slots = np.full(n, -1, np.int32)
        left = one
        at = (h[left] & np.uint64(n - 1)).astype(np.int64)
        while len(left):
            _, won = np.unique(at, return_index=True)
            free = won[slots[at[won]] < 0]
            slots[at[free]] = left[free]
            rest = np.ones(len(left), bool)
            rest[free] = False
            left, at = left[rest], (at[rest] + 1) & (n - 1)
        return cls(slots, counts.astype(np.int32), starts.astype(np.int32), np.diff(np.append(starts, len(points))).astype(np.int32), points)

    def find(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, h: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The entry of each pre-token, or -1. own: the hashes of the entries."""
        n = len(self.slots)
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        at = (h & np.uint64(n - 1)).astype(np.int64)
        while len(todo):
            entry = self.slots[at]
            hit = (entry >= 0) & (own[np.maximum(entry, 0)] == h[todo]) if len(own) else np.zeros(len(todo), bool)
            out[todo[hit]] = entry[hit]
            go = (entry >= 0) & ~hit
            todo, at = todo[go], (at[go] + 1) & (n - 1)
        found = np.flatnonzero(out >= 0)
        found = found[self.sizes[out[found]] == sizes[found]]
        good = np.zeros(len(h), bool)
        if len(found):  # the characters themselves are compared
            k, ends = sizes[found], np.cumsum(sizes[found])
            step = np.arange(ends[-1]) - np.repeat(ends - k, k)
            same = points[np.repeat(starts[found], k) + step] == self.points[np.repeat(self.firsts[out[found]], k) + step]
            good[found] = np.logical_and.reduceat(same, ends - k)
        return np.where(good, out, -1)


class Counter:
    """Counts of texts by a table and a worker's cache."""

    def __init__(self, path: str, table: Table | None) -> None:
        self.library = Library(path)
        self.split = Splitter(self.library)
        self.cache: dict[str, int] = {}
        self.table = table
        self.own = hashes(table.points, table.firsts.astype(np.int64)) if table is not None and len(table.firsts) else np.zeros(0, np.uint64)

    def _missed(self, words: list[str]) -> list[int]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = list({w for w in words if w not in self.cache})
        learned = dict(zip(new, self.library.counts(new), strict=True))
        found = [learned[w] if w in learned else self.cache[w] for w in words]
        self.cache.update((w, n) for w, n in learned.items() if len(w) <= CACHED_CHARS)
        return found

    def _piece(self, text: str, firsts: np.ndarray) -> np.ndarray:
        """Counts of texts that stand one after the other, none of them empty."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = self.split.starts(points, firsts)
        sizes = np.diff(np.append(starts, len(points)))
        counts = np.zeros(len(starts), np.int64)
        missed = np.ones(len(starts), bool)
        if self.table is not None and len(self.own):
            entry = self.table.find(points, starts, sizes, hashes(points, starts), self.own)
            missed = entry < 0
            counts[~missed] = self.table.counts[entry[~missed]]
        at = np.flatnonzero(missed)
        if len(at):
            counts[at] = self._missed([text[a : a + k] for a, k in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)])
        return np.add.reduceat(counts, np.searchsorted(starts, firsts))

    def _pieces(self, text: str) -> Iterator[str]:
        """A long text in parts of about PIECE characters that no pre-token spans."""
        begin = 0
        while len(text) - begin > 2 * PIECE:
            end = begin + PIECE
            while end < len(text) and not (text[end] in " \n" and self.split.kind(np.array([ord(text[end - 1])]))[0] != SPACE):
                end += 1
            yield text[begin:end]
            begin = end
        if begin < len(text):
            yield text[begin:]

    def __call__(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        if not self.library.byte_level:
            return self.library.counts(texts)
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.library.added)]
        for i, n in zip(whole, self.library.counts([texts[i] for i in whole]), strict=True):
            out[i] = n
        odd = set(whole)
        held: list[tuple[int, str]] = []
        size = 0

        def done() -> None:
            ends = np.cumsum([len(t) for _, t in held])
            for (i, _), n in zip(held, self._piece("".join(t for _, t in held), np.concatenate([[0], ends[:-1]]).astype(np.int64)).tolist(), strict=True):
                out[i] += n
            held.clear()

        for i, text in enumerate(texts):
            if i in odd:
                continue
            for part in self._pieces(text):
                held.append((i, part))
                size += len(part)
                if size >= PIECE:
                    done()
                    size = 0
        if held:
            done()
        return out


def frequent(docs: DataFrame, path: str, rows: int = TABLE_ROWS, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Table | None:
    """The table of the pre-tokens that are most frequent in a sample of the texts; None where texts are encoded whole."""
    library = Library(path)
    if not library.byte_level:
        return None
    most = 1 << 40
    share = max(1, min(most, 4 * sample_docs * most // max(docs.count(), 1)))
    mark = F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns])
    some = docs.select("text", mark.alias("mark")).where(F.pmod(mark, F.lit(most)) < share).where(F.length("text").between(1, sample_chars)).orderBy("mark").limit(sample_docs).collect()
    split, seen = Splitter(library), {}
    for r in some:
        for a, b in split.spans(r.text):
            word = r.text[a:b]
            seen[word] = seen.get(word, 0) + 1
    words = sorted((w for w in seen if len(w) <= CACHED_CHARS), key=lambda w: (-seen[w], w))[:rows]
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return Table.build(points, np.cumsum(sizes) - sizes, np.array(library.counts(words), np.int64))


#: A worker's counter, which outlives a task.
_COUNTERS: dict[str, Counter] = {}


def counted(docs: DataFrame, path: str, limit: int = 512, table: Table | None = None) -> DataFrame:
    """docs (with text) with n_bytes, n_tokens and over_limit (more than `limit` tokens), counted where they are read."""
    sent = docs.sparkSession.sparkContext.broadcast(table if table is not None else frequent(docs, path))
    mark = uuid.uuid4().hex

    @F.arrow_udf("long")
    def tokens(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if mark not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[mark] = Counter(path, sent.value)
        for part in parts:
            counts: list[int] = []
            for begin, end in byte_groups(part):
                counts += _COUNTERS[mark](part.slice(begin, end - begin).to_pylist())
            yield pa.array(counts, pa.int64())

    text = text_of("text")
    return docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": tokens(text)}).withColumn("over_limit", F.col("n_tokens") > limit)
