"""Secret scans: fixed patterns, and formats learned as probabilistic automata from labelled credentials.

The base patterns (assignments, access keys, long hexadecimal runs) give their spans as they are. Beside them,
for each kind of labelled credential a prefix tree of the examples is folded into a probabilistic automaton: states
are merged while their stopping and continuing frequencies, and those of all they lead to, are statistically
compatible (Hoeffding bounds, red-blue order). In every run of credential characters (base spans are cut out of it) candidates
of 8 or more with a digit and a letter are scored by log2 of their likelihood under the best automaton against a model of
ordinary tokens. A candidate is the whole run, or begins after a separator or at a format's first symbols and ends where
the automaton likes best to stop, so credentials glued to names and paths are found. Those above the threshold add a span
`format`, the best first, without overlaps; the whole run is taken unless a part is better by half the threshold.

All spans, those of the base too, carry their score: of an assignment that of its value. A text is gone through once, whatever the number
of spans in it.

Labels: examples of documented public formats made by a seeded rule, and at most `LABEL_ROWS` texts of the corpus, chosen by
a hash, whose base matches label themselves: a bounded sample for fitting; all texts are scanned whole, in one pass without a
shuffle. Null texts are empty. Ids may be of any type. Repeated rows are judged by themselves. Other columns stay out.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind_of, text_of

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ of 24 or more: either takes whole runs
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Labelled texts, their most characters, and examples of a kind: bounds of the fit alone.
LABEL_ROWS, LABEL_CHARS, EXAMPLES = 300, 50_000, 150
THRESHOLD = 12.0
LEAST = 8
SEPARATORS = "=.-_/+"
#: A candidate is followed until its score lies so many bits below its best: three or four symbols that no example has.
DROP = 40.0

UP, LOW, DIG = string.ascii_uppercase, string.ascii_lowercase, string.digits
#: Documented public formats: fixed prefix, then parts of (alphabet, least, most length).
FORMATS = {
    "aws_access": ("AKIA", ((UP + "234567", 16, 16),)),
    "github": ("ghp_", ((UP + LOW + DIG, 36, 36),)),
    "google": ("AIza", ((UP + LOW + DIG + "_-", 35, 35),)),
    "stripe": ("sk_live_", ((UP + LOW + DIG, 24, 24),)),
    "slack": ("xoxb-", ((DIG, 11, 12), ("-", 1, 1), (DIG, 11, 12), ("-", 1, 1), (UP + LOW + DIG, 24, 24))),
    "jwt": ("eyJ", ((UP + LOW + DIG + "_-", 20, 40), (".", 1, 1), (UP + LOW + DIG + "_-", 30, 60), (".", 1, 1), (UP + LOW + DIG + "_-", 43, 43))),
    "sendgrid": ("SG.", ((UP + LOW + DIG + "_-", 22, 22), (".", 1, 1), (UP + LOW + DIG + "_-", 43, 43))),
}
PREFIX = re.compile("|".join(re.escape(prefix) for prefix, _ in FORMATS.values()))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's place in KINDS) of the base matches that are long enough."""
    out = []
    low = text.lower()
    if any(x in low for x in NAMES):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def examples(n: int = EXAMPLES, seed: int = 5) -> dict[str, list[str]]:
    """Labelled credentials of the public formats."""
    r = random.Random(seed)
    made = lambda parts: "".join("".join(r.choices(a, k=r.randint(lo, hi))) for a, lo, hi in parts)
    return {k: [prefix + made(parts) for _ in range(n)] for k, (prefix, parts) in FORMATS.items()}


#: Characters of a class share its probability; the first characters of a token stand for themselves.
_CLASSES = {**{c: ("U", 26) for c in UP}, **{c: ("x", 6) for c in "abcdef"}, **{c: ("l", 20) for c in LOW[6:]}, **{c: ("9", 10) for c in DIG}}
LITERAL = 4


def symbols(token: str) -> list[tuple[str, int]]:
    """(symbol, characters that it may stand for) of a token."""
    return [(c, 1) if i < LITERAL else _CLASSES.get(c, (c, 1)) for i, c in enumerate(token)]


class Automaton:
    """A deterministic probabilistic automaton, folded from examples."""

    def __init__(self, tokens: list[str], alpha: float = 0.05) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.stop = [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for t in tokens:
            self._add([s for s, _ in symbols(t)])
        self._fold()

    def _add(self, token: list[str]) -> None:
        q = 0
        for s in token:
            self.count[q][s] = self.count[q].get(s, 0) + 1
            if s not in self.next[q]:
                self.next[q][s] = len(self.next)
                self.next.append({}), self.count.append({}), self.stop.append(0)
            q = self.next[q][s]
        self.stop[q] += 1

    def _n(self, q: int) -> int:
        return self.stop[q] + sum(self.count[q].values())

    def _alike(self, a: int, n: int, b: int, m: int) -> bool:
        return n == 0 or m == 0 or abs(a / n - b / m) < self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            n, m = self._n(a), self._n(b)
            if not self._alike(self.stop[a], n, self.stop[b], m):
                return False
            for s in self.count[a].keys() | self.count[b].keys():
                if not self._alike(self.count[a].get(s, 0), n, self.count[b].get(s, 0), m):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def _join(self, a: int, b: int) -> None:
        """Folds the subtree of b into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.stop[a] += self.stop[b]
            for s, n in self.count[b].items():
                self.count[a][s] = self.count[a].get(s, 0) + n
            for s, q in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], q))
                else:
                    self.next[a][s] = q

    def _fold(self) -> None:
        red = [0]
        while True:
            blue = [(p, s, q) for p in red for s, q in sorted(self.next[p].items()) if q not in red]
            if not blue:
                break
            p, s, q = max(blue, key=lambda x: self._n(x[2]))
            for r in red:
                if self._compatible(r, q):
                    self.next[p][s] = r
                    self._join(r, q)
                    break
            else:
                red.append(q)
        self.states = len(red)
        keep = {q: i for i, q in enumerate(red)}
        self.next = [{s: keep[t] for s, t in self.next[q].items()} for q in red]
        self.count, self.stop = [self.count[q] for q in red], [self.stop[q] for q in red]
        self.size = [self._n(q) for q in range(len(red))]

    def log2(self, token: str, floor: float = 1e-4) -> float:
        """log2 of the token's probability; what no example did has the probability floor."""
        total, q = 0.0, 0
        for s, size in symbols(token):
            n = self._n(q)
            total += math.log2(max(self.count[q].get(s, 0) / n, floor) / size)
            q = self.next[q].get(s, q)
        return total + math.log2(max(self.stop[q] / self._n(q), floor))

    def best_end(self, run: str, start: int, ordinary: list[float], ends: dict[int, float], fits: list[tuple[int, int]], floor: float = 1e-4) -> tuple[float, int]:
        """Bits in favour of the best candidate from this start, and its end. ordinary: log2 of each character in the
        background, ends: of the run's end by its place; fits: digits and letters before each character."""
        total, q, top, best = 0.0, 0, 0.0, (-math.inf, start)
        for i in range(start, len(run)):
            s, size = (run[i], 1) if i - start < LITERAL else _CLASSES.get(run[i], (run[i], 1))
            total += math.log2(max(self.count[q].get(s, 0) / self.size[q], floor) / size) - ordinary[i]
            q = self.next[q].get(s, q)
            if i - start >= LEAST - 1 and fits[i + 1][0] > fits[start][0] and fits[i + 1][1] > fits[start][1]:
                best = max(best, (total + math.log2(max(self.stop[q] / self.size[q], floor)) - ends.get(i + 1, 0.0), i + 1))
            if total < top - DROP:
                break
            top = max(top, total)
        return best


class Background:
    """Ordinary tokens: letter pairs with add-half smoothing over 70 characters, and lengths by a constant rate."""

    def __init__(self, tokens: list[str]) -> None:
        self.pairs, self.first = Counter(), Counter()
        for t in tokens:
            for a, b in zip(" " + t, t + " ", strict=True):
                self.pairs[a, b] += 1
                self.first[a] += 1

    def each(self, token: str) -> list[float]:
        """log2 of each character after the one before it, and of the end."""
        return [math.log2((self.pairs[a, b] + 0.5) / (self.first[a] + 35)) for a, b in zip(" " + token, token + " ", strict=True)]

    def log2(self, token: str) -> float:
        return sum(self.each(token))


class Scanner:
    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str], threshold: float = THRESHOLD) -> None:
        self.automata = {k: Automaton(v) for k, v in sorted(labelled.items()) if v}
        self.background = Background(ordinary)
        self.threshold = threshold

    def score(self, token: str) -> tuple[float, str]:
        """Bits in favour of the best format, and its name."""
        best, kind = max((a.log2(token), k) for k, a in self.automata.items())
        return best - self.background.log2(token), kind

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and those that the automata add."""
        base, more = base_spans(text), []
        for m, covers in with_covers(TOKEN.finditer(text), base):
            for a, b in uncovered(m.start(), m.end(), covers):
                run = text[a:b].lstrip(SEPARATORS).rstrip(".")
                if len(run) >= LEAST:
                    start = a + text[a:b].index(run)
                    more += [(start + x, start + y, 3) for x, y in self.parts(run)]
        return base, sorted(more)

    def parts(self, run: str) -> list[tuple[int, int]]:
        """The credentials in a run: its best candidates that do not overlap."""
        fits = [(0, 0)]
        for c in run:
            fits.append((fits[-1][0] + c.isdigit(), fits[-1][1] + c.isalpha()))
        if not all(fits[-1]):
            return []
        *ordinary, last = self.background.each(run)
        core = len(run.rstrip(SEPARATORS))  # a credential may end with a separator, or before it
        ends, found = {core: self.background.each(run[:core])[-1], len(run): last}, []
        for to in ends:
            if to >= LEAST and all(fits[to]) and (whole := self.score(run[:to])[0]) >= self.threshold:
                found.append((whole + self.threshold / 2, 0, to))
        starts = {i for i, c in enumerate(run) if c not in SEPARATORS and (i == 0 or run[i - 1] in SEPARATORS)} | {m.start() for m in PREFIX.finditer(run)}
        for i in starts:
            if len(run) - i >= LEAST:
                best, to = max(x.best_end(run, i, ordinary, ends, fits) for x in self.automata.values())
                if best >= self.threshold:
                    found.append((best, i, to))
        taken: list[tuple[int, int]] = []  # by place, so that only its neighbours can overlap a candidate
        for _, i, to in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            at = bisect(taken, (i, to))
            if (not at or taken[at - 1][1] <= i) and (at == len(taken) or to <= taken[at][0]):
                taken.insert(at, (i, to))
        return taken


def with_covers(tokens: Iterator[re.Match], spans: list[tuple[int, int, int]]) -> Iterator[tuple[re.Match, list[tuple[int, int, int]]]]:
    """Tokens, each with the spans that overlap it. Both come sorted by start and are gone through once; spans that overlap
    one another are united."""
    united: list[list[int]] = []
    for a, b, _ in spans:
        if united and a < united[-1][1]:
            united[-1][1] = max(united[-1][1], b)
        else:
            united.append([a, b])
    at = 0
    for m in tokens:
        while at < len(united) and united[at][1] <= m.start():
            at += 1
        to = at
        while to < len(united) and united[to][0] < m.end():
            to += 1
        yield m, [(a, b, 0) for a, b in united[at:to]]


def uncovered(start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of start:end that no span covers; spans come sorted by start."""
    out = []
    for a, b, _ in spans:
        if start < b and a < end:
            out.append((start, a))
            start = b
    return [(a, b) for a, b in [*out, (start, end)] if a < b]


def fitted(docs: DataFrame, label_rows: int = LABEL_ROWS) -> Scanner:
    """A scanner from the public formats and the texts with the least hashes among those with something like a base match, at most
    `label_rows` different ones of up to `LABEL_CHARS` characters; of each kind's labels those `EXAMPLES` with the least hashes teach.
    The hashes to look below come from a count of different texts, so that a few times `label_rows` texts leave the scan at any size."""
    most = 1 << 40
    text = docs.select(text_of("text").alias("text")).where(F.length("text") <= LABEL_CHARS).withColumn("mark", F.pmod(F.xxhash64("text"), F.lit(most)))
    like = text.where(F.col("text").rlike(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]"))
    different = like.agg(F.approx_count_distinct("mark")).first()[0]
    share = most if different <= 4 * label_rows else 4 * label_rows * most // different
    some = like.where(F.col("mark") < share).distinct().orderBy("mark", "text").limit(label_rows)
    labelled, ordinary = defaultdict(list, examples()), []
    for row in some.collect():
        spans = base_spans(row.text)
        for a, b, k in spans:
            token = row.text[a:b] if k else ASSIGN.match(row.text[a:b])[2]
            labelled[KINDS[k]].append(token)
        ordinary += [w for w in re.findall(r"[A-Za-z0-9+/_.=-]+", row.text) if not any(w in row.text[a:b] for a, b, _ in spans)]
    mark = lambda x: zlib.crc32(x.encode())
    return Scanner({k: sorted(sorted(set(v)), key=mark)[:EXAMPLES] for k, v in labelled.items()}, ordinary)


def scores(spans: Column) -> Column:
    """The spans' scores in bits as a string, with one decimal, in the spans' order."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"], 1).cast("string")), ",")


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], x[2])))


SCHEMA = "spans array<struct<start:int,end:int,kind:string,score:double>>, n_assign long, n_access long, n_hex long, base_sha256 string, named string"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """Per document: doc_id, spans (all, with kinds and the bits in favour of the best format), counts of base spans, their
    digest, all spans as a string."""
    sent = docs.sparkSession.sparkContext.broadcast(scanner)  # automata of a few hundred states

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        types = (_SPANS, *[pa.int64()] * 3, pa.string(), pa.string())
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                base, more = own.spans(t)
                n = Counter(k for _, _, k in base)
                all_ = sorted(base + more, key=lambda x: (x[0], x[2]))
                rows.append(([{"start": a, "end": b, "kind": KINDS[k], "score": own.score(ASSIGN.match(t[a:b])[2] if k == 0 else t[a:b])[0]} for a, b, k in all_], n[0], n[1], n[2], hashlib.sha256(named(base).encode()).hexdigest(), named(all_)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "spans", "n_assign", "n_access", "n_hex", "base_sha256", "named"])

    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, {SCHEMA}")
