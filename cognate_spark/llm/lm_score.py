"""Language-model scores by logistic context mixing over bits, beside an add-one unigram base.

A text is scored as its words, A-Z lower-cased, with single spaces between and an end byte. Each byte is eight
binary decisions; predictors of order 0 to 4 know how often each bit followed its context in all training texts. Their
log-odds are combined by weights that a gate selects (bit place and the longest context seen); an adaptive map then
refines the mixed probability. The score is the sum of log10 of the bits' probabilities, `bits_per_byte` its cost.

All that is learned comes from all training texts, through their 5-byte windows and words, which Spark counts. Counts
of contexts are exact, without hashed tables: windows are dealt out by the two bytes before their last one, so that whatever
contexts of order 2 to 4 share is in one group (at most 2 ** 24 windows); the counts of orders 0 and 1 are at most 65536.
Weights are learned online in each task (Newton steps over its windows, each bit's own count left out and each window as
often as it occurs) and merged over `ROUNDS` rounds, averaged by their precisions. The map sums over all training windows.

A bit's probability depends on a window alone, so each distinct window is costed once. The `COMMON_WINDOWS` most frequent
are sent to the tasks; a text's others go with its number to a join with the costs, so nothing is lost at any size.

Words: at most `COMMON_WORDS` frequent ones are sent to the tasks; all others go with their document's number to a
join with the counts, so the base is exact at any vocabulary. A rare word is no hot key.

Null texts are empty: one end token. Null ids count as the empty string for the split. Repeated rows are documents
by themselves. Other columns stay out. Without training texts every base term is log10(1 / 1) = 0.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, kind_of, text_of, words, written

ORDERS = 5
#: Words sent to every task: 25 MB there.
COMMON_WORDS = 150_000
#: Windows sent to every task with their costs: 16 MB, and 32 MB for finding them.
COMMON_WINDOWS = 1 << 20
#: Rounds of online learning; windows of a step, and of a piece (whole groups); strength of a task's first weights.
ROUNDS, STEP, PIECE, PRIOR = 3, 1 << 14, 1 << 16, 50.0
HELD, WINDOW = np.uint64(1 << 40), np.uint64((1 << 40) - 1)
END = 10
STEPS = 32
MULT = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def canonical(text: str) -> bytes:
    return b" ".join(text.encode().lower().split()) + b"\n"  # bytes: ASCII letters and blanks only


def _windows_of(texts: list[bytes]) -> np.ndarray:
    """For each byte of all texts, one after the other, its value and the four before it (0 before the text's start), the nearest in the
    lower bits."""
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    lens = np.array([len(t) for t in texts])
    place = np.arange(len(raw)) - np.repeat(np.cumsum(lens) - lens, lens)
    code = raw.copy()
    for k in range(1, ORDERS):
        code[k:] |= np.where(place[k:] >= k, raw[:-k] << np.uint64(8 * k), np.uint64(0))
    return code


def bits_of(code: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, node, bit) for the eight bits of the windows' last bytes."""
    byte = (code & np.uint64(255)).astype(np.int64)
    for j in range(8):
        yield j, (byte | 256) >> (8 - j), (byte >> (7 - j)) & 1


class Mixer:
    """The gated weights and the refining map."""

    def __init__(self) -> None:
        self.seen = 0  # bytes of training texts behind weights and map
        self.weights = np.full((ORDERS + 1, 8, ORDERS), 0.3)
        self.refined = np.tile(1 / (1 + np.exp(-(np.arange(STEPS + 1) - STEPS / 2) / 2)), (256, 1))

    def predict(self, x: np.ndarray, gate: np.ndarray, j: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mixed probability of a 1, the final one, and the place in the refining map."""
        t = np.clip((self.weights[gate, j] * x).sum(1), -12, 12)
        p = 1 / (1 + np.exp(-t))
        at = np.rint(np.clip(t * 2, -STEPS / 2, STEPS / 2) + STEPS / 2).astype(np.int64)
        return p, np.clip((p + self.refined[node, at]) / 2, 1e-6, 1 - 1e-6), at


def log_odds(a: np.ndarray, b: np.ndarray, bit: np.ndarray, own: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds by order, and the gate, from the zeros and ones after each window's contexts (windows x orders)."""
    a, b = np.maximum(a - own * (1 - bit)[:, None], 0), np.maximum(b - own * bit[:, None], 0)
    return np.log((b + 0.2) / (a + 0.2)), (a + b >= 1).sum(1)


def near_tables(pairs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Zeros and ones of orders 0 and 1 by (context, node), from the counts of (byte before, byte)."""
    code = np.arange(1 << 16, dtype=np.uint64)
    one = np.zeros((2, 1 << 16))
    for _, node, bit in bits_of(code):
        at = (code >> np.uint64(8) << np.uint64(8)).astype(np.int64) + node
        for v in (0, 1):
            one[v] += np.bincount(at[bit == v], pairs[bit == v], 1 << 16)
    return [tuple(x.reshape(256, 256).sum(0) for x in one), tuple(one)]


def exact(code: np.ndarray, n: np.ndarray, near: list) -> Iterator[tuple]:
    """(place, node, bit, zeros, ones) for the bits of windows that hold whole groups; n: how often they occur in training."""
    runs = []
    for o in range(2, ORDERS):
        masked = code & np.uint64((1 << 8 * (o + 1)) - 1)
        order = np.argsort(masked, kind="stable")
        runs.append((o, masked[order], order, n[order]))
    before = ((code >> np.uint64(8)) & np.uint64(255)).astype(np.int64) << 8
    for j, node, bit in bits_of(code):
        a, b = np.empty((len(code), ORDERS)), np.empty((len(code), ORDERS))
        for o in (0, 1):
            a[:, o], b[:, o] = (x[node + o * before] for x in near[o])
        for o, masked, order, times in runs:
            key = masked >> np.uint64(8 - j)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            ones = np.add.reduceat(times * ((masked >> np.uint64(7 - j)) & np.uint64(1)), first)
            a[order, o], b[order, o] = np.repeat(np.add.reduceat(times, first) - ones, size), np.repeat(ones, size)
        yield j, node, bit, a, b


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code, n, m) of whole groups; rows come sorted by group."""
    held: list[list[np.ndarray]] = []
    size, least = 0, PIECE
    for batch in batches:
        held.append([batch.column(0).to_numpy().astype(np.uint64), *(batch.column(i).to_numpy().astype(np.float64) for i in (1, 2))])
        size += len(batch)
        if size >= least:
            all_ = [np.concatenate(x) for x in zip(*held, strict=True)]
            group = (all_[0] >> np.uint64(8)) & np.uint64(0xFFFF)
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield tuple(x[:cut] for x in all_)
            held, size = [[x[cut:] for x in all_]], size - cut
            least = max(PIECE, 2 * size)
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _learned(sent):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, mixer = sent.value
        weights, precision, seen = mixer.weights.copy(), np.tile(np.eye(ORDERS) * PRIOR, (ORDERS + 1, 8, 1, 1)), 0.0
        for code, n, _ in _pieces(batches):
            seen += n.sum()
            for j, _, bit, a, b in exact(code, n, near):
                x, gate = log_odds(a, b, bit, 1.0)
                for at in range(0, len(code), STEP):
                    part = slice(at, at + STEP)
                    for g in np.unique(gate[part]):
                        mine = at + np.flatnonzero(gate[part] == g)
                        own, times = x[mine], n[mine]
                        p = 1 / (1 + np.exp(-np.clip(own @ weights[g, j], -12, 12)))
                        precision[g, j] += (own * (times * np.maximum(p * (1 - p), 0.02))[:, None]).T @ own
                        move = np.linalg.solve(precision[g, j], own.T @ (times * (bit[mine] - p)))
                        weights[g, j] += move * min(1.0, 0.5 / max(np.abs(move).max(), 1e-9))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([precision.tobytes()], pa.binary()), pa.array([seen])], ["a", "b", "seen"])

    return run


def _mapped(sent):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, mixer = sent.value
        hits, all_, seen = np.zeros(256 * (STEPS + 1)), np.zeros(256 * (STEPS + 1)), 0.0
        for code, n, _ in _pieces(batches):
            seen += n.sum()
            for j, node, bit, a, b in exact(code, n, near):
                key = node * (STEPS + 1) + mixer.predict(*log_odds(a, b, bit, 1.0), j, node)[2]
                hits += np.bincount(key, n * bit, len(hits))
                all_ += np.bincount(key, n, len(hits))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([hits.tobytes()], pa.binary()), pa.array([all_.tobytes()], pa.binary()), pa.array([seen])], ["a", "b", "seen"])

    return run


def _costed(sent):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, mixer = sent.value
        for code, n, m in _pieces(batches):
            cost = np.zeros(len(code))
            for j, node, bit, a, b in exact(code, n, near):
                p = mixer.predict(*log_odds(a, b, bit, 0.0), j, node)[1]
                cost += np.log10(np.where(bit == 1, p, 1 - p))
            for at in range(0, len(code), 1 << 18):
                part = slice(at, at + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(code[part].astype(np.int64)), pa.array(m[part].astype(np.int64)), pa.array(cost[part])], ["code", "m", "cost"])

    return run


class Costs:
    """log10 of the common windows. Each has a place by its hash, which the most frequent one keeps; others are searched."""

    def __init__(self, code: np.ndarray, cost: np.ndarray, m: np.ndarray, bits: int = 21) -> None:
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << bits)
        rising = np.argsort(m, kind="stable")
        at = self.places(code[rising])
        self.keys[at], self.values[at] = code[rising], cost[rising]
        order = np.argsort(code)
        self.code, self.cost = code[order], cost[order]

    def places(self, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((code * MULT) >> self.shift).astype(np.int64)

    def __call__(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs, 0 for windows that are not common, and where these are."""
        at = self.places(code)
        out = self.values[at]
        missing = np.flatnonzero(self.keys[at] != code)
        if len(missing) and len(self.code):
            place = np.minimum(np.searchsorted(self.code, code[missing]), len(self.code) - 1)
            found = self.code[place] == code[missing]
            out[missing] = np.where(found, self.cost[place], 0.0)
            missing = missing[~found]
        else:
            out[missing] = 0.0
        return out, missing


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(all_, kind="stable")
    all_, n = all_[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))
    return all_[first], np.add.reduceat(n, first)


def _chunks(batch: pa.RecordBatch, column: int, size: int = 1 << 22) -> Iterator[tuple[int, list[bytes]]]:
    """Canonical texts of a batch, of about `size` bytes or one text at a time, each with its first row."""
    begin, held, n = 0, [], 0
    for i, t in enumerate(batch.column(column)):
        held.append(canonical(t.as_py()))
        n += len(held[-1])
        if n >= size:
            yield begin, held
            begin, held, n = i + 1, [], 0
    if held:
        yield begin, held


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's windows with their counts, those of held-out texts with a mark; given out whenever they fill 2 million places."""
    codes: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def out() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(codes[0]), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(codes[0][at : at + (1 << 18)].astype(np.int64)), pa.array(counts[0][at : at + (1 << 18)])], ["code", "n"])

    for batch in batches:
        held = batch.column(1).to_numpy(zero_copy_only=False)
        for begin, texts in _chunks(batch, 0):
            flags = np.repeat(held[begin : begin + len(texts)], [len(t) for t in texts])
            code, n = np.unique(_windows_of(texts) | np.where(flags, HELD, np.uint64(0)), return_counts=True)
            codes, counts = [*codes, code], [*counts, n.astype(np.int64)]
            if sum(map(len, codes)) > 1 << 21:
                code, n = _merged(codes, counts)
                codes, counts = [code], [n]
                if len(code) > 1 << 20:
                    yield from out()
                    codes, counts = [], []
    if codes:
        code, n = _merged(codes, counts)
        codes, counts = [code], [n]
        yield from out()


_MODELS: dict[str, Costs] = {}


def _scored_rows(sent):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, windows_, common = sent.value
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Costs(*windows_)
        model, get = _MODELS[key], common.get
        for batch in batches:
            uid, doc_id = batch.column(0), batch.column(2)
            for begin, texts in _chunks(batch, 1):
                code = _windows_of(texts)
                cost, missing = model(code)
                lens = np.array([len(t) for t in texts])
                ends = np.cumsum(lens)
                score = np.add.reduceat(cost, ends - lens)
                cuts = np.searchsorted(missing, np.concatenate([[0], ends])).astype(np.int32)
                far = pa.ListArray.from_arrays(pa.array(cuts), pa.array(code[missing].astype(np.int64)))
                base, known, rare, tokens = [], [], [], []
                for t in texts:
                    w = t.split()
                    terms = [get(x) for x in w]
                    rest = [x.decode() for x, v in zip(w, terms, strict=True) if v is None] if None in terms else []
                    base.append(sum(v for v in terms if v is not None)), known.append(len(w) - len(rest)), rare.append(rest), tokens.append(len(w) + 1)
                columns = [uid.slice(begin, len(texts)), doc_id.slice(begin, len(texts)), pa.array(base, pa.float64()), pa.array(known, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(score, pa.float64()), pa.array(lens, pa.int64()), pa.array(tokens, pa.int64()), far]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "base", "n_known", "rare", "score", "n_bytes", "n_tokens", "far"])

    return run


def counted_windows(docs: DataFrame) -> DataFrame:
    """code, n, m: the windows of all docs, how often they occur in training texts and in all texts; written."""
    texts = docs.select(text_of("text").alias("text"), held_out(F.col("doc_id")).alias("held"))
    marked = texts.mapInArrow(_count_windows, "code long, n long")
    training = F.when(F.col("code") < int(HELD), F.col("n")).otherwise(0)
    return written(marked.groupBy(F.col("code").bitwiseAND(int(WINDOW)).alias("code")).agg(F.sum(training).alias("n"), F.sum("n").alias("m")), "windows")


def _grouped(windows_: DataFrame) -> DataFrame:
    """The windows dealt out and sorted by the two bytes before the last one."""
    tasks = max(windows_.sparkSession.sparkContext.defaultParallelism, windows_.count() >> 18)
    group = F.shiftright("code", 8).bitwiseAND(0xFFFF)
    return windows_.repartition(tasks, group).sortWithinPartitions(group)


def train(windows_: DataFrame) -> tuple[list, Mixer]:
    """Counts of orders 0 and 1, and the weights and map of all training texts, from their counted windows."""
    sc, mixer, pairs = windows_.sparkSession.sparkContext, Mixer(), np.zeros(1 << 16)
    training = windows_.where("n > 0")
    for r in training.groupBy(F.col("code").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect():  # at most 65536 rows
        pairs[r.pair] = r.n
    near, grouped = near_tables(pairs), _grouped(training)
    fields = "a binary, b binary, seen double"
    for _ in range(ROUNDS):
        weighted, precision = np.zeros((ORDERS + 1, 8, ORDERS)), np.zeros((ORDERS + 1, 8, ORDERS, ORDERS))
        for r in grouped.mapInArrow(_learned(sc.broadcast((near, mixer))), fields).collect():  # a row of 12 KB a task
            a, b = (np.frombuffer(x).reshape(y.shape) for x, y in ((r.a, weighted), (r.b, precision)))
            weighted, precision = weighted + (b @ a[..., None])[..., 0], precision + b
        if precision.any():
            mixer.weights = np.linalg.solve(precision, weighted[..., None])[..., 0]
    hits, all_ = np.zeros(mixer.refined.size), np.zeros(mixer.refined.size)
    for r in grouped.mapInArrow(_mapped(sc.broadcast((near, mixer))), fields).toLocalIterator():  # a row of 135 KB a task
        hits, all_, mixer.seen = hits + np.frombuffer(r.a), all_ + np.frombuffer(r.b), mixer.seen + int(r.seen)
    mixer.refined = ((hits + 60 * mixer.refined.ravel()) / (all_ + 60)).reshape(mixer.refined.shape)
    return near, mixer


def vocabulary(docs: DataFrame) -> DataFrame:
    """w, c: the words of all docs with their counts, written."""
    return written(docs.select(F.explode(words(ascii_lower(text_of("text")))).alias("w")).groupBy("w").agg(F.count("*").alias("c")), "vocabulary")


def _frequent(df: DataFrame, count: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the largest counts, at most so many, and the others: whole classes of like counts."""
    level = F.floor(F.log2(count) * 8).cast("int")
    n, least = 0, 1 << 30
    for r in sorted(df.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):  # at most 504 rows
        if (n := n + r.n) > most:
            break
        least = r.level
    return df.where(level >= least), df.where(level < least)


def _common(vocab: DataFrame, most: int) -> dict[bytes, float]:
    """log10(c + 1) of the words with the largest counts."""
    rows = _frequent(vocab, "c", most)[0].toArrow()
    return {w.as_py().encode(): math.log10(c.as_py() + 1) for w, c in zip(rows["w"], rows["c"], strict=True)}


def scored(docs: DataFrame, common_words: int = COMMON_WORDS, common_windows: int = COMMON_WINDOWS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    training = docs.where(~held_out(F.col("doc_id")))
    vocab = vocabulary(training)
    kinds = vocab.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    ends = training.count()
    n, v = kinds.n + ends, kinds.v + (ends > 0)
    counted = counted_windows(docs)
    costs = written(_grouped(counted).mapInArrow(_costed(spark.sparkContext.broadcast(train(counted))), "code long, m long, cost double"), "costs")
    often, seldom = _frequent(costs, "m", common_windows)
    held = often.toArrow()
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, (held["code"].to_numpy().astype(np.uint64), held["cost"].to_numpy(), held["m"].to_numpy()), _common(vocab, common_words)))

    base = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    rows = base.select("uid", text_of("text").alias("text"), F.col("doc_id"))
    made = written(rows.mapInArrow(_scored_rows(sent), f"uid long, doc_id {kind_of(docs, 'doc_id')}, base double, n_known long, rare array<string>, score double, n_bytes long, n_tokens long, far array<long>"), "scores")
    rare = made.select("uid", F.explode("rare").alias("w")).join(vocab, "w").groupBy("uid").agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_base"), F.count("*").alias("rare_known"))
    far = made.select("uid", F.explode("far").alias("code")).join(seldom, "code").groupBy("uid").agg(F.sum("cost").alias("far_score"))
    out = made.drop("rare", "far").join(rare, "uid", "left").join(far, "uid", "left").withColumn("score", F.col("score") + F.coalesce("far_score", F.lit(0.0)))
    base_score = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    known = F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score", (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
