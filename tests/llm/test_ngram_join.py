"""The n-gram join on crowds: shared passages, large groups of near copies, odd columns; recall against brute force."""

import collections
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cognate_spark.llm import ngram_join

from .test_operators import NAMES, plain_sets


def crowd(seed=5, others=1100, pairs=40, copies=560):
    """Texts of which a third is one passage, pairs of short texts that are mostly the passage, and one large group of near copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    passage, base = [word() for _ in range(60)], [word() for _ in range(200)]
    texts = [" ".join([word() for _ in range(60)] + passage + [word() for _ in range(60)]) for _ in range(others)]
    for _ in range(pairs):
        own = [word() for _ in range(6)]
        texts += [" ".join(passage + own + [word()]), " ".join(passage + own + [word()])]
    for i in range(copies):
        changed = list(base)
        changed[r.randrange(200)] = word()
        texts.append(" ".join(changed[: 200 - i % 40]))
    r.shuffle(texts)
    return texts


def plain_links(texts):
    sets = [plain_sets(t) for t in texts]
    at = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    links = collections.defaultdict(set)
    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in at[x])
        links[i] = {j for j, c in common.items() if j != i and c >= 0.8 * (len(s) + len(sets[j]) - c) - 1e-9}
    return links


def test_recall_in_a_crowd(spark, monkeypatch):
    texts = crowd()
    want = plain_links(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    report = {}
    found = {r.doc_id: r for r in ngram_join.join(docs, report=report).collect()}
    asked = [i for i in want if i % 20 == 0 and want[i]]
    assert sum(found[i].n_links for i in asked) >= 0.9 * sum(len(want[i]) for i in asked) and len(asked) > 30
    assert {i: found[i].n_links for i in want} == {i: len(want[i]) for i in want}  # and in fact every link
    assert report["links"] > 100 and report["recall"] >= 0.99 and ngram_join.LEAST_DEPTH <= report["depth"] <= ngram_join.DEPTH
    for i in range(len(texts)):
        assert all(found[j].class_id == found[i].class_id for j in want[i])


def test_prefixes_are_shortened_only_where_needed(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for _ in range(150):
        base = [word() for _ in range(300)]
        texts += [" ".join(base), " ".join([*base[:-1], word()])]
    report = {}
    ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), report=report)
    assert report["depth"] == ngram_join.DEPTH  # nearly equal texts are found by whole paths


def test_odd_columns_and_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [("b", text, 1, 2, 3, 4), ("a", text + " more", 5, 6, 7, 8), (None, text, 9, 1, 2, 3), ("c", "", 0, 0, 0, 0), ("c", None, 1, 1, 1, 1), ("a", text + " more", 0, 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, print int, key_id int, _print int, Row int")
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or "", r.text or "") for r in kept.collect()) == [("", text), ("c", ""), ("c", "")]
    assert {(r.doc_id, r.n_links) for r in ngram_join.join(docs).collect()} == {("b", 3), ("a", 3), (None, 3), ("c", 0)}
    assert ngram_join.deduplicated(spark.createDataFrame([], NAMES)).count() == 0


def test_a_shortfall_is_an_error(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for _ in range(120):
        base = [word() for _ in range(100)]
        texts += [" ".join(base), " ".join([*base[:-2], word()])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    report = {}
    ngram_join.join(docs, report=report)
    assert report["queries"] == 240 and report["links"] >= 200 and report["recall"] == 1.0  # all documents are queries here
    none = spark.createDataFrame([], "a binary, b binary, depth int")
    monkeypatch.setattr(ngram_join, "candidates", lambda *_: none)
    with pytest.raises(RuntimeError, match="incomplete"):
        ngram_join.join(docs, report=report)
    assert report["recall"] == 0.0


def test_long_texts_are_queries(spark):
    r = random.Random(6)
    long = [f"w{r.randrange(10**6)}" for _ in range(40_000)]
    other = [*long[:-1500], *(f"x{i}" for i in range(1500))]  # a similarity of about 0.93
    far = [*long[:20_000], *(f"y{i}" for i in range(20_000))]
    sets = [ngram_join.shingles(" ".join(t)) for t in (long, other, far)]
    q = ngram_join.Query.of(sets[0])
    assert q.n == len(sets[0]) > 30_000 and 0 < len(q.some) <= ngram_join.LONG and q.zeros > 0
    near = [ngram_join.Queries([q], 0.8).links(s) for s in sets]
    true = len(np.intersect1d(sets[0], sets[1])) / len(np.union1d(sets[0], sets[1]))
    assert near[0] == [{"q": 0, "s": 1.0}] and abs(near[1][0]["s"] - true) < 0.02 and near[2] == []
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((long, other, far))], "doc_id long, text string")
    report = {}
    out = {x.doc_id: x.n_links for x in ngram_join.join(docs, report=report).collect()}
    assert out == {0: 1, 1: 1, 2: 0} and report["links"] == 2 and report["recall"] == 1.0


def test_queries_keep_their_bounds(spark):
    docs = spark.createDataFrame([(i % 50, f"a b c d e {i % 40} " * (1 + i % 7)) for i in range(400)], "doc_id long, text string")
    some = ngram_join.query_sets(docs, queries=10)
    assert 0 < len(some) <= 10 and len({q.digest for q in some}) == len(some)
    assert sum(len(q.some) for q in ngram_join.query_sets(docs, most_shingles=60)) <= 60


NO_EDGES = "a binary, b binary, depth int"


def linked(docs, **more):
    return {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.join(docs, least_recall=0.0, **more).collect()}


def plain_classes(want):
    """doc_id: (links, least id of the component)."""
    least = {}
    for i in sorted(want):
        if i not in least:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in least:
                    least[x] = i
                    todo += want[x]
    return {i: (len(want[i]), least[i]) for i in want}


def test_every_link_is_found_where_the_forest_finds_none(spark, monkeypatch):
    """What crowded nodes drop has an exact way: with no edge from any node every link is there, those in a crowd of more than CHUNK too."""
    texts = crowd(seed=9, others=300, pairs=20, copies=300)
    texts += [" ".join(f"t{i}" for i in range(k, k + 12)) for k in range(0, 40, 2)] + ["a b c d e f", "a b c d e", "", "a b"]
    want = plain_links(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(ngram_join, "candidates", lambda *_: spark.createDataFrame([], NO_EDGES))
    report = {}
    assert linked(docs, report=report) == plain_classes(want) and report["recall"] < 0.1 and report["rest"] > 250


def test_links_that_some_nodes_drop_join_their_components(spark, monkeypatch):
    texts = crowd(seed=10, others=100, pairs=30, copies=330)
    want = plain_links(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    whole = ngram_join.candidates
    monkeypatch.setattr(ngram_join, "candidates", lambda *a: whole(*a).where("pmod(xxhash64(a, b), 10) < 6"))
    report = {}
    assert linked(docs, report=report) == plain_classes(want) and report["rest"] > 10


def test_long_texts_are_compared_by_all_parities(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10**7)}"
    base = [word() for _ in range(12_000)]
    texts = [" ".join(base[:k] + [word() for _ in range(12_000 - k)]) for k in (12_000, 11_000, 10_800, 8000, 6000)]
    want = plain_links(texts)
    assert sum(len(x) for x in want.values()) == 6  # the first three are linked, others share first shingles only
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "candidates", lambda *_: spark.createDataFrame([], NO_EDGES))
    report = {}
    assert linked(docs, report=report) == plain_classes(want) and report["rest"] == 3


def test_bounds_of_the_exact_way():
    r = np.random.default_rng(3)
    order = ngram_join.Order([ngram_join.Query.of(np.unique(r.integers(0, 4000, 600).astype(np.uint64))) for _ in range(8)])
    for k in range(400):
        n = int(r.integers(1, 700))
        s = np.unique(r.integers(0, 4000 if k % 2 else 1 << 63, n).astype(np.uint64))
        gone = r.random(len(s)) < 0.12
        t = np.union1d(s[~gone], r.integers(0, 1 << 63, int(r.integers(0, 1 + len(s) // 8))).astype(np.uint64))
        common = len(np.intersect1d(s, t))
        x, y = ngram_join.parities(s), ngram_join.parities(t)
        size = min(len(x), len(y))
        differ = int(np.bitwise_count(ngram_join.folded(x, size) ^ ngram_join.folded(y, size)).sum())
        assert differ <= len(s) + len(t) - 2 * common
        if common and common >= 0.8 * (len(s) + len(t) - common):
            least, most = ngram_join._may_differ(len(s), len(t), 0.8)
            assert common >= least and len(s) + len(t) - 2 * common <= most
            a, b = order.first(s, 0.8).tolist(), order.first(t, 0.8).tolist()
            first = next(i for i, v in enumerate(a) if v in b)  # the first in common, beyond which links have enough left
            assert min(len(s) - first, len(t) - b.index(a[first])) >= least


def test_one_document_of_a_class_stays_where_nodes_drop_links(spark, monkeypatch):
    """The pipeline's stage: what nodes drop leaves no second document of a class."""
    texts = crowd(seed=10, others=100, pairs=30, copies=330)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    whole = ngram_join.candidates
    monkeypatch.setattr(ngram_join, "candidates", lambda *a: whole(*a).where("pmod(xxhash64(a, b), 10) < 6"))
    kept = sorted(r.doc_id for r in ngram_join.deduplicated(docs).collect())
    assert kept == sorted({least for _, least in plain_classes(plain_links(texts)).values()})


def test_pairs_of_a_crowd_stay_as_compared():
    """A crowd's pairs hold its classes together by links themselves: ends of a chain may be too unlike to be kept as a pair later."""
    chain = [np.arange(k, k + 400, dtype=np.uint64) for k in (0, 40, 80, 120)]  # neighbours have 360 of 440 in common, others 320 of 480 or fewer
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * 4, pa.int64()), pa.array(range(4), pa.int64()), pa.array(range(4), pa.int64()), pa.array([400] * 4, pa.int32()), pa.array([0] * 4, pa.int32()), pa.array([0] * 4, pa.int32()), pa.array([ngram_join.parities(s).tobytes() for s in chain], pa.binary())],
        ["node", "id", "root", "n", "pos", "side", "odd"],
    )
    pairs = {(a, b) for out in ngram_join._rest_pairs(0.8)(iter([batch])) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    assert pairs == {(0, 1), (1, 2), (2, 3)}


def test_chains_of_links_are_one_class(spark):
    """In a chain the class with the least hash beside each may lead away from the middle link."""
    texts = [" ".join(f"c{chain}w{i}" for i in range(k, k + 60)) for chain in range(12) for k in range(0, 30, 5)]
    want = plain_links(texts)
    assert {len(x) for x in want.values()} == {1, 2}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert linked(docs) == plain_classes(want)
    assert ngram_join.deduplicated(docs).count() == 12


def test_hashing_words_remembers_none():
    """A worker's memory does not grow with the words that it has seen."""
    tracemalloc.start()
    ngram_join.shingles("a b c d e f")
    before = tracemalloc.get_traced_memory()[0]
    for k in range(50):
        ngram_join.shingles(" ".join(f"w{i}" for i in range(2000 * k, 2000 * k + 2000)))
    assert tracemalloc.get_traced_memory()[0] - before < 1 << 20
    tracemalloc.stop()


def test_words_are_those_of_split():
    texts = ["", " \t", "A b\x0ba\x0cB\r\n", "é É e e", "x" * 300 + " y " + "X" * 256 + " " + "x" * 257 + " " + "x" * 300, " ".join(f"w{i % 5000}" for i in range(60_000))]
    names = {}
    for t in texts:
        raw = t.encode().lower()
        hashes = ngram_join._word_hashes(raw).tolist()
        assert len(hashes) == len(raw.split())
        assert all(names.setdefault(w, h) == h for w, h in zip(raw.split(), hashes, strict=True))
    assert len(set(names.values())) == len(names)


def test_the_order_knows_what_no_query_has(spark):
    """Shingles of a passage come last without a query that has it, so texts that share it alone do not meet."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"t{k}w{i}" for i in range(60)) + " " + passage for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    order, common = ngram_join.Order([], ngram_join.counted(docs)), ngram_join.shingles(passage)
    assert order.levels.max() > 40 and not any(np.isin(order.first(ngram_join.shingles(t), 0.8), common).any() for t in texts)
    assert not ngram_join.counted(docs.limit(0)).any()
