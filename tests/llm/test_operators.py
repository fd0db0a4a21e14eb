"""The training-data operators against plain versions, with nulls, empty and long texts, ties, repeats and extra columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cognate_spark.llm import chat, decontam, html_extract, linededup, lm_score, mixing, ngram_join, quality, secrets, tokenbin
from cognate_spark.llm.queries import tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
NAMES = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Texts with copies, near copies, nulls, empties, blanks, a very long one, and repeated rows."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéfghABC1") for _ in range(r.randint(1, 7))) for _ in range(80)]
    texts = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(1, 150))]
        if texts and i % 5 == 0:
            words = (r.choice(texts) or "x").split() or ["x"]
            if len(words) > 3 and i % 10 == 0:
                words[len(words) // 2] = "changed"
        texts.append("".join(w + r.choice((" ", " ", " ", "\n", "  ", "\t")) for w in words))
    texts += [None, "", "  \n ", " ".join(vocab * 200), "one", "a b c", "same line\nother", "SAME LINE \nother"]
    rows = [(i, t, "en", [None, "s1", "s2", "s3"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "no id", None, None, None), (7, "another text of id seven", "en", "s1", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), NAMES).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], NAMES)


def plain_features(t):
    w = WORDS.findall(t or "")
    wins = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if wins[x] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_features_and_cascade(spark, docs):
    found = quality.with_features(docs).collect()
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_features(r.text)
    names = [x.name for x in quality.RULES]
    one = {(r.doc_id, r.text, r.kept) for r in quality.cascade(docs, order=names).collect()}
    assert one == {(r.doc_id, r.text, r.kept) for r in quality.cascade(docs, order=names[::-1]).collect()}
    assert one == {(r.doc_id, r.text, r.kept) for r in quality.cascade(docs).collect()}
    assert not any(k for _, t, k in one if len(WORDS.findall(t or "")) < 50)
    assert quality.cascade(empty(spark)).count() == 0
    clash = docs.withColumn("kept", docs.doc_id).withColumn("n_words", docs.doc_id)
    assert quality.cascade(clash, order=names).count() == docs.count()


def plain_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, hit, found = words(text), set(), set()
    for id_, t in items:
        iw = words(t)
        if id_ is None or not iw:
            continue
        n = min(window, len(iw))
        for win in {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == win:
                    found.add(str(id_))
                    hit.update(range(i, i + n))
    return len(w), len(hit), sorted(found)


def test_the_planned_order_is_greedy_by_rejections_per_cost(spark, docs):
    plan = quality.plan_cascade(docs, sample_rows=10_000)
    seconds = {x["rule"]: x["seconds"] for x in plan}
    hits = {n: {(r.doc_id, r.text) for r in quality.cascade(docs, tuple(x for x in quality.RULES if x.name == n), order=[n]).where("not kept").collect()} for n in seconds}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    left, gone = set(seconds), set()
    for step in plan:
        still = [x for x in rows if x not in gone]
        share = {n: sum(x in hits[n] for x in still) / max(len(still), 1) for n in left}
        assert step["rejects"] == pytest.approx(share[step["rule"]]) and share[step["rule"]] / seconds[step["rule"]] == pytest.approx(max(share[n] / seconds[n] for n in left))
        left.remove(step["rule"])
        gone |= hits[step["rule"]]


def test_decontamination(spark, docs):
    texts = [r.text for r in docs.collect() if r.text and len(r.text.split()) > 30]
    items = [(1, " ".join(texts[0].split()[5:25]).upper()), (2, " ".join(texts[1].split()[:12])), (10, "one"), (11, "a B"), (3, None), (4, ""), (None, texts[2]), (5, "never seen words of no text at all in here"), (2, texts[3][:200])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated(docs, bench).collect()
    assert len(found) == docs.count()
    want = collections.Counter((r.doc_id, *map(str, plain_hits(r.text, items))) for r in docs.collect())
    assert want == collections.Counter((r.doc_id, str(r.n_words), str(r.n_hit), str(r["items"])) for r in found)
    odd = docs.withColumn("d", docs.doc_id).withColumn("Print", docs.doc_id).withColumn("own", docs.doc_id)
    assert decontam.clean(odd, bench).columns == odd.columns
    assert decontam.contaminated(odd, bench, keep=("d", "own")).columns == ["doc_id", "d", "own", "n_words", "n_hit", "items"]
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns
    assert {(r.doc_id, r.text) for r in clean.collect()} == {(r.doc_id, r.text) for r in docs.collect() if not plain_hits(r.text, items)[1]}
    assert decontam.contaminated(empty(spark), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_without_broadcasts(spark, monkeypatch):
    r = random.Random(6)
    long = [r.choice("abcdefghij") + r.choice("klmnop") for _ in range(250_000)]
    rows = [("x", " ".join(long)), ("y", " ".join(long[:300])), ("y", " ".join(long[:300])), (None, None), ("z", "nothing here")]
    items = [(1, " ".join(long[200:240])), (2, " ".join(long[-25:])), (3, "nothing here")]
    docs, bench = spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d or "", *map(str, plain_hits(t if d != "x" else " ".join([*long[150:300], "|", *long[-60:]]), items))) for d, t in rows)
    want = [(d, "250000" if d == "x" else n, h, i) for d, n, h, i in want]
    got = lambda: sorted((x.doc_id or "", str(x.n_words), str(x.n_hit), str(x["items"])) for x in decontam.contaminated(docs, bench).collect())
    assert got() == want
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_KEYS", 0)
    assert got() == want


def plain_targets(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full, out = sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            full.add(s)
            out[s] = cap * sizes[s]
            left -= out[s]


def test_a_bit_map_keeps_shingles_from_the_shuffle(spark, monkeypatch):
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(30)]
    rows = [(i, " ".join([word() for _ in range(300)] + (items[i % 30][1].split()[3:20] if i % 10 == 0 else []))) for i in range(200)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((x.doc_id, x.n_hit) for x in decontam.contaminated(docs, bench).collect())
    passed = []
    through = decontam.may_be_in
    monkeypatch.setattr(decontam, "may_be_in", lambda df, *a: passed.append((df.count(), (out := through(df, *a)).count())) or out)
    monkeypatch.setattr(decontam, "BROADCAST_KEYS", 0)
    assert sorted((x.doc_id, x.n_hit) for x in decontam.contaminated(docs, bench).collect()) == want
    (all_, few), = passed
    assert all_ > 200 * 298 and few < 200 + 20 * 40 and sum(n > 0 for _, n in want) == 20  # a row a document, and shingles of windows


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.choice((0, 1, 5, 40, 41, 300))), None, r.choice((None, "a", "b", "c", "a", "a", "a")), 0) for i in range(600)] + [(600 + i, "w " * 7, None, "hot", 0) for i in range(900)] + [(None, None, None, "tiny", 0), (5, "w w", None, "tiny", 0)]
    docs = spark.createDataFrame(rows, NAMES).repartition(4)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    taken, largest = collections.Counter(), collections.Counter()
    for x in found:
        assert 0 <= x.taken <= 3 * x.size and x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 * largest[s] + 1e-3 * want[s] + 1, s
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.size, x.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mixed(docs).count() == sum(x.copies for x in found)
    odd = docs.withColumnRenamed("lang", "size").withColumn("Rate", docs.doc_id).withColumn("own_print", docs.doc_id).withColumn("copies", docs.doc_id)
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() == mixing.mixed(docs).count()


def plain_lines(rows, min_docs):
    keys = lambda t: [low(x).strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")]
    n = collections.Counter(k for t in rows for k in set(keys(t)))
    return ["\n".join(x for x, k in zip((t or "").split("\n"), keys(t), strict=True) if not k or n[k] < min_docs) for t in rows]


def test_line_dedup_both_ways_and_undoing(spark, docs):
    rows = docs.collect()
    want = collections.Counter(zip([r.text for r in rows], plain_lines([r.text for r in rows], 2), strict=True))
    index = linededup.LineIndex.build(docs, min_docs=2)
    odd = docs.withColumn("at", docs.doc_id).withColumn("line_uid", docs.doc_id).withColumn("Line_Gone", docs.doc_id)
    for limits in ((1 << 20,), (0,), (0, 0)):  # exact keys at hand, filters alone, a join of all lines
        assert want == collections.Counter((r.text, r.kept_text) for r in index.drop(docs, *limits).collect())
        out = index.drop(odd, *limits)
        assert out.columns == [*odd.columns, "n_lines", "n_dropped", "kept_text"] and out.count() == odd.count()
    a, b = docs.where("doc_id % 3 = 0"), docs.where("coalesce(doc_id % 3, 1) != 0")
    grown = linededup.LineIndex.build(a, 2).insert(b)
    assert sorted(grown.counts.collect()) == sorted(index.counts.collect())
    assert want == collections.Counter((r.text, r.kept_text) for r in grown.drop(docs).collect())
    undone = grown.delete(b)
    assert sorted(undone.counts.collect()) == sorted(linededup.LineIndex.build(a, 2).counts.collect())
    assert sorted(r.kept_text for r in undone.drop(a).collect()) == sorted(plain_lines([r.text for r in a.collect()], 2))
    assert linededup.LineIndex.build(empty(spark)).drop(empty(spark)).count() == 0


def test_line_dedup_beyond_the_broadcast_limits(spark):
    """Rows whose numbers depend on how they were dealt out: both sides of the join have to see the same ones."""
    r = random.Random(21)
    hot = [f"shared line {i}" for i in range(30)]
    rows = [(i, "\n".join(r.choice(hot) if r.random() < 0.5 else f"own {i} {k}" for k in range(12))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).orderBy(F.rand(3)).repartition(5)
    index = linededup.LineIndex.build(docs, min_docs=10)
    want = {x.doc_id: x.kept_text for x in index.drop(docs).collect()}
    assert all("shared" not in t for t in want.values()) and any(want.values())
    for how in ({"broadcast_keys": 0}, {"broadcast_keys": 0, "filter_keys": 0}, {"filter_keys": 0}):
        assert {x.doc_id: x.kept_text for x in index.drop(docs, **how).collect()} == want
    with pytest.raises(ValueError, match="inserted"):
        index.delete(spark.createDataFrame([(1, "a line that is not there")], "doc_id long, text string"))


def test_cuckoo_filter():
    r = np.random.default_rng(1)
    h1, h2 = r.integers(-(2**63), 2**63 - 1, 5000), r.integers(-(2**63), 2**63 - 1, 5000)
    f = linededup.CuckooFilter.sized(5000)
    assert f.insert(h1, h2) and f.contains(h1, h2).all()
    f.delete(h1[:2500], h2[:2500])
    assert f.contains(h1[2500:], h2[2500:]).all() and f.contains(h1[:2500], h2[:2500]).mean() < 0.01


def plain_sets(t, size=5):
    w = low(t).split()
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_ngram_join(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [plain_sets(t) for _, t in rows]
    links = {i: [j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))}
    found = ngram_join.join(docs).collect()
    assert collections.Counter((d, len(links[i])) for i, (d, _) in enumerate(rows)) == collections.Counter((r.doc_id, r.n_links) for r in found)
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    seen, parts = set(), 0
    for i in range(len(rows)):
        if i not in seen:
            parts, todo = parts + 1, [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x), todo.extend(links[x])
    assert kept.count() == parts
    assert ngram_join.join(empty(spark)).count() == 0


def test_token_store(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    store = tokenbin.write_store(docs, tokenizer_path(), shard_bytes=500)
    keys = tokenbin.numbered(docs)
    found = sorted(store.lookup(keys).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    at = 0
    assert len(found) == len(want)
    for r, (has, id_, text) in zip(found, want, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens) == (id_ if has else None, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    foreign = spark.createDataFrame([(10**9 + i, 0) for i in range(50)], "doc_id long, k long")
    assert store.lookup(foreign).count() == 0
    assert tokenbin.write_store(empty(spark), tokenizer_path()).lookup(keys).count() == 0


def test_token_store_keeps_large_ids_beside_nulls(spark):
    ids = [2**60, 2**60 + 1, None, None, 2**63 - 1, 2**63 - 2, -(2**63), -(2**63) + 1, 2**53 + 1, 2**53, 0, 0]
    docs = spark.createDataFrame([(x, f"text number {i}") for i, x in enumerate(ids)], "doc_id long, text string").repartition(3)
    store = tokenbin.write_store(docs, tokenizer_path())
    found = store.lookup(tokenbin.numbered(docs)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in found) == sorted((x is not None, x or 0) for x in ids)
    by_start = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert by_start == sorted(ids, key=lambda x: (x is not None, x or 0))
    foreign = spark.createDataFrame([(2**60 + 2, 0), (2**53 + 2, 0), (None, 2), (1, 0)], "doc_id long, k long")
    assert store.lookup(foreign).collect() == []
    small = spark.createDataFrame([(1, "a"), (None, "b")], "doc_id short, text string")
    assert {r.doc_id for r in tokenbin.write_store(small, tokenizer_path()).lookup(tokenbin.numbered(small)).collect()} == {1, None}


def test_equal_keys_end_with_an_error():
    rows = tokenbin.pd.DataFrame({"index_shard": [0, 0], "id": [5, 5], "no_id": [False, False], "k": [0, 0], "part": 0, "shard": 0, "offset": 0, "n": 1})
    with pytest.raises(ValueError, match="equal"):
        tokenbin._index(rows)


def test_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    t, e, r = Tokenizer.from_file(tokenizer_path()), tokenbin.Encoder(tokenizer_path()), random.Random(2)
    bits = ["a", "be", " ", " ", "\n", "\t", "é", "'s", "12", ".", "<|endoftext|>", "\0", "\x02", "　", "漢"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(5000)]
    assert all(np.frombuffer(x, "<u2").tolist() == t.encode(y, add_special_tokens=False).ids for x, y in zip(e(texts), texts, strict=True))


def test_secrets(spark):
    hex_, key = "0123456789abcdef" * 2, "AKIA" + "ABCDEFGH23456QRS"
    texts = [f"my Password = '{hex_}' and {key}.", "api_key: short", "token=abc;secret:abcdef", None, "", "x" * 100_000 + f" {key}", "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9aB3dE5gH7" + " plain words of 2020", "AKIASHORT " + "f" * 24]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(docs, secrets.fitted(docs)).collect()}
    assert [(got[i].n_assign, got[i].n_access, got[i].n_hex) for i in range(8)] == [(1, 1, 1), (0, 0, 0), (1, 0, 0), (0, 0, 0), (0, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 1)]
    assert got[2].named == "assign:10:23" and got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[6].named == "format:0:40"
    model = secrets.Scanner(secrets.examples(), ["the", "word", "2020-11-12"])
    fresh = [(k, x) for k, v in secrets.examples(20, seed=77).items() for x in v]
    assert sum(model.score(x) >= (secrets.THRESHOLD, "") and model.score(x)[1] == k for k, x in fresh) > 0.9 * len(fresh)


def test_base_secrets_against_plain_patterns(spark):
    r = random.Random(8)
    bits = ["password", "Token", "api_key", "apikey", "SECRET", '"', "'", ":", "=", " ", "  ", "AKIA", "ABCDEFGH23456QRS", "0123456789abcdef", "fedcba98", "abc/+._-", "xyz", "\n", "é"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(400)] + [None, ""]
    found = secrets.scan(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string"), secrets.Scanner(secrets.examples(), ["word"])).collect()
    for x in found:
        t, spans = texts[int(x.doc_id)] or "", []
        spans += [(m.start(), m.end(), 0) for m in re.finditer(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        spans += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[0], s[2]))
        assert x.base_sha256 == hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == i for _, _, k in spans) for i in range(3))
        assert all(math.isfinite(s.score) for s in x.spans)


def test_planted_formats_are_found_in_a_table(spark):
    """Credentials that no label has, alone or glued, in prose; their spans carry scores, and prose has none."""
    r = random.Random(12)
    prose = "the river house under morning light walked many people 2020 city v1.2 small garden question/answer file_name.txt x86 a1b2".split()
    rows, planted = [], {}
    for i, (kind, value) in enumerate((k, v) for k, values in secrets.examples(25, seed=4321).items() for v in values if k != "aws_access"):
        head = r.choice(["", "KEY=", "https://example.org/", "("])
        words = [r.choice(prose) for _ in range(40)]
        at = r.randrange(40)
        text = " ".join([*words[:at], head + value, *words[at:]])
        start = len(" ".join(words[:at])) + (at > 0) + len(head)
        planted[2 * i] = (kind, start, start + len(value))
        rows += [(2 * i, text), (2 * i + 1, " ".join(r.choice(prose) for _ in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.scan(docs, secrets.fitted(docs)).withColumn("scores", secrets.scores(F.col("spans"))).collect()
    spans = {x.doc_id: {(s.start, s.end): s.score for s in x.spans} for x in found}
    hits = sum((a, b) in spans[i] for i, (_, a, b) in planted.items())
    assert hits >= 0.95 * len(planted), (hits, len(planted))
    assert all(v >= secrets.THRESHOLD for i in planted for v in spans[i].values()) and not any(spans[i] for i in spans if i % 2)
    assert all([abs(float(y) - s.score) < 0.051 for y, s in zip(x.scores.split(","), x.spans, strict=True)] == [True] * len(x.spans) for x in found if x.spans)


def test_many_spans_take_linear_time():
    model = secrets.Scanner(secrets.examples(), ["word"])
    took = []
    for n in (2_000, 16_000):
        text = " ".join(f"{i:024x}" if i % 2 else f"token=abc{i:05d} x1y{i:07d}" for i in range(n))
        began = time.process_time()
        base, _ = model.spans(text)
        took.append(time.process_time() - began)
        assert len(base) == n
    assert took[1] < 24 * max(took[0], 0.05), took


def test_secrets_glued():
    ordinary = "the word 2020-11-12 https://example.org/path/to/page.html STRIPE_KEY GH src/main/version-1.2.3 file_name_20201112.tar.gz".split()
    model = secrets.Scanner(secrets.examples(), ordinary)
    for kind, values in secrets.examples(8, seed=78).items():
        if kind != "aws_access":  # a base pattern
            for x in (x for x in values if model.score(x)[0] >= secrets.THRESHOLD):  # what is found alone
                for head, tail in (("", ""), ("STRIPE_KEY=", ""), ("GH=", " and more"), ("https://example.org/path/", ""), ("AKIA" + "ABCDEFGH23456QRS/", ""), ("see x1", ".")):
                    text = "words " + head + x + tail
                    start, found = 6 + len(head), model.spans(text)[1]
                    if head == "see x1":  # no separator: what it is glued to may come with it
                        assert any(start - 2 <= a <= start and b == start + len(x) for a, b, _ in found), (kind, text)
                    else:
                        assert (start, start + len(x), 3) in found, (kind, text)
    two = [v[0] for k, v in secrets.examples(1, seed=79).items() if k in ("github", "stripe")]
    assert [b - a for a, b, _ in model.spans("/".join(two))[1]] == [len(x) for x in two]
    assert not any(model.spans(x)[1] for x in ordinary)


def test_html(labeller):
    page = "<html><head><title>T</title><script>var a='</p>'</script></head><body><nav><a href=x>Menu</a></nav><article><h1>Head &amp; line</h1><p>One<br>two \n three<p>Four <b>five</b></article><!-- no --><footer>&copy; me</footer></body>"
    assert [b.text for b in html_extract.blocks(page)] == ["T", "Menu", "Head & line", "One two three", "Four five", "© me"]
    said = ["Over the river and through the wood, they went.", "Nobody &lt;knows&gt; where the road ends. It is long.", "In the end, everything was as it had been before the storm."]
    whole = "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Menu</a></li><li><a href=y>More</a></li></ul></nav><article><h1>News of the day</h1>" + "".join(f"<p>{x}</p>" for x in said) + "</article><div class='comments'><p>Nice post, thanks a lot!</p></div><footer>&copy; me</footer></body></html>"
    assert html_extract.main_texts(["", whole], labeller) == ["", "\n\n".join(["News of the day", said[0], said[1].replace("&lt;", "<").replace("&gt;", ">"), said[2]])]


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, "v", ""), (3, "w", "<article><p>Text of the page.</p></article>")], "page_id long, url string, html string")
    out = html_extract.extracted(pages, html_extract.fitted(pages, invented_pages=60)).collect()
    assert [r.main_text for r in out[:2]] == ["", ""] and len(out) == 3


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "a<\\|b <| c"), (1, 1, "assistant", "tie"), (2, 0, "sys\ntem\\", "x" * 50_000), (2, None, "user", None), (None, 0, None, "é"), (None, 1, "assistant", "漢字")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.formatted(turns).collect()
    assert len(made) == 3
    for m in made:
        mine = sorted((r for r in rows if r[0] == m.conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert chat.parsed(m.formatted) == [(r[2] or "", r[3] or "") for r in mine]
        assert [chat.unescaped(m.formatted[s.begin : s.end]) for s in m.loss_spans] == [r[3] or "" for r in mine if r[2] == "assistant"]
    assert chat.digests(chat.formatted(turns.limit(0))).count() == 0
    named = turns.selectExpr("'c' || conv_id as conv_id", "turn", "role", "text")
    assert sorted(r.formatted for r in chat.formatted(named).collect()) == sorted(m.formatted for m in made)
    many = spark.range(25_000).selectExpr("id div 3 as conv_id", "id as turn", "'user' as role", "string(id) as text").coalesce(1)
    assert chat.digests(chat.formatted(many)).agg({"n_turns": "sum"}).first()[0] == 25_000


def test_language_model(spark, docs):
    rows = docs.collect()
    tok = [WORDS.findall(low(r.text)) + [""] for r in rows]
    out = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2 for r in rows]
    c = collections.Counter(w for t, o in zip(tok, out, strict=True) if not o for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((r.doc_id or -1, len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t in zip(rows, tok, strict=True))
    for common in (20, 10_000):
        got = lm_score.scored(docs, common_words=common).collect()
        assert want == sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
        assert all(r.train_tokens == n and r.score < 0 and r.bits_per_byte < 8 for r in got)
    texts = [lm_score.canonical(r.text or "") for r in rows]
    plain = [sum((t[k - o] if k >= o else 0) << 8 * o for o in range(5)) for t in texts for k in range(len(t))]
    assert lm_score._windows_of(texts).tolist() == plain
    assert lm_score.scored(empty(spark)).count() == 0


def test_probabilities_of_the_scorer_sum_to_one(spark):
    r = random.Random(9)
    rows = [(i, "".join(r.choice("ab cd") for _ in range(60))) for i in range(60)]
    near, mixer = lm_score.train(lm_score.counted_windows(spark.createDataFrame(rows, "doc_id long, text string")))
    before = sum(b << 8 * (k + 1) for k, b in enumerate(b"a bc"))
    code = np.arange(256, dtype=np.uint64) | np.uint64(before)  # every byte after one context
    n = np.array([float(sum(lm_score.canonical(t).count(b"cb a" + bytes([c])) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2)) for c in range(256)])
    total = np.ones(256)
    for j, node, bit, zeros, ones in lm_score.exact(code, n, near):
        p = mixer.predict(*lm_score.log_odds(zeros, ones, bit, 0.0), j, node)[1]
        total *= np.where(bit == 1, p, 1 - p)
    assert total.sum() == pytest.approx(1)


def test_language_model_counts_and_learns_from_all_texts(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789 é漢") for _ in range(150)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    raw = [lm_score.canonical(t) for t in texts]
    training = [t for i, t in enumerate(raw) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter()
    for t in training:
        for k, byte in enumerate(t):
            for o in range(5):
                before = (bytes(4) + t[:k])[len(t[:k]) + 4 - o :]
                counts.update((before, (byte | 256) >> (8 - j), byte >> (7 - j) & 1) for j in range(8))
    _, mixer = lm_score.train(lm_score.counted_windows(docs))
    assert mixer.seen == sum(map(len, training))  # weights and map: every training text
    want = {}
    for i in range(0, 300, 30):
        want[i] = 0.0
        for k, byte in enumerate(raw[i]):
            for j in range(8):
                node, bit = np.array([(byte | 256) >> (8 - j)]), np.array([byte >> (7 - j) & 1])
                a, b = (np.array([[float(counts[(bytes(4) + raw[i][:k])[k + 4 - o :], int(node[0]), v]) for o in range(5)]]) for v in (0, 1))
                p = mixer.predict(*lm_score.log_odds(a, b, bit, 0.0), j, node)[1][0]
                want[i] += math.log10(p if bit[0] else 1 - p)
    for common in (0, 2000, 1 << 20):  # all, some and no windows by the join
        got = {x.doc_id: x.score for x in lm_score.scored(docs, common_windows=common).collect()}
        assert all(got[i] == pytest.approx(w, rel=1e-9) for i, w in want.items())
