"""Token counts, the prefix trie and the Merkle manifest against plain versions."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from cognate_spark.llm import merkle, prefix_trie, token_counts
from cognate_spark.llm.common import ascii_lower, ranked
from cognate_spark.llm.queries import tokenizer_path

ALPHABET = " \n\t'aAstremdvl19.,#é中 　\x1c\U0001f600ß"


@pytest.fixture(scope="module")
def library():
    return token_counts.Library(tokenizer_path())


def made_table(library, texts):
    split = token_counts.Splitter(library)
    words = sorted({t[a:b] for t in texts for a, b in split.spans(t)})
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return token_counts.Table.build(points, np.cumsum(sizes) - sizes, np.array(library.counts(words)))


def test_pre_tokens_are_the_library_s(library):
    r, split = random.Random(1), token_counts.Splitter(library)
    for _ in range(4000):
        t = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14)))
        assert split.spans(t) == library.pieces(t), repr(t)


def test_counts_by_table_and_cache(library, monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 200))) + r.choice(["", "", "<|endoftext|>", "<|endoftext"]) for _ in range(200)]
    texts += ["", " ", "'s", "a" * 5000, "\n" * 300, "word " * 2000]
    true = library.counts(texts)
    for table in (None, made_table(library, texts[:0]), made_table(library, texts[:100])):
        assert token_counts.Counter(tokenizer_path(), table)(texts) == true
    table = made_table(library, texts[:100])
    table.points = table.points.copy()
    table.points[:] += 1  # every hit of a hash now fails the comparison of characters
    assert token_counts.Counter(tokenizer_path(), table)(texts) == true
    monkeypatch.setattr(token_counts, "PIECE", 40)
    monkeypatch.setattr(token_counts, "CACHE", 20)
    assert token_counts.Counter(tokenizer_path(), None)(texts) == true


def test_counted_rows(spark, library):
    long = "Many words, and numbers like 12345. " * 30_000
    rows = [(1, "Hello world's end", 5), (1, "Hello world's end", 5), (None, None, None), (3, "", 1), (4, long, 2), (5, "été <|endoftext|> 中文", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    out = token_counts.counted(docs, tokenizer_path(), limit=10).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == sorted((i or 0, len((t or "").encode()), library.counts([t or ""])[0], library.counts([t or ""])[0] > 10) for i, t, _ in rows)
    assert token_counts.counted(docs.limit(0), tokenizer_path()).collect() == []
    few = token_counts.frequent(docs, tokenizer_path(), rows=3)
    assert len(few.counts) == 3 and [r.n_tokens for r in token_counts.counted(docs, tokenizer_path(), table=few).orderBy("doc_id", "text").collect()] == [library.counts([t or ""])[0] for _, t, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_are_asked_whole(spark, name):
    path = tokenizer_path(name)
    texts = ["Hello World", "", "a  b\nc été", "1234"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert token_counts.frequent(docs, path) is None
    assert [r.n_tokens for r in token_counts.counted(docs, path).orderBy("doc_id").collect()] == token_counts.Library(path).counts(texts)


def test_ranks_over_many_ranges(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "b", "é", ""]), r.choice([None, *range(40)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k long, part long").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        out = ranked(df, "g", [F.col("k").asc_nulls_first(), F.col("part").asc()], "at").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [(x.g, x.k, x.part) for x in sorted((x for x in out if x.g == g), key=lambda x: x["at"])] == mine
        assert sorted(x["at"] for x in out if x.g == g) == list(range(len(mine)))


def plain_trie(rows):
    conv, seq, nodes, kids, total = {}, {}, {}, {}, {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            conv.setdefault(c, []).append((t is not None, t or 0, sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], role, text))
    for c in conv:
        conv[c].sort()
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 9
        seq[c] = [x[3:] for x in conv.get(c - c % 5, [])[:h]] + [x[3:] for x in conv[c][h:]]
        for d in range(len(seq[c]) + 1):
            nodes.setdefault(tuple(seq[c][:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        below = kids.get(k, [])
        saved = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        total[k] = (sum(total[x][0] for x in below) or 1, saved + sum(total[x][1] for x in below))
    ends = lambda k, m: sha256(",".join(str(c) for c in sorted(m) if len(seq[c]) == len(k)).encode()).hexdigest()
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), *total[k], ends(k, m)) for k, m in nodes.items()), key=repr)


def talks(n, most, texts, seed):
    r, out = random.Random(seed), []
    for c in range(n):
        for t in range(r.choice([1, 2, 3, r.randint(1, most)])):
            out.append((c if r.random() < 0.99 else None, r.choice([t, None]) if r.random() < 0.1 else t, r.choice(["user", "assistant", None]), r.choice(texts)))
    return out


def test_prefix_trie_against_a_plain_one(spark):
    edge = [(9223372036854775805, 0, "u", "x"), (9223372036854775807, 0, "u", "x"), (-3, 1, "u", "y")]
    deep = [(7, i, "user", "same") for i in range(600)] + [(5, i, "user", "same") for i in range(290)]  # more than two pages of pages
    for rows in (talks(200, 40, ["a", "", None, "bb", "é"], 3) + edge, talks(20, 5, ["x"], 4) + deep):
        df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
        assert sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(df)).collect()), key=repr) == plain_trie(rows)
    assert prefix_trie.trie(prefix_trie.rebuilt(df.limit(0))).collect() == []


def plain_manifest(rows):
    sha = lambda s: sha256(s.encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by, out = {}, []
    for d, s, lang, n, t in rows:
        leaf = sha("".join(map(enc, (d, s, lang, n, t))))
        found = sha("".join(map(enc, (d, s, lang, n, low(t))))) if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else leaf
        by.setdefault(s, []).append((d is not None, d or 0, leaf, found, d))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            run, at = level[i // 16 * 16 :][:16], i % 16
            yield "".join(run[:at]), "".join(run[at + 1 :])
            i //= 16

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for i, (_, _, leaf, found, d) in enumerate(sorted(by[s])):
            way = [*path(trees[s], i), *path(top, k)]
            for left, right in way:
                found = sha(left + found + right)
            out.append((d, leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in way)), found, found == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest_against_a_plain_tree(spark):
    r = random.Random(5)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0

    def proven(rows, levels):
        df = spark.createDataFrame([(*x, "old") for x in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(3)
        return sorted(map(tuple, merkle.proofs(merkle.build(df, {"text": ascii_lower(F.col("text"))}, tampered, levels)).collect()), key=repr)

    for n, sources, levels in ((1, ["a"], 3), (40, ["a", None, "", "é", "z"], 3), (600, ["a"] * 8 + ["b", None], 1), (600, [*map(str, range(30)), *["hot"] * 20], 2)):
        rows = [(r.choice([None, *range(n), i, i]), r.choice(sources), r.choice(["en", None]), i, r.choice([None, "", f"xy é {i}", f"Big {i}"])) for i in range(n)]
        rows += rows[:3]
        assert proven(rows, levels) == plain_manifest(rows)
    assert proven([], 3) == []


def test_a_version_shares_what_it_does_not_copy():
    leaves = [sha256(str(i).encode()).hexdigest().encode() for i in range(700)]
    block = merkle.Block(leaves, None)
    before = [list(x) for x in block.levels]
    changed = sha256(b"changed").hexdigest().encode()
    copies = block.version(333, changed)
    whole = merkle.Block([*leaves[:333], changed, *leaves[334:]], None)
    assert block.levels == before and len(copies) == len(block.levels) == 4
    for level, (old, new) in enumerate(zip(block.levels, whole.levels, strict=True)):
        at = 333 >> 4 * level
        assert copies[level] == new[at] and [x for i, x in enumerate(old) if i != at] == [x for i, x in enumerate(new) if i != at]
