"""The pipeline and its registration."""

import collections
import zlib

import numpy as np

import corpus_pipeline
from cognate_spark.llm import mixing, ngram_join, quality
from cognate_spark.llm.queries import ORACLES, QUERIES, tokenizer_path

from .test_operators import NAMES, corpus, plain_hits, plain_sets


def test_every_operator_is_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline_against_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [r for r in corpus(seed=9, n=90)]
    items = [(1, " ".join((rows[8][1] or "").split()[3:30])), (2, "words that no document has at all")]
    spark.createDataFrame(rows, NAMES).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = [(r.doc_id, r.text, r.source) for r in quality.cascade(docs, order=[x.name for x in quality.RULES]).where("kept").collect()]
    order = sorted(left, key=lambda r: (r[0], ))
    sets, gone, kept = [plain_sets(t) for _, t, _ in order], set(), []
    for i in range(len(order)):
        if i not in gone:
            kept.append(order[i])
            todo = [i]
            while todo:
                x = todo.pop()
                for j in range(len(order)):
                    if j not in gone and j != i and len(sets[x] & sets[j]) >= 0.8 * len(sets[x] | sets[j]):
                        gone.add(j), todo.append(j)
    clean = [r for r in kept if not plain_hits(r[1], items)[1]]
    assert 0 < len(clean) < len(left)
    mixed = mixing.mix(spark.createDataFrame([(d, t, s) for d, t, s in clean], "doc_id long, text string, source string")).collect()
    copies = {(r.doc_id): r.copies for r in mixed}
    t, at = Tokenizer.from_file(tokenizer_path()), 0
    want = []
    for d, text, _ in sorted(clean):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        for k in range(copies[d]):
            want.append((d, k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    assert collections.Counter((r.doc_id, r.k, r.start, r.n_tokens, r.ids_crc32) for r in found) == collections.Counter(want)
    assert ngram_join.deduplicated(docs.limit(0)).count() == 0
