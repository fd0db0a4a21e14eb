"""The registered queries of the operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html_extract, linededup, lm_score, merkle, mixing, ngram_join, prefix_trie, quality, secrets, token_counts, tokenbin
from .common import ascii_lower, table


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")  # of every document; the cascade counts the others where it needs them
    columns = {k: F.col(k) for k in asked}
    order = [x["rule"] for x in quality.plan_cascade(docs, given=asked)]
    judged = quality.cascade(quality.with_features(docs, asked), order=order, given=asked)
    return judged.select("doc_id", *asked, (quality.BASE[0].rejects(columns) | quality.BASE[1].rejects(columns)).alias("base_failed"), "kept")


def op3_prefix_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.LineIndex.build(docs, min_docs=10).drop(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = tokenbin.write_store(docs, tokenizer_path())
    return store.lookup(tokenbin.numbered(docs)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fitted(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("named").alias("spans"), secrets.scores(F.col("spans")).alias("scores"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    made = html_extract.extracted(pages, html_extract.fitted(pages))
    return made.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.formatted(turns.unionByName(extra)))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.counted(docs, tokenizer_path(), limit=512).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.proofs(merkle.build(table(spark, sf_dir, "documents"), {"text": ascii_lower(F.col("text"))}, tampered))


QUERIES = {f.__name__: f for f in (op1_entropy_mix, op2_quality_cascade, op3_prefix_decontam, op4_line_dedup, op5_ngram_join, op6_token_store, op7_secret_formats, op8_html_text, op9_chat_format, op10_context_mixing, op11_token_counts, op12_prefix_trie, op13_merkle_manifest)}

#: Unsigned CRC-32 of a string of ASCII characters, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))))"
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_RUNS = "list_transform(generate_series(0, len(l) - 1, 16), lambda i: sha256(array_to_string(l[i + 1 : i + 16], '')))"
_BESIDE = "array_to_string(l[16 * (i // 16) + 1 : i], '') || '|' || array_to_string(l[i + 2 : 16 * (i // 16) + 16], '')"

ORACLES = {
    "op2_quality_cascade": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS u FROM documents),
w AS (SELECT u, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT u, unnest(generate_series(1, len(w) - 2)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT u, i, count(*) OVER (PARTITION BY u, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (SELECT u, count(*) AS n_repeat_words FROM (SELECT DISTINCT u, i + k AS at FROM g, (VALUES (0), (1), (2)) v(k) WHERE n > 1) GROUP BY u),
f AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals,
             len(regexp_extract_all(text, '[!?]')) AS n_marks FROM w LEFT JOIN c USING (u)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
         OR 12 * n_dup_lines > n_words OR 2 * n_capitals > word_chars OR 4 * n_marks > n_words) AS kept FROM b""",
    "op3_prefix_decontam": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS u, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS s, least(len(w), 10) AS n
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT u, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
hits AS (SELECT u, i, n, item_id FROM (SELECT u, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM p, lens WHERE i + n - 1 <= len(w)) JOIN win USING (s, n)),
covered AS (SELECT u, count(*) AS n_hit FROM (SELECT DISTINCT u, unnest(generate_series(i, i + n - 1)) AS at FROM (SELECT DISTINCT u, i, n FROM hits)) GROUP BY u),
items AS (SELECT u, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY u)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (u) LEFT JOIN items USING (u)""",
    "op4_line_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS u, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT u, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i FROM d),
k AS (SELECT u, i, line, translate(trim(line, E' \t\n\x0B\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM x),
hot AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT u) >= 10),
kept AS (SELECT u, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM k WHERE k NOT IN (SELECT k FROM hot) GROUP BY u)
SELECT doc_id, len(l) AS n_lines, len(l) - coalesce(n, 0) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (u)""",
    "op5_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS u, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT u, hash(array_to_string(w[i : i + 4], ' ')) AS s FROM (SELECT u, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT u, count(*) AS n FROM s GROUP BY u),
c AS (SELECT a.u AS a, b.u AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.u < b.u GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b, c = x.n AND c = y.n AS same FROM c JOIN n x ON a = x.u JOIN n y ON b = y.u WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(u, v) AS (SELECT u, u FROM d UNION SELECT e.b, r.v FROM r JOIN e ON e.a = r.u)
SELECT doc_id, (SELECT min(x.doc_id) FROM r JOIN d x ON x.u = r.v WHERE r.u = d.u) AS class_id,
       least(doc_id, coalesce((SELECT min(x.doc_id) FROM l JOIN d x ON x.u IN (a, b) WHERE same AND d.u IN (a, b)), doc_id)) AS copy_id,
       (SELECT count(*) FROM e WHERE e.a = d.u) AS n_links FROM d""",
    "op9_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS n,
             length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) AS m FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(12 + m + 1 + n + 11)::BIGINT AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op12_prefix_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, max(pos) AS n, {_CRC.format("conv_id::VARCHAR")} % 9 AS h FROM t GROUP BY conv_id),
c AS (SELECT k.conv_id, k.h, k.conv_id - k.conv_id % 5 AS host, least(k.h, coalesce(x.n, 0)) AS taken FROM k LEFT JOIN k x ON x.conv_id = k.conv_id - k.conv_id % 5),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = host AND pos <= h UNION ALL SELECT c.conv_id, pos - h + taken, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
p AS MATERIALIZED (SELECT conv_id, pos AS depth, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS node, strlen(text) AS size FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM k),
e AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
n AS MATERIALIZED (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved FROM p GROUP BY node),
a AS MATERIALIZED (SELECT n.*, p.node AS parent FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
ch AS (SELECT parent AS node, count(*) AS n_children FROM a WHERE parent IS NOT NULL GROUP BY parent),
b AS (SELECT a.*, coalesce(n_children, 0) AS n_children FROM a LEFT JOIN ch USING (node)),
s AS (SELECT p.node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM b JOIN p ON p.conv_id = b.conv_id AND p.depth <= b.depth GROUP BY p.node),
m AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM p JOIN e USING (conv_id, depth) GROUP BY node)
SELECT b.conv_id, b.depth, u.conv_id AS parent_conv_id, b.n_convs, b.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM b JOIN s USING (node) LEFT JOIN m USING (node) LEFT JOIN n u ON u.node = b.parent""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, row_number() OVER () AS u, {" || ".join(_FIELD.format(x) for x in merkle.FIELDS[:4])} AS head, {_FIELD.format("text")} AS body, text FROM documents),
f AS (SELECT doc_id, source, u, sha256(head || body) AS leaf, CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 5 = 0 THEN sha256(head || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) ELSE sha256(head || body) END AS found FROM d),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM f),
t(source, k, l) AS (SELECT source, 0, list(leaf ORDER BY pos) FROM p GROUP BY source UNION ALL SELECT source, k + 1, {_RUNS} FROM t WHERE len(l) > 1),
sub AS MATERIALIZED (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM t WHERE len(l) = 1),
r(k, l) AS (SELECT 0, list(subroot ORDER BY pos) FROM sub UNION ALL SELECT k + 1, {_RUNS} FROM r WHERE len(l) > 1),
way AS (SELECT u, k, {_BESIDE} AS b FROM (SELECT u, k, l, pos // (16 ** k)::BIGINT AS i FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source WHERE len(l) > 1)
        UNION ALL SELECT u, 1000 + k, {_BESIDE} FROM (SELECT u, k, l, sub.pos // (16 ** k)::BIGINT AS i FROM p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source, r WHERE len(l) > 1)),
g AS (SELECT u, list(b ORDER BY k) AS b FROM way GROUP BY u),
o AS (SELECT doc_id, leaf, subroot, (SELECT l[1] FROM r WHERE len(l) = 1) AS root, sha256(replace(array_to_string(coalesce(b, []), ''), '|', '')) AS proof_sha256,
             list_reduce(list_prepend(found, coalesce(b, [])), lambda x, y: sha256(string_split(y, '|')[1] || x || string_split(y, '|')[2])) AS folded_root
      FROM p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source LEFT JOIN g USING (u))
SELECT *, folded_root = root AS verified FROM o""",
}
