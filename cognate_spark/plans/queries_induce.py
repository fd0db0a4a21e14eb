"""Queries of meaning elements and induced tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import induce as I
from ..operators import mels as M
from ..shared import numbered
from . import testbed as B
from .queries_text import LEXICAL
from .registry import query


def _shown(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.array_join("glosses", "|").alias("glosses"))


@query("""WITH r AS (SELECT unnest(string_split(p_size || ',' || p_brand || ', ' || p_partkey % 7, ',')) AS t, replace(p_name, ' ', '/ *') || '/' || p_name AS g FROM part), t AS (SELECT try_cast(trim(t) AS INT) AS t, unnest([string_split(g, '/')[3], string_split(string_split(g, '/')[3], ' ')[1], string_split(string_split(g, '/')[3], ' ')[2]]) AS g FROM r)
SELECT t::VARCHAR AS mel_id, string_agg(DISTINCT g, '|' ORDER BY g) AS glosses FROM t WHERE t IS NOT NULL GROUP BY t""")
def mels_from_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.read(spark, sf_dir, "part").select(F.concat(F.col("p_size").cast("string"), F.lit(","), F.col("p_brand"), F.lit(", "), (F.col("p_partkey") % 7).cast("string")).alias("analysis"), F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("/ *")), F.lit("/"), F.col("p_name")).alias("gloss"))
    return _shown(M.mels_from_tags(rows), "mel_id")


#: Concept pairs: names of parts of one order; families, languages and words are orders, suppliers and lines.
_EDGES = "e AS MATERIALIZED (SELECT a.p_name AS a, b.p_name AS b, count(DISTINCT x.l_orderkey) AS families, count(DISTINCT x.l_suppkey) AS languages, count(*) AS words FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber + 1 = y.l_linenumber JOIN part a ON a.p_partkey = x.l_partkey JOIN part b ON b.p_partkey = y.l_partkey WHERE a.p_name < b.p_name GROUP BY ALL)"


def _colex(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line, part = B.read(spark, sf_dir, "lineitem"), B.read(spark, sf_dir, "part").select("p_partkey", "p_name")
    x = line.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey").withColumnRenamed("p_name", "a")
    y = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey").select("l_orderkey", "l_linenumber", F.col("p_name").alias("b"))
    pairs = x.join(y, ["l_orderkey", "l_linenumber"]).where("a < b")
    edges = pairs.groupBy("a", "b").agg(F.count_distinct("l_orderkey").alias("families"), F.count_distinct("l_suppkey").alias("languages"), F.count("*").alias("words"))
    known = part.select(F.col("p_name").alias("gloss")).where("gloss not like 'red%'")
    return edges, known


_COLEX = "WITH " + _EDGES + """, k AS (SELECT DISTINCT p_name AS g FROM part WHERE p_name NOT LIKE 'red%'), p AS (SELECT * FROM e WHERE a IN (SELECT g FROM k) AND b IN (SELECT g FROM k)),
gr AS (SELECT a AS gloss, a || '|' || string_agg(b, '|' ORDER BY families DESC, languages DESC, words DESC, b) AS glosses FROM p GROUP BY a
  UNION ALL SELECT g, g FROM k WHERE g IN (SELECT a FROM e UNION SELECT b FROM e) AND g NOT IN (SELECT a FROM p UNION SELECT b FROM p))"""


@query(_COLEX + " SELECT gloss, glosses FROM gr")
def mels_from_colexification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(M.mels_from_colexification(*_colex(spark, sf_dir)), "gloss")


@query(_COLEX + ", f AS (SELECT DISTINCT unnest(string_split(glosses, '|')) AS g FROM gr) SELECT 'nf' || row_number() OVER (ORDER BY p_name) + (SELECT count(*) FROM gr) AS mel_id, p_name AS glosses FROM (SELECT DISTINCT p_name FROM part) WHERE p_name NOT IN (SELECT g FROM f)")
def mels_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = B.read(spark, sf_dir, "part").select(F.col("p_name").alias("gloss"))
    return _shown(M.mels_not_found(every, M.mels_from_colexification(*_colex(spark, sf_dir))), "mel_id")


#: Synsets: brand (en lemmas are first words of names, hyphenated names and whole names with underscores) and type (fr lemmas are last words).
_LEMMAS = """w AS (SELECT *, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part),
l AS (SELECT DISTINCT p_brand AS synset, 'en' AS lang, a AS lemma FROM w UNION SELECT p_brand, 'en', a || '_' || b FROM w UNION SELECT p_brand, 'en', b || a FROM w WHERE p_size % 2 = 0
  UNION SELECT p_type, 'fr', b FROM w UNION SELECT p_type, 'fr', a FROM w WHERE length(a) > 3)"""
#: Glosses: words, names as they are, with particles and asides, and hyphenated the other way round.
_RAW = "UNION ALL ".join(f"SELECT {x} AS gloss FROM w " for x in ("a", "b", "p_name", "'to ' || a || ' (' || b || ')'", "b || '-' || a", "'*' || a || '/' || b || ', ' || p_name"))


def _lemmas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = B.read(spark, sf_dir, "part").withColumns({"a": F.split("p_name", " ")[0], "b": F.split("p_name", " ")[1]})
    row = lambda df, synset, lang, lemma: df.select(F.col(synset).alias("synset"), F.lit(lang).alias("lang"), lemma.alias("lemma"))
    a, b = F.col("a"), F.col("b")
    lemmas = row(w, "p_brand", "en", a).unionByName(row(w, "p_brand", "en", F.concat_ws("_", "a", "b"))).unionByName(row(w.where("p_size % 2 = 0"), "p_brand", "en", F.concat("b", "a")))
    lemmas = lemmas.unionByName(row(w, "p_type", "fr", b)).unionByName(row(w.where("length(a) > 3"), "p_type", "fr", a)).distinct()
    made = F.array(a, b, F.col("p_name"), F.concat(F.lit("to "), a, F.lit(" ("), b, F.lit(")")), F.concat_ws("-", "b", "a"), F.concat(F.lit("*"), a, F.lit("/"), b, F.lit(", "), F.col("p_name")))
    return w.select(F.explode(made).alias("gloss")).distinct(), lemmas


@query("WITH " + _LEMMAS + ", g AS (SELECT DISTINCT gloss FROM (" + _RAW + """)), s AS (SELECT gloss, unnest(string_split(trim(gloss), '/')) AS y FROM g), t AS (SELECT gloss, unnest(string_split(y, ', ')) AS x0 FROM s), u AS (SELECT gloss, trim(x0) AS x FROM t),
n0 AS (SELECT gloss, """ + LEXICAL + """ AS n FROM u), n AS MATERIALIZED (SELECT gloss, n FROM n0 UNION SELECT gloss, replace(n, '-', '') FROM n0),
h AS (SELECT gloss, synset, lang FROM n JOIN l ON lemma = n), f AS (SELECT * FROM h WHERE lang = 'en' UNION SELECT * FROM h WHERE lang = 'fr' AND gloss NOT IN (SELECT gloss FROM h WHERE lang = 'en')),
o AS (SELECT DISTINCT synset, gloss AS other FROM l JOIN n ON n = lemma)
SELECT f.gloss, lang AS found_in, string_agg(DISTINCT other, '|' ORDER BY other) AS glosses FROM f JOIN o USING (synset) GROUP BY ALL""")
def mels_from_synsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(M.mels_from_synsets(*_lemmas(spark, sf_dir)), "gloss", "found_in")


@query("WITH " + _LEMMAS + ", g AS (SELECT DISTINCT gloss FROM (" + _RAW + ")) SELECT gloss, CASE count(DISTINCT lang) WHEN 0 THEN NULL WHEN 1 THEN min(lang) ELSE 'xx' END AS tag FROM g LEFT JOIN l ON lemma = gloss GROUP BY gloss")
def gloss_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gloss_language(*_lemmas(spark, sf_dir))


@query("SELECT l_orderkey AS mel_id, (SELECT string_agg(g, '|' ORDER BY g) FROM (SELECT DISTINCT unnest(gs) AS g)) AS glosses FROM (SELECT l_orderkey, list(p_name) || list(p_type) AS gs FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)")
def mels_from_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.read(spark, sf_dir, "lineitem").join(B.read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("set_id"), F.col("p_type").alias("proto_gloss"), F.col("p_name").alias("gloss"))
    return _shown(M.mels_from_sets(rows), "mel_id")


@query("WITH a AS (SELECT string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS g, count(DISTINCT p_name) AS n FROM part GROUP BY p_brand UNION SELECT string_agg(DISTINCT p_name, '|' ORDER BY p_name), count(DISTINCT p_name) FROM part GROUP BY p_brand, p_size) SELECT g AS glosses, count(*) AS n FROM a WHERE n > 1 GROUP BY g")
def distinct_mels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.read(spark, sf_dir, "part")
    one = lambda *k: p.groupBy(*k).agg(F.collect_list("p_name").alias("glosses"))
    return _shown(M.distinct_mels(one("p_brand"), one("p_brand", "p_size")), "mel_id").groupBy("glosses").agg(F.count("*").alias("n"))


# Aligned words: row k has the k-th word of each language.

_CANON = "([^aeiou]*)([aeiou]+)([^aeiou]*)([a-z]*)"
_ALIGNED = "al AS (SELECT language, row_number() OVER (PARTITION BY language ORDER BY form_id::BIGINT, glyphs) AS row_id, glyphs AS word FROM forms)"
_PARTS = _ALIGNED + ", sy AS (SELECT language, row_id, word, unnest(['onset', 'vowel', 'coda', 'rest']) AS slot, unnest(CASE WHEN regexp_matches(word, '^(?:" + _CANON + ")') THEN [regexp_extract(word, '^(?:" + _CANON + ")', 1), regexp_extract(word, '^(?:" + _CANON + ")', 2), regexp_extract(word, '^(?:" + _CANON + ")', 3), CASE WHEN regexp_extract(word, '^(?:" + _CANON + ")', 4) = '' THEN '0' ELSE regexp_extract(word, '^(?:" + _CANON + ")', 4) END] ELSE ['', '', '', ''] END) AS constituent FROM al)"
_ROWS = _PARTS + ", rw AS (SELECT row_id, slot, " + ", ".join(f"max(constituent) FILTER (language = '{x}') AS {x}" for x in B.LANGUAGES) + " FROM sy GROUP BY ALL)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = numbered(B.forms(spark, sf_dir), [F.col("form_id").cast("long"), "glyphs"], "row_id", within=("language",))
    return placed.select("language", "row_id", F.col("glyphs").alias("word"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.split_syllables(_words(spark, sf_dir), _CANON, ["onset", "vowel", "coda", "rest"], zero_last=True)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.correspondence_rows(_parts(spark, sf_dir), B.LANGUAGES)


@query("WITH " + B.FORMS + ", " + _PARTS + " SELECT * FROM sy")
def split_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)


#: A syllable with a nasal or liquid as final; other last consonants are read as suffixes first.
_FINALS = "^(?:([^aeiou]*)([aeiou]+)([mnrl]?)([^aeiou]*))"
_MOVED = f"""mv AS (SELECT language, row_id, word, CASE WHEN regexp_matches(word, '{_FINALS}') THEN [regexp_extract(word, '{_FINALS}', 1), regexp_extract(word, '{_FINALS}', 2), regexp_extract(word, '{_FINALS}', 3), coalesce(nullif(regexp_extract(word, '{_FINALS}', 4), ''), '0')] ELSE ['', '', '', ''] END AS c FROM al),
mw AS (SELECT language, row_id, word, CASE WHEN c[3] = '' AND c[4] NOT IN ('', '0') THEN [c[1], c[2], c[4], '0'] ELSE c END AS c FROM mv)"""


@query("WITH " + B.FORMS + ", " + _ALIGNED + ", " + _MOVED + " SELECT language, row_id, word, unnest(['initial', 'vowel', 'final', 'suffix']) AS slot, unnest(c) AS constituent FROM mw")
def split_syllables_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finals that were read as suffixes are moved to their slot."""
    return I.split_syllables(_words(spark, sf_dir), _FINALS[4:-1], ["initial", "vowel", "final", "suffix"], zero_last=True, move_last=True)


@query("WITH " + B.FORMS + ", " + _ROWS + " SELECT * FROM rw")
def correspondence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir)


@query()
def merge_correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_correspondences(_rows(spark, sf_dir), B.LANGUAGES)


_FIRST = "list_filter([en, fr, de, es], lambda x: x IS NOT NULL AND x <> '')"
_MAJOR = _ROWS + f", mj AS (SELECT *, upper(replace(list_sort(list_transform(list_distinct(c), lambda x: (-len(list_filter(c, lambda y: y = x)), list_position(c, x), x)))[1][3], 'ß', 'ss')) AS proto FROM (SELECT *, {_FIRST} AS c FROM rw))"


@query("WITH " + B.FORMS + ", " + _MAJOR + " SELECT row_id, slot, proto FROM mj")
def majority_constituent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.majority_constituent(_rows(spark, sf_dir), B.LANGUAGES).select("row_id", "slot", "proto")


_PER = ", ".join(f"string_agg(seg, ',' ORDER BY o) FILTER (language = '{x}') AS {x}" for x in B.LANGUAGES)


@query("WITH " + B.FORMS + ", " + _MAJOR + ", lo AS (SELECT slot, coalesce(nullif(trim(proto), ''), 'U') AS proto, language, seg, min(row_id) AS o FROM (UNPIVOT (SELECT slot, proto, row_id, en, fr, de, es FROM mj) ON en, fr, de, es INTO NAME language VALUE seg) WHERE seg <> '' GROUP BY ALL) SELECT slot, proto, " + _PER + " FROM lo GROUP BY slot, proto")
def group_by_proto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.group_by_proto(I.majority_constituent(_rows(spark, sf_dir), B.LANGUAGES), B.LANGUAGES, by=("slot",))


@query("SELECT o_custkey AS set_id, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS \"F\", arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'O') AS \"O\", arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_custkey")
def reflex_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderstatus").alias("language"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("ord"))
    return I.reflex_table(o, ["F", "O", "P"])
