"""Adapters: the driver's tables as word lists, meaning elements and a table of correspondences, in Spark and in SQL.

The tables hold no word lists, so forms are the words of `documents`, glosses are part names, and an invented table of
sound correspondences over a-z stands for one written by hand. SQL fragments are common table expressions for DuckDB.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse, sets
from ..operators.lexicon import usable_forms, with_variants
from ..operators.table import SoundTable, local, token_index
from ..shared import numbered, settled
from ..sources.readers import read_corrs_tsv

LANGUAGES = ["en", "fr", "de", "es"]
CLASSES = {"V": ["a", "e", "i", "o", "u"], "N": ["m", "n"]}
CANON = "(C*V+)+C*"
SUPRA = ("w",)
#: ord, id, context, syllable types, proto, en, fr, de, es. Invented; one row a letter, then special rows.
CORR_ROWS = [(i + 1, str(i + 1), "", "V,C" if x == "y" else "V" if x in "aeiou" else "C", x, x, x, x, x) for i, x in enumerate("abcdefghijklmnopqrstuvwxyz")] + [
    (27, "27", "", "C", "p", "f", "", "pf,f", ""),
    (28, "28", "", "C", "t", "th", "", "d", ""),
    (29, "29", "_V", "C", "k", "h", "ch", "ch", "j"),
    (30, "30", "V_V", "C", "s", "", "z,s", "s", "s"),
    (31, "31", "$_", "V", "i", "y", "y", "j", "y"),
    (32, "32", "_#", "C", "n", "n", "n", "n", "m,n"),
    (33, "33", "$_V", "C", "h", "", "∅", "", "∅"),
    (34, "34", "_k,g", "C", "n", "ng", "", "ng", ""),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEPT: dict = {}
#: Seconds that making kept tables took, and how many are being made just now (one may need another).
MADE = {"seconds": 0.0, "depth": 0}


def kept(f: Callable) -> Callable:
    """One table a session and folder, written to the shared folder: many queries begin with the same parses."""

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (f.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _KEPT:
            began = time.perf_counter()
            MADE["depth"] += 1
            try:
                _KEPT[key] = settled(f(spark, sf_dir), f.__name__)
            finally:
                MADE["depth"] -= 1
                MADE["seconds"] += 0.0 if MADE["depth"] else time.perf_counter() - began
        return _KEPT[key]

    return get


def forget() -> None:
    """The next query makes its tables anew."""
    _KEPT.clear()


@kept
def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """language, form_id, glyphs, gloss: distinct words, runs of letters, per language of the documents."""
    words = read(spark, sf_dir, "documents").select(F.col("lang").alias("language"), "doc_id", F.explode(F.split(F.lower("text"), r"\P{L}+")).alias("glyphs")).where("glyphs != ''")
    first = words.groupBy("language", "glyphs").agg(F.min("doc_id").alias("form_id"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("gloss"))
    n = part.count()
    return first.withColumn("k", F.col("form_id") % n).join(part, "k").select("language", F.col("form_id").cast("string").alias("form_id"), "glyphs", "gloss")


@kept
def mels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mel_id, glosses: first words of part names with the names of even length that begin with them, and long last words."""
    names = read(spark, sf_dir, "part").select("p_name", F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("n")).distinct()
    rank = lambda df, c, x: numbered(df.select(c).distinct(), [c], "place").select(c, F.concat(F.lit(x), F.col("place").cast("string")).alias("mel_id"))
    a, n = rank(names.where("length(a) != 3"), "a", "a"), rank(names.where("length(n) > 4"), "n", "n")
    terms = a.select("mel_id", F.col("a").alias("g")).unionByName(n.select("mel_id", F.col("n").alias("g"))).unionByName(a.join(names, "a").where("length(p_name) % 2 = 0").select("mel_id", F.col("p_name").alias("g")))
    return terms.groupBy("mel_id").agg(F.array_sort(F.collect_set("g")).alias("glosses"))


def corr_cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CORR_ROWS, "ord int, ID string, Context string, Slot string, `*` string, " + ", ".join(f"{x} string" for x in LANGUAGES))


@kept
def corrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invented table, cut to rows with a token that occurs in the documents' words (zero tokens always do)."""
    table = local(read_corrs_tsv(corr_cells(spark), LANGUAGES))
    seen = forms(spark, sf_dir).select("language", F.explode(F.concat(_substrings(1), _substrings(2))).alias("token")).distinct()
    tokens = token_index(table)
    attested = tokens.join(seen, ["language", "token"], "left_semi").select("ord").unionByName(tokens.where("token = '∅'").select("ord")).distinct()
    return table.join(attested, "ord", "left_semi")


def _substrings(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length("glyphs")), lambda i: F.substring(F.col("glyphs"), i, F.lit(n)))


def sound_table(spark: SparkSession, sf_dir: str) -> SoundTable:
    return SoundTable(corrs(spark, sf_dir), CLASSES, CANON, SUPRA)


@kept
def parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_forms(forms(spark, sf_dir), sound_table(spark, sf_dir))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.keyed_forms(with_variants(usable_forms(forms(spark, sf_dir))))


@kept
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.project_back(keyed(spark, sf_dir), parses(spark, sf_dir)).select("language", "key", "gloss", "kind", "attested", "rcn", "proto")


def raw_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir)


@kept
def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.create_sets(projection(spark, sf_dir), mels(spark, sf_dir))


@kept
def final_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal sets over several languages, one derivation each."""
    return sets.pick_derivation(sets.filter_subsets(sets.root_sets(_raw(spark, sf_dir)), "attested"))


@kept
def other_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run: without meaning elements for longer words, so that it differs in part."""
    some = projection(spark, sf_dir).where("length(proto) > 4")
    return sets.pick_derivation(sets.filter_subsets(sets.root_sets(sets.create_sets(some, mels(spark, sf_dir))), "attested"))


# SQL


def _values() -> str:
    text = lambda x: "'" + str(x) + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in CORR_ROWS)


def narrower(a: str, b: str) -> str:
    return f"({a} IS NOT NULL AND ({b} IS NULL OR (len(list_filter({a}, lambda e: NOT list_contains({b}, e))) = 0 AND len({a}) < len({b}))))"


def _expanded(side: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in CLASSES.items())
    return f"CASE WHEN {side} IS NULL THEN NULL ELSE list_sort(list_distinct(flatten(list_transform({side}, lambda x: CASE x {cases} ELSE [x] END)))) END"


FORMS = r"""forms AS (SELECT language, form_id::VARCHAR AS form_id, glyphs, p_name AS gloss FROM (
  SELECT lang AS language, w AS glyphs, min(doc_id) AS form_id FROM (SELECT lang, doc_id, unnest(regexp_split_to_array(lower(text), '\P{L}+')) AS w FROM documents)
  WHERE w <> '' GROUP BY ALL) JOIN part ON p_partkey = form_id % (SELECT count(*) FROM part))"""
MELS = """pn AS (SELECT DISTINCT p_name, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS n FROM part),
ra AS (SELECT a, 'a' || dense_rank() OVER (ORDER BY a) AS mel_id FROM (SELECT DISTINCT a FROM pn WHERE length(a) <> 3)),
mt AS (SELECT mel_id, a AS term FROM ra UNION SELECT 'n' || dense_rank() OVER (ORDER BY n), n FROM (SELECT DISTINCT n FROM pn WHERE length(n) > 4)
  UNION SELECT mel_id, p_name FROM pn JOIN ra USING (a) WHERE length(p_name) % 2 = 0)"""
CORRS = f"""cells(ord, corr_id, ctx, slot, proto, en, fr, de, es) AS (VALUES {_values()}),
tok0 AS (SELECT ord, lang, unnest(string_split(cell, ',')) AS token FROM (UNPIVOT (SELECT ord, en, fr, de, es FROM cells) ON en, fr, de, es INTO NAME lang VALUE cell) WHERE cell <> ''),
subs AS (SELECT DISTINCT language, substr(glyphs, i, k) AS s FROM (SELECT language, glyphs, unnest(generate_series(1, length(glyphs))) AS i FROM forms), (VALUES (1), (2)) v(k)),
att AS MATERIALIZED (SELECT DISTINCT ord FROM tok0 LEFT JOIN subs ON lang = language AND token = s WHERE s IS NOT NULL OR token = '∅'),
tok AS MATERIALIZED (SELECT * FROM tok0 WHERE ord IN (SELECT ord FROM att)),
corr AS MATERIALIZED (SELECT *, CASE WHEN ctx = '' OR string_split(ctx, '_')[1] = '' THEN NULL ELSE string_split(string_split(ctx, '_')[1], ',') END AS l,
  CASE WHEN ctx = '' OR string_split(ctx, '_')[2] = '' THEN NULL ELSE string_split(string_split(ctx, '_')[2], ',') END AS r FROM cells WHERE ord IN (SELECT ord FROM att))"""
NODES = f"""node AS MATERIALIZED (SELECT 0 AS ord, '' AS corr_id, '$' AS proto, NULL::VARCHAR[] AS el, NULL::VARCHAR[] AS er, false AS supra
  UNION ALL SELECT ord, corr_id, proto, {_expanded('l')}, {_expanded('r')}, proto = 'w' FROM corr),
nx0 AS MATERIALIZED (SELECT a.ord AS l, b.ord AS n FROM node a, node b WHERE b.ord > 0 AND (b.el IS NULL OR list_contains(b.el, a.proto)) AND (b.supra OR a.er IS NULL OR list_contains(a.er, b.proto)))"""
BLOCKED = f"""pr AS (SELECT a.ord AS a, b.ord AS b FROM node a JOIN node b ON a.proto = b.proto AND a.ord <> b.ord WHERE a.ord > 0 AND b.ord > 0),
g1 AS (SELECT DISTINCT x.l, x.n FROM nx0 x JOIN pr ON pr.a = x.n JOIN nx0 y ON y.l = x.l AND y.n = pr.b JOIN node na ON na.ord = pr.a JOIN node nb ON nb.ord = pr.b
  WHERE x.l > 0 AND {narrower('nb.el', 'na.el')} AND nb.er IS NOT DISTINCT FROM na.er),
nx1 AS (SELECT * FROM nx0 WHERE l > 0 AND (l, n) NOT IN (SELECT (l, n) FROM g1)),
met AS (SELECT x.l, x.n, pr.b, b.el IS NOT DISTINCT FROM c.el AS same_left, {narrower('b.el', 'c.el')} AS narrow_left FROM nx1 x JOIN pr ON pr.a = x.l JOIN node c ON c.ord = x.l JOIN node b ON b.ord = pr.b JOIN node nn ON nn.ord = x.n
  WHERE (nn.el IS NULL OR list_contains(nn.el, b.proto)) AND (b.er IS NULL OR list_contains(b.er, nn.proto)) AND {narrower('b.er', 'c.er')}),
g2 AS (SELECT DISTINCT l, n FROM met WHERE same_left),
cond AS MATERIALIZED (SELECT l, n, max(b) AS by_ord FROM met WHERE NOT same_left AND narrow_left AND (l, n) NOT IN (SELECT (l, n) FROM g2) GROUP BY ALL),
mv AS MATERIALIZED (SELECT * FROM nx0 WHERE l = 0 UNION ALL SELECT * FROM nx1 WHERE (l, n) NOT IN (SELECT (l, n) FROM g2))"""
PARSES = """syl AS (SELECT ord, unnest(string_split(slot, ',')) AS x FROM corr),
dfa(q, x, q2) AS (VALUES (0, 'C', 0), (0, 'V', 1), (1, 'C', 1), (1, 'V', 1)),
allow AS (SELECT b.ord AS b, a.ord AS last FROM node a, node b WHERE b.ord > 0 AND (b.el IS NULL OR list_contains(b.el, a.proto))),
step AS MATERIALIZED (SELECT mv.l, mv.n, tok.lang, CASE WHEN token = '∅' THEN '' ELSE token END AS token, (token = '∅')::INT AS zero, c.corr_id, c.proto, c.supra, d.q, d.q2, cond.by_ord
  FROM mv JOIN node a ON a.ord = mv.l JOIN node c ON c.ord = mv.n JOIN tok ON tok.ord = c.ord JOIN syl ON syl.ord = c.ord JOIN dfa d ON d.x = syl.x LEFT JOIN cond ON cond.l = mv.l AND cond.n = mv.n
  WHERE a.er IS DISTINCT FROM ['#']),
p(language, glyphs, pos, rcn, proto, last, ll, q, z) AS (SELECT language, glyphs, 0, ''::VARCHAR, ''::VARCHAR, 0, -1, 0, 0 FROM (SELECT DISTINCT language, glyphs FROM forms)
  UNION ALL SELECT p.language, p.glyphs, pos + length(token), rcn || CASE WHEN rcn = '' THEN '' ELSE ' ' END || corr_id, p.proto || s.proto, CASE WHEN supra THEN p.last ELSE n END, CASE WHEN supra THEN p.ll ELSE p.last END, q2, z + zero
  FROM p JOIN step s ON s.l = p.last AND s.q = p.q AND s.lang = p.language AND substr(glyphs, pos + 1, length(token)) = token LEFT JOIN allow ON allow.b = s.by_ord AND allow.last = p.ll
  WHERE allow.b IS NULL),
parses AS MATERIALIZED (SELECT DISTINCT language, glyphs, rcn, p.proto FROM p JOIN node e ON e.ord = last WHERE pos = length(glyphs) AND q = 1 AND (e.er IS NULL OR list_contains(e.er, '#')))"""
PROJECTION = """proj AS MATERIALIZED (SELECT language, glyphs, gloss, language || chr(31) || glyphs || chr(31) || gloss AS key, rcn, proto FROM forms JOIN parses USING (language, glyphs))"""
#: gloss → mel: exact, or by the candidates of two-word names without delimiters (phrase, then words).
SETS = """cand AS (SELECT gloss, unnest(list_distinct([gloss] || string_split(gloss, ' '))) AS term FROM (SELECT DISTINCT gloss FROM forms)),
gm AS (SELECT DISTINCT gloss, mel_id FROM cand JOIN mt USING (term)),
raw AS MATERIALIZED (SELECT rcn, proto, coalesce(mel_id, '') AS mel_id, list_sort(list(DISTINCT key)) AS support, count(DISTINCT language) AS languages FROM proj LEFT JOIN gm USING (gloss) GROUP BY ALL)"""
DROP = """{0}_d AS MATERIALIZED (SELECT DISTINCT support FROM {1}),
{0}_e AS MATERIALIZED (SELECT support, unnest(support) AS m FROM {0}_d),
{0}_c AS (SELECT m, count(*) AS n FROM {0}_e GROUP BY m),
{0}_r AS (SELECT support, min((n, m)) AS r FROM {0}_e JOIN {0}_c USING (m) GROUP BY support),
{0}_lost AS MATERIALIZED (SELECT DISTINCT a.support FROM {0}_r a JOIN {0}_e b ON b.m = a.r[2] WHERE a.r[1] > 1 AND len(b.support) > len(a.support) AND list_has_all(b.support, a.support)),
{0}_kept AS (SELECT * FROM {1} WHERE support NOT IN (SELECT support FROM {0}_lost)),
{0} AS MATERIALIZED (SELECT proto, support, ids, mel_id, rcn, languages FROM (SELECT *, array_to_string(list_transform(string_split(rcn, ' '), lambda x: lpad(x, 4, ' ')), ' ') AS ids FROM {0}_kept)
  QUALIFY row_number() OVER (PARTITION BY proto, support ORDER BY ids, mel_id) = 1)"""
MULTI = "multi AS MATERIALIZED (SELECT * FROM raw WHERE languages > 1), single AS (SELECT * FROM raw WHERE languages <= 1)"
FINAL = MULTI + ",\n" + DROP.format("fin", "multi")
OTHER = """raw2 AS MATERIALIZED (SELECT rcn, proto, coalesce(mel_id, '') AS mel_id, list_sort(list(DISTINCT key)) AS support, count(DISTINCT language) AS languages FROM proj LEFT JOIN gm USING (gloss) WHERE length(proto) > 4 GROUP BY ALL),
multi2 AS MATERIALIZED (SELECT * FROM raw2 WHERE languages > 1),
""" + DROP.format("fin2", "multi2")

_ORDER = {"forms": FORMS, "mels": MELS, "corrs": CORRS, "nodes": NODES, "blocked": BLOCKED, "parses": PARSES, "proj": PROJECTION, "sets": SETS, "final": FINAL, "other": OTHER}
_NEEDS = {"corrs": ["forms"], "nodes": ["corrs"], "blocked": ["nodes"], "parses": ["blocked"], "proj": ["parses"], "sets": ["proj", "mels"], "final": ["sets"], "other": ["final"]}


def sql(needs: str, select: str) -> str:
    """A query over the fragments named (and those that they need)."""
    wanted: set[str] = set()

    def add(x: str) -> None:
        for y in _NEEDS.get(x, ()):
            add(y)
        wanted.add(x)

    for x in needs.split():
        add(x)
    return "WITH RECURSIVE " + ",\n".join(v for k, v in _ORDER.items() if k in wanted) + "\n" + select
