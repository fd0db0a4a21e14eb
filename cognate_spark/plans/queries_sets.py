"""Queries of tables, parsing, sets, reports, coverage and comparison over the driver's tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import coverage as V
from ..operators import parse as P
from ..operators import reports as S
from ..operators import sets as Z
from ..operators import table as T
from ..schemas import SEP
from ..shared import numbered, shared_dir
from . import testbed as B
from .registry import query


def _shown(keys: str | Column) -> Column:
    """Form keys as one readable string."""
    col = F.col(keys) if isinstance(keys, str) else keys
    return F.translate(F.array_join(col, ";"), SEP, "|")


_SHOW = "replace(array_to_string({0}, ';'), chr(31), '|')"
_KEY = "replace({0}, chr(31), '|')"


def _key(name: str) -> Column:
    return F.translate(F.col(name), SEP, "|")


def _ids(df: DataFrame) -> DataFrame:
    return df.withColumn("ids", P.ids_string(F.col("rcn")))


_IDS = "array_to_string(list_transform(string_split({0}, ' '), lambda x: lpad(x, 4, ' ')), ' ')"

# The table


@query(B.sql("nodes", "SELECT ord, array_to_string(el, ',') AS left_context, array_to_string(er, ',') AS right_context FROM node WHERE ord > 0"))
def expand_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = B.sound_table(spark, sf_dir)
    return T.expand_contexts(table.corrs, T.class_table(table)).select("ord", F.array_join("el", ",").alias("left_context"), F.array_join("er", ",").alias("right_context"))


@query(B.sql("corrs", "SELECT lang AS language, token, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS corrs FROM tok WHERE ord IN (SELECT ord FROM corr) GROUP BY ALL"))
def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.token_index(B.corrs(spark, sf_dir)).groupBy("language", "token").agg(F.array_join(F.array_sort(F.collect_list("ord")), ",").alias("corrs"))


@query(B.sql("corrs", "SELECT ord, token AS outcome, string_agg(lang, ',' ORDER BY lang) AS languages FROM tok0 WHERE ord IN (SELECT ord FROM corr) GROUP BY ALL"))
def rule_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.rule_view(B.corrs(spark, sf_dir)).where("outcome != ''").select("ord", "outcome", F.array_join("languages", ",").alias("languages"))


@query(B.sql("nodes", "SELECT l AS last_ord, n AS next_ord FROM nx0"))
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.transitions(B.sound_table(spark, sf_dir))


@query(B.sql("blocked", "SELECT l AS last_ord, n AS next_ord, by_ord FROM mv LEFT JOIN cond USING (l, n)"))
def block_less_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, conditional = T.block_less_specific(B.sound_table(spark, sf_dir))
    return kept.join(conditional, ["last_ord", "next_ord"], "left").select("last_ord", "next_ord", "by_ord")


#: Contexts of the rules: what may stand before (V is a class) and what must come after, to the word's end (#).
_LEFT, _RIGHT = [["$"], ["V"], None], [["V", "#"], None, ["e", "n", "r", "s"], ["er", "#"]]


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged rules of the word pairs in part names: the second word's two first letters become the first word's first, in contexts
    that go round."""
    p = B.read(spark, sf_dir, "part").select("p_partkey", F.substring("p_name", 1, 1).alias("i"), F.substring(F.split("p_name", " ")[1], 1, 2).alias("o")).where("i != o")
    each = p.groupBy("i", "o").agg(F.min("p_partkey").alias("k"))
    none = F.lit(None).cast("array<string>")
    words = lambda x: none if x is None else F.array(*map(F.lit, x))
    side = lambda contexts: F.element_at(F.array(*map(words, contexts)), (F.col("k") % len(contexts) + 1).cast("int"))
    return each.select(F.col("k").cast("int").alias("ord"), F.concat(F.lit("r"), F.col("k").cast("string")).alias("rule_id"), side(_LEFT).alias("ctx_l"), side(_RIGHT).alias("ctx_r"), F.col("i").alias("input"), F.array("o").alias("outcome"), F.when(F.col("k") % 2 == 0, F.array(F.lit("en"), F.lit("fr"))).otherwise(F.array(F.lit("en"))).alias("languages"), (F.col("k") % 2 + 1).cast("int").alias("stage"))


@query("WITH e AS (SELECT substr(p_name, 1, 1) AS i, substr(string_split(p_name, ' ')[2], 1, 2) AS o, min(p_partkey) AS k FROM part GROUP BY ALL) SELECT o AS token, 'r' || k AS rule_id, (k % 2 + 1)::INT AS stage, (SELECT max(k % 2 + 1)::INT FROM e WHERE k % 2 = 0) AS max_stage FROM e WHERE k % 2 = 0")
def rules_for_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine, most = T.rules_for_language(_rules(spark, sf_dir), "fr")
    return mine.crossJoin(most).select("token", "rule_id", "stage", "max_stage")


@query(B.sql("corrs", "SELECT name, string_agg(proto, ',' ORDER BY o) AS members FROM (SELECT x AS name, proto, min(ord) AS o FROM (SELECT ord, proto, unnest(string_split(slot, ',')) AS x FROM corr) GROUP BY ALL) GROUP BY name"))
def derive_sound_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.derive_sound_classes(B.corrs(spark, sf_dir)).select("name", F.array_join("members", ",").alias("members"))


# Parsing


@query(B.sql("parses", "SELECT * FROM parses"))
def parse_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.parses(spark, sf_dir).select("language", "glyphs", F.array_join("rcn", " ").alias("rcn"), "proto")


@query(B.sql("proj", f"SELECT rcn, count(*) AS forms, count(DISTINCT language) AS languages, {_KEY.format('min(key)')} AS first_key FROM proj GROUP BY rcn"))
def project_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.projection(spark, sf_dir).groupBy(F.array_join("rcn", " ").alias("rcn")).agg(F.count("*").alias("forms"), F.count_distinct("language").alias("languages"), F.min("key").alias("k"))
    return out.select("rcn", "forms", "languages", _key("k").alias("first_key"))


@query(B.sql("parses", "SELECT language, form_id, glyphs FROM forms WHERE (language, glyphs) NOT IN (SELECT (language, glyphs) FROM parses)"))
def failed_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.failed_parses(B.keyed(spark, sf_dir), B.parses(spark, sf_dir)).select("language", "form_id", "glyphs")


@query(B.sql("parses", f"SELECT language, glyphs, proto, {_IDS.format('rcn')} AS ids, array_to_string(list_transform(string_split(rcn, ' '), lambda x: CASE x WHEN '25' THEN '(V,C)' ELSE CASE WHEN x IN ('1', '5', '9', '15', '21', '31') THEN 'V' ELSE 'C' END END), '') AS syllables FROM parses"))
def reconstruction_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reconstruction_strings(B.parses(spark, sf_dir), B.corrs(spark, sf_dir)).select("language", "glyphs", "proto", "ids", "syllables")


def _sides(name: str, contexts: list) -> str:
    """SQL for a rule's context by its number k, with classes as their members."""
    whole = [None if c is None else sorted({y for x in c for y in B.CLASSES.get(x, [x])}) for c in contexts]
    return f"CASE k % {len(whole)} " + " ".join(f"WHEN {i} THEN {'NULL::VARCHAR[]' if c is None else c}" for i, c in enumerate(whole)) + f" END AS {name}"


#: A stage's letters are read one by one, as they are or as a rule's outcome; then the next lower stage begins with what was made. `open` is
#: what must still follow: per rule applied the remainders of its right contexts, of which one has to come.
_UNDONE = f"""rl AS MATERIALIZED (SELECT *, {_sides('lft', _LEFT)}, {_sides('rgt', _RIGHT)} FROM (SELECT i, o, k, k % 2 + 1 AS stage, unnest(CASE WHEN k % 2 = 0 THEN ['en', 'fr'] ELSE ['en'] END) AS lang FROM (SELECT substr(p_name, 1, 1) AS i, substr(string_split(p_name, ' ')[2], 1, 2) AS o, min(p_partkey) AS k FROM part GROUP BY ALL) WHERE i <> o)),
st AS MATERIALIZED (SELECT lang || stage || substr(o, 1, 1) AS key, o AS token, i AS input, 'r' || k AS id, lft, rgt FROM rl UNION ALL SELECT 'same', NULL, NULL, NULL, NULL, NULL UNION ALL SELECT 'next', NULL, NULL, NULL, NULL, NULL),
u(language, glyphs, word, stage, pos, made, used, hist, hjson, open) AS (SELECT language, glyphs, glyphs, 2, 0, '', ''::VARCHAR, ''::VARCHAR, ''::VARCHAR, []::VARCHAR[][] FROM (SELECT DISTINCT language, glyphs FROM forms)
  UNION ALL SELECT language, glyphs, CASE key WHEN 'next' THEN made ELSE word END, CASE key WHEN 'next' THEN stage - 1 ELSE stage END, CASE key WHEN 'next' THEN 0 ELSE pos + coalesce(length(token), 1) END,
    CASE key WHEN 'next' THEN '' ELSE made || said END, CASE WHEN key = 'next' THEN '' WHEN id IS NULL THEN used ELSE used || CASE WHEN used = '' THEN '' ELSE ',' END || id END,
    CASE key WHEN 'next' THEN used || CASE WHEN used = '' OR hist = '' THEN '' ELSE ',' END || hist ELSE hist END,
    CASE WHEN key = 'next' AND used <> '' THEN made || '=' || used || ';' || hjson ELSE hjson END,
    CASE key WHEN 'next' THEN [] ELSE CASE WHEN rgt IS NULL THEN [] ELSE [rgt] END || list_filter(list_transform(open, lambda g: list_transform(list_filter(g, lambda c: starts_with(c, said) AND c <> said), lambda c: substr(c, length(said) + 1))), lambda g: len(g) > 0) END
  FROM (SELECT *, coalesce(input, substr(word, pos + 1, 1)) AS said FROM (SELECT *, unnest([language || stage || substr(word, pos + 1, 1), CASE WHEN pos < length(word) THEN 'same' ELSE 'next' END]) AS key FROM u WHERE stage > 0) JOIN st USING (key))
  WHERE CASE WHEN key = 'next' THEN len(list_filter(open, lambda g: NOT list_contains(g, '#'))) = 0
    ELSE (token IS NULL OR substr(word, pos + 1, length(token)) = token) AND len(list_filter(open, lambda g: len(list_filter(g, lambda c: starts_with(said, c) OR starts_with(c, said))) = 0)) = 0
      AND (lft IS NULL OR len(list_filter(lft, lambda c: CASE WHEN c = '$' THEN made = '' ELSE ends_with(made, c) END)) > 0) END),
undone AS MATERIALIZED (SELECT language, glyphs, word AS stage0, hist AS rules, hjson FROM u WHERE stage = 0)"""


@query(f"WITH RECURSIVE {B.FORMS},\n{_UNDONE}\nSELECT language, glyphs, stage0, rules FROM undone")
def undo_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = P.undo_rules(B.forms(spark, sf_dir), _rules(spark, sf_dir), B.CLASSES)
    return made.select("language", "glyphs", "stage0", F.array_join(F.flatten(F.transform("history", lambda h: h["rule_ids"])), ",").alias("rules"))


#: Parses of proto strings by the proto segments themselves, as `own`; {0}: where the strings come from.
_OWN = """ostep AS MATERIALIZED (SELECT mv.l, mv.n, c.proto AS token, c.corr_id, c.supra, d.q, d.q2, cond.by_ord
  FROM mv JOIN node a ON a.ord = mv.l JOIN node c ON c.ord = mv.n JOIN syl ON syl.ord = c.ord JOIN dfa d ON d.x = syl.x LEFT JOIN cond ON cond.l = mv.l AND cond.n = mv.n WHERE a.er IS DISTINCT FROM ['#']),
op(word, pos, rcn, last, ll, q) AS (SELECT word, 0, ''::VARCHAR, 0, -1, 0 FROM (SELECT DISTINCT proto AS word FROM {0})
  UNION ALL SELECT word, pos + length(token), rcn || CASE WHEN rcn = '' THEN '' ELSE ' ' END || corr_id, CASE WHEN supra THEN op.last ELSE n END, CASE WHEN supra THEN op.ll ELSE op.last END, q2
  FROM op JOIN ostep s ON s.l = op.last AND s.q = op.q AND substr(word, pos + 1, length(token)) = token LEFT JOIN allow ON allow.b = s.by_ord AND allow.last = op.ll WHERE allow.b IS NULL),
own AS MATERIALIZED (SELECT DISTINCT word, rcn FROM op JOIN node e ON e.ord = last WHERE pos = length(word) AND q = 1 AND (e.er IS NULL OR list_contains(e.er, '#')))"""


# Sets


@query(B.sql("forms mels", "SELECT DISTINCT gloss, mel_id FROM (SELECT gloss, unnest(list_distinct([gloss] || string_split(gloss, ' '))) AS term FROM (SELECT DISTINCT gloss FROM forms)) JOIN mt USING (term)"))
def associate_mels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.associate_mels(B.forms(spark, sf_dir).select("gloss", F.lit(True).alias("modern")), B.mels(spark, sf_dir))


def _set_rows(sets: DataFrame) -> DataFrame:
    return sets.select(F.array_join("rcn", " ").alias("rcn"), "proto", "mel_id", _shown("support").alias("support"), "languages")


_SET_ROWS = f"rcn, proto, mel_id, {_SHOW.format('support')} AS support, languages"


@query(B.sql("sets", f"SELECT {_SET_ROWS} FROM raw WHERE languages > 1"))
def create_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set_rows(Z.root_sets(B.raw_sets(spark, sf_dir)))


_BLOCKS = f"SELECT rcn, mel_id, languages, n, b AS block, {_SHOW.format('support[1000 * b + 1 : 1000 * b + 1000]')} AS keys FROM (SELECT *, len(support) AS n, unnest(generate_series(0, (len(support) - 1) // 1000)) AS b FROM {{0}})"


def _block_rows(sets: Z.SetBlocks) -> DataFrame:
    each = sets.blocks().join(sets.sets, "set_id")
    return each.select(F.array_join("rcn", " ").alias("rcn"), "mel_id", "languages", "n", "block", _shown("keys").alias("keys"))


@query(B.sql("sets", _BLOCKS.format("raw")))
def set_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sets, with their supports in blocks of bounded size."""
    return _block_rows(Z.set_blocks(B.projection(spark, sf_dir), B.mels(spark, sf_dir)))


@query(B.sql("final", _BLOCKS.format("fin_kept")))
def maximal_set_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_rows(Z.set_blocks(B.projection(spark, sf_dir), B.mels(spark, sf_dir)).where("languages > 1").maximal())


@query(B.sql("sets", f"SELECT {_SET_ROWS} FROM raw WHERE languages <= 1"))
def singleton_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set_rows(Z.singleton_sets(B.raw_sets(spark, sf_dir)))


@query(B.sql("sets", f"SELECT rcn, mel_id, {_SHOW.format('support')} AS attested FROM raw"))
def attested_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Z.attested_support(B.raw_sets(spark, sf_dir), B.keyed(spark, sf_dir).select("key", "attested"))
    return made.select(F.array_join("rcn", " ").alias("rcn"), "mel_id", _shown("attested").alias("attested"))


@query(B.sql("final", f"SELECT {_SET_ROWS} FROM fin_kept"))
def filter_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set_rows(Z.filter_subsets(Z.root_sets(B.raw_sets(spark, sf_dir))))


@query(B.sql("final", f"SELECT {_SET_ROWS} FROM fin"))
def pick_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set_rows(B.final_sets(spark, sf_dir))


@query(B.sql("final", f"SELECT proto, ids, mel_id, {_SHOW.format('support')} AS support, languages FROM fin"))
def upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: from words to maximal cognate sets, in one go."""
    made = Z.upstream(B.forms(spark, sf_dir), B.sound_table(spark, sf_dir), B.mels(spark, sf_dir))
    return made.select("proto", "ids", "mel_id", _shown("support").alias("support"), "languages")


@query(B.sql("sets", "SELECT rcn, proto, mel_id, len(support) AS members FROM (SELECT rcn, proto, mel_id, list(DISTINCT key) AS support, count(DISTINCT language) AS languages FROM proj JOIN gm USING (gloss) GROUP BY ALL) WHERE languages > 1"))
def create_sets_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Z.root_sets(Z.create_sets(B.projection(spark, sf_dir), B.mels(spark, sf_dir), only_with_mel=True))
    return made.select(F.array_join("rcn", " ").alias("rcn"), "proto", "mel_id", F.size("support").cast("long").alias("members"))


@query(B.sql("final", f"SELECT {_SHOW.format('support')} AS support, string_agg(DISTINCT proto, ',' ORDER BY proto) AS protos, count(*) AS n FROM fin GROUP BY fin.support"))
def competing_reconstructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.competing_reconstructions(B.final_sets(spark, sf_dir)).select(_shown("support").alias("support"), F.array_join("protos", ",").alias("protos"), "n")


_ISOLATES = "iso AS (SELECT f AS form, list_sort(list(DISTINCT ids)) AS ids FROM (SELECT unnest(support) AS f, " + _IDS.format("rcn") + " AS ids FROM single) WHERE f NOT IN (SELECT unnest(support) FROM fin) GROUP BY f)"


def _with(sql: str, more: str, select: str) -> str:
    """sql ends with a select of nothing in particular; more goes before it."""
    return sql.rstrip() + ",\n" + more + "\n" + select


_FIN = B.sql("final", "")


#: What the correspondences become per language; a blank cell is silent.
_SAID = """outs AS MATERIALIZED (SELECT DISTINCT corr_id, lang, CASE WHEN s = '∅' THEN '' ELSE s END AS s FROM (SELECT corr_id, lang, unnest(string_split(cell, ',')) AS s FROM (UNPIVOT (SELECT corr_id, en, fr, de, es FROM cells WHERE ord IN (SELECT ord FROM att)) ON en, fr, de, es INTO NAME lang VALUE cell))),
pd(word, lang, rest, said) AS (SELECT word, lang, string_split(rcn, ' '), '' FROM own, (SELECT DISTINCT lang FROM outs)
  UNION SELECT word, pd.lang, rest[2:], said || s FROM pd JOIN outs ON outs.corr_id = rest[1] AND outs.lang = pd.lang WHERE len(rest) > 0)"""


@query(_with(_FIN, _OWN.format("fin") + ",\n" + _SAID, "SELECT DISTINCT word AS proto, lang AS language, said AS reflex FROM pd WHERE len(rest) = 0"))
def postdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted reflexes of the proto forms of all sets."""
    protos = B.final_sets(spark, sf_dir).select("proto").distinct()
    return P.postdict(protos, B.sound_table(spark, sf_dir))


#: The two-level tree: sets of fr and es, whose proto strings are parsed again, beside words of en and de.
_TREE = (
    "wraw AS MATERIALIZED (SELECT rcn, proto, coalesce(mel_id, '') AS mel_id, list_sort(list(DISTINCT key)) AS support, count(DISTINCT language) AS languages FROM proj LEFT JOIN gm USING (gloss) WHERE language IN ('fr', 'es') GROUP BY ALL),\n"
    + B.DROP.format("wfin", "wraw")
    + ",\n"
    + _OWN.format("wfin")
    + """,
trow AS (SELECT rcn, proto, coalesce(mel_id, '') AS mel_id, language, key, [key] AS attested FROM proj LEFT JOIN gm USING (gloss) WHERE language IN ('en', 'de')
  UNION ALL SELECT own.rcn, proto, '', 'Western', 'Western‖' || ids || '‖' || mel_id || '‖' || array_to_string(support, chr(30)), support FROM wfin JOIN own ON own.word = wfin.proto),
tall AS MATERIALIZED (SELECT rcn, proto, mel_id, list_sort(list(DISTINCT key)) AS keys, list_sort(list_distinct(flatten(list(attested)))) AS support, count(DISTINCT language) AS languages FROM trow GROUP BY rcn, proto, mel_id HAVING count(DISTINCT language) > 1),
"""
    + B.DROP.format("tfin", "tall")
)


@query(_with(B.sql("sets", ""), _TREE, f"SELECT proto, ids, mel_id, {_SHOW.format('support')} AS attested, languages FROM (SELECT *, {_IDS.format('rcn')} AS ids FROM tfin_kept) QUALIFY row_number() OVER (PARTITION BY proto, keys ORDER BY ids, mel_id) = 1"))
def upstream_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of two levels over the same words: Western is rebuilt from fr and es, then the target from it, en and de."""
    table = B.sound_table(spark, sf_dir)
    western = T.SoundTable(table.corrs, table.classes, table.canon, table.supra)
    above = T.SoundTable(table.corrs.withColumn("daughters", F.map_concat("daughters", F.create_map(F.lit("Western"), F.array("proto")))), table.classes, table.canon, table.supra)
    made = Z.upstream_tree("Proto: Western, en, de; Western: fr, es", B.forms(spark, sf_dir), {"Proto": above, "Western": western}, f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}", B.mels(spark, sf_dir))
    return made.select("proto", "ids", "mel_id", _shown("attested").alias("attested"), "languages")


def _isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.isolates(B.final_sets(spark, sf_dir), Z.singleton_sets(B.raw_sets(spark, sf_dir)))


@query(_with(_FIN, _ISOLATES, f"SELECT {_KEY.format('form')} AS form, array_to_string(ids, ';') AS ids FROM iso"))
def isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _isolates(spark, sf_dir).select(_key("form").alias("form"), F.array_join("ids", ";").alias("ids"))


@query(_with(_FIN, _ISOLATES, f"SELECT {_KEY.format('form')} AS form, unnest(ids[1:4]) AS ids, unnest(generate_series(1, least(len(ids), 4))) AS rank FROM iso"))
def top_isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_isolates(_isolates(spark, sf_dir), 3).select(_key("form").alias("form"), F.col("rank").cast("long").alias("rank"), "ids")


# Reports

_STATS = "st AS (SELECT f.language, count(DISTINCT f.key) AS forms, count(DISTINCT f.key) - count(DISTINCT p.key) AS no_parses, count(p.key) AS reconstructions FROM (SELECT language, language || chr(31) || glyphs || chr(31) || gloss AS key FROM forms) f LEFT JOIN proj p USING (key) GROUP BY f.language)"
_PROJ = B.sql("proj", "")


@query(_with(_PROJ, _STATS, "SELECT * FROM st"))
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.language_stats(B.keyed(spark, sf_dir), B.projection(spark, sf_dir))


@query(_with(_PROJ, _STATS, "SELECT language, sum(forms)::BIGINT AS forms, sum(no_parses)::BIGINT AS no_parses, sum(reconstructions)::BIGINT AS reconstructions FROM st GROUP BY ROLLUP (language)"))
def stats_with_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stats_with_totals(S.language_stats(B.keyed(spark, sf_dir), B.projection(spark, sf_dir)))


_USAGE = "us AS (SELECT c.corr_id, count(DISTINCT u.proto) AS uses FROM corr c LEFT JOIN (SELECT proto, unnest(string_split(rcn, ' ')) AS corr_id FROM fin{0}) u USING (corr_id) GROUP BY c.corr_id)"


@query(_with(_FIN, _USAGE.format(""), "SELECT * FROM us"))
def correspondence_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.correspondence_usage(B.final_sets(spark, sf_dir), B.corrs(spark, sf_dir))


@query(_with(_FIN, _USAGE.format(""), "SELECT count(*) FILTER (uses > 0) AS used, count(*) AS correspondences FROM us"))
def correspondences_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.correspondences_used(B.final_sets(spark, sf_dir), B.corrs(spark, sf_dir))


@query(_with(_FIN, _USAGE.format(" WHERE list_has_any(list_transform(support, lambda k: string_split(k, chr(31))[1]), ['fr'])"), "SELECT * FROM us"))
def usage_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.usage_by_language(B.final_sets(spark, sf_dir), B.corrs(spark, sf_dir), "fr")


#: The words as they were before the rules, parsed as forms are.
_PARSED0 = re.sub(r"\bparses\b", "parses0", re.sub(r"\bp\b", "p0", B.PARSES[B.PARSES.index("p(language") :])).replace("(SELECT DISTINCT language, glyphs FROM forms)", "(SELECT DISTINCT language, stage0 AS glyphs FROM undone)")
_RULED = "ru AS (SELECT DISTINCT unnest(string_split(rules, ',')) AS rule_id, proto FROM undone JOIN parses0 ON parses0.language = undone.language AND parses0.glyphs = stage0 WHERE rules <> '')"


@query(_with(B.sql("parses", ""), _UNDONE + ",\n" + _PARSED0 + ",\n" + _RULED, "SELECT id AS rule_id, count(DISTINCT proto) AS uses FROM (SELECT DISTINCT id FROM st WHERE id IS NOT NULL) LEFT JOIN ru ON rule_id = id GROUP BY id"))
def rule_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = Z.projection(B.keyed(spark, sf_dir), B.sound_table(spark, sf_dir), rules=_rules(spark, sf_dir))
    return S.rule_usage(rows, _rules(spark, sf_dir))


@query(B.sql("final", "SELECT count(DISTINCT f) AS reflexes_in_sets FROM (SELECT unnest(support) AS f FROM fin)"))
def reflexes_in_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reflexes_in_sets(B.final_sets(spark, sf_dir))


_PER = ", ".join(f"coalesce(sum(len(list_filter(support, lambda k: starts_with(k, '{x}' || chr(31))))), 0)::BIGINT AS {x}" for x in B.LANGUAGES)


@query(_with(_FIN, "one AS (SELECT * FROM fin QUALIFY count(*) OVER (PARTITION BY support) = 1), oc AS (SELECT support, unnest(string_split(rcn, ' ')) AS corr_id FROM one)", f"SELECT c.corr_id, count(oc.corr_id) AS row_count, {_PER} FROM corr c LEFT JOIN oc USING (corr_id) GROUP BY c.corr_id"))
def correspondence_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.correspondence_frequency(B.final_sets(spark, sf_dir), B.corrs(spark, sf_dir), B.LANGUAGES)


@query(B.sql("final", f"SELECT string_split(f, chr(31))[1] AS language, {_KEY.format('f')} AS form, string_agg(DISTINCT ids, ';' ORDER BY ids) AS sets, count(DISTINCT ids) AS n FROM (SELECT unnest(support) AS f, ids FROM fin) GROUP BY f"))
def word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.word_index(B.final_sets(spark, sf_dir)).select("language", _key("form").alias("form"), F.array_join("sets", ";").alias("sets"), "n")


_TAB = ", ".join(f"array_to_string(list_sort(list_distinct(list_transform(list_filter(support, lambda k: starts_with(k, '{x}' || chr(31))), lambda k: string_split(k, chr(31))[2]))), ', ') AS {x}" for x in B.LANGUAGES)


@query(B.sql("final", f"SELECT ids, proto, mel_id, {_TAB} FROM fin"))
def sets_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sets_by_language(B.final_sets(spark, sf_dir), B.LANGUAGES).drop("support_key")


@query(_with(_PROJ, "dk AS (SELECT DISTINCT key, proto, " + _IDS.format("rcn") + " AS ids FROM proj ORDER BY key, proto, ids LIMIT 100001)", f"SELECT {_KEY.format('key')} AS key, proto, ids FROM dk UNION ALL SELECT DISTINCT language || '|' || glyphs || '|' || gloss, NULL, NULL FROM forms WHERE (language, glyphs) NOT IN (SELECT (language, glyphs) FROM parses)"))
def dump_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.dump_keys(_ids(B.projection(spark, sf_dir)), P.failed_parses(B.keyed(spark, sf_dir), B.parses(spark, sf_dir)))
    return out.select(_key("key").alias("key"), "proto", "ids")


@query(_with(_FIN, _ISOLATES, """SELECT 'lexicons' AS stat, count(DISTINCT language) AS value FROM forms UNION ALL SELECT 'reflexes', count(*) FROM (SELECT DISTINCT language, glyphs, gloss FROM forms)
UNION ALL SELECT 'reflexes_in_sets', count(DISTINCT f) FROM (SELECT unnest(support) AS f FROM fin) UNION ALL SELECT 'subsets_tossed', count(*) FROM fin_lost
UNION ALL SELECT 'isolates', count(*) FROM iso UNION ALL SELECT 'failures', count(*) FROM forms WHERE (language, glyphs) NOT IN (SELECT (language, glyphs) FROM parses)
UNION ALL SELECT 'sets', count(DISTINCT support) FROM fin"""))
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = B.raw_sets(spark, sf_dir)
    return S.run_summary(B.keyed(spark, sf_dir), P.failed_parses(B.keyed(spark, sf_dir), B.parses(spark, sf_dir)), Z.root_sets(raw), B.final_sets(spark, sf_dir), Z.singleton_sets(raw))


@query(B.sql("final", "SELECT ids, proto, mel_id, replace(array_to_string(list_transform(list_sort(list_transform(support, lambda k: (list_position(['es', 'de', 'fr', 'en'], string_split(k, chr(31))[1]), k))), lambda x: x[2]), ';'), chr(31), '|') AS members FROM fin"))
def list_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.list_sets(B.final_sets(spark, sf_dir), ["es", "de", "fr", "en"]).select("ids", "proto", "mel_id", _shown("members").alias("members"))


@query(B.sql("final", "SELECT lpad((row_number() OVER (ORDER BY ids, mel_id, support))::VARCHAR, 6, '0') AS set_id, ids, replace(array_to_string(list_transform(list_sort(list_transform(support, lambda k: (list_position(['es', 'de', 'fr', 'en'], string_split(k, chr(31))[1]), k))), lambda x: string_split(x[2], chr(31))[2]), ';'), chr(31), '|') AS reflexes FROM fin"))
def write_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested sets are written in partitions by their meaning and read back."""
    from ..sources.writers import publish
    from ..sources.writers import write_sets as nested

    parts = lambda k: F.struct(F.split(k, SEP)[0].alias("language"), F.split(k, SEP)[1].alias("glyphs"), F.split(k, SEP)[2].alias("gloss"), F.lit(None).cast("string").alias("form_id"))
    n = F.col("n").cast("string")
    sets = numbered(B.final_sets(spark, sf_dir), ["ids", "mel_id", "support"], "n").select(F.lpad(n, 6, "0").alias("set_id"), "ids", "proto", "mel_id", F.transform("attested", parts).alias("members"))
    made, path = nested(sets, ["es", "de", "fr", "en"]), f"{shared_dir(spark)}/sets-{uuid.uuid4().hex}"
    publish(made.withColumn("mel", F.coalesce(F.nullif("mel_id", F.lit("")), F.lit("none"))), path, "json", partition="mel")
    back = spark.read.schema(made.schema).json(path)
    return back.select("set_id", "ids", F.array_join(F.transform("reflexes", lambda r: r["lx"]), ";").alias("reflexes"))


# Coverage

_COV = B.sql("forms mels", "").rstrip() + """,
gl AS (SELECT DISTINCT gloss FROM forms WHERE gloss <> ''),
ex AS (SELECT gloss, gloss AS term FROM gl WHERE gloss IN (SELECT term FROM mt)),
mg AS (SELECT * FROM ex UNION SELECT gloss, w FROM (SELECT gloss, unnest(list_distinct([gloss] || string_split(gloss, ' '))) AS w FROM gl WHERE gloss NOT IN (SELECT gloss FROM ex)) WHERE w IN (SELECT term FROM mt)),
lg AS (SELECT DISTINCT language, gloss FROM forms WHERE gloss <> ''),
gu AS (SELECT term, count(*) AS uses FROM lg JOIN mg USING (gloss) GROUP BY term),
mu AS (SELECT mel_id, term, coalesce(uses, 0) AS uses, max(coalesce(uses, 0)) OVER (PARTITION BY mel_id) > 0 AS used FROM mt LEFT JOIN gu USING (term))
"""


def _fm(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return B.forms(spark, sf_dir), B.mels(spark, sf_dir)


@query(_COV + "SELECT * FROM mg")
def match_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.match_glosses(*_fm(spark, sf_dir))


@query(_COV + "SELECT language, i AS input_glosses, m AS matched, i - m AS not_matched, forms FROM (SELECT language, count(*) AS i, count(*) FILTER (gloss IN (SELECT gloss FROM mg)) AS m FROM lg GROUP BY language) JOIN (SELECT language, count(*) AS forms FROM forms GROUP BY language) USING (language)")
def coverage_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.coverage_by_language(*_fm(spark, sf_dir))


@query(_COV + "SELECT * FROM gu")
def gloss_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gloss_uses(*_fm(spark, sf_dir))


@query(_COV + "SELECT * FROM mu")
def mel_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.mel_usage(*_fm(spark, sf_dir))


@query(_COV + "SELECT (SELECT count(*) FROM gl) AS distinct_input_glosses, count(DISTINCT mel_id) AS number_of_mels, count(DISTINCT term) AS number_of_mels_glosses, count(DISTINCT CASE WHEN NOT used THEN mel_id END) AS unused_mels, count(DISTINCT CASE WHEN uses > 0 THEN term END) AS used_mel_glosses, count(DISTINCT term) - count(DISTINCT CASE WHEN uses > 0 THEN term END) AS unused_mel_glosses FROM mu")
def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.coverage_totals(*_fm(spark, sf_dir))


@query(_COV + "SELECT language, gloss FROM lg WHERE gloss NOT IN (SELECT gloss FROM mg)")
def unmatched_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = B.forms(spark, sf_dir)
    return V.unmatched_glosses(forms, B.mels(spark, sf_dir))


@query(_COV + "SELECT gloss, gloss IN (SELECT gloss FROM mg) AS matched FROM gl")
def matched_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overall lists: glosses with and without a match."""
    forms, mels = _fm(spark, sf_dir)
    matched = V.matched_glosses(forms, mels).withColumn("matched", F.lit(True))
    return matched.unionByName(V.unmatched_overall(forms, mels).withColumn("matched", F.lit(False)))


# Comparison


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return B.final_sets(spark, sf_dir), B.other_sets(spark, sf_dir)


_CMP = "cm AS MATERIALIZED (SELECT a.proto AS p1, b.proto AS p2, coalesce(a.proto, b.proto) AS proto, coalesce(a.support, b.support) AS support, CASE WHEN b.proto IS NULL THEN 'only_1' WHEN a.proto IS NULL THEN 'only_2' ELSE 'both' END AS side FROM (SELECT DISTINCT proto, support FROM fin) a FULL JOIN (SELECT DISTINCT proto, support FROM fin2) b ON a.proto = b.proto AND a.support = b.support)"
_TWO = B.sql("other", "")


@query(_with(_TWO, _CMP, "SELECT n1, n2, common, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f_score FROM (SELECT *, CASE WHEN n1 > 0 THEN common / n1 END AS precision, CASE WHEN n2 > 0 THEN common / n2 END AS recall FROM (SELECT count(*) FILTER (side <> 'only_2') AS n1, count(*) FILTER (side <> 'only_1') AS n2, count(*) FILTER (side = 'both') AS common FROM cm))"))
def compare_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare_lexicons(*_two(spark, sf_dir))[1]


@query(_with(_TWO, _CMP, f"SELECT proto, {_SHOW.format('support')} AS members, CASE side WHEN 'only_1' THEN 'lost' ELSE 'gained' END AS change FROM cm WHERE side <> 'both'"))
def sets_lost_gained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sets_lost_gained(*_two(spark, sf_dir)).select("proto", F.translate("key", "\x1e" + SEP, ";|").alias("members"), "change")


_SIDE = "(SELECT support, string_agg(DISTINCT proto, '|' ORDER BY proto) AS proto, string_agg(DISTINCT ids, '|' ORDER BY ids) AS ids, string_agg(DISTINCT mel_id, '|' ORDER BY mel_id) AS mel FROM {0} GROUP BY support)"


@query(B.sql("other", f"SELECT {_SHOW.format('coalesce(a.support, b.support)')} AS members, a.proto AS proto1, b.proto AS proto2, a.ids AS ids1, b.ids AS ids2, a.mel AS mel1, b.mel AS mel2, CASE WHEN b.proto IS NULL THEN 'lost' WHEN a.proto IS NULL THEN 'gained' WHEN a.proto = b.proto AND a.ids = b.ids THEN 'identical' ELSE 'changed' END AS status FROM {_SIDE.format('fin')} a FULL JOIN {_SIDE.format('fin2')} b ON a.support = b.support"))
def diff_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.diff_runs(*_two(spark, sf_dir)).withColumn("members", F.translate("key", "\x1e" + SEP, ";|")).drop("key")


_NODE = "side || ':' || proto || ':' || sha256(array_to_string(support, chr(30)))"
_EDGES = _CMP + f", ed AS MATERIALIZED (SELECT DISTINCT unnest(support) AS form, {_NODE} AS proto_node, side FROM cm WHERE side <> 'both')"


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return C.overlap_graph(C.compare_lexicons(*_two(spark, sf_dir))[0])


@query(_with(_TWO, _EDGES, f"SELECT {_KEY.format('form')} AS node, 'reflex' AS kind, count(*) AS degree FROM ed GROUP BY ALL UNION ALL SELECT proto_node, side, count(*) FROM ed GROUP BY ALL"))
def overlap_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)[1].select(_key("node").alias("node"), "kind", "degree")


@query(_with(_TWO, _EDGES, f"SELECT {_KEY.format('f.form')} AS form, c.proto_node, CASE WHEN ed.form IS NULL THEN '' ELSE 'X' END AS mark FROM (SELECT DISTINCT form FROM ed ORDER BY form LIMIT 200) f CROSS JOIN (SELECT DISTINCT proto_node FROM ed ORDER BY proto_node LIMIT 100) c LEFT JOIN ed ON ed.form = f.form AND ed.proto_node = c.proto_node"))
def overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overlap_matrix(_edges(spark, sf_dir)[0]).select(_key("form").alias("form"), "proto_node", "mark")


#: The runs: a column each.
_RUNS = {"1-URGENT": "a", "2-HIGH": "b", "3-MEDIUM": "c", "4-NOT SPECIFIED": "d", "5-LOW": "e"}
_RUN_SUMS = ", ".join(f"sum(value) FILTER (run = '{k}')::BIGINT AS {v}" for k, v in _RUNS.items())


@query(f"""WITH s AS (SELECT o_orderpriority AS run, o_orderstatus AS language, 'orders' AS stat, count(*) AS value FROM orders GROUP BY ALL UNION ALL SELECT o_orderpriority, NULL, 'orders', count(*) FROM orders GROUP BY ALL)
SELECT stat, language, {_RUN_SUMS} FROM s GROUP BY stat, language""")
def stats_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("language")).agg(F.count("*").alias("value"))
    stats = o.unionByName(o.groupBy("run").agg(F.sum("value").alias("value")).withColumn("language", F.lit(None).cast("string"))).withColumn("stat", F.lit("orders"))
    return C.stats_across_runs(stats, list(_RUNS)).withColumnsRenamed(_RUNS)
