"""Queries of the XML readers: tables derived from the driver's are written as XML to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..sources import readers as R
from ..sources import writers as X
from ..sources.xml_scan import elements
from . import testbed as B
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("WITH " + B.FORMS + " SELECT language, form_id, CASE WHEN length(glyphs) % 5 = 0 THEN '' ELSE glyphs END AS glyphs, CASE WHEN length(glyphs) % 3 = 0 THEN '<' || gloss || '> & more' ELSE 'to ' || gloss END AS gloss FROM forms")
def read_lexicon_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' words as lexicons: some have no headword, two of them, or a normalised gloss with characters to escape."""
    n = F.length("glyphs")
    hw = F.when(n % 5 == 0, F.lit(None)).when(n % 4 == 0, F.array("glyphs", F.lit("second"))).otherwise(F.array("glyphs"))
    ngl = F.when(n % 3 == 0, F.array(F.concat(F.lit("<"), "gloss", F.lit("> & more"))))
    rows = B.forms(spark, sf_dir).select("language", "form_id", hw.alias("hw"), F.array(F.concat(F.lit("to "), "gloss")).alias("gl"), ngl.alias("ngl"))
    path = _folder(spark, "lexicons")
    X.publish_lexicons_xml(rows, path)
    return R.read_lexicon_xml(spark, f"{path}/*")


_CORRS = """WITH c AS (SELECT p_partkey, p_name AS proto, p_type || ' , ' || p_brand AS aa, CASE WHEN p_partkey % 4 <> 0 THEN '' ELSE NULL END AS bb, p_size FROM part)
SELECT row_number() OVER (ORDER BY p_partkey)::INT AS ord, p_partkey::VARCHAR AS corr_id, CASE WHEN p_partkey % 2 = 0 THEN 'x+y' END AS ctx_l, CASE WHEN p_partkey % 3 = 0 THEN '#' END AS ctx_r,
  CASE WHEN p_size % 2 = 0 THEN 'C+V' ELSE 'C' END AS syll, proto, 'aa:' || replace(aa, ' , ', '+') || CASE WHEN bb IS NULL THEN '' ELSE ';bb:' END AS daughters FROM c"""


@query(_CORRS)
def read_corrs_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correspondence a part, in as many files as there are tasks; a quarter has one language only."""
    k, words = F.col("p_partkey"), lambda *x: F.array(*map(F.lit, x))
    bb = F.when(k % 4 != 0, F.create_map(F.lit("bb"), F.array(F.lit("")))).otherwise(F.create_map().cast("map<string,array<string>>"))
    corrs = B.read(spark, sf_dir, "part").select(k.alias("ord"), k.cast("string").alias("corr_id"), F.when(k % 2 == 0, words(" x", "y ")).alias("ctx_l"), F.when(k % 3 == 0, words("#")).alias("ctx_r"), F.when(F.col("p_size") % 2 == 0, words("C", "V")).otherwise(words("C")).alias("syll"), F.col("p_name").alias("proto"), F.map_concat(F.create_map(F.lit("aa"), F.array("p_type", "p_brand")), bb).alias("daughters"))
    path = _folder(spark, "corrs")
    X.publish_in_order(X.corrs_xml(corrs), path, "corr", "tableOfCorr")
    daughters = F.array_join(F.transform(F.array_sort(F.map_entries("daughters")), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "+"))), ";")
    joined = lambda c: F.array_join(c, "+").alias(c)
    return R.read_corrs_xml(spark, path).select("ord", "corr_id", joined("ctx_l"), joined("ctx_r"), joined("syll"), "proto", daughters.alias("daughters"))


@query("SELECT row_number() OVER (ORDER BY p_partkey)::INT AS ord, 'r' || p_partkey AS rule_id, CASE WHEN p_partkey % 2 = 0 THEN 'a+e' END AS ctx_l, CASE WHEN p_partkey % 3 = 0 THEN '#' END AS ctx_r, p_name AS input, p_type || '+' || p_brand AS outcome, 'aa+bb' AS languages, p_size::INT AS stage FROM part")
def read_rules_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, words = F.col("p_partkey"), lambda *x: F.array(*map(F.lit, x))
    rules = B.read(spark, sf_dir, "part").select(k.alias("ord"), F.concat(F.lit("r"), k.cast("string")).alias("rule_id"), F.when(k % 2 == 0, words("a", "e")).alias("ctx_l"), F.when(k % 3 == 0, words("#")).alias("ctx_r"), F.col("p_name").alias("input"), F.array("p_type", "p_brand").alias("outcome"), words("aa", "bb").alias("languages"), F.col("p_size").cast("int").alias("stage"))
    path = _folder(spark, "rules")
    X.publish_in_order(X.rules_xml(rules), path, "rule", "tableOfCorr")
    joined = lambda c: F.array_join(c, "+").alias(c)
    return R.read_rules_xml(spark, path).select("ord", "rule_id", joined("ctx_l"), joined("ctx_r"), "input", joined("outcome"), joined("languages"), "stage")


@query("SELECT row_number() OVER (ORDER BY p_partkey)::INT AS ord, p_partkey::VARCHAR AS quirk_id, '' AS source_id, p_type AS language, p_name AS form, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS gloss, 'alt ' || p_name AS alternative, '' AS slot, p_size::VARCHAR AS value, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'one|' || p_brand END AS notes FROM part")
def read_quirks_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = B.read(spark, sf_dir, "part").select(k.alias("ord"), k.cast("string").alias("_id"), F.col("p_type").alias("lg"), F.col("p_name").alias("lx"), F.when(k % 3 != 0, F.col("p_brand")).alias("gl"), F.concat(F.lit("alt "), "p_name").alias("alternative"), F.col("p_size").cast("string").alias("analysis_value"), F.when(k % 2 != 0, F.array(F.lit("one"), "p_brand")).alias("note"))
    path = _folder(spark, "quirks")
    X.publish_in_order(rows, path, "quirk", "tableOfCorr")
    return R.read_quirks_xml(spark, path).withColumn("notes", F.array_join("notes", "|"))


@query("""WITH c AS (SELECT p_brand, p_type, string_agg(DISTINCT p_name, '+' ORDER BY p_name) AS members, min(p_partkey) AS k FROM part GROUP BY ALL)
SELECT p_brand AS canon, string_agg(p_type || '=' || members, ';' ORDER BY p_type) AS classes, CASE WHEN min(k) % 2 = 0 THEN 'w+h' ELSE '' END AS supra, CASE WHEN min(k) % 3 = 0 THEN 'glyphs' ELSE 'constituent' END AS mode FROM c GROUP BY p_brand""")
def read_canon_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's parameters a brand, with a class a type of its parts."""
    value = lambda c: F.struct(c.alias("_value"))
    each = B.read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ", ").alias("members"), F.min("p_partkey").alias("k"))
    rows = each.groupBy("p_brand").agg(F.collect_list(F.struct(F.col("p_type").alias("_name"), F.col("members").alias("_value"))).alias("class"), F.min("k").alias("k"))
    rows = rows.select("k", "class", value(F.col("p_brand")).alias("canon"), F.when(F.col("k") % 2 == 0, value(F.lit("w, h"))).alias("spec"), F.when(F.col("k") % 3 == 0, value(F.lit("glyphs"))).alias("context_match_type"))
    path = _folder(spark, "canons")
    X.publish_in_order(rows, path, "parameters", "tableOfCorr", "k")
    classes = F.array_join(F.transform(F.array_sort(F.map_entries("classes")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), ";")
    return R.canons_from_xml(elements(spark, path, "parameters")).select("canon", classes.alias("classes"), F.array_join("supra", "+").alias("supra"), "mode")


def _mel_text(glosses: Column) -> Column:
    return F.concat(F.lit("<mel id='"), F.col("mel_id"), F.lit("'>"), F.array_join(F.transform(glosses, lambda g: F.concat(F.lit("<gl>"), g, F.lit("</gl>"))), ""), F.lit("</mel>"))


@query(B.sql("mels", "SELECT mel_id, string_agg(term, '|' ORDER BY term) AS glosses FROM mt GROUP BY mel_id UNION ALL SELECT 'none', ''"))
def read_mels_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meaning elements as a file of lines, beside an empty one that closes itself."""
    path = _folder(spark, "mels")
    text = B.mels(spark, sf_dir).select(_mel_text(F.col("glosses")).alias("value")).unionByName(spark.range(1).select(F.lit("<semantics><!-- <mel id='no'/> --><mel id='none'/>").alias("value")))
    X.publish(text, path, "text")
    return R.read_mels_xml(spark, path).select("mel_id", F.array_join(F.array_sort("glosses"), "|").alias("glosses"))


@query("""WITH i AS (SELECT p_partkey, unnest([p_type, p_brand, p_name]) AS from_seg, unnest([0, 1, 2]) AS j, p_brand AS language, p_size::VARCHAR AS to_seg FROM part)
SELECT row_number() OVER (ORDER BY p_partkey, j)::INT AS ord, language, from_seg, to_seg FROM i""")
def read_fuzzy_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("_dial"), F.col("p_size").cast("string").alias("_to"), F.array("p_type", "p_brand", "p_name").alias("from"))
    path = _folder(spark, "fuzzy")
    X.publish_in_order(rows, path, "item", "fuzzy")
    return R.read_fuzzy_xml(spark, path)
