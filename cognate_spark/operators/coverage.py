"""How far the glosses of lexicons are covered by a list of meaning elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexicon import glosses_by_language
from .sets import gloss_candidates


def mel_terms(mels: DataFrame) -> DataFrame:
    return mels.select(F.explode("glosses").alias("term")).distinct()


def match_glosses(glosses: DataFrame, mels: DataFrame) -> DataFrame:
    """gloss, term: a gloss that is listed matches itself alone; any other all its normalised candidates that are listed."""
    hits = gloss_candidates(glosses.select("gloss").distinct()).join(mel_terms(mels), "term")
    exact = hits.where("exact").select("gloss", "term")
    rest = hits.where("not exact").select("gloss", "term").join(exact.select("gloss"), "gloss", "left_anti")
    return exact.unionByName(rest).distinct()


def coverage_by_language(forms: DataFrame, mels: DataFrame) -> DataFrame:
    """language, input_glosses, matched, not_matched, forms."""
    matched = match_glosses(forms.where("gloss != ''").select("gloss"), mels).select("gloss").distinct().withColumn("hit", F.lit(True))
    per = glosses_by_language(forms).join(matched, "gloss", "left").groupBy("language").agg(F.count("*").alias("input_glosses"), F.count("hit").alias("matched"))
    counts = forms.groupBy("language").agg(F.count("*").alias("forms"))
    out = counts.join(per, "language", "left").na.fill(0, ["input_glosses", "matched"])
    return out.select("language", "input_glosses", "matched", (F.col("input_glosses") - F.col("matched")).alias("not_matched"), "forms")


def gloss_uses(forms: DataFrame, mels: DataFrame) -> DataFrame:
    """term, uses: matches of each mel gloss over (language, gloss)."""
    pairs = glosses_by_language(forms)
    return pairs.join(match_glosses(pairs, mels), "gloss").groupBy("term").agg(F.count("*").alias("uses"))


def mel_usage(forms: DataFrame, mels: DataFrame) -> DataFrame:
    """mel_id, term, uses (0 included), used: whether the mel is used at all."""
    each = mels.select("mel_id", F.explode("glosses").alias("term")).join(gloss_uses(forms, mels), "term", "left").na.fill(0, ["uses"])
    used = each.groupBy("mel_id").agg((F.max("uses") > 0).alias("used"))
    return each.join(used, "mel_id").select("mel_id", "term", "uses", "used")


def coverage_totals(forms: DataFrame, mels: DataFrame) -> DataFrame:
    """One row of totals; unused mel glosses are those that nothing matched."""
    usage = mel_usage(forms, mels)
    m = usage.agg(F.count_distinct("mel_id").alias("number_of_mels"), F.count_distinct("term").alias("number_of_mels_glosses"), F.count_distinct(F.when(~F.col("used"), F.col("mel_id"))).alias("unused_mels"), F.count_distinct(F.when(F.col("uses") > 0, F.col("term"))).alias("used_mel_glosses"))
    g = forms.where("gloss != ''").agg(F.count_distinct("gloss").alias("distinct_input_glosses"))
    return g.crossJoin(m).withColumn("unused_mel_glosses", F.col("number_of_mels_glosses") - F.col("used_mel_glosses"))


def unmatched_glosses(forms: DataFrame, mels: DataFrame) -> DataFrame:
    """language, gloss without a match."""
    pairs = glosses_by_language(forms)
    return pairs.join(match_glosses(pairs, mels).select("gloss").distinct(), "gloss", "left_anti").select("language", "gloss")


def unmatched_overall(forms: DataFrame, mels: DataFrame) -> DataFrame:
    """gloss: distinct ones of all languages without a match."""
    glosses = forms.where("gloss != ''").select("gloss").distinct()
    return glosses.join(match_glosses(glosses, mels).select("gloss").distinct(), "gloss", "left_anti")


def matched_glosses(forms: DataFrame, mels: DataFrame) -> DataFrame:
    return match_glosses(forms.where("gloss != ''").select("gloss"), mels).select("gloss").distinct()
