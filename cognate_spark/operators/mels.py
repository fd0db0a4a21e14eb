"""Building meaning elements: groups of glosses that count as one meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gloss import compute_gloss, normalize_gloss_lexical
from ..shared import numbered, settled


def mels_from_tags(rows: DataFrame) -> DataFrame:
    """Rows (analysis `1,2`, gloss `a/b`) → mel_id (the tag), glosses: of each integer tag the parts of its glosses between slashes, as
    `compute_gloss` makes them."""
    tag = F.explode(F.split("analysis", ",")).alias("tag")
    tags = rows.select("gloss", tag).select(F.expr("try_cast(trim(tag) as int)").alias("tag"), F.explode(F.transform(F.split("gloss", "/", -1), compute_gloss)).alias("g")).where("tag is not null")
    return tags.groupBy("tag").agg(F.array_sort(F.collect_set("g")).alias("glosses")).select(F.col("tag").cast("string").alias("mel_id"), "glosses")


def mels_from_colexification(edges: DataFrame, glosses: DataFrame) -> DataFrame:
    """Concept pairs (a, b, families, languages, words) among known glosses (gloss): a → its partners, most attested first; known
    glosses in no pair are groups by themselves. `ord` numbers all groups in that order, those of one gloss that a pair
    has elsewhere included and then left out."""
    known = glosses.select("gloss").distinct()
    pairs = edges.join(known.withColumnRenamed("gloss", "a"), "a", "left_semi").join(known.withColumnRenamed("gloss", "b"), "b", "left_semi")
    rank = F.struct((-F.col("families")).alias("f"), (-F.col("languages")).alias("l"), (-F.col("words")).alias("w"), "a", "b")
    partners = pairs.groupBy("a").agg(F.array_sort(F.collect_list(rank)).alias("r"))
    groups = partners.select(F.col("a").alias("gloss"), F.col("r")[0].alias("first"), F.transform("r", lambda x: x["b"]).alias("others"))
    paired = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    # an end of any edge, known but without a pair of its own
    ends = edges.select(F.col("a").alias("gloss")).unionByName(edges.select(F.col("b").alias("gloss"))).distinct().join(known, "gloss", "left_semi")
    alone = ends.join(groups.select("gloss"), "gloss", "left_anti").join(paired.withColumnRenamed("a", "gloss"), "gloss", "left_anti")
    return groups.select("gloss", F.concat(F.array("gloss"), "others").alias("glosses")).unionByName(alone.select("gloss", F.array("gloss").alias("glosses")))


def mels_from_synsets(glosses: DataFrame, lemmas: DataFrame, first: str = "en", second: str = "fr") -> DataFrame:
    """gloss, glosses, found_in: the glosses that share a synset (synset, lang, lemma) with the gloss, by the first language's lemmas or, where
    it has none, the second's. Glosses are looked up by their normal forms (`normalize_gloss_lexical`: parts, without particles, with
    underscores, with and without hyphens), and lemmas lead back to the glosses as they were written."""
    forms = settled(glosses.select("gloss").distinct().select("gloss", F.explode(normalize_gloss_lexical(F.col("gloss"))).alias("form")), "normal-forms")
    hits = forms.join(lemmas.select(F.col("lemma").alias("form"), "synset", "lang"), "form").select("gloss", "synset", "lang").distinct()
    in_first = hits.where(F.col("lang") == first)
    in_second = hits.where(F.col("lang") == second).join(in_first.select("gloss").distinct(), "gloss", "left_anti")
    found = in_first.unionByName(in_second)
    others = lemmas.select("synset", F.col("lemma").alias("form")).join(forms, "form").select("synset", F.col("gloss").alias("other")).distinct()
    return found.join(others, "synset").groupBy("gloss", F.col("lang").alias("found_in")).agg(F.array_sort(F.collect_set("other")).alias("glosses"))


def mels_not_found(glosses: DataFrame, found: DataFrame) -> DataFrame:
    """Glosses that no group has, as groups nf<n>, numbered after the found ones (found: glosses array)."""
    n_found = found.count()
    rest = glosses.select("gloss").distinct().join(found.select(F.explode("glosses").alias("gloss")).distinct(), "gloss", "left_anti")
    return numbered(rest, ["gloss"], "n").select(F.concat(F.lit("nf"), (F.col("n") + n_found).cast("string")).alias("mel_id"), F.array("gloss").alias("glosses"))


def mels_from_sets(reflexes: DataFrame) -> DataFrame:
    """Hand-made sets (set_id, proto_gloss, gloss) → the set's proto gloss and those of its reflexes."""
    both = F.array_union(F.collect_set("proto_gloss"), F.collect_set("gloss"))
    return reflexes.groupBy("set_id").agg(F.array_sort(F.filter(both, lambda g: g != "")).alias("glosses")).select(F.col("set_id").alias("mel_id"), "glosses")


def distinct_mels(a: DataFrame, b: DataFrame) -> DataFrame:
    """Groups of two or more glosses of either grouping (glosses), each once, numbered."""
    all_ = a.select("glosses").unionByName(b.select("glosses")).select(F.array_sort(F.array_distinct("glosses")).alias("glosses")).where(F.size("glosses") > 1).distinct()
    return numbered(all_, [F.array_join("glosses", "\x1f")], "n").select(F.concat(F.lit("m"), F.col("n").cast("string")).alias("mel_id"), "glosses")


def gloss_language(glosses: DataFrame, lemmas: DataFrame, first: str = "en", second: str = "fr") -> DataFrame:
    """gloss, tag: the language that alone has it as a lemma, xx for both, null for none."""
    langs = lemmas.where(F.col("lang").isin(first, second)).groupBy(F.col("lemma").alias("gloss")).agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    tag = F.when(F.size("langs") > 1, F.lit("xx")).otherwise(F.get("langs", F.lit(0)))
    return glosses.select("gloss").distinct().join(langs, "gloss", "left").select("gloss", F.when(F.col("langs").isNotNull(), tag).alias("tag"))
