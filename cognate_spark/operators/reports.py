"""Statistics and views of a run. Sets have proto, ids, rcn, mel_id, support, attested (arrays of form keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import SEP, set_key


def _part(key: str, i: int) -> Column:
    """language, glyphs or gloss of a form key."""
    return F.get(F.split(F.col(key), SEP), F.lit(i))


def language_stats(forms: DataFrame, projection: DataFrame) -> DataFrame:
    """language, forms, no_parses, reconstructions. projection: one row per form key and reconstruction."""
    per = projection.groupBy("language", "key").agg(F.count_distinct("rcn").alias("n"))
    got = per.groupBy("language").agg(F.count("*").alias("parsed"), F.sum("n").alias("reconstructions"))
    all_ = forms.groupBy("language").agg(F.count_distinct("key").alias("forms"))
    out = all_.join(got, "language", "left").na.fill(0, ["parsed", "reconstructions"])
    return out.select("language", "forms", (F.col("forms") - F.col("parsed")).alias("no_parses"), "reconstructions")


def stats_with_totals(stats: DataFrame) -> DataFrame:
    """Per-language rows and their total, with language null."""
    return stats.rollup("language").agg(*[F.sum(c).alias(c) for c in stats.columns if c != "language"])


def correspondence_usage(sets: DataFrame, corrs: DataFrame) -> DataFrame:
    """corr_id, uses: distinct proto forms that use each correspondence, 0 included, rarest first."""
    used = sets.select(F.explode(F.array_distinct("rcn")).alias("corr_id"), "proto").groupBy("corr_id").agg(F.count_distinct("proto").alias("uses"))
    return corrs.select("corr_id").join(used, "corr_id", "left").na.fill(0, ["uses"]).orderBy("uses", "corr_id")


def correspondences_used(sets: DataFrame, corrs: DataFrame) -> DataFrame:
    return correspondence_usage(sets, corrs).agg(F.count_if(F.col("uses") > 0).alias("used"), F.count("*").alias("correspondences"))


def rule_usage(projection: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, uses: distinct proto forms derived through each rule, 0 included. projection has proto and history."""
    each = projection.select("proto", F.explode(F.flatten(F.transform("history", lambda h: h["rule_ids"]))).alias("rule_id"))
    return rules.select("rule_id").join(each.groupBy("rule_id").agg(F.count_distinct("proto").alias("uses")), "rule_id", "left").na.fill(0, ["uses"])


def reflexes_in_sets(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("attested").alias("form")).agg(F.count_distinct("form").alias("reflexes_in_sets"))


def correspondence_frequency(sets: DataFrame, corrs: DataFrame, languages: list[str]) -> DataFrame:
    """corr_id, row_count (occurrences in id strings), and a count per language, each reflex counting once per occurrence.
    Sets with competing reconstructions (others of the same support) are passed over."""
    key = set_key(F.col("support"))
    alone = sets.withColumn("_key", key).withColumn("_n", F.count("*").over(W.partitionBy("_key"))).where("_n = 1")
    per_language = F.transform(F.array(*map(F.lit, languages)), lambda x: F.size(F.filter("attested", lambda k: F.startswith(k, F.concat(x, F.lit(SEP))))))
    each = alone.select(F.explode("rcn").alias("corr_id"), per_language.alias("n"))
    sums = each.groupBy("corr_id").agg(F.count("*").alias("row_count"), *[F.sum(F.get("n", F.lit(i))).cast("long").alias(x) for i, x in enumerate(languages)])
    return corrs.select("corr_id").join(sums, "corr_id", "left").na.fill(0)


def usage_by_language(sets: DataFrame, corrs: DataFrame, language: str) -> DataFrame:
    return correspondence_usage(sets.where(F.exists("attested", lambda k: F.startswith(k, F.lit(language + SEP)))), corrs)


def word_index(sets: DataFrame) -> DataFrame:
    """language, form, sets (id strings), n: the sets of each attested form."""
    each = sets.select(F.explode("attested").alias("form"), "ids").distinct()
    return each.groupBy("form").agg(F.array_sort(F.collect_set("ids")).alias("sets"), F.count("*").alias("n")).select(_part("form", 0).alias("language"), "form", "sets", "n")


def sets_by_language(sets: DataFrame, languages: list[str]) -> DataFrame:
    """ids, proto, mel_id, and a column per language with its reflexes, comma-joined. Within the row, no shuffle."""
    of = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("attested", lambda k: F.startswith(k, F.lit(x + SEP))), lambda k: F.get(F.split(k, SEP), F.lit(1))))), ", ")
    return sets.select("ids", "proto", "mel_id", set_key(F.col("support")).alias("support_key"), *[of(x).alias(x) for x in languages])


def dump_keys(projection: DataFrame, failures: DataFrame, limit: int = 100_000) -> DataFrame:
    """Lines (form, proto, ids): the first limit + 1 in order, then the failures with proto null."""
    top = projection.select("key", "proto", "ids").distinct().orderBy("key", "proto", "ids").limit(limit + 1)
    none = F.lit(None).cast("string")
    return top.unionByName(failures.select("key", none.alias("proto"), none.alias("ids")).distinct())


def run_summary(forms: DataFrame, failures: DataFrame, raw_sets: DataFrame, sets: DataFrame, singletons: DataFrame) -> DataFrame:
    """stat, value: lexicons, reflexes, reflexes_in_sets, subsets_tossed, isolates, failures, sets (distinct supports). raw_sets:
    before subsets were dropped and derivations picked."""
    key = set_key(F.col("support"))
    in_sets = sets.select(F.explode("attested").alias("form")).distinct()
    one = lambda df, name: df.select(F.lit(name).alias("stat"), F.col("value").cast("long").alias("value"))
    parts = [
        one(forms.agg(F.count_distinct("language").alias("value")), "lexicons"),
        one(forms.agg(F.count_distinct("key").alias("value")), "reflexes"),
        one(in_sets.agg(F.count("*").alias("value")), "reflexes_in_sets"),
        one(raw_sets.select(key.alias("k")).distinct().join(sets.select(key.alias("k")).distinct(), "k", "left_anti").agg(F.count("*").alias("value")), "subsets_tossed"),
        one(singletons.select(F.explode("attested").alias("form")).distinct().join(in_sets, "form", "left_anti").agg(F.count("*").alias("value")), "isolates"),
        one(failures.agg(F.count_distinct("key").alias("value")), "failures"),
        one(sets.agg(F.count_distinct(key).alias("value")), "sets"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def band_counts(bands: DataFrame) -> DataFrame:
    """band, lines; the total has band null."""
    return bands.rollup("band").agg(F.count("*").alias("lines"))


def list_sets(sets: DataFrame, daughters: list[str]) -> DataFrame:
    """Sets by id string, members in daughter order."""
    order = F.array(*map(F.lit, daughters))
    placed = F.transform("attested", lambda k: F.struct(F.array_position(order, F.get(F.split(k, SEP), F.lit(0))).alias("at"), k.alias("k")))
    return sets.select("ids", "proto", "mel_id", F.transform(F.array_sort(placed), lambda x: x["k"]).alias("members")).orderBy("ids", "mel_id")


def top_isolates(isolates: DataFrame, k: int) -> DataFrame:
    """form, rank, ids: at most k + 1 reconstructions of each isolate. Within the row, no shuffle."""
    return isolates.select("form", F.posexplode(F.slice(F.array_sort("ids"), 1, k + 1)).alias("pos", "ids")).select("form", (F.col("pos") + 1).alias("rank"), "ids")
