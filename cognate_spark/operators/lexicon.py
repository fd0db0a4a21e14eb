"""Preparing lexicons: usable forms, subsets, variants, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.gloss import natural_key
from ..shared import carried, segmented


def usable_forms(forms: DataFrame) -> DataFrame:
    return forms.where(F.col("glyphs").isNotNull() & ~F.trim("glyphs").isin("", "?"))


def known_languages(forms: DataFrame, languages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forms of the table's languages; and (language, forms) of those left out. languages: language."""
    out = forms.join(languages, "language", "left_anti").groupBy("language").agg(F.count("*").alias("forms"))
    return forms.join(languages, "language", "left_semi"), out


def select_languages(forms: DataFrame, order: list[str]) -> DataFrame:
    """Forms of a choice of languages, with `language_order` from 1."""
    return forms.where(F.col("language").isin(order)).withColumn("language_order", F.array_position(F.array(*map(F.lit, order)), F.col("language")))


def filter_bands(bands: DataFrame, on_bands: list[str], pattern: str, keep: list[str] | None = None, drop: list[str] | None = None, reject: bool = False) -> DataFrame:
    """Entries with a matching band (or, if reject, without one), cut to the bands asked for; head and sub-head lines
    (line_kind head, sub) always stay. One shuffle by entry."""
    hit = F.max((F.col("band").isin(on_bands) & F.col("content").rlike(pattern)).cast("int")).over(W.partitionBy("file", "entry_no"))
    chosen = bands.withColumn("hit", hit).where(F.col("hit") == (0 if reject else 1)).drop("hit")
    wanted = F.lit(True) if keep is None and drop is None else F.col("band").isin(keep) if keep is not None else ~F.col("band").isin(drop)
    return chosen.where(wanted | F.col("line_kind").isin("head", "sub"))


def section_of_entry(lines: DataFrame, default: str = "0") -> DataFrame:
    """Entries (line_kind head with content) with the last `hdr` line before them in their file. Files are gone through in segments, which
    hand on their last header."""
    parts = segmented(lines, "file", "line_no", "sections")
    header = F.when(F.col("band") == "hdr", F.col("content"))
    before = W.partitionBy("file", "_seg").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    own = parts.withColumn("_own", F.last(header, ignorenulls=True).over(before))
    last = parts.groupBy("file", "_seg").agg(F.max_by(header, F.when(header.isNotNull(), F.col("line_no"))).alias("_header"))
    ends = last.withColumn("_above", F.last("_header", ignorenulls=True).over(W.partitionBy("file").orderBy("_seg").rowsBetween(W.unboundedPreceding, -1))).where("_above is not null")
    heads = carried(own.where((F.col("line_kind") == "head") & (F.trim("content") != "")), ends, "file", ["_above"])
    return heads.select(*lines.columns, F.coalesce("_own", "_above", F.lit(default)).alias("section"))


def latest_fuzzy(fuzzy: DataFrame) -> DataFrame:
    """One target for (language, from_seg): the last in file order."""
    return fuzzy.groupBy("language", "from_seg").agg(F.max_by("to_seg", "ord").alias("to_seg"))


def ambiguous_fuzzy(fuzzy: DataFrame) -> DataFrame:
    """(language, from_seg) with several targets."""
    return fuzzy.groupBy("language", "from_seg").agg(F.array_sort(F.collect_set("to_seg")).alias("targets")).where(F.size("targets") > 1)


def fuzzy_forms(forms: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """Extra forms whose glyphs, rewritten from left to right by the language's longest matching segments, differ.

    The language's segments become one pattern, longest first, and a map; a mapping is a small table, so it is broadcast
    by its size as Spark sees it. Columns: those of forms, parse_glyphs, kind.
    """
    quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    segs = F.array_sort(F.collect_list(F.struct((-F.length("from_seg")).alias("n"), F.col("from_seg").alias("f"), F.col("to_seg").alias("t"))))
    by_language = latest_fuzzy(fuzzy).where("from_seg != ''").groupBy("language").agg(segs.alias("segs"))
    by_language = by_language.select("language", F.concat(F.lit("(?s)("), F.array_join(F.transform("segs", lambda s: quoted(s["f"])), "|"), F.lit("|.)")).alias("pattern"), F.map_from_entries(F.transform("segs", lambda s: F.struct(s["f"], s["t"]))).alias("map"))
    parts = F.regexp_extract_all("glyphs", F.col("pattern"), F.lit(1))
    made = F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(F.col("map"), x), x)), "")
    out = forms.join(by_language, "language").withColumn("parse_glyphs", made).drop("pattern", "map")
    return out.where(F.col("parse_glyphs") != F.col("glyphs")).withColumn("kind", F.lit("fuzzy"))


def quirky_forms(forms: DataFrame, quirks: DataFrame) -> DataFrame:
    """Extra forms to be parsed as the alternative of their quirk; the last quirk of a (language, form, gloss) counts."""
    last = quirks.groupBy(F.col("language"), F.col("form").alias("glyphs"), "gloss").agg(F.max_by("alternative", "ord").alias("parse_glyphs"))
    return forms.join(last, ["language", "glyphs", "gloss"]).select(*forms.columns, "parse_glyphs", F.lit("quirk").alias("kind"))


def with_variants(forms: DataFrame, fuzzy: DataFrame | None = None, quirks: DataFrame | None = None) -> DataFrame:
    """All forms to parse: attested ones as they are (kind modern), and the variants beside them."""
    out = forms.select("*", F.col("glyphs").alias("parse_glyphs"), F.lit("modern").alias("kind"))
    for more in ([fuzzy_forms(forms, fuzzy)] if fuzzy is not None else []) + ([quirky_forms(forms, quirks)] if quirks is not None else []):
        out = out.unionByName(more)
    return out


def all_glosses(forms: DataFrame) -> DataFrame:
    return forms.where(F.coalesce("gloss", F.lit("")) != "").select("gloss").distinct()


def glosses_by_language(forms: DataFrame) -> DataFrame:
    return forms.where(F.coalesce("gloss", F.lit("")) != "").select("language", "gloss").distinct()


def natural_sort(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(natural_key(F.col(column)), column)


def search_sets(sets: DataFrame, language: str = "", form: str = "", gloss: str = "") -> DataFrame:
    """Sets in which one member (struct with language, glyphs, gloss in `members`) holds all texts asked for, in any case."""

    def fits(m: Column) -> Column:
        tests = [F.contains(F.lower(F.coalesce(m[k], F.lit(""))), F.lit(v.strip().lower())) for k, v in (("language", language), ("glyphs", form), ("gloss", gloss)) if v.strip()]
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out

    return sets.where(F.exists("members", fits))
