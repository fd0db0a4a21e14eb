"""Writers: each gives the table to write, in the layout that the readers take; `save` puts it somewhere."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gloss import format_context
from ..shared import numbered


def save(df: DataFrame, path: str, kind: str = "parquet", partition: str | None = None, **options: str) -> None:
    """parquet, json, csv (options: sep, header) or xml (options: rowTag, rootTag)."""
    out = df.write.format(kind).options(**options)
    (out.partitionBy(partition) if partition else out).save(path)


def publish(df: DataFrame, path: str, kind: str = "parquet", partition: str | None = None, **options: str) -> None:
    """As `save`, but whole or not at all: written to a folder beside the path, which takes its name in the end. The path must
    not be there yet."""
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    save(df, staging, kind, partition, **options)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(hadoop.Path(path)) or not files.rename(hadoop.Path(staging), hadoop.Path(path)):
        files.delete(hadoop.Path(staging), True)
        raise FileExistsError(f"{path} is there already")


def lexicon_xml(forms: DataFrame) -> DataFrame:
    """Forms (with hw, gl, ngl as arrays, or glyphs and gloss) as rows for XML: rowTag entry."""
    one = lambda name, plain: F.col(name) if name in forms.columns else F.array(plain)
    ngl = F.col("ngl") if "ngl" in forms.columns else F.lit(None).cast("array<string>")
    return forms.select(F.col("form_id").alias("_id"), one("gl", "gloss").alias("gl"), ngl.alias("ngl"), one("hw", "glyphs").alias("hw"))


def publish_lexicons_xml(forms: DataFrame, path: str) -> None:
    """A folder of XML files a language (some dozens), each with the language in its root: path/<language>."""
    for (language,) in sorted(forms.select("language").distinct().collect()):
        publish(lexicon_xml(forms.where(F.col("language") == language)), f"{path}/{language}", "xml", rowTag="entry", rootTag=f'lexicon dialecte="{language}"')


def corrs_xml(corrs: DataFrame) -> DataFrame:
    """Correspondences as rows for XML: rowTag corr, rootTag tableOfCorr."""
    proto = F.struct(F.col("proto").alias("_VALUE"), F.array_join("syll", ",").alias("_syll"), F.array_join("ctx_l", ",").alias("_contextL"), F.array_join("ctx_r", ",").alias("_contextR"))
    modern = F.transform(F.map_entries("daughters"), lambda e: F.struct(e["key"].alias("_dialecte"), e["value"].alias("seg")))
    return corrs.select("ord", F.col("corr_id").alias("_num"), proto.alias("proto"), modern.alias("modern"))


def rules_xml(rules: DataFrame) -> DataFrame:
    """Rules as rows for XML: rowTag rule, rootTag tableOfCorr."""
    input_ = F.struct(F.col("input").alias("_VALUE"), F.array_join("ctx_l", ",").alias("_contextL"), F.array_join("ctx_r", ",").alias("_contextR"))
    outcome = F.struct(F.array_join("outcome", ",").alias("_VALUE"), F.array_join("languages", ",").alias("_languages"))
    return rules.select("ord", F.col("rule_id").alias("_num"), F.col("stage").alias("_stage"), input_.alias("input"), outcome.alias("outcome"))


def publish_in_order(rows: DataFrame, path: str, row_tag: str, root_tag: str, order: str = "ord") -> None:
    """Rows for XML in files whose names and contents follow the order, which is left out itself."""
    publish(rows.repartitionByRange(order).sortWithinPartitions(order).drop(order), path, "xml", rowTag=row_tag, rootTag=root_tag)


def write_lexicon(forms: DataFrame, order: str = "ord") -> DataFrame:
    """Forms renumbered <language>.n in input order."""
    placed = numbered(forms, [order], "n", within=("language",))
    return placed.select("language", F.concat(F.lower("language"), F.lit("."), F.col("n").cast("string")).alias("entry_id"), "glyphs", "gloss")


def _joined(col: str) -> Column:
    return F.coalesce(F.array_join(col, ", "), F.lit(""))


def write_corrs_tsv(corrs: DataFrame, languages: list[str]) -> DataFrame:
    """Editor layout: ID, Context, Slot, *, a column per language, in table order."""
    cells = [F.coalesce(F.array_join(F.col("daughters")[x], ", "), F.lit("")).alias(x) for x in languages]
    return corrs.orderBy("ord").select(F.col("corr_id").alias("ID"), format_context(F.col("ctx_l"), F.col("ctx_r")).alias("Context"), F.array_join("syll", ",").alias("Slot"), F.col("proto").alias("*"), *cells)


def write_rules_tsv(rules: DataFrame) -> DataFrame:
    return rules.orderBy("ord").select(F.col("rule_id").alias("RID"), format_context(F.col("ctx_l"), F.col("ctx_r")).alias("Context"), F.col("input").alias("Input"), _joined("outcome").alias("Outcome"), _joined("languages").alias("Languages"), F.col("stage").alias("Stage"))


def write_quirks_tsv(quirks: DataFrame) -> DataFrame:
    return quirks.orderBy("ord").select(F.col("language").alias("Language"), F.col("form").alias("Form"), F.col("gloss").alias("Gloss"), F.col("alternative").alias("Alternative"), _joined("notes").alias("Notes"))


def write_sets(sets: DataFrame, language_order: list[str]) -> DataFrame:
    """Nested sets (members: array of structs with language, glyphs, gloss, form_id), reflexes in language order, numbered by
    their id string."""
    order = F.array(*map(F.lit, language_order))
    by_place = F.transform("members", lambda m: F.struct(F.array_position(order, m["language"]).alias("place"), m["language"].alias("language"), m["glyphs"].alias("glyphs"), m["gloss"].alias("gloss"), m["form_id"].alias("form_id")))
    reflexes = F.transform(F.array_sort(by_place), lambda m: F.struct(m["language"].alias("lg"), m["glyphs"].alias("lx"), m["gloss"].alias("gl"), m["form_id"].alias("id")))
    return sets.select("set_id", "ids", "proto", "mel_id", reflexes.alias("reflexes"))


def write_mels(groups: DataFrame, order: str = "ord", prefix: str = "x") -> DataFrame:
    """Gloss groups (ord, glosses) as numbered meaning elements x0001…, with more places from the ten thousandth on."""
    n = F.col("n").cast("string")
    return numbered(groups, [order], "n").select(F.concat(F.lit(prefix), F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)).alias("mel_id"), "glosses")


def search_docs(bands: DataFrame) -> DataFrame:
    """Entry bands (entry_id, language, band, content, line_no) → id, language_s and a map <band>_ss → contents in order."""
    per = bands.groupBy("entry_id", "language", "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"]).alias("c"))
    fields = F.map_from_entries(F.collect_list(F.struct(F.concat("band", F.lit("_ss")), "c")))
    return per.groupBy(F.col("entry_id").alias("id"), F.col("language").alias("language_s")).agg(fields.alias("fields"))
