"""Readers: XML, wide tables, band files, tables of correspondences. All give the canonical schemas.

XML files are scanned element by element (`xml_scan`), tables and band files come as DataFrames already read, so any source of such
rows will do; what follows is explode, unpivot and arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.gloss import parse_context
from ..shared import carried, numbered, segmented, settled
from .xml_scan import Paths, elements, in_order, parsed, root_attribute, with_root_attribute


def _first(col: str) -> Column:
    return F.get(F.col(col), F.lit(0))


def _list(col: Column | str) -> Column:
    """Comma list, stripped; null for null or blank."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(F.trim(F.coalesce(col, F.lit(""))) != "", F.transform(F.split(col, ","), lambda x: F.trim(x)))


ENTRY = "_id string, hw array<string>, gl array<string>, ngl array<string>"
CORR = "_num string, proto struct<_VALUE:string,_syll:string,_contextL:string,_contextR:string>, modern array<struct<_dialecte:string,seg:array<string>>>"
_SIDE = "struct<_VALUE:string,_contextL:string,_contextR:string>"
RULE = f"_num string, _stage int, input {_SIDE}, outcome struct<_VALUE:string,_languages:string>"
QUIRK = "_id string, source_id string, lg string, lx string, gl string, alternative string, analysis_slot string, analysis_value string, note array<string>"
_VALUE = "struct<_value:string>"
PARAMETERS = f"class array<struct<_name:string,_value:string>>, canon {_VALUE}, spec {_VALUE}, context_match_type {_VALUE}"
MEL = "_id string, gl array<struct<_VALUE:string,_pivot:string>>"
ITEM = "_dial string, _to string, from array<string>"


def read_lexicon_xml(spark: SparkSession, paths: Paths) -> DataFrame:
    """forms; glyphs are the first hw or '', gloss the first ngl or else gl, the language is said by the file's root. Files are
    read in splits, entry by entry."""
    e = parsed(elements(spark, paths, "entry"), ENTRY)
    e = with_root_attribute(e.select("file", "e.*"), root_attribute(spark, paths, "lexicon", "dialecte", "entry"), "language")
    return e.select("language", F.col("_id").alias("form_id"), F.coalesce(_first("hw"), F.lit("")).alias("glyphs"), F.coalesce(_first("ngl"), _first("gl")).alias("gloss"))


def read_lexicon_wide(df: DataFrame, gloss_col: str, id_col: str | None, language_cols: list[str]) -> DataFrame:
    """forms of a table with one column per language; cells are stripped, empty ones are no forms."""
    ids = F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")
    base = df.select(ids.alias("form_id"), F.trim(F.col(gloss_col)).alias("gloss"), *[F.col(c).cast("string").alias(c) for c in language_cols])
    long = base.unpivot(["form_id", "gloss"], language_cols, "language", "glyphs")
    return long.select("language", "form_id", F.trim("glyphs").alias("glyphs"), "gloss").where("glyphs != ''")


def drop_comment_rows(df: DataFrame, first: str | None = None) -> DataFrame:
    """Rows whose first cell holds a # anywhere go."""
    cell = F.col(first or df.columns[0])
    return df.where(~F.contains(F.coalesce(cell, F.lit("")), F.lit("#")))


def read_tsv(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table whose header is the first line without # in its first cell. The header is one line, taken by the driver; lines like it
    further down are data. The path is one file."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    lines = drop_comment_rows(text.withColumn("first", F.split("value", sep).getItem(0)), "first")
    header = lines.select("value", "_block", "_row").orderBy("_block", "_row").first()
    if header is None:
        raise ValueError(f"{path}: no header")
    names = [x.strip() for x in header.value.split(sep)]
    cells = F.split("value", sep)
    data = lines.where((F.col("_block") != header["_block"]) | (F.col("_row") != header["_row"]))
    return data.select(*[F.get(cells, F.lit(i)).alias(n or f"_{i}") for i, n in enumerate(names)])


def read_lexicon_bands(lines: DataFrame) -> DataFrame:
    """Band text (file, line_no, value) → one row a line: entry, sub-entry and mode numbers, band and content.

    `.hw` (or mar, tag, sya) begins an entry, `..` a sub-entry, leading digits are a mode; blank lines go, lines that
    begin with * are comments. Entry and sub-entry numbers are running sums within a file, made in segments of it, so that a large
    file is read and counted by many tasks.
    """
    v = F.rtrim(F.col("value"), F.lit(" \t\r\n"))
    kind = F.when(F.trim(v) == "", "blank").when(v.startswith("*"), "comment").when(v.startswith(".."), "sub").when(v.rlike(r"^\."), "head").otherwise("band")
    body = F.regexp_replace(v, r"^\.{1,2}", "")
    lines = segmented(lines.select("file", "line_no", v.alias("v"), kind.alias("line_kind"), body.alias("body")).where("line_kind != 'blank'"), "file", "line_no", "band-lines")
    one = lambda k: F.sum((F.col("line_kind") == k).cast("long"))
    up = W.partitionBy("file", "_seg").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    inside = W.partitionBy("file", "_seg", "entry").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    counted = settled(lines.withColumn("entry", one("head").over(up)).withColumn("sub", one("sub").over(inside)), "band-counts")
    # a segment hands on its entries, and the sub-entries since its last head or, without one, those handed to it as well
    last = counted.groupBy("file", "_seg").agg(F.max("entry").alias("heads"), F.max_by("sub", "line_no").alias("tail"))
    by_file = W.partitionBy("file").orderBy("_seg")
    since = last.withColumns({"before": F.sum("heads").over(by_file.rowsBetween(W.unboundedPreceding, -1)), "run": F.sum((F.col("heads") > 0).cast("int")).over(by_file)})
    since = since.withColumn("so_far", F.sum("tail").over(W.partitionBy("file", "run").orderBy("_seg"))).withColumn("subs", F.lag("so_far").over(by_file))
    numbered_lines = carried(counted, since.where("before is not null"), "file", ["before", "subs"])
    entry = F.col("entry") + F.coalesce("before", F.lit(0))
    sub = F.col("sub") + F.when(F.col("entry") == 0, F.coalesce("subs", F.lit(0))).otherwise(0)
    mode = F.regexp_extract("body", r"^(\d+)", 1)
    band = F.when(F.col("line_kind") == "comment", F.lit("comment")).otherwise(F.regexp_extract("body", r"^\d*([A-Za-z]+)", 1))
    content = F.when(F.col("line_kind") == "comment", F.trim(F.expr("substring(v, 2)"))).otherwise(F.trim(F.regexp_extract("body", r"^\d*[A-Za-z]*[\t ]+(.*)$", 1)))
    return numbered_lines.select("file", "line_no", entry.alias("entry_no"), sub.alias("sub_no"), F.when(mode != "", mode.cast("int")).otherwise(F.lit(0)).alias("mode_level"), band.alias("band"), content.alias("content"), "line_kind")


def band_entry_ids(bands: DataFrame, language: Column) -> DataFrame:
    """bands with `entry_id` = <language>.<entry number>."""
    return bands.withColumn("entry_id", F.concat(F.lower(language), F.lit("."), F.col("entry_no").cast("string")))


def read_corrs_xml(spark: SparkSession, paths: Paths) -> DataFrame:
    """corrs in file order; a language without a `modern` element has no segments."""
    c = parsed(in_order(elements(spark, paths, "corr")), CORR).select("ord", "e.*")
    segments = lambda m: F.coalesce(F.transform(m["seg"], lambda s: F.trim(F.coalesce(s, F.lit("")))), F.array().cast("array<string>"))
    pairs = F.map_from_entries(F.transform("modern", lambda m: F.struct(m["_dialecte"], segments(m))))
    return c.select(F.col("ord").cast("int").alias("ord"), F.col("_num").alias("corr_id"), _list("proto._contextL").alias("ctx_l"), _list("proto._contextR").alias("ctx_r"), _list("proto._syll").alias("syll"), F.trim("proto._VALUE").alias("proto"), F.coalesce(pairs, F.create_map().cast("map<string,array<string>>")).alias("daughters"))


def read_rules_xml(spark: SparkSession, paths: Paths) -> DataFrame:
    """rules in file order."""
    r = parsed(in_order(elements(spark, paths, "rule")), RULE).select("ord", "e.*")
    return r.select(F.col("ord").cast("int").alias("ord"), F.col("_num").alias("rule_id"), _list("input._contextL").alias("ctx_l"), _list("input._contextR").alias("ctx_r"), F.trim("input._VALUE").alias("input"), _list("outcome._VALUE").alias("outcome"), _list("outcome._languages").alias("languages"), F.col("_stage").alias("stage"))


def read_quirks_xml(spark: SparkSession, paths: Paths) -> DataFrame:
    """quirks in file order; fields that are missing are empty."""
    q = parsed(in_order(elements(spark, paths, "quirk")), QUIRK).select("ord", "e.*")
    text = lambda f: F.coalesce(F.col(f), F.lit(""))
    return q.select(F.col("ord").cast("int").alias("ord"), text("_id").alias("quirk_id"), text("source_id").alias("source_id"), text("lg").alias("language"), text("lx").alias("form"), text("gl").alias("gloss"), text("alternative").alias("alternative"), text("analysis_slot").alias("slot"), text("analysis_value").alias("value"), F.coalesce("note", F.array().cast("array<string>")).alias("notes"))


def canons_from_xml(rows: DataFrame, text: str = "element") -> DataFrame:
    """The columns of rows but the XML of a `parameters` element, and what it says: classes (name → members), canon, supra, mode."""
    cut = lambda c: F.coalesce(_list(c), F.array().cast("array<string>"))
    classes = F.map_from_entries(F.transform("e.class", lambda c: F.struct(c["_name"], cut(c["_value"]))))
    kept = [c for c in rows.columns if c != text]
    return parsed(rows, PARAMETERS, text).select(*kept, F.coalesce(classes, F.create_map().cast("map<string,array<string>>")).alias("classes"), F.col("e.canon._value").alias("canon"), cut(F.col("e.spec._value")).alias("supra"), F.coalesce("e.context_match_type._value", F.lit("constituent")).alias("mode"))


def read_canon_xml(spark: SparkSession, paths: Paths) -> dict:
    """Config of a table, its first `parameters`: classes, canon, suprasegmentals, context_match_type; one small element for the driver."""
    p = canons_from_xml(elements(spark, paths, "parameters")).orderBy("file", "block", "row", "i").select("classes", "canon", "supra", "mode").first()
    if p is None:
        raise ValueError(f"{paths}: no parameters")
    return p.asDict()


def mels_from_xml(rows: DataFrame, text: str = "element") -> DataFrame:
    """mels of a column of `mel` elements."""
    return parsed(rows, MEL, text).select(F.col("e._id").alias("mel_id"), F.transform(F.coalesce("e.gl", F.array()), lambda g: g["_VALUE"]).alias("glosses"))


def read_mels_xml(spark: SparkSession, paths: Paths) -> DataFrame:
    return mels_from_xml(elements(spark, paths, "mel"))


def fuzzy_from_xml(rows: DataFrame, text: str = "element") -> DataFrame:
    """language, from_seg, to_seg, j (place in its item) and the other columns of rows, of a column of `item` elements."""
    item = parsed(rows, ITEM, text)
    return item.select(*[c for c in rows.columns if c != text], F.col("e._dial").alias("language"), F.col("e._to").alias("to_seg"), F.posexplode("e.from").alias("j", "from_seg"))


def read_fuzzy_xml(spark: SparkSession, paths: Paths) -> DataFrame:
    """fuzzy with ord = 1, 2, 3 … over all segments of all files."""
    each = fuzzy_from_xml(elements(spark, paths, "item"))
    return numbered(each, ["file", "block", "row", "i", "j"], "ord").select(F.col("ord").cast("int").alias("ord"), "language", "from_seg", "to_seg")


def _corrs(df: DataFrame, languages: list[str], context: Column, cells: Column, columns: tuple[str, str, str, str]) -> DataFrame:
    """ord, id, syll and proto by name; the languages' cells are folded into a map."""
    order, id_, syll, proto = columns
    base = df.select(F.col(order).cast("int").alias("ord"), F.col(id_).cast("string").alias("corr_id"), context.alias("ctx"), _list(syll).alias("syll"), F.trim(proto).alias("proto"), *languages)
    long = base.unpivot(["ord", "corr_id", "ctx", "syll", "proto"], languages, "language", "cell").withColumn("segs", cells)
    made = long.groupBy("ord", "corr_id", "ctx", "syll", "proto").agg(F.map_from_entries(F.collect_list(F.struct("language", "segs"))).alias("daughters"))
    return made.select("ord", "corr_id", F.col("ctx.l").alias("ctx_l"), F.col("ctx.r").alias("ctx_r"), "syll", "proto", "daughters")


def _segments(sep: str) -> Column:
    """Segments of a cell; a blank cell has the one empty segment."""
    return F.transform(F.split(F.coalesce("cell", F.lit("")), sep), lambda x: F.trim(x))


def read_corrs_tsv(df: DataFrame, languages: list[str], order: str = "ord") -> DataFrame:
    """Editor layout: ord, ID, Context, Slot, *, and a column per language."""
    return _corrs(df, languages, parse_context(F.col("Context")), _segments(","), (order, "ID", "Slot", "`*`"))


def read_toc_tsv(df: DataFrame, languages: list[str], order: str = "ord") -> DataFrame:
    """Table layout: ord, N, Type, *, context, languages; = stands for a comma."""
    comma = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "=", ",")
    cells = df.select(order, F.col("N").alias("ID"), comma("context").alias("Context"), comma("Type").alias("Slot"), comma("`*`").alias("*"), *[comma(x).alias(x) for x in languages])
    return read_corrs_tsv(cells, languages, order)


def read_toc_pipe_csv(df: DataFrame, languages: list[str], order: str = "ord") -> DataFrame:
    """Comma CSV: N, Type, *, context as `a/b_c/d` in parentheses, segments separated by |. A side that holds C, V or ˈ is free."""
    sides = F.split(F.regexp_replace(F.coalesce("context", F.lit("")), r"[()]", ""), "_")
    side = lambda i: F.when((F.coalesce(F.get(sides, F.lit(i)), F.lit("")) != "") & ~F.get(sides, F.lit(i)).rlike("[CVˈ]"), F.transform(F.split(F.get(sides, F.lit(i)), "/"), lambda x: F.trim(x)))
    return _corrs(df, languages, F.struct(side(0).alias("l"), side(1).alias("r")), _segments(r"\|"), (order, "N", "Type", "`*`"))


def read_rules_tsv(df: DataFrame, order: str = "ord") -> DataFrame:
    ctx = parse_context(F.coalesce("Context", F.lit("")))
    return df.select(F.col(order).cast("int").alias("ord"), F.col("RID").cast("string").alias("rule_id"), ctx["l"].alias("ctx_l"), ctx["r"].alias("ctx_r"), F.trim("Input").alias("input"), _list("Outcome").alias("outcome"), _list("Languages").alias("languages"), F.col("Stage").cast("int").alias("stage"))


def read_quirks_tsv(df: DataFrame, order: str = "ord") -> DataFrame:
    """The last row of each (language, form, gloss) counts."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = df.select(F.col(order).cast("int").alias("ord"), text("Language").alias("language"), text("Form").alias("form"), text("Gloss").alias("gloss"), text("Alternative").alias("alternative"), _list("Notes").alias("notes"))
    last = rows.groupBy("language", "form", "gloss").agg(F.max_by(F.struct("alternative", "notes", "ord"), "ord").alias("q"))
    return last.select("q.ord", "language", "form", "gloss", "q.alternative", "q.notes")


def forms_from_pairs(pairs: DataFrame) -> DataFrame:
    """Ad-hoc forms (ord, language, glyphs): the last pair of a language counts."""
    return pairs.groupBy("language").agg(F.max_by("glyphs", "ord").alias("glyphs")).select("language", F.lit(None).cast("string").alias("form_id"), "glyphs", F.lit(None).cast("string").alias("gloss"))
