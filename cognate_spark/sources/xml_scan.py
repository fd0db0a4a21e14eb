"""XML files as rows, one element a row, scanned in splits.

Spark's text source reads records that end with an element's end tag, so a file of any size is read by many tasks; what stands before
the element's start in its record is cut off. `from_xml` parses the elements by a given schema, from here or from any other
column of strings, and sets those aside that it cannot parse.

End tags are written without blanks (`</entry>`); a comment or CDATA section that holds one is not told apart. Elements of the tag
are not inside one another. Files are UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import few, numbered, settled

Paths = str | list[str]

#: Attributes of a start tag; > may stand in quotes.
_ATTRIBUTES = r"""(?:\s(?:[^>"'/]|/(?!>)|"[^"]*+"|'[^']*+')*+)?"""
#: Columns that put the elements of all files in order.
_PLACE = ["file", "block", "row", "i"]


def _records(spark: SparkSession, paths: Paths, tag: str) -> DataFrame:
    text = spark.read.option("lineSep", f"</{tag}>").text(paths)
    value = F.regexp_replace("value", r"(?s)<!--.*?-->", "")
    return text.select(value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def elements(spark: SparkSession, paths: Paths, tag: str) -> DataFrame:
    """file, block, row, i (its place), element: every element of the tag, whole, self-closing ones too."""
    start = f"<{tag}{_ATTRIBUTES}"
    found = F.regexp_extract_all("value", F.lit(f"(?s){start}(?:/>|>.*)"), F.lit(0))
    each = _records(spark, paths, tag).select("file", "block", "row", F.posexplode(found).alias("i", "e"))
    closed = F.col("e").rlike(rf"\A{start}/>\z")
    return each.select(*_PLACE, F.when(closed, F.col("e")).otherwise(F.concat("e", F.lit(f"</{tag}>"))).alias("element"))


def in_order(rows: DataFrame) -> DataFrame:
    """rows with `ord` = 1, 2, 3 … over all files: files by name, elements by place."""
    return numbered(rows, _PLACE, "ord")


def root_attribute(spark: SparkSession, paths: Paths, root: str, attribute: str, tag: str) -> DataFrame:
    """file, value: an attribute of each file's root, which stands in the record of its first element."""
    opened = F.regexp_extract("value", f"(?s)<{root}{_ATTRIBUTES}(?=/?>)", 0)
    heads = _records(spark, paths, tag).select("file", opened.alias("o")).where("o != ''")
    return heads.groupBy("file").agg(F.first(parsed_column(F.concat("o", F.lit("/>")), f"_{attribute} string")[f"_{attribute}"]).alias("value"))


def with_root_attribute(rows: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """rows with their file's attribute as a column; there is a root a file, and the join goes by their number."""
    return rows.join(few(settled(roots.select("file", F.col("value").alias(name)), "roots")), "file", "left")


def parsed_column(text: Column, schema: str) -> Column:
    """A string of XML as a struct of the schema, with _corrupt_record where it does not fit."""
    options = {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}
    return F.from_xml(text, f"{schema}, _corrupt_record string", options)


def parsed(rows: DataFrame, schema: str, text: str = "element") -> DataFrame:
    """rows with e, the struct; those that do not fit the schema are left out (`rejected` has them)."""
    return _tried(rows, schema, text).where("e is not null and e._corrupt_record is null")


def rejected(rows: DataFrame, schema: str, text: str = "element") -> DataFrame:
    """The rows whose XML is malformed or does not fit the schema, as they are."""
    return _tried(rows, schema, text).where("e is null or e._corrupt_record is not null").drop("e")


def _tried(rows: DataFrame, schema: str, text: str) -> DataFrame:
    return rows.withColumn("e", parsed_column(F.col(text), schema))
