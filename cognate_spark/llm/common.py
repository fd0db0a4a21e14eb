"""Shared pieces: table access, words, ASCII folding and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import ranked, shared_dir  # noqa: F401
from ..shared import settled as written

#: A word of the corpus: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A word for decontamination, after A-Z are lower-cased: ASCII letters and digits and all that is not ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased and no other letter; pure ASCII texts take the quick way, with the same result."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def words(col: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, by a count; as it is otherwise. df should be written."""
    return F.broadcast(df) if df.count() <= rows else df


def byte_groups(texts: pa.Array, size: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, "right")))
        yield begin, end
        begin = end


#: A bit map of keys has 2^MAP_BITS bits, in at most 2^(MAP_BITS - 6) rows (16 MB), whatever the number of keys.
MAP_BITS = 26


def _map_bit(key: Column) -> tuple[Column, Column]:
    """A 64-bit key's word in the bit map, and its bit there."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 64 - MAP_BITS).bitwiseAND(F.lit(63)).cast("int"))
    return F.shiftrightunsigned(key, 70 - MAP_BITS), bit


def bit_map(keys: DataFrame, key: str) -> DataFrame:
    """map_word, map_bits: a bit map of the keys; written."""
    word, bit = _map_bit(F.col(key))
    return written(keys.select(word.alias("map_word"), bit.alias("bit")).groupBy("map_word").agg(F.bit_or("bit").alias("map_bits")), "bit-map")


def may_be_in(df: DataFrame, key: str, bits: DataFrame, always: Column | None = None) -> DataFrame:
    """Rows of df whose key may be among those of the bit map, and those of `always`. The map is broadcast."""
    word, bit = _map_bit(F.col(key))
    hit = F.coalesce(F.col("map_bits").bitwiseAND(bit) != 0, F.lit(False))
    joined = df.withColumn("map_own", word).join(F.broadcast(bits), F.col("map_own") == F.col("map_word"), "inner" if always is None else "left")
    return joined.where(hit if always is None else hit | always).select(*df.columns)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def kind_of(df: DataFrame, name: str) -> str:
    """The type of a column, for the schemas of Arrow functions: ids may be numbers or strings."""
    return df.schema[name].dataType.simpleString()
