"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets /tmp/checkpoints."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


#: Paths of the tables that this process has written, the latest last.
TABLES: list[str] = []


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and still there when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of `settled` that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        at = hadoop.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        TABLES.remove(path)


def few(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df with a broadcast hint if a count finds at most so many (short) rows; as it is otherwise. df should be settled."""
    return F.broadcast(df) if df.count() <= rows else df


def numbered(df: DataFrame, order: list[str | Column], name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """df with `name`: 1, 2, 3 … in this order, or in each group of `within`.

    Rows are dealt out by ranges and sorted where they are; running counts of the ranges, one row a range, are added. So no
    task sees all rows, as it would with a window.
    """
    if within:
        said = [F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("")) for c in within]
        placed = ranked(df.withColumn("_group", F.concat_ws("\x1f", *said)), "_group", [F.col(c) if isinstance(c, str) else c for c in order], name)
        return placed.select(*df.columns, (F.col(name) + 1).alias(name))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    dealt = settled(dealt, "numbered")
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select(F.col("_range").alias("_r"), (before - F.col("_first") + 1).alias("_offset"))
    return dealt.join(F.broadcast(offsets), F.col("_range") == F.col("_r")).select(*df.columns, (F.col("_row") + F.col("_offset")).alias(name))


def ranked(df: DataFrame, group: str, keys: list[Column], name: str) -> DataFrame:
    """df with `name`: 0, 1, 2 … within each group (a column without nulls) in the order of the keys.

    Rows are dealt out by ranges of (group, keys) and counted where they are sorted, so a group may span any number of tasks. Only
    the first group of a range can have rows in ranges before it: what these hold is one number a range, which the driver adds up.
    """
    by = [F.col(group), *keys]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    part = next(x for x in ("_part", "__part", "___part") if x not in df.columns)
    schema = StructType([*df.schema.fields, StructField(part, IntegerType()), StructField(name, LongType())])
    at, names = df.columns.index(group), schema.names

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted batches with the task's number and the place of each row among those of its group in the task."""
        from pyspark import TaskContext

        task, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n, col = batch.num_rows, batch.column(at)
            if not n:
                continue
            starts = np.concatenate([[0], np.flatnonzero(np.diff(col.dictionary_encode().indices.to_numpy())) + 1])
            sizes = np.diff(np.append(starts, n))
            places = np.arange(n) - np.repeat(starts, sizes)
            if col[0].as_py() == last:
                places[: sizes[0]] += count
            last, count = col[n - 1].as_py(), int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task, np.int32)), pa.array(places)], names=names)

    placed = settled(dealt.mapInArrow(counted, schema), "ranked")
    ranges = placed.groupBy(part).agg(F.min(group).alias("head"), F.max(F.struct(F.col(group).alias("group"), F.col(name).alias("at"))).alias("last")).collect()
    carried, before, held = [], None, 0
    for r in sorted(ranges, key=lambda r: r[0]):
        held = held if r["head"] == before else 0
        if held:
            carried.append((r[0], r["head"], held))
        held = r["last"]["at"] + 1 + (held if r["last"]["group"] == r["head"] else 0)
        before = r["last"]["group"]
    if not carried:
        return placed.drop(part)
    more = df.sparkSession.createDataFrame(carried, StructType([StructField("_p", IntegerType()), StructField("_g", df.schema[group].dataType), StructField("_n", LongType())]))
    joined = placed.join(F.broadcast(more), (F.col(part) == F.col("_p")) & (F.col(group) == F.col("_g")), "left")
    return joined.select(*df.columns, (F.col(name) + F.coalesce("_n", F.lit(0))).alias(name))


def segmented(df: DataFrame, group: str, order: str | list[str], name: str) -> DataFrame:
    """df dealt out by ranges of (group, order), with `_seg`, the number of the range; settled. A group of any size is several
    segments, of which each is in one task; what they carry on from one to the next is one row a segment (`carried`)."""
    by = [group, *([order] if isinstance(order, str) else order)]
    return settled(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_seg", F.spark_partition_id()), name)


def carried(rows: DataFrame, ends: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """rows of `segmented` with columns of ends (group, _seg, columns), null where there is no row. ends should have a row only where
    something is carried on: for a group's second segment and those after it, so at most one a range."""
    ends = few(settled(ends.select(F.col(group).alias("_group"), F.col("_seg").alias("_s"), *columns), "carried"))
    return rows.join(ends, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_seg") == F.col("_s")), "left").drop("_group", "_s")
