"""Comparing runs: proto forms and sets in common, lost, gained, changed. Keys are sorted members joined to one string."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import set_key


def _keyed(protos: DataFrame, by: str) -> DataFrame:
    return protos.select("proto", set_key(F.col(by)).alias("key"), F.col(by).alias("members")).dropDuplicates(["proto", "key"])


def compare_lexicons(a: DataFrame, b: DataFrame, by: str = "support") -> tuple[DataFrame, DataFrame]:
    """(rows, scores): rows proto, key, members, side (both, only_1, only_2); scores n1, n2, common, precision (of n1), recall (of n2),
    f_score, which are null where they would divide by zero. Proto forms are equal by string and supporting forms."""
    one, two = _keyed(a, by), _keyed(b, by)
    both = one.select("proto", "key", F.col("members").alias("m1"), F.lit(1).alias("in1")).join(two.select("proto", "key", F.col("members").alias("m2"), F.lit(1).alias("in2")), ["proto", "key"], "full")
    side = F.when(F.col("in2").isNull(), "only_1").when(F.col("in1").isNull(), "only_2").otherwise("both")
    rows = both.select("proto", "key", F.coalesce("m1", "m2").alias("members"), side.alias("side"))
    n = rows.agg(F.count_if(F.col("side") != "only_2").alias("n1"), F.count_if(F.col("side") != "only_1").alias("n2"), F.count_if(F.col("side") == "both").alias("common"))
    part = n.select("*", F.try_divide("common", "n1").alias("precision"), F.try_divide("common", "n2").alias("recall"))
    return rows, part.withColumn("f_score", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def sets_lost_gained(old: DataFrame, new: DataFrame) -> DataFrame:
    """proto, key, change: sets by proto string and attested forms that one run alone has."""
    rows, _ = compare_lexicons(old, new, "attested")
    return rows.where("side != 'both'").select("proto", "key", F.when(F.col("side") == "only_1", "lost").otherwise("gained").alias("change"))


def diff_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per set of reflexes: status identical, changed (proto strings or id strings differ), lost or gained, with both sides' protos, ids and
    mels. Sets of one run with the same reflexes are one row."""

    def side(df: DataFrame, n: str) -> DataFrame:
        joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
        return df.groupBy(set_key(F.col("attested")).alias("key")).agg(joined("proto").alias(f"proto{n}"), joined("ids").alias(f"ids{n}"), joined("mel_id").alias(f"mel{n}"))

    both = side(old, "1").join(side(new, "2"), "key", "full")
    same = (F.col("proto1") == F.col("proto2")) & (F.col("ids1") == F.col("ids2"))
    status = F.when(F.col("proto2").isNull(), "lost").when(F.col("proto1").isNull(), "gained").when(same, "identical").otherwise("changed")
    return both.withColumn("status", status)


def overlap_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the one-sided rows of compare_lexicons: edges form, proto_node, side; nodes with their degree."""
    node = F.concat_ws(":", "side", "proto", F.sha2("key", 256))
    edges = rows.where("side != 'both'").select(F.explode("members").alias("form"), node.alias("proto_node"), "side").distinct()
    nodes = edges.select(F.col("form").alias("node"), F.lit("reflex").alias("kind")).unionByName(edges.select(F.col("proto_node").alias("node"), F.col("side").alias("kind")))
    return edges, nodes.groupBy("node", "kind").agg(F.count("*").alias("degree"))


def overlap_matrix(edges: DataFrame, reflexes: int = 200, protos: int = 100) -> DataFrame:
    """form, proto_node, mark: X where there is an edge, over the first reflexes and proto forms by name. The limits are the feature."""
    rows = edges.select("form").distinct().orderBy("form").limit(reflexes)
    cols = edges.select("proto_node").distinct().orderBy("proto_node").limit(protos)
    hits = edges.select("form", "proto_node", F.lit("X").alias("mark")).distinct()
    return rows.crossJoin(cols).join(hits, ["form", "proto_node"], "left").na.fill("", ["mark"])


def stats_across_runs(stats: DataFrame, runs: list[str]) -> DataFrame:
    """stat, language (null: totals), a column per run. stats: run, language, stat, value."""
    return stats.groupBy("stat", "language").pivot("run", runs).agg(F.sum("value"))

