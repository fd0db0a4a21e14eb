"""Compiling a table of correspondences: contexts, which may follow which, and what a more specific one blocks.

Tables have some dozens of rows (a property of the input: they are written by hand), so self-joins by conditions on
arrays are fine here. Row 0 of `nodes` is the word's start: proto `$`, no contexts.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO = "∅"
START = "$"
END = "#"


@dataclass(frozen=True)
class SoundTable:
    corrs: DataFrame
    classes: dict[str, list[str]] = field(default_factory=dict)
    canon: str = "(C|V)+"
    supra: tuple[str, ...] = ()
    mode: str = "constituent"
    panini: bool = True


def local(df: DataFrame) -> DataFrame:
    """A small table as rows of the plan itself: for compiled tables, of which there are some dozens to thousands of rows."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def localized(table: SoundTable) -> SoundTable:
    """The table with its correspondences held by the plan, so that compiling it reads nothing again."""
    return replace(table, corrs=local(table.corrs))


def expand_contexts(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with el, er: the contexts with class names (classes: name, members) replaced by their members, as sorted sets;
    null stays null. The classes become one map, one row, which is joined to all."""
    one = classes.agg(F.map_from_entries(F.collect_list(F.struct("name", "members"))).alias("_classes"))
    wide = rows.join(F.broadcast(one))
    made = lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform(c, lambda x: F.coalesce(F.try_element_at("_classes", x), F.array(x))))))
    return wide.withColumn("el", made(F.col("ctx_l"))).withColumn("er", made(F.col("ctx_r"))).drop("_classes")


def class_table(table: SoundTable) -> DataFrame:
    spark = table.corrs.sparkSession
    return spark.createDataFrame([(k, list(v)) for k, v in table.classes.items()], "name string, members array<string>")


def nodes(table: SoundTable) -> DataFrame:
    """ord, corr_id, proto, el, er, supra, syll, daughters, with the start as row 0."""
    rows = expand_contexts(table.corrs, class_table(table))
    supra = F.col("proto").isin(*table.supra) if table.supra else F.lit(False)
    real = rows.select("ord", "corr_id", "proto", "el", "er", supra.alias("supra"), "syll")
    free = F.lit(None).cast("array<string>")
    begin = real.sparkSession.range(1).select(F.lit(0).alias("ord"), F.lit("").alias("corr_id"), F.lit(START).alias("proto"), free.alias("el"), free.alias("er"), F.lit(False).alias("supra"), free.alias("syll"))
    return begin.unionByName(real)


def _as(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{name}_{c}") for c in ("ord", "corr_id", "proto", "el", "er", "supra")])


def left_ok(c: str, last: str, mode: str) -> Column:
    """Whether the left context of c allows `last` before it."""
    el, proto = F.col(f"{c}_el"), F.col(f"{last}_proto")
    return el.isNull() | (F.exists(el, lambda x: F.endswith(proto, x)) if mode == "glyphs" else F.array_contains(el, proto))


def right_ok(c: str, last: str, mode: str, bypass: bool = True) -> Column:
    """Whether the right context of `last` allows c after it; suprasegmentals are let through by the bypass."""
    er, proto = F.col(f"{last}_er"), F.col(f"{c}_proto")
    fits = er.isNull() | (F.exists(er, lambda x: F.startswith(proto, x)) if mode == "glyphs" else F.array_contains(er, proto))
    return F.col(f"{c}_supra") | fits if bypass else fits


def _narrower(a: Column, b: Column) -> Column:
    """a is a context where b is free, or a proper subset of b."""
    return a.isNotNull() & (b.isNull() | ((F.size(F.array_except(a, b)) == 0) & (F.size(a) < F.size(b))))


def transitions(table: SoundTable, node: DataFrame | None = None) -> DataFrame:
    """last_ord, next_ord: which correspondence may follow which, by both contexts."""
    node = nodes(table) if node is None else node
    last, nxt = _as(node, "last"), _as(node.where("ord > 0"), "next")
    return last.join(nxt, left_ok("next", "last", table.mode) & right_ok("next", "last", table.mode)).select("last_ord", "next_ord")


def block_less_specific(table: SoundTable, node: DataFrame | None = None, moves: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(moves that are left, conditional): conditional (last_ord, next_ord, by_ord) forbids the move when the left context of
    by_ord allows what stands before last. Moves from the start are never blocked."""
    node = local(nodes(table)) if node is None else node
    moves = local(transitions(table, node)) if moves is None else moves
    if not table.panini:
        return moves, moves.limit(0).withColumn("by_ord", F.lit(0))
    real = node.where("ord > 0")
    from_real = moves.where("last_ord > 0")
    # (i) among what may follow, one with a narrower left context and the same right context
    pairs = _as(real, "a").join(_as(real, "b"), (F.col("a_ord") != F.col("b_ord")) & (F.col("a_proto") == F.col("b_proto")))
    left_rule = pairs.where(_narrower(F.col("b_el"), F.col("a_el")) & F.col("a_er").eqNullSafe(F.col("b_er"))).select(F.col("a_ord").alias("next_ord"), "b_ord")
    other = from_real.select("last_ord", F.col("next_ord").alias("b_ord"))
    gone_left = from_real.join(left_rule, "next_ord").join(other, ["last_ord", "b_ord"]).select("last_ord", "next_ord").distinct()
    left = from_real.join(gone_left, ["last_ord", "next_ord"], "left_anti")
    # (ii) and (iii): another of the same proto with a narrower right context after which the next one fits
    nxt = _as(real, "next")
    rivals = pairs.select(F.col("a_ord").alias("last_ord"), F.col("a_el").alias("own_el"), F.col("a_er").alias("own_er"), *[F.col(f"b_{c}") for c in ("ord", "proto", "el", "er", "supra")])
    met = left.join(rivals, "last_ord").join(nxt, "next_ord").where(left_ok("next", "b", table.mode) & right_ok("next", "b", table.mode, bypass=False))
    narrow_right = _narrower(F.col("b_er"), F.col("own_er"))
    gone_right = met.where(narrow_right & F.col("b_el").eqNullSafe(F.col("own_el"))).select("last_ord", "next_ord").distinct()
    both = met.where(narrow_right & ~F.col("b_el").eqNullSafe(F.col("own_el")) & _narrower(F.col("b_el"), F.col("own_el")))
    conditional = both.join(gone_right, ["last_ord", "next_ord"], "left_anti").groupBy("last_ord", "next_ord").agg(F.max("b_ord").alias("by_ord"))
    kept = moves.where("last_ord = 0").unionByName(left.join(gone_right, ["last_ord", "next_ord"], "left_anti"))
    return kept, conditional


def token_index(corrs: DataFrame) -> DataFrame:
    """language, token, ord, corr_id: tokens up to the first empty one of each cell."""
    each = corrs.select("ord", "corr_id", F.explode("daughters").alias("language", "segs"))
    first_empty = F.array_position("segs", "")
    cut = F.when(first_empty > 0, F.slice("segs", F.lit(1), (first_empty - 1).cast("int"))).otherwise(F.col("segs"))
    return each.select("language", F.explode(cut).alias("token"), "ord", "corr_id").distinct()


def rule_view(corrs: DataFrame) -> DataFrame:
    """One row per correspondence and outcome: the languages that share it."""
    each = corrs.select("ord", "corr_id", "proto", F.explode("daughters").alias("language", "segs")).select("ord", "corr_id", "proto", "language", F.explode("segs").alias("outcome"))
    return each.groupBy("ord", "corr_id", "proto", "outcome").agg(F.array_sort(F.collect_set("language")).alias("languages"))


def rules_for_language(rules: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """Rules of a language by outcome token, and (highest stage); a stage below 1 is an error."""
    mine = rules.where(F.array_contains("languages", language)).withColumn("stage", F.when(F.col("stage") < 1, F.raise_error(F.concat(F.lit("rule stage below 1: "), "rule_id")).cast("int")).otherwise(F.col("stage")))
    return mine.select(F.explode("outcome").alias("token"), "ord", "rule_id", "input", "stage"), mine.agg(F.coalesce(F.max("stage"), F.lit(0)).alias("max_stage"))


def derive_sound_classes(corrs: DataFrame, kinds: tuple[str, ...] = ("C", "V", "c", "v")) -> DataFrame:
    """name, members: the distinct proto forms of each syllable type, in first-seen order."""
    each = corrs.select("ord", "proto", F.explode("syll").alias("name")).where(F.col("name").isin(*kinds))
    first = each.groupBy("name", "proto").agg(F.min("ord").alias("ord"))
    return first.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "proto"))), lambda x: x["proto"]).alias("members"))

