"""Mixing sources to target weights by entropy balancing, with built-in functions only.

Of all rates r >= 0 on documents, r <= `cap`, that give each source its target number of tokens, those nearest to
1 in relative entropy are exponentially tilted: r = min(cap, exp(lambda * size / mean size)), with one multiplier a
source, the minimum of a convex dual. Safeguarded Newton steps find the multipliers; each is one distributed
aggregation. Rates depend on (source, size) alone, so the documents enter as counts of these pairs, summed
before any shuffle; a hot source is a few thousand rows.

Rates become whole copies by systematic rounding: over the cells of a source in order of size, the rounded running
sum of expected copies is shared out, so the tokens taken differ from the target by half the largest document at
most (plus the solver's tolerance). A cell is (source, size, salt): the salt, from the id, splits a size that many
documents share, and within a cell the documents with the smallest hashes take the extra copy. No randomness: reruns agree.

Null texts have size 0; they have rate 1, add nothing and are taken 0 times. Null sources form a source of their own.
Repeated rows are documents by themselves; rows alike in id, source and size may swap their copies. With no
words at all every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import carried, segmented
from .common import WORD, bounded, text_of, unused, written

SALTS = 64
#: Rows (24 bytes) of copies that may be broadcast to the texts.
BROADCAST_ROWS = 200_000


def sized(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size (words of the whole text), written once, so that texts are read once."""
    size = F.regexp_count(text_of("text"), F.lit(WORD)).cast("long")
    salt = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(SALTS)).cast("int")
    return written(docs.select("doc_id", "source", *keep, size.alias("size"), salt.alias("salt")), "sizes")


def targets(pairs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """source, source_size, docs, target, from pairs (source, size, n). Sources by code point, null last, take the weights in turn.

    A target stops at cap times its source's size and its excess goes to the others by weight. The level L of
    target = min(cap * size, L * weight) is found from the sources in order of size / weight: below it they are full.
    """
    per = pairs.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())  # one row a source
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in weights]), turn)).withColumn("limit", F.col("source_size") * F.lit(cap))
    ratio = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    full = F.coalesce(F.sum("limit").over(ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = per.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - full) / open_weight)
    # the level of the first source that does not fill up holds for all
    level = level.withColumn("level", F.max(F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.col("level"))).over(every))
    return level.select("source", "source_size", "docs", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("weight"))).alias("target"))


def multipliers(pairs: DataFrame, goals: DataFrame, cap: float = 3.0, tolerance: float = 1e-6, max_steps: int = 60) -> DataFrame:
    """goals with `lam`: the tilt of each source. pairs: source, size, n.

    Newton on the dual's gradient, which rises with lam; a bracket that each step narrows takes over where a
    Newton step would leave it (the kink at the cap). A source filled to the cap needs rate cap throughout.
    """
    mean = F.col("source_size") / F.col("docs")
    full = F.col("target") >= F.col("source_size") * F.lit(cap) * (1 - 1e-12)
    state = goals.select("*", mean.alias("mean"), F.when((F.col("source_size") > 0) & (F.col("target") > 0) & ~full, F.log(F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)).alias("lam"), F.lit(-700.0).alias("lo"), F.lit(1e9).alias("hi"), full.alias("full"))
    state = written(state, "dual")
    for _ in range(max_steps):
        c = F.col("size") / F.col("mean")
        rate = tilted(F.col("lam"), c, cap)
        sums = pairs.where("size > 0").join(state.where("not full").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.when(rate < cap, F.col("n") * F.col("size") * c * rate).otherwise(0.0)).alias("slope"))
        at = state.join(sums.withColumnRenamed("s", "k"), F.col("source").eqNullSafe(F.col("k")), "left").drop("k")
        over = F.col("got") - F.col("target")
        lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - over / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
        middle = F.when(hi >= 1e8, F.greatest(F.col("lam") * 2, F.col("lam") + 2)).otherwise((lo + hi) / 2)
        done = F.abs(over) <= tolerance * F.col("target")
        step = F.when(F.col("got").isNull() | done, F.col("lam")).when(inside, newton).otherwise(middle)
        state = written(at.select("source", "source_size", "docs", "target", "mean", step.alias("lam"), F.when(F.col("got").isNull(), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("got").isNull(), F.col("hi")).otherwise(hi).alias("hi"), "full", F.coalesce(~done & (F.col("target") > 0), F.lit(False)).alias("open")), "dual")
        if state.where("open").isEmpty():
            break
    return state.select("source", "source_size", "docs", "target", "mean", "lam", "full")


def tilted(lam: Column, c: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(lam * c, F.lit(50.0))))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, source, `keep`, size, source_size, target, rate, copies (whole, at most cap), taken."""
    docs_sized = sized(docs, keep)
    cells = written(docs_sized.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "cells")
    pairs = written(cells.groupBy("source", "size").agg(F.sum("n").alias("n")), "pairs")
    goals = written(targets(pairs, weights, share, cap), "targets")
    solved = multipliers(pairs, goals, cap)
    rate = F.when(F.col("full"), F.lit(float(cap))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(tilted(F.col("lam"), F.col("size") / F.col("mean"), cap))
    rated = cells.withColumnRenamed("source", "s").join(solved, F.col("s").eqNullSafe(F.col("source"))).withColumn("rate", rate).drop("s", "lam", "full", "mean", "docs")
    # copies up to each cell in order of size, rounded; decimals add up alike however the cells are dealt out
    rated = segmented(rated.withColumns({"back": -F.col("size"), "want": (F.col("n") * F.col("rate")).cast("decimal(38,9)")}), "source", ["back", "salt"], "rated")
    ends = rated.groupBy("source", "_seg").agg(F.sum("want").alias("total"))
    before = F.sum("total").over(W.partitionBy("source").orderBy("_seg").rowsBetween(W.unboundedPreceding, -1))
    rated = carried(rated, ends.withColumn("before", before).where("before is not null"), "source", ["before"])
    here = F.sum("want").over(W.partitionBy("source", "_seg").orderBy("back", "salt")) + F.coalesce("before", F.lit(0))
    rated = rated.withColumn("here", here).withColumn("cell_copies", F.floor(F.col("here") + F.lit(0.5).cast("decimal(2,1)")).cast("long") - F.floor(F.col("here") - F.col("want") + F.lit(0.5).cast("decimal(2,1)")).cast("long"))
    shared = rated.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("salt").alias("t"), "n", "source_size", "target", "rate", "cell_copies")
    ranked = docs_sized.withColumn("rank", F.row_number().over(W.partitionBy("source", "size", "salt").orderBy(F.xxhash64("doc_id"), "doc_id")))
    both = ranked.join(shared, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("t")))
    copies = F.least(F.floor(F.col("cell_copies") / F.col("n")) + F.when(F.col("rank") <= F.col("cell_copies") % F.col("n"), 1).otherwise(0), F.lit(int(cap)))
    return both.select("doc_id", "source", *keep, "size", "source_size", "target", "rate", copies.cast("long").alias("copies")).withColumn("taken", F.when(F.col("size") > 0, F.col("size") * F.col("copies")).otherwise(F.lit(0)).cast("long"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """The mix itself: docs, each as many times as it is taken. Rows alike in id and text are kept once, with all
    their copies, whatever their other columns, which may have any names."""
    own, d, p, copies, copy = unused(docs, "own_print", "key_id", "key_print", "all_copies", "copy")
    needed = docs.select("doc_id", "source", "text", F.xxhash64(text_of("text")).alias("own_print"))
    taken = mix(needed, weights, share, cap, keep=("own_print",)).groupBy(F.col("doc_id").alias(d), F.col("own_print").alias(p)).agg(F.sum("copies").alias(copies), F.count("*").alias("rows"))
    taken = written(taken, "copies")
    marked = docs.withColumn(own, F.xxhash64(text_of("text")))
    if not taken.where("rows > 1").isEmpty():
        marked = marked.dropDuplicates(["doc_id", own])
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(own) == F.col(p))
    out = marked.join(bounded(taken.where(F.col(copies) > 0).select(d, p, copies), BROADCAST_ROWS), same)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
