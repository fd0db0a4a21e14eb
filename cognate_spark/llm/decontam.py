"""Benchmark decontamination as a prefix-filtered set join, with built-in functions only.

Every benchmark item gives windows of `window` consecutive words (an item of fewer words is one window). A
document contains a window only if it contains all its shingles, so one shingle, its necessary prefix at
containment 1, is enough to find candidates: the rarest, by its count in all documents.

Documents are split into words once. Their shingles that occur in windows are kept with their places, as keys; the
counts of these give each window its rarest shingle, and a join on those yields the places at which a window would begin. Bounds
on place and length drop those that would not fit. Then the texts of the documents with candidates, and of no others, are fetched and
the words there are compared with the window's, exactly.

Hot shingles are rare by choice: each window is filed under the rarest it has. The windows' keys are broadcast only if
they number at most `BROADCAST_KEYS`. Else a bit map of them, of the same size whatever their number, is, and the documents' keys that it
lets through, without texts, are joined with them by a shuffle.

Null texts have no words: such documents are clean, such items have no windows. Items without an id are ignored.
Repeated rows are documents by themselves. Ids may be of any type. The result holds `doc_id` and other columns asked for by `keep`,
under any names but those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ITEM_WORD, ascii_lower, bit_map, bounded, may_be_in, text_of, unused, words, written

#: Rows of 200 bytes or so each, and keys of 8 bytes, that may be broadcast.
BROADCAST_ROWS, BROADCAST_KEYS = 100_000, 1_000_000


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), ITEM_WORD)


def _shingle(w: Column, i: Column, size: int) -> Column:
    """Key of the shingle that begins at place i, with the number of its words."""
    return F.xxhash64(F.lit(size), *[F.get(w, i + k) for k in range(size)])


def _shingles(w: Column, sizes: list[int]) -> Column:
    """(place, key) of all shingles of these sizes, sizes one after the other."""
    def of(size: int) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.struct(i.alias("place"), _shingle(w, i, size).alias("key")))
        return F.when(F.size(w) >= size, found).otherwise(F.array().cast("array<struct<place:int,key:bigint>>"))

    each = [of(s) for s in sizes]
    return F.concat(*each) if len(each) > 1 else each[0]


def item_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """item_id string, words: the distinct windows of the items."""
    w = F.col("w")
    fits = F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0)))
    cut = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), item_words(text_of("text")).alias("w")).where(F.size(w) > 0)
    return cut.select("item_id", F.explode(F.transform(fits, lambda i: F.slice(w, i + 1, window))).alias("words")).distinct()


def _judged(docs: DataFrame, items: DataFrame, window: int, shingle: int, keep: tuple[str, ...]) -> DataFrame:
    """Per document: doc_id, kept (struct of the columns `keep`), print (hash of the text), n_words, n_hit, items."""
    windows = written(item_windows(items, window), "windows")
    size = F.least(F.size("words"), F.lit(shingle))
    sizes = sorted(r[0] for r in windows.select(size).distinct().collect()) or [shingle]  # at most `shingle` values
    mine = F.lit(None).cast("array<struct<place:int,key:bigint>>")
    for s in sizes:
        mine = F.when(size == s, _shingles(F.col("words"), [s])).otherwise(mine)
    filed = windows.withColumn("mine", mine)
    wanted = written(filed.select(F.explode("mine.key").alias("key")).distinct().withColumn("found", F.lit(True)), "shingles")

    large = wanted.count() > BROADCAST_KEYS
    # each document gives one row besides its shingles, with a place below 0 and a key that is dealt out like others, so that none is lost
    base = docs.select(F.col("doc_id"), F.struct(F.lit(True).alias(unused(docs, "own")[0]), *keep).alias("kept"), F.xxhash64(text_of("text")).alias("print"), item_words(text_of("text")).alias("w"))
    own = F.array(F.struct(F.lit(-1).alias("place"), F.xxhash64("doc_id", "print").alias("key")))
    spread = base.select("doc_id", "kept", "print", F.size("w").alias("n_words"), F.explode(F.concat(own, _shingles(F.col("w"), sizes))).alias("s")).select("doc_id", "kept", "print", "n_words", "s.place", "s.key")
    if large:
        spread = may_be_in(spread, "key", bit_map(wanted, "key"), F.col("place") < 0)
    else:
        wanted = F.broadcast(wanted)
    seen = written(spread.join(wanted, "key", "left").where("place < 0 or found").select("doc_id", F.when(F.col("place") < 0, F.col("kept")).alias("kept"), "print", "n_words", "place", "key"), "seen")
    met = seen.where("place >= 0").drop("kept")

    # the window's rarest shingle; one that no document has finds nothing and drops the window
    counts = bounded(written(met.groupBy("key").agg(F.count("*").alias("n")), "rarity"), BROADCAST_KEYS)
    each = filed.select("item_id", "words", F.explode("mine").alias("s")).select("item_id", "words", "s.place", "s.key").join(counts, "key", "left")
    rarest = each.groupBy("item_id", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "place")).alias("r")).where("r.n > 0")
    prefix = written(rarest.groupBy(F.col("r.key").alias("key"), F.col("r.place").alias("offset"), "words").agg(F.collect_set("item_id").alias("item_ids")), "prefixes")
    filing = written(prefix.select("key", "offset", F.size("words").alias("length")).distinct(), "filing")
    begin = F.col("place") - F.col("offset")
    fits = met.join(bounded(filing, BROADCAST_KEYS), "key").where((begin >= 0) & (begin + F.col("length") <= F.col("n_words")))
    asked = written(fits.groupBy("doc_id", "print").agg(F.collect_set(F.struct(begin.alias("begin"), "length", "key", "offset")).alias("asked")), "asked")

    # the words at the places asked for; rows alike in id and text are asked once
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p"))
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text_of("text")).alias("p"), text_of("text").alias("text"))
    told = texts.join(bounded(asked, BROADCAST_ROWS), same).dropDuplicates(["d", "p"]).select("doc_id", "print", item_words(F.col("text")).alias("w"), "asked")
    at = told.select("doc_id", "print", "w", F.explode("asked").alias("a")).select("doc_id", "print", "a.begin", "a.length", "a.key", "a.offset", F.slice("w", F.col("a.begin") + 1, F.col("a.length")).alias("words"))
    hits = at.join(bounded(prefix, BROADCAST_ROWS), ["key", "offset", "words"]).select("doc_id", "print", F.struct("begin", (F.col("begin") + F.col("length")).alias("end")).alias("hit"), "item_ids")
    grouped = hits.groupBy("doc_id", "print").agg(F.sort_array(F.collect_set("hit")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda s, h: F.struct((s["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(h["begin"], s["end"]))).alias("n"), F.greatest(s["end"], h["end"]).alias("end"))
    marked = written(grouped.select(F.col("doc_id").alias("d"), F.col("print").alias("p"), F.aggregate("hits", start, step, lambda s: s["n"].cast("long")).alias("n_hit"), "items"), "hits")
    out = seen.where("place < 0").join(bounded(marked, BROADCAST_ROWS), same, "left")
    return out.select("doc_id", "kept", "print", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the columns `keep`, n_words, n_hit (words inside any occurrence of a window), items
    (sorted ids as strings of the items with an occurring window)."""
    return _judged(docs, items, window, shingle, keep).select("doc_id", *[F.col(f"kept.`{c}`") for c in keep], "n_words", "n_hit", "items")


def clean(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """docs without those in which a window of an item occurs. Rows alike in id and text share their fate."""
    own, d, p = unused(docs, "print", "d", "p")
    found = _judged(docs, items, window, shingle, ()).where("n_hit > 0")
    dirty = bounded(written(found.select(F.col("doc_id").alias(d), F.col("print").alias(p)).distinct(), "dirty"), BROADCAST_ROWS)
    marked = docs.withColumn(own, F.xxhash64(text_of("text")))
    return marked.join(dirty, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(own) == F.col(p)), "left_anti").select(*docs.columns)
