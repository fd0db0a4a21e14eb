"""Inducing tables of correspondences from aligned words."""

from __future__ import annotations

import heapq
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import TABLES, few, numbered, settled


def split_syllables(words: DataFrame, pattern: str, slots: list[str], zero_last: bool = False, move_last: bool = False) -> DataFrame:
    """words (…, word) → one row per slot with its constituent, by the groups of a pattern; a word that it does not match has
    empty ones. zero_last: a last group that takes no part is `0`. move_last: what was read in the last slot, where the one before it is
    empty, belongs there (a final read as a suffix), and the last is then `0`."""
    whole = f"^(?:{pattern})"
    match = F.col("word").rlike(whole)
    group = lambda i: F.regexp_extract("word", whole, i + 1)
    last = len(slots) - 1
    cells = [F.when(~F.coalesce(match, F.lit(False)), F.lit("")).when(F.lit(zero_last and i == last) & (group(i) == ""), F.lit("0")).otherwise(group(i)).alias(s) for i, s in enumerate(slots)]
    base = words.select(*words.columns, *cells)
    if move_last:
        final, suffix = F.col(slots[last - 1]), F.col(slots[last])
        moves = (final == "") & ~suffix.isin("", "0")
        base = base.withColumns({slots[last - 1]: F.when(moves, suffix).otherwise(final), slots[last]: F.when(moves, F.lit("0")).otherwise(suffix)})
    return base.unpivot(words.columns, slots, "slot", "constituent")


def correspondence_rows(parts: DataFrame, languages: list[str]) -> DataFrame:
    """row_id, slot, a column per language: the constituents of each word row."""
    return parts.groupBy("row_id", "slot").pivot("language", languages).agg(F.first("constituent", ignorenulls=True))


#: Rows of a slot in the first stretch after a language's last row (and at the start); the next ones end after 4, 16 … times as many.
FIRST_STRETCH = 1 << 15
#: Rows that a broadcast takes at most.
BROADCAST_ROWS = 500_000


def _among(mask: Column, languages: list[str]) -> list[Column]:
    """The cells of the languages in a set (bits), the others empty."""
    return [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.col(c)).otherwise("").alias(c) for i, c in enumerate(languages)]


def _bits(truths: list[Column]) -> Column:
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(truths)), F.lit(0))


def _without(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def merge_correspondences(rows: DataFrame, languages: list[str], order: str = "row_id") -> DataFrame:
    """Greedy merge of compatible rows per slot, in order: a row joins the first group with which it clashes nowhere ('' and null
    fit anything) and fills its gaps. slot, group_no, the languages. Rows of the same place go by their cells.

    The result depends on the order, but few rows depend on what others did to a group. A slot's distinct rows are taken in
    stretches, in which the same languages are alive (have cells from there on) and which grow by four. In a stretch

    * a row is covered if one before it, or a group, has all its cells;
    * groups with gaps come from those that had gaps before it and from rows with gaps that nothing covers;
    * a row that fits none of these in a way that fills a gap changes nothing where it is covered, and else is a group for good,
      as all its gaps are in languages without further cells.

    Spark's joins find these, on the cells that two sets of languages have in common; the others, and the groups with gaps, go
    one after another (`_first_fit`), a slot at a time. The more rows with gaps there are, the more these are.
    """
    cells = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in languages]
    distinct = rows.select(F.coalesce(F.concat(F.lit("s"), F.col("slot").cast("string")), F.lit("")).alias("_slot"), F.col(order).alias("_first"), *cells)
    distinct = distinct.groupBy("_slot", *languages).agg(F.min("_first").alias("_first"))
    placed = settled(numbered(distinct, ["_first", *languages], "_place", within=("_slot",)).drop("_first"), "placed")
    lasts = placed.groupBy("_slot").agg(*[F.coalesce(F.max(F.when(F.col(c) != "", F.col("_place"))), F.lit(0)).alias(f"_last{i}") for i, c in enumerate(languages)])
    last = [F.col(f"_last{i}") for i in range(len(languages))]
    over = [x < F.col("_place") for x in last]
    since = F.col("_place") - F.array_max(F.array(F.lit(0), *[F.when(t, x) for t, x in zip(over, last, strict=True)]))
    stretch = F.when(since > FIRST_STRETCH, F.ceil(F.log(4.0, since / FIRST_STRETCH))).otherwise(0)
    placed = placed.join(F.broadcast(lasts), "_slot").withColumns({"_held": _bits([F.col(c) != "" for c in languages]), "_alive": _bits([~t for t in over]), "_stretch": F.size(F.filter(F.array(*over), lambda t: t)) * 100 + stretch})
    # an empty row joins the first group, or the next row fills its own: only where there is no other does it matter
    placed = settled(placed.where((F.col("_held") != 0) | (F.array_max(F.array(F.lit(0), *last)) == 0)).drop(*[f"_last{i}" for i in range(len(languages))]), "placed")
    stretches = placed.groupBy("_stretch").agg(F.collect_set("_held").alias("masks"), F.count_if(F.col("_held") != F.col("_alive")).alias("gapped")).orderBy("_stretch").collect()
    group = ["_slot", "_place", *languages]
    now = lambda s: placed.where(F.col("_stretch") == s["_stretch"]).drop("_stretch")
    start = now(stretches[0]) if stretches else placed.where("false")
    gapped, found = _one_by_one(start.select(*group, "_alive", F.lit(None).cast("long").alias("_cover")), languages), None
    whole: list[str] = []  # tables of groups without gaps in what is alive
    for s in stretches[1:]:
        alive = F.broadcast(now(s).select("_slot", "_alive").distinct())
        gaps = F.coalesce(_without(F.col("_alive"), _bits([F.col(c) != "" for c in languages])), F.lit(1))
        split = gapped.join(alive, "_slot", "left").withColumn("_gaps", gaps)
        filled = split.where("_gaps = 0").select(*group)
        filled = settled(filled if found is None else filled.unionByName(found), "whole")
        whole.append(TABLES[-1])
        known = filled.sparkSession.read.schema(filled.schema).parquet(*whole)
        gapped, found = _next_stretch(now(s), alive, split.where("_gaps != 0").select(*group), known, languages, s["masks"], s["gapped"])
    groups = gapped if found is None else reduce(DataFrame.unionByName, [known, found, gapped])
    return numbered(groups, ["_place"], "group_no", within=("_slot",)).select(F.when(F.col("_slot") != "", F.substring("_slot", 2, 2**31 - 1)).alias("slot"), F.col("group_no").cast("int").alias("group_no"), *languages)


def _next_stretch(now: DataFrame, alive: DataFrame, gapped: DataFrame, whole: DataFrame, languages: list[str], masks: list[int], n_gapped: int) -> tuple[DataFrame, DataFrame]:
    """A stretch of rows (now) after the groups so far: all groups with gaps after it, and those that it adds for good."""
    key, group = ["_slot", *languages], ["_slot", "_place", *languages]
    asked = F.array(*[F.lit(m) for m in sorted(masks)])
    rows = now.select(*group, "_held", "_alive")
    known = whole.unionByName(gapped).join(alive, "_slot").select("_slot", "_place", *_among(F.col("_alive"), languages), "_alive")
    known = known.select(*group, _bits([F.col(c) != "" for c in languages]).alias("_held"), "_alive")
    # rows with gaps are covered by anything before that has their cells, other rows by groups with the same cells
    parts = rows.unionByName(known).withColumn("_part", F.explode(F.filter(asked, lambda m: (m.bitwiseAND(F.col("_held")) == m) & (m != F.col("_alive"))))).select("_slot", *_among(F.col("_part"), languages), "_place")
    at = rows.where("_held != _alive").select(*key, F.col("_place").alias("_at"))
    hits = parts.join(F.broadcast(at) if n_gapped <= BROADCAST_ROWS else at, key).where("_place < _at").groupBy("_slot", "_at").agg(F.min("_place").alias("_cover"))
    same = known.where("_held = _alive").groupBy(*key).agg(F.min("_place").alias("_cover"))
    hits = hits.unionByName(rows.where("_held = _alive").select(*key, F.col("_place").alias("_at")).join(same, key).select("_slot", "_at", "_cover"))
    rows = settled(rows.join(hits.withColumnRenamed("_at", "_place"), ["_slot", "_place"], "left"), "covered")
    # what may have gaps, by the cells that it can have in common with a row that fills one
    bare = (F.col("_held") != F.col("_alive")) & F.col("_cover").isNull()
    may = rows.where(bare).select(*group, "_held").unionByName(known.where("_held != _alive").select(*group, "_held"))
    common = F.array_distinct(F.transform(F.filter(asked, lambda m: _without(m, F.col("_held")) != 0), lambda m: m.bitwiseAND(F.col("_held"))))
    gaps = may.withColumn("_part", F.explode(common)).select("_slot", F.col("_held").alias("_of"), *_among(F.col("_part"), languages), "_place").groupBy("_slot", "_of", *languages).agg(F.min("_place").alias("_since"))
    gaps = few(settled(gaps, "gaps"), BROADCAST_ROWS)
    of = F.array(*[F.lit(r[0]) for r in gaps.select("_of").distinct().orderBy("_of").collect()]).cast("array<int>")
    fills = rows.withColumn("_of", F.explode(F.filter(of, lambda f: _without(F.col("_held"), f) != 0)))
    fills = fills.select("_slot", "_place", "_of", *_among(F.col("_of").bitwiseAND(F.col("_held")), languages)).join(gaps, ["_slot", "_of", *languages]).where("_since < _place")
    fills = fills.select("_slot", "_place", F.lit(True).alias("_fills")).distinct()
    rows = settled(rows.join(fills, ["_slot", "_place"], "left").withColumn("_turn", bare | F.col("_fills").isNotNull()), "turns")
    turns = rows.where("_turn").select(*group, "_alive", "_cover").unionByName(gapped.select(*group, F.lit(None).cast("int").alias("_alive"), F.lit(None).cast("long").alias("_cover")))
    return _one_by_one(turns, languages), rows.where("not _turn and _cover is null").select(*group)


def _one_by_one(turns: DataFrame, languages: list[str]) -> DataFrame:
    return settled(turns.groupBy("_slot").applyInPandas(lambda part: _first_fit(part, languages), "_slot string, _place long, " + ", ".join(f"`{c}` string" for c in languages)), "gapped")


def _first_fit(part: pd.DataFrame, languages: list[str]) -> pd.DataFrame:
    """Groups (no _alive) and rows of one slot → its groups. A row whose _cover, a place, is before all groups that it fits is in a
    group that is not here, and changes nothing.

    Cells are numbers in fields of one integer, 0 for a gap. By its set of languages, and cut to what rows can have in common with it,
    the groups with each key stand in a heap (one that has moved on goes when it is met); of groups without gaps the first is enough.
    """
    part = part.sort_values("_place")
    is_row = part["_alive"].notna()
    if not is_row.any():
        return part[["_slot", "_place", *languages]]
    alive = int(part["_alive"].max())
    packed, masks, fields, values, shift = [0] * len(part), [0] * len(part), [], [], 0
    for i, c in enumerate(languages):
        codes, known = pd.factorize(part[c].where(part[c] != ""))
        codes = (codes + 1).tolist()
        packed = [p | x << shift for p, x in zip(packed, codes, strict=True)]
        masks = [m | (x > 0) << i for m, x in zip(masks, codes, strict=True)]
        width = len(known).bit_length()
        fields.append(((1 << width) - 1) << shift)
        values.append((shift, ["", *known]))
        shift += width
    asked = {m for m, r in zip(masks, is_row, strict=True) if r}
    bits = cache(lambda s: sum(x for i, x in enumerate(fields) if s >> i & 1))
    shared = cache(lambda f: [(s, bits(s)) for s in {f & m for m in asked}])
    index: dict[int, dict[int, dict[int, int | list[int]]]] = {}
    places, states, held = [], [], []

    def put(g: int) -> None:
        f = held[g] & alive
        by = index.setdefault(f, {s: {} for s, _ in shared(f)})
        for s, b in shared(f):
            k = states[g] & b
            if f == alive:
                by[s][k] = min(g, by[s].get(k, g))
            else:
                heapq.heappush(by[s].setdefault(k, []), g)

    cover = part["_cover"].fillna(-1).astype("int64")
    for place, p, m, r, at in zip(part["_place"].tolist(), packed, masks, is_row.tolist(), cover.tolist(), strict=True):
        best = len(places)
        if r:
            for f, by in index.items():
                s = f & m
                g = by[s].get(p & bits(s))
                if isinstance(g, list):
                    while g and held[g[0]] & alive != f:
                        heapq.heappop(g)
                    g = g[0] if g else None
                if g is not None and g < best:
                    best = g
            if at >= 0 and (best == len(places) or places[best] > at):
                continue
        if best == len(places):
            places.append(place)
            states.append(p)
            held.append(m)
        elif m & ~held[best]:
            states[best] |= p
            held[best] |= m
        else:
            continue
        put(best)
    out = {"_slot": part["_slot"].iloc[0], "_place": places}
    return pd.DataFrame(out | {c: [known[(x & b) >> shift] for x in states] for c, b, (shift, known) in zip(languages, fields, values, strict=True)})


def majority_constituent(rows: DataFrame, languages: list[str], ignore: tuple[str, ...] = ("",)) -> DataFrame:
    """rows with `proto`: the most frequent segment of the row, the first of equals, in upper case. Within the row, no shuffle."""
    cells = F.filter(F.array(*[F.col(c) for c in languages]), lambda x: x.isNotNull() & ~x.isin(*ignore))
    best = F.array_max(F.transform(F.array_distinct(cells), lambda x: F.struct(F.size(F.filter(cells, lambda y: y == x)).alias("n"), (-F.array_position(cells, x)).alias("at"), x.alias("x"))))
    return rows.withColumn("proto", F.upper(best["x"]))


def _in_order(value: Column, order: str) -> Column:
    """Distinct values in first-seen order."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]))


def group_by_proto(rows: DataFrame, languages: list[str], order: str = "row_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Per proto segment (blank: U), and columns of `by`, the distinct segments of each language, comma-joined, in first-seen order."""
    proto = F.when(F.trim(F.coalesce("proto", F.lit(""))) == "", F.lit("U")).otherwise(F.trim("proto"))
    long = rows.select(*by, proto.alias("proto"), order, *languages).unpivot([*by, "proto", order], languages, "language", "seg").where("coalesce(seg, '') != ''")
    first = long.groupBy(*by, "proto", "language", "seg").agg(F.min(order).alias(order))
    lists = first.groupBy(*by, "proto", "language").agg(F.array_join(_in_order(F.col("seg"), order), ",").alias("segs"))
    return lists.groupBy(*by, "proto").pivot("language", languages).agg(F.first("segs"))


def reflex_table(records: DataFrame, languages: list[str]) -> DataFrame:
    """Set records (set_id, language, value, ord) → a row per set, the last non-null value of each language."""
    return records.where("value is not null").groupBy("set_id").pivot("language", languages).agg(F.max_by("value", "ord"))

