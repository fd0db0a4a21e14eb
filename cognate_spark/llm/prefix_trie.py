"""Prefix trie of conversations, laid out by a van Emde Boas recursion: which beginnings are shared, by how many, and what that saves.

A conversation is a sequence of turns; a node is a distinct beginning of d turns. The trie is never walked turn by turn. Sequences are
cut at half depth: the cut prefix gets a name, the hash of its root's name and of the turns since, and becomes the root of the
lower forest, while the upper trie keeps the old root; both halves are cut again at the same time, until a piece is one turn high.
All cuts are aligned to powers of two, so what a name needs of the turns between is a digest of an aligned piece, and those
are made once, from short pieces to long ones. Both ways take PAGE_BITS halvings in one step: a page holds PAGE children, so a
step groups at most that many rows, and a conversation of n turns takes log(n) / log(PAGE) steps, whatever its share of the table.

Totals are grafted upward in the order of the pieces' heights. When two pieces of height h become one of height 2 h, what stands
below each cut node is summed in its lower piece, and goes to the node's ancestors in the upper piece, all of them at once: they
are read off the path of the least member. Log(n) rounds give every node the sum over its whole subtree.

Nothing is collected, and no group holds more than PAGE turns or DIGEST_IDS ids. Digests and names are 16 bytes of SHA-256.

Turns without a conv_id belong to no conversation. Null roles and texts are empty; null turn numbers come first; turns of one
number stand in the order of their digests. Repeated rows are turns by themselves. An empty table has no node. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, written

PAGE_BITS = 4
PAGE = 1 << PAGE_BITS
#: Rows that share a conv_id are joined in chunks of so many turns (a power of two), and ids of a node's members in ranges of so many.
CHUNK_BITS, DIGEST_BITS = 12, 12
DIGEST_IDS = 1 << DIGEST_BITS


def _sha(x: Column) -> Column:
    return F.substring(F.unhex(F.sha2(x, 256)), 1, 16)


ROOT = b"\0" * 16


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (1, 2, 3 … by turn), sym (digest of role and text) and size (bytes of the text)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    sym = _sha(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", sym.alias("sym"), F.octet_length(text).cast("long").alias("size"))
    placed = ranked(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("sym").asc()], "pos")
    return placed.select("conv_id", (F.col("pos") + 1).alias("pos"), "sym", "size")


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """conv_id, pos, sym, size, len of rebuilt conversations, and for each a last row without sym at len + 1.

    Conversation c gets the first h = crc32(c) % most turns of conversation c - c % family (all if there are fewer), then its own
    after its first h.
    """
    all_ = written(turns(conversations), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    known = written(all_.groupBy("conv_id").agg(F.max("pos").alias("n")), "conversations")
    hosts = known.select(F.col("conv_id").alias("host"), F.col("n").alias("n_host"))
    each = known.withColumns({"h": h, "host": F.try_subtract("conv_id", F.pmod("conv_id", F.lit(family)))}).join(hosts, "host", "left")
    taken = F.least(F.col("h"), F.coalesce("n_host", F.lit(0)))
    guests = each.select("conv_id", "n", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    guests = written(guests, "guests")

    heads = all_.where(F.col("pos") < most).where(F.pmod("conv_id", F.lit(family)) == 0)
    offered = heads.select(F.explode(F.array(*[F.try_add("conv_id", F.lit(i).cast("long")) for i in range(family)])).alias("conv_id"), "pos", "sym", "size")
    begin = offered.join(guests.select("conv_id", "taken", "len"), "conv_id").where("pos <= taken").select("conv_id", "pos", "sym", "size", "len")
    chunk = F.shiftright("pos", CHUNK_BITS).cast("int")
    own = all_.where(F.col("pos") > h).withColumn("chunk", chunk)
    parts = guests.where("n > h").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.shiftright("n", CHUNK_BITS).cast("int"))))
    rest = own.join(parts, ["conv_id", "chunk"]).select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "sym", "size", "len")
    ends = guests.select("conv_id", (F.col("len") + 1).alias("pos"), F.lit(None).cast("binary").alias("sym"), F.lit(None).cast("long").alias("size"), "len")
    return begin.unionByName(rest).unionByName(ends)


def _piece(parts: Column, lo: int, hi: int) -> Column:
    """Digest of an aligned piece of a page from the digests of its parts; null if one is missing."""
    if hi - lo == 1:
        return F.get(parts, F.lit(lo))
    mid = (lo + hi) // 2
    return _sha(F.concat(_piece(parts, lo, mid), _piece(parts, mid, hi)))


def _cuts(root: Column, parts: Column, lo: int, hi: int) -> list[Column]:
    """Names of the cuts between lo and hi: at half depth first, then those of the upper piece and of the lower forest."""
    if hi - lo == 1:
        return []
    mid = (lo + hi) // 2
    cut = _sha(F.concat(root, _piece(parts, lo, mid)))
    return [*_cuts(root, parts, lo, mid), cut, *_cuts(cut, parts, mid, hi)]


def _pages(rows: DataFrame, more: list[Column]) -> DataFrame:
    """rows (conv_id, at, part: null where a piece is not whole) by pages: conv_id, page, parts in order, whole (digest of a full page)."""
    part = F.when(F.col("part").isNotNull(), F.struct((F.col("at") % PAGE).alias("i"), "part"))
    page = rows.groupBy("conv_id", F.shiftright("at", PAGE_BITS).alias("page")).agg(F.array_sort(F.collect_list(part)).alias("p"), *more)
    page = page.withColumn("parts", F.transform("p", lambda x: x["part"])).drop("p")
    return page.withColumn("whole", F.when(F.size("parts") == PAGE, _piece(F.col("parts"), 0, PAGE)))


def paths(sequences: DataFrame) -> DataFrame:
    """conv_id, depth, name, parent (null at the root), size (bytes of the last text), len: the nodes of each conversation.
    sequences: as `rebuilt` gives them."""
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("at", "size"))), lambda x: x["size"]).alias("sizes")
    rows = sequences.select("conv_id", (F.col("pos") - 1).alias("at"), F.col("sym").alias("part"), "size", "len")
    levels = [written(_pages(rows, [sizes, F.max("len").alias("len")]), "pages")]
    longest = levels[0].agg(F.max("page")).first()[0]
    while longest:
        level = levels[-1].select("conv_id", F.col("page").alias("at"), F.col("whole").alias("part"))
        levels.append(written(_pages(level, []), "pages"))
        longest >>= PAGE_BITS
    named = levels[-1].withColumn("root", F.lit(ROOT))
    for below in reversed(levels[:-1]):
        child = named.select("conv_id", F.posexplode(_roots()).alias("i", "root"), "page")
        named = written(below.join(child.select("conv_id", (F.col("page") * PAGE + F.col("i")).alias("page"), "root"), ["conv_id", "page"]), "named")
    named = written(named.withColumn("names", _roots()), "names")
    last = named.where(F.size("parts") == PAGE).select("conv_id", (F.col("page") + 1).alias("page"), F.get("names", F.lit(PAGE - 1)).alias("before"), F.get("sizes", F.lit(PAGE - 1)).alias("size_before"))
    joined = named.join(last, ["conv_id", "page"], "left")
    i = F.col("i")
    each = joined.select("conv_id", "page", "len", "before", "size_before", "names", "sizes", F.posexplode("names").alias("i", "name"))
    parent = F.when(i > 0, F.get("names", i - 1)).otherwise(F.col("before"))
    size = F.when(i > 0, F.get("sizes", i - 1)).otherwise(F.coalesce("size_before", F.lit(0).cast("long")))
    return each.select("conv_id", (F.col("page") * PAGE + i).alias("depth"), "name", parent.alias("parent"), size.alias("size"), "len")


def _roots() -> Column:
    """Names of the roots of a page's children: as many as it has whole pieces, and one more if it is not full."""
    root, parts = F.col("root"), F.col("parts")
    return F.slice(F.array(root, *_cuts(root, parts, 0, PAGE)), 1, F.least(F.size(parts) + 1, F.lit(PAGE)))


def grafted(nodes: DataFrame, path: DataFrame, values: list[str], depth: int) -> DataFrame:
    """name and the sums of the values over each node's subtree, the node included. nodes: name, depth, parent, parent_conv_id and the
    values; path: conv_id, depth, name, len; depth: of the deepest node."""
    sums = [F.sum(v).alias(v) for v in values]
    parts = nodes.select("name", "depth", "parent", "parent_conv_id", *values)
    level = 1
    while (1 << (level - 1)) < depth:
        half = 1 << (level - 1)
        below = parts.where((F.col("depth") > 1) & ((F.col("depth") - 1) % (2 * half) == half))  # the tops of lower forests
        cut = below.groupBy("parent", "parent_conv_id", "depth").agg(*sums)
        up = cut.select(F.col("parent_conv_id").alias("conv_id"), F.explode(F.sequence(F.col("depth") - half, F.col("depth") - 1)).alias("depth"), *values)
        start = F.col("depth") - 1 - (F.col("depth") - 1) % (2 * half)
        upper = path.where((F.col("depth") > 0) & (F.col("depth") - start <= half) & (F.col("len") >= start + half))
        more = upper.select("conv_id", "depth", "name").join(up, ["conv_id", "depth"]).groupBy("name", "depth").agg(*sums)
        more = written(more, "grafted")
        place = more.join(nodes.select("name", "parent", "parent_conv_id"), "name")
        parts = parts.unionByName(written(place.select("name", "depth", "parent", "parent_conv_id", *values), "grafted"))
        level += 1
    total = written(parts.groupBy("name").agg(*sums), "totals")
    top = parts.where("depth = 1").agg(*sums)  # the forest under the root
    root = nodes.where("depth = 0").select("name", *[F.col(v).alias(f"own_{v}") for v in values]).join(F.broadcast(top))
    whole = root.select("name", *[(F.col(f"own_{v}") + F.coalesce(v, F.lit(0))).cast("long").alias(v) for v in values])
    return total.join(nodes.where("depth > 0").select("name"), "name").select("name", *[F.col(v).cast("long").alias(v) for v in values]).unionByName(whole)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by name, each a piece of a node's list: the digest of each list, a piece at a time."""
    name, state = None, None
    names: list[bytes] = []
    out: list[str] = []
    for batch in batches:
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n != name:
                if name is not None:
                    names.append(name), out.append(state.hexdigest())
                name, state = n, sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.string())], ["name", "ends_sha256"])
        names, out = [], []
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["name", "ends_sha256"])


def ends_digest(path: DataFrame) -> DataFrame:
    """name, ends_sha256 of nodes at which conversations end: ids meet in ranges of DIGEST_IDS, and the ranges in their order."""
    ends = path.where("depth = len").groupBy("name", F.shiftright("conv_id", DIGEST_BITS).alias("range")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return ends.repartition("name").sortWithinPartitions("name", "range").select("name", "ids").mapInArrow(_digests, "name binary, ends_sha256 string")


def trie(sequences: DataFrame) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. sequences: as `rebuilt` gives them."""
    path = written(paths(sequences), "paths")
    first = path.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("size").alias("size"))
    first = written(first, "nodes")
    above = first.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    children = first.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    placed = written(first.join(above, "parent", "left"), "placed")
    nodes = placed.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = written(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("size")}), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = grafted(nodes, path.select("conv_id", "depth", "name", "len"), ["n_leaves", "saved_tokens"], deepest)
    whole = nodes.drop("n_leaves", "saved_tokens").join(totals, "name").join(ends_digest(path), "name", "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))
