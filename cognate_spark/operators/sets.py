"""Cognate sets: forms of different languages that share a reconstruction and a meaning; the maximal ones of them.

A projection row is one form with one of its reconstructions: language, key (identity of the form), gloss, kind,
attested (keys of the attested forms below it), rcn, proto. Forms merge by key. Supports are sorted arrays of keys.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gloss import normalize_gloss
from ..schemas import form_key, set_digest, set_key
from ..shared import few, ranked, settled
from . import parse as P
from .lexicon import usable_forms, with_variants
from .table import SoundTable

DEFAULT_MEL = ""


def keyed_forms(forms: DataFrame) -> DataFrame:
    """Forms to parse (with parse_glyphs and kind) with key and attested: attested forms merge by language, glyphs and gloss,
    a variant is itself by its row and its alternative."""
    own = form_key()
    variant = F.concat_ws("‖", "kind", F.coalesce("form_id", F.lit("")), own, "parse_glyphs")
    return forms.withColumn("key", F.when(F.col("kind") == "modern", own).otherwise(variant)).withColumn("attested", F.array(own))


def gloss_candidates(glosses: DataFrame) -> DataFrame:
    """gloss, term, exact: each gloss with itself and its normalised candidates."""
    norm = glosses.select("gloss", F.explode(normalize_gloss(F.col("gloss"))).alias("term"), F.lit(False).alias("exact"))
    return glosses.select("gloss", F.col("gloss").alias("term"), F.lit(True).alias("exact")).unionByName(norm)


def associate_mels(glosses: DataFrame, mels: DataFrame) -> DataFrame:
    """gloss, mel_id for glosses (gloss, modern): exact hits always, normalised ones only for glosses of attested forms. Glosses
    without a hit do not appear."""
    terms = mels.select("mel_id", F.explode("glosses").alias("term")).distinct()
    hits = gloss_candidates(glosses.select("gloss").distinct()).join(terms, "term").select("gloss", "mel_id", "exact").distinct()
    modern = glosses.groupBy("gloss").agg(F.max("modern").alias("modern"))
    return hits.join(modern, "gloss").where("exact or modern").select("gloss", "mel_id").distinct()


def with_mels(projection: DataFrame, mels: DataFrame | None, only_with_mel: bool = False) -> DataFrame:
    """Projection rows with mel_id, once for each mel of their gloss. Proto forms have the default mel, also when strict; so has
    all without mels."""
    if mels is None:
        return projection.withColumn("mel_id", F.lit(DEFAULT_MEL))
    plain = projection.where("kind != 'proto'")
    known = associate_mels(plain.where("gloss is not null").select("gloss", (F.col("kind") == "modern").alias("modern")), mels)
    found = plain.join(known, "gloss", "inner" if only_with_mel else "left").withColumn("mel_id", F.coalesce("mel_id", F.lit(DEFAULT_MEL)))
    return found.select(*projection.columns, "mel_id").unionByName(projection.where("kind = 'proto'").withColumn("mel_id", F.lit(DEFAULT_MEL)))


def create_sets(projection: DataFrame, mels: DataFrame | None = None, only_with_mel: bool = False) -> DataFrame:
    """rcn, proto, mel_id, support, attested, languages (how many): one row per reconstruction and meaning. Distinct rows come
    before the collecting, so a hot reconstruction moves its distinct keys alone."""
    rows = with_mels(projection, mels, only_with_mel).select("rcn", "proto", "mel_id", "language", "key", "attested").distinct()
    return rows.groupBy("rcn", "proto", "mel_id").agg(F.array_sort(F.collect_set("key")).alias("support"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("attested")))).alias("attested"), F.count_distinct("language").alias("languages"))


def root_sets(sets: DataFrame) -> DataFrame:
    return sets.where("languages > 1")


def singleton_sets(sets: DataFrame) -> DataFrame:
    return sets.where("languages <= 1")


def attested_support(sets: DataFrame, below: DataFrame) -> DataFrame:
    """sets whose support are keys of `below` (key, attested), with the attested forms under them."""
    id_ = set_digest(F.col("support"))
    each = sets.select(id_.alias("_id"), F.explode("support").alias("key")).distinct().join(below.select("key", F.explode("attested").alias("form")), "key")
    found = each.groupBy("_id").agg(F.array_sort(F.collect_set("form")).alias("attested"))
    return sets.drop("attested").withColumn("_id", id_).join(found, "_id").drop("_id")


#: Sets that a member may have before the pairs of those sets are told apart by a second member.
HOT_MEMBER = 1000
#: Words of 64 bits in a set's bit map of members.
_WORDS = 4


def _map_word(i: int) -> Column:
    """Of a set's members, the bits that their hashes set in a word: a superset has all of a subset's bits."""
    at = F.shiftrightunsigned(F.xxhash64("member"), 8 * i).bitwiseAND(F.lit(63)).cast("int")
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at)).alias(f"w{i}")


def proper_subsets(members: DataFrame, hot: int = HOT_MEMBER) -> DataFrame:
    """_key of those sets (_key, member, both of any size, each pair once) that are proper subsets of others.

    A superset holds the rarest member of its subset: sets meet on that member, a smaller with the larger ones, by size and a bit
    map of the members, which rules most pairs out. For those that are left the members in common are counted. No set is ever
    one row.

    A rarest member that more than `hot` sets have would make too many pairs. Among its sets, members are counted anew, and they
    meet on it and the one that is rarest there; a set of that member alone is lost if there is a larger one.
    """
    words = [f"w{i}" for i in range(_WORDS)]
    about = settled(members.groupBy("_key").agg(F.count("*").alias("n_own"), *[_map_word(i) for i in range(_WORDS)]), "about")
    counts = settled(members.groupBy("member").agg(F.count("*").alias("n")), "members")
    least = members.join(counts, "member").groupBy("_key").agg(F.min(F.struct("n", "member")).alias("r")).where("r.n > 1")
    rare = settled(least.join(about, "_key").select("_key", "n_own", *words, "r.n", "r.member"), "rarest")

    def pairs(small: DataFrame, large: DataFrame, on: list[str]) -> DataFrame:
        other = large.select(*on, F.col("_key").alias("_other")).join(about.select(F.col("_key").alias("_other"), F.col("n_own").alias("n_other"), *[F.col(w).alias(f"o{w}") for w in words]), "_other")
        inside = F.col("n_other") > F.col("n_own")
        for w in words:
            inside &= F.col(w).bitwiseAND(F.col(f"o{w}")) == F.col(w)
        return small.join(other, on).where(inside).select("_key", "_other", "n_own")

    hots = few(settled(rare.where(F.col("n") > hot).select("member").distinct(), "hot-members"))
    usual = rare.where(F.col("n") <= hot)
    found = pairs(usual, members.join(few(settled(usual.select("member").distinct(), "met-members")), "member", "left_semi"), ["member"])
    alone = rare.limit(0).select("_key")
    if not hots.isEmpty():
        crowd = settled(members.join(hots, "member"), "crowds")
        again = settled(crowd.join(members.withColumnRenamed("member", "second"), "_key").where("second <> member"), "crowds-again")
        times = settled(again.groupBy("member", "second").agg(F.count("*").alias("m")), "crowd-members")
        mine = rare.where(F.col("n") > hot)
        best = mine.select("_key", "member").join(again, ["_key", "member"]).join(times, ["member", "second"]).groupBy("_key", "member").agg(F.min(F.struct("m", "second")).alias("r")).where("r.m > 1")
        small = best.select("_key", "member", F.col("r.second").alias("second")).join(about, "_key")
        found = found.unionByName(pairs(small, again, ["member", "second"]))
        larger = again.select("member").distinct()
        alone = mine.where(F.col("n_own") == 1).join(larger, "member", "left_semi").select("_key")
    found = settled(found, "pairs")
    common = found.join(members, "_key").join(members.withColumnRenamed("_key", "_other"), ["_other", "member"])
    lost = common.groupBy("_key", "_other", "n_own").agg(F.count("*").alias("n")).where("n = n_own").select("_key")
    return lost.unionByName(alone).distinct()


def filter_subsets(sets: DataFrame, by: str = "attested", hot: int = HOT_MEMBER) -> DataFrame:
    """Sets whose `by` is not a proper subset of another's. Equal supports share their fate, so distinct ones are compared; they
    are known by digests."""
    keyed = settled(sets.withColumn("_key", set_digest(F.col(by))), "keyed")
    members = settled(keyed.groupBy("_key").agg(F.first(by).alias("s")).select("_key", F.explode("s").alias("member")), "supports")
    return keyed.join(proper_subsets(members, hot), "_key", "left_anti").drop("_key")


# Sets of any size: a row a set, and its support in blocks.

#: Keys of a block.
BLOCK_KEYS = 1000


@dataclass(frozen=True)
class SetBlocks:
    """sets: set_id, rcn, proto, mel_id, languages, n (keys of the support), print (the same for equal supports); members: set_id, member."""

    sets: DataFrame
    members: DataFrame

    def blocks(self, size: int = BLOCK_KEYS) -> DataFrame:
        """set_id, block, keys: the support in order, so many keys a row."""
        placed = ranked(self.members, "set_id", [F.col("member").asc()], "at").withColumn("block", F.floor(F.col("at") / size))
        return placed.groupBy("set_id", "block").agg(F.array_sort(F.collect_list("member")).alias("keys"))

    def where(self, condition: str) -> SetBlocks:
        kept = settled(self.sets.where(condition), "set-heads")
        return SetBlocks(kept, self.members.join(kept.select("set_id"), "set_id", "left_semi"))

    def maximal(self, hot: int = HOT_MEMBER) -> SetBlocks:
        """The sets whose support is not a proper subset of another's."""
        one = self.sets.groupBy(F.col("print").alias("_key")).agg(F.min("set_id").alias("set_id"))
        members = settled(self.members.join(one, "set_id").select("_key", "member"), "supports")
        lost = proper_subsets(members, hot)
        kept = settled(self.sets.join(lost.withColumnRenamed("_key", "print"), "print", "left_anti"), "set-heads")
        return SetBlocks(kept, self.members.join(kept.select("set_id"), "set_id", "left_semi"))


def set_blocks(projection: DataFrame, mels: DataFrame | None = None, only_with_mel: bool = False, attested: bool = False) -> SetBlocks:
    """The sets of `create_sets` without an array of a whole support anywhere: the default meaning's set may hold most forms of a
    corpus. attested: supports are the attested forms below."""
    rows = with_mels(projection, mels, only_with_mel)
    member = F.explode("attested") if attested else F.col("key")
    id_ = F.unhex(F.sha2(F.concat(F.array_join("rcn", "\x1f"), F.lit("\x1e"), "mel_id"), 256))
    each = settled(rows.select(F.substring(id_, 1, 16).alias("set_id"), "rcn", "proto", "mel_id", "language", member.alias("member")).distinct(), "set-rows")
    members = settled(each.select("set_id", "member").distinct(), "set-members")
    total = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(38,0)")).cast("string")
    about = members.groupBy("set_id").agg(F.count("*").alias("n"), total("member").alias("a"), total(F.lit(1), "member").alias("b"))
    heads = each.groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("rcn", "proto", "mel_id")], F.count_distinct("language").alias("languages"))
    return SetBlocks(settled(heads.join(about, "set_id").select("set_id", "rcn", "proto", "mel_id", "languages", "n", F.concat_ws("/", F.col("n").cast("string"), "a", "b").alias("print")), "set-heads"), members)


def pick_derivation(sets: DataFrame) -> DataFrame:
    """One reconstruction per proto string, mel and support: the least id string."""
    ids = P.ids_string(F.col("rcn"))
    rest = [c for c in sets.columns if c not in ("proto", "support")]
    best = sets.withColumn("_key", set_digest(F.col("support"))).groupBy("proto", "_key").agg(F.min(F.struct(ids.alias("ids"), "mel_id", F.struct(*rest, "support").alias("row"))).alias("b"))
    return best.select("proto", "b.ids", *[F.col(f"b.row.{c}").alias(c) for c in (*rest, "support")])


def projection(forms: DataFrame, table: SoundTable, max_zero: int | None = None, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(projection, failures) of keyed forms. With rules, forms are undone first: each stage-0 candidate is parsed, and its key
    holds the reconstruction and history besides."""
    if rules is None:
        parses = P.parse_forms(forms.select("language", F.col("parse_glyphs").alias("glyphs")), table, max_zero)
        return P.project_back(forms, parses).select("language", "key", "gloss", "kind", "attested", "rcn", "proto"), P.failed_parses(forms, parses)
    undone = P.undo_rules(forms.select("language", F.col("parse_glyphs").alias("glyphs")), rules, table.classes)
    parses = P.parse_forms(undone.select("language", F.col("stage0").alias("glyphs")), table, max_zero)
    found = undone.join(parses.withColumnRenamed("glyphs", "stage0"), ["language", "stage0"]).withColumnRenamed("glyphs", "parse_glyphs")
    both = forms.join(found, ["language", "parse_glyphs"])
    old = F.size("history") > 0
    key = F.when(old, F.concat_ws("‖", F.lit("stage0"), "key", F.array_join("rcn", " "), F.to_json("history"))).otherwise(F.col("key"))
    out = both.select("language", key.alias("key"), "gloss", F.when(old, "stage0").otherwise(F.col("kind")).alias("kind"), "attested", "rcn", "proto", "history")
    return out, forms.join(found.select("language", "parse_glyphs").distinct(), ["language", "parse_glyphs"], "left_anti")


def upstream(forms: DataFrame, table: SoundTable, mels: DataFrame | None = None, only_with_mel: bool = False, root: bool = True, fuzzy: DataFrame | None = None, quirks: DataFrame | None = None, rules: DataFrame | None = None, max_zero: int | None = None, keyed: bool = False) -> DataFrame:
    """The maximal sets of one node of the tree, one derivation each: proto, ids, rcn, mel_id, support, attested, languages."""
    ready = forms if keyed else keyed_forms(with_variants(usable_forms(forms), fuzzy, quirks))
    rows, _ = projection(ready, table, max_zero, rules)
    rows = settled(rows.drop("history"), "projection")  # parses are read once for the meanings and once for the sets,
    sets = settled(create_sets(rows, mels, only_with_mel), "sets")  # sets several times to compare them
    kept = filter_subsets(root_sets(sets), "attested") if root else filter_subsets(sets, "support")
    return pick_derivation(kept)


def parse_tree(text: str) -> dict[str, list[str]]:
    """`P1: P2, a; P2: b, c` as {proto: daughters}, the target first."""
    nodes = (x.split(":") for x in text.strip().rstrip(";").split(";"))
    return {k.strip(): [y.strip() for y in v.split(",")] for k, v in nodes}


def _print(df: DataFrame) -> str:
    """The same for the same rows, in whatever order: their number and sums over their hashes."""
    h = F.xxhash64(*[F.to_json(F.map_entries(c)) if t.startswith("map") else F.col(c) for c, t in df.dtypes])
    low, high = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftright(h, 31)
    return "-".join(str(x) for x in df.agg(F.count("*"), F.coalesce(F.sum(low.cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(high.cast("decimal(38,0)")), F.lit(0)), F.bit_xor(h)).first())


def upstream_tree(tree: str, forms: DataFrame, tables: dict[str, SoundTable], path: str, mels: DataFrame | None = None, only_with_mel: bool = False, max_zero: int | None = None) -> DataFrame:
    """Sets of the tree's target. Lower nodes come first; their sets are the forms of the next level; only the target drops sets of
    one language.

    A node's sets are written to path/<node>-<fingerprint>. The fingerprint is a hash of all that they come from: the node's forms, its
    table, the meaning elements and settings, and the fingerprints of the nodes below. A run that finds a node's folder whole
    reads it, so a broken run goes on where it was, and a second one writes nothing.
    """
    nodes = parse_tree(tree)
    target = next(iter(nodes))
    leaves = keyed_forms(with_variants(usable_forms(forms)))
    spark, made, prints = forms.sparkSession, {}, {}
    mel_print = "" if mels is None else _print(mels)
    hadoop = spark._jvm.org.apache.hadoop.fs

    def of(node: str) -> DataFrame:
        if node in made:
            return made[node]
        parts = [as_forms(of(d), d) if d in nodes else leaves.where(F.col("language") == d).select("language", "key", "gloss", "kind", "attested", "parse_glyphs") for d in nodes[node]]
        table = tables[node]
        said = [prints.get(d) or _print(x) for d, x in zip(nodes[node], parts, strict=True)]
        about = (node, nodes[node], said, _print(table.corrs), sorted(table.classes.items()), table.canon, table.supra, table.mode, table.panini, mel_print, only_with_mel, node == target, max_zero)
        prints[node] = sha256(repr(about).encode()).hexdigest()[:32]
        folder = f"{path}/{node}-{prints[node]}"
        done = hadoop.Path(f"{folder}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            upstream(rows, table, mels, only_with_mel, node == target, max_zero=max_zero, keyed=True).write.mode("overwrite").parquet(folder)
        made[node] = spark.read.parquet(folder)
        return made[node]

    return of(target).withColumn("proto_language", F.lit(target))


def as_forms(sets: DataFrame, language: str) -> DataFrame:
    """Sets as forms of their proto language."""
    key = F.concat_ws("‖", F.lit(language), "ids", "mel_id", set_key(F.col("support")))
    return sets.select(F.lit(language).alias("language"), key.alias("key"), F.lit(None).cast("string").alias("gloss"), F.lit("proto").alias("kind"), "attested", F.col("proto").alias("parse_glyphs"))


def competing_reconstructions(sets: DataFrame) -> DataFrame:
    """Proto strings of sets with the same support: support, protos, n."""
    key = set_digest(F.col("support"))
    return sets.withColumn("_key", key).groupBy("_key").agg(F.first("support").alias("support"), F.array_sort(F.collect_set("proto")).alias("protos"), F.count("*").alias("n")).drop("_key")


def isolates(sets: DataFrame, singletons: DataFrame) -> DataFrame:
    """form, ids: attested forms that no set has, with the single-language reconstructions they are in."""
    alone = singletons.select(F.explode("attested").alias("form"), P.ids_string(F.col("rcn")).alias("ids")).distinct()
    return alone.join(sets.select(F.explode("attested").alias("form")).distinct(), "form", "left_anti").groupBy("form").agg(F.array_sort(F.collect_set("ids")).alias("ids"))

