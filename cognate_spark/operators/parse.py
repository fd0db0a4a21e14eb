"""Parsing forms into correspondences (upstream) and predicting reflexes (downstream), as chains of joins.

The table is compiled into steps (language, last, canon state, next character) → token, correspondence, states after. A
frontier of unfinished parses is joined with the steps once per character or zero token; steps are small and local, so
Spark broadcasts them and the chain has no shuffle. Finished parses wait in a sink state until the frontier is written next. Every
distinct (language, glyphs) is parsed once.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shared import few, settled
from . import table as T
from .canon import compile_canon, has_lookaround

SINK = -9
#: Steps, of 150 bytes or so, that are broadcast: 300 MB would be the most; tables of 100 rows have some ten thousand.
MOST_STEPS = 1_000_000
NO_LAST = -1


def compile_steps(table: T.SoundTable, max_zero: int | None = None) -> tuple[DataFrame, int]:
    """steps, and the most zero tokens that may stand between two characters.

    Transitions and blocking come from the joins in `table`; their results, some hundreds of rows, are brought together
    with the canon here. Zero tokens that may follow each other for ever are an error unless max_zero limits them.
    """
    spark = table.corrs.sparkSession
    table = T.localized(table)
    node = T.local(T.nodes(table))
    rows = {r.ord: r for r in node.collect()}
    kept, conditional = (T.local(x) for x in T.block_less_specific(table, node))
    following, blocked = defaultdict(list), {}
    for r in kept.collect():
        following[r.last_ord].append(r.next_ord)
    before = T._as(node, "last").join(T._as(node.where("ord > 0"), "by"), T.left_ok("by", "last", table.mode)).select("by_ord", "last_ord")
    allows = defaultdict(list)
    for r in before.collect():
        allows[r.by_ord].append(r.last_ord)
    for r in conditional.collect():
        blocked[r.last_ord, r.next_ord] = sorted(allows[r.by_ord])
    tokens = defaultdict(lambda: defaultdict(list))
    for r in T.token_index(table.corrs).collect():
        tokens[r.language][r.ord].append(r.token)
    canon, steps, zero_moves = compile_canon(table.canon), [], set()
    for language, by_ord in tokens.items():
        for last, r in rows.items():
            if r.er == [T.END]:
                continue  # only word-final: nothing may follow
            for nxt in following[last]:
                c = rows[nxt]
                for q in sorted(canon.states):
                    for letters in sorted(set(c.syll or [])):
                        q2 = canon.after(q, letters)
                        if q2 is None:
                            continue
                        for token in by_ord.get(nxt, ()):
                            zero = token == T.ZERO
                            text = "" if zero else token
                            to = last if c.supra else nxt
                            steps.append((language, last, q, text[:1], text, c.corr_id, c.proto, letters, to, q2, bool(c.supra), int(zero), blocked.get((last, nxt), []), False))
                            if zero:
                                zero_moves.add((language, (last, q), (to, q2)))
        for last, r in rows.items():
            if r.er is None or T.END in r.er:
                steps += [(language, last, q, "", "", None, "", "", SINK, SINK, True, 0, [], True) for q in sorted(canon.accepting)]
        steps.append((language, SINK, SINK, "", "", None, "", "", SINK, SINK, True, 0, [], False))
    zeros = {(language, a) for language, a, _ in zero_moves}
    steps = [(*x, (x[0], (x[8], x[9])) in zeros) for x in steps]
    longest = _longest_path({(a, b) for _, a, b in zero_moves})
    if longest is None and max_zero is None:
        raise ValueError("zero tokens of this table can follow each other for ever: set max_zero")
    if len(steps) > MOST_STEPS:
        raise ValueError(f"the table compiles to {len(steps)} steps; more than {MOST_STEPS} are not sent to all tasks")
    schema = "language string, last int, q int, ch string, token string, corr_id string, step_proto string, letters string, to int, q2 int, keeps boolean, zero int, blocked array<int>, final boolean, more boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    packed = pa.Table.from_pylist([dict(zip(names, x, strict=True)) for x in steps], to_arrow_schema(StructType.fromDDL(schema)))
    return F.broadcast(spark.createDataFrame(packed, schema)), longest or 0


def _longest_path(edges: set[tuple]) -> int | None:
    """Moves on the longest path, or None if there is a circle."""
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    depth: dict = {}

    def of(x: tuple, above: frozenset) -> int | None:
        if x in above:
            return None
        if x not in depth:
            below = [of(y, above | {x}) for y in after.get(x, ())]
            if None in below:
                return None
            depth[x] = 1 + max(below) if below else 0
        return depth[x]

    found = [of(a, frozenset()) for a in list(after)]
    return None if None in found else max(found, default=0)


def parse_forms(forms: DataFrame, table: T.SoundTable, max_zero: int | None = None, longest: int | None = None, write_every: int = 5) -> DataFrame:
    """language, glyphs, rcn (correspondence ids), proto: the set of all parses of the distinct (language, glyphs).

    max_zero: the most zero tokens in a parse; needed only if the table lets them follow each other for ever. longest: of the forms,
    found by an aggregate if not given. After every write_every joins the frontier is written, so that plans stay short, and finished
    parses leave it; the chain ends when no parse is unfinished.
    """
    steps, zeros = compile_steps(table, max_zero)
    work = forms.select("language", "glyphs").distinct()
    if longest is None:
        longest = work.agg(F.max(F.length("glyphs"))).first()[0] or 0
    unlimited = max_zero is None
    most_zero = zeros * (longest + 1) if unlimited else max_zero
    start = compile_canon(table.canon).start
    look = has_lookaround(table.canon)
    state = work.select("language", "glyphs", F.lit(0).alias("pos"), F.lit("").alias("rcn"), F.lit("").alias("proto"), F.lit("").alias("syll"), F.lit(0).alias("last"), F.lit(NO_LAST).alias("lastlast"), F.lit(start).alias("q"), F.lit(0).alias("zeros"), F.lit(True).alias("more"))
    done, going = [], True
    for i in range(longest + most_zero + 1):
        state = _advanced(state, steps, most_zero, look)
        if i % write_every == write_every - 1:
            state = settled(state, "frontier")
            done.append(state.where(F.col("last") == SINK))
            state = state.where(F.col("last") != SINK)
            going = not state.isEmpty()
            if not going:
                break
    if going:
        done.append(state.where(F.col("last") == SINK))
    ended = reduce(DataFrame.unionByName, done)
    if look:
        ended = ended.where(F.col("syll").rlike(f"^(?:{table.canon})$"))
    return ended.select("language", "glyphs", "rcn", "proto").distinct().withColumn("rcn", F.expr(f"slice(split(rcn, '{_ID}'), 2, length(rcn))"))


#: Stands before each id of a parse that is going on.
_ID = "\x1f"


def _advanced(state: DataFrame, steps: DataFrame, most_zero: int, look: bool) -> DataFrame:
    """The frontier a token further. A state is joined by its next character; by none if it is at the word's end, or may take a zero token."""
    at = F.substring(F.col("glyphs"), F.col("pos") + 1, F.lit(1))
    tried = F.when(at == "", F.array(F.lit(""))).when(F.col("more"), F.array(at, F.lit(""))).otherwise(F.array(at))
    keyed = state.withColumn("ch", F.explode(tried)).drop("more")
    token_fits = F.substring(F.col("glyphs"), F.col("pos") + 1, F.length("token")) == F.col("token")
    ends = ~F.col("final") | (F.col("pos") >= F.length("glyphs"))
    free = ~F.array_contains("blocked", F.col("lastlast")) & (F.col("zeros") + F.col("zero") <= most_zero)
    moved = keyed.join(steps, ["language", "last", "q", "ch"]).where(token_fits & ends & free)
    rcn = F.when(F.col("corr_id").isNotNull(), F.concat("rcn", F.lit(_ID), "corr_id")).otherwise(F.col("rcn"))
    return moved.select("language", "glyphs", (F.col("pos") + F.length("token")).alias("pos"), rcn.alias("rcn"), F.concat("proto", "step_proto").alias("proto"), (F.concat("syll", "letters") if look else F.lit("")).alias("syll"), F.col("to").alias("last"), F.when(F.col("keeps"), F.col("lastlast")).otherwise(F.col("last")).alias("lastlast"), F.col("q2").alias("q"), (F.col("zeros") + F.col("zero")).alias("zeros"), "more")


def project_back(forms: DataFrame, parses: DataFrame) -> DataFrame:
    """Every form with each of its reconstructions; forms have parse_glyphs, what they are parsed as."""
    return forms.join(parses.withColumnRenamed("glyphs", "parse_glyphs"), ["language", "parse_glyphs"])


def failed_parses(forms: DataFrame, parses: DataFrame) -> DataFrame:
    return forms.join(parses.select("language", F.col("glyphs").alias("parse_glyphs")).distinct(), ["language", "parse_glyphs"], "left_anti")


def ids_string(rcn: Column) -> Column:
    """Ids padded to four places and joined by a blank."""
    return F.array_join(F.transform(rcn, lambda x: F.when(F.length(x) < 4, F.lpad(x, 4, " ")).otherwise(x)), " ")


def syllable_structure(sylls: Column) -> Column:
    """sylls: an array of syllable-type arrays; ambiguous ones in parentheses."""
    return F.array_join(F.transform(sylls, lambda s: F.when(F.size(s) > 1, F.concat(F.lit("("), F.array_join(s, ","), F.lit(")"))).otherwise(F.get(s, F.lit(0)))), "")


def reconstruction_strings(parses: DataFrame, corrs: DataFrame) -> DataFrame:
    """parses with ids and syllables. The table becomes one map, one row."""
    one = corrs.agg(F.map_from_entries(F.collect_list(F.struct("corr_id", "syll"))).alias("_syll"))
    return parses.join(F.broadcast(one)).select("*", ids_string(F.col("rcn")).alias("ids"), syllable_structure(F.transform("rcn", lambda x: F.try_element_at("_syll", x))).alias("syllables")).drop("_syll")


def postdict(protos: DataFrame, table: T.SoundTable, max_zero: int | None = None) -> DataFrame:
    """proto, language, reflex: all that the proto forms can become, over all their parses. protos: proto.

    A frontier: what is said so far and the correspondences still to come. Each position is a join with the outcomes, and what is
    then alike is one row, so beginnings are never multiplied before they are told apart. Finished reflexes leave it.
    """
    own = table.corrs.withColumn("daughters", F.create_map(F.lit("*"), F.array("proto")))
    plain = T.SoundTable(own, table.classes, table.canon, table.supra, table.mode, table.panini)
    parses = parse_forms(protos.select(F.lit("*").alias("language"), F.col("proto").alias("glyphs")), plain, max_zero).select(F.col("glyphs").alias("proto"), "rcn")
    outcome = F.when(F.col("seg") == T.ZERO, F.lit("")).otherwise(F.col("seg"))
    segments = table.corrs.select("corr_id", F.explode("daughters").alias("language", "segs")).select("corr_id", "language", F.explode("segs").alias("seg"))
    outcomes = few(settled(segments.select("corr_id", "language", outcome.alias("said")).distinct(), "outcomes"), MOST_STEPS)
    rest = F.expr("slice(rest, 2, size(rest))").alias("rest")
    first = parses.select("proto", F.col("rcn").alias("rest")).withColumn("corr_id", F.get("rest", F.lit(0)))
    state = settled(first.join(outcomes, "corr_id").select("proto", "language", rest, F.col("said").alias("reflex")).distinct(), "said")
    done = state.where(F.size("rest") == 0)
    while not (going := state.where(F.size("rest") > 0)).isEmpty():
        step = going.withColumn("corr_id", F.get("rest", F.lit(0))).join(outcomes, ["corr_id", "language"])
        state = settled(step.select("proto", "language", rest, F.concat("reflex", "said").alias("reflex")).distinct(), "said")
        done = done.unionByName(state.where(F.size("rest") == 0))
    return done.select("proto", "language", "reflex").distinct()


# Undoing staged rules: one frontier a stage, joined with the rules once a letter. A rule's right context is kept as what must still
# follow: an array of groups, each the remainders of the contexts of which one has to come.


def _rule_steps(rules: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    """key, rule_id, token, input, left, right by language, stage and first letter, and one step that leaves a letter as it is."""
    def expanded(ctx: str) -> Column:
        whole = F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if classes else None
        parts = F.transform(ctx, lambda x: F.coalesce(F.try_element_at(whole, x), F.array(x)) if classes else F.array(x))
        return F.when(F.col(ctx).isNotNull(), F.array_sort(F.array_distinct(F.flatten(parts))))

    each = rules.select("rule_id", "stage", "input", expanded("ctx_l").alias("left"), expanded("ctx_r").alias("right"), F.explode("languages").alias("language"), "outcome")
    each = each.select("*", F.explode("outcome").alias("token")).where("token != ''")
    steps = each.select(_rule_key(F.col("language"), F.col("stage"), F.col("token")).alias("key"), "rule_id", "token", "input", "left", "right")
    none = F.lit(None).cast("array<string>")
    same = rules.sparkSession.range(1).select(F.lit("").alias("key"), F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("input"), none.alias("left"), none.alias("right"))
    return steps.unionByName(same)


def _rule_key(language: Column, stage: Column, text: Column) -> Column:
    return F.concat_ws("\x1f", language, stage.cast("string"), F.substring(text, 1, 1))


def _stage_letter(state: DataFrame, steps: DataFrame, stage: int) -> DataFrame:
    """The frontier with one more letter, or one more rule's outcome, read; words that are at their end stay."""
    rest = F.expr("substring(word, pos + 1)")
    keyed = state.withColumn("rest", rest).withColumn("key", F.explode(F.array(F.lit(""), _rule_key(F.col("language"), F.lit(stage), rest))))
    tried = keyed.join(F.broadcast(steps), "key").where(F.col("token").isNull() | F.col("rest").startswith(F.col("token")))
    said = F.coalesce("input", F.substring("rest", 1, 1))
    at_end = F.col("rest") == ""
    follows = F.forall("open", lambda g: F.exists(g, lambda c: F.startswith(said, c) | F.startswith(c, said)))
    after = F.exists("left", lambda c: F.when(c == T.START, F.col("made") == "").otherwise(F.endswith(F.col("made"), c)))
    allowed = tried.where((at_end & F.col("rule_id").isNull()) | (follows & F.coalesce(after, F.lit(True)) & ~at_end))
    longer = lambda g: F.transform(F.filter(g, lambda c: F.startswith(c, said) & ~F.startswith(said, c)), lambda c: F.substring(c, F.length(said) + 1, F.length(c)))
    left_open = F.filter(F.transform("open", longer), lambda g: F.size(g) > 0)
    opened = F.when(at_end, F.col("open")).when(F.col("right").isNull(), left_open).otherwise(F.concat(F.array("right"), left_open))
    step = F.when(at_end, 0).otherwise(F.coalesce(F.length("token"), F.lit(1)))
    used = F.when(F.col("rule_id").isNull(), F.col("used")).otherwise(F.concat("used", F.array("rule_id")))
    return allowed.select("language", "glyphs", "word", "history", (F.col("pos") + step).alias("pos"), F.concat("made", said).alias("made"), opened.alias("open"), used.alias("used"))


def undo_rules(forms: DataFrame, rules: DataFrame, classes: dict[str, list[str]] | None = None, write_every: int = 8) -> DataFrame:
    """language, glyphs, stage0, history: all forms from which the glyphs come by the language's rules, from the highest stage
    to the lowest; history lists the stages that applied a rule, the earliest first. Rules (some dozens) are broadcast; a word's
    letters are read by as many joins as the longest one has, without a shuffle, and the frontier is written after every write_every."""
    steps = settled(_rule_steps(rules, classes or {}), "rule-steps")
    history = "array<struct<glyphs:string,rule_ids:array<string>>>"
    found = forms.select("language", "glyphs").distinct().select("language", "glyphs", F.col("glyphs").alias("word"), F.array().cast(history).alias("history"))
    for stage in sorted({r.stage for r in rules.select("stage").distinct().collect()}, reverse=True):  # a row a stage
        found = settled(found, "stage")
        longest = found.agg(F.max(F.length("word"))).first()[0] or 0
        state = found.select("*", F.lit(0).alias("pos"), F.lit("").alias("made"), F.array().cast("array<array<string>>").alias("open"), F.array().cast("array<string>").alias("used"))
        for i in range(longest):
            state = _stage_letter(state, steps, stage)
            if i % write_every == write_every - 1:
                state = settled(state, "undone")
        done = state.where(F.forall("open", lambda g: F.array_contains(g, T.END)))
        entry = F.array(F.struct(F.col("made").alias("glyphs"), F.col("used").alias("rule_ids")))
        found = done.select("language", "glyphs", F.col("made").alias("word"), F.when(F.size("used") > 0, F.concat(entry, "history")).otherwise(F.col("history")).alias("history"))
    return found.select("language", "glyphs", F.col("word").alias("stage0"), "history")
