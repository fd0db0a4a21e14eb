"""Quality rules as a short-circuit cascade, with built-in functions only.

A rule rejects documents by a few features of the whole text. `plan_cascade` times each rule on a sample
and sees which sampled documents it rejects; the order is greedy: next comes the rule that rejects most of
what the earlier ones leave, per second. `cascade` evaluates the rules in that order in one CASE, so that a
document that an early rule rejects never pays for a later one. The verdict is the same in any order.

Null and empty texts have no words and are too short. Rows may repeat; each is judged by itself, nothing is
shuffled. Other columns pass through. `with_features` replaces columns named as the features it adds, `cascade` those named
`rejected_by` and `kept`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused, words, written


@dataclass(frozen=True)
class Rule:
    """Rejects the documents for which rejects(features) is true; uses names the features."""

    name: str
    uses: tuple[str, ...]
    rejects: Callable[[dict[str, Column]], Column]


#: Features that are counted from the words; the others come from the text.
OF_WORDS = ("n_words", "word_chars", "n_repeat_words")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks")
BASE = (
    Rule("too_short", ("n_words",), lambda f: f["n_words"] < 50),
    Rule("repetitive", ("n_words", "n_repeat_words"), lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
)
RULES = (
    *BASE,
    Rule("word_length", ("n_words", "word_chars"), lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])),
    Rule("symbols", ("n_words", "n_symbols"), lambda f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("dup_lines", ("n_words", "n_dup_lines"), lambda f: 12 * f["n_dup_lines"] > f["n_words"]),
    Rule("capitals", ("word_chars", "n_capitals"), lambda f: 2 * f["n_capitals"] > f["word_chars"]),
    Rule("marks", ("n_words", "n_marks"), lambda f: 4 * f["n_marks"] > f["n_words"]),
)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def repeat_words(w: Column) -> Column:
    """Words of the array that lie in a 3-word window found twice or more in it, the first one included.

    Windows are sorted with their places; those equal to a neighbour give their places, and a fold over the
    ordered places adds what each window covers beyond the one before: n log n in the words of a text.
    """
    n = F.size(w)
    at = F.sequence(F.lit(0), n - 3)
    hash_at = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    window = lambda i: F.struct(hash_at(i).alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))
    same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def places(s: Column) -> Column:
        is_at = lambda x, k: F.coalesce(same(x, F.get(s, k)), F.lit(False))  # noqa: E731  get gives null outside
        return F.sort_array(F.transform(F.filter(s, lambda x, k: is_at(x, k + 1) | is_at(x, k - 1)), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = lambda p: F.aggregate(p, start, lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"].cast("long"))
    hashes = F.transform(at, hash_at)
    none = F.lit(0).cast("long")
    # the hashes alone settle a text in which no window comes twice
    return F.when(n < 3, none).when(_let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), none).otherwise(covered(_let(F.sort_array(F.transform(at, window)), places)))


def _features(w: Column) -> dict[str, Column]:
    """By name, over the column `text` and its words w."""
    text = text_of("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": F.when(F.instr(text, "\n") == 0, F.lit(0)).otherwise(F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0))).cast("long"),
        "n_repeat_words": repeat_words(w),
        "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        "n_marks": F.regexp_count(text, F.lit("[!?]")).cast("long"),
    }


def with_features(docs: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Adds the features named, counted over the whole text; the words are split once."""
    (own,) = unused(docs, "words")
    cols = _features(F.col(own))
    if not any(k in OF_WORDS for k in names):
        return docs.withColumns({k: cols[k] for k in names}) if names else docs
    return docs.withColumn(own, words(text_of("text"))).withColumns({k: cols[k] for k in names}).drop(own)


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, seed: int = 7, given: tuple[str, ...] = ()) -> list[dict]:
    """The rules in the order to run them, each with its seconds per document and the share it rejects.

    The sample is a Bernoulli sample of about twice `sample_rows` rows, cut to so many, in the shared folder; no text comes to
    the driver. It touches the order alone. A rule's cost is the least of three timings, less what a job without a rule
    takes; features that are `given` cost nothing. A share counts those that the rules before leave.
    Without documents the order is the one given.
    """
    share = min(1.0, 2 * sample_rows / max(docs.count(), 1))
    sample = written(with_features(docs.select("text").sample(fraction=share, seed=seed).limit(sample_rows), given), "sample")
    if not (n := sample.count()):
        return [{"rule": r.name, "seconds": 0.0, "rejects": 0.0} for r in rules]
    columns = {k: F.col(k) for k in FEATURES}

    def timed(uses: tuple[str, ...], rejects: Column) -> float:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            with_features(sample, tuple(k for k in uses if k not in given)).agg(F.count_if(rejects), F.sum(F.length("text"))).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    nothing = timed((), F.lit(False))
    seconds = {r.name: max(timed(r.uses, r.rejects(columns)) - nothing, 1e-4) / n for r in rules}
    hit = F.array_compact(F.array(*[F.when(r.rejects(columns), F.lit(r.name)) for r in rules]))
    all_ = with_features(sample, tuple(k for k in FEATURES if k not in given))
    groups = [(set(x["hit"]), x["n"]) for x in all_.groupBy(hit.alias("hit")).agg(F.count("*").alias("n")).collect()]
    out, left = [], list(rules)
    while left:
        total = sum(k for _, k in groups) or 1
        share = {r.name: sum(k for h, k in groups if r.name in h) / total for r in left}
        best = max(left, key=lambda r: share[r.name] / seconds[r.name])
        out.append({"rule": best.name, "seconds": seconds[best.name], "rejects": share[best.name]})
        groups = [(h, k) for h, k in groups if best.name not in h]
        left.remove(best)
    return out


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, given: tuple[str, ...] = ()) -> DataFrame:
    """docs with `rejected_by` (the first rule in the order that rejects, else null) and `kept`, which replace columns of these names.

    Each feature stands in the branch that needs it, so that it is counted only when the branches before have not
    decided. Without `order` the rules are planned on a sample of docs. given: features that docs have as columns.
    """
    by_name = {r.name: r for r in rules}
    names = order or [x["rule"] for x in plan_cascade(docs, rules)]

    def first(cols: dict[str, Column]) -> Column:
        case = F  # F.when begins the CASE, Column.when goes on with it
        for name in names:
            case = case.when(F.coalesce(by_name[name].rejects(cols), F.lit(False)), F.lit(name))
        return case

    def judged(w: Column) -> Column:
        return first(_features(w) | {k: F.col(k) for k in given})

    # the words are bound inside the expression: as a column of their own, a filter on `kept` would be pushed below it and
    # split the text again for every word
    of_words = any(k in OF_WORDS and k not in given for r in rules for k in r.uses)
    case = _let(words(text_of("text")), judged) if of_words else judged(F.array().cast("array<string>"))
    return docs.withColumn("rejected_by", case).withColumn("kept", F.col("rejected_by").isNull())
