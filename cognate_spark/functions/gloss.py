"""Glosses, headwords and reflexes as column expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading words that a gloss loses, in this order, once each.
LEADING = ("a kind of", "a", "to", "be", "become", "go", "être")
#: Particles that a phrase loses before further words, in this order.
PARTICLES = ("to", "be")
#: Bands that may hold the headword, in order of choice, for the two kinds of files.
HEADWORD_BANDS = ("hw", "var", "mar", "tag", "sya")
ENTRY_HEADWORD_BANDS = ("hw", "mar", "tag", "sya")
GLOSS_BANDS = ("dfe", "dff", "gl", "mode_dfe", "mode_dff")
PLACEHOLDER = "placeholder"


def _chain(col: Column, *steps: tuple[str, str]) -> Column:
    """Regular replacements one after the other."""
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, col)


def _without_leading(col: Column) -> Column:
    return _chain(col, *((f"^{x} ", "") for x in LEADING))


def compute_gloss(gloss: Column) -> Column:
    """A gloss for matching: no asides, marks or leading particles, blanks single, lower case; the gloss itself if that
    leaves nothing; empty for null."""
    cut = F.regexp_replace(F.regexp_replace(F.substring_index(gloss, " (", 1), r"\*", ""), r"\? ", "")
    bare = _chain(cut, (r"\(.*?\) +", ""), (r"\(.*?\)", ""), (r"[()]", ""))
    small = F.lower(F.trim(F.translate(_chain(_without_leading(bare), (" +", " ")), "_", " ")))
    return F.when(gloss.isNull() | (gloss == ""), F.lit("")).when(small == "", gloss).otherwise(small)


def _words(col: Column) -> Column:
    return F.filter(F.split(F.trim(col), r"\s+"), lambda x: x != "")


def _without_particles(phrase: Column) -> Column:
    def one(p: Column, particle: str) -> Column:
        w = _words(p)
        return F.when((F.size(w) > 1) & (F.get(w, F.lit(0)) == particle), F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), " ")).otherwise(p)

    return F.trim(reduce(one, PARTICLES, phrase))


def normalize_gloss(gloss: Column) -> Column:
    """Candidate meanings of a gloss: its phrases (split at / , ; :) and then their single words, each once."""
    bare = F.regexp_replace(F.regexp_replace(gloss, r"\([^)]*\)|\[[^\]]*\]", ""), r"\*", "")
    variants = F.when(F.contains(bare, F.lit("|")), F.array(F.regexp_replace(bare, r"\|", ""), F.substring_index(bare, "|", 1))).otherwise(F.array(bare))
    parts = F.flatten(F.transform(variants, lambda v: F.split(v, "[/,;:]")))
    phrases = F.array_distinct(F.filter(F.transform(parts, lambda p: _without_particles(F.trim(p))), lambda p: p != ""))
    return F.when(gloss.isNotNull(), F.array_distinct(F.concat(phrases, F.flatten(F.transform(phrases, _words)))))


def normalize_gloss_lexical(gloss: Column) -> Column:
    """Lemma look-up forms: split at / and then at comma and blank, blanks to underscores, with and without hyphens."""
    parts = F.transform(F.flatten(F.transform(F.split(F.trim(gloss), "/"), lambda x: F.split(x, ", "))), lambda x: F.trim(x))

    def lemma(g: Column) -> Column:
        cut = F.regexp_replace(F.regexp_replace(F.substring_index(g, " (", 1), r"\*", ""), r"\? ", "")
        return F.translate(F.trim(_chain(_without_leading(F.regexp_replace(cut, r"[()]", "")), (" +", " "))), " ", "_")

    made = F.transform(parts, lemma)
    return F.array_distinct(F.concat(made, F.transform(made, lambda g: F.replace(g, F.lit("-"), F.lit("")))))


def normalize_gloss_concept(gloss: Column) -> Column:
    """Concept names: the starred word alone if there is one, else the parts at / , ; in upper case, with and without hyphens."""
    starred = F.regexp_extract(gloss, r"\*(\w+)", 1)

    def concept(g: Column) -> Column:
        return F.upper(reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), ("be ", "go ", "être "), F.substring_index(g, " (", 1)))

    split = F.split(F.trim(gloss), "[/,;]")
    parts = F.when(F.size(split) > 1, F.transform(split, lambda x: F.trim(F.trim(x), F.lit("*")))).otherwise(split)
    made = F.transform(parts, concept)
    all_ = F.array_distinct(F.concat(made, F.transform(made, lambda g: F.replace(g, F.lit("-"), F.lit("")))))
    return F.when(starred != "", F.array(F.upper(starred))).otherwise(all_)


def clean_reflex(value: Column) -> Column:
    """A field-note reflex made ready for parsing; null where nothing usable is left or it holds braces."""
    inner = F.when(F.contains(value, F.lit("(")), F.trim(F.regexp_replace(value, r" *\((.*?)\) *", ""))).otherwise(value)
    bare = F.trim(F.replace(inner, F.lit("??"), F.lit("")))
    cut = _chain(bare, (r"^n-", ""), (r"^n.-", ""), ("-k", ""), ("-n", ""), (r"^.*?\\", ""), ("/.*?$", ""), ("-.*$", ""), (r"\?", ""))
    clean = F.trim(cut)
    return F.when(~F.contains(value, F.lit("{")) & (inner != "") & (clean != ""), clean)


def unwrap_reflex(value: Column) -> Column:
    """A simpler clean-up: enclosing parentheses go, the first of alternatives stays."""
    return F.trim(F.split(F.regexp_replace(value, r"^\((.*)\)$", "$1"), ", ").getItem(0))


def transliterate(col: Column, source: str, target: str, pairs: tuple[tuple[str, str], ...] = ()) -> Column:
    """Characters one by one, then strings in the order given."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, F.translate(col, source, target))


def choose_headword(bands: tuple[str, ...] = HEADWORD_BANDS) -> Column:
    return F.coalesce(*[F.col(b) for b in bands], F.lit(PLACEHOLDER))


def choose_gloss(fallback: Column, bands: tuple[str, ...] = GLOSS_BANDS) -> Column:
    """The first gloss band present, else a text that names the entry's place."""
    return F.coalesce(*[F.col(b) for b in bands], F.concat(F.lit("no gloss "), fallback.cast("string")))


def split_headword(hw: Column) -> Column:
    """struct(headword, suffixes): cut at - and =; a placeholder stays whole."""
    parts = F.filter(F.split(hw, "[-=]"), lambda x: x != "")
    whole = (hw == PLACEHOLDER) | ~hw.rlike("[-=]") | (F.size(parts) == 0)
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x: F.concat(F.lit("-"), x))
    return F.struct(F.when(whole, hw).otherwise(F.get(parts, F.lit(0))).alias("headword"), F.when(whole, F.array().cast("array<string>")).otherwise(rest).alias("suffixes"))


def add_normalized_gloss(ngl: Column, band: Column, gl: Column) -> tuple[Column, Column]:
    """(ngl, gl): an ngl stays; else it is computed from the band, or gl, or is the placeholder. gl falls back on the band."""
    return F.coalesce(ngl, F.when(F.coalesce(band, gl).isNotNull(), compute_gloss(F.coalesce(band, gl))), F.lit(PLACEHOLDER)), F.coalesce(gl, band)


def natural_key(col: Column) -> Column:
    """Sort key under which digits count as numbers, of any length, and case does not count: c2 before c102. A number is written
    with its number of digits in front."""
    parts = F.regexp_extract_all(F.lower(col), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(F.ltrim(p, F.lit("0"))).cast("string"), 10, "0"), F.ltrim(p, F.lit("0")))).otherwise(p)), "")


def parse_context(col: Column) -> Column:
    """struct(l, r) of `a,b_c`; a null side is free. `/` does not count; a text without `_` is an error."""
    side = lambda i: F.when(F.get(F.split(F.replace(col, F.lit("/"), F.lit("")), "_"), F.lit(i)) != "", F.transform(F.split(F.get(F.split(F.replace(col, F.lit("/"), F.lit("")), "_"), F.lit(i)), ","), lambda x: F.trim(x)))
    both = F.struct(side(0).alias("l"), side(1).alias("r"))
    free = F.struct(F.lit(None).cast("array<string>").alias("l"), F.lit(None).cast("array<string>").alias("r"))
    return F.when(F.coalesce(col, F.lit("")) == "", free).when(~F.contains(col, F.lit("_")), F.raise_error(F.concat(F.lit("context without _: "), col)).cast("struct<l:array<string>,r:array<string>>")).otherwise(both)


def format_context(l: Column, r: Column) -> Column:  # noqa: E741
    side = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return F.when(l.isNull() & r.isNull(), F.lit("")).otherwise(F.concat(side(l), F.lit("_"), side(r)))
