"""Canonical schemas as DDL, and the identity of forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMS = "language string, form_id string, glyphs string, gloss string"
CORRS = "ord int, corr_id string, ctx_l array<string>, ctx_r array<string>, syll array<string>, proto string, daughters map<string,array<string>>"
RULES = "ord int, rule_id string, ctx_l array<string>, ctx_r array<string>, input string, outcome array<string>, languages array<string>, stage int"
QUIRKS = "ord int, quirk_id string, source_id string, language string, form string, gloss string, alternative string, slot string, value string, notes array<string>"
MELS = "mel_id string, glosses array<string>"
FUZZY = "ord int, language string, from_seg string, to_seg string"
BANDS = "file string, line_no bigint, entry_no bigint, sub_no bigint, mode_level int, band string, content string"

SEP = "\x1f"


def form_key(language: str = "language", glyphs: str = "glyphs", gloss: str = "gloss") -> Column:
    """Identity of an attested form: its id is not part of it, so homographs of one meaning are one form."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat_ws(SEP, empty(language), empty(glyphs), empty(gloss))


def set_key(members: Column) -> Column:
    """One string for a set of keys."""
    return F.array_join(F.array_sort(members), "\x1e")


def set_digest(members: Column) -> Column:
    """32 bytes that stand for a set of keys, however large it is."""
    return F.unhex(F.sha2(set_key(members), 256))
