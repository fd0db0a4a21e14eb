"""Parsing, undoing rules, sets and trees against a plain parser, on invented and random tables."""

import itertools
import random
import re

import pytest

from cognate_spark.operators import lexicon as L
from cognate_spark.operators import parse as P
from cognate_spark.operators import sets as Z
from cognate_spark.operators.canon import compile_canon
from cognate_spark.operators.induce import merge_correspondences
from cognate_spark.operators.table import SoundTable, block_less_specific
from cognate_spark.schemas import CORRS, FORMS, RULES


def test_canon():
    for canon in ("(C*V+)+C*", "(I*V)+", "C?V|VC", "[CG]V*", "C(?=CC|V$)V"):
        c = compile_canon(canon)
        plain = re.compile(re.sub(r"\(\?[=!][^)]*\)", "", canon))
        for n in range(5):
            for s in map("".join, itertools.product("CVIG", repeat=n)):
                q = c.after(c.start, s)
                assert (q is not None and q in c.accepting) == bool(plain.fullmatch(s)), (canon, s)
    with pytest.raises(ValueError):
        compile_canon("(CV")


class Plain:
    """A depth-first parser over the whole table, written from the description of the semantics."""

    def __init__(self, rows, classes, canon, supra, mode, zeros):
        cut = lambda ctx: None if ctx is None else {y for x in ctx for y in classes.get(x, [x])}
        self.rows = {r[0]: dict(id=r[1], L=cut(r[2]), R=cut(r[3]), syll=r[4], proto=r[5], d=r[6]) for r in rows}
        self.rows[0] = dict(id="", L=None, R=None, syll=[], proto="$", d={})
        self.canon, self.supra, self.mode, self.zeros = re.compile(canon), supra, mode, zeros
        real = [k for k in self.rows if k]
        self.next = {a: {b for b in real if self.left(b, a) and self.right(b, a)} for a in self.rows}
        self.cond = {}
        full = {a: set(v) for a, v in self.next.items()}
        less = lambda x, y: x is not None and (y is None or x < y)
        r = self.rows
        for a in real:
            for b in full[a]:
                if any(c != b and r[c]["proto"] == r[b]["proto"] and less(r[c]["L"], r[b]["L"]) and r[c]["R"] == r[b]["R"] for c in full[a]):
                    self.next[a].discard(b)
            for c in sorted(real):
                if c != a and r[c]["proto"] == r[a]["proto"] and less(r[c]["R"], r[a]["R"]):
                    for b in list(self.next[a]):
                        if self.left(b, c) and self.right(b, c, False):
                            if r[c]["L"] == r[a]["L"]:
                                self.next[a].discard(b)
                            elif less(r[c]["L"], r[a]["L"]):
                                self.cond[a, b] = c

    def left(self, c, last):
        ctx, proto = self.rows[c]["L"], self.rows[last]["proto"]
        return ctx is None or (any(proto.endswith(x) for x in ctx) if self.mode == "glyphs" else proto in ctx)

    def right(self, c, last, bypass=True):
        ctx, proto = self.rows[last]["R"], self.rows[c]["proto"]
        return bypass and proto in self.supra or ctx is None or (any(proto.startswith(x) for x in ctx) if self.mode == "glyphs" else proto in ctx)

    def parses(self, language, word):
        out = set()

        def go(at, parse, last, lastlast, syll, zeros):
            r = self.rows[last]
            if at == len(word) and (r["R"] is None or "#" in r["R"]) and self.canon.fullmatch(syll):
                out.add(tuple(parse))
            if r["R"] == {"#"}:
                return
            for b in self.next[last]:
                if (last, b) in self.cond and self.left(self.cond[last, b], lastlast):
                    continue
                c = self.rows[b]
                for token in c["d"].get(language, []):
                    if token == "":
                        break
                    zero = token == "∅"
                    if zero and zeros == self.zeros or not zero and not word.startswith(token, at):
                        continue
                    for s in c["syll"]:
                        keep = c["proto"] in self.supra
                        go(at + (0 if zero else len(token)), [*parse, c["id"]], last if keep else b, lastlast if keep else last, syll + s, zeros + zero)

        go(0, [], 0, None, "", 0)
        return out


def random_table(r):
    rows, letters = [], "abpt"
    for k in range(1, 12):
        proto = r.choice(letters + "w")
        side = lambda: None if r.random() < 0.55 else r.sample(["V", "a", "b", "p", "t", "$", "#"], r.randint(1, 2))
        seg = lambda: [r.choice([*letters, "ab", "pt", "∅"]) for _ in range(r.randint(1, 2))]
        left, right = side(), side()
        rows.append((k, f"c{k}", left and [x for x in left if x != "#"] or None, right and [x for x in right if x != "$"] or None, r.sample(["C", "V"], r.randint(1, 2)), proto, {"aa": seg(), "bb": seg()}))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_parses_equal_a_plain_parser(spark, seed):
    r = random.Random(seed)
    rows, classes, mode = random_table(r), {"V": ["a", "b"]}, r.choice(["constituent", "glyphs"])
    table = SoundTable(spark.createDataFrame(rows, CORRS), classes, "(C*V+)+C*", ("w",), mode)
    words = sorted({(g, "".join(r.choice("abpt") for _ in range(r.randint(1, 4)))) for g in ("aa", "bb") for _ in range(12)})
    forms = spark.createDataFrame(words, "language string, glyphs string")
    found = {}
    for x in P.parse_forms(forms.repartition(3), table, max_zero=1).collect():
        found.setdefault((x.language, x.glyphs), set()).add(tuple(x.rcn))
    plain = Plain(rows, classes, "(C*V+)+C*", ("w",), mode, 1)
    assert {w: plain.parses(*w) for w in words if plain.parses(*w)} == found
    kept, cond = block_less_specific(table)
    assert {(x.last_ord, x.next_ord) for x in kept.collect()} == {(a, b) for a, v in plain.next.items() for b in v}
    assert {(x.last_ord, x.next_ord): x.by_ord for x in cond.collect()} == {k: v for k, v in plain.cond.items() if k[1] in plain.next[k[0]]}


@pytest.fixture(scope="module")
def simple(spark):
    rows = [(i + 1, x, None, None, ["V" if x in "aeo" else "C"], x, {"aa": [x], "bb": ["f" if x == "p" else x], "cc": [x]}) for i, x in enumerate("aeoptkf")]
    return SoundTable(spark.createDataFrame(rows, CORRS), {}, "(CV)+")


def test_zero_circle_is_an_error(spark):
    rows = [(1, "1", None, None, ["C"], "h", {"aa": ["∅"]}), (2, "2", None, None, ["V"], "a", {"aa": ["a"]})]
    table = SoundTable(spark.createDataFrame(rows, CORRS), {}, "C*V")
    forms = spark.createDataFrame([("aa", "a")], "language string, glyphs string")
    with pytest.raises(ValueError, match="max_zero"):
        P.parse_forms(forms, table)
    assert {tuple(x.rcn) for x in P.parse_forms(forms, table, max_zero=2).collect()} == {("2",), ("1", "2"), ("1", "1", "2")}


FORMS_ROWS = [("aa", "1", "pate", "red"), ("bb", "2", "fate", "to be red"), ("cc", "3", "pate", "blue"), ("aa", "4", "toka", "blue"), ("bb", "5", "toka", "blue"), ("aa", "6", "?", "x"), ("aa", "7", "xxx", "x"), ("cc", "8", "toka", "blue"), ("aa", "9", "pate", "red")]


def test_upstream_and_postdict(spark, simple):
    forms = spark.createDataFrame(FORMS_ROWS, FORMS)
    mels = spark.createDataFrame([("m1", ["red"]), ("m2", ["blue"])], "mel_id string, glosses array<string>")
    made = {(r.proto, r.mel_id): [k.split("\x1f")[:2] for k in r.support] for r in Z.upstream(forms, simple, mels).collect()}
    assert made == {("pate", "m1"): [["aa", "pate"], ["bb", "fate"]], ("toka", "m2"): [["aa", "toka"], ["bb", "toka"], ["cc", "toka"]]}
    strict = Z.upstream(forms.where("gloss = 'blue'"), simple, mels.where("mel_id = 'm1'"), only_with_mel=True)
    assert strict.count() == 0
    back = {(r.language, r.reflex) for r in P.postdict(spark.createDataFrame([("pate",)], "proto string"), simple).collect()}
    assert back == {("aa", "pate"), ("bb", "fate"), ("cc", "pate")}


def test_tree(spark, simple, tmp_path):
    forms = spark.createDataFrame(FORMS_ROWS, FORMS)
    from pyspark.sql import functions as F

    above = SoundTable(simple.corrs.withColumn("daughters", F.map_concat("daughters", F.create_map(F.lit("W"), F.array("proto")))), {}, simple.canon)
    made = Z.upstream_tree("P: W, cc; W: aa, bb;", forms, {"P": above, "W": simple}, str(tmp_path)).collect()
    assert {r.proto: r.languages for r in made} == {"pate": 2, "toka": 2}
    assert {len(r.attested) for r in made} == {3}


def test_filter_subsets_is_an_antichain(spark):
    r = random.Random(4)
    rows = [([f"c{i}"], f"p{i}", "", sorted(r.sample("abcdefg", r.randint(1, 5)))) for i in range(60)]
    sets = spark.createDataFrame(rows, "rcn array<string>, proto string, mel_id string, support array<string>")
    kept = sorted(x.proto for x in Z.filter_subsets(sets.repartition(7), "support").collect())
    assert kept == sorted(p for _, p, _, s in rows if not any(set(s) < set(t) for _, _, _, t in rows))


def test_undo_rules(spark):
    rules = [(1, "r1", None, ["#"], "t", ["d"], ["aa"], 2), (2, "r2", ["$"], None, "k", ["h"], ["aa"], 1), (3, "r3", ["V"], None, "pp", ["b"], ["aa"], 1)]
    forms = spark.createDataFrame([("aa", "had"), ("aa", "abd"), ("bb", "had")], "language string, glyphs string")
    got = {}
    for x in P.undo_rules(forms, spark.createDataFrame(rules, RULES), {"V": ["a"]}).collect():
        got.setdefault((x.language, x.glyphs), set()).add((x.stage0, tuple(i for h in x.history for i in h.rule_ids)))
    assert got["bb", "had"] == {("had", ())}
    # `#` after the last letter stays open to the end, where it is allowed
    assert got["aa", "had"] == {("had", ()), ("kad", ("r2",)), ("hat", ("r1",)), ("kat", ("r2", "r1"))}
    assert ("appt", ("r3", "r1")) in got["aa", "abd"] and ("abd", ()) in got["aa", "abd"]


def test_greedy_merge(spark):
    rows = [(1, "o", "p", "", None), (2, "o", "p", "f", ""), (3, "o", "t", "", "d"), (4, "o", "", "x", ""), (5, "o", "p", "f", "b")]
    df = spark.createDataFrame(rows, "row_id int, slot string, aa string, bb string, cc string")
    out = sorted(tuple(r) for r in merge_correspondences(df.repartition(3), ["aa", "bb", "cc"]).collect())
    assert out == [("o", 1, "p", "f", "b"), ("o", 2, "t", "x", "d")]


def test_fuzzy_longest_match(spark):
    forms = spark.createDataFrame([("aa", "1", "jeje:k", "g"), ("aa", "2", "xx", "g"), ("bb", "3", "je", "g")], FORMS)
    fuzzy = spark.createDataFrame([(1, "aa", "e:", "E"), (2, "aa", "je", "i"), (3, "aa", "je:", "I"), (4, "aa", "k", "g"), (5, "aa", "k", "c")], "ord int, language string, from_seg string, to_seg string")
    assert [(r.form_id, r.parse_glyphs) for r in L.fuzzy_forms(forms, fuzzy).collect()] == [("1", "iIc")]
    assert [r.targets for r in L.ambiguous_fuzzy(fuzzy).collect()] == [["c", "g"]]


def test_merge_correspondences_registered_over_all_slots(spark, monkeypatch):
    import random

    from cognate_spark.plans import queries_induce

    r, slots = random.Random(4), ["onset", "vowel", "coda", "rest"]
    rows = [(k, s, *(r.choice(["", "", None, "a", "b", "c"]) for _ in range(4))) for k in range(60) for s in slots]
    df = spark.createDataFrame(rows, "row_id long, slot string, en string, fr string, de string, es string")
    monkeypatch.setattr(queries_induce, "_rows", lambda *_: df)
    want = []
    for slot in slots:
        groups = []
        for row in ([x or "" for x in row[2:]] for row in rows if row[1] == slot):
            g = next((g for g in groups if all(a == b or not a or not b for a, b in zip(g, row, strict=True))), None)
            if g is None:
                groups.append(row)
            else:
                g[:] = [a or b for a, b in zip(g, row, strict=True)]
        want += [(slot, i + 1, *g) for i, g in enumerate(groups)]
    assert sorted(map(tuple, queries_induce.merge_correspondences(spark, "").collect())) == sorted(want)
