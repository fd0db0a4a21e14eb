"""Scans in splits, segmented files, crowded sets, frontiers and restarts, on small inputs that force the ways for large ones."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cognate_spark.functions.gloss import natural_key
from cognate_spark.operators import induce, lexicon, parse, sets
from cognate_spark.operators.table import SoundTable
from cognate_spark.sources import readers as R
from cognate_spark.sources import writers as X
from cognate_spark.sources import xml_scan


@pytest.fixture
def many_ranges(spark):
    """As on a cluster: ranges are not put together again."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_large_lexicon_is_read_by_many_tasks(spark, tmp_path):
    entries = [f'<entry id="e{i}"><gl>to run {i}</gl><hw>w{i}é</hw></entry>\n' for i in range(20_000)]
    entries[7] = '<entry id="e7" note="a > b"/>\n'
    entries[9] = '<!-- <entry id="no"/> -->' + entries[9]
    entries[11] = '<entry id="e11"><hw>broken</gl></entry>\n'
    (tmp_path / "big.xml").write_text('<?xml version="1.0"?>\n<lexicon dialecte="a&amp;b">' + "".join(entries) + "</lexicon>", encoding="utf-8")
    (tmp_path / "small.xml").write_text('<lexicon dialecte="bb"><entry id="x"><hw>pa</hw></entry></lexicon>', encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        rows = xml_scan.elements(spark, str(tmp_path), "entry")
        assert rows.rdd.getNumPartitions() > 8
        forms = {r.form_id: r for r in R.read_lexicon_xml(spark, str(tmp_path)).collect()}
        assert len(forms) == 20_000 and forms["x"].language == "bb" and forms["e19999"].glyphs == "w19999é" and forms["e19999"].language == "a&b"
        assert (forms["e7"].glyphs, forms["e7"].gloss) == ("", None) and "e11" not in forms and "no" not in forms
        (bad,) = xml_scan.rejected(rows, R.ENTRY).collect()
        assert "broken" in bad.element
        ids = [r.i for r in xml_scan.parsed(xml_scan.in_order(rows), "_id string").orderBy("ord").select(F.col("e._id").alias("i")).collect()]
        assert ids == [f"e{i}" for i in range(20_000) if i != 11] + ["x"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bad_numbers_are_set_apart(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<t><rule num="r1" stage="one"><input>a</input></rule><rule num="r2" stage="2"><input contextL="x">b</input><outcome languages="aa">c</outcome></rule></t>', encoding="utf-8")
    (rule,) = R.read_rules_xml(spark, str(tmp_path / "r.xml")).collect()
    assert (rule.ord, rule.rule_id, rule.stage, rule.ctx_l) == (2, "r2", 2, ["x"])
    assert xml_scan.rejected(xml_scan.elements(spark, str(tmp_path / "r.xml"), "rule"), R.RULE).count() == 1
    rows = spark.createDataFrame([(1, "<mel id='m'><gl>a</gl><gl>b</gl></mel>"), (2, "<mel"), (3, None)], "k int, xml string")
    assert [tuple(r) for r in R.mels_from_xml(rows, "xml").collect()] == [("m", ["a", "b"])]
    with pytest.raises(ValueError, match="no parameters"):
        R.read_canon_xml(spark, str(tmp_path / "r.xml"))


def test_publishing_is_whole_or_not_at_all(spark, tmp_path):
    df = spark.range(5)
    X.publish(df, f"{tmp_path}/out", "json")
    with pytest.raises(FileExistsError):
        X.publish(df, f"{tmp_path}/out", "json")
    assert spark.read.json(f"{tmp_path}/out").count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_header_like_lines_are_data(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# c\tx\nA\tB\n1\t2\nA\tB\n", encoding="utf-8")
    assert [tuple(r) for r in R.read_tsv(spark, str(tmp_path / "t.tsv")).collect()] == [("1", "2"), ("A", "B")]


def test_bands_and_sections_over_segments(many_ranges):
    r = random.Random(4)
    lines = [(f, i, r.choice([".hw\ta", "..\tb", "gl\tc", "hdr\tsection " + str(i), "* note", "2dfe\tx", " "])) for f in ("a.txt", "b.txt", "c.txt") for i in range(120 if f == "b.txt" else 7)]
    lines += [("long.txt", 0, "* " + "z" * 1_000_100)]
    df = many_ranges.createDataFrame(lines, "file string, line_no long, value string").repartition(5)
    bands = R.read_lexicon_bands(df)
    got = {(x.file, x.line_no): (x.entry_no, x.sub_no) for x in bands.collect()}
    sections = {(x.file, x.line_no): x.section for x in lexicon.section_of_entry(bands).collect()}
    entry = sub = 0
    section, file = "0", None
    for f, i, v in sorted(lines):
        if f != file:
            file, entry, sub, section = f, 0, 0, "0"
        if not v.strip():
            continue
        entry, sub = (entry + 1, 0) if v.startswith(".hw") else (entry, sub + v.startswith(".."))
        section = v.split("\t")[1] if v.startswith("hdr") else section
        assert got[f, i] == (entry, sub), (f, i, v)
        if v.startswith(".hw"):
            assert sections[f, i] == section
    assert len(bands.where("file = 'long.txt'").first().content) == 1_000_100


def test_numbers_of_any_length_sort_by_value(spark):
    names = ["c2", "c102", "C30", "c" + "9" * 20, "c1" + "0" * 20, "c0003", "b", "c3x2", "c3x10"]
    df = spark.createDataFrame([(x,) for x in names], "n string")
    got = [x.n for x in df.orderBy(natural_key(F.col("n")), "n").collect()]
    assert got == ["b", "c2", "c0003", "c3x2", "c3x10", "C30", "c102", "c" + "9" * 20, "c1" + "0" * 20]


def plain_maximal(supports):
    return {s for s in supports if not any(s < t for t in supports)}


@pytest.mark.parametrize("hot", [3, 1000])
def test_filter_subsets_in_a_crowd(spark, hot):
    r = random.Random(hot)
    made = {frozenset({"a", "b", *r.sample([f"m{i}" for i in range(12)], r.randint(0, 6))}) for _ in range(150)} | {frozenset("a"), frozenset("z"), frozenset({"q", "w"})}
    rows = [([str(i)], "p", "", sorted(s), sorted(s), 2) for i, s in enumerate(sorted(map(sorted, made)))]
    df = spark.createDataFrame(rows, "rcn array<string>, proto string, mel_id string, support array<string>, attested array<string>, languages long")
    kept = {frozenset(x.attested) for x in sets.filter_subsets(df, hot=hot).collect()}
    assert kept == plain_maximal(made)


def test_filter_subsets_does_not_compare_all_pairs(spark):
    """Many sets share their rarest members and differ in others: pairs would be in the hundreds of millions."""
    n = 20_000
    each = spark.range(n).select(F.array(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("rcn"), F.lit("p").alias("proto"), F.lit("").alias("mel_id"), F.lit(2).cast("long").alias("languages"), F.concat(F.array(F.lit("a"), F.lit("b")), F.transform(F.sequence(F.lit(0), (F.col("id") % 3).cast("int")), lambda j: F.concat(F.lit("x"), ((F.col("id") * 7 + j * 13) % 5000).cast("string")))).alias("attested"))
    df = each.withColumn("support", F.col("attested"))
    began = time.time()
    kept = sets.filter_subsets(df).count()
    assert 0 < kept < n and time.time() - began < 120


def test_postdict_tells_outcomes_apart_at_every_position(spark):
    letters = "abcdefghijklmnopqrst"
    rows = [(i + 1, str(i + 1), None, None, ["V"], x, {"aa": ["u", "u", "∅"] if i % 2 else ["u"], "bb": [x]}) for i, x in enumerate(letters)]
    corrs = spark.createDataFrame(rows, "ord int, corr_id string, ctx_l array<string>, ctx_r array<string>, syll array<string>, proto string, daughters map<string,array<string>>")
    protos = spark.createDataFrame([(letters,), ("ab",)], "proto string")
    found = parse.postdict(protos, SoundTable(corrs, canon="V+")).collect()  # ten positions of two different outcomes, but few different strings
    assert {x.reflex for x in found if x.proto == letters and x.language == "aa"} == {"u" * n for n in range(10, 21)}
    assert sorted((x.language, x.reflex) for x in found if x.proto == "ab") == [("aa", "u"), ("aa", "uu"), ("bb", "ab")]


def test_a_tree_is_not_built_twice(spark, tmp_path):
    rows = [(1, "1", None, None, ["C"], "p", {"aa": ["p"], "bb": ["b"], "cc": ["f"], "Low": ["p"]}), (2, "2", None, None, ["V"], "a", {"aa": ["a"], "bb": ["a", "o"], "cc": ["a"], "Low": ["a"]})]
    corrs = spark.createDataFrame(rows, "ord int, corr_id string, ctx_l array<string>, ctx_r array<string>, syll array<string>, proto string, daughters map<string,array<string>>")
    table = SoundTable(corrs, canon="(CV)+")
    forms = spark.createDataFrame([("aa", "1", "papa", "x"), ("bb", "2", "bobo", "x"), ("cc", "3", "fafa", "x"), ("cc", "4", "fa", "y")], "language string, form_id string, glyphs string, gloss string")
    files = lambda: sorted(p.name for p in tmp_path.rglob("*"))
    build = lambda f, t=table: sorted(map(tuple, sets.upstream_tree("Top: Low, cc; Low: aa, bb", f, {"Top": t, "Low": t}, str(tmp_path)).select("proto", "ids", "languages").collect()))
    one = build(forms)
    before = files()
    assert one == [("papa", "   1    2    1    2", 2)] and len(list(tmp_path.iterdir())) == 2
    assert build(forms.repartition(3)) == one and files() == before  # the same rows: nothing is written
    build(forms.where("form_id != '4'"))
    assert len(list(tmp_path.iterdir())) == 3  # the node above alone has other forms
    build(forms, SoundTable(corrs, canon="(CV)*"))
    assert len(list(tmp_path.iterdir())) == 5


def test_greedy_merge_in_stretches(spark, monkeypatch):
    """Joins decide most rows of a slot, few meet in one task, and groups are those of a plain merge, in a crowd of gaps too."""
    r, langs, rows, want, ones = random.Random(4), ["en", "fr", "de", "es"], [], [], []
    for slot, gap, values, n in (("many gaps", 0.6, 4, 300), ("few gaps", 0.03, 6, 900), (None, 0.3, 20, 200), ("one", 1, 1, 3)):
        ends, groups = [n, n * 2 // 3, n, n // 3], []
        for i in range(n):
            row = ["" if i >= end or r.random() < gap else f"v{min(r.randrange(values), r.randrange(values))}" for end in ends]
            rows.append((i, slot, *(x or r.choice(["", None]) for x in row)))
            g = next((g for g in groups if all(a == b or not a or not b for a, b in zip(g, row, strict=True))), None)
            if g is None:
                groups.append(row)
            else:
                g[:] = [a or b for a, b in zip(g, row, strict=True)]
        want += [(slot or "", i + 1, *g) for i, g in enumerate(groups)]
    one_by_one = induce._one_by_one
    monkeypatch.setattr(induce, "_one_by_one", lambda turns, *a: ones.append(turns.where("_alive is not null and _slot = 'sfew gaps'").count()) or one_by_one(turns, *a))
    monkeypatch.setattr(induce, "FIRST_STRETCH", 60)
    df = spark.createDataFrame(rows, "row_id long, slot string, en string, fr string, de string, es string").repartition(5)
    got = sorted((x.slot or "", *tuple(x)[1:]) for x in induce.merge_correspondences(df, langs).collect())
    assert got == sorted(want)
    assert len(ones) > 3 and sum(ones) < 0.8 * df.where("slot = 'few gaps'").select(*langs).distinct().count()
