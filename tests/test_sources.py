"""Readers and writers on invented files."""

from pyspark.sql import functions as F

from cognate_spark.sources import readers as R
from cognate_spark.sources import writers as X


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_lexicon_xml(spark, tmp_path):
    a = put(tmp_path / "a.xml", '<lexicon dialecte="aa"><entry id="a1"><gl>to run</gl><ngl>run</ngl><hw>pa</hw><hw>second</hw></entry><entry id="a2"><gl>red</gl></entry></lexicon>')
    b = put(tmp_path / "b.xml", '<lexicon dialecte="bb"><entry id="b1"><gl>x (y)</gl><hw>o̥a</hw></entry></lexicon>')
    rows = {tuple(r) for r in R.read_lexicon_xml(spark, [a, b]).collect()}
    assert rows == {("aa", "a1", "pa", "run"), ("aa", "a2", "", "red"), ("bb", "b1", "o̥a", "x (y)")}


TABLE = """<tableOfCorr><parameters><class name="V" value="a, e"/><canon value="(CV)+"/><spec value="w"/></parameters>
<corr num="1"><proto syll="C" contextL="$" contextR="V, x">p</proto><modern dialecte="aa"><seg>p</seg><seg>f</seg></modern><modern dialecte="bb"><seg/></modern></corr>
<corr num="1a"><proto syll="V,C">a</proto><modern dialecte="aa"><seg>a</seg></modern></corr>
<rule num="r1" stage="2"><input contextR="e">t</input><outcome languages="aa,bb">d,th</outcome></rule>
<quirk id="q1"><lg>aa</lg><lx>pa</lx><gl>run</gl><alternative>pe</alternative><note>one</note><note>two</note></quirk></tableOfCorr>"""


def test_table_xml(spark, tmp_path):
    path = put(tmp_path / "t.xml", TABLE)
    one, two = R.read_corrs_xml(spark, path).orderBy("ord").collect()
    assert (one.corr_id, one.ctx_l, one.ctx_r, one.syll, one.proto) == ("1", ["$"], ["V", "x"], ["C"], "p")
    assert one.daughters["aa"] == ["p", "f"] and two.ctx_l is None and two.syll == ["V", "C"]
    rule = R.read_rules_xml(spark, path).first()
    assert (rule.rule_id, rule.stage, rule.input, rule.outcome, rule.languages, rule.ctx_r) == ("r1", 2, "t", ["d", "th"], ["aa", "bb"], ["e"])
    quirk = R.read_quirks_xml(spark, path).first()
    assert (quirk.language, quirk.form, quirk.alternative, quirk.notes, quirk.slot) == ("aa", "pa", "pe", ["one", "two"], "")
    assert R.read_canon_xml(spark, path) == {"classes": {"V": ["a", "e"]}, "canon": "(CV)+", "supra": ["w"], "mode": "constituent"}


def test_mels_and_fuzzy_xml(spark, tmp_path):
    mels = put(tmp_path / "m.xml", '<semantics><mel id="m1"><gl pivot="key">red one</gl><gl>rouge</gl></mel><mel id="m2"></mel></semantics>')
    assert {(r.mel_id, tuple(r.glosses)) for r in R.read_mels_xml(spark, mels).collect()} == {("m1", ("red one", "rouge")), ("m2", ())}
    fuzzy = put(tmp_path / "f.xml", '<fuzzy><item dial="aa" to="e"><from>e:</from><from>je</from></item><item dial="bb" to="x"><from>k</from></item></fuzzy>')
    assert [tuple(r)[1:] for r in R.read_fuzzy_xml(spark, fuzzy).orderBy("ord").collect()] == [("aa", "e:", "e"), ("aa", "je", "e"), ("bb", "k", "x")]


def test_tsv_with_comments_and_back(spark, tmp_path):
    path = put(tmp_path / "t.tsv", "# note\tx\nID\tContext\tSlot\t*\taa\tbb\n1\t$_V,x\tC\tp\tp, f\t\n#no\t\t\t\t\t\n2\t\tV\ta\ta\te\n")
    rows = R.read_tsv(spark, path).withColumn("ord", F.monotonically_increasing_id().cast("int"))
    corrs = R.read_corrs_tsv(rows, ["aa", "bb"])
    back = X.write_corrs_tsv(corrs, ["aa", "bb"]).collect()
    assert [tuple(r) for r in back] == [("1", "$_V,x", "C", "p", "p, f", ""), ("2", "", "V", "a", "a", "e")]


def test_writers_save_and_read(spark, tmp_path):
    forms = spark.createDataFrame([(1, "Aa", "x", "pa", "run"), (2, "Aa", "y", "po", "go"), (3, "Bb", "z", "to", "go")], "ord int, language string, form_id string, glyphs string, gloss string")
    made = X.write_lexicon(forms)
    X.save(made, f"{tmp_path}/lex", "json", partition="language")
    assert {(r.language, r.entry_id) for r in spark.read.json(f"{tmp_path}/lex").collect()} == {("Aa", "aa.1"), ("Aa", "aa.2"), ("Bb", "bb.1")}
    X.save(made, f"{tmp_path}/xml", "xml", rowTag="entry", rootTag="lexicon")
    assert spark.read.format("xml").option("rowTag", "entry").load(f"{tmp_path}/xml").count() == 3
