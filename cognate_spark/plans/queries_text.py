"""Queries of sources, sinks, glosses and lexicons over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gloss as G
from ..operators import lexicon as L
from ..shared import numbered, shared_dir
from ..sources import readers as R
from ..sources import writers as X
from . import testbed as B
from .registry import query

#: A gloss with asides, alternatives and particles from a part, so that every rule has work to do.
_MADE = "CASE p_partkey % 6 WHEN 0 THEN 'to ' || p_name WHEN 1 THEN p_name || ' (' || lower(p_type) || ')' WHEN 2 THEN '*a kind of ' || p_name || '/' || lower(p_brand) WHEN 3 THEN 'be ' || p_name || ', ' || lower(p_type) || '; x-y' WHEN 4 THEN p_name || '|' || lower(p_type) ELSE '? to be ' || p_name || ' [old]' END"


def _glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "part").select("p_partkey", F.expr(_MADE).alias("gloss"))


_COMPUTE = "regexp_replace(regexp_replace(regexp_replace(replace(replace(string_split({0}, ' (')[1], '*', ''), '? ', ''), '\\(.*?\\) +', '', 'g'), '\\(.*?\\)', '', 'g'), '[()]', '', 'g')"
_LEAD = "regexp_replace(" * 7 + "{0}" + "".join(f", '^{x} ', '')" for x in G.LEADING)


def _computed(x: str) -> str:
    body = f"lower(trim(replace(regexp_replace({_LEAD.format(_COMPUTE.format(x))}, ' +', ' ', 'g'), '_', ' ')))"
    return f"CASE WHEN coalesce({x}, '') = '' THEN '' WHEN {body} = '' THEN {x} ELSE {body} END"


_G = f"WITH g AS (SELECT p_partkey, {_MADE} AS gloss FROM part) "


@query(_G + f"SELECT p_partkey, {_computed('gloss')} AS computed FROM g")
def compute_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _glosses(spark, sf_dir).select("p_partkey", G.compute_gloss(F.col("gloss")).alias("computed"))


@query(_G + f"SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'own' ELSE {_computed('gloss')} END AS ngl, gloss AS gl FROM g")
def add_normalized_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    ngl = F.when(F.col("p_partkey") % 4 == 0, F.lit("own"))
    new, gl = G.add_normalized_gloss(ngl, F.col("gloss"), F.lit(None).cast("string"))
    return _glosses(spark, sf_dir).select("p_partkey", new.alias("ngl"), gl.alias("gl"))


def _stripped(x: str, particle: str) -> str:
    w = f"list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda y: y <> '')"
    return f"CASE WHEN len({w}) > 1 AND ({w})[1] = '{particle}' THEN array_to_string(({w})[2:], ' ') ELSE {x} END"


@query(_G + """, b AS (SELECT p_partkey, replace(regexp_replace(gloss, '\\([^)]*\\)|\\[[^\\]]*\\]', '', 'g'), '*', '') AS b FROM g),
v AS (SELECT p_partkey, unnest(CASE WHEN contains(b, '|') THEN [replace(b, '|', ''), string_split(b, '|')[1]] ELSE [b] END) AS v, unnest(CASE WHEN contains(b, '|') THEN [1, 2] ELSE [1] END) AS i FROM b),
s AS (SELECT p_partkey, i, unnest(regexp_split_to_array(v, '[/,;:]')) AS x, generate_subscripts(regexp_split_to_array(v, '[/,;:]'), 1) AS j FROM v),
t AS (SELECT p_partkey, i, j, trim(x) AS x FROM s),
u AS (SELECT p_partkey, i, j, """ + _stripped("x", "to") + """ AS x FROM t),
ph AS (SELECT p_partkey, i, j, """ + _stripped("x", "be") + """ AS x FROM u),
ph2 AS (SELECT p_partkey, i, j, x FROM ph WHERE x <> ''),
al AS (SELECT p_partkey, x, (0, i, j, 0) AS o FROM ph2 UNION ALL SELECT p_partkey, unnest(regexp_split_to_array(x, '\\s+')), (1, i, j, generate_subscripts(regexp_split_to_array(x, '\\s+'), 1)) FROM ph2),
d AS (SELECT p_partkey, x, min(o) AS o FROM al GROUP BY ALL)
SELECT p_partkey, string_agg(x, '|' ORDER BY o) AS candidates FROM d GROUP BY p_partkey""")
def normalize_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _glosses(spark, sf_dir).select("p_partkey", F.array_join(G.normalize_gloss(F.col("gloss")), "|").alias("candidates"))


LEXICAL = "replace(trim(regexp_replace(" + _LEAD.format("regexp_replace(replace(replace(string_split(x, ' (')[1], '*', ''), '? ', ''), '[()]', '', 'g')") + ", ' +', ' ', 'g')), ' ', '_')"


@query(_G + """, s AS (SELECT p_partkey, unnest(string_split(trim(gloss), '/')) AS y FROM g), t AS (SELECT p_partkey, unnest(string_split(y, ', ')) AS x0 FROM s), u AS (SELECT p_partkey, trim(x0) AS x FROM t),
l AS (SELECT p_partkey, """ + LEXICAL + """ AS l FROM u), a AS (SELECT p_partkey, l FROM l UNION SELECT p_partkey, replace(l, '-', '') FROM l)
SELECT p_partkey, string_agg(l, '|' ORDER BY l) AS lemmas FROM a GROUP BY p_partkey""")
def normalize_gloss_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _glosses(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(G.normalize_gloss_lexical(F.col("gloss"))), "|").alias("lemmas"))


@query(_G + """, s AS (SELECT p_partkey, regexp_extract(gloss, '\\*(\\w+)', 1) AS star, regexp_split_to_array(trim(gloss), '[/,;]') AS p FROM g),
t AS (SELECT p_partkey, star, unnest(CASE WHEN star <> '' THEN [star] WHEN len(p) > 1 THEN list_transform(p, lambda x: trim(trim(x), '*')) ELSE p END) AS x FROM s),
u AS (SELECT p_partkey, upper(CASE WHEN star <> '' THEN x ELSE replace(replace(replace(string_split(x, ' (')[1], 'be ', ''), 'go ', ''), 'être ', '') END) AS c, star FROM t),
a AS (SELECT p_partkey, c FROM u UNION SELECT p_partkey, replace(c, '-', '') FROM u WHERE star = '')
SELECT p_partkey, string_agg(c, '|' ORDER BY c) AS concepts FROM a GROUP BY p_partkey""")
def normalize_gloss_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _glosses(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(G.normalize_gloss_concept(F.col("gloss"))), "|").alias("concepts"))


_NOTE = "CASE p_partkey % 8 WHEN 0 THEN p_name || '-k' WHEN 1 THEN 'n-' || p_name WHEN 2 THEN p_name || ' (' || p_type || ')' WHEN 3 THEN '{' || p_name WHEN 4 THEN p_brand || '\\' || p_name WHEN 5 THEN p_name || '/' || p_brand WHEN 6 THEN p_name || '??' ELSE '(' || p_name || ')' END"


@query("WITH n AS (SELECT p_partkey, " + _NOTE + """ AS v FROM part), a AS (SELECT *, CASE WHEN contains(v, '(') THEN trim(regexp_replace(v, ' *\\((.*?)\\) *', '', 'g')) ELSE v END AS i FROM n),
b AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(trim(replace(i, '??', '')), '^n-', ''), '^n.-', ''), '-k', ''), '-n', ''), '^.*?\\\\', ''), '/.*?$', ''), '-.*$', ''), '\\?', '', 'g')) AS c FROM a)
SELECT p_partkey, c AS reflex FROM b WHERE NOT contains(v, '{') AND i <> '' AND c <> ''""")
def clean_reflex(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = B.read(spark, sf_dir, "part").select("p_partkey", F.expr(_NOTE.replace("\\", "\\\\")).alias("v"))
    return note.select("p_partkey", G.clean_reflex(F.col("v")).alias("reflex")).where("reflex is not null")


@query("WITH " + B.FORMS + " SELECT language, form_id, replace(replace(translate(glyphs, 'aeiou', '12345'), 'th', 'T'), 'ch', 'C') AS written FROM forms")
def transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.forms(spark, sf_dir).select("language", "form_id", G.transliterate(F.col("glyphs"), "aeiou", "12345", (("th", "T"), ("ch", "C"))).alias("written"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, CASE WHEN o_custkey % 3 = 0 THEN 'mar' END, CASE WHEN o_custkey % 5 = 0 THEN 'sya' END, 'placeholder') AS headword FROM orders")
def choose_headword(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.read(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    bands = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("hw"), none.alias("var"), F.when(F.col("o_custkey") % 3 == 0, "mar").alias("mar"), none.alias("tag"), F.when(F.col("o_custkey") % 5 == 0, "sya").alias("sya"))
    return bands.select("o_orderkey", G.choose_headword().alias("headword"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, CASE WHEN o_custkey % 3 = 0 THEN 'gl' END, 'no gloss ' || o_orderkey) AS gloss FROM orders")
def choose_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.read(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    bands = o.select("o_orderkey", none.alias("dfe"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("dff"), F.when(F.col("o_custkey") % 3 == 0, "gl").alias("gl"), none.alias("mode_dfe"), none.alias("mode_dff"))
    return bands.select("o_orderkey", G.choose_gloss(F.col("o_orderkey")).alias("gloss"))


@query("""WITH s AS (SELECT o_orderkey, o_orderpriority || '=' || o_orderstatus AS hw FROM orders), p AS (SELECT *, list_filter(regexp_split_to_array(hw, '[-=]'), lambda x: x <> '') AS p FROM s)
SELECT o_orderkey, p[1] AS headword, array_to_string(list_transform(p[2:], lambda x: '-' || x), '|') AS suffixes FROM p""")
def split_headword(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.read(spark, sf_dir, "orders").select("o_orderkey", G.split_headword(F.concat("o_orderpriority", F.lit("="), "o_orderstatus")).alias("h"))
    return o.select("o_orderkey", "h.headword", F.array_join("h.suffixes", "|").alias("suffixes"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type || ',' || p_brand || '_' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END END AS c FROM part)
SELECT p_partkey, CASE WHEN c = '' THEN -1 ELSE len(string_split(string_split(c, '_')[1], ',')) END AS n_left, CASE WHEN c = '' OR string_split(c, '_')[2] = '' THEN -1 ELSE 1 END AS n_right, c AS formatted FROM p""")
def parse_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type || ',' || p_brand || '_' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END END")
    c = B.read(spark, sf_dir, "part").select("p_partkey", G.parse_context(text).alias("c"))
    n = lambda x: F.coalesce(F.size(F.col(f"c.{x}")), F.lit(-1)).cast("long")
    return c.select("p_partkey", F.when(F.col("c.l").isNull(), -1).otherwise(n("l")).cast("long").alias("n_left"), F.when(F.col("c.r").isNull(), -1).otherwise(n("r")).cast("long").alias("n_right"), G.format_context(F.col("c.l"), F.col("c.r")).alias("formatted"))


# Sources and sinks

_WIDE = "SELECT o_custkey AS id, CASE WHEN o_custkey % 7 = 0 THEN '# ' || o_custkey ELSE 'row' END AS first, min(o_orderpriority) AS gloss, max(CASE WHEN o_orderstatus = 'F' THEN ' ' || o_orderpriority END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS o, max(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS p FROM orders GROUP BY o_custkey"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.read(spark, sf_dir, "orders")
    s = lambda x: F.when(F.col("o_orderstatus") == x, F.col("o_orderpriority"))
    wide = o.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("gloss"), F.max(F.concat(F.lit(" "), s("F"))).alias("f"), F.max(s("O")).alias("o"), F.max(s("P")).alias("p"))
    return wide.select(F.when(F.col("id") % 7 == 0, F.concat(F.lit("# "), F.col("id").cast("string"))).otherwise("row").alias("first"), "id", "gloss", "f", "o", "p")


@query(f"WITH w AS ({_WIDE}) SELECT language, id::VARCHAR AS form_id, trim(cell) AS glyphs, gloss FROM (UNPIVOT (SELECT id, gloss, f, o, p FROM w) ON f, o, p INTO NAME language VALUE cell) WHERE trim(cell) <> ''")
def read_lexicon_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.read_lexicon_wide(_wide(spark, sf_dir), "gloss", "id", ["f", "o", "p"])


@query(f"WITH w AS ({_WIDE}) SELECT id, gloss FROM w WHERE NOT contains(first, '#')")
def drop_comment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.drop_comment_rows(_wide(spark, sf_dir)).select("id", "gloss")


_LINES = """l0 AS (SELECT conv_id::VARCHAR AS file, turn AS line_no, CASE WHEN role = 'system' THEN '* note ' || conv_id WHEN role = 'user' AND turn % 4 = 0 THEN '.hw' || chr(9) || conv_id || '-' || turn WHEN role = 'user' THEN '..' || chr(9) || 'sub' WHEN turn % 3 = 0 THEN '2dfe' || chr(9) || length(text) ELSE 'dff  ' || length(text) END AS v FROM conversations)"""
_BANDS = _LINES + """, l1 AS (SELECT *, CASE WHEN v LIKE '*%' THEN 'comment' WHEN v LIKE '..%' THEN 'sub' WHEN v LIKE '.%' THEN 'head' ELSE 'band' END AS line_kind, regexp_replace(v, '^\\.{1,2}', '') AS body FROM l0),
l2 AS (SELECT *, sum((line_kind = 'head')::INT) OVER (PARTITION BY file ORDER BY line_no) AS entry_no FROM l1),
bands AS (SELECT file, line_no, entry_no::BIGINT AS entry_no, (sum((line_kind = 'sub')::INT) OVER (PARTITION BY file, entry_no ORDER BY line_no))::BIGINT AS sub_no, CASE WHEN regexp_extract(body, '^(\\d+)', 1) <> '' THEN regexp_extract(body, '^(\\d+)', 1)::INT ELSE 0 END AS mode_level,
  CASE WHEN line_kind = 'comment' THEN 'comment' ELSE regexp_extract(body, '^\\d*([A-Za-z]+)', 1) END AS band, CASE WHEN line_kind = 'comment' THEN trim(substr(v, 2)) ELSE trim(regexp_extract(body, '^\\d*[A-Za-z]*[\\t ]+(.*)$', 1)) END AS content, line_kind FROM l2)"""


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.read(spark, sf_dir, "conversations")
    tab = lambda a, b: F.concat(F.lit(a + "\t"), b)
    value = F.when(F.col("role") == "system", F.concat(F.lit("* note "), F.col("conv_id").cast("string"))).when((F.col("role") == "user") & (F.col("turn") % 4 == 0), tab(".hw", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))).when(F.col("role") == "user", tab("..", F.lit("sub"))).when(F.col("turn") % 3 == 0, tab("2dfe", F.length("text").cast("string"))).otherwise(F.concat(F.lit("dff  "), F.length("text").cast("string")))
    return R.read_lexicon_bands(c.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line_no"), value.alias("value")))


@query("WITH " + _BANDS + " SELECT * FROM bands")
def read_lexicon_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands(spark, sf_dir)


@query("WITH " + _BANDS + ", hit AS (SELECT DISTINCT file, entry_no FROM bands WHERE band IN ('dfe', 'dff') AND regexp_matches(content, '[05]$')) SELECT file, line_no, band, content FROM bands WHERE (file, entry_no) IN (SELECT (file, entry_no) FROM hit) AND (band = 'dfe' OR line_kind IN ('head', 'sub'))")
def filter_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.filter_bands(_bands(spark, sf_dir), ["dfe", "dff"], "[05]$", keep=["dfe"]).select("file", "line_no", "band", "content")


@query("WITH " + _BANDS + ", s AS (SELECT file, line_no, content, line_kind, coalesce(last_value(CASE WHEN band = 'dfe' THEN content END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING), '0') AS section FROM bands) SELECT file, line_no, content, section FROM s WHERE line_kind = 'head' AND content <> ''")
def section_of_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _bands(spark, sf_dir).withColumn("band", F.when(F.col("band") == "dfe", "hdr").otherwise(F.col("band")))
    return L.section_of_entry(lines).select("file", "line_no", "content", "section")


@query("WITH " + _BANDS + " SELECT band, count(*) AS lines FROM bands GROUP BY ROLLUP (band)")
def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.reports import band_counts as counted

    return counted(_bands(spark, sf_dir))


@query("WITH " + _BANDS + ", e AS (SELECT file || '.' || entry_no AS id, band, string_agg(content, '|' ORDER BY line_no) AS c FROM bands WHERE entry_no > 0 GROUP BY ALL) SELECT id, string_agg(band || '_ss=' || c, ';' ORDER BY band) AS fields FROM e GROUP BY id")
def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = R.band_entry_ids(_bands(spark, sf_dir).where("entry_no > 0"), F.col("file")).withColumn("language", F.lit("xx"))
    docs = X.search_docs(bands)
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))), ";")
    return docs.select("id", fields.alias("fields"))


@query("SELECT o_orderstatus AS language, last_value(o_orderpriority) OVER w AS glyphs FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) = 1")
def forms_from_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("language"), F.col("o_orderpriority").alias("glyphs"))
    return R.forms_from_pairs(pairs).select("language", "glyphs")


@query("WITH " + B.FORMS + " SELECT language, language || '.' || row_number() OVER (PARTITION BY language ORDER BY form_id::BIGINT, glyphs) AS entry_id, glyphs, gloss FROM forms")
def write_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renumbered lexicons are written as XML, a folder a language, and read back."""
    made = X.write_lexicon(B.forms(spark, sf_dir).withColumn("ord", F.struct(F.col("form_id").cast("long"), "glyphs")))
    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    X.publish_lexicons_xml(made.withColumnRenamed("entry_id", "form_id"), path)
    return R.read_lexicon_xml(spark, f"{path}/*").select("language", F.col("form_id").alias("entry_id"), "glyphs", "gloss")


#: Table cells from parts: two daughter columns, contexts and slots.
_CELLS = "SELECT p_partkey AS ord, p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type || '_' || CASE WHEN p_partkey % 2 = 0 THEN 'x,y' ELSE '' END END AS context, CASE WHEN p_partkey % 4 = 0 THEN 'C,V' ELSE 'C' END AS slot, p_name AS proto, p_type || ', ' || p_brand AS aa, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS bb FROM part"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    B.read(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(_CELLS.replace("::VARCHAR", "::STRING"))


_READ = "SELECT ord, string_agg(language || ':' || segs, ';' ORDER BY language) AS daughters, n_left, n_right, n_syll, proto FROM l GROUP BY ALL"
_LONG = ", l AS (SELECT ord, proto, {left} AS n_left, {right} AS n_right, len(string_split(slot, ',')) AS n_syll, language, array_to_string(list_transform(string_split({cell}, ','), lambda x: trim(x)), '+') AS segs FROM (UNPIVOT c ON aa, bb INTO NAME language VALUE cell)) "


def _corr_view(corrs: DataFrame) -> DataFrame:
    n = lambda c: F.when(F.col(c).isNull(), -1).otherwise(F.size(c)).cast("long")
    daughters = F.array_join(F.array_sort(F.transform(F.map_entries("daughters"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "+")))), ";")
    return corrs.select(F.col("ord").cast("long").alias("ord"), daughters.alias("daughters"), n("ctx_l").alias("n_left"), n("ctx_r").alias("n_right"), n("syll").alias("n_syll"), "proto")


@query(f"WITH c AS ({_CELLS})" + _LONG.format(left="CASE WHEN context = '' THEN -1 ELSE 1 END", right="CASE WHEN contains(context, 'x,y') THEN 2 ELSE -1 END", cell="cell") + _READ)
def read_corrs_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir).select("ord", F.col("id").alias("ID"), F.col("context").alias("Context"), F.col("slot").alias("Slot"), F.col("proto").alias("*"), "aa", "bb")
    return _corr_view(R.read_corrs_tsv(c, ["aa", "bb"]))


@query(f"WITH c AS ({_CELLS})" + _LONG.format(left="CASE WHEN context = '' THEN -1 ELSE 1 END", right="CASE WHEN contains(context, 'x,y') THEN 2 ELSE -1 END", cell="replace(cell, '#', ',')") + _READ)
def read_toc_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir).select("ord", F.col("id").alias("N"), F.replace("slot", F.lit(","), F.lit("=")).alias("Type"), F.col("proto").alias("*"), F.concat(F.lit("/"), F.col("context")).alias("context"), F.translate("aa", "#,", "==").alias("aa"), F.translate("bb", "#", "=").alias("bb"))
    return _corr_view(R.read_toc_tsv(c.withColumn("context", F.when(F.col("context") == "/", "").otherwise(F.col("context"))), ["aa", "bb"]))


@query(f"WITH c AS (SELECT ord, proto, slot, context, replace(aa, ', ', '|') AS aa, bb FROM ({_CELLS}))" + _LONG.format(left="CASE WHEN context = '' OR regexp_matches(string_split(context, '_')[1], '[CVˈ]') THEN -1 ELSE 1 END", right="CASE WHEN contains(context, 'x,y') THEN 2 ELSE -1 END", cell="replace(cell, '|', ',')") + _READ)
def read_toc_pipe_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir).select("ord", F.col("id").alias("N"), F.col("slot").alias("Type"), F.col("proto").alias("*"), F.when(F.col("context") == "", "").otherwise(F.concat(F.lit("("), F.replace("context", F.lit(","), F.lit("/")), F.lit(")"))).alias("context"), F.replace("aa", F.lit(", "), F.lit("|")).alias("aa"), "bb")
    return _corr_view(R.read_toc_pipe_csv(c, ["aa", "bb"]))


@query("SELECT p_partkey AS ord, p_partkey::VARCHAR AS rule_id, p_name AS input, p_type || '+' || p_brand AS outcome, 'aa+bb' AS languages, p_size AS stage FROM part")
def read_rules_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("RID"), F.lit("").alias("Context"), F.col("p_name").alias("Input"), F.concat_ws(", ", "p_type", "p_brand").alias("Outcome"), F.lit("aa, bb").alias("Languages"), F.col("p_size").alias("Stage"))
    return R.read_rules_tsv(p).select(F.col("ord").cast("long").alias("ord"), "rule_id", "input", F.array_join("outcome", "+").alias("outcome"), F.array_join("languages", "+").alias("languages"), "stage")


@query("SELECT p_type AS language, p_brand AS form, p_name AS gloss, arg_max(p_size::VARCHAR, p_partkey) AS alternative FROM part GROUP BY ALL")
def read_quirks_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("Language"), F.col("p_brand").alias("Form"), F.col("p_name").alias("Gloss"), F.col("p_size").alias("Alternative"), F.lit("").alias("Notes"))
    return R.read_quirks_tsv(p).select("language", "form", "gloss", "alternative")


@query(f"WITH c AS ({_CELLS}) SELECT id AS \"ID\", context AS \"Context\", slot AS \"Slot\", proto AS \"*\", aa, bb FROM c")
def write_corrs_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir).select("ord", F.col("id").alias("ID"), F.col("context").alias("Context"), F.col("slot").alias("Slot"), F.col("proto").alias("*"), "aa", "bb")
    return X.write_corrs_tsv(R.read_corrs_tsv(c, ["aa", "bb"]), ["aa", "bb"])


@query("SELECT p_partkey::VARCHAR AS \"RID\", '' AS \"Context\", p_name AS \"Input\", p_type || ', ' || p_brand AS \"Outcome\", 'aa, bb' AS \"Languages\", p_size AS \"Stage\" FROM part")
def write_rules_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("RID"), F.lit("").alias("Context"), F.col("p_name").alias("Input"), F.concat_ws(", ", "p_type", "p_brand").alias("Outcome"), F.lit("aa, bb").alias("Languages"), F.col("p_size").alias("Stage"))
    return X.write_rules_tsv(R.read_rules_tsv(p))


@query("SELECT p_type AS \"Language\", p_brand AS \"Form\", p_name AS \"Gloss\", arg_max(p_size::VARCHAR, p_partkey) AS \"Alternative\", '' AS \"Notes\" FROM part GROUP BY ALL")
def write_quirks_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("Language"), F.col("p_brand").alias("Form"), F.col("p_name").alias("Gloss"), F.col("p_size").alias("Alternative"), F.lit("").alias("Notes"))
    return X.write_quirks_tsv(R.read_quirks_tsv(p))


@query("SELECT 'x' || lpad((row_number() OVER (ORDER BY p_brand))::VARCHAR, 4, '0') AS mel_id, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS glosses FROM part GROUP BY p_brand")
def write_mels(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = B.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ord")).agg(F.array_sort(F.collect_set("p_name")).alias("glosses"))
    return X.write_mels(groups).select("mel_id", F.array_join("glosses", "|").alias("glosses"))


# Lexicons


@query("WITH " + B.FORMS + " SELECT language, form_id, glyphs FROM (SELECT language, form_id, CASE form_id::BIGINT % 5 WHEN 0 THEN '?' WHEN 1 THEN ' ' ELSE glyphs END AS glyphs FROM forms) WHERE trim(glyphs) NOT IN ('', '?')")
def usable_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("form_id").cast("long") % 5
    return L.usable_forms(B.forms(spark, sf_dir).withColumn("glyphs", F.when(k == 0, "?").when(k == 1, " ").otherwise(F.col("glyphs")))).select("language", "form_id", "glyphs")


@query("WITH " + B.FORMS + " SELECT language, count(*) AS forms, language IN ('en', 'de') AS known FROM forms GROUP BY language")
def known_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = B.forms(spark, sf_dir)
    table = spark.createDataFrame([("en",), ("de",), ("nl",)], "language string")
    kept, dropped = L.known_languages(forms, table)
    return kept.groupBy("language").agg(F.count("*").alias("forms")).withColumn("known", F.lit(True)).unionByName(dropped.withColumn("known", F.lit(False)))


@query("WITH " + B.FORMS + " SELECT language, form_id, glyphs, list_position(['es', 'fr'], language) AS language_order FROM forms WHERE language IN ('es', 'fr')")
def select_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.select_languages(B.forms(spark, sf_dir), ["es", "fr"]).select("language", "form_id", "glyphs", "language_order")


#: ord, language, from, to; one from segment has two targets.
_FUZZY = [(1, "en", "th", "t"), (2, "en", "t", "d"), (3, "en", "the", "de"), (4, "fr", "ou", "u"), (5, "fr", "o", "a"), (6, "fr", "ou", "w"), (7, "de", "ch", "x")]


@query("WITH " + B.FORMS + """, m AS (SELECT language, glyphs, gloss, CASE language WHEN 'en' THEN ['the', 'th', 't'] WHEN 'fr' THEN ['ou', 'o'] ELSE ['ch'] END AS f, CASE language WHEN 'en' THEN ['de', 't', 'd'] WHEN 'fr' THEN ['w', 'a'] ELSE ['x'] END AS t FROM forms WHERE language <> 'es'),
s AS (SELECT *, regexp_extract_all(glyphs, CASE language WHEN 'en' THEN 'the|th|t|.' WHEN 'fr' THEN 'ou|o|.' ELSE 'ch|.' END) AS x FROM m),
r AS (SELECT language, glyphs, gloss, array_to_string(list_transform(x, lambda y: coalesce(t[list_position(f, y)], y)), '') AS parse_glyphs FROM s) SELECT * FROM r WHERE parse_glyphs <> glyphs""")
def fuzzy_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    fuzzy = spark.createDataFrame(_FUZZY, "ord int, language string, from_seg string, to_seg string")
    return L.fuzzy_forms(B.forms(spark, sf_dir), fuzzy).select("language", "glyphs", "gloss", "parse_glyphs")


@query("WITH " + B.FORMS + ", q AS (SELECT language, glyphs, gloss, reverse(glyphs) AS parse_glyphs FROM forms WHERE gloss LIKE 'red%') SELECT * FROM q")
def quirky_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = B.forms(spark, sf_dir)
    some = forms.where("gloss like 'red%'")
    quirks = some.select(F.lit(2).alias("ord"), "language", F.col("glyphs").alias("form"), "gloss", F.reverse("glyphs").alias("alternative")).unionByName(some.select(F.lit(1).alias("ord"), "language", F.col("glyphs").alias("form"), "gloss", F.lit("old").alias("alternative")))
    return L.quirky_forms(forms, quirks).select("language", "glyphs", "gloss", "parse_glyphs")


@query("WITH " + B.FORMS + " SELECT DISTINCT gloss FROM forms WHERE gloss <> ''")
def all_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.all_glosses(B.forms(spark, sf_dir))


@query("WITH " + B.FORMS + " SELECT DISTINCT language, gloss FROM forms WHERE gloss <> ''")
def glosses_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.glosses_by_language(B.forms(spark, sf_dir))


@query("SELECT DISTINCT p_brand, row_number() OVER (ORDER BY regexp_extract(lower(p_brand), '^([^0-9]*)', 1), regexp_extract(p_brand, '([0-9]+)$', 1)::INT, p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = B.read(spark, sf_dir, "part").select("p_brand").distinct()
    return numbered(L.natural_sort(brands, "p_brand"), [G.natural_key(F.col("p_brand")), "p_brand"], "place")


@query("WITH " + B.FORMS + " SELECT form_id, count(*) AS members FROM forms GROUP BY form_id HAVING count(*) FILTER (language = 'en' AND contains(glyphs, 'th') AND contains(gloss, 'red')) > 0")
def search_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = B.forms(spark, sf_dir).groupBy("form_id").agg(F.collect_list(F.struct("language", "glyphs", "gloss")).alias("members"))
    return L.search_sets(sets, "EN", "th", "Red ").select("form_id", F.size("members").cast("long").alias("members"))
