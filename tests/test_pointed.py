"""Pointed Hebrew: words worked by hand, whole texts, and the readers of files."""

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from seqloom import catalog
from seqloom.functions import pointed as H
from seqloom.operators import words
from seqloom.sources import pointed, tables

from .test_catalog import SF, shown

A = H.ACUTE
# points and accents by letter, so that words can be read in the tests
_SIGNS = {
    "a": "ַ", "A": "ָ", "e": "ֵ", "E": "ֶ", "i": "ִ", "o": "ֹ", "u": "ֻ", ":": H.SHEVA, "*": H.DAGESH, "s": H.SIN_DOT,
    "m": "ֽ", "n": "֣", "t": "֖", "z": "֔", "|": H.PASEQ, ".": H.SOF_PASUQ, "-": H.MAQAF,
}


def w(text):
    return "".join(_SIGNS.get(c, c) for c in text)


@pytest.mark.parametrize(
    "word, said",
    [
        ("הaחomשEך", f"haho{A}shekh"),  # the accent follows its own vowel
        ("מAקnוoם", f"maqo{A}m"),  # next unit is a carrier with a vowel
        ("הAאtוoר", f"hao{A}r"),
        ("וAבoהוn*", f"vavo{A}hu"),  # vav with a vowel is a consonant, shuruq is not; the accent falls back to the vowel behind
        ("אוoר", "or"),
        ("מEלEtך", f"mele{A}kh"),
        ("דAבtAר", f"da{A}var"),  # accent before the vowel, next vowel not on a carrier: the one behind
        ("ב:*רteאשiית", f"bere{A}shit"),  # the next carrier is silent: the nearest segment, of two the earlier
        ("רוoח", "roh"),
        ("רו*חa", "ruah"),  # furtive
        ("מaלכAה", "malkha"),  # final he is silent
        ("מaל:כAה", "malkha"),  # sheva after a: silent
        ("יiש:ר:*נAה", "yishrena"),  # a second sheva in a row is heard
        ("שsi" + "ים", "sim"),  # yod after i is silent
        ("יi", "yi"),
        ("בaיiת", "vayit"),
        ("דוoד:אa", "dodea"),  # sheva before a guttural with a vowel
        ("כaל:*ב", "khalv"),
        ("יהוה", "adonai"), ("יהוnה", f"adonai{A}"), ("אEלoהitים", f"elohi{A}m"),
        ("שלום", ""), ("", ""), ("abc", ""), (".", ""),
    ],
)
def test_words(word, said):
    assert H.transliterated(w(word)) == said


def test_acute():
    assert H.stressed("shalom") == f"sha{A}lom" and H.stressed("shalom", first=False) == f"shalo{A}m"
    assert H.stressed("sh") == "sh" and H.stressed(f"a{A}ba", first=False) == f"a{A}ba"


def test_stream(spark):
    text = w("﻿הAאtוoר (ab)  [x]12 מEלEטך-שaר. | שלום.")
    rows = spark.createDataFrame([("g", text), ("none", None), ("empty", "")], "book string, text string")
    got = [r["token"] for r in pointed.pointed_stream(rows).orderBy("tok_pos").collect()]
    assert got == [f"hao{A}r[tipeha]", "meletkh", "shar", "{sof_pasuq}", "{paseq}", "{sof_pasuq}"]
    joined = words.words(pointed.pointed_stream(rows)).orderBy("pos").collect()
    assert [(r["word"], r["internal"], r["external"]) for r in joined] == [(f"hao{A}r", ["tipeha"], []), ("meletkh", [], []), ("shar", [], ["sof_pasuq", "paseq", "sof_pasuq"])]
    total = pointed.summary(pointed.pointed_stream(rows)).collect()
    assert [tuple(r) for r in total] == [("g", 3, 3)]


def test_validation(spark):
    rows = spark.createDataFrame([("a", "אֿ֯֯ׄ"), ("b", "אׅ"), ("c", None)], "book string, text string")
    got = {r["book"]: tuple(r)[1:] for r in pointed.validation(rows).collect()}
    assert got == {"a": (2, 1, 1, 0), "b": (0, 0, 0, 1), "c": (0, 0, 0, 0)}
    with pytest.raises(Exception, match="U\\+05C5"):
        pointed.validation(rows, strict=True).collect()


@pytest.mark.parametrize("name", [n for n in catalog.oracle_sql() if n.startswith("pointed_")])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert shown(catalog.queries()[name](spark, SF).toPandas()) == shown(con.execute(catalog.oracle_sql()[name]).df())


def test_files(spark, tmp_path):
    book = tmp_path / "genesis_taamim_annotated.txt"
    book.write_text("﻿bara[munah] {sof_pasuq}\n et ", encoding="utf8")
    stated = hashlib.sha256(book.read_bytes()).hexdigest()
    other = tmp_path / "exodus_taamim_annotated.txt"
    other.write_text("x", encoding="utf8")
    for path, value in ((book, stated.upper()), (other, "0" * 63)):
        (tmp_path / f"{path.name}.meta.json").write_text(json.dumps({"output_sha256": value}))
    rows = tables.annotated_text(spark, str(book)).orderBy("tok_pos").collect()
    assert [tuple(r) for r in rows] == [("genesis", 0, "bara[munah]"), ("genesis", 1, "{sof_pasuq}"), ("genesis", 2, "et")]
    ok = {r["path"].rsplit("/", 1)[1]: (r["ok"], r["sha256"] == stated) for r in tables.verified(spark, f"{tmp_path}/*.txt", f"{tmp_path}/*.meta.json").collect()}
    assert ok == {book.name: (True, True), other.name: (False, False)}


def test_spans(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"book": "g", "he": [["a b", "c"], ["d e f"]]}))
    spans = tables.verse_spans(spark, str(tmp_path / "v.json"))
    assert [tuple(r) for r in spans.orderBy("ordinal").collect()] == [("g", 1, 1, 1, 0, 2, 2), ("g", 2, 1, 2, 2, 3, 1), ("g", 3, 2, 1, 3, 6, 3)]
    assert tables.span_faults(spans).count() == 0
    assert [r["ordinal"] for r in tables.span_faults(spans.where("ordinal <> 2")).collect()] == [3]


def test_tables_of_text(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", float("nan")), ("c", float("inf"))], "k string, v double")
    assert [r["v"] for r in tables.json_safe(rows).orderBy("k").collect()] == [1.5, None, None]
    for tab in (False, True):
        tables.write_csv(rows, str(tmp_path / "out"), tab)
    tables.write_csv(rows.limit(1), str(tmp_path / "out"))
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "out"), "k string, v double").collect()] == [("a", 1.5)]
    titles = spark.createDataFrame([("Mechon-Mamre, v2", "mechon mamre V2"), ("a", "b")], "x string, y string")
    assert [r[0] for r in titles.select(tables.same_version("x", "y")).collect()] == [True, False]
    assert tables.canonical_hash({"b": 1, "a": "é"}) == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()


@pytest.mark.parametrize("name", ["pointed_letters", "pointed_units", "pointed_mark_names", "pointed_cleanup", "pointed_validation"])
def test_texts_do_not_pass_through_python(spark, name):
    text = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in text


def test_summary_composes_without_python(spark):
    text = catalog.queries()["pointed_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "nfc" not in text and text.count("ArrowEvalPython") == 1


def test_composed_as_python_does(spark):
    import unicodedata

    from seqloom.functions import pointed

    texts = [None, "", "ascii", "éà", "שּׁ", "אַשׁ", "ẛ̣", "각", "\U0001d15e", "ַּ֑"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(pointed.composed(F.col("t"))).collect()
    assert [r[0] for r in rows] == [t and unicodedata.normalize("NFC", t) for t in texts]
