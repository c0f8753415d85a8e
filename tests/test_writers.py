"""Bibliography entries, annotation pages, state folded from a log."""

from pyspark.sql import functions as F

from scholion.sources import writers
from scholion.streaming import health


def doc(**k):
    base = dict(id="7", citekey="Omo2009Flow", type="journal", title=None, authors=None, editors=None, year=None, source=None, volume=None, issue=None, pages=None, publisher=None, city=None, institution=None, identifiers=None, abstract=None, keywords=None, websites=None)
    return {**base, **k}


def text(spark, **k):
    return writers.bibliography_entry(spark.createDataFrame([doc(**k)], writers.DOCUMENT)).first()["entry"]


def test_article(spark):
    got = text(spark, title="Flow &amp; 5% of {gels} \u2013 a\u200bb", authors=[("Ada", "Omo", None), (None, None, "IUPAC"), (None, None, "others")], year="2009", source="J. Flow_1", pages="12\u201319", identifiers=("10.1/x", None, None, "99", "1401.0387"))
    assert got == "@article{Omo2009Flow,\n  author  = {Omo, Ada and {IUPAC} and others},\n  title   = {{Flow \\& 5\\% of \\{gels\\} -- ab}},\n  journal = {J. Flow\\_1},\n  year    = {2009},\n  pages   = {12--19},\n  doi     = {10.1/x},\n  pmid    = {99},\n  eprint  = {1401.0387},\n}"


def test_other_kinds(spark):
    assert text(spark, type="book_section", title="T", source="Book") == "@incollection{Omo2009Flow,\n  title     = {{T}},\n  key       = {Omo2009Flow},\n  booktitle = {Book},\n}"
    assert text(spark, type="thesis", institution="U of X", source="Archive") == "@phdthesis{Omo2009Flow,\n  key    = {Omo2009Flow},\n  type   = {Thesis},\n  school = {U of X},\n  note   = {Archive. Untitled record (document id 7)},\n}"
    assert text(spark, type="strange", title="T", editors=[("B", "Ed", None)]).startswith("@misc{Omo2009Flow,\n  editor = {Ed, B}")


def test_annotations(spark):
    d = spark.createDataFrame([doc(title="T", authors=[("Ada", "Omo", None)], year="2009"), doc(citekey="none")], writers.DOCUMENT)
    n = spark.createDataFrame([("Omo2009Flow", 2, 5, "highlight", "later"), ("Omo2009Flow", 1, 9, "note", "mine"), ("Omo2009Flow", 1, 3, "highlight", ""), ("Omo2009Flow", 1, 1, "note", None)], "citekey string, page int, y int, kind string, text string")
    got = {r["citekey"]: r["markdown"] for r in writers.annotation_pages(d, n).collect()}
    assert got["Omo2009Flow"] == "# T\n\n- **key**: `Omo2009Flow`\n- **authors**: Ada Omo\n- **year**: 2009\n- **source**: \n\n---\n\n- *(highlight, p. 1)*\n- **note (p. 1)**: mine\n- > later\n  \n  *(p. 2)*\n"
    assert got["none"].endswith("*(no annotations)*\n") and got["none"].startswith("# (untitled)")


def test_state_of_a_log(spark, tmp_path):
    fold, schema = health.fold_state(str(tmp_path), ["k"], "at"), "k string, at int, v string"
    fold(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], schema), 0)
    for _ in range(2):
        fold(spark.createDataFrame([("a", 3, "z"), ("c", 1, None)], schema), 1)
    assert sorted(tuple(r) for r in spark.read.schema(schema).parquet(f"{tmp_path}/state=1").collect()) == [("a", 3, "z"), ("b", 2, "y"), ("c", 1, None)]
    assert spark.read.parquet(f"{tmp_path}/state=1").select(F.count("*")).first()[0] == 3
