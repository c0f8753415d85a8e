"""Library operators, sources, sinks and streams on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from scholion.functions import scalars as S
from scholion.operators import ledger, library
from scholion.sources import readers, writers
from scholion.streaming import health


def rows(df, *c):
    return sorted(tuple(r) for r in (df.select(*c) if c else df).collect())


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("v")).first()["v"]


@pytest.mark.parametrize(("f", "given", "wanted"), [
    (S.doi_normal, " https://doi.org/10.1/AbC. ", "10.1/abc"), (S.doi_normal, " ", None), (S.doi_clean, "10.1/a(b).", "10.1/a(b)"), (S.doi_clean, "10.1/a)", "10.1/a"), (S.doi_of_filename, "10.1021_ja012.pdf", "10.1021/ja012"),
    (S.key_name, "o'Brien", "Obrien"), (S.key_name, "IUPAC", "IUPAC"), (S.key_name, "李", "Anon"), (S.key_word, "On the Flow of Things", "Flow"), (S.key_word, None, "Untitled"), (S.cited_surname, "J. van Smith and Jones-Lee", "Jones-Lee"),
    (S.folio, "R863", 863), (S.folio, "021039-2", 2), (S.folio, "iv", None), (S.stem_key, "Omo2009-2", "Omo2009"), (S.stem_key, "Omo-1", "Omo-1"), (S.backend_of, "mendeley:7", "mendeley"), (S.backend_of, "http:7", None), (S.backend_of, "7", "zotero"),
    (S.page_clean, "a suspen-\nsion is\nhere.\nNew", "a suspension is here.\nNew"), (S.expand_group, "1–4,7", [1, 2, 3, 4, 7]), (S.expand_group, "1-90", [1, 90]), (S.alnum_share, "  ", 1.0), (S.failure_kind, "Could not reach the host (403)", "network"), (S.failure_kind, "KeyError: x", "other"), (S.key_word, "How vaxraol grows", "How"), (S.key_word, "Using the flow", "Flow"), (S.issn_set, "1091-6490 (Electronic) 00278424", ["00278424", "10916490"]), (S.arxiv_id, "arXiv:1401.0387v1", "1401.0387"), (S.proof_marks, "pages xxx–xxx and 000-000", 2), (S.creator_role, "inventor", "primary"), (S.creator_role, "new", "unknown"), (S.personlike, "Ada Lovelace", "two or three capitalised words"), (S.personlike, "J. B. Ames", "initials then a capitalised word"), (S.personlike, "WHO", ""), (S.dois_of_filename, "10.1021_ja-012.pdf", ["10.1021/ja-012"]), (S.clean_url, " https://a.b/c ", "https://a.b/c"), (S.clean_url, "https://a.b papers2://x", ""), (S.single_url, "https://a.b/c", True), (S.issn_shape, "1234-567X", True),
])
def test_scalars(spark, f, given, wanted):
    assert one(spark, f, given) == wanted


def test_ledger(spark):
    claims = spark.createDataFrame([(c,) for c in "abcd"], "claim string")
    links = spark.createDataFrame([("a", "k1", "main"), ("a", "k2", "main"), ("b", "k1", "main"), ("c", "k3", "context")], "claim string, source string, role string")
    weights = spark.createDataFrame([("main", 1.0), ("context", 0.0)], "role string, weight double")
    assert rows(ledger.load_rank(links, weights)) == [("k1", 2.0, 2, 1), ("k2", 1.0, 1, 0)]
    assert rows(ledger.thin_claims(claims, links, weights)) == [("b", 1), ("c", 0), ("d", 0)]
    assert rows(ledger.orphan_claims(claims, links, weights)) == [("c", "uncarried"), ("d", "bare")]
    assert rows(ledger.remainder(links, weights, F.lit("k1")), "claim", "verdict") == [("a", "thin"), ("b", "falls")]
    assert rows(ledger.violations(claims, links, weights)) == []


def test_minted_keys_avoid_others(spark):
    docs = spark.createDataFrame([("1", "Bird", 1), ("2", "Bird", 2), ("3", "Birda", 1), ("4", "Bird", 3)], "id string, base string, created int")
    taken = spark.createDataFrame([("Bird",)], "key string")
    got = dict(rows(library.minted_keys(docs, taken)))
    assert got == {"1": "Birdb", "2": "Birdc", "4": "Birdd", "3": "Birda"}


def test_suffixes(spark):
    got = [r["s"] for r in spark.range(0, 55).orderBy("id").select(library.suffix(F.col("id").cast("int")).alias("s")).collect()]
    assert got[:3] == ["", "a", "b"] and got[26:29] == ["z", "aa", "ab"] and len(set(got)) == 55


def test_seats(spark):
    f = spark.createDataFrame([("d", "x", 2), ("d", "b", None), ("d", "a", None), ("e", "p", 1), ("e", "q", 1)], "doc string, id string, seat bigint")
    assert rows(library.seats(f)) == [("d", "a", 1, False), ("d", "b", 3, False), ("d", "x", 2, False), ("e", "p", 1, True), ("e", "q", 1, True)]


def test_verdicts_partition(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "x"), (4, "d")], "k int, v string")
    assert rows(library.snapshot_diff(old, new, "k", ["v"])) == [(1, "gone"), (2, "same"), (3, "changed"), (4, "new")]
    assert rows(library.field_changes(old, new, "k", ["v"])) == [(1, "v", "a", None), (3, "v", "c", "x"), (4, "v", None, "d")]
    c = spark.createDataFrame([(1, "p", 2), (1, "q", 2), (2, "p", 1), (2, "q", 3)], "r int, candidate string, score int")
    assert rows(library.unique_best(c, "r", "score")) == [(1, None, "tie"), (2, "q", "matched")]


def test_ordinals(spark):
    names = [f"Name{i}" for i in range(20)]
    refs = spark.createDataFrame([(k, i + 1, n) for k in "tu" for i, n in enumerate(names)], "key string, n int, name string")
    marks = spark.createDataFrame([("t", i + 1, names[i]) for i in range(12)] + [("u", i + 1, names[i + 1]) for i in range(12)], "key string, n int, name string")
    got = {r["key"]: r["verdict"] for r in library.ordinal_rates(marks, refs).collect()}
    assert got == {"t": "confirmed", "u": "offset"}


def test_accessions(spark):
    t = spark.createDataFrame([("a", "taken from PDB entry 1ABC (as 3DEF), 2XYZ and 1999; also pdb code 1abc. PDB2PQR; PDB IDs 4GHI"), ("b", "in 1ABC alone"), ("c", None)], "key string, text string")
    assert rows(library.accessions(t, "key", F.col("text"))) == [("a", "1ABC", 2), ("a", "2XYZ", 1), ("a", "3DEF", 1)]


def test_partitions_do_not_matter(spark, sf):
    from scholion.plans.catalogue import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append([rows(QUERIES[q](spark, sf)) for q in ("q12_load", "w1_runs", "j12_placed")])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_bibliography_round_trip(spark, tmp_path, sf):
    from scholion.session import table

    e = table(spark, sf, "entries").where("title is not null")
    writers.write_bibliography(e, str(tmp_path / "b"))
    back = readers.read_bibliography(spark, str(tmp_path / "b"))
    assert back.count() == e.count()
    x = e.join(back, "citekey").where(F.col("fields")["journal"] != F.regexp_replace("journal", r"([&%$#_])", r"\\$1"))
    assert x.count() == 0


def test_nested_braces():
    assert readers.parse_bibliography('@article{k1, title = {A {nested} one}, year = 2009, note = "x, y"}\n@book{k2,title={T}') == [("k1", "article", {"title": "A {nested} one", "year": "2009", "note": "x, y"}), ("k2", "book", {"title": "T"})]


def test_page_ranges(spark):
    b = spark.createDataFrame([("a", {"pages": "12--19"}), ("b", {"pages": "7"}), ("c", {"pages": "9-3"}), ("d", {})], "citekey string, fields map<string,string>")
    assert {r["citekey"]: (r["first"], r["last"]) for r in readers.page_range(b).collect()} == {"a": (12, 19), "b": (None, None), "c": (None, None), "d": (None, None)}


def test_split_pages(spark):
    t = spark.createDataFrame([("s", "---\ntitle: x\n---\nhead <!-- p. 1 -->\none\n<!-- p. 2 -->\ntwo")], "stem string, body string")
    assert [(p, t) for _, p, _, t in rows(readers.split_pages(t))] == [(1, "one"), (2, "two")]


def test_findings_log(spark):
    body = "# log\n## 1. FINDING 2020-01-02\nquote: a b\nquestion: why\n## 2. CHECKED 2020-01-03 of 1\n## oops\n## 3. FINDING 2020-13-03\nquote: x\n"
    got = readers.parse_findings(spark.createDataFrame([("k", body)], "citekey string, body string"))
    assert [(r["ordinal"], r["complaint"]) for r in got.collect()] == [(1, None), (2, None), (None, "no readable head"), (3, "no such date")]


def test_ledger_overrides_and_captured_pages(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"weights": {"main": 1.0}, "claims": [{"id": "a", "statement": "s", "sources": [{"k": "k1", "role": "main"}]}]}))
    claims, links, weights = readers.read_ledger(spark, str(tmp_path / "l.json"))
    assert rows(links) == [("a", "k1", "main")] and rows(weights) == [("main", 1.0)] and claims.count() == 1
    (tmp_path / "o.tsv").write_text("# note\nstem\tatt\n\n")
    assert rows(readers.read_overrides(spark, str(tmp_path / "o.tsv"), "stem string, attachment string")) == [("stem", "att")]
    (tmp_path / "page-0.json").write_text(json.dumps([{"key": "A", "version": 1, "data": {"itemType": "note"}}, {"key": "B", "version": 2, "data": {"itemType": "book", "title": "T"}}]))
    (tmp_path / "page-100.json").write_text("[]")
    spark.dataSource.register(readers.CapturedPages)
    assert rows(spark.read.format("captured_pages").option("path", str(tmp_path)).option("skip", "note,attachment").load().select("key", "title")) == [("B", "T")]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    schema = "source string, ts timestamp, failed boolean"
    spark.createDataFrame([("a", f"2020-01-01 0{i}:00:00", f) for i, f in enumerate([False, True, True])], "source string, ts string, failed boolean").selectExpr("source", "cast(ts as timestamp) ts", "failed").write.parquet(str(src))
    q = health.failure_streaks(spark.readStream.schema(schema).parquet(str(src))).writeStream.outputMode("update").format("memory").queryName("streaks").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("select * from streaks").collect()
    assert len(r) == 1 and r[0]["streak"] == 2 and r[0]["failing_since"].hour == 1
    q = spark.readStream.schema(schema).parquet(str(src)).writeStream.foreachBatch(health.fold_log(str(tmp_path / "log"))).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    ok = spark.createDataFrame([("f", "m1", "attach")], "file string, ok_md5 string, plan string")
    came = spark.createDataFrame([("f", "m1"), ("g", "m2")], "file string, md5 string")
    assert rows(health.arrivals(came, ok), "file", "verdict") == [("f", "approved"), ("g", "unplanned")]
