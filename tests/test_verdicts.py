"""Resolution, page numbers, tallies and plans: fixtures, edge cases, brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from scholion.functions import scalars as S
from scholion.operators import library, offsets, reports, resolve, texts

REF = "ref_id bigint, doi string, title string, author string, year string, journal string, raw string, key string"
LIB = "citekey string, doi string, title string, surname string, year string, volume string, firstpage string"


def rows(df, *c):
    return sorted((tuple(r) for r in (df.select(*c) if c else df).collect()), key=str)


def lib(spark, entries):
    return resolve.library_entries(spark.createDataFrame(entries, LIB))


BOOKS = [("A", "10.1/A", "On the folding of vaxraol in a gel", "Čámo, D.", "2009", "57", "2394-2399"), ("B", None, "Shear flow of dilute foams", "Omo", "1999", "3", "12"), ("C", None, "Editorial", "Omo", "1999", "4", "77"), ("D", "10.1/d", None, "Bu", None, None, None), ("E", None, "Wetting of porous beds", "van Dern", None, "5", "9")]


def test_cascade(spark):
    refs = [
        (1, "https://doi.org/10.1/a", "anything else", None, None, None, None, "x"), (2, None, "On the folding of vaxraol in a gell", None, "2010", None, None, "x"), (3, None, "On the folding of vaxraol in a gel", None, "2012", None, "Camo 2009 folding vaxraol", "x"),
        (4, None, None, None, None, None, "Omo, Shear flow of dilute foams, 1999", "x"), (5, None, "", None, None, None, "Omo (1999) J. Flow 4, 77", "x"), (6, None, None, None, None, None, "Omo 1999", "x"), (7, None, None, None, None, None, None, "x"),
        (8, "10.9/none", None, None, None, None, "J. van Dern, Wetting of porous beds", "x"), (9, None, None, None, None, None, "A. Omo, 1998, Shear flow of dilute foams", "x"), (1, "https://doi.org/10.1/a", "anything else", None, None, None, None, "x"),
    ]
    got = {r["ref_id"]: (r["match"], r["how"]) for r in resolve.resolve(spark.createDataFrame(refs, REF), lib(spark, BOOKS)).collect()}
    assert got == {1: ("A", "doi"), 2: ("A", "title"), 3: (None, None), 4: ("B", "title-in-raw"), 5: ("C", "author-year+"), 6: (None, None), 7: (None, None), 8: ("E", "title-in-raw") if got[8][0] else (None, None), 9: (None, None)}
    assert resolve.resolve(spark.createDataFrame([], REF), lib(spark, BOOKS)).count() == 0 and resolve.resolve(spark.createDataFrame(refs, REF), lib(spark, BOOKS[:0])).where("match is not null").count() == 0


def test_titles_against_brute_force(spark):
    """Blocking by rare words and either end finds what comparing all pairs finds, but for a few in a hundred."""
    rnd = random.Random(4)
    words = ["gel", "foam", "flow", "folding", "membrane", "resin", "collapse", "wetting", "porous", "dilute", "charged", "shear", "protein", "crystal", "polymer", "network"]
    books = [(f"K{i:03}", None, " ".join(rnd.choice(words) for _ in range(7)) + f" of sample{rnd.randrange(60)}", "Omo", str(1990 + rnd.randrange(20)), None, None) for i in range(120)]
    refs = []
    for i in range(150):
        t = list(rnd.choice(books)[2])
        for _ in range(rnd.randrange(5)):
            t[rnd.randrange(len(t))] = rnd.choice("abcdefgh")
        refs.append((i, None, "".join(t), None, str(1990 + rnd.randrange(20)) if i % 3 else None, None, None, "x"))
    e = lib(spark, books)
    found = dict(rows(resolve.by_title(spark.createDataFrame(refs, REF), e), "ref_id", "match"))
    want = {}
    plain = {b[0]: (b[2].lower(), int(b[4])) for b in books}
    for i, _, t, _, y, *_ in refs:
        scored = [(-difflib.SequenceMatcher(None, t, p).ratio(), k) for k, (p, by) in plain.items() if y is None or abs(int(y) - by) <= 1]
        if scored and min(scored)[0] <= -0.9:
            want[i] = min(scored)[1]
    same = sum(found.get(i) == k for i, k in want.items())
    assert len(want) > 50 and same >= 0.95 * len(want) and len(set(found) - set(want)) == 0


def test_existing_and_identified(spark):
    e = lib(spark, BOOKS)
    new = spark.createDataFrame([(1, "10.1/A.", None), (2, None, "dilute foams of Shear flow"), (3, None, "new thing"), (4, None, None)], "id int, doi string, title string")
    assert rows(resolve.existing_record(new, e)) == [(1, "A", "doi"), (2, "B", "title"), (3, None, "new"), (4, None, "new")]
    f = spark.createDataFrame([(1, ["10.1/a"], "On the folding of vaxraol in a gel by D. Camo", "scan"), (2, ["10.9/x", "10.1/a"], "On the folding of vaxraol in a gel", "scan"), (3, ["10.1/a"], "another paper", "scan"), (4, [], "x", "scan"), (5, ["10.1/a"], "On the folding of vaxraol in a gel", "phys123456")], "id int, d array<string>, p string, s string")
    assert rows(resolve.identify(f, e, F.col("d"), F.col("p"), F.col("s"))) == [(1, "10.1/a", "identified"), (2, "10.1/a", "identified"), (3, None, "title not on page"), (4, None, "no DOI"), (5, None, "name says otherwise")]


def book(spark, head, n=6, doc="d", body="text of the page that is long enough " * 12):
    return spark.createDataFrame([(doc, k, head(k) + "\n" + body) for k in range(1, n + 1)], "doc string, page int, text string")


def test_offsets(spark):
    plain, article, letter = book(spark, lambda k: f"JOURNAL {862 + k}"), book(spark, lambda k: f"PRX 021039-{k}"), book(spark, lambda k: f"R{100 + k}")
    assert rows(offsets.derived_offsets(plain), "offset", "verdict", "pre") == [(862, "derived", "")]
    assert rows(offsets.derived_offsets(letter), "offset", "verdict", "pre") in ([(100, "derived", "R")], [(None, "tie", "")])
    assert rows(offsets.derived_offsets(article), "verdict") == [("derived",)] and rows(offsets.derived_offsets(article), "offset", "pre") == [(0, "021039-")]
    assert rows(offsets.derived_offsets(book(spark, lambda k: "no number", 2)), "verdict") == [("too few",)]
    assert offsets.derived_offsets(plain.limit(0)).count() == 0


def test_offset_form_ties_with_captions(spark):
    """A tie is refused: captions count along with the pages as well."""
    both = spark.createDataFrame([("d", k, f"{40 + k}\n" + "words " * 90 + f"\n{k}") for k in range(1, 6)], "doc string, page int, text string")
    assert rows(offsets.derived_offsets(both), "offset", "verdict") == [(None, "tie")]


def test_locators(spark):
    body = "words of a page " * 60
    inside = spark.createDataFrame([("d", k, body + f"\n{500 + k}\n" + "licence block " * 30) for k in range(1, 7)] + [("e", k, f"{310 + k}\n" + body) for k in range(1, 5)], "doc string, page int, text string")
    asked = spark.createDataFrame([(1, "d", 2, "502", None, None), (2, "d", 2, "503", None, None), (3, "d", 2, None, None, None), (4, "e", 2, None, None, None), (5, "e", 2, "312", 311, 314), (6, "e", 2, "313", None, None), (7, "e", 2, None, 400, 410), (8, "e", 2, "iv", None, None)], "id int, doc string, page int, printed string, first int, last int")
    assert rows(offsets.resolved_locators(inside, asked)) == [(1, "502", 500, "confirmed"), (2, None, None, "underivable"), (3, None, None, "marker only"), (4, "312", 310, "derived"), (5, "312", 310, "derived"), (6, None, None, "disagrees"), (7, None, None, "vetoed"), (8, None, None, "no folio")]


def test_list_gate(spark):
    good = "Omosen, P. R. Journal of Flow 29, 736-739"
    lists = [("good", k, str(k), good) for k in range(1, 13)] + [("head", k, str(k), "Figure caption" if k < 4 else good) for k in range(1, 13)] + [("short", k, str(k), "junk" if k == 1 else good) for k in range(1, 9)] + [("prose", k, None, "the section goes on") for k in range(1, 5)] + [("labels", k, str(700 * k), good) for k in range(1, 5)]
    g = library.list_gate(spark.createDataFrame(lists, "src_key string, n int, label string, raw string"))
    assert rows(g, "src_key", "n", "trimmed", "verdict") == [("good", 12, 0, "sound"), ("head", 9, 3, "sound"), ("labels", 4, 0, "labels"), ("prose", 4, 0, "unnamed"), ("short", 8, 0, "sound")]


def test_deep_folders_and_loops(spark):
    f = spark.createDataFrame([(k, f"f{k}", k - 1 if k else None) for k in range(14)] + [(90, "a", 91), (91, "b", 90), (92, "c", 90), (95, "d", 99), (96, "e", 95)], "id int, name string, parent_id int")
    got = {r["id"]: (r["path"], r["verdict"]) for r in library.folder_paths(f).collect()}
    assert got[13][0].count("/") == 13 and [got[k][1] for k in (90, 91, 92, 95, 96)] == ["loop", "loop", "loop", "orphan", "orphan"]


def test_suffixes_are_unique(spark):
    s = [r["s"] for r in spark.range(0, 20_000).select(library.suffix(F.col("id")).alias("s")).collect()]
    assert len(set(s)) == 20_000 and all(x == "" or x.isascii() and x.isalpha() and x.islower() for x in s) and max(map(len, s)) == 4
    docs = spark.range(0, 800).select(F.col("id").cast("string").alias("id"), F.lit("Omo").alias("base"), F.col("id").alias("created"))
    keys = [r["key"] for r in library.minted_keys(docs, spark.createDataFrame([("Omoaab",), ("Omoc",)], "key string")).collect()]
    assert len(set(keys)) == 800 and not {"Omoaab", "Omoc"} & set(keys)


def test_all_pairs_of_copies(spark):
    t = "the same long text " * 30
    f = spark.createDataFrame([("k", "a", "else"), ("k", "b", t), ("k", "c", t), ("k", "d", t + "!")], "key string, stem string, text string")
    assert rows(texts.copy_pairs(f)) == [("k", "a", "b", "other"), ("k", "a", "d", "other"), ("k", "b", "c", "equal"), ("k", "b", "d", "near")]
    assert dict(rows(texts.compared_copies(f), "stem", "verdict")) == {"a": "first", "b": "other", "c": "equal", "d": "near"}


def test_reports(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, v int")
    assert rows(reports.only(df, "k", spark.createDataFrame([("b",)], "k string"))) == [("b", 2), ("b", 3)]
    with pytest.raises(ValueError, match="unknown k: z"):
        reports.only(df, "k", spark.createDataFrame([("b",), ("z",)], "k string"))
    assert rows(reports.tally(df, "k", total=F.col("v")), "k", "n", "total", "of") == [("a", 1, 1, 4), ("b", 2, 5, 4), ("none", 1, 4, 4)]
    assert rows(reports.capped(df, 2, F.col("v"))) == [("a", 1, 2), ("b", 2, 2)]
    with pytest.raises(Exception, match="no file was seen"):
        reports.extraction_tally(spark.createDataFrame([], "plan string, status string, rules int, stem string"), 2).collect()


def test_windows_and_marks(spark):
    d = spark.createDataFrame([("p", "1. Omo, First thing 12\n2. Bumo, Second thing 3. Third\n[4] Fourth"), ("q", None)], "k string, t string")
    assert rows(reports.entry_windows(d, "k", "t")) == [("p", 1, "Omo, First thing 12"), ("p", 2, "Bumo, Second thing"), ("p", 4, "Fourth")]
    one = lambda c, text: spark.createDataFrame([(text,)], "t string").select(c(F.col("t")).alias("v")).first()["v"]
    assert one(S.loose_marks, "as shown12, in figure3 and 50 layer4 of folding7–9.") == ["12", "7–9"]
    assert one(S.cites_by_name, "(Omo et al., 1998) " * 9 + "[1]") is True and one(S.cites_by_name, "(Omo et al., 1998) " * 7) is False


def test_identifiers_to_restore(spark):
    frozen = spark.createDataFrame([("a", "1091-6490 (Electronic)", "arXiv:1401.0387v1", "10.1021/x1"), ("b", "1060510618", None, "10.1021/x2"), ("c", "1091-6490", "cond-mat/0510639", None)], "key string, issn string, arxiv string, doi string")
    live = spark.createDataFrame([("a", "1091-6490", "arXiv: 1401.0387", None), ("b", None, "", "10.1021/X2")], "key string, l_issn string, l_extra string, l_doi string")
    assert rows(reports.restorable(frozen, live), "key", "field", "route") == [("a", "arxiv", "same"), ("a", "doi", "add"), ("a", "issn", "same"), ("b", "doi", "same"), ("b", "issn", "junk"), ("c", "arxiv", "gone"), ("c", "issn", "gone")]


def test_paper_plans(spark):
    long = "words " * 500
    p = spark.createDataFrame([("a", None, None, 0, None), ("b", "short", None, 9, None), ("c", long, None, 0, None), ("d", long, "unnamed", 0, None), ("e", long, "sound", 0, None), ("f", long + "(Omo et al., 1998) " * 9, "sound", 0, None), ("g", long, None, 30, "confirmed"), ("h", long, None, 30, None)], "key string, text string, gate string, deposited int, marks string")
    assert [v for _, v in rows(reports.paper_plans(p))] == ["no-extract", "extract-too-short", "no-list-anywhere", "not-a-list", "parsed", "not-applicable", "confirmed", "unverifiable"]


def test_marks_and_plans_in_order(spark):
    m = spark.createDataFrame([("p", 1), ("p", 3), ("p", 0), ("q", 1)], "key string, n int")
    fits, dropped = reports.in_range(m, spark.createDataFrame([("p",), ("p",)], "key string"))
    assert rows(fits) == [("p", 1)] and rows(dropped) == [("p", 0), ("p", 3), ("q", 1)]
    keys, items = spark.createDataFrame([("k", "q1")], "citekey string, qid string"), spark.createDataFrame([("q2", "d2"), ("q3", "d3"), ("q4", "d3")], "qid string, doi string")
    found = spark.createDataFrame([("1", "k", None), ("2", "x", "d2"), ("3", None, "d2"), ("4", None, "d3"), ("5", None, "d9"), ("6", None, None)], "file string, citekey string, doi string")
    assert rows(reports.inbox_plan(found, keys, items), "file", "plan") == [("1", "attach"), ("2", "refuse: unknown key"), ("3", "attach"), ("4", "refuse: DOI of several records"), ("5", "create"), ("6", "refuse: nothing names it")]


def test_letters_bound_the_ratio(spark):
    """Counts of letters never part titles that the ratio holds together, and part most of the others before they are compared."""
    rnd = random.Random(8)
    words = ["gel", "foam", "flow", "folding", "membrane", "resin", "collapse", "wetting", "porous", "dilute", "charged", "shear", "ee" * 150]
    pool = [" ".join(rnd.choice(words) for _ in range(6)) for _ in range(40)]
    pool += ["".join(c if rnd.random() > 0.08 else rnd.choice("aeiou ") for c in t) for t in pool]
    df = spark.createDataFrame([(a, b, difflib.SequenceMatcher(None, a, b).ratio()) for a in pool for b in pool], "a string, b string, ratio double")
    apart = resolve.letters_apart(resolve.letter_counts(F.col("a")), resolve.letter_counts(F.col("b")))
    n = F.length("a") + F.length("b")
    assert df.where((F.col("ratio") >= 0.9) & (apart > 0.1 * n + 1e-6)).count() == 0
    assert df.where((F.col("ratio") < 0.6) & (apart <= 0.1 * n)).count() < 0.1 * df.where("ratio < 0.6").count()


def test_equal_titles_are_compared_once(spark):
    """Lines and entries of one title and year stand for all of their kind, and each line gets the smallest key."""
    e = lib(spark, [(f"K{i:02}", None, "Shear flow of dilute foams in gels", "Omo", "1999", None, None) for i in range(9, 60)] + [("J", None, "Shear flow of dilute foams in gels", "Omo", "2005", None, None)])
    refs = [(i, None, "Shear flow of dilute foams in gelz", None, (None, "1999", "2000", "2005", "2010")[i % 5], None, None, "x") for i in range(50)]
    found = dict(rows(resolve.by_title(spark.createDataFrame(refs, REF), e), "ref_id", "match"))
    assert found == {i: ("J", "K09", "K09", "J")[i % 5] for i in range(50) if i % 5 < 4}


def test_annotations_are_counted_by_file(spark, tmp_path):
    """[J2] Rows of a file that stand twice count as in SQL, and what is joined is files, not annotations of files."""
    import duckdb

    import __spark_entry__ as entry
    from oracle import connect, differences

    con = duckdb.connect()
    con.execute("create table attachments as select * from (values ('F1', 'q1', 3), ('F1', 'q1', 3), ('F2', 'q1', 4), ('F3', 'q2', 4), ('F4', null, 3), ('F5', 'q3', null), ('F6', 'q4', 5)) t(att_key, parent_qid, ord)")
    con.execute("create table entries as select * from (values ('q1', 'A'), ('q2', 'B'), ('q3', 'C'), (null, 'D')) t(qid, citekey)")
    con.execute("create table events as select range as event_id from range(0, 4000)")
    for name in ("attachments", "entries", "events"):
        con.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    got = entry.queries()["j2_annotations"](spark, str(tmp_path))
    assert rows(got, "citekey", "n", "files") == [("A", 10, 1), ("B", 5, 1)]
    assert differences(got, connect(str(tmp_path)), entry.oracle_sql()["j2_annotations"]) == ""
