"""Operators on texts."""

import random

import pytest
from scholion.operators import texts as X


def test_quotes():
    assert X.plain_quote("“Ｆull ﬁlm”​ –  A­B") == '"full film" - ab'


def test_rotation():
    prose = "the resin of the membrane and the flow of the foam in the station is moving in the region of the gel " * 12
    turned = prose.translate({ord("a") + i: ord("a") + (i + 7) % 26 for i in range(26)})
    assert X.rotated(turned) and not X.rotated(prose) and not X.rotated("acgt" * 400) and not X.rotated("")


def test_span():
    assert X.find_span("It was the ‘open gel’ that\nbroke.", "the 'open gel' that broke") == "the ‘open gel’ that\nbroke"
    assert X.find_span("a b a b", "a b") is None and X.find_span("x", "...") is None


@pytest.mark.parametrize("seed", range(5))
def test_chain_against_brute_force(seed):
    from itertools import combinations

    v = [random.Random(seed).randrange(12) for _ in range(9)]
    longest = max((len(c) for n in range(1, 10) for c in combinations(range(9), n) if all(1 <= v[b] - v[a] <= 5 for a, b in zip(c, c[1:]))), default=0)
    got = X.longest_chain(v)
    assert len(got) == longest and all(1 <= v[b] - v[a] <= 5 for a, b in zip(got, got[1:]))
    assert X.longest_chain([]) == []


def test_lists(spark):
    body = "text\n" * 40 + "References\n[1] A. One, J. Flow 3 (2001) 7\n  and more\n[2] B. Two\n77 stray\n[3] C. Three\n"
    df = spark.createDataFrame([("p", body), ("q", "no list"), ("r", None)], "k string, t string")
    assert [(r["k"], r["label"], r["raw"]) for r in X.reference_lists(df, "k", "t").collect()] == [("p", 1, "A. One, J. Flow 3 (2001) 7 and more"), ("p", 2, "B. Two 77 stray"), ("p", 3, "C. Three")]


def test_copies_and_places(spark):
    t = "the same long text " * 30
    f = spark.createDataFrame([("k", "k", t), ("k", "k-2", t), ("k", "k-3", t + "!"), ("k", "k-4", "else"), ("m", "m", None)], "key string, stem string, text string")
    assert {r["stem"]: r["verdict"] for r in X.compared_copies(f).collect()} == {"k": "first", "k-2": "equal", "k-3": "near", "k-4": "other", "m": "first"}
    pages = spark.createDataFrame([("k", 1, "One  gel"), ("k", 2, "two ‘foams’ here"), ("k", 3, 'The beg of a long quote, over "seven" words in all.')], "key string, page int, text string")
    q = spark.createDataFrame([(1, "k", 1, "one gel"), (2, "k", 1, "'foams'"), (3, "k", 1, "none"), (4, "z", 1, "one"), (5, "k", 1, None), (6, "k", 1, "eg of a LONG quote, over “seven” words in al"), (7, "k", 3, "a long quote over eight words in all there")], "id int, key string, page int, quote string")
    assert {r["id"]: (r["verdict"], r["found_on"]) for r in X.located(q, pages).collect()} == {1: ("ok", None), 2: ("elsewhere", 2), 3: ("missing", None), 4: ("missing", None), 5: ("missing", None), 6: ("elsewhere", 3), 7: ("missing", None)}


def test_entities(spark):
    d = spark.createDataFrame([(1, "a &amp;amp; b", "x"), (2, "a & b", None)], "id int, title string, journal string")
    assert [tuple(r) for r in X.with_entities(d, "id", ["title", "journal"]).collect()] == [(1, "title", "a &amp;amp; b", "a &amp; b")]
