"""Operators for corpora: results, edge cases, brute force and round trips."""

import random
import unicodedata

import pytest

pytest.importorskip("scholion.llm.queries")

from scholion.llm import leak, mix, pages, queries, residue, unify  # noqa: E402


def rows(df):
    return {tuple(r) for r in df.collect()}


# -- scanned pages ---------------------------------------------------------------

PAGE = "page_id bigint, doc string, page int, text string, line_no string, kind string"
BODY = ["The resin of the supported membrane was held in glycerol and the", "permeability of the membrane saturates with the broad plateau.", "Both the resin and the membrane drive the permeability of foam."]


def book(spark, change=lambda n, lines: lines, n=8):
    out = []
    for k in range(1, n + 1):
        lines = ["JOURNAL OF GRANULAR CHEMISTRY", "", *BODY, *BODY, "", f"- {100 + k} -"]
        out.append((k, "Omo2009", k, "\n".join(change(k, lines)), "x", "y"))
    return spark.createDataFrame(out, PAGE)


def test_furniture_broken_misread(spark):
    def change(n, lines):
        if n == 3:
            lines[2] = "The rcsin of the supported membrane was held in glycerol and thc"
            lines[4] = "Both the resin and the membrane drive the permea-"
            lines.insert(5, "bility of foam.")
        return lines

    got = rows(pages.repairs(book(spark, change)).select("page_id", "line_no", "kind").distinct())
    assert {(k, 1, "furniture") for k in range(1, 9)} <= got
    assert {(p, k) for p, _, k in got if k == "furniture"} == {(k, "furniture") for k in range(1, 9)} and sum(k == "furniture" for _, _, k in got) == 16
    assert {x for x in got if x[2] != "furniture"} == {(3, 3, "misread"), (3, 5, "broken")}


def test_misread_numbers_by_share(spark):
    """A misread number is listed however often it occurs, if its number occurs far more often; a frequent form without one stays."""
    lexicon = spark.createDataFrame([("4o4", 30), ("28s", 50), ("2o5", 2)], "word string, n bigint")
    numbers = spark.createDataFrame([("404", 900), ("285", 60)], "word string, n bigint")
    assert {(r["word"], r["right"]) for r in pages.corrections(lexicon, numbers=numbers).collect()} == {("4o4", "404"), ("2o5", "205")}


def test_numbers_whatever_the_count(spark):
    """Twenty or more occurrences of a misread number change nothing while its share stays."""
    numbers = spark.createDataFrame([("100", 1000), ("101", 1000)], "word string, n bigint")
    for n in (20, 21, 200):
        lexicon = spark.createDataFrame([("l00", n), ("l01", n)], "word string, n bigint")
        assert {r["right"] for r in pages.corrections(lexicon, numbers=numbers).collect()} == {"100", "101"}


def test_long_words_are_corrected(spark):
    word = "poly" + "methyl" * 8 + "ether"
    lexicon = spark.createDataFrame([(word, 90), (word.replace("ether", "cther"), 1), ("m" * 3000, 1)], "word string, n bigint")
    assert {(r["word"], r["right"]) for r in pages.corrections(lexicon).collect()} == {(word.replace("ether", "cther"), word)}


def test_context_chooses(spark):
    """Of two words that a misread one may stand for, the neighbours pick."""
    def change(n, lines):
        lines[2:2] = ["the warm bath was hot and the warm bath was hot", "a long path was cut and a long path was cut"] * 3
        if n == 5:
            lines[2] = "the warm 8ath was hot and the warm bath was hot"
        return lines

    got = {(r["page_id"], r["line_no"], r["right"]) for r in pages.repairs(book(spark, change)).where("kind = 'misread'").collect()}
    assert got == {(5, 3, "bath")}


def test_compounds_stay(spark):
    def change(n, lines):
        lines[2] = "The pulsed-field gradient of the resin and the membrane, pulsed-"
        lines[3] = "field gradient again of the resin with the membrane plateau."
        return lines

    assert not [r for r in pages.repairs(book(spark, change)).collect() if r["kind"] == "broken"]


def test_paragraphs(spark):
    text = [r["text"] for r in pages.paragraphs(book(spark, lambda n, x: x, 3)).orderBy("paragraph").collect()]
    assert text and not any("JOURNAL" in t or "10" in t for t in text) and text[0].startswith("The resin of the supported membrane was held in glycerol and the permeability")


def test_pages_void(spark):
    odd = spark.createDataFrame([(1, None, None, "", "a", "b"), (2, None, 1, None, "a", "b"), (None, "d", 1, "x", "a", "b"), (3, "d", 1, "\n\n", "a", "b"), (4, "e", 1, "word " * 20000, "a", "b"), (4, "e", 1, "word " * 20000, "a", "b")], PAGE)
    assert pages.repairs(odd).count() == 0
    assert pages.repairs(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("read", "right"), [("rcsin", "resin"), ("vvas", "was"), ("arnineate", "amineate"), ("supportéd", "supported"), ("condidons", "conditions"), ("(oefficient", "coefficient"), ("clisappears", "disappears"), ("1iquid", "liquid"), ("app1ied", "applied"), ("membraiie", "membrane")])
def test_index_meets_confusions(read, right):
    assert set(pages.deletes(read)) & set(pages.deletes(right)) and pages.distance(read, right) < 0.95


@pytest.mark.parametrize(("line", "numbers"), [("- 542 -", {542}), ("l662", {1662}), ("civ", {104}), ("Page", set()), ("[202]", {202})])
def test_page_numbers(line, numbers):
    assert numbers <= pages.numbers_in(line)


# -- consistent form -------------------------------------------------------------------


@pytest.mark.parametrize(("a", "b"), [("étude", "étude"), ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("zero​width", "zerowidth"), ("no break", "no break"), ("е́tat", "état"), ("5 Ω", "5 Ω"), ("µm", "μm"), ("oﬃce", "office"), ("grazing‐incidence", "grazing-incidence"), ("soft­hyphen", "softhyphen"), ("Ａ́b", "Áb"), ("が", "が"), ("q̣̇", "q̣̇")])
def test_reads_the_same(a, b):
    t = unify.transducer()
    assert t(a) == t(b)


@pytest.mark.parametrize(("a", "b"), unify.APART + [("x²", "x2"), ("Fur", "Für"), ("a–b", "a-b"), ("The", "the"), ("👩‍🔬", "👩🔬"), ("نمی‌خواهم", "نمیخواهم")])
def test_stays_apart(a, b):
    t = unify.transducer()
    assert t(a) != t(b)


def test_form_is_final():
    t = unify.transducer()
    rnd = random.Random(2)
    for _ in range(3000):
        s = "".join(chr(rnd.choice([rnd.randrange(32, 0x250), rnd.randrange(0x300, 0x530), rnd.randrange(0x2000, 0x2070), rnd.randrange(0xFF01, 0xFFE0), 0x212B, 0x3099, 0x304B])) for _ in range(rnd.randrange(1, 8)))
        once = t(s)
        assert t(once) == once, ascii(s)
        assert t(unicodedata.normalize("NFD", s)) == once, ascii(s)


def test_conflicts_are_found(monkeypatch):
    monkeypatch.setattr(unify, "LOOK_ALIKES", unify.LOOK_ALIKES | {"²": "2"})
    with pytest.raises(ValueError):
        unify.compile_rules()


def test_pairs_against_all(spark):
    texts = ["a b", "a b", "a b", "a​ b", None, "", "​", "c", "с", "c", "d", "x" * 50000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(0, "a b", "z")], "k bigint, t string, form string")
    t = unify.transducer()
    want = {("f", i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a and b and a != b and t(a) == t(b) != ""}
    assert rows(unify.same_reading(unify.unified(df, "k", "t", "f"))) == want
    assert unify.same_reading(unify.unified(df.limit(0), "k", "t", "f")).count() == 0


# -- leaks ------------------------------------------------------------------------------------

DOC = "doc_id bigint, text string, item_id string"


def items(spark):
    rnd = random.Random(7)
    out = []
    for i in range(12):
        w = [f"w{rnd.randrange(400)}x" if rnd.random() < 0.2 else "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9))) for _ in range(60)]
        out.append((i, "Read this and then answer the question that follows it in one short sentence as well as you can.\n" + " ".join(w[:50]) + "\nQuestion: " + " ".join(w[50:]), i))
    return spark.createDataFrame([*out, (None, "x", 1), (90, None, 1), (91, "", 1)], "item_id bigint, text string, doc_id int")


def test_leaks_against_brute_force(spark):
    it = items(spark)
    texts = {r["item_id"]: r["text"] for r in it.collect() if r["text"]}
    rnd = random.Random(9)
    docs, want = [], set()
    for d in range(150):
        i, n, spoiled = rnd.randrange(12), rnd.choice([6, 10, 18, 25, 40]), rnd.randrange(0, 3)
        w = leak.words(texts[i].split("\n")[1])
        a = rnd.randrange(0, len(w) - n)
        part = w[a : a + n]
        for k in rnd.sample(range(1, n - 1), spoiled):
            if part[k].isalpha() and len(part[k]) > 4:
                part[k] = part[k][:2] + "z" + part[k][3:]
        text = " ".join(["filler"] * rnd.randrange(5)) + " " + rnd.choice([" ", "\n", "  "]).join(part).upper() + ", and " + "other words " * rnd.randrange(40)
        docs.append((d, text, "q"))
        if n >= 18:
            want.add((d, i))
    docs += [(500, None, "q"), (501, "", "q"), (None, "x", "q"), (502, texts[3].split("\n")[0], "q"), (503, "before " + texts[4].split("\n")[2].removeprefix("Question: ") + " after", "q"), (504, "long " * 30000, "q")]
    got = rows(leak.leaks(spark.createDataFrame(docs, DOC), it).select("doc_id", "item_id"))
    assert got == want | {(503, 4)}
    blocks = rows(leak.leaks(spark.createDataFrame(docs, DOC), it, block_words=100).select("doc_id", "item_id"))
    assert blocks == got


@pytest.mark.parametrize("instruction", ["", "Read this and answer.\n"])
def test_a_passage_with_several_questions(spark, instruction):
    passage = " ".join(f"{w}{k}" for k, w in enumerate(["gel", "foam", "resin", "plateau"] * 10))
    it = spark.createDataFrame([(k, f"{instruction}{passage}\nQuestion: why does the {w} grow so fast here?") for k, w in enumerate(("gel", "foam", "resin"))] + [(9, "Read this and answer.\nA lot of other words stand in this one.\nQuestion: what else?")], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "before " + passage + " after"), (2, "Read this and answer. Nothing else.")], "doc_id bigint, text string")
    assert rows(leak.leaks(d, it).select("doc_id", "item_id")) == {(1, 0), (1, 1), (1, 2)}


def test_leaks_void(spark):
    d = spark.createDataFrame([(1, "some text", "x")], DOC)
    assert leak.leaks(d.limit(0), items(spark)).count() == 0
    assert leak.leaks(d, items(spark).limit(0)).count() == 0


@pytest.mark.parametrize(("a", "b", "same"), [("litres", "liters", True), ("entered", "entred", True), ("31", "32", False), ("cat", "dog", False), ("w3x", "w4x", False), ("membrane", "metal", False)])
def test_misspelled(a, b, same):
    assert leak.misspelled(a, b) is same


# -- mixing -----------------------------------------------------------------------------------------


def test_flow_is_cheapest():
    flow = mix.min_cost_flow({"a": 100, "a|b": 50, "b": 10}, {"a": 120, "b": 60}, {"a": {"a"}, "a|b": {"a", "b"}, "b": {"b"}}, {"a": 2, "b": 3})
    assert sum(v for (_, s), v in flow.items() if s == "a") == 120 and sum(v for (_, s), v in flow.items() if s == "b") == 60
    used = {p: sum(v for (q, _), v in flow.items() if q == p) for p in ("a", "a|b", "b")}
    # 160 tokens serve 180, so just 20 are repeated.
    assert sum(max(0, used[p] - n) for p, n in (("a", 100), ("a|b", 50), ("b", 10))) == 20


def test_mixture(spark):
    rnd = random.Random(4)
    docs = [(i, f"document {i} " + " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randrange(5, 40))), rnd.choice(["big"] * 6 + ["small", "Other one"]), 1) for i in range(2000)]
    docs += [(5000, docs[0][1], "small", 1), (6000, None, "big", 1), (6001, "", "big", 1), (6002, "text", None, 1), (6003, "text here", "untargeted", 1), docs[3]]
    targets = spark.createDataFrame([("big", 0.5, 1, 0), ("small", 0.25, 2, 0), ("other_one", 0.2, 3, 0), ("absent", 0.05, 3, 0), (None, 0.1, 1, 0)], "source string, target_share double, max_repeats int, tokens int")
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, repeats int")
    chosen, shares = mix.mixture(d, targets, total=40_000, seed=3)
    got = {r["source"]: r for r in shares.collect()}
    for s, share, cap in (("big", 0.5, 1), ("small", 0.25, 2), ("other_one", 0.2, 3)):
        reach = min(share * 40_000, got[s]["available_tokens"] * cap)
        assert abs(got[s]["mixed_tokens"] - reach) < 0.03 * reach + 60, s
    assert got["absent"]["mixed_tokens"] == 0 and got["untargeted"]["mixed_tokens"] == 0
    used = {}
    for r in chosen.collect():
        used[r["doc_id"]] = used.get(r["doc_id"], 0) + r["repeats"]
        assert 1 <= r["repeats"] <= {"big": 1, "small": 2, "other_one": 3}[r["source"]]
    assert rows(chosen) == rows(mix.mixture(d, targets, total=40_000, seed=3)[0])
    assert abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9


def test_mixture_void(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    d = spark.createDataFrame([], "doc_id bigint, text string, source string")
    chosen, shares = mix.mixture(d, targets)
    assert chosen.count() == 0 and shares.count() == 1
    assert mix.mixture(spark.createDataFrame([(1, "x y", "a")], d.schema), targets.limit(0))[0].count() == 0


# -- residue --------------------------------------------------------------------------------------------


def test_residue(spark):
    prose = "The resin was held in glycerol and the plateau of the membrane saturates below the broad peak. " * 4
    docs = [prose + f"Dear ${{{n}}}, the yield {k} grows." for k, n in enumerate(("author", "title", "doi"))]
    docs += [prose + "See [[DOI]] for details.", prose + "See [[YEAR]] for details."]
    docs += [f"The script replaces the string {{{{title}}}} by the title before {w} is plotted. " + prose for w in ("flow", "heat", "mass", "wear")]
    docs += ["Text to follow.", "Lorem ipsum dolor sit amet labore culpa velit sunt officia labore.", "TBD TBD TBD TBD TBD"]
    docs += ["404 - the page is not found here. Please enable JavaScript in your browser.", "On things\nPlease enable JavaScript in your browser.\nHome | Help"]
    docs += ["The web viewer was written in JavaScript and shows the flow of each gel. " + prose, prose, "Peaks at 404 and 503 nm were found.", "", None, prose * 500]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)] + [(9, "Text to follow.", "x"), (None, "TBD TBD TBD TBD", "x")], "doc_id bigint, text string, reason string")
    got = rows(residue.residue(df))
    assert {i for i, why in got if why == "slot"} == {0, 1, 2, 3, 4}
    assert {i for i, why in got if why == "filler"} == {9, 10, 11}
    assert {i for i, why in got if why == "page"} == {12, 13}
    assert residue.residue(df.limit(0)).count() == 0


def test_slots_by_texts_and_filled_records(spark):
    """A page fetched three times keeps its slot, as does a template that other records fill; a quoted name stays text."""
    docs = ["A slow melt. See __doi__ for all details."] * 3
    docs += [f"Record {w}. Cite as ${{key}} in your work." for w in ("a b", "c d", "e f")] + [f"Record {w}. Cite as {w} in your work." for w in ("Omo 2009", "10.1/x.5", "Bumo")]
    docs += [f"In {w} the name {{{{title}}}} stands for the title." for w in ("one", "two", "three")] + ["The name was kept. One stands for the other."]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    assert rows(residue.residue(df)) == {(i, "slot") for i in range(6)}


@pytest.mark.parametrize("left", [("ORDER_NO", "CITY"), ("", ""), ("*|ORDERNO|*", ":city:"), ("orderNo", "city_name")])
def test_slots_by_alignment(spark, left):
    """Names in no template language's notation, and blanks, are found where filled records differ; the same shapes in other text stay."""
    fill = lambda no, city: f"Dear reader, we thank you for it. Your order {no}, placed on paper, was sent to {city}, as agreed upon. It will come soon to you."
    docs = [fill(f"A{k}7", w) for k, w in enumerate("Bern Paris Rome Oslo Kiel Graz Brno Pisa".split())] + [fill(*left) + f" Note {k}." for k in range(3)]
    docs += ["The value MAX_LEN was set by the user. The mRNA of the cell , as shown, grows.", "The DNA and the mRNA of pH 7 differ, () and [] aside."]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    assert rows(residue.residue(df)) == {(i, "slot") for i in (8, 9, 10)}


def test_pages_under_long_navigation(spark):
    nav = "\n".join(f"Menu item {k}" for k in range(400))
    message = "404 - the page is not found here. Please enable JavaScript in your browser."
    docs = [nav + "\n" + message, "On foams\n" + nav + "\n" + message + "\n" + nav, message + " But this text has a lot of other things to say about foams and gels. " * 6]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    assert rows(residue.residue(df)) == {(0, "page"), (1, "page")}


@pytest.mark.parametrize("text", ["Text to\u00a0follow.", "Content coming\u00a0soon", "Lorem&nbsp;ipsum", "Text to  follow.", "See &#123;&#123;title&#125;&#125; here"])
def test_residue_in_odd_spaces(spark, text):
    assert residue.residue(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).count() == 1


def test_sources_with_any_name(spark):
    targets = spark.createDataFrame([("a|b", 0.5, 1), ('c"[', 0.5, 1)], "source string, target_share double, max_repeats int")
    d = spark.createDataFrame([(1, "x y z", "a|b"), (2, "u v w", 'c"['), (3, "x y z", 'c"[')], "doc_id bigint, text string, source string")
    assert sorted(r["source"] for r in mix.mixture(d, targets)[0].collect()) == ["a|b", 'c"[']


def test_forms_of_quotes_and_titles(spark, sf):
    """Every quote and every title gets its form."""
    got = queries.p3_forms(spark, sf).groupBy("field_name").count().collect()
    want = {"quote": spark.read.parquet(f"{sf}/findings.parquet").where("quote is not null and record_id is not null").count(), "title": spark.read.parquet(f"{sf}/entries.parquet").where("title is not null and entry_id is not null").count()}
    assert {r["field_name"]: r["count"] for r in got} == want


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).limit(5).collect() is not None
