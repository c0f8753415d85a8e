"""The operators on records: results, edge cases, and agreement with plainer ways on small fixtures."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholion.llm import history, linkage, names
from scholion.session import checkpoint, table

ENTRY = "entry_id bigint, batch_no int, title string, surname string, authors array<struct<first_name:string,last_name:string,name:string>>, year string, journal string, volume string, firstpage string, doi string, id string, old string, core string"


def entries(spark, rows):
    return spark.createDataFrame([(i, b, t, s, None, y, j, v, p, d, "x", "y", "z") for i, b, t, s, y, j, v, p, d in rows], ENTRY)


A = "How vaxraol controls folding in a salt-free lipid bilayer with dorvoene"


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_duplicates(spark):
    rows = [
        (1, 0, A, "Čámo", "2009", "Annals of Membrane Transport", "57", "2394", "10.90137/aomt-1234567"),
        (2, 0, A.upper(), "Camo", "2009", "AMT", "57", "2394", None),
        (3, 1, "vaxraol controls folding in a <i>salt</i>-free lipid bil…", "Čámo", "2010", None, "57", "2394", "https://doi.org/10.90137/AOMT-1234567"),
        (4, 1, "Erratum: " + A, "Čámo", "2009", "AMT", "57", "2500", None),
        (5, 1, A + ". Part II", "Čámo", "2010", "AMT", "58", "11", None),
        (6, 2, "Editorial", "Omo", "2009", "AMT", "57", "1", None),
        (7, 2, "Editorial", "Bumo", "2009", "BS", "12", "7", None),
        (8, 2, "On other things altogether in a foam", "Xumo", "2009", "AMT", "57", "99", "10.90137/aomt-1234567"),
        (9, 3, None, None, None, None, None, None, None),
        (10, 3, "", "", "", "", "", "", ""),
        (11, 3, None, None, None, None, None, None, None),
        (2, 0, A.upper(), "Camo", "2009", "AMT", "57", "2394", None),
    ]
    assert pairs(history.duplicates(entries(spark, rows))) == {(1, 2), (1, 3)}


def test_duplicates_void(spark):
    assert history.duplicates(entries(spark, [])).count() == 0
    assert history.duplicates(entries(spark, [(1, None, "é" * 20000, "x", "n. d.", None, None, None, "none")])).count() == 0


def test_duplicates_many_copies(spark):
    rows = [(i, i % 3, A, "Čámo", "2009", "J", "57", "2394", None) for i in range(300)]
    got = pairs(history.duplicates(entries(spark, rows)))
    assert len(got) == 299 and {a for a, _ in got} == {0}


def test_duplicates_without_a_common_place(spark):
    """Equal titles meet though given names, particles or missing fields leave no place in print or start of the name in common."""
    rows = [(1, 0, A, "Chokoberg", "2009", None, "57", "2394", None), (2, 1, A, "Katherine Chokoberg", "2009", None, "57", None, None), (3, 1, A + " und foam", "Omosen", "2001", None, None, None, None), (4, 2, A + " und foam", "C. Omosen", None, None, None, None, None), (5, 2, A + " und gel", "Yauvauyan", "2001", None, None, None, None), (6, 3, A + " und gel", "Xauvauyan", None, None, None, None, None)]
    assert pairs(history.duplicates(entries(spark, rows))) == {(1, 2), (3, 4), (5, 6)}


def test_batches_as_whole(spark, sf):
    """Batch after batch against the stored index gives the works that one pass over everything gives."""
    e = table(spark, sf, "entries")
    links = pairs(history.at_once(e))
    place = {r["entry_id"]: (r["batch_no"], r["entry_id"]) for r in e.collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        ra, rb = sorted((find(a), find(b)), key=place.get)
        up[rb] = ra
    assert pairs(history.duplicates(e)) == {(find(x), x) for x in up if find(x) != x}


def test_small_batches_share_a_pass(spark, monkeypatch):
    """Batches that aren't more than what came before are checked in one pass, each record against earlier ones only."""
    assert history.together([(0, 60), (1, 5), (2, 55), (3, 60), (5, 60)]) == [(0, 0), (1, 2), (3, 5)]
    assert history.together([]) == [] and history.together([(4, 1), (7, 9)]) == [(4, 4), (7, 7)]
    rows = [(i, 0, f"{A} in sample {i}", "Omo", "2009", "J", str(i), "9", None) for i in range(8)]
    rows += [(20, 3, A + " in sample 4", "Omo", "2009", "J", "4", None, None), (21, 2, A + " in sample 4.", "Omo", "2009", "J", "4", "9", None), (22, 1, "Wettability of granular beds in shear", "Bumo", "2001", None, "6", None, None), (19, 4, "Wettability of granular beds in shears", "Bumo", "2001", None, "6", None, None)]
    passes, check = [], history.check_batch
    monkeypatch.setattr(history, "check_batch", lambda h, b: passes.append(1) or check(h, b))
    assert pairs(history.duplicates(entries(spark, rows))) == {(4, 20), (4, 21), (22, 19)}
    assert len(passes) == 2


def test_kept_tables_leave_no_shuffle_files(spark):
    """What a kept table was made from goes from disk when it is written, not when the driver collects its garbage."""
    def files():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_")}

    before = files()
    kept = checkpoint(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_short_and_shifted_titles(spark):
    """Titles below the head's length meet with a letter more or less, and two letters that were put in before a segment move it by two."""
    rows = [(1, 0, "Protein folds of yeast", "Omo", "2000", None, "5", None, None), (2, 1, "Protein folds of yeastt", "Omo", "2000", None, "5", None, None), (3, 1, "Prottein folds of yeasts", "Omo", "2000", None, "5", None, None), (4, 0, "Wettability of granular beds in shear", "Bumo", "2001", None, "6", None, None), (5, 2, "Wexttxability of granular beds in shear", "Bumo", "2001", None, "6", None, None)]
    d = history.describe(entries(spark, rows))
    met = {tuple(r) for r in history.probe(history.index_rows(d), d).collect()}
    assert {(1, 2), (1, 3), (4, 5)} <= met
    assert (1, 2) in pairs(history.duplicates(entries(spark, rows)))


def test_segments_meet_all_near_heads(spark):
    """Every pair of heads within the allowed edits shares a key, whatever the edits."""
    rnd = random.Random(5)
    base = "hydrodynamicradiusandcollapse" + "inquenchedblends"
    rows = [(0, 0, base, "Omo", "2000", None, "5", "9", None)]
    for i in range(1, 150):
        t = list(base)
        for _ in range(rnd.randint(1, history.TITLE_EDITS)):
            k = rnd.randrange(2, 20)
            how = rnd.choice("sid")
            if how == "s":
                t[k] = rnd.choice("abcdefgh")
            elif how == "i":
                t.insert(k, rnd.choice("abcdefgh"))
            else:
                del t[k]
        rows.append((i, 1, "".join(t), "Omo", "2000", None, "5", "9", None))
    d = history.describe(entries(spark, rows))
    met = {r["new"] for r in history.probe(history.index_rows(d.where("id = 0")), d).collect()}
    assert met == set(range(1, 150))


def test_segments_meet_all_near_dois(spark):
    """Every pair of DOIs one edit apart shares a key, wherever the edit is."""
    base = "10.90137/aomt-932553646"
    forms = [base[:k] + "7" + base[k:] for k in range(9, len(base) + 1)] + [base[:k] + base[k + 1 :] for k in range(9, len(base))] + [base[:k] + "z" + base[k + 1 :] for k in range(9, len(base))]
    d = history.describe(entries(spark, [(0, 0, "zero words", None, None, None, None, "9", base)] + [(i + 1, 1, f"title{i}", None, None, None, None, "9", f) for i, f in enumerate(forms)]))
    assert {r["new"] for r in history.probe(history.index_rows(d.where("id = 0")), d).collect()} == set(range(1, len(forms) + 1))


def test_keys_meet_all_that_verify_accepts(spark):
    """Records that lack their page meet by titles and DOIs wherever edits lie, and whatever else they lack."""
    doi = "10.90137/aomt-932553646"
    edited = lambda *at: "".join("x" if i in at else c for i, c in enumerate(A.replace(",", "")))
    rows = [
        (1, 0, A, "Chokoberg", "2009", None, "57", "2394", doi),
        (2, 1, A, "Chokoberg", "2010", None, "57", None, "10.90131/aomt-932558646"),
        (3, 1, edited(5, 7, 9), "Chokoberg", "2008", None, "57", None, None),
        (4, 2, edited(5, 25, 62), "Chokoberg", None, None, None, None, None),
        (5, 2, A, "Li", None, None, None, None, None),
        (6, 0, "Folding of " + A, "Li", "2001", None, None, None, None),
        (7, 1, "Folding of " + A, "Li", None, None, None, None, None),
        (8, 1, "Towards " + A, None, "2009", None, "57", "2394", None),
    ]
    every = checkpoint(history.describe(entries(spark, rows)))
    old, new = every.select(F.col("id").alias("old")), every.select(F.col("id").alias("new"))
    want = pairs(history.verify(old.crossJoin(new).where("old < new"), every, every))
    assert {(1, 2), (1, 3), (1, 4), (6, 7), (1, 8)} <= want
    assert want <= pairs(history.at_once(entries(spark, rows)))


def test_keys_of_near_dois_without_pages(spark):
    """Any two edits leave DOIs a key in common, also where nothing else is known."""
    base, rnd = "10.90137/aomt-932553646", random.Random(3)
    forms = set()
    while len(forms) < 120:
        t = list(base)
        for _ in range(2):
            k, how = rnd.randrange(8, len(t)), rnd.choice("sid")
            t[k : k + (how != "i")] = [] if how == "d" else [rnd.choice("0123456789")]
        forms.add("".join(t))
    rows = [(0, 0, A, None, None, None, None, None, base)] + [(i + 1, 1, A, None, None, None, None, None, f) for i, f in enumerate(sorted(forms))]
    got = history.describe(entries(spark, rows))
    met = {r["new"] for r in history.probe(history.index_rows(got.where("id = 0")), got).collect()}
    assert met == {r["id"] for r in got.where("id > 0 and levenshtein(doi, '" + base + "') <= 2").collect()}


def test_slips_of_the_nearer_name(spark):
    """A slip stands for the name it is one letter from, though a commoner one is two away."""
    tokens = spark.createDataFrame([("pedraky", 12), ("knedraky", 30), ("pledraky", 1), ("pedarky", 1)], "token string, uses bigint")
    got = {r["token"]: r["stands_for"] for r in names.slips(tokens, ratio=0.75).collect()}
    assert got["pledraky"] == "pedraky" and got["pedarky"] == "pedraky"


def test_names(spark):
    given = ["Dvéskaustonova", "Dvéskaustonova, Charlotte", "C. DVESKAUSTONOVA", "Charlotte Dveskaustonova", "Lottie Dvéskaustonova", "Dvéskaustonova, Wenjing", "Dveskaustonvoa, C.", "Omosen, Charlotte", "Omosen", "W. B. Omosen", "W. A. Omosen", "van der Drullábek, D.", "Dmitri van der Drullabek", "Yédránnec Laboratory of Interfacial Science", "YEDLIS (Yédránnec)", "YEDLIS", "Yédránnec Lab. of Interfacial Science", None, "", "  ", "12", "Omosen"]
    got = pairs(names.same_names(spark.createDataFrame([(n, 1) for n in given], "name string, uses int")))
    linked = lambda a, b: (min(a, b), max(a, b)) in got
    assert linked("Dvéskaustonova", "Dvéskaustonova, Charlotte") and linked("Dvéskaustonova", "Dvéskaustonova, Wenjing")
    assert linked("C. DVESKAUSTONOVA", "Charlotte Dveskaustonova") and linked("Lottie Dvéskaustonova", "Charlotte Dveskaustonova") and linked("Dveskaustonvoa, C.", "Dvéskaustonova, Charlotte")
    assert not linked("Dvéskaustonova, Charlotte", "Dvéskaustonova, Wenjing") and not linked("Omosen, Charlotte", "Dvéskaustonova, Charlotte")
    assert not linked("W. B. Omosen", "W. A. Omosen") and linked("Omosen", "W. A. Omosen")
    assert linked("van der Drullábek, D.", "Dmitri van der Drullabek")
    assert linked("YEDLIS", "YEDLIS (Yédránnec)") and linked("YEDLIS", "Yédránnec Laboratory of Interfacial Science") and linked("Yédránnec Lab. of Interfacial Science", "Yédránnec Laboratory of Interfacial Science")
    assert all(a < b for a, b in got)


def test_names_void(spark):
    assert names.same_names(spark.createDataFrame([], "name string")).count() == 0


@pytest.mark.parametrize(("a", "b"), [("abcd", "abxd"), ("", "a"), ("same", "same"), ("kitten", "sitting")])
def test_subsequence(a, b):
    def lcs(x, y):
        return 0 if not x or not y else 1 + lcs(x[:-1], y[:-1]) if x[-1] == y[-1] else max(lcs(x[:-1], y), lcs(x, y[:-1]))

    assert names.lcs_ratio(a, b) == (2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0)


def test_slips_against_all_pairs(spark):
    """Suffix blocking, refined for crowded suffixes, meets every single slip that comparing all pairs finds."""
    rnd = random.Random(3)
    hubs = ["".join(rnd.choice("bdgklmnrstv") + rnd.choice("aeiou") for _ in range(4)) + "berg" for _ in range(40)]
    rows, want = [(h, 9) for h in hubs], {}
    for h in hubs:
        k = rnd.randrange(1, len(h) - 1)
        s = rnd.choice([h[:k] + h[k + 1 :], h[:k] + "z" + h[k:], h[:k] + h[k + 1] + h[k] + h[k + 2 :]])
        if s not in want and s not in hubs:
            want[s] = h
            rows.append((s, 1))
    got = {r["token"]: r["stands_for"] for r in names.slips(spark.createDataFrame(rows, "token string, uses bigint"), common=8).collect()}
    missed = [s for s in want if s not in got]
    assert len(missed) <= 0.02 * len(want)


def _refs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "ref_id bigint, doi string, title string, author string, year string, journal string, raw string, entry_id string")


def test_matching(spark):
    e = entries(spark, [(1, 0, A, "Čámo", "2009", "Annals of Membrane Transport", "57", "2394", "10.90137/aomt-1"), (2, 1, A, "Camo", "2009", "Annals of Membrane Transport", "57", "2394", None), (3, 0, "Effect of glydoide on the surface charge of a salt-free ionic liquid", "Dreteigu", "2020", "Journal of Interfacial Rheology", "70", "12", None), (4, 0, None, None, None, None, None, None, None)])
    r = _refs(spark, [
        (10, None, "How vaxraol controls foldign in a salt-free lipid bilayer with dorvoene", "Čámo C", "2009", "Ann. Membr. Transp.", "Čámo C: Ann. Membr. Transp. 57 (2009) 2394"),
        (11, None, None, "Camo", "2009", "Ann. Membr. Transp.", "Camo. 2009. Ann. Membr. Transp., vol. 57, pp. 2394ff."),
        (12, None, "How vaxraol controls folding in another thing with zorvoene", "Omosen", "1999", "JIR", "Omosen, JIR 3 77 1999"),
        (13, None, None, None, None, None, None), (14, None, "", "", "", "", ""), (15, "10.1234/x", A, "Čámo", "2009", None, None), (10, None, "How vaxraol controls foldign in a salt-free lipid bilayer with dorvoene", "Čámo C", "2009", "Ann. Membr. Transp.", "Čámo C: Ann. Membr. Transp. 57 (2009) 2394"),
        (16, None, None, None, None, None, "57 2394 - - 3 1"), (17, None, "x" * 30000, None, None, None, "y " * 20000),
    ])
    got = {r["ref_id"]: (r["entry_id"], r["confidence"]) for r in linkage.match(e, r).collect()}
    assert {k: v[0] for k, v in got.items()} == {10: 1, 11: 1}
    assert all(0.5 <= c <= 1 for _, c in got.values())


def test_bands_survive_one_typo(spark):
    """Lines with one telling word left meet their entry by the surname's tail, by a year off by one, or by an end of the title."""
    title = "Hydrodynamic radius and collapse of vaxraol"
    e = linkage.read_entries(entries(spark, [(1, 0, title, "Dreteigu", "2009", "Annals of Foam", None, None, None), (2, 0, "On the whole and the rest", "Omo", "1990", None, None, None, None)]))
    broken = "Hydrodynamik radius and kollapse of waxraol"
    refs = _refs(spark, [
        (1, None, "Hydrodynamik radius und collapse of vaxraol", "Xreteigu", None, None, None),
        (2, None, broken, None, "2010", "Ann Foam", None), (3, None, "Hydrodynamik radius and collapse of vaxraol", None, "2008", None, None),
        (4, None, "On the whole and the rest", None, None, None, None), (5, None, broken, None, "2012", "Ann Foam", None),
    ])
    r = checkpoint(linkage.read_refs(refs))
    named = {r["line"]: r["ref_id"] for r in linkage.content(refs).join(r, "same").collect()}
    got = {(x["entry"], named[x["line"]]) for x in linkage.candidates(e, r, ["the", "whole", "and", "rest"]).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 4)}


def test_hopeless_pairs_are_left_out(spark):
    """Only pairs that can't reach the least probability whatever their dearer measures say miss in the features."""
    e = linkage.read_entries(entries(spark, [(1, 0, A, "Čámo", "2009", "Annals of Membrane Transport", "57", "2394", None), (2, 0, "Effect of glydoide on the surface charge of a salt-free ionic liquid", "Dreteigu", "2020", "Journal of Interfacial Rheology", "70", "12", None), (3, 0, None, "Omo", None, None, "3", "4", None), (4, 0, "Erratum: " + A, "Camo", "2010", None, "58", "1", None)]))
    r = checkpoint(linkage.read_refs(_refs(spark, [
        (10, None, "How vaxraol controls foldign in a salt-free lipid bilayer", "Čámo C", "2009", "Ann. Membr. Transp.", "Čámo C: Ann. Membr. Transp. 57 (2009) 2394"),
        (11, None, None, "Camo", "2009", None, "Camo. 2009. Ann. Membr. Transp., vol. 57, pp. 2394ff."), (12, None, "Efect of glydoide on the surface charge of a salt-free ionic liquid", "Dreteigo", None, "JIR", None),
        (13, None, "Quite another thing under another year", "Xumo", "1955", "JQX", "Xumo, JQX 1 (1955) 7"), (14, None, None, None, None, None, None), (15, None, "Ännals of \U0001d400 \n tea", "Li, Wu", "n. d.", "", "12 70 2020"),
    ])))
    every = e.select("entry").crossJoin(r.select("line"))
    for weights, constant in ((linkage.PRIOR, -5.0), ({f: -w for f, w in linkage.PRIOR.items()}, 2.0), (dict.fromkeys(linkage.FEATURES, 1.0), -7.5)):
        logit = sum((F.col(f) * w for f, w in weights.items()), F.lit(constant))
        reach = lambda df: {tuple(x) for x in df.where(logit >= 0).select("entry", "line", *linkage.FEATURES).collect()}  # noqa: B023, E731
        whole, pruned = linkage.features(every, e, r), linkage.features(every, e, r, model=(weights, constant, 0.5))
        assert reach(pruned) == reach(whole)
        assert pruned.count() < whole.count() == 24


def test_matching_plans_stay_small(spark):
    """No query that runs on the way repeats what could be kept: the driver holds a plan's text again and again while it runs."""
    e = entries(spark, [(1, 0, A, "Čámo", "2009", "Annals of Membrane Transport", "57", "2394", None), (2, 1, A, "Camo", "2009", "Annals of Membrane Transport", "57", "2394", None)])
    r = _refs(spark, [(10, None, A, "Čámo C", "2009", "Ann. Membr. Transp.", "Čámo C: Ann. Membr. Transp. 57 (2009) 2394")])
    kept = spark._jsparkSession.sharedState().statusStore()
    done = kept.executionsCount()
    assert [tuple(x)[:2] for x in linkage.match(e, r).collect()] == [(10, 1)]
    ran = kept.executionsList(done, 1000)
    sizes = [len(ran.apply(i).physicalPlanDescription()) for i in range(ran.size())]
    assert len(sizes) > 8 and max(sizes) < 150_000


def test_training_pairs_are_chosen_before_they_are_measured(spark):
    """The pairs of smallest rank of either label, and only these, are measured; the model is the one that all pairs give."""
    e = linkage.read_entries(entries(spark, [(i, 0, f"{A} {i}", "Čámo", "2009", "Annals of Foam", "5", str(i), f"10.90137/{i}{i * 7919}") for i in range(1, 31)]))
    r = checkpoint(linkage.read_refs(_refs(spark, [(i, f"10.90137/{i}{i * 7919}", f"{A} {i}", "Čámo C", "2009", "Ann. Foam", f"Čámo, Ann. Foam 5 (2009) {i}") for i in range(1, 31)] + [(99, None, A, "Čámo", "2009", None, None)])))
    every = checkpoint(e.select("entry").crossJoin(r.select("line")))
    got = linkage.chosen(every, e, r, sample=20)
    assert got.count() == 40
    whole, few = linkage.features(every, e, r, labels=True), linkage.features(got, e, r, labels=True)
    assert linkage.model(few, 20, 5) == linkage.model(whole, 20, 5) != [*linkage.PRIOR.values(), -5.0]


def test_sketches_are_made_once_a_record(spark):
    """Below the listing of bands, not above it."""
    e = checkpoint(linkage.read_entries(entries(spark, [(1, 0, A, "Čámo", "2009", "Annals of Foam", "5", "7", None)])))
    plan = linkage._bands(e, "e", "entry", [], firm=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftleft" not in plan.split("Generate explode")[0] and "shiftleft" in plan.split("Generate explode")[1]


def test_matching_void(spark):
    e, r = entries(spark, []), _refs(spark, [])
    assert linkage.match(e, r).count() == 0
    assert linkage.match(e, _refs(spark, [(1, None, A, None, None, None, None)])).count() == 0


def test_model_learns_and_calibrates():
    rnd = np.random.default_rng(0)
    x = rnd.random((4000, 3))
    p = 1 / (1 + np.exp(-(6 * x[:, 0] - 4 * x[:, 1] - 1)))
    y = (rnd.random(4000) < p).astype(float)
    w = linkage.fit(x[:2000], y[:2000])
    a, b = linkage.calibrate(np.hstack([x[2000:], np.ones((2000, 1))]) @ w, y[2000:])
    q = 1 / (1 + np.exp(-(a * (np.hstack([x, np.ones((4000, 1))]) @ w) + b)))
    assert np.abs(q - p).mean() < 0.05


def test_short_forms_stand_for_several_names(spark):
    given = ["Omosen, Theodore", "Omosen, Theodora", "Theo Omosen", "Fran Keller", "Keller, Frances", "Keller, Francis", "Bob Keller", "Robert Keller", "R. Keller"]
    got = pairs(names.same_names(spark.createDataFrame([(n,) for n in given], "name string")))
    linked = lambda a, b: (min(a, b), max(a, b)) in got
    assert linked("Omosen, Theodore", "Theo Omosen") and linked("Omosen, Theodora", "Theo Omosen") and not linked("Omosen, Theodora", "Omosen, Theodore")
    assert linked("Fran Keller", "Keller, Frances") and linked("Fran Keller", "Keller, Francis") and not linked("Keller, Frances", "Keller, Francis") and linked("Bob Keller", "Robert Keller") and linked("R. Keller", "Robert Keller")
