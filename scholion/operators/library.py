"""Relational operators over the library: keys, joins with verdicts, windows, text gates, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholion.functions.scalars import authored, outward
from scholion.session import checkpoint

# -- keys and ids -----------------------------------------------------------


def minted_keys(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """[W7, Q18] Keys for new documents (``id``, ``base``, ``created``) beside those in ``taken`` (``key``).

    The first of a base gets it bare if free, the next a, b, ... by (created,
    id); after z follow two letters, then three and so on. A minted key that is taken, or that another base mints too,
    moves on past everything the base holds. Ids keep the key they once had.
    """
    # What a base can't mint: taken keys and other bases that read as it with a suffix.
    bases = docs.select("base").distinct()
    # A key's bases: what is left of it with any number of its last small letters gone.
    stripped = F.transform(F.sequence(F.lit(0), F.length(F.regexp_extract("key", "([a-z]*)$", 1))), lambda n: F.substring("key", F.lit(1), F.length("key") - n))
    barred = taken.select("key").unionByName(bases.select(F.col("base").alias("key"))).distinct()
    used = barred.select("key", F.explode(stripped).alias("base")).join(bases, "base", "left_semi")
    w = Window.partitionBy("base").orderBy("created", "id")
    ranked = docs.withColumn("n", F.row_number().over(w) - 1)
    # Free suffixes of a base: as many candidates as it needs and holds, less the taken ones, in order.
    need = ranked.groupBy("base").agg(F.max("n").alias("most")).join(used.groupBy("base").agg(F.count(F.lit(1)).alias("held")), "base", "left").na.fill(0, ["held"])
    slots = need.select("base", F.explode(F.sequence(F.lit(0), F.col("most") + F.col("held"))).alias("k")).withColumn("key", F.concat("base", suffix(F.col("k"))))
    free = slots.join(taken.select("key").distinct(), "key", "left_anti").join(bases.select(F.col("base").alias("key"), F.col("base").alias("own")), "key", "left").where(F.col("own").isNull() | (F.col("own") == F.col("base"))).select("base", "k", "key")
    order = Window.partitionBy("base").orderBy("k")
    placed = free.withColumn("n", F.row_number().over(order) - 1).select("base", "n", "key")
    return ranked.join(placed, ["base", "n"]).select("id", "key")


def suffix(k: Column) -> Column:
    """'' for 0, then a to z, then aa, ab, ..., with as many letters as it takes."""
    one = lambda acc: F.when(acc["rest"] > 0, F.struct(F.floor((acc["rest"] - 1) / 26).alias("rest"), F.concat(F.chr((acc["rest"] - 1) % 26 + 97), acc["text"]).alias("text"))).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.struct(k.cast("bigint").alias("rest"), F.lit("").alias("text")), lambda acc, _: one(acc), lambda acc: acc["text"])


def stems(files: DataFrame) -> DataFrame:
    """[W8] File stems ``key``, ``key-2``, ... by position: (``att_key``, ``stem``)."""
    w = Window.partitionBy("citekey").orderBy("ord", "att_key")
    n = F.row_number().over(w)
    return files.select("att_key", F.when(n == 1, F.col("citekey")).otherwise(F.concat_ws("-", "citekey", n)).alias("stem"))


def seats(files: DataFrame) -> DataFrame:
    """[W9, W10, J26] Files in their recorded seats, the others in the free ones by id; two on a seat are an anomaly.

    ``files``: (``doc``, ``id``, ``seat`` or null). Returns (``doc``, ``id``, ``place``, ``anomaly``).
    """
    total = files.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    pinned = files.where("seat is not null").withColumn("anomaly", F.count(F.lit(1)).over(Window.partitionBy("doc", "seat")) > 1)
    free = total.select("doc", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("place")).join(pinned.select("doc", F.col("seat").alias("place")), ["doc", "place"], "left_anti")
    free = free.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("place")))
    loose = files.where("seat is null").withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("id")))
    return pinned.select("doc", "id", F.col("seat").alias("place"), "anomaly").unionByName(loose.join(free, ["doc", "k"], "left").select("doc", "id", "place", F.lit(False).alias("anomaly")))


# -- joins with verdicts ----------------------------------------------------


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """[J10, J23, Q17] (``key``, ``verdict``): new, gone, changed or same, over all fields; null equals null."""
    a = old.select(F.col(key), F.struct(*fields).alias("a"))
    b = new.select(F.col(key), F.struct(*fields).alias("b"))
    x = a.join(b, key, "full")
    return x.select(key, F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed").alias("verdict"))


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """[J10, Q20] One row per field that differs: (``key``, ``field``, ``before``, ``after``)."""
    unpivoted = lambda d, v: d.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(v)) for f in fields])).alias("x")).select(key, "x.*")
    return unpivoted(old, "before").join(unpivoted(new, "after"), [key, "field"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


def own_key(c: Column, *row: str) -> Column:
    """A join key under which rows without one are spread: a hash of the row, behind a mark that no key has, so that they meet nothing and crowd no task."""
    return F.coalesce(F.nullif(c, F.lit("")), F.concat(F.lit("\0"), F.xxhash64(*row).cast("string")))


def held(references: DataFrame, library: DataFrame) -> DataFrame:
    """[J6] References with whether the library holds them, by DOI or by title; empty never matches."""
    by_doi = library.where("doi <> ''").select(F.col("doi").alias("_d")).distinct().withColumn("has_doi", F.lit(True))
    by_title = library.where("title_key <> ''").select(F.col("title_key").alias("_t")).distinct().withColumn("has_title", F.lit(True))
    r = references.withColumn("_d", own_key(F.col("doi"), *references.columns)).withColumn("_t", own_key(F.col("title_key"), *references.columns))
    return r.join(by_doi, "_d", "left").join(by_title, "_t", "left").withColumn("held", F.coalesce("has_doi", "has_title", F.lit(False))).drop("has_doi", "has_title", "_d", "_t")


def joined_by_doi(references: DataFrame, last: DataFrame) -> DataFrame:
    """[J3] (``ref_id``, ``match``): every reference with the entry of its DOI, or null; ``last`` as of :func:`last_by_doi`."""
    r = references.withColumn("_d", own_key(F.col("doi"), "ref_id"))
    return r.join(last.select(F.col("doi").alias("_d"), F.col("key").alias("match")), "_d", "left").select("ref_id", "match")


def last_by_doi(library: DataFrame) -> DataFrame:
    """[J3] One entry per DOI: the last one in order of arrival."""
    return library.where("doi is not null").groupBy("doi").agg(F.max_by("key", F.struct("ord", "key")).alias("key"))


def gaps(references: DataFrame, limit: int | None = None) -> DataFrame:
    """[A3, O1, Q10] What the library lacks, by demand: (``doi``, ``papers``, ``lines``), most papers first; at most ``limit`` of them if given."""
    out = references.where("not held and doi is not null").groupBy("doi").agg(F.count_distinct("src_key").alias("papers"), F.count(F.lit(1)).alias("lines")).orderBy(F.desc("papers"), F.desc("lines"), "doi")
    return out.limit(limit) if limit is not None else out


def gap_details(references: DataFrame) -> DataFrame:
    """[A3, U1] Gaps with the papers that name them and what the first line says: (``doi``, ``lines``, ``papers``, ``title``, ``year``), first by paper and place."""
    first = F.struct("src_key", "ord", "ref_id")
    return references.where("not held and doi is not null").groupBy("doi").agg(F.count(F.lit(1)).alias("lines"), F.array_sort(F.collect_set("src_key")).alias("papers"), F.min_by("title", first).alias("title"), F.min_by("year", first).alias("year"))


def unique_best(candidates: DataFrame, by: str, score: str) -> DataFrame:
    """[W13, J5] The best candidate where no other has its score; ties are refused with a verdict."""
    top = candidates.groupBy(by).agg(F.max(score).alias("top"))
    at_top = candidates.join(top, by).where(F.col(score) == F.col("top")).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("candidate").alias("candidate"))
    return at_top.select(by, F.when(F.col("n") == 1, F.col("candidate")).alias("match"), F.when(F.col("n") == 1, "matched").otherwise("tie").alias("verdict"))


def siblings(docs: DataFrame) -> DataFrame:
    """[J15, Q23] Per document how many others share its title, and whether it may be deleted: not the last copy."""
    n = docs.where("title_key <> ''").groupBy("title_key").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(n, "title_key", "left").select("id", (F.coalesce("n", F.lit(1)) - 1).alias("siblings"), F.when(F.coalesce("n", F.lit(1)) > 1, "survivor exists").otherwise("last copy").alias("verdict"))


def current_findings(log: DataFrame) -> DataFrame:
    """[J22, A21, T3] Findings with the state their later events give them.

    The event log folds in one shuffle: the events about a finding are those
    with its ordinal as ``ref_ordinal``.
    """
    events = log.where("kind in ('CHECKED', 'RETRACTED')").groupBy("citekey", F.col("ref_ordinal").alias("ordinal")).agg(F.count_if(F.col("kind") == "CHECKED").alias("checks"), F.count_if(F.col("kind") == "RETRACTED").alias("retractions"))
    return log.where("kind = 'FINDING'").join(events, ["citekey", "ordinal"], "left").na.fill(0, ["checks", "retractions"]).withColumn("state", F.when(F.col("retractions") > 0, "retracted").when(F.col("checks") > 0, "checked").otherwise("live"))


def staleness(extracts: DataFrame, recorded: DataFrame) -> DataFrame:
    """[J18, Q14] Recorded files against extracts (``key``, ``sha``): gone, stale or ok; extracts without record: unread."""
    x = extracts.select("key", "sha").join(recorded.select("key", F.col("sha").alias("was")), "key", "full")
    return x.select("key", F.when(F.col("sha").isNull(), "gone").when(F.col("was").isNull(), "unread").when(F.col("sha") != F.col("was"), "stale").otherwise("ok").alias("verdict"))


# Verdicts under which a citation file holds the list alone.
LIST_ONLY = ("not-applicable", "unverifiable", "no-signal", "parsed", "failed", "offset")


def stale_files(files: DataFrame, extracts: DataFrame, known: DataFrame) -> DataFrame:
    """[J18, Q14] Citation files (``key``, ``source``, ``verdict``, ``sha``, ``chars``) against extracts (``key``, ``text``) and the library's keys: (``key``, ``state``).

    ``gone`` where the library doesn't hold the key (an empty library is no
    evidence), ``orphan`` without an extract, ``ok`` where hash, or else length,
    agrees; a changed extract makes a list that came from elsewhere ``cosmetic``
    and all else ``stale``.
    """
    from scholion.functions.scalars import body_hash

    e = extracts.select("key", body_hash(F.col("text")).alias("now"), F.length("text").alias("long"), F.lit(True).alias("there"))
    held = known.select("key").distinct().withColumn("known", F.lit(True))
    x = files.where("key is not null").join(e, "key", "left").join(held, "key", "left").withColumn("library", F.lit(known.limit(1).count() > 0))
    same = F.when(F.col("sha").isNotNull(), F.col("sha") == F.col("now")).otherwise(F.coalesce(F.col("chars") == F.col("long"), F.lit(False)))
    apart = F.coalesce(F.col("verdict").isin(*LIST_ONLY), F.lit(False)) & ~F.coalesce(F.col("source") == "extract", F.lit(False))
    return x.select("key", F.when(F.col("library") & F.col("known").isNull(), "gone").when(F.col("there").isNull(), "orphan").when(same, "ok").when(apart, "cosmetic").otherwise("stale").alias("state"))


def doi_audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """[J8, Q11] Our record of a DOI against another source's: (``key``, ``verdict``), title before author, as ordered.

    Both have (``doi``, ``title_key``, ``surname``); ours has ``key`` as well.
    """
    x = ours.join(theirs.select("doi", F.col("title_key").alias("t"), F.col("surname").alias("s")), "doi", "left")
    a, b = F.lower("surname"), F.lower("s")
    return x.select(
        "key",
        F.when(F.col("doi").isNull(), "no doi").when(F.col("t").isNull(), "unknown doi").when(F.col("t") != F.col("title_key"), "other title").when(a.isNull() | b.isNull(), "skip").when(a == b, "agree").when(a.endswith(b) | b.endswith(a), "particle").otherwise("mismatch").alias("verdict"),
    )


# -- sequences ---------------------------------------------------------------


def climbing_runs(rows: DataFrame, part: str, order: list[str], value: str) -> DataFrame:
    """[W1] Longest run that climbs by exactly one, the earliest of equals: (part, ``start``, ``length``)."""
    w = Window.partitionBy(part).orderBy(*order)
    x = rows.withColumn("n", F.row_number().over(w)).withColumn("isle", F.col(value) - F.col("n"))
    # Equal differences that don't touch are apart: a break starts a new run.
    x = x.withColumn("brk", F.when(F.lag(value).over(w).isNull() | (F.col(value) != F.lag(value).over(w) + 1), 1).otherwise(0)).withColumn("run", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy(part, "run").agg(F.min(value).alias("start"), F.count(F.lit(1)).alias("length"), F.min("n").alias("n"))
    return runs.groupBy(part).agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("n"))).alias("b")).select(part, "b.*")


def dense_blocks(rows: DataFrame, part: str, value: str, gap: int) -> DataFrame:
    """[W3] Block of most values with no gap above ``gap``, the first of equals: (part, ``first``, ``last``, ``size``)."""
    w = Window.partitionBy(part).orderBy(value)
    x = rows.withColumn("brk", F.when(F.col(value) - F.lag(value).over(w) <= gap, 0).otherwise(1)).withColumn("block", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = x.groupBy(part, "block").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("size"))
    return b.groupBy(part).agg(F.max_by(F.struct("first", "last", "size"), F.struct("size", -F.col("first"))).alias("m")).select(part, "m.*")


def range_text(numbers: DataFrame, part: str, value: str) -> DataFrame:
    """[P25] Distinct numbers as ``1-3, 7``: (part, ``ranges``), at most eight groups and then dots."""
    w = Window.partitionBy(part).orderBy(value)
    x = numbers.select(part, value).distinct().withColumn("isle", F.col(value) - F.row_number().over(w))
    g = x.groupBy(part, "isle").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    out = g.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("g"))
    return out.select(part, F.concat(F.array_join(F.transform(F.slice("g", 1, 8), lambda x: x["t"]), ", "), F.when(F.size("g") > 8, ", ...").otherwise("")).alias("ranges"))


def failure_streaks(runs: DataFrame, part: str, order: list[str], failed: Column) -> DataFrame:
    """[W12, T1] Per run how many failures in a row end there, since when they last."""
    w = Window.partitionBy(part).orderBy(*order)
    x = runs.withColumn("failed", failed).withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(part, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("streak", F.count_if(F.col("failed")).over(inner)).withColumn("failing_since", F.when(F.col("failed"), F.min(F.when(F.col("failed"), F.col(order[0]))).over(inner)))


def next_starts(rows: DataFrame, part: str, pos: str, end: Column) -> DataFrame:
    """[W4, W5] Each start with where the next one cuts it; the last runs to ``end``."""
    return rows.withColumn("until", F.coalesce(F.lead(pos).over(Window.partitionBy(part).orderBy(pos)), end))


def offset_votes(pages: DataFrame, part: str, offset: str, page: str, share: float = 0.6, floor: int = 3) -> DataFrame:
    """[A12] Plurality offset of a document: one vote a page; too few or a tie refuse, with a verdict."""
    votes = pages.where(F.col(offset).isNotNull()).groupBy(part, offset).agg(F.count_distinct(page).alias("votes"))
    total = pages.groupBy(part).agg(F.count_distinct(page).alias("pages"))
    top = votes.groupBy(part).agg(F.max("votes").alias("top"))
    best = votes.join(top, part).where("votes = top").groupBy(part).agg(F.count(F.lit(1)).alias("ties"), F.min(offset).alias("best"), F.max("top").alias("top"))
    need = F.greatest(F.lit(floor), F.floor(F.col("pages") * share))
    return best.join(total, part).select(part, F.when((F.col("ties") == 1) & (F.col("top") >= need), F.col("best")).alias("offset"), "top", "pages", F.when(F.col("top") < need, "too few").when(F.col("ties") > 1, "tie").otherwise("derived").alias("verdict"))


def banded_cluster(rows: DataFrame, part: str, value: str, page: str, band: int) -> DataFrame:
    """[A14] Most distinct pages whose values fall in one band: (part, ``pages``)."""
    w = Window.partitionBy(part).orderBy(value).rangeBetween(0, band)
    return rows.withColumn("n", F.size(F.collect_set(page).over(w))).groupBy(part).agg(F.max("n").alias("pages"))


def quartile_at(rows: DataFrame, part: str, value: str) -> DataFrame:
    """[A22] The value at index n // 4 of the sorted values, by counting rows, not interpolating.

    Values are counted before they are put in order, so a part that most rows
    share takes no more than its distinct values.
    """
    counts = rows.groupBy(part, value).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(part).orderBy(value))).withColumn("all", F.sum("n").over(Window.partitionBy(part)))
    return upto.where(F.col("upto") > F.floor(F.col("all") / 4)).groupBy(part).agg(F.min(value).alias("q1"))


# -- text gates --------------------------------------------------------------


def folded_line(c: Column) -> Column:
    """A line as it is compared over pages: lower case, single spaces."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def boilerplate(lines: DataFrame, doc: str, page: str, line: str, share: float = 0.6, floor: int = 3) -> DataFrame:
    """[A15] Lines, compared without case and spacing, on at least ``max(floor, share of pages)`` pages of a document of three pages or more."""
    on = lines.select(doc, page, folded_line(F.col(line)).alias(line)).where(F.col(line) != "").groupBy(doc, line).agg(F.count_distinct(page).alias("pages"))
    n = lines.groupBy(doc).agg(F.count_distinct(page).alias("of"))
    return on.join(n, doc).where((F.col("of") >= 3) & (F.col("pages") >= F.greatest(F.lit(floor), F.floor(F.col("of") * share))))


def content_share(lines: DataFrame, doc: str, page: str, line: str, least: int = 80) -> DataFrame:
    """[A15, A16] Share of a document's pages with ``least`` characters that aren't boilerplate, and a verdict."""
    stamps = boilerplate(lines, doc, page, line).select(doc, F.col(line).alias("folded"))
    kept = lines.withColumn("folded", folded_line(F.col(line))).join(stamps, [doc, "folded"], "left_anti")
    sizes = kept.groupBy(doc, page).agg(F.sum(F.length(F.trim(line))).alias("chars"))
    every = lines.select(doc, page).distinct().join(sizes, [doc, page], "left").na.fill(0, ["chars"])
    out = every.groupBy(doc).agg(F.avg((F.col("chars") >= least).cast("double")).alias("text_share"), F.count(F.lit(1)).alias("pages"))
    return out.withColumn("verdict", F.when(F.col("text_share") < 0.5, "thin").otherwise("text"))


def list_gate(refs: DataFrame) -> DataFrame:
    """Verdict over a parsed list per paper, in the order of the checks; refs have ``src_key``, ``raw``, ``n`` (place) and ``label``.

    Up to three entries at the head that are labelled 0, or don't read as a
    reference that names its author and points outward, are trimmed while more
    than eight are left. ``named`` looks at the first 60 characters.
    """
    raw = F.coalesce("raw", F.lit(""))
    named, pointing = authored(F.left(raw, F.lit(60))), outward(raw)
    x = refs.select("src_key", F.struct("n", raw.alias("raw")).alias("at"), "label", F.length(raw).alias("size"), named.alias("named"), pointing.alias("pointing"), (F.coalesce(F.col("label") == "0", F.lit(False)) | ~(named & pointing)).alias("junk"))
    # The first three of each list; the limit is applied before the shuffle too.
    first = x.select("src_key", "at", "junk", F.row_number().over(Window.partitionBy("src_key").orderBy("at")).alias("k")).where("k <= 3")
    total = x.groupBy("src_key").agg(F.count(F.lit(1)).alias("total")).join(first.groupBy("src_key").agg(F.array_sort(F.collect_list(F.struct("k", "at", "junk"))).alias("head")), "src_key")
    run = lambda k: F.forall(F.slice("head", 1, k), lambda h: h["junk"]) & (F.col("total") > 8 + k - 1)
    heads = total.select("src_key", "head", F.when(run(3), 3).when(run(2), 2).when(run(1), 1).otherwise(0).alias("trimmed"))
    heads = heads.select("src_key", "trimmed", F.try_element_at("head", F.nullif("trimmed", F.lit(0)))["at"].alias("last"))
    kept = x.join(heads, "src_key").where(F.col("last").isNull() | (F.col("at") > F.col("last")))
    label = F.expr("try_cast(regexp_extract(label, '^([0-9]+)$', 1) as int)")
    g = kept.groupBy("src_key").agg(F.count(F.lit(1)).alias("n"), F.max("trimmed").alias("trimmed"), F.avg(F.col("named").cast("double")).alias("named"), F.avg(F.col("pointing").cast("double")).alias("outward"), F.coalesce(F.max(label), F.lit(0)).alias("top"))
    g = g.join(quartile_at(kept.select("src_key", "size"), "src_key", "size"), "src_key")
    return g.withColumn("verdict", F.when(F.col("named") < 0.55, "unnamed").when(F.col("outward") < 0.65, "inward").when(F.col("q1") > 450, "paragraphs").when(F.col("top") > 8 * F.col("n"), "labels").otherwise("sound"))


def skip_unchanged(files: DataFrame, state: DataFrame, rules: int, done: tuple[str, ...] = ("ok", "thin")) -> DataFrame:
    """[F13, Q19, A17] Files against the recorded state: skip, changed, moved, failed before, old rules or new."""
    x = files.join(state, "qid", "left")
    return x.select("qid", F.when(F.col("status").isNull(), "new").when(~F.col("status").isin(*done), "retry").when(~F.col("filehash").eqNullSafe(F.col("was_hash")), "changed").when(~F.col("stem").eqNullSafe(F.col("was_stem")), "moved").when(F.col("rules") < rules, "old rules").otherwise("skip").alias("plan"))


# -- mining, marks, verdict pipelines -------------------------------------------


# How a text announces a structure's accession, the shape of one, what looks like one and isn't, and software whose name ends like one.
_ACC = r"[1-9][A-Za-z0-9]{3}"
_CUE = (
    r"(?:Protein\s+Data\s+Bank\s*(?:\(PDB\))?\s*(?:under\s+)?(?:accession|reference|entry|entries|ID|IDs|code|codes|with)?[\s:.,]*(?:no\.|code)?"
    r"|PDB[\s-]*(?:ID|IDs|code|codes|entry|entries|accession|structure|structures)?|rcsb\.org/(?:structure/|pdb/explore(?:/explore)?\.do\?structureId=))[\s:=]*"
)
_GLOSS = r"(?:\s*\([^)]{0,90}\))?"
NOT_ACCESSIONS, SOFTWARE = ("1H50", "3RD", "2ND"), ("2PQR", "2GMX")


def cued(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, ``acc``): all that stands in a list behind a cue, glosses in brackets stepped over, in capitals. A cue is taken whole, its words in the order given (``ID`` before ``IDs``, so that a plural cues nothing), and no accession begins inside a word."""
    lists = F.regexp_extract_all(text, F.lit(rf"(?i)(?>{_CUE})(?<![A-Za-z0-9])({_ACC}{_GLOSS}(?:\s*(?:,|;|/|and|&)\s*{_ACC}{_GLOSS})*)"), 1)
    return texts.select(key, F.explode(lists).alias("list")).select(key, F.explode(F.regexp_extract_all("list", F.lit(f"({_ACC})"), 1)).alias("acc")).select(key, F.upper("acc").alias("acc"))


def accessions(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """[F4, A1, Q9] Structure accessions of each text: (key, ``acc``, ``n``); years, ordinals and the names of software don't count."""
    rejected = F.col("acc").rlike(r"^(?:19|20)\d\d$") | F.col("acc").isin(*NOT_ACCESSIONS, *SOFTWARE)
    return cued(texts, key, text).where(~rejected).groupBy(key, "acc").agg(F.count(F.lit(1)).alias("n"))


def rejected_software(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """How often, and in how many texts, a software's name was read as an accession: reported, not hidden."""
    return cued(texts, key, text).where(F.col("acc").isin(*SOFTWARE)).groupBy("acc").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("texts"))


def accession_summary(found: DataFrame, scanned: int, key: str) -> DataFrame:
    """[A2] One row over found accessions (key, ``acc``): texts scanned, with any, their share, distinct ones and links."""
    g = found.agg(F.count_distinct(key).alias("with_any"), F.count_distinct("acc").alias("distinct_accs"), F.count(F.lit(1)).alias("links"))
    return g.select(F.lit(scanned).cast("bigint").alias("scanned"), "with_any", (F.col("with_any") / F.greatest(F.lit(scanned), F.lit(1))).alias("share"), "distinct_accs", "links")


def marker_style(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Citation style by the most marks; equal counts go to brackets, then parentheses, then superscripts."""
    b, p, s = F.regexp_count(text, F.lit(r"\[\d+(?:[,\-]\s*\d+)*\]")), F.regexp_count(text, F.lit(r"\(\d{1,3}(?:[,\-]\s*\d{1,3})*\)")), F.regexp_count(text, F.lit(r"[a-z][.,]\d{1,3}\s"))
    top = F.greatest(b, p, s)
    return texts.select(key, b.alias("brackets"), p.alias("parens"), s.alias("supers"), F.when(top == 0, "none").when(b == top, "bracket").when(p == top, "paren").otherwise("super").alias("style"))


def ordinal_rates(markers: DataFrame, refs: DataFrame) -> DataFrame:
    """[J24, A11, Q4] Agreement of markers with the reference of their number, one up, one down and by chance.

    ``markers``: (``key``, ``n``, ``name``); ``refs``: (``key``, ``n``, ``name``). The
    chance arm draws a number by hash, the same at each run. Returns a row per
    key with the four rates, ``tested`` and the verdict, tests in this order:
    too few references, too few tests, no signal, offset, confirmed, failed.
    """
    size = refs.groupBy("key").agg(F.count(F.lit(1)).alias("pool"))
    m = markers.join(size, "key")
    arms = m.select("key", "name", "pool", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), v.alias("n")) for a, v in (("true", F.col("n")), ("up", F.col("n") + 1), ("down", F.col("n") - 1), ("chance", F.pmod(F.xxhash64("key", "n"), F.col("pool")) + 1))])).alias("x")).select("key", "name", "pool", "x.*")
    hit = arms.join(refs.select("key", "n", F.col("name").alias("there")), ["key", "n"]).withColumn("hit", F.lower("there").eqNullSafe(F.lower("name")).cast("double"))
    rate = lambda a: F.coalesce(F.avg(F.when(F.col("arm") == a, F.col("hit"))), F.lit(0.0)).alias(a)
    g = hit.groupBy("key").agg(F.max("pool").alias("pool"), F.count_if(F.col("arm") == "true").alias("tested"), rate("true"), rate("up"), rate("down"), rate("chance"))
    t, u, d, c = (F.col(x) for x in ("true", "up", "down", "chance"))
    return g.withColumn("verdict", F.when(F.col("pool") < 10, "unverifiable").when(F.col("tested") < 5, "unverifiable").when(F.greatest(t, u, d) <= 0.1, "no-signal").when(F.greatest(u, d) > t + 0.3, "offset").when((t >= 0.8) & (t > F.greatest(u, d)) & (t > c + 0.3), "confirmed").otherwise("failed"))


def without_self(edges: DataFrame) -> DataFrame:
    """[Q3] A paper isn't its own reference: such matches become null."""
    return edges.withColumn("match", F.when(F.col("match") != F.col("src_key"), F.col("match")))


def folder_paths(folders: DataFrame) -> DataFrame:
    """[D14] Full path of every folder (``id``, ``name``, ``parent_id``), however deep: (``id``, ``path``, ``verdict``).

    Level by level, each joined once with the folders below it. Folders that no
    root leads to have no path: ``orphan`` where a chain ends in a parent that
    isn't there, else ``loop``.
    """

    def downward(level: DataFrame) -> DataFrame:
        every = level
        while True:
            level = checkpoint(folders.join(level.select(F.col("id").alias("parent_id"), "path"), "parent_id").select("id", F.concat_ws("/", "path", "name").alias("path")))
            if not level.limit(1).count():
                return every
            every = every.unionByName(level)

    paths = downward(folders.where("parent_id is null").select("id", F.col("name").alias("path")))
    lost = folders.join(paths.select("id"), "id", "left_anti")
    headless = downward(lost.join(folders.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", F.lit("").alias("path"))).select("id", F.lit("orphan").alias("verdict"))
    stray = lost.select("id").join(headless, "id", "left").select("id", F.lit(None).cast("string").alias("path"), F.coalesce("verdict", F.lit("loop")).alias("verdict"))
    return paths.withColumn("verdict", F.lit("ok")).unionByName(stray)


def folder_members(folders: DataFrame, members: DataFrame, keys: DataFrame) -> DataFrame:
    """[K4, S5, J20] Every path with the sorted keys of its documents: (``path``, ``keys``).

    ``members``: (``folder_id``, ``doc_id``); ``keys``: (``doc_id``, ``citekey``). Documents
    without a key are left out, folders without documents stay, with none.
    """
    known = members.join(keys, "doc_id").groupBy(F.col("folder_id").alias("id")).agg(F.array_sort(F.collect_set("citekey")).alias("keys"))
    return folder_paths(folders).where("verdict = 'ok'").join(known, "id", "left").groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("keys", F.array().cast("array<string>")))))).alias("keys"))


def placed_files(files: DataFrame, attachments: DataFrame) -> DataFrame:
    """[J12] Archive files to attachments of a document: by name, else where one file meets one attachment, else by a type only one has; the rest is refused.

    ``files``: (``doc``, ``file``, ``ext``); ``attachments``: (``doc``, ``att``, ``filename``, ``ext``).
    """
    named = files.join(attachments.select("doc", F.col("filename").alias("file"), "att"), ["doc", "file"]).groupBy("doc", "file").agg(F.min("att").alias("att")).withColumn("how", F.lit("name"))
    rest, loose = files.join(named.select("doc", "file"), ["doc", "file"], "left_anti"), attachments.join(named.select("att"), "att", "left_anti")
    one = rest.groupBy("doc").agg(F.count(F.lit(1)).alias("f"), F.first("file").alias("file")).where("f = 1").join(loose.groupBy("doc").agg(F.count(F.lit(1)).alias("a"), F.first("att").alias("att")).where("a = 1"), "doc").select("doc", "file", "att", F.lit("single").alias("how"))
    rest, loose = rest.join(one.select("doc", "file"), ["doc", "file"], "left_anti"), loose.join(one.select("att"), "att", "left_anti")
    kind = rest.groupBy("doc", "ext").agg(F.count(F.lit(1)).alias("f"), F.first("file").alias("file")).where("f = 1").join(loose.groupBy("doc", "ext").agg(F.count(F.lit(1)).alias("a"), F.first("att").alias("att")).where("a = 1"), ["doc", "ext"]).select("doc", "file", "att", F.lit("type").alias("how"))
    refused = rest.join(kind.select("doc", "file"), ["doc", "file"], "left_anti").select("doc", "file", F.lit(None).cast("string").alias("att"), F.lit("refused").alias("how"))
    return named.select("doc", "file", "att", "how").unionByName(one).unionByName(kind).unionByName(refused)
