"""Duplicates of new batches against all history, by an index of keys that is complete for its test.

:func:`verify` says which two records describe one work; :func:`_keys` makes keys
of which any two such records share one. Records that give their page meet by it
and the volume; where one lacks its page they meet by equal titles, by parts of
DOIs that two edits leave whole, or by winnowed letters of titles within 6 % of
edits. Whether a field is lacking is part of the key, so that complete records,
which are most, meet by their place in print only; years, numbers and kinds of
title refine keys. A record's keys are stored once; a new record asks for those
that can meet them. Candidates are verified with bounded edit distances and the
supporting fields, and the new keys are appended for the batches to come.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.functions.text import plain_doi, plain_name, plain_title, present, year_of
from scholion.operators.components import components
from scholion.session import checkpoint, looked_up, shared_folder, tidied

#: Letters of a title's indexed pieces; characters of a DOI's tail, and the edits between DOIs that count as near.
GRAM, TAIL, DOI_EDITS = 5, 10, 2
#: Edits that the keys of any title of 34 letters or more allow for; longer ones may have more, by 6 % of their letters.
TITLE_EDITS = 2
#: Titles below so many letters are shared by many works.
GENERIC = 24
#: Bits of an id (0 to 2**48 - 1) below the batch (0 to 32,767) in one number.
_ID_BITS = 48

_KIND = r"\b(erratum|corrigendum|correction|addendum|retraction|comment|reply|response|part\s+(?:\d+|[ivx]+)|supplement|[ivx]{2,})\b"


def core_of(title: Column) -> Column:
    """The letters of a plain title without the light words that open it."""
    return F.replace(F.regexp_replace(title, r"^(?:(?:on|the|a|an|of|towards?|how|effects?|from|zur|der|die|das|le|la|les|el)\s+)+(?=\S)", ""), F.lit(" "), F.lit(""))


def describe(entries: DataFrame) -> DataFrame:
    """The fields a record is compared by. Columns other than those of ``entries`` are dropped."""
    t = plain_title(F.col("title"))
    return (
        entries.select(
            F.col("entry_id").cast("bigint").alias("id"),
            F.coalesce(F.col("batch_no"), F.lit(0)).alias("batch"),
            F.coalesce(t, F.lit("")).alias("title"),
            F.coalesce(core_of(t), F.lit("")).alias("core"),
            plain_doi(F.col("doi")).alias("doi"),
            present(plain_name(F.coalesce(F.col("surname"), F.expr("authors[0].last_name"), F.expr("authors[0].name")))).alias("surname"),
            year_of(F.col("year")).alias("year"),
            present(F.lower("volume")).alias("volume"),
            present(F.lower("firstpage")).alias("page"),
        )
        .where("id is not null")
        .withColumn("kind", F.array_join(F.regexp_extract_all("title", F.lit(_KIND), 1), " "))
        .withColumn("numbers", F.array_join(F.array_sort(F.regexp_extract_all("title", F.lit(r"(\d+)"), 1)), " "))
    )


def _years(stored: bool) -> Column:
    """Pairs of years, under which two records meet if theirs are at most one apart or one has none."""
    pair = lambda y: F.floor(y / 2).cast("string")
    y = F.col("year")
    if stored:
        return F.when(y.isNull(), F.array(F.lit("none"), F.lit("any"))).otherwise(F.array(pair(y), F.lit("any")))
    return F.when(y.isNull(), F.array(F.lit("any"))).otherwise(F.array(pair(y - 1), pair(y + 1), F.lit("none")))


def _lacks(name: str, stored: bool) -> Column:
    """Marks under which two records meet if one of them at least lacks the field."""
    lack = F.col(name).isNull()
    if stored:
        return F.when(lack, F.array(F.lit("all"), F.lit("lack"))).otherwise(F.array(F.lit("all")))
    return F.array(F.when(lack, F.lit("all")).otherwise(F.lit("lack")))


def _made(tag: str, fields: list[Column], *options: Column) -> Column:
    """Keys of the fields, each refined with one of every option and the kind of title; none where a field is null."""

    def deeper(chosen: list[Column], left: tuple[Column, ...]) -> Column:
        if not left:
            return F.array(F.xxhash64(F.lit(tag), "kind", *fields, *chosen))
        each = F.transform(left[0], lambda o: deeper([*chosen, o], left[1:]) if left[1:] else F.xxhash64(F.lit(tag), "kind", *fields, *chosen, o))
        return F.flatten(each) if left[1:] else each

    return F.when(reduce(and_, [f.isNotNull() for f in fields]), deeper([], options)).otherwise(F.array().cast("array<bigint>"))


def _grams(s: Column) -> tuple[Column, Column]:
    """Hashes of :data:`GRAM` letters that are smallest in a window (winnowing).

    Strings of n letters (the longer) within 6 % of edits share a run of 8
    letters at least, of 10 from 34 letters on, of 12 from 67 on; a run of a
    window and ``GRAM`` - 1 more shares a hash. What is smallest in a window is
    so in the shorter windows within it, so lengths on two sides of a step meet.
    """
    n = F.length(s)
    window = F.when(n < 36, 4).when(n < 72, 6).otherwise(8)
    hashes = F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.xxhash64(s.substr(i, F.lit(GRAM))))
    least = F.transform(F.sequence(F.lit(1), n - GRAM + 2 - window), lambda i: F.array_min(F.slice(F.col("hashes"), i, window)))
    return hashes, least


def _dois(stored: bool) -> Column:
    """Parts of DOIs, one of which any two within :data:`DOI_EDITS` edits share.

    A DOI is parted before its last :data:`TAIL` characters. With all edits in
    the tail, the head and a third of the tail are whole; with one edit at most
    in the tail, one of its halves is. A part may be shifted by the edits before
    it, or counted from the end.
    """
    s, n, parts = F.col("doi"), F.length("doi"), []
    for d in [0] if stored else range(-DOI_EDITS, DOI_EDITS + 1):
        # The stored DOI has d characters more.
        cut = F.greatest(n + (d - TAIL), F.lit(0))
        tail = n + d - cut
        for count, head in ((DOI_EDITS + 1, F.substring(s, F.lit(1), cut)), (2, F.lit(""))):
            for i in range(count):
                first, beyond = F.floor(tail * i / count), F.floor(tail * (i + 1) / count)
                if i == count - 1:
                    shifts = [-d]
                else:
                    most = 0 if count > 2 and i == 0 else DOI_EDITS if count > 2 else 1
                    shifts = [k for k in range(-most, most + 1) if abs(k) + abs(d + k) <= DOI_EDITS]
                for k in [0] if stored else shifts:
                    at = (cut + first + k).cast("int")
                    length = (beyond - first).cast("int")
                    parts.append(F.when((at >= 0) & (length > 0) & (at + length <= n), F.xxhash64(F.lit(f"{count} {i}"), n + d, head, s.substr(at + 1, length))))
    return F.array_compact(F.array(*parts))


def _keys(described: DataFrame, stored: bool, at: str) -> DataFrame:
    """(``key``, ``at``): keys of which any two records that :func:`verify` may accept share one, stored of one and asked of the other.

    Accepted pairs don't differ in volume, page or kind where both are known, nor
    in year by more than one. Both pages known: they meet by page, with the
    volume or where one lacks it. Else one lacks its page, and the pair meets by
    equal titles, by near DOIs, or, as one lacks its DOI too, by titles within 6 %
    of edits. Titles that say nothing match nothing.
    """
    years, no_page, no_volume, no_doi = _years(stored), _lacks("page", stored), _lacks("volume", stored), _lacks("doi", stored)
    n = F.length("core")
    named = F.col("surname").isNotNull()
    none = F.array().cast("array<bigint>")
    hashes, least = _grams(F.col("core"))
    x = described.where("length(title) > 0")
    # Parts are columns of their own, so each is made once a record.
    x = x.withColumn("hashes", F.when(named & (n >= 16), hashes)).withColumn("grams", F.coalesce(F.array_distinct(F.when(F.col("hashes").isNotNull(), least)), none))
    x = x.withColumn("parts", F.when(F.col("doi").isNotNull(), _dois(stored)).otherwise(none))
    keys = [
        _made("place", [F.col("page"), F.col("volume")], years),
        _made("page", [F.col("page")], no_volume, years),
        _made("title", [F.when(named & (n >= GENERIC), F.col("core"))], no_page, years),
        _made("short", [F.when(named & (n < GENERIC), F.col("core")), F.col("volume")], no_page, years),
        _made("doi", [F.col("doi")], no_page, years),
        _made("near doi", [F.col("numbers")], no_page, F.col("parts")),
        _made("letters", [F.col("numbers"), F.col("volume")], no_page, no_doi, F.col("grams")),
        _made("letters", [F.when(n >= GENERIC - 1, F.col("numbers"))], no_page, no_doi, no_volume, years, F.col("grams")),
    ]
    return x.select(_at().alias(at), F.explode(F.array_distinct(F.concat(*keys))).alias("key"))


def index_rows(described: DataFrame) -> DataFrame:
    """The index of records: (``at``, the record's place in the order of arrival, ``key``); append these rows of every accepted batch."""
    return _keys(described, True, "at")


def _at() -> Column:
    """Batch and id in one number that orders as they do, so that less is shuffled."""
    return (F.shiftleft(F.col("batch").cast("bigint"), _ID_BITS) + F.col("id")).alias("at")


def probe(index: DataFrame, batch: DataFrame) -> DataFrame:
    """Candidates (``old``, ``new``): records of the index that came before a record of the batch and meet one of its probes.

    Only the batch's own probes are shuffled besides the stored index; history
    itself isn't compared again.
    """
    probes = _keys(batch, False, "new_at")
    # Probes are many for a record, so they are never sent to all: they go where the index lies.
    met = probes.hint("merge").join(index, "key").where(F.col("at") < F.col("new_at")).select("at", "new_at").distinct()
    return met.select(F.col("at").bitwiseAND((1 << _ID_BITS) - 1).alias("old"), F.col("new_at").bitwiseAND((1 << _ID_BITS) - 1).alias("new"))


def _near(a: Column, b: Column, share: float) -> Column:
    """Edit distance within a share of the longer string; null where either is."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.levenshtein(a, b) <= F.floor(longest * share)


def plausible(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Candidates that no year, volume, page or kind of title speaks against, told by hashes of these, before whole fields are joined to them."""

    def narrow(side: DataFrame, name: str, mark: str) -> DataFrame:
        made = {"y": F.col("year").cast("smallint"), "v": F.hash(F.col("volume")), "p": F.hash(F.col("page")), "k": F.hash(F.col("kind"))}
        known = {"y": "year", "v": "volume", "p": "page"}
        return side.where("length(title) > 0").select(F.col("id").alias(name), *[(F.when(F.col(known[k]).isNotNull(), c) if k in known else c).alias(f"{k}_{mark}") for k, c in made.items()])

    true = lambda c: F.coalesce(c, F.lit(True))
    x = pairs.hint("merge").join(narrow(old, "old", "a"), "old").hint("merge").join(narrow(new, "new", "b"), "new")
    agree = (F.col("k_a") == F.col("k_b")) & true(F.abs(F.col("y_a") - F.col("y_b")) <= 1) & true(F.col("v_a") == F.col("v_b")) & true(F.col("p_a") == F.col("p_b"))
    return x.where(agree).select("old", "new")


def verify(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The candidates that describe the same work."""
    cols = ["title", "core", "doi", "surname", "year", "volume", "page", "kind", "numbers"]
    x = plausible(pairs, old, new).hint("merge").join(old.select(F.col("id").alias("old"), *[F.col(c).alias(f"{c}_a") for c in cols]), "old").hint("merge").join(new.select(F.col("id").alias("new"), *[F.col(c).alias(f"{c}_b") for c in cols]), "new")
    a, b = F.col("core_a"), F.col("core_b")
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n = F.length(short)
    cut = (n >= 12) & (F.levenshtein(short, F.substring(long, F.lit(1), n)) <= F.floor(n * 0.1) + 1)
    words_a, words_b = F.split("title_a", " "), F.split("title_b", " ")
    shared = F.size(F.array_intersect(words_a, words_b)) / F.greatest(F.lit(1), F.least(F.size(F.array_distinct(words_a)), F.size(F.array_distinct(words_b))))
    x = x.select(
        "old", "new",
        (a == b).alias("same"), _near(a, b, 0.06).alias("close"), (_near(a, b, 0.25) | cut | (shared >= 0.6)).alias("alike"), (cut | _near(a, b, 0.2)).alias("headed"),
        F.coalesce(F.col("doi_a") == F.col("doi_b"), F.lit(False)).alias("doi_same"),
        F.coalesce(F.levenshtein("doi_a", "doi_b") <= DOI_EDITS, F.lit(False)).alias("doi_near"),
        (F.col("doi_a").isNull() | F.col("doi_b").isNull()).alias("doi_open"),
        F.coalesce((F.abs(F.col("year_a") - F.col("year_b")) <= 1), F.lit(True)).alias("year_ok"),
        (F.col("volume_a") == F.col("volume_b")).alias("volume_ok"),
        (F.col("page_a") == F.col("page_b")).alias("page_ok"),
        (_near(F.col("surname_a"), F.col("surname_b"), 0.34) | F.col("surname_a").contains(F.col("surname_b")) | F.col("surname_b").contains(F.col("surname_a"))).alias("who_ok"),
        ((F.col("kind_a") == F.col("kind_b")) & (F.length("title_a") > 0) & (F.length("title_b") > 0)).alias("kind_ok"),
        (F.col("numbers_a") == F.col("numbers_b")).alias("numbers_ok"),
        ((F.length(a) < GENERIC) & (F.length(b) < GENERIC)).alias("generic"),
    )
    true = lambda c: F.coalesce(F.col(c), F.lit(True))  # noqa: E731  # nothing known speaks against it
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    base = F.col("kind_ok") & F.col("year_ok") & true("volume_ok") & true("page_ok")
    printed = known("page_ok") & (known("volume_ok") | known("doi_near") | F.col("close")) & F.col("alike") & (true("who_ok") | F.col("doi_near") | F.col("close"))
    by_doi = F.col("doi_near") & F.col("headed") & (F.col("numbers_ok") | F.col("doi_same"))
    by_title = (F.col("same") | (F.col("close") & F.col("numbers_ok"))) & known("who_ok") & (F.col("doi_open") | known("page_ok") | F.col("same")) & (known("volume_ok") | known("page_ok") | ~F.col("generic"))
    return x.where(base & (printed | by_doi | by_title)).select("old", "new")


_FIELDS = ["title", "core", "doi", "surname", "year", "volume", "page", "kind", "numbers"]


class History:
    """Everything accepted so far: the segment index and the compared fields, both stored and appended to batch by batch.

    The index is a table bucketed by key, so a batch's probes are shuffled to it
    and it isn't shuffled itself; fields are read for the records that a batch
    met, found by their ids. Both lie in the folder that all executors share.
    Only records that lead a class of equal ones are stored, so a work that is
    copied often stays one row.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.name = spark, f"segments_{uuid.uuid4().hex}"
        self.folder = f"{shared_folder(spark)}/{self.name}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.batches = 0

    def accept(self, leads: DataFrame) -> DataFrame:
        """Append the records that a batch adds; returns them as they are stored."""
        to = f"{self.folder}/fields/{self.batches:06}"
        leads.write.option("compression", "zstd").parquet(to)
        self.schema, self.batches = leads.schema, self.batches + 1
        kept = self.spark.read.schema(self.schema).parquet(to)
        rows = index_rows(kept).repartition(self.buckets, "key")
        with tidied(self.spark):
            rows.write.mode("append").format("parquet").option("compression", "zstd").option("path", f"{self.folder}/index").bucketBy(self.buckets, "key").saveAsTable(self.name)
        return kept

    @property
    def index(self) -> DataFrame:
        return self.spark.table(self.name)

    @property
    def fields(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/fields/{n:06}" for n in range(self.batches)])

    def close(self) -> None:
        """Forget the table's name; its files stay in the shared folder."""
        self.spark.sql(f"drop table if exists {self.name}")


def classed(entries: DataFrame) -> DataFrame:
    """:func:`describe` with a row an id, and the ``class`` of records that are equal in every field and not void."""
    once = describe(entries).groupBy("id").agg(*[F.min_by(F.col(c), F.struct("batch", *_FIELDS)).alias(c) for c in ["batch", *_FIELDS]])
    alike = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in _FIELDS])
    return once.withColumn("class", F.when((F.length("title") >= 12) | F.col("doi").isNotNull(), alike).otherwise(F.xxhash64("id", F.lit("own"))))


def check_batch(history: History, batch: DataFrame) -> DataFrame:
    """One new batch, or several that follow each other, of :func:`classed` records, against all that was accepted; they are accepted with that.

    Returns the links (``old``, ``new``) of its records to earlier ones, of
    history or of the batch, kept. History isn't probed again: the batch's own
    keys are joined with the stored index, and fields are read for what they met.
    """
    groups = batch.groupBy("class").agg(F.min(F.struct("batch", "id")).alias("lead"), F.count(F.lit(1)).alias("n"))
    # Records equal to a stored one are its copies and add nothing to the index.
    held = history.fields.groupBy("class").agg(F.min("id").alias("held")) if history.batches else history.spark.createDataFrame([], "class bigint, held bigint")
    groups = checkpoint(groups.hint("merge").join(held, "class", "left").select("class", F.col("lead.id").alias("lead"), "n", "held"))
    copies = batch.select("id", "class").hint("merge").join(groups.where("n > 1 or held is not null"), "class").select(F.coalesce("held", "lead").alias("old"), F.col("id").alias("new")).where("old <> new")
    leads = history.accept(batch.hint("merge").join(groups.where("held is null").select(F.col("lead").alias("id")), "id", "left_semi"))
    pairs = checkpoint(probe(history.index, leads))
    return checkpoint(verify(pairs, history.fields, leads).unionByName(copies))


def together(sizes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and last batch of each pass, from batches in order with their numbers of records.

    Batches that lie there already are checked together as long as they aren't
    more than all that came before them. The index, which a pass reads in full,
    at most doubles then, and small batches don't each pay for a pass.
    """
    passes: list[tuple[int, int]] = []
    before = taken = 0
    for batch, n in sizes:
        if passes and taken + n <= before:
            passes[-1] = (passes[-1][0], batch)
        else:
            before, taken = before + taken, 0
            passes.append((batch, batch))
        taken += n
    return passes


def duplicates(entries: DataFrame) -> DataFrame:
    """(``entry_a``, ``entry_b``): each later record of a work with the work's first, by (``batch_no``, ``entry_id``).

    Batches are checked in their order against all history (:func:`check_batch`),
    small ones together (:func:`together`): a record meets only those that came
    before it. The links of all batches make the works. Records equal in every compared field
    form one class first, so many copies cost one probe.

    Rows without ``entry_id`` are ignored, repeated rows of one id count once, in
    their first batch (ids and batches aren't negative; ids stay below 2**48); a
    null ``batch_no`` counts as 0. Records without title, DOI or place in print
    match nothing. Other columns may have any names. An empty table gives no row.
    """
    spark = entries.sparkSession
    rows = entries.where("entry_id is not null").withColumn("batch_no", F.coalesce("batch_no", F.lit(0)))
    first = rows.groupBy("entry_id").agg(F.min("batch_no").alias("batch_no"), F.count(F.lit(1)).alias("n"))
    again = checkpoint(first.where("n > 1"))
    if again.limit(1).count():
        rows = looked_up(rows, again.select("entry_id"), "entry_id", "left_anti").unionByName(rows.join(again.select("entry_id", "batch_no"), ["entry_id", "batch_no"], "left_semi"))
    history, links = History(spark), spark.createDataFrame([], "old bigint, new bigint")
    every = checkpoint(classed(rows))
    sizes = sorted((r["batch"], r["count"]) for r in every.groupBy("batch").count().toLocalIterator())
    for first_no, last_no in together(sizes):
        links = links.unionByName(check_batch(history, every.where(F.col("batch").between(first_no, last_no))))
    history.close()
    roots = components(links, "old", "new")
    placed = roots.join(every.select(F.col("id").alias("node"), "batch"), "node")
    firsts = placed.groupBy("root").agg(F.min(F.struct("batch", "node")).alias("lead"))
    return placed.join(firsts, "root").select(F.col("lead.node").alias("entry_a"), F.col("node").alias("entry_b")).where("entry_a <> entry_b")


def at_once(entries: DataFrame) -> DataFrame:
    """The links (``old``, ``new``) that one pass over all records finds: what batch after batch has to give. For comparing."""
    every = checkpoint(describe(entries).dropDuplicates(["id"]))
    return verify(probe(index_rows(every), every), every, every)
