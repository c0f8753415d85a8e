"""Printed page numbers: offsets derived from page edges, claims confirmed, locators resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.functions.scalars import outside
from scholion.operators.library import banded_cluster, offset_votes

#: Characters at either end of a page that can hold its number; how far apart, in characters or lines, numbers of one place may be.
EDGE, POSITION_BAND, LINE_BAND = 160, 120, 2


def edge_numbers(pages: DataFrame) -> DataFrame:
    """Numbers near the ends of pages (``doc``, ``page``, ``text``): (``doc``, ``page``, ``pre``, ``n``); ``pre`` is what is printed right before the number.

    A number of up to five digits, bare or behind one or two letters, or the part
    of an article's folio (``021039-2``) behind its hyphen.
    """
    edges = F.concat(F.left("text", F.lit(EDGE)), F.lit(" "), F.right("text", F.lit(EDGE)))
    bare = F.regexp_extract_all("edges", F.lit(r"((?:(?<![A-Za-z])[A-Za-z]{1,2})?(?<![\d.-])\d{1,5})(?![\d.])"), 1)
    article = F.regexp_extract_all("edges", F.lit(r"\b(\d{5,8}-\d{1,3})\b"), 1)
    x = pages.select("doc", "page", edges.alias("edges")).select("doc", "page", F.explode(F.array_distinct(F.concat(bare, article))).alias("t"))
    return x.select("doc", "page", F.regexp_extract("t", r"^(\d{5,8}-|[A-Za-z]*)", 1).alias("pre"), F.regexp_extract("t", r"(\d+)$", 1).cast("int").alias("n"))


def derived_offsets(pages: DataFrame) -> DataFrame:
    """[A12, A13, Q6] (``doc``, ``offset``, ``top``, ``pages``, ``verdict``, ``pre``): the offset that most pages' edges agree on, and what they print around the number.

    The form is recorded where as many pages carry it as the offset needs; it
    adds no vote. Of several forms the one on most pages counts, then the longest.
    """
    n = edge_numbers(pages).withColumn("off", F.col("n") - F.col("page"))
    every = pages.select("doc", "page").distinct()
    voted = offset_votes(n.select("doc", "page", "off").unionByName(every.withColumn("off", F.lit(None).cast("int"))), "doc", "off", "page")
    forms = n.groupBy("doc", F.col("off").alias("offset"), "pre").agg(F.count_distinct("page").alias("on"))
    best = forms.groupBy("doc", "offset").agg(F.max_by(F.struct("pre", "on"), F.struct("on", F.length("pre"), "pre")).alias("f"))
    x = voted.join(best, ["doc", "offset"], "left")
    need = F.greatest(F.lit(3), F.floor(F.col("pages") * 0.6))
    x = x.select("doc", "offset", "top", "verdict", F.when(F.col("f.on") >= need, F.col("f.pre")).otherwise("").alias("pre"))
    # Documents without any number were too few as well.
    return every.groupBy("doc").agg(F.count_distinct("page").alias("pages")).join(x, "doc", "left").select("doc", "offset", F.coalesce("top", F.lit(0)).alias("top"), "pages", F.coalesce("verdict", F.lit("too few")).alias("verdict"), F.coalesce("pre", F.lit("")).alias("pre"))


def confirmed_offsets(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """[A14, Q6] Claims (``id``, ``doc``, ``offset``, ``pre``) with their ``support``, or null: pages that print the claimed number at one place.

    The whole folio has to stand at an end of its line. Its place is counted in
    characters and in lines, from either end of the page; the most distinct pages
    within one band count, if they are three or more and six in ten.
    """
    total = pages.groupBy("doc").agg(F.count_distinct("page").alias("of"))
    x = claims.join(pages, "doc").withColumn("want", F.concat("pre", (F.col("page") + F.col("offset")).cast("string"))).where(F.contains("text", F.col("want")))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    starts = F.aggregate(F.split("text", "\n"), F.array(F.lit(0)), lambda acc, line: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(line) + 1)))
    each = x.select("id", "page", "want", F.length("text").alias("size"), F.size(F.split("text", "\n")).alias("lines"), starts.alias("starts"), F.explode(lines).alias("l"))
    # The folio with the rest of its line before or behind it, but not both.
    ahead = F.trim("l.line").startswith(F.col("want")) & ~F.substr(F.trim("l.line"), F.length("want") + 1, F.lit(1)).rlike(r"[\d.]")
    behind = F.trim("l.line").endswith(F.col("want")) & ~F.substr(F.reverse(F.trim("l.line")), F.length("want") + 1, F.lit(1)).rlike(r"[\d.-]")
    at = F.element_at("starts", F.col("l.i") + 1)
    places = each.select("id", "page", F.explode(F.array_compact(F.array(F.when(ahead, at + F.instr("l.line", F.col("want")) - 1), F.when(behind, at + F.length(F.rtrim("l.line")) - F.length("want"))))).alias("start"), "size", "lines", F.col("l.i").alias("i"), F.length("want").alias("w"))
    four = F.array(*[F.struct(F.lit(k).alias("how"), v.cast("int").alias("v")) for k, v in (("start", F.col("start")), ("end", F.col("size") - F.col("start") - F.col("w")), ("line", F.col("i")), ("last", F.col("lines") - 1 - F.col("i")))])
    spots = places.select("id", "page", F.explode(four).alias("s")).select(F.struct("id", "s.how").alias("part"), "page", F.col("s.v").alias("v"))
    wide = banded_cluster(spots.where("part.how in ('start', 'end')"), "part", "v", "page", POSITION_BAND)
    support = wide.unionByName(banded_cluster(spots.where("part.how in ('line', 'last')"), "part", "v", "page", LINE_BAND)).groupBy(F.col("part.id").alias("id")).agg(F.max("pages").alias("support"))
    out = claims.join(support, "id", "left").join(total, "doc", "left")
    return out.select("id", F.when((F.col("support") >= F.greatest(F.lit(3), F.floor(F.col("of") * 0.6))) & (F.col("of") >= 3), F.col("support")).alias("support"))


def folio_of(c: Column) -> Column:
    """What is printed before a page number, and the number: of ``863``, ``021039-2`` or ``R863``; else null."""
    t = F.trim(c)
    pre = F.regexp_extract(t, r"^(\d{5,8}-|[A-Za-z]{1,2})?\d{1,5}$", 1)
    return F.when(t.rlike(r"^(?:\d{1,5}|\d{5,8}-\d{1,3}|[A-Za-z]{1,2}\d{1,5})$"), F.struct(pre.alias("pre"), F.regexp_extract(t, r"(\d+)$", 1).cast("int").alias("n")))


def resolved_locators(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """[Q6, P24] Locators (``id``, ``doc``, ``page``, ``printed`` or null, ``first``, ``last``) with what they resolve to.

    Returns (``id``, ``shown``, ``offset``, ``verdict``). A derived offset that leads out of
    the article's range is vetoed. Without a claimed number: ``derived``, ``vetoed``
    or ``marker only``. With one: ``no folio``; where nothing was derived ``confirmed``,
    ``vetoed`` or ``underivable`` by what the pages carry; ``disagrees`` where the
    number or its form isn't the derived one; else ``derived``.
    """
    d = derived_offsets(pages).where("verdict = 'derived'").select("doc", "offset", F.col("pre").alias("d_pre"))
    x = asked.join(d, "doc", "left").withColumn("veto", F.col("offset").isNotNull() & outside(F.col("page") + F.col("offset"), F.col("first"), F.col("last"))).withColumn("f", folio_of(F.col("printed")))
    x = x.withColumn("offset", F.when(~F.col("veto"), F.col("offset")))
    claims = x.where("offset is null and f is not null").select("id", "doc", (F.col("f.n") - F.col("page")).alias("offset"), F.col("f.pre").alias("pre"))
    x = x.join(confirmed_offsets(pages, claims), "id", "left")
    number = F.col("page") + F.col("offset")
    clash = (F.col("f.n") != number) | ((F.col("d_pre") != "") & (F.col("f.pre") != "") & (F.col("d_pre") != F.col("f.pre")))
    unclaimed = F.when(F.col("veto"), "vetoed").when(F.col("offset").isNotNull(), "derived").otherwise("marker only")
    claimed = F.when(F.col("f").isNull(), "no folio").when(F.col("offset").isNull(), F.when(F.col("support").isNotNull(), "confirmed").when(F.col("veto"), "vetoed").otherwise("underivable")).when(clash, "disagrees").otherwise("derived")
    verdict = F.when(F.coalesce(F.col("printed"), F.lit("")) == "", unclaimed).otherwise(claimed)
    pre = F.coalesce(F.nullif("d_pre", F.lit("")), F.col("f.pre"), F.lit(""))
    shown = F.when(verdict == "derived", F.concat(pre, number.cast("string"))).when(verdict == "confirmed", F.trim("printed"))
    return x.select("id", shown.alias("shown"), F.when(verdict == "derived", F.col("offset")).when(verdict == "confirmed", F.col("f.n") - F.col("page")).alias("offset"), verdict.alias("verdict"))
