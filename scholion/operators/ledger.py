"""Claims and the sources that carry them: what rests on what, and what falls with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def links(rows: DataFrame, claim: str, source: str, role: Column) -> DataFrame:
    """Distinct (``claim``, ``source``) links, each with the first of its roles in alphabetical order."""
    return rows.select(F.col(claim).alias("claim"), F.col(source).alias("source"), role.alias("role")).groupBy("claim", "source").agg(F.min("role").alias("role"))


def weighed(link: DataFrame, weights: DataFrame) -> DataFrame:
    """Links with the weight of their role; roles without weight carry nothing. ``weights`` is a ledger's own small list of roles."""
    return link.join(weights, "role", "left").na.fill({"weight": 0.0})


def load_rank(link: DataFrame, weights: DataFrame) -> DataFrame:
    """[A5, O2] Sources by the weight on them: (``source``, ``load``, ``claims``, ``sole``), heaviest first.

    ``sole`` counts claims that nothing else carries. One shuffle by claim to
    count carriers, one by source to sum.
    """
    w = weighed(link, weights).where("weight > 0")
    carriers = w.groupBy("claim").agg(F.count(F.lit(1)).alias("carriers"))
    out = w.join(carriers, "claim").groupBy("source").agg(F.sum(F.col("weight").cast("decimal(12,1)")).cast("double").alias("load"), F.count(F.lit(1)).alias("claims"), F.count_if(F.col("carriers") == 1).alias("sole"))
    return out.orderBy(F.desc("load"), F.desc("claims"), F.desc("sole"), F.desc("source"))


def thin_claims(claims: DataFrame, link: DataFrame, weights: DataFrame) -> DataFrame:
    """[A6] Claims with at most one carrier: (``claim``, ``carriers``); claims without any link are among them."""
    n = weighed(link, weights).groupBy("claim").agg(F.count_if(F.col("weight") > 0).alias("carriers"))
    return claims.select("claim").distinct().join(n, "claim", "left").na.fill(0, ["carriers"]).where("carriers <= 1")


def orphan_claims(claims: DataFrame, link: DataFrame, weights: DataFrame) -> DataFrame:
    """[A6] Claims nothing carries: ``bare`` without links, ``uncarried`` with links of no weight."""
    n = weighed(link, weights).groupBy("claim").agg(F.count_if(F.col("weight") > 0).alias("carriers"), F.count(F.lit(1)).alias("links"))
    return claims.select("claim").distinct().join(n, "claim", "left").na.fill(0, ["carriers", "links"]).where("carriers = 0").select("claim", F.when(F.col("links") == 0, "bare").otherwise("uncarried").alias("kind"))


def remainder(link: DataFrame, weights: DataFrame, source: Column) -> DataFrame:
    """[A7, A8] What stays of each claim of a source once it is withdrawn: carriers left and a verdict."""
    w = weighed(link, weights)
    hit = w.where(F.col("source") == source).select("claim", F.col("role").alias("lost_role"))
    kept = w.where(F.col("source") != source).groupBy("claim").agg(F.count_if(F.col("weight") > 0).alias("left"))
    return hit.join(kept, "claim", "left").na.fill(0, ["left"]).select("claim", "lost_role", "left", F.when(F.col("left") == 0, "falls").when(F.col("left") == 1, "thin").otherwise("stands").alias("verdict"))


def evidence_left(link: DataFrame, weights: DataFrame, source: Column) -> DataFrame:
    """[A7] What still carries each claim of a withdrawn source: (``claim``, ``kept``, ``roles``): the sources of weight, or where there are none, how often each role that is left occurs."""
    w = weighed(link, weights)
    hit = w.where(F.col("source") == source).select("claim").distinct()
    rest = w.where(F.col("source") != source).join(hit, "claim", "left_semi")
    kept = rest.where("weight > 0").groupBy("claim").agg(F.array_sort(F.collect_set("source")).alias("kept"))
    roles = rest.groupBy("claim", "role").agg(F.count(F.lit(1)).alias("n")).groupBy("claim").agg(F.array_join(F.array_sort(F.collect_list(F.concat("role", F.lit(" "), "n"))), ", ").alias("roles"))
    out = hit.join(kept, "claim", "left").join(roles, "claim", "left")
    return out.select("claim", F.coalesce("kept", F.array().cast(kept.schema["kept"].dataType)).alias("kept"), F.when(F.col("kept").isNull(), F.coalesce("roles", F.lit("none"))).alias("roles"))


def histogram(claims: DataFrame, by: str, values: DataFrame) -> DataFrame:
    """[A9] Rows a value, in the order of ``values`` (``by``, ``place``), with zero where none has it; values that aren't listed come last."""
    n = claims.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return values.join(n, by, "full").select(by, F.coalesce("n", F.lit(0)).alias("n"), "place").orderBy(F.asc_nulls_last("place"), by)


def unresolved(link: DataFrame, known: DataFrame) -> DataFrame:
    """[J9] Sources that the library doesn't hold, with how many claims name them."""
    return link.join(known.select(F.col("key").alias("source")), "source", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("claims"))


def violations(claims: DataFrame, link: DataFrame, weights: DataFrame) -> DataFrame:
    """[Q26] All that is wrong with a ledger at once: (``problem``, ``claim``)."""
    parts = [
        claims.groupBy("claim").count().where("count > 1").select(F.lit("duplicate claim").alias("problem"), "claim"),
        claims.where("claim is null").select(F.lit("claim without id").alias("problem"), "claim"),
        link.join(claims.select("claim"), "claim", "left_anti").select(F.lit("link to no claim").alias("problem"), "claim"),
        link.join(weights, "role", "left_anti").select(F.lit("unknown role").alias("problem"), "claim"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
