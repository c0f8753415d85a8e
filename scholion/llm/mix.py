"""Mixing sources to target shares of tokens, by min-cost flow.

Documents with the same text are one document that belongs to every source it
was found in. They are aggregated by this membership pattern; a flow routes the
patterns' tokens to the sources' quotas at a cost that rises with every
repetition, so nothing is repeated while unused text is left. The flow's amounts
become intervals on a line on which each pattern's documents lie in seeded
order, once for every pass; a document is used as often as it lies in them.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholion.session import checkpoint, spread

#: Where the public tokenizer's ranks are, and how finely a pattern's documents are ordered.
RANKS, BUCKETS = "/opt/tokenizers/byte_bpe_50k.tiktoken", 4096
#: Up to so many intervals (a pattern and a source each) are sent to every executor; more are joined by a shuffle.
SPANS = 100_000
# Fixed value: the pattern by which byte-level vocabularies of this kind split a text.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer, once a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def min_cost_flow(supply: dict[str, int], quotas: dict[str, int], member: dict[str, set[str]], repeats: dict[str, int]) -> dict[tuple[str, str], int]:
    """Tokens routed from each pattern to each source.

    Pass k over a pattern costs k; a source takes at most its quota, and of a
    pattern at most ``repeats`` passes. Successive shortest paths: the greatest
    flow, and of those the cheapest.
    """
    nodes = ["<s>", *supply, *(f">{q}" for q in quotas), "<t>"]
    at = {x: i for i, x in enumerate(nodes)}
    graph: list[list[list[int]]] = [[] for _ in nodes]  # [to, capacity, cost, reverse edge]

    def edge(a: str, b: str, capacity: int, cost: int) -> list[int]:
        x, y = [at[b], capacity, cost, len(graph[at[b]])], [at[a], 0, -cost, len(graph[at[a]])]
        graph[at[a]].append(x)
        graph[at[b]].append(y)
        return x

    routed = {}
    for p, tokens in supply.items():
        for k in range(max(repeats[s] for s in member[p])):
            edge("<s>", p, tokens, k)
        for s in sorted(member[p]):
            routed[p, s] = edge(p, f">{s}", tokens * repeats[s], 0)
    for s, q in quotas.items():
        edge(f">{s}", "<t>", q, 0)
    start = {k: e[1] for k, e in routed.items()}
    potential = [0] * len(nodes)
    while True:
        far, via = [None] * len(nodes), [None] * len(nodes)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for j, (v, capacity, cost, _) in enumerate(graph[u]):
                step = d + cost + potential[u] - potential[v]
                if capacity > 0 and (far[v] is None or step < far[v]):
                    far[v], via[v] = step, (u, j)
                    heapq.heappush(heap, (step, v))
        if far[-1] is None:
            return {k: start[k] - e[1] for k, e in routed.items() if start[k] > e[1]}
        potential = [p + f if f is not None else p for p, f in zip(potential, far)]
        v, least = len(nodes) - 1, None
        while v:
            u, j = via[v]
            least, v = min(graph[u][j][1], least) if least is not None else graph[u][j][1], u
        v = len(nodes) - 1
        while v:
            u, j = via[v]
            graph[u][j][1] -= least
            graph[v][graph[u][j][3]][1] += least
            v = u


def counted(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(``doc_id``, ``source``, ``h``, ``tokens``): each document with its text's hash and size in tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(ranks)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "h": b["h"], "tokens": [len(enc.encode_ordinary(t)) for t in b["text"]]})

    source = F.nullif(F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_"), F.lit(""))
    d = documents.where("doc_id is not null and trim(text) <> ''").select("doc_id", source.alias("source"), "text", F.sha2("text", 256).alias("h")).where("source is not null")
    return spread(d).mapInPandas(count, "doc_id bigint, source string, h string, tokens bigint")


def _place(seed: int) -> tuple[Column, Column]:
    """A document's bucket and its place within it, both from the seed."""
    x = F.xxhash64(F.lit(seed), "h")
    return F.pmod(x, F.lit(BUCKETS)).cast("int"), F.pmod(F.shiftright(x, 16), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, ranks: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """The chosen documents and the shares reached.

    Returns (``doc_id``, ``source``, ``repeats``, ``tokens``), one row per chosen
    document and the source it counts for, and one row per source of either
    table: (``source``, ``target_share``, ``max_repeats``, ``available_tokens``,
    ``mixed_tokens``, ``actual_share``). ``total`` is the size wanted; by default
    that of all documents of the sources with a target.

    Of documents with one text the smallest id stands for all. Documents without
    id, text or source aren't used; sources without target get none, and targets
    without documents, null shares or no repeats stay at 0. Copies of rows count
    once. Empty tables give an empty mixture. Sizes follow the flow to within one
    document in each of :data:`BUCKETS` parts of a pattern.
    """
    spark = documents.sparkSession
    wanted = {r["source"]: (r["share"], r["repeats"]) for r in targets.where("source is not null").groupBy(F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_").alias("source")).agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("repeats")).collect()}
    every = checkpoint(counted(documents, ranks))
    usable = sorted(s for s, (share, repeats) in wanted.items() if share > 0 and repeats > 0)
    texts = every.where(F.col("source").isin(usable)).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"), F.to_json(F.array_sort(F.collect_set("source"))).alias("pattern"))
    bucket, inner = _place(seed)
    texts = checkpoint(texts.where("tokens > 0").withColumn("bucket", bucket).withColumn("inner", inner))
    # A pattern is a set of sources with a target, so there are few; sums only reach the driver.
    supply = {r["pattern"]: r["n"] for r in texts.groupBy("pattern").agg(F.sum("tokens").alias("n")).collect()}
    size = total if total is not None else sum(supply.values())
    shares = sum(wanted[s][0] for s in usable) or 1.0
    quotas = {s: round(size * wanted[s][0] / max(shares, sum(x for x, _ in wanted.values()))) for s in usable}
    flow = min_cost_flow(supply, quotas, {p: set(json.loads(p)) for p in supply}, {s: wanted[s][1] for s in usable}) if supply else {}
    intervals, line = [], {}
    for (p, s), tokens in sorted(flow.items()):
        a = line.get(p, 0.0)
        line[p] = a + tokens / supply[p]
        intervals.append((p, s, a, line[p]))
    spans = spark.createDataFrame(intervals, "pattern string, source string, a double, b double")
    sums = texts.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    w = Window.partitionBy("pattern").orderBy("bucket")
    # At most BUCKETS rows a pattern: a small window over sums, not over documents.
    before = sums.withColumn("before", F.sum("in_bucket").over(w) - F.col("in_bucket")).withColumn("all", F.sum("in_bucket").over(Window.partitionBy("pattern")))
    m = (F.col("before") + F.col("inner") * F.col("in_bucket")) / F.col("all")
    used = texts.join(before, ["pattern", "bucket"]).withColumn("m", m).join(F.broadcast(spans) if len(intervals) <= SPANS else spans, "pattern").withColumn("repeats", (F.ceil(F.col("b") - F.col("m")) - F.ceil(F.col("a") - F.col("m"))).cast("int")).where("repeats > 0")
    chosen = checkpoint(used.select("doc_id", "source", "repeats", "tokens"))
    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"))
    there = every.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    goal = spark.createDataFrame([(s, float(x), int(r)) for s, (x, r) in sorted(wanted.items())], "source string, target_share double, max_repeats int")
    report = goal.join(there, "source", "full").join(reached, "source", "left").na.fill(0, ["available_tokens", "mixed_tokens"])
    # One row a source: the total over them is a window over a handful of rows.
    report = report.withColumn("whole", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1))))
    return chosen, report.select("source", "target_share", "max_repeats", "available_tokens", "mixed_tokens", (F.col("mixed_tokens") / F.greatest(F.col("whole"), F.lit(1))).alias("actual_share"))
