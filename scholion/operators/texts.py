"""Operators on texts that built-in expressions can't say: vectorised Python over whole columns."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion.session import spread

# Marks that count as one another in quotes, and characters that take no part in them.
_MARKS = str.maketrans({**dict.fromkeys("‘’", "'"), **dict.fromkeys("“”", '"'), **dict.fromkeys("–—−", "-")})
_SILENT = regex.compile(r"(?V1)[\p{Cc}\p{Cf}\p{Co}--\s]+")
# Headings under which papers list their references.
_HEADS = re.compile(r"^\W{0,4}(?:\d+\.?\s+)?(?:references(?: and notes)?|bibliography|literature cited|works cited|literatur(?:verzeichnis)?|références)\W{0,4}$", re.I)


def _mapped(f, kind: T.DataType):
    """A vectorised function of one column; null stays null."""

    @F.pandas_udf(kind)
    def mapped(c: pd.Series) -> pd.Series:
        return c.map(f, na_action="ignore")

    return mapped


def plain_quote(text: str) -> str:
    """[P21] A quote for comparing: compatibility forms, one kind of marks and dashes, nothing unseen, lower case, single spaces."""
    return " ".join(_SILENT.sub("", unicodedata.normalize("NFKC", text)).translate(_MARKS).lower().split())


# Fragments that are common in prose, and the thresholds that belong to them.
FRAGMENTS = ("the", "and", "tion", "ing", "of", "that", "with", "for", "are", "was", "this", "ment", "ally")
SHIFT_LEAST, SHIFT_READ, SHIFT_FLOOR, SHIFT_RATIO, SEQUENCE_TOP4 = 600, 8000, 12, 4.0, 0.55


def shift_counts(text: str) -> np.ndarray:
    """How many common fragments a text holds under each of the 26 shifts along the alphabet.

    A fragment that was shifted keeps the steps between its letters, so one pass
    over the letters finds it under every shift: where all its letters are off by
    the same number, that number is the shift.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64) - ord("a")
    letter = (codes >= 0) & (codes < 26)
    found = np.zeros(26, dtype=np.int64)
    for f in FRAGMENTS:
        n = len(codes) - len(f) + 1
        if n <= 0:
            continue
        off = [np.where(letter[i : i + n], (codes[i : i + n] - (ord(c) - ord("a"))) % 26, -1 - i) for i, c in enumerate(f)]
        same = np.logical_and.reduce([o == off[0] for o in off[1:]])
        found += np.bincount(off[0][same & (off[0] >= 0)], minlength=26)
    return found


def rotated(text: str) -> bool:
    """[P27] Whether prose was shifted along the alphabet: a shift holds far more common fragments than the text itself.

    The first characters decide, as a page is shifted as a whole; sequences that
    four letters nearly make up aren't prose.
    """
    read = text[:SHIFT_READ]
    letters = Counter(c for c in read.lower() if c.isalpha())
    if len(text) < SHIFT_LEAST or sum(n for _, n in letters.most_common(4)) >= SEQUENCE_TOP4 * max(1, letters.total()):
        return False
    counts = shift_counts(read)
    return bool(counts[1:].max() >= max(SHIFT_FLOOR, SHIFT_RATIO * max(counts[0], 1)))


def find_span(raw: str, quote: str) -> str | None:
    """[Q7] The stretch of a raw text that a quote stands for, as it is written there; null if it isn't there or more than once."""
    words = [w for w in re.split(r"[^\w]+", plain_quote(quote)) if w]
    if not words:
        return None
    found = list(re.finditer(r"[\W_]*".join(re.escape(c) for c in "".join(words)), unicodedata.normalize("NFKC", raw), re.I))
    return found[0][0] if len(found) == 1 else None


def longest_chain(numbers: list[int], step: int = 5) -> list[int]:
    """[W2] Places of the longest chain that climbs by 1 to ``step``, skipping what doesn't fit; the first of equals.

    The best chain that ends in each value is all that later ones can build on,
    so a number looks at ``step`` values and not at every number before it.
    """
    ends: dict[int, tuple[int, int]] = {}
    before: dict[int, int] = {}
    for place, v in enumerate(numbers):
        length, at = max((ends[w] for w in range(v - step, v) if w in ends), default=(0, 0))
        if length:
            before[place] = -at
        if v not in ends or length + 1 > ends[v][0]:
            ends[v] = (length + 1, -place)
    chain = [-max(ends.values())[1]] if ends else []
    while chain and chain[-1] in before:
        chain.append(before[chain[-1]])
    return chain[::-1]


def list_entries(text: str, floor: float = 0.35) -> list[tuple[int, str]]:
    """[Q1, F16] (label, raw) of a paper's reference list: the last heading past ``floor`` of the text whose lines make a chain of labels."""
    lines = text.split("\n")
    for h in reversed([i for i, x in enumerate(lines) if _HEADS.match(x) and sum(map(len, lines[:i])) + i >= floor * len(text)]):
        labels = [(i, int(m[1])) for i in range(h + 1, len(lines)) if (m := re.match(r"\s*[\[(]?(\d{1,4})[\]).]?\s+\S", lines[i]))]
        chain = longest_chain([n for _, n in labels])
        if len(chain) >= 2 or labels and len(labels) == 1:
            starts = [labels[k] for k in chain]
            ends = [i for i, _ in starts[1:]] + [len(lines)]
            return [(n, re.sub(r"^\s*[\[(]?\d{1,4}[\]).]?\s+", "", " ".join(x.strip() for x in lines[i:e] if x.strip()))) for (i, n), e in zip(starts, ends)]
    return []


def reference_lists(texts: DataFrame, key: str, text: str) -> DataFrame:
    """[Q1] (key, ``label``, ``raw``) of every paper's list; papers without one give no row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *e) for k, t in zip(b[key], b[text]) if t for e in list_entries(t)], columns=[key, "label", "raw"])

    kind = texts.schema[key].dataType.simpleString()
    return spread(texts.select(key, text)).mapInPandas(parse, f"{key} {kind}, label int, raw string")


def copy_pairs(files: DataFrame, ratio: float = 0.98) -> DataFrame:
    """[J16] Files of one key compared: (``key``, ``stem_a``, ``stem_b``, ``verdict``), ``stem_a`` the earlier.

    Files of one text are a class, led by its first stem: every other member gives
    one row ``equal`` with the leader. Leaders are compared with each other,
    ``near`` or ``other``, so that no link between different texts is lost and
    copies aren't expanded into all pairs. A null text is an empty one.
    """
    alike = F.pandas_udf(lambda a, b: pd.Series([_ratio(x, y, ratio) for x, y in zip(a, b)]), T.DoubleType())
    f = files.select("key", "stem", F.coalesce("text", F.lit("")).alias("text"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    classes = f.groupBy("key", "h").agg(F.min("stem").alias("stem_a"))
    equal = f.select("key", "stem", "h").join(classes, ["key", "h"]).where("stem <> stem_a").select("key", "stem_a", F.col("stem").alias("stem_b"), F.lit("equal").alias("verdict"))
    leads = f.join(classes.select("key", F.col("stem_a").alias("stem")), ["key", "stem"], "left_semi").select("key", "stem", "text")
    pairs = leads.select("key", F.col("stem").alias("stem_a"), F.col("text").alias("a")).join(leads.select("key", F.col("stem").alias("stem_b"), F.col("text").alias("b")), "key").where("stem_a < stem_b")
    return equal.unionByName(pairs.select("key", "stem_a", "stem_b", F.when(alike("a", "b") >= ratio, "near").otherwise("other").alias("verdict")))


def _ratio(a: str, b: str, least: float) -> float:
    """Share of two texts that is common; 0 where cheap bounds show that it is below ``least``."""
    m = difflib.SequenceMatcher(None, a, b)
    return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0


def compared_copies(files: DataFrame, ratio: float = 0.98) -> DataFrame:
    """[Q13] Every file of a key with the best it is to any earlier one: (``key``, ``stem``, ``verdict``): first, equal, near or other."""
    rank = F.when(F.col("verdict") == "equal", 0).when(F.col("verdict") == "near", 1).otherwise(2)
    best = copy_pairs(files, ratio).groupBy("key", F.col("stem_b").alias("stem")).agg(F.min(rank).alias("rank"))
    told = F.when(F.col("rank").isNull(), "first").when(F.col("rank") == 0, "equal").when(F.col("rank") == 1, "near").otherwise("other")
    return files.select("key", "stem").distinct().join(best, ["key", "stem"], "left").select("key", "stem", told.alias("verdict"))


def located(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """[J21, Q8] Whether each quote stands on its page: ok, elsewhere (with the page), or missing.

    ``quotes``: (``id``, ``key``, ``page``, ``quote``); ``pages``: (``key``, ``page``, ``text``).
    """
    plain = _mapped(plain_quote, T.StringType())
    q = quotes.select("id", "key", "page", plain("quote").alias("q")).withColumn("w", F.split("q", " ")).where("q <> ''")
    p = pages.select("key", F.col("page").alias("there"), plain("text").alias("t"))
    # A quote of seven words or more meets the pages that hold five of its words in a row (not its first, which may be cut): no key's pages are all paired with its quotes.
    anchored = q.where("size(w) >= 7").withColumn("h", F.xxhash64(F.array_join(F.slice("w", 2, 5), " ")))
    words = F.split("t", " ")
    windows = p.where(F.size(words) >= 5).select("key", "there", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda k: F.xxhash64(F.array_join(F.slice(words, k, 5), " "))))).alias("h"))
    met = anchored.select("id", "key", "h").join(windows, ["key", "h"]).select("id", "key", "there").distinct()
    long = met.join(q.select("id", "page", "q"), "id").join(p, ["key", "there"])
    short = q.where("size(w) < 7").select("id", "key", "page", "q").join(p, "key")
    both = long.select("id", "page", "q", "there", "t").unionByName(short.select("id", "page", "q", "there", "t"))
    hits = both.where(F.contains("t", F.col("q"))).groupBy("id").agg(F.max((F.col("there") == F.col("page")).cast("int")).alias("here"), F.min("there").alias("there"))
    return quotes.join(hits, "id", "left").select("id", F.when(F.col("here") == 1, "ok").when(F.col("there").isNotNull(), "elsewhere").otherwise("missing").alias("verdict"), F.when(F.coalesce(F.col("here") == 0, F.lit(False)), F.col("there")).alias("found_on"))


def with_entities(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """[F15, P15, Q15] Fields that hold entities, each with its value decoded once: a repair plan (key, ``field``, ``before``, ``after``)."""
    decode = _mapped(html.unescape, T.StringType())
    x = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("before")) for f in fields])).alias("x")).select(key, "x.*").where(F.col("before").contains("&"))
    return x.withColumn("after", decode("before")).where("before <> after")


def quote_column(c: Column) -> Column:
    """[P21] See :func:`plain_quote`."""
    return _mapped(plain_quote, T.StringType())(c)


def rotated_column(c: Column) -> Column:
    """[P27] See :func:`rotated`."""
    return _mapped(rotated, T.BooleanType())(c)
