"""Evaluation passages inside training text, by spaced seeds.

Items and documents become sequences of normalised words. Fixed masks pick some
of the words of a short window and ignore the others, so that a misspelled word
spoils only the seeds that look at it. Seeds of the items are joined to those of
the documents; every hit names an alignment, which is then verified word by
word: equal words and misspelled ones count, anything else ends the overlap.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.session import spread

#: The places of a window that each mask looks at.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 4, 5), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 2, 4, 5, 7))
_MIX = np.uint64(0x9E3779B97F4A7C15)


_hyphenated = re.compile(r"(?<=[^\W\d])[-‐‑¬\u00ad][^\S\n]*\n\s*(?=[^\W\d])")
_mark = re.compile(r"[^\w\s]+|_+")


def words(text: str) -> list[str]:
    """Words without case, layout and punctuation; marks inside a word vanish."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "\n" in text:
        text = _hyphenated.sub("", text)
    return _mark.sub("", text.lower()).split()


@lru_cache(maxsize=100_000)
def misspelled(a: str, b: str) -> bool:
    """Whether one word is the other with a letter or two wrong; words with digits are never misspelled ones."""
    n, m = len(a), len(b)
    most = 1 if max(n, m) < 6 else 2
    # An edit changes at most two of the letters in use.
    if abs(n - m) > 2 or max(n, m) < 3 or len(set(a) ^ set(b)) > 2 * most or any(c.isdigit() for c in a + b):
        return False
    before, row = None, list(range(m + 1))
    for i in range(1, n + 1):
        last, row, prior = row, [i] + [0] * m, before
        for j in range(1, m + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if prior is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], prior[j - 2] + 1)
        before = last
        if min(row) > most:
            return False
    return row[m] <= most


class SeedIndex:
    """Seeds of a block of items, ready to be probed with whole documents."""

    def __init__(self, items: list[tuple[int, str]], common: set[str]):
        self.ids, self.words, self.question = [], [], []
        for i, text in items:
            lines = [x for x in (text or "").split("\n") if x.strip()]
            # An instruction opens the item; the question at its end may have a label.
            lines = lines[1:] if len(lines) > 2 and lines[0].strip() in common else lines
            parts = [words(x if k + 1 < len(lines) else re.sub(r"^\s*\w{1,12}:", "", x)) for k, x in enumerate(lines)]
            self.ids.append(i)
            self.words.append([w for p in parts for w in p])
            self.question.append(len(parts[-1]) if len(parts) > 1 else 0)
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for x in self.words for w in x}))}
        self.codes = [np.array([self.vocabulary[w] for w in x], dtype=np.int64) for x in self.words]
        self.seeds = []
        for mask in MASKS:
            keys, at = [], []
            for k, c in enumerate(self.codes):
                h, _ = self._hash(c, mask)
                keys.append(h)
                at.append(np.stack([np.full(len(h), k), np.arange(len(h))], 1) if len(h) else np.zeros((0, 2), dtype=np.int64))
            keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
            order = np.argsort(keys, kind="stable")
            self.seeds.append((keys[order], np.concatenate(at)[order] if at else np.zeros((0, 2), dtype=np.int64)))

    @staticmethod
    def _hash(codes: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        n = len(codes) - mask[-1]
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        h, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
        for p in mask:
            c = codes[p : p + n]
            known &= c >= 0
            h = (h ^ (c + 1).astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
        return h, known

    def alignments(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(place, item, place in the item) of every seed hit."""
        found = []
        for mask, (keys, at) in zip(MASKS, self.seeds):
            h, known = self._hash(codes, mask)
            spots = np.nonzero(known)[0]
            if not len(spots) or not len(keys):
                continue
            lo = np.searchsorted(keys, h[spots], "left")
            there = keys[np.minimum(lo, len(keys) - 1)] == h[spots]
            spots, lo = spots[there], lo[there]
            hi = np.searchsorted(keys, h[spots], "right")
            for p, a, b in zip(spots.tolist(), lo.tolist(), hi.tolist()):
                found += [(p, k, q) for k, q in at[a:b].tolist()]
        return found

    def overlaps(self, texts: list[str], least: int) -> list[list[tuple[int, int]]]:
        """For each text the items that it holds, each with the words of its longest overlap.

        Texts are hashed together, with gaps between them that no seed spans.
        """
        gap = max(m[-1] for m in MASKS) + 1
        docs = [words(t) for t in texts]
        get, flat, starts = self.vocabulary.get, [], []
        for d in docs:
            starts.append(len(flat))
            flat += [get(w, -1) for w in d]
            flat += [-1] * gap
        every = np.array(flat, dtype=np.int64)
        places = np.array(starts, dtype=np.int64)
        hits: dict[int, dict[int, set[int]]] = {}
        found = self.alignments(every)
        owners = (np.searchsorted(places, np.array([p for p, _, _ in found], dtype=np.int64), "right") - 1).tolist() if found else []
        for i, (p, k, q) in zip(owners, found):
            hits.setdefault(i, {}).setdefault(k, set()).add(p - starts[i] - q)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for i, by_item in hits.items():
            doc, codes = docs[i], every[starts[i] : starts[i] + len(docs[i])]
            for k, shifts in by_item.items():
                runs = [r for s in shifts for r in self._runs(doc, codes, k, s)]
                best, q, n = self._chain(runs), self.question[k], len(self.words[k])
                whole = q and any(b - a >= q and a - s <= n - q and b - s >= n for a, b, s in runs)
                if best >= min(least, n) or whole:
                    out[i].append((self.ids[k], best))
        return out

    def _runs(self, doc: list[str], codes: np.ndarray, k: int, shift: int) -> list[tuple[int, int, int]]:
        own, item = self.codes[k], self.words[k]
        a, b = max(0, shift), min(len(codes), shift + len(own))
        same = codes[a:b] == own[a - shift : b - shift]
        runs, start, wrong = [], None, 0
        for p in range(a, b + 1):
            if p < b and same[p - a]:
                start = p if start is None else start
                wrong = 0
            elif p < b and start is not None and wrong < 2 and misspelled(doc[p], item[p - shift]):
                wrong += 1
            elif start is not None:
                if p - wrong - start >= 4:
                    runs.append((start, p - wrong if p == b or wrong > 1 else p, shift))
                start, wrong = None, 0
        return runs

    @staticmethod
    def _chain(runs: list[tuple[int, int, int]]) -> int:
        """Words in the longest overlap, where a word divided or joined may move the alignment by a place or two."""
        best, ends = 0, []
        for a, b, s in sorted(set(runs)):
            n = b - a
            n += max((m for e, t, m in ends if -1 <= a - e <= 2 and abs(t - s) <= 2 and t != s), default=0)
            ends.append((b, s, n))
            best = max(best, n)
        return best


def leaks(documents: DataFrame, items: DataFrame, least: int = 14, block_words: int = 400_000, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold a passage of an item: (``doc_id``, ``item_id``, ``n_words``).

    ``least`` words in a row (about fifteen) count as a leak, fewer only where they are the
    whole question or item. A line that opens items of three lines or more with
    different lines behind it is an instruction and never counts; a passage that
    several questions share does. The items' seeds are sent to the executors in
    blocks of about ``block_words`` words, so what is broadcast has a bound
    whatever the number of items; each block is matched with all documents.

    Null or empty texts on either side, and empty tables, give no row. Repeated
    rows with one id give one row. Other columns are ignored.
    """
    spark = documents.sparkSession
    own = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    size = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 6
    blocks = max(1, -(-size // block_words))
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")
    opening = own.select(lines.alias("lines")).where("size(lines) > 2").select(F.col("lines")[0].alias("line"), F.xxhash64(F.col("lines")[1]).alias("behind"))
    shared = opening.groupBy("line").agg(F.count_distinct("behind").alias("n")).where("n > 1")
    # Only those that open items of a block are fetched with it.
    d = spread(documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null"))
    parts = []
    for k in range(blocks):
        block = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else own
        common = {r["line"] for r in shared.join(block.select(lines.alias("lines")).select(F.try_element_at("lines", F.lit(1)).alias("line")), "line", "left_semi").toLocalIterator()}
        index = spark.sparkContext.broadcast(SeedIndex(sorted({(r["item_id"], r["text"]) for r in block.toLocalIterator()}), common))

        def match(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids, texts, out = b["doc_id"].tolist(), b["text"].tolist(), []
                for at in range(0, len(ids), 256):
                    out += [(i, k, n) for i, found in zip(ids[at : at + 256], index.value.overlaps(texts[at : at + 256], least)) for k, n in found]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words"])

        parts.append(d.mapInPandas(match, "doc_id bigint, item_id bigint, n_words int"))
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    return all_parts.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
