"""Repair of text from scanned pages.

Layout: running heads, feet, stamps and page numbers are told from text by where
they stand, by what repeats over the pages of a document and over documents, and
by numbers that go along with the pages. Words: a frequency lexicon of the whole
corpus is indexed by symmetric deletes over a folded form in which characters
that scanning confuses fall together; candidates are ranked by a weighted edit
distance with those confusions, by frequency and, where a misreading is a word
itself, by bigram context. Divided words are joined where the lexicon knows the
whole and not the compound.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scholion.session import checkpoint, looked_up

# What scanning confuses, right characters and misread ones, both ways.
CONFUSIONS = [("m", "rn"), ("w", "vv"), ("d", "cl"), ("n", "ii"), ("u", "ii"), ("ti", "d"), ("li", "h"), ("fi", "h"), ("c", "("), ("l", "1"), ("i", "1"), ("l", "i"), ("o", "0"), ("s", "5"), ("b", "8"), ("g", "9"), ("z", "2"), ("c", "e"), ("t", "f"), ("h", "b"), ("y", "v"), ("g", "q"), ("a", "u"), ("n", "u"), ("m", "in"), ("h", "li"), ("l", "|"), ("i", "!"), ("t", "l"), ("o", "c"), ("o", "e"), ("b", "6"), ("a", "o"), ("r", "n"), ("h", "n"), ("k", "lc"), ("f", "i"), ("ri", "n"), ("rt", "n"), ("nn", "mi")]
# Marks that divide a word at a line's end.
DIVIDERS = "-‐‑¬­"
_ROMAN = dict(zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000)))
_DIGITS = str.maketrans("lIiOoSsBZz|!", "111005582211")

#: Lines at either end of a page that can be furniture; documents in which a line must recur to be a stamp or journal.
EDGE, RECUR = 3, 4
#: The share of all numbers up to which a form like ``4o4`` is a misread number, though its number isn't found.
STRAY = 1 / 5000
#: How often a form must be found to count as a word; how many bigrams must speak for a right word where the read one is a word too.
WORD, EVIDENCE = 5, 10


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


_SAME = str.maketrans({"(": "c", "0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "9": "g", "2": "z", "|": "l", "!": "l", "i": "l"})
_GROUPS = (("lll", "m"), ("rn", "m"), ("ln", "m"), ("vv", "w"), ("ll", "n"), ("tl", "d"), ("cl", "d"), ("lh", "h"))
# The same with those first that the others would spoil.
_GROUPS_TOO = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("tl", "d"), ("ll", "n"))


@lru_cache(maxsize=200_000)
def level(word: str) -> str:
    """The form without accents in which digits and the letters they are taken for fall together."""
    return strip_accents(word).translate(_SAME)


@lru_cache(maxsize=200_000)
def fold(word: str, groups: tuple = _GROUPS) -> str:
    """As :func:`level`, with groups of characters that scanning takes for one."""
    w = level(word)
    for a, b in groups:
        w = w.replace(a, b)
    return w


_BLUR = str.maketrans("etfbhyvgquaonr", "cffhhvvqqaacnn")


@lru_cache(maxsize=200_000)
def blur(word: str) -> str:
    """As :func:`fold`, with all confusable letters in one class: for comparing lines."""
    return fold(word).translate(_BLUR)


def _key(form: str) -> int:
    return zlib.crc32(form.encode("utf-8", "replace")) << 8 | len(form) & 255


def deletes(word: str) -> list[int]:
    """Keys of the symmetric-delete index: a word's forms whole, and all but the first with one character less; as numbers, whatever a word's length."""
    out = {_key(fold(word))}
    for form in {level(word), fold(word, _GROUPS_TOO)}:
        out.add(_key(form))
        if len(form) > 2:
            out.update(_key(form[:i] + form[i + 1 :]) for i in range(len(form)))
    return list(out)


_PAIRS = {(a, b): 0.3 for x, y in CONFUSIONS for a, b in ((x, y), (y, x))}


@lru_cache(maxsize=200_000)
def distance(read: str, right: str, most: float = 1.3) -> float:
    """Weighted edit distance: a confusion or a stray accent costs 0.3, any other edit 1."""
    if abs(len(read) - len(right)) > 3:
        return 9.0
    # Equal ends cost nothing; a character of them is kept, for groups that reach into it.
    short = min(len(read), len(right))
    k = next((i for i in range(short) if read[i] != right[i]), short)
    read, right = read[max(0, k - 1) :], right[max(0, k - 1) :]
    short = min(len(read), len(right)) - 1
    k = next((i for i in range(short) if read[-1 - i] != right[-1 - i]), max(0, short))
    if k > 1:
        read, right = read[: 1 - k], right[: 1 - k]
    n, m = len(read), len(right)
    rows = [[9.0] * (m + 1) for _ in range(n + 1)]
    rows[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            best = rows[i][j]
            if i and j:
                a, b = read[i - 1], right[j - 1]
                cost = 0.0 if a == b else 0.3 if strip_accents(a) == strip_accents(b) else _PAIRS.get((a, b), 1.0)
                best = min(best, rows[i - 1][j - 1] + cost)
            if i:
                best = min(best, rows[i - 1][j] + 1)
            if j:
                best = min(best, rows[i][j - 1] + 1)
            for p, q in ((1, 2), (2, 1), (2, 2)):
                if i >= p and j >= q and (read[i - p : i], right[j - q : j]) in _PAIRS:
                    best = min(best, rows[i - p][j - q] + 0.3)
            rows[i][j] = best
        if min(rows[i]) > most:
            return 9.0
    return rows[n][m]


def units(text: str) -> list[str]:
    """Words of a line in lower case: marks around them and dividing hyphens left out."""
    out = []
    for token in text.split():
        token = token.strip("\"'“”„«»‘’.,;:!?%*…")
        if token.isalpha():
            if len(token) > 1:
                out.append(token.lower())
            continue
        for x in re.split(r"[-‐‑–—/=]+", token):
            if "(" in x and ")" in x:
                parts = re.split(r"[()]+", x)
            elif "(" in x and re.search(r"[^\W\d_]\(|\([^\W\d_]", x) and not x.startswith("(") or x.startswith("(") and len(x) > 5:
                parts = [x, x[1:]] if x.startswith("(") else [x]
                parts = parts[:1] if not x.startswith("(") else parts
            else:
                parts = [x.strip("()[]{}")]
            out += [p.lower() for p in (y.strip("\"'“”.,;:!?%*…[]{})­¬") for y in parts) if len(p) > 1 and re.search(r"[^\W\d_]", p)]
    return out


def skeleton(line: str) -> str:
    """A line's letters in folded form, without numbers: what running heads and stamps have in common."""
    bare = re.sub(r"\b[\dlIOoS]*\d[\dlIOoS]*\b|\d+", " ", line)
    letters = re.sub(r"(?<=[^\W\d_])\((?=[^\W\d_])", "c", bare)
    return blur(re.sub(r"[\W_]+", "", letters).lower())


def _edges(lines: list[str]) -> list[int]:
    filled = [i for i, x in enumerate(lines) if x.strip()]
    return sorted({*filled[:EDGE], *filled[-EDGE:]})


# What a page number is called.
_PAGE_WORDS = {blur(w) for w in ("page", "seite", "pag.", "pagina", "página", "p.")}


def _roman(s: str) -> int | None:
    if not s or any(c not in _ROMAN for c in s):
        return None
    v = [_ROMAN[c] for c in s]
    return sum(-x if y > x else x for x, y in zip(v, [*v[1:], 0]))


def numbers_in(line: str) -> set[int]:
    """Numbers that a line of nothing but a number can stand for, misread or roman ones too."""
    s = re.sub(r"^[\W_]+|[\W_]+$", "", line.strip())
    out = set()
    if re.fullmatch(r"[\dlIiOoSsBZz|!]{1,5}", s):
        out.add(int(s.translate(_DIGITS)))
    r = _roman(s.lower().replace("1", "l").replace("j", "i"))
    if r and len(s) <= 9:
        out.add(r)
    r = _roman(s.lower().replace("1", "i").replace("l", "i")) if re.fullmatch(r"[ivxlc1]+", s.lower()) else None
    if r:
        out.add(r)
    return out


def _loose(line: str) -> set[int]:
    """Numbers at either end of a line of words."""
    return {int(x.translate(_DIGITS)) for x in re.findall(r"^\s*([\dlIO]{1,5})(?=\s{2,})|(?<=\s\s)([\dlIO]{1,5})\s*$", line) for x in x if x and any(c.isdigit() for c in x)}


def layout(pages: list[tuple[int, int, str, set[int], set[int]]]) -> dict[tuple[int, int], bool]:
    """Which lines of one document are furniture; pages are (page_id, page, text, lines known as stamps, lines that other pages have as text), in order."""
    split = [(pid, no, text.split("\n"), known, prose) for pid, no, text, known, prose in pages]
    edges = {pid: _edges(lines) for pid, _, lines, _, _ in split}
    n = len(split)
    seen: Counter = Counter()
    offsets: Counter = Counter()
    for pid, no, lines, _, _ in split:
        seen.update({skeleton(lines[i]) for i in edges[pid]})
        ends = {*edges[pid][:2], *edges[pid][-2:]}
        offsets.update({v - no for i in ends for v in numbers_in(lines[i])} | {v - no for i in ends for v in _loose(lines[i])})
    top = offsets.most_common(1)[0] if offsets else (None, 0)
    steady = top[0] if top[1] >= max(2, 0.4 * n) else None
    common = {skeleton(lines[i - 1]) for _, _, lines, _, prose in split for i in prose}
    stamps = {skeleton(lines[i - 1]) for _, _, lines, known, _ in split for i in known}
    heads = [s for s, k in seen.items() if len(s) >= 5 and (k >= 2 and k >= 0.15 * n and s not in common or s in stamps)]
    out: dict[tuple[int, int], bool] = {}
    for k, (pid, no, lines, known, prose) in enumerate(split):
        spots = edges[pid]
        for i in spots:
            line, s = lines[i], skeleton(lines[i])
            numbers = numbers_in(line)
            at_end = i in spots[:2] or i in spots[-2:]
            found = False
            if numbers and at_end and len(line.strip()) <= 14:
                decorated = bool(re.search(r"^\s*[-–—\[(|~=*·•].*\d|^\s*[-–—\[(|~=*·•]\s*[ivxlc]+\b", line))
                fits = steady is not None and any(v - no == steady for v in numbers)
                last = i == spots[-1] or i == spots[0]
                lonely = not any(numbers_in(lines[j]) and len(lines[j].split()) == 1 for j in (i - 1, i + 1) if 0 <= j < len(lines))
                found = fits or decorated or last and lonely and not re.search(r"\.\d", line)
            elif (m := re.fullmatch(r"\W*([^\W\d_]+\.?)\s*[\dlIO]+(?:\s*(?:[^\W\d_]\w{1,2}|0\w|de|/)\s*[\dlIO]+)?\W*", line.strip())) and blur(m[1].lower()) in _PAGE_WORDS:
                found = True
            elif at_end and s:
                caption = re.match(r"\s*(?:Table|Figure|Tab|Fig|Abb|[\dlI]+\.)\w*\.?\s", line) and not (steady is not None and any(v - no == steady for v in _loose(line)))
                same = next((h for h in heads if h == s or len(h) >= 8 and abs(len(h) - len(s)) <= 3 and _close(h, s)), None)
                paged = steady is not None and any(v - no == steady for v in _loose(line))
                found = not caption and (i + 1 not in prose or paged) and (same is not None or i + 1 in known or paged)
            if found:
                out[(pid, i + 1)] = True
        # The document's own title at the start is text, though it runs on as a head.
        if k == 0:
            for i in [x for x in spots[:EDGE] if (pid, x + 1) in out]:
                if _is_title(lines, i, seen) and not numbers_in(lines[i]):
                    out.pop((pid, i + 1))
    return out


def _close(a: str, b: str) -> bool:
    """Whether two skeletons differ in few characters."""
    most = max(2, len(a) // 6)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def _is_title(lines: list[str], i: int, seen: Counter) -> bool:
    """A line in mixed case at the start, alone in its form: not a head that other pages carry as well."""
    line = lines[i].strip()
    return seen[skeleton(line)] <= 1 and not re.search(r"\s{3,}|\d{3,}|\bet al\b|:\s|\(\d{4}\)", line) and not line.isupper() and any(c.islower() for c in line) and bool(re.search(r"^[^\W\d_a-z]", line))


LINE = T.StructType([T.StructField(n, t) for n, t in (("doc", T.StringType()), ("page_id", T.LongType()), ("line_no", T.LongType()), ("seq", T.LongType()), ("furniture", T.BooleanType()), ("text", T.StringType()), ("words", T.ArrayType(T.StringType())), ("tail", T.StringType()), ("divider", T.StringType()), ("continued", T.BooleanType()), ("first", T.StringType()), ("next_page", T.LongType()), ("next_line", T.LongType()))])
_TAIL = re.compile(rf"([^\W\d_][\w()]*)([{DIVIDERS}]?)$")
_HEAD = re.compile(r"\s*([^\W_][\w()]*)")
_FIRST = re.compile(r"[^\W_(]*(?:\([^\W_(]*)*")


def document_lines(pages: pd.DataFrame, roles: pd.DataFrame) -> pd.DataFrame:
    """All lines of one document (at most some dozen pages), each with its words, what it ends with, and what the next text line begins with."""
    if not len(pages):
        return pd.DataFrame(columns=[f.name for f in LINE])
    pages = pages.sort_values(["page", "page_id"]).drop_duplicates("page_id")
    known: dict[tuple[int, str], set[int]] = {}
    for pid, no, role in roles[["page_id", "line_no", "role"]].itertuples(index=False):
        known.setdefault((pid, role), set()).add(int(no))
    split = [(int(pid), int(no), text, known.get((pid, "stamp"), set()), known.get((pid, "prose"), set())) for pid, no, text in pages[["page_id", "page", "text"]].itertuples(index=False)]
    furniture = layout(split)
    doc, out, seq, last = pages["doc"].iloc[0], [], 0, None
    for pid, _, text, _, _ in split:
        for i, line in enumerate(text.split("\n"), 1):
            seq += 1
            if (pid, i) in furniture or not line.strip():
                out.append([doc, pid, i, seq, (pid, i) in furniture, line, [], None, None, False, "", None, None])
                continue
            m = _TAIL.search(line.rstrip())
            row = [doc, pid, i, seq, False, line, units(line), m[1].lower() if m else None, m[2] if m else None, False, "", None, None]
            # The line before goes on here.
            if last is not None:
                h = _HEAD.match(line)
                last[-3:] = [_FIRST.match(h[1])[0] if h else "", pid, i]
                row[9] = bool(last[8])
            out.append(row)
            last = row
    return pd.DataFrame(out, columns=[f.name for f in LINE]).astype({"next_page": "Int64", "next_line": "Int64"})


def read_lines(raw_pages: DataFrame, recur: int = RECUR) -> DataFrame:
    """Every line of every page with its part in the layout; see :data:`LINE`."""
    p = raw_pages.select(F.coalesce("doc", F.concat(F.lit("\0"), F.col("page_id").cast("string"))).alias("doc"), "page_id", F.coalesce("page", F.lit(0)).cast("int").alias("page"), "text").where("page_id is not null and text is not null")
    filled = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), x.alias("line"))), lambda x: F.trim(x["line"]) != "")
    every = p.select("doc", "page_id", F.posexplode(filled).alias("pos", "x"), F.size(filled).alias("n"))
    # What recurs in a line: its letters, without names in lines of small letters, so that stamps for different readers meet.
    named = F.regexp_replace("x.line", r"(?<=\s)\p{Lu}[\p{L}'’]*(?=\s)", " ")
    mask = F.lower(F.regexp_replace(F.when(F.col("x.line").rlike(r"\p{Ll}{3}.*\p{Ll}{3}"), named).otherwise(F.col("x.line")), r"[^\p{L}]+", ""))
    # Read twice, so kept: a hash and a place a line.
    masked = checkpoint(every.select("doc", "page_id", "x.line_no", ((F.col("pos") < EDGE) | (F.col("pos") >= F.col("n") - EDGE)).alias("edge"), mask.alias("mask")).where(F.length("mask") >= 8).select("doc", "page_id", "line_no", "edge", F.xxhash64("mask").alias("h")))
    # Partial counts by document first, so that a mask most pages share is no hot key.
    by_doc = masked.groupBy("h", "doc").agg(F.count_if("edge").alias("at_edge"), F.count_if(~F.col("edge")).alias("inside"))
    counts = by_doc.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.sum("at_edge").alias("at_edge"), F.sum("inside").alias("inside")).where("at_edge > 0")
    role = F.when((F.col("docs") >= recur) & (F.col("at_edge") >= 9 * F.col("inside")), "stamp").when(F.col("inside") >= 2, "prose")
    roles = checkpoint(counts.select("h", role.alias("role")).where("role is not null"))
    judged = looked_up(masked.where("edge").select("doc", "page_id", "line_no", "h"), roles, "h", "inner").select("doc", "page_id", "line_no", "role")
    # Pages and what is known of their lines meet by document: the text is shuffled once.
    return p.groupBy("doc").cogroup(judged.groupBy("doc")).applyInPandas(document_lines, LINE)


def _keys_udf():
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(word: pd.Series) -> pd.Series:
        return word.map(deletes)

    return keys


def _distance_udf():
    @F.pandas_udf(T.DoubleType())
    def far(read: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([distance(a, b) for a, b in zip(read, right)])

    return far


def corrections(lexicon: DataFrame, most: float = 0.95, numbers: DataFrame | None = None, margin: float = 0.3) -> DataFrame:
    """(``word``, ``right``, ``sure``, ``rivals``): misread words with the words they may stand for, from a lexicon (``word``, ``n``).

    Sure ones are too rare beside the right word to be words of their own; the
    others need context, and so does the choice where ``rivals``, the words that
    cost at most ``margin`` more than the cheapest, are several. ``place`` orders
    them by cost and frequency. ``numbers`` (``word``, ``n``) counts numbers as they
    are rightly read: a form is a misread number if it takes a small share of its
    number's occurrences, or of all numbers where that one isn't found.
    """
    keyed = lexicon.where(F.length("word") >= 2).select("word", "n", F.explode(_keys_udf()("word")).alias("key"))
    right = keyed.where((F.col("n") >= 3) & ~F.col("word").rlike(r"[\d(|!]")).select(F.col("word").alias("right"), F.col("n").alias("right_n"), "key")
    pairs = keyed.hint("merge").join(right, "key").where((F.col("word") != F.col("right")) & (F.col("right_n") > F.col("n")) & (F.abs(F.length("word") - F.length("right")) <= 2)).select("word", "n", "right", "right_n").distinct()
    odd = F.col("word").rlike(r"\p{L}[\d(|!]|[\d(|!]\p{L}")
    # A misreading takes a small share of its word's occurrences; digits among letters give it away.
    sure = odd | (F.col("n") <= F.lit(2) + F.col("right_n") * 0.02)
    worth = sure | (F.col("n") <= F.col("right_n") * 0.3)
    # Weighed only where the frequencies leave it open.
    near = pairs.where(worth & (~odd | (F.col("n") <= F.lit(3) + F.col("right_n") * 0.1))).withColumn("sure", sure).withColumn("cost", _distance_udf()("word", "right")).where(F.col("cost") <= most)
    near = near.where((F.length("word") > 2) | odd)
    # A word's candidates are few: they share nearly all of its letters.
    ranked = near.groupBy("word").agg(F.array_sort(F.collect_set(F.struct("cost", (-F.col("right_n")).alias("order"), "right", "sure"))).alias("c"))
    kept = F.filter("c", lambda x: x["cost"] <= F.element_at("c", 1)["cost"] + margin)
    best = ranked.withColumn("c", kept).select("word", F.posexplode("c").alias("place", "x"), F.size("c").alias("rivals")).select("word", "x.right", F.col("x.sure").alias("sure"), "rivals", "place")
    # Numbers with letters among their digits that digits are taken for.
    number = F.translate("word", "lioszb|!", "11052811")
    figures = lexicon.where(F.col("word").rlike(r"^[\dliosb|!]*\d[\dliosb|!]*(?:[.,][\dliosb|!]+)?$|^[liosb|!]+[.,][liosb|!]*\d[\dliosb|!]*$") & F.col("word").rlike(r"[liosb|!]") & (F.length("word") >= 3)).select("word", "n", number.alias("right"))
    if numbers is not None:
        # Shares only, so that a form is judged alike whatever the size of the corpus.
        every = numbers.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        figures = figures.hint("merge").join(numbers.select(F.col("word").alias("right"), F.col("n").alias("right_n")), "right", "left").where(F.col("n") <= 2 + F.coalesce("right_n", F.lit(0)) * 0.3 + every * STRAY)
    figures = figures.select("word", "right", F.lit(True).alias("sure"), F.lit(1).alias("rivals"), F.lit(0).alias("place"))
    return best.unionByName(figures.hint("merge").join(best.select("word"), "word", "left_anti"))


def paragraphs(raw_pages: DataFrame) -> DataFrame:
    """(``doc``, ``paragraph``, ``text``): continuous text across pages, furniture out, words joined and corrected.

    A blank line or an indented one begins a paragraph, unless a word goes on
    over it; so does a heading, caption or row of figures. Nulls and empty
    tables as in :func:`repairs`.
    """
    lines = checkpoint(read_lines(raw_pages))
    fixes = _repairs(lines).where("kind <> 'furniture'").groupBy("page_id", "line_no").agg(F.collect_set(F.when(F.col("kind") == "misread", F.struct("word", "right"))).alias("swaps"), F.max(F.col("kind") == "broken").alias("broken"))
    x = lines.where("not furniture").select("doc", "page_id", "line_no", "seq", "text").hint("merge").join(fixes, ["page_id", "line_no"], "left")
    return x.groupBy("doc").applyInPandas(_join_document, "doc string, paragraph int, text string")


def _join_document(group: pd.DataFrame) -> pd.DataFrame:
    """Paragraphs of one document from its lines."""
    out: list[str] = []
    blank, broken = True, False
    for text, swaps, goes_on in group.sort_values("seq")[["text", "swaps", "broken"]].itertuples(index=False):
        line = text.rstrip()
        if not line.strip():
            blank = blank or not broken
            continue
        for s in swaps if swaps is not None else []:
            line = re.sub(rf"(?<![^\W\d_]){re.escape(s['word'])}(?![^\W\d_])", lambda m, r=s["right"]: r.capitalize() if m[0][:1].isupper() else r, line, flags=re.I)
        apart = blank or line.startswith("  ") or bool(re.match(r"\s*(?:(?:Table|Figure)\s+\d|\d+\.\s+\S+$|[\d.,\s]+$)", line)) or bool(out) and bool(re.match(r"(?:(?:Table|Figure)\s+\d+\.|\d+\.\s+\S+$|[\d.,\s]+$)", out[-1]))
        if out and broken:
            out[-1] += line.strip()
        elif out and (not apart or line.lstrip()[0].islower() and not re.search(r"[.!?:]$|^(?:Table|Figure)\s+\d", out[-1]) and not line.startswith("  ")):
            out[-1] += ("" if out[-1].endswith("-") else " ") + line.strip()
        else:
            out.append(line.strip())
        broken = goes_on is not None and goes_on == True  # noqa: E712  # may be null
        if broken:
            out[-1] = re.sub(rf"[{DIVIDERS}]\s*$", "", out[-1])
        blank = False
    return pd.DataFrame({"doc": [group["doc"].iloc[0]] * len(out), "paragraph": range(1, len(out) + 1), "text": out})


def repairs(raw_pages: DataFrame) -> DataFrame:
    """Lines of pages with what has to be done: (``page_id``, ``line_no``, ``kind``, ``word``, ``right``).

    ``furniture`` lines go; ``broken`` lines' last word (``word``) goes on in the
    next text line (``right`` is the whole); ``misread`` words are replaced.

    Null texts and ids give no row, empty texts have no lines to repair. A page
    repeated under its id counts once. A page without ``doc`` is a document of
    its own. Empty tables give no row; other columns are ignored.
    """
    return _repairs(checkpoint(read_lines(raw_pages)))


def _repairs(lines: DataFrame) -> DataFrame:
    """:func:`repairs` of lines that were read and kept."""
    text = lines.where("not furniture and trim(text) <> ''")
    words = text.select("page_id", "line_no", F.posexplode("words").alias("at", "word"), F.size("words").alias("size"), (F.length("divider") > 0).alias("divided"), "continued")
    whole = words.where(~((F.col("at") == F.col("size") - 1) & F.coalesce("divided", F.lit(False))) & ~((F.col("at") == 0) & F.col("continued")))
    lexicon = checkpoint(whole.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    # Compounds as they stand within lines.
    compounds = text.where(F.contains("text", F.lit("-"))).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\d])(\p{L}[\p{L}\d()]*-\p{L}[\p{L}\d()]*)(?=[\s.,;:)])"), 1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    numbers = checkpoint(text.where(F.col("text").rlike(r"\d")).select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\d.,|!])(\d+(?:[.,]\d+)?)(?![\p{L}\d|!])"), 1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    right_of = checkpoint(corrections(lexicon, numbers=numbers))
    best_of = right_of.where("place = 0")

    ends = text.where(F.col("tail").isNotNull() & (F.length("first") > 0) & (F.length("tail") >= 1)).select("page_id", "line_no", "next_page", "next_line", "tail", "divider", "first", F.concat("tail", F.lower("first")).alias("joined"), F.concat("tail", F.lit("-"), F.lower("first")).alias("compound"))
    # Distinct forms of line ends are looked up once each, all in one table of counts.
    counts = lexicon.select("word", "n", F.lit(0).alias("k")).unionByName(compounds.select("word", "n", F.lit(1).alias("k")))
    asked = ends.select(F.explode(F.array(F.struct(F.col("joined").alias("word"), F.lit(0).alias("k")), F.struct(F.col("tail").alias("word"), F.lit(0).alias("k")), F.struct(F.lower("first").alias("word"), F.lit(0).alias("k")), F.struct(F.col("compound").alias("word"), F.lit(1).alias("k")))).alias("x")).select("x.*").distinct()
    found = checkpoint(asked.hint("merge").join(counts, ["word", "k"]).withColumn("h", F.xxhash64("word", "k")).select("h", "n"))
    tried = ends
    for name, col, k in (("whole_n", F.col("joined"), 0), ("compound_n", F.col("compound"), 1), ("tail_n", F.col("tail"), 0), ("first_n", F.lower("first"), 0)):
        tried = looked_up(tried.withColumn("h", F.xxhash64(col, F.lit(k))), found.withColumnRenamed("n", name), "h", "left").drop("h")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    lower_first = F.col("first").rlike(r"^[\p{Ll}\d(]") | (F.upper("first") == F.col("first"))
    both_words = (n("tail_n") >= WORD) & (n("first_n") >= WORD)
    by_mark = (F.length("divider") > 0) & lower_first & (F.col("first").rlike(r"^\P{N}")) & (((n("whole_n") > 0) & (n("whole_n") >= n("compound_n"))) | ((n("compound_n") == 0) & (n("whole_n") == 0) & (~both_words | (F.col("divider") != "-"))))
    no_mark = (F.length("divider") == 0) & F.col("first").rlike(r"^\p{Ll}") & (n("whole_n") >= 3) & (n("tail_n") <= 1 + n("whole_n") * 0.05) & (n("first_n") <= 2 + n("whole_n") * 0.5) & (F.length("tail") >= 2)
    broken = checkpoint(tried.where(by_mark | no_mark).select("page_id", "line_no", "next_page", "next_line", "tail", "first", "joined"))

    # Misread words: those within lines, and those divided over two, by where the fault lies.
    around = text.select("page_id", "line_no", F.posexplode("words").alias("at", "word"), F.col("words").alias("line")).select("page_id", "line_no", "at", "word", F.expr("get(line, at - 1)").alias("before"), F.expr("get(line, at + 1)").alias("after"))
    within = checkpoint(looked_up(around, right_of, "word", "inner"))
    plain = within.where("sure and rivals = 1").select("page_id", "line_no", "at", "word", "right")
    open_ = within.where("not sure or rivals > 1")
    # Bigrams of the words in question, read and right ones, with either neighbour; counted for those neighbours only.
    forms = open_.select("before", "after", F.explode(F.array("word", "right")).alias("form"))
    pair = lambda a, b, side: F.xxhash64(a, b, F.lit(side))
    wanted = checkpoint(forms.select(F.explode(F.array(pair("before", "form", 0), pair("form", "after", 1))).alias("h")).distinct())
    met = around.select(F.explode(F.array_compact(F.array(F.when(F.col("before").isNotNull(), pair("before", "word", 0)), F.when(F.col("after").isNotNull(), pair("word", "after", 1))))).alias("h"))
    bigrams = checkpoint(looked_up(met, wanted, "h", "inner").groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    r = open_
    for name, h in (("lw", pair("before", "word", 0)), ("rw", pair("word", "after", 1)), ("lc", pair("before", "right", 0)), ("rc", pair("right", "after", 1))):
        r = looked_up(r.withColumn("h", h), bigrams.withColumnRenamed("n", name), "h", "left").drop("h")
    right_n, read_n = n("lc") + n("rc"), n("lw") + n("rw")
    # Context decides whether an open one is a misreading, and which of several words it stands for.
    fits = (F.col("sure")) | ((right_n >= EVIDENCE) & (right_n >= 20 * (read_n - 1)))
    chosen = r.where(fits).groupBy("page_id", "line_no", "at", "word").agg(F.max_by("right", F.struct(right_n, -F.col("place"))).alias("right"))
    parts = broken.select("page_id", "line_no", "next_page", "next_line", "tail", "joined")
    parts = looked_up(parts, best_of.select(F.col("word").alias("joined"), F.col("right").alias("joined_right")), "joined", "inner")
    in_tail = ~F.col("joined_right").startswith(F.col("tail"))
    divided = parts.select(F.when(in_tail, F.col("page_id")).otherwise(F.col("next_page")).alias("page_id"), F.when(in_tail, F.col("line_no")).otherwise(F.col("next_line")).alias("line_no"), F.lit(-1).alias("at"), F.col("joined").alias("word"), F.col("joined_right").alias("right"))
    # Fragments beside a division aren't words and are judged with their whole only.
    cut = broken.select("page_id", "line_no", F.col("tail").alias("word")).unionByName(broken.select(F.col("next_page").alias("page_id"), F.col("next_line").alias("line_no"), F.lower("first").alias("word")))
    misread = plain.unionByName(chosen).hint("merge").join(cut, ["page_id", "line_no", "word"], "left_anti").unionByName(divided)
    return (
        lines.where("furniture").select("page_id", "line_no", F.lit("furniture").alias("kind"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("right"))
        .unionByName(broken.select("page_id", "line_no", F.lit("broken").alias("kind"), F.col("tail").alias("word"), F.col("joined").alias("right")))
        .unionByName(misread.select("page_id", "line_no", F.lit("misread").alias("kind"), "word", "right"))
    )
