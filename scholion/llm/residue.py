"""Template residue and error-page text.

Records of one template agree in the words around a slot and differ in what
fills it. A first pass lists what may have been left in a slot: names between
the delimiters of template languages, names by shape alone (capitals or words
joined by underscores, other marks around a word), and blanks, each with its
frame: the words before and behind it in its line. A second pass aligns all
records on those frames and lists the values that stand there. A frame whose
values differ from text to text is an induced slot, and a name or blank in it was
left unfilled. A delimited name is open too where no frame shows it to be
ordinary text (the frame's constant in nearly all of at least ``fixed_min``
distinct texts). Whole-page messages are segments that recur, numbers and codes
masked, on pages that hold nothing else but a title and navigation.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.session import checkpoint, spread

NAME = r"[^\W\d_](?:[\w .-]{0,38}\w)?"
# The delimiters that mark a variable in common template languages.
SLOT = (
    rf"\{{\{{\s*{NAME}\s*\}}\}}|\{{%\s*{NAME}\s*%\}}|<%=?\s*{NAME}\s*%>|[$#]\{{\s*{NAME}\s*\}}|\[\[\s*{NAME}\s*\]\]|@@\s*{NAME}\s*@@"
    rf"|__{NAME}?[^\W_]__|%{NAME}%|<{NAME}>|«\s*{NAME}\s*»|<<\s*{NAME}\s*>>|\[(?:INSERT|ENTER|YOUR|ADD) {NAME}\]|\[{NAME} (?:HERE|GOES HERE)\]"
)
# Default contents that authoring tools leave in a field.
DEFAULTS = (
    r"(?:type|insert|enter|write|put|add) (?:the|your|an?) [\w ]{1,30} here|(?:text|content|abstract|details?) to (?:follow|come)|(?:content |abstract |text )?coming soon"
    r"|(?:blind|muster|platzhalter|beispiel)text(?:,? [\w ]{1,30})?|texto? de (?:relleno|ejemplo|muestra)(?:,? [\w ]{1,30})?|texte (?:factice|de remplissage|à venir)(?:,? [\w ]{1,30})?"
    r"|(?:placeholder|dummy|sample|filler) text(?:,? (?:goes|comes|here|only|please)[\w ]{0,30})?|(?:please )?replace this text|здесь будет текст|текст появится позже|ここに(?:本文|要旨|テキスト).{0,12}|ダミーテキスト.{0,12}|本文準備中"
)
# Words of the classic filler passage, those of four letters up.
LOREM = frozenset(
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum".split()
)
# Stems by which failure and script notices are recognised in six languages.
CUES = (
    r"java ?script|\bscripts?\b|scripting|noscript|skript|\bcookies?\b|\bbrowser|navegador|navigateur|браузер|ブラウザ|^\W*(?:http|error|fehler|erreur|ошибка|エラー)?\W*[45]\d\d\b\W*[-–:]|(?:http|error|code|status|fehler|erreur|ошибка)\W{0,4}[45]\d\d\b|not found|not here|introuvable|nicht gefunden|no encontrad|не найден|見つかりません"
    r"|timed out|timeout|too many requests|too busy|\bbusy\b|try again|went wrong|could not be (?:displayed|completed|loaded)|cannot be (?:displayed|loaded)|no se pudo|n'a pas pu|konnte nicht|не удалось|できません|エラー"
    r"|maintenance|wartung|mantenimiento|обслуживани|メンテナンス|connection re(?:set|fused)|access (?:to|denied)|is refused|no rights|forbidden|permission|session has|sign in|log in|robot|captcha|traceback|exception|unavailable|<fault>|cancelled after|no record matches|\berror\b\W{0,2}\w+ has|\w+error at|fehler \d|fehlgeschlagen|while loading|(?:failed|unable) to load|\"failed\"|^loading\W*$"
)

_slot = re.compile(SLOT)
# By shape alone: names in capitals or joined by underscores, names between marks that aren't those of sentences, blanks before a mark or between brackets or quotes.
# Each begins with few characters, so that a text is searched fast.
_SHAPES = [
    re.compile(r"[A-Z]{2,}[A-Z0-9]*(?:_[A-Z0-9]+)*(?![\w/@-])|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+(?![\w/@-])"),
    re.compile(r"[*|:$#@~^=%]{1,3}[^\W\d_][\w .-]{0,38}?[*|:$#@~^=%]{1,3}(?![\w*|:$#@~^=%])"),
    re.compile(r" (?=[,.;](?:\s|$))"),
    re.compile(r"\(\s*\)|\[\s*\]|\"\s*\"|“\s*”"),
]
_JOINED = re.compile(r"(?<![\w/.@-])(?:[a-z]+(?:_[a-z0-9]+)+|[a-z]+[A-Z][A-Za-z]+)(?![\w/@-])")
_bump, _bracket = re.compile(r"[A-Z](?<=[a-z].)"), re.compile(r"[(\[\"“]\s*[)\]\"”]")


def shapes(text: str) -> Iterator[re.Match]:
    """What may have been left in a slot, told by its shape."""
    for k, shape in enumerate(_SHAPES):
        if k == 3 and not _bracket.search(text):
            continue
        for m in shape.finditer(text):
            before = text[m.start() - 1] if m.start() else " "
            if (not (before.isalnum() or before in "_/.@-"), before.isspace(), before.isalnum(), True)[k]:
                yield m
    if "_" in text or _bump.search(text):
        yield from _JOINED.finditer(text)


_default = re.compile(rf"(?:{DEFAULTS})[\s.…!:]*", re.I)
_cue = re.compile(CUES, re.I | re.M)
_code = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{4,}\b|\d+(?:[.,]\d+)*", re.I)
_end = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")
_token = re.compile(r"\w+|[^\w\s]")
_capitals = re.compile(r"[A-Z]{2,}$")
_ODD = ("  ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_odd = re.compile(r"[^\S\n\x00-\x7f]")

#: Words on either side that make a frame, the most words of a value, and how many frames are aligned in one pass over the records.
SIDE, VALUE, FRAMES = 2, 12, 100_000


def _clean(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    odd = any(c in text for c in _ODD) or not text.isascii() and _odd.search(text)
    return (re.sub(r"[^\S\n]+", " ", text) if odd else text).strip()


def _lines(text: str) -> list[str]:
    return [x.strip() for x in text.split("\n") if x.strip()]


def _segments(text: str) -> list[str]:
    return [s.strip() for x in _lines(text) for s in _end.split(x) if s.strip()]


def is_filler(segment: str) -> bool:
    """A segment that is filler as a whole: a default, one token over and over, or the filler passage."""
    words = re.findall(r"[^\W\d_]+", segment.lower())
    if not words:
        return bool(re.fullmatch(r"(?:[_.…\-\s]*_{4,}[_.…\-\s]*)+", segment))
    if _default.fullmatch(segment) or all(re.fullmatch(r"x{2,}", w) for w in words):
        return True
    if len(words) >= 4 and len(set(words)) == 1:
        return True
    long = [w for w in words if len(w) >= 4]
    return "lorem ipsum" in segment.lower() and len(words) < 80 or len(long) >= 5 and sum(w in LOREM for w in long) >= 0.35 * len(long) and len(set(words)) < 0.97 * len(words) + 1 and sum(w in LOREM for w in set(long)) >= 3


def _context(text: str, a: int, b: int) -> tuple[str, str]:
    """The :data:`SIDE` words or marks before and behind a place, as they are written; where its line has fewer, with the line's end."""
    start, stop = text.rfind("\n", 0, a), text.find("\n", b)
    left = list(_token.finditer(text, max(start + 1, a - 80), a))[-SIDE:]
    right = list(islice(_token.finditer(text, b, stop), SIDE))
    return text[left[0].start() if len(left) == SIDE else start : left[-1].end() if left else start + 1], text[right[0].start() if right else stop : right[-1].end() if len(right) == SIDE else stop + 1]


# What has to be there for a delimited name, a default or a cue to match: cheap tests that spare most texts the patterns.
_marks = re.compile(r"\{[{%]|<[%<]|[$#]\{|\[\[|@@|__|%[^\W\d_]|<[^\W\d_]|«|\[[A-Z]|HERE\]|&(?:lt|laquo|#)")
_ANCHORS = (
    *(f"{v} {d}" for v in ("type", "insert", "enter", "write", "put", "add") for d in ("the", "your", "a")), "to follow", "to come", "coming soon",
    "blindtext", "mustertext", "platzhaltertext", "beispieltext", "texto de", "text de", "texte factice", "texte de", "texte à", "placeholder text", "dummy text", "sample text", "filler text", "replace this", "xx", "____", "здесь", "позже", "ここに", "ダミー", "準備中",
)
_CUE_ANCHORS = (
    "script", "skript", "cookie", "browser", "navegador", "navigateur", "браузер", "ブラウザ", "http", "status", "code", "error:", "error 4", "error 5", "error at", "error has", "error, ", "error. ", "fehler", "erreur", "ошибка", "エラー", "not found", "not here", "introuvable", "nicht gefunden", "no encontrad", "не найден", "見つかりません", "timed out", "timeout", "too many requests", "busy", "try again", "went wrong",
    "could not be", "cannot be", "no se pudo", "n'a pas pu", "konnte nicht", "не удалось", "できません", "maintenance", "wartung", "mantenimiento", "обслуживани", "メンテナンス", "connection re", "access to", "access denied", "is refused", "no rights", "forbidden", "permission", "session has", "sign in", "log in", "robot", "captcha", "traceback", "exception", "unavailable", "<fault>", "cancelled after", "no record matches", "fehlgeschlagen", "loading", "failed", "unable to load",
)
_again = re.compile(r"(?:^|[\n.!?。])\W{0,9}(\w+)\W+\1\W+\1\W+\1\b", re.I)


_status = re.compile(r"^\W*[45]\d\d\b", re.M)


def _may_cue(low: str) -> bool:
    return any(a in low for a in _CUE_ANCHORS) or _status.search(low) is not None


def _may_fill(low: str) -> bool:
    return any(a in low for a in _ANCHORS) or len(LOREM.intersection(low.split())) >= 3 or "lorem ipsum" in low or _again.search(low) is not None


def _id(text: str) -> int:
    """A number for what a cleaned text says, spaces aside."""
    return int.from_bytes(hashlib.blake2b(" ".join(text.split()).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def fillings(frames: list[tuple[str, str]]):
    """One pass for (``before``, ``after``, ``value``, ``same``): what stands in the given frames, in every text.

    ``value`` is a hash, or 0 where nothing stands there or something that may have been left: a value that holds a name.
    """
    rights: dict[str, dict[int, set[str]]] = {}
    for b, a in frames:
        rights.setdefault(b, {}).setdefault(len(a), set()).add(a)

    def pass_over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = ahocorasick.Automaton()
        for b in rights:
            found.add_word(b, b)
        found.make_automaton()
        for batch in batches:
            out = set()
            for raw in batch["text"]:
                text = f"\n{_clean(raw)}\n"
                same = None
                for end, b in found.iter(text):
                    at, begin = end + 1, end + 1 - len(b)
                    if begin and text[begin].isalnum() and text[begin - 1].isalnum() or at < len(text) and b[-1].isalnum() and text[at].isalnum():
                        continue
                    stop = text.find("\n", at, at + 300)
                    # A value of one sentence: up to so many words and marks, with the words behind at their ends.
                    spots = (t.start() for t in islice(_token.finditer(text, at, stop if stop >= 0 else at + 300), VALUE + 1))
                    for k in chain(spots, (stop,) if stop >= 0 else ()):
                        for size, those in rights[b].items():
                            a = text[k : k + size]
                            if a in those and not (a[-1].isalnum() and text[k + size : k + size + 1].isalnum()):
                                value = text[at:k].strip()
                                same = _id(text) if same is None else same
                                out.add((b, a, 0 if not value or next(shapes(value), None) or _slot.search(value) else _id(value) or 1, same))
                        if text[k] in ".!?" and text[k + 1 : k + 2].isspace():
                            break
            yield pd.DataFrame(list(out), columns=["before", "after", "value", "same"])

    return pass_over


def evidence(beside: int):
    """All that one pass over a record yields, in rows of one shape.

    ``slot``: a delimited name with its frame, ``same`` for equal texts; ``shape``:
    a name by shape, or a blank, with its frame (``cues`` is 1 for mere capitals); ``filler``: the record holds
    filler; ``segment``: a segment of a record that is but messages, title and
    navigation, with at most ``beside`` characters of anything else, masked, with
    its cues and its place.
    """

    def pass_over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, raw in zip(b["doc_id"], b["text"]):
                text = _clean(raw)
                low = text.lower()
                own, framed, taken = None, f"\n{text}\n", []
                for kind, found in (("slot", _slot.finditer(framed) if _marks.search(text) else ()), ("shape", shapes(framed))):
                    for m in found:
                        # What is a slot already isn't told by its shape again.
                        if kind == "slot":
                            taken.append(m.span())
                        elif any(a < m.end() and m.start() < z for a, z in taken):
                            continue
                        before, after = _context(framed, m.start(), m.end())
                        # Shapes need words on both sides to be aligned by, and capitals words that aren't.
                        plain = kind == "shape" and _capitals.match(m.group()) is not None
                        if kind == "slot" or before.strip() and after.strip() and len(before) + len(after) >= 6 and not (plain and (before.isupper() or after.isupper())):
                            own = own or _id(text)
                            out.append((i, kind, before, after, m.group(), int(plain), False, own))
                if _may_fill(low) and any(is_filler(x) for x in _segments(text) if _may_fill(x.lower())):
                    out.append((i, "filler", "", "", "", 0, False, None))
                out += [(i, "segment", mask, "", "", cues, around, None) for mask, cues, around in _page(text, beside)]
            yield pd.DataFrame(out, columns=["doc_id", "kind", "before", "after", "value", "cues", "around", "same"]).astype({"same": "Int64"})

    return pass_over


def _page(text: str, beside: int) -> list[tuple[str, int, bool]]:
    """Segments (mask, cues, whether title or navigation) of a text that may be a message page, read until there is too much else; else none."""
    # First without cues, which most texts lack where there is too much else: one search over what was read.
    return _segments_of_page(text, beside, True) and _segments_of_page(text, beside, False)


def _each_segment(text: str) -> Iterator[str]:
    """Segments one by one, so that a text is split no further than it is read."""
    a = 0
    while a < len(text):
        z = text.find("\n", a)
        z = len(text) if z < 0 else z
        for m in _end.finditer(text, a, z):
            if text[a : m.start()].strip():
                yield text[a : m.start()].strip()
            a = m.end()
        if text[a:z].strip():
            yield text[a:z].strip()
        a = z + 1


def _segments_of_page(text: str, beside: int, glance: bool) -> list[tuple[str, int, bool]]:
    out, other, cued, first = [], 0, False, True
    for s in _each_segment(text):
        title = first and s[-1] not in ".!?。！？…" and len(s) < 300
        nav = "|" in s or "©" in s or len(s) < 40 and s[-1] not in ".!?。！？" and len(s.split()) <= 5
        first = False
        cues = set() if glance else {m.lower() for m in _cue.findall(s)}
        mask = _code.sub("0", s).lower()
        cued = cued or bool(cues)
        out.append((s if glance else mask, len(cues), title or nav))
        if not cues and not title and not nav:
            other += len(mask)
            if other > beside:
                if not glance:
                    return []
                break
    if glance:
        read = "\n".join(x for x, _, _ in out)
        return out if _may_cue(read.lower()) and _cue.search(read) else []
    return out if cued else []


def residue(documents: DataFrame, doc: str = "doc_id", text: str = "text", fixed_min: int = 3, fixed_share: float = 0.9, repeat_min: int = 2, beside: int = 150) -> DataFrame:
    """Records to exclude, as (``doc_id``, ``reason``), a row per reason.

    Reasons: ``slot`` (an unfilled slot), ``filler`` (default or filler text)
    and ``page`` (an error, failed-load or scripts-required page). ``fixed_min``
    distinct texts with one constant delimited name in a frame make that name
    ordinary text, if they are at least ``fixed_share`` of the texts that have
    the frame with anything in it; a frame in which as many texts hold values of
    their own is a slot, so that names by shape and blanks in it are open too.
    ``repeat_min`` is in how many records a message must recur, unless the record
    shows several cues; ``beside`` is how many characters that are neither message,
    title nor navigation such a page may hold, all of them recurring.

    Null or empty texts and an empty table give no row. Repeated rows of one id
    give one row a reason. Other columns are ignored; ``doc`` and ``text`` name
    the columns used. Texts of any length are read whole, but for pages, which
    are read until they hold too much else to be one.
    """
    d = spread(documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null"))
    # One pass over the texts; its rows are few, and are kept so that the pass isn't made again.
    found = checkpoint(d.mapInPandas(evidence(beside), "doc_id bigint, kind string, before string, after string, value string, cues int, around boolean, same bigint"))
    slots, shapes = found.where("kind = 'slot'"), found.where("kind = 'shape'")
    frames = slots.groupBy("before", "after").agg(F.count_distinct("value").alias("values"), F.count_distinct("same").alias("texts"))
    steady = checkpoint(frames.where((F.col("values") == 1) & (F.col("texts") >= fixed_min) & F.col("before").rlike(r"\S") & F.col("after").rlike(r"\S")))
    # Records are aligned on the frames in question, so many a pass.
    # Words in capitals are most often acronyms: they are asked about where their frame recurs.
    shaped = shapes.groupBy("before", "after").agg(F.count_distinct("same").alias("texts"), F.min("cues").alias("plain")).where((F.col("plain") == 0) | (F.col("texts") > 1))
    asked = checkpoint(steady.select("before", "after").unionByName(shaped.select("before", "after")).distinct().withColumn("part", F.pmod(F.xxhash64("before", "after"), F.lit(1 << 30))))
    n = asked.count()
    blocks = -(-n // FRAMES)
    parts = [d.select("text").mapInPandas(fillings([(r["before"], r["after"]) for r in asked.where(F.col("part") % blocks == k).toLocalIterator()]), "before string, after string, value bigint, same bigint") for k in range(blocks)]
    if parts:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        # Distinct values a frame and texts that hold them, pre-aggregated by value.
        by_value = every.where("value <> 0").groupBy("before", "after", "value").agg(F.count_distinct("same").alias("texts"))
        filled = checkpoint(by_value.groupBy("before", "after").agg(F.count(F.lit(1)).alias("fillings"), F.sum("texts").alias("others")))
        fixed = steady.hint("merge").join(filled, ["before", "after"], "left").where(F.col("texts") >= fixed_share * (F.col("texts") + F.coalesce("others", F.lit(0)))).select("before", "after")
        # Values of their own: nearly as many as texts, where a phrase of the language would bring the same again.
        varied = filled.where((F.col("fillings") >= fixed_min) & (2 * F.col("fillings") >= F.col("others")))
        left = shapes.groupBy("before", "after").agg(F.count_distinct("same").alias("left_texts"))
        induced = left.hint("merge").join(varied, ["before", "after"]).where(F.col("left_texts") <= F.col("others")).select("before", "after")
        open_ = slots.hint("merge").join(fixed, ["before", "after"], "left_anti").select("doc_id").unionByName(shapes.hint("merge").join(induced, ["before", "after"], "left_semi").select("doc_id"))
    else:
        open_ = slots.select("doc_id")
    open_slots = open_.distinct().withColumn("reason", F.lit("slot"))

    filler = found.where("kind = 'filler'").select("doc_id").distinct().withColumn("reason", F.lit("filler"))

    # Whole-page messages. Pre-aggregated on a hash: in how many records a mask occurs.
    segments = found.where("kind = 'segment'").select("doc_id", F.col("before").alias("mask"), "cues", "around").withColumn("h", F.xxhash64("mask"))
    judged = segments.hint("merge").join(segments.groupBy("h").agg(F.count_distinct("doc_id").alias("records")), "h")
    repeated, cued, size = F.col("records") >= repeat_min, F.col("cues") > 0, F.length("mask")
    page = judged.groupBy("doc_id").agg(
        F.count_if(cued & repeated).alias("messages"),
        F.sum("cues").alias("cues"),
        F.count_if(~(F.col("around") | cued | repeated)).alias("content"),
        F.coalesce(F.sum(F.when(~F.col("around"), size)), F.lit(0)).alias("size"),
    )
    pages = page.where((F.col("content") == 0) & (F.col("size") <= 6 * beside) & ((F.col("messages") > 0) | (F.col("cues") > 1))).select("doc_id", F.lit("page").alias("reason"))
    return open_slots.unionByName(filler).unionByName(pages)
