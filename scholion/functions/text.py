"""Column expressions for text, names, DOIs and numbers. All run inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin one, lower case.
_LOOKS = dict(zip("οναерсухѕіјһԁԛԝӏорвкмнтΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕЅІЈКМНОРСТУХ", "ovaepcyxsijhdqwlopbkmhtabezhikmnoptyxabesijkmhopctyx"))
# Names of Greek letters, as markup spells them.
GREEK = dict(zip("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split(), "αβγδεζηθικλμνξοπρστυφχψω"))


@lru_cache(maxsize=1)
def _letters() -> tuple[str, str, str]:
    """Characters and their plain lower-case letter, and those to drop; from the Unicode data."""
    src, dst, drop = [], [], []
    for n in [*range(0x41, 0x5B), *range(0xA0, 0x530), *range(0x1E00, 0x2000), *range(0x2070, 0x20A0), *range(0x2100, 0x2190), *range(0xFF01, 0xFF5F)]:
        c = chr(n)
        if unicodedata.combining(c) or unicodedata.category(c) == "Cf":
            drop.append(c)
            continue
        t = _LOOKS.get(c) or {"ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d", "ð": "d", "ı": "i", "þ": "t"}.get(c) or unicodedata.normalize("NFKD", c).lower()
        t = "".join(x for x in t if not unicodedata.combining(x))
        t = _LOOKS.get(t, t)
        if len(t) == 1 and t != c:
            src.append(c)
            dst.append(t)
    return "".join(src), "".join(dst), "".join(drop)


def fold(c: Column) -> Column:
    """Lower case without accents, widths, look-alike letters and characters that take no room."""
    src, dst, drop = _letters()
    plain, ascii_only = F.lower(c), F.length(c) == F.octet_length(c)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("Æ", "ae"), ("œ", "oe"), ("Œ", "oe"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.when(ascii_only, plain).otherwise(F.regexp_replace(F.translate(c, src + drop, dst), r"[\p{M}\p{Cf}]+", ""))


@lru_cache(maxsize=1)
def plain_letters() -> tuple[str, str]:
    """Characters whose compatibility form, marks left out, is one other character; and that one. From the Unicode data."""
    src, dst = [], []
    for n in [*range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2100), *range(0x2100, 0x2190), *range(0xFF01, 0xFF5F)]:
        t = "".join(x for x in unicodedata.normalize("NFKD", chr(n)) if not unicodedata.combining(x))
        if len(t) == 1 and t != chr(n):
            src.append(chr(n))
            dst.append(t)
    return "".join(src), "".join(dst)


# Ligatures and their letters.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))


def deaccent(c: Column) -> Column:
    """[P5] Without accents and in compatibility forms; look-alike letters of other scripts stay."""
    for a, b in LIGATURES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(c, *plain_letters()), r"\p{M}+", "")


def plain_title(c: Column) -> Column:
    """A title's words in lower case, single spaces between: without markup, accents and punctuation."""
    c = F.regexp_replace(F.regexp_replace(c, "&amp;", "&"), r"<\s*/?\s*\p{L}{1,6}\s*/?>|\\(?:emph|text\p{L}*|math\p{L}*)\b", "")
    c = fold(c)
    spelled = c
    for name, letter in GREEK.items():
        spelled = F.replace(spelled, F.lit("$\\" + name + "$"), F.lit(letter))
    c = F.when(F.contains(c, F.lit("$\\")), spelled).otherwise(c)
    c = F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), r"['’´`]", "")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def plain_doi(c: Column) -> Column:
    """A DOI in one notation: lower case, from its ``10.`` on, without escapes, query, spaces and closing marks. No ``10.``: null."""
    c = F.lower(F.regexp_replace(c, r"[\s\p{Cf}\p{Z}]+", ""))
    c = F.translate(c, "‐‑–", "---")
    for a, b in (("%2f", "/"), ("%28", "("), ("%29", ")"), ("%3a", ":"), ("%3b", ";"), ("%3c", "<"), ("%3e", ">"), ("%5b", "["), ("%5d", "]"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_extract(c, r"(10\.\d{4,}/[^?#\s]*)", 1)
    return F.nullif(F.regexp_replace(c, r"[.,;:]+$", ""), F.lit(""))


def plain_name(c: Column) -> Column:
    """A name's words in lower case without accents and transliterated umlauts; apostrophes join, other marks part."""
    c = F.regexp_replace(fold(c), r"['’´`]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), r"(?<=[aou])e(?=[^\saeiouy])|(?<=\ba)e", ""))


def year_of(c: Column) -> Column:
    """The first plausible year in a text, as a number; else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(c, r"(1[6-9]\d\d|20\d\d)", 1), F.lit("")), F.lit("9999")).cast("int")


def present(c: Column) -> Column:
    """Null where a text is empty or blank."""
    return F.nullif(F.trim(c), F.lit(""))
