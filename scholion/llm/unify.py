"""One consistent form for texts that read the same but differ in characters.

A transducer over grapheme clusters: a table from clusters to their consistent
form is built once from rules (widths, canonical accents, spaces, characters
without a width, ligatures, look-alike letters), checked for conflicts, and
compiled to one expression that takes the longest match at each place, so a
text is rewritten in one pass. What can be seen stays: case, the length of a
dash, raised figures, accents, markup.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion.session import spread

# Letters of other scripts drawn like the Latin letter beside them.
LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Һ": "h",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ү": "y", "ѵ": "v", "Ѵ": "V", "ⲟ": "o", "Ⲟ": "O", "ⲥ": "c", "Ⲥ": "C", "ⲣ": "p", "Ⲣ": "P", "Ꭰ": "D", "Ꮪ": "S", "Ꮯ": "C", "Ꮲ": "P",
    "Օ": "O", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "Ꭺ": "A", "Ꮃ": "W", "ı": "ı", "ɡ": "g", "ɑ": "a", "ℓ": "ℓ", "µ": "μ", "∆": "Δ", "∑": "Σ", "∏": "Π",
}
# Marks drawn alike.
MARKS = {"‐": "-", "‑": "-", "﹣": "-", "⁃": "-", "’": "’", "ʼ": "’", "․": ".", "‚": "‚", "：": ":", "∶": ":", "∕": "/", "⁄": "/", "∗": "*", "∣": "|", "ǀ": "|", "﹕": ":", "‥": "..", "…": "..."}
#: Characters that take no room (format characters, fillers, variation selectors), and every kind of one space.
IGNORED = "".join(chr(n) for n in [*range(0x80, 0x10000), *range(0xE0100, 0xE01F0)] if n > 0xFFFF or unicodedata.category(chr(n)) == "Cf" or 0xFE00 <= n <= 0xFE0F or n in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D))
SPACES = "\t\n\x0b\x0c\r\x85" + "".join(chr(n) for n in range(0x80, 0x10000) if unicodedata.category(chr(n)) in ("Zs", "Zl", "Zp"))
# Pairs that can be told apart by eye and must never meet.
APART = [("²", "2"), ("³", "3"), ("₂", "2"), ("–", "-"), ("—", "–"), ("—", "-"), ("α", "a"), ("β", "B"), ("é", "e"), ("ß", "ss"), ("μ", "u"), ("Σ", "S"), ("ω", "w"), ("κ", "k"), ("τ", "t"), ("σ", "o"), ("l", "I"), ("l", "1"), ("O", "0"), ("æ", "ae"), ("в", "B"), ("н", "H"), ("к", "k"), ("т", "T"), ("й", "и"), ("ё", "e"), ("が", "か"), ("º", "o"), ("ª", "a"), ("½", "1/2")]


def _joins(c: str) -> bool:
    """Scripts and pictures in which a joiner changes what is seen."""
    return "؀" <= c <= "෿" or "က" <= c <= "៿" or "←" <= c <= "⯿" or c >= "\U0001f000"


def compile_rules() -> dict[str, str]:
    """The table of single characters, from the rules above and the Unicode data; raises on a conflict."""
    table: dict[str, str] = {}

    def rule(source: str, target: str) -> None:
        if table.setdefault(source, target) != target:
            raise ValueError(f"{source!r} has two forms: {table[source]!r} and {target!r}")

    for c in IGNORED:
        rule(c, "")
    for c in SPACES:
        rule(c, " ")
    for c, t in (LOOK_ALIKES | {k: v for k, v in MARKS.items() if len(k) == 1 and not "＀" <= k <= "￯"}).items():
        rule(c, t)
    for n in [*range(0xFF01, 0xFFEF), *range(0xFB00, 0xFB07), *range(0x2160, 0x2180), *range(0xFE50, 0xFE6C)]:
        c = chr(n)
        t = unicodedata.normalize("NFKC", c)
        if t != c and c not in table and not unicodedata.combining(t[0]):
            rule(c, "".join(table.get(x, x) if len(table.get(x, x)) == 1 else x for x in t))
    for source, target in list(table.items()):
        again = "".join(table.get(x, x) for x in target)
        if again != target and source != target:
            table[source] = again
    for source, target in table.items():
        if "".join(table.get(x, x) for x in target) != target:
            raise ValueError(f"the form {target!r} of {source!r} isn't final")
    for a, b in APART:
        if _form(a, table) == _form(b, table):
            raise ValueError(f"{a!r} and {b!r} would become the same")
    return {k: v for k, v in table.items() if k != v}


def _form(cluster: str, table: dict[str, str]) -> str:
    """The consistent form of one grapheme cluster."""
    kept = "".join(c for c in cluster if c not in IGNORED or c in "\u200c\u200d" and _joins(cluster[0]))
    out = []
    for c in unicodedata.normalize("NFD", kept):
        out.append(table.get(c, c) if c not in IGNORED else c)
    return unicodedata.normalize("NFC", "".join(out))


class Transducer:
    """The compiled table; clusters not seen before are added as they come."""

    def __init__(self) -> None:
        self.table = compile_rules()
        self.known: dict[str, str] = {c: _form(c, self.table) for c in self.table}
        for n in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
            for c in {chr(n), unicodedata.normalize("NFD", chr(n))}:
                self.known[c] = _form(c, self.table)
        zero = "".join(map(re.escape, IGNORED))
        marks = "".join(re.escape(chr(n)) for n in range(0x300, 0x10000) if unicodedata.combining(chr(n))) + "\uff9e\uff9f"
        self.pattern = re.compile(rf"[^\x00-\x7f][{marks}{zero}]*|[\x00-\x7f][{marks}{zero}]+|[\t\n\x0b\x0c\r]")

    def _one(self, m: re.Match) -> str:
        c = m.group()
        found = self.known.get(c)
        if found is None:
            found = _form(c, self.table)
            if len(self.known) < 100_000:
                self.known[c] = found
        return found

    def __call__(self, text: str) -> str:
        if not text.isascii() or "\n" in text or "\t" in text or "\r" in text:
            text = self.pattern.sub(self._one, text)
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
        return re.sub(" {2,}", " ", text).strip() if "  " in text or text[:1] == " " or text[-1:] == " " else text


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    """One compiled transducer a process."""
    return Transducer()


@F.pandas_udf(T.StringType())
def consistent(text: pd.Series) -> pd.Series:
    """The consistent form of each text; null stays null."""
    t = transducer()
    return text.map(t, na_action="ignore")


def unified(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(``field_name``, ``row``, ``raw``, ``form``) of one text column; null texts give no row."""
    return spread(df.select(F.col(key).alias("row"), F.col(text).alias("raw")).where("raw is not null and row is not null")).select(F.lit(name).alias("field_name"), "row", "raw", consistent("raw").alias("form"))


def same_reading(unified_rows: DataFrame) -> DataFrame:
    """Pairs (``field_name``, ``row_a``, ``row_b``) of rows with one form and different characters.

    Rows first become classes of equal characters; only classes of one form are
    compared, so rows with the same characters are never paired with each other
    and a form that most rows share costs no more than the pairs it yields.
    Texts whose form is empty give no pair. Null texts, repeated rows and an
    empty table are fine; a row repeated under its id counts once.
    """
    rows = unified_rows.where("form <> ''").select("field_name", "row", F.sha2("form", 256).alias("f"), F.sha2("raw", 256).alias("r"))
    classes = rows.select("field_name", "f", "r").distinct()
    several = classes.groupBy("field_name", "f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Rows of forms with several spellings only; the rest can't take part.
    left = rows.join(several, ["field_name", "f"], "left_semi").distinct()
    right = left.select("field_name", "f", F.col("r").alias("r2"), F.col("row").alias("row2"))
    kinds = left.select("field_name", "f", "r").distinct()
    pairs = kinds.join(kinds.withColumnRenamed("r", "r2"), ["field_name", "f"]).where("r < r2")
    return (
        pairs.join(left, ["field_name", "f", "r"])
        .join(right, ["field_name", "f", "r2"])
        .select("field_name", F.least("row", "row2").alias("row_a"), F.greatest("row", "row2").alias("row_b"))
        .where("row_a < row_b")
        .distinct()
    )
