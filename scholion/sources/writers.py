"""Sinks: bibliography text, index tables, folders, reports, append-only logs and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Characters that mean something to TeX, and characters it can't read, with their spelling.
TEX = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "%": r"\%", "#": r"\#", "_": r"\_", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
UNICODE_TEX = {
    "\u2010": "-", "\u2011": "-", "\u2012": "--", "\u2013": "--", "\u2014": "---", "\u2015": "---", "\u2212": "$-$", "\u2018": "`", "\u2019": "'", "\u201a": ",", "\u201b": "`", "\u201c": "``", "\u201d": "''", "\u201e": ",,", "\u2032": "$'$", "\u2033": "$''$", "\u00ab": "``", "\u00bb": "''", "\u00a1": "!`", "\u00bf": "?`", "\u02da": r"\textdegree{}",
    "\u00a0": " ", "\u2002": " ", "\u2003": " ", "\u2007": " ", "\u2008": " ", "\u2009": " ", "\u200a": " ", "\u202f": " ", "\u3000": " ", "\u00b0": r"\textdegree{}", "\u2103": r"\textdegree{}C", "\u00b1": r"$\pm$", "\u00d7": r"$\times$", "\u00f7": r"$\div$", "\u2248": r"$\approx$", "\u223c": r"$\sim$", "\u2260": r"$\neq$", "\u2264": r"$\leq$", "\u2265": r"$\geq$", "\u221e": r"$\infty$",
    "\u2190": r"$\leftarrow$", "\u2192": r"$\rightarrow$", "\u2194": r"$\leftrightarrow$", "\u21d4": r"$\Leftrightarrow$", "\u2211": r"$\sum$", "\u220f": r"$\prod$", "\u2208": r"$\in$", "\u2206": r"$\Delta$", "\u2202": r"$\partial$", "\u00b7": r"$\cdot$", "\u2217": "$*$", "\u2215": "/", "\u2026": r"\ldots{}", "\u2022": r"\textbullet{}", "\u00a9": r"\textcopyright{}", "\u00ae": r"\textregistered{}", "\u2122": r"\texttrademark{}", "\u00a7": r"\S{}", "\u2020": r"\dag{}", "\u2021": r"\ddag{}",
}
# Kinds of documents and the entry types of a bibliography.
ENTRY_TYPES = {"journal": "article", "magazine_article": "article", "newspaper_article": "article", "book": "book", "book_section": "incollection", "encyclopedia_article": "incollection", "conference_proceedings": "inproceedings", "thesis": "phdthesis", "report": "techreport", "working_paper": "techreport", "web_page": "misc", "computer_program": "misc", "patent": "misc", "generic": "misc"}
DOCUMENT = "id string, citekey string, type string, title string, authors array<struct<first_name:string,last_name:string,name:string>>, editors array<struct<first_name:string,last_name:string,name:string>>, year string, source string, volume string, issue string, pages string, publisher string, city string, institution string, identifiers struct<doi:string,issn:string,isbn:string,pmid:string,arxiv:string>, abstract string, keywords array<string>, websites array<string>"


def decoded(c: Column) -> Column:
    """[P15] Named entities and numbered ones of XML undone, once."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def tex(c: Column) -> Column:
    """[P16] Text as TeX reads it: each character that means something is escaped once, those it can't read are spelled, unseen ones go."""
    seen = F.regexp_replace(decoded(c), r"[\p{Cf}\p{Co}]", "")
    spelled = {**TEX, **UNICODE_TEX}
    # Signs of private use stand for the characters while they are spelled, so that no spelling is spelled again; the text has none of its own left.
    signs = [chr(0xE000 + k) for k in range(len(spelled))]
    c = F.translate(seen, "".join(spelled), "".join(signs))
    for sign, text in zip(signs, spelled.values()):
        c = F.replace(c, F.lit(sign), F.lit(text))
    # Only what has such a character is taken apart.
    odd = "[" + "".join("\\" + k if k in "\\{}$&^_~%#" else k for k in spelled) + "]"
    return F.trim(F.replace(F.when(seen.rlike(odd), c).otherwise(seen), F.lit("\n"), F.lit(" ")))


def author_text(people: Column) -> Column:
    """[P45] Names for a bibliography: ``Last, First and ...``, organisations in braces, ``others`` without."""
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    one = lambda a: F.coalesce(F.when(blank(a["last_name"]).isNotNull() & blank(a["first_name"]).isNotNull(), F.concat(tex(blank(a["last_name"])), F.lit(", "), tex(blank(a["first_name"])))), tex(F.coalesce(blank(a["last_name"]), blank(a["first_name"]))), F.when(F.lower(blank(a["name"])) == "others", "others").otherwise(F.concat(F.lit("{"), tex(blank(a["name"])), F.lit("}"))))
    return F.nullif(F.array_join(F.array_compact(F.transform(people, one)), " and "), F.lit(""))


def filled_fields(fields: list[tuple[str, Column]]) -> Column:
    """The fields of an entry that aren't empty, in order, with their names. Select it before :func:`entry_text`, which reads it more than once."""
    return F.filter(F.array(*[F.struct(F.lit(n).alias("n"), v.cast("string").alias("v")) for n, v in fields]), lambda f: f["v"] != "")


def entry_text(kind: Column, key: Column, fields: Column) -> Column:
    """One entry of a bibliography from its :func:`filled_fields`, their signs below one another."""
    width = F.coalesce(F.array_max(F.transform(fields, lambda f: F.length(f["n"]))), F.lit(0))
    lines = F.transform(fields, lambda f: F.concat(F.lit("  "), F.rpad(f["n"], width, F.lit(" ")), F.lit(" = {"), f["v"], F.lit("},")))
    return F.concat_ws("\n", F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",")), F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit("}"))


def documents_of(entries: DataFrame) -> DataFrame:
    """The library's entries in the schema of documents (:data:`DOCUMENT`); what they don't have is null."""
    back = {"article": "journal", "incollection": "book_section", "inproceedings": "conference_proceedings", "book": "book", "phdthesis": "thesis", "techreport": "report"}
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in back.items() for x in kv])[F.col("entry_type")], F.lit("generic"))
    none = lambda t: F.lit(None).cast(t)
    people = "array<struct<first_name:string,last_name:string,name:string>>"
    ids = F.struct(F.col("doi").alias("doi"), *[none("string").alias(x) for x in ("issn", "isbn", "pmid", "arxiv")])
    return entries.select(F.col("qid").alias("id"), "citekey", kind.alias("type"), "title", F.col("authors").cast(people).alias("authors"), none(people).alias("editors"), "year", F.col("journal").alias("source"), "volume", none("string").alias("issue"), F.col("firstpage").alias("pages"), *[none("string").alias(x) for x in ("publisher", "city", "institution")], ids.alias("identifiers"), none("string").alias("abstract"), *[none("array<string>").alias(x) for x in ("keywords", "websites")])


def bibliography_entry(docs: DataFrame, with_abstract: bool = True) -> DataFrame:
    """[K1] (``citekey``, ``entry``) of documents (:data:`DOCUMENT`).

    The venue is the journal of an article and the book title of a part; for
    other kinds it goes into the note, as does that a record has no title.
    Records without people are sorted by their key. Empty fields are left out.
    """
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in ENTRY_TYPES.items() for x in kv])[F.col("type")], F.lit("misc"))
    authors, editors = author_text(F.col("authors")), author_text(F.col("editors"))
    ids = lambda f: F.col("identifiers")[f]
    venue = F.nullif(tex(F.col("source")), F.lit(""))
    part, article, thesis = kind.isin("inproceedings", "incollection"), kind == "article", kind == "phdthesis"
    untitled = F.coalesce(F.col("title"), F.lit("")) == ""
    note = F.concat_ws(". ", F.when(~part & ~article, venue), F.when(untitled, F.concat(F.lit("Untitled record (document id "), F.coalesce("id", F.lit("?")), F.lit(")"))))
    pages = F.regexp_replace(F.trim(F.replace(F.regexp_replace(decoded(F.col("pages")), r"[\p{Cf}\p{Co}]", ""), F.lit("\n"), F.lit(" "))), r"[-\u2010-\u2015\u2212]+", "--")
    fields = [
        ("author", authors), ("editor", editors), ("title", F.when(~untitled, F.concat(F.lit("{"), tex(F.col("title")), F.lit("}")))), ("key", F.when(authors.isNull() & editors.isNull(), F.col("citekey"))),
        ("journal", F.when(article, venue)), ("booktitle", F.when(part, venue)), ("year", F.col("year")), ("volume", F.col("volume")), ("number", F.col("issue")), ("pages", pages), ("publisher", tex(F.col("publisher"))), ("type", F.when(thesis, "Thesis")),
        ("school", F.when(thesis, tex(F.col("institution")))), ("institution", F.when(~thesis, tex(F.col("institution")))), ("address", tex(F.col("city"))), *[(n, ids(n)) for n in ("doi", "issn", "isbn", "pmid")], ("eprint", ids("arxiv")),
        ("url", decoded(F.try_element_at("websites", F.lit(1)))), ("keywords", tex(F.array_join("keywords", ", "))), ("abstract", tex(F.col("abstract")) if with_abstract else F.lit(None)), ("note", note),
    ]
    x = docs.select("citekey", kind.alias("kind"), filled_fields(fields).alias("fields"))
    return x.select("citekey", entry_text(F.col("kind"), F.col("citekey"), F.col("fields")).alias("entry"))


def annotation_pages(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """[K5] (``citekey``, ``markdown``) of documents with their annotations (``citekey``, ``page``, ``y``, ``kind``, ``text``) in reading order."""
    said = F.trim(F.coalesce(F.col("text"), F.lit("")))
    at = F.concat(F.lit("p. "), F.coalesce("page", F.lit(0)).cast("string"))
    line = F.when((F.col("kind") == "highlight") & (said == ""), F.concat(F.lit("- *(highlight, "), at, F.lit(")*"))).when(F.col("kind") == "highlight", F.concat(F.lit("- > "), said, F.lit("\n  \n  *("), at, F.lit(")*"))).when(said != "", F.concat(F.lit("- **note ("), at, F.lit(")**: "), said))
    body = notes.select("citekey", F.struct(F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("y", F.lit(0)).alias("y"), line.alias("line")).alias("n")).where("n.line is not null").groupBy("citekey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda n: n["line"]), "\n").alias("body"))
    names = F.array_join(F.filter(F.transform("authors", lambda a: F.trim(F.concat_ws(" ", F.trim(a["first_name"]), F.trim(F.coalesce(F.nullif(a["last_name"], F.lit("")), a["name"]))))), lambda x: x != ""), ", ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(untitled)"))), F.lit(""), F.concat(F.lit("- **key**: `"), "citekey", F.lit("`")), F.concat(F.lit("- **authors**: "), F.coalesce(names, F.lit(""))), F.concat(F.lit("- **year**: "), text("year")), F.concat(F.lit("- **source**: "), text("source")), F.concat(F.lit("- **doi**: "), F.nullif(F.col("identifiers")["doi"], F.lit(""))), F.lit(""), F.lit("---"), F.lit(""))
    return docs.join(body, "citekey", "left").select("citekey", F.concat(head, F.lit("\n"), F.coalesce("body", F.lit("*(no annotations)*")), F.lit("\n")).alias("markdown"))


def write_bibliography(docs: DataFrame, path: str) -> None:
    """[K2] The whole bibliography as text, by key in lower case; range-partitioned, so parts are in order. Takes documents or the library's entries."""
    bibliography_entry(docs if "type" in docs.columns else documents_of(docs)).sort(F.lower("citekey"), "citekey").select("entry").write.mode("overwrite").text(path)


def index_table(docs: DataFrame, files: DataFrame) -> DataFrame:
    """[K3] One row a document: whether it has text (yes, no, or blank without files)."""
    f = files.groupBy(F.col("parent_qid").alias("qid")).agg(F.max((F.col("content_type") == "application/pdf").cast("int")).alias("pdf"))
    return docs.join(f, "qid", "left").select("citekey", "year", "title", F.when(F.col("pdf").isNull(), "").when(F.col("pdf") == 1, "yes").otherwise("no").alias("has_text"))


def report(rows: DataFrame, by: str) -> DataFrame:
    """[K7, K9, K14] Counts by verdict; they add up to the rows."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def append_log(rows: DataFrame, path: str) -> None:
    """[K13] Rows added to an append-only log."""
    rows.write.mode("append").parquet(path)


def snapshot(rows: DataFrame, path: str, version: int) -> str:
    """[K11, K12] Rows as a new version beside the old ones; a version once written isn't written again."""
    to = f"{path}/version={version}"
    rows.write.mode("error").parquet(to)
    return to
