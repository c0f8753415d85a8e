"""Scalar functions of the library domain as column expressions.

Names in brackets are the inventory's numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholion.functions.text import deaccent, fold

# Words without weight in titles, and those skipped for a key.
LIGHT_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with", "its", "their", "using", "via", "into", "between")
KEY_SKIP = ("a", "an", "the", "on", "of", "in", "for", "and", "to", "with", "at", "by", "from", "into", "via", "is", "are", "as", "using", "toward", "towards")
# How a reference names a venue, a volume with pages, and an author.
VENUE = (
    r"(?i)\b(?:Journal|Jnl|Proc\.?|Proceedings|Rev\.?|Review|Trans\.?|Bull\.?|Ann\.?|Acta|Arch\.?|Chem|Phys|Biol|Biochem|Biophys|Med\.|Sci\.?|Soc\.?|Nature|Science|Cell|Lancet|Polym|Macromol|Mater|Eng|Lett|Commun|Res\."
    r"|Press|Wiley|Springer|Elsevier|Academic|Pergamon|Plenum|Dekker|McGraw|Blackwell|Oxford|Cambridge|Prentice|Publisher|Publishing|eds?\.|editors?|Vol\.|pp?\.|Thesis|Dissertation|University|Univ\.)"
)
VOLUME_PAGES = r"\b\d{1,4}\s*[:,]\s*\d{1,5}\s*[-–]\s*\d{1,5}\b"
AUTHOR = r"[A-Z][a-z]{2,}(?:,\s*|\s+)(?:[A-Z]\.\s*){1,4}|[A-Z][a-z]{2,}\s+[A-Z](?:\s+[A-Z])*\b(?![A-Z])|[A-Z][a-z]{2,}\s+[A-Z]{1,3},|[A-Z]{3,},\s*[A-Z]\.|(?:[A-Z]\.\s*){1,3}[A-Z][a-z]{2,}"
# Phrases by which a failed run is told, in the order they are tested.
INTERRUPTED = ("keyboardinterrupt",)
NETWORK = ("could not reach", "connectionerror", "connecttimeout", "readtimeout", "max retries", "name or service not known", "temporary failure in name resolution", "connection reset", "connection refused")
AUTH = ("refused the key", "no zotero credentials", "needs both api_key and user_id", "invalid key", "403", "401", "no documents returned")
BACKENDS = ("zotero", "mendeley")


def doi_normal(c: Column) -> Column:
    """[P1] Trimmed, lower case, without resolver prefix and closing marks; empty is null."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.nullif(F.regexp_replace(c, r"[ .;,]+$", ""), F.lit(""))


def doi_clean(c: Column) -> Column:
    """[P2] Without trailing marks; a closing bracket stays where it has an opening one."""
    c = F.regexp_replace(c, r"[.,;:]+$", "")
    for opened, closed in (("(", ")"), ("[", "]")):
        surplus = F.length(F.replace(c, F.lit(opened), F.lit(""))) > F.length(F.replace(c, F.lit(closed), F.lit("")))
        c = F.when(c.endswith(closed) & surplus, F.regexp_replace(c, r".$", "")).otherwise(c)
    return F.regexp_replace(c, r"[.,;:]+$", "")


def doi_find(c: Column) -> Column:
    """[P3] All DOIs in a text."""
    return F.regexp_extract_all(c, F.lit(r"(10\.\d{4,9}/[^\s\"<>]+)"), 1)


def doi_of_filename(c: Column) -> Column:
    """[P4] DOI spelled in a file name, its first mark after the registrant as the slash."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, r"(10\.\d{4,9}[_-][^\s]+?)(?:\.pdf)?$", 1), r"^(10\.\d{4,9})[_-]", "$1/"), F.lit(""))


def title_words(c: Column) -> Column:
    """[P6] A title's words: folded, lower case, letters and digits only, one space between."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))


def title_ascii(c: Column) -> Column:
    """[P6] Without accents, lower case, everything but ASCII letters and digits a space: what titles are compared by in Q2."""
    return F.trim(F.regexp_replace(F.lower(deaccent(c)), r"[^a-z0-9 ]+", " "))


def title_ascii_key(c: Column) -> Column:
    """[P6] ASCII letters and digits only."""
    return F.regexp_replace(F.lower(deaccent(c)), r"[^a-z0-9]+", "")


def word_set(c: Column) -> Column:
    """[P6, J13] The distinct words of a title, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(title_ascii(c), r" +"), lambda w: w != "")))


def overlap(a: Column, b: Column) -> Column:
    """[U2] Share of the first word set that the second one holds; an empty set has none."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))


def title_key(c: Column) -> Column:
    """[P6] Letters and digits only, script kept."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def significant(c: Column) -> Column:
    """[P7] Distinct words longer than three characters that carry meaning, sorted; accents don't count, other scripts' letters part words."""
    plain = title_ascii(c)
    return F.array_sort(F.array_distinct(F.filter(F.split(plain, " "), lambda w: (F.length(w) > 3) & ~w.isin(*LIGHT_WORDS))))


def year_first(c: Column) -> Column:
    """[P8] First year from 1600 to 2099 in a text; else null."""
    return F.nullif(F.regexp_extract(c, r"(1[6-9]\d\d|20\d\d)", 1), F.lit("")).cast("int")


def issue_year(printed: Column, issue: Column, issued: Column) -> Column:
    """[P9] Print year before issue year before issued year."""
    return F.coalesce(printed, issue, issued)


def last_name(c: Column) -> Column:
    """[P10] The last word of a name."""
    return F.element_at(F.split(F.trim(c), r"\s+"), -1)


def key_name(c: Column) -> Column:
    """[P11] Name part of a key: ASCII letters only; capitals stay, else first letter large; none: Anon."""
    letters = F.regexp_replace(deaccent(c), r"[^A-Za-z]", "")
    shaped = F.when(F.upper(letters) == letters, letters).otherwise(F.concat(F.upper(F.left(letters, F.lit(1))), F.lower(F.substring(letters, 2, 1 << 30))))
    return F.coalesce(F.nullif(shaped, F.lit("")), F.lit("Anon"))


def first_person(*people: Column) -> Column:
    """[P11] The name a key is made of: the first author's, else the first editor's; last name before single-field name before first name. Lists that hold no letters fall through."""
    named = [F.coalesce(*[F.nullif(F.trim(F.try_element_at(p, F.lit(1))[f]), F.lit("")) for f in ("last_name", "name", "first_name")]) for p in people]
    return F.coalesce(*[F.when(deaccent(n).rlike("[A-Za-z]"), n) for n in named])


def key_word(c: Column) -> Column:
    """[P12] Title part of a key: first telling word of more than two letters, else the first word, else Untitled."""
    words = F.filter(F.split(F.regexp_replace(deaccent(c), r"[^A-Za-z]+", " "), " "), lambda w: w != "")
    word = F.coalesce(F.try_element_at(F.filter(words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*KEY_SKIP)), F.lit(1)), F.try_element_at(words, F.lit(1)))
    return F.coalesce(F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, 2, 1 << 30))), F.lit("Untitled"))


def bib_author(c: Column) -> Column:
    """[P14] Surname of the first of several names joined by `` and ``: before a comma, else the last word."""
    first = F.trim(F.split(c, r" and ")[0])
    return F.nullif(F.trim(F.when(F.contains(first, F.lit(",")), F.split(first, ",")[0]).otherwise(F.element_at(F.split(first, r"\s+"), -1))), F.lit(""))


def key_surname(c: Column) -> Column:
    """[P14] The letters of a key before its first digit."""
    return F.regexp_extract(c, r"^([^\d]*)", 1)


def outside(page: Column, first: Column, last: Column) -> Column:
    """[P24] Whether a page is outside an article's range; without a range nothing is."""
    return F.coalesce((page < first) | (page > last), F.lit(False))


def cited_surname(c: Column) -> Column:
    """[P13] The longest capitalised word of a name, the first of equals."""
    words = F.regexp_extract_all(c, F.lit(r"([A-Z][A-Za-z'-]+)"), 1)
    return F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))


def without_tags(c: Column) -> Column:
    """[P17] Markup tags out, white space collapsed."""
    return squeeze(F.regexp_replace(c, r"<[^>]+>", " "))


def squeeze(c: Column) -> Column:
    """[P18] White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without_controls(c: Column) -> Column:
    """[P19] Line ends as LF, no control characters but tab and LF."""
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def page_clean(c: Column) -> Column:
    """[P20] Words joined over lines, soft line ends as spaces, blank lines squeezed."""
    c = F.regexp_replace(without_controls(c), r"(\w)-\n(\w)", "$1$2")
    c = F.regexp_replace(c, r"([^\n.:;!?])\n([^\n\-0-9•*])", "$1 $2")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def expand_group(c: Column) -> Column:
    """[P22] Numbers of a citation group; a range of up to 30 is filled, a wider one keeps its ends."""

    def one(p: Column) -> Column:
        a, b = F.try_to_number(F.regexp_extract(p, r"^(\d+)", 1), F.lit("999999")).cast("int"), F.try_to_number(F.regexp_extract(p, r"(\d+)$", 1), F.lit("999999")).cast("int")
        return F.when(p.rlike(r"^\d+-\d+$") & (b > a) & (b - a <= 30), F.sequence(a, F.greatest(a, b))).when(p.rlike(r"^\d+-\d+$"), F.array(a, b)).when(p.rlike(r"^\d+$"), F.array(a)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.split(F.regexp_replace(F.regexp_replace(c, r"[–—]", "-"), r"\s+", ""), "[,;]"), one))


def folio(c: Column) -> Column:
    """[P23] Printed page number of ``863``, ``021039-2`` or ``R863``; anything else null."""
    return F.when(c.rlike(r"^\d+-\d+$"), F.regexp_extract(c, r"-(\d+)$", 1)).when(c.rlike(r"^[A-Z]?\d+$"), F.regexp_extract(c, r"(\d+)$", 1)).cast("int")


def alnum_share(c: Column) -> Column:
    """[P26] Letters and digits among the characters that aren't space; none: 1."""
    n = F.length(F.regexp_replace(c, r"\s+", ""))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")) / n)


def body_hash(c: Column) -> Column:
    """[P29] First 16 hex digits of the body's SHA-256."""
    return F.left(F.sha2(c, 256), F.lit(16))


def backend_of(c: Column) -> Column:
    """[P31] The known backend an id names before its colon; a bare id has the first one, a foreign one none."""
    head = F.regexp_extract(c, r"^([a-z]+):", 1)
    return F.when(head == "", F.lit(BACKENDS[0])).when(head.isin(*BACKENDS), head)


def local_id(c: Column) -> Column:
    """[P31] The id without its known backend."""
    return F.regexp_replace(c, "^(" + "|".join(BACKENDS) + "):", "")


def stem_key(c: Column) -> Column:
    """[P32] Key of a file stem: a suffix of two or more is a further file's number."""
    return F.when(c.rlike(r"-([2-9]|[1-9]\d+)$"), F.regexp_replace(c, r"-\d+$", "")).otherwise(c)


def stem_number(c: Column) -> Column:
    """[P32] Number of the file: 1, or the stem's suffix of two or more."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"-([2-9]|[1-9]\d+)$", 1), F.lit("")).cast("int"), F.lit(1))


def issn_shape(c: Column) -> Column:
    """[P33] Whether a text is one ISSN."""
    return c.rlike(r"^\d{4}-?\d{3}[\dXx]$")


def isbn_shape(c: Column) -> Column:
    """[P33] Whether a text, hyphens and spaces aside, has the ten or thirteen characters of an ISBN."""
    return F.regexp_replace(c, r"[\s-]+", "").rlike(r"^(?:\d{9}[\dXx]|\d{13})$")


def issn_set(c: Column) -> Column:
    """[P33] All ISSNs in a text, without hyphen, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.upper(c), F.lit(r"\b(\d{4}-?\d{3}[\dX])\b"), 1), lambda x: F.replace(x, F.lit("-"), F.lit("")))))


def issn_class(value: Column, held: Column) -> Column:
    """[P33, U4] A value beside the ISSNs a record holds: junk without any ISSN, same where they share one, else differs."""
    x, y = issn_set(F.coalesce(value, F.lit(""))), issn_set(F.coalesce(held, F.lit("")))
    return F.when(F.size(x) == 0, "junk").when(F.arrays_overlap(x, y), "same").otherwise("differs")


# Fixed value: an arXiv id of either form, with or without prefix and version.
ARXIV = r"(?i)(?:arxiv\s*:\s*)?([a-z-]+(?:\.[A-Z]{2})?/\d{7}|\d{4}\.\d{4,5})(?:v\d+)?"


def arxiv_ids(c: Column) -> Column:
    """[P34] All arXiv ids in a text, in lower case, without prefix and version."""
    return F.transform(F.regexp_extract_all(c, F.lit(ARXIV), 1), F.lower)


def arxiv_id(c: Column) -> Column:
    """[P34] The first arXiv id of a text without prefix and version; without one, the text trimmed and in lower case."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(c, ARXIV, 1)), F.lit("")), F.lower(F.trim(c)))


def same_identifier(a: Column, b: Column) -> Column:
    """[P34] Whether two identifiers differ in punctuation and case only; empty ones aren't the same."""
    bare = lambda c: F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9A-Za-z]", ""))
    return (bare(a) != "") & (bare(a) == bare(b))


# The types of creators that remote records name, by the part they have in a work.
PRIMARY = ("author", "inventor", "programmer", "presenter", "director", "podcaster", "interviewee", "artist", "cartographer", "performer", "sponsor")
SECONDARY = ("seriesEditor", "translator", "contributor", "bookAuthor", "reviewedAuthor", "commenter", "wordsBy", "scriptwriter", "producer", "guest", "counsel", "attorneyAgent", "recipient", "castMember")


def creator_role(c: Column) -> Column:
    """[P37] Part of a creator: primary, editor, secondary, or unknown; no type is an author."""
    t = F.coalesce(F.nullif(c, F.lit("")), F.lit("author"))
    return F.when(t.isin(*PRIMARY), "primary").when(t == "editor", "editor").when(t.isin(*SECONDARY), "secondary").otherwise("unknown")


def creators_of(creators: Column, *roles: str) -> Column:
    """[P37] Names of the creators of the given parts, in order: ``Last, First`` or the single-field name. Unknown ones are asked for beside primary ones, so that none is lost."""
    name = lambda c: F.coalesce(F.nullif(F.trim(c["name"]), F.lit("")), F.concat_ws(", ", F.nullif(F.trim(c["lastName"]), F.lit("")), F.nullif(F.trim(c["firstName"]), F.lit(""))))
    return F.transform(F.filter(creators, lambda c: creator_role(c["creatorType"]).isin(*roles)), name)


# The fields of a remote record that may hold its venue, in order.
VENUE_FIELDS = ("publicationTitle", "bookTitle", "proceedingsTitle", "encyclopediaTitle", "dictionaryTitle", "blogTitle", "websiteTitle", "repository")


def venue(*fields: Column, extra: Column | None = None) -> Column:
    """[P39] The first field that isn't blank, else what a line ``Publication Title:`` of the free text says."""
    said = [F.nullif(F.trim(F.regexp_extract(F.coalesce(extra, F.lit("")), r"(?im)^[ \t]*Publication Title[ \t]*:[ \t]*(.+)$", 1)), F.lit(""))] if extra is not None else []
    return F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in fields], *said)


def pmid_of(c: Column) -> Column:
    """[P41] The PMID that free text gives."""
    return F.nullif(F.regexp_extract(c, r"(?i)\bPMID:\s*(\d+)", 1), F.lit(""))


def annotation_page(label: Column, index: Column) -> Column:
    """[P44] Page of an annotation: its label where that is a number, else the first part of its sort index, counted from one, else 0."""
    first = F.trim(F.split(F.coalesce(index, F.lit("")), r"\|")[0])
    number = lambda c: F.when(c.rlike(r"^\d{1,9}$"), c).cast("int")
    return F.coalesce(number(F.trim(label)), number(first) + 1, F.lit(0))


def annotation_height(index: Column) -> Column:
    """[P44] Place on the page: the second part of the sort index, else 0."""
    part = F.trim(F.try_element_at(F.split(F.coalesce(index, F.lit("")), r"\|"), F.lit(2)))
    return F.coalesce(F.when(part.rlike(r"^\d{1,9}$"), part).cast("int"), F.lit(0))


def annotation_text(kind: Column, text: Column, comment: Column) -> Column:
    """[P44] What an annotation says: a highlight's text with its comment below it, of other kinds the comment, else the text."""
    text, comment = F.trim(F.coalesce(text, F.lit(""))), F.trim(F.coalesce(comment, F.lit("")))
    marked = F.when(comment == "", text).when(text == "", comment).otherwise(F.concat(text, F.lit("\n  \n  — "), comment))
    return F.when(kind.isin("highlight", "underline"), marked).otherwise(F.coalesce(F.nullif(comment, F.lit("")), text))


def proof_marks(c: Column) -> Column:
    """[P46] How many placeholders for page ranges a text holds; published versions have none."""
    return F.regexp_count(c, F.lit(r"[xX]{3,}\s*[-–—]\s*[xX]{3,}|\b0{3}\s*[-–—]\s*0{3}\b|XXXX,\s*XXX"))


def name_conflict(stem: Column, doi: Column, template: str = r"(?i)1-s2\.0-S?[\dX-]{8,}(?:-main)?") -> Column:
    """[P50] Whether a file's stem speaks against a DOI: it has five digits in a row, isn't a publisher's own name, has six characters or more, and neither it nor the DOI (whole, or after its slash) contains the other."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9.]", "")
    name, full, tail = bare(stem), bare(doi), bare(F.regexp_replace(doi, r"^[^/]*/", ""))
    apart = lambda other: ~F.contains(name, other) & ~F.contains(other, name)
    return F.coalesce(stem.rlike(r"\d{5}") & ~stem.rlike(template) & (F.length(name) >= 6) & apart(full) & apart(tail), F.lit(False))


def title_on_page(title: Column, page: Column, share: float = 0.6, run: int = 4) -> Column:
    """[P51] Whether a page shows a title: enough of its words, and four of them in a row; titles of fewer words need the words only."""
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    t, p = words(title), words(page)
    text = F.array_join(p, " ")
    inrow = F.exists(F.sequence(F.lit(1), F.greatest(F.size(t) - run + 1, F.lit(1))), lambda i: F.contains(text, F.array_join(F.slice(t, i, run), " ")))
    return F.coalesce((F.size(t) > 0) & (overlap(F.array_distinct(t), p) >= share) & ((F.size(t) < run) | inrow), F.lit(False))


def pdf_bytes(c: Column) -> Column:
    """Whether a file's first 1,024 bytes hold the mark of a PDF."""
    return F.contains(F.substring(c, 1, 1024), F.lit(b"%PDF-"))


# Marks of the styles of citing.
BRACKET = r"\[(\d{1,3}(?:\s*[,;–-]\s*\d{1,3})*)\]"
PAREN = r"\((\d{1,3}(?:\s*[,;–-]\s*\d{1,3})*)\)"
SUPER = r"[a-zÀ-ɏ]{3,}[.,;:)]\s?(\d{1,3}(?:[,;–-]\d{1,3})*)(?=[\s–]|$)"
SUPER_LOOSE = r"[a-zÀ-ɏ]{4,}(\d{1,3}(?:[,;–-]\d{1,3})*)(?=[\s.,;:)]|$)"
# Words that a number may follow without being a mark.
UNITS = "nm|cm|mm|km|mol|kj|kcal|ev|hz|ps|ns|fs|ms|kda|da|mpa|gpa|fig|figure|table|eq|equation|ref|chapter|section|no|vol|type|group|level|phase|mode|state|form|step|case|class|model|run|set|site|sample|series|region|zone|layer|stage|part|line|row|column|point|page|chain|atom|residue|loop"


def loose_marks(c: Column) -> Column:
    """Numbers that stand right behind a word, as raised marks do, but for those behind a unit or the name of a figure, table or the like."""
    found = F.regexp_extract_all(c, F.lit("(" + SUPER_LOOSE + ")"), 1)
    kept = F.filter(found, lambda m: ~F.regexp_extract(m, r"^([^\d]+)", 1).rlike(f"(?:{UNITS})$"))
    return F.transform(kept, lambda m: F.regexp_extract(m, r"(\d.*)$", 1))


def single_url(c: Column) -> Column:
    """[P35] Whether a text is exactly one web address."""
    return c.rlike(r"^https?://[^\s]+\.[^\s]+$") & ~c.rlike(r"https?://.*https?://")


def appended_line(text: Column, label: str, value: Column) -> Column:
    """[P36] Text with a ``label: value`` line, added only where no line has that label."""
    has = F.exists(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.lower(x).startswith(label.lower() + ":"))
    return F.when(has, text).otherwise(F.concat_ws("\n", F.nullif(text, F.lit("")), F.concat(F.lit(label + ": "), value)))


def personlike(c: Column) -> Column:
    """[P38] Why a single-field name reads as a person's: initials before a capitalised word, or two or three capitalised words; else empty. For reports: an organisation may read so too."""
    n = F.trim(F.coalesce(c, F.lit("")))
    initials = n.rlike(r"^(?:[A-Z]\.\s*)+[A-Z][a-z]")
    capitalised = n.rlike(r"^\p{Lu}\p{Ll}* {1,2}\p{Lu}\p{Ll}*$|^\p{Lu}\p{Ll}* \p{Lu}\p{Ll}* \p{Lu}\p{Ll}*$")
    return F.when(initials, "initials then a capitalised word").when(capitalised, "two or three capitalised words").otherwise("")


def dois_of_filename(c: Column) -> Column:
    """[P4] DOIs spelled in a file name, cleaned: as they are, then with the first underscore, or else hyphen, after the registrant for the slash."""
    name = F.regexp_replace(c, r"(?i)\.pdf$", "")
    spelled = F.transform(F.regexp_extract_all(name, F.lit(r"(?i)\b(10\.\d{4,9}[_-][^\s/]+)"), 1), lambda m: F.when(F.contains(m, F.lit("_")), F.regexp_replace(m, r"^([^_]*)_", "$1/")).otherwise(F.regexp_replace(m, r"^([^-]*)-", "$1/")))
    return F.transform(F.concat(doi_find(name), spelled), doi_clean)


def clean_url(c: Column) -> Column:
    """[P35] A text that is one web address and nothing else; else empty: several run together are refused, not taken apart."""
    v = F.trim(F.coalesce(c, F.lit("")))
    return F.when(v.rlike(r"(?i)^https?://\S+$") & ~F.contains(v, F.lit("\\n")), v).otherwise("")


def author_list(authors: Column) -> Column:
    """[P45] ``Last, First and ...``; organisations in braces."""
    return F.array_join(F.transform(authors, lambda a: F.coalesce(F.concat(F.lit("{"), a["name"], F.lit("}")), F.concat_ws(", ", a["last_name"], a["first_name"]))), " and ")


def failure_kind(c: Column) -> Column:
    """[P47] Interrupted before network before auth before other, by fixed phrases."""
    said = F.lower(c)
    has = lambda phrases: F.coalesce(F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(said, p)), F.lit(False))
    return F.when(has(INTERRUPTED), "interrupted").when(has(NETWORK), "network").when(has(AUTH), "auth").otherwise("other")


def described(author: Column, year: Column, title: Column, journal: Column) -> Column:
    """[P48] One line for a reference."""
    return F.concat_ws(" ", author, F.concat(F.lit("("), year, F.lit(")")), title, journal)


def outward(c: Column) -> Column:
    """[P49] Whether a reference points outward: a venue's or publisher's word, or volume and pages."""
    return c.rlike(VENUE) | c.rlike(VOLUME_PAGES)


def authored(c: Column) -> Column:
    """[P49] Whether a text has a name with initials in the shape of a bibliography's author."""
    return c.rlike(AUTHOR)


def glued(c: Column) -> Column:
    """[P49] Whether an entry of 80 characters or more holds two references run together: a label inside, or two years and two spans of pages."""
    years = F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(1[89]\d{2}|20\d{2})\b"), 1)))
    return (F.length(c) >= 80) & (F.substring(c, 21, 1 << 30).rlike(r"\S\s*[\[(]\s*\d{1,3}\s*[\])l]\s*[A-Z]") | ((years >= 2) & (F.regexp_count(c, F.lit(VOLUME_PAGES)) >= 2)))


# Fixed value: a mark of author and year in parentheses.
AUTHOR_YEAR = r"\([^()]{0,80}?[A-Za-z]{3,}[^()]{0,40}?(?:19|20)\d{2}[a-z]?\)"


def cites_by_name(c: Column) -> Column:
    """[F8] Whether a text cites by author and year: at least eight such marks, and more than numbers of any one style."""
    named = F.regexp_count(c, F.lit(AUTHOR_YEAR))
    return (named >= 8) & (named > F.greatest(*[F.regexp_count(c, F.lit(r)) for r in (BRACKET, PAREN, SUPER)]))
