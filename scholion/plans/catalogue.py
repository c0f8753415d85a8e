"""Queries of the library operators, each with SQL that gives the same rows.

Where an operator's input isn't among the tables (a ledger, runs, folders), the
tables stand in for it: orders for claims, their lines for sources, events for
runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholion.functions import scalars as S
from scholion.functions.text import LIGATURES, plain_letters
from scholion.operators import ledger, library, texts
from scholion.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


query.ORACLE = ORACLE


# -- ledger --------------------------------------------------------------------

_ROLE = F.concat
_LINKS_SQL = "links as (select l_orderkey as claim, l_suppkey as source, min(l_returnflag || l_linestatus) as role from lineitem group by 1, 2), weights as (select * from (values ('AF', 1.0), ('NF', 0.5), ('NO', 0.5), ('RF', 0.0)) as t(role, weight)), w as (select links.*, coalesce(weight, 0) as weight from links left join weights using (role))"


def _ledger(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    claims = table(s, d, "orders").select(F.col("o_orderkey").alias("claim"))
    links = ledger.links(table(s, d, "lineitem"), "l_orderkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus"))
    weights = s.createDataFrame([("AF", 1.0), ("NF", 0.5), ("NO", 0.5), ("RF", 0.0)], "role string, weight double")
    return claims, links, weights


@query("q12_load", f"with {_LINKS_SQL}, c as (select claim, count(*) as carriers from w where weight > 0 group by 1) select source, sum(weight)::double as load, count(*) as claims, count(*) filter (where carriers = 1) as sole from w join c using (claim) where weight > 0 group by 1")
def q12_load(s, d):
    _, links, weights = _ledger(s, d)
    return ledger.load_rank(links, weights)


@query("a6_thin", f"with {_LINKS_SQL}, c as (select claim, count(*) filter (where weight > 0) as carriers from w group by 1) select o_orderkey as claim, coalesce(carriers, 0) as carriers from orders left join c on claim = o_orderkey where coalesce(carriers, 0) <= 1")
def a6_thin(s, d):
    return ledger.thin_claims(*_ledger(s, d))


@query("a6_orphans", f"with {_LINKS_SQL}, c as (select claim, count(*) filter (where weight > 0) as carriers, count(*) as n from w group by 1) select o_orderkey as claim, case when coalesce(n, 0) = 0 then 'bare' else 'uncarried' end as kind from orders left join c on claim = o_orderkey where coalesce(carriers, 0) = 0")
def a6_orphans(s, d):
    return ledger.orphan_claims(*_ledger(s, d))


@query("a7_remainder", f"with {_LINKS_SQL}, hit as (select claim, role as lost_role from w where source = 1), kept as (select claim, count(*) filter (where weight > 0) as n from w where source <> 1 group by 1) select claim, lost_role, coalesce(n, 0) as \"left\", case when coalesce(n, 0) = 0 then 'falls' when n = 1 then 'thin' else 'stands' end as verdict from hit left join kept using (claim)")
def a7_remainder(s, d):
    _, links, weights = _ledger(s, d)
    return ledger.remainder(links, weights, F.lit(1))


@query("j9_unresolved", f"with {_LINKS_SQL} select source, count(*) as claims from links where not exists (select 1 from supplier where s_suppkey = source and s_acctbal > 0) group by 1")
def j9_unresolved(s, d):
    _, links, _ = _ledger(s, d)
    return ledger.unresolved(links, table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("key")))


@query("q26_violations", f"with {_LINKS_SQL} select distinct 'unknown role' as problem, claim from links where role not in ('AF', 'NF', 'RF') union select distinct 'link to no claim', claim from links where claim not in (select o_orderkey from orders where o_totalprice > 1000)")
def q26_violations(s, d):
    _, links, weights = _ledger(s, d)
    return ledger.violations(table(s, d, "orders").where("o_totalprice > 1000").select(F.col("o_orderkey").alias("claim")), links, weights.where("role <> 'NO'"))


@query("a9_histogram", "select o_orderstatus as status, count(*) as n, count(*) filter (where o_totalprice > 100000) as heavy from orders group by 1")
def a9_histogram(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("heavy"))


# -- scalars: one query a family, over whole columns --------------------------------


def _sql_plain(c: str) -> str:
    """SQL for :func:`scholion.functions.text.deaccent`."""
    src, dst = (x.replace("'", "''") for x in plain_letters())
    for a, b in LIGATURES:
        c = f"replace({c}, '{a}', '{b}')"
    return rf"regexp_replace(translate({c}, '{src}', '{dst}'), '\p{{M}}+', '', 'g')"


def _sql_list(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _sql_ascii(c: str) -> str:
    return rf"trim(regexp_replace(lower({_sql_plain(c)}), '[^a-z0-9 ]+', ' ', 'g'))"


# The SQL engine's word boundaries know ASCII only, and it can't look ahead.
_EDGE, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_SQL_VENUE, _SQL_PAGES, _SQL_AUTHOR = S.VENUE.replace(r"\b", _EDGE, 1), _EDGE + S.VOLUME_PAGES[2:-2] + _END, S.AUTHOR.replace(r"\b(?![A-Z])", _END)
_SQL_SURPLUS = "case when doi like '%{c}' and length(replace(doi, '{o}', '')) > length(replace(doi, '{c}', '')) then left(doi, length(doi) - 1) else doi end"
_SQL_CLEAN = r"regexp_replace(@, '[.,;:]+$', '')"
for _o, _c in (("(", ")"), ("[", "]")):
    _SQL_CLEAN = f"(select {_SQL_SURPLUS.format(o=_o, c=_c)} from (select {_SQL_CLEAN} as doi))"
_SQL_CLEAN = rf"regexp_replace({_SQL_CLEAN}, '[.,;:]+$', '')"


def _scalar(name: str, source: str, key: str, made: dict[str, tuple[Callable[[], Column], str]], where: str | None = None) -> None:
    """A projection of a table: its key and the given columns, in Spark and in SQL."""

    def run(s: SparkSession, d: str) -> DataFrame:
        t = table(s, d, source)
        t = t.where(where) if where else t
        return t.select(key, *[f().alias(c) for c, (f, _) in made.items()])

    QUERIES[name] = run
    ORACLE[name] = f"select {key}, {', '.join(f'{q} as {c}' for c, (_, q) in made.items())} from {source}" + (f" where {where}" if where else "")


_scalar("p1_p2_dois", "refs", "ref_id", {
    "normal": (lambda: S.doi_normal(F.col("doi")), r"nullif(regexp_replace(regexp_replace(lower(trim(doi)), '^(https?://(dx\.)?doi\.org/|doi:\s*)', ''), '[ .;,]+$', ''), '')"),
    "clean": (lambda: S.doi_clean(F.col("doi")), _SQL_CLEAN.replace("@", "refs.doi")),
    "in_raw": (lambda: F.size(S.doi_find(F.coalesce("raw", F.lit("")))), r"len(regexp_extract_all(coalesce(raw, ''), '10\.\d{4,9}/[^\s\"<>]+'))"),
})
QUERIES["scalar_dois"], ORACLE["scalar_dois"] = QUERIES.pop("p1_p2_dois"), ORACLE.pop("p1_p2_dois")
_scalar("scalar_titles", "refs", "ref_id", {
    "key": (lambda: S.title_key(F.col("title")), r"regexp_replace(lower(title), '[^\p{L}\p{N}]+', '', 'g')"),
    "ascii": (lambda: S.title_ascii(F.col("title")), _sql_ascii("title")),
    "ascii_key": (lambda: S.title_ascii_key(F.col("title")), rf"regexp_replace(lower({_sql_plain('title')}), '[^a-z0-9]+', '', 'g')"),
    "words": (lambda: F.array_join(S.significant(F.col("title")), " "), f"array_to_string(list_sort(list_distinct(list_filter(string_split({_sql_ascii('title')}, ' '), lambda w: length(w) > 3 and w not in {_sql_list(S.LIGHT_WORDS)}))), ' ')"),
    "year_found": (lambda: S.year_first(F.col("year")), r"try_cast(nullif(regexp_extract(year, '(1[6-9]\d\d|20\d\d)', 1), '') as int)"),
    "outward": (lambda: S.outward(F.col("raw")), f"regexp_matches(raw, '{_SQL_VENUE}') or regexp_matches(raw, '{_SQL_PAGES}')"),
    "authored": (lambda: S.authored(F.left("raw", F.lit(60))), f"regexp_matches(left(raw, 60), '{_SQL_AUTHOR}')"),
    "pmid": (lambda: S.pmid_of(F.col("raw")), r"nullif(regexp_extract(raw, '(?i)\bPMID:\s*(\d+)', 1), '')"),
    "first_name_of": (lambda: S.bib_author(F.col("author")), r"nullif(trim(case when contains(trim(split_part(author, ' and ', 1)), ',') then split_part(trim(split_part(author, ' and ', 1)), ',', 1) else regexp_extract(trim(split_part(author, ' and ', 1)), '(\S+)$', 1) end), '')"),
    "one_line": (lambda: S.described(F.col("author"), F.col("year"), F.col("title"), F.col("journal")), "concat_ws(' ', author, '(' || year || ')', title, journal)"),
})
_scalar("scalar_keys", "entries", "entry_id", {
    "name_part": (lambda: S.key_name(S.first_person(F.col("authors"))), "coalesce(nullif(case when upper(an) = an then an else upper(left(an, 1)) || lower(substr(an, 2)) end, ''), 'Anon')"),
    "word_part": (lambda: S.key_word(F.col("title")), r"coalesce(upper(left(w, 1)) || lower(substr(w, 2)), 'Untitled')"),
    "surname_cited": (lambda: F.when(F.col("surname").isNotNull(), S.cited_surname(F.col("surname"))), r"if(surname is null, null, list_reduce(list_prepend('', regexp_extract_all(surname, '[A-Z][A-Za-z''-]+')), lambda a, b: case when length(b) > length(a) then b else a end))"),
    "backend": (lambda: S.backend_of(F.col("qid")), "case when regexp_extract(qid, '^([a-z]+):', 1) = '' then 'zotero' when regexp_extract(qid, '^([a-z]+):', 1) in ('zotero', 'mendeley') then regexp_extract(qid, '^([a-z]+):', 1) end"),
    "local": (lambda: S.local_id(F.col("qid")), "regexp_replace(qid, '^(zotero|mendeley):', '')"),
    "page_no": (lambda: S.folio(F.col("firstpage")), r"try_cast(case when regexp_matches(firstpage, '^\d+-\d+$') then regexp_extract(firstpage, '-(\d+)$', 1) when regexp_matches(firstpage, '^[A-Z]?\d+$') then regexp_extract(firstpage, '(\d+)$', 1) end as int)"),
})
_SQL_PERSON = "coalesce(nullif(trim(authors[1].last_name), ''), nullif(trim(authors[1].name), ''), nullif(trim(authors[1].first_name), ''))"
ORACLE["scalar_keys"] = ORACLE["scalar_keys"].replace(" from entries", f" from (select *, coalesce(list_filter(ws, lambda x: length(x) > 2 and lower(x) not in {_sql_list(S.KEY_SKIP)})[1], ws[1]) as w, regexp_replace({_sql_plain(_SQL_PERSON)}, '[^A-Za-z]', '', 'g') as an from (select *, list_filter(string_split(regexp_replace({_sql_plain('title')}, '[^A-Za-z]+', ' ', 'g'), ' '), lambda x: x <> '') as ws from entries))")
_scalar("scalar_texts", "documents", "doc_id", {
    "squeezed": (lambda: F.md5(S.squeeze(F.col("text"))), r"md5(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')))"),
    "untagged": (lambda: F.md5(S.without_tags(F.col("text"))), r"md5(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')))"),
    "cleared": (lambda: F.md5(S.without_controls(F.col("text"))), r"md5(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'))"),
    "alnum": (lambda: F.round(S.alnum_share(F.col("text")), 9), r"round(case when length(regexp_replace(text, '[ \t\n\x0b\f\r]+', '', 'g')) = 0 then 1.0 else length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'))::double / length(regexp_replace(text, '[ \t\n\x0b\f\r]+', '', 'g')) end, 9)"),
    "sha16": (lambda: S.body_hash(F.col("text")), "left(sha256(text), 16)"),
    "characters": (lambda: F.length("text"), "length(text)"),
})
_scalar("scalar_pages", "raw_pages", "page_id", {
    "stem": (lambda: S.stem_key(F.col("doc")), r"case when regexp_matches(doc, '-([2-9]|[1-9]\d+)$') then regexp_replace(doc, '-\d+$', '') else doc end"),
    "file_no": (lambda: S.stem_number(F.col("doc")), r"coalesce(try_cast(nullif(regexp_extract(doc, '-([2-9]|[1-9]\d+)$', 1), '') as int), 1)"),
    "joined": (lambda: F.md5(S.page_clean(F.col("text"))), r"md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '([0-9A-Za-z_])-\n([0-9A-Za-z_])', '\1\2', 'g'), '([^\n.:;!?])\n([^\n\-0-9•*])', '\1 \2', 'g'), '\n{3,}', chr(10) || chr(10), 'g')))"),
    "garbled": (lambda: (F.length(F.regexp_replace("text", r"\s+", "")) >= 200) & (S.alnum_share(F.col("text")) < 0.25), r"length(regexp_replace(text, '[ \t\n\x0b\f\r]+', '', 'g')) >= 200 and length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'))::double / length(regexp_replace(text, '[ \t\n\x0b\f\r]+', '', 'g')) < 0.25"),
})
_scalar("scalar_files", "attachments", "att_key", {
    "is_pdf_name": (lambda: F.coalesce(F.lower("filename").endswith(".pdf"), F.lit(False)), "coalesce(lower(filename) like '%.pdf', false)"),
    "ext": (lambda: F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]{1,5})$", 1)), r"lower(regexp_extract(filename, '\.([A-Za-z0-9]{1,5})$', 1))"),
    "wrong_type": (lambda: F.coalesce(F.lower("filename").endswith(".pdf") & (F.col("content_type") != "application/pdf"), F.lit(False)), "coalesce(lower(filename) like '%.pdf' and content_type <> 'application/pdf', false)"),
    "stored": (lambda: F.coalesce(F.col("link_mode").isin("imported_file", "imported_url"), F.lit(False)), "coalesce(link_mode in ('imported_file', 'imported_url'), false)"),
})
_scalar("scalar_authors", "entries", "entry_id", {
    "authors_text": (lambda: S.author_list(F.col("authors")), "array_to_string(list_transform(authors, lambda a: coalesce('{' || a.name || '}', concat_ws(', ', a.last_name, a.first_name))), ' and ')"),
    "last_word": (lambda: S.last_name(F.regexp_replace("surname", r"\s+", " ")), r"string_split(trim(regexp_replace(surname, '[ \t\n\x0b\f\r]+', ' ', 'g')), ' ')[-1]"),
    "doc_type": (lambda: F.element_at(F.create_map(*[F.lit(x) for kv in (("article", "journal"), ("inproceedings", "conference_proceedings"), ("incollection", "book_section"), ("phdthesis", "thesis")) for x in kv]), F.col("entry_type")), "case entry_type when 'article' then 'journal' when 'inproceedings' then 'conference_proceedings' when 'incollection' then 'book_section' when 'phdthesis' then 'thesis' end"),
    "noted": (lambda: S.appended_line(F.col("journal"), "Volume", F.col("volume")), "case when journal is null then 'Volume: ' || volume when volume is null then journal else journal || chr(10) || 'Volume: ' || volume end"),
})
ORACLE["scalar_authors"] = ORACLE["scalar_authors"].replace("case when journal is null then 'Volume: ' || volume when volume is null then journal else journal || chr(10) || 'Volume: ' || volume end", "concat_ws(chr(10), nullif(journal, ''), 'Volume: ' || volume)")


# -- keys, ids, stems -----------------------------------------------------------


@query("w7_minted", "with b as (select entry_id as id, added_at as created, coalesce(nullif(regexp_replace(surname, '[^A-Za-z]', '', 'g'), ''), 'Anon') || coalesce(nullif(regexp_extract(year, '(1[6-9]\\d\\d|20\\d\\d)', 1), ''), 'x') || '0' as base from entries), r as (select *, row_number() over (partition by base order by created, id) - 1 as k from b) select id, base || case when k = 0 then '' when k <= 26 then chr((k + 96)::int) else chr(((k - 27) // 26 + 97)::int) || chr(((k - 27) % 26 + 97)::int) end as \"key\" from r")
def w7_minted(s, d):
    name = F.coalesce(F.nullif(F.regexp_replace("surname", "[^A-Za-z]", ""), F.lit("")), F.lit("Anon"))
    year = F.coalesce(F.nullif(F.regexp_extract("year", r"(1[6-9]\d\d|20\d\d)", 1), F.lit("")), F.lit("x"))
    docs = table(s, d, "entries").select(F.col("entry_id").alias("id"), F.col("added_at").alias("created"), F.concat(name, year, F.lit("0")).alias("base"))
    return library.minted_keys(docs, table(s, d, "entries").select(F.col("citekey").alias("key")))


@query("w8_stems", "with f as (select att_key, citekey, row_number() over (partition by citekey order by ord, att_key) as n from attachments join entries on parent_qid = qid) select att_key, case when n = 1 then citekey else citekey || '-' || n end as stem from f")
def w8_stems(s, d):
    files = table(s, d, "attachments").join(table(s, d, "entries").select(F.col("qid").alias("parent_qid"), "citekey"), "parent_qid")
    return library.stems(files)


@query("w9_seats", "with f as (select parent_qid as doc, att_key as id, case when ord % 2 = 1 then ord end as seat from attachments where parent_qid is not null), t as (select doc, count(*) as n from f group by 1), pin as (select doc, id, seat as place, count(*) over (partition by doc, seat) > 1 as anomaly from f where seat is not null), free as (select doc, place, row_number() over (partition by doc order by place) as k from (select doc, unnest(range(1, n + 1)) as place from t) x where not exists (select 1 from pin where pin.doc = x.doc and pin.place = x.place)), loose as (select doc, id, row_number() over (partition by doc order by id) as k from f where seat is null) select doc, id, place, anomaly from pin union all select loose.doc, id, place, false from loose left join free on loose.doc = free.doc and loose.k = free.k")
def w9_seats(s, d):
    files = table(s, d, "attachments").where("parent_qid is not null").select(F.col("parent_qid").alias("doc"), F.col("att_key").alias("id"), F.when(F.col("ord") % 2 == 1, F.col("ord")).cast("bigint").alias("seat"))
    return library.seats(files)


@query("j1_resolved", "select count(*) as files, count(citekey) as resolved, count(*) - count(citekey) as unresolved from attachments left join entries on parent_qid = qid")
def j1_resolved(s, d):
    x = table(s, d, "attachments").join(table(s, d, "entries").select(F.col("qid").alias("parent_qid"), "citekey"), "parent_qid", "left")
    return x.agg(F.count(F.lit(1)).alias("files"), F.count("citekey").alias("resolved"), F.count_if(F.col("citekey").isNull()).alias("unresolved"))


@query("s3_files_by_doc", "select parent_qid, count(*) as files, array_to_string(list(att_key order by ord, att_key), ' ') as keys, min(seen_at) as first_seen from attachments where link_mode <> 'linked_url' and parent_qid in (select qid from entries) group by 1")
def s3_files_by_doc(s, d):
    a = table(s, d, "attachments").where("link_mode <> 'linked_url'").join(table(s, d, "entries").select(F.col("qid").alias("parent_qid")), "parent_qid", "left_semi")
    return a.groupBy("parent_qid").agg(F.count(F.lit(1)).alias("files"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "att_key"))), lambda x: x["att_key"]), " ").alias("keys"), F.min("seen_at").alias("first_seen"))


@query("j25_collisions", "with x as (select regexp_replace(qid, '^(zotero|mendeley):', '') as local, qid from entries) select local, count(*) as ids, min(qid) as first_id from x group by 1 having count(*) > 1")
def j25_collisions(s, d):
    x = table(s, d, "entries").select(S.local_id(F.col("qid")).alias("local"), "qid")
    return x.groupBy("local").agg(F.count(F.lit(1)).alias("ids"), F.min("qid").alias("first_id")).where("ids > 1")


# -- joins with verdicts ---------------------------------------------------------

_N = r"nullif(regexp_replace(regexp_replace(lower(trim(doi)), '^(https?://(dx\.)?doi\.org/|doi:\s*)', ''), '[ .;,]+$', ''), '')"
_K = r"regexp_replace(lower(regexp_replace(title, '[^\x20-\x7e]', '', 'g')), '[^a-z0-9]+', '', 'g')"


def _doi() -> Column:
    return S.doi_normal(F.col("doi"))


def _key() -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace("title", r"[^\x20-\x7e]", "")), "[^a-z0-9]+", "")


def _held(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "refs").select("ref_id", "src_key", _doi().alias("doi"), F.coalesce(_key(), F.lit("")).alias("title_key"))
    return library.held(r, table(s, d, "entries").select(_doi().alias("doi"), _key().alias("title_key")))


_HELD_SQL = f"r as (select ref_id, src_key, {_N} as doi, coalesce({_K}, '') as title_key from refs), e as (select {_N} as doi, {_K} as title_key from entries), h as (select r.*, (doi is not null and doi in (select doi from e where doi is not null)) or title_key in (select title_key from e where title_key <> '') as held from r)"


@query("j6_held", f"with {_HELD_SQL} select ref_id, coalesce(held, false) as held from h")
def j6_held(s, d):
    return _held(s, d).select("ref_id", "held")


@query("q10_gaps", f"with {_HELD_SQL} select doi, count(distinct src_key) as papers, count(*) as lines from h where not coalesce(held, false) and doi is not null group by 1")
def q10_gaps(s, d):
    return library.gaps(_held(s, d))


@query("a4_demand", f"with {_HELD_SQL}, g as (select doi, count(distinct src_key) as papers from h where not coalesce(held, false) and doi is not null group by 1) select count(*) as gaps, count(*) filter (where papers <= 1) as once, count(*) filter (where papers >= 3) as three, count(*) filter (where papers >= 5) as five from g")
def a4_demand(s, d):
    g = library.gaps(_held(s, d))
    return g.agg(F.count(F.lit(1)).alias("gaps"), F.count_if(F.col("papers") <= 1).alias("once"), F.count_if(F.col("papers") >= 3).alias("three"), F.count_if(F.col("papers") >= 5).alias("five"))


@query("j3_by_doi", f"with e as (select {_N} as doi, arg_max(citekey, entry_id) as \"match\" from entries where {_N} is not null group by 1) select ref_id, \"match\" from (select ref_id, {_N} as doi from refs) r left join e using (doi)")
def j3_by_doi(s, d):
    last = library.last_by_doi(table(s, d, "entries").select(_doi().alias("doi"), F.col("entry_id").alias("ord"), F.col("citekey").alias("key")))
    return library.joined_by_doi(table(s, d, "refs").select("ref_id", _doi().alias("doi")), last)


@query("q3_edges", f"with e as (select {_N} as doi, arg_max(citekey, entry_id) as m from entries where {_N} is not null group by 1) select ref_id, src_key, case when m <> src_key then m end as \"match\" from (select ref_id, src_key, {_N} as doi from refs) r join e using (doi)")
def q3_edges(s, d):
    last = library.last_by_doi(table(s, d, "entries").select(_doi().alias("doi"), F.col("entry_id").alias("ord"), F.col("citekey").alias("key")))
    return library.without_self(table(s, d, "refs").select("ref_id", "src_key", _doi().alias("doi")).join(last, "doi").select("ref_id", "src_key", F.col("key").alias("match")))


@query("j5_unique", "with r as (select ref_id, upper(author) as who, try_cast(nullif(regexp_extract(year, '(1[6-9]\\d\\d|20\\d\\d)', 1), '') as int) as y, raw from refs where doi is null and title is null), e as (select entry_id as candidate, upper(surname) as who, try_cast(nullif(regexp_extract(year, '(1[6-9]\\d\\d|20\\d\\d)', 1), '') as int) as y, volume, firstpage from entries), c as (select ref_id, candidate, case when contains(raw, volume) and contains(raw, firstpage) then 2 else 1 end as score from r join e using (who, y)), t as (select ref_id, max(score) as top from c group by 1), b as (select ref_id, count(*) as n, min(candidate) as candidate from c join t using (ref_id) where score = top group by 1) select ref_id, case when n = 1 then candidate end as \"match\", case when n = 1 then 'matched' else 'tie' end as verdict from b")
def j5_unique(s, d):
    r = table(s, d, "refs").where("doi is null and title is null").select("ref_id", F.upper("author").alias("who"), S.year_first(F.col("year")).alias("y"), "raw")
    e = table(s, d, "entries").select(F.col("entry_id").alias("candidate"), F.upper("surname").alias("who"), S.year_first(F.col("year")).alias("y"), "volume", "firstpage")
    c = r.join(e, ["who", "y"]).select("ref_id", "candidate", F.when(F.col("raw").contains(F.col("volume")) & F.col("raw").contains(F.col("firstpage")), 2).otherwise(1).alias("score"))
    return library.unique_best(c, "ref_id", "score")


@query("q11_doi_audit", f"with t as (select {_N} as doi, min({_K}) as t, min(author) as s from refs where {_N} is not null and title is not null group by 1), x as (select citekey as \"key\", {_N} as doi, {_K} as title_key, surname from entries) select \"key\", case when doi is null then 'no doi' when t is null then 'unknown doi' when t <> title_key then 'other title' when surname is null or s is null then 'skip' when lower(surname) = lower(s) then 'agree' when lower(surname) like '%' || lower(s) or lower(s) like '%' || lower(surname) then 'particle' else 'mismatch' end as verdict from x left join t using (doi)")
def q11_doi_audit(s, d):
    theirs = table(s, d, "refs").where("title is not null").select(_doi().alias("doi"), _key().alias("k"), "author").where("doi is not null").groupBy("doi").agg(F.min("k").alias("title_key"), F.min("author").alias("surname"))
    return library.doi_audit(table(s, d, "entries").select(F.col("citekey").alias("key"), _doi().alias("doi"), _key().alias("title_key"), "surname"), theirs)


@query("j10_diff", "with o as (select * from entries where batch_no < 6), n as (select entry_id, title, case when entry_id % 5 = 0 then '1999' else year end as year, journal from entries where batch_no > 0) select entry_id, case when o.entry_id is null then 'new' when n.entry_id is null then 'gone' when o.title is not distinct from n.title and o.year is not distinct from n.year and o.journal is not distinct from n.journal then 'same' else 'changed' end as verdict from o full join n using (entry_id)")
def j10_diff(s, d):
    e = table(s, d, "entries")
    return library.snapshot_diff(e.where("batch_no < 6"), e.where("batch_no > 0").withColumn("year", F.when(F.col("entry_id") % 5 == 0, "1999").otherwise(F.col("year"))), "entry_id", ["title", "year", "journal"])


@query("q20_changes", "with o as (select entry_id, unnest([{'field': 'title', 'v': title}, {'field': 'year', 'v': year}], recursive := true) from entries), n as (select entry_id, unnest([{'field': 'title', 'v': title || '.'}, {'field': 'year', 'v': case when entry_id % 7 = 0 then null else year end}], recursive := true) from entries) select entry_id, field, o.v as before, n.v as \"after\" from o full join n using (entry_id, field) where o.v is distinct from n.v")
def q20_changes(s, d):
    e = table(s, d, "entries").select("entry_id", "title", "year")
    return library.field_changes(e, e.withColumn("title", F.concat("title", F.lit("."))).withColumn("year", F.when(F.col("entry_id") % 7 != 0, F.col("year"))), "entry_id", ["title", "year"])


@query("j15_siblings", f"with x as (select entry_id as id, coalesce({_K}, '') as k from entries), n as (select k, count(*) as n from x where k <> '' group by 1) select id, coalesce(n, 1) - 1 as siblings, case when coalesce(n, 1) > 1 then 'survivor exists' else 'last copy' end as verdict from x left join n using (k)")
def j15_siblings(s, d):
    return library.siblings(table(s, d, "entries").select(F.col("entry_id").alias("id"), F.coalesce(_key(), F.lit("")).alias("title_key")))


@query("j22_findings", "with ev as (select citekey, ref_ordinal as ordinal, count(*) filter (where kind = 'CHECKED') as checks, count(*) filter (where kind = 'RETRACTED') as retractions from findings where kind in ('CHECKED', 'RETRACTED') group by 1, 2) select record_id, coalesce(checks, 0) as checks, coalesce(retractions, 0) as retractions, case when retractions > 0 then 'retracted' when checks > 0 then 'checked' else 'live' end as state from findings f left join ev using (citekey, ordinal) where kind = 'FINDING'")
def j22_findings(s, d):
    return library.current_findings(table(s, d, "findings")).select("record_id", "checks", "retractions", "state")


@query("a21_states", "with ev as (select citekey, ref_ordinal as ordinal, count(*) filter (where kind = 'CHECKED') as checks, count(*) filter (where kind = 'RETRACTED') as retractions from findings where kind in ('CHECKED', 'RETRACTED') group by 1, 2) select case when retractions > 0 then 'retracted' when checks > 0 then 'checked' else 'live' end as state, count(*) as n, count(used_for) as used from findings f left join ev using (citekey, ordinal) where kind = 'FINDING' group by 1")
def a21_states(s, d):
    return library.current_findings(table(s, d, "findings")).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count("used_for").alias("used"))


@query("o8_live_first", "with ev as (select citekey, ref_ordinal as ordinal, true as dead from findings where kind = 'RETRACTED' group by 1, 2) select record_id, row_number() over (partition by citekey order by coalesce(dead, false), ordinal) as place from findings left join ev using (citekey, ordinal) where kind = 'FINDING'")
def o8_live_first(s, d):
    f = library.current_findings(table(s, d, "findings"))
    return f.select("record_id", F.row_number().over(Window.partitionBy("citekey").orderBy(F.col("state") == "retracted", "ordinal")).alias("place"))


@query("w11_ordinals", "select citekey, max(ordinal) + 1 as next_ordinal, count(*) as records, max(ordinal) - count(distinct ordinal) as missing from findings group by 1")
def w11_ordinals(s, d):
    return table(s, d, "findings").groupBy("citekey").agg((F.max("ordinal") + 1).alias("next_ordinal"), F.count(F.lit(1)).alias("records"), (F.max("ordinal") - F.count_distinct("ordinal")).alias("missing"))


@query("q14_stale", "with x as (select doc_id as \"key\", left(sha256(text), 16) as sha from documents where lang is not null), r as (select doc_id as \"key\", left(sha256(replace(text, chr(160), ' ')), 16) as was from documents where section is not null) select \"key\", case when sha is null then 'gone' when was is null then 'unread' when sha <> was then 'stale' else 'ok' end as verdict from x full join r using (\"key\")")
def q14_stale(s, d):
    docs = table(s, d, "documents").withColumnRenamed("doc_id", "key")
    now = docs.where("lang is not null").select("key", S.body_hash(F.col("text")).alias("sha"))
    return library.staleness(now, docs.where("section is not null").select("key", S.body_hash(F.replace("text", F.lit("\u00a0"), F.lit(" "))).alias("sha")))


@query("f13_skip", "with f as (select att_key as qid, md5 as filehash, filename as stem from attachments), st as (select att_key as qid, case when ord % 2 = 0 then md5 else md5 || 'x' end as was_hash, filename as was_stem, case when ord % 3 = 0 then 'failed' else 'ok' end as status, 2 + ord % 2 as rules from attachments where parent_qid is not null) select qid, case when status is null then 'new' when status not in ('ok', 'thin') then 'retry' when filehash is distinct from was_hash then 'changed' when stem is distinct from was_stem then 'moved' when rules < 3 then 'old rules' else 'skip' end as plan from f left join st using (qid)")
def f13_skip(s, d):
    a = table(s, d, "attachments")
    state = a.where("parent_qid is not null").select(F.col("att_key").alias("qid"), F.when(F.col("ord") % 2 == 0, F.col("md5")).otherwise(F.concat("md5", F.lit("x"))).alias("was_hash"), F.col("filename").alias("was_stem"), F.when(F.col("ord") % 3 == 0, "failed").otherwise("ok").alias("status"), (2 + F.col("ord") % 2).alias("rules"))
    return library.skip_unchanged(a.select(F.col("att_key").alias("qid"), F.col("md5").alias("filehash"), F.col("filename").alias("stem")), state, 3)


@query("j12_placed", "with f as (select parent_qid as doc, coalesce(filename, att_key) as file, lower(regexp_extract(filename, '\\.([A-Za-z0-9]{1,5})$', 1)) as ext from attachments where parent_qid is not null and ord <= 2), a as (select parent_qid as doc, att_key as att, case when ord > 1 then filename end as filename, lower(regexp_extract(filename, '\\.([A-Za-z0-9]{1,5})$', 1)) as ext from attachments where parent_qid is not null), n as (select f.doc, f.file, min(att) as att, 'name' as how from f join a on f.doc = a.doc and f.file = a.filename group by 1, 2), r1 as (select * from f where not exists (select 1 from n where n.doc = f.doc and n.file = f.file)), l1 as (select * from a where att not in (select att from n)), s as (select r.doc, r.file, l.att, 'single' as how from (select doc, min(file) as file from r1 group by 1 having count(*) = 1) r join (select doc, min(att) as att from l1 group by 1 having count(*) = 1) l using (doc)), r2 as (select * from r1 where not exists (select 1 from s where s.doc = r1.doc and s.file = r1.file)), l2 as (select * from l1 where att not in (select att from s)), k as (select r.doc, r.file, l.att, 'type' as how from (select doc, ext, min(file) as file from r2 group by 1, 2 having count(*) = 1) r join (select doc, ext, min(att) as att from l2 group by 1, 2 having count(*) = 1) l on r.doc = l.doc and r.ext = l.ext) select * from n union all select * from s union all select * from k union all select doc, file, null, 'refused' from r2 where not exists (select 1 from k where k.doc = r2.doc and k.file = r2.file)")
def j12_placed(s, d):
    a = table(s, d, "attachments").where("parent_qid is not null")
    ext = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]{1,5})$", 1)).alias("ext")
    files = a.where("ord <= 2").select(F.col("parent_qid").alias("doc"), F.coalesce("filename", "att_key").alias("file"), ext)
    return library.placed_files(files, a.select(F.col("parent_qid").alias("doc"), F.col("att_key").alias("att"), F.when(F.col("ord") > 1, F.col("filename")).alias("filename"), ext))


def _folders(s: SparkSession, d: str) -> DataFrame:
    """Regions over nations over suppliers, as folders; one loop and one orphan beside them."""
    r = table(s, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("int").alias("parent_id"))
    n = table(s, d, "nation").select((1000 + F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent_id"))
    p = table(s, d, "supplier").select((10000 + F.col("s_suppkey")).cast("int").alias("id"), F.col("s_name").alias("name"), (1000 + F.col("s_nationkey")).alias("parent_id"))
    return r.unionByName(n).unionByName(p).unionByName(s.createDataFrame([(-1, "a", -2), (-2, "b", -1), (-3, "c", -9)], "id int, name string, parent_id int"))


_PATHS_SQL = "f as (select r_regionkey as id, r_name as name, null::int as parent_id from region union all select 1000 + n_nationkey, n_name, n_regionkey from nation union all select (10000 + s_suppkey)::int, s_name, 1000 + s_nationkey from supplier), p as (select id, name as path, 'ok' as verdict from f where parent_id is null union all select f.id, p.path || '/' || f.name, 'ok' from f join p on f.parent_id = p.id)"


@query("d14_paths", f"with recursive {_PATHS_SQL} select * from p union all select * from (values (-1, null, 'loop'), (-2, null, 'loop'), (-3, null, 'orphan'))")
def d14_paths(s, d):
    return library.folder_paths(_folders(s, d))


@query("k4_folders", f"with recursive {_PATHS_SQL}, m as (select 1000 + c_nationkey as id, list_sort(list(distinct c_mktsegment)) as ks from customer where c_mktsegment <> 'BUILDING' group by 1) select path, array_to_string(coalesce(ks, []), ' ') as \"keys\" from p left join m using (id)")
def k4_folders(s, d):
    c = table(s, d, "customer")
    members = c.select((1000 + F.col("c_nationkey")).alias("folder_id"), F.col("c_custkey").alias("doc_id"))
    keys = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("citekey"))
    return library.folder_members(_folders(s, d), members, keys).select("path", F.array_join("keys", " ").alias("keys"))


@query("a18_inventory", "select md5, count(*) as files, count(distinct parent_qid) as parents, min(att_key) as first_file from attachments where md5 is not null group by 1 having count(*) > 1")
def a18_inventory(s, d):
    return table(s, d, "attachments").where("md5 is not null").groupBy("md5").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("parent_qid").alias("parents"), F.min("att_key").alias("first_file")).where("files > 1")


@query("a19_accounting", "select count(*) as files, count(*) filter (where parent_qid is null) as orphans, count(*) filter (where parent_qid is not null and filename is null) as unnamed, count(*) filter (where parent_qid is not null and filename is not null) as ready, true as reconciles from attachments")
def a19_accounting(s, d):
    g = table(s, d, "attachments").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("parent_qid").isNull()).alias("orphans"), F.count_if(F.col("parent_qid").isNotNull() & F.col("filename").isNull()).alias("unnamed"), F.count_if(F.col("parent_qid").isNotNull() & F.col("filename").isNotNull()).alias("ready"))
    return g.withColumn("reconciles", F.col("files") == F.col("orphans") + F.col("unnamed") + F.col("ready"))


@query("u3_missing_labels", "with l as (select src_key, max(ord) as top, count(distinct ord) as n from refs group by 1) select src_key, top, top - n as missing from l")
def u3_missing_labels(s, d):
    return table(s, d, "refs").groupBy("src_key").agg(F.max("ord").alias("top"), (F.max("ord") - F.count_distinct("ord")).alias("missing"))


# -- sequences -----------------------------------------------------------------------


@query("w1_runs", "with x as (select src_key, ord, row_number() over (partition by src_key order by ref_id) as n, lag(ord) over (partition by src_key order by ref_id) as p from refs), y as (select *, sum(case when p is null or ord <> p + 1 then 1 else 0 end) over (partition by src_key order by n) as run from x), r as (select src_key, run, min(ord) as start, count(*) as length, min(n) as n from y group by 1, 2), z as (select *, row_number() over (partition by src_key order by length desc, n) as k from r) select src_key, start, length from z where k = 1")
def w1_runs(s, d):
    return library.climbing_runs(table(s, d, "refs"), "src_key", ["ref_id"], "ord")


@query("w3_blocks", "with x as (select user_id, event_id as v, event_id - lag(event_id) over (partition by user_id order by event_id) as gap from events), y as (select *, sum(case when gap <= 60 then 0 else 1 end) over (partition by user_id order by v) as b from x), r as (select user_id, b, min(v) as first, max(v) as last, count(*) as size from y group by 1, 2), z as (select *, row_number() over (partition by user_id order by size desc, first) as k from r) select user_id, first, last, size from z where k = 1")
def w3_blocks(s, d):
    return library.dense_blocks(table(s, d, "events"), "user_id", "event_id", 60)


@query("p25_ranges", "with x as (select distinct citekey, ordinal from findings), y as (select *, ordinal - row_number() over (partition by citekey order by ordinal) as isle from x), g as (select citekey, min(ordinal) as a, max(ordinal) as b from y group by citekey, isle), k as (select *, row_number() over (partition by citekey order by a) as i from g) select citekey, string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) filter (where i <= 8) || case when count(*) > 8 then ', ...' else '' end as ranges from k group by 1")
def p25_ranges(s, d):
    return library.range_text(table(s, d, "findings"), "citekey", "ordinal")


@query("w12_streaks", "with x as (select *, event_type = 'error' as failed, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id) as island from events) select event_id, count(*) filter (where failed) over w as streak, case when failed then min(case when failed then ts end) over w end as failing_since from x window w as (partition by user_id, island order by ts, event_id rows unbounded preceding)")
def w12_streaks(s, d):
    return library.failure_streaks(table(s, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "streak", "failing_since")


@query("w4_spans", "select page_id, page, coalesce(lead(page) over (partition by doc order by page), 1000) as until from raw_pages")
def w4_spans(s, d):
    return library.next_starts(table(s, d, "raw_pages"), "doc", "page", F.lit(1000)).select("page_id", "page", "until")


@query("a12_offset", "with p as (select doc, page, unnest(list_distinct(list_transform(regexp_extract_all(text, '(?m)^[- —\\[]*(\\d{1,5})[- —\\]]*$', 1), lambda x: x::int - page))) as off from raw_pages), v as (select doc, off, count(distinct page) as votes from p group by 1, 2), t as (select doc, count(distinct page) as pages from p group by 1), m as (select doc, max(votes) as top from v group by 1), b as (select doc, count(*) as ties, min(off) as best, max(top) as top from v join m using (doc) where votes = top group by 1) select doc, case when ties = 1 and top >= greatest(3, floor(pages * 0.6)) then best end as \"offset\", top, pages, case when top < greatest(3, floor(pages * 0.6)) then 'too few' when ties > 1 then 'tie' else 'derived' end as verdict from b join t using (doc)")
def a12_offset(s, d):
    p = table(s, d, "raw_pages").select("doc", "page", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^[- —\[]*(\d{1,5})[- —\]]*$"), 1), lambda x: x.cast("int") - F.col("page")))).alias("off"))
    return library.offset_votes(p, "doc", "off", "page")


@query("a14_band", "select a.user_id, max(n) as pages from (select e.user_id, e.event_id, count(distinct f.event_type) as n from events e join events f on e.user_id = f.user_id and f.value between e.value and e.value + 5 group by 1, 2) a group by 1")
def a14_band(s, d):
    return library.banded_cluster(table(s, d, "events"), "user_id", "value", "event_type", 5)


@query("a22_quartile", "select source, list_sort(list(n_chars))[(count(*) // 4 + 1)::int] as q1 from documents group by 1")
def a22_quartile(s, d):
    x = table(s, d, "documents").withColumn("source", F.coalesce("source", F.lit("\0")))
    return library.quartile_at(x, "source", "n_chars").select(F.nullif("source", F.lit("\0")).alias("source"), "q1")


# -- text gates, mining, marks -------------------------------------------------------


def _page_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_pages").select("doc", "page", F.explode(F.split("text", "\n")).alias("line"))


_LINES = "l as (select doc, page, unnest(string_split(text, chr(10))) as line from raw_pages), t as (select doc, count(distinct page) as n from l group by 1), f as (select doc, page, line, lower(trim(regexp_replace(line, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) as folded from l), b as (select doc, folded as line, count(distinct page) as pages from f where folded <> '' group by 1, 2), bp as (select doc, line, pages, n as \"of\" from b join t using (doc) where n >= 3 and pages >= greatest(3, floor(n * 0.6)))"


@query("a15_boilerplate", f"with {_LINES} select doc, line, pages, \"of\" from bp")
def a15_boilerplate(s, d):
    return library.boilerplate(_page_lines(s, d), "doc", "page", "line")


@query("a16_content", f"with {_LINES}, k as (select doc, page, sum(length(trim(line))) as chars from f where not exists (select 1 from bp where bp.doc = f.doc and bp.line = f.folded) group by 1, 2), e as (select distinct doc, page from l) select doc, avg((coalesce(chars, 0) >= 80)::int::double) as text_share, count(*) as pages, case when avg((coalesce(chars, 0) >= 80)::int::double) < 0.5 then 'thin' else 'text' end as verdict from e left join k using (doc, page) group by 1")
def a16_content(s, d):
    return library.content_share(_page_lines(s, d), "doc", "page", "line")


_GATE_SQL = f"x as (select src_key, ord as n, label, coalesce(raw, '') as raw, regexp_matches(left(coalesce(raw, ''), 60), '{_SQL_AUTHOR}') as named, regexp_matches(coalesce(raw, ''), '{_SQL_VENUE}') or regexp_matches(coalesce(raw, ''), '{_SQL_PAGES}') as pointing from refs), j as (select *, coalesce(label = '0', false) or not (named and pointing) as junk, row_number() over (partition by src_key order by n, raw) as k, count(*) over (partition by src_key) as total from x), h as (select src_key, any_value(total) as total, list(junk order by k) filter (where k <= 3) as hs, list({{'n': n, 'raw': raw}} order by k) filter (where k <= 3) as ps from j group by 1), t as (select src_key, ps, case when total > 10 and hs[1] and hs[2] and hs[3] then 3 when total > 9 and hs[1] and hs[2] then 2 when total > 8 and hs[1] then 1 else 0 end as trimmed from h), kept as (select j.*, trimmed from j join t using (src_key) where trimmed = 0 or {{'n': n, 'raw': raw}} > ps[trimmed]), g as (select src_key, count(*) as n, max(trimmed) as trimmed, avg(named::int::double) as named, avg(pointing::int::double) as outward, coalesce(max(try_cast(regexp_extract(label, '^([0-9]+)$', 1) as int)), 0) as top, list_sort(list(length(raw)))[(count(*) // 4 + 1)::int] as q1 from kept group by 1)"


@query("f11_gate", f"with {_GATE_SQL} select src_key, n, trimmed, q1, top, case when named < 0.55 then 'unnamed' when outward < 0.65 then 'inward' when q1 > 450 then 'paragraphs' when top > 8 * n then 'labels' else 'sound' end as verdict from g")
def f11_gate(s, d):
    return library.list_gate(table(s, d, "refs").select("src_key", "label", "raw", F.col("ord").alias("n"))).select("src_key", "n", "trimmed", "q1", "top", "verdict")


def _cued() -> Column:
    """A sentence of one of six forms over two accessions made of a row's numbers."""
    a = F.concat((1 + F.col("p_partkey") % 9).cast("string"), F.upper(F.chr(97 + F.col("p_size") % 26)), F.lit("x7"))
    b = F.concat(F.lit("2"), F.upper(F.chr(97 + F.col("p_partkey") % 26)), F.lit("b3"))
    forms = [
        F.concat(F.lit("Taken from PDB entries "), a, F.lit(", "), b, F.lit(" and 1999 of it.")), F.concat(F.lit("See PDB: "), a, F.lit(" (a homolog of it), "), b, F.lit(" (another one).")), F.concat(F.lit("Protein Data Bank (PDB) under accession code "), a, F.lit(" & "), b),
        F.concat(F.lit("Run by PDB2PQR and PDB 2PQR on "), a), F.concat(F.lit("at rcsb.org/structure/"), b, F.lit("; "), a), F.concat(F.lit("In 2009 no cue came before "), a),
    ]
    return F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int"))


_ACC = "a as (select p_partkey, (1 + p_partkey % 9) || upper(chr((97 + p_size % 26)::int)) || 'X7' as a, '2' || upper(chr((97 + p_partkey % 26)::int)) || 'B3' as b, p_partkey % 6 as form from part), t as (select p_partkey, unnest(case when form in (0, 1, 2, 4) then [a, b] else [] end) as acc from a), c as (select p_partkey, acc, count(*) as n from t group by 1, 2)"


@query("q9_accessions", f"with {_ACC} select * from c")
def q9_accessions(s, d):
    return library.accessions(table(s, d, "part"), "p_partkey", _cued())


@query("f4_software", "select '2PQR' as acc, count(*) as n, count(distinct p_partkey) as texts from part where p_partkey % 6 = 3 having count(*) > 0")
def f4_software(s, d):
    return library.rejected_software(table(s, d, "part"), "p_partkey", _cued())


@query("a2_demand", f"with {_ACC} select acc, count(distinct p_partkey) as papers from c group by 1")
def a2_demand(s, d):
    return library.accessions(table(s, d, "part"), "p_partkey", _cued()).groupBy("acc").agg(F.count_distinct("p_partkey").alias("papers")).orderBy(F.desc("papers"), "acc")


@query("a2_summary", f"with {_ACC} select (select count(*) from part) as scanned, count(distinct p_partkey) as with_any, count(distinct p_partkey) / (select count(*) from part) as share, count(distinct acc) as distinct_accs, count(*) as links from c")
def a2_summary(s, d):
    parts = table(s, d, "part")
    return library.accession_summary(library.accessions(parts, "p_partkey", _cued()), parts.count(), "p_partkey")


@query("j18_states", "with f as (select doc_id as \"key\", case when doc_id % 3 = 0 then 'extract' else 'deposit' end as source, case when doc_id % 2 = 0 then 'parsed' else 'confirmed' end as verdict, case when doc_id % 5 > 0 then left(sha256(text || case when doc_id % 4 = 0 then '!' else '' end), 16) end as sha, case when doc_id % 7 > 0 then length(text) end as chars from documents), e as (select doc_id as \"key\", left(sha256(text), 16) as now, length(text) as long from documents where lang is not null), k as (select doc_id as \"key\" from documents where citekey is not null) select \"key\", case when \"key\" not in (select \"key\" from k) then 'gone' when now is null then 'orphan' when case when sha is not null then sha = now else coalesce(chars = long, false) end then 'ok' when verdict = 'parsed' and source <> 'extract' then 'cosmetic' else 'stale' end as state from f left join e using (\"key\")")
def j18_states(s, d):
    t = table(s, d, "documents").withColumnRenamed("doc_id", "key")
    sha = F.when(F.col("key") % 5 > 0, S.body_hash(F.concat("text", F.when(F.col("key") % 4 == 0, "!").otherwise(""))))
    files = t.select("key", F.when(F.col("key") % 3 == 0, "extract").otherwise("deposit").alias("source"), F.when(F.col("key") % 2 == 0, "parsed").otherwise("confirmed").alias("verdict"), sha.alias("sha"), F.when(F.col("key") % 7 > 0, F.length("text")).alias("chars"))
    return library.stale_files(files, t.where("lang is not null").select("key", "text"), t.where("citekey is not null").select("key"))


@query("f7_style", r"with x as (select doc_id, len(regexp_extract_all(text, '\[\d+(?:[,\-]\s*\d+)*\]')) as brackets, len(regexp_extract_all(text, '\(\d{1,3}(?:[,\-]\s*\d{1,3})*\)')) as parens, len(regexp_extract_all(text, '[a-z][.,]\d{1,3}\s')) as supers from documents) select *, case when greatest(brackets, parens, supers) = 0 then 'none' when brackets = greatest(brackets, parens, supers) then 'bracket' when parens = greatest(brackets, parens, supers) then 'paren' else 'super' end as style from x")
def f7_style(s, d):
    return library.marker_style(table(s, d, "documents"), "doc_id", "text")


@query("p22_groups", "with g as (select l_orderkey, l_linenumber, l_suppkey % 50 + 1 as a, l_suppkey % 50 + 1 + l_linenumber * 9 as b from lineitem) select l_orderkey, l_linenumber, array_to_string(case when b - a <= 30 then range(a, b + 1) else [a, b] end || [7], ' ') as numbers from g")
def p22_groups(s, d):
    a = F.col("l_suppkey") % 50 + 1
    text = F.concat(a.cast("string"), F.lit("–"), (a + F.col("l_linenumber") * 9).cast("string"), F.lit(", 7"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(S.expand_group(text).cast("array<string>"), " ").alias("numbers"))


@query("q4_verdicts")
def q4_verdicts(s, d):
    refs = table(s, d, "refs").where("author is not null").groupBy(F.col("src_key").alias("key"), F.col("ord").alias("n")).agg(F.min(S.cited_surname(F.col("author"))).alias("name"))
    marks = refs.select("key", F.when(F.pmod(F.xxhash64("key"), F.lit(4)) == 0, F.col("n") - 1).otherwise(F.col("n")).alias("n"), "name")
    return library.ordinal_rates(marks, refs)


_SAID = ("Could not reach https://host/keys: 403", "HTTP 401", "KeyboardInterrupt", "ReadTimeout after 30 s", "KeyError: 'x'", "network cable", None)


@query("p47_failures", "select event_id, case event_id % 7 when 0 then 'network' when 1 then 'auth' when 2 then 'interrupted' when 3 then 'network' else 'other' end as kind from events")
def p47_failures(s, d):
    return table(s, d, "events").select("event_id", S.failure_kind(F.element_at(F.array(*map(F.lit, _SAID)), (F.col("event_id") % 7 + 1).cast("int"))).alias("kind"))


@query("props_json", "select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events")
def props_json(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("q15_entities", "select entry_id, field, before, replace(replace(replace(replace(before, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&') as \"after\" from (select entry_id, 'title' as field, title as before from entries union all select entry_id, 'journal', journal from entries) where before <> replace(replace(replace(replace(before, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')")
def q15_entities(s, d):
    return texts.with_entities(table(s, d, "entries"), "entry_id", ["title", "journal"])


@query("p21_quotes")
def p21_quotes(s, d):
    return table(s, d, "findings").where("quote is not null").select("record_id", texts.quote_column(F.col("quote")).alias("quote_form"))


@query("p27_rotated")
def p27_rotated(s, d):
    return table(s, d, "raw_pages").select("page_id", texts.rotated_column(F.col("text")).alias("rotated"))


@query("k3_index", "select citekey, year, title, case when pdf is null then '' when pdf then 'yes' else 'no' end as has_text from entries left join (select parent_qid, bool_or(content_type = 'application/pdf') as pdf from attachments group by 1) on parent_qid = qid")
def k3_index(s, d):
    from scholion.sources import writers

    return writers.index_table(table(s, d, "entries"), table(s, d, "attachments"))


@query("k1_bibliography")
def k1_bibliography(s, d):
    from scholion.sources import writers

    return writers.bibliography_entry(writers.documents_of(table(s, d, "entries")))


@query("k1_plain_fields", "select citekey, '@' || case entry_type when 'article' then 'article' when 'incollection' then 'incollection' when 'inproceedings' then 'inproceedings' when 'book' then 'book' when 'phdthesis' then 'phdthesis' when 'techreport' then 'techreport' else 'misc' end || '{' || citekey || ',' || chr(10) || array_to_string(list_transform(list_filter([{'n': 'year', 'v': year}, {'n': 'volume', 'v': volume}, {'n': 'pages', 'v': firstpage}, {'n': 'doi', 'v': doi}], lambda f: f.v <> ''), lambda f: '  ' || rpad(f.n, list_max(list_transform(list_filter([{'n': 'year', 'v': year}, {'n': 'volume', 'v': volume}, {'n': 'pages', 'v': firstpage}, {'n': 'doi', 'v': doi}], lambda g: g.v <> ''), lambda g: length(g.n)))::int, ' ') || ' = {' || f.v || '},'), chr(10)) || chr(10) || '}' as entry from entries where year <> ''")
def k1_plain_fields(s, d):
    from scholion.sources import writers

    e = table(s, d, "entries").where("year <> ''")
    kind = F.when(F.col("entry_type").isin("article", "incollection", "inproceedings", "book", "phdthesis", "techreport"), F.col("entry_type")).otherwise("misc")
    x = e.select("citekey", kind.alias("kind"), writers.filled_fields([("year", F.col("year")), ("volume", F.col("volume")), ("pages", F.col("firstpage")), ("doi", F.col("doi"))]).alias("fields"))
    return x.select("citekey", writers.entry_text(F.col("kind"), F.col("citekey"), F.col("fields")).alias("entry"))


@query("p16_tex", "select entry_id, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(title, '[\\n]', ' ', 'g'), '\\p{Cf}|\\p{Co}', '', 'g'), ''), lambda c: case c when chr(92) then '\\textbackslash{}' when '{' then '\\{' when '}' then '\\}' when '$' then '\\$' when '&' then '\\&' when '%' then '\\%' when '#' then '\\#' when '_' then '\\_' when '~' then '\\textasciitilde{}' when '^' then '\\textasciicircum{}' else c end), '') as tex from entries where regexp_matches(title, '^[ -~]+$') and not contains(title, '&')".replace("\\\\", "\\"))
def p16_tex(s, d):
    from scholion.sources import writers

    return table(s, d, "entries").where(F.col("title").rlike("^[ -~]+$") & ~F.contains("title", F.lit("&"))).select("entry_id", writers.tex(F.col("title")).alias("tex"))
