"""Links between the spellings of one person or organisation.

Spellings are read as surname and given names in every order they allow; the
reading kept is the one that the other spellings support. Surnames and given
names that a slip of the keyboard changed are found by suffix blocking: tokens
are indexed by their suffixes, forwards and backwards, of at least half their
length; a suffix that many tokens share is refined with the token's first
letter and length instead of being dropped; pairs of a block are compared by the
ratio of their longest common subsequence. A rare token then stands for the
common one it is a slip of.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scholion.functions.text import _LOOKS
from scholion.session import checkpoint

# Given names and their short forms; a short form may stand for several names.
SHORT_FORMS = {
    "robert": "rob bob bobby robbie bert", "margaret": "maggie peggy meg greta", "william": "bill billy will liam", "elizabeth": "liz beth betty betsy lizzie eliza lisa", "catherine": "kate katie cathy", "katherine": "kate katie kathy", "michael": "mike mick mickey", "james": "jim jimmy",
    "john": "jack johnny", "thomas": "tom tommy", "richard": "dick rick rich", "theodore": "ted theo teddy", "theodora": "theo dora teddy", "edward": "ed eddie ned ted", "edouard": "eddy ed", "charles": "chuck charlie charley",
    "charlotte": "lottie charley carlotta", "alexander": "alex lex sandy sasha al", "aleksandra": "sasha ola sandra alex", "alexandra": "sasha sandra alex", "nicholas": "nick nicky", "benjamin": "ben benny benji", "samuel": "sam", "samantha": "sam",
    "daniel": "dan danny", "david": "dave davy", "stephen": "steve", "steven": "steve", "christopher": "chris kit", "christina": "tina chris", "christine": "tina chris", "anthony": "tony",
    "andrew": "andy drew", "matthew": "matt", "gregory": "greg", "kenneth": "ken", "lawrence": "larry", "joseph": "joe", "josephine": "jo", "joanna": "jo",
    "peter": "pete", "philip": "phil pip", "philippa": "pippa pip", "ronald": "ron", "donald": "don", "victor": "vic", "victoria": "vicky vic", "susanna": "sue susie suzy susan",
    "susan": "sue susie suzy", "wilhelmina": "mina minnie wilma", "dorothea": "dora thea", "dorothy": "dora dot", "gabriela": "gaby gabi", "gabriel": "gabe", "leonardo": "leo", "leonard": "leo len",
    "leon": "leo", "francisco": "paco pancho fran", "frances": "fran fanny", "francis": "frank fran", "alejandro": "ale alejo", "alejandra": "ale", "rajendra": "raj", "ursula": "ursel uschi",
    "johannes": "hans jan hannes", "henrik": "henk", "dmitri": "dima mitya", "stefan": "steffen", "oluwaseun": "seun", "oliver": "ollie", "olivia": "ollie", "jennifer": "jenny",
    "rebecca": "becky", "abigail": "abby", "eleanor": "nell nora", "henry": "harry hank", "harold": "harry", "frederick": "fred freddy", "alfred": "fred al", "albert": "al bert",
    "alan": "al", "aloysius": "al", "herbert": "bert herb", "augustus": "gus", "gustav": "gus", "patricia": "pat patty tricia trish", "patrick": "pat paddy", "deborah": "debbie",
    "cynthia": "cindy", "amanda": "mandy", "nathaniel": "nat", "nathan": "nat", "zachary": "zach", "zoltan": "zoli",
}
LONG_FORMS = {short: sorted(full for full, forms in SHORT_FORMS.items() if short in forms.split()) for short in {x for forms in SHORT_FORMS.values() for x in forms.split()}}
# Words that belong to the surname after them, and to an organisation's name.
PARTICLES = frozenset("van von der den de la le di da del della du al el ten ter zu zur af av dos bin ibn st".split())
FILLERS = frozenset("of for the and de la und für fur des der et y".split())
KINDS = {"lab": "laboratory", "labor": "laboratory", "laboratory": "laboratory", "inst": "institute", "institute": "institute", "institut": "institute", "cent": "centre", "ctr": "centre", "centre": "centre", "center": "centre", "acad": "academy", "academy": "academy", "univ": "university", "university": "university", "soc": "society", "society": "society", "dept": "department", "department": "department", "found": "foundation", "foundation": "foundation", "assoc": "association", "association": "association", "coll": "college", "college": "college", "school": "school", "fac": "faculty", "faculty": "faculty", "bur": "bureau", "bureau": "bureau", "council": "council", "consort": "consortium", "consortium": "consortium", "network": "network", "group": "group", "agency": "agency", "office": "office", "board": "board"}

READING = "array<struct<kind:string,sur:string,given:array<string>,weight:int>>"


def plain(text: str) -> str:
    """Lower case without accents, look-alike letters and transliterated umlauts."""
    text = "".join(_LOOKS.get(c, c) for c in text)
    for a, b in (("ß", "ss"), ("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("æ", "a"), ("Æ", "A"), ("œ", "o"), ("ı", "i")):
        text = text.replace(a, b)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return re.sub(r"(?<=[aou])e(?=[^\W\daeiouy])|(?<=\ba)e", "", text.lower())


def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", re.sub(r"['’´`]", "", text))


def _initials(token: str, shouted: bool) -> bool:
    if len(token) > 1 and token.lower() in PARTICLES:
        return False
    return len(token) == 1 or token.isupper() and len(token) <= (2 if shouted else 3)


def _given(tokens: list[str], shouted: bool) -> list[str]:
    out = []
    for t in tokens:
        out += list(plain(t)) if _initials(t, shouted) else [plain(t)]
    return out


@lru_cache(maxsize=20_000)
def kind_word(word: str) -> str | None:
    """The kind of organisation that a word names, abbreviated or with a slip; else null."""
    if word in KINDS or len(word) < 6:
        return KINDS.get(word)
    return next((k for k in dict.fromkeys(KINDS.values()) if abs(len(k) - len(word)) <= 1 and lcs_ratio(k, word) >= 0.88), None)


def readings(name: str) -> list[tuple[str, str, list[str], int]]:
    """Ways to read a spelling: (kind, surname or place, given names or other words, how sure: 2 sure, 1 possible)."""
    name = re.sub(r"(?i)[,\s]*\bet\s+al\b\.?|[,\s]*\b(?:and|u\.)\s+(?:others|a\.)\s*$|\(eds?\.?\)", "", name).strip(" ,;.")
    words = _tokens(name)
    if not words:
        return []
    if len(words) > 2 and plain(words[0]) == "the":
        words = words[1:]
    low = [plain(w) for w in words]
    kinds = [i for i, w in enumerate(low) if kind_word(w)]
    acronym = re.fullmatch(r"\s*([^\W\d_]{4,8})\s*\(\s*([^()]{3,})\)\s*", name)
    if acronym and acronym[1].isupper():
        return [("org", plain("".join(_tokens(acronym[2]))), [plain(acronym[1])], 2)]
    if kinds and len(words) >= 3:
        before, _, after = name.partition(",")
        if after and not any(kind_word(plain(w)) for w in _tokens(after)):
            place, rest = _tokens(after), _tokens(before)
        else:
            k = kinds[0]
            place, rest = (words[:k], words[k:]) if k else (words[-1:], words[:-1])
        rest = [kind_word(plain(w)) or plain(w) for w in rest if plain(w) not in FILLERS]
        return [("org", plain("".join(place)), rest, 2)]
    shouted = not any(c.islower() for c in name)
    before, comma, after = name.partition(",")
    if comma and _tokens(before) and _tokens(after):
        return [("person", "".join(plain(t) for t in _tokens(before)), _given(_tokens(after), shouted), 2)]
    if len(words) == 1:
        one = [("person", low[0], [], 2)]
        return one + [("org", "", [low[0]], 1)] if words[0].isupper() and 5 <= len(low[0]) <= 7 else one
    short = [_initials(w, shouted) for w in words]
    lead = next((i for i, s in enumerate(short) if not s), len(words))
    tail = next((i for i, s in enumerate(reversed(short)) if not s), len(words))
    if lead and lead < len(words) and not tail:
        return [("person", "".join(low[lead:]), _given(words[:lead], shouted), 2)]
    mixed = any(short)
    out = []
    if tail and tail < len(words) and not lead:
        rest = words[: len(words) - tail]
        out.append(("person", "".join(plain(w) for w in rest), _given(words[len(words) - tail :], shouted), 2 if len(rest) == 1 else 1))
        if len(rest) == 1:
            return out
    for i in range(1, len(words)):
        first, last = words[:i], words[i:]
        out.append(("person", "".join(plain(w) for w in last), _given(first, shouted), 1)) if not all(plain(w) in PARTICLES for w in last) and plain(first[-1]) not in PARTICLES else None
        if not any(_initials(w, shouted) for w in first) and plain(first[-1]) not in PARTICLES:
            out.append(("person", "".join(plain(w) for w in first), _given(last, shouted), 1))
    if not mixed:
        out.append(("person", "".join(low), [], 1))
    if low[0] in PARTICLES and not mixed and all(w in PARTICLES for w in low[:-1]):
        return [("person", "".join(low), [], 2)]
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("sur", T.StringType()), T.StructField("given", T.ArrayType(T.StringType())), T.StructField("weight", T.IntegerType())])))
def read_name(name: pd.Series) -> pd.Series:
    """All readings of each spelling."""
    return name.map(lambda n: [{"kind": k, "sur": s, "given": g, "weight": w} for k, s, g, w in readings(n)])


def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-common-subsequence ratio of each pair."""
    return pd.Series([lcs_ratio(x, y) for x, y in zip(a, b)])


def slips(tokens: DataFrame, ratio: float = 0.8, common: int = 64, least: int = 3) -> DataFrame:
    """(``token``, ``stands_for``): each rare token with the common one it is a slip of, by suffix blocking.

    ``tokens`` has ``token`` and ``uses``, the spellings it is in. Suffixes of at
    least half the token (and ``least`` characters) are indexed, of the token
    and of its reverse, so a slip anywhere leaves one of them whole. A suffix of
    more than ``common`` tokens is refined with the token's other end and length.
    Tokens without a common neighbour aren't listed.
    """
    n = F.length("token")
    t = tokens.where(n >= 4)
    half = F.greatest(F.lit(least), F.floor((n - 1) / 2)).cast("int")
    sizes = F.sequence(half, F.least(n, half + 2))
    ends = t.select("token", "uses", F.explode(F.concat(F.transform(sizes, lambda k: F.concat(F.lit(">"), F.right("token", k))), F.transform(sizes, lambda k: F.concat(F.lit("<"), F.left("token", k))))).alias("end"))
    crowds = ends.groupBy("end").agg(F.count(F.lit(1)).alias("crowd"))
    # Refined key: the two letters at the other end, with and without the first of them, so that one slip there is met too.
    far = F.when(F.col("end").startswith(">"), F.left("token", F.lit(2))).otherwise(F.reverse(F.right("token", F.lit(2))))
    options = F.when(F.col("crowd") <= common, F.array(F.lit(""))).otherwise(F.array(F.concat(F.lit("1"), F.substring(far, 1, 1)), F.concat(F.lit("2"), F.substring(far, 2, 1)), F.concat(F.lit("2"), F.substring(far, 1, 1)), F.concat(F.lit("1"), F.substring(far, 2, 1))))
    blocks = ends.join(crowds, "end").select("token", "uses", F.explode(F.array_distinct(options)).alias("part"), "end")
    other = blocks.select(F.col("token").alias("hub"), F.col("uses").alias("hub_uses"), "part", "end")
    pairs = blocks.join(other, ["end", "part"]).where((F.col("token") != F.col("hub")) & (F.abs(F.length("token") - F.length("hub")) <= 1) & ((F.col("hub_uses") > F.col("uses")) | ((F.col("hub_uses") == F.col("uses")) & (F.col("hub") < F.col("token")))) & ((F.col("uses") <= 2) | (F.col("hub_uses") >= 3 * F.col("uses"))))
    near = pairs.select("token", "hub", "uses", "hub_uses").distinct().where(F.levenshtein("token", "hub", 2) >= 0).withColumn("ratio", subsequence("token", "hub")).where(F.col("ratio") >= ratio)
    # One slip (two letters that changed places too) before two: the more names there are, the more often a commoner one lies two away.
    letters = lambda c: F.array_sort(F.split(c, ""))
    single = (F.levenshtein("token", "hub") == 1) | (letters("token") == letters("hub"))
    direct = checkpoint(near.groupBy("token").agg(F.max_by("hub", F.struct(single.alias("single"), "hub_uses", "ratio", "hub")).alias("stands_for")))
    # What a token stands for may itself be a slip of a commoner one.
    beyond = direct.select(F.col("token").alias("stands_for"), F.col("stands_for").alias("beyond"))
    return direct.join(beyond, "stands_for", "left").select("token", F.coalesce("beyond", "stands_for").alias("stands_for"))


def _choose(read: DataFrame) -> DataFrame:
    """Of each spelling the reading that the sure readings of others support best."""
    sure = read.where("weight = 2 and kind = 'person'")
    known_sur = sure.groupBy("sur").agg(F.count_distinct("name").alias("as_sur"))
    known_given = sure.select("name", F.explode("given").alias("g")).where(F.length("g") > 1).groupBy("g").agg(F.count_distinct("name").alias("as_given"))
    open_ = read.where("weight = 1").withColumn("g", F.try_element_at(F.filter("given", lambda g: F.length(g) > 1), F.lit(1)))
    scored = (
        open_.join(known_sur, "sur", "left")
        .join(known_given, "g", "left")
        .join(known_given.select(F.col("g").alias("sur"), F.col("as_given").alias("sur_as_given")), "sur", "left")
        .join(known_sur.select(F.col("sur").alias("g"), F.col("as_sur").alias("given_as_sur")), "g", "left")
    )
    log = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)))
    # Without support on either side the last word is the surname.
    score = log("as_sur") + log("as_given") - log("sur_as_given") - log("given_as_sur") - F.when(F.col("g").isNull() & F.col("as_sur").isNull(), 0.5).otherwise(0) + F.when(F.col("place") == 0, 0.01).otherwise(0)
    best = scored.groupBy("name").agg(F.max_by(F.struct("kind", "sur", "given"), F.struct(score.alias("s"), -F.col("place"))).alias("r"))
    return read.where("weight = 2").select("name", "kind", "sur", "given").unionByName(best.select("name", "r.*"))


def same_names(names: DataFrame) -> DataFrame:
    """(``name_a``, ``name_b``), ``name_a`` smaller: pairs of spellings in the column ``name`` that stand for the same one.

    A surname alone is linked with every person who has it; two people with one
    surname aren't linked. Null and blank names are ignored, repeated ones count
    once, names without letters match nothing; an empty table gives no row.
    """
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = checkpoint(names.select("name").where("trim(name) <> ''").distinct().repartition(parts).select("name", F.posexplode(read_name("name")).alias("place", "r")).select("name", "place", "r.*"))
    read = checkpoint(_choose(distinct))
    return _people(read.where("kind = 'person'")).unionByName(_organisations(read, distinct)).distinct()


def _pairs(a: DataFrame, b: DataFrame, on: list[str], test: Column) -> DataFrame:
    right = b.select(*[F.col(c) if c in on else F.col(c).alias(f"{c}2") for c in b.columns])
    return a.join(right, on).where((F.col("name") != F.col("name2")) & test).select(F.least("name", "name2").alias("name_a"), F.greatest("name", "name2").alias("name_b"))


def _people(read: DataFrame) -> DataFrame:
    sur = slips(read.groupBy(F.col("sur").alias("token")).agg(F.count_distinct("name").alias("uses"))).withColumnRenamed("token", "sur")
    given = read.select("name", F.explode("given").alias("token")).where(F.length("token") > 1).groupBy("token").agg(F.count_distinct("name").alias("uses"))
    # Names that are known as such aren't slips of each other.
    fixed = slips(given).where(~F.col("token").isin(*SHORT_FORMS, *LONG_FORMS)).select(F.col("token").alias("first"), F.col("stands_for").alias("first_for"))
    g = (
        read.join(sur, "sur", "left")
        .withColumn("sur", F.coalesce("stands_for", "sur"))
        .withColumn("first", F.try_element_at("given", F.lit(1)))
        .join(fixed, "first", "left")
        .withColumn("first", F.coalesce("first_for", "first"))
        .withColumn("middle", F.substring(F.try_element_at("given", F.lit(2)), 1, 1))
    )
    # What a given name may stand for: itself, and the names it is short for. Initials stand for all that begin with them.
    long = F.create_map(*[x for short, names in sorted(LONG_FORMS.items()) for x in (F.lit(short), F.array(*map(F.lit, names)))])
    forms = F.concat(F.array("first"), F.coalesce(long[F.col("first")], F.array().cast("array<string>")))
    g = checkpoint(g.select("name", "sur", F.when(F.col("first").isNotNull(), forms).alias("forms"), "middle").distinct())
    bare = g.where("forms is null").select("name", "sur")
    full = g.where("forms is not null").withColumn("initial", F.explode(F.array_distinct(F.transform("forms", lambda f: F.left(f, F.lit(1))))))
    lone = lambda c: F.length(F.element_at(c, 1)) == 1
    firsts = lone("forms") | lone("forms2") | F.arrays_overlap("forms", "forms2")
    middles = F.coalesce(F.col("middle") == F.col("middle2"), F.lit(True))
    return _pairs(bare, g.select("name", "sur"), ["sur"], F.lit(True)).unionByName(_pairs(full, full, ["sur", "initial"], firsts & middles & (F.col("name") < F.col("name2"))))


def _organisations(read: DataFrame, all_readings: DataFrame) -> DataFrame:
    org = read.where("kind = 'org'").select("name", "sur", "given")
    named = org.where("sur <> ''")
    places = slips(named.groupBy(F.col("sur").alias("token")).agg(F.count_distinct("name").alias("uses"))).withColumnRenamed("token", "sur")
    named = named.join(places, "sur", "left").select("name", F.coalesce("stands_for", "sur").alias("sur"), "given")
    short = (F.size("given") == 1) & (F.length(F.element_at("given", 1)) <= 8)
    acronym = F.concat(F.left("sur", F.lit(3)), F.array_join(F.transform("given", lambda w: F.left(w, F.lit(1))), ""))
    long = checkpoint(named.where(~short).withColumn("code", acronym))
    alias = checkpoint(named.where(short).withColumn("code", F.element_at("given", 1)).select("name", "sur", "code"))
    # A bare acronym reads as a surname too; it is an organisation where a named one has that code.
    bare = all_readings.where("kind = 'org' and sur = ''").select("name", F.element_at("given", 1).alias("code"))
    codes = checkpoint(long.select("name", "sur", "code").unionByName(alias).distinct())
    fits = F.forall(F.arrays_zip(F.col("given").alias("p"), F.col("given2").alias("q")), lambda z: F.coalesce(z["p"].startswith(z["q"]) | z["q"].startswith(z["p"]) | (F.levenshtein(z["p"], z["q"]) <= 2), F.lit(True)))
    same_place = _pairs(long.select("name", "sur", "given"), long.select("name", "sur", "given"), ["sur"], fits & (F.col("name") < F.col("name2")))
    with_alias = _pairs(long.select("name", "sur"), alias.select("name", "sur"), ["sur"], F.lit(True)).unionByName(_pairs(alias.select("name", "sur"), alias.select("name", "sur"), ["sur"], F.col("name") < F.col("name2")))
    # Truncated names have shorter codes; a bare acronym joins all spellings of the place that its code names.
    places_of = bare.join(codes.select("code", "sur").distinct(), "code").select("name", "sur").distinct()
    by_code = _pairs(places_of, codes.select("name", "sur").distinct(), ["sur"], F.lit(True)).unionByName(_pairs(places_of, places_of, ["sur"], F.col("name") < F.col("name2")))
    return same_place.unionByName(with_alias).unionByName(by_code)
