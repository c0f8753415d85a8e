"""Sources: bibliographies, page-marked text, finding logs, ledgers, override tables, captured service pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _values(body: str) -> dict[str, str]:
    """Fields of an entry's body; braces nest, quotes and bare words are values too."""
    out, i = {}, 0
    while m := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(body, i):
        i = m.end()
        if body[i : i + 1] == "{":
            depth, j = 0, i
            while j < len(body):
                depth += (body[j] == "{") - (body[j] == "}")
                j += 1
                if not depth:
                    break
            out[m[1].lower()] = body[i + 1 : j - (not depth)]
        elif body[i : i + 1] == '"':
            j = body.find('"', i + 1) + 1 or len(body)
            out[m[1].lower()] = body[i + 1 : j - 1]
        else:
            j = i + len(re.match(r"[^,]*", body[i:])[0])
            out[m[1].lower()] = body[i:j].strip()
        i = j
    return out


def parse_bibliography(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(key, type, fields) of every entry; unbalanced ones end where the text does."""
    out = []
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s]+)\s*,", text):
        depth, j = 1, m.end()
        while j < len(text) and depth:
            depth += (text[j] == "{") - (text[j] == "}")
            j += 1
        out.append((m[2], m[1].lower(), _values(text[m.end() : j - (not depth)])))
    return out


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """[S6, S7, S8, S9] (``citekey``, ``entry_type``, ``fields``) of bibliography files; one file a row before parsing."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for t in b["value"] for x in parse_bibliography(t or "")], columns=["citekey", "entry_type", "fields"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "citekey string, entry_type string, fields map<string,string>")


def page_range(bibliography: DataFrame) -> DataFrame:
    """[S10] First and last page of entries; a lone number has none, nor has an inverted range."""
    a, b = (F.regexp_extract(F.col("fields")["pages"], r"^\s*(\d+)\s*[-–]+\s*(\d+)\s*$", k) for k in (1, 2))
    x = bibliography.select("citekey", F.nullif(a, F.lit("")).cast("int").alias("first"), F.nullif(b, F.lit("")).cast("int").alias("last"))
    return x.select("citekey", *[F.when(F.col("first") <= F.col("last"), F.col(c)).alias(c) for c in ("first", "last")])


def split_pages(extracts: DataFrame, key: str = "stem", text: str = "body") -> DataFrame:
    """[S11, S13, S14] Pages of page-marked text: (key, ``page``, ``start``, ``text``), front matter left out."""
    body = F.regexp_replace(F.col(text), r"(?s)\A---\n.*?\n---\n", "")
    parts = F.split(body, r"<!-- p\. (?=\d+ -->)")
    x = extracts.select(F.col(key), F.posexplode(parts).alias("i", "part"), parts.alias("all")).where("i > 0")
    start = F.aggregate(F.slice("all", 1, F.col("i")), F.lit(0), lambda a, p: a + F.length(p) + 8) - 8
    return x.select(key, F.regexp_extract("part", r"^(\d+) -->", 1).cast("int").alias("page"), start.alias("start"), F.regexp_replace("part", r"^\d+ -->\s*|\s+$", "").alias("text"))


def parse_findings(log: DataFrame, key: str = "citekey", text: str = "body") -> DataFrame:
    """[S15] Records of a findings log; a block that can't be read is a row with a complaint, never skipped."""
    block = F.explode(F.filter(F.split(F.col(text), r"(?m)^(?=## )"), lambda b: b.startswith("## "))).alias("block")
    x = log.select(F.col(key), block)
    head = r"^## (\d+)\. (FINDING|CHECKED|RETRACTED) (\d{4}-\d\d-\d\d)(?: of (\d+))?"
    take = lambda name: F.nullif(F.trim(F.regexp_extract("block", rf"(?m)^{name}: (.*)$", 1)), F.lit(""))
    num = lambda k: F.nullif(F.regexp_extract("block", head, k), F.lit("")).cast("int")
    x = x.select(key, num(1).alias("ordinal"), F.nullif(F.regexp_extract("block", head, 2), F.lit("")).alias("kind"), F.try_to_date(F.regexp_extract("block", head, 3)).alias("found_on"), num(4).alias("ref_ordinal"), take("question").alias("question"), take("locator").alias("locator"), take("quote").alias("quote"), take("note").alias("note"), "block")
    complaint = F.when(F.col("kind").isNull(), "no readable head").when(F.col("found_on").isNull(), "no such date").when((F.col("kind") == "FINDING") & F.col("quote").isNull(), "finding without quote").when((F.col("kind") != "FINDING") & F.col("ref_ordinal").isNull(), "refers to nothing")
    return x.withColumn("complaint", complaint).drop("block")


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """[S16] (claims, links, weights) of a claim ledger in JSON."""
    schema = "claims array<struct<id:string,statement:string,status:string,note:string,sources:array<struct<k:string,role:string,why:string>>>>, weights map<string,double>"
    j = spark.read.schema(schema).json(path, multiLine=True)
    c = j.select(F.explode("claims").alias("c")).select("c.*").withColumnRenamed("id", "claim")
    links = c.select("claim", F.explode("sources").alias("s")).select("claim", F.col("s.k").alias("source"), F.col("s.role").alias("role"))
    return c.drop("sources"), links, j.select(F.explode("weights").alias("role", "weight"))


def read_overrides(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """[S17, S24] Tab-separated overrides; lines with ``#`` are comments, blank ones are skipped."""
    return spark.read.csv(path, sep="\t", comment="#", schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).na.drop("all")


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CapturedPages(DataSource):
    """[S1, S2] Pages of a paged service as captured files ``page-<start>.json``: one partition a page.

    The service itself isn't asked. Options: ``path``, the folder; ``skip``,
    item types to leave out, with commas.
    """

    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return "key string, version bigint, item_type string, title string, parent string, data string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.skip = options["path"], {x for x in options.get("skip", "").split(",") if x}

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        return [_Page(str(p)) for p in sorted(Path(self.folder).glob("page-*.json"))]

    def read(self, partition: _Page):
        import json

        with open(partition.path) as f:
            for x in json.load(f):
                d = x.get("data", {})
                if d.get("itemType") not in self.skip:
                    yield (x.get("key"), x.get("version"), d.get("itemType"), d.get("title"), d.get("parentItem"), json.dumps(d))
