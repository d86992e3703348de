"""Delimited files: the item tables, corpus directories and expected-value files."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wildloom.session import exists

# The column names and types of the three item tables.
ITEMS = "id int, deleted smallint, type smallint, by string, time timestamp_ntz, text string, dead smallint, parent int, poll int, url string, score int, title string, descendants int"
BLOCKLISTS = "block_id int, host_pattern string, category string"
TOPICS = "topic_id int, pattern string"


_JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
_TIME = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
#: What a bare empty field is taken for while reading, so that it differs from an empty text in quotes.
_NULL = "\ue000\u0000null"


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, line_sep: str | None = None) -> DataFrame:
    """Comma-separated text with doubled quotes and line breaks inside quotes; an empty bare field is null, one in quotes an empty text.

    Without ``line_sep`` any line break ends a record, and those in texts become LF; with it they stay as they are.
    """
    r = spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"').option("multiLine", True)
    r = r.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", _NULL)
    if line_sep:
        r = r.option("lineSep", line_sep)
    return r.option("timestampNTZFormat", _TIME).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """As :func:`read_csv` reads with ``line_sep`` LF."""
    w = df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    w = w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("lineSep", "\n")
    w.option("timestampNTZFormat", _TIME).csv(path)


@dataclass
class Corpus:
    texts: DataFrame
    patterns: DataFrame
    labels: DataFrame | None
    ilike: bool
    escape: str | None


def read_corpus(spark: SparkSession, directory: str) -> Corpus:
    """texts.csv, patterns.csv, and where they are there labels.csv and meta.json (operator, escape_char); any folder that Spark reads."""
    d = directory.rstrip("/")
    labels = read_csv(spark, f"{d}/labels.csv", "text_id long, pattern_id long") if exists(spark, f"{d}/labels.csv") else None
    meta = {}
    if exists(spark, f"{d}/meta.json"):
        meta = json.loads(spark.read.text(f"{d}/meta.json", wholetext=True).first()[0])
    return Corpus(
        read_csv(spark, f"{d}/texts.csv", "text_id long, text string"),
        read_csv(spark, f"{d}/patterns.csv", "pattern_id long, pattern string"),
        labels,
        str(meta.get("operator", "LIKE")).upper() == "ILIKE",
        meta.get("escape_char") or None,
    )


def write_corpus(corpus: Corpus, directory: str) -> None:
    """As :func:`read_corpus` reads."""
    d = directory.rstrip("/")
    write_csv(corpus.texts.select("text_id", "text"), f"{d}/texts.csv")
    write_csv(corpus.patterns.select("pattern_id", "pattern"), f"{d}/patterns.csv")
    if corpus.labels is not None:
        write_csv(corpus.labels.select("text_id", "pattern_id"), f"{d}/labels.csv")
    meta = {"operator": "ILIKE" if corpus.ilike else "LIKE"} | ({"escape_char": corpus.escape} if corpus.escape else {})
    corpus.texts.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{d}/meta.json")


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated rows; lines that begin with # are remarks."""
    return spark.read.option("sep", "\t").option("comment", "#").option("header", False).csv(path)


def write_expected(spark: SparkSession, rows: list[tuple], path: str, remark: str = "") -> None:
    """As :func:`read_expected` reads, after a line with the remark."""
    lines = [f"# {remark}"] * bool(remark) + ["\t".join(map(str, r)) for r in rows]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, with times as TIMESTAMP_NTZ."""
    return spark.read.parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).option("timestampNTZFormat", _JSON_TIME).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As :func:`write_jsonl` writes; a line that does not fit the schema raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("timestampNTZFormat", _JSON_TIME).json(path)


def as_items(df: DataFrame) -> DataFrame:
    """Casts of the item columns, for sources that hold them as text."""
    kinds = dict(x.rsplit(" ", 1) for x in ITEMS.split(", "))
    return df.select(*[F.col(f"`{n}`").cast(kinds[n]).alias(n) for n in kinds])
