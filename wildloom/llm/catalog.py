"""The queries of the training-text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wildloom.llm import markup, packing, pii, reading, tokens, tone
from wildloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Key of the surrogates in the queries here; a user passes a secret of their own.
SECRET = b"wildloom demonstration key"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- 3: personal information -----------------------------------------------------------------------


@query("p3_found")
def p3_found(spark, d):
    h = pii.detect(table(spark, d, "hackernews").select("id", "text"), "text")
    return h.select("id", F.explode(F.array_distinct(F.transform("mentions", lambda m: m["kind"]))).alias("kind")).distinct()


@query("p3_anonymized")
def p3_anonymized(spark, d):
    return pii.anonymize(table(spark, d, "hackernews").select("id", "text"), "text", SECRET).select("id", "clean_text")


# --- 4: tone -----------------------------------------------------------------------------------


def _toned(spark, d, *more: str) -> DataFrame:
    h = table(spark, d, "hackernews")
    model = tone.train(table(spark, d, "tone_samples"), "sample_id", "sample_text", "verdict")
    return tone.score(h.select("id", "text", "title", *more), ["text", "title"], model).drop("text", "title")


@query("p4_found")
def p4_found(spark, d):
    return _toned(spark, d).where(F.col("score") >= tone.THRESHOLD).select("id").distinct()


@query("p4_scores")
def p4_scores(spark, d):
    return _toned(spark, d).dropDuplicates(["id"])


@query("p4_account_rates")
def p4_account_rates(spark, d):
    return tone.rates(_toned(spark, d, "by").dropDuplicates(["id"]), "by")


@query("p4_host_rates")
def p4_host_rates(spark, d):
    return tone.rates(_toned(spark, d, "url").dropDuplicates(["id"]).withColumn("host", markup.host_of("url")), "host")


# --- 7: markup -------------------------------------------------------------------------------------


@query("p7_found")
def p7_found(spark, d):
    done = markup.clean_corpus(table(spark, d, "hackernews").select("id", "text", "url"), "text", "url")
    return done.where(F.size("markup") > 0).select("id").distinct()


@query("p7_clean")
def p7_clean(spark, d):
    done = markup.clean_corpus(table(spark, d, "hackernews").select("id", "text", "url"), "text", "url")
    return done.select("id", F.array_join("markup", ",").alias("markup"), "clean")


# --- 8: encoding ---------------------------------------------------------------------------------


@query("p8_ids")
def p8_ids(spark, d):
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


@query("p8_counts")
def p8_counts(spark, d):
    return tokens.count_tokens(table(spark, d, "documents").select("doc_id", "text"), "text", "n_tokens").select("doc_id", "n_tokens")


@query("p8_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p8_decoded(spark, d):
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "ids", "text")


# --- 9: packing ----------------------------------------------------------------------------------


@query("p9_bins")
def p9_bins(spark, d):
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", "source")


@query("p9_containers")
def p9_containers(spark, d):
    return packing.containers(packing.pack(table(spark, d, "documents"), "doc_id", "text", "source"))


@query("p9_conflicts", "SELECT '' AS bin_id, '' AS fault WHERE false")
def p9_conflicts(spark, d):
    docs = table(spark, d, "documents")
    return packing.conflicts(packing.pack(docs, "doc_id", "text", "source"), docs, "doc_id", "text", "source")


@query("p9_documents", "SELECT doc_id, coalesce(text, '') = '' AS no_tokens, 1 AS rests FROM documents")
def p9_documents(spark, d):
    per = packing.pack(table(spark, d, "documents"), "doc_id", "text", "source").groupBy("doc_id")
    return per.agg((F.sum("n_tokens") == 0).alias("no_tokens"), F.count_if(~F.col("bin_id").startswith("full-")).cast("int").alias("rests"))


# --- 10: reading level -----------------------------------------------------------------------------


def _levels(spark, d) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "grade_samples"), "sample_text", "grade")


@query("p10_found")
def p10_found(spark, d):
    return _levels(spark, d).where(F.col("english") & (F.col("n_words") >= reading.MIN_WORDS) & F.col("grade").isNotNull()).select("doc_id", "grade").distinct()


@query("p10_levels")
def p10_levels(spark, d):
    return _levels(spark, d)
