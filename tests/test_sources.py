import datetime
import json

import pytest

from pyspark.sql import functions as F

from wildloom.session import table
from wildloom.sources import tables, workload
from wildloom.streaming.probe import drain, probe_stream, windowed_counts

SMALL = "/root/testdata/sf0.001"


def test_csv_round_trip(spark, tmp_path):
    h = table(spark, SMALL, "hackernews").select("id", "text", "title", "time").where("text is not null and text <> '' and text not rlike '\\\\r'")
    tables.write_csv(h, str(tmp_path / "x"))
    back = tables.read_csv(spark, str(tmp_path / "x"), "id int, text string, title string, time timestamp_ntz")
    assert h.select("id", "text", "time").exceptAll(back.select("id", "text", "time")).count() == 0


def test_corpus_directory(spark, tmp_path):
    (tmp_path / "texts.csv").write_text('text_id,text\n1,"a ""b""\nc"\n2,xyz\n')
    (tmp_path / "patterns.csv").write_text("pattern_id,pattern\n1,%b%\n2,!%\n")
    (tmp_path / "labels.csv").write_text("text_id,pattern_id\n1,1\n")
    (tmp_path / "meta.json").write_text(json.dumps({"operator": "ILIKE", "escape_char": "!"}))
    c = tables.read_corpus(spark, str(tmp_path))
    assert c.texts.count() == 2 and c.texts.first().text == 'a "b"\nc'
    assert c.ilike and c.escape == "!" and c.labels.count() == 1


def test_expected_values(spark, tmp_path):
    path = str(tmp_path / "e.tsv")
    tables.write_expected(spark, [("a", 1), ("b", 2)], path, "remark")
    assert [tuple(r) for r in tables.read_expected(spark, path).collect()] == [("a", "1"), ("b", "2")]


def test_item_casts(spark):
    h = table(spark, SMALL, "hackernews")
    text = h.select(*[F.col(f"`{x}`").cast("string").alias(x) for x in h.columns])
    assert tables.as_items(text).exceptAll(h).count() == 0


def test_digest_of_nothing():
    assert workload.pairs_digest([]) == "cbf29ce484222325"


def test_stream_probe(spark):
    h = table(spark, SMALL, "hackernews")
    pats = spark.createDataFrame([(1, "%spell checker%"), (2, "%the%")], "pid int, pattern string")
    stream = spark.readStream.schema(h.schema).parquet(f"{SMALL}/hackernews.parquet*").select("id", "text", "time")
    got = drain(probe_stream(stream, pats, "text", "pattern").select("id", "pid"))
    assert got.count() == h.where("text like '%spell checker%'").count() + h.where("text like '%the%'").count()
    windows = windowed_counts(probe_stream(stream, pats, "text", "pattern"), "time", ["pid"])
    assert windows.isStreaming


def test_csv_keeps_every_text(spark, tmp_path):
    texts = [None, "", " ", '"', '""', "a,b", "two\nlines", "two\r\nlines", "one\rsign", "\n", "\r", "# no comment", "\\", '\\"', 'end\\', " lead and trail ", "\ttab\t", "\u00a0", "null", "x" * 100_000, 'say "hi"\r\n, then', "\u2028", "\ufeffmark"]
    rows = [(i, None, 1, t, datetime.datetime(2020, 1, 2, 3, 4, 5, 678901) if i % 2 else None, t, 0, None, i, t, -i, t, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, tables.ITEMS)
    tables.write_csv(df, str(tmp_path / "all"))
    got = sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "all"), tables.ITEMS, line_sep="\n").collect()))
    assert [(a, b) for a, b in zip(got, rows, strict=True) if a != b] == []


def test_utf8(spark):
    from wildloom.functions import is_text, strict_text, valid_text

    df = spark.createDataFrame([(1, bytearray("aé日😀".encode())), (2, bytearray(b"a\xff")), (3, None), (4, bytearray(b"")), (5, bytearray(b"\xe2\x82"))], "id int, b binary")
    got = {r.id: (r.ok, r.t) for r in df.select("id", is_text(F.col("b")).alias("ok"), valid_text(F.col("b")).alias("t")).collect()}
    assert got[1] == (True, "aé日😀") and got[2] == (False, "a\ufffd") and got[3] == (None, None) and got[4] == (True, "") and not got[5][0]
    assert df.where("id in (1, 4)").select(strict_text(F.col("b"))).collect()[0][0] == "aé日😀"
    with pytest.raises(Exception, match="(?i)utf"):
        df.where("id = 2").select(strict_text(F.col("b"))).collect()
