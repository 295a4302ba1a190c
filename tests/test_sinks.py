"""What is written, read again; and written again."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from gleaner.sources import sinks

ODD = 'say "hi",\nline two; é\t'


def test_files_twice(spark, tmp_path):
    at = str(tmp_path / "files")
    files = spark.createDataFrame(
        [("a.com", "robots.txt", "x\ny\n"), ("a.com", "ai.json", '{"a":1}'), ("b.com", "robots.txt", ODD), ("b.com", "empty.txt", None)],
        "site string, name string, content string",
    )
    expected = {
        ("a.com", "robots.txt", "x\ny\n"), ("a.com", "ai.json", '{"a":1}'), ("b.com", "robots.txt", ODD), ("b.com", "empty.txt", ""),
    }
    read = lambda: {(r["site"], r["name"], r["content"].rstrip("\x00")) for r in sinks.read_files(spark, at).collect()}
    for _ in range(2):
        sinks.write_files(files, at)
        assert read() == expected
    assert len(list(Path(at).glob("site=*/name=*/part-*"))) == 4
    # another batch replaces its own files only
    sinks.write_files(spark.createDataFrame([("a.com", "robots.txt", "new")], files.schema), at)
    assert read() == {x for x in expected if x[:2] != ("a.com", "robots.txt")} | {("a.com", "robots.txt", "new")}


def test_sections_are_in_order(spark, tmp_path):
    at = str(tmp_path / "sections")
    rows = spark.createDataFrame(
        [(f"s{k % 3}", "llms-full.txt", k, f"part {k}") for k in range(300)], "site string, name string, place long, content string",
    ).repartition(7)
    for _ in range(2):
        sinks.write_sections(rows, at, "place")
        for s in range(3):
            parts = sorted(Path(at, f"site=s{s}", "name=llms-full.txt").glob("part-*"))
            assert "".join(p.read_text() for p in parts).split("\n")[:-1] == [f"part {k}" for k in range(300) if k % 3 == s]


def test_csv_twice(spark, tmp_path):
    at = str(tmp_path / "csv")
    rows = [(1, "plain", 5, "a"), (2, ODD, None, "a"), (3, "", 7, "b"), (4, 'quote " only', 8, "b")]
    items = spark.createDataFrame(rows, "seq int, name string, score int, site string")
    for _ in range(2):
        sinks.write_csv(items, at)
        got = sinks.read_csv(spark, at, "seq int, name string, score int, site string").collect()
        assert sorted((r["seq"], r["name"] or "", r["score"], r["site"]) for r in got) == sorted(rows)
    text = next(Path(at, "site=a").glob("part-*")).read_text()
    assert text.startswith('"seq","name","score"\n"1","plain","5"\n') and '""hi""' in text


def test_summaries_and_log_twice(spark, tmp_path):
    at, log = str(tmp_path / "json"), str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 5, [("x", 1)]), ("b", 6, [])], "site string, score int, items array<struct<name:string,n:int>>")
    events = spark.createDataFrame(
        [(1, "2024-01-01 00:00:00"), (2, "2024-01-02 05:00:00")], "id int, t string",
    ).withColumn("at", F.to_timestamp("t")).drop("t")
    for _ in range(2):
        sinks.write_summaries(rows, at)
        sinks.append_log(events, log)
        assert [
            json.loads(x) for x in next(Path(at, "site=a").glob("part-*")).read_text().splitlines()
        ] == [{"score": 5, "items": [{"name": "x", "n": 1}]}]
        assert sorted(r["id"] for r in spark.read.parquet(log).collect()) == [1, 2]
    sinks.append_log(events.where("id = 2").withColumn("id", F.lit(3)), log)
    assert sorted(r["id"] for r in spark.read.parquet(log).collect()) == [1, 3]


def test_upsert(spark, tmp_path):
    at = str(tmp_path / "table")
    schema = "domain string, score int, version int, gone boolean"
    table = lambda: {r["domain"]: r["score"] for r in spark.read.parquet(at).collect()}
    first = spark.createDataFrame([(f"d{k}", k, 1, False) for k in range(50)], schema)
    more = spark.createDataFrame(
        [
            ("d1", 100, 2, False), ("d2", 200, 0, False), ("d3", 300, 1, False), ("new", 1, 1, None), ("d4", None, 2, True),
            ("d5", 7, 3, False), ("d5", 8, 2, False),
        ],
        schema,
    )
    expected = {f"d{k}": k for k in range(50)} | {"d1": 100, "d3": 300, "new": 1, "d5": 7}
    del expected["d4"]
    sinks.upsert_table(spark, at, first, "domain", "version", 4, "gone")
    for _ in range(2):
        sinks.upsert_table(spark, at, more, "domain", "version", 4, "gone")
        assert table() == expected
    sinks.upsert_table(spark, at, spark.createDataFrame([(d, 0, 9, True) for d in expected], schema), "domain", "version", 4, "gone")
    assert not list(Path(at).glob("part=*"))
