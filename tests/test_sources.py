import datetime as dt
import json
from types import SimpleNamespace

import pandas as pd
import pytest

from civicpulse.operators.regions import select_trends
from civicpulse.operators.speeches import (
    _parse_batches,
    attribute_names,
    parse_speeches,
    promote_attributes,
)
from civicpulse.session import scratch_path
from civicpulse.sources.articles import read_articles
from civicpulse.sources.posts import read_posts
from civicpulse.sources.sinks import write_table
from civicpulse.sources.speeches import read_speeches
from civicpulse.sources.trends import merge_trend_dir, read_counts, read_trend_dir, read_trend_long

HEADER = "date,England,Wales,Scotland,Northern Ireland\n"


@pytest.fixture
def wide(tmp_path):
    (tmp_path / "one +topic%.csv").write_text(HEADER + "2020-12-13,5,4,6,0\n2020-12-20,4,,x,0\n")
    (tmp_path / "two.csv").write_text(HEADER + "2020-12-13,14.0,6.3,4.48,1.9600000000000002\n")
    return tmp_path


def test_wide_files_are_tagged_and_melted(spark, rows, wide):
    topics = {"one +topic%.csv": "HS2", "two.csv": "Sizewell C"}
    table = read_trend_dir(spark, str(wide), topics)
    assert rows.get(table, "topic_name", "England", "Wales", "Northern Ireland") == [
        ("HS2", 4.0, None, 0.0), ("HS2", 5.0, 4.0, 0.0), ("Sizewell C", 14.0, 6.3, 1.9600000000000002)
    ]
    long = merge_trend_dir(spark, str(wide), topics)
    assert long.count() == 3 * 4 - 2
    assert long.columns == ["date", "topic_name", "region", "interest_value", "region_name"]


def test_a_file_without_topic_is_an_error(spark, wide):
    with pytest.raises(ValueError, match=r"\['one \+topic%.csv'\]"):
        read_trend_dir(spark, str(wide), {"two.csv": "Sizewell C"})


def test_a_file_with_other_columns_is_an_error(spark, wide):
    (wide / "two.csv").write_text("date,Wales,England,Scotland,Northern Ireland\n2020-12-13,1,2,3,4\n")
    with pytest.raises(Exception, match="header"):
        read_trend_dir(spark, str(wide), {"one +topic%.csv": "a", "two.csv": "b"}).collect()


def test_other_columns_in_every_file_are_ignored(spark, rows, wide):
    for name in ("one +topic%.csv", "two.csv"):
        (wide / name).write_text("Wales,note,date,England,Scotland,Northern Ireland\n1,x,2020-12-13,2,3,4\n")
    table = read_trend_dir(spark, str(wide), {"one +topic%.csv": "a", "two.csv": "b"})
    assert rows.get(table, "topic_name", "England", "Wales") == [("a", 2.0, 1.0), ("b", 2.0, 1.0)]
    assert merge_trend_dir(spark, str(wide), {"one +topic%.csv": "a", "two.csv": "b"}).count() == 8


def test_a_missing_region_column_is_an_error(spark, wide):
    topics = {"one +topic%.csv": "a", "two.csv": "b"}
    with pytest.raises(ValueError, match="Cornwall"):
        read_trend_dir(spark, str(wide), topics, ["England", "Cornwall"])


def test_long_file(spark, rows, tmp_path):
    (tmp_path / "t.csv").write_text(
        "date,Program,region,value\n2024-12-19,HS2,E12000003,44\nbad,HS2,E12000003,1\n2024-12-20,HS2,,1\n"
    )
    table = read_trend_long(spark, str(tmp_path))
    assert rows.get(table, "date", "topic_name", "region", "region_name", "interest_value") == [
        (dt.date(2024, 12, 19), "HS2", "E12000003", "E12000003", 44.0)
    ]


def test_quotes_are_doubled_inside_quotes(spark, rows, tmp_path):
    (tmp_path / "t.csv").write_text(
        'date,topic_name,region,region_name,interest_value\n2024-12-19,"The ""HS2"", \\ line",r,"A, B",1\n'
    )
    assert rows.get(read_trend_long(spark, str(tmp_path)), "topic_name", "region_name") == [
        ('The "HS2", \\ line', "A, B")
    ]


def test_long_file_without_needed_column(spark, tmp_path):
    (tmp_path / "t.csv").write_text("date,Program,value\n2024-12-19,HS2,44\n")
    with pytest.raises(ValueError, match="region"):
        read_trend_long(spark, str(tmp_path))


def test_daily_counts(spark, rows, tmp_path):
    (tmp_path / "c.csv").write_text("date,HS2,New Hospital Programme\n2025-01-01,20.0,0.0\n2025-01-02,,1.0\n")
    assert rows.get(read_counts(spark, str(tmp_path)), "topic", "date", "value") == [
        ("HS2", dt.date(2025, 1, 1), 20.0), ("HS2", dt.date(2025, 1, 2), None),
        ("New Hospital Programme", dt.date(2025, 1, 1), 0.0), ("New Hospital Programme", dt.date(2025, 1, 2), 1.0),
    ]


def test_posts_with_quotes_line_breaks_and_bad_times(spark, rows, tmp_path):
    (tmp_path / "p.csv").write_text(
        "topic,created_at,month,author,text,likes,reposts,replies\n"
        'HS2,2025-12-18T23:25:52.713Z,December 2025,a,"two\nlines, ""quoted""",7,1,0\n'
        "HS2,2025-12-19T00:30:00+01:00,December 2025,b,plain,3.0,,x\n"
        "HS2,yesterday,December 2025,c,lost,3,0,0\n"
    )
    assert rows.get(read_posts(spark, str(tmp_path)), "author", "day", "text", "likes", "reposts", "replies") == [
        ("a", dt.date(2025, 12, 18), 'two\nlines, "quoted"', 7, 1, 0),
        ("b", dt.date(2025, 12, 18), "plain", 3, None, None),
    ]


def test_articles_by_field_and_by_folder(spark, rows, tmp_path):
    folder = tmp_path / "search_query=High Speed 2"
    folder.mkdir()
    response = {"status": "ok", "articles": [{"url": "u1", "title": "T1"}, {"url": None, "source": {"name": "S"}}]}
    (folder / "1.json").write_text(json.dumps(response, indent=2))
    (folder / "2.json").write_text(json.dumps({"status": "ok", "articles": []}))
    table = read_articles(spark, str(tmp_path))
    assert rows.get(table, "search_query", "pos", "url", "title", "source.name") == [
        ("High Speed 2", 0, "u1", "T1", None), ("High Speed 2", 1, None, None, "S")
    ]
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join(json.dumps({"search_query": q, **response}) for q in "ab"))
    assert read_articles(spark, str(lines), multi_line=False).groupBy("search_query").count().count() == 2


DEBATE = """<?xml version="1.0" encoding="ISO-8859-1"?>
<publicwhip scraperversion="a" latest="yes">
  <major-heading id="h">Roads</major-heading>
  <speech id="s1" latest="no" data="hidden"><p pid="1">Caf\xe9 <i>is</i> open</p><p>Second</p></speech>
  <group><speech id="s2"><phrase/>tail<speech id="s3"><p>Inner</p></speech></speech></group>
  <speech id="s4" time="10:00"/>
</publicwhip>
"""


def test_speech_files(spark, rows, tmp_path):
    (tmp_path / "debate one.xml").write_bytes(DEBATE.encode("latin-1"))
    (tmp_path / "broken.xml").write_text("<publicwhip><speech><p>x</p></speech>")
    (tmp_path / "notes.txt").write_text("<speech><p>no</p></speech>")
    table = read_speeches(spark, str(tmp_path))
    good = table.filter("error is null")
    assert rows.get(good, "file_name", "ordinal", "data") == [
        ("debate one.xml", 0, "Café "), ("debate one.xml", 1, None),
        ("debate one.xml", 2, "Inner"), ("debate one.xml", 3, None),
    ]
    assert rows.get(table.filter("error is not null"), "file_name", "data") == [("broken.xml", None)]
    names = [r.key for r in attribute_names(good).orderBy("key").collect()]
    wide = promote_attributes(good, names)
    assert wide.columns == ["file_name", "ordinal", "data", "error", "id", "latest", "scraperversion", "time"]
    assert rows.get(wide, "id", "latest", "scraperversion", "time") == [
        ("s1", "no", "a", None), ("s2", "yes", "a", None), ("s3", "yes", "a", None), ("s4", "yes", "a", "10:00")
    ]


def test_a_speech_at_the_root_and_an_attribute_named_like_a_column(spark, rows):
    documents = rows.make("file_name string, content string", ("f", '<speech id="r"><p>Root</p></speech>'),
                          ("g", '<d error="e"><speech><p>x</p></speech></d>'), ("h", None))
    table = parse_speeches(documents)
    assert rows.get(table, "file_name", "data") == [("f", "Root"), ("g", "x")]
    with pytest.raises(ValueError, match="error"):
        promote_attributes(table, ["error", "id"])
    assert "id" in promote_attributes(table, ["id"]).columns


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_sink_round_trip(spark, rows, tmp_path, fmt):
    table = rows.make("topic_name string, text string", ("HS2", 'a "b", c'), ("S", "d"))
    write_table(table, str(tmp_path / fmt), fmt, partition_by=["topic_name"])
    reader = spark.read.option("header", True).option("escape", '"')
    assert rows.get(reader.format(fmt).load(str(tmp_path / fmt)), "topic_name", "text") == rows.get(table)
    with pytest.raises(ValueError):
        write_table(table, str(tmp_path / "x"), "xlsx")


def test_a_topic_is_read_from_its_own_folder(spark, rows, tmp_path):
    trends = rows.make("date date, topic_name string, region string, interest_value double",
                       (dt.date(2025, 1, 1), "HS2", "Wales", 1.0), (dt.date(2025, 1, 2), "S", "Wales", 2.0))
    write_table(trends, str(tmp_path / "t"), partition_by=["topic_name"])
    selected = select_trends(spark.read.parquet(str(tmp_path / "t")), "HS2", "2025-01-01")
    plan = selected._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(topic_name" in plan and "EqualTo(date,2025-01-01)" in plan
    assert selected.count() == 1


def test_a_long_document_comes_in_batches():
    speech = "<speech id='s'><p>x</p></speech>"
    document = pd.DataFrame({"file_name": ["f"], "content": [f"<d>{speech * 100_000}</d>".encode()]})
    sizes = [len(batch) for batch in _parse_batches(iter([document]))]
    assert sum(sizes) == 100_000 and len(sizes) == 20


def test_a_partitioned_table_has_few_files(spark, tmp_path):
    rows = spark.range(0, 10_000, 1, 32).selectExpr("id % 5 AS topic_name", "id AS value")
    write_table(rows, str(tmp_path / "t"), partition_by=["topic_name"])
    written = spark.read.parquet(str(tmp_path / "t"))
    assert len(written.inputFiles()) <= 10 and written.count() == 10_000


def test_posts_with_cells_that_are_no_numbers(spark, tmp_path):
    (tmp_path / "posts.csv").write_text(
        "topic,created_at,month,author,text,likes,reposts,replies\n"
        "t,2025-01-01T10:00:00Z,January 2025,a,x,1e30,NaN,3\n"
        "t,soon,January 2025,a,x,1,1,1\n"
    )
    found = read_posts(spark, str(tmp_path / "posts.csv")).select("likes", "reposts", "replies").collect()
    assert [tuple(r) for r in found] == [(None, None, 3)]


def test_scratch_paths_are_fresh_and_shared(spark):
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    assert one != two and one.startswith(shared)
    context = SimpleNamespace(getCheckpointDir=lambda: None)
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context)
    with pytest.raises(ValueError):
        scratch_path(unset, "x")
