"""Files split at any byte against the readers that take a file whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from civicpulse.operators.speeches import parse_speeches
from civicpulse.sources.blocks import pieces
from civicpulse.sources.boundaries import read_boundaries
from civicpulse.sources.large_csv import CsvScan, read_large_csv
from civicpulse.sources.large_geojson import FeatureScan
from civicpulse.sources.large_xml import SpeechParser, read_large_speeches
from civicpulse.sources.posts import read_posts
from civicpulse.sources.speeches import read_speeches

SIZES = [48, 700, 1 << 20]


@pytest.fixture(params=SIZES)
def block(spark, request):
    """Blocks of some bytes, restored afterwards."""
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield request.param
    for name, value in before.items():
        spark.conf.set(name, value)


def cells(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some_csv(seed: int, rows: int) -> str:
    pick = random.Random(seed)

    def cell() -> str:
        text = "".join(pick.choice(["a", "b", " ", "é", '"', ",", "\n", "\r\n", 'x"y', '""', "long " * 9]) for _ in range(pick.randrange(9)))
        kind = pick.random()
        if kind < 0.6:
            return '"' + text.replace('"', '""') + '"'
        return ["plain", "", 'st"ray', '"closed"then open', '""'][int(kind * 100) % 5]

    end = "\r\n" if seed % 3 == 0 else "\n"
    return f"a,b c,d{end}" + "".join(f"{i},{cell()},{cell()}{end}" for i in range(rows))


@pytest.mark.parametrize("seed", range(3))
def test_csv_rows_at_any_block_size(spark, tmp_path, block, seed):
    (tmp_path / "x.csv").write_bytes(some_csv(seed, 25).encode())
    (tmp_path / "y.csv").write_bytes(some_csv(seed + 10, 3).replace("\r\n", "\n").rstrip("\n").encode())
    whole = spark.read.options(header="true", multiLine="true", escape='"').csv(str(tmp_path))
    assert cells(read_large_csv(spark, str(tmp_path))) == cells(whole)


def test_csv_blocks_are_read_apart(spark, tmp_path, block):
    (tmp_path / "x.csv").write_text(some_csv(5, 60))
    starts = pieces(spark, str(tmp_path), "\n").select("block").distinct().count()
    assert starts > 20 or block > 48


def test_a_quote_that_is_never_closed(spark, tmp_path, block):
    (tmp_path / "x.csv").write_text('a,b\n1,x\n2,"open\nto the end\n3,y\n')
    whole = spark.read.options(header="true", multiLine="true", escape='"').csv(str(tmp_path))
    assert cells(read_large_csv(spark, str(tmp_path)).select("a")) == cells(whole.select("a"))


def test_csv_with_folders_and_another_header(spark, tmp_path, block):
    for day in ("one", "two"):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "x.csv").write_text(f'a,b\n{day},"line\nbreak"\n')
    got = read_large_csv(spark, str(tmp_path))
    assert cells(got) == [("one", "line\nbreak", "one"), ("two", "line\nbreak", "two")]
    (tmp_path / "day=two" / "x.csv").write_text('a,c\n1,"2"\n')
    with pytest.raises(Exception, match="another header"):
        read_large_csv(spark, str(tmp_path)).collect()


def test_posts_of_large_files(spark, tmp_path, block):
    rows = "".join(f'HS2,2025-12-{1 + i % 28:02d}T23:25:52.713Z,December 2025,a{i},"two\nlines, ""{i}""",{i},1,x\n' for i in range(50))
    (tmp_path / "p.csv").write_text("topic,created_at,month,author,text,likes,reposts,replies\n" + rows)
    assert cells(read_posts(spark, str(tmp_path), large_files=True)) == cells(read_posts(spark, str(tmp_path)))


def test_summaries_of_quotes_compose(spark):
    """A block's summary, applied to the state before it, is the state that reading it line by line gives."""
    scan, lines = CsvScan(), some_csv(8, 80).split("\n")
    table = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i long, value string")
    marked = table.withColumns(scan.columns()).orderBy("i").select("value", *scan.columns()).toArrow()
    batches = [marked.slice(i, 1).to_batches()[0] for i in range(marked.num_rows)]
    state = scan.begin
    for batch in batches:
        state = scan.after(state, scan.summary([batch]))
    for cut in (1, 7, 50):
        first, rest = scan.summary(batches[:cut]), scan.summary(batches[cut:])
        assert scan.after(scan.after(scan.begin, first), rest) == scan.after(scan.begin, scan.summary(batches)) == state


def some_features(seed: int, count: int) -> dict:
    pick = random.Random(seed)

    def feature(i: int):
        if pick.random() < 0.05:
            return None
        properties = {"n": i, "RGN24CD": f"R{i}", "s": pick.choice(['a}b', '{"', '\\"x\\', "plain", "[1,2", "features", 'x"features":[']), "features": [1, {"q": [2]}], "z": None, "e": {}}
        rings = [[[pick.random(), pick.random()] for _ in range(pick.randrange(4, 8))] for _ in range(pick.randrange(1, 3))]
        if pick.random() < 0.3:
            return {"geometry": {"coordinates": [rings], "type": "MultiPolygon"}, "type": "Feature", "properties": properties}
        return {"type": "Feature", "properties": properties, "geometry": {"type": "Polygon", "coordinates": rings}}

    other = [{"features": [{"properties": {"a": "no"}}]}, {}]
    return {"type": "FeatureCollection", "other": other, "crs": {"p": [1, 2]}, "features": [feature(i) for i in range(count)], "tail": [{"x": 1}], "features_": [{}]}


@pytest.mark.parametrize("indent", [None, 1])
def test_features_at_any_block_size(spark, tmp_path, block, indent):
    (tmp_path / "a.json").write_text(json.dumps(some_features(1, 30), indent=indent) + ("\n" if indent else ""))
    (tmp_path / "b.json").write_text(json.dumps(some_features(2, 5), indent=indent))
    (tmp_path / "c.json").write_text('{"features": [], "x": {"features": [{"properties": {}}]}}')
    columns = ["file_name", "feature_pos", "region_code", "region_name", "polygons", F.col("properties")["s"], F.col("properties")["n"]]
    got, whole = read_boundaries(spark, str(tmp_path), large_files=True), read_boundaries(spark, str(tmp_path))
    assert cells(got.select(*columns)) == cells(whole.select(*columns))
    assert got.count() == 35


def test_summaries_of_brackets_compose():
    import pyarrow as pa

    scan = FeatureScan()
    text = json.dumps(some_features(4, 20))
    batches = [pa.RecordBatch.from_pydict({"value": [piece + "}"]}) for piece in text.split("}")[:-1]]
    state, states = scan.begin, []
    for batch in batches:
        states.append(state)
        state = scan.after(state, json.loads(json.dumps(scan.summary([batch]))))
    assert state == [False, "", 19]
    for low, high in ((0, 9), (3, 40), (10, len(batches))):
        summary = json.loads(json.dumps(scan.summary(batches[low:high])))
        assert scan.after(states[low], summary) == (states + [state])[high]


def some_debate(speeches: int) -> str:
    body = "".join(
        f'<group><speech id="s{i}" time="{i}>"><p>Text {i} &gt; &amp; <i>is</i> {"long " * (i % 30)}</p><p>no</p></speech></group>'
        f"<!-- <speech/> --><speech id='n{i}'><phrase/>tail<speech><p><![CDATA[<speech>{i}]]></p></speech></speech>"
        for i in range(speeches)
    )
    return f'<?xml version="1.0" encoding="ISO-8859-1"?>\n<debate source="caf\xe9" data="hidden">{body}</debate>'


def test_speeches_of_files_of_any_size(spark, tmp_path, block):
    good = some_debate(12)
    for name, text in (("a.xml", good), ("b c.xml", good + "\n"), ("late.xml", good[:-3]), ("more.xml", good + "<x/>"), ("one.xml", "<speech><p>x</p></speech>"), ("none.xml", ""), ("odd.xml", "no xml"), ("x.txt", good)):
        (tmp_path / name).write_bytes(text.encode("latin-1"))
    (tmp_path / "wide.xml").write_bytes('<?xml version="1.0" encoding="UTF-16"?><d><speech a=">"><p>戾 㸀</p></speech></d>'.encode("utf-16"))
    (tmp_path / "mark.xml").write_bytes(b"\xef\xbb\xbf<d><speech><p>marked</p></speech></d>")

    def rows(df):
        return sorted((r.file_name, r.ordinal or 0, r.data or "", sorted((r.attributes or {}).items()), r.error or "") for r in df.collect())

    assert rows(read_speeches(spark, str(tmp_path), large_files=True)) == rows(read_speeches(spark, str(tmp_path)))


def test_a_parser_holds_one_speech():
    parser = SpeechParser()
    for _ in parser.feed(b"<d><g>"):
        pass
    for i in range(2000):
        assert [s[0] for s in parser.feed(b"<speech><p>x</p></speech><other><x/></other>")] == [i]
    assert [len(element) for element in parser.open] == [1, 0]


def test_errors_take_back_the_rows_of_their_file(spark, tmp_path, rows):
    (tmp_path / "f.xml").write_text("<d>" + "<speech><p>x</p></speech>" * 12_000)
    got = read_large_speeches(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].error and got[0].data is None
    documents = rows.make("file_name string, content string", ("f.xml", (tmp_path / "f.xml").read_text()))
    assert parse_speeches(documents).first().error == got[0].error
