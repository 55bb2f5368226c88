"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random

import duckdb
import numpy as np
import pytest
from brute import linked, personal_data, without_repeats, written
from compare import differences
from pyspark.sql import functions as F

import corpus_pipeline
from civicpulse.llm import (
    decontamination,
    jaccard,
    neighbours,
    packing,
    pii,
    quality,
    repeats,
    sharding,
    tokens,
    urls,
)
from civicpulse.llm.common import start
from civicpulse.llm.components import components

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, set_id int, bucket string, "
    "part string, number string, spans string, score string, hash string, rank string, block string, row string, y string"
)
PASSAGE = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"long{i}" for i in range(60_000))


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    start(spark)


@pytest.fixture(scope="module")
def docs(spark):
    """Texts by number of the row; rows 8 and 9 are the same row, null doc_ids are two rows."""
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, PASSAGE), (6, f"before {PASSAGE} after"), (7, LONG),
        (8, "mail a.b@c.example.com or +1 (329) 555-7030"), (8, "mail a.b@c.example.com or +1 (329) 555-7030"),
        (None, "a null id"), (None, None), (10, "x" * 300_000), (11, "é👩‍👩‍👧 10.0.0.1\u00a0z\u2581 \u2581y"),
    ]
    rows = [(d, t, None, None, None, *["c"] * 1, 1, *["c"] * 10) for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE, "x"), (2, None, "x"), (3, "", "x"), (None, PASSAGE, "x")], "item_id long, text string, key string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1, 0) for i in range(1, 9)] + [(10, 0, 0), (11, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def texts_of(docs):
    return [r.text for r in docs.collect()]


def operators(benchmark, labels):
    return {
        "pii": lambda d: pii.personal_data(d).select("doc_id", "n_email", "spans"),
        "repeats": repeats.remove_repeats,
        "tokens": tokens.token_counts,
        "sharding": lambda d: sharding.place(d, ["a", "b"], slots=101),
        "jaccard": lambda d: jaccard.classes(d).select("doc_id", "class_id", "n_links"),
        "quality": lambda d: quality.score(d, quality.train(d, labels)),
    }


@pytest.mark.parametrize("name", ["pii", "repeats", "tokens", "sharding", "jaccard", "quality"])
def test_every_row_has_a_row(docs, benchmark, labels, name):
    run = operators(benchmark, labels)[name]
    found = run(docs)
    assert sorted(repr(r.doc_id) for r in found.collect()) == sorted(repr(r.doc_id) for r in docs.collect())
    assert run(docs.where("false")).count() == 0
    nulls = docs.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
    assert run(nulls).count() == docs.count()


def test_values_of_odd_rows(docs):
    texts = texts_of(docs)
    assert sorted(r[1:] for r in repeats.remove_repeats(docs).collect()) == sorted(without_repeats(texts))
    links, _ = linked(texts)
    assert sorted(r.n_links for r in jaccard.classes(docs).collect()) == sorted(links)
    spans = sorted(written(personal_data(t)) for t in texts)
    assert sorted(r.spans for r in pii.personal_data(docs).collect()) == spans


@pytest.mark.parametrize("group", [1, repeats.GROUP])
def test_repeats_within_and_between_texts(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    words = [f"r{i}" for i in range(200)]
    texts = [
        "x " * 100, "x " * 34, " ".join(words[:36]), " ".join(words[1:36]), " ".join(words[2:36]), " ".join(words[50:90] * 2),
        " ".join(words[100:140] + ["gap"] + words[140:180]), " ".join(["new"] + words[105:175]), "x " * 50 + " ".join(words[:40]),
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [tuple(r)[1:] for r in repeats.remove_repeats(table).orderBy("doc_id").collect()]
    assert found == without_repeats(texts)


def test_tokens_of_odd_rows(docs):
    import public_tokenizers
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.VOCABULARY))
    expected = sorted((len((t or "").encode()), len(processor.encode(t or ""))) for t in texts_of(docs))
    assert sorted((r.n_bytes, r.n_tokens) for r in tokens.token_counts(docs).collect()) == expected


def test_packing_of_odd_rows(docs):
    rows = packing.pack(docs).collect()
    assert sum(r.length == 1 for r in rows) >= 3  # null and empty texts
    assert sum(r.piece == 0 for r in rows) == docs.count()
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack(docs.where("false")).count() == 0


@pytest.mark.parametrize("counts", [{1: 5}, {2048: 3}, {2047: 2, 1: 1}, {1024: 7}, {700: 100, 300: 7, 3: 1}, {i: 3 for i in range(1, 2049)}])
def test_plans_place_each_piece_once(counts):
    plan = packing.Plan(counts)
    ranks, room = {n: set() for n in counts}, {}
    for length, rank, number, first, per, base in plan.segments:
        for i in range(number):
            assert rank + i not in ranks[length]
            ranks[length].add(rank + i)
            room.setdefault(first + i // per, []).append((base + i % per * length, length))
    assert {n: len(r) for n, r in ranks.items()} == counts
    for spans in room.values():
        spans.sort()
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) <= 2048
    assert sorted(room) == list(range(plan.bins))
    assert plan.bins <= 1.05 * sum(n * c for n, c in counts.items()) / 2048 + 25 or counts == {1024: 7}


def test_decontamination_of_odd_rows(docs, benchmark):
    rows = decontamination.overlaps(docs, benchmark)
    assert sorted((r.doc_id, r.item_id, r.n_words, r.n_equal) for r in rows.collect()) == [(5, 1, 60, 60), (6, 1, 60, 60)]
    assert decontamination.overlaps(docs, benchmark.where("false")).count() == 0
    assert decontamination.overlaps(docs.where("false"), benchmark).count() == 0
    kept = decontamination.without_benchmark(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2


def test_decontamination_tolerates_substitutions(spark):
    words = PASSAGE.split()
    item = " ".join(words[:40])
    some = [w if i % 9 != 4 else f"other{i}" for i, w in enumerate(words[:40])]
    many = [w if i % 3 else f"other{i}" for i, w in enumerate(words[:40])]
    table = spark.createDataFrame([
        (1, "start " + " ".join(some).upper() + "! end"), (2, " ".join(many)), (3, " ".join(words[5:18])), (4, " ".join(words[5:15])),
        (5, "p q r s t u v"), (6, "p q r s t z v"),
    ], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "q r s t u"), (9, "p q")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.overlaps(table, items).collect()}
    assert found == {(1, 7), (3, 7), (5, 8)}


def test_near_copies_in_odd_numbers(spark):
    words = [f"v{i}" for i in range(100)]
    rows, number = [], 0
    for i in range(60):  # a chain: each differs from the next by one word more
        rows.append((i, " ".join([*(f"new{j}" for j in range(i)), *words[i:]])))
    rows += [(100, "a b c"), (101, "a b c"), (102, "a b"), (103, "a b c d"), (None, "a b c")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    links, root = linked([t for _, t in rows])
    found = {(r.doc_id, r.n_links, r.class_id) for r in jaccard.classes(table).collect()}
    assert found == {(d, links[k], rows[root[k]][0]) for k, (d, _) in enumerate(rows)}
    assert jaccard.one_of_each(table).count() == len(set(root))


def test_large_buckets_are_split_and_blocked(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:150], f"own{i}", *words[150:]])) for i in range(60)]
    found = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in found} == {(0, 59)}


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 120), 100)}


def test_identifiers_found_by_their_context(spark):
    base = [(i, f"text {i} here. Please call me at +1 202 555 01{i:02d} any day") for i in range(30)]
    new = [(100, "You may call me at 555-0199, thanks"), (101, "born in 1999 and again in 2001"), (102, "see me at 12 today")]
    table = spark.createDataFrame(base + new, "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.personal_data(table).collect()}
    assert rows[100].spans == "phone:19:27" and rows[100].n_phone == 0
    assert rows[101].spans == "" and rows[102].spans == ""
    assert rows[3].spans == written(personal_data(base[3][1]))
    assert pii.masked(table).where("doc_id = 100").first().text == "You may call me at [PHONE], thanks"


@pytest.mark.parametrize("text", [
    "a@b.c_d@e.f", "..a@b-.c.d@e", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111 1111-1111 1111 4111111111111112 1",
    "+1 (2)3-4.5 6789+12345678901234567", "👩 é x@y.zz 👩 8.8.8.8", "+1234567890)) +1 (((( 4", "a@b@c.d %@x.y", "1-2 3",
])
def test_base_spans(spark, text):
    table = spark.createDataFrame([(1, text * 3)], "doc_id long, text string")
    assert pii.personal_data(table).first().spans == written(personal_data(text * 3))


def test_many_spans_in_a_text(spark):
    text = " ".join(f"a{i}@b.cd" for i in range(1500))
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.personal_data(table).first().spans == written(personal_data(text))
    assert pii.masked(table).first().text == " ".join(["[EMAIL]"] * 1500)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]),
            (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [0.5, 0.0]), (100, [0.5, 0.0]), (9, [1.0, 0.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    found = neighbours.search(table, F.col("vec_id") % 100 == 0)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == [
        (0, 1, 1, 0.0), (0, 2, 9, 0.0), (0, 3, 100, 0.5), (0, 4, 100, 0.5),
        *[row for row in ((100, 1, 100, 0.0), (100, 2, 0, 0.5), (100, 3, 1, 0.5), (100, 4, 9, 0.5)) for _ in range(2)],
    ]  # every other row is a candidate, the equal one of the same vec_id too
    assert neighbours.search(table.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert neighbours.search(table, F.lit(False)).count() == 0


def test_large_leaves_are_searched_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 50)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 3)
    rows = [(i, [float(i % 7), 1.0, float(i // 7 % 5)] if i < 400 else [3.0, 3.0, 3.0]) for i in range(700)]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    points = dict(rows)
    for query in range(0, 700, 20):
        got = sorted((r.score, r.vec_id) for r in found if r.query_id == query)
        assert got == sorted((math.dist(points[query], p), v) for v, p in rows if v != query)[:10]


def test_urls_of_odd_rows(spark):
    given = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/12?x", "x://example.org", "a://b://c/d", "http://com/fr/", "http://COM?q/fr/",
             "http://É.com/de/\n#z", "http://notorg/", "http://example.org/en/1", "http://example.org/es", "http://h/" + "a/" * 5000]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(given + given[-2:])], "page_id long, url string, host string")
    rows = {r.page_id: r for r in urls.judge(pages).collect()}
    assert len(rows) == len(given) + 2
    assert [(rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) for i in range(13)] == [
        *[("", "", None, "allow")] * 4, ("a.example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "", None, "allow"),
        ("b:", "//c/d", None, "allow"), ("com", "/fr/", "com/fr/", "allow"), ("com", "", None, "allow"),
        ("É.com", "/de/\n", "com/de/", "block"), ("notorg", "/", None, "allow"), ("example.org", "/en/1", "example.org/en/1", "block"),
        ("example.org", "/es", "org/", "allow"),
    ]
    assert urls.judge(pages.where("false")).count() == 0


def test_templates_merge_and_are_rejected(spark):
    """Paths below /go/ are nearly all blocked, so the one no rule knows is too; /read/ is allowed."""
    rules = (urls.Rule("block", "h", "/go/b"), urls.Rule("allow", "h", "/read/a"))
    given = [f"http://h/go/b{w}" for w in _names(60)] + [f"http://h/read/a{w}" for w in _names(60)]
    pages = spark.createDataFrame(list(enumerate([*given, "http://h/go/new", "http://h/read/new"])), "page_id long, url string")
    rows = {r.page_id: r for r in urls.judge(pages, rules).collect()}
    assert (rows[120].verdict, rows[120].template) == ("block", "h/go/*")
    assert (rows[121].verdict, rows[121].template) == ("allow", "h/read/*")


def test_only_the_tree_blocks_pages_without_a_rule(spark):
    """A section whose labelled parts are blocked; the site as a whole is not, nor are its other sections."""
    rules = (urls.Rule("block", "h.com", "/forum/spam/"), urls.Rule("block", "h.com", "/forum/junk/"), urls.Rule("allow", "h.com", "/news/"))
    given = [f"http://{'www.' if i % 2 else ''}h.com/forum/{w}/t{i}" for i in range(30) for w in ("spam", "junk")]
    given += [f"http://h.com/news/{'abc'[i % 3]}/x" for i in range(90)]
    asked = ["http://h.com/forum/other/t1", "http://m.h.com/forum/more", "http://h.com/news", "http://h.com/about/us", "http://h.com/forum/a/b/c/d/e/f/g"]
    pages = spark.createDataFrame(list(enumerate(given + asked)), "page_id long, url string")
    rows = {r.page_id: r for r in urls.judge(pages, rules).collect()}
    found = [(rows[len(given) + i].verdict, rows[len(given) + i].rule) for i in range(len(asked))]
    assert found == [("block", None), ("block", None), ("allow", None), ("allow", None), ("block", None)]
    templates = {r.template for r in rows.values()}
    assert "h.com/forum/+/+" in templates and len(templates) < 15


def test_templates_equal_sql(spark, tmp_path):
    """Spark's levels against DuckDB's, over deep and wide trees and several sites."""
    pick = random.Random(6)
    sections = ["a", "b", "c", "fr", "de", "es", "en"]

    def url() -> str:
        host = pick.choice(["www.x.com", "x.com", "m.x.com", "example.org", "y.example.org", "net", "blog.z.com", "z.com"])
        depth = pick.choice([0, 1, 2, 3, 4, 5, 9, 30])
        path = "".join("/" + pick.choice([*sections, f"id{pick.randrange(10**6)}", pick.choice("abcdefgh") * 9]) for _ in range(depth))
        return f"http://{host}{path}{pick.choice(['', '/', '?q', '/1'])}"

    pages = [(i, url()) for i in range(3000)]
    found = urls.judge(spark.createDataFrame(pages, "page_id long, url string"))
    connection = duckdb.connect()
    connection.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    connection.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    assert differences(found, connection, urls.judge_sql()) == []


def _names(n):
    return [chr(97 + i // 26) + chr(97 + i % 26) for i in range(n)]


def test_sharding_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    ten = sharding.lookup_table(names, 1009)
    assert max(ten.count(i) for i in range(10)) - min(ten.count(i) for i in range(10)) <= 1
    nine = sharding.lookup_table(names[:9], 1009)
    assert sum(a != b for a, b in zip(ten, nine) if a < 9) <= 0.25 * 1009
    assert ten == _turns(names, 1009)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1000)


def _turns(names, slots):
    """The same table by whole permutations."""
    import hashlib

    orders = []
    for name in names:
        digest = hashlib.md5(name.encode()).digest()
        at, skip = int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1
        orders.append([(at + j * skip) % slots for j in range(slots)])
    owner = {}
    while True:
        for shard, order in enumerate(orders):
            slot = next(s for s in order if s not in owner)
            owner[slot] = shard
            orders[shard] = order[order.index(slot) + 1 :]
            if len(owner) == slots:
                return [owner[s] for s in range(slots)]


def test_quality_without_two_classes(docs, labels):
    for few in (labels.where("quality = 1"), labels.where("false")):
        scores = {r.score for r in quality.score(docs, quality.train(docs, few)).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1


def test_equal_texts_have_equal_scores_whatever_else_differs(docs, labels):
    model = quality.train(docs, labels)
    again = docs.withColumns({"lang": F.lit("zz"), "doc_id": F.col("doc_id") + 1000})
    assert sorted(r.score for r in quality.score(docs, model).collect()) == sorted(r.score for r in quality.score(again, model).collect())
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.score(docs, model).where("predicted = 1").count()


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_tables(spark, docs, benchmark, labels, tmp_path, number):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[number]
    found = stage(spark, docs, str(tmp_path))
    if name != "packing":
        assert found.columns == docs.columns
    assert found.count() > 0
    assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_vectors_that_share_a_vec_id(spark):
    """Each is a vector of its own: all other rows are its candidates, those of the same vec_id and equal ones too."""
    pick = np.random.default_rng(3)
    rows = [(100, [0.0, 2.0]), (1, [1.0, 1.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (200, [3.0, 0.5]), (200, [3.0, 0.5]), (200, [-1.0, 4.0])]
    rows += [(int(pick.integers(2, 90)), pick.standard_normal(2).tolist()) for _ in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = neighbours.search(table, F.col("vec_id") % 100 == 0).collect()
    assert (100, 1.0, 1) in {(r.query_id, r.score, r.vec_id) for r in found}
    expected = []
    for i, (name, vector) in enumerate(rows):
        if name % 100 == 0:
            others = sorted((math.dist(vector, v), n) for j, (n, v) in enumerate(rows) if j != i)[:10]
            expected += [(name, rank, n, pytest.approx(d)) for rank, (d, n) in enumerate(others, 1)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found)
    assert len(got) == 40 and all(g in expected for g in got)
