"""Identifiers of several words and written-out e-mail addresses, found by their contexts."""

import random
import time

import pytest
from brute import scored

from civicpulse.llm import pii
from civicpulse.llm.common import start

PHONES = [(i, f"text {i} here. Please call me at +1 202 555 01{i:02d} any day") for i in range(30)]
MAILS = [(40 + i, f"letter {i} here. Kindly write to jo{i}@example.com any day") for i in range(30)]
NEW = {
    "You may call me at (202) 555-0143, thanks": ("phone", "(202) 555-0143"),
    "You may call me at 202 555 0143.": ("phone", "202 555 0143"),
    "You may call me at 123 45 6789 or so": ("phone", "123 45 6789"),
    "You may call me at 202 - 555.0143 now": ("phone", "202 - 555.0143"),
    "You may call me at 555-0199 +1 202 555 0101": ("phone", "555-0199"),
    "Just write to jane.doe(at)example.com today": ("email", "jane.doe(at)example.com"),
    "Just write to jane7 [AT] mail5 [dot] example.com, please": ("email", "jane7 [AT] mail5 [dot] example.com"),
    "You may call me at jane.roe(at)example.com": None,
    "Some say 202 555 0143 and jane.poe(at)example.com": None,
}


@pytest.fixture(scope="module")
def spans(spark):
    start(spark)
    rows = PHONES + MAILS + [(100 + i, t) for i, t in enumerate(NEW)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.spans for r in pii.personal_data(table).collect()}


@pytest.mark.parametrize("number", range(len(NEW)))
def test_candidates_of_several_words(spans, number):
    text, expected = list(NEW.items())[number]
    found = [s.split(":") for s in spans[100 + number].split(",") if s]
    found = [(k, text[int(a) : int(b)]) for k, a, b in found]
    assert [f for f in found if not f[1].startswith("+")] == ([expected] if expected else [])


def candidates(spark, count: int):
    text = " ".join(f"word item{i} 10{i}" + (f" jo{i}@example.com" if i % 50 == 0 else "") for i in range(count))
    return pii.base_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).checkpoint()


def test_time_per_candidate_of_one_text_stays(spark):
    start(spark)
    seconds = {}
    for count in (1_000, 8_000, 64_000):
        found = candidates(spark, count)
        begun = time.perf_counter()
        rows = pii._mentions(found).count()
        seconds[count] = time.perf_counter() - begun
        assert rows == 2 * count + count // 50
    assert seconds[64_000] < 8 * seconds[8_000] + 5


def test_contexts_of_long_words(spark):
    start(spark)
    word = "x" * 5000
    text = f"{word}A {word}B 12345 and \t {word}é  7.7.7.7"
    found = pii.base_spans(spark.createDataFrame([(1, text), (2, "12345"), (3, "one 12345")], "doc_id long, text string"))
    contexts = {r.doc_id: [t.context for t in r.token] for r in found.collect()}
    assert contexts == {1: [f"{word}a {word}b", f"and {word}é"], 2: [""], 3: ["one"]}


def test_turns_of_scores_against_plain_ones(spark):
    start(spark)
    pick = random.Random(3)
    edges = {}
    for _ in range(600):
        value = f"v{pick.randrange(120)}"
        kind = int(value[1:]) % 7
        kind = kind if kind < 4 else 4 if kind < 6 else 5
        edges[f"p{min(pick.randrange(30), pick.randrange(30))} {kind if pick.random() < 0.8 else ''}", value] = kind
    rows = [(p, v, k) for (p, v), k in edges.items()]
    found = pii._scored(spark.createDataFrame(rows, "pattern string, value string, kind int")).collect()
    assert {(r.pattern, r.kind): pytest.approx(r.confidence) for r in found} == scored(rows)
    assert any(r.confidence >= pii.SPEAKS for r in found)


def test_masked_with_columns_named_like_its_own(spark):
    start(spark)
    names = ["doc_id", "text", "key", "number", "spans", "_of", "_with", "at", "out"]
    docs = spark.createDataFrame([(1, "mail a@b.example now", *"klmnopq"), (1, None, *"klmnopq")], names)
    assert sorted((r.text or "", r["_of"], r["_with"]) for r in pii.masked(docs).collect()) == [("", "n", "o"), ("mail [EMAIL] now", "n", "o")]
