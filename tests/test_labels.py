from pyspark.sql import functions as F

from civicpulse.functions.labels import first_non_empty, geography_label, tooltip
from civicpulse.functions.text import strip_space, truncate


def test_tooltip_prints_plain_numbers_and_blanks(rows):
    df = rows.make("n string, c string, v double", ("England", "E9", 7.25), ("Wales", None, None),
                   (None, "S9", 123456789.0), ("x", "y", 7.35))
    assert [r[0] for r in df.select(tooltip(F.col("n"), F.col("c"), F.col("v"))).collect()] == [
        "England (E9) — 7.2", "Wales () — ", " (S9) — 123456789.0", "x (y) — 7.3"
    ]


def test_first_non_empty(rows):
    df = rows.make("a string, b string", ("", "b"), ("a", "b"), (None, ""), (None, None))
    assert [r[0] for r in df.select(first_non_empty(F.col("a"), F.col("b"))).collect()] == ["b", "a", None, None]


def test_geography_label(rows):
    df = rows.make("g string", ("GB",), ("FR",), (None,))
    assert [r[0] for r in df.select(geography_label(F.col("g"))).collect()] == ["United Kingdom", "FR", None]


def test_strip_space_takes_what_python_strips(rows):
    texts = ["\u00a0\u2003 a b\x1f\n\n", "\n \t", "a", "", "\u3000é\x85"]
    df = rows.make("t string", *[(t,) for t in texts])
    assert [r[0] for r in df.select(strip_space(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_truncate_counts_characters(rows):
    assert rows.make("t string", ("😀é" * 10,)).select(truncate(F.col("t"), 3)).first()[0] == "😀é😀"
