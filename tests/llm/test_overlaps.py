"""Overlaps with benchmark items against every stretch of every alignment, by the definition."""

from itertools import combinations

import numpy as np
import pytest

from civicpulse.llm import decontamination
from civicpulse.llm.common import start


def counts(equal) -> bool:
    """Whether a stretch of at least 13 places, or all of fewer, has four fifths equal."""
    n = len(equal)
    return any(5 * sum(equal[a:b]) >= 4 * (b - a) for a in range(n) for b in range(a + min(13, n), n + 1))


def replaced(n: int, *places: int) -> list[str]:
    return [f"other{i}" if i in places else f"w{i}" for i in range(n)]


def test_best_overlap_is_found_wherever_a_stretch_counts():
    chance = np.random.default_rng(7)
    seen = set()
    for n in [12, 13, 14, 16, 25, 51] * 60:
        item = np.arange(n)
        document = np.where(chance.random(n) < chance.choice([0.6, 0.75, 0.85]), item, -1)
        found = decontamination.best_overlap(document, item, 0)
        assert (found is not None) == counts((document == item).tolist())
        seen.add(found is None)
        if found:
            begin, words, equal = found
            assert equal == (document == item)[begin : begin + words].sum()
            assert words >= min(13, n) and 5 * equal >= 4 * words
    assert seen == {True, False}


@pytest.fixture(scope="module")
def pairs(spark):
    start(spark)

    def of(texts, items):
        table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
        benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
        return {(r.doc_id, r.item_id) for r in decontamination.overlaps(table, benchmark).collect()}

    return of


def test_replaced_words_near_the_ends_are_part_of_an_overlap():
    for n, place in [(13, 0), (13, 1), (14, 2)]:
        document, item = np.arange(n), np.arange(n)
        document[place] = -1
        assert decontamination.best_overlap(document, item, 0) is not None


def test_runs_between_replaced_words(pairs):
    texts = [replaced(51, *range(13, 19), *range(32, 38)), replaced(67, *range(20, 29), *range(49, 58))]
    items = [(0, replaced(51)), (1, [f"w{i}" for i in range(67)])]
    assert pairs(texts, items) >= {(0, 0), (1, 1)}


@pytest.mark.parametrize("n, substituted", [(12, 2), (13, 2), (14, 2), (15, 3), (16, 3), (18, 3), (20, 4), (25, 5)])
def test_a_mask_fits_beside_any_substitutions(n, substituted):
    gone = np.array([sum(1 << i for i in c) for c in combinations(range(n), substituted)])
    hit = np.zeros(len(gone), bool)
    for mask in decontamination.MASKS:
        bits = sum(1 << i for i, c in enumerate(mask) if c == "1")
        for at in range(n - len(mask) + 1):
            hit |= gone & (bits << at) == 0
    assert hit.all()


def test_every_pattern_within_the_share_is_found(pairs):
    chance = np.random.default_rng(11)
    texts = [replaced(n, *c) for n in (12, 13) for c in combinations(range(n), 2)]
    texts += [replaced(n, *chance.choice(n, s, replace=False)) for n, s in [(15, 3), (16, 3), (20, 4), (25, 5)] for _ in range(40)]
    items = [(n, replaced(n)) for n in (12, 13, 15, 16, 20, 25)]
    found = pairs(texts, items)
    assert found >= {(i, len(t)) for i, t in enumerate(texts)}
    assert all(counts([a == b for a, b in zip(texts[i], replaced(n))]) for i, n in found)


def test_every_text_of_an_item_is_searched(pairs):
    first, second = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    assert pairs([first, second], [(1, first), (1, second), (1, second)]) == {(0, 1), (1, 1)}
