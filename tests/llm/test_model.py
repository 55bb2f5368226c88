"""The additive model against plain scores, and its boosting steps against a search through all trees."""

import math

import numpy as np
import pytest

from civicpulse.llm import quality


def plain_score(model: quality.Model, row: np.ndarray) -> float:
    bins = [sum(value >= edge for edge in edges) for value, edges in zip(row, model.edges)]
    total = model.base + sum(table[b] for table, b in zip(model.singles, bins))
    total += sum(table[bins[a]][bins[b]] for (a, b), table in model.pairs)
    return 1 / (1 + math.exp(-total))


def worth(gain, weight, low, high) -> float:
    return sum(gain[low:high]) ** 2 / (sum(weight[low:high]) + 1)


def plain_tree(gain, weight, low, high, depth) -> list[float]:
    """The values of a tree grown by the best split at a time; a split leaves a weight of 5 on both sides."""
    splits = [
        (worth(gain, weight, low, at) + worth(gain, weight, at, high), -at)
        for at in range(low + 1, high)
        if sum(weight[low:at]) >= 5 and sum(weight[at:high]) >= 5
    ]
    if depth and splits and max(splits)[0] > worth(gain, weight, low, high) + 1e-9:
        at = -max(splits)[1]
        return plain_tree(gain, weight, low, at, depth - 1) + plain_tree(gain, weight, at, high, depth - 1)
    return [sum(gain[low:high]) / (sum(weight[low:high]) + 1)] * (high - low)


@pytest.mark.parametrize("seed", range(20))
def test_a_step_is_the_best_shallow_tree(seed):
    pick = np.random.default_rng(seed)
    bins = int(pick.integers(1, 20))
    gain, weight = pick.normal(size=bins) * 5, pick.random(bins) * pick.choice([0.5, 4, 30])
    assert quality._cuts(gain, weight) == pytest.approx(plain_tree(gain.tolist(), weight.tolist(), 0, bins, 2))


def examples(count: int, seed: int):
    pick = np.random.default_rng(seed)
    x = pick.normal(size=(count, len(quality.FEATURES)))
    chance = 1 / (1 + np.exp(-(2 * x[:, 0] - np.abs(x[:, 1]) + 2 * (x[:, 2] > 0) * (x[:, 3] > 0))))
    return x, (pick.random(count) < chance).astype(float)


def test_scores_are_sums_of_table_entries():
    x, y = examples(1500, 1)
    model = quality.Model.loads(quality.fit(x, y).dumps())
    assert len(model.pairs) == quality.PAIRS
    rows = np.vstack([examples(200, 2)[0], x[:20], np.full((1, x.shape[1]), 1e9), np.full((1, x.shape[1]), -1e9)])
    assert model.score(rows) == pytest.approx([plain_score(model, row) for row in rows])


def test_each_round_lowers_the_loss(monkeypatch):
    x, y = examples(1500, 3)
    losses = []
    for rounds in (1, 4, 16):
        monkeypatch.setattr(quality, "ROUNDS", rounds)
        monkeypatch.setattr(quality, "PAIR_ROUNDS", 0)
        p = quality.fit(x, y).score(x)
        losses.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    assert losses == sorted(losses, reverse=True) and losses[2] < 0.9 * losses[0]


def test_the_first_round_against_a_plain_one(monkeypatch):
    """One cycle over all features, worked out row by row."""
    monkeypatch.setattr(quality, "ROUNDS", 1)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 0)
    x, y = examples(300, 4)
    model = quality.fit(x, y)
    share = (y.sum() + 1) / (len(y) + 2)
    total = [math.log(share / (1 - share))] * len(y)
    for f, edges in enumerate(model.edges):
        bins = [sum(value >= edge for edge in edges) for value in x[:, f]]
        gain, weight = [0.0] * (len(edges) + 1), [0.0] * (len(edges) + 1)
        for b, t, label in zip(bins, total, y):
            p = 1 / (1 + math.exp(-t))
            gain[b] += label - p
            weight[b] += p * (1 - p)
        update = [quality.RATE * v for v in plain_tree(gain, weight, 0, len(gain), 2)]
        assert model.singles[f] == pytest.approx(update, abs=1e-8)
        total = [t + update[b] for t, b in zip(total, bins)]
