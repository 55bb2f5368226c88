"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def holds(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def personal_data(text: str | None) -> list[tuple[str, int, int]]:
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def without_repeats(texts: list[str | None], size: int = 35) -> list[tuple[int, int, str]]:
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text: str | None) -> frozenset:
    w = (text or "").encode().split()
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def linked(texts: list[str | None]) -> tuple[list[int], list[int]]:
    """Links and class (its smallest index) of each text, every pair that shares a shingle compared."""
    sets, having = [shingle_set(t) for t in texts], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            having[x].append(i)
    shared = Counter(pair for owners in having.values() for pair in combinations(owners, 2))
    links, root = [0] * len(texts), list(range(len(texts)))
    for (i, j), n in shared.items():
        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            links[i] += 1
            links[j] += 1
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return links, root


def folded(text: str | None) -> list[str]:
    return re.sub(r"[!-/:-@\[-`{-~]", " ", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")).split()


def overlaps(text: str | None, item: str) -> bool:
    """Whether some alignment has a stretch long and equal enough, all alignments and stretches tried."""
    d, q = folded(text), folded(item)
    least = min(13, len(q))
    for shift in range(-len(q) + 1, len(d)):
        equal = [d[shift + i] == q[i] for i in range(len(q)) if 0 <= shift + i < len(d)]
        sums = [0]
        for e in equal:
            sums.append(sums[-1] + e)
        for a in range(len(equal) - least + 1):
            if any(5 * (sums[b] - sums[a]) >= 4 * (b - a) for b in range(a + least, len(equal) + 1)):
                return True
    return False


def scored(edges: list[tuple[str, str, int]], kinds: int = 4, rounds: int = 3) -> dict:
    """Confidence by (pattern, kind) after turns of votes, from (pattern, value, kind) with open kinds from ``kinds``."""
    sizes = Counter(p for p, _, _ in edges)
    votes = [(p, v, k, 1.0) for p, v, k in edges if k < kinds]
    unknown = [(p, v, k) for p, v, k in edges if k >= kinds]
    for turn in range(rounds):
        weight, count = defaultdict(float), Counter()
        for p, _, k, score in votes:
            weight[p, k] += score
            count[p, k] += 1
        sure = {pk: weight[pk] / (sizes[pk[0]] + 1) for pk in weight if count[pk] >= 3}
        if turn == rounds - 1:
            return sure
        wrong = {}
        for p, v, k in unknown:
            for (q, kind), share in sure.items():
                if q == p and share >= 0.5 and (k == kinds or kind == 0):
                    wrong[v, kind] = wrong.get((v, kind), 1.0) * (1 - share)
        votes = [(p, v, k, 1.0) for p, v, k in edges if k < kinds]
        votes += [(p, v, kind, 1 - w) for p, v, _ in unknown for (u, kind), w in wrong.items() if u == v]
