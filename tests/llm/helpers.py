"""Brute-force versions of the corpus operators, in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def line_dedup(docs, min_chars=40, min_docs=5):
    held = defaultdict(list)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(AZ)
    for doc_id, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k].append(doc_id)
    out = {}
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)]) != doc_id)]
        out[doc_id] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def shingles(text, k):
    w = words((text or "").translate(AZ))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_components(docs, k, percent):
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        r = find(i)
        least[r] = min(least.get(r, doc_id), doc_id)
    return {doc_id: least[find(i)] for i, (doc_id, _) in enumerate(docs)}, {d: len(s) for (d, _), s in zip(docs, sets, strict=True)}


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(before[j - 1] + (p != t), before[j] + 1, row[j - 1] + 1)
    return min(row)


def repeated_runs(docs, n=50):
    """doc_id -> whether a run of n words also stands in another document."""
    held = defaultdict(set)
    for doc_id, text in docs:
        w = words((text or "").translate(AZ))
        for i in range(len(w) - n + 1):
            held[tuple(w[i : i + n])].add(doc_id)
    return {d for ids in held.values() if len(ids) > 1 for d in ids}


def quality_base(text):
    text = text or ""
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)
