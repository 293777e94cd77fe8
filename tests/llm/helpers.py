"""Brute-force versions of the text operators, and small awkward tables."""

from __future__ import annotations

import itertools
import re
from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, node string, bucket string, label string, row string"
LONG = " ".join(f"w{i % 97}x{i % 31}" for i in range(30_000))
SENTENCE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree in silence"


def awkward_rows():
    texts = [
        (1, SENTENCE),
        (2, SENTENCE.upper()),
        (3, SENTENCE + " tonight"),
        (4, None),
        (5, ""),
        (6, "   \t "),
        (7, "one"),
        (8, "ONE"),
        (9, "Ünïcödé ÄÖÜ ſtraße 漢字 🙂"),
        (10, LONG),
        (11, LONG + " tail"),
        (None, SENTENCE),
        (None, None),
        (12, "repeated row here"),
        (12, "repeated row here"),
        (13, "same id one"),
        (13, "same id two"),
        (14, "a b　c  \x1c d\x0be\n\n f "),
    ]
    return [
        (i, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), "k", "s", "n", "b", "l", "r")
        for k, (i, t) in enumerate(texts)
    ]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, n):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return set()
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def near_components(rows, n, percent=80):
    """(doc_id, n_shingles, component_id) per row, by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(i)
    common = defaultdict(int)
    for members in by_shingle.values():
        for a, b in itertools.combinations(members, 2):
            common[a, b] += 1
    for (a, b), k in common.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            parent[root(a)] = root(b)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = root(i)
            smallest[r] = min(smallest.get(r, doc_id), doc_id)
    return [(d, len(sets[i]), smallest.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
