"""Plain forms of the agreed columns, and small tables with odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Rows that every operator must bear: null, empty, blank, one word, repeated rows, wide characters, a long text, ties.
ODD_TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "one",
    "é 東京 \U0001f600 ok",
    "word " * 30_000,
    "same text here for all of you and me",
    "same text here for all of you and me",
    "a\x00b\x1cc",
]


def odd_rows(spark, extra: str = "lang string, source string, n_chars long"):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id at all in this row", None, None, 3), (3, "one", "en", "s1", None)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text: str | None, k: int = 5) -> frozenset:
    words = BLANK_WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(zip(*[words[i:] for i in range(k)])) if len(words) >= k else frozenset([tuple(words)])


def jaccard_components(rows: list[tuple], least: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id → (set size, smallest id reachable), by comparing every document with all that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for a, (_, own) in enumerate(sets):
        for b, both in Counter(b for g in own for b in having[g]).items():
            if 100 * both >= least * (len(own) + len(sets[b][1]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        for g in own:
            having[g].append(a)
    best: dict[int, int] = {}
    for a, (i, _) in enumerate(sets):
        best[find(a)] = min(best.get(find(a), i), i)
    return {i: (len(own), best[find(a)]) for a, (i, own) in enumerate(sets)}
