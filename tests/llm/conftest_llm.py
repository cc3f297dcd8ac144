"""Small tables and brute force shared by the tests of the corpus operators."""

import itertools
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, spans string, _h long"


def make(spark, rows):
    """A documents table with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 0.5, "k", "s", 7) for r in rows], SCHEMA)


def odd_rows():
    """Nulls everywhere, empty and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghéü") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = [" ".join(rng.choices(words, k=n)) for n in (3, 40, 150, 600, 30_000)]
    edited = prose[3].split()
    edited[100], edited[400] = "other", "words"
    passage = prose[2]
    return [
        (1, prose[0], "en", "a"), (2, prose[1], "en", "b"), (3, prose[2], "fr", "a"), (4, prose[3], "fr", "c"), (5, prose[4], "en", None), (6, " ".join(edited), "fr", "c"),
        (7, prose[3], None, "d"), (8, None, "en", "a"), (9, "", "en", "a"), (10, " \t\n", None, None), (None, "Null id, with text.", "en", "b"), (None, None, None, None),
        (11, "twice the same row", "en", "b"), (11, "twice the same row", "en", "b"), (12, "x" * 3000, "de", "b"), (13, "Before " + passage + " after", "fr", "a"), (14, "Ahead. " + passage + "\nÉnd", "fr", "b"),
        (15, "one", "en", "a"), (16, "ONE", "en", "a"), (17, "123 456 !!!", "en", "a"), (18, "🙂 漢字 \x1c x" * 50, "en", "a"),
    ]


def jaccard_components(rows, width, percent):
    """Brute force: (doc_id, text) -> {doc_id: (set size, component)} over all pairs."""
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            n = len(x & y)
            if 100 * n >= percent * (len(x) + len(y) - n):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(s), find(d)) for d, s in sets.items()}
