"""Ranked search against a plain recount of every document and item."""

import math
import random
import re
from collections import Counter

from conftest_llm import make

from curbline.llm import pipelined as P

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long, score double, shard string"


def _terms(text):
    return Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))


def brute(docs, items, k):
    counted = [(d, c) for d, c in ((d, _terms(t)) for d, t in docs) if c]
    n_docs, n_words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_words
            scores.append((-sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in _terms(text).items() if c[t]), d is None, d))
        best = [s for s in sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0)) if s[0] < 0][:k]
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(best, 1)]
    return sorted(out, key=str)


def _rows(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=str)


def _corpus():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    rows = [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 60))), "en", "a") for i in range(300)]
    rows += [(2**53 + 1 + i, rows[0][1], "en", "a") for i in range(40)]  # more equal scores than places
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12))), 1, 0.5, "s") for i in range(20)] + [(30, rows[0][1], 1, 0.5, "s")]
    return rows, items


def test_equals_brute_force_over_shards_blocks_and_owners(spark, odd):
    rows, items = _corpus()
    rows += odd
    items += [(50, None, None, None, None), (51, "", None, None, None), (52, "nowhere-seen", None, None, None), (None, "twice the same", None, None, None), (53, "123 é 漢字 ÉND", None, None, None), (53, "123 é 漢字 ÉND", None, None, None)]
    asked = spark.createDataFrame(items, ITEMS)
    docs = make(spark, rows).repartition(3)
    want = brute([r[:2] for r in rows], [i[:2] for i in items], 5)
    assert _rows(P.search(docs, asked, k=5, shard_size=16, together=4)) == want
    assert _rows(P.search(docs, asked, k=5, owners=1)) == want
    assert _rows(P.search(docs, asked, k=5, owners=6, shard_size=1000)) == want


def test_empty_tables(spark, no_docs):
    asked = spark.createDataFrame([(1, "word", 1, 0.5, "s")], ITEMS)
    assert P.search(no_docs, asked).collect() == []
    assert P.search(make(spark, [(1, "word", "en", "a")]), asked.limit(0)).collect() == []
    assert P.search(make(spark, [(1, None, "en", "a"), (2, "...", "en", "a")]), asked).collect() == []


def test_bundles_let_go_of_documents_that_cannot_win(spark):
    """A rare term decides; documents with common terms only leave their bundles at the first owner, and results stay."""
    rows = [(i, "common other " + ("rare " * 3 if i < 40 else "") + f"x{i}", "en", "a") for i in range(400)]
    asked = spark.createDataFrame([(1, "rare common", 1, 0.5, "s")], ITEMS)
    got = _rows(P.search(make(spark, rows), asked, k=5))
    assert got == brute([r[:2] for r in rows], [(1, "rare common")], 5)
