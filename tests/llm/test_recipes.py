"""Exact duplicates by recipes against grouping whole texts."""

import random
from collections import defaultdict
from hashlib import sha256

from conftest_llm import make
from pyspark.sql import functions as F

from curbline.llm import recipes as R


def _expected(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    out = []
    for doc, text in rows:
        known = [d for d in groups[text or ""] if d is not None]
        out.append((doc, max(known, default=None), len(groups[text or ""]), sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def _texts(odd):
    rng = random.Random(8)
    words = ["".join(rng.choice("abdlt éü漢") for _ in range(5)) for _ in range(300)]
    long = " ".join(rng.choices(words, k=20_000))
    rows = odd + [(200, long, "en", "a"), (201, long, "en", "a"), (202, long[:-1], "en", "a"), (203, "y" + long, "en", "a"), (204, "t" * 50_000, "en", "a"), (205, "t" * 50_001, "en", "a")]
    return rows + [(2**53 + 1, "big id", "en", "a"), (2**53 + 2, "big id", "en", "a"), (None, "big id", "en", "a")]


def test_groups_equal_brute_force(spark, odd):
    rows = _texts(odd)
    got = R.exact_duplicates(make(spark, rows)).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == _expected([r[:2] for r in rows])
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r[1] or "" for r in rows}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_shared_identifiers_are_found_and_made_longer(spark, odd):
    rows = _texts(odd)
    docs = make(spark, rows)
    assert R.verified_parts(docs, parts=1, bits=3) > 1
    got = R.exact_duplicates(docs, parts=1, bits=3).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == _expected([r[:2] for r in rows])


def test_chunks_give_the_text_back_and_follow_the_content(spark, odd):
    rows = _texts(odd)
    docs = make(spark, rows)
    back = sorted([(r["doc_id"], bytes(r["bytes"])) for r in R.restored(docs, 2).collect()], key=str)
    assert back == sorted([(r[0], (r[1] or "").encode()) for r in rows], key=str)
    cut = {r["doc_id"]: r["c"] for r in docs.where("doc_id in (200, 203, 204)").select("doc_id", R.chunks("text").alias("c")).collect()}
    assert all(len(c) <= R.MOST for cs in cut.values() for c in cs)
    assert len(set(cut[200]) & set(cut[203])) >= len(cut[200]) - 2  # one byte in front changes the first chunks only
    assert len(cut[204]) > 10


def test_invalid_bytes_empty_table_and_no_python(spark, no_docs):
    raw = spark.createDataFrame([(1, bytearray(b"\xff\xfe")), (2, bytearray(b"\xff\xfd")), (3, bytearray(b"\xff\xfe"))], "doc_id long, b binary").select("doc_id", F.expr("cast(b as string)").alias("text"))
    assert {r["doc_id"]: r["keep_id"] for r in R.exact_duplicates(raw).collect()} == {1: 3, 2: 2, 3: 3}
    assert R.exact_duplicates(no_docs).collect() == []
    plan = R.exact_duplicates(make(spark, [(1, "a", "en", "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
