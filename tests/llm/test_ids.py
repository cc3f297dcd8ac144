"""Large doc_ids beside a null one keep all their digits in every operator and stage, and fingerprints tell their likeness."""

import random

import corpus_pipeline
import numpy as np
from conftest_llm import make

from curbline.llm import bpe, imatch, language, minhash, pipelined, quality, rans, recipes, repeats

BIG = 2**53 + 1
IDS = [BIG, None, -BIG, BIG + 2, 2**62 + 1]


def _rows():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    shared = " ".join(rng.choices(words, k=150))[:900]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(3)] + [shared + " tail one", "head two " + shared]
    return [(i, t, "en", "a") for i, t in zip([BIG + 4, None, -BIG, BIG, BIG + 2], texts)], shared


def test_ids_keep_their_digits(spark, tmp_path):
    rows, _ = _rows()
    docs, ids = make(spark, rows).coalesce(1), {r[0] for r in rows}
    stats = quality.with_statistics(docs)
    rans.write(docs, str(tmp_path / "ids"))
    found = {
        "op4": rans.digests(rans.read(spark, str(tmp_path / "ids"))), "op5": minhash.near_duplicates(docs, width=2), "op7": quality.scored(stats, quality.fit(stats, docs.selectExpr("doc_id", "1 AS label"))),
        "op8": bpe.digests(docs), "op9": language.identify(docs, *language.fit(docs)), "op10": repeats.digests(docs), "op12": recipes.exact_duplicates(docs), "op2": imatch.fingerprints(docs),
        "op11": pipelined.search(docs, docs.selectExpr("doc_id AS item_id", "text"), k=9),
    }
    for name, df in found.items():
        assert {r["doc_id"] for r in df.collect()} == ids, name
    assert {r["component_id"] for r in found["op5"].collect()} == ids - {BIG + 2} and {r["item_id"] for r in found["op11"].collect()} == ids
    for name, stage in corpus_pipeline.STAGES:
        assert {r["doc_id"] for r in stage(spark, docs, "").collect()} <= ids, name


def test_documents_with_large_ids_lose_what_they_share(spark):
    rows, shared = _rows()
    got = {r["doc_id"]: r["n_removed"] for r in repeats.digests(make(spark, rows).coalesce(1)).collect()}
    assert got[BIG] >= 900 and got[BIG + 2] >= 900 and got[None] == 0


def _likeness(a, b):
    """From two printed fingerprints alone."""
    (level_a, *lists_a), (level_b, *lists_b) = a.split(":"), b.split(":")
    thin = len(lists_a) == 1 or len(lists_b) == 1
    x, y = ((lists[-1] if thin else lists[0]).split("-") for lists in (lists_a, lists_b))
    n, step = imatch.SALTS, int(level_b) - int(level_a)
    if abs(step) > 1:
        return 0.0
    p, q = (x, y) if not step else (x[n:], y[:n]) if step > 0 else (x[:n], y[n:])
    told = [(i, j) for i, j in zip(p, q) if i or j]
    return sum(i == j for i, j in told) / len(told) if told else float(not step and x == y)


def test_likeness_is_that_of_the_printed_fingerprints(spark):
    rng = random.Random(12)
    words = [f"t{i}" for i in range(900)]
    copy = " ".join(rng.choices(words, k=80))
    rows = [(i, copy if i % 3 == 0 else " ".join(rng.choices(words, k=rng.randint(1, 90))), "en", "a") for i in range(120)] + [(200, "", "en", "a"), (201, None, "en", "a")]
    got = {r["doc_id"]: r for r in imatch.fingerprints(make(spark, rows)).collect()}
    order = sorted(got, reverse=True)
    for at, doc in enumerate(order):
        r, following = got[doc], got[order[(at + 1) % len(order)]]
        assert np.isclose(r["near_edited"], _likeness(r["fingerprint"], r["edited_fingerprint"])), doc
        assert np.isclose(r["near_next"], _likeness(r["fingerprint"], following["fingerprint"])), doc
    assert any(0 < r["near_edited"] < 1 for r in got.values())
