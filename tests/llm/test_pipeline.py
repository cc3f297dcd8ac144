"""The pipeline, stage by stage, against plain recounts of each stage's input."""

import numpy as np
import regex
from conftest_llm import make

import corpus_pipeline as P


def _run(spark, docs):
    tables = [docs]
    for _, stage in P.STAGES:
        tables.append(stage(spark, tables[-1], "").cache())
    return tables


def test_stages_on_odd_rows(spark, odd, odd_docs, brute_components):
    docs, spoken, single, stripped, mixed, tokens = _run(spark, odd_docs)
    assert all(t.columns == docs.columns for t in (spoken, single, stripped, mixed))
    texts = [r["text"] for r in spoken.collect()]
    assert all(regex.search(r"\p{L}", t) for t in texts) and len(texts) >= 12
    groups = brute_components([(i, r["text"]) for i, r in enumerate(spoken.collect())], 5, 80)
    assert single.count() == len({c for _, c in groups.values()})
    assert all(r["n_chars"] == len(r["text"]) for r in stripped.collect()) and stripped.count() == single.count()
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in stripped.collect()}
    rows = tokens.collect()
    assert len(rows) == mixed.count() and all(r["round_trip"] and len(r["token_ids"]) == 4 * r["n_tokens"] for r in rows)
    assert all((np.frombuffer(r["token_ids"], "<u4") < 50_256).all() for r in rows)


def test_stages_on_no_rows(spark):
    assert [t.count() for t in _run(spark, make(spark, []))] == [0] * 6


def test_passages_of_fifty_words_go(spark):
    passage = " ".join(f"word{k}" for k in range(51))
    assert len(passage) < 400
    docs = make(spark, [(1, "Ahead of it. " + passage, "en", "a"), (2, passage + " Behind it.", "en", "b"), (3, "Neither of them.", "en", "b"), (4, None, "en", None)])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.remove_repeats(spark, docs, "").collect()}
    assert got == {1: ("Ahead of it. ", 13), 2: (" Behind it.", 11), 3: ("Neither of them.", 16), 4: (None, None)}
