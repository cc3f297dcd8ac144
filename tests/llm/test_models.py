"""Language, quality, fingerprints, mixing and search: held-out accuracy, recall, brute force and odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
import regex
import xxhash
from conftest_llm import make
from pyspark.sql import functions as F

from curbline.llm import collisions, imatch, language, mixing, quality, queries

FOLDER = "/root/testdata/sf0.001"


def test_language_held_out_accuracy(spark, odd, odd_docs, no_docs):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = [r for r in queries.op9_mixture_language(spark, FOLDER).collect() if r["held_out"]]
    assert len(got) > 20 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) > 0.95
    languages, model = language.fit(odd_docs)
    assert languages == ["de", "en", "fr"]
    rows = language.identify(odd_docs, languages, model).collect()
    assert all((r["lang_pred"] == "und") == (not regex.search(r"\p{L}", r["text"] or "")) and 0 <= r["score"] <= 1 for r in rows) and len(rows) == len(odd)
    none, empty = language.fit(no_docs)
    assert none == [] and all(r["lang_pred"] == "und" for r in language.identify(odd_docs, none, empty).collect())
    assert language.identify(no_docs, languages, model).count() == 0


def test_a_mixture_has_both_languages():
    texts = {"a": "aba cab bac " * 200, "b": "xyz zyx yxz " * 200}
    table = np.stack([np.bincount(language.grams(t), minlength=language.BUCKETS) + 0.5 for t in texts.values()])
    table = (table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    best, share = language.mixtures([texts["a"], texts["b"], "aba cab bac " * 70 + "xyz zyx yxz " * 30, None, "1 2"], table)
    assert best.tolist() == [0, 1, 0, -1, -1] and share[0] > 0.99 and 0.6 < share[2] < 0.8


def test_a_mixture_may_have_four_languages():
    """Without the fourth, its text counts for the second, which it resembles, and that would win."""
    words = ["aba cab bac ", "xyz zyx yxz ", "klo olk kol ", "xyz mnu unm num "]
    table = np.stack([np.bincount(language.grams(t * 500), minlength=language.BUCKETS) + 0.5 for t in words])
    table = (table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    best, share = language.mixtures([words[0] * 180 + words[1] * 165 + words[2] * 175 + words[3] * 105], table)
    assert best.tolist() == [0] and abs(share[0] - 0.273) < 0.01


def test_quality_held_out_accuracy(spark, odd_docs, no_docs):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in queries.op7_quadratic_quality(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(got) > 50 and sum(r["predicted"] == labels[r["doc_id"]] for r in got) / len(got) > 0.95
    labels = spark.createDataFrame([(1, 1), (2, 1), (12, 0), (17, 0), (3, None), (99, 1)], "doc_id long, label int")
    stats = quality.with_statistics(odd_docs)
    rows = quality.scored(stats, quality.fit(stats, labels)).collect()
    assert len(rows) == 21 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert quality.fit(stats, labels.where("label = 1")).share == 1.0 and quality.fit(stats, labels.limit(0)).share == 0.5
    assert quality.scored(quality.with_statistics(no_docs), quality.fit(stats, labels)).count() == 0


def _like(a, b):
    if abs(a[0] - b[0]) > 1:
        return 0.0
    common = [(a[1][x], b[1][x]) for x in a[1].keys() & b[1].keys()]
    told = [x == y for x, y in common if x or y]
    return sum(told) / len(told) if told else float(a == b)


def rehash(x, seed=42):
    """xxhash64 of one 64-bit integer, as Spark computes it (the eight bytes of the number)."""
    return xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)


def test_fingerprints_equal_brute_force(spark, odd, odd_docs, no_docs):
    low, high = 0.0, 0.3
    rows = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in odd}, reverse=True)
    got = imatch.fingerprints(odd_docs, low=low, high=high).collect()
    assert len(got) == len(rows)
    split = regex.compile(r"[^\p{L}\p{N}]+").split

    def signed(t):
        return {h - (1 << 64) if h >> 63 else h for h in (xxhash.xxh64_intdigest(w.encode(), 42) for w in split(t.lower()) if w)}

    def salted(term, k):
        """The k-th hash: two 64-bit hashes of the word, turned by multiples of 8 bits."""
        whole = term & (2**64 - 1)
        if k % 2:
            whole = rehash(whole)
        return ((whole >> (k // 2 * 8)) | (whole << (64 - k // 2 * 8))) & (2**64 - 1)

    terms = [signed(r[1] or "") for r in odd]
    lexicon = {t for s in terms for t in s if low * len(odd) <= sum(t in s for s in terms) <= high * len(odd)}

    def components(t):
        all_terms = signed(t)
        level = max(0, len(all_terms).bit_length() - 1)
        subset = {(k, lv): tuple(sorted(x for x in all_terms & lexicon if not salted(x, k) & ((1 << lv) - 1))) for lv in (level, level + 1) for k in range(imatch.SALTS)}
        if all_terms and not any(subset.values()):
            subset = dict.fromkeys(subset, (min(all_terms),))
        return level, subset

    found = {r["doc_id"]: r for r in got}
    # the two rows without an id are ordered by hash of the text, so only those with a fixed next row are compared
    for i, (_, doc, text) in enumerate(rows[:-3]):
        k = len(text) // 3
        edited = text[: len(text) - k] + rows[i + 1][2][:k]
        r = found[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, other = components(text), components(edited)
        assert abs(r["near_edited"] - _like(own, other)) < 1e-12 and abs(r["near_next"] - _like(own, components(rows[i + 1][2]))) < 1e-12
        assert r["fingerprint"].startswith(f"{own[0]}:") and [bool(x) for x in r["fingerprint"].split(":")[1].split("-")] == [bool(x) for x in own[1].values()]
    assert found[4]["fingerprint"] == found[7]["fingerprint"] and found[8]["fingerprint"] == found[9]["fingerprint"]
    assert imatch.fingerprints(no_docs).count() == 0
    alone = imatch.fingerprints(make(spark, [(1, "abcdef", "en", "a")]), low=0.0, high=1.0).collect()[0]
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_fingerprints_of_copies_that_hold_a_third_of_the_rows(spark):
    """All terms of the copies are beyond the band; they stay as like their edited texts as other documents do."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(6000)]
    copy = rng.sample(words, 50)
    half = copy[:25] + rng.sample(words, 25)  # another group of copies that shares half of its words
    texts = [(copy, half, None, copy, None, None)[i % 6] or rng.sample(words, 50) for i in range(120)]
    found = {r["doc_id"]: r for r in imatch.fingerprints(make(spark, [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)])).collect()}
    mean = {kind: np.mean([r["near_edited"] for i, r in found.items() if i % 6 in kind]) for kind in ((0, 3), (1,), (2, 4, 5))}
    assert all(0.2 < m < 0.9 for m in mean.values()) and max(mean.values()) - min(mean.values()) < 0.2
    assert len({found[i]["fingerprint"] for i in found if i % 3 == 0}) == 1
    assert all(0.1 < r["near_next"] < 0.8 for i, r in found.items() if i % 6 == 1)  # followed by the other copies
    assert all(r["near_next"] < 0.1 for i, r in found.items() if i % 6 == 3)


def test_mix_follows_targets(spark, odd, odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == len(odd)
    sizes = {}
    for _, text, _, source in odd:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, share, target = dict(weight), 1.5 * sum(sizes.values()), {}
    while True:  # share out by weight, stop sources at twice their size, share the excess again
        level = share / sum(left.values())
        full = [s for s in left if left[s] * level >= 2 * sizes[s]]
        if not full:
            target.update({s: w * level for s, w in left.items()})
            break
        for s in full:
            target[s] = 2 * sizes[s]
            share -= target[s]
            del left[s]
    assert all(r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    for s in sizes:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= max(r["size"] for r in got if r["source"] == s)
    again = mixing.mix(odd_docs.repartition(5)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, again)) == sorted(map(key, got))
    emitted = mixing.emit(odd_docs, mixing.mix(odd_docs))
    assert emitted.columns == odd_docs.columns and emitted.count() == sum(r["copies"] for r in got)
    assert mixing.mix(no_docs).count() == 0


def test_search_recall_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(collisions, "BLOCK", 70)  # several blocks and groups
    monkeypatch.setattr(collisions, "QUERIES", 3)
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in table.collect())[:300]
    odd = [(100_000, None), (100_050, [0.0] * 64), (100_100, [float("nan")] * 64), (100_150, [1.0, None] * 32), (100_200, [1.0] * 3), (None, [1.0] * 64), (100_250, rows[0][1]), (100_251, rows[0][1]), (100_300, [2 * x for x in rows[0][1]])]
    frame = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows + odd], "vec_id long, embedding array<float>, label string, score double")
    got = {}
    for r in sorted(collisions.search(frame).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    held = [(i, np.array(v, float)) for i, v in rows + odd[6:]]
    hits = 0
    for q, v in held:
        if q % 50:
            continue
        best = sorted((-float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), i) for i, w in held if i != q)[:5]
        assert len(got[q]) == 5 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        hits += len({i for _, i in best} & {i for i, _ in got[q]})
    assert set(got) == {i for i, _ in held if i % 50 == 0} and hits / (5 * len(got)) >= 0.9
    assert [i for i, _ in got[0][:3]] == [100_250, 100_251, 100_300]
    assert collisions.search(frame.limit(0)).count() == 0 and collisions.search(frame.where(F.col("vec_id") == 0)).count() == 0
