"""Near duplicates against brute force over all pairs."""

import random

import numpy as np
from conftest_llm import make

from curbline.llm import minhash as M
from curbline.llm.shingles import shingle_set


def _families():
    """A base with copies edited more and more, so that some are linked to each other but not to the base, and strangers."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows, doc = [], 100
    for length in (12, 60, 200):
        base = rng.choices(words, k=length)
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 8, 10, 12, 14):
            copy = list(base)
            for _ in range(edits * length // 100 + (edits > 4)):
                copy[rng.randrange(length)] = rng.choice(words)
            if edits == 8:
                base = copy  # later copies descend from this one
            rows.append((doc, " ".join(copy), "en", "a"))
            doc += rng.randint(1, 5)
    rows += [(doc + i, " ".join(rng.choices(words, k=50)), "en", "b") for i in range(30)]
    return rows


def test_components_equal_brute_force(spark, odd, brute_components):
    rows = [r for r in odd if r[0] is not None] + _families()
    got = M.near_duplicates(make(spark, rows), width=2, percent=80).collect()
    want = brute_components([r[:2] for r in rows], 2, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len(got) == len(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_short_members_of_a_large_family_find_each_other(spark, brute_components):
    """Short texts that only the hub's long variants share buckets with are linked among themselves, and across sizes."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]

    def edited(words, places):
        return [f"x{rng.random()}" if i in places else w for i, w in enumerate(words)]

    texts = [edited(base, set(rng.sample(range(60, 100), 7))) for _ in range(400)]  # the variants, all linked with the base
    texts += [edited(base[:75], {k, k + 1}) for k in (3, 11, 19)]  # linked with each other, too short for the variants
    texts += [base[:58] + ["y1"], base[:58] + ["y2", "y3"]]  # shorter still
    rows = [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)]
    want = brute_components([r[:2] for r in rows], 1, 80)
    assert len({want[i][1] for i in range(400)}) == 1 and want[402][1] == 400
    got = M.near_duplicates(make(spark, rows), width=1, percent=80, bands=8, rows=3).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_one_of_each_group_stays(spark, odd, odd_docs):
    kept = M.one_per_group(odd_docs, width=5, percent=80)
    assert kept.columns == odd_docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    gone = {6, 7, 13, 14, 16}  # edited and exact copies, and the same word in other case
    want = {(r[0] is None, r[0] or 0, r[1] or "") for r in odd if r[0] not in gone}
    assert ids == sorted(want)


def test_empty(spark, no_docs):
    assert M.near_duplicates(no_docs).count() == 0 and M.one_per_group(no_docs).count() == 0


def test_densified_bins_agree_like_the_sets():
    rng = np.random.default_rng(5)
    np.seterr(over="ignore")
    for size in (1, 5, 80, 5000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.r_[a[: max(1, size * 9 // 10)], rng.integers(0, 2**63, size // 10, dtype=np.uint64)])
        same = (M.densified(a, 350) == M.densified(b, 350)).mean()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(same - true) < 0.25 if size < 50 else abs(same - true) < 0.1
    assert len(shingle_set("", 2)) == 0 and len(shingle_set("A", 2)) == 1 and (shingle_set("A b A b", 2) == shingle_set("a B a\tb", 2)).all()
