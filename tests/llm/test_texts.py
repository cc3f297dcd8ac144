"""Repeats, BPE and token files against plain recounts and the tokenizer libraries."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from curbline.llm import bpe, rans, repeats


def _covered(texts, length):
    """Brute force: bytes of each text that lie in a string of ``length`` bytes that also starts elsewhere."""
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        flags, end = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                flags[max(i, end) : i + length] = b"\1" * (i + length - max(i, end))
                end = i + length
        out.append(flags)
    return out


@pytest.mark.parametrize("group", [repeats.GROUP, 1])
def test_repeats_equal_brute_force(odd, odd_docs, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)  # 1: every comparison goes by counted strings
    texts = [(r[1] or "").encode() for r in odd]
    want = []
    for (doc, *_), body, flags in zip(odd, texts, _covered(texts, 400)):
        kept = bytes(x for x, f in zip(body, flags) if not f)
        spans = sum(1 for i, f in enumerate(flags) if f and not (i and flags[i - 1]))
        want.append((str(doc), len(body), sum(flags), spans, hashlib.sha256(kept).hexdigest()))
    got = [(str(r[0]), *r[1:]) for r in repeats.digests(odd_docs, length=400).collect()]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)


def test_stripped_texts_keep_whole_characters(spark, no_docs):
    passage = "é" * 300
    docs = spark.createDataFrame([(1, "x" + passage), (2, "è" + passage + "y"), (3, "none")], "doc_id long, text string")
    got = dict(repeats.strip(docs, length=400).collect())
    assert got == {1: "x", 2: "èy", 3: "none"}
    assert repeats.digests(no_docs).count() == 0 and repeats.strip(no_docs).columns == no_docs.columns


@pytest.mark.parametrize("length", [16, 60, 240])
def test_shorter_repeats_equal_brute_force(spark, length):
    rng = random.Random(length)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    shared = [" ".join(rng.choices(words, k=n)) for n in (length // 4, length // 2, 55)]
    texts = [f"{' '.join(rng.choices(words, k=30))} {rng.choice(shared)} {i} {rng.choice(shared)}" for i in range(40)] + ["x" * 700, ""]
    want = {i: bytes(x for x, f in zip(t.encode(), flags) if not f).decode() for i, (t, flags) in enumerate(zip(texts, _covered([t.encode() for t in texts], length)))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(repeats.strip(docs, length=length).collect()) == want and any(len(want[i]) < len(t) for i, t in enumerate(texts))


def test_too_short_repeats_are_refused(no_docs):
    with pytest.raises(ValueError):
        repeats.strip(no_docs, length=15)


def test_bpe_equals_library(odd, odd_docs, no_docs):
    with open(bpe.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc, text, *_ in odd:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want.append((str(doc), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(odd_docs).collect()) == sorted(want)
    back = bpe.decode(bpe.encode(odd_docs)).where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary"))
    assert back.count() == 0 and bpe.digests(no_docs).count() == 0


def test_token_files(spark, odd, odd_docs, no_docs, tmp_path):
    tokenizer = rans.chunk_ids(rans.VOCABULARY).tokenizer
    rows = sorted(((r[0] is not None, r[0] or 0, len(ids := tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in odd))
    rans.write(odd_docs, str(tmp_path / "a"))
    got = rans.digests(rans.read(spark, str(tmp_path / "a"))).orderBy("start").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == rows
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert [r["doc_id"] or 0 for r in got] == sorted(r["doc_id"] or 0 for r in got)
    rans.write(no_docs, str(tmp_path / "b"))
    assert rans.read(spark, str(tmp_path / "b")).count() == 0
    bad = spark.read.parquet(str(tmp_path / "a/blocks")).withColumn("crc32", F.col("crc32") + 1)
    bad.write.parquet(str(tmp_path / "c/blocks"))
    spark.read.parquet(str(tmp_path / "a/table")).write.parquet(str(tmp_path / "c/table"))
    with pytest.raises(Exception, match="checksum"):
        rans.read(spark, str(tmp_path / "c")).count()


def test_coder_round_trip_and_checkpoints():
    rng = np.random.default_rng(1)
    ids = np.unique(rng.integers(0, 50_000, 5_000))
    coder = rans.Coder(ids, rans.scaled(rng.integers(1, 1_000_000, len(ids)).astype(float)))
    assert coder.freq.sum() == 1 << 20
    blocks = [rng.choice(ids, n) for n in (1, 31, 32, 33, 8192, 8193, 32_768, 20_000)]
    coded = coder.encode(blocks)
    back = coder.decode([(len(b), w, s, np.array(p)) for b, (w, s, p) in zip(blocks, coded)])
    assert all((a == b).all() for a, b in zip(blocks, back))
    words, states, places = coded[6]  # the last quarter alone, from its checkpoint
    tail = coder.decode([(8_192, words[4 * places[3] :], states[3 * 8 * rans.LANES :], np.array([0]))])[0]
    assert (tail == blocks[6][3 * 8_192 :]).all()
    assert rans.scaled(np.array([3.0])).tolist() == [1 << 20]


def test_long_pieces_without_a_break(spark):
    """The heap gives the ids of the matrices, and a megabyte takes seconds, not hours."""
    coder = bpe.Encoder(bpe.VOCABULARY, public_tokenizers.PATTERN)
    rng = np.random.default_rng(1)
    for piece in (b"a" * 3000, bytes(rng.integers(97, 102, 3000).astype(np.uint8)), ("漢字é" * 300).encode()):
        assert coder._merge_long(piece).tolist() == coder.encode_pieces([piece])[0].tolist()
    text = "x" * 500_000 + "".join(map(chr, rng.integers(97, 123, 600_000)))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode_and_back(docs).collect()}
    assert all(r["round_trip"] for r in got.values()) and 0 < got[1]["n_tokens"] < len(text) and got[2]["n_tokens"] == 0
