"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are split by the tokenizer's pattern; every distinct piece is encoded once per worker. The pieces of a batch that
are not known yet are put into matrices by length (powers of two), one row per piece, one cell per token, padded on the
right. In each round every row merges its leftmost pair of least rank: pairs are looked up in a sorted table of hashed
pairs, the cells behind the merge move one place left, and rows without a pair leave the matrix.

The pair table is built from the rank file: a token is reached by every split into two tokens, as pairs are ranked by
their joined bytes. It has one entry per split, so its size is fixed by the vocabulary.

Defined results: a null text counts as empty; an empty text has no ids; lone surrogates cannot occur in Spark strings;
repeated rows are encoded like any others; an empty table gives an empty result. A piece of more than ``_LONG`` bytes
without any break gets its merges from a heap over linked cells, with the same ids, in n log n time and O(n) memory.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.llm.common import id_number, id_text, python_batches, tidy

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
_CELLS = 400_000  # cells of one matrix
_KEPT_PIECES = 100_000  # distinct pieces that one worker keeps before it starts anew
_PART_CHARS = 250_000  # characters split into pieces at a time
_LONG = 4096  # bytes of a piece that is merged by itself
_NO_RANK = np.int64(1 << 40)


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.bits = max(4, (2 * len(rank)).bit_length() + 1)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.slots_key, self.slots_rank = self._hash_table(keys, np.array(rank, np.int64))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, np.ndarray] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hash_table(self, keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing; the longest probe is remembered and bounds every lookup."""
        size = 1 << self.bits
        slot_key, slot_rank = np.full(size, -1, np.int64), np.full(size, _NO_RANK, np.int64)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            want = at[left]
            free = slot_key[want] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(want, return_index=True)[1]] = True
            put = free & first
            slot_key[want[put]], slot_rank[want[put]] = keys[left[put]], ranks[left[put]]
            left = left[~put]
            at[left] = (at[left] + 1) & (size - 1)
        return slot_key, slot_rank

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; _NO_RANK where it is no token or the right cell is padding."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        keys[b < 0] = -2
        shape, keys = keys.shape, keys.ravel()
        slot = self._slot(keys)
        out = np.full(len(keys), _NO_RANK, np.int64)
        open_cells = np.flatnonzero(keys >= 0)
        for _ in range(self.probes):
            if not len(open_cells):
                break
            seen = self.slots_key[slot[open_cells]]
            hit = seen == keys[open_cells]
            out[open_cells[hit]] = self.slots_rank[slot[open_cells[hit]]]
            open_cells = open_cells[~hit & (seen >= 0)]
            slot[open_cells] = (slot[open_cells] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each (non-empty) piece."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        bucket = np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
        for i in np.flatnonzero(sizes > _LONG):
            out[i] = self._merge_long(pieces[i])
        for b in np.unique(bucket[sizes <= _LONG]):
            rows = np.flatnonzero((bucket == b) & (sizes <= _LONG))
            step = max(1, _CELLS >> int(b))
            for at in range(0, len(rows), step):
                self._merge([pieces[i] for i in rows[at : at + step]], rows[at : at + step], sizes[rows[at : at + step]], out)
        return out

    def _merge(self, pieces: list[bytes], index: np.ndarray, sizes: np.ndarray, out: list[np.ndarray]) -> None:
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        cells = np.full((len(pieces), width), -1, np.int32)
        cells[inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        length, index = sizes.copy(), index.copy()
        ranks = np.full((len(pieces), width), _NO_RANK, np.int64)
        ranks[:, :-1] = self._rank(cells[:, :-1], cells[:, 1:])
        while True:
            best = ranks.argmin(axis=1)  # the leftmost of equal minima
            least = ranks[np.arange(len(ranks)), best]
            done = least == _NO_RANK
            if done.any():
                for i, row, n in zip(index[done], cells[done], length[done]):
                    out[i] = row[:n].copy()
                cells, ranks, length, index, best, least = cells[~done], ranks[~done], length[~done], index[~done], best[~done], least[~done]
            if not len(cells):
                return
            width = int(length.max())
            rows, column = np.arange(len(cells)), np.arange(width - 1)
            source = column + (column > best[:, None])  # compaction: cells behind the merge move one place left
            cells[rows, best] = least.astype(np.int32)
            cells = np.take_along_axis(cells[:, :width], source, axis=1)
            ranks = np.take_along_axis(ranks[:, :width], source, axis=1)
            length -= 1
            before, after = np.maximum(best - 1, 0), np.minimum(best + 1, width - 2)
            new_left = self._rank(cells[rows, before], cells[rows, best])
            new_right = self._rank(cells[rows, best], cells[rows, after])
            has_right = best + 1 < length
            ranks[rows, best] = np.where(has_right, new_right, _NO_RANK)
            has_left = best > 0
            ranks[rows[has_left], before[has_left]] = new_left[has_left]

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges by a heap of pairs over linked cells: n log n for a piece without a break."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        after[-1] = -1

        def rank(i: int) -> int | None:
            j = after[i]
            return None if j < 0 else self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[j]])

        heap = [(r, i) for i in range(len(ids)) if (r := rank(i)) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)  # the leftmost of least rank
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (new := rank(k)) is not None:
                    heappush(heap, (new, k))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        part: list[str | None] = []
        held = 0
        for text in texts:
            part.append(text)
            held += len(text or "")
            if held > _PART_CHARS:
                out += self._encode(part)
                part, held = [], 0
        return out + self._encode(part)

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > _KEPT_PIECES:
            self.known.clear()
        known = self.known
        new = list({p for pieces in split for p in pieces if p not in known})
        for piece, ids in zip(new, self.encode_pieces([p.encode() for p in new])):
            known[piece] = ids.astype("<u4")
        none = np.empty(0, "<u4")
        return [np.concatenate([known[p] for p in pieces]) if pieces else none for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, *, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``docs`` plus ``token_ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``. Clashing names are replaced."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([ids.tobytes() for ids in encoder(vocabulary).encode(batch.tolist())])

    python_batches(docs.sparkSession)
    ids = F.pandas_udf(tidy(run), "binary")
    return docs.withColumn("token_ids", ids(text)).withColumn("n_tokens", F.floor(F.length("token_ids") / 4))


def encode_and_back(docs: DataFrame, *, vocabulary: str = VOCABULARY, text: str = "text", same: str = "round_trip") -> DataFrame:
    """``encode``, and whether decoding the ids gives the text back, by one pass through Python."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            coder, texts = encoder(vocabulary), batch.tolist()
            found = coder.encode(texts)
            yield pd.DataFrame({"ids": [i.tobytes() for i in found], "same": [coder.decode(i) == (t or "").encode() for i, t in zip(found, texts)]})

    python_batches(docs.sparkSession)
    done = docs.withColumn("_done", F.pandas_udf(tidy(run), "ids binary, same boolean")(text))
    done = done.withColumns({"token_ids": F.col("_done.ids"), same: F.col("_done.same")}).drop("_done")
    return done.withColumn("n_tokens", F.floor(F.length("token_ids") / 4))


def decode(docs: DataFrame, *, vocabulary: str = VOCABULARY, out: str = "decoded") -> DataFrame:
    """``docs`` plus the bytes that its ``token_ids`` stand for."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([encoder(vocabulary).decode(np.frombuffer(b, "<u4")) for b in batch])

    python_batches(docs.sparkSession)
    return docs.withColumn(out, F.pandas_udf(tidy(run), "binary")("token_ids"))


def digests(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of ``docs``: ids and decoded bytes stay inside the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            coder = encoder(vocabulary)
            found = coder.encode(batch["text"].tolist())
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_tokens": [len(i) for i in found], "ids_sha256": [sha256(i.tobytes()).hexdigest() for i in found],
                "decoded_sha256": [sha256(coder.decode(i)).hexdigest() for i in found],
            })

    python_batches(docs.sparkSession)
    found = docs.select(id_text(), "text").mapInPandas(tidy(run), "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumn("doc_id", id_number())
