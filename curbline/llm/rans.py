"""Token ids in files, coded with a static range asymmetric numeral system (rANS).

A folder written by ``write`` holds Parquet tables, so that any store Spark reaches will do:

* ``table``: id, freq. One shared frequency table, from counts over all ids, scaled to a sum of 2 ** 20.
* ``blocks``: one row per block of at most ``BLOCK`` consecutive ids, independent of all others: ``first`` (index of its
  first id in the whole sequence), ``n_ids``, ``words`` (32-bit words in the order of reading), ``states`` and ``places``
  (checkpoints: the 64-bit states of the ``LANES`` interleaved coders and the word to read next, every ``STRIDE`` ids),
  ``crc32`` (of words and states), and ``doc_ids, starts, sizes`` of the documents that it touches.

Ids are in ascending doc_id order; blocks are ordered by ``first``. Id k of a block belongs to lane k mod ``LANES``. A
reader may decode any stretch between two checkpoints by itself; here all stretches of a batch are decoded side by side.

Defined results: a null text counts as empty; every document ends with ``end_id``, so an empty one has one id; null
doc_ids come first; repeated rows are documents of their own; an empty table gives an empty folder and an empty result;
a broken checksum raises an error; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbline.llm.common import id_number, id_text, python_batches
from curbline.session import scratch_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BLOCK, LANES, STRIDE = 1 << 15, 32, 1 << 13
_SCALE = 20
_LOW = np.uint64(1 << 31)
_WIDE = 96  # blocks coded side by side
_KEPT_CHUNKS = 300_000  # chunks whose ids one worker keeps, twice
_MARKS = ".,;:!?"
_letter = re.compile("[A-Za-z\u00e0-\u00f6\u00f8-\u00ff]").match
_odd_space = re.compile(r"[^\S \n]|\0").search
_single_space = re.compile(r"(?<=\S) (?=\S)").split


def _plain(text: str) -> bool:
    """No white space but single spaces and line feeds, each between other characters."""
    return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n" or _odd_space(text))


class ChunkIds:
    """Ids of texts, by the tokenizers library, chunk by chunk.

    A single space or line feed between two characters that are no white space always starts a new piece of the
    byte-level pattern (and what follows a line feed another one), and so does a mark of punctuation after a letter.
    Texts are cut there, and equal chunks are encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the chunks kept last; those seen again move to the new ones

    def _encode(self, chunks: list[str]) -> list[bytes]:
        code = "H" if self.kind.itemsize == 2 else "I"
        return [array(code, found.ids).tobytes() for found in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learn(self, chunks: set[str]) -> None:
        known, before = self.known, self.before
        again = before.keys() & chunks
        known.update((c, before[c]) for c in again)
        whole, cut = [], []
        for chunk in chunks - again:
            if chunk[-1:] in _MARKS:
                stem = chunk.rstrip(_MARKS)
                if _letter(stem[-1:]):
                    cut.append((chunk, stem, chunk[len(stem) :]))
                    continue
            whole.append(chunk)
        known.update(zip(whole, self._encode(whole)))
        missing = list({x for _, stem, end in cut for x in (stem, end)} - known.keys())
        known.update(zip(missing, self._encode(missing)))
        known.update((chunk, known[stem] + known[end]) for chunk, stem, end in cut)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut: list[list[str]] = []
        for text in texts:
            if not text:
                cut.append([])
            elif _plain(text):  # a space opens its chunk, a line feed is one of its own
                cut.append(text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))
            else:
                parts = _single_space(text)
                cut.append(parts[:1] + [" " + p for p in parts[1:]])
        self._learn(set().union(*cut).difference(self.known))
        out = [b"".join(map(self.known.__getitem__, chunks)) for chunks in cut]
        if len(self.known) > _KEPT_CHUNKS:
            self.known, self.before = {}, self.known
        return out


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def tokenized(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, shard, within, size, ids: shards follow each other in ascending doc_id, documents in order inside."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, shard, within = chunk_ids(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], coder.kind).tobytes()
        for batch in batches:
            ids = [x + end for x in coder.encode(batch["text"].tolist())]
            sizes = np.array([len(x) // coder.kind.itemsize for x in ids], np.int64)
            before = within + np.cumsum(sizes) - sizes
            within += int(sizes.sum())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "shard": shard, "within": before, "size": sizes, "ids": ids})

    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select(id_text(), "text").mapInPandas(run, "doc_id string, shard int, within long, size long, ids binary")


class Coder:
    """Coding and decoding with one frequency table: ids (sorted) and frequencies with sum 2 ** 20."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freq.astype(np.uint64)
        self.cum = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.place = np.zeros(int(ids.max()) + 1, np.int32)
        self.place[ids] = np.arange(len(ids))
        self.slots: np.ndarray | None = None

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[bytes, bytes, list[int]]]:
        """Words, checkpoint states and checkpoint places of each block."""
        steps = -(-max(map(len, blocks)) // LANES)
        filler = int(self.freq.argmax())
        symbols = np.full((len(blocks), steps * LANES), filler, np.int32)
        for row, ids in zip(symbols, blocks):
            row[: len(ids)] = self.place[ids]
        symbols = np.ascontiguousarray(symbols.reshape(len(blocks), steps, LANES).transpose(1, 0, 2))
        used = np.array([-(-len(b) // LANES) for b in blocks])
        state = np.full((len(blocks), LANES), _LOW, np.uint64)
        words = np.zeros(symbols.shape, np.uint32)
        out = np.zeros(symbols.shape, bool)
        saved = {}
        stride = STRIDE // LANES
        for t in range(steps - 1, -1, -1):
            on = used > t
            f, c = self.freq[symbols[t]], self.cum[symbols[t]]
            full = (state >= (f << np.uint64(63 - _SCALE))) & on[:, None]
            words[t], out[t] = state & np.uint64(0xFFFFFFFF), full
            x = np.where(full, state >> np.uint64(32), state)
            div = x // f
            x = (div << np.uint64(_SCALE)) + (x - div * f) + c
            state = np.where(on[:, None], x, state)
            if t % stride == 0:
                saved[t] = state
        result = []
        for b in range(len(blocks)):
            marks = range(0, int(used[b]), stride)
            emitted = out[: used[b], b]
            places = np.concatenate([[0], np.cumsum(emitted.sum(axis=1))])[list(marks)]
            result.append((words[: used[b], b][emitted].astype("<u4").tobytes(), np.stack([saved[t][b] for t in marks]).astype("<u8").tobytes(), places.tolist()))
        return result

    def decode(self, blocks: list[tuple[int, bytes, bytes, np.ndarray]]) -> list[np.ndarray]:
        """Ids of each (n_ids, words, states, places): all stretches between checkpoints side by side."""
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.freq.astype(np.int64))
        words = np.frombuffer(b"".join(w for _, w, _, _ in blocks) + b"\0" * 4, "<u4").astype(np.uint64)
        bases = np.cumsum([0] + [len(w) // 4 for _, w, _, _ in blocks[:-1]])
        state = np.frombuffer(b"".join(s for _, _, s, _ in blocks), "<u8").astype(np.uint64).reshape(-1, LANES)
        pointer = np.concatenate([np.asarray(p, np.int64) + base for (_, _, _, p), base in zip(blocks, bases)])
        per = STRIDE // LANES
        used = np.concatenate([np.minimum(-(-n // LANES) - np.arange(len(p)) * per, per) for n, _, _, p in blocks])
        symbols = np.zeros((per, len(state), LANES), np.int32)
        mask = np.uint64((1 << _SCALE) - 1)
        for t in range(int(used.max())):
            on = (used > t)[:, None]
            slot = state & mask
            symbol = self.slots[slot]
            symbols[t] = symbol
            x = self.freq[symbol] * (state >> np.uint64(_SCALE)) + slot - self.cum[symbol]
            need = (x < _LOW) & on
            at = np.minimum(pointer[:, None] + np.cumsum(need, axis=1) - 1, len(words) - 1)
            x = np.where(need, (x << np.uint64(32)) | words[np.maximum(at, 0)], x)
            state = np.where(on, x, state)
            pointer += need.sum(axis=1)
        symbols = symbols.transpose(1, 0, 2).reshape(len(state), -1)
        out, row = [], 0
        for n, _, _, places in blocks:
            out.append(self.ids[symbols[row : row + len(places)].ravel()[:n]])
            row += len(places)
        return out


def scaled(counts: np.ndarray) -> np.ndarray:
    """Positive frequencies with sum 2 ** 20 that follow ``counts`` (all positive)."""
    total = 1 << _SCALE
    share = counts / counts.sum() * (total - len(counts))
    freq = 1 + np.floor(share).astype(np.int64)
    freq[np.argsort(np.floor(share) - share, kind="stable")[: total - int(freq.sum())]] += 1
    return freq


def write(docs: DataFrame, folder: str, *, vocabulary: str = VOCABULARY, end_id: int = 0) -> None:
    """Encode all texts of ``docs`` (doc_id, text) and write them to ``folder`` in ascending doc_id order."""
    spark = docs.sparkSession
    python_batches(spark)
    kind = chunk_ids(vocabulary).kind
    staged = f"{scratch_dir(spark).rstrip('/')}/curbline-{uuid.uuid4().hex}"
    tokenized(docs, vocabulary, end_id).write.option("compression", "zstd").parquet(staged)
    held = spark.read.parquet(staged)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << (8 * min(kind.itemsize, 3)), np.int64)  # ids of three bytes at most
        for batch in batches:
            for ids in batch["ids"]:
                found = np.frombuffer(ids, kind)
                total += np.bincount(found, minlength=len(total)) if len(found) > len(total) // 8 else 0
                if len(found) <= len(total) // 8:
                    np.add.at(total, found, 1)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    counts = held.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")  # one row per id
    ids = counts["id"].to_numpy(np.int64)
    freq = scaled(counts["n"].to_numpy(float)) if len(ids) else np.empty(0, np.int64)
    spark.createDataFrame(pd.DataFrame({"id": ids, "freq": freq}), "id long, freq long").coalesce(1).write.parquet(f"{folder}/table")
    sizes = held.groupBy("shard").agg(F.sum("size").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # one row per shard
    placed = held.join(F.broadcast(base), "shard").select("doc_id", (F.col("_base") + F.col("within")).alias("start"), "size", "ids")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(ids, freq)
        blocks: list[tuple[int, np.ndarray, list]] = []
        open_ids: list[np.ndarray] = []
        open_docs: list[tuple] = []
        first = held_n = 0

        def close() -> None:
            nonlocal first, held_n, open_ids, open_docs
            whole = np.concatenate(open_ids)
            at = 0
            while held_n - at >= BLOCK or (at < held_n and closing):
                part = whole[at : at + BLOCK]
                lo, hi = first + at, first + at + len(part)
                blocks.append((lo, part, [d for d in open_docs if d[1] < hi and d[1] + d[2] > lo]))
                at += len(part)
            open_ids, held_n, first = ([whole[at:]] if at < held_n else []), held_n - at, first + at
            open_docs = [d for d in open_docs if d[1] + d[2] > first]

        def ready() -> pd.DataFrame:
            coded = coder.encode([b for _, b, _ in blocks])
            frame = pd.DataFrame({
                "first": [f for f, _, _ in blocks], "n_ids": [len(b) for _, b, _ in blocks], "words": [c[0] for c in coded], "states": [c[1] for c in coded], "places": [c[2] for c in coded],
                "crc32": [zlib.crc32(c[1], zlib.crc32(c[0])) for c in coded], "doc_ids": [[d[0] for d in ds] for _, _, ds in blocks], "starts": [[d[1] for d in ds] for _, _, ds in blocks], "sizes": [[d[2] for d in ds] for _, _, ds in blocks],
            })
            blocks.clear()
            return frame

        closing = False
        for batch in batches:
            doc_ids = batch["doc_id"].tolist()
            for doc_id, start, size, raw in zip(doc_ids, batch["start"].tolist(), batch["size"].tolist(), batch["ids"]):
                if held_n and start != first + held_n:  # another stretch of the sequence
                    closing = True
                    close()
                    closing = False
                if not held_n:
                    first = start
                open_ids.append(np.frombuffer(raw, kind))
                open_docs.append((doc_id, start, size))
                held_n += size
                if held_n >= BLOCK:
                    close()
                while len(blocks) >= _WIDE:
                    yield ready()
        if held_n:
            closing = True
            close()
        if blocks:
            yield ready()

    schema = "first long, n_ids int, words binary, states binary, places array<int>, crc32 long, doc_ids array<string>, starts array<long>, sizes array<long>"
    blocks = placed.mapInPandas(encode, schema)
    blocks.withColumn("doc_ids", F.col("doc_ids").cast("array<bigint>")).write.option("compression", "zstd").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str, *, kind: str = "<u4") -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of pieces of documents, from the files.

    A document that lies in several blocks has one row per block; ``offset`` is the place of a piece in its document.
    """
    frequencies = spark.read.parquet(f"{folder}/table").toPandas().sort_values("id")  # one row per id of the vocabulary
    ids, freq = frequencies["id"].to_numpy(np.int64), frequencies["freq"].to_numpy(np.int64)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(ids, freq) if len(ids) else None
        for batch in batches:
            for at in range(0, len(batch), _WIDE):
                part = batch.iloc[at : at + _WIDE]
                for words, states, crc in zip(part["words"], part["states"], part["crc32"]):
                    if zlib.crc32(states, zlib.crc32(words)) != crc:
                        raise ValueError("a block of token ids does not have its checksum")
                found = coder.decode(list(zip(part["n_ids"].tolist(), part["words"], part["states"], part["places"])))
                rows = []
                for first, whole, docs, starts, sizes in zip(part["first"].tolist(), found, part["doc_ids"], part["starts"], part["sizes"]):
                    for doc_id, start, size in zip(docs, starts, sizes):
                        lo, hi = max(int(start), first), min(int(start + size), first + len(whole))
                        rows.append((doc_id, int(start), int(size), lo - int(start), whole[lo - first : hi - first].astype(kind).tobytes()))
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "offset", "ids"])

    blocks = spark.read.parquet(f"{folder}/blocks").withColumn("doc_ids", F.col("doc_ids").cast("array<string>"))
    found = blocks.mapInPandas(decode, "doc_id string, start long, n_tokens long, offset long, ids binary")
    return found.withColumn("doc_id", id_number())


def digests(pieces: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document from the pieces of ``read``; few documents lie in several blocks."""
    part = F.struct("offset", F.crc32("ids").alias("crc"), F.when(F.length("ids") < 4 * F.col("n_tokens"), F.col("ids")).alias("ids"))
    parts = pieces.select("doc_id", "start", "n_tokens", part.alias("_p")).groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    joined = F.crc32(F.aggregate("_p.ids", F.lit(b""), lambda a, b: F.concat(a, b)))
    return parts.select("doc_id", "start", "n_tokens", F.when(F.size("_p") == 1, F.col("_p")[0]["crc"]).otherwise(joined).alias("ids_crc32"))
