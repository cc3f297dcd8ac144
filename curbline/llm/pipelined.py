"""Ranked lexical search over a term-partitioned index, evaluated as a pipeline of term owners.

1. Index. Tasks invert their documents in shards of at most ``SHARD`` documents: a row per shard and term with the
   documents (numbered inside the shard, in doc_id order) and occurrences, and a row per shard with doc_ids and lengths.
   Words that no item asks for are left out by a bit table of fixed size; what its collisions let through, a join removes.
2. Owners. The terms asked for are dealt to ``OWNERS`` owners of about equally many postings, rarest terms first.
3. Pipeline. A bundle is an item's sparse accumulators (documents and integer scores) over one shard. Bundles of up to
   ``ITEMS`` items visit one owner after the other: each stage is a cogroup of the bundles with that owner's postings on
   (items, shard) and adds integer contributions. A bundle lets go of a document once its score and all that later owners
   can add are below the bundle's own k-th best score, as it cannot come back into the best k.
4. The last stage selects the best k of each bundle, and a ranking per item selects among the shards.

A group holds at most ITEMS times SHARD scores and the postings of one shard, whatever the sizes of the tables. Items
against all documents is a stated query set, in blocks.

Defined results: null texts and texts without a term are not ranked; items without a term find nothing; rows of either
table that repeat are documents and items of their own; equal scores are ordered by doc_id, null ones last; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbline.llm.common import numbered, python_batches
from curbline.operators.scan import running_totals
from curbline.session import cut

SHARD, ITEMS, OWNERS = 2048, 256, 3  # documents of a shard, items that travel together, stages
_SHARD_POSTINGS, _SHARD_BYTES = 1_000_000, 32_000_000  # a shard of long documents is closed earlier
_SLOTS = 1 << 20  # of the bit table that leaves out words no item has
_SEPARATORS = [(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)]
_TERM_BYTES = bytes(0x20 if any(a <= b <= z for a, z in _SEPARATORS) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
INDEX = "shard bigint, term binary, docs binary, times binary, lengths binary, n_docs int, n_ids int, n_words bigint"
BUNDLE = "block bigint, shard bigint, item int, docs binary, scores binary, n_ids int, rest array<struct<item:int,owner:int,most:bigint>>"
FOUND = "block bigint, item int, doc_id bigint, score bigint"


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all bytes beyond ASCII, with A-Z lowered."""
    return text.translate(_TERM_BYTES).split() if text else []


class _Shard:
    """Documents being inverted."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.postings: dict[bytes, list[int]] = defaultdict(list)  # document, occurrences, document, ...
        self.n_postings = self.n_bytes = 0

    def add(self, doc_id: int | None, text: bytes, slots: bytes) -> None:
        words = terms(text)
        if not words:
            return
        at = len(self.ids)
        for word, n in Counter(words).items():
            if slots[crc32(word) & (_SLOTS - 1)]:
                self.postings[word] += (at, n)
                self.n_postings += 1
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.n_bytes += len(text)

    def full(self, most: int) -> bool:
        return len(self.ids) >= most or self.n_postings >= _SHARD_POSTINGS or self.n_bytes >= _SHARD_BYTES

    def rows(self, shard: int) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids = [self.ids[i] for i in order]
        known = sum(i is not None for i in ids)
        out = [(shard, None, np.array([i or 0 for i in ids], "<i8").tobytes(), None, np.array([self.lengths[i] for i in order], "<u4").tobytes(), len(ids), known, sum(self.lengths))]
        for word, pairs in self.postings.items():
            both = np.array(pairs, np.int64).reshape(-1, 2)
            out.append((shard, word, place[both[:, 0]].astype("<u2").tobytes(), both[:, 1].astype("<u4").tobytes(), None, len(both), None, None))
        names = ["shard", "term", "docs", "times", "lengths", "n_docs", "n_ids", "n_words"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), kinds)], names)


def inverted(docs: DataFrame, slots: bytes, shard_size: int = SHARD) -> DataFrame:
    """Rows of ``INDEX``: per shard one of doc_ids and lengths (term null), and one per term whose slot is set."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        n, shard = 0, _Shard()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i in range(batch.num_rows):
                shard.add(ids[i].as_py(), texts[i].as_py() or b"", slots)
                if shard.full(shard_size):
                    yield shard.rows(first + n)
                    n, shard = n + 1, _Shard()
        if shard.ids:
            yield shard.rows(first + n)

    python_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(invert, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """``_item, term, times`` for rows of ``_item, text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, w, n) for i, text in zip(batch.column("_item").to_pylist(), batch.column("text").to_pylist()) for w, n in Counter(terms(text)).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64()))], ["_item", "term", "times"])

    return items.select("_item", F.col("text").cast("binary").alias("text")).mapInArrow(count, "_item bigint, term binary, times bigint")


def slot_table(vocabulary: DataFrame) -> bytes:
    """One byte per slot, set where a term of ``vocabulary`` falls; at most ``_SLOTS`` numbers come to the driver."""
    taken = bytearray(_SLOTS)
    for (slot,) in vocabulary.select(F.crc32("term").bitwiseAND(_SLOTS - 1).alias("s")).distinct().collect():
        taken[slot] = 1
    return bytes(taken)


def owned_terms(index: DataFrame, vocabulary: DataFrame, n_docs: int, owners: int) -> DataFrame:
    """``term, w, owner`` of the terms that occur: by falling weight, owners of about equally many postings."""
    held = index.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n_docs").alias("df"))
    found = cut(vocabulary.select("term").distinct().join(held, "term"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    total = found.agg(F.sum("df")).first()[0] or 1
    ranked = running_totals(found, [F.col("df"), F.col("term")], {"_upto": F.col("df")})
    owner = F.least(F.floor((F.col("_upto") - F.col("df")) * owners / F.lit(total)), F.lit(owners - 1)).cast("int")
    return ranked.select("term", weight.cast("bigint").alias("w"), owner.alias("owner"))


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_REST = pa.list_(pa.struct([("item", pa.int32()), ("owner", pa.int32()), ("most", pa.int64())]))
_BUNDLE = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("item", pa.int32()), ("docs", pa.binary()), ("scores", pa.binary()), ("n_ids", pa.int32()), ("rest", _REST)])
_FOUND = pa.schema([("block", pa.int64()), ("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def contributions(w: int, times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * times) // (1000 * times + 12 * m))


def _visit(owner: int, owners: int, n_docs: int, n_words: int, k: int):
    """What one owner does with the bundles of one shard."""

    def visit(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, shard = (x.as_py() for x in key)
        facts, scores = None, {}
        for row in left.to_pylist():
            if row["item"] < 0:
                facts = row
        lengths = np.frombuffer(facts["scores"], "<u4").astype(np.int64)
        m = 75 + (25 * lengths * n_docs) // n_words
        for row in left.to_pylist():
            if row["item"] >= 0:
                held = scores[row["item"]] = np.zeros(len(m), np.int64)
                held[np.frombuffer(row["docs"], "<u2")] = np.frombuffer(row["scores"], "<i8")
        for row in right.to_pylist():
            docs = np.frombuffer(row["docs"], "<u2")
            added = contributions(row["w"], np.frombuffer(row["times"], "<u4").astype(np.int64), m[docs])
            for use in row["uses"]:
                if use["item"] not in scores:
                    scores[use["item"]] = np.zeros(len(m), np.int64)
                scores[use["item"]][docs] += use["times"] * added  # a document is once in a term's list
        rest: Counter = Counter()
        for x in facts["rest"] or ():
            rest[x["item"]] += x["most"] if x["owner"] > owner else 0
        out, ids = [], np.frombuffer(facts["docs"], "<i8")
        for item, held in sorted(scores.items()):
            docs = np.flatnonzero(held)
            if owner == owners - 1:  # documents are numbered by doc_id, and the sort is stable
                for d in docs[np.argsort(-held[docs], kind="stable")[:k]].tolist():
                    out.append((block, item, int(ids[d]) if d < facts["n_ids"] else None, int(held[d])))
            else:
                least = np.partition(held[docs], len(docs) - k)[len(docs) - k] if len(docs) > k else 0
                docs = docs[held[docs] + rest[item] >= least]
                out.append((block, shard, item, docs.astype("<u2").tobytes(), held[docs].tobytes(), None, None))
        if owner == owners - 1:
            return _arrow(out, _FOUND)
        return _arrow([(block, shard, -1, facts["docs"], facts["scores"], facts["n_ids"], facts["rest"]), *out], _BUNDLE)

    return visit


def search(docs: DataFrame, items: DataFrame, *, k: int = 20, owners: int = OWNERS, shard_size: int = SHARD, together: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best k documents of each row of ``items`` (item_id, text)."""
    asked = cut(numbered(items.select("item_id", "text"), [F.col("item_id").asc_nulls_last(), F.col("text")], "_item"))
    wanted = cut(item_terms(asked))
    index = cut(inverted(docs, slot_table(wanted), shard_size))
    per_shard = index.where(F.col("term").isNull())
    n_docs, n_words = per_shard.agg(F.sum("n_docs"), F.sum("n_words")).first()
    if not n_docs:
        return asked.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    block, item = F.floor(F.col("_item") / together), F.pmod(F.col("_item"), F.lit(together)).cast("int")
    owned = wanted.join(owned_terms(index, wanted, n_docs, owners), "term").select(block.alias("block"), item.alias("item"), "term", "times", "w", "owner")
    owned = cut(owned)
    uses = cut(owned.groupBy("block", "owner", "term", "w").agg(F.collect_list(F.struct("item", "times")).alias("uses")))  # at most ``together`` of each
    most = owned.groupBy("block", "item", "owner").agg(F.sum(F.col("times") * F.col("w") * 1_000_000).alias("most"))
    rest = most.groupBy("block").agg(F.collect_list(F.struct("item", "owner", "most")).alias("rest"))  # at most ``together`` times ``owners``
    # every bundle visits every shard: the blocks of items are dealt to shards here, and only here
    n_blocks = asked.agg(F.max(block)).first()[0] or 0
    bundles = per_shard.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks).cast("bigint")))).join(rest, "block")
    bundles = bundles.select("block", "shard", F.lit(-1).alias("item"), "docs", F.col("lengths").alias("scores"), "n_ids", "rest")
    lists = index.where(F.col("term").isNotNull()).select("term", *[F.col(c).alias(c) for c in ("shard", "docs", "times")])  # columns of their own beside the bundles'
    for owner in range(owners):
        postings = lists.join(uses.where(F.col("owner") == owner), "term").select("block", "shard", "w", "docs", "times", "uses")
        met = bundles.groupBy("block", "shard").cogroup(postings.groupBy("block", "shard"))
        bundles = met.applyInArrow(_visit(owner, owners, n_docs, n_words, k), FOUND if owner == owners - 1 else BUNDLE)
    best = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())  # k rows per shard
    ranked = bundles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item_id", block.alias("block"), item.alias("item")), ["block", "item"]).select("item_id", "rank", "doc_id", "score")


CHECK_SQL = r"""
WITH lowered AS (SELECT 0 AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    UNION ALL SELECT 1, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT kind, id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered),
counted AS (SELECT kind, id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT id, sum(tf)::BIGINT AS n FROM counted WHERE kind = 0 GROUP BY id),
corpus AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nw FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted, corpus WHERE kind = 0 GROUP BY term, nd),
added AS (SELECT q.id AS item_id, d.id AS doc_id, sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * n * nd) // nw))))::BIGINT AS score
    FROM counted q JOIN counted d ON q.kind = 1 AND d.kind = 0 AND q.term = d.term JOIN weights ON weights.term = d.term JOIN lengths l ON l.id = d.id, corpus GROUP BY q.id, d.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM added WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
