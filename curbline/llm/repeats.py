"""Repeated byte strings of a corpus by prefix-free parsing: suffix arrays of dictionary and parse give corpus order.

A byte goes when it lies in a ``length``-byte string that also starts anywhere else, in the same document or another.

1. Parse. A rolling hash runs over 16 bytes. The trigger of a string is the position of the least hash among its first
   ``spread(length)`` positions (the leftmost of equals), so that equal strings have their trigger at equal offsets and
   phrases between triggers are at most that many bytes long, whatever the text. Strings that start in one phrase and share a
   trigger form a run: a phrase suffix of ``s`` bytes, then ``length - s`` bytes from the trigger on.
2. Runs meet by the bytes that all their strings share (``length - spread + 1`` from the trigger). A run alone there
   has no repeated string. Runs that are equal as a whole are repeated as a whole, which settles most copies by counts
   alone; one of each kind stays for comparison.
3. Compare. Where different runs meet, tasks get their phrases (dictionary) and what follows (parse). Both are suffix
   sorted, with common lengths of neighbours. For each ``s``, runs whose phrases end in the same ``s`` bytes are
   neighbours in the dictionary's order; ordered by the parse inside, they are in corpus order, and two neighbours share
   a string exactly if what follows agrees for ``length - s`` bytes (a range minimum over the parse's common lengths).
4. Groups of more than ``GROUP`` different runs (a passage that starts or ends in very many contexts) are not gathered:
   each of their strings is counted by hash instead, which Spark folds before it shuffles. The answer is the same.

Defined results: null text counts as empty; texts shorter than ``length`` bytes lose nothing; a repeated row repeats all
its strings; an empty table gives an empty result; other columns are ignored. Two different runs are taken for equal only
if two 64-bit hashes of them agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.llm.common import id_number, id_text, python_batches, tidy
from curbline.llm.shingles import mix64
from curbline.session import cut

MOST_SPREAD = 256
GROUP = 20_000
_GRAM_DOUBLINGS = 4  # the rolling hash covers 2 ** 4 bytes
LEAST = 1 << _GRAM_DOUBLINGS
_FLUSH = 20_000  # runs compared at a time (a group is never divided)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = np.uint64(0xD1342543DE82EF95)


def spread(length: int) -> int:
    """Starts that look for a trigger: a power of two that leaves a third of the string, and a whole rolling hash, behind it."""
    if length < LEAST:
        raise ValueError(f"repeated strings have at least {LEAST} bytes")
    return 1 << (min(MOST_SPREAD, 2 * length // 3, length - LEAST + 1).bit_length() - 1)


def triggers(data: np.ndarray, near: int) -> np.ndarray:
    """For each start x: the position of the least rolling hash in [x, x + near), a power of two."""
    with np.errstate(over="ignore"):
        h, factor = _BYTES[data], _FACTOR
        for k in range(_GRAM_DOUBLINGS):
            h = h[: -(1 << k)] * factor + h[1 << k :]
            factor = factor * factor
        h = mix64(h)
    best = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach < near:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Per run: text number, trigger, most and least s, all relative to the text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    starts = np.maximum(sizes - length + 1, 0)
    if not starts.sum():
        none = np.empty(0, np.int64)
        return none, none, none, none
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), starts)
    x = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts) + begins[owner]
    at = triggers(data, spread(length))[x]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    return owner[first], at[first] - begins[owner[first]], at[first] - x[first], at[first] - x[last]


def _parsed(docs: DataFrame, length: int) -> DataFrame:
    shared = length - spread(length) + 1

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["body"].tolist()
            owner, at, most, least = runs(texts, length)
            spots = list(zip(owner.tolist(), at.tolist(), most.tolist(), least.tolist()))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].to_numpy()[owner], "text_hash": batch["text_hash"].to_numpy()[owner], "at": at, "most": most.astype(np.int32), "least": least.astype(np.int32),
                "key": np.array([xxhash.xxh3_64_intdigest(texts[o][a : a + shared]) for o, a, _, _ in spots], np.uint64).view(np.int64),
                "run": np.array([xxhash.xxh3_64_intdigest(texts[o][a - m : a - n + length], m << 16 | n) for o, a, m, n in spots], np.uint64).view(np.int64),
            })

    schema = "doc_id string, text_hash long, at long, most int, least int, key long, run long"
    return docs.where(F.length("body") >= length).mapInPandas(tidy(parse), schema)


def _common(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefix length of each row with the one before, -1 at the start of a group."""
    out = np.full(len(rows), -1, np.int64)
    differ = rows[1:] != rows[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    out[1:] = np.where(group[1:] == group[:-1], n, -1)
    return out


def shared_strings(group: np.ndarray, left: np.ndarray, right: np.ndarray, most: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """Flags [run, s]: the string of that run with ``s`` bytes before the trigger occurs in another run of its group.

    left: bytes before the trigger, backwards; right: bytes after those that the group shares.
    """
    n, near = len(group), spread(length)
    shared = length - near + 1
    flags = np.zeros((n, near), bool)
    width = left.shape[1]
    dictionary = np.lexsort((np.ascontiguousarray(left).view(f"S{width}").ravel(), group))
    lcs = _common(left[dictionary], group[dictionary])
    parse = np.lexsort((np.ascontiguousarray(right).view(f"S{right.shape[1]}").ravel(), group))
    lcp = _common(right[parse], group[parse]) + shared
    rank = np.empty(n, np.int64)
    rank[parse] = np.arange(n)
    minima = [lcp]
    while (1 << len(minima)) <= n:
        step = 1 << (len(minima) - 1)
        minima.append(np.minimum(minima[-1][:-step], minima[-1][step:]))
    most_d, least_d, rank_d = most[dictionary], least[dictionary], rank[dictionary]
    for s in range(near):
        inside = np.flatnonzero((least_d <= s) & (s <= most_d))
        if len(inside) < 2:
            continue
        ending = np.cumsum(lcs < s)[inside] if s else np.cumsum(lcs < 0)[inside]  # runs whose phrases end in the same s bytes
        order = np.lexsort((rank_d[inside], ending))
        ending, place = ending[order], rank_d[inside][order]
        low, high = place[:-1] + 1, place[1:]
        same = np.flatnonzero(ending[1:] == ending[:-1])
        low, high = low[same], high[same]
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        least_common = np.empty(len(same), np.int64)
        for k in np.unique(level):
            on = level == k
            least_common[on] = np.minimum(minima[k][low[on]], minima[k][high[on] - (1 << int(k)) + 1])
        equal = same[least_common >= length - s]
        members = dictionary[inside[order]]
        flags[members[equal], s] = True
        flags[members[equal + 1], s] = True
    return flags


def _spans(flags: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of each stretch of flagged strings."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    return row, at[row] - high, at[row] - low + length


def _compare(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    width = spread(length)  # at least one more than any value has, so that no view is empty

    def matrix(values: pd.Series, backwards: bool) -> np.ndarray:
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        out = np.zeros((len(values), width), np.uint8)
        out[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(v[::-1] if backwards else v for v in values), np.uint8)
        return out

    group = np.unique(frame["key"].to_numpy(), return_inverse=True)[1]
    most, least, at = (frame[c].to_numpy() for c in ("most", "least", "at"))
    flags = shared_strings(group, matrix(frame["left"], True), matrix(frame["right"], False), most, least, length)
    flags[frame["many"].to_numpy()] = False  # these are settled as a whole
    row, begin, end = _spans(flags, at, length)
    return pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[row], "text_hash": frame["text_hash"].to_numpy()[row], "begin": begin, "end": end})


_SPAN = "doc_id string, text_hash long, begin long, end long"
_OWNER = ["doc_id", "text_hash"]


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id, text_hash, spans`` of documents that lose bytes; spans as begin << 32 | end, overlapping and unsorted.

    docs: doc_id (as text), text_hash, body (binary); other columns are only passed along, so that a join of the same table
    behind this one has the same exchange, which Spark then makes once.
    """
    shared = length - spread(length) + 1
    parsed = _parsed(docs, length)
    keys = parsed.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), (F.min("run") != F.max("run")).alias("mixed")).where(F.col("_n") > 1)
    keys = cut(keys.select("key", "mixed"))  # as a table of its own, so that Spark may split a hot key of the join
    met = cut(parsed.join(keys, "key"))
    kinds = met.groupBy("key", "run").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(*[c for c in met.columns if c not in ("key", "run")])).alias("_one"))
    kinds = cut(kinds.select("key", "run", "copies", "_one.*"))
    many = kinds.where(F.col("copies") > 1).select("key", "run")
    whole = met.join(many, ["key", "run"]).select(*_OWNER, (F.col("at") - F.col("most")).alias("begin"), (F.col("at") - F.col("least") + length).alias("end"))
    unlike = kinds.where("mixed")
    size = unlike.groupBy("key").agg((F.count(F.lit(1)) > GROUP).alias("large"))
    spots = unlike.join(size, "key").groupBy(*_OWNER).agg(F.collect_list(F.struct("key", "at", "most", "least", (F.col("copies") > 1).alias("many"), "large")).alias("spots"))
    spots = spots.withColumnsRenamed({c: f"_{c}" for c in _OWNER})

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, h, s["key"], s["at"], s["most"], s["least"], s["many"], s["large"], body[s["at"] - s["most"] : s["at"]], body[s["at"] + shared : s["at"] - s["least"] + length])
                    for d, h, body, found in zip(batch["doc_id"], batch["text_hash"], batch["body"], batch["spots"]) for s in found]
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "key", "at", "most", "least", "many", "large", "left", "right"])

    others = [c for c in docs.columns if c not in (*_OWNER, "body")]
    along = [F.xxhash64(*others).alias("along")] if others else []
    pieces = docs.join(spots, _same_row(docs, spots)).select(*_OWNER, "body", "spots", *along).mapInPandas(
        tidy(gather), "doc_id string, text_hash long, key long, at long, most int, least int, many boolean, large boolean, left binary, right binary")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            if rows + len(batch) > _FLUSH and rows:
                frame = pd.concat(held)
                open_group = (frame["key"] == batch["key"].iloc[0]).to_numpy()
                if not open_group.all():
                    yield _compare(frame[~open_group], length)
                    held = [frame[open_group]]
                    rows = int(open_group.sum())
            held.append(batch)
            rows += len(batch)
        if rows:
            yield _compare(pd.concat(held), length)

    gathered = pieces.where(~F.col("large")).repartition("key").sortWithinPartitions("key")
    compared = gathered.drop("large").mapInPandas(tidy(compare), _SPAN)

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, h, k, m, at - s, *divmod(xxhash.xxh3_128_intdigest(text[most - s : most - s + length - shared], s), 1 << 64))
                    for d, h, k, at, most, least, m, text in zip(batch["doc_id"], batch["text_hash"], batch["key"], batch["at"], batch["most"], batch["least"], batch["many"], map(bytes.__add__, batch["left"], batch["right"]))
                    for s in range(least, most + 1)]
            out = pd.DataFrame(rows, columns=["doc_id", "text_hash", "key", "many", "begin", "h1", "h2"])
            yield out.assign(h1=out["h1"].astype("uint64").astype("int64"), h2=out["h2"].astype("uint64").astype("int64"))

    single = pieces.where("large").drop("large").mapInPandas(tidy(strings), "doc_id string, text_hash long, key long, many boolean, begin long, h1 long, h2 long")
    seen = single.groupBy("key", "h1", "h2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    counted = single.where(~F.col("many")).join(seen, ["key", "h1", "h2"]).select(*_OWNER, "begin", (F.col("begin") + length).alias("end"))
    spans = whole.unionByName(compared).unionByName(counted)
    return spans.groupBy(*_OWNER).agg(F.collect_set(F.shiftleft("begin", 32).bitwiseOR(F.col("end"))).alias("spans"))


def _same_row(docs: DataFrame, other: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(other["_doc_id"]) & (docs["text_hash"] == other["_text_hash"])


def merged(spans: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of maximal removed runs, from packed spans."""
    if spans is None or not len(spans):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    spans = np.sort(np.asarray(spans, np.int64))
    begin, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    first = np.r_[True, begin[1:] > end[:-1]]
    return begin[first], np.r_[end[:-1][first[1:]], end[-1:]]


def kept(body: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(body)]
    return b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _bodies(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(id_text(), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("body"), *more)


def _with_spans(bodies: DataFrame, length: int) -> DataFrame:
    python_batches(bodies.sparkSession)
    found = repeated_spans(bodies, length).withColumnsRenamed({c: f"_{c}" for c in _OWNER})
    return bodies.join(found, _same_row(bodies, found), "left").drop("_doc_id", "_text_hash")


def digests(docs: DataFrame, *, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, body, spans in zip(batch["doc_id"], batch["body"], batch["spans"]):
                begin, end = merged(spans)
                rows.append((doc_id, len(body), int((end - begin).sum()), len(begin), sha256(kept(body, begin, end)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    held = _with_spans(_bodies(docs), length)
    found = held.select("doc_id", "body", "spans").mapInPandas(tidy(run), "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return found.withColumn("doc_id", id_number())


def strip(docs: DataFrame, *, length: int = 400) -> DataFrame:
    """``docs`` without repeated strings in ``text``; a character of which only some bytes are covered stays."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for bodies, spans in batches:
            out = []
            for body, found in zip(bodies, spans):
                begin, end = merged(found)
                data = np.frombuffer(body + b"\0", np.uint8)
                for k in range(3):  # inside a character: begin after it, end before it
                    begin = begin + ((data[begin] & 0xC0) == 0x80)
                    end = end - ((data[end] & 0xC0) == 0x80)
                ok = begin < end
                out.append(kept(body, begin[ok], end[ok]).decode())
            yield pd.Series(out)

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    bodies = _bodies(docs, F.col("text").isNull().alias("_none"), *[F.col(c).alias(f"_c_{c}") for c in others])
    held = _with_spans(bodies, length)
    whole = F.when(~F.col("_none"), F.col("body").cast("string"))
    text = F.when(F.col("spans").isNull(), whole).otherwise(F.pandas_udf(tidy(run), "string")("body", "spans"))
    return held.withColumn("_c_text", text).select(*[id_number() if c == "doc_id" else F.col(f"_c_{c}").alias(c) for c in docs.columns])
