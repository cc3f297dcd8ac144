"""Near-duplicate documents by MinHash: one-permutation hashing, bands, star-shaped candidate edges, exact checks.

1. Every text becomes its set of word shingles (64-bit hashes). The shingles are dealt to ``bands * rows`` bins; the
   least hash of each bin is its MinHash, and empty bins are filled by optimal densification (each empty bin takes the
   value of a full bin drawn by a universal hash of bin number and attempt).
2. Equal sets form one class; only class representatives go on, so copies never make pairs.
3. Representatives meet in buckets of equal bands. Where sets of a bucket differ too much in size to be linked, it is
   parted by size, so that two sets that can be linked are in the same part or in neighbouring ones. The hub of a part is
   the member that meets most others over all its buckets; every member is paired with the hub of its part and with that
   of the part of the next smaller sets, a star per part.
4. Pairs are confirmed on the full sets. Members that a hub does not link are then compared with those members of the
   star that can still be linked: what two members share inside the hub's set is bounded by what each shares with it, and
   what they share outside is found by a join on shingles that the hub lacks. Members that already share a component need
   no test. So every pair of a bucket that its sizes allow is settled, and no bucket is capped.
5. Components of the confirmed links give the classes.

With 50 bands of 7 rows, a pair at similarity 0.8 misses all buckets with probability 0.00001, one at 0.05 meets in one
with probability 0.00000004.

Defined results: null and empty texts, and texts of white space, have the empty set and are linked with nothing; fewer
words than the width make one shingle; repeated rows and equal texts are one class; a null doc_id is never a component
id unless all members have none; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.llm.common import id_number, id_text, python_batches, tidy
from curbline.llm.shingles import mix64, shingle_set
from curbline.operators.graph import connected_components
from curbline.session import cut

BANDS, ROWS = 50, 7
WIDE = 16  # members of a star beyond which a shingle counts as part of its hub
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def densified(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One MinHash per bin from sorted distinct hashes (at least one)."""
    owner = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    full, first = np.unique(owner, return_index=True)
    least = np.zeros(bins, np.uint64)
    least[full] = shingles[first]
    filled = np.zeros(bins, bool)
    filled[full] = True
    open_bins, attempt = np.flatnonzero(~filled), 0
    while len(open_bins):
        attempt += 1
        drawn = (mix64((open_bins.astype(np.uint64) + np.uint64(1)) * _GOLDEN + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = filled[drawn]
        least[open_bins[hit]] = least[drawn[hit]]
        open_bins = open_bins[~hit]
    return least


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    mins = densified(shingles, bands * rows).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN
    for k in range(rows):
        key = mix64(key * _GOLDEN + mins[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, vid (64-bit id of the set, null for the empty set) and band keys per row."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.seterr(over="ignore")
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch["text"]]
            vids = [int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in sets]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "n_shingles": [len(s) for s in sets], "vid": pd.array(vids, "Int64"),
                "bands": [band_keys(s, bands, rows) if len(s) else None for s in sets],
            })

    rows_in = docs.select(id_text(), "text", F.xxhash64("text").alias("text_hash"))
    return rows_in.mapInPandas(tidy(sign), "doc_id string, text_hash long, n_shingles long, vid long, bands array<long>").withColumn("doc_id", id_number())


def compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``pairs`` (a, b, upper) plus common, united, novel: exact sizes of intersection and union, and what only a has."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, np.empty(0, np.uint64)
        for batch in batches:
            common, united, novel = [], [], []
            for b, text_a, text_b in zip(batch["b"], batch["text_a"], batch["text_b"]):
                if b != last:
                    last, held = b, shingle_set(text_b, width)
                own = shingle_set(text_a, width)
                new = np.setdiff1d(own, held, assume_unique=True)
                common.append(len(own) - len(new))
                united.append(len(held) + len(new))
                novel.append(new.view(np.int64))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "upper": batch["upper"], "common": common, "united": united, "novel": novel})

    joined = pairs.join(texts.select(F.col("vid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("vid").alias("b"), F.col("text").alias("text_b")), "b")
    return joined.select("a", "b", "upper", "text_a", "text_b").mapInPandas(tidy(measure), "a long, b long, upper boolean, common long, united long, novel array<long>")


def unsettled(tested: DataFrame, found: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of members of one star in different components that may still be linked.

    The hub's set is widened by the shingles that more than ``WIDE`` members of its star share. Of n shingles a member has
    c in that set H. Two members share min(c_a, c_b) shingles inside H at most; the others that they share are counted by
    an equi join on shingles that at most ``WIDE`` members have. Both bounds are exact, so no link is lost. Two members
    that are both ``upper`` (larger than the sets of the hub's part) are in another star together and left to it.
    """
    linked = 100 * F.col("common") >= percent * F.col("united")
    rays = tested.select(F.col("b").alias("hub"), F.col("a").alias("vid"), "upper", F.col("common").alias("c"), linked.alias("held"), "novel")
    rays = rays.join(found.withColumnRenamed("vertex", "vid"), "vid", "left").withColumn("component", F.coalesce("component", "vid"))
    rays = cut(rays.join(classes.select("vid", "n"), "vid"))
    split = rays.groupBy("hub").agg((F.min("component") != F.max("component")).alias("_split")).where("_split").select("hub")
    rays = cut(rays.join(cut(split), "hub"))
    new = rays.select("hub", "vid", F.explode("novel").alias("shingle"))
    spread = cut(new.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))
    new = cut(new.join(spread, ["hub", "shingle"]))  # a shingle of one member is shared with nobody
    wide = new.where(F.col("_n") > WIDE).groupBy("hub", "vid").agg(F.count(F.lit(1)).alias("_q"))
    rays = cut(rays.drop("novel").join(wide, ["hub", "vid"], "left").withColumn("c", F.col("c") + F.coalesce("_q", F.lit(0))).drop("_q"))
    loose = rays.where(~F.col("held")).select("hub", F.col("vid").alias("a"), F.col("c").alias("c_a"), F.col("n").alias("n_a"), F.col("component").alias("component_a"), F.col("upper").alias("upper_a"))
    apart = ~(F.col("upper_a") & F.col("upper")) & (F.col("component_a") != F.col("component")) & (F.col("held") | (F.col("a") < F.col("vid")))

    def may(most: Column) -> Column:
        return 100 * most >= percent * (F.col("n_a") + F.col("n") - most)

    inside = F.least("c_a", "c")
    plain = loose.where(100 * F.col("c_a") >= percent * F.col("n_a")).join(rays, "hub").where(apart & may(inside))
    rare = new.where(F.col("_n") <= WIDE).select("hub", "vid", "shingle")
    met = rare.select("hub", F.col("vid").alias("a"), "shingle").join(loose.select("hub", "a"), ["hub", "a"], "left_semi").join(rare, ["hub", "shingle"])
    both = met.where(F.col("a") != F.col("vid")).groupBy("hub", "a", "vid").agg(F.count(F.lit(1)).alias("o"))
    outside = both.join(loose, ["hub", "a"]).join(rays, ["hub", "vid"]).where(apart & may(inside + F.col("o")))
    return plain.select("a", F.col("vid").alias("b")).union(outside.select("a", "vid")).distinct()


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept, group_id per row of ``docs`` (doc_id, text).

    group_id is the same number for all rows of a component, and null for empty sets.
    """
    python_batches(docs.sparkSession)
    signed = cut(signatures(docs, width, bands, rows))
    classes = signed.where(F.col("vid").isNotNull()).groupBy("vid").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("_first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes.select("vid", "n", F.col("_first.doc_id").alias("least_id"), F.col("_first.text_hash").alias("text_hash"), "bands"))
    members = classes.select("vid", "n", F.explode("bands").alias("key"))
    classes = classes.drop("bands")
    mixed = 100 * F.min("n") < percent * F.max("n")  # not all sets can be linked with each other
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), mixed.alias("mixed")).where(F.col("size") > 1)
    step = math.log(100 / max(percent, 1)) + 1e-6  # sets that can be linked are at most one part apart, whatever the rounding
    part = F.when(F.col("mixed"), F.floor(F.log("n") / step)).otherwise(-1)
    met = cut(members.join(buckets, "key").select("key", "vid", "n", "size", part.alias("part")))
    fame = met.groupBy("vid").agg(F.sum("size").alias("fame"))
    hubs = met.join(fame, "vid").groupBy("key", "part").agg(F.max(F.struct("fame", "vid", "n")).alias("_hub"), F.count(F.lit(1)).alias("near"))
    hubs = hubs.select("key", "part", F.col("_hub.vid").alias("b"), F.col("_hub.n").alias("n_b"), "near")
    own, below = (F.struct((F.col("part") - k).alias("part"), F.lit(k > 0).alias("upper")) for k in (0, 1))
    placed = met.select("key", "vid", "n", F.explode(F.when(F.col("part") < 0, F.array(own)).otherwise(F.array(own, below))).alias("_p"))
    alike = 100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")
    rays = placed.select("key", "vid", "n", "_p.*").join(hubs, ["key", "part"]).where((F.col("vid") != F.col("b")) & (alike | (F.col("near") > 1)))
    star = cut(rays.groupBy(F.col("vid").alias("a"), "b").agg(F.min("upper").alias("upper")))
    needed = star.select(F.col("a").alias("vid")).union(star.select("b")).distinct().join(classes, "vid").select("vid", F.col("least_id").alias("_id"), F.col("text_hash").alias("_th"))
    rows_in = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    texts = rows_in.join(needed, rows_in["doc_id"].eqNullSafe(needed["_id"]) & (rows_in["_h"] == needed["_th"])).groupBy("vid").agg(F.first("text").alias("text"))
    texts = cut(texts)
    linked = 100 * F.col("common") >= percent * F.col("united")
    tested = cut(compared(star, texts, width))
    links = tested.where(linked).select("a", "b")
    found = cut(connected_components(links))
    again = cut(unsettled(tested, found, classes, percent).withColumn("upper", F.lit(False)))
    more = compared(again, texts, width).where(linked).select("a", "b")
    between = more.join(found.select(F.col("vertex").alias("a"), F.col("component").alias("_ca")), "a", "left").join(found.select(F.col("vertex").alias("b"), F.col("component").alias("_cb")), "b", "left")
    between = cut(between.select(F.coalesce("_ca", "a").alias("a"), F.coalesce("_cb", "b").alias("b")))
    merged = cut(connected_components(between)).select(F.col("vertex").alias("_m"), F.col("component").alias("_top"))
    known = found.unionByName(merged.select(F.col("_m").alias("vertex"), F.col("_m").alias("component"))).groupBy("vertex").agg(F.min("component").alias("component"))
    top = known.join(merged, known["component"] == merged["_m"], "left").select(F.col("vertex").alias("vid"), F.coalesce("_top", "component").alias("component"))
    named = cut(top.join(classes.select("vid", "least_id"), "vid"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labels = named.join(least, "component").select("vid", "component_id", "component")
    labels = cut(classes.join(labels, "vid", "left").select("vid", F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("component", "vid").alias("group_id")))
    out = signed.select("doc_id", "text_hash", "n_shingles", "vid").join(labels, "vid", "left")
    out = out.withColumn("component_id", F.when(F.col("vid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "group_id")


def one_per_group(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of their component, one each; all rows without a word."""
    found = near_duplicates(docs.select("doc_id", "text"), **options).where(F.col("group_id").isNotNull())
    first = found.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("_first"))
    first = first.select(F.col("_first.doc_id").alias("doc_id"), F.col("_first.text_hash").alias("text_hash"))
    wordless = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(~wordless).select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct("*").alias("row")).groupBy("doc_id", "text_hash").agg(F.first("row").alias("row"))
    kept = rows.join(first, rows["doc_id"].eqNullSafe(first["doc_id"]) & (rows["text_hash"] == first["text_hash"]), "left_semi")
    return kept.select("row.*").unionByName(docs.where(wordless))
