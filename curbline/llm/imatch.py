"""Document fingerprints by I-Match (native): terms of a band of document frequency, sorted, hashed per lexicon subset.

Terms are the distinct runs of letters and digits of the lowered text, known by their 64-bit hash. The lexicon holds the
terms that occur in ``low`` to ``high`` of all documents. It has at most (mean distinct terms of a document) / ``low``
entries whatever the number of documents, and is broadcast for that reason.

Subset (k, l) of the lexicon holds the terms whose k-th hash ends in l zero bits: a share of 2 ** -l, another one for each
k. A text of n distinct terms is fingerprinted by the subsets of the levels l = floor(log2 n) and l + 1, which hold one or
two of its terms each; its component for a subset is the hash of its sorted distinct terms there. So at any length some
components survive an edit. Where the lexicon holds none of a text's terms in its subsets, as in copies that are so many
that their terms are beyond the band, its components are those of all its terms there. Likeness is the share
of equal components among those that either text has, over the levels that both texts use; if one of the two falls back
to all its terms, all terms of both are compared.

Defined results: a null text counts as empty; texts without a term have an empty fingerprint, alike only to each other;
documents are ordered by falling doc_id (null last, equal ids by text); rows equal in doc_id and text are one document
and give one row; a single document is its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.llm.common import numbered
from curbline.session import cut

LOW, HIGH = 0.001, 0.1
SALTS = 16
_EMPTY = 0  # in place of a 32-bit hash


def terms(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.array_distinct(F.transform(words, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``term`` of every hashed term in the band; document frequencies over all rows."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return cut(counts.where((F.col("df") >= low * n) & (F.col("df") <= high * n)).select("term"))


def components(df: DataFrame, kept: str, out: str) -> DataFrame:
    """``df`` plus array ``out``: one 32-bit hash per subset of the two levels, from the sorted terms in ``kept``."""
    held = [f"transform(sequence(0, {SALTS - 1}), k -> transform(filter({kept}, t -> (t.{field} & shiftleft(1, k)) != 0), t -> t.term))" for field in ("in0", "in1")]
    df = df.withColumn("_held", F.expr(f"concat({held[0]}, {held[1]})"))
    return df.withColumn(out, F.transform("_held", lambda h: F.when(F.size(h) > 0, F.hash(h).bitwiseOR(F.lit(2))).otherwise(F.lit(_EMPTY)))).drop("_held")


def likeness(a: str, b: str) -> Column:
    """Of two fingerprints, as structs of level, thin, and components by lexicon and by all terms."""
    thin = F.col(a)["thin"] | F.col(b)["thin"]
    (level_a, all_a), (level_b, all_b) = ((F.col(x)["level"], F.when(thin, F.col(x)["full"]).otherwise(F.col(x)["parts"])) for x in (a, b))

    def share(x: Column, y: Column) -> Column:
        told = F.zip_with(x, y, lambda p, q: F.when((p != _EMPTY) | (q != _EMPTY), p == q))
        heard = F.size(F.filter(told, lambda e: e.isNotNull()))
        return F.when(heard > 0, F.size(F.filter(told, lambda e: e)) / heard).otherwise(F.when((level_a == level_b) & (all_a == all_b), 1.0).otherwise(0.0))

    low, high = (1, SALTS), (SALTS + 1, SALTS)
    return (
        F.when(level_a == level_b, share(all_a, all_b)).when(level_a + 1 == level_b, share(F.slice(all_a, *high), F.slice(all_b, *low)))
        .when(level_b + 1 == level_a, share(F.slice(all_a, *low), F.slice(all_b, *high))).otherwise(0.0))


def _printed(name: str) -> Column:
    """level:components by lexicon:components by all terms; of a thin text level:components by all terms."""

    def hexed(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda x: F.when(x == _EMPTY, "").otherwise(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))))), "-")

    by_lexicon = F.when(~F.col(name)["thin"], hexed(F.col(name)["parts"]))  # null, and so left out, of a thin text
    return F.concat_ws(":", F.col(name)["level"].cast("string"), by_lexicon, hexed(F.col(name)["full"]))


def neighbours(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text_hash, n_chars, its next document, the document before and how much that one needs."""
    ids = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.length("text").cast("bigint").alias("n_chars")).distinct()
    ranked = cut(numbered(cut(ids), [F.col("doc_id").desc_nulls_last(), F.col("text_hash")], "_rank"))
    last = ranked.agg(F.max("_rank")).first()[0] or 0
    after = ranked.select(F.when(F.col("_rank") == 1, F.lit(last)).otherwise(F.col("_rank") - 1).alias("_rank"), F.col("doc_id").alias("next_id"), F.col("text_hash").alias("next_hash"))
    before = ranked.select(
        F.when(F.col("_rank") == last, F.lit(1)).otherwise(F.col("_rank") + 1).cast("bigint").alias("_rank"), F.col("doc_id").alias("prev_id"), F.col("text_hash").alias("prev_hash"), F.floor(F.col("n_chars") / 3).alias("need"))
    return cut(ranked.join(after, "_rank").join(before, "_rank").drop("_rank"))


def _members(t: Column, mask: Column) -> Column:
    """Bit k: the k-th hash of a term has none of the bits of ``mask``.

    The hashes are two 64-bit ones, each rotated by multiples of 8 bits.
    """
    bits = []
    for k in range(SALTS):
        source, turn = t[("term", "more")[k % 2]], k // 2 * 8
        turned = source if not turn else F.shiftrightunsigned(source, turn).bitwiseOR(F.shiftleft(source, 64 - turn))
        bits.append(F.when(turned.bitwiseAND(mask) == 0, F.lit(1 << k)).otherwise(F.lit(0)))
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out


def _sides(a: str, b: str, level_a: str, level_b: str) -> Column:
    """Terms of both texts as (side, term, more, ends) that are in a subset, each side with a mark, term 0, so that it has a row.

    more: a second hash of the term; ends: 2 ** level of the text. The others are left out before the array is spread over
    rows, as a filter behind it keeps Spark from dropping the arrays, which every row would then carry.
    """

    def marked(name: str, side: int, level: str) -> Column:
        ends = F.expr(f"shiftleft(1L, {level})")
        every = F.transform(F.array_append(name, F.lit(0).cast("bigint")), lambda t: F.struct(F.lit(side).alias("side"), t.alias("term"), F.xxhash64(t).alias("more"), ends.alias("ends")))
        return F.filter(every, lambda t: (t["term"] == 0) | (_members(t, t["ends"] - 1) != 0))

    return F.concat(marked(a, 0, level_a), marked(b, 1, level_b))


def _key(doc_id: str) -> list[Column]:
    """A doc_id as two columns without nulls, so that joins and groups on it share one partitioning."""
    return [F.coalesce(doc_id, F.lit(0)).alias("_id"), F.col(doc_id).isNull().alias("_none")]


def fingerprints(docs: DataFrame, *, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per document."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    places = neighbours(docs)
    words = lexicon(docs, low, high)
    words = words.select("term", F.lit(True).alias("_known"))
    key = ["_id", "_none", "text_hash"]
    own = docs.select(*_key("doc_id"), F.xxhash64("text").alias("text_hash"), "text").groupBy(*key).agg(F.first("text").alias("text"))
    placed = own.join(places.select(*_key("doc_id"), "*"), key)
    heads = placed.select(*_key("prev_id"), F.col("prev_hash").alias("text_hash"), F.expr("substring(text, 1, CAST(need AS INT))").alias("_head"))
    left = F.expr("substring(text, 1, CAST(n_chars - floor(n_chars / 3) AS INT))")
    paired = placed.join(heads, key).select(*key, "doc_id", "n_chars", "next_id", "next_hash", terms(F.col("text")).alias("_a"), F.concat(left, "_head").alias("_edited"))
    paired = paired.withColumns({"edited_sha256": F.sha2("_edited", 256), "_b": terms(F.col("_edited"))}).drop("_edited")
    whole = ["doc_id", "n_chars", "next_id", "next_hash", "edited_sha256"]
    for c in ("a", "b"):
        paired = paired.withColumns({f"_least_{c}": F.array_min(f"_{c}"), f"_level_{c}": F.greatest(F.length(F.bin(F.size(f"_{c}"))) - 1, F.lit(0))})
        whole += [f"_least_{c}", f"_level_{c}"]
    # Rows of a document stay where the join put them: no shuffle before they are gathered again.
    rows = paired.select(*key, *whole, F.explode(_sides("_a", "_b", "_level_a", "_level_b")).alias("_t"))
    own_bits = {"in0": _members(F.col("_t"), F.col("_t.ends") - 1), "in1": _members(F.col("_t"), F.col("_t.ends") * 2 - 1)}
    rows = rows.select(*key, *whole, "_t.side", "_t.term", *[bits.alias(c) for c, bits in own_bits.items()])
    met = rows.join(F.broadcast(words), "term", "left")
    lists = [F.collect_list(F.when((F.col("side") == side) & (F.col("term") != 0), F.struct("term", "in0", "in1", F.col("_known").isNotNull().alias("known")))).alias(c) for side, c in enumerate(("_a", "_b"))]
    kept = met.groupBy(*key).agg(*[F.first(c).alias(c) for c in whole], *lists)
    for c, out in (("a", "own"), ("b", "edited")):
        kept = kept.withColumn(f"_{c}", F.array_sort(f"_{c}")).withColumn(f"_known_{c}", F.filter(f"_{c}", lambda t: t["known"]))
        least = F.array_repeat(F.hash(F.array(f"_least_{c}")).bitwiseOR(F.lit(2)), 2 * SALTS)
        none = F.array_repeat(F.lit(_EMPTY), 2 * SALTS)
        kept = components(components(kept, f"_known_{c}", f"_parts_{c}"), f"_{c}", f"_full_{c}")
        full = F.when(F.size(f"_{c}") > 0, F.col(f"_full_{c}")).when(F.col(f"_least_{c}").isNull(), none).otherwise(least)  # least: about once in 10 million texts
        thin = F.col(f"_least_{c}").isNotNull() & (F.size(f"_known_{c}") == 0)
        kept = kept.withColumn(out, F.struct(F.col(f"_level_{c}").alias("level"), thin.alias("thin"), F.col(f"_parts_{c}").alias("parts"), full.alias("full")))
    done = cut(kept.select("text_hash", *whole[:5], "own", "edited"))
    nexts = done.select(*_key("doc_id"), "text_hash", F.col("own").alias("following"))
    out = done.select(*_key("next_id"), F.col("next_hash").alias("text_hash"), *whole[:2], "edited_sha256", "own", "edited").join(nexts, key)
    return out.select(
        "doc_id", "n_chars", "edited_sha256", _printed("own").alias("fingerprint"), _printed("edited").alias("edited_fingerprint"), likeness("own", "edited").alias("near_edited"), likeness("own", "following").alias("near_next"))
