"""Exact deduplication by recipes of content-defined chunks (native).

Every text is cut at places that its own bytes decide: behind three bytes that are 4 modulo 8 (in ASCII for example d, l
and t), or behind a UTF-8 lead byte between two continuation bytes of that kind, but not before ``least`` bytes and not
after ``most``. Equal passages are thus cut alike wherever they stand. Chunks of all texts are deduplicated by their bytes
(copies are folded before they move), and each gets an identifier of one or more 64-bit hashes. The identifiers are
verified: while two different chunks share one, all identifiers are made one hash longer. A text is then its recipe, the
ordered list of its identifiers; only recipes are grouped and joined, so that the bytes of a long text move once, in
chunks, and those of a copy hardly at all.

Defined results: a null text counts as empty, and all empty texts are equal; nothing is normalised; rows without doc_id
stay only where their whole group has none; of repeated rows exactly one can stay; bytes that are not valid UTF-8 are
compared as they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.session import cut

LEAST, MOST = 256, 4096  # bytes of a chunk
PARTS, BITS = 2, 64  # 64-bit hashes of an identifier at first, and how many bits of each count (fewer in tests)
_MOST_PARTS = 16


def _bytes_class(ranges: list[tuple[int, int]], modulus: int = 1, remainder: int = 0) -> str:
    return "[" + "".join(f"\\x{b:02x}" for a, z in ranges for b in range(a, z + 1) if b % modulus == remainder) + "]"


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """A pattern over bytes (as Latin-1) whose matches, one behind the other, are the chunks of a text."""
    marked, tail = _bytes_class([(0, 127)], 8, 4), _bytes_class([(128, 191)], 8, 4)
    lead = _bytes_class([(192, 255)])
    return f"(?s).{{{least - 3},{most - 3}}}?(?:{marked}{{3}}|{tail}{lead}{tail})|.{{1,{most}}}"


def chunks(text: str | Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text, in order, as strings of one character a byte."""
    text = F.col(text) if isinstance(text, str) else text
    body = F.decode(F.coalesce(text, F.lit("")).cast("binary"), "ISO-8859-1")
    return F.regexp_extract_all(body, F.lit(chunk_pattern(least, most)), F.lit(0))


def identifier(chunk: Column, parts: int, bits: int = BITS) -> Column:
    """An array of ``parts`` differently seeded 64-bit hashes of a chunk."""
    return F.array(*[F.shiftrightunsigned(F.xxhash64(F.lit(k), chunk), 64 - bits) for k in range(parts)])


def chunk_table(docs: DataFrame, parts: int = PARTS, bits: int = BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Distinct chunks of all texts: ``id`` (as in recipes), ``chunk`` (binary), ``uses``."""
    each = docs.select(F.explode(chunks("text", least, most)).alias("_c"))
    held = each.groupBy("_c").agg(F.count(F.lit(1)).alias("uses"))
    return held.select(identifier(F.col("_c"), parts, bits).alias("id"), F.encode("_c", "ISO-8859-1").alias("chunk"), "uses")


def verified_parts(docs: DataFrame, parts: int = PARTS, bits: int = BITS, least: int = LEAST, most: int = MOST) -> int:
    """The least number of hashes, from ``parts`` on, with which no two different chunks share an identifier."""
    while parts <= _MOST_PARTS:
        table = chunk_table(docs, parts, bits, least, most)
        if table.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).isEmpty():
            return parts
        parts += 1
    raise ValueError(f"different chunks share identifiers of {_MOST_PARTS} hashes")


def recipes(docs: DataFrame, parts: int, bits: int = BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Per row: ``_row`` (a number of its own), doc_id, text_sha256, n_bytes, recipe (ordered identifiers in one array)."""
    steps = F.flatten(F.transform(chunks("text", least, most), lambda c: identifier(c, parts, bits)))
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", F.sha2(body, 256).alias("text_sha256"), F.octet_length(body).cast("bigint").alias("n_bytes"), steps.alias("recipe")).withColumn("_row", F.monotonically_increasing_id())


def exact_duplicates(docs: DataFrame, *, parts: int = PARTS, bits: int = BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, n_chunks.

    The row with the largest doc_id of each group of equal recipes stays. Groups are folded before they move, and the
    join back is an ordinary one, whose hot keys Spark splits.
    """
    parts = verified_parts(docs, parts, bits, least, most)
    rows = cut(recipes(docs, parts, bits, least, most))
    groups = rows.groupBy("recipe").agg(
        F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("_row", "doc_id"), F.max("_row")).alias("_stays"), F.count(F.lit(1)).alias("group_size")
    )
    return rows.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", (F.col("_row") == F.col("_stays")).alias("kept"), "text_sha256", "n_bytes", (F.size("recipe") / parts).cast("int").alias("n_chunks")
    )


def restored(docs: DataFrame, parts: int, bits: int = BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``_row, doc_id, bytes``: the texts put together again from their recipes and the table of chunks."""
    rows = cut(recipes(docs, parts, bits, least, most))
    step = F.posexplode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.size("recipe"), F.lit(1)), F.lit(parts)), lambda k: F.slice("recipe", k, parts))).alias("_at", "id")
    parted = rows.select("_row", "doc_id", step).join(chunk_table(docs, parts, bits, least, most).select("id", "chunk"), "id", "left")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", F.decode("chunk", "ISO-8859-1").alias("c")))), lambda x: F.coalesce(x["c"], F.lit(""))), "")
    return parted.groupBy("_row", "doc_id").agg(F.encode(whole, "ISO-8859-1").alias("bytes"))


CHECK_SQL = """
WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256,
    CAST(strlen(body) AS BIGINT) AS n_bytes
FROM bodies WINDOW same AS (PARTITION BY body)
"""
