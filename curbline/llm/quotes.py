"""Chat formatting by quotation linking: messages find what they quote, and conversations follow the replies.

Every message is split into its own lines and quoted passages by the number of leading '>' marks (nested levels); lines
such as "On ... wrote:" in front of a quote are dropped. Quoted passages are normalised (case, white space) and hashed as
a whole, then by paragraph and by line, and joined to hashes of what other messages say themselves. A quote belongs to
the first message that says it: in its own conversation if there is an earlier one, else in an earlier conversation.
The parent of a message is what its outermost linked quote belongs to, else the message before it in its conversation.
Threads are the trees of parents; inside a thread messages are ordered by depth, then by conversation and turn, so that
each follows its parent. Originals are folded per hash before the join, so that a passage that very many messages say or
quote makes no pairs; roots are found by pointer doubling.

Defined results: null and empty texts are messages without words, and neither quote nor can be quoted; a quote that nobody
said is dropped and not linked; null conv_ids form one conversation, before all others; repeated rows are messages of
their own, in order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.llm.common import numbered, python_batches
from curbline.session import cut

_marks = re.compile(r"[ \t]*(?:>[ \t]*)+").match
_wrote = re.compile(r"\s*On\b.*\bwrote:\s*$|.*\bschrieb:\s*$|.*\ba écrit\s*:\s*$|.*\bescribió:\s*$").match


def _hash(text: str) -> int | None:
    plain = " ".join(text.lower().split())
    return int.from_bytes(blake2b(plain.encode(), digest_size=8).digest(), "little", signed=True) if plain else None


def pieces(lines: list[str]) -> list[int]:
    """Hashes of a passage as a whole, of its paragraphs and of its lines, the longer first."""
    paragraphs = re.split(r"\n\s*\n", "\n".join(lines))
    parts = ["\n".join(lines), *sorted(paragraphs, key=len, reverse=True), *sorted(lines, key=len, reverse=True)]
    return [h for h in dict.fromkeys(map(_hash, parts)) if h is not None]


def parse(text: str | None) -> tuple[str, list[int], list[tuple[int, int, int]], int]:
    """Own text, hashes of own passages, quotes as (level, order, hash), number of quoted passages."""
    own: list[str] = []
    runs: list[tuple[int, list[str]]] = []
    last = 0
    for line in re.split(r"\r?\n", text or ""):
        mark = _marks(line)
        level = mark.group().count(">") if mark else 0
        if level:
            if last == 0 and own and _wrote(own[-1]):
                own.pop()
            if level == last:
                runs[-1][1].append(line[mark.end() :])
            else:
                runs.append((level, [line[mark.end() :]]))
        else:
            own.append(line)
        last = level
    quotes, order = [], 0
    for level, lines in runs:
        for h in pieces(lines):
            quotes.append((level, order, h))
            order += 1
    return "\n".join(own).strip("\n") if runs else text or "", pieces(own), quotes, len(runs)


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` plus own, said, quotes and n_quotes."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parse(t) for t in batch]
            yield pd.DataFrame({"own": [f[0] for f in found], "said": [f[1] for f in found], "quotes": [[{"level": a, "place": b, "hash": c} for a, b, c in f[2]] for f in found], "n_quotes": [f[3] for f in found]})

    python_batches(messages.sparkSession)
    out = F.pandas_udf(run, "own string, said array<long>, quotes array<struct<level:int,place:int,hash:long>>, n_quotes int")
    return messages.withColumn("_p", out("text")).select(*messages.columns, "_p.*")


def roots(parents: DataFrame) -> DataFrame:
    """``id, root, depth`` from ``id, parent`` (null for roots; parents are smaller than ids), by pointer doubling."""
    top = F.col("parent").isNull()
    start = cut(parents.select("id", F.coalesce("parent", "id").alias("up"), (~top).cast("bigint").alias("depth"), top.alias("done")))
    settled, active = start.where("done"), start.where(~F.col("done"))
    while not active.isEmpty():
        # up of a settled row is its root; whoever points to one is settled too, the others jump on
        ahead = settled.unionByName(active).select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        moved = cut(active.join(ahead, "up").select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done")))
        settled, active = settled.unionByName(moved.where("done")), moved.where(~F.col("done"))
    return settled.select("id", F.col("up").alias("root"), "depth")


def threads(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, reply_to_conv, reply_to_turn, by_quote, thread_conv, thread_turn, depth, position."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.xxhash64("role", "text")]
    rows = cut(parsed(numbered(conversations.select("conv_id", "turn", "role", "text"), order, "id")))
    said = rows.select("id", "conv_id", F.explode("said").alias("hash"))
    inside = cut(said.groupBy("hash", "conv_id").agg(F.min("id").alias("near")))
    anywhere = inside.groupBy("hash").agg(F.min("near").alias("far"))
    quoted = rows.select("id", "conv_id", F.explode("quotes").alias("q")).select("id", "conv_id", "q.*")
    near = inside.withColumnsRenamed({"hash": "_h", "conv_id": "_c"})
    found = quoted.join(near, (quoted["hash"] == near["_h"]) & quoted["conv_id"].eqNullSafe(near["_c"]), "left").join(anywhere, "hash", "left")
    source = F.when(F.col("near") < F.col("id"), F.col("near")).when(F.col("far") < F.col("id"), F.col("far"))
    links = found.withColumn("source", source).where(F.col("source").isNotNull()).groupBy("id").agg(F.min(F.struct("level", "place", "source"))["source"].alias("quoted"))
    before = rows.select((F.col("id") + 1).alias("id"), F.col("conv_id").alias("_prev"))
    linked = rows.select("id", "conv_id").join(before, "id", "left").join(links, "id", "left")
    parents = cut(linked.select("id", "quoted", F.coalesce("quoted", F.when((F.col("id") > 1) & F.col("_prev").eqNullSafe(F.col("conv_id")), F.col("id") - 1)).alias("parent")))
    trees = numbered(roots(parents), [F.col("root"), F.col("depth"), F.col("id")], "_place")
    first = trees.groupBy("root").agg((F.min("_place") - 1).alias("_first"))
    trees = trees.join(first, "root").select("id", "root", "depth", (F.col("_place") - F.col("_first")).alias("position"))
    names = rows.select("id", "conv_id", "turn")
    out = rows.drop("said", "quotes", "text").join(parents, "id").join(trees, "id")
    out = out.join(names.select(F.col("id").alias("parent"), F.col("conv_id").alias("reply_to_conv"), F.col("turn").alias("reply_to_turn")), "parent", "left")
    out = out.join(names.select(F.col("id").alias("root"), F.col("conv_id").alias("thread_conv"), F.col("turn").alias("thread_turn")), "root")
    return out.select("conv_id", "turn", "role", F.col("own").alias("text"), "n_quotes", "reply_to_conv", "reply_to_turn", F.col("quoted").isNotNull().alias("by_quote"), "thread_conv", "thread_turn", "depth", "position")
