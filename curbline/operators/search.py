"""Street, junction and alias tables, and batch name search over them (AG27, AG28, SE1-SE7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.functions import columns as C
from curbline.session import cut

# Catch-all street names that are no place to look for.
GENERIC_NAMES = ("ALLEY", "PRIVATE DR")
TOP = 8


def street_index(segments: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per street: display name, base form, bounding box, length, owner by length, crashes (AG27)."""
    named = segments.where(F.trim("street") != "").where(~F.col("street").isin(*GENERIC_NAMES))
    per = named.withColumn("_code", C.owner_code("owner")).groupBy("street", "_code").agg(
        F.min(F.least("x1", "x2")).alias("x_min"), F.min(F.least("y1", "y2")).alias("y_min"),
        F.max(F.greatest("x1", "x2")).alias("x_max"), F.max(F.greatest("y1", "y2")).alias("y_max"), F.sum("len").alias("_len"),
    )
    best = F.min(F.struct((-F.round("_len", 6)).alias("l"), F.col("_code").alias("c"))).getField("c").alias("owner_code")
    box = per.groupBy("street").agg(F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"), F.sum("_len").alias("length_m"), best)
    crashes = incidents.groupBy("street").agg(F.count(F.lit(1)).alias("crashes"))
    out = box.join(crashes, "street", "left").fillna(0, ["crashes"])
    return out.withColumns({"display": C.display_name("street"), "base": C.base_form("street")})


def junction_index(nodes: DataFrame) -> DataFrame:
    """Junctions for search: display name, status y/n/u, street bases in order."""
    status = F.when(F.col("signalized"), F.lit("y")).when(F.col("on_covered"), F.lit("n")).otherwise(F.lit("u"))
    shown = F.array_join(F.transform("streets", lambda s: C.display_name(s)), " & ")
    return nodes.withColumns({"display": shown, "status": status})


def junction_streets(nodes: DataFrame) -> DataFrame:
    """One row per junction and street: ``node_id, k, street, base``."""
    spread = nodes.select("node_id", F.posexplode("streets").alias("k", "street"))
    return spread.withColumn("base", C.base_form("street"))


# The forms in which people write a state route, a federal one, and the shown name of the latter.
STATE_FORMS = ("sr", "state route", "route", "highway", "hwy")
US_FORMS = ("us %s", "us highway %s", "highway %s", "hwy %s", "us-%s")
US_NAME = r"(?i)^(?:N |S |E |W )?Us Highway (\d+)$"


def alias_groups(routes: DataFrame, *, state: str) -> DataFrame:
    """Query forms of route designations and the streets that carry them (AG28): ``alias_key, member``.

    ``state``: the abbreviation that is also written before a route's number.
    """
    shown = C.display_name(F.concat_ws(" ", *[F.when(C.clean(c) != "", C.clean(c)) for c in ("predir", "name", "type")]))
    named = routes.select(C.clean("altname").alias("alt"), shown.alias("member")).where("alt <> '' and member <> ''").distinct()
    digits = F.col("alt").rlike("^[0-9]+$")
    numbered = F.transform(F.array(*[F.lit(p) for p in (*STATE_FORMS, state)]), lambda p: F.concat_ws(" ", p, F.col("alt")))
    forms = F.when(digits, numbered).otherwise(F.array(F.col("alt"), C.base_form("alt")))
    us = F.regexp_extract("member", US_NAME, 1)
    shapes = F.array(*[F.format_string(p, F.col("_us")) for p in US_FORMS])
    # the "us" forms key the whole group of the designation
    per_alt = named.select("alt", us.alias("_us")).where("_us <> ''").distinct().withColumn("form", F.explode(shapes)).select("alt", "form")
    keys = named.select("alt", F.explode(forms).alias("form")).distinct().unionByName(per_alt)
    out = named.join(keys, "alt").select(F.lower(C.squeeze("form")).alias("alias_key"), "member")
    return out.where("alias_key <> ''").distinct()


def split_queries(queries: DataFrame, *, query_id: str = "query_id", text: str = "q") -> DataFrame:
    """Parts of each query (SE1): ``query_id, part_no, raw, parts``; two or more mean a junction."""
    parts = F.filter(F.transform(F.split(F.trim(F.col(text)), r"(?i)\s*(?:\band\b|&|@)\s*"), lambda p: F.trim(p)), lambda p: p != "")
    spread = queries.withColumn("_p", parts).select(query_id, F.size("_p").alias("parts"), F.posexplode("_p").alias("part_no", "raw"))
    return spread.select(query_id, "part_no", "raw", "parts")


def _shortened(word: Column, deletions: int) -> Column:
    """The word and all forms with up to ``deletions`` letters left out (1 or 2)."""

    def less(w):
        at = F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1)))
        return F.transform(at, lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))

    once = less(word)
    forms = F.concat(F.array(word), once)
    if deletions == 2:
        forms = F.concat(forms, F.flatten(F.transform(once, less)))
    return F.array_distinct(forms)


def _spelled(parts: DataFrame, words: DataFrame, distance: int) -> DataFrame:
    """``part, base`` of parts and words at exactly this edit distance (1 or 2), given that none is nearer."""
    asked = parts.withColumn("_f", F.explode(_shortened(F.col("part"), distance)))
    held = words.withColumn("_f", F.explode(_shortened(F.col("base"), distance)))
    pairs = asked.join(held, "_f").select("part", "base").distinct()
    return pairs.where(F.levenshtein("part", "base") == distance)


def match_parts(parts: DataFrame, vocabulary: DataFrame, aliases: DataFrame) -> DataFrame:
    """Candidate base forms per distinct part text (SE2): ``raw, base, quality``.

    exact or alias 4, prefix 3, fuzzy 2 (best distance only), contains 1. Prefixes, substrings
    and near spellings are all equi joins: on prefixes, on substrings, and on forms with letters
    left out, which two words within edit distance d must share. As only the best distance counts,
    a part that is itself a word asks for no other spelling, and forms with two letters left out
    are built for those parts alone that nothing at distance 1 answers. No candidate is capped.
    """
    raw = parts.select("raw").distinct().withColumns({"key": F.lower(C.squeeze("raw")), "part": C.base_form("raw")}).where("part <> ''")
    words = vocabulary.select("base").distinct().where("base <> ''")
    grouped = aliases.select("alias_key", C.base_form("member").alias("base")).distinct()
    full = raw.join(grouped, raw["key"] == grouped["alias_key"]).select("raw", "base")
    rest = raw.join(grouped.select(F.col("alias_key").alias("key")).distinct(), "key", "left_anti")
    short = rest.join(grouped, rest["part"] == grouped["alias_key"]).select("raw", "base")
    exact = raw.join(words, raw["part"] == words["base"]).select("raw", "base")
    found = full.unionByName(short).unionByName(exact).withColumn("quality", F.lit(4))
    starts = words.withColumn("part", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("base") - 1, F.lit(1))), lambda n: F.substring("base", F.lit(1), n))))
    found = found.unionByName(raw.join(starts.where(F.col("part") != F.col("base")), "part").select("raw", "base", F.lit(3).alias("quality")))
    inner = words.where(F.length("base") >= 6).withColumn("_i", F.explode(F.sequence(F.lit(2), F.length("base") - 4)))
    inner = inner.withColumn("_n", F.explode(F.sequence(F.lit(5), F.length("base") - F.col("_i") + 1)))
    inner = inner.select("base", F.col("base").substr(F.col("_i"), F.col("_n")).alias("part")).distinct()
    found = found.unionByName(raw.join(inner, "part").select("raw", "base", F.lit(1).alias("quality")))
    odd = raw.where(F.length("part") >= 4).select("part").distinct().join(words.select(F.col("base").alias("part")), "part", "left_anti")
    one = cut(_spelled(odd, words, 1))
    two = _spelled(odd.where(F.length("part") >= 6).join(one.select("part").distinct(), "part", "left_anti"), words, 2)
    near = raw.join(one.unionByName(two), "part").select("raw", "base", F.lit(2).alias("quality"))
    found = found.unionByName(near)
    return cut(found.groupBy("raw", "base").agg(F.max("quality").alias("quality")))  # read several times


def _ranked(cands: DataFrame, query_id: str, order: list[Column], limit: int) -> DataFrame:
    place = Window.partitionBy(query_id).orderBy(*order)
    return cands.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit)


def street_candidates(parts: DataFrame, matches: DataFrame, streets: DataFrame, *, query_id: str = "query_id", limit: int = TOP, directions: bool = False) -> DataFrame:
    """Streets for one-part queries, best first (SE3); ``directions`` adds 0.5 where the query's
    direction agrees and marks a tie of the top two when it gave none (SE5)."""
    single = parts.where("parts = 1").select(query_id, "raw")
    # streets of one base differ in nothing but these (and their direction), so only the first few can be answers
    group = ["base", *(["_side"] if directions else [])]
    first = Window.partitionBy(*group).orderBy(F.col("crashes").desc(), F.round("length_m", 3).desc(), F.col("street"))
    few = streets.select("street", "base", "crashes", "length_m", *([C.direction_of("street").alias("_side")] if directions else []))
    few = few.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= max(limit, 2)).select("street", "base", "crashes", "length_m")
    cands = single.join(matches, "raw").join(few, "base")
    cands = cands.withColumn("q", F.col("quality").cast("double"))
    if directions:
        cands = cands.withColumn("_d", C.direction_of("raw"))
        cands = cands.withColumn("q", F.col("q") + F.when(C.flag(F.col("_d") == C.direction_of("street")), F.lit(0.5)).otherwise(F.lit(0.0)))
    order = [F.col("q").desc(), F.col("crashes").desc(), F.round("length_m", 3).desc(), F.col("street")]
    out = _ranked(cands, query_id, order, max(limit, 2))
    if directions:
        per = Window.partitionBy(query_id).orderBy("place")
        tie = lambda other: C.flag(F.col("_d").isNull() & (other("q") == F.col("q")) & (other("base") == F.col("base")))
        ahead, behind = tie(lambda c: F.lead(c).over(per)), tie(lambda c: F.lag(c).over(per))
        out = out.withColumn("ambiguous", ((F.col("place") == 1) & ahead) | ((F.col("place") == 2) & behind)).drop("_d")
    return out.where(F.col("place") <= limit).drop("quality", "raw")


def junction_candidates(parts: DataFrame, matches: DataFrame, node_streets: DataFrame, nodes: DataFrame, *, query_id: str = "query_id", limit: int = TOP, directions: bool = False) -> DataFrame:
    """Junctions where every part matches a street of its own (SE4), parts choosing in order.

    ``parts`` may also hold one-part queries (SE6). Queries of the same parts are answered once. Only junctions on a
    street of the query's rarest part (by its hits at junctions) are looked at, and of those all streets are: a junction
    that this part does not match is no answer. The rows of one (query, junction) pair are its few streets times its few parts.
    """
    asked = parts.groupBy(query_id, "parts").agg(F.array_sort(F.collect_set(F.struct("part_no", "raw"))).alias("_texts"))
    texts = cut(asked.select("parts", "_texts").distinct().withColumn("_ask", F.monotonically_increasing_id()))
    spread = texts.select("_ask", "parts", F.inline("_texts"))
    slim = node_streets.select("node_id", "k", "base", "street")
    reach = matches.join(slim.groupBy("base").agg(F.count(F.lit(1)).alias("_n")), "base").groupBy("raw").agg(F.sum("_n").alias("_n"))
    counted = spread.join(reach, "raw").groupBy("_ask", "parts", "part_no").agg(F.sum("_n").alias("_n"))
    rarest = counted.groupBy("_ask", "parts").agg(F.min(F.struct("_n", "part_no")).getField("part_no").alias("part_no"), F.count(F.lit(1)).alias("_seen")).where(F.col("_seen") == F.col("parts"))
    first = spread.join(rarest.select("_ask", "part_no"), ["_ask", "part_no"]).select("_ask", "raw").join(matches, "raw")
    at = first.join(slim.select("base", "node_id"), "base").select("_ask", "node_id").distinct()
    quality = F.col("quality").cast("double")
    hits = at.join(slim, "node_id").join(spread, "_ask").join(matches, ["raw", "base"])
    if directions:
        quality = quality + F.when(C.flag(C.direction_of("raw") == C.direction_of("street")), F.lit(0.5)).otherwise(F.lit(0.0))
    hits = hits.select("_ask", "parts", "node_id", F.struct("part_no", (-quality).alias("nq"), "k").alias("h"))
    both = hits.groupBy("_ask", "node_id", "parts").agg(F.array_sort(F.collect_list("h")).alias("_h"), F.count_distinct("h.part_no").alias("_seen"))
    both = both.where(F.col("_seen") == F.col("parts"))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(-1).alias("last"), F.lit(0).alias("taken"), F.lit(0.0).alias("q"))

    def pick(acc, h):
        free = (h["part_no"] != acc["last"]) & ~F.array_contains(acc["used"], h["k"])
        take = F.struct(F.array_append(acc["used"], h["k"]).alias("used"), h["part_no"].alias("last"), (acc["taken"] + 1).alias("taken"), (acc["q"] - h["nq"]).alias("q"))
        return F.when(free, take).otherwise(acc)

    scored = both.withColumn("_g", F.aggregate("_h", start, pick)).where(F.col("_g.taken") == F.col("parts"))
    out = scored.select("_ask", "node_id", F.col("_g.q").alias("q")).join(nodes.select("node_id", "crashes"), "node_id")
    best = _ranked(out, "_ask", [F.col("q").desc(), F.col("crashes").desc(), F.col("node_id")], limit)
    return asked.join(texts, ["parts", "_texts"]).select(query_id, "_ask").join(best, "_ask").select(query_id, "node_id", "q", "crashes", "place")


def locate(queries: DataFrame, streets: DataFrame, node_streets: DataFrame, nodes: DataFrame, aliases: DataFrame, *, query_id: str = "query_id", text: str = "q") -> DataFrame:
    """Up to eight candidates per query: streets, junctions, or the fallback to junctions (SE1-SE6)."""
    parts = split_queries(queries, query_id=query_id, text=text)
    words = streets.select("base").unionByName(node_streets.select("base"))
    matches = match_parts(parts, words, aliases)
    on_street = cut(street_candidates(parts, matches, streets, query_id=query_id))
    at_node = junction_candidates(parts.where("parts >= 2"), matches, node_streets, nodes, query_id=query_id)
    lost = parts.where("parts = 1").join(on_street.select(query_id).distinct(), query_id, "left_anti")
    fallback = junction_candidates(lost, matches, node_streets, nodes, query_id=query_id)
    as_street = on_street.select(query_id, F.lit("street").alias("kind"), "street", F.lit(None).cast("bigint").alias("node_id"), "q", "place")
    as_node = at_node.unionByName(fallback).select(query_id, F.lit("intersection").alias("kind"), F.lit(None).cast("string").alias("street"), "node_id", "q", "place")
    return as_street.unionByName(as_node)


def hit_rate(expected: DataFrame, answers: DataFrame, *, query_id: str = "query_id", street: str = "street") -> DataFrame:
    """Share of labelled queries whose expected street is among the candidates (SE7)."""
    found = answers.select(query_id, street).where(F.col(street).isNotNull()).distinct().withColumn("_hit", F.lit(1))
    return expected.join(found, [query_id, street], "left").agg(F.count(F.lit(1)).alias("queries"), F.count("_hit").alias("hits"), C.percent(F.count("_hit"), F.count(F.lit(1))).alias("hit_pct"))
