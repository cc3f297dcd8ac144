"""Folding, ranking and share tables (AG*, WN*, TK*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.functions import columns as C
from curbline.functions.geometry import METRES_PER_MILE
from curbline.operators.scan import running_totals
from curbline.session import cut



def n_fatal(severity="severity") -> Column:
    return F.count_if(C.is_fatal(severity))


def dedup_incidents(person_rows: DataFrame, *, key: str = "incident_id", order: Sequence[str], severity: str = "injury") -> DataFrame:
    """One row per incident (AG1): worst severity, number of people, the first row's other fields.

    One aggregate with a map-side combine; a crash with very many rows is folded before it moves.
    """
    rest = [c for c in person_rows.columns if c not in (key, severity, *order)]
    first = F.min(F.struct(*order, *rest)).alias("_f")
    folded = person_rows.groupBy(key).agg(F.min(C.severity_rank(severity)).alias("_r"), F.count(F.lit(1)).alias("victims"), first)
    kept = [c for c in person_rows.columns if c not in (key, severity, order[0])]
    return folded.select(key, C.severity_label("_r").alias("severity"), "victims", *[F.col(f"_f.{c}").alias(c) for c in kept])


def dominant(df: DataFrame, by: Sequence[str], value: str, *, out: str = "dominant", share: str = "share", weight: Column | None = None) -> DataFrame:
    """Most frequent value per group and its share (AG3); ties go to the smallest value."""
    weight = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(weight.alias("_n"))
    top = counts.groupBy(*by).agg(F.sum("_n").alias("_all"), F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_t"))
    return top.select(*by, F.col("_t.v").alias(out), (-F.col("_t.n") / F.col("_all")).alias(share))


def modal_nonzero(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mode of known, non-zero values per group; the smallest on ties (AG4)."""
    return dominant(df.where(C.flag(F.col(value) != 0)), by, value, out=value, share="_s").drop("_s")


def corridor_ranking(incidents: DataFrame, *, street: str = "street", owner: str = "owner", mixed_below: float = 0.90) -> DataFrame:
    """Per street: totals, dominant owner, mixed flag, usual speed and lanes (AG2).

    Everything is a count per (street, value) first, so a street with a third of all
    incidents is a handful of partial rows when it is shuffled.
    """
    known = incidents.where(F.col(street).isNotNull())
    cells = known.groupBy(F.col(street).alias("street"), F.col(owner).alias("owner"), "speed", "lanes").agg(
        F.count(F.lit(1)).alias("total"), n_fatal().alias("fatal"), F.count_if(C.flag(F.col("severity") == C.SERIOUS)).alias("serious")
    )
    cells = cut(cells)  # incidents are read and folded once for the four parts below
    base = cells.groupBy("street").agg(*[F.sum(c).alias(c) for c in ("total", "fatal", "serious")])
    own = dominant(cells, ["street"], "owner", out="dominant_owner", share="owner_share", weight=F.col("total"))
    parts = base.join(own, "street", "left")
    for value in ("speed", "lanes"):
        some = cells.where(C.flag(F.col(value) != 0))
        parts = parts.join(dominant(some, ["street"], value, out=value, share="_s", weight=F.col("total")).drop("_s"), "street", "left")
    mixed = C.flag(F.col("owner_share") < mixed_below).alias("mixed_owner")
    return parts.select("street", "total", "fatal", "serious", "dominant_owner", mixed, "speed", "lanes")


def most_first(*columns: str, tie: str = "street") -> list[Column]:
    return [*[F.col(c).desc() for c in columns], F.col(tie).asc()]


def top(df: DataFrame, k: int, *columns: str, tie: str = "street") -> DataFrame:
    """The k best rows (TK1, TK2): Spark keeps k rows per task and merges them."""
    return df.orderBy(*most_first(*columns, tie=tie)).limit(k)


def owner_split(incidents: DataFrame, owner: str = "owner") -> DataFrame:
    """Counts and shares per owner (AG5): all, fatal, people. The total of the few owner rows
    is taken over those rows."""
    per = incidents.groupBy(F.col(owner).alias("owner")).agg(F.count(F.lit(1)).alias("crashes"), n_fatal().alias("fatal"), F.sum("victims").alias("people"))
    whole = Window.partitionBy(F.lit(1))  # one row per owner label
    return per.select(
        "owner", "crashes", "fatal", "people",
        *[C.percent(F.col(c), F.sum(c).over(whole)).alias(f"{c}_pct") for c in ("crashes", "fatal", "people")],
    )


def _scoped(cells: DataFrame) -> DataFrame:
    """Rows of a small count table once for "all" and, where ``_fatal``, once for "fatal"."""
    return cells.withColumn("scope", F.explode(F.when(F.col("_fatal"), F.array(F.lit("all"), F.lit("fatal"))).otherwise(F.array(F.lit("all")))))


def owner_split_range(incidents: DataFrame, owner: str = "owner", corner: str = "is_corner") -> DataFrame:
    """Surface split with its upper bound: corner cases moved to the state route (AG6)."""
    cells = incidents.groupBy(F.col(owner).alias("o"), C.flag(F.col(corner)).alias("c"), C.is_fatal().alias("_fatal")).agg(F.count(F.lit(1)).alias("n"))
    count = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0))
    per = _scoped(cells).groupBy("scope").agg(
        count(F.col("o").isin(*C.SURFACE_OWNERS)).alias("surface"), count(F.col("o") == C.CITY).alias("city"), count(F.col("o") == C.STATE_ROUTE).alias("state"),
        count(F.col("c")).alias("corner"), count(F.col("o").isin(*C.LIMITED_OWNERS)).alias("limited"),
    )
    return per.select(
        "*", C.percent("city", "surface").alias("city_pct"), C.percent("state", "surface").alias("state_pct"),
        C.percent(F.col("city") - F.col("corner"), "surface").alias("city_low_pct"), C.percent(F.col("state") + F.col("corner"), "surface").alias("state_high_pct"),
    )


def threshold_sensitivity(df: DataFrame, distance: str, limits: Sequence[float]) -> DataFrame:
    """Count and share within each limit (AG7); one pass, one row per limit."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(C.flag(F.col(distance) <= float(t))).alias(f"_{i}") for i, t in enumerate(limits)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("limit_m"), F.col(f"_{i}").alias("within")) for i, t in enumerate(limits)]))
    return counts.select("n", rows.alias("_r")).select("_r.limit_m", "_r.within", C.percent(F.col("_r.within"), "n").alias("within_pct"))


def by_category(df: DataFrame, fields: Sequence[str], *, fatal: bool = True) -> DataFrame:
    """Value counts of several fields in one pass, nulls kept (AG8, AG9): ``field, value, crashes``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    spread = df.select(pairs.alias("_p"), *(["severity"] if fatal else []))
    counts = [F.count(F.lit(1)).alias("crashes")] + ([n_fatal().alias("fatal")] if fatal else [])
    return spread.groupBy(F.col("_p.field").alias("field"), F.col("_p.value").alias("value")).agg(*counts)


def totals_by(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Crashes, deaths and people per group (AG9, AG10)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("crashes"), n_fatal().alias("fatal"), F.sum("victims").alias("people"))


def scoped_shares(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """How many (fatal) incidents meet each predicate, in rows ``scope, n, <test>, <test>_pct`` (AG11, AG15)."""
    cells = df.groupBy(C.is_fatal().alias("_fatal"), *[C.flag(t).alias(k) for k, t in tests.items()]).agg(F.count(F.lit(1)).alias("_n"))
    met = [F.coalesce(F.sum(F.when(F.col(k), F.col("_n"))), F.lit(0)).alias(k) for k in tests]
    per = _scoped(cells).groupBy("scope").agg(F.sum("_n").alias("n"), *met)
    return per.select("scope", "n", *[e for k in tests for e in (F.col(k), C.percent(k, "n").alias(f"{k}_pct"))])


def concentration(ranking: DataFrame) -> DataFrame:
    """Streets needed for half of all deaths; streets without, with one, with any (AG12).

    Streets with equal deaths are folded to one row per death count. With D deaths in all there
    are at most sqrt(2 D) different counts, so the running sum over them is small.
    """
    hist = ranking.groupBy("fatal").agg(F.count(F.lit(1)).alias("streets"), F.count_if(F.col("total") == 1).alias("single"))
    down = Window.partitionBy(F.lit(1)).orderBy(F.col("fatal").desc())
    run = hist.withColumn("_before", F.coalesce(F.sum(F.col("fatal") * F.col("streets")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = run.withColumn("_all", F.sum(F.col("fatal") * F.col("streets")).over(Window.partitionBy(F.lit(1))))
    # streets of this count whose running sum stays below half: before + k * fatal < all / 2
    room = F.col("_all") / 2 - F.col("_before")
    below = F.when(room <= 0, F.lit(0)).when(F.col("fatal") == 0, F.col("streets")).otherwise(F.least(F.col("streets"), F.ceil(room / F.nullif(F.col("fatal"), F.lit(0))) - 1))
    return run.withColumn("_below", below).agg(
        (F.sum("_below") + 1).cast("bigint").alias("streets_for_half"), F.sum("streets").alias("streets"), F.sum(F.when(F.col("fatal") == 0, F.col("streets")).otherwise(0)).alias("zero_fatal"),
        F.sum("single").alias("one_crash"), F.sum(F.when(F.col("fatal") > 0, F.col("streets")).otherwise(0)).alias("any_fatal"),
    )


def deaths_running(ranking: DataFrame) -> DataFrame:
    """Running deaths down the ranking (WN2), over any number of streets."""
    return running_totals(ranking.select("street", "total", "fatal"), most_first("fatal", "total"), {"running_fatal": F.col("fatal")})


def lethality(ranking: DataFrame, least: int = 5) -> DataFrame:
    return ranking.where(F.col("total") >= least).withColumn("fatal_share", F.col("fatal") / F.col("total"))


def profile_by_owner(incidents: DataFrame, ranking: DataFrame) -> DataFrame:
    """Streets, crashes, deaths, mean lanes and mean known speed per dominant owner (AG14)."""
    streets = ranking.groupBy("dominant_owner").agg(F.count(F.lit(1)).alias("streets"))
    # crashes are folded per street before they meet the ranking
    per = incidents.where(F.col("street").isNotNull()).groupBy("street").agg(
        F.count(F.lit(1)).alias("_n"), n_fatal().alias("_f"), F.sum("lanes").alias("_l"), F.count("lanes").alias("_ln"),
        F.sum(F.when(F.col("speed") > 0, F.col("speed"))).alias("_s"), F.count_if(C.flag(F.col("speed") > 0)).alias("_sn"),
    )
    rolled = per.join(ranking.select("street", "dominant_owner"), "street").groupBy("dominant_owner").agg(*[F.sum(c).alias(c) for c in ("_n", "_f", "_l", "_ln", "_s", "_sn")])
    return streets.join(rolled, "dominant_owner").select(
        "dominant_owner", "streets", F.col("_n").alias("crashes"), F.col("_f").alias("fatal"),
        F.bround(F.col("_l") / F.nullif(F.col("_ln"), F.lit(0)), 1).alias("mean_lanes"), F.bround(F.col("_s") / F.nullif(F.col("_sn"), F.lit(0)), 1).alias("mean_speed"),
    )


def ownership_mileage(segments: DataFrame, by: Sequence[str], length: str = "len") -> DataFrame:
    """Segments and miles per owner or rule (AG17)."""
    return segments.groupBy(*by).agg(F.count(F.lit(1)).alias("segments"), (F.sum(length) / METRES_PER_MILE).alias("miles"))


def lane_mileage(segments: DataFrame, length: str = "len") -> DataFrame:
    """Share of known length with four lanes or more, surface and all (AG18)."""
    known, surface = C.flag(F.col("lanes") > 0), ~C.is_grade_separated()
    total = lambda ok: F.coalesce(F.sum(F.when(ok, F.col(length))), F.lit(0.0))
    share = lambda part, whole: F.bround(100 * total(part) / F.nullif(total(whole), F.lit(0.0)), 1)
    return segments.agg(
        share(known & surface & C.is_wide(), known & surface).alias("wide_surface_pct"), share(known & C.is_wide(), known).alias("wide_all_pct"),
        share(known, F.lit(True)).alias("known_pct"), F.bround(total(known & surface) / METRES_PER_MILE).cast("bigint").alias("surface_miles"),
    )


def histogram(df: DataFrame, value: str, edges: Sequence[float] = (0, 0.1, 0.3, 0.6, 0.85, 1.01)) -> DataFrame:
    """Left-closed bins (AG19)."""
    label = F.lit(None).cast("string")
    pick = None
    for low, high in zip(edges, edges[1:]):
        inside = (F.col(value) >= low) & (F.col(value) < high)
        text = F.lit(f"[{low}, {high})")
        pick = F.when(inside, text) if pick is None else pick.when(inside, text)
    return df.select((label if pick is None else pick).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def transitions(df: DataFrame, before: str, after: str) -> DataFrame:
    """Old to new label counts (AG20)."""
    return df.groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(F.count(F.lit(1)).alias("n"))


def mix_by_keyword(df: DataFrame, name: str, labels: Sequence[str], keywords: Sequence[str]) -> DataFrame:
    """Label mix of rows whose name contains whole words (AG21). Names are split into runs of as many
    words as the keywords have; labels are folded per name first."""
    per = df.groupBy(F.upper(F.col(name)).alias("_name"), *labels).agg(F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_w", F.split(F.col("_name"), r"[^A-Z0-9_]+"))

    def runs(size: int) -> Column:
        starts = F.when(F.size("_w") >= size, F.sequence(F.lit(1), F.size("_w") - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("_w", i, F.lit(size)), " "))

    sizes = sorted({len(k.split()) for k in keywords})
    words = per.withColumn("keyword", F.explode(F.array_distinct(F.concat(*[runs(k) for k in sizes])))) if sizes else per.withColumn("keyword", F.lit("")).limit(0)
    return words.where(F.col("keyword").isin(*keywords)).groupBy("keyword", *labels).agg(F.sum("_n").alias("n"))


def trailing_windows(incidents: DataFrame, by: Sequence[str], months: Sequence[int] = (12, 6, 3, 1), date: str = "incident_date") -> DataFrame:
    """Incidents and deaths in all data and the last months, counted back from the data's last
    date (WN7). Months clamp at month end."""
    last = F.lit(incidents.agg(F.max(date)).first()[0])
    inside = lambda m: C.flag(F.col(date) >= F.add_months(last, -m))
    cols = [F.count(F.lit(1)).alias("all_n"), n_fatal().alias("all_fatal")]
    for m in months:
        cols += [F.count_if(inside(m)).alias(f"m{m}_n"), F.count_if(inside(m) & C.is_fatal()).alias(f"m{m}_fatal")]
    return incidents.groupBy(*by).agg(*cols)


def coverage_dates(incidents: DataFrame, date: str = "incident_date") -> DataFrame:
    return incidents.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def density_grid(points: DataFrame, cell: float = 500.0) -> DataFrame:
    """Incidents and deaths per square (AG35)."""
    return points.groupBy(F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy")).agg(F.count(F.lit(1)).alias("crashes"), n_fatal().alias("fatal"))


def name_quality_flags(names: DataFrame, street: str = "street", type_tokens: Sequence[str] = tuple(C.SUFFIX_NAMES)) -> DataFrame:
    """Doubtful street names (AG36): a bare type word, an interstate, directional halves of one road."""
    words = F.split(F.upper(F.col(street)), r"\s+")
    bare = (F.size(words) == 1) & F.get(words, F.lit(0)).isin(*type_tokens)
    inter = F.upper(F.col(street)).startswith("INTERSTATE") | F.upper(F.col(street)).startswith("I-")
    d = ["N", "S", "E", "W"]
    head = F.when(F.get(words, F.lit(0)).isin(*d), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))).otherwise(words)
    base = F.when(F.get(head, F.size(head) - 1).isin(*d), F.slice(head, F.lit(1), F.greatest(F.size(head) - 1, F.lit(0)))).otherwise(head)
    flagged = names.select(F.col(street).alias("street"), bare.alias("_bare"), inter.alias("_inter"), F.array_join(base, " ").alias("base"))
    single = flagged.select("street", F.when(F.col("_bare"), F.lit("type word only")).when(F.col("_inter"), F.lit("interstate")).alias("flag")).where("flag is not null")
    many = flagged.groupBy("base").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    split = flagged.join(many, "base").select("street", F.lit("directional split").alias("flag"))
    return single.unionByName(split)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts, one row per table (AG39)."""
    counts = [df.select(F.lit(name).alias("table_name")).groupBy("table_name").agg(F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def exploded_signal_share(nodes: DataFrame) -> DataFrame:
    """Junctions of each street and how many are signalized (AG26, AG40)."""
    per = nodes.select(F.explode("streets").alias("street"), "signalized").groupBy("street").agg(F.count(F.lit(1)).alias("junctions"), F.count_if("signalized").alias("signalized"))
    return per.withColumn("signalized_pct", C.percent("signalized", "junctions"))


def junction_totals(nodes: DataFrame, attributed: DataFrame, node: str = "intersection_node_id") -> DataFrame:
    """Crashes and deaths per junction, 0 where none (AG24)."""
    per = attributed.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node_id")).agg(F.count(F.lit(1)).alias("crashes"), n_fatal().alias("deaths"))
    return nodes.join(per, "node_id", "left").fillna(0, ["crashes", "deaths"])


def snap_quality(df: DataFrame, distance: str = "dist", far: float = 40.0) -> DataFrame:
    """Mean, largest and far-off snap distances (AG16); the median comes from ``percentiles``."""
    d = F.col(distance)
    return df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_m"), F.max(d).alias("max_m"), F.count_if(C.flag(d > far)).alias("far"), C.percent(F.count_if(C.flag(d > far)), F.count(d)).alias("far_pct"))


def ambiguity_kinds(status: DataFrame, nodes: DataFrame, road_m: DataFrame, *, off_road: float = 20.0) -> DataFrame:
    """Why field and place disagree about a junction (AG25): one row.

    ``not_reported``: not reported at a junction, yet within reach of a covered one. ``not_found``: reported at one, but
    none is in reach. ``off_road``: reported at a junction and farther than that from any through-road (``road_m``:
    incident_id, dist).
    """
    covered = nodes.where("on_covered").select(F.col("node_id").alias("intersection_node_id"), F.lit(True).alias("_covered"))
    both = status.join(covered, "intersection_node_id", "left").join(road_m.select("incident_id", F.col("dist").alias("_road")), "incident_id", "left")
    at, lost = F.col("at_intersection"), F.col("intersection_node_id").isNull()
    return both.agg(
        F.count_if(~at & C.flag(F.col("_covered"))).alias("not_reported"), F.count_if(at & lost).alias("not_found"), F.count_if(at & C.flag(F.col("_road") > off_road)).alias("off_road"),
        F.count_if(at & lost & C.flag(F.col("_road") > off_road)).alias("not_found_off_road"),
    )
