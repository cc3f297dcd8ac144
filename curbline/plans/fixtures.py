"""Road-safety views derived from the given star-schema tables.

The column expressions are plain SQL that means the same in Spark and in ANSI engines, so
each view has one definition. ``n`` (the lattice size) is a number in Spark and a one-row
view in the check SQL.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.session import tune

PERSON_ROWS = """
l_orderkey AS incident_id
l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS person_seq
CASE WHEN l_quantity <= 3 THEN 'Fatal' WHEN l_quantity <= 10 THEN 'Suspected Serious Injury' WHEN l_quantity <= 22 THEN 'Suspected Minor Injury' WHEN l_quantity <= 40 THEN 'Possible Injury' WHEN l_quantity <= 45 THEN 'No Injury' WHEN l_quantity <= 48 THEN 'No Apparent Injury' ELSE 'Other' END AS injury
CASE l_linenumber WHEN 1 THEN 'Intersection-In Crosswalk' WHEN 2 THEN 'Not Intersection-On Roadway Not In Crosswalk' WHEN 3 THEN 'Intersection-On Roadway Crosswalk Not Available' WHEN 4 THEN 'Not on Roadway' WHEN 5 THEN 'Not Intersection-On Roadway Crosswalk not Available' WHEN 6 THEN 'Outside Traffic' ELSE NULL END AS location
CASE l_returnflag WHEN 'R' THEN 'Daylight' WHEN 'A' THEN 'Dark-Lighted' ELSE CASE WHEN l_linestatus = 'F' THEN 'Dark-Not Lighted' ELSE 'Dusk' END END AS light
CAST(l_shipdate AS DATE) AS incident_date
CASE WHEN l_suppkey % 50 = 0 THEN NULL WHEN l_suppkey % 50 = 1 THEN 0e0 ELSE 34.95e0 + ((l_partkey * 7919 + l_orderkey * 31) % 50000) / 1e5 END AS lat
CASE WHEN l_suppkey % 50 = 0 THEN NULL WHEN l_suppkey % 50 = 1 THEN 0e0 ELSE -90.35e0 + ((l_partkey * 6007 + l_orderkey * 53) % 80000) / 1e5 END AS lon
((l_partkey * 131 + l_orderkey * 17) % (n * 200)) + 0.25e0 AS x
((l_partkey * 71 + l_orderkey * 29) % (n * 200)) + 0.75e0 AS y
""".strip().split("\n")

_LATTICE = """
p_partkey AS seg_id
p_size
p_partkey % 2 AS o
CAST(floor(p_partkey / 2e0) AS BIGINT) AS k
n
""".strip().split("\n")
_PLACED = """
seg_id
p_size
o
n
CAST(floor(k / CAST(n AS DOUBLE)) AS BIGINT) AS ln
k % n AS st
""".strip().split("\n")
SEGMENTS = """
seg_id
CASE WHEN st * 2 < n THEN 'W' ELSE 'E' END AS predir
CASE WHEN o = 0 THEN concat('HICKORY', CAST(ln AS VARCHAR(20))) ELSE concat('VALLEY', CAST(ln AS VARCHAR(20))) END AS name
CASE WHEN o = 0 THEN 'AVE' ELSE 'ST' END AS type
CASE WHEN ln % 9 = 0 THEN 'S1100' WHEN ln % 9 = 1 THEN 'S1630' WHEN ln % 3 = 2 THEN 'S1200' ELSE 'S1400' END AS mtfcc
p_size % 8 AS lanes
CASE WHEN p_size % 10 = 0 THEN 0 ELSE 25 + 5 * (p_size % 7) END AS speed
ln
o
CAST(CASE WHEN o = 0 THEN st * 200 ELSE ln * 200 + ((st * 5 + ln * 3) % 5) * 4 END AS DOUBLE) AS x1
CAST(CASE WHEN o = 0 THEN ln * 200 + ((st * 7 + ln * 3) % 5) * 4 ELSE st * 200 END AS DOUBLE) AS y1
CAST(CASE WHEN o = 0 THEN (st + 1) * 200 ELSE ln * 200 + (((st + 1) * 5 + ln * 3) % 5) * 4 END AS DOUBLE) AS x2
CAST(CASE WHEN o = 0 THEN ln * 200 + (((st + 1) * 7 + ln * 3) % 5) * 4 ELSE (st + 1) * 200 END AS DOUBLE) AS y2
""".strip().split("\n")
# street: the display key; the fixture has no suffix direction and no label
STREETS = """
seg_id
predir
name
type
mtfcc
lanes
speed
ln
o
x1
y1
x2
y2
concat(predir, ' ', name, ' ', type) AS street
concat(predir, ' ', name) AS name_key
""".strip().split("\n")
ROUTES = """
seg_id AS route_id
predir
CASE WHEN ln % 8 = 2 THEN name ELSE concat('SR', CAST(ln AS VARCHAR(20))) END AS name
type
CAST(ln AS VARCHAR(20)) AS altname
x1
y1 + (ln % 13) AS y1
x2
y2 + (ln % 13) AS y2
""".strip().split("\n")
ROUTES_WHERE = "o = 0 AND ln % 4 = 2"
SIGNALS = """
c_custkey AS signal_id
CASE WHEN c_custkey % 3 = 0 THEN 'Push Button' ELSE 'Pedestrian Signal' END AS kind
concat('SR', CAST(c_nationkey % 6 AS VARCHAR(20))) AS route_number
CAST((c_custkey % n) * 200 + (c_custkey * 7) % 41 - 20 AS DOUBLE) AS x
CAST((CAST(floor(c_custkey / CAST(n AS DOUBLE)) AS BIGINT) % n) * 200 + (c_custkey * 11) % 41 - 20 AS DOUBLE) AS y
""".strip().split("\n")
TAGGED = """
signal_id
x
y
CASE signal_id % 5 WHEN 0 THEN 'zebra' WHEN 1 THEN 'lines' WHEN 2 THEN 'no' WHEN 3 THEN '' ELSE NULL END AS markings
CASE signal_id % 7 WHEN 0 THEN 'traffic_signals' WHEN 1 THEN 'Traffic_Signals' ELSE 'marked' END AS crossing
CASE signal_id % 11 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE NULL END AS signals
CASE signal_id % 13 WHEN 0 THEN 'traffic_signals' ELSE 'crossing' END AS highway
""".strip().split("\n")
SIDEWALKS = """
seg_id AS walk_id
CASE WHEN seg_id % 5 = 0 THEN 0 ELSE 3 + CAST(seg_id % 4 AS INT) END AS width
x1 + o * (7 + seg_id % 20) AS x1
y1 + (1 - o) * (7 + seg_id % 20) AS y1
x2 + o * (7 + seg_id % 20) AS x2
y2 + (1 - o) * (7 + seg_id % 20) AS y2
""".strip().split("\n")
SIDEWALKS_WHERE = "seg_id % 3 = 0"
SEARCHES = """
c_custkey AS query_id
CASE c_custkey % 6 WHEN 0 THEN concat('hickory', CAST(c_custkey % n AS VARCHAR(20))) WHEN 1 THEN concat('W Hickory', CAST(c_custkey % n AS VARCHAR(20)), ' Ave') WHEN 2 THEN concat('hickroy', CAST(c_custkey % n AS VARCHAR(20))) WHEN 3 THEN concat('Hickory', CAST(c_custkey % n AS VARCHAR(20)), ' and valley', CAST(c_custkey % 7 AS VARCHAR(20))) WHEN 4 THEN concat('vally', CAST(c_custkey % n AS VARCHAR(20)), ' @ hickory2') ELSE concat('sr ', CAST(c_custkey % n AS VARCHAR(20))) END AS q
""".strip().split("\n")
# Octagon corners as shares of the lattice side, in order.
OCTAGON = ((0.3, 0.1), (0.7, 0.1), (0.9, 0.3), (0.9, 0.7), (0.7, 0.9), (0.3, 0.9), (0.1, 0.7), (0.1, 0.3))


class Tables:
    """The derived views of one data directory as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def n(self) -> int:
        return math.ceil(math.sqrt(self.read("part").count() / 2.0))

    def _sized(self, name: str) -> DataFrame:
        return self.read(name).withColumn("n", F.lit(self.n).cast("bigint"))

    @cached_property
    def person_rows(self) -> DataFrame:
        return self._sized("lineitem").selectExpr(*PERSON_ROWS)

    @cached_property
    def streets(self) -> DataFrame:
        return self._sized("part").selectExpr(*_LATTICE).selectExpr(*_PLACED).selectExpr(*SEGMENTS).selectExpr(*STREETS)

    @cached_property
    def routes(self) -> DataFrame:
        named = self.streets.where(ROUTES_WHERE).selectExpr(*ROUTES)
        return named.withColumn("name_key", F.concat("predir", F.lit(" "), "name"))

    @cached_property
    def signals(self) -> DataFrame:
        return self._sized("customer").selectExpr(*SIGNALS)

    @cached_property
    def tagged(self) -> DataFrame:
        return self.signals.selectExpr(*TAGGED)

    @cached_property
    def sidewalks(self) -> DataFrame:
        return self.streets.where(SIDEWALKS_WHERE).selectExpr(*SIDEWALKS)

    @cached_property
    def searches(self) -> DataFrame:
        return self._sized("customer").selectExpr(*SEARCHES)

    @cached_property
    def boundary(self) -> DataFrame:
        """Edges of the city octagon; its size follows the lattice read from ``part``."""
        corners = [(a * self.n * 200.0, b * self.n * 200.0) for a, b in OCTAGON]  # in the order of the check SQL, to the last bit
        rows = [(1, *corners[i], *corners[(i + 1) % 8]) for i in range(8)]
        return self.spark.createDataFrame(rows, "polygon_id int, x1 double, y1 double, x2 double, y2 double")


def _select(columns, source: str, where: str = "") -> str:
    tail = f" WHERE {where}" if where else ""
    return f"SELECT {', '.join(columns)} FROM {source}{tail}"


def view_sql() -> dict[str, str]:
    """The same views as SQL, in dependency order."""
    octagon = ", ".join(
        f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for a, b in zip(OCTAGON, (*OCTAGON[1:], OCTAGON[0]))
    )
    return {
        "grid": "SELECT CAST(ceil(sqrt(count(*) / 2e0)) AS BIGINT) AS n FROM part",
        "person_rows": _select(PERSON_ROWS, "lineitem CROSS JOIN grid"),
        "lattice": _select(_LATTICE, "part CROSS JOIN grid"),
        "placed": _select(_PLACED, "lattice"),
        "segments": _select(SEGMENTS, "placed"),
        "streets": _select(STREETS, "segments"),
        "routes": f"SELECT *, concat(predir, ' ', name) AS name_key FROM ({_select(ROUTES, 'streets', ROUTES_WHERE)}) r",
        "signals": _select(SIGNALS, "customer CROSS JOIN grid"),
        "tagged": _select(TAGGED, "signals"),
        "sidewalks": _select(SIDEWALKS, "streets", SIDEWALKS_WHERE),
        "searches": _select(SEARCHES, "customer CROSS JOIN grid"),
        "boundary": "SELECT 1 AS polygon_id, a * n * 200e0 AS x1, b * n * 200e0 AS y1, c * n * 200e0 AS x2, d * n * 200e0 AS y2 "
        f"FROM (VALUES {octagon}) v(a, b, c, d) CROSS JOIN grid",
    }
