"""Derived tables of one data directory, computed on demand and written once per run."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.functions import columns as C
from curbline.operators import aggregates as A
from curbline.operators import chains as CH
from curbline.operators import corridors as K
from curbline.operators import crossings as X
from curbline.operators import network as N
from curbline.operators import rules as R
from curbline.operators import search as S
from curbline.operators.scan import global_rank
from curbline.operators.spatial import nearest
from curbline.plans.fixtures import Tables
from curbline.session import cut

# Parameters of the example city: names and ids the rules single out.
RULES = R.Rulebook(limited_names=("VALLEY4",), forced_ids=(104, 330), forced_names=("E HICKORY5",))
CITY_BOX = (34.99, 35.42, -90.31, -89.61)  # south, north, west, east
PERSON_ORDER = ["person_seq", "incident_date", "light"]
MERGE_RADIUS = 25.0


class Scene(Tables):
    @cached_property
    def streets(self) -> DataFrame:
        """The street pieces, written once: a test on them would otherwise repeat all that its columns are made of."""
        return cut(super().streets)

    @cached_property
    def incidents(self) -> DataFrame:
        return A.dedup_incidents(self.person_rows, order=PERSON_ORDER)

    @cached_property
    def stored(self) -> DataFrame:
        """The incidents, folded once for the queries that read them more than once."""
        return cut(self.incidents)

    @cached_property
    def measured(self) -> DataFrame:
        return cut(R.segment_measures(self.streets, self.routes, RULES))

    @cached_property
    def rulebook(self) -> DataFrame:
        return R.tag_segments(self.measured, RULES)

    @cached_property
    def classified(self) -> DataFrame:
        return cut(R.classify_incidents(self.stored, self.rulebook, self.routes, snapped=self.snapped))

    @cached_property
    def snapped(self) -> DataFrame:
        """The nearest street piece of each incident; the rulebook holds the same pieces."""
        hit = nearest(self.stored, self.streets, point_id="incident_id", key=["seg_id"])
        return cut(hit.select("incident_id", "seg_id", F.col("dist").alias("seg_m")))

    @cached_property
    def named(self) -> DataFrame:
        """Incidents with the attributes of their nearest street only."""
        attrs = self.streets.select("seg_id", "street", "lanes", "speed", "mtfcc", "name")
        return cut(self.stored.join(self.snapped, "incident_id").join(attrs, "seg_id"))

    @cached_property
    def classed(self) -> DataFrame:
        """Incidents with their street's attributes and an owner from the road class alone."""
        owner = F.when(F.col("mtfcc") == "S1100", C.INTERSTATE).when(F.col("mtfcc") == "S1630", C.RAMP).when(F.col("mtfcc") == "S1200", C.STATE_ROUTE).otherwise(C.CITY)
        return self.named.withColumn("owner", owner)

    @cached_property
    def ranking(self) -> DataFrame:
        return A.corridor_ranking(self.classed)

    @cached_property
    def through(self) -> DataFrame:
        return self.streets.where(C.is_through())

    @cached_property
    def met(self) -> DataFrame:
        return cut(X.line_crossings(self.through))

    @cached_property
    def nodes(self) -> DataFrame:
        return cut(X.junction_nodes(self.met, radius=MERGE_RADIUS))

    @cached_property
    def signal_crossings(self) -> DataFrame:
        return cut(R.signal_crossings(self.signals, self.streets))

    @cached_property
    def covered(self) -> DataFrame:
        snapped = nearest(self.signals, self.through, point_id="signal_id", key=["seg_id"], carry=["street"]).select("signal_id", "street")
        return cut(R.covered_streets(self.signals.join(snapped, "signal_id", "left")))

    @cached_property
    def marked_nodes(self) -> DataFrame:
        return cut(R.mark_nodes(self.nodes, self.signal_crossings, self.covered))

    @cached_property
    def signal_status(self) -> DataFrame:
        return cut(R.intersection_status(self.stored, self.marked_nodes, self.signal_crossings))

    @cached_property
    def full_nodes(self) -> DataFrame:
        return cut(A.junction_totals(self.marked_nodes, R.incident_junctions(self.stored, self.nodes)))

    @cached_property
    def chains(self) -> DataFrame:
        return cut(CH.merge_lines(self.streets, by=["street"]))

    @cached_property
    def lines(self) -> DataFrame:
        return CH.reference_lines(self.chains, by=["street"])

    @cached_property
    def ref(self) -> DataFrame:
        return cut(self.chains.join(self.lines.select("chain_id"), "chain_id", "left_semi"))

    @cached_property
    def graph(self) -> DataFrame:
        return N.road_graph(self.chains, by=["street"])

    @cached_property
    def net_chains(self) -> DataFrame:
        """Chains of the network of each direction half, whose roads branch and close loops."""
        return cut(CH.merge_lines(self.streets, by=["predir"]))

    @cached_property
    def net(self) -> DataFrame:
        return N.road_graph(self.net_chains, by=["predir"])

    @cached_property
    def on_chain(self) -> DataFrame:
        """Incidents with the chain and measure of their nearest street."""
        at = self.chains.select("seg_id", "chain_id", "m_start", "m_dir", "len", F.col("x1").alias("_x1"), F.col("y1").alias("_y1"), F.col("x2").alias("_x2"), F.col("y2").alias("_y2"))
        from curbline.functions.geometry import foot

        placed = self.named.join(at, "seg_id").withColumn("t", foot("x", "y", "_x1", "_y1", "_x2", "_y2"))
        return cut(placed.withColumn("m", CH.measured()).drop("t", "m_start", "m_dir", "len", "_x1", "_y1", "_x2", "_y2"))

    def places(self, chains: DataFrame) -> DataFrame:
        """Signals as lookup places on a set of chains."""
        hit = nearest(self.signals, chains, point_id="signal_id", key=["seg_id"], carry=["chain_id", "m_start", "m_dir", "len"])
        return cut(hit.withColumn("m", CH.measured()).select("signal_id", "seg_id", "chain_id", "m"))

    @cached_property
    def net_incidents(self) -> DataFrame:
        hit = nearest(self.stored, self.net_chains, point_id="incident_id", key=["seg_id"], carry=["chain_id", "m_start", "m_dir", "len"])
        at = hit.withColumn("m", CH.measured()).select("incident_id", "seg_id", "chain_id", "m")
        return cut(self.stored.select("incident_id", "severity", "x", "y").join(at, "incident_id"))

    # --- crosswalk study -------------------------------------------------------------------
    @cached_property
    def walk_lines(self) -> DataFrame:
        """Every third marked crossing drawn as a 12 m line, along x or along y."""
        marked = self.tagged.where(C.is_marked("markings") & (F.col("signal_id") % 3 == 0))
        flat = F.col("signal_id") % 2 == 0
        half = lambda on: F.when(on, 6.0).otherwise(0.0)
        return marked.select("signal_id", (F.col("x") - half(flat)).alias("x1"), (F.col("y") - half(~flat)).alias("y1"), (F.col("x") + half(flat)).alias("x2"), (F.col("y") + half(~flat)).alias("y2"))

    @cached_property
    def walk_points(self) -> DataFrame:
        return self.tagged.where(C.is_marked("markings") & (F.col("signal_id") % 3 != 0)).select("signal_id", "x", "y")

    @cached_property
    def kept_marked(self) -> DataFrame:
        lines = K.crossing_lines(self.walk_lines, self.ref, line_id="signal_id")
        points = K.crossing_points(self.walk_points, self.ref, self.through.where("true"), point_id="signal_id")
        at = self.tagged.select("signal_id", "x", "y")
        both = lines.select("signal_id", "street").unionByName(points.select("signal_id", "street"))
        return cut(both.join(at, "signal_id").select(F.concat(F.lit("m"), F.col("signal_id")).alias("place_id"), "street", "x", "y"))

    @cached_property
    def kept_signals(self) -> DataFrame:
        on = K.junction_signals(self.signal_crossings, self.ref, K.junction_points(self.ref, self.through))
        at = self.signal_crossings.select("crossing_id", "x", "y")
        return cut(on.join(at, "crossing_id").select(F.concat(F.lit("s"), F.col("crossing_id")).alias("place_id"), "street", "x", "y"))

    @cached_property
    def safe(self) -> DataFrame:
        return cut(K.safe_crossings(self.kept_marked, self.kept_signals, self.ref))

    # --- search ----------------------------------------------------------------------------
    @cached_property
    def street_index(self) -> DataFrame:
        return cut(S.street_index(self.rulebook, self.named))

    @cached_property
    def aliases(self) -> DataFrame:
        return S.alias_groups(self.routes, state="tn")

    @cached_property
    def node_streets(self) -> DataFrame:
        return cut(S.junction_streets(self.nodes))

    @cached_property
    def searched_words(self) -> DataFrame:
        """Base forms of all streets and of all names at junctions (each crossing is part of one junction)."""
        names = self.met.select(F.explode(F.array("name_a", "name_b")).alias("street"))
        return self.street_index.select("base").unionByName(names.select(C.base_form("street").alias("base"))).distinct()

    @cached_property
    def node_crashes(self) -> DataFrame:
        return self.full_nodes.select("node_id", "crashes")

    @cached_property
    def ranked(self) -> DataFrame:
        return global_rank(self.ranking, A.most_first("total", "fatal"))

    # --- snapshots -------------------------------------------------------------------------
    @cached_property
    def old_snapshot(self) -> DataFrame:
        return self.incidents.where("incident_id % 97 <> 0")

    @cached_property
    def new_snapshot(self) -> DataFrame:
        more = F.col("victims") + F.when(F.col("incident_id") % 83 == 0, 1).otherwise(0)
        return self.incidents.where("incident_id % 89 <> 0").withColumn("victims", more)
