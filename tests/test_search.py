"""Junction search against plain loops, and how many rows it makes."""

import random

import pytest

from curbline.operators import search as S

PARTS, MATCHES = "query_id long, part_no int, raw string, parts int", "raw string, base string, quality int"
STREETS, NODES = "node_id long, k int, base string, street string", "node_id long, crashes long"


def _side(name):
    return name[0] if name[1:2] == " " and name[0] in "NSEW" else None


def _plain(parts, matches, streets, nodes, directions):
    """Every query at every junction, its parts choosing in order."""
    quality, at, asked = {(r, b): q for r, b, q in matches}, {}, {}
    for node, k, base, street in streets:
        at.setdefault(node, []).append((k, base, street))
    for query, no, raw, n in parts:
        asked.setdefault((query, n), []).append((no, raw))
    out = {}
    for (query, _), texts in asked.items():
        found = []
        for node, crashes in nodes:
            used, total = set(), 0.0
            for _, raw in sorted(texts):
                hits = [(-quality[raw, b] - 0.5 * (directions and _side(raw) is not None and _side(raw) == _side(s)), k) for k, b, s in at.get(node, []) if (raw, b) in quality and k not in used]
                if not hits:
                    break
                used.add(min(hits)[1])
                total -= min(hits)[0]
            else:
                found.append((-total, -crashes, node))
        out.update({(query, place): (node, -q) for place, (q, _, node) in enumerate(sorted(found)[:8], 1)})
    return out


@pytest.mark.parametrize("directions", [False, True])
def test_junctions_of_queries_with_shared_parts(spark, directions):
    rng = random.Random(11)
    bases = [f"b{i}" for i in range(9)]
    streets = [(node, k, b, f"{rng.choice(['W ', 'E ', ''])}{b} ST") for node in range(60) for k, b in enumerate(rng.choices(bases, k=rng.randint(1, 4)))]
    nodes = [(node, rng.randrange(4)) for node in range(60)]
    raws = [f"{d}{b}" for b in bases for d in ("W ", "")] + ["nothing"]
    matches = [(r, b, rng.randint(1, 4)) for r in raws[:-1] for b in bases if rng.random() < 0.3]
    parts = []
    for query in [*range(60), None]:
        n = rng.choice([1, 2, 2, 3])
        parts += [(query, no, raw, n) for no, raw in enumerate(rng.choices(raws if query else raws[:6], k=n))]
    parts += [(1000 + p[0], *p[1:]) for p in parts if p[0] is not None]  # every query asked twice
    frames = [spark.createDataFrame(*x) for x in ((parts, PARTS), (matches, MATCHES), (streets, STREETS), (nodes, NODES))]
    got = {(r["query_id"], r["place"]): (r["node_id"], r["q"]) for r in S.junction_candidates(*frames, directions=directions).collect()}
    want = _plain(parts, matches, streets, nodes, directions)
    assert got == want and {q for q, _ in got} >= {None} and len(got) > 300


def _most_rows(plan):
    """The largest number of rows that an operator of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _most_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _most_rows(plan.plan())
    metric = plan.metrics().get("numOutputRows")
    below = [_most_rows(plan.children().apply(i)) for i in range(plan.children().size())]
    return max([metric.get().value() if metric.isDefined() else 0, *below])


def test_common_street_is_not_spread_over_queries(spark):
    """2,000 queries for a rare street at one with 400 junctions: by hits of both parts that were 800,000 rows and more."""
    streets = [(n, 0, "common", "COMMON ST") for n in range(400)] + [(n, 1, f"rare{n}", f"RARE{n} ST") for n in range(400)]
    parts = [(q, no, raw, 2) for q in range(2000) for no, raw in ((0, "common"), (1, f"rare{q % 200}"))]
    matches = [("common", "common", 4), *((f"rare{n}", f"rare{n}", 4) for n in range(200))]
    frames = [spark.createDataFrame(*x) for x in ((parts, PARTS), (matches, MATCHES), (streets, STREETS), ([(n, n) for n in range(400)], NODES))]
    out = S.junction_candidates(*frames)
    plan = out._jdf.queryExecution().executedPlan()
    assert {(r["query_id"], r["node_id"], r["q"], r["place"]) for r in out.collect()} == {(q, q % 200, 8.0, 1) for q in range(2000)}
    assert _most_rows(plan) < 20000
