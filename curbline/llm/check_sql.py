"""DuckDB SQL that recomputes results of corpus operators by plain counting."""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def near_duplicates(percent: int = 80) -> str:
    """All pairs that share a two-word shingle, and everything reachable over links."""
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
members AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= {percent} * (len(x.s) + len(y.s) - n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b)
SELECT a AS doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(b) AS component_id, a = min(b) AS kept FROM reach JOIN sets ON doc_id = a GROUP BY a
"""


def repeats(length: int = 400) -> str:
    """Every string of ``length`` bytes counted by its hash; covered bytes merged to runs."""
    return f"""
WITH bodies AS MATERIALIZED (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {length} + 1)) AS pos FROM bodies WHERE len(h) >= {2 * length}),
strings AS MATERIALIZED (SELECT doc_id, pos, md5_number(substr(h, 2 * pos + 1, {2 * length})) AS k FROM starts),
twice AS (SELECT k FROM strings GROUP BY k HAVING count(*) > 1),
hits AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM strings SEMI JOIN twice USING (k)),
marked AS (SELECT doc_id, pos, sum(CASE WHEN pos <= before + {length} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM hits),
runs AS (SELECT doc_id, run, min(pos) AS a, max(pos) + {length} AS z FROM marked GROUP BY doc_id, run),
edges AS (SELECT doc_id, run, a, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS kept_from FROM runs
    UNION ALL SELECT r.doc_id, max(run) + 1, max(len(h)) // 2, max(z) FROM runs r JOIN bodies b USING (doc_id) GROUP BY r.doc_id),
rest AS (SELECT e.doc_id, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY run) AS h FROM edges e JOIN bodies b USING (doc_id) GROUP BY e.doc_id),
lost AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(len(b.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(r.h, b.h))) AS kept_sha256
FROM bodies b LEFT JOIN lost USING (doc_id) LEFT JOIN rest r USING (doc_id)
"""
