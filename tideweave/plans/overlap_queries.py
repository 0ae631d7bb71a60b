"""Agreement of covers, ladders of edge sets, unions of communities' graphs, natural joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import overlap
from ..sources import tables
from .quality_queries import _USERS, _half, _nodes, _rounded, _users
from .registry import query

_TWO = f"""{tables.MEMBERSHIPS}, one AS (SELECT node, community FROM memberships WHERE half = 1), two AS (SELECT node, community FROM memberships WHERE half = 2)"""
_SHARED = f"""{_TWO}, nodes AS (SELECT DISTINCT user_id AS node FROM events),
j AS (SELECT x.node AS u, y.node AS v, count(*) AS j FROM one x JOIN one y ON x.community = y.community GROUP BY ALL),
k AS (SELECT x.node AS u, y.node AS v, count(*) AS k FROM two x JOIN two y ON x.community = y.community GROUP BY ALL),
p AS (SELECT a.node AS u, b.node AS v, coalesce(j, 0) AS j, coalesce(k, 0) AS k FROM nodes a CROSS JOIN nodes b
      LEFT JOIN j ON j.u = a.node AND j.v = b.node LEFT JOIN k ON k.u = a.node AND k.v = b.node)"""
GROUPS = ["North", "South", "East", "West"]


@query(f"""WITH {_SHARED}, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER ((j > 0) = (k > 0)) AS same, count(*) FILTER (j > 0) AS one, count(*) FILTER (k > 0) AS two FROM p WHERE u <> v),
e AS (SELECT same / n AS agreement, one / n * (two / n) + (1 - one / n) * (1 - two / n) AS expected FROM s)
SELECT round(agreement, 6) AS agreement, round(expected, 6) AS expected, round(CASE WHEN abs(1 - expected) < 1e-10 THEN 0 ELSE greatest(0, least(1, (agreement - expected) / (1 - expected))) END, 6) AS omega FROM e""")
def binary_omega(spark, folder):
    return _rounded(overlap.binary_omega(_half(spark, folder, 1), _half(spark, folder, 2), _nodes(spark, folder)), "agreement", "expected", "omega")


@query(f"WITH {_SHARED} SELECT round(CAST(count(*) FILTER (j = k) AS DOUBLE) / count(*), 6) AS ratio FROM p")
def match_ratio(spark, folder):
    return _rounded(overlap.match_ratio(_half(spark, folder, 1), _half(spark, folder, 2), _nodes(spark, folder)), "ratio")


@query(f"""WITH {_TWO}, x AS (SELECT a.community AS c, b.community AS d, CAST(count(*) AS DOUBLE) AS x FROM one a JOIN one b ON a.node = b.node GROUP BY ALL),
y AS (SELECT a.community AS c, b.community AS d, CAST(count(*) AS DOUBLE) AS y FROM two a JOIN two b ON a.node = b.node GROUP BY ALL)
SELECT round((SELECT sum(x * y) FROM x JOIN y USING (c, d)) / sqrt((SELECT sum(x * x) FROM x) * (SELECT sum(y * y) FROM y)), 6) AS cosine""")
def overlap_cosine(spark, folder):
    return _rounded(overlap.cosine(_half(spark, folder, 1), _half(spark, folder, 2)), "cosine")


@query(f"""WITH {_TWO}, {_USERS}, l AS (SELECT src AS node, dst AS other FROM ug UNION ALL SELECT dst, src FROM ug), g AS (SELECT node, count(*) AS degree FROM l GROUP BY 1),
r AS (SELECT node, count(*) AS r FROM one GROUP BY 1),
w AS (SELECT n.node, c.community, CASE WHEN r.r IS NULL THEN 0 ELSE 1 + (CASE WHEN one.node IS NULL THEN 0 ELSE 1 END) / CAST(r.r AS DOUBLE) END AS w
      FROM nodes n CROSS JOIN (SELECT DISTINCT community FROM two) c LEFT JOIN r USING (node) LEFT JOIN one ON one.node = n.node AND one.community = c.community),
vol AS (SELECT two.community, sum(g.degree * w.w) AS volume FROM two JOIN w USING (node, community) JOIN g USING (node) GROUP BY 1),
b AS (SELECT two.community, sum(w.w * o.w) AS boundary FROM two JOIN w USING (node, community) JOIN l USING (node) JOIN w o ON o.node = l.other AND o.community = two.community
      WHERE NOT EXISTS (SELECT 1 FROM two t WHERE t.node = l.other AND t.community = two.community) GROUP BY 1)
SELECT community, round(coalesce(boundary, 0), 6) AS boundary, round(volume, 6) AS volume, round(coalesce(boundary, 0) / least(volume, (SELECT sum(degree) FROM g) - volume), 6) AS conductance FROM vol LEFT JOIN b USING (community)""")
def weighted_conductance(spark, folder):
    found = overlap.weighted_conductance(_users(spark, folder), _half(spark, folder, 2), _half(spark, folder, 1))
    return _rounded(found, "boundary", "volume", "conductance")


_LABEL = "lab AS (SELECT user_id AS node, event_type AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE k = 1)"


@query(f"""WITH {_USERS}, {_LABEL}, l AS (SELECT src AS node, dst AS other FROM ug UNION ALL SELECT dst, src FROM ug),
n AS (SELECT l.node, a.label, b.label AS near, count(*) AS n FROM l JOIN lab a ON a.node = l.node JOIN lab b ON b.node = l.other GROUP BY ALL)
SELECT node, CAST(sum(n) AS BIGINT) AS degree, round((coalesce(sum(n) FILTER (near = label), 0) - coalesce(max(n) FILTER (near <> label), 0)) / CAST(sum(n) AS DOUBLE), 6) AS permanence FROM n GROUP BY node""")
def permanence(spark, folder):
    n = tables.table(spark, folder, "events").groupBy(F.col("user_id").alias("node"), F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("node").orderBy(F.col("n").desc(), "label"))
    labels = n.withColumn("k", first).filter("k = 1").select("node", "label")
    return _rounded(overlap.permanence(_users(spark, folder), labels), "permanence")


@query("""WITH f AS (SELECT user_id AS src, lead(user_id) OVER w AS dst, date_diff('second', ts, lead(ts) OVER w) / 60.0 AS dist FROM events WINDOW w AS (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id)),
e AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(dist) AS dist FROM f WHERE src <> dst GROUP BY ALL), r AS (SELECT unnest(generate_series(5, 100, 5)) AS rung)
SELECT rung, (SELECT count(*) FROM e WHERE dist <= rung) AS edges, (SELECT count(*) FROM (SELECT src FROM e WHERE dist <= rung UNION SELECT dst FROM e WHERE dist <= rung)) AS nodes FROM r""")
def edge_ladder(spark, folder):
    """Users whose events of a type follow one another within 5, 10, ... 100 minutes."""
    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    events = tables.table(spark, folder, "events")
    gap = (F.date_trunc("second", F.lead("ts").over(w)).cast("timestamp").cast("long") - F.date_trunc("second", "ts").cast("timestamp").cast("long")) / 60.0
    rows = events.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"), gap.alias("dist")).filter("src != dst")
    return overlap.ladder(rows, 5, 100)


@query(f"""WITH {_TWO}, {_USERS} SELECT a.community, concat(ug.src, '_', a.community) AS src, concat(ug.dst, '_', a.community) AS dst FROM ug JOIN one a ON a.node = ug.src JOIN one b ON b.node = ug.dst AND b.community = a.community""")
def communities_apart(spark, folder):
    """Disjoint union of the communities' subgraphs."""
    return overlap.disjoint_union(_users(spark, folder), _half(spark, folder, 1))


@query(f"""WITH n AS (SELECT DISTINCT user_id AS node FROM events), k AS (SELECT node, md5(CAST(node AS VARCHAR)) AS h, row_number() OVER (ORDER BY md5(CAST(node AS VARCHAR)), node) AS k FROM n)
SELECT node, ({GROUPS!r})[CASE WHEN k <= {2 * len(GROUPS)} THEN (k - 1) % {len(GROUPS)} ELSE CAST('0x' || substr(h, 9, 7) AS BIGINT) % {len(GROUPS)} END + 1] AS label FROM k""")
def group_labels(spark, folder):
    return overlap.group_labels(_nodes(spark, folder), GROUPS)


@query("SELECT doc_id, lang, source, n_chars, quality, toxic FROM (SELECT doc_id, lang, source, n_chars FROM documents) NATURAL LEFT JOIN labels")
def natural_left_join(spark, folder):
    docs = tables.table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return overlap.natural_left_join(docs, tables.table(spark, folder, "labels")).select("doc_id", "lang", "source", "n_chars", "quality", "toxic")
