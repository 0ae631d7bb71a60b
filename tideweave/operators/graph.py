"""Graphs as tables of edges: construction, contraction and closed-form measures.

Directed edges are rows (src, dst); an undirected graph has each edge once, src < dst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def undirected(edges: DataFrame, weight: str | None = None, how=F.min) -> DataFrame:
    """Loops dropped and directions merged; weights of parallel edges by ``how``."""
    pair = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    rows = edges.filter("src != dst").select(*pair, *([weight] if weight else []))
    return rows.groupBy("src", "dst").agg(how(weight).alias(weight)) if weight else rows.distinct()


def both_ways(edges: DataFrame, *columns: str) -> DataFrame:
    """Each undirected edge as two rows (node, other)."""
    one = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *columns)
    return one.union(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), *columns))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in ``keep`` (node)."""
    return edges.join(keep.select(F.col("node").alias("src")), "src", "left_semi").join(keep.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, degree of a directed graph."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """One row: edges and the share of them with an edge the other way."""
    rows = edges.select("src", "dst").distinct()
    back = rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    return rows.join(back, ["src", "dst"], "left").agg(F.count("*").alias("edges"), F.avg(F.col("back").isNotNull().cast("double")).alias("reciprocity"))


def triangles(edges: DataFrame) -> DataFrame:
    """a < b < c of every triangle of an undirected graph.

    Paths begin at each edge's end with fewer neighbours, so a node with very many neighbours does
    not pair all of them.
    """
    both = both_ways(edges)
    d = both.groupBy("node").agg(F.count("*").alias("d"))
    ends = edges.join(d.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst")
    low = F.struct("ds", "src") < F.struct(F.col("dd").alias("ds"), F.col("dst").alias("src"))
    out = ends.select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("v"))
    paths = out.alias("x").join(out.alias("y"), F.col("x.u") == F.col("y.u")).filter("x.v < y.v").select(F.col("x.u").alias("u"), F.col("x.v").alias("src"), F.col("y.v").alias("dst"))
    closed = paths.join(edges.select("src", "dst"), ["src", "dst"])
    s = F.array_sort(F.array("u", "src", "dst"))
    return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def transitivity(edges: DataFrame) -> DataFrame:
    """One row: triangles, connected triples, and three triangles per triple (0 without triples)."""
    triples = both_ways(edges).groupBy("node").agg(F.count("*").alias("d")).agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).cast("long").alias("triples"))
    found = triangles(edges).agg(F.count("*").alias("triangles"))
    ratio = F.coalesce(F.try_divide(3.0 * F.col("triangles"), F.col("triples")), F.lit(0.0))
    return found.crossJoin(triples).select("triangles", "triples", ratio.alias("transitivity"))


def local_clustering(edges: DataFrame) -> DataFrame:
    """node, degree, triangles, clustering (null below degree 2)."""
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    d = both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))
    rows = d.join(t, "node", "left").fillna(0, ["triangles"])
    return rows.withColumn("clustering", F.try_divide(2.0 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1)))


def constraint(edges: DataFrame) -> DataFrame:
    """Burt's constraint of each node: the sum over neighbours of (p_ij + sum_q p_iq p_qj) squared.

    p_ij is the share of i's weight, both directions together, that goes to j.
    """
    mutual = both_ways(undirected(edges, "weight", F.sum), "weight")
    total = Window.partitionBy("node")
    p = mutual.select("node", "other", (F.col("weight") / F.sum("weight").over(total)).alias("p"))
    a, b = p.alias("a"), p.alias("b")
    indirect = a.join(b, F.col("a.other") == F.col("b.node")).filter("a.node != b.other")
    indirect = indirect.groupBy(F.col("a.node").alias("node"), F.col("b.other").alias("other")).agg(F.sum(F.col("a.p") * F.col("b.p")).alias("via"))
    rows = p.join(indirect, ["node", "other"], "left").fillna(0.0, ["via"])
    return rows.groupBy("node").agg(F.sum(F.pow(F.col("p") + F.col("via"), 2)).alias("constraint"))


def assortativity(edges: DataFrame) -> DataFrame:
    """One row: correlation of the degrees of both ends over both orientations."""
    both = both_ways(edges)
    d = both.groupBy("node").agg(F.count("*").alias("d"))
    rows = both.join(d, "node").join(d.select(F.col("node").alias("other"), F.col("d").alias("e")), "other")
    return rows.agg(F.corr("d", "e").alias("assortativity"))


def mixing_matrix(edges: DataFrame, level: DataFrame) -> DataFrame:
    """Edges between unordered pairs of levels; ``level`` has node, level."""
    a = level.select(F.col("node").alias("src"), F.col("level").alias("x"))
    b = level.select(F.col("node").alias("dst"), F.col("level").alias("y"))
    rows = edges.join(a, "src").join(b, "dst")
    return rows.groupBy(F.least("x", "y").alias("level_a"), F.greatest("x", "y").alias("level_b")).agg(F.count("*").alias("edges"))


def consecutive_places(incidence: DataFrame) -> DataFrame:
    """Edges between places that follow one another along a road, by median milepost.

    ``incidence`` has road, place, milepost; parallel edges and directions are merged.
    """
    at = incidence.groupBy("road", "place").agg(F.median("milepost").alias("m"))
    then = F.lead("place").over(Window.partitionBy("road").orderBy("m", "place"))
    rows = at.select(F.col("place").alias("src"), then.alias("dst")).filter("dst IS NOT NULL")
    return undirected(rows)


def bridge_removed(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Without the removed nodes; all neighbours of a removed node are linked instead.

    ``removed`` (node) is a short list: each of its nodes pairs all its neighbours.
    """
    both = both_ways(edges)
    near = both.join(removed, "node").join(removed.select(F.col("node").alias("other")), "other", "left_anti")
    a, b = near.alias("a"), near.alias("b")
    new = a.join(b, F.col("a.node") == F.col("b.node")).filter("a.other < b.other").select(F.col("a.other").alias("src"), F.col("b.other").alias("dst"))
    gone = removed.select(F.col("node").alias("src")), removed.select(F.col("node").alias("dst"))
    left = edges.join(gone[0], "src", "left_anti").join(gone[1], "dst", "left_anti").select("src", "dst")
    return left.union(new).distinct()


def ego_sizes(edges: DataFrame, steps: int = 2) -> DataFrame:
    """node, size: nodes within so many steps, the node included (one or two steps)."""
    both = both_ways(edges).distinct()
    reach = both
    if steps == 2:
        far = both.alias("a").join(both.alias("b"), F.col("a.other") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.other").alias("other"))
        reach = both.union(far).filter("node != other").distinct()
    return reach.groupBy("node").agg((F.count("*") + 1).alias("size"))


def neighbour_connectivity(edges: DataFrame) -> DataFrame:
    """node, mean degree of neighbours, H-index of their degrees, collective influence.

    Collective influence is (degree - 1) times the sum of (degree - 1) over neighbours.
    """
    both = both_ways(edges)
    d = both.groupBy("node").agg(F.count("*").alias("d"))
    rows = both.join(d.select(F.col("node").alias("other"), F.col("d").alias("e")), "other")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("e").desc(), "other"))
    rows = rows.withColumn("place", place)
    out = rows.groupBy("node").agg(F.count("*").alias("degree"), F.avg("e").alias("connectivity"), F.max(F.least("place", "e")).alias("h_index"), F.sum(F.col("e") - 1).alias("beyond"))
    return out.select("node", "degree", "connectivity", "h_index", ((F.col("degree") - 1) * F.col("beyond")).alias("influence"))


def morans_i(points: DataFrame, bands: list[float], distance: Column | None = None) -> DataFrame:
    """Moran's I by upper distance: ``points`` has id, x, y, value; neighbours are nearer than the band.

    Points fall into squares as wide as the widest band, and only pairs from neighbouring squares
    are compared.
    """
    wide = float(max(bands))
    n = points.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("v"))
    z = points.crossJoin(F.broadcast(n)).select("id", "x", "y", (F.col("value") - F.col("mean")).alias("z"), "n", "v")
    cell = lambda c: F.floor(F.col(c) / wide)
    near = F.explode(F.array(*(F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = z.select("*", near.alias("c")).select("id", "x", "y", "z", "n", "v", "c.cx", "c.cy")
    b = z.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"), cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)) if distance is None else distance
    pairs = a.join(b, ["cx", "cy"]).filter("id != id2").withColumn("d", d).filter(F.col("d") <= wide)
    level = F.explode(F.array(*(F.lit(float(x)) for x in bands))).alias("band")
    pairs = pairs.select("z", "z2", "n", "v", "d", level).filter(F.col("d") <= F.col("band"))
    out = pairs.groupBy("band").agg(F.count("*").alias("links"), F.sum(F.col("z") * F.col("z2")).alias("s"), F.first("v").alias("v"))
    return out.select("band", "links", F.try_divide(F.col("s"), F.col("links") * F.col("v")).alias("moran_i"))


def nearest(points: DataFrame, features: DataFrame, first: float = 0.01, radius: float = 6371.0088) -> DataFrame:
    """id, feature, distance: the nearest feature of every point by great circle (equal ones: the smallest).

    ``points`` has id, lat, lon, ``features`` feature, lat, lon, in degrees.  Both become points of the
    unit sphere in cubes; a point is done once a feature of the 27 cubes around it is nearer than a
    cube is wide.  What is left goes on with cubes of twice the width, at most two for the last.
    """
    from .paths import settled

    def sphere(rows: DataFrame, *keep: str) -> DataFrame:
        lat, lon = F.radians("lat"), F.radians("lon")
        return rows.select(*keep, (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))

    cubes = lambda wide, i=0, j=0, k=0: [(F.floor(F.col(c) / wide) + d).alias(f"c{c}") for c, d in zip("xyz", (i, j, k))]
    left = settled(sphere(points, "id"))
    marks = settled(sphere(features, "feature").select("feature", *(F.col(c).alias(f"{c}2") for c in "xyz")))
    wide, done = first, []
    around = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    while True:
        near = F.explode(F.array(*(F.struct(*cubes(wide, *d)) for d in around))).alias("c")
        a = left.select("*", near).select("id", "x", "y", "z", "c.*")
        b = marks.select("*", *((F.floor(F.col(f"{c}2") / wide)).alias(f"c{c}") for c in "xyz"))
        chord = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) + F.pow(F.col("z") - F.col("z2"), 2))
        met = a.join(b, ["cx", "cy", "cz"]).select("id", "feature", chord.alias("chord"))
        best = met.groupBy("id").agg(F.min(F.struct(F.round("chord", 9).alias("chord"), "feature")).alias("b")).select("id", "b.feature", "b.chord")
        found = settled(best if wide >= 2 else best.filter(F.col("chord") <= wide))
        done.append(found)
        if wide >= 2:
            break
        left = settled(left.join(found.select("id"), "id", "left_anti"))
        if not left.limit(1).count():
            break
        wide = min(2.0, 2 * wide)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", "feature", (2 * radius * F.asin(F.least(F.col("chord") / 2, F.lit(1.0)))).alias("distance"))


def triad_census(edges: DataFrame) -> DataFrame:
    """Connected triads by the states of their three dyads: mutual, one way, none."""
    one = edges.filter("src != dst").select("src", "dst").distinct()
    dyad = one.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").alias("k"))
    ways = dyad.select(F.col("a").alias("u"), F.col("b").alias("v"), "k").union(dyad.select("b", "a", "k"))
    x, y = ways.alias("x"), ways.alias("y")
    wedge = x.join(y, F.col("x.u") == F.col("y.u")).filter("x.v < y.v").select(F.col("x.u").alias("m"), F.col("x.v").alias("a"), F.col("y.v").alias("b"), F.col("x.k").alias("k1"), F.col("y.k").alias("k2"))
    full = wedge.join(dyad, ["a", "b"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    # a closed triad is met at each of its nodes; it counts where the middle node is the smallest
    own = full.filter((F.col("k") == 0) | (F.col("m") < F.col("a")))
    state = F.array_sort(F.array("k1", "k2", "k"))
    return own.groupBy(F.concat_ws("", state.cast("array<string>")).alias("dyads")).agg(F.count("*").alias("triads"))
