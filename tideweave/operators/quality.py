"""Quality of overlapping communities, from memberships (node, community), edges and covariates.

Undirected edges are given once.  Nodes without a community form the background community ``0``
where a measure has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BACKGROUND = "0"


def with_background(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds the background community for nodes without any."""
    rest = nodes.select("node").join(members.select("node"), "node", "left_anti").select("node", F.lit(BACKGROUND).alias("community"))
    return members.select("node", "community").unionByName(rest)


def threshold(n: int) -> float:
    """Least affiliation of a member: sqrt(-log(1 - 1/n))."""
    from math import log1p, sqrt

    return sqrt(-log1p(-1 / n))


def omega(truth: DataFrame, found: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row: Omega index of two memberships, with observed and expected agreement.

    With ``by``, columns of ``found`` and ``nodes``, one row for each of their values in ``nodes``.

    Two nodes agree if both memberships give them equally many common communities.  Nodes with the
    same sets of communities count alike, so pairs are taken between different sets of sets only.
    """
    side = lambda m, name, *keys: m.groupBy(*keys, "node").agg(F.array_sort(F.collect_set(F.col("community").cast("string"))).alias(name))
    none = F.array().cast("array<string>")
    kinds = nodes.select(*by, "node").distinct().join(side(truth, "a"), "node", "left").join(side(found, "b", *by), [*by, "node"], "left")
    kinds = kinds.select(*by, F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b")).groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    kinds = kinds.withColumn("k", F.concat_ws("|", F.array_join("a", ","), F.array_join("b", ",")))
    x, y = kinds.alias("x"), kinds.alias("y")
    near = F.col("x.k") <= F.col("y.k")
    for c in by:
        near &= F.col(f"x.{c}") == F.col(f"y.{c}")
    pairs = x.join(y, near)
    same = F.col("x.k") == F.col("y.k")
    number = F.when(same, F.col("x.n") * (F.col("x.n") - 1) / 2).otherwise(F.col("x.n") * F.col("y.n")).cast("double")
    counts = pairs.select(*(F.col(f"x.{c}").alias(c) for c in by), F.size(F.array_intersect("x.a", "y.a")).alias("j"), F.size(F.array_intersect("x.b", "y.b")).alias("k"), number.alias("n"))
    counts = counts.groupBy(*by, "j", "k").agg(F.sum("n").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("p"), F.sum(F.when(F.col("j") == F.col("k"), F.col("n")).otherwise(0.0)).alias("same"))
    a, b = counts.groupBy(*by, "j").agg(F.sum("n").alias("na")), counts.groupBy(*by, F.col("k").alias("j")).agg(F.sum("n").alias("nb"))
    expected = a.join(b, [*by, "j"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    # without a common number nothing is expected to agree
    both = total.join(expected, list(by), "left").fillna(0.0, "e") if by else total.crossJoin(expected)
    out = both.select(*by, (F.col("same") / F.col("p")).alias("observed"), (F.col("e") / (F.col("p") * F.col("p"))).alias("expected"))
    return out.withColumn("omega", F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")))


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """One row: adjusted Rand index of two hard labellings (node, a, b)."""
    pairs = lambda n: n * (n - 1) / 2
    cells = labels.groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(name))
    rows = both.crossJoin(side("a", "sa")).crossJoin(side("b", "sb"))
    expected = F.col("sa") * F.col("sb") / pairs(F.col("n"))
    return rows.select(F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected).alias("ari"))


def precision_recall(cells: DataFrame) -> DataFrame:
    """One row from 0/1 columns truth, predicted: accuracy, precision, recall, f1 (0 when undefined)."""
    t, p = F.col("truth") == 1, F.col("predicted") == 1
    n = lambda c: F.sum(c.cast("double"))
    rows = cells.agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), F.count("*").cast("double").alias("n"))
    zero = F.lit(0.0)
    rows = rows.select(
        (1 - (F.col("fp") + F.col("fn")) / F.col("n")).alias("accuracy"),
        F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero).alias("recall"),
    )
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), zero))


def imputation_error(cells: DataFrame) -> DataFrame:
    """Per cov, from truth, imputed and is_missing: rmse, rmse_missing, and the latter divided by all rows."""
    e = F.pow(F.col("truth") - F.col("imputed"), 2)
    missing = F.when(F.col("is_missing"), e)
    return cells.groupBy("cov").agg(
        F.sqrt(F.avg(e)).alias("rmse"), F.sqrt(F.avg(missing)).alias("rmse_missing"), F.sqrt(F.sum(missing) / F.count("*")).alias("rmse_missing_all_rows")
    )


def dispersion(values: DataFrame) -> DataFrame:
    """Per community: size, and mean over covariates of its variance over the global one.

    ``values`` has node, community, cov, value.  A community of one node has no variance.
    """
    whole = values.dropDuplicates(["node", "cov"]).groupBy("cov").agg(F.var_samp("value").alias("all_var"))
    own = values.groupBy("community", "cov").agg(F.var_samp("value").alias("var"), F.count("*").alias("n"))
    rows = own.join(whole, "cov").groupBy("community").agg(F.max("n").alias("size"), F.avg(F.try_divide("var", "all_var")).alias("dispersion"))
    return rows


def weighted_dispersion(values: DataFrame) -> DataFrame:
    """One row: dispersions weighted by community sizes, and their plain mean; communities of one node left out."""
    rows = dispersion(values).filter("dispersion IS NOT NULL")
    return rows.agg((F.sum(F.col("size") * F.col("dispersion")) / F.sum("size")).alias("weighted"), F.avg("dispersion").alias("plain"))


def binary_dispersion(values: DataFrame) -> DataFrame:
    """Per community: mean over 0/1 covariates of p(1-p), over the global p(1-p)."""
    spread = lambda: F.avg("value") * (1 - F.avg("value"))
    whole = values.dropDuplicates(["node", "cov"]).groupBy("cov").agg(spread().alias("all_spread"))
    own = values.groupBy("community", "cov").agg(spread().alias("spread"), F.count("*").alias("n"))
    return own.join(whole, "cov").groupBy("community").agg(F.max("n").alias("size"), F.avg("spread").alias("spread"), F.avg(F.try_divide("spread", "all_spread")).alias("ratio"))


def trace_r2(values: DataFrame) -> DataFrame:
    """One row: pooled within-community trace, total trace, and 1 - within / total."""
    own = values.groupBy("community", "cov").agg(F.var_samp("value").alias("v"), F.count("*").alias("n"))
    within = own.agg((F.sum((F.col("n") - 1) * F.col("v"))).alias("w"))
    whole = values.dropDuplicates(["node", "cov"]).groupBy("cov").agg(F.var_samp("value").alias("v"), F.count("*").alias("n")).agg(F.sum((F.col("n") - 1) * F.col("v")).alias("t"))
    return within.crossJoin(whole).select(F.col("w").alias("within"), F.col("t").alias("total"), (1 - F.try_divide("w", "t")).alias("r2"))


def cosine_cohesion(values: DataFrame) -> DataFrame:
    """Per community: mean cosine of all pairs of nodes on min-max scaled covariates.

    The sum over pairs of unit vectors comes from the length of their sum; no pair is formed.
    """
    lim = values.groupBy("cov").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = values.join(lim, "cov").withColumn("x", F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("value")))
    norm = Window.partitionBy("community", "node")
    unit = scaled.withColumn("len", F.sqrt(F.sum(F.pow("x", 2)).over(norm))).filter("len > 0").withColumn("u", F.col("x") / F.col("len"))
    sums = unit.groupBy("community", "cov").agg(F.sum("u").alias("s"), F.countDistinct("node").alias("n"))
    rows = sums.groupBy("community").agg(F.max("n").alias("n"), F.sum(F.pow("s", 2)).alias("s2"))
    return rows.select("community", "n", F.try_divide(F.col("s2") - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("cosine"))


def silhouette(values: DataFrame) -> DataFrame:
    """Per community: mean silhouette of its nodes with mean squared distances.

    The mean squared distance of a node to a community follows from the community's means of values
    and of squares, so no pair of nodes is formed.  a is the mean over a node's own communities
    (without itself), b the least of the others.
    """
    center = values.groupBy("community", "cov").agg(F.avg("value").alias("m"), F.avg(F.pow("value", 2)).alias("q"), F.count("*").alias("n"))
    center = center.select(F.col("community").alias("other"), "cov", "m", "q", "n")
    point = values.dropDuplicates(["node", "cov"]).select("node", "cov", "value")
    d = point.join(center, "cov").groupBy("node", "other").agg(F.sum(F.pow("value", 2) - 2 * F.col("value") * F.col("m") + F.col("q")).alias("d"), F.max("n").alias("n"))
    own = values.select("node", F.col("community").alias("other")).distinct().withColumn("own", F.lit(True))
    d = d.join(own, ["node", "other"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    inside = F.when(F.col("own") & (F.col("n") > 1), F.col("d") * F.col("n") / (F.col("n") - 1))
    s = d.groupBy("node").agg(F.avg(inside).alias("a"), F.min(F.when(~F.col("own"), F.col("d"))).alias("b"))
    s = s.select("node", F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")).alias("s"))
    return own.select("node", F.col("other").alias("community")).join(s, "node").groupBy("community").agg(F.avg("s").alias("silhouette"), F.count("*").alias("n"))


def shared_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """community, src, dst of edges with both ends in the community."""
    a = members.select(F.col("node").alias("src"), "community")
    b = members.select(F.col("node").alias("dst"), "community")
    return edges.select("src", "dst").join(a, "src").join(b, ["dst", "community"])


def internal_density(edges: DataFrame, members: DataFrame) -> DataFrame:
    """community, n, edges, density = 2 m / (n (n - 1))."""
    m = shared_edges(edges, members).groupBy("community").agg(F.count("*").alias("m"))
    n = members.groupBy("community").agg(F.count("*").alias("n"))
    rows = n.join(m, "community", "left").fillna(0, ["m"])
    return rows.select("community", "n", F.col("m").alias("edges"), F.coalesce(F.try_divide(2.0 * F.col("m"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("density"))


def triangle_participation(edges: DataFrame, members: DataFrame) -> DataFrame:
    """community, n, share of its nodes that are in a triangle within it."""
    inside = shared_edges(edges, members)
    x, y, z = (inside.alias(k) for k in "xyz")
    t = x.join(y, (F.col("x.community") == F.col("y.community")) & (F.col("x.dst") == F.col("y.src")))
    t = t.join(z, (F.col("x.community") == F.col("z.community")) & (F.col("z.src") == F.col("x.src")) & (F.col("z.dst") == F.col("y.dst")))
    t = t.select(F.col("x.community").alias("community"), F.explode(F.array("x.src", "x.dst", "y.dst")).alias("node")).distinct().groupBy("community").agg(F.count("*").alias("t"))
    n = members.groupBy("community").agg(F.count("*").alias("n"))
    return n.join(t, "community", "left").fillna(0, ["t"]).select("community", "n", (F.col("t") / F.col("n")).alias("participation"))


def ego_split_mixing(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges of the ego-split graph between communities c <= d: c, d, n.

    A node has a copy in each of its communities.  An edge joins the copies in common communities;
    without one it joins all copies of its ends; copies of one node are joined with each other.
    """
    a = members.select(F.col("node").alias("src"), F.col("community").alias("c"))
    b = members.select(F.col("node").alias("dst"), F.col("community").alias("d"))
    ends = edges.select("src", "dst").join(a, "src").join(b, "dst")
    common = F.max((F.col("c") == F.col("d")).cast("int")).over(Window.partitionBy("src", "dst"))
    kept = ends.withColumn("common", common).filter((F.col("common") == 0) | (F.col("c") == F.col("d")))
    own = members.select("node", F.col("community").alias("c")).join(members.select("node", F.col("community").alias("d")), "node").filter("c < d")
    rows = kept.select("c", "d").unionByName(own.select("c", "d"))
    return rows.groupBy(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).agg(F.count("*").alias("n"))


def conductance(mixing: DataFrame) -> DataFrame:
    """community, cut, volume, conductance = cut / min(volume, volume of the rest); 0 without volume."""
    ends = mixing.select(F.col("c").alias("community"), (F.col("c") == F.col("d")).alias("inside"), "n").union(mixing.filter("c != d").select("d", F.lit(False), "n"))
    rows = ends.groupBy("community").agg(F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("cut"), F.sum(F.when(F.col("inside"), 2 * F.col("n")).otherwise(F.col("n"))).alias("volume"))
    total = mixing.agg((2 * F.sum("n")).alias("total"))
    least = F.least("volume", F.col("total") - F.col("volume"))
    return rows.crossJoin(F.broadcast(total)).select("community", "cut", "volume", F.coalesce(F.try_divide("cut", least), F.lit(0.0)).alias("conductance"))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row for an overlapping cover: ``q_edges`` sums over adjacent pairs only, ``q_newman`` over all.

    A pair counts with the products of both nodes' shares in common communities; a node's share is
    one over the number of its communities.
    """
    share = members.select("node", "community", (1 / F.count("*").over(Window.partitionBy("node"))).alias("a"))
    d = edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("d"))
    m = edges.agg(F.count("*").alias("m"))
    s, t = (share.join(d, "node").select(F.col("node").alias(n), "community", F.col("a").alias(f"a_{n}"), F.col("d").alias(f"d_{n}")) for n in ("src", "dst"))
    rows = edges.select("src", "dst").join(s, "src").join(t, ["dst", "community"]).crossJoin(F.broadcast(m))
    both = F.col("a_src") * F.col("a_dst")
    near = rows.agg(F.sum(both * (1 - F.col("d_src") * F.col("d_dst") / (2 * F.col("m"))) / F.col("m")).alias("q_edges"), F.sum(both / F.col("m")).alias("inside"))
    mass = share.join(d, "node").groupBy("community").agg(F.sum(F.col("a") * F.col("d")).alias("k")).crossJoin(F.broadcast(m)).agg(F.sum(F.pow(F.col("k") / (2 * F.col("m")), 2)).alias("expected"))
    return near.crossJoin(mass).select("q_edges", (F.col("inside") - F.col("expected")).alias("q_newman"))


def cover_scores(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per community: partition density, community quality, normalised cut, and its share of overlapping nodes."""
    inside = shared_edges(edges, members).groupBy("community").agg(F.count("*").alias("m"))
    n = members.groupBy("community").agg(F.count("*").alias("n"))
    d = edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("d"))
    vol = members.join(d, "node").groupBy("community").agg(F.sum("d").alias("vol"))
    many = members.withColumn("k", F.count("*").over(Window.partitionBy("node"))).groupBy("community").agg(F.avg((F.col("k") > 1).cast("double")).alias("overlap"))
    rows = n.join(inside, "community", "left").join(vol, "community", "left").join(many, "community").fillna(0, ["m", "vol"])
    tree = F.col("n") - 1
    density = F.try_divide(F.col("m") - tree, F.col("n") * (F.col("n") - 1) / 2 - tree)
    cut = F.col("vol") - 2 * F.col("m")
    return rows.select("community", density.alias("partition_density"), ((F.col("m") - cut) / F.col("n")).alias("quality"), F.try_divide(cut, "vol").alias("normalised_cut"), "overlap")


def trimmed(members: DataFrame, nodes: int, most: float = 0.8, least: int = 0) -> DataFrame:
    """Without communities of more than a share of all nodes or of too few nodes."""
    n = members.groupBy("community").agg(F.count("*").alias("n")).filter((F.col("n") <= most * nodes) & (F.col("n") > least)).select("community")
    return members.join(n, "community", "left_semi").select(*members.columns)


def containment(members: DataFrame) -> DataFrame:
    """a, b, share: how much of community a is in community b, a != b; from counts of common nodes."""
    x, y = members.select("node", F.col("community").alias("a")), members.select("node", F.col("community").alias("b"))
    n = members.groupBy(F.col("community").alias("a")).agg(F.count("*").alias("n"))
    both = x.join(y, "node").filter("a != b").groupBy("a", "b").agg(F.count("*").alias("k"))
    return both.join(n, "a").select("a", "b", (F.col("k") / F.col("n")).alias("share"))


def merged(members: DataFrame, share: float = 0.7) -> DataFrame:
    """Communities joined where one holds more than a share of another; chains join all together.

    Only counts of common nodes are compared, so the work is in pairs of communities, not in nodes.
    """
    from .paths import connected

    pairs = containment(members).filter(F.col("share") > share).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    names = connected(pairs).withColumnRenamed("node", "community")
    rows = members.join(names, "community", "left")
    return rows.select("node", F.coalesce("label", "community").alias("community")).distinct()


def block_loglik(edges: DataFrame, blocks: DataFrame, corrected: bool = False) -> DataFrame:
    """One row: log-likelihood of a block model, sum of m_rs log(m_rs / (n_r n_s)) over both orders.

    ``corrected`` takes degree sums in place of block sizes.
    """
    b = blocks.select("node", "block")
    ends = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("src", "dst")
    m = ends.join(b.toDF("src", "r"), "src").join(b.toDF("dst", "s"), "dst").groupBy("r", "s").agg(F.count("*").cast("double").alias("m"))
    size = m.groupBy("r").agg(F.sum("m").alias("n")) if corrected else b.groupBy(F.col("block").alias("r")).agg(F.count("*").cast("double").alias("n"))
    rows = m.join(size.toDF("r", "nr"), "r").join(size.toDF("s", "ns"), "s")
    return rows.agg(F.sum(F.col("m") * F.ln(F.col("m") / (F.col("nr") * F.col("ns")))).alias("loglik"))


def information_criteria(loglik: float, communities: int, nodes: int, edges: int, weights) -> dict[str, float]:
    """BIC of the graph and of the regressions, entropy of the affiliations, and ICL."""
    import numpy as np

    w = np.asarray(weights, float)
    w = w[w > 0]
    bic = -2 * loglik + communities * nodes * np.log(edges)
    entropy = float((w * np.log(w)).sum())
    return {"bic": float(bic), "bic_reg": float(-2 * loglik + communities * np.log(nodes)), "entropy": entropy, "icl": float(bic + 2 * entropy)}
