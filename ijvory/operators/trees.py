"""Symbolic factorisation: elimination trees, row subtrees and counts of the factor's entries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ijvory.operators.rounds import afresh, settle

#: Edges of which one task finds the tree.
FITS = 1 << 15


def fill_pattern(a: DataFrame) -> DataFrame:
    """``(i, j)``, j < i: the strict lower pattern of the Cholesky factor of a symmetric pattern.

    L(i, j) is an entry if a path from i to j runs over nodes below both. Paths
    are followed by rounds; of the paths to a node the one with the least
    highest node matters.
    """
    edges = settle(a.where("i <> j").select("i", "j").distinct())
    best = frontier = settle(edges.select(F.col("i").alias("s"), F.col("j").alias("c"), F.lit(-1).cast("long").alias("top")))
    while not frontier.isEmpty():
        ahead = frontier.join(edges, F.col("c") == F.col("i")).select("s", "j", F.greatest("top", "c").alias("top"))
        ahead = ahead.where("top < s AND j <> s").groupBy("s", F.col("j").alias("c")).agg(F.min("top").alias("top"))
        old = best.withColumnRenamed("top", "old")
        frontier = settle(ahead.join(old, ["s", "c"], "left").where("old IS NULL OR top < old").select("s", "c", "top"))
        best = settle(best.unionByName(frontier).groupBy("s", "c").agg(F.min("top").alias("top")))
    return best.where("c < s AND top < c").select(F.col("s").alias("i"), F.col("c").alias("j"))


def _grown(cells: pa.Table) -> pa.Table:
    """``(node, parent)`` of the edges ``(x, y)``, x < y, of one part: each climbs from x to the top so far, which is tied to y."""
    x, y = (cells.column(c).to_numpy() for c in "xy")
    order = np.argsort(y, kind="stable")
    above: dict[int, int] = {}
    parent: dict[int, int] = {}
    for at, top in zip(x[order].tolist(), y[order].tolist()):
        while at != top:
            up = above.get(at)
            above[at] = top
            if up is None:
                parent[at] = top
                break
            at = up
    return pa.table({"node": pa.array(list(parent), pa.int64()), "parent": pa.array(list(parent.values()), pa.int64())})


def _parents(edges: DataFrame, fits: int) -> DataFrame:
    """``(node, parent)`` of the elimination tree of edges ``(x, y)``, x < y, roots left out.

    Edges of more than a task are halved by their higher end, in all parts side by side. The components of the
    lower half are subtrees; each hangs by its highest node from the least node above that it has an edge to,
    and counts in the upper half as edges of that node to the others.
    """
    from ijvory.operators.graphs import connected

    now, out = settle(edges.select(F.lit(1).cast("long").alias("part"), "x", "y").distinct()), []
    while True:
        sizes = now.groupBy("part").agg(F.count("*").alias("n"), F.percentile_approx("y", 0.5).alias("m"), F.max("y").alias("top"))
        large = settle(sizes.where(F.col("n") > fits).select("part", F.least("m", F.col("top") - 1).alias("m")))
        if large.isEmpty():
            break
        split = settle(now.join(large, "part"))
        low, cross = split.where("y <= m"), split.where("y > m")
        tied = settle(connected(low.select(F.col("x").alias("i"), F.col("y").alias("j"))))
        last = tied.join(tied.groupBy("root").agg(F.max("node").alias("last")), "root").select(F.col("node").alias("x"), "last")
        below = settle(cross.where("x <= m").join(last, "x", "left").select("part", F.coalesce("last", "x").alias("c"), "y"))
        hung = settle(below.groupBy("c").agg(F.min("y").alias("u")))
        out.append(hung.select(F.col("c").alias("node"), F.col("u").alias("parent")))
        star = below.join(hung, "c").where("u <> y").select((F.col("part") * 2 + 1).alias("part"), F.col("u").alias("x"), "y")
        high = star.unionByName(cross.where("x > m").select((F.col("part") * 2 + 1).alias("part"), "x", "y")).distinct()
        now = settle(now.join(large, "part", "left_anti").unionByName(low.select((F.col("part") * 2).alias("part"), "x", "y")).unionByName(high))
    found = now.groupBy("part").applyInArrow(_grown, "node long, parent long")
    for more in out:
        found = found.unionByName(more)
    return found


def etree(a: DataFrame, n: int, fits: int = FITS) -> DataFrame:
    """``(node, parent)`` of an n x n symmetric pattern; roots have parent -1."""
    up = _parents(a.where("i <> j").select(F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y")), fits)
    nodes = a.sparkSession.range(n).withColumnRenamed("id", "node")
    return nodes.join(up, "node", "left").select("node", F.coalesce("parent", F.lit(-1)).alias("parent"))


def _tour(tree: DataFrame) -> DataFrame:
    """``(node, parent, root, e, d, level)``: nodes of its tree from this one to the last in postorder, from its first descendant to the last, and its depth.

    The tour goes down and up each edge, children ascending; its steps to the end are counted by pointer doubling.
    """
    up, down = lambda c: F.col(c) * 2 + 1, lambda c: F.col(c) * 2
    nodes = settle(tree.select("node", "parent"))
    kin = nodes.where("parent >= 0").select("node", F.lead("node").over(Window.partitionBy("parent").orderBy("node")).alias("sibling"))
    child = nodes.where("parent >= 0").groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("child"))
    near = nodes.join(kin, "node", "left").join(child, "node", "left")
    on = F.when(F.col("sibling").isNotNull(), down("sibling")).when(F.col("parent") >= 0, up("parent"))
    steps = F.array(
        F.struct(down("node").alias("at"), F.coalesce(down("child"), up("node")).alias("next"), F.lit(0).alias("ups"), F.lit(1).alias("downs")),
        F.struct(up("node").alias("at"), on.alias("next"), F.lit(1).alias("ups"), F.lit(0).alias("downs")),
    )
    at = near.select(F.explode(steps).alias("s")).select("s.at", "s.next", F.col("s.ups").cast("long").alias("ups"), F.col("s.downs").cast("long").alias("downs"), F.col("s.at").alias("end"))
    at = afresh(at)
    while not at.where("next IS NOT NULL").isEmpty():
        far = at.select(F.col("at").alias("next"), F.col("next").alias("next2"), F.col("ups").alias("ups2"), F.col("downs").alias("downs2"), F.col("end").alias("end2"))
        more = lambda c: (F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c)
        at = afresh(at.join(far, "next", "left").select("at", F.col("next2").alias("next"), more("ups"), more("downs"), F.coalesce("end2", "end").alias("end")))
    both = at.groupBy(F.floor(F.col("at") / 2).alias("node")).agg(
        F.floor(F.max("end") / 2).alias("root"), F.min("ups").alias("e"), F.max("ups").alias("d"), F.max(F.when(F.col("at") % 2 == 1, F.col("ups") - F.col("downs") - 1)).alias("level"),
    )
    return afresh(nodes.join(both, "node"))


def _meetings(tour: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(node)``: where the ``pairs (root, a, b)`` of places in postorder meet, a before b: the parent of the least deep node from a to before b."""
    pairs = settle(pairs.withColumn("k", F.floor(F.log2((F.col("a") - F.col("b")).cast("double"))).cast("int")))
    most = pairs.agg(F.max("k")).first()[0]
    if most is None:
        return tour.select("node").limit(0)
    held, found = afresh(tour.select("root", "e", F.struct("level", "parent").alias("least"))), None
    for k in range(most + 1):
        here = pairs.where(F.col("k") == k).select("root", "b", "a").withColumn("id", F.monotonically_increasing_id())
        ends = here.select("id", "root", F.explode(F.array(F.col("b") + 1, F.col("a") - (1 << k) + 1)).alias("e"))
        met = ends.join(held, ["root", "e"]).groupBy("id").agg(F.min("least").alias("least")).select(F.col("least.parent").alias("node"))
        found = met if found is None else found.unionByName(met)
        if k < most:
            far = held.select("root", (F.col("e") - (1 << k)).alias("e"), F.col("least").alias("other"))
            held = afresh(held.join(far, ["root", "e"], "left").select("root", "e", F.least("least", F.coalesce("other", "least")).alias("least")))
    return found


def depths(tree: DataFrame) -> DataFrame:
    """``(node, level)``: steps from each node to its root, by pointer doubling."""
    at = settle(tree.select("node", F.col("parent").alias("up"), F.when(F.col("parent") < 0, 0).otherwise(1).cast("long").alias("level")))
    while not at.where("up >= 0").isEmpty():
        over = at.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        at = settle(at.join(over, "up", "left").select("node", F.coalesce("next", F.lit(-1)).alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
    return at.select("node", "level")


def height(tree: DataFrame) -> DataFrame:
    """One row ``height``: nodes on the longest path to a root."""
    return depths(tree).agg((F.max("level") + 1).alias("height"))


def row_subtrees(a: DataFrame, tree: DataFrame) -> DataFrame:
    """``(k, node)``: the strict row patterns of the factor, climbing the tree from A's entries above the diagonal."""
    up = tree.select("node", "parent")
    seen = frontier = settle(a.where("i < j").select(F.col("j").alias("k"), F.col("i").alias("node")).distinct())
    while not frontier.isEmpty():
        ahead = frontier.join(up, "node").where("parent >= 0 AND parent < k").select("k", F.col("parent").alias("node")).distinct()
        frontier = settle(ahead.join(seen, ["k", "node"], "left_anti"))
        seen = settle(seen.unionByName(frontier))
    return seen


def row_counts(a: DataFrame, tree: DataFrame) -> DataFrame:
    """``(node, n)``: entries in each row of the factor, the diagonal included."""
    n = row_subtrees(a, tree).groupBy(F.col("k").alias("node")).agg(F.count("*").alias("n"))
    return tree.select("node").join(n, "node", "left").select("node", (F.coalesce("n", F.lit(0)) + 1).alias("n"))


def column_counts(a: DataFrame, tree: DataFrame) -> DataFrame:
    """``(node, n)``: entries in each column of the factor, the diagonal included.

    A column counts the rows whose subtrees hold its node. A row's subtree has a leaf at each of A's entries
    that has none below it; its paths from them are counted from each leaf up, less one where a path meets
    the one before. The sum of these over a node's descendants is its count, found without the factor's pattern.
    """
    from ijvory.operators.orderings import before

    tour = _tour(tree)
    place = tour.select(F.col("node").alias("i"), "root", "e", "d")
    cells = a.where("i < j").select("i", F.col("j").alias("row")).distinct().join(place, "i")
    past = F.lag("e").over(Window.partitionBy("row").orderBy(F.desc("e")))
    leaves = settle(cells.withColumn("past", past).where("past IS NULL OR past > d").select("i", "root", "e", "past"))
    met = _meetings(tour, leaves.where("past IS NOT NULL").select("root", F.col("past").alias("a"), F.col("e").alias("b")))
    inner = tree.where("parent >= 0").select(F.col("parent").alias("node"))
    alone = tree.select("node").join(inner, "node", "left_anti")
    marks = lambda df, value: df.select("node", F.lit(value).cast("long").alias("n"))
    parts = marks(leaves.select(F.col("i").alias("node")), 1).unionByName(marks(met, -1)).unionByName(marks(inner, -1)).unionByName(marks(alone, 1))
    delta = tour.join(parts.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").select("node", "root", "e", "d", (-F.col("e")).alias("at"), F.coalesce("n", F.lit(0)).alias("own"))
    summed = settle(before(delta, ["root", "at"], F.col("own"), "past"))
    start = summed.select("root", F.col("e").alias("d"), F.col("past").alias("start"))
    return summed.join(start, ["root", "d"]).select("node", (F.col("past") + F.col("own") - F.col("start")).alias("n"))


def path_to_root(tree: DataFrame, sources: DataFrame) -> DataFrame:
    """``(pos, node)``: the nodes of ``sources (node)`` and all above them, children before parents."""
    from ijvory.operators.graphs import reach
    from ijvory.operators.orderings import before

    up = tree.where("parent >= 0").select(F.col("parent").alias("i"), F.col("node").alias("j"))
    found = reach(up, sources).join(depths(tree), "node").withColumn("deep", -F.col("level"))
    return before(found, ["deep", "node"], F.lit(1).cast("long"), "pos").select("pos", "node")


def normal_counts(a: DataFrame, n: int) -> DataFrame:
    """``(node, parent, r)`` for each of n columns: the tree of AᵀA and the entries of the row of R."""
    from ijvory.operators.graphs import star_of_normal

    star = settle(star_of_normal(a))
    tree = settle(etree(star, n))
    return tree.join(column_counts(star, tree).withColumnRenamed("n", "r"), "node")


def householder_counts(a: DataFrame, n: int) -> DataFrame:
    """``(node, parent, v, r, extra)`` for each of n columns: entries of the Householder vector and of the row of R, for the tree of AᵀA.

    A row enters at its first column; a column's vector has the rows that enter there and those that
    its children leave over, all but one each. ``extra`` is 1 where there is none, and an empty row has to be added.
    """
    counted = settle(normal_counts(a, n))
    tree = counted.select("node", "parent")
    rows = a.groupBy("i").agg(F.min("j").alias("node")).groupBy("node").agg(F.count("*").alias("own"))
    nodes = settle(tree.join(depths(tree), "node").join(rows, "node", "left").select("node", "parent", "level", F.coalesce("own", F.lit(0)).alias("own")))
    deepest = nodes.agg(F.max("level")).first()[0]
    out = left = None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        now = nodes.where(F.col("level") == level)
        if left is not None:
            more = left.groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("v") - 1).alias("more"))
            now = now.join(more, "node", "left")
        else:
            now = now.withColumn("more", F.lit(0))
        found = F.col("own") + F.coalesce("more", F.lit(0))
        left = settle(now.select("node", "parent", F.greatest(found, F.lit(1)).alias("v"), (found == 0).cast("int").alias("extra")))
        out = left if out is None else out.unionByName(left)
    return out.join(counted.select("node", "r"), "node").select("node", "parent", "v", "r", "extra")
