"""Orders of rows and columns: numbering at scale, postorders, level orders, minimum degree and large diagonals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ijvory.operators.graphs import bfs_levels, matching, strong_components
from ijvory.operators.maintain import droptol
from ijvory.operators.rounds import settle
from ijvory.operators.trees import depths


def before(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows that come before in the order of ``keys``.

    Rows are dealt out by ranges; only one total per range meets in one task.
    """
    ranges = df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()).withColumn("_value", value)
    ranges = settle(ranges)
    own = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("_range").agg(F.sum("_value").alias("_total"))
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(below), F.lit(0)).alias("_start"))
    summed = ranges.withColumn("_own", F.coalesce(F.sum("_value").over(own), F.lit(0))).join(F.broadcast(starts), "_range")
    return summed.withColumn(name, F.col("_start") + F.col("_own")).drop("_range", "_value", "_own", "_start")


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """A permutation ``(k, at)`` of the nodes of ``df``, in the order of ``keys``."""
    return before(df, keys, F.lit(1).cast("long"), "k").select("k", F.col("node").alias("at"))


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """``(node, parent, level, size)``: nodes of each subtree, summed from the deepest level up."""
    nodes = settle(tree.join(depths(tree), "node").select("node", "parent", "level"))
    deepest = nodes.agg(F.max("level")).first()[0]
    out = below = None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        now = nodes.where(F.col("level") == level)
        if below is None:
            now = now.withColumn("size", F.lit(1).cast("long"))
        else:
            sums = below.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("more"))
            now = now.join(sums, "node", "left").select("node", "parent", "level", (F.coalesce("more", F.lit(0)) + 1).alias("size"))
        below = settle(now)
        out = below if out is None else out.unionByName(below)
    return out if out is not None else nodes.withColumn("size", F.lit(1).cast("long"))


def postorder(tree: DataFrame) -> DataFrame:
    """``(node, post, first, level)``: place in postorder, children ascending; place of the first descendant; depth.

    A subtree begins where its parent's begins plus the sizes of its smaller
    siblings; these starts add up along the path to the root, by doubling.
    """
    sizes = settle(before(subtree_sizes(tree), ["parent", "node"], F.col("size"), "ahead"))
    eldest = sizes.groupBy("parent").agg(F.min("ahead").alias("least"))
    at = sizes.join(eldest, "parent").select("node", F.col("parent").alias("up"), "level", "size", (F.col("ahead") - F.col("least")).alias("start"))
    at = settle(at)
    while not at.where("up >= 0").isEmpty():
        over = at.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("start").alias("more"))
        at = at.join(over, "up", "left").select("node", F.coalesce("next", F.lit(-1)).alias("up"), "level", "size", (F.col("start") + F.coalesce("more", F.lit(0))).alias("start"))
        at = settle(at)
    return at.select("node", (F.col("start") + F.col("size") - 1).alias("post"), F.col("start").alias("first"), "level")


def common_ancestors(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, ancestor)``: the lowest common ancestor of each pair ``(a, b)``; -1 in different trees.

    The deeper of the two climbs, both if they are level, until they meet.
    """
    at = settle(tree.join(depths(tree), "node").select("node", "parent", "level"))
    left = at.select(F.col("node").alias("x"), F.col("parent").alias("px"), F.col("level").alias("lx"))
    right = at.select(F.col("node").alias("y"), F.col("parent").alias("py"), F.col("level").alias("ly"))
    open_, done = settle(pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")).distinct()), None
    while True:
        met = open_.where("x = y OR x < 0 OR y < 0").select("a", "b", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.lit(-1)).alias("ancestor"))
        done = met if done is None else done.unionByName(met)
        rest = open_.where("x <> y AND x >= 0 AND y >= 0")
        if rest.isEmpty():
            return done
        both = rest.join(left, "x").join(right, "y")
        open_ = settle(both.select("a", "b", F.when(F.col("lx") >= F.col("ly"), F.col("px")).otherwise(F.col("x")).alias("x"), F.when(F.col("ly") >= F.col("lx"), F.col("py")).otherwise(F.col("y")).alias("y")))


def degrees(graph: DataFrame) -> DataFrame:
    """``(node, degree)`` of a symmetric pattern."""
    return graph.where("i <> j").groupBy(F.col("j").alias("node")).agg(F.count_distinct("i").alias("degree"))


def reverse_levels(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """A permutation ``(k, at)`` that keeps neighbours near: reverse breadth-first levels, by degree within a level.

    Each component starts from its node of least degree.
    """
    sized = settle(strong_components(graph, nodes).join(degrees(graph), "node", "left").select("node", "label", F.coalesce("degree", F.lit(0)).alias("degree")))
    starts = sized.groupBy("label").agg(F.min(F.struct("degree", "node")).alias("x")).select("x.node")
    levels = bfs_levels(graph, starts)
    placed = sized.join(levels, "node").select("node", (-F.col("label")).alias("a"), (-F.col("level")).alias("b"), (-F.col("degree")).alias("c"), (-F.col("node")).alias("d"))
    return numbered(placed, ["a", "b", "c", "d"])


def halves(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, side)``: the first and the second half in the order of ``reverse_levels``."""
    order = settle(reverse_levels(graph, nodes))
    middle = (order.count() + 1) // 2
    return order.select(F.col("at").alias("node"), F.when(F.col("k") < middle, 0).otherwise(1).alias("side"))


def node_separator(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, side)``: 0 and 1 have no edge between them; 2 is the separator, a least cover of the edges between the halves."""
    side = settle(halves(graph, nodes))
    mark = lambda c: side.select(F.col("node").alias(c), F.col("side").alias(f"{c}_side"))
    crossing = settle(graph.select("i", "j").join(mark("i"), "i").join(mark("j"), "j").where("i_side = 0 AND j_side = 1").select("i", "j"))
    matched = settle(matching(crossing))
    # alternating paths from rows without a partner: the cover is the columns that they reach and the rows that they don't
    seen = frontier = settle(crossing.select("i").distinct().join(matched.select("i"), "i", "left_anti"))
    cols = settle(crossing.select("j").limit(0))
    while not frontier.isEmpty():
        new = settle(frontier.join(crossing, "i").select("j").distinct().join(cols, "j", "left_anti"))
        cols = settle(cols.unionByName(new))
        frontier = settle(new.join(matched, "j").select("i").distinct().join(seen, "i", "left_anti"))
        seen = settle(seen.unionByName(frontier))
    rows = matched.select("i").join(seen, "i", "left_anti")
    cover = rows.select(F.col("i").alias("node")).unionByName(cols.select(F.col("j").alias("node"))).distinct().withColumn("cut", F.lit(True))
    return side.join(cover, "node", "left").select("node", F.when(F.col("cut"), 2).otherwise(F.col("side")).alias("side"))


def minimum_degree(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, round, degree)``: eliminate, round after round, all nodes whose degree is least among their neighbours and near the least of all.

    "Near" is up to a quarter more, so that a node of high degree waits even where its neighbours have higher ones. Such nodes are no neighbours of one another, so they go together; the
    neighbours of each are joined up. Order by round, then node. Equal degrees
    are told apart by a hash, which lets many nodes of a round go.
    """
    edges = settle(graph.where("i <> j").select("i", "j").distinct())
    left, out, rounds = settle(nodes.select("node").distinct()), None, 0
    while not left.isEmpty():
        size = edges.groupBy(F.col("j").alias("node")).agg(F.count("*").alias("degree"))
        rank = settle(left.join(size, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree")).withColumn("rank", F.struct("degree", F.xxhash64("node"), "node")))
        lowest = rank.agg(F.min("degree")).first()[0]
        lower = edges.join(rank.select(F.col("node").alias("i"), F.col("rank").alias("other")), "i").groupBy(F.col("j").alias("node")).agg(F.min("other").alias("least"))
        now = settle(rank.join(lower, "node", "left").where("least IS NULL OR rank < least").where(F.col("degree") <= 1.25 * lowest).select("node", "degree"))
        found = now.select("node", F.lit(rounds).alias("round"), "degree")
        out = found if out is None else out.unionByName(found)
        gone = now.select("node")
        spokes = edges.join(gone.select(F.col("node").alias("j")), "j", "left_semi")
        fill = spokes.join(spokes.select(F.col("i").alias("k"), "j"), "j").where("i <> k").select("i", F.col("k").alias("j"))
        kept = edges.join(gone.select(F.col("node").alias("i")), "i", "left_anti").join(gone.select(F.col("node").alias("j")), "j", "left_anti")
        edges = settle(kept.unionByName(fill).distinct())
        left = settle(left.join(gone, "node", "left_anti"))
        rounds += 1
    return out if out is not None else left.select("node", F.lit(0).alias("round"), F.lit(0).cast("long").alias("degree"))


def large_diagonal(a: DataFrame, tol: float = 0.2) -> DataFrame:
    """``(i, j)``: a matching of rows and columns over entries above ``tol`` of their column's largest."""
    largest = a.groupBy("j").agg(F.max("v").alias("top"))
    scaled = a.join(largest, "j").select("i", "j", F.try_divide("v", "top").alias("v")).where("v IS NOT NULL")
    return matching(droptol(scaled, tol))
