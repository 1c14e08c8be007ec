"""Graphs of matrices: column j points to the rows i of its entries. Frontiers advance by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.operators.products import normal_pattern
from ijvory.operators.rounds import afresh, settle


def bfs_levels(a: DataFrame, sources: DataFrame) -> DataFrame:
    """``(node, level)``: the least number of steps from ``sources (node)`` along j -> i."""
    edges = a.select("i", "j").distinct()
    seen = frontier = settle(sources.select("node").distinct().withColumn("level", F.lit(0)))
    level = 0
    while not frontier.isEmpty():
        level += 1
        ahead = frontier.join(edges, F.col("node") == F.col("j")).select(F.col("i").alias("node")).distinct()
        frontier = settle(ahead.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen


#: Steps that ``reach`` takes edge by edge before it contracts the graph.
STEPS = 8


def reach(a: DataFrame, sources: DataFrame) -> DataFrame:
    """``(node)``: all nodes that the sources reach, themselves included.

    What is not reached in STEPS steps is searched by strong components, with shortcuts along
    nodes that have one edge out, so rings and chains of any length take few rounds.
    """
    edges = settle(a.where("i <> j").select("i", "j").distinct())
    seen, frontier = _advance(edges, sources, STEPS)
    if frontier.isEmpty():
        return seen
    seen = settle(seen.distinct())
    labels = settle(strong_components(edges, edges.select(F.explode(F.array("i", "j")).alias("node")).unionByName(seen)))
    at = lambda c, name: labels.select(F.col("node").alias(c), F.col("label").alias(name))
    between = settle(edges.join(at("i", "x"), "i").join(at("j", "y"), "j").where("x <> y").select(F.col("x").alias("i"), F.col("y").alias("j")).distinct())
    found, _ = _advance(settle(between.unionByName(_shortcuts(between)).distinct()), labels.join(seen, "node", "left_semi").select(F.col("label").alias("node")))
    return labels.join(found.select(F.col("node").alias("label")), "label", "left_semi").select("node")


def _advance(edges: DataFrame, sources: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(node)`` found in at most so many steps from ``sources (node)``, and those of the last step."""
    seen = frontier = settle(sources.select("node").distinct())
    steps = 0
    while not frontier.isEmpty() and (most is None or steps < most):
        ahead = frontier.join(edges, F.col("node") == F.col("j")).select(F.col("i").alias("node")).distinct()
        frontier = settle(ahead.join(seen, "node", "left_anti"))
        seen = seen.unionByName(frontier)
        steps += 1
        if steps % STEPS == 0:
            seen = settle(seen.distinct())
    return seen, frontier


def _shortcuts(edges: DataFrame) -> DataFrame:
    """Edges ``(i, j)`` over 2, 4, 8 .. steps of an acyclic graph along nodes with one edge out."""
    at = settle(edges.groupBy("j").agg(F.count("*").alias("n"), F.min("i").alias("i")).where("n = 1").select("i", "j"))
    out = at
    while not at.isEmpty():
        at = settle(at.join(at.select(F.col("i").alias("far"), F.col("j").alias("i")), "i").groupBy("j").agg(F.min("far").alias("i")).select("i", "j"))
        out = out.unionByName(at)
    return out


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)``: each node of undirected ``edges (i, j)`` with the least node it is connected to, by large-star and small-star steps."""
    tied = afresh(edges.where("i <> j").select(F.greatest("i", "j").alias("hi"), F.least("i", "j").alias("lo")).distinct())
    while True:
        both = tied.unionByName(tied.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = afresh(tied.join(least, F.col("lo") == F.col("u")).select("hi", F.col("m").alias("lo")).distinct())
        floor = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        hops = large.join(floor, F.col("hi") == F.col("u")).select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("x"))
        new = afresh(hops.select("x.*").where("lo <> hi").distinct())
        if new.exceptAll(tied).isEmpty() and tied.exceptAll(new).isEmpty():
            return new.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(new.select("lo", "lo").distinct().toDF("node", "root"))
        tied = new


def topological_levels(a: DataFrame) -> DataFrame:
    """``(node, level)`` for an acyclic graph: one more than the highest level that points to it, sources 0.

    Raises an error for a cycle, which leaves nodes that never become free.
    """
    edges = afresh(a.where("i <> j").select("i", "j").distinct())
    left = afresh(a.select(F.explode(F.array("i", "j")).alias("node")).distinct())
    done, level = None, 0
    while not left.isEmpty():
        held = edges.join(left.select(F.col("node").alias("j")), "j", "left_semi").select(F.col("i").alias("node")).distinct()
        free = settle(left.join(held, "node", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        done = free if done is None else done.unionByName(free)
        left = settle(left.join(free.select("node"), "node", "left_anti"))
        level += 1
    return done if done is not None else left.withColumn("level", F.lit(0))


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The least label that reaches each node along s -> d, by rounds until nothing changes."""
    while True:
        ahead = labels.join(edges, F.col("node") == F.col("s")).select(F.col("d").alias("node"), "label")
        new = settle(labels.unionByName(ahead).groupBy("node").agg(F.min("label").alias("label")))
        if new.exceptAll(labels).isEmpty():
            return new
        labels = new


def _colored(edges: DataFrame, left: DataFrame) -> DataFrame | None:
    """``(node, label)`` of the strong components of ``edges (s, d)``, forward and backward from the smallest nodes of all parts at once."""
    done = None
    while not left.isEmpty():
        forward = _spread(edges, left.withColumn("label", F.col("node")))
        # edges inside a forward class only: a component never leaves its class
        mark = forward.select(F.col("node").alias("s"), F.col("label").alias("x"))
        inner = edges.join(mark, "s").join(forward.select(F.col("node").alias("d"), F.col("label").alias("y")), "d").where("x = y").select("s", "d")
        inner = settle(inner)
        back = inner.select(F.col("d").alias("s"), F.col("s").alias("d"))
        start = forward.withColumn("label", F.when(F.col("label") == F.col("node"), F.col("node")).otherwise(F.lit(2**62)))
        found = _spread(back, start).where(F.col("label") < 2**62)
        done = found if done is None else done.unionByName(found)
        left = settle(left.join(found, "node", "left_anti"))
        edges = settle(inner.join(left.select(F.col("node").alias("s")), "s").join(left.select(F.col("node").alias("d")), "d").select("s", "d"))
    return done


def _links(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, tail, head)`` and ``(node, label)``: nodes with one edge in and one out, by doubling.

    The first has those on a chain between two other nodes, the second those on a ring of their own.
    """
    one = lambda own, other, name: edges.groupBy(F.col(own).alias("node")).agg(F.count("*").alias("n"), F.min(other).alias(name)).where("n = 1").drop("n")
    at = afresh(one("d", "s", "tail").join(one("s", "d", "head"), "node").withColumn("low", F.col("node")))
    rounds = max(1, at.count()).bit_length() + 1
    for _ in range(rounds):
        on = at.select(F.col("node").alias("head"), F.col("head").alias("head2"), F.col("low").alias("low2"))
        back = at.select(F.col("node").alias("tail"), F.col("tail").alias("tail2"))
        step = at.join(on, "head", "left").join(back, "tail", "left")
        moved = (F.col("head2").isNotNull() | F.col("tail2").isNotNull()).alias("moved")
        at = afresh(step.select("node", F.coalesce("tail2", "tail").alias("tail"), F.coalesce("head2", "head").alias("head"), F.least("low", F.coalesce("low2", "low")).alias("low"), moved))
        if at.where("moved").isEmpty():
            return at.select("node", "tail", "head"), at.select("node", F.col("low").alias("label")).limit(0)
    # whoever still points to a link is on a ring, and has seen all of it
    ring = settle(at.join(at.select(F.col("node").alias("head")), "head", "left_semi"))
    chain = at.join(ring.select("node"), "node", "left_anti")
    return chain.select("node", "tail", "head"), ring.select("node", F.col("low").alias("label"))


def strong_components(a: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, label)``: nodes that reach one another have the smallest of them as label.

    Nodes without an edge in or out are components of their own and go; chains of nodes with one
    edge in and one out become single edges, by doubling; both again while anything goes. Chains,
    rings and trees of any length so take a number of rounds that grows with the
    logarithm. What is left is searched forward and backward. At the end a node
    of a chain belongs to the component of both its ends, or else stands alone.
    """
    edges = settle(a.where("i <> j").select(F.col("j").alias("s"), F.col("i").alias("d")).distinct())
    count, chains, labels = edges.count(), [], None
    while count:
        inner = edges.join(edges.select(F.col("d").alias("s")).distinct(), "s", "left_semi").join(edges.select(F.col("s").alias("d")).distinct(), "d", "left_semi")
        inner = settle(inner.select("s", "d"))
        chain, ring = _links(inner)
        # by minima, so that Spark doesn't carry along what it has inferred about the doubled columns
        chain = settle(chain.groupBy("node").agg(F.min("tail").alias("tail"), F.min("head").alias("head")))
        ring = settle(ring.groupBy("node").agg(F.min("label").alias("label")))
        labels = ring if labels is None else labels.unionByName(ring)
        if not chain.isEmpty():
            chains.append(chain)
        gone = chain.select("node").unionByName(ring.select("node"))
        kept = inner.join(gone.select(F.col("node").alias("s")), "s", "left_anti").join(gone.select(F.col("node").alias("d")), "d", "left_anti")
        new = chain.where("tail <> head").select(F.col("tail").alias("s"), F.col("head").alias("d"))
        edges = afresh(kept.select("s", "d").unionByName(new).distinct())
        before, count = count, edges.count()
        if count == before:
            break
    if count:
        found = _colored(edges, settle(edges.select(F.explode(F.array("s", "d")).alias("node")).distinct()))
        labels = found if labels is None else labels.unionByName(found)
    if labels is None:
        return nodes.select("node").distinct().withColumn("label", F.col("node"))
    labels = settle(labels.groupBy("node").agg(F.min("label").alias("label")))
    for chain in reversed(chains):
        # an end that no component has is one of its own
        ends = chain.select("node", "tail", F.explode(F.array("tail", "head")).alias("end")).join(labels.withColumnRenamed("node", "end"), "end", "left")
        own = F.coalesce("label", "end")
        both = ends.groupBy("node").agg(F.min("tail").alias("tail"), F.min(own).alias("label"), F.max(own).alias("other")).where("label = other")
        found = both.select(F.explode(F.array("node", "tail")).alias("node"), "label")
        labels = settle(labels.unionByName(found).groupBy("node").agg(F.min("label").alias("label")))
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    known = labels.join(least, "label").select("node", "least")
    return afresh(nodes.select("node").distinct().join(known, "node", "left").select("node", F.coalesce("least", "node").alias("label")))


def graph_of_sum(a: DataFrame) -> DataFrame:
    """The pattern of A + Aᵀ without its diagonal."""
    a = a.select("i", "j").where("i <> j")
    return a.unionByName(a.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def graph_of_normal(a: DataFrame, dense: int | None = None) -> DataFrame:
    """The pattern of AᵀA without its diagonal, and without rows of more than ``dense`` entries if given."""
    if dense is not None:
        a = a.join(a.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") > dense), "i", "left_anti")
    return normal_pattern(a).where("i <> j")


def star_of_normal(a: DataFrame) -> DataFrame:
    """Edges ``(i, j)``, both ways, from the first column of each row of A to its others.

    The pattern of AᵀA joins all columns of a row. Eliminated, this star of as many edges as A has
    entries fills up to the same pattern, so it has the same elimination tree and counts.
    """
    first = a.groupBy("i").agg(F.min("j").alias("first"))
    rays = a.select("i", "j").join(first, "i").where("j > first").select(F.col("first").alias("i"), "j").distinct()
    return rays.unionByName(rays.select(F.col("j").alias("i"), F.col("i").alias("j")))


def reach_in_order(a: DataFrame, sources: DataFrame) -> DataFrame:
    """``(pos, node)``: what ``sources (node)`` reach, so that every edge between them leads to a later one; an error for a cycle."""
    from ijvory.operators.orderings import before

    found = settle(reach(a, sources))
    inside = a.select("i", "j").join(found.select(F.col("node").alias("i")), "i", "left_semi").join(found.select(F.col("node").alias("j")), "j", "left_semi")
    alone = found.select(F.col("node").alias("i"), F.col("node").alias("j"))
    return before(topological_levels(inside.unionByName(alone)), ["level", "node"], F.lit(1).cast("long"), "pos").select("pos", "node")


def peel_triangular(a: DataFrame) -> DataFrame:
    """``(i, j, round)``: rows left with one entry, round after round, each with the column that goes with it.

    If all rows are peeled, the matrix is a permuted triangular one; in a round
    that finds two rows for a column the smaller row takes it.
    """
    left, out, rounds = settle(a.select("i", "j").distinct()), None, 0
    while True:
        single = left.groupBy("i").agg(F.count("*").alias("n"), F.bit_xor("j").alias("j")).where("n = 1")
        taken = settle(single.groupBy("j").agg(F.min("i").alias("i")).select("i", "j", F.lit(rounds).alias("round")))
        if taken.isEmpty():
            return taken if out is None else out
        out = taken if out is None else out.unionByName(taken)
        left = settle(left.join(taken.select("j"), "j", "left_anti").join(taken.select("i"), "i", "left_anti"))
        rounds += 1


def matching(a: DataFrame) -> DataFrame:
    """``(i, j)``: a maximum matching of rows and columns.

    Greedy rounds first; then columns without a row look for augmenting paths
    all at once, level by level, and those that share no node are flipped.
    """
    cells = settle(a.select("i", "j").distinct())
    matched, rounds = settle(cells.limit(0)), 0
    while True:  # greedy: each free row asks its least free column, which takes its least row
        free = cells.join(matched.select("i"), "i", "left_anti").join(matched.select("j"), "j", "left_anti")
        asked = free.groupBy("i").agg(F.min("j").alias("j")).groupBy("j").agg(F.min("i").alias("i")).select("i", "j")
        asked = settle(asked)
        if asked.isEmpty():
            break
        matched, rounds = matched.unionByName(asked), rounds + 1
        if rounds % STEPS == 0:
            matched = settle(matched)
    matched = settle(matched)
    while True:
        # paths column - row = column - row ..., kept as the list of columns and rows so far
        start = cells.join(matched.select("j"), "j", "left_anti").select("j").distinct()
        paths = settle(start.select(F.col("j").alias("root"), "j", F.array("j").alias("cols"), F.array().cast("array<bigint>").alias("rows")))
        seen = settle(cells.select("i").limit(0))
        flip = None
        while not paths.isEmpty():
            steps = paths.join(cells, "j").join(seen, "i", "left_anti")
            # a row is visited once, by its least root
            steps = steps.groupBy("i").agg(F.min(F.struct("root", "cols", "rows")).alias("x")).select("i", "x.*")
            steps = settle(steps.select("i", "root", "cols", F.concat("rows", F.array("i")).alias("rows")))
            ends = steps.join(matched.select("i"), "i", "left_anti")
            if not ends.isEmpty():
                flip = ends.groupBy("root").agg(F.min(F.struct("cols", "rows")).alias("x")).select("x.*")
                break
            seen = settle(seen.unionByName(steps.select("i")))
            paths = settle(steps.join(matched, "i").select("root", "j", F.concat("cols", F.array("j")).alias("cols"), "rows"))
        if flip is None:
            return matched
        # trees of different roots share no row, so all their paths can be flipped together
        new = settle(flip.select(F.explode(F.arrays_zip(F.col("rows").alias("i"), F.col("cols").alias("j"))).alias("x")).select("x.i", "x.j"))
        matched = settle(matched.join(new.select("i"), "i", "left_anti").join(new.select("j"), "j", "left_anti").unionByName(new))


def coarse_parts(a: DataFrame, matched: DataFrame) -> DataFrame:
    """``(side, node, part)``: the coarse block decomposition of rows and columns.

    Part 1: reached by alternating paths from columns without a row; part 3:
    from rows without a column; part 2: the square rest with its own matching.
    """
    cells = a.select("i", "j").distinct()
    # alternating steps: column -> any of its rows -> the column matched to the row
    by_col = cells.join(matched.select("i", F.col("j").alias("mate")), "i").select(F.col("mate").alias("i"), "j")
    cols1 = reach(by_col, cells.join(matched.select("j"), "j", "left_anti").select(F.col("j").alias("node")))
    by_row = cells.join(matched.select(F.col("i").alias("mate"), "j"), "j").select(F.col("mate").alias("j"), "i").select(F.col("j").alias("i"), F.col("i").alias("j"))
    rows3 = reach(by_row, cells.join(matched.select("i"), "i", "left_anti").select(F.col("i").alias("node")))
    rows1 = cells.join(cols1.select(F.col("node").alias("j")), "j").select(F.col("i").alias("node")).distinct()
    cols3 = cells.join(rows3.select(F.col("node").alias("i")), "i").select(F.col("j").alias("node")).distinct()

    def side(name, every, one, three):
        marks = every.join(one.withColumn("one", F.lit(True)), "node", "left").join(three.withColumn("three", F.lit(True)), "node", "left")
        return marks.select(F.lit(name).alias("side"), "node", F.when(F.col("one"), 1).when(F.col("three"), 3).otherwise(2).alias("part"))

    rows = cells.select(F.col("i").alias("node")).distinct()
    cols = cells.select(F.col("j").alias("node")).distinct()
    return side("row", rows, rows1, rows3).unionByName(side("col", cols, cols1, cols3))
