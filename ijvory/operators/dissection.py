"""Nested dissection: separators of all parts of a level side by side, part by part in a key.

A part of more nodes than a task may hold is coarsened first: neighbours that choose each other
become one node, round after round, in all parts at once, until it fits. A task per part then halves
it by levels of a breadth-first search, and the halves pass back to the nodes. Of the nodes with an edge
to the other half, those of the half that has fewer are the separator. Parts that fit
a task are dissected to the end in it. A part of more nodes than any task holds is coarsened once and
its coarse graph halved down to parts that a task holds, whose separators are then found from the top.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.operators.orderings import numbered
from ijvory.operators.rounds import afresh, settle

#: Nodes of a part that one task dissects to the end, and of one that is ordered as it is.
FITS, LEAF = 1024, 8
#: Nodes that a task holds at most, whatever part is said to fit it.
HELD = 1 << 15


def _levels(start: int, edges: dict[int, set[int]], free: set[int]) -> list[list[int]]:
    """Breadth-first levels of what ``start`` reaches within ``free``."""
    seen, levels = {start}, [[start]]
    while True:
        new = sorted({y for x in levels[-1] for y in edges[x] if y in free} - seen)
        if not new:
            return levels
        seen.update(new)
        levels.append(new)


def _in_levels(nodes: set[int], edges: dict[int, set[int]]) -> list[int]:
    """The nodes, component by component, each from a node far from its others outward."""
    left, out = set(nodes), []
    for start in sorted(nodes, key=lambda x: (len(edges[x] & nodes), x)):
        if start not in left:
            continue
        for _ in range(2):
            levels = _levels(start, edges, left)
            start = min(levels[-1], key=lambda x: (len(edges[x]), x))
        found = [x for level in _levels(start, edges, left) for x in level]
        out += found
        left.difference_update(found)
    return out


def _halved(nodes: set[int], edges: dict[int, set[int]], weight: dict[int, int]) -> set[int]:
    """About half of the weight, at one end."""
    half, held, first = sum(weight[x] for x in nodes) / 2, 0, set()
    for x in _in_levels(nodes, edges):
        if held >= half:
            break
        first.add(x)
        held += weight[x]
    return first


def _separator(first: set[int], nodes: set[int], edges: dict[int, set[int]]) -> set[int]:
    other = nodes - first
    a = {x for x in first if edges[x] & other}
    b = {x for x in other if edges[x] & first}
    return a if len(a) <= len(b) else b


def _dissect(nodes: set[int], edges: dict[int, set[int]], leaf: int, path: str, out: list[tuple[int, str, int]]) -> None:
    """Appends ``(node, path, place)``; in the order of paths and places separators come last."""
    todo = [(nodes, path)]
    while todo:
        part, path = todo.pop()
        if len(part) > leaf:
            first = _halved(part, edges, dict.fromkeys(part, 1))
            cut = _separator(first, part, edges)
            first, second = first - cut, part - first - cut
            if first and second:
                out += [(x, path + "2", k) for k, x in enumerate(sorted(cut))]
                todo += [(first, path + "0"), (second, path + "1")]
                continue
        order = sorted(part, key=lambda x: (len(edges[x] & part), x))
        out += [(x, path, k) for k, x in enumerate(order)]


def _graph(pdf: pd.DataFrame) -> tuple[set[int], dict[int, set[int]]]:
    """Nodes and neighbours of rows ``(i, j)``, where a row (i, i) says that there is a node."""
    edges: dict[int, set[int]] = defaultdict(set)
    for i, j in zip(pdf.i.tolist(), pdf.j.tolist()):
        if i != j:
            edges[i].add(j)
    return set(pdf.i.tolist()), edges


def _coarse(edges: DataFrame, nodes: DataFrame, fits: int) -> tuple[DataFrame, DataFrame]:
    """``(node, path, owner)`` and the coarse ``(path, i, j)``, both ways: at most ``fits`` owners in each part, or none that have neighbours."""
    # afresh, as both are joined to what comes of them, round after round
    at = afresh(nodes.select("node", "path", F.col("node").alias("owner")))
    now = afresh(edges.select("path", "i", "j", F.lit(1).cast("long").alias("w")))
    rounds = 0
    while True:
        owners = at.select("path", "owner").distinct()
        large = settle(owners.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > fits).select("path"))
        if large.isEmpty():
            return at, now
        # each picks the neighbour of its heaviest edge, by chance among equals; who pick each other become one
        live = now.join(large, "path", "left_semi")
        rank = F.struct("w", F.xxhash64(F.least("i", "j"), F.greatest("i", "j"), F.lit(rounds)).alias("h"), "j")
        pick = settle(live.groupBy("path", "i").agg(F.max(rank).alias("x")).select("path", "i", F.col("x.j").alias("j")))
        other = pick.select("path", F.col("j").alias("i"), F.col("i").alias("j"))
        pairs = settle(pick.join(other, ["path", "i", "j"], "left_semi").where("i > j").select("path", F.col("i").alias("gone"), F.col("j").alias("to")))
        # nodes whose choice is taken join the pair of their choice, so that stars shrink as well
        taken = pairs.select("path", "gone", "to").unionByName(pairs.select("path", F.col("to").alias("gone"), "to"))
        single = pick.join(taken.select("path", F.col("gone").alias("i")), ["path", "i"], "left_anti")
        joined = single.join(taken.select("path", F.col("gone").alias("j"), "to"), ["path", "j"]).select("path", F.col("i").alias("gone"), "to")
        move = settle(pairs.unionByName(joined))
        if move.isEmpty():
            return at, now
        at = afresh(at.join(move.select("path", F.col("gone").alias("owner"), "to"), ["path", "owner"], "left").select("node", "path", F.coalesce("to", "owner").alias("owner")))
        a, b = (move.select("path", F.col("gone").alias(c), F.col("to").alias(f"{c}2")) for c in "ij")
        now = now.join(a, ["path", "i"], "left").join(b, ["path", "j"], "left").select("path", F.coalesce("i2", "i").alias("i"), F.coalesce("j2", "j").alias("j"), "w")
        now = afresh(now.where("i <> j").groupBy("path", "i", "j").agg(F.sum("w").alias("w")))
        rounds += 1


def _weighed(at: DataFrame, coarse: DataFrame) -> DataFrame:
    """``(path, i, j, w)``: the coarse edges, and a row (i, i) for each owner with the number of its nodes."""
    size = at.groupBy("path", "owner").agg(F.count("*").alias("w"))
    return coarse.select("path", "i", "j", F.lit(0).cast("long").alias("w")).unionByName(size.select("path", F.col("owner").alias("i"), F.col("owner").alias("j"), "w"))


def _parts(weight: dict[int, int], edges: dict[int, set[int]], path: str, held: int) -> dict[int, str]:
    """The path of each owner: halves of halves, until a part weighs ``held`` at most or is one owner."""
    out, todo = {}, [(set(weight), path)]
    while todo:
        part, path = todo.pop()
        if len(part) == 1 or sum(weight[x] for x in part) <= held:
            out.update(dict.fromkeys(part, path))
            continue
        first = _halved(part, edges, weight)
        if first == part:  # its last owner has most of the weight
            first.remove(max(part, key=lambda x: (weight[x], x)))
        todo += [(first, path + "0"), (part - first, path + "1")]
    return out


def _split(edges: DataFrame, nodes: DataFrame, held: int) -> tuple[DataFrame, DataFrame]:
    """``(node, path)`` of parts that a task holds, with no edge between two of them, and of the separators around them.

    The graph is coarsened once for all levels. An edge between two parts is cut at the level at which their paths
    part, from the top, unless an end of it is in a separator above.
    """
    at, coarse = _coarse(edges, nodes, held)

    def halve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.i == pdf.j]
        # smoothing may add a few nodes to a part
        found = _parts(dict(zip(own.i.tolist(), own.w.tolist())), _graph(pdf)[1], key[0], held * 3 // 4)
        return pd.DataFrame({"path": key[0], "owner": list(found), "part": list(found.values())})

    parts = _weighed(at, coarse).groupBy("path").applyInPandas(halve, "path string, owner long, part string")
    part = afresh(at.join(parts, ["path", "owner"]).select("node", "part"))
    for up in (True, False):
        # smooth the ragged rims: who has most neighbours in another part goes there, to later parts first
        votes = edges.join(part.select(F.col("node").alias("j"), F.col("part").alias("most")), "j").groupBy("i", "most").agg(F.count("*").alias("n"))
        votes = votes.groupBy(F.col("i").alias("node")).agg(F.max(F.struct("n", "most")).alias("x"), F.sum("n").alias("d")).where("2 * x.n > d").select("node", "x.most")
        there = F.col("most") > F.col("part") if up else F.col("most") < F.col("part")
        part = afresh(part.join(votes, "node", "left").select("node", F.when(there, F.col("most")).otherwise(F.col("part")).alias("part")))
    mark = lambda c, name: part.select(F.col("node").alias(c), F.col("part").alias(name))
    level = F.expr("aggregate(sequence(1, least(length(a), length(b))), 0, (n, k) -> if(n = k - 1 and substr(a, k, 1) = substr(b, k, 1), k, n))")
    across = afresh(edges.select("i", "j").join(mark("i", "a"), "i").join(mark("j", "b"), "j").where("a <> b").select("i", "j", "a", level.alias("level")))
    cut = None
    for k in sorted(r.level for r in across.select("level").distinct().collect()):
        here = across.where(F.col("level") == k)
        for end in "ij" if cut is not None else "":
            here = here.join(cut.select(F.col("node").alias(end)), end, "left_anti")
        rim = here.select(F.expr(f"substr(a, 1, {k})").alias("path"), F.col("i").alias("node"), F.expr(f"substr(a, {k + 1}, 1)").alias("own")).distinct()
        counts = rim.groupBy("path").agg(F.count_if(F.col("own") == "0").alias("x"), F.count_if(F.col("own") == "1").alias("y"))
        new = afresh(rim.join(counts, "path").where(F.col("own") == F.when(F.col("x") <= F.col("y"), "0").otherwise("1")).select("node", F.concat("path", F.lit("2")).alias("path")))
        cut = new if cut is None else cut.unionByName(new)
    left = part.select("node", F.col("part").alias("path"))
    if cut is None:
        return left, left.limit(0)
    return left.join(cut.select("node"), "node", "left_anti"), cut


def _inside(edges: DataFrame, left: DataFrame) -> DataFrame:
    """``(i, j, path)``: the edges between nodes of one part."""
    a, b = left.select(F.col("node").alias("i"), "path"), left.select(F.col("node").alias("j"), F.col("path").alias("other"))
    return edges.select("i", "j").join(a, "i").join(b, "j").where("path = other").select("i", "j", "path")


def _bisect(edges: DataFrame, nodes: DataFrame, fits: int) -> DataFrame:
    """``(node, path, side)``: 0 and 1 have no edge between them, 2 is the separator."""
    at, coarse = _coarse(edges, nodes, fits)
    rows = _weighed(at, coarse)

    def halve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part, near = _graph(pdf)
        own = pdf[pdf.i == pdf.j]
        first = _halved(part, near, dict(zip(own.i.tolist(), own.w.tolist())))
        return pd.DataFrame({"path": key[0], "owner": sorted(part), "side": [int(x not in first) for x in sorted(part)]})

    sides = rows.groupBy("path").applyInPandas(halve, "path string, owner long, side int")
    side = settle(at.join(sides, ["path", "owner"]).select("node", "path", "side"))
    for turn in (0, 1):
        # smooth the ragged rim of coarse nodes: who has most neighbours on the other side goes there, one side at a time
        other = side.select(F.col("node").alias("j"), F.col("side").alias("other"))
        pull = edges.join(other, "j").groupBy(F.col("i").alias("node")).agg(F.avg("other").alias("pull"))
        away = F.when(F.lit(turn) == 0, F.col("pull") > 0.5).otherwise(F.col("pull") < 0.5)
        moved = side.join(pull, "node", "left").select("node", "path", F.when((F.col("side") == turn) & away, 1 - F.col("side")).otherwise(F.col("side")).alias("side"))
        side = settle(moved)
    mark = lambda c: side.select(F.col("node").alias(c), F.col("side").alias(f"{c}_side"))
    rim = settle(edges.join(mark("i"), "i").join(mark("j"), "j").where("i_side <> j_side").select("path", F.col("i").alias("node"), F.col("i_side").alias("own")).distinct())
    counts = rim.groupBy("path").agg(F.count_if(F.col("own") == 0).alias("a"), F.count_if(F.col("own") == 1).alias("b"))
    cut = rim.join(counts, "path").where(F.col("own") == F.when(F.col("a") <= F.col("b"), 0).otherwise(1)).select("node", F.lit(2).alias("cut"))
    return settle(side.join(cut, "node", "left").select("node", "path", F.coalesce("cut", "side").alias("side")))


def separators(graph: DataFrame, nodes: DataFrame, fits: int = FITS, leaf: int = LEAF) -> DataFrame:
    """``(node, path, place)``: a path of 0 and 1 for the halves that a node lies in, ended by 2 if it separates the next two; the place among equals."""
    if not 1 <= leaf <= fits:
        raise ValueError("a leaf has at least one node and fits a task")
    edges = graph.where("i <> j").select("i", "j")
    edges = settle(edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct().withColumn("path", F.lit("")))
    left, done = settle(nodes.select("node").distinct().withColumn("path", F.lit(""))), None
    if left.count() > HELD:
        left, cut = _split(edges, left, HELD)
        fits = min(fits, HELD)
        left, done = afresh(left), cut.select("node", "path", F.lit(0).alias("place"))
        edges = afresh(_inside(edges, left))
    while True:
        large = settle(left.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > fits).select("path"))
        if large.isEmpty():
            break
        here, rest = left.join(large, "path", "left_semi"), left.join(large, "path", "left_anti")
        side = _bisect(settle(edges.join(large, "path", "left_semi").select("path", "i", "j")), here, fits)
        cut = side.where("side = 2").select("node", F.concat("path", F.lit("2")).alias("path"), F.lit(0).alias("place"))
        done = cut if done is None else done.unionByName(cut)
        halves = side.where("side < 2").select("node", F.concat("path", F.col("side").cast("string")).alias("path"))
        left = settle(rest.select("node", "path").unionByName(halves))
        edges = settle(_inside(edges, left))

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, str, int]] = []
        part, near = _graph(pdf)
        _dissect(part, near, leaf, key[0], out)
        return pd.DataFrame(out, columns=["node", "path", "place"])

    rows = edges.select("path", "i", "j").unionByName(left.select("path", F.col("node").alias("i"), F.col("node").alias("j")))
    last = settle(rows.groupBy("path").applyInPandas(finish, "node long, path string, place int"))
    return last if done is None else last.unionByName(done)


def nested_dissection(graph: DataFrame, nodes: DataFrame, fits: int = FITS, leaf: int = LEAF) -> DataFrame:
    """A permutation ``(k, at)`` of ``nodes (node)`` of little fill: the halves of every part before what separates them."""
    return numbered(separators(graph, nodes, fits, leaf), ["path", "place", "node"])
