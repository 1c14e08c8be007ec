"""Gaussian elimination of one large sparse matrix by rounds of independent pivots.

Pivots are independent if none of their rows has an entry in another one's
column. All of a round are eliminated at once: two joins pick their rows and
columns, a third one forms the updates, one sum applies them. An entry is sent
only when the pivot of its row or column is. A sparse matrix has many independent
pivots in each round; where hardly any are left, what remains is nearly dense,
and once it has at most DENSE rows one task finishes it.

A matrix with many rows, of which a round takes less than a quarter, as those of meshes, is first dissected. The parts of a level
have no entry in common, so a task eliminates the pivots of a part in a front: its rows and columns,
and what they have entries in. From the smallest parts up these are as many rounds as levels. Pivots by size
that a front has to put off go to the part around it, at last to the rounds above. Fronts read and write
tiles, blocks of a dense matrix as bytes, so a task holds its front once, eight bytes a cell, and a few tiles.

Right sides go through the stored rounds, down and up again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ijvory.operators.rounds import NotPositiveDefinite, SingularMatrix, afresh, apart, settle

#: Rows and columns, at most, of a remainder that one task finishes: DENSE squared numbers.
DENSE = 1024
#: Of the largest entries that its row and its column have in A, the smaller one: what counts as zero when pivots are chosen by size.
TINY = 1e-13
#: Rows beyond which a matrix is dissected; nodes that one task dissects; nodes of a smallest part; columns that are eliminated between two products.
FRONTS, DISSECTED, SMALL, PANEL = 2 * DENSE, 1 << 15, 512, 64
#: Numbers of a tile at most, if it has several rows, and of what a front updates at a time.
TILE, CHUNK = 1 << 17, 1 << 20
#: Row numbers that tell an error in a task.
_SINGULAR, _INDEFINITE = -1, -2


def ready_diagonals(rest: DataFrame) -> DataFrame:
    """``(i, j, d)``: the diagonal entries of nodes without a smaller neighbour. Elimination in the given order, without pivoting."""
    off = rest.where("i <> j").select(F.greatest("i", "j").alias("i")).distinct()
    return rest.where("i = j").join(off, "i", "left_anti").select("i", "j", F.col("v").alias("d"))


def least_degree_diagonals(rest: DataFrame) -> DataFrame:
    """``(i, j, d)``: diagonal entries of a symmetric matrix with fewer neighbours than all of these; equal numbers are told apart by a hash."""
    off = rest.where("i <> j").select("i", "j")
    diag = rest.where("i = j").select("i", F.col("v").alias("d"))
    degree = diag.join(off.groupBy("i").agg(F.count("*").alias("n")), "i", "left")
    rank = settle(degree.select("i", "d", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("i").alias("h"), "i").alias("x")))
    least = off.join(rank.select(F.col("i").alias("j"), F.col("x").alias("y")), "j").groupBy("i").agg(F.min("y").alias("y"))
    return rank.join(least, "i", "left").where("y IS NULL OR x < y").select("i", F.col("i").alias("j"), "d")


#: Ways to choose pivots that stay on the diagonal whatever their size.
DIAGONAL = (ready_diagonals, least_degree_diagonals)


def _zero(v, row, col):
    return F.abs(v) <= TINY * F.least(row, col)


def threshold_pivots(tol: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """Independent pivots of at least ``tol`` of their column's largest entry, those of little fill first."""
    if not 0 <= tol <= 1:
        raise ValueError("tol is from 0 to 1")

    def choose(rest: DataFrame) -> DataFrame:
        live = rest.where(~_zero(F.col("v"), F.col("row"), F.col("col"))).select("i", "j", "v")
        cols = live.groupBy("j").agg(F.max(F.abs("v")).alias("top"), F.count("*").alias("c"))
        rows = live.groupBy("i").agg(F.count("*").alias("r"))
        large = live.join(cols, "j").where(F.abs("v") >= F.col("top") * tol).join(rows, "i")
        rank = F.struct(((F.col("r") - 1) * (F.col("c") - 1)).alias("cost"), F.xxhash64("i", "j").alias("h"), "i", "j", F.col("v").alias("d"))
        by_col = large.select("i", "j", rank.alias("x")).groupBy("j").agg(F.min("x").alias("x"))
        found = settle(by_col.groupBy("x.i").agg(F.min("x").alias("x")).select("i", F.col("x.j").alias("j"), "x"))
        # where the row of one meets the column of another, the one that ranks first stays
        mine, other = found.select("i", F.col("x").alias("x"), F.col("j").alias("own")), found.select("j", F.col("x").alias("y"))
        clash = live.join(mine, "i").join(other, "j").where("j <> own").select("x", "y")
        beaten = clash.select(F.greatest("x", "y").alias("x")).select("x.i").distinct()
        return found.join(beaten, "i", "left_anti").select("i", "j", F.col("x.d").alias("d"))

    choose.tol = tol
    return choose


@dataclass
class Factors:
    """Rounds of pivots ``(i, j, d)`` with the multipliers ``(i, p, v)`` below and the rows ``(p, j, v)`` beside them, and the remainder.

    Pivots of fronts also have their part ``own`` and their ``place`` in its order; what is below and beside them comes as tiles (see ``_FRONT``),
    which are those of the transpose where ``turned``.

    ``p`` is the pivot's row in ``lower`` and ``upper``; ``rest (i, j, v, row, col)`` has at most DENSE rows and columns, and the
    largest entries of each entry's row and column in A.
    """

    rounds: list[tuple[DataFrame, DataFrame, DataFrame]] = field(default_factory=list)
    rest: DataFrame | None = None
    in_order: bool = False
    #: Some row or column with entries has no pivot.
    singular: bool = False
    #: All pivots have to be positive.
    definite: bool = False
    #: The cells of A.
    cells: DataFrame | None = None

    def transposed(self) -> Factors:
        """The factors of the transpose: rows and columns change places, and the pivots go from the rows to the multipliers."""
        out = []
        for pivots, lower, upper in self.rounds:
            if "own" in pivots.columns:
                turn = lambda t: t.withColumn("turned", ~F.col("turned"))
                out.append((pivots.select(F.col("j").alias("i"), F.col("i").alias("j"), "d", "own", "place"), turn(upper), turn(lower)))
                continue
            at = pivots.select(F.col("i").alias("p"), F.col("j").alias("q"), "d")
            down = upper.join(at, "p").select(F.col("j").alias("i"), F.col("q").alias("p"), (F.col("v") / F.col("d")).alias("v"))
            beside = lower.join(at, "p").select(F.col("q").alias("p"), F.col("i").alias("j"), (F.col("v") * F.col("d")).alias("v"))
            out.append((pivots.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"), settle(down), settle(beside)))
        rest = None if self.rest is None else self.rest.select(F.col("j").alias("i"), F.col("i").alias("j"), "v", F.col("col").alias("row"), F.col("row").alias("col"))
        return Factors(out, rest, self.in_order, self.singular, self.definite)

    def solve(self, b: DataFrame) -> DataFrame:
        """x of A x = b as ``(i, k, v)`` for right sides ``(i, k, v)``; a column without a pivot is an error, a row without one must come out as zero."""
        if self.singular:
            raise SingularMatrix("the matrix is singular")
        b = settle(b.groupBy("i", "k").agg(F.sum("v").alias("v")))
        held = []
        for pivots, lower, _ in self.rounds:
            if "own" in pivots.columns:
                done = settle(_down(lower, b.join(pivots.select("i", "own", "place"), "i")))
                here, moved = done.where("solved").select("own", "place", "i", "k", "v"), done.where("not solved").select("i", "k", "v")
            else:
                here = settle(b.join(pivots.select("i"), "i", "left_semi"))
                moved = lower.join(here.select(F.col("i").alias("p"), "k", F.col("v").alias("y")), "p").select("i", "k", (-F.col("v") * F.col("y")).alias("v"))
            held.append(here)
            b = settle(b.join(pivots.select("i"), "i", "left_anti").unionByName(moved).groupBy("i", "k").agg(F.sum("v").alias("v")))
        x = None if self.rest is None else settle(_solve_dense(self.rest, b, self.definite))
        if x is not None:
            marks = {r["i"] for r in x.where("i < 0").select("i").distinct().collect()}
            if _SINGULAR in marks:
                raise SingularMatrix("the matrix is singular")
            if _INDEFINITE in marks:
                raise NotPositiveDefinite("not positive definite")
        for (pivots, _, upper), here in zip(reversed(self.rounds), reversed(held)):
            if "own" in pivots.columns:
                new = _up(upper, here.select("own", "place", "k", "v"), x)
            else:
                rows = here.select(F.col("i").alias("p"), "k", "v")
                if x is not None:
                    rows = rows.unionByName(upper.join(x.select(F.col("i").alias("j"), "k", F.col("v").alias("x")), "j").select("p", "k", (-F.col("v") * F.col("x")).alias("v")))
                at = pivots.select(F.col("i").alias("p"), F.col("j").alias("i"), "d")
                new = rows.groupBy("p", "k").agg(F.sum("v").alias("v")).join(at, "p").select("i", "k", (F.col("v") / F.col("d")).alias("v"))
            x = settle(new if x is None else x.unionByName(new))
        return x if x is not None else b.select("i", "k", "v").limit(0)

    def parts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``(pivots (step, i, j, d), lower (i, p, v), upper (p, j, v))`` of all rounds and the remainder, diagonals left out of both.

        Steps rise from round to round; pivots of one round come in the order of their rows.
        """
        ps, ls, us = [], [], []
        for n, (pivots, lower, upper) in enumerate(self.rounds):
            ps.append(pivots.select(F.lit(n).cast("long").alias("round"), F.col("place") if "place" in pivots.columns else F.lit(0).cast("long").alias("place"), "i", "j", "d"))
            if "own" in pivots.columns:
                lower, upper = lower.mapInArrow(_cells_below, "i long, p long, v double"), upper.mapInArrow(_cells_beside, "p long, j long, v double")
            ls.append(lower.select("i", "p", "v"))
            us.append(upper.select("p", "j", "v"))
        if self.rest is not None:
            done = settle(_factor_dense(self.rest, self.in_order))
            if not done.where("kind = 'e'").isEmpty():
                raise SingularMatrix("a pivot is zero")
            ps.append(done.where("kind = 'p'").select(F.lit(len(self.rounds)).cast("long").alias("round"), "place", "i", "j", F.col("v").alias("d")))
            ls.append(done.where("kind = 'l'").select("i", F.col("j").alias("p"), "v"))
            us.append(done.where("kind = 'u'").select(F.col("i").alias("p"), "j", "v"))
        union = lambda xs: xs[0] if len(xs) == 1 else union([xs[0].unionByName(xs[1]), *xs[2:]])
        return union(ps), union(ls), union(us)


def _pack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and column numbers, the dense matrix of a remainder, and what counts as zero in it."""
    rows, i = np.unique(pdf.i, return_inverse=True)
    cols, j = np.unique(pdf.j, return_inverse=True)
    m, row, col = np.zeros((len(rows), len(cols))), np.zeros(len(rows)), np.zeros(len(cols))
    np.add.at(m, (i, j), pdf.v)
    row[i], col[j] = pdf.row, pdf.col
    return rows, cols, m, TINY * np.minimum.outer(row, col)


def _steps(m: np.ndarray, rows: np.ndarray, cols: np.ndarray, zero: np.ndarray, in_order: bool) -> list[tuple[int, int]] | None:
    """Eliminate ``m`` in place; the places of the pivots, None for a pivot of zero in a given order. Multipliers end up below them."""
    steps, free = [], np.ones(len(rows), bool)
    for c in range(len(cols)):
        if in_order:
            r = int(np.searchsorted(rows, cols[c]))
            if r >= len(rows) or rows[r] != cols[c] or m[r, c] == 0:
                return None
        else:
            size = np.abs(m[:, c])
            r = int(np.argmax(np.where(free & (size > zero[:, c]), size, -1.0)))
            if not free[r] or not size[r] > zero[r, c]:
                continue
        free[r] = False
        below = np.flatnonzero(free)
        m[below, c] /= m[r, c]
        m[below, c + 1 :] -= np.outer(m[below, c], m[r, c + 1 :])
        steps.append((r, c))
    return steps


def _factor_dense(rest: DataFrame, in_order: bool) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols, m, zero = _pack(pdf)
        out, done = [], set()
        steps = _steps(m, rows, cols, zero, in_order)
        if steps is None:
            return pd.DataFrame({"kind": ["e"], "place": [0], "i": [0], "j": [0], "v": [0.0]})
        for place, (r, c) in enumerate(steps):
            done.add(r)
            out.append(("p", place, rows[r], cols[c], m[r, c]))
            out += [("u", place, rows[r], cols[k], m[r, k]) for k in range(c + 1, len(cols)) if m[r, k] != 0]
            out += [("l", place, rows[k], rows[r], m[k, c]) for k in range(len(rows)) if k not in done and m[k, c] != 0]
        return pd.DataFrame(out, columns=["kind", "place", "i", "j", "v"])

    return rest.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "kind string, place long, i long, j long, v double")


def _solve_dense(rest: DataFrame, b: DataFrame, definite: bool) -> DataFrame:
    """x of the remainder; rows beyond its columns must agree with it. An error comes as a negative row."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"i": [], "k": [], "v": []})
        rows, cols, m, zero = _pack(left)
        ks = np.unique(right.k) if len(right) else np.zeros(0, int)
        y = np.zeros((len(rows), len(ks)))
        right = right[np.isin(right.i, rows)]
        y[np.searchsorted(rows, right.i), np.searchsorted(ks, right.k)] = right.v
        both = np.hstack([m, y])
        steps = _steps(both, rows, cols, zero, definite)
        if steps is None or len(steps) < len(cols) or definite and any(not both[p] > 0 for p in steps):
            return pd.DataFrame({"i": [_INDEFINITE if definite else _SINGULAR], "k": [0], "v": [0.0]})
        x = np.zeros((len(cols), len(ks)))
        for r, c in reversed(steps):
            x[c] = (both[r, len(cols) :] - both[r, c + 1 : len(cols)] @ x[c + 1 :]) / both[r, c]
        j, k = np.indices(x.shape)
        return pd.DataFrame({"i": cols[j.ravel()], "k": ks[k.ravel()], "v": x.ravel()})

    one = lambda df: df.withColumn("one", F.lit(0)).groupBy("one")
    # the right sides of other rows stay away, so a task gets DENSE rows of them at most
    mine = apart(b.join(rest.select("i").distinct(), "i", "left_semi"))
    k = dict(b.dtypes)["k"]
    return one(rest).cogroup(one(mine)).applyInPandas(lambda x, y: run(x.drop(columns="one"), y.drop(columns="one")), f"i long, k {k}, v double")


def _matrix(at: pa.Buffer | None, tile: pa.Buffer, shape: tuple[int, int]) -> np.ndarray:
    """A tile's numbers; ``at`` are the places of those that are not zero, if most are."""
    values = np.frombuffer(tile)
    if at is None:
        return values.reshape(shape)
    out = np.zeros(shape[0] * shape[1])
    out[np.frombuffer(at, np.int32)] = values
    return out.reshape(shape)


def _longs(buffer: pa.Buffer) -> np.ndarray:
    return np.frombuffer(buffer, np.int64)


def _factor_tiles(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """``(kind, first, rows, cols, d, names, numbers, turned)`` of the rows that are tiles: of the pivots, and of the rows or columns outside."""
    for n in np.flatnonzero(batch.column("tile").is_valid().to_numpy(zero_copy_only=False)):
        get = lambda c: batch.column(c)[int(n)]
        kind, first, rows, cols = get("kind").as_py(), get("first").as_py(), _longs(get("rows").as_buffer()), _longs(get("cols").as_buffer())
        names = get("names").values.to_numpy() if kind != _INNER else rows[first : first + max(1, TILE // len(rows))]
        shape = (len(rows), len(names)) if kind == _UPPER else (len(names), len(rows))
        yield kind, first, rows, cols, np.frombuffer(get("d").as_buffer()), names, _matrix(get("at").as_buffer(), get("tile").as_buffer(), shape), get("turned").as_py()


def _cells_of(batches: Iterator[pa.RecordBatch], below: bool) -> Iterator[pa.RecordBatch]:
    """The entries of L, left of the pivots, or those of U, beside them, by the names that the factors go by; the diagonal is left out."""
    for batch in batches:
        for kind, first, rows, cols, d, names, m, turned in _factor_tiles(batch):
            r, c = np.nonzero(m)
            v = m[r, c]
            if kind == _INNER:
                r = r + first
                take = (r > c) if below != turned else (r < c)
                r, c, v = r[take], c[take], v[take]
                if turned:
                    a, b, v = (cols[c], cols[r], v / d[r]) if below else (cols[c], rows[r], v * d[c])
                else:
                    a, b = (rows[r], rows[c]) if below else (rows[r], cols[c])
            elif kind == _LOWER:
                a, b, v = (cols[c], names[r], v * d[c]) if turned else (names[r], rows[c], v)
            else:
                a, b, v = (names[c], cols[r], v / d[r]) if turned else (rows[r], names[c], v)
            for n in range(0, len(v), CHUNK):
                yield pa.record_batch([pa.array(x[n : n + CHUNK]) for x in (a, b, v)], names=["i", "p", "v"] if below else ["p", "j", "v"])


def _cells_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _cells_of(batches, True)


def _cells_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _cells_of(batches, False)


def _sweep(tiles: DataFrame, sides: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Tiles and right sides ``(own, far, place, k, v)`` of a part go to one task."""
    both = tiles.select("own", "kind", "first", "rows", "cols", "names", "at", "tile", "d", "turned").unionByName(sides, allowMissingColumns=True)
    return both.groupBy("own").applyInArrow(run, schema)


def _triangles(batches: Iterator[pa.RecordBatch]) -> tuple[str, np.ndarray, list, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]] | None:
    """A part's name, its pivots' factors, its tiles outside, its pivots' rows and columns and diagonal, and its right sides; None without right sides."""
    tiles, sides, own = [], [], None
    for batch in batches:
        if batch.num_rows:
            own = batch.column("own")[0].as_py()
            tiles += _factor_tiles(batch)
            lone = batch.filter(batch.column("tile").is_null())
            sides.append([lone.column(c).to_numpy(zero_copy_only=False) for c in ("far", "place", "k", "v")])
    if not sum(len(x[0]) for x in sides) or not tiles:
        return None
    _, _, rows, cols, d, _, _, turned = tiles[0]
    t = np.zeros((len(rows), len(rows)))
    for kind, first, _, _, _, _, m, _ in tiles:
        if kind == _INNER:
            t[first : first + len(m)] = m
    if turned:
        t = np.tril(t.T, -1) / d[None, :] + np.triu(t.T, 1) * d[:, None] + np.diag(d)
        rows, cols = cols, rows
    far, place, k, v = (np.concatenate(x) for x in zip(*[x for x in sides if len(x[0])]))
    return own, t, [x for x in tiles if x[0] != _INNER], rows, cols, d, [far.astype(bool), place.astype(np.int64), v], *np.unique(k, return_inverse=True)


def _down(lower: DataFrame, b: DataFrame) -> DataFrame:
    """``(solved, own, place, i, k, v)``: L y = b for the pivots of parts, for right sides ``(own, place, k, v)``, and what it adds to the rows outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _triangles(batches)
        if found is None:
            return
        own, t, tiles, rows, _, d, (_, place, v), ks, k = found
        y = np.zeros((len(t), len(ks)))
        np.add.at(y, (place, k), v)
        y = np.linalg.solve(np.tril(t, -1) + np.eye(len(t)), y)
        parts = [(True, rows, y)]
        for _, _, _, _, _, names, m, turned in tiles:
            parts.append((False, names, -(m.T @ (y / d[:, None]) if turned else m @ y)))
        for solved, names, x in parts:
            at, n = (z.ravel() for z in np.indices(x.shape))
            yield pa.record_batch([pa.array(np.full(len(at), solved)), pa.array([own] * len(at), pa.string()), pa.array(at), pa.array(names[at]), pa.array(ks[n]), pa.array(x.ravel())], names=["solved", "own", "place", "i", "k", "v"])

    sides = b.select("own", F.lit(False).alias("far"), "place", "k", "v")
    return _sweep(lower, sides, run, f"solved boolean, own string, place long, i long, k {dict(b.dtypes)['k']}, v double")


def _up(upper: DataFrame, y: DataFrame, x: DataFrame | None) -> DataFrame:
    """``(i, k, v)``: U x = y for the pivots of parts, for ``y (own, place, k, v)`` and what is known of x ``(i, k, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _triangles(batches)
        if found is None:
            return
        _, t, tiles, _, cols, d, (far, place, v), ks, k = found
        right = np.zeros((len(t), len(ks)))
        np.add.at(right, (place[~far], k[~far]), v[~far])
        known, at = np.unique(place[far], return_inverse=True)
        others = np.zeros((len(known) + 1, len(ks)))
        others[at, k[far]] = v[far]
        for _, _, _, _, _, names, m, turned in tiles:
            at = np.minimum(np.searchsorted(known, names), max(0, len(known) - 1))
            z = others[np.where(known[at] == names, at, len(known))] if len(known) else np.zeros((len(names), len(ks)))
            right -= d[:, None] * (m.T @ z) if turned else m @ z
        at, n = (z.ravel() for z in np.indices(right.shape))
        yield pa.record_batch([pa.array(cols[at]), pa.array(ks[n]), pa.array(np.linalg.solve(np.triu(t), right).ravel())], names=["i", "k", "v"])

    sides = y.select("own", F.lit(False).alias("far"), "place", "k", "v")
    if x is not None:
        need = upper.where(F.col("names").isNotNull()).select("own", F.explode("names").alias("i"))
        sides = sides.unionByName(need.join(x, "i").select("own", F.lit(True).alias("far"), F.col("i").alias("place"), "k", "v"))
    return _sweep(upper, sides, run, f"i long, k {dict(y.dtypes)['k']}, v double")


def _parts(rest: DataFrame) -> DataFrame:
    """``(node, own, place)``: nested dissection of a pattern; parts of at most SMALL nodes are kept whole, with an order of little fill."""
    from ijvory.operators.dissection import separators

    cells = rest.select("i", "j")
    found = settle(separators(cells.where("i <> j"), cells.select(F.explode(F.array("i", "j")).alias("node")).distinct(), DISSECTED))
    found = found.select("node", "path", "place", F.regexp_replace("path", "2$", "").alias("part"))
    # the largest part around a node that is small; what separates larger ones is a part for itself
    around = found.select("node", "part", F.explode(F.sequence(F.lit(0), F.length("part"))).alias("n")).select("node", F.expr("left(part, n)").alias("own"))
    small = around.groupBy("own").agg(F.count("*").alias("n")).where(F.col("n") <= SMALL).select("own")
    whole = around.join(small, "own").groupBy("node").agg(F.min("own").alias("own"))
    placed = found.join(whole, "node", "left").select("node", F.coalesce("own", "part").alias("own"), "path", "place")
    order = Window.partitionBy("own").orderBy("path", "place", "node")
    return settle(placed.select("node", "own", (F.row_number().over(order) - 1).cast("long").alias("place")))


#: What a front writes. Pivots: their ``rows`` and ``cols`` and ``d``. Factors: the same and a tile, of the pivots from place ``first`` on, or of the rows or columns ``names``
#: outside. The rest: the step and part that take it, and tags of its rows and columns. ``at``: where the numbers of a tile are, if most are zero.
_FRONT = "kind int, own string, step long, first long, rows binary, cols binary, names array<long>, at binary, tile binary, d binary"
_ARROW = pa.schema([("kind", pa.int32()), ("own", pa.string()), ("step", pa.int64()), ("first", pa.int64()), ("rows", pa.binary()), ("cols", pa.binary()), ("names", pa.list_(pa.field("element", pa.int64()))), ("at", pa.binary()), ("tile", pa.binary()), ("d", pa.binary())])
_PIVOT, _INNER, _LOWER, _UPPER, _REST = range(5)
#: The step of rows and columns that no front takes.
_NEVER = 1 << 30
#: What a cell says of its row and its column: the step that takes them, the length of that part's path, which leads to this one's, their places there, and their largest entries.
_ROW_TAGS, _COL_TAGS = ["i", "ri", "rl", "rp", "row"], ["j", "ci", "cl", "cp", "col"]


def _panels(m: np.ndarray, order: list[int], choose: Callable[[int, np.ndarray], int], free: np.ndarray, open_: np.ndarray) -> list[tuple[int, int]]:
    """Eliminate columns of ``m`` in place, in this order, with the rows that ``choose(column, free rows)`` names, -1 to put it off; the places of the pivots."""
    steps = []
    for start in range(0, len(order), PANEL):
        panel, here = order[start : start + PANEL], []
        for c in panel:
            r = choose(c, free)
            if r < 0:
                continue
            free[r] = open_[c] = False
            here.append((r, c))
            below, later = np.flatnonzero(free), [x for x in panel if open_[x]]
            m[below, c] /= m[r, c]
            m[np.ix_(below, later)] -= np.outer(m[below, c], m[r, later])
        if here:
            others = open_.copy()
            others[panel] = False
            r, c, x, below = [r for r, _ in here], [c for _, c in here], np.flatnonzero(others), np.flatnonzero(free)
            m[np.ix_(r, x)] = beside = np.linalg.solve(np.tril(m[np.ix_(r, c)], -1) + np.eye(len(r)), m[np.ix_(r, x)])
            some = max(1, CHUNK // max(1, len(x)))
            for n in range(0, len(below), some):
                m[np.ix_(below[n : n + some], x)] -= m[np.ix_(below[n : n + some], c)] @ beside
        steps += here
    return steps


def _assembled(batches: Iterator[pa.RecordBatch]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """A part's name, its front, and the tags of its rows and columns."""
    cells, tiles, tags, own = [], [], ([], []), ""
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("own")[0].as_py()
        lone = batch.filter(batch.column("tile").is_null())
        if lone.num_rows:
            got = {c: lone.column(c).to_numpy(zero_copy_only=False) for c in (*_ROW_TAGS, *_COL_TAGS, "v")}
            cells.append((got["i"], got["j"], got["v"]))
            for held, names in zip(tags, (_ROW_TAGS, _COL_TAGS)):
                first = np.unique(got[names[0]], return_index=True)[1]
                held.append(np.column_stack([got[c][first].view(np.int64) if c == names[-1] else got[c][first].astype(np.int64) for c in names]))
        for n in np.flatnonzero(batch.column("tile").is_valid().to_numpy(zero_copy_only=False)):
            get = lambda c: batch.column(c)[int(n)].as_buffer()
            r, c = _longs(get("rows")).reshape(-1, 5), _longs(get("cols")).reshape(-1, 5)
            tags[0].append(r)
            tags[1].append(c)
            tiles.append((r[:, 0], c[:, 0], get("at"), get("tile")))
    rows, cols = (x[np.unique(x[:, 0], return_index=True)[1]] for x in map(np.concatenate, tags))
    m = np.zeros((len(rows), len(cols)))
    for i, j, v in cells:
        np.add.at(m, (np.searchsorted(rows[:, 0], i), np.searchsorted(cols[:, 0], j)), v)
    while tiles:
        i, j, at, tile = tiles.pop()
        r, c, v = np.searchsorted(rows[:, 0], i), np.searchsorted(cols[:, 0], j), np.frombuffer(tile)
        if at is None:
            m[np.ix_(r, c)] += v.reshape(len(r), len(c))
        else:
            at = np.frombuffer(at, np.int32)
            m[r[at // len(c)], c[at % len(c)]] += v
    return own, m, rows, cols


def _tile(m: np.ndarray, given: bool) -> tuple[bytes | None, bytes]:
    """``at`` and the numbers; with ``given`` a zero is a cell as well."""
    flat = np.ascontiguousarray(m).ravel()
    at = np.flatnonzero(flat)
    return (None, flat.tobytes()) if given or 3 * len(at) >= 2 * len(flat) else (at.astype(np.int32).tobytes(), flat[at].tobytes())


def _front(step: int, tol: float | None, given: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Eliminates one part; ``tol`` is None for pivots on the diagonal, and ``given`` says that places name the pairs of rows and columns.

    What it puts off is tagged for the part around it and the next step.
    """

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own, m, row_tags, col_tags = _assembled(batches)
        rows, cols, rp, cp = row_tags[:, 0], col_tags[:, 0], row_tags[:, 3], col_tags[:, 3]
        largest_r, largest_c = (np.ascontiguousarray(x[:, 4]).view(float) for x in (row_tags, col_tags))
        mine_r, mine_c = row_tags[:, 1] == step, col_tags[:, 1] == step
        order = [int(c) for c in np.lexsort((cols, cp)) if mine_c[c]]
        if given:
            mate = {int(rp[r]): int(r) for r in np.flatnonzero(mine_r)}
            pairs = {c: mate.get(int(cp[c]), -1) for c in order}
        else:
            same = dict(zip(rows.tolist(), range(len(rows))))
            pairs = {c: same.get(int(cols[c]), -1) for c in order}
        bad = []

        def fixed(c: int, free: np.ndarray) -> int:
            r = pairs[c]
            if r < 0 or not m[r, c] != 0:
                bad.append(c)
            return -1 if bad else r

        def by_size(c: int, free: np.ndarray) -> int:
            size = np.where(free, np.abs(m[:, c]), -1.0)
            fit = mine_r & (size > TINY * np.minimum(largest_r, largest_c[c])) & (size >= tol * size.max())
            r = pairs[c]
            return r if r >= 0 and fit[r] else int(np.argmax(np.where(fit, size, -1.0))) if fit.any() else -1

        steps, left, free, open_ = [], order, np.ones(len(rows), bool), np.ones(len(cols), bool)
        while left:
            new = _panels(m, left, fixed if given or tol is None else by_size, free, open_)
            done = {c for _, c in new}
            steps += new
            left = [c for c in left if c not in done] if new and not bad else []
        if bad:
            yield _PIVOT, own, step, 0, np.zeros(1, np.int64).tobytes(), np.zeros(1, np.int64).tobytes(), None, None, None, np.zeros(1).tobytes()
            return
        # rows and columns of this part that found no pivot
        for tags, late in ((row_tags, mine_r & free), (col_tags, mine_c & open_)):
            tags[late, 1], tags[late, 2] = (step + 1, len(own) - 1) if own else (_NEVER, 0)
            tags[late, 3] += 1 << 32
        at_r, at_c = np.array([r for r, _ in steps], int), np.array([c for _, c in steps], int)
        out_r, out_c, d = np.flatnonzero(free), np.flatnonzero(open_), m[at_r, at_c]
        if len(steps):
            head = rows[at_r].tobytes(), cols[at_c].tobytes()
            yield _PIVOT, own, step, 0, *head, None, None, None, d.tobytes()
            some = max(1, TILE // len(steps))
            for n in range(0, len(steps), some):
                yield _INNER, own, step, n, *head, None, *_tile(m[np.ix_(at_r[n : n + some], at_c)], False), d.tobytes()
            for n in range(0, len(out_r), some):
                yield _LOWER, own, step, 0, *head, rows[out_r[n : n + some]].tolist(), *_tile(m[np.ix_(out_r[n : n + some], at_c)], False), d.tobytes()
            for n in range(0, len(out_c), some):
                yield _UPPER, own, step, 0, *head, cols[out_c[n : n + some]].tolist(), *_tile(m[np.ix_(at_r, out_c[n : n + some])], False), d.tobytes()
        when_r, when_c = row_tags[out_r, 1], col_tags[out_c, 1]
        for when in np.union1d(when_r, when_c).tolist():
            long = np.concatenate([row_tags[out_r[when_r == when], 2], col_tags[out_c[when_c == when], 2]])[0]
            for r, c in ((out_r[when_r == when], out_c[when_c >= when]), (out_r[when_r > when], out_c[when_c == when])):
                if len(c):
                    some = max(1, TILE // len(c))
                    for n in range(0, len(r), some):
                        yield _REST, own[:long], when, 0, row_tags[r[n : n + some]].tobytes(), col_tags[c].tobytes(), None, *_tile(m[np.ix_(r[n : n + some], c)], given), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows_of(batches):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, bytes))
            if size > 8 * CHUNK:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*held), _ARROW)], schema=_ARROW)
                held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*held), _ARROW)], schema=_ARROW)

    return run


def _pivot_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own, rows, cols, d in zip(*(batch.column(c) for c in ("own", "rows", "cols", "d"))):
            rows = _longs(rows.as_buffer())
            yield pa.record_batch([pa.array(rows), pa.array(_longs(cols.as_buffer())), pa.array(np.frombuffer(d.as_buffer())), pa.array([own.as_py()] * len(rows), pa.string()), pa.array(np.arange(len(rows)))], names=["i", "j", "d", "own", "place"])


def _rest_cells(given: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cells of tiles that no front takes; a diagonal one, and one of each row and column, may be zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in zip(*(batch.column(c) for c in ("rows", "cols", "at", "tile"))):
                rows, cols, at, tile = (x.as_buffer() for x in parts)
                rows, cols = _longs(rows).reshape(-1, 5), _longs(cols).reshape(-1, 5)
                m = _matrix(at, tile, (len(rows), len(cols)))
                keep = (m != 0) | given | (rows[:, :1] == cols[None, :, 0])
                keep[~keep.any(1), 0] = True
                keep[0, ~keep.any(0)] = True
                r, c = np.nonzero(keep)
                largest = [np.ascontiguousarray(x[:, 4]).view(float) for x in (rows, cols)]
                yield pa.record_batch([pa.array(x) for x in (rows[r, 0], cols[c, 0], m[r, c], largest[0][r], largest[1][c])], names=["i", "j", "v", "row", "col"])

    return run


def _front_rounds(rest: DataFrame, rows: DataFrame, cols: DataFrame, count: int, out: Factors, tol: float | None, given: bool) -> DataFrame:
    """What ``count`` steps of fronts leave of ``rest``, for rows ``(i, ri, ro, rp)`` and columns ``(j, ci, co, cp)``: the step and part that take them, and their places; the rounds go to ``out``.

    A cell waits for the step that takes its row or its column, and no table of what is left is written until the end.
    """
    tagged = rest.join(rows, "i", "left").join(cols, "j", "left").withColumns({c: F.coalesce(c, F.lit(_NEVER)).cast("long") for c in ("ri", "ci")})
    tagged = tagged.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("rp", "cp")} | {c: F.coalesce(c, F.lit("")) for c in ("ro", "co")})
    tagged = tagged.withColumns({"rl": F.length("ro").cast("long"), "cl": F.length("co").cast("long"), "step": F.least("ri", "ci"), "own": F.when(F.col("ri") <= F.col("ci"), F.col("ro")).otherwise(F.col("co"))})
    cells = settle(tagged.select("step", "own", *_ROW_TAGS, *_COL_TAGS, "v"))
    union = lambda xs: xs[0] if len(xs) == 1 else union([xs[0].unionByName(xs[1], allowMissingColumns=True), *xs[2:]])
    taken, held = [], []
    for step in range(count):
        front = union([cells.where(F.col("step") == step).drop("step"), *(x.where(F.col("step") == step).select("own", "rows", "cols", "at", "tile") for x in held)])
        if not held:
            front = front.withColumns({c: F.lit(None).cast("binary") for c in ("rows", "cols", "at", "tile")})
        # folders for each kind and step, of which only those that are needed are read again
        done = afresh(front.groupBy("own").applyInArrow(_front(step, tol, given), _FRONT), "kind", "step")
        held.append(done.where(F.col("kind") == _REST))
        pivots = done.where(F.col("kind") == _PIVOT).select("own", "rows", "cols", "d").mapInArrow(_pivot_cells, "i long, j long, d double, own string, place long")
        lower, upper = (done.where(F.col("kind").isin(_INNER, x)).withColumn("turned", F.lit(False)) for x in (_LOWER, _UPPER))
        taken.append((pivots, lower, upper))
    counts = {r["step"]: r for r in union([p.select(F.lit(n).alias("step"), "d") for n, (p, _, _) in enumerate(taken)]).groupBy("step").agg(F.count("*"), F.min(F.abs("d")), F.min("d")).collect()}
    for n in sorted(counts):
        _valid(*counts[n][1:], out.definite)
    # a plan keeps its rounds in step with these
    out.rounds += [t for n, t in enumerate(taken) if given or n in counts]
    tiles = union([x.where(F.col("step") >= count).select("rows", "cols", "at", "tile") for x in held]).mapInArrow(_rest_cells(given), "i long, j long, v double, row double, col double")
    left = cells.where(F.col("step") >= count).select("i", "j", "v", "row", "col").unionByName(tiles)
    return settle(left.groupBy("i", "j").agg(F.sum("v").alias("v"), F.max("row").alias("row"), F.max("col").alias("col")))


def _valid(n: int, least: float, lowest: float, definite: bool) -> None:
    if n and definite and not lowest > 0:
        raise NotPositiveDefinite("not positive definite")
    if n and (least == 0 or least != least):
        raise SingularMatrix("a pivot is zero")


def _checked(pivots: DataFrame, definite: bool) -> int:
    n, least, lowest = pivots.agg(F.count("*"), F.min(F.abs("d")), F.min("d")).first()
    _valid(n, least, lowest, definite)
    return n


def _by_fronts(rest: DataFrame, out: Factors, tol: float | None, dense: int) -> DataFrame:
    """What the parts of ``rest``, level by level, leave; the parts around all others, of at most ``dense`` rows in all, are left too."""
    parts = _parts(rest)
    sizes = {r["level"]: r["n"] for r in parts.groupBy(F.length("own").alias("level")).agg(F.count("*").alias("n")).collect()}
    deepest, top, left = max(sizes), 0, 0
    while top < deepest and left + sizes.get(top, 0) <= dense:
        left, top = left + sizes.get(top, 0), top + 1
    step = F.when(F.length("own") >= top, F.lit(deepest) - F.length("own")).otherwise(F.lit(_NEVER)).cast("long")
    named = lambda i, x: parts.select(F.col("node").alias(i), step.alias(f"{x}i"), F.col("own").alias(f"{x}o"), F.col("place").alias(f"{x}p"))
    return _front_rounds(rest, named("i", "r"), named("j", "c"), deepest - top + 1, out, tol, False)


def _by_plan(rest: DataFrame, out: Factors, plan: Factors) -> DataFrame:
    """What the next rounds of a plan leave, those of fronts."""
    first = last = len(out.rounds)
    while last < len(plan.rounds) and "own" in plan.rounds[last][0].columns:
        last += 1
    union = lambda xs: xs[0] if len(xs) == 1 else union([xs[0].unionByName(xs[1]), *xs[2:]])
    all_ = settle(union([plan.rounds[n][0].withColumn("step", F.lit(n - first).cast("long")) for n in range(first, last)]))
    named = lambda i, x: all_.select(i, F.col("step").alias(f"{x}i"), F.col("own").alias(f"{x}o"), F.col("place").alias(f"{x}p"))
    return _front_rounds(rest, named("i", "r"), named("j", "c"), last - first, out, None, True)


def eliminate(
    a: DataFrame, choose: Callable[[DataFrame], DataFrame] = ready_diagonals, pattern: DataFrame | None = None,
    drop: Callable[[DataFrame], DataFrame] | None = None, definite: bool = False, plan: Factors | None = None, dense: int = DENSE,
) -> Factors:
    """The factors of A. With ``pattern``, updates outside it are left out; ``drop`` filters ``(i, j, v, d)`` next to each pivot d.

    On the diagonal a pivot of zero is an error, and with ``definite`` one that is not positive; by
    size, what has no pivot is left, as the matrix is singular. With ``plan``, the factors of a matrix that has all of A's
    cells, no pivot is chosen: its pivots are taken in its rounds, and one that is zero now is an error.
    """
    on_diagonal = plan.in_order if plan else choose in DIAGONAL
    one = a.groupBy("i", "j").agg(F.sum("v").alias("v"))
    if on_diagonal:
        rest = settle(one.withColumns({"row": F.lit(0.0), "col": F.lit(0.0)}))
    else:
        one = settle(one)
        rows, cols = (one.groupBy(c).agg(F.max(F.abs("v")).alias(name)) for c, name in (("i", "row"), ("j", "col")))
        rest = settle(one.join(rows, "i").join(cols, "j").select("i", "j", "v", "row", "col"))
    out = Factors(in_order=on_diagonal, definite=definite, cells=rest)
    if plan and not rest.join(plan.cells.select("i", "j"), ["i", "j"], "left_anti").isEmpty():
        raise ValueError("the plan lacks cells of the matrix")
    if plan:
        # what is absent now is a zero of the plan's pattern
        rest = settle(rest.unionByName(plan.cells.join(rest.select("i", "j"), ["i", "j"], "left_anti").withColumn("v", F.lit(0.0))))
    size = max(rest.agg(F.count_distinct("i"), F.count_distinct("j")).first())
    may_dissect = plan is None and pattern is None and drop is None and choose is not ready_diagonals and dense > 1 and size > FRONTS
    while True:
        if plan and len(out.rounds) == len(plan.rounds):
            out.rest, out.singular = None if plan.rest is None else rest, plan.singular
            return out
        given = plan.rounds[len(out.rounds)][0] if plan else None
        if plan and "own" in given.columns:
            rest = _by_plan(rest, out, plan)
            continue
        given = given.select("i", "j") if plan else None
        pivots = settle(rest.join(given, ["i", "j"]).select("i", "j", F.col("v").alias("d")) if plan else choose(rest))
        n = _checked(pivots, definite)
        if may_dissect and n:
            rows, cols = rest.agg(F.count_distinct("i"), F.count_distinct("j")).first()
            if max(rows, cols) > FRONTS and 4 * n < min(rows, cols):
                rest, may_dissect = _by_fronts(rest, out, None if on_diagonal else choose.tol, dense), False
                continue
        if not n:
            if on_diagonal and not rest.isEmpty():
                raise NotPositiveDefinite("not positive definite") if definite else SingularMatrix("a pivot is zero")
            if not rest.where("isnan(v) OR abs(v) = double('inf')").isEmpty():
                raise ArithmeticError("values that are no numbers are left")
            taken = sum(p.count() for p, _, _ in out.rounds)
            out.singular = taken < size
            return out
        if plan is None and pattern is None and drop is None and n <= dense:
            rows, cols = rest.agg(F.count_distinct("i"), F.count_distinct("j")).first()
            if max(rows, cols) <= dense and 4 * n <= min(rows, cols):
                out.rest = rest
                return out
        beside = rest.join(pivots.select("i", F.col("j").alias("own"), "d"), "i").where("j <> own").select("i", "j", "v", "d", "col")
        below = rest.join(pivots.select("j", F.col("i").alias("own"), "d"), "j").where("i <> own").select("i", F.col("own").alias("p"), "j", "v", "d", "row")
        if drop is not None:
            beside, below = drop(beside), drop(below)
        upper = settle(beside.select(F.col("i").alias("p"), "j", "v", "col"))
        lower = settle(below.select("i", "p", (F.col("v") / F.col("d")).alias("v"), "row"))
        moved = lower.join(upper.select("p", "j", F.col("v").alias("u"), "col"), "p").select("i", "j", (-F.col("v") * F.col("u")).alias("v"), "row", "col")
        if pattern is not None:
            moved = moved.join(pattern.select("i", "j"), ["i", "j"], "left_semi")
        kept = rest.join(pivots.select("i"), "i", "left_anti").join(pivots.select("j"), "j", "left_anti").select("i", "j", "v", "row", "col")
        summed = kept.unionByName(moved).groupBy("i", "j").agg(F.sum("v").alias("v"), F.max("row").alias("row"), F.max("col").alias("col"))
        rest = settle(summed)
        out.rounds.append((pivots, lower.select("i", "p", "v"), upper.select("p", "j", "v")))
