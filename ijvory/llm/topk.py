"""Exact top-k inner-product search by columnar branch and bound.

Vectors are quantised to whole numbers. Queries and candidates are dealt into
blocks of bounded size, and a cogroup brings every query block to every candidate
block. There the candidates lie dimension by dimension; a query adds up a few
dimensions at a time, bounds what the others can still add by the norms of the
remaining parts, and compacts the candidates that can still reach its k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 8192
DIMENSIONS = 16
SCALE = 256
LONG = np.iinfo(np.int64)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(id, q)`` with q = floor(scale x) for the rows whose id and components are all there and finite."""
    xs = F.col(vector_col)
    sound = F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(id_col).isNotNull() & xs.isNotNull()).where(F.coalesce(sound, F.lit(False)))
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(xs, lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def _matrix(q: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of the list column, filled with zeros to ``dims`` columns."""
    q = pa.concat_arrays(q.chunks) if q.num_chunks != 1 else q.chunk(0)
    n = np.diff(q.offsets.to_numpy())
    out = np.zeros((len(n), dims), np.int64)
    out[np.arange(dims) < n[:, None]] = q.flatten().to_numpy()
    return out


class Candidates:
    """A block of candidates, dimension by dimension, largest first, with the norms of what is left after each block of dimensions."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        norms = np.sum(rows.astype(np.float64) ** 2, axis=1)
        order = np.argsort(-norms, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(rows[order].T)
        squares = self.columns.astype(np.float64) ** 2
        self.rest = [np.sqrt(np.sum(squares[at:], axis=0)) for at in range(DIMENSIONS, len(self.columns), DIMENSIONS)]

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, ties to the smaller id; rows with the id ``own`` are left out, each other row counts."""
        columns, dims = self.columns, len(query)
        live = np.flatnonzero(self.ids != own)
        # the k-th score of the largest candidates is a floor for the k-th of all
        seed = live[: max(4 * k, 64)]
        scores = query @ columns[:, seed]
        floor = np.partition(scores, len(seed) - k)[len(seed) - k] if len(seed) > k else None
        total = query[:DIMENSIONS] @ columns[:DIMENSIONS]
        total = total[live]
        for n, rest in enumerate(self.rest):
            at = (n + 1) * DIMENSIONS
            if floor is not None:
                # Cauchy and Schwarz bound what the other dimensions can add
                more = rest[live] * np.sqrt(np.sum(query[at:].astype(np.float64) ** 2))
                keep = np.flatnonzero(total + more * (1 + 1e-9) + 1 >= floor)
                if len(keep) < len(live):
                    live, total = live[keep], total[keep]
            total = total + query[at : at + DIMENSIONS] @ columns[at : at + DIMENSIONS, live]
        first = np.lexsort((self.ids[live], -total))[:k] if dims else np.argsort(self.ids[live], kind="stable")[:k]
        return self.ids[live[first]], total[first]


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("copy", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return schema.empty_table()
        dims = max(1, *(pc.max(pc.list_value_length(t.column("q"))).as_py() for t in (queries, candidates)))
        qs, cs = _matrix(queries.column("q"), dims), _matrix(candidates.column("q"), dims)
        peak = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
        # doubles are exact below 2^53; products that could leave 64 bits are formed with whole numbers of any size
        most = peak(qs) * peak(cs) * dims
        kind = np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object
        qs, block = qs.astype(kind), Candidates(candidates.column("id").to_numpy(), cs.astype(kind))
        own, copies, found, scores = [], [], [], []
        for i, c, q in zip(queries.column("id").to_numpy(), queries.column("copy").to_numpy(), qs):
            a, b = block.best(q, i, k)
            own.append(np.full(len(a), i))
            copies.append(np.full(len(a), c))
            found.append(a)
            scores.append(np.array([min(max(int(x), LONG.min), LONG.max) for x in b], np.int64))
        return pa.table([np.concatenate(x).astype(f.type.to_pandas_dtype()) for x, f in zip((own, copies, found, scores), schema)], schema=schema)

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of every query, ranked from 1.

    Both tables are ``(id, q)`` of ``quantised``. A query never meets rows of its
    own id; every other row counts, also one that repeats an id or a vector, and
    so does every row of queries; a query of an empty or shorter vector counts
    the missing components as zero; scores outside 64 bits become the nearest
    long; empty tables give no rows.
    """
    # rows of queries that share an id are told apart by their number among them
    copy = F.row_number().over(Window.partitionBy("id").orderBy("q"))
    queries = queries.select("id", "q", copy.alias("copy"))
    n_q = max(1, -(-queries.count() // QUERY_BLOCK))
    n_c = max(1, -(-candidates.count() // CANDIDATE_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id", "q"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.select("id", "q", "copy", block(n_q).alias("qb")).select("*", each(n_c).alias("cb"))
    c = candidates.select("id", "q", block(n_c).alias("cb")).select("*", each(n_q).alias("qb"))
    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(_search(k), "query_id long, copy int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
