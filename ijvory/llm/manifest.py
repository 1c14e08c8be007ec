"""A Merkle manifest of a table: leaves, roots and proofs by merging sparse forests.

Leaves lie sorted in partitions, in a written table. A forest holds nodes keyed by tree,
level and index whose run of siblings is not complete. The size of every tree is known,
so a run's arity is, and a node joins its siblings as soon as the last of them is there;
the root of a group's tree is at once a leaf of the tree above. Adding nodes in any order,
or merging forests in any order, gives the same forest: ``treeReduce`` merges
those of the partitions, each of a few nodes at either end. What they held and made, the
spine, is all that a partition needs besides its own leaves to write every proof.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ijvory.llm.common import cut

#: Nodes whose hashes make one of the next level.
ARITY = 2
#: Leaves of a partition, about.
LEAVES = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The number of the tree whose leaves are the roots of the groups.
TOP = -1
#: One in so many documents is tampered with.
TAMPERED = 7

Node = tuple[int, int, int]


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Forest:
    """Nodes ``(tree, level, index)`` whose siblings are not all there (``held``), and every node that was added or made (``known``).

    ``widths`` has the nodes of each level of every tree that has nodes here. Adding and merging are associative and commutative.
    """

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.widths: dict[int, list[int]] = {}
        self.held: dict[Node, str] = {}
        self.known: dict[Node, str] = {}

    def plant(self, tree: int, leaves: int) -> None:
        """Say how many leaves a tree has in all."""
        widths = [leaves]
        while widths[-1] > 1:
            widths.append(-(-widths[-1] // self.arity))
        self.widths[tree] = widths

    def add(self, node: Node, value: str) -> None:
        while True:
            self.known[node] = self.held[node] = value
            tree, level, at = node
            width = self.widths[tree][level]
            if width == 1:
                if tree == TOP:
                    return
                del self.held[node]
                node = (TOP, 0, tree)
                continue
            first = at - at % self.arity
            run = [(tree, level, k) for k in range(first, min(first + self.arity, width))]
            if not all(x in self.held for x in run):
                return
            node, value = (tree, level + 1, at // self.arity), digest([self.held.pop(x) for x in run])

    def fragment(self) -> Forest:
        """What other partitions can need of this one: the nodes that wait for siblings."""
        out = Forest(self.arity)
        out.widths = {t: self.widths[t] for t in {TOP, *(t for t, _, _ in self.held)}}
        out.held, out.known = dict(self.held), dict(self.held)
        return out

    def merged(self, other: Forest) -> Forest:
        large, small = (self, other) if len(self.known) >= len(other.known) else (other, self)
        out = Forest(self.arity)
        out.widths, out.held, out.known = large.widths | small.widths, dict(large.held), large.known | small.known
        for node, value in small.held.items():
            out.add(node, value)
        return out

    def climb(self, tree: int, at: int, value: str, get: Callable[[Node], str]) -> tuple[str, list[str]]:
        """The root of a tree, computed from ``value`` at leaf ``at`` and the siblings, and these, level by level."""
        siblings: list[str] = []
        for level, width in enumerate(self.widths[tree][:-1]):
            first = at - at % self.arity
            run = [value if k == at else get((tree, level, k)) for k in range(first, min(first + self.arity, width))]
            siblings += [x for k, x in enumerate(run, first) if k != at]
            value, at = digest(run), at // self.arity
        return value, siblings


def leaf_of(fields: dict[str, Column]) -> Column:
    """The leaf's hash: each field ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    sized = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[sized(c.cast("string")) for c in fields.values()]), 256)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", id_col: str = "doc_id", count: str = "n_chars", every: int = TAMPERED) -> DataFrame:
    """``(doc_id, tree, leaf, other)``: the leaf of every row and, where it is tampered with, the leaf that it has then."""
    own = {c: F.col(c) for c in fields}
    other = leaf_of(own | {count: F.col(count).cast("decimal(38,0)") + 1})
    touched = F.crc32(F.col(id_col).cast("string")) % every == 0
    return docs.select(F.col(id_col).alias("doc_id"), F.col(group).cast("string").alias("tree"), leaf_of(own).alias("leaf"), F.when(touched, other).alias("other"))


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition of sorted leaves: its groups, and the first and last one with their leaves here."""
    groups, first, last, head, tail, n = 0, None, None, 0, 0, 0
    for batch in batches:
        runs = pc.run_end_encode(batch.column("tree")) if batch.num_rows else None
        at = 0
        for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()) if runs is not None else ():
            if not n or name != last:
                if groups == 1:
                    head = tail
                groups, last, tail = groups + 1, name, 0
                first = name if groups == 1 else first
            tail += end - at
            n += end - at
            at = end
    if n:
        head = tail if groups == 1 else head
        yield pa.record_batch([pa.array([x], k) for x, k in zip((groups, first, last, head, tail), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["groups", "first", "last", "head", "tail"])


def _places(parts: list) -> tuple[dict[int, tuple[int, int, int, int]], int]:
    """For each partition the number of its first group, how many leaves of it lie before, its size and that of its last group; and the number of groups."""
    out, number, before = {}, -1, 0
    name: object = object()
    spans: list[tuple[int, int, int]] = []
    sizes: dict[int, int] = {}
    for p in parts:
        if p["first"] != name:
            number, before = number + 1, 0
        start = before
        sizes[number] = before + p["head"]
        last = number + p["groups"] - 1
        spans.append((p["part"], number, start))
        if p["groups"] > 1:
            sizes[last] = p["tail"]
        number, before, name = last, sizes[last], p["last"]
        out[p["part"]] = last
    return {part: (g, start, sizes[g], sizes[out[part]]) for part, g, start in spans}, number + 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _placed(batches: Iterator[pa.RecordBatch], place: tuple[int, int, int, int], groups: int, arity: int, rows: list) -> Forest:
    """The forest of a partition's leaves; appends ``(node, row)`` of each to ``rows``."""
    number, at, size, last = place
    name, first, forest = None, True, Forest(arity)
    forest.plant(TOP, groups)
    each: list[list[tuple]] = []
    for row in _rows(batches):
        if first or row[1] != name:
            each.append([])
            name, first = row[1], False
        each[-1].append(row)
    for k, members in enumerate(each):
        forest.plant(number + k, size if not k else last if k == len(each) - 1 else len(members))
        for row in members:
            node = (number + k, 0, at)
            forest.add(node, row[2])
            rows.append((node, row))
            at += 1
        at = 0
    return forest


def manifest(docs: DataFrame, arity: int = ARITY, per_part: int = LEAVES, fields: tuple[str, ...] = FIELDS, group: str = "lang", id_col: str = "doc_id", count: str = "n_chars", every: int = TAMPERED) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row of ``docs``.

    Leaves of a group lie in the order of their ids, null first, rows of one id in the order of
    their leaves; repeated rows are leaves of their own. Runs of ``arity`` nodes become one of the
    next level until one is left, the subroot; subroots in the order of their groups, null
    first, become the root likewise. A null field is ``-``; an empty text is not. Where ``every`` divides
    the CRC-32 of the id, the row is checked as if its ``count`` were one more; a null id or
    count changes nothing. Other columns are not read; an empty table gives an empty one.

    The driver sees a row for each partition and the spine, which has a few nodes for each.
    """
    if arity < 2:
        raise ValueError("the arity is at least 2")
    digests = cut(leaves(docs, fields, group, id_col, count, every))
    n = max(1, -(-digests.count() // per_part))
    # equal rows are many leaves, so their order of arrival parts them
    keyed = digests.withColumn("turn", F.monotonically_increasing_id()).repartitionByRange(n, "tree", "doc_id", "leaf", "turn").sortWithinPartitions("tree", "doc_id", "leaf", "turn")
    placed = cut(keyed.select("doc_id", "tree", "leaf", "other"))
    kind = dict(placed.dtypes)["doc_id"]
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    numbered = placed.select("doc_id", "tree", "leaf", "other", F.spark_partition_id().alias("part"))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None

        def seen():
            nonlocal part
            for b in batches:
                part = b.column("part")[0].as_py() if b.num_rows else part
                yield b

        for out in _summary(seen()):
            yield out.append_column("part", pa.array([part], pa.int32()))

    parts = numbered.mapInArrow(summary, "groups long, first string, last string, head long, tail long, part int").orderBy("part").collect()
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    places, groups = _places(parts)
    known = docs.sparkSession.sparkContext.broadcast((places, groups))

    def started(batches: Iterator[pa.RecordBatch]) -> tuple[tuple | None, Iterator[pa.RecordBatch]]:
        for b in batches:
            if b.num_rows:
                return known.value[0][b.column("part")[0].as_py()], _again(b, batches)
        return None, iter(())

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, batches = started(batches)
        if place is not None:
            kept = pickle.dumps(_placed(batches, place, known.value[1], arity, []).fragment())
            yield pa.record_batch([pa.array([kept], pa.binary())], names=["forest"])

    def loaded(row) -> Forest:
        return pickle.loads(row["forest"])

    spine = numbered.mapInArrow(fragments, "forest binary").rdd.map(loaded).treeReduce(Forest.merged)
    above = docs.sparkSession.sparkContext.broadcast(spine)
    ids = to_arrow_type(placed.schema["doc_id"].dataType)
    kinds = [ids, *[pa.string()] * 5, pa.bool_()]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, batches = started(batches)
        if place is None:
            return
        rows: list = []
        own, shared = _placed(batches, place, known.value[1], arity, rows), above.value
        get = lambda node: own.known.get(node) or shared.known[node]
        root = get((TOP, len(own.widths[TOP]) - 1, 0))
        for at in range(0, len(rows), 5000):
            out = []
            for (tree, _, index), (doc_id, _, leaf, other, _) in rows[at : at + 5000]:
                folded, siblings = own.climb(tree, index, leaf if other is None else other, get)
                folded, more = own.climb(TOP, tree, folded, get)
                subroot = get((tree, len(own.widths[tree]) - 1, 0))
                out.append((doc_id, leaf, subroot, root, digest(siblings + more), folded, folded == root))
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    return numbered.mapInArrow(proofs, schema)


def _again(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest
