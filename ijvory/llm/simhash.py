"""SimHash near-duplicate detection with deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits are cut into two
segments of 32 bits; one of the segments then differs in at most one bit. Each
segment is indexed as it is and with each one of its bits wild; an equality
join of the index brings every such pair together, and a popcount verifies it.
A wild bit joins only fingerprints that differ in it, so a pair meets once for
each segment, never once for each of 32 wildcards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ijvory.llm.common import content, cut, held, parts_for, slices

SEED = 42
BITS, SEGMENTS = 64, 2
WIDTH = BITS // SEGMENTS
MAX_DISTANCE = 3
#: Shingles whose bits are unpacked at a time.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text as an unsigned integer; zero for a text without words."""
    words = (text or "").encode().lower().split()
    if len(words) > shingle:
        shingles = [b" ".join(x) for x in zip(*(words[k:] for k in range(shingle)))]
    else:
        shingles = [b" ".join(words)] if words else []
    blocks = (shingles[at : at + BLOCK] for at in range(0, len(shingles), BLOCK))
    return _majority(np.array([xxhash.xxh64_intdigest(s, SEED) for s in block], np.uint64) for block in blocks)


def _majority(blocks: Iterator[np.ndarray]) -> int:
    """The bits that more than half of all hashes have, as an unsigned integer; zero without hashes."""
    votes, n = np.zeros(BITS, np.int64), 0
    for hashes in blocks:
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    both = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return both.mapInArrow(run, "doc_id long, fp long")


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, k * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints, a < b, within ``max_distance`` bits.

    ``fps`` has one row for each distinct ``fp``. A pair may come twice, once
    from either segment. Two segments find all pairs up to three bits apart.
    """
    if not 0 <= max_distance <= 2 * SEGMENTS - 1:
        raise ValueError("two segments find pairs at most three bits apart")
    wild = [
        F.struct(
            (_segment(F.col("fp"), k).bitwiseAND(F.lit(((1 << WIDTH) - 1) ^ (1 << b))) + F.lit((k * WIDTH + b) << WIDTH)).alias("key"),
            F.shiftrightunsigned("fp", k * WIDTH + b).bitwiseAND(F.lit(1)).alias("side"),
        )
        for k in range(SEGMENTS)
        for b in range(WIDTH)
    ]
    same = [(_segment(F.col("fp"), k) + F.lit((SEGMENTS * WIDTH + k) << WIDTH)) for k in range(SEGMENTS)]
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance

    def side(df, n, name):
        return df.where(F.col("x.side") == n).select("x.key", F.col("fp").alias(name))

    variants = fps.select("fp", F.explode(F.array(*wild)).alias("x"))
    by_wild = side(variants, 0, "a").join(side(variants, 1, "b"), "key").where(near).select("a", "b")
    exact = fps.select("fp", F.explode(F.array(*same)).alias("key"))
    a, b = exact.select("key", F.col("fp").alias("a")), exact.select("key", F.col("fp").alias("b"))
    by_same = a.join(b, "key").where((F.col("a") < F.col("b")) & near).select("a", "b")
    return by_wild.unionByName(by_same)


#: Edges that one task ties together.
TIED = 1 << 19


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, root)`` of all edges ``(lo, hi)`` of a task: roots are hooked to the least root they have an edge to, until none has one."""
    both = [b for b in batches if b.num_rows]
    if not both:
        return
    lo, hi = (np.concatenate([b.column(k).to_numpy() for b in both]) for k in range(2))
    nodes, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    x, y = at[: len(lo)], at[len(lo) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(edges: DataFrame, n: int | None = None) -> DataFrame:
    """``(node, root)``: each node of ``edges (a, b)`` with the smallest node it reaches; ``n``, if given, is their number.

    Edges that fit a task are tied in it, in one job. Of more, large-star and small-star steps alternate,
    each one a group-minimum and an equality join, until the edges no longer change. Every exchange is fed
    by as many partitions as the edges call for, however many the session shuffles into.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    if n is not None and n <= TIED:
        return cut(edges.coalesce(1).mapInArrow(_tied, "node long, root long"))
    edges = cut(edges.distinct())

    def state(df):
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(lo, hi))")).first())

    before = None
    while (now := state(edges)) != before:
        if now[0] <= TIED:
            return cut(edges.coalesce(1).mapInArrow(_tied, "node long, root long"))
        before, parts = now, parts_for(now[0])
        few = lambda df, n=parts: df.coalesce(n)
        edges = few(edges)
        ways = edges.select("lo", "hi", F.explode(F.array(F.struct("lo", "hi"), F.struct(F.col("hi").alias("lo"), F.col("lo").alias("hi")))).alias("x"))
        least = ways.groupBy(F.col("x.lo").alias("u")).agg(F.min("x.hi").alias("v"))
        least = few(least.select("u", F.least("u", "v").alias("m")))
        # large star: the larger neighbours of u are tied to the least of them all
        large = few(few(edges.join(least, F.col("lo") == F.col("u")).select(F.col("m").alias("lo"), "hi")).distinct())
        # small star: u and its smaller neighbours are tied to the least of these
        floor = few(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")))
        tied = few(large.join(floor, F.col("hi") == F.col("u")))
        hops = tied.select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("u").alias("hi")))).alias("x")).select("x.*")
        edges = cut(few(hops.where("lo <> hi").distinct()))
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(edges.select("lo", "lo").distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = MAX_DISTANCE
) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Documents link if their fingerprints differ in at most ``max_distance``
    bits; ``component_id`` is the smallest id that a document reaches. Null and
    empty texts have fingerprint zero and link like any other. Repeated rows
    come out as often as they came in; rows with a null id have no part in the
    smallest id but get the component of their fingerprint. An empty table
    gives an empty table; further columns of ``docs`` are not read.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    groups = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    tied = components(links(groups.select("fp"), max_distance))
    first = groups.select(F.col("fp").alias("node"), "first")
    joined = first.join(tied, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # no shuffle below by component: the smallest id of each root comes by a join of its own
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    label = cut(joined.select("node", "root").join(smallest, "root").select(F.col("node").alias("fp"), "component_id"))
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


#: Keys with more texts than CROWDED are settled by representatives; FEW of them in the first round, GROWTH times as many in each next one.
CROWDED, FEW, GROWTH = 32, 8, 8
#: Shingles that count as common: one text in SAMPLED is looked at, the COMMON shingles most often seen OFTEN times or more are taken.
SAMPLED, OFTEN, COMMON = 16, 6, 100_000


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    shingles = {b" ".join(x) for x in zip(*(words[k:] for k in range(shingle)))} or {b" ".join(words)}
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)).view(np.int64))


def sketch(shingles: np.ndarray) -> bytes:
    """A bit for each of the places, one to two for each shingle, to which some shingle of a set is hashed."""
    places = 1 << max(3, (len(shingles) - 1).bit_length())
    bits = np.zeros(places, bool)
    bits[shingles & (places - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_overlap(x: bytes, n_x: int, y: bytes, n_y: int, similarity: float) -> bool:
    """False only if two sets, by their sketches and sizes, cannot have the Jaccard similarity.

    Each bit that one set has alone stands for a shingle at least that the other lacks. The larger
    sketch is folded to the size of the smaller one.
    """
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(p), len(q))
    p, q = (np.bitwise_or.reduce(z.reshape(-1, size), axis=0) for z in (p, q))
    most = min(n_x - int(np.bitwise_count(p & ~q).sum()), n_y - int(np.bitwise_count(q & ~p).sum()))
    return most >= similarity * (n_x + n_y - most) - 1e-9


def _nodes(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(doc_id, content, node, fp, n, sketch)`` for every row.

    Texts with equal sets of shingles share a node, those without words have node 0; fp, n and
    sketch are the fingerprint, the size and the sketch of the set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, limit=1 << 19)):
            sets = [shingle_set(t, shingle) for t in b.column(1).to_pylist()]
            nodes = np.array([_node(x) for x in sets], np.int64)
            fps = np.array([_majority(x[at : at + BLOCK].view(np.uint64) for at in range(0, len(x), BLOCK)) for x in sets], np.uint64).view(np.int64)
            more = [pa.array([len(x) for x in sets], pa.int32()), pa.array([sketch(x) for x in sets], pa.binary())]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(nodes), pa.array(fps), *more], names=["doc_id", "content", "node", "fp", "n", "sketch"])

    both = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), content(F.col(text_col)).alias("content"))
    return both.mapInArrow(run, "doc_id long, content binary, node long, fp long, n int, sketch binary")


def _sets(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``(shingles)`` for every row: the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 0, 1 << 19)):
            yield pa.record_batch([pa.array([shingle_set(t, shingle) for t in b.column(0).to_pylist()], pa.list_(pa.int64()))], names=["shingles"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "shingles array<long>")


def _texts(docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """``(node, z)``: a text of each of the ``nodes (node, content)``, which are settled, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for b in (part for batch in batches for part in slices(batch)):
            yield pa.record_batch([b.column(0), pa.array([zip_.compress(t.encode()) for t in b.column(1).to_pylist()], pa.binary())], names=["node", "z"])

    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), content(F.col(text_col)).alias("content")).join(nodes, "content")
    return cut(own.select("node", "text").mapInArrow(run, "node long, z binary").dropDuplicates(["node"]))


def _prefixes(docs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """``(key, node, at, size)``: the shingles of a set of which a similar set has one at least among its own.

    Sets of n and more shingles that are alike share ``similarity * n`` of them, so in any one
    order of all shingles their first ``n - similarity * n + 1`` have one in common. The order
    puts common shingles last; it decides the cost alone, so a sample of the texts will do.
    """
    sample = _sets(docs.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLED)) == 0), text_col, shingle)
    often = sample.select(F.explode("shingles").alias("key")).groupBy("key").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "key").limit(COMMON).toArrow()
    common, count = (often.column(k).to_numpy().astype(np.int64) for k in range(2))
    order = np.argsort(common)
    common, count = common[order], count[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in (part for batch in batches for part in slices(batch, 0, 1 << 19)):
            keys, nodes, places, sizes = [], [], [], []
            for text in b.column(0).to_pylist():
                x = shingle_set(text, shingle)
                n, node = len(x), _node(x)
                if not n or node in seen:
                    continue
                if len(seen) < BLOCK:
                    seen.add(node)  # most copies of a set end here, the others below
                first = min(n, n - math.ceil(similarity * n - 1e-9) + 1)
                if len(common):
                    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    x = x[np.lexsort((x, np.where(common[at] == x, count[at], 0)))]
                keys.append(x[:first])
                nodes.append(np.full(first, node, np.int64))
                places.append(np.arange(first, dtype=np.int32))
                sizes.append(np.full(first, n, np.int32))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in (keys, nodes, places, sizes)], names=["key", "node", "at", "size"])

    index = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key long, node long, at int, size int")
    # dealt once by key; the rest needs no other exchange
    return index.repartition("key").groupBy("key", "node").agg(F.min("at").alias("at"), F.min("size").alias("size"))


def _node(shingles: np.ndarray) -> int:
    """A number for a set of shingles; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64)) if len(shingles) else 0


def _may(similarity: float) -> Column:
    """Whether sets a and b can be alike, by their sizes and by what is left of them after a key they share."""
    less, more = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    most = F.least("a_at", "b_at") + F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    need = (F.col("a_size") + F.col("b_size")) * F.lit(similarity / (1 + similarity)) - 1e-6
    return (less >= more * similarity - 1e-6) & (most >= need)


def _counted(index: DataFrame) -> DataFrame:
    """The entries of keys with more than one, with their number ``n``."""
    return index.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")


def _by_size(crowd: DataFrame, similarity: float) -> DataFrame:
    """Entries of crowded keys under finer keys: similar sets are alike in size, so each entry goes to the class of its size and to the one below."""
    # classes a little wider than the ratio of sizes that similar sets can have
    grade = F.floor(F.log(F.col("size").cast("double")) / (1e-6 - math.log(similarity)))
    each = crowd.select("key", F.explode(F.array(grade, grade - 1)).alias("grade"), "node", "at", "size")
    return _counted(each.select(F.xxhash64("key", "grade").alias("key"), "node", "at", "size"))


def _side(index: DataFrame, name: str, *more: str) -> DataFrame:
    return index.select("key", F.col("node").alias(name), F.col("at").alias(f"{name}_at"), F.col("size").alias(f"{name}_size"), *[F.col(m).alias(f"{name}_{m}") for m in more])


def _alike(pairs: DataFrame, drawn: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float) -> tuple[DataFrame, int]:
    """Those of the pairs ``(a, b)`` of nodes whose sets of shingles have the Jaccard similarity, and their number.

    The sketches rule out most of the others, so that few texts are moved.
    """

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n_x, y, n_y = (b.column(k).to_pylist() for k in range(2, 6))
            keep = [may_overlap(*z, similarity) for z in zip(x, n_x, y, n_y)]
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(node: int, z: pa.Scalar) -> np.ndarray:
            if node not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[node] = shingle_set(zstandard.ZstdDecompressor().decompress(z.as_py()).decode(), shingle)
            return kept[node]

        for b in batches:
            keep = []
            for x, y, zx, zy in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                p, q = of(x, zx), of(y, zy)
                c = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(c >= similarity * (len(p) + len(q) - c) - 1e-9)
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs, n = held(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not n:
        return pairs, 0
    ends = lambda of: of.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own, _ = held(ends(pairs), hint=True)
    mine, _ = held(drawn.join(own, "node", "left_semi"), hint=True)
    side = lambda name: mine.select(F.col("node").alias(name), F.col("sketch").alias(f"s{name}"), F.col("n").alias(f"n{name}"))
    likely, n = held(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "na", "sb", "nb").mapInArrow(may, "a long, b long"))
    if not n:
        return likely, 0
    nodes, _ = held(mine.select("node", "content").join(ends(likely), "node", "left_semi"), hint=True)
    texts = _texts(docs, text_col, nodes)
    text = lambda name: texts.select(F.col("node").alias(name), F.col("z").alias(f"z{name}"))
    return held(likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "za", "zb").mapInArrow(same, "a long, b long"))


def _by_fingerprint(rows: DataFrame, sharing: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of nodes in ``sharing`` that the fingerprints propose: each with the first of its fingerprint, and the first ones of linked fingerprints."""
    nodes = rows.select("node", "fp").join(sharing, "node", "left_semi").distinct()
    first, _ = held(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(first.select("fp"))
    end = lambda name: first.select(F.col("fp").alias(name), F.col("first").alias(f"{name}_node"))
    near = near.join(end("a"), "a").join(end("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return same.unionByName(near)


def _similar_nodes(docs: DataFrame, text_col: str, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(node, root)`` for the nodes that are like another one: components of all pairs with the similarity.

    Fingerprints propose pairs first; those that the exact similarity confirms tie most copies. An
    exact prefix join then finds what fingerprints cannot, among texts not yet tied. Of a crowded
    key some members, by their hash, are compared with all others that are not yet in their
    component, and with them the member that has most links so far; more of them each round, until
    the key is one component or every member has been compared. Texts that share a key of few
    texts and are not tied by then are compared pair by pair.
    """
    index, _ = held(_counted(_prefixes(docs, text_col, shingle, similarity)))
    # a text that shares no key has no partner at all
    sharing, _ = held(index.select("node").distinct(), hint=True)
    drawn = rows.join(sharing, "node", "left_semi").groupBy("node")
    drawn, _ = held(drawn.agg(F.first("sketch").alias("sketch"), F.first("n").alias("n"), F.min("content").alias("content")), hint=True)
    links_, n_links = _alike(_by_fingerprint(rows, sharing), drawn, docs, text_col, shingle, similarity)
    tied = components(links_, n_links)
    index, _ = held(index.where(F.col("n") <= CROWDED).unionByName(_by_size(index.where(F.col("n") > CROWDED), similarity)))
    spread = (F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)).alias("u")
    crowd, n = held(index.where(F.col("n") > CROWDED).select("*", spread))
    before, now = 0, FEW
    while n:
        degree = links_.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        known = crowd.where(F.col("n") > before).join(tied, "node", "left").join(degree, "node", "left")
        known, _ = held(known.select("key", "node", "at", "size", "n", "u", F.coalesce("root", "node").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree")))
        open_keys = known.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max(F.struct("degree", "node")).alias("top"))
        open_keys = open_keys.where("r0 <> r1").select("key", F.when(F.col("top.degree") > 0, F.col("top.node")).alias("hub"))
        crowd, n = held(known.join(open_keys, "key").select("key", "node", "at", "size", "n", "u", "root", "hub"))
        if not n:
            break
        lead = crowd.where((F.col("u") >= before / F.col("n")) & (F.col("u") < now / F.col("n")) | (F.col("node") == F.col("hub")))
        pairs = _side(lead, "a", "root").join(_side(crowd, "b", "root"), "key").where((F.col("a_root") != F.col("b_root")) & _may(similarity)).select("a", "b")
        found, n = _alike(pairs, drawn, docs, text_col, shingle, similarity)
        if n:
            n_links += n
            links_ = links_.unionByName(found).coalesce(parts_for(n_links))
            tied = components(links_, n_links)
        crowd = crowd.select("key", "node", "at", "size", "n", "u")
        before, now = now, now * GROWTH
    few = index.where(F.col("n") <= CROWDED).join(tied, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root"))
    pairs = _side(few, "a", "root").join(_side(few, "b", "root"), "key").where(apart & _may(similarity)).select("a", "b")
    found, n = _alike(pairs, drawn, docs, text_col, shingle, similarity)
    return components(links_.unionByName(found), n_links + n) if n else tied


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, node, component_id)``: groups of texts that are tied by pairs of a Jaccard similarity of ``similarity`` at least.

    The similarity is that of the sets of distinct shingles (as 64-bit hashes), found exactly for every
    pair that decides a group; no pair is missed. Texts without words form one group.
    """
    groups = _groups(docs, id_col, text_col, shingle, similarity)
    return groups.select("doc_id", "node", F.col("first.doc_id").alias("component_id"))


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """``(doc_id, content, node, first)``: first is the smallest id, with its content, of the group."""
    rows = cut(_nodes(docs, id_col, text_col, shingle))
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "content"))
    nodes = cut(rows.groupBy("node").agg(F.min(own).alias("first")))
    joined = nodes.join(_similar_nodes(docs, text_col, rows, shingle, similarity), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("first"))
    label = cut(joined.select("node", "root").join(smallest, "root").select("node", "first"))
    return rows.join(label, "node").select("doc_id", "content", "node", "first")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group of similar texts; columns as they were.

    Of rows that repeat this id and text one stays, of similar texts under this id one too; other
    texts under it are judged by their own group. Rows with a null id stay, as no other stands for them.
    """
    groups = cut(_groups(docs, "doc_id", "text", shingle, similarity))
    other = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("content") != F.col("first.content"))
    named = F.struct("doc_id", "content").alias("_key")
    gone, _ = held(groups.where(other).select(named).distinct(), hint=True)
    again, n_again = held(groups.where(~other).groupBy(named).count().where("count > 1").select("_key"), hint=True)
    key = F.struct(docs["doc_id"].cast("long").alias("doc_id"), content(docs["text"]).alias("content")) == F.col("_key")
    # rows with a null id have no first text and so are in neither table
    kept = docs.join(gone, key, "left_anti")
    if not n_again:
        return kept
    once = kept.join(again, key, "left_anti")
    repeated = kept.join(again, key, "left_semi").withColumn("_content", content(F.col("text"))).dropDuplicates(["doc_id", "_content"])
    return once.unionByName(repeated.drop("_content"))
