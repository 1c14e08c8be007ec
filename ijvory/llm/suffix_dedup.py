"""Repeated substrings by blockwise suffix sorting with a difference cover.

Documents are packed into slices of bounded size. A difference cover samples the
positions of every document so that two equal strings of WIDTH bytes, wherever
they start, share a sampled position. The sampled strings are ranked first: a
rank says whether another document has the string. A suffix can only have a tie
of WIDTH bytes if a sample in its first MODULUS bytes has one, so the ranks leave
few suffixes, and only these are ever moved and sorted.

They are dealt into suffix buckets. A suffix goes where its anchor goes, the
KEY bytes within its first WIDTH that come first in a fixed pseudo-random order;
neighbouring suffixes mostly have the same anchor, so that one record carries a
run of them. A task sorts the suffixes of its bucket byte by byte. Ties end at
WIDTH bytes, as the contract compares no more: suffixes that are equal so far are
neighbours, and the smallest document among them keeps its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.llm.common import content, cut, small

WIDTH = 50
#: A perfect difference cover modulo 21: each difference occurs once.
MODULUS, COVER = 21, (0, 1, 4, 14, 16)
SAMPLE = WIDTH - MODULUS + 1
#: Bytes of an anchor; suffixes that can share one; bytes of a record: text, then the number of its suffixes.
KEY = 16
SPREAD = WIDTH - KEY + 1
TEXT = WIDTH + SPREAD - 1
ROW = TEXT + 4
SLICE_BYTES = 1 << 21
#: Bytes of text for each bucket, about, and the least number of buckets.
BUCKET_BYTES, BUCKETS = 12 << 20, 64
LAST = 2**63 - 1
SLICES = "slice long, ids array<long>, orders array<long>, sizes array<long>, z binary"
U64 = np.uint64


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, and n powers of a random odd base and of its inverse modulo 2^64."""
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 64, 256, dtype=U64)
    base = int(rng.integers(0, 1 << 64, dtype=U64)) | 1
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, U64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return values, both[0], both[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def fingerprints(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit fingerprint of the ``width`` bytes of ``data`` from each position in ``at``."""
    values, up, down = _powers(1 << max(len(data), 1).bit_length())
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return _mixed((sums[at + width] - sums[at]) * down[at])


def pack(docs: DataFrame) -> DataFrame:
    """Slices of whole documents ``(doc_id, text)``, compressed; ``orders`` sorts null ids last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        zip_ = zstandard.ZstdCompressor(level=3)

        def row():
            nonlocal number, ids, texts, held
            out = [[number], [ids], [[LAST if i is None else i for i in ids]], [[len(t) for t in texts]], [zip_.compress(b"".join(texts))]]
            number, ids, texts, held = number + 1, [], [], 0
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds)], names=["slice", "ids", "orders", "sizes", "z"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = (t.as_py() or "").encode()
                ids.append(i)
                texts.append(text)
                held += len(text)
                if held >= SLICE_BYTES:
                    yield row()
        if ids:
            yield row()

    return docs.mapInArrow(run, SLICES)


def _unzip(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {name: b.column(name)[k].as_py() for name in b.schema.names}


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts ``keys`` (numbers or fixed-width bytes), and where each run of equals begins in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    return order, np.flatnonzero(first)


def _spread(first: np.ndarray, n: int) -> np.ndarray:
    """The number of its run for each of n sorted entries."""
    return np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))


def _bytes(rows: np.ndarray) -> np.ndarray:
    """Rows of a byte matrix as values that compare byte by byte."""
    rows = np.ascontiguousarray(rows)
    return rows.view(f"V{rows.shape[1]}").ravel()


class Slice:
    """The bytes of a slice with its documents' places."""

    def __init__(self, row: dict):
        self.number, self.ids = row["slice"], row["ids"]
        self.orders, self.sizes = np.array(row["orders"], np.int64), np.array(row["sizes"], np.int64)
        self.data = np.frombuffer(_unzip(row["z"]) if self.sizes.sum() else b"", np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def order_of(self, at: np.ndarray) -> np.ndarray:
        return self.orders[np.searchsorted(self.starts, at, side="right") - 1] if len(at) else np.zeros(0, np.int64)

    def whole(self, width: int) -> np.ndarray:
        """Which positions have ``width`` bytes of their document from them on."""
        edge = np.zeros(len(self.data) + 1, np.int8)
        for a, n in zip(self.starts, self.sizes):
            if n >= width:
                edge[a], edge[a + n - width + 1] = edge[a] + 1, edge[a + n - width + 1] - 1
        return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The positions of the cover, in the order of their strings' fingerprints; the distinct fingerprints; where each begins."""
        step = np.arange(len(self.data), dtype=np.int64) - np.repeat(self.starts, self.sizes)
        chosen = np.zeros(MODULUS, bool)
        chosen[list(COVER)] = True
        at = np.flatnonzero(chosen[step % MODULUS] & self.whole(SAMPLE))
        keys = fingerprints(self.data, at, SAMPLE) if len(at) else np.zeros(0, U64)
        order, first = _groups(keys)
        return at[order], keys[order][first], first

    def suffixes(self, tied: np.ndarray) -> np.ndarray:
        """Starts of the suffixes that have one of the ``tied`` samples in their first MODULUS bytes."""
        mark = np.zeros(len(self.data) + 1, np.int32)
        mark[tied + 1] = 1
        sums = np.cumsum(mark, dtype=np.int32)
        at = np.flatnonzero(self.whole(WIDTH))
        return at[sums[at + MODULUS] > sums[at]]

    def records(self, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and size of each run of suffixes with one anchor, the anchor's hash, and the run's bytes."""
        at = self.suffixes(tied)
        n = len(self.data)
        if not len(at):
            return at, at, np.zeros(0, U64), np.zeros((0, ROW), np.uint8)
        padded = np.concatenate([self.data, np.zeros(8 + TEXT, np.uint8)])
        words = np.empty(n + 8, U64)
        for k in range(8):
            part = padded[k : k + (n + 8 - k + 7) // 8 * 8]
            words[k::8] = part.view("<u8")[: len(words[k::8])]
        hashes = _mixed(words[:n] * U64(0x9E3779B97F4A7C15) + words[8 : n + 8])
        # the position in the low bits: the least value is the first of equal anchors, in any slice
        low = U64(0xFFFFFFFF)
        least = (hashes & ~low) | np.arange(n, dtype=U64)
        wide = 1
        while 2 * wide <= SPREAD:
            least = np.minimum(least[: len(least) - wide], least[wide:])
            wide *= 2
        rest = SPREAD - wide
        anchors = (np.minimum(least[at], least[at + rest]) & low).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (anchors[1:] != anchors[:-1])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(at)))
        starts = at[first]
        rows = np.zeros((len(first), ROW), np.uint8)
        place = np.arange(TEXT)
        rows[:, :TEXT] = np.where(place < (sizes + WIDTH - 1)[:, None], padded[starts[:, None] + place], 0)
        rows[:, TEXT] = sizes
        return starts, sizes, hashes[anchors[first]], rows


def _packed(ranks: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as differences of three bytes each, or four where one is larger."""
    steps = np.diff(ranks, prepend=0).astype("<u4")
    wide = 3 if steps.max(initial=0) < 1 << 24 else 4
    return steps.view(np.uint8).reshape(-1, 4)[:, :wide].tobytes()


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 4), np.uint8)
    if n:
        wide = len(packed) // n
        steps[:, :wide] = np.frombuffer(packed, np.uint8).reshape(n, wide)
    return np.cumsum(steps.view("<u4").ravel(), dtype=np.int64)


RANKS = "task int, slice long, n int, ranks binary, shared binary"
BITS = "slice long, kind int, task int, bits binary"
RECORDS = "task int, slice long, n int, rows binary, docs binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _parts(bucket: np.ndarray, tasks: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each bucket's entries, in their order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(tasks + 1))
    for t, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            yield t, order[a:b]


def _dealt(keys: np.ndarray, tasks: int) -> np.ndarray:
    return ((keys & U64(0xFFFFFFFF)) % U64(tasks)).astype(np.int64)


def _send_ranks(slices: DataFrame, tasks: int) -> DataFrame:
    """The sampled strings of every slice, one row for each bucket: 32 bits of each distinct string, and whether two of the slice's documents have it."""

    def run(batches):
        for r in _rows(batches):
            s, out = Slice(r), []
            at, keys, first = s.samples()
            docs = s.order_of(at)
            shared = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first) if len(first) else np.zeros(0, bool)
            for t, mine in _parts(_dealt(keys, tasks), tasks):
                out.append((t, s.number, len(mine), _packed((keys[mine] >> U64(32)).astype(np.int64)), np.packbits(shared[mine]).tobytes()))
            yield from _table(RANKS, out).to_batches()

    return slices.mapInArrow(run, RANKS)


def _tied_ranks(sent: pa.Table) -> pa.Table:
    """In one bucket of the cover, the bit of each sampled string: another document has it."""
    rows = list(_rows(iter(sent.to_batches())))
    sizes = [r["n"] for r in rows]
    ranks = np.concatenate([_unpacked(r["ranks"], r["n"]) for r in rows])
    bit = np.concatenate([np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=r["n"]) for r in rows]).astype(bool)
    order = np.argsort(ranks, kind="stable")
    same = ranks[order][1:] == ranks[order][:-1]
    bit[order[1:]] |= same
    bit[order[:-1]] |= same
    parts = np.split(bit, np.cumsum(sizes)[:-1])
    return _table(BITS, [(r["slice"], 0, r["task"], np.packbits(b).tobytes()) for r, b in zip(rows, parts) if b.any()])


def _tied(s: Slice, answers: list[dict], tasks: int) -> np.ndarray:
    """The sampled positions of a slice whose string another document has."""
    at, keys, first = s.samples()
    bit = np.zeros(len(keys), bool)
    found = {r["task"]: r["bits"] for r in answers if r["kind"] == 0}
    for t, mine in _parts(_dealt(keys, tasks), tasks):
        if t in found:
            bit[mine] = np.unpackbits(np.frombuffer(found[t], np.uint8), count=len(mine))
    return at[bit[_spread(first, len(at))]]


def _distinct(s: Slice, tied: np.ndarray):
    """The runs of a slice, their distinct records, and for each run the number of its record."""
    starts, sizes, hashes, rows = s.records(tied)
    docs = s.order_of(starts)
    order, first = _groups(_bytes(rows))
    which = np.empty(len(starts), np.int64)
    which[order] = _spread(first, len(order))
    least = np.minimum.reduceat(docs[order], first) if len(first) else docs
    return starts, sizes, docs, which, rows[order][first], hashes[order][first], least


def _send_records(tasks: int):
    """The distinct runs of a slice, one row for each bucket, with the smallest document of each."""

    def run(slices: pa.Table, answers: pa.Table) -> pa.Table:
        out, told = [], list(_rows(iter(answers.to_batches())))
        for r in _rows(iter(slices.to_batches())):
            s = Slice(r)
            *_, rows, hashes, least = _distinct(s, _tied(s, told, tasks))
            zip_ = zstandard.ZstdCompressor(level=1)
            for t, mine in _parts(_dealt(hashes, tasks), tasks):
                out.append((t, s.number, len(mine), zip_.compress(rows[mine].tobytes()), zip_.compress(least[mine].tobytes())))
        return _table(RECORDS, out)

    return run


def _sort_bucket(sent: pa.Table) -> pa.Table:
    """In one suffix bucket, for each record the bits of its suffixes that a smaller document has.

    All suffixes of the bucket's distinct records are sorted; equal ones are neighbours then.
    """
    sent_rows = list(_rows(iter(sent.to_batches())))
    rows = np.concatenate([np.frombuffer(_unzip(r["rows"]), np.uint8).reshape(-1, ROW) for r in sent_rows])
    docs = np.concatenate([np.frombuffer(_unzip(r["docs"]), np.int64) for r in sent_rows])
    order, first = _groups(_bytes(rows))
    number = _spread(first, len(order))
    least = np.minimum.reduceat(docs[order], first)
    texts = rows[order[first]]
    sizes = texts[:, TEXT].astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    suffixes = np.lib.stride_tricks.sliding_window_view(texts[:, :TEXT], WIDTH, axis=1)[owner, shift]
    in_order, begins = _groups(_bytes(suffixes))
    smallest = np.minimum.reduceat(least[owner[in_order]], begins)
    gone = np.empty(len(owner), bool)
    gone[in_order] = smallest[_spread(begins, len(owner))] < least[owner[in_order]]
    masks = np.zeros(len(texts), U64)
    np.bitwise_or.at(masks, owner[gone], U64(1) << shift[gone].astype(U64))
    # a record of a document after the first that has its text is gone whole
    answer = np.empty(len(rows), U64)
    answer[order] = np.where(docs[order] > least[number], U64(2**64 - 1), masks[number])
    zip_, out, at = zstandard.ZstdCompressor(level=1), [], 0
    for r in sent_rows:
        part = answer[at : at + r["n"]]
        at += r["n"]
        if part.any():
            out.append((r["slice"], 1, r["task"], zip_.compress(part.tobytes())))
    return _table(BITS, out)


def _removed(s: Slice, answers: list[dict], tasks: int) -> np.ndarray:
    """Which bytes of a slice go."""
    starts, sizes, docs, which, _, hashes, least = _distinct(s, _tied(s, answers, tasks))
    masks = np.zeros(len(hashes), U64)
    found = {r["task"]: r["bits"] for r in answers if r["kind"] == 1}
    for t, mine in _parts(_dealt(hashes, tasks), tasks):
        if t in found:
            masks[mine] = np.frombuffer(_unzip(found[t]), U64)
    mask = np.where(docs > least[which], U64(2**64 - 1), masks[which])
    owner = np.repeat(np.arange(len(starts)), sizes)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    gone = (starts[owner] + shift)[(mask[owner] >> shift.astype(U64)) & U64(1) > 0]
    edge = np.bincount(gone, minlength=len(s.data) + 1) - np.bincount(gone + WIDTH, minlength=len(s.data) + 1)
    return np.cumsum(edge[:-1]) > 0


def _finish(tasks: int, with_text: bool):
    def run(slices: pa.Table, answers: pa.Table) -> pa.Table:
        out, told = [], list(_rows(iter(answers.to_batches())))
        for r in _rows(iter(slices.to_batches())):
            s = Slice(r)
            covered = _removed(s, told, tasks)
            for i, a, n in zip(s.ids, s.starts, s.sizes):
                c, text = covered[a : a + n], s.data[a : a + n]
                kept = text[~c].tobytes()
                spans = int(np.count_nonzero(c[1:] & ~c[:-1]) + (n > 0 and c[0]))
                out.append((i, int(n), int(n) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)[: 5 + with_text])
        return _table(_schema(with_text), out)

    return run


def _schema(with_text: bool) -> str:
    return "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text


def _copies(docs: DataFrame) -> DataFrame:
    """``(copy_order, copy_content)`` of texts of WIDTH bytes and more that a smaller document has word for word."""
    rows = docs.where(F.octet_length("text") >= WIDTH).select(F.coalesce("doc_id", F.lit(LAST)).alias("copy_order"), content(F.col("text")).alias("copy_content"))
    firsts = rows.groupBy("copy_content").agg(F.min("copy_order").alias("first"), F.max("copy_order").alias("last")).where("first < last")
    return rows.join(small(cut(firsts.drop("last"))), "copy_content").where("copy_order > first").select("copy_order", "copy_content").distinct()


def removed_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])`` for every row.

    A byte of the UTF-8 text goes if it is inside a string of WIDTH bytes that
    also starts in a document with a smaller id. Null texts count as empty; rows
    that repeat an id remove nothing from one another; null ids come after all
    others and, among themselves, count as the same; an empty table gives an
    empty one; other columns are not read; ids are cast to long. ``kept`` is the
    remaining bytes. A text has to fit a task, with some 80 bytes of memory for
    each of its own.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # whole copies are settled by their digests and not sorted: what they hold, the first of them holds
    copies = small(cut(_copies(docs)))
    is_copy = (F.coalesce("doc_id", F.lit(LAST)) == F.col("copy_order")) & (content(F.col("text")) == F.col("copy_content"))
    slices = cut(pack(docs.join(copies, is_copy, "left_anti")))
    total = slices.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    tasks = max(BUCKETS, -(-total // BUCKET_BYTES))
    tied = cut(_send_ranks(slices, tasks).groupBy("task").applyInArrow(_tied_ranks, BITS))
    by_slice = slices.groupBy("slice")
    records = by_slice.cogroup(tied.groupBy("slice")).applyInArrow(_send_records(tasks), RECORDS)
    repeats = cut(records.groupBy("task").applyInArrow(_sort_bucket, BITS))
    rest = by_slice.cogroup(tied.unionByName(repeats).groupBy("slice")).applyInArrow(_finish(tasks, with_text), _schema(with_text))
    whole = docs.join(copies, is_copy, "left_semi")
    n = F.octet_length("text").cast("long")
    none = [F.lit(b"").alias("kept")] * with_text
    return rest.unionByName(whole.select("doc_id", n.alias("n_bytes"), n.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), *none))
