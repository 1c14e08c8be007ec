"""Spelling variants: words within one edit of each other, found in broadcast compact tries.

Words are counted in tasks first, a bounded table at a time, then by a shuffle of
those partial counts. The vocabulary, in code-point order, is cut into shards of
bounded size; a task builds the path-compressed trie of each, as a few flat arrays.
Some shards at a time, bounded in bytes, are broadcast; every word's distance-one
Levenshtein automaton is run against each of them depth-first. While no edit has
been made there is one place in the trie; at each branch off the word's own path the
edit is spent, and the rest of the word must follow exactly. What a shard accepts is
reduced at once to a number of neighbours and the best one.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.llm.common import cut, slices

#: A word is a run of these, A-Z in lower case already.
BREAK = "[^a-zÀ-ÿ]+"
#: One in so many (document, word) loses a letter.
EVERY = 97
#: Shortest word, in code points, and least occurrences.
SHORTEST, OFTEN = 5, 3
#: Words that a task counts before it hands them on; bytes of text that are read at a time, and the longest piece of one text.
COUNTED, READ, PIECE = 400_000, 1 << 23, 1 << 22
#: Words of a shard; bytes of the shards that are broadcast at a time.
SHARD, SENT = 200_000, 24 << 20
#: Lengths in bytes up to which checksums are continued by table.
TABLED = 64


def _zero_byte() -> np.ndarray:
    """The table of CRC-32 by one byte, from its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _zero_byte()


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts in lower case, those of more than PIECE characters in several pieces parted at a break; and the row of each piece."""
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    if (pc.max(pc.binary_length(low)).as_py() or 0) <= PIECE:
        return low, np.arange(len(low))
    out, rows = [], []
    for row, text in enumerate(low.to_pylist()):
        at = 0
        while at < len(text) or not at:
            end = at + PIECE
            while end < len(text) and ("a" <= text[end] <= "z" or "À" <= text[end] <= "ÿ"):
                end += 1
            out.append(text[at:end])
            rows.append(row)
            at = end
    return pa.array(out, pa.string()), np.array(rows)


def _count(ids: pa.Array, texts: pa.Array, every: int | None, counts: dict[str, int]) -> None:
    """Add the words of some texts to ``counts``."""
    low, row = _pieces(texts)
    parts = pc.split_pattern_regex(low, BREAK)
    words = parts.flatten().dictionary_encode()
    names, code = words.dictionary.to_pylist(), words.indices.to_numpy()
    n = np.bincount(code, minlength=len(names))
    if every and len(names):
        doc = np.repeat(row, np.diff(parts.offsets.to_numpy()))
        data = [w.encode() for w in names]
        size = np.array([len(b) for b in data])
        own = np.array([zlib.crc32(b) for b in data], np.uint32)
        # the checksum of a prefix, carried on over as many bytes as the word has, and the word's own make that of both
        starts = [None if i is None else f"{i}:".encode() for i in ids.to_pylist()]
        known = np.array([s is not None for s in starts], bool)
        ahead = np.empty((len(starts), 1 + min(TABLED, int(size.max()))), np.uint32)
        ahead[:, 0] = [zlib.crc32(s or b"") for s in starts]
        for k in range(1, ahead.shape[1]):
            ahead[:, k] = (ahead[:, k - 1] >> np.uint32(8)) ^ _TABLE[ahead[:, k - 1] & np.uint32(255)]
        short = np.minimum(size, ahead.shape[1] - 1)[code]
        h = ahead[doc, short] ^ own[code]
        hit = (h % np.uint32(every) == 0) | (size[code] > TABLED)
        for k in np.flatnonzero(hit & known[doc] & (size[code] > 0)):
            c, value = code[k], int(h[k])
            if size[c] > TABLED:
                value = zlib.crc32(data[c], zlib.crc32(starts[doc[k]]))
                if value % every:
                    continue
            w = names[c]
            at = value % len(w)
            w = w[:at] + w[at + 1 :]
            n[c] -= 1
            counts[w] = counts.get(w, 0) + 1
    for w, m in zip(names, n.tolist()):
        if m:
            counts[w] = counts.get(w, 0) + m


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = EVERY, shortest: int = SHORTEST, often: int = OFTEN
) -> DataFrame:
    """``(word, n)`` of all documents: words of at least ``shortest`` code points that occur ``often`` times.

    A run of letters of a document whose unsigned CRC-32 of ``<id>:<run>`` h is divided by
    ``every`` loses its code point h % length; none does where ``every`` is None or the id is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            kept = [w for w in counts if len(w) >= shortest]
            for at in range(0, len(kept), 50_000):
                part = kept[at : at + 50_000]
                yield pa.record_batch([pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])
            counts.clear()

        for b in (part for batch in batches for part in slices(batch, limit=READ)):
            _count(b.column(0), b.column(1), every, counts)
            if len(counts) > COUNTED:
                yield from out()
        yield from out()

    both = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = both.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= often)


class Trie:
    """A path-compressed trie of counted words in flat arrays.

    Nodes are numbered breadth-first, so a node's children follow one another: those
    of node k are ``first[k]`` to ``first[k + 1]``. ``head`` has the first character of the edge
    to each node, ``tail[cut[k]:cut[k + 1]]`` the others; ``n`` the count of a word that ends there, or 0.
    """

    __slots__ = ("first", "cut", "n", "head", "tail")

    def __init__(self, words: list[str], counts: list[int]):
        """``words`` are distinct and in code-point order."""
        heads, tails, n, first, cut_ = ["\0"], [], [0], [], [0, 0]
        todo, held = [(0, len(words), 0)], 0
        for lo, hi, depth in todo:  # grows while it is read
            first.append(len(n))
            if lo < hi and len(words[lo]) == depth:
                n[len(first) - 1] = counts[lo]
                lo += 1
            for c, group in itertools.groupby(range(lo, hi), lambda k: words[k][depth]):
                a = next(group)
                z = a
                for z in group:
                    pass
                one, other, end = words[a], words[z], depth + 1
                most = min(len(one), len(other))
                if a == z:
                    end = most
                while end < most and one[end] == other[end]:
                    end += 1
                heads.append(c)
                tails.append(one[depth + 1 : end])
                held += end - depth - 1
                cut_.append(held)
                n.append(0)
                todo.append((a, z + 1, end))
        first.append(len(n))
        self.first, self.cut, self.n = array("i", first), array("q", cut_), array("q", n)
        self.head, self.tail = "".join(heads), "".join(tails)

    def __getstate__(self):
        return [x.tobytes() for x in (self.first, self.cut, self.n)] + [self.head, self.tail]

    def __setstate__(self, state):
        self.first, self.cut, self.n = array("i"), array("q"), array("q")
        for x, b in zip((self.first, self.cut, self.n), state):
            x.frombytes(b)
        self.head, self.tail = state[3:]

    def neighbours(self, word: str) -> Iterator[tuple[int, str]]:
        """``(n, other)`` for each word of the trie that one inserted, deleted or replaced code point makes of ``word``, each once."""
        first, cut_, counts, head, tail, size = self.first, self.cut, self.n, self.head, self.tail, len(word)
        find, starts = head.find, word.startswith

        def follow(node: int, at: int, j: int) -> int:
            """The count where the edge to ``node``, from place ``at`` of its tail, and what lies below spell word[j:], or 0."""
            while True:
                end = cut_[node + 1]
                if at < end:
                    if not starts(tail[at:end], j):
                        return 0
                    j += end - at
                if j == size:
                    return counts[node]
                node = find(word[j], first[node], first[node + 1])
                if node < 0:
                    return 0
                at, j = cut_[node], j + 1

        node = i = 0  # the automaton without an edit: word[:i] leads to node
        while True:
            c, own = word[i] if i < size else "", -1
            for k in range(first[node], first[node + 1]):
                x = head[k]
                if x == c:
                    own = k
                    continue
                at = cut_[k]
                if n := follow(k, at, i):
                    yield n, word[:i] + x + word[i:]
                if c and (n := follow(k, at, i + 1)):
                    yield n, word[:i] + x + word[i + 1 :]
            if not c:
                return
            # of equal letters in a row the last one is deleted, and a letter is inserted behind its equals
            if i + 1 == size:
                if counts[node]:
                    yield counts[node], word[:i]
            elif (d := word[i + 1]) != c:
                k = find(d, first[node], first[node + 1])
                if k >= 0 and (n := follow(k, cut_[k], i + 2)):
                    yield n, word[:i] + word[i + 1 :]
            if own < 0:
                return
            a, z = cut_[own], cut_[own + 1]
            i += 1
            while a < z and i < size and tail[a] == word[i]:
                a, i = a + 1, i + 1
            if a < z:  # inside an edge there is one way on
                x = tail[a]
                if n := follow(own, a + 1, i):
                    yield n, word[:i] + x + word[i:]
                if i < size:
                    if n := follow(own, a + 1, i + 1):
                        yield n, word[:i] + x + word[i + 1 :]
                    if i + 1 < size and word[i + 1] == x and (n := follow(own, a + 1, i + 2)):
                        yield n, word[:i] + word[i + 1 :]
                return
            node = own


def _shards(words: DataFrame, per_shard: int) -> DataFrame:
    """``(shard, size, trie)``: the tries of runs of about ``per_shard`` words in code-point order, as bytes."""
    n = max(1, -(-words.count() // per_shard))
    ranges = words.repartitionByRange(n, "word")
    parts = max(1, ranges.rdd.getNumPartitions())
    # neighbouring ranges share a shard where there are more ranges than asked for
    ranges = ranges.withColumn("shard", F.floor(F.spark_partition_id() * n / F.lit(float(parts))).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        kept = pickle.dumps(Trie(table.column("word").to_pylist(), table.column("n").to_pylist()))
        return pa.table({"shard": table.column("shard")[:1], "size": pa.array([len(kept)], pa.int64()), "trie": pa.array([kept], pa.binary())})

    return cut(ranges.groupBy("shard").applyInArrow(build, "shard int, size long, trie binary"))


def neighbourhoods(words: DataFrame, per_shard: int = SHARD, sent: int = SENT) -> DataFrame:
    """``(word, n_near, best_n, best)`` for each word of ``(word, n)`` with a neighbour among them.

    ``best`` is the neighbour of largest n, of equals the first in code-point order. Only tries of
    at most ``sent`` bytes together, or one shard, pass through the driver at a time.
    """
    spark, shards = words.sparkSession, _shards(words, per_shard)
    passes: list[list[int]] = [[]]
    held = 0
    for shard, size in shards.select("shard", "size").orderBy("shard").collect():
        if passes[-1] and held + size > sent:
            passes.append([])
            held = 0
        passes[-1].append(shard)
        held += size

    out = None
    for group in passes:
        tries = [bytes(r["trie"]) for r in shards.where(F.col("shard").isin(group)).select("trie").collect()] if group else []
        shared = spark.sparkContext.broadcast(tries)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            here = [pickle.loads(t) for t in shared.value]
            for batch in batches:
                found = []
                for word in batch.column(0).to_pylist():
                    near, best, form = 0, 0, None
                    for trie in here:
                        for n, other in trie.neighbours(word):
                            near += 1
                            if n > best or n == best and other < form:
                                best, form = n, other
                    if near:
                        found.append((word, near, best, form))
                cols = list(zip(*found)) or [()] * 4
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(x, k) for x, k in zip(cols, kinds)], names=["word", "n_near", "best_n", "best"])

        part = cut(words.select("word").mapInArrow(run, "word string, n_near long, best_n long, best string"))
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    first = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    reduced = out.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("x"))
    return reduced.select("word", "n_near", (-F.col("x.m")).alias("best_n"), "x.best")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)``: where the forms lead to, the word itself if it has none; by doubling."""
    at = cut(forms.select("word", "form"))
    while not at.where("form IS NOT NULL").isEmpty():
        ahead = at.select(F.col("word").alias("form"), F.col("form").alias("next"))
        at = at.join(ahead, "form", "left").select("word", "form", "next")
        # a word whose form has no form of its own is done; it keeps the root that it has reached
        if at.where("next IS NOT NULL").isEmpty():
            break
        at = cut(at.select("word", F.coalesce("next", "form").alias("form")))
    return at.select("word", F.coalesce("form", "word").alias("root"))


def variants(words: DataFrame, factor: int = 2, per_shard: int = SHARD, sent: int = SENT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``(word, n)``.

    A word's form is its neighbour of largest n if that is at least ``factor`` times its own, which
    lets forms lead to no circle. An empty table gives an empty one.
    """
    words = cut(words.select("word", "n"))
    near = neighbourhoods(words, per_shard, sent)
    large = F.col("best_n") >= factor * F.col("n")
    both = words.join(near, "word", "left")
    both = cut(both.select(
        "word", F.when(large, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best_n")).alias("form_n")
    ))
    return both.join(roots(both), "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = EVERY) -> DataFrame:
    """``variants`` of the words of all documents.

    Null and empty texts have no words; repeated rows count again; a null id deletes no letters;
    ids are cast to long; other columns are not read; without words there are no rows.
    """
    return variants(word_counts(docs, id_col, text_col, every))
