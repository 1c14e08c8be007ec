"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Every run of ``SPAN`` words that a document shares with a benchmark item holds a
``GRAM``-word gram whose hash is the least of its neighbours (the minimum of each
sliding window of ``SPAN - GRAM + 1`` gram hashes is kept on either side), so
joining the kept grams misses no shared run. A joined gram carries the words
around it; the runs that hold it are then compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ijvory.llm.common import ascii_lower, content, cut, let, small

SPAN = 10
GRAM = 5
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text: A-Z in lower case, cut at all other ASCII; none for null."""
    return F.filter(F.split(ascii_lower(text), NOT_WORD), lambda w: w != "")


def _join(ws: Column, at: Column, n: int) -> Column:
    """The ``n`` words of ``ws`` from the zero-based ``at``, joined by spaces."""
    return F.array_join(F.slice(ws, at + 1, n), " ")


def _upto(n: Column) -> Column:
    """0 .. n-1, empty if n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _slide(values: Column, pick, back: int, width: int, n: Column) -> Column:
    """pick() over the ``width`` entries of ``values`` that start ``back`` before each of n places."""
    return F.transform(_upto(n), lambda k: pick(*[F.get(values, k - back + d) for d in range(width)]))


def kept_grams(ws: Column, span: int = SPAN, gram: int = GRAM) -> Column:
    """``array<struct<at, hash>>``: the grams that are a minimum of some window."""
    width = span - gram + 1

    def grams(hashes):
        n = F.size(hashes) - (gram - 1)
        return F.transform(_upto(n), lambda k: F.xxhash64(*[F.get(hashes, k + d) for d in range(gram)]))

    def minima(gs):
        least = _slide(gs, F.least, 0, width, F.size(gs) - (width - 1))
        # a gram is kept if the largest minimum of the windows that hold it is its own hash
        top = let(least, lambda m: _slide(m, F.greatest, width - 1, width, F.size(gs)))
        both = F.transform(F.arrays_zip(gs.alias("hash"), top.alias("top")), lambda x, k: F.struct(k.alias("at"), x["hash"].alias("hash"), x["top"].alias("top")))
        return F.filter(both, lambda x: x["hash"] == x["top"])

    out = let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: let(grams(h), minima))
    return F.when(F.size(ws) >= span, out)


def _runs_of(n: int, first: Column | int = 0):
    """From words to all their runs of ``n``: ``array<struct<at, n, window>>``, at counted from ``first``."""

    def runs(ws):
        return F.transform(_upto(F.size(ws) - (n - 1)), lambda k: F.struct((k + first).alias("at"), F.lit(n).alias("n"), _join(ws, k, n).alias("window")))

    return runs


def benchmark_windows(bench: DataFrame, span: int = SPAN) -> DataFrame:
    """``(n, window, items)``: the distinct windows of the items and who has them.

    An item of fewer than ``span`` words, but not none, is one window.
    """
    ws = bench.select("item_id", words(F.col("text")).alias("ws"))

    def windows(w):
        n = F.size(w)
        short = F.array(F.struct(n.alias("n"), F.array_join(w, " ").alias("window")))
        runs = F.transform(_runs_of(span)(w), lambda r: F.struct(r["n"].alias("n"), r["window"].alias("window")))
        return F.when(n >= span, runs).when(n > 0, short)

    each = ws.select("item_id", F.explode(let(F.col("ws"), windows)).alias("x"))
    return each.groupBy("x.n", "x.window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_words, n_hit, items)`` for every row of ``docs``.

    A word is hit if it is inside an occurrence of a benchmark window; ``items``
    are the items with occurring windows. Null and empty texts have no words.
    Rows that repeat a doc_id (a null one too) each come out with the hits of
    their own text. Null items and texts of ``bench`` add no window. Empty
    tables give no rows, or rows without hits; other columns are not read.
    """
    return _judged(docs, bench, id_col, text_col, span, gram).drop("content")


def _judged(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``contamination`` with the ``content`` of each row's text."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), content(F.col(text_col)).alias("content"))
    bench = cut(benchmark_windows(bench.where("item_id IS NOT NULL"), span))
    width = span - gram + 1
    long = bench.where(F.col("n") == span)
    grams = long.select(F.explode(let(kept_grams(F.split("window", " "), span, gram), lambda g: g["hash"])).alias("hash")).distinct()

    def around(w):
        # the words that a run through the gram can have, and the place of the first
        def context(g):
            first = F.greatest(g["at"] - (width - 1), F.lit(0))
            return F.struct(g["hash"].alias("hash"), first.alias("first"), F.slice(w, first + 1, g["at"] - first + span).alias("ws"))

        return F.transform(kept_grams(w, span, gram), context)

    kept = docs.select("doc_id", "content", F.explode(let(words(F.col("text")), around)).alias("g"))
    kept = kept.select("doc_id", "content", "g.*").join(small(cut(grams)), "hash", "left_semi")
    runs = _runs_of(span, F.col("first"))(F.col("ws"))
    found = kept.select("doc_id", "content", F.explode(runs).alias("x")).select("doc_id", "content", "x.*")
    for n in [r.n for r in bench.where(F.col("n") < span).select("n").distinct().collect()]:
        short = docs.select("doc_id", "content", F.explode(let(words(F.col("text")), _runs_of(n))).alias("x"))
        found = found.unionByName(short.select("doc_id", "content", "x.*"))
    hits = found.join(small(bench), ["n", "window"]).groupBy("doc_id", "content")
    hits = hits.agg(F.collect_set(F.struct("at", "n")).alias("runs"), F.collect_set("items").alias("sets"))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["n"] - 1))))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("content").alias("hit_content"), F.size(covered).cast("long").alias("n_hit"), F.array_distinct(F.flatten("sets")).alias("items"))
    counts = docs.select("doc_id", "content", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = counts.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("content") == F.col("hit_content")), "left")
    return out.select("doc_id", "content", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array()).alias("items"))


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a word that is hit; columns as they were."""
    hit = _judged(docs, bench).where("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("content").alias("hit_content")).distinct()
    return docs.join(small(cut(hit)), docs["doc_id"].eqNullSafe(F.col("hit_id")) & (content(docs["text"]) == F.col("hit_content")), "left_anti")
