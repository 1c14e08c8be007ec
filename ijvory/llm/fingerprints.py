"""Threshold-scaled fingerprints of documents, in DataFrame operations alone.

A text's shingles are hashed, and every hash in the lowest 1/SCALE of all values is
kept: long texts keep many, so that a short text inside a long one is found. Of a text
with fewer than LEAST such hashes the LEAST smallest are kept, all if it has fewer.
Either rule is a threshold that a fingerprint itself tells; two fingerprints are compared,
and merged, below the lower of theirs, where both are complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ijvory.llm.common import ascii_lower, cut, let
from ijvory.llm.decontam import NOT_WORD

SHINGLE = 5
SCALE, LEAST = 8, 16
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def _limit(scale: int) -> int:
    """The highest hash that is kept, as a signed number; hashes are ordered so."""
    return LOWEST + (1 << 64) // scale - 1


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE, least: int = LEAST) -> Column:
    """The fingerprint of a text as a sorted array of hashes, empty if it has no word.

    Words are those of ``decontam.words``; fewer than ``shingle`` are one shingle.
    """
    limit = F.lit(_limit(scale))
    distinct = lambda hs: F.sort_array(F.array_distinct(hs))
    # an element of the split that is empty is no word
    each = F.filter(F.transform(F.split(ascii_lower(text), NOT_WORD), lambda w: F.when(w != "", F.xxhash64(w))), lambda h: h.isNotNull())

    def shingles(h: Column) -> Column:
        last = F.size(h) - shingle
        at = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        runs = F.transform(at, lambda k: F.xxhash64(*[F.get(h, k + d) for d in range(shingle)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(runs)

    def kept(hs: Column) -> Column:
        return let(distinct(F.filter(hs, lambda h: h <= limit)), lambda low: F.when(F.size(low) >= least, low).otherwise(F.slice(distinct(hs), 1, least)))

    return let(let(each, shingles), kept)


def threshold(fp: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The highest value below which a fingerprint lacks no hash of its text."""
    limit = F.lit(_limit(scale))
    return F.when(F.size(fp) < least, F.lit(HIGHEST)).otherwise(F.greatest(F.element_at(fp, -1), limit))


def merged(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The fingerprint of two texts' shingles together."""
    limit = F.lit(_limit(scale))

    def kept(hs: Column) -> Column:
        return let(F.filter(hs, lambda h: h <= limit), lambda low: F.when(F.size(low) >= least, low).otherwise(F.slice(hs, 1, least)))

    return let(F.sort_array(F.array_union(a, b)), kept)


def _compared(a: Column, b: Column, of, scale: int, least: int) -> Column:
    """of(shared, in a, in b), numbers of hashes below the lower threshold; 1 if both texts have no word."""

    def measure(x: Column) -> Column:
        limit = F.least(threshold(x["a"], scale, least), threshold(x["b"], scale, least))
        both = let(limit, lambda t: F.struct(*[F.filter(x[c], lambda h: h <= t).alias(c) for c in "ab"]))
        return let(both, lambda y: of(F.size(F.array_intersect(y["a"], y["b"])), F.size(y["a"]), F.size(y["b"])))

    empty = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(empty == 2, 1.0).when(empty == 1, 0.0).otherwise(let(F.struct(a.alias("a"), b.alias("b")), measure))


def containment(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The share of the shingles of the text with fewer that the other one has, estimated; 1 for two texts without words."""
    return _compared(a, b, lambda shared, n, m: shared / F.greatest(F.least(n, m), F.lit(1)), scale, least)


def resemblance(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The share of the shingles of both texts that both have, estimated; 1 for two texts without words."""
    return _compared(a, b, lambda shared, n, m: shared / F.greatest(n + m - shared, F.lit(1)), scale, least)


def listed(fp: Column) -> Column:
    """A fingerprint as a string of 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(fp, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``at``, their place from 0 in the order of ``keys``; one number for each range of rows meets in a task."""
    ranges = cut(rows.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    own = Window.partitionBy("range").orderBy(*keys)
    totals = ranges.groupBy("range").agg(F.count("*").alias("n"))
    starts = totals.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return ranges.withColumn("own", F.row_number().over(own)).join(F.broadcast(starts), "range").withColumn("at", F.col("start") + F.col("own") - 1).drop("range", "own", "start")


def compared_to_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next, alike_edited, alike_next)`` for every row.

    The edited text has, for the last half of its code points, the first as many of the next
    document in the order of the ids (null first, rows of one id in the order of a hash of their text), the
    first after the last; all of a shorter one. ``near`` is the containment, ``alike`` the
    resemblance, of the fingerprints of the row's text and the edited or the next text. A null text
    is empty; of rows that repeat id and text each is followed by the next; a single row by
    itself; ids are cast to long; other columns are not read; an empty table gives an empty one.

    Whole texts are dealt once, by a hash of id and text; besides, only the half that goes to the row before moves.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(name, F.lit(":"), text), 256)).alias("key")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key, text.alias("text"))

    places = cut(rows.select("doc_id", "key", F.length("text").cast("long").alias("size")).groupBy("doc_id", "key", "size").count())
    n = places.count()
    places = cut(_in_order(places, ["doc_id", "key"]).select("at", "key", "size", "count"))
    # where a row is repeated, the row before it is one like it, for all but the first
    before = places.select(((F.col("at") + 1) % n if n else F.col("at")).alias("at"), F.col("key").alias("owner"), F.col("size").alias("owner_size"))
    links = cut(places.join(before, "at").select("key", "owner", "owner_size"))

    # id and text in one column, so that both sides of the join below need the same and share this exchange
    dealt = rows.select("key", F.struct("doc_id", "text").alias("row")).repartition("key").groupBy("key").agg(F.first("row").alias("row"), F.count("*").alias("copies"))
    own = dealt.select("key", "row.doc_id", "row.text", "copies", sketch(F.col("row.text"), shingle, scale, least).alias("fp"))
    given = own.join(links, "key").select(F.col("owner").alias("key"), F.substring("text", F.lit(1), F.floor(F.col("owner_size") / 2).cast("int")).alias("more"), F.col("fp").alias("next_fp"))
    both = own.join(given, "key")
    # copies but the last are followed by a copy
    half = F.floor(F.length("text") / 2).cast("int")
    kinds = F.array(
        F.struct(F.lit(1).cast("long").alias("times"), F.col("more"), F.col("next_fp")),
        F.struct((F.col("copies") - 1).alias("times"), F.substring("text", F.lit(1), half).alias("more"), F.col("fp").alias("next_fp")),
    )
    plain = F.array(F.struct(F.lit(1).cast("long").alias("times"), F.col("more"), F.col("next_fp")))
    both = both.select("doc_id", "text", "fp", F.explode(F.when(F.col("copies") > 1, kinds).otherwise(plain)).alias("x"))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.col("x.more"))
    both = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fp", "x.next_fp", "x.times", edited.alias("edited"))
    both = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", sketch(F.col("edited"), shingle, scale, least).alias("edited_fp"), "next_fp", "times")
    done = both.select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp",
        containment(F.col("fp"), F.col("edited_fp"), scale, least).alias("near_edited"), containment(F.col("fp"), F.col("next_fp"), scale, least).alias("near_next"),
        resemblance(F.col("fp"), F.col("edited_fp"), scale, least).alias("alike_edited"), resemblance(F.col("fp"), F.col("next_fp"), scale, least).alias("alike_next"), "times",
    )
    return done.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")
