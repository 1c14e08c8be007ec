"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

Sources have whole-number shares q out of H, their sum. Block k (from 0) of a
source is released at slot floor(k H / q) and due by slot ceil((k + 1) H / q);
earliest deadline first over released blocks meets all deadlines, so at any slot
a source is less than one block from its target. The schedule repeats after H
slots with exactly q blocks of each source, so H slots are scheduled and every
block finds its slot by arithmetic and an equality join.

Sources end at different times. When one ends, a new phase begins, in which the
others share the slots in the ratio of their shares; no row is dropped or
repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ijvory.llm.common import cut, let, small

#: Rows of a source are numbered bucket by bucket; the bucket is the head of the order key.
BUCKET_DIGITS = 3
LATE = 2**62


def shuffled(docs: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """``(doc_id, source, at)``: each row's place, from 0, in the pseudo-random order of its source.

    The order is that of the MD5 of the id. Its first digits cut a source into
    4,096 buckets, which are numbered on their own and put behind one another,
    so that no task needs a whole source.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), key.alias("key"))
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("source", "bucket", F.coalesce(first, F.lit(0)).cast("long").alias("first"))
    number = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id")) - 1
    return rows.withColumn("number", number).join(offsets, ["source", "bucket"]).select("doc_id", "source", (F.col("first") + F.col("number")).alias("at"))


def even_shares(docs: DataFrame, source_col: str = "source", scale: int = 100, power: float = 0.5) -> DataFrame:
    """``(source, n, q)``: shares in the ratio of the sources' sizes to a power, the usual flattening."""
    n = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("all"))
    share = F.pow(F.col("n") / F.col("all"), F.lit(power)) if power != 0.5 else F.sqrt(F.col("n") / F.col("all"))
    return n.join(F.broadcast(whole)).select("source", "n", F.greatest(F.lit(1), F.round(share * scale)).cast("long").alias("q"))


def phases(shares: DataFrame, block: int) -> DataFrame:
    """``(phase, source, rank, q, first, last, slots, base)`` for each source in each phase it is part of.

    ``first`` to ``last`` (exclusive) are its blocks of the phase, ``slots`` the
    length of a period and ``base`` the first slot. With s sources there are at
    most s (s + 1) / 2 rows, whatever their sizes.
    """
    blocks = shares.where("n > 0").select("source", "q", F.expr(f"(n + {block - 1}) div {block}").alias("n"))
    # sources end in the order of n / q; in whole numbers a source has done (q n_p) div q_p blocks when source p ends
    one = blocks.agg(F.collect_list(F.struct("source", "q", "n")).alias("xs"))
    # ties and rounding: compare n_a q_b with n_b q_a
    order = lambda a, b: F.when(a["n"] * b["q"] < b["n"] * a["q"], -1).when(a["n"] * b["q"] > b["n"] * a["q"], 1).when(a["source"] < b["source"], -1).when(a["source"] > b["source"], 1).otherwise(0)
    one = one.select(F.array_sort("xs", order).alias("xs"))
    end = one.select("xs", F.posexplode("xs").alias("phase", "end"))
    each = end.select("phase", "end", F.get("xs", F.col("phase") - 1).alias("prior"), F.posexplode("xs").alias("rank", "x")).where("rank >= phase")
    ranges = each.select(
        "phase", F.col("x.source").alias("source"), "rank", F.col("x.q").alias("q"),
        F.expr("coalesce((x.q * prior.n) div prior.q, 0)").alias("first"), F.expr("(x.q * end.n) div end.q").alias("last"),
    )
    size = ranges.groupBy("phase").agg(F.sum("q").alias("slots"), F.max(F.expr("(last - first + q - 1) div q")).alias("periods"))
    # one row for each source at most
    base = size.select("phase", "slots", F.coalesce(F.sum(F.col("slots") * F.col("periods")).over(Window.partitionBy().orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return ranges.join(base, "phase").where("last > first")


def _edf(xs: Column) -> Column:
    """Earliest deadline first over one period of ``array<struct<rank, q>>``: ``array<struct<rank, turn>>`` by slot."""
    slots = F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x["q"])

    def period(h):
        start = F.struct(F.transform(xs, lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<struct<rank:int,turn:bigint>>").alias("out"))

        def step(s, t):
            def due(x, k):
                done = F.get(s["done"], k)
                released = (done < x["q"]) & (F.floor(done * h / x["q"]) <= t)
                return F.struct(F.when(released, F.ceil((done + 1) * h / x["q"])).otherwise(F.lit(LATE)).alias("due"), k.alias("k"))

            def serve(best):
                k = best["k"]
                turn = F.struct(F.get(xs, k)["rank"].alias("rank"), F.get(s["done"], k).alias("turn"))
                done = F.transform(s["done"], lambda c, j: F.when(j == k, c + 1).otherwise(c))
                return F.struct(done.alias("done"), F.concat(s["out"], F.array(turn)).alias("out"))

            return let(F.array_min(F.transform(xs, due)), serve)

        return F.aggregate(F.sequence(F.lit(0).cast("long"), h - 1), start, step, lambda s: s["out"])

    return let(slots, period)


def schedule(plan: DataFrame) -> DataFrame:
    """``(phase, rank, turn, slot)``: the slot of each source's turns within a period of each phase."""
    xs = plan.groupBy("phase").agg(F.sort_array(F.collect_list(F.struct("rank", "q"))).alias("xs"))
    return xs.select("phase", F.posexplode(_edf(F.col("xs"))).alias("slot", "x")).select("phase", "x.rank", "x.turn", F.col("slot").cast("long").alias("slot"))


def mix(docs: DataFrame, shares: dict[str, int] | None = None, block: int = 4, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, block, place, phase, slot)`` for every row: read the rows by slot, then place.

    Blocks of ``block`` rows are scheduled; ``shares`` are whole-number target
    weights by source, 1 for a source not named; without them the square roots
    of the sources' sizes are used. Slots rise without repeats; a phase's last period can leave some unused.
    A null source counts as the empty name, a null id sorts as the empty text;
    repeated rows get places of their own; an empty table gives an empty one;
    other columns are not read.
    """
    if block < 1 or any(int(q) != q or q < 1 for q in (shares or {}).values()):
        raise ValueError("blocks and shares are whole numbers from 1")
    sized = even_shares(docs, source_col)
    if shares is not None:
        q = F.lit(1).cast("long")
        for name, x in shares.items():
            q = F.when(F.col("source") == name, F.lit(x).cast("long")).otherwise(q)
        sized = sized.withColumn("q", q)
    plan = cut(phases(sized, block))
    turns = cut(schedule(plan))
    rows = shuffled(docs, id_col, source_col).withColumn("block", F.expr(f"`at` div {block}"))
    own = (F.col("source") == F.col("of")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("last"))
    rows = rows.join(small(plan.withColumnRenamed("source", "of")), own)
    rows = rows.withColumn("turn", (F.col("block") - F.col("first")) % F.col("q"))
    rows = rows.join(small(turns), ["phase", "rank", "turn"])
    slot = F.col("base") + F.expr("(block - first) div q") * F.col("slots") + F.col("slot")
    return rows.select("doc_id", "source", "block", (F.col("at") % block).alias("place"), "phase", slot.alias("slot"))
