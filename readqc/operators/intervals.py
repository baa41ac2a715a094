"""Operators on intervals (contig, start0, end0, name) and range joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BIN = 16_384


def merge(intervals: DataFrame) -> DataFrame:
    """Overlapping or touching intervals as one; names joined with | in order of (start0, end0)."""
    order = W.partitionBy("contig").orderBy("start0", "end0", "name")
    reach = F.max("end0").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start0") <= F.col("_reach"), 0).otherwise(1)).over(order)
    marked = intervals.withColumn("_reach", reach).withColumn("_island", island)
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start0", "end0", "name"))), lambda x: x["name"]), "|")
    return marked.groupBy("contig", "_island").agg(F.min("start0").alias("start0"), F.max("end0").alias("end0"), names.alias("name")).drop("_island")


def pad(intervals: DataFrame, contigs: DataFrame, by: int) -> DataFrame:
    """Grown on both sides, within the contig."""
    sized = intervals.join(contigs.select("contig", "length"), "contig")
    return sized.select("contig", F.greatest(F.col("start0") - by, F.lit(0)).alias("start0"), F.least(F.col("end0") + by, F.col("length")).alias("end0"), "name")


def territory(intervals: DataFrame) -> DataFrame:
    return intervals.agg(F.coalesce(F.sum(F.col("end0") - F.col("start0")), F.lit(0)).cast("long").alias("territory"))


MOST_SENT = 200_000


def sendable(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if it has at most MOST_SENT rows (of a few numbers each: some 40 MB), which is counted; a larger one is joined by a shuffle, whatever size Spark expects."""
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df.hint("merge")


LEAST_BIN = 32


def span_sizes(a: DataFrame, b: DataFrame) -> list[tuple[int, int]]:
    """(rows, positions) of a and of b, by one job; a span has one position at least."""
    size = lambda df, s, e, i: df.agg(F.lit(i).alias("i"), F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.col(e) - F.col(s), F.lit(1))), F.lit(0)).cast("long").alias("total"))
    return [(r.n, r.total) for r in sorted(size(a, "a_start", "a_end", 0).union(size(b, "b_start", "b_end", 1)).collect())]


def _bin_of(sizes: list[tuple[int, int]]) -> int:
    return max(LEAST_BIN, min(BIN, 1 << math.ceil(math.log2(max(total / max(n, 1) for n, total in [*sizes, (1, 1)])))))


def bin_for(a: DataFrame, b: DataFrame) -> int:
    """The power of two from LEAST_BIN to BIN that is no less than the mean span of a or b.

    So a row enters two bins or so on average, and what meets in a bin is mostly what overlaps, however dense the spans are.
    """
    return _bin_of(span_sizes(a, b))


def range_join(a: DataFrame, b: DataFrame, how: str = "inner", bin_size: int | None = None, send: bool = False) -> DataFrame:
    """Overlaps of a(contig, a_start, a_end) and b(contig, b_start, b_end), each pair once.

    Both sides enter every bin that they touch; a pair counts in the later of their first bins, so no distinct is needed.
    The size of the bins follows the spans (bin_for) where it isn't given, which is a job over both sides. It tells how many
    entries they make as well, which Spark, that sizes rows before they enter their bins, doesn't: b is broadcast only up to
    MOST_SENT of them, a never beyond that, and larger sides are shuffled and merged, so no side is held whole in memory.
    ``how``: inner, left_semi or left_anti (rows of a with, or without, a match; rows of a must be distinct). ``send``: b is
    broadcast if its entries are few (sendable), so a large a isn't shuffled.
    """
    sizes = span_sizes(a, b) if bin_size is None else []
    bin_size = bin_size or _bin_of(sizes)
    many = [n + total // bin_size > MOST_SENT for n, total in sizes] or [False, False]

    def bins(df, s, e, name):
        last = F.floor((F.greatest(F.col(e) - 1, F.col(s))) / bin_size)
        return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(s) / bin_size), last)))

    left, right = bins(a, "a_start", "a_end", "_bin"), bins(b.withColumnRenamed("contig", "_contig"), "b_start", "b_end", "_b_bin")
    if send:
        right = sendable(right)
    elif any(many):
        right = right.hint("merge") if many[1] else F.broadcast(right)
    hit = (F.col("contig") == F.col("_contig")) & (F.col("_bin") == F.col("_b_bin")) & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
    first = F.col("_bin") == F.greatest(F.floor(F.col("a_start") / bin_size), F.floor(F.col("b_start") / bin_size))
    if how == "inner":
        return left.join(right, hit & first).drop("_bin", "_b_bin", "_contig")
    found = left.join(right, hit & first, "left_semi").drop("_bin").distinct()
    return found if how == "left_semi" else a.exceptAll(found)


INDEX_BIN = 4096


def overlap_index(bin_size: int = INDEX_BIN, **spans: DataFrame) -> DataFrame:
    """(contig, bin, one array<struct<s, e>> for each name, sorted): the merged intervals that a row which starts in the bin, and spans at most bin_size, can overlap.

    A row joins its bin once, and folds over the arrays; intervals of one name don't overlap, so a bin holds at most bin_size of them.
    """
    parts = None
    for name, df in spans.items():
        bins = F.sequence(F.greatest(F.floor(F.col("start0") / bin_size) - 1, F.lit(0)), F.floor((F.col("end0") - 1) / bin_size))
        rows = merge(df).filter("end0 > start0").select("contig", F.explode(bins).alias("bin"), *[(F.struct(F.col("start0").alias("s"), F.col("end0").alias("e")) if n == name else F.lit(None).cast("struct<s:bigint,e:bigint>")).alias(n) for n in spans])
        parts = rows if parts is None else parts.union(rows)
    return parts.groupBy("contig", "bin").agg(*[F.sort_array(F.collect_list(n)).alias(n) for n in spans])


def overlaps(name: str, start: str, end: str) -> Column:
    """Whether [start, end) overlaps an interval of an index's array; false without one."""
    return F.expr(f"coalesce(exists({name}, x -> x.s < {end} and {start} < x.e), false)")


def shared_bases(name: str, blocks: str, at: str) -> Column:
    """Positions of a read's blocks (ref_off, len; from ``at`` on) within the intervals of an index's array."""
    fold = f"aggregate({name}, u, (v, x) -> v + greatest(0L, least({at} + b.ref_off + b.len, x.e) - greatest({at} + b.ref_off, x.s)))"
    return F.expr(f"if({name} is null, 0L, aggregate({blocks}, 0L, (u, b) -> {fold}))")


BUCKET = 65_536


def depth_runs(marks: DataFrame, by: str) -> DataFrame:
    """(by, start, end, depth) of marks(by, start, marks), a text of 1 and 0 a position: stretches of equal depth above 0.

    Only the borders (+1, -1) of runs of 1 are shuffled, by bucket of the positions; marks are cut at the buckets' borders.
    """
    size = F.length("marks")
    last = F.floor((F.col("start") + size - 1) / BUCKET)
    cut = marks.filter(size > 0).select(by, "start", "marks", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), last)).alias("bucket"))
    first = F.greatest(F.col("start"), F.col("bucket") * BUCKET)
    text = F.substr("marks", (first - F.col("start") + 1).cast("int"), (F.least(F.col("start") + size, (F.col("bucket") + 1) * BUCKET) - first).cast("int"))
    # Runs alternate: the text's pieces of equal marks, each with the length of those before it.
    runs = F.aggregate(F.regexp_extract_all("marks", F.lit("1+|0+"), F.lit(0)), F.expr("named_struct('n', 0, 'b', cast(array() as array<struct<at:int,step:int>>))"), lambda s, r: F.struct(
        (s["n"] + F.length(r)).alias("n"), F.when(r.startswith("1"), F.concat(s["b"], F.array(F.struct(s["n"].alias("at"), F.lit(1).alias("step")), F.struct((s["n"] + F.length(r)).alias("at"), F.lit(-1).alias("step"))))).otherwise(s["b"]).alias("b")), lambda s: s["b"])
    each = cut.select(by, "bucket", first.alias("first"), text.alias("marks")).select(by, "bucket", "first", F.explode(runs).alias("r"))
    steps = each.groupBy(by, "bucket", (F.col("first") + F.col("r.at")).alias("start")).agg(F.sum("r.step").alias("step"))
    order = W.partitionBy(by, "bucket").orderBy("start")
    out = steps.select(by, "start", F.lead("start").over(order).alias("end"), F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("depth"))
    return out.filter("depth > 0")
