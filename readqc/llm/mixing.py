"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Every source asks for a share of the budget by its weight. A source may be repeated ``max_epochs`` times at most; targets
that exceed this are clamped, and what they leave goes to the others by weight, until none is above. A round is one
aggregate over a table of one row a source, of which only two exact sums reach the driver.

Sampling: a source with target / size = 1.3 gives each document once and a further 0.3 of its words, namely the
documents of the smallest seeded hash; the document at the cut gives only its leading words, so the sum of a source is
its target to the word. The cut is found by summing sizes in ``buckets`` slices of the hash; only the slice of the cut is
sorted, so no source, however large, meets in one task, and the decision on a document compares its hash with one row.
Rows equal in id and text have equal hashes; where such a group is at the cut, its rows are written with a number, and
the first of them are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stored, word_count

OUT = ["size", "source_size", "target", "repeats", "part", "taken"]
_ROW = 33  # bits of the row's number below the partition's in monotonically_increasing_id


def numbered(rows: DataFrame, name: str, n: str = "n") -> DataFrame:
    """rows, written as they are dealt, plus n: their number from 0, partition after partition. One count a partition reaches the driver."""
    kept = stored(rows.withColumn(n, F.monotonically_increasing_id()), name)
    at = F.shiftright(n, _ROW)
    before, offsets = 0, []
    for r in kept.groupBy(at.alias("p")).count().orderBy("p").collect():
        offsets.append((r.p, before))
        before += r["count"]
    table = rows.sparkSession.createDataFrame(offsets, "p long, before long")  # one row a partition
    kept = kept.select(*[F.col(c) for c in rows.columns], F.col(n).alias("_n")).join(F.broadcast(table.select(F.col("p").alias("_p"), F.col("before").alias("_before"))), F.shiftright("_n", _ROW) == F.col("_p"))
    return kept.select(*[F.col(c) for c in rows.columns], (F.col("_before") + F.col("_n") % (1 << _ROW)).alias(n))


def weighted(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sources(source, ...) plus weight: ``weights`` over the sources in code point order, null last, repeating."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("source").isNull(), F.col("source"))
    ranked = numbered(sources.repartitionByRange(n, *order).sortWithinPartitions(*order), "sources")
    return ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))).drop("n")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """sources(source, source_size, weight) plus target: weight shares of budget * all sizes, none above max_epochs * source_size."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    exact = lambda c: F.coalesce(F.sum(c.cast("decimal(30,6)")), F.lit(0).cast("decimal(38,6)"))
    total, level = float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * budget, 0.0
    while True:  # the level, words a unit of weight, rises until it clamps no further source
        open_ = cap > F.col("weight") * level
        clamped, weight = sources.agg(exact(F.when(~open_, cap)), exact(F.when(open_, F.col("weight")))).first()
        if not weight:
            target = cap
            break
        target, above = F.least(cap, F.col("weight") * level), (total - float(clamped)) / float(weight)
        if above <= level:
            break
        level = above
    return sources.withColumn("target", target.cast("double"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 17, buckets: int = 4096) -> DataFrame:
    """docs plus size, source_size, target, repeats (whole copies), part (words of a further partial copy) and taken.

    Sources in code point order, null last, weigh ``weights``, repeating. Null, empty and wordless texts have size 0 and
    taken 0. Rows with equal ids and texts are interchangeable; among equal hashes the smaller id, then text hash, goes
    first. Columns of docs named like an added one are replaced; others may have any name. An empty table gives an empty
    table.
    """
    docs = docs.drop(*OUT)
    a = F.xxhash64(F.lit(seed), F.col("doc_id"))
    h = F.struct(F.pmod(F.shiftright(a, 32), F.lit(buckets)).alias("s"), a.alias("a"), F.col("doc_id").alias("b"), F.xxhash64("text").alias("c"))
    keyed = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"), h.alias("h"))
    sizes = stored(keyed.select("source", "size", "h"), "sizes")
    slices = stored(sizes.groupBy("source", F.col("h.s").alias("s")).agg(F.sum("size").alias("words")), "slices")

    sources = stored(water_fill(weighted(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights), budget, max_epochs), "targets")
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("repeats", whole).withColumn("rest", words - F.col("repeats") * F.col("source_size"))

    # The slice in which the running sum passes the rest, and what is left of the rest there.
    running = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = slices.withColumn("before", running).join(sources.select(F.col("source").alias("src"), "rest"), F.col("source").eqNullSafe(F.col("src")))
    at = at.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select("src", F.col("s").alias("at_s"), (F.col("rest") - F.col("before")).alias("left"))
    # Rows of equal hash are one row of the slice.
    inside = sizes.join(at, F.col("source").eqNullSafe(F.col("src")) & (F.col("h.s") == F.col("at_s"))).groupBy("src", "h", "size", "left").agg(F.count(F.lit(1)).alias("copies"))
    all_words = F.col("size") * F.col("copies")
    before = F.coalesce(F.sum(all_words).over(W.partitionBy("src").orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = inside.withColumn("before", before).filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + all_words))
    cut = cut.select("src", F.struct(F.col("h"), (F.col("left") - F.col("before")).alias("words"), "copies").alias("cut"))
    plan = sources.join(cut, F.col("source").eqNullSafe(F.col("src")), "left").select(F.col("source").alias("src"), "source_size", "target", "repeats", "cut")
    plan = stored(plan, "plan")

    met = keyed.join(plan, F.col("source").eqNullSafe(F.col("src")), "left")
    same = F.coalesce(F.col("h") == F.col("cut.h"), F.lit(False))
    first = F.when(F.col("h") < F.col("cut.h"), F.col("size")).when(same, F.least(F.col("cut.words"), F.col("size"))).otherwise(0)
    shared = plan.filter("cut.copies > 1").select(F.col("src").alias("shared_src"), F.col("cut.h").alias("shared_h"))
    if shared.isEmpty():
        return _mixed(met, first)
    # Rows of a group at the cut: numbered by their source, those before the words of the cut are taken.
    mark = same & (F.col("cut.copies") > 1)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = met.filter(mark).withColumn("deal", F.xxhash64(F.monotonically_increasing_id()))
    group = numbered(group.repartitionByRange(n, "source", "deal").sortWithinPartitions("source"), "copies")
    group = group.join(group.groupBy(F.col("source").alias("of")).agg(F.min("n").alias("least")), F.col("source").eqNullSafe(F.col("of")))
    left = F.col("cut.words") - (F.col("n") - F.col("least")) * F.col("size")
    return _mixed(met.filter(~mark), first).union(_mixed(group, F.greatest(F.least(left, F.col("size")), F.lit(0))))


def _mixed(met: DataFrame, part) -> DataFrame:
    part = F.coalesce(part, F.lit(0)).cast("long")
    new = F.struct("size", "source_size", "target", "repeats", part.alias("part"), (F.col("repeats") * F.col("size") + part).alias("taken"))
    return met.select("row", new.alias("new")).select("row.*", "new.*")
