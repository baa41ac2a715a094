"""Alignment summary, base and quality profiles, insert sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import expressions as X
from ..operators import histogram as H

R = X.ratio


def _primary(reads: DataFrame) -> DataFrame:
    return reads.filter(~X.flag(X.SECONDARY) & ~X.flag(X.SUPPLEMENTARY))


def bad_cycles(reads: DataFrame) -> DataFrame:
    """(category, bad_cycles): cycles at which N makes up at least 80% of the category's reads, QC failures counted below the line only."""
    cat = F.when(X.flag(X.PAIRED) & ~X.flag(X.FIRST), "read2").otherwise("read1")
    primary = _primary(reads).withColumn("category", cat)
    totals = primary.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    hit = primary.filter(~X.flag(X.QC_FAIL) & F.col("seq").contains("N")).select("category", "flags", "seq", F.posexplode(F.split("seq", "")).alias("i", "b")).filter("b = 'N'")
    cycle = F.when(X.flag(X.REVERSE), F.length("seq") - F.col("i")).otherwise(F.col("i") + 1)
    counts = hit.select("category", cycle.alias("cycle")).groupBy("category", "cycle").agg(F.count(F.lit(1)).alias("n"))
    bad = counts.join(totals, "category").filter("n >= total * 0.8").groupBy("category").agg(F.count(F.lit(1)).alias("bad_cycles"))
    return totals.select("category").join(bad, "category", "left").fillna(0, ["bad_cycles"])


def high_quality(min_mapq: int) -> Column:
    return ~X.flag(X.QC_FAIL) & ~X.flag(X.UNMAPPED) & (F.coalesce("mapq", F.lit(255)) >= min_mapq)


def folds() -> dict[str, Column]:
    """What alignment_measures uses more than once of a CIGAR, by the names it uses."""
    return {"_m": X.aligned_bases(), "_mis": X.adjusted_mismatches(), "_clip": X.three_prime_clip()}


def alignment_measures(max_insert_size: int = 100_000, min_mapq: int = 20) -> dict[str, tuple[Column, Column]]:
    """name: (which reads, what of each is added up), of reads with folds()."""
    pf, al, hq, one = ~X.flag(X.QC_FAIL), ~X.flag(X.QC_FAIL) & ~X.flag(X.UNMAPPED), high_quality(min_mapq), F.lit(1)
    in_pair = al & X.flag(X.PAIRED) & ~X.flag(X.MATE_UNMAPPED)
    mate_ok = F.col("mq").isNull() | ((F.col("mq") >= min_mapq) & (F.coalesce("mapq", F.lit(255)) >= min_mapq))
    mis, clip = F.col("_mis"), F.col("_clip")
    return {
        "total_reads": (F.lit(True), one), "aligned_reads": (al, one), "hq_aligned_bases": (hq, F.col("_m")), "hq_aligned_q20_bases": (hq, X.q20_bases(of=X.AS_BLOCKS)), "mis": (al, mis), "m": (al, F.col("_m")), "events": (al, X.op_count("ID")), "ins": (al, X.op_sum("I")),
        "aligned_reads_in_pairs": (in_pair, one), "reads_improperly_paired": (in_pair & ~X.flag(X.PROPER), one), "forward": (al & ~X.flag(X.REVERSE), one), "pair_den": (in_pair & mate_ok, one), "pair_chim": (in_pair & mate_ok & X.chimeric(max_insert_size), one),
        "single_den": (~in_pair & hq, one), "single_chim": (~in_pair & hq & F.col("has_sa"), one), "soft": (al, X.op_sum("S")), "hard": (pf, X.op_sum("H")), "clip3": (al, clip), "clip3_reads": (al & (clip > 0), one),
    }


def alignment_summary(reads: DataFrame, sample: str = "sample", max_insert_size: int = 100_000, min_mapq: int = 20) -> DataFrame:
    """One row for read1, read2 and, if there are second reads, pair; a row of zeros for read1 without any."""
    return alignment_from(facts.facts(reads, ["alignment"], {"alignment": {"max_insert_size": max_insert_size, "min_mapq": min_mapq}}), sample)


def alignment_from(f: DataFrame, sample: str = "sample") -> DataFrame:
    """alignment_summary from facts: pair is the sum of both categories, and has the median of their common histogram."""
    c, t = F.col, F.col("t")
    measures = list(alignment_measures())
    zero = f.sparkSession.range(1).select(F.lit(facts.SUMS).alias("t"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), *[F.lit(0).cast("long").alias(m) for m in facts.MEASURES])
    rows = f.filter(t.isin(facts.SUMS, facts.MISMATCHES, facts.LENGTHS, facts.NO_CALLS)).union(zero)
    of = W.partitionBy("a")  # a row a histogram key: as many as a read is long
    rows = rows.withColumn("total", F.sum(F.when((t == facts.SUMS) & (c("b") == 0), c("m0"))).over(of)).withColumn("bad", (t == facts.NO_CALLS) & (c("m0") >= c("total") * 0.8))
    rows = rows.withColumn("a", F.explode(F.array("a", F.lit(2).cast("long"))))
    length, n, by = F.when(t == facts.LENGTHS, c("b")), c("m0"), W.partitionBy("a")
    rows = rows.withColumn("middle", F.percentile(length, 0.5, n).over(by))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    sums = [total(F.when((t == facts.SUMS) & (c("b") == i // 5), c(facts.MEASURES[i % 5]))).alias(name) for i, name in enumerate(measures)]
    half = lambda x: F.coalesce(F.percentile(x, 0.5, n), F.lit(0.0))
    mismatches, double = F.when(t == facts.MISMATCHES, c("b")), length.cast("double")
    agg = rows.groupBy("a").agg(
        *sums, total(F.when(t == facts.MISMATCHES, n)).alias("hq_aligned_reads"), total(mismatches * n).alias("hq_mis"), half(mismatches).alias("hq_median_mismatches"), total(F.when(t == facts.LENGTHS, n)).alias("pf_reads"), total(length * n).alias("bases"), F.coalesce(F.sum(double * double * n), F.lit(0.0)).alias("squares"),
        half(length).alias("median_read_length"), half(F.abs(length - c("middle"))).alias("mad_read_length"), F.coalesce(F.min(length), F.lit(0)).cast("int").alias("min_read_length"), F.coalesce(F.max(length), F.lit(0)).cast("int").alias("max_read_length"), F.count(F.when(c("bad"), 1)).alias("bad_cycles"),
    )
    out = agg.withColumn("second", F.max(c("a") == 1).over(W.partitionBy())).filter((c("a") < 2) | c("second"))  # three rows
    sd = F.sqrt(F.greatest(R(c("squares"), c("pf_reads")) - R(c("bases"), c("pf_reads")) * R(c("bases"), c("pf_reads")), F.lit(0.0)))
    category = F.element_at(F.array(F.lit("read1"), F.lit("read2"), F.lit("pair")), (c("a") + 1).cast("int"))
    return out.select(
        F.lit(sample).alias("sample"), category.alias("category"), "total_reads", "aligned_reads", R(c("aligned_reads"), c("pf_reads")).alias("frac_aligned"), "hq_aligned_reads", "hq_aligned_bases", "hq_aligned_q20_bases", "hq_median_mismatches",
        R(c("mis"), c("m")).alias("mismatch_rate"), R(c("hq_mis"), c("hq_aligned_bases")).alias("hq_mismatch_rate"), R(c("events"), c("m")).alias("indel_rate"), R(c("bases"), c("pf_reads")).alias("mean_read_length"), sd.alias("sd_read_length"),
        "median_read_length", "mad_read_length", "min_read_length", "max_read_length", R(c("m") + c("ins"), c("aligned_reads")).alias("mean_aligned_read_length"), "aligned_reads_in_pairs", R(c("aligned_reads_in_pairs"), c("aligned_reads")).alias("frac_aligned_in_pairs"),
        "reads_improperly_paired", R(c("reads_improperly_paired"), c("aligned_reads")).alias("frac_reads_improperly_paired"), "bad_cycles", R(c("forward"), c("aligned_reads")).alias("strand_balance"),
        R(c("pair_chim") + c("single_chim"), c("pair_den") + c("single_den")).alias("frac_chimeras"), R(c("soft"), c("bases")).alias("frac_softclipped_reads"), R(c("hard"), c("bases")).alias("frac_hardclipped_reads"), R(c("clip3"), c("clip3_reads")).alias("mean_3prime_softclipped_bases"),
    )


def _basic(reads: DataFrame) -> DataFrame:
    return facts.base_counts(facts.facts(reads, ["basic"]))


def base_distribution_by_cycle(reads: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """counts: base_counts() of facts, in place of a scan of the reads."""
    n, b = F.col("n"), F.col("base")
    of = lambda x: F.coalesce(F.sum(F.when(b == x, n)), F.lit(0))
    rows = (_basic(reads) if counts is None else counts).groupBy("read_end", "cycle").agg(F.sum(n).alias("total"), *[of(x).alias(x) for x in "ACGT"])
    t = F.col("total")
    rest = t - F.col("A") - F.col("C") - F.col("G") - F.col("T")
    return rows.select("read_end", "cycle", *[R(F.col(x), t).alias(f"frac_{x.lower()}") for x in "ACGT"], R(rest, t).alias("frac_n")).orderBy("read_end", "cycle")


def mean_quality_by_cycle(reads: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Cycles of second reads follow the last cycle of the first reads."""
    rows = (_basic(reads) if counts is None else counts).groupBy("read_end", "cycle").agg(F.sum("n").alias("total"), F.sum(F.col("bq") * F.col("n")).alias("q"))
    shift = F.coalesce(F.max(F.when(F.col("read_end") == 1, F.col("cycle"))).over(W.partitionBy()), F.lit(0))  # a row a cycle
    at = F.col("cycle") + F.when(F.col("read_end") == 2, F.col("shift")).otherwise(0)
    return rows.withColumn("shift", shift).select(at.alias("cycle"), R(F.col("q"), F.col("total")).alias("mean_quality")).orderBy("cycle")


def quality_score_distribution(reads: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    q = F.col("bq").bitwiseAND(0x7F).cast("long")
    rows = (_basic(reads) if counts is None else counts).filter(F.col("base").isin("A", "C", "G", "T")).groupBy(q.alias("quality")).agg(F.sum("n").alias("count"))
    total = F.sum("count").over(W.partitionBy())  # a row a quality
    return rows.select("quality", "count", R(F.col("count"), total).alias("frac_bases")).orderBy("quality")


def quality_bins(reads: DataFrame) -> DataFrame:
    """Chart data: every quality up to 45 or the largest, and one edge beyond."""
    dist = quality_score_distribution(reads)
    top = dist.agg(F.greatest(F.coalesce(F.max("quality"), F.lit(0)), F.lit(45)).alias("top"))
    return top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top") + 1)).alias("quality")).join(dist, "quality", "left").select("quality", F.coalesce("frac_bases", F.lit(0.0)).alias("frac_bases"))


def counts_for_size(include_duplicates: bool = False) -> Column:
    """Whether a pair counts, which its second read tells."""
    keep = X.flag(X.PAIRED) & ~X.flag(X.UNMAPPED) & ~X.flag(X.MATE_UNMAPPED) & ~X.flag(X.FIRST) & ~X.flag(X.SECONDARY | X.SUPPLEMENTARY) & ~X.flag(X.QC_FAIL) & (F.col("tlen") != 0)
    return keep if include_duplicates else keep & ~X.flag(X.DUPLICATE)


def insert_sizes(reads: DataFrame, include_duplicates: bool = False) -> DataFrame:
    """(pair_orientation, insert_size, n): the histogram of kept pairs, one row a pair from its second read."""
    rows = reads.filter(counts_for_size(include_duplicates)).select(X.pair_orientation().alias("pair_orientation"), F.abs(F.col("tlen").cast("long")).alias("insert_size"))
    return rows.filter("pair_orientation IS NOT NULL").groupBy("pair_orientation", "insert_size").agg(F.count(F.lit(1)).alias("n"))


def insert_size_metrics(reads: DataFrame, include_duplicates: bool = False, min_frac: float = 0.05, deviations: float = 10.0, hist: DataFrame | None = None) -> DataFrame:
    """hist: size_counts() of facts, in place of a scan of the reads."""
    hist = insert_sizes(reads, include_duplicates) if hist is None else hist
    by = ["pair_orientation"]
    stats = H.median_mad(hist, by, "insert_size", "n")
    base = hist.groupBy(*by).agg(F.sum("n").alias("read_pairs"), H.mode("insert_size", "n").alias("mode_insert_size"), F.min("insert_size").alias("min_insert_size"), F.max("insert_size").alias("max_insert_size"))
    trimmed = hist.join(F.broadcast(stats), by).filter(F.col("insert_size") <= F.col("median") + F.col("mad") * float(deviations))  # three rows
    mean, sd = H.mean_sd("insert_size", "n")
    moments = trimmed.groupBy(*by).agg(mean.alias("mean_insert_size"), sd.alias("standard_deviation"))
    total = base.agg(F.sum("read_pairs").alias("total"))
    out = base.join(stats, by).join(moments, by).crossJoin(F.broadcast(total)).filter(F.col("read_pairs") >= F.col("total") * float(min_frac))
    return out.select("pair_orientation", "read_pairs", "mean_insert_size", "standard_deviation", F.col("median").alias("median_insert_size"), F.col("mad").alias("median_absolute_deviation"), "mode_insert_size", "min_insert_size", "max_insert_size").orderBy(F.array_position(F.array(F.lit("FR"), F.lit("RF"), F.lit("TANDEM")), F.col("pair_orientation")))


def insert_size_histogram(reads: DataFrame, include_duplicates: bool = False, hist: DataFrame | None = None) -> DataFrame:
    hist = insert_sizes(reads, include_duplicates) if hist is None else hist
    of = lambda o: F.coalesce(F.sum(F.when(F.col("pair_orientation") == o, F.col("n"))), F.lit(0)).cast("long")
    return hist.groupBy("insert_size").agg(of("FR").alias("fr_count"), of("RF").alias("rf_count"), of("TANDEM").alias("tandem_count")).orderBy("insert_size")


from . import facts  # noqa: E402 - facts are made of this module's expressions
