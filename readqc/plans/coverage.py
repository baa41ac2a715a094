"""Whole-genome coverage and GC bias.

ref: reference pieces (contig, start0, seq) of one size; contigs: (ref_id, contig, length); intervals: (contig, start0, end0, name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import expressions as X
from ..operators import bases, histogram as H, intervals as I
from ..store import stored

R = X.ratio
MOST_DEPTH = 65_535  # fixed value: the largest cap on depth
BUCKET = 8192


def fragment_key():
    """The name for reads that can meet their mate on this contig, else the read's own number."""
    pairable = X.flag(X.PAIRED) & ~X.flag(X.UNMAPPED) & ~X.flag(X.MATE_UNMAPPED) & (F.col("ref_id") == F.col("mate_ref_id")) & F.col("qname").isNotNull()
    return F.when(pairable, F.concat(F.lit("n"), "qname")).otherwise(F.concat(F.lit("#"), F.col("read_id").cast("string")))


def classified(reads: DataFrame, include_duplicates: bool = False, exclude_unpaired: bool = True, min_mapq: int = 20) -> DataFrame:
    """Reads that count, with excl: the first rule that excludes them (mapq, dupe, unpaired) or null."""
    excl = F.when(F.coalesce("mapq", F.lit(0)) < min_mapq, "mapq")
    if not include_duplicates:
        excl = excl.when(X.flag(X.DUPLICATE), "dupe")
    if exclude_unpaired:
        excl = excl.when(~X.flag(X.PAIRED) | X.flag(X.MATE_UNMAPPED), "unpaired")
    return reads.filter(~X.flag(X.UNMAPPED) & ~X.flag(X.SECONDARY | X.SUPPLEMENTARY) & ~X.flag(X.QC_FAIL)).withColumn("excl", excl)


def _marked(kept: DataFrame, min_bq: int) -> DataFrame:
    """kept plus blocks and marks (1 for each base of the read whose quality passes, else 0)."""
    return kept.withColumns({"blocks": X.aligned_blocks(), "marks": X.passing(F.col("quals"), X.op_sum("MIS=X").cast("int"), min_bq)})


def depth_runs(reads: DataFrame, min_bq: int = 20, **rules) -> DataFrame:
    """(contig, start, end, depth): stretches of equal depth above 0, the distinct fragments with a passing base.

    A read's positions that pass in the fragment's earlier read as well are blanked, read by read. What remains are runs,
    of which only the borders (+1, -1) are shuffled, by bucket of the reference; blocks are cut at the buckets' borders.
    """
    kept = _marked(classified(reads, **rules).filter("excl IS NULL").withColumn("frag", fragment_key()), min_bq)
    earlier = F.lag(F.struct("pos0", "blocks", "marks")).over(W.partitionBy("frag", "contig").orderBy("read_id"))
    flat = kept.select("frag", "contig", "read_id", "pos0", "blocks", "marks").withColumn("mate", earlier)
    flat = flat.select("contig", "pos0", "marks", "mate", F.explode("blocks").alias("b"))
    flat = flat.select("contig", (F.col("pos0") + F.col("b.ref_off")).alias("at"), F.col("b.len").alias("len"), F.expr("substr(marks, b.read_off + 1, b.len)").alias("own"), "mate")
    flat = flat.select("contig", "at", "len", "own", X.aligned_to("mate.marks", "0").alias("other"))
    last = F.floor((F.col("at") + F.col("len") - 1) / BUCKET)
    flat = flat.filter("len > 0").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("at") / BUCKET), last)))
    start, end = F.greatest(F.col("at"), F.col("bucket") * BUCKET), F.least(F.col("at") + F.col("len"), (F.col("bucket") + 1) * BUCKET)
    part = lambda c: F.substr(c, (start - F.col("at") + 1).cast("int"), (end - start).cast("int"))
    flat = flat.select("contig", "bucket", start.alias("at"), (end - start).cast("int").alias("len"), part("own").alias("own"), part("other").alias("other"))
    whole = (F.instr("own", "0") == 0) & (F.instr("other", "1") == 0)
    borders = F.when(whole, F.array(F.lit(0), F.col("len"))).otherwise(F.sequence(F.lit(0), F.col("len")))
    on = lambda i: (F.substr("own", i + 1, F.lit(1)) == "1") & (F.substr("other", i + 1, F.lit(1)) != "1")
    i = F.col("i")
    now, before = F.when(on(i), 1).otherwise(0), F.when((i > 0) & on(F.greatest(i - 1, F.lit(0))), 1).otherwise(0)
    each = flat.select("*", F.explode(borders).alias("i"), whole.alias("whole"))
    step = F.when(F.col("whole"), F.when(i == 0, 1).otherwise(-1)).otherwise(now - before)
    steps = each.select("contig", "bucket", (F.col("at") + i).alias("start"), step.alias("step")).filter("step <> 0")
    steps = steps.repartition("contig", "bucket").groupBy("contig", "bucket", "start").agg(F.sum("step").alias("step"))
    by = W.partitionBy("contig", "bucket").orderBy("start")
    runs = steps.select("contig", "start", F.lead("start").over(by).alias("end"), F.sum("step").over(by.rowsBetween(W.unboundedPreceding, 0)).alias("depth"))
    return runs.filter("depth > 0")


def position_depth(reads: DataFrame, min_bq: int = 20, **rules) -> DataFrame:
    """(contig, ref_pos, depth) of covered positions."""
    return depth_runs(reads, min_bq, **rules).select("contig", F.explode(F.expr("sequence(start, end - 1)")).alias("ref_pos"), "depth")


def _known(ref: DataFrame) -> DataFrame:
    """ref with the pieces' N dropped from counting: n_known."""
    return ref.withColumn("n_known", F.length(F.translate("seq", "Nn", "")))


def eligible_territory(ref: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """One row: territory, the positions that are not N and, if intervals are given, inside them."""
    if intervals is None:
        return _known(ref).agg(F.coalesce(F.sum("n_known"), F.lit(0)).cast("long").alias("territory"))
    a = ref.select("contig", F.col("start0").alias("a_start"), (F.col("start0") + F.length("seq")).alias("a_end"), "seq")
    b = I.merge(intervals).select("contig", F.col("start0").alias("b_start"), F.col("end0").alias("b_end"))
    cut = F.expr("substr(seq, cast(greatest(a_start, b_start) - a_start + 1 as int), cast(least(a_end, b_end) - greatest(a_start, b_start) as int))")
    return I.range_join(a, b).agg(F.coalesce(F.sum(F.length(F.translate(cut, "Nn", ""))), F.lit(0)).cast("long").alias("territory"))


def eligible_depth(runs: DataFrame, ref: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """(depth, n): how many positions, not N and inside the intervals, have each depth above 0."""
    if intervals is not None:
        b = I.merge(intervals).select("contig", F.col("start0").alias("b_start"), F.col("end0").alias("b_end"))
        met = I.range_join(runs.withColumnsRenamed({"start": "a_start", "end": "a_end"}), b)
        runs = met.select("contig", F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"), "depth")
    met = bases.with_pieces(runs, ref)
    seen = F.substr("piece", (F.col("start") - F.col("piece_start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return met.groupBy("depth").agg(F.sum(F.length(F.translate(seen, "N", ""))).alias("n")).filter("n > 0")


def depth_histogram(reads: DataFrame, ref: DataFrame, intervals: DataFrame | None = None, coverage_cap: int | None = 250, runs: DataFrame | None = None, **options) -> DataFrame:
    """(depth 0..cap, bases, frac_bases, bases_at_or_above, frac_bases_at_or_above); empty without territory. coverage_cap None: the depths that occur, and 0. runs: depth_runs of the reads, if at hand."""
    if coverage_cap is not None and not 0 <= coverage_cap <= MOST_DEPTH:
        raise ValueError(f"coverage_cap must be from 0 to {MOST_DEPTH}")
    depth = eligible_depth(depth_runs(reads, **options) if runs is None else runs, ref, intervals)
    seen = depth if coverage_cap is None else depth.groupBy(F.least(F.col("depth"), F.lit(coverage_cap)).alias("depth")).agg(F.sum("n").alias("n"))
    total = eligible_territory(ref, intervals).filter("territory > 0")
    each = reads.sparkSession.range(1 if coverage_cap is None else coverage_cap + 1).select(F.col("id").alias("depth"))
    each = each.union(seen.select("depth")) if coverage_cap is None else each
    every = each.crossJoin(F.broadcast(total)).join(seen, "depth", "left")  # a row a depth
    covered = F.sum(F.when(F.col("depth") > 0, F.coalesce("n", F.lit(0))).otherwise(0)).over(W.partitionBy())
    hist = every.withColumn("bases", F.when(F.col("depth") == 0, F.col("territory") - covered).otherwise(F.coalesce("n", F.lit(0))).cast("long")).select("depth", "bases")
    hist = H.cumulative(hist, "depth", "bases")
    return hist.select("depth", "bases", R(F.col("bases"), F.col("total")).alias("frac_bases"), F.col("at_or_above").cast("long").alias("bases_at_or_above"), R(F.col("at_or_above"), F.col("total")).alias("frac_bases_at_or_above")).orderBy("depth")


def exclusions(reads: DataFrame, min_bq: int = 20, coverage_cap: int | None = 250, runs: DataFrame | None = None, **rules) -> DataFrame:
    """One row of excluded bases by rule, over whole contigs: mapq, dupe, unpaired, baseq, overlap, capped. Overlap is what passes in the reads beyond the sum of depths."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    of = lambda k: total(F.when(F.col("excl") == k, F.col("m"))).alias(k)
    passed = F.expr("aggregate(blocks, 0L, (s, b) -> s + length(translate(substr(marks, b.read_off + 1, b.len), '0', '')))")
    rows = _marked(classified(reads, **rules), min_bq).select("excl", X.aligned_bases().alias("m"), F.when(F.col("excl").isNull(), passed).alias("passed"))
    by_read = rows.agg(of("mapq"), of("dupe"), of("unpaired"), total(F.col("m") * F.col("excl").isNull().cast("int") - F.col("passed")).alias("baseq"), total("passed").alias("_passed"))
    n, depth = F.col("end") - F.col("start"), F.col("depth")
    by_run = (depth_runs(reads, min_bq, **rules) if runs is None else runs).agg(total(n * depth).alias("_depth"), total(n * (F.lit(0) if coverage_cap is None else F.greatest(depth - coverage_cap, F.lit(0)))).alias("capped"))
    return by_read.crossJoin(by_run).select("mapq", "dupe", "unpaired", "baseq", (F.col("_passed") - F.col("_depth")).alias("overlap"), "capped")  # one row each


def wgs_metrics(reads: DataFrame, ref: DataFrame, sample: str = "sample", intervals: DataFrame | None = None, min_bq: int = 20, coverage_cap: int | None = 250, runs: DataFrame | None = None, **rules) -> DataFrame:
    """One row. coverage_cap None: depths count in full."""
    runs = stored(depth_runs(reads, min_bq, **rules), "depth") if runs is None else runs
    hist = depth_histogram(reads, ref, intervals, coverage_cap, runs).select(F.col("depth"), F.col("bases").alias("n"), F.col("bases_at_or_above").alias("above"))
    cum = H.cumulative(hist, "depth", "n")
    mean, sd = H.mean_sd("depth", "n", sample=True)
    at = lambda x: F.coalesce(F.max(F.when(F.col("depth") == x, F.col("above"))), F.lit(0))
    levels = (1, 5, 10, 15, 20, 25, 30, 40, 50, 60, 100)
    base = cum.groupBy().agg(F.sum("n").alias("territory"), mean.alias("mean"), sd.alias("sd"), *[at(x).alias(f"a{x}") for x in levels], *[H.percentile_up(p).alias(f"p{f}") for p, f in ((0.2, 80), (0.1, 90), (0.05, 95))], F.sum(F.col("depth") * F.col("n")).alias("total_depth"))
    mm = H.median_mad(hist.filter("n > 0"), [], "depth", "n")
    row = base.filter("territory > 0").crossJoin(mm).crossJoin(exclusions(reads, min_bq, coverage_cap, runs, **rules))  # one row each
    kinds = ("mapq", "dupe", "unpaired", "baseq", "overlap", "capped")
    c = F.col
    excluded = sum((c(k) for k in kinds[1:]), c(kinds[0]))
    raw = excluded + c("total_depth")
    return row.select(
        F.lit(sample).alias("sample"), c("territory").cast("long").alias("genome_territory"), c("mean").alias("mean_coverage"), c("sd").alias("sd_coverage"), c("median").alias("median_coverage"), c("mad").alias("mad_coverage"),
        *[R(c(k), raw).alias(f"frac_excluded_{k}") for k in kinds], R(excluded, raw).alias("frac_excluded_total"),
        *[R(c(f"a{x}"), c("territory")).alias(f"frac_bases_at_{x}x") for x in levels], *[R(c("mean"), c(f"p{f}")).alias(f"fold_{f}_base_penalty") for f in (80, 90, 95)],
    )


def coverage_chart(hist: DataFrame, metrics: DataFrame) -> DataFrame:
    """Chart data: depth up to the 99.9th percentile, share of bases, and a Poisson curve of the mean over the covered share."""
    cum = H.cumulative(hist.select("depth", F.col("bases").alias("n")), "depth", "n")
    limit = cum.groupBy().agg(H.percentile_up(0.999).alias("limit"), R(F.sum(F.when(F.col("depth") > 0, F.col("n"))), F.sum("n")).alias("covered"))
    w = W.orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    row = hist.crossJoin(limit).crossJoin(metrics.select("mean_coverage"))  # one row each
    log_fact = F.sum(F.when(F.col("depth") > 0, F.log(F.col("depth").cast("double"))).otherwise(0.0)).over(w)
    pmf = F.when(F.col("mean_coverage") > 0, F.exp(F.col("depth") * F.log("mean_coverage") - F.col("mean_coverage") - F.col("lf"))).otherwise(F.when(F.col("depth") == 0, 1.0).otherwise(0.0))
    return row.withColumn("lf", log_fact).filter(F.col("depth") <= F.col("limit")).select("depth", "frac_bases", (pmf * F.col("covered")).alias("poisson"))


def gc_measures(window: int = 100, min_mapq: int = 0, exclude_duplicates: bool = False, exclude_supplementary: bool = False) -> tuple[Column, ...]:
    """Of a read: whether it is kept, the start of its window, whether it stands for its cluster, bases, mismatches, sum and number of qualities."""
    keep = ~X.flag(X.UNMAPPED) & ~X.flag(X.SECONDARY) & ~X.flag(X.QC_FAIL) & (F.coalesce("mapq", F.lit(255)) >= min_mapq)
    if exclude_supplementary:
        keep &= ~X.flag(X.SUPPLEMENTARY)
    if exclude_duplicates:
        keep &= ~X.flag(X.DUPLICATE)
    end = X.alignment_end()
    start = F.when(X.flag(X.REVERSE) & end.isNotNull(), F.greatest(end - window, F.lit(0))).otherwise(F.col("pos0"))
    q = F.aggregate(F.split("quals", ""), F.lit(0).cast("long"), lambda s, x: s + F.when(x == "", 0).otherwise(F.ascii(x) - 33))
    nm = F.greatest(F.coalesce("nm", F.lit(0)), F.lit(0)).cast("long")
    return keep, start, ~X.flag(X.PAIRED) | X.flag(X.FIRST), F.length("seq").cast("long"), nm, q, F.length("quals").cast("long")


def gc_reads(reads: DataFrame, window: int = 100, **rules) -> DataFrame:
    """Kept reads with the start of their window, as counts of one read each: contig, start0, starts, cluster, n, nm, q, nq."""
    keep, start, *rest = gc_measures(window, **rules)
    names = ("cluster", "n", "nm", "q", "nq")
    return reads.filter(keep).select("contig", start.alias("start0"), F.lit(1).alias("starts"), *[x.alias(n) for x, n in zip(rest, names, strict=True)])


def gcbias_bins(reads: DataFrame, ref: DataFrame, contigs: DataFrame, window: int = 100, starts: DataFrame | None = None, **rules) -> DataFrame:
    """(gc 0..100, windows, starts, n, nm, q, nq). Reads, or their counts by start, go to the stretch that they start in, where one byte tells their window's percentage."""
    stretches = bases.gc_stretches(ref, contigs, window)
    names = ("starts", "n", "nm", "q", "nq")
    at = (gc_reads(reads, window, **rules) if starts is None else starts).select("contig", "start0", *names, F.floor(F.col("start0") / bases.stretch_size(window)).alias("s"))
    met = at.join(stretches.select("contig", "s", "gc"), ["contig", "s"]).select(bases.gc_of("start0", window).cast("long").alias("gc"), *names).filter(F.col("gc") <= 100)
    counts = met.groupBy("gc").agg(*[F.sum(c).cast("long").alias(c) for c in names])
    windows = stretches.select(F.posexplode("windows").alias("gc", "n")).groupBy(F.col("gc").cast("long").alias("gc")).agg(F.sum("n").alias("windows"))
    every = ref.sparkSession.range(101).select(F.col("id").alias("gc"))
    return every.join(windows, "gc", "left").join(counts, "gc", "left").fillna(0)


def gcbias_detail(reads: DataFrame, ref: DataFrame, contigs: DataFrame, sample: str = "sample", window: int = 100, bins: DataFrame | None = None, **rules) -> DataFrame:
    bins = gcbias_bins(reads, ref, contigs, window, **rules) if bins is None else bins
    every = W.partitionBy()
    mean = R(F.sum("starts").over(every), F.sum("windows").over(every))
    c = F.col
    norm = lambda top: R(R(top, c("windows")), c("mean"))
    emp = F.when((c("nm") > 0) & (c("n") > 0), F.lit(-10.0) * F.log10(c("nm") / c("n"))).otherwise(0.0)
    return bins.withColumn("mean", mean).select(
        F.lit(sample).alias("sample"), "gc", "windows", c("starts").alias("read_starts"), R(c("q"), c("nq")).alias("reported_base_quality"), emp.alias("empirical_base_quality"),
        norm(c("starts")).alias("normalized_coverage"), norm(F.sqrt(c("starts").cast("double"))).alias("error_bar_width"),
    ).orderBy("gc")


def gcbias_summary(reads: DataFrame, ref: DataFrame, contigs: DataFrame, sample: str = "sample", window: int = 100, bins: DataFrame | None = None, kept: DataFrame | None = None, **rules) -> DataFrame:
    """bins and kept (total_clusters, aligned_reads; one row): what they would be made of the reads, if it is there already."""
    bins = gcbias_bins(reads, ref, contigs, window, **rules) if bins is None else bins
    if kept is None:
        kept = gc_reads(reads, window, **rules).agg(F.count(F.when(F.col("cluster"), 1)).alias("total_clusters"), F.count(F.lit(1)).alias("aligned_reads"))
    every = W.partitionBy()
    c = F.col
    bins = bins.withColumns({"tw": F.sum("windows").over(every), "ts": F.sum("starts").over(every)})
    drop = F.greatest(R(c("windows"), c("tw")) - R(c("starts"), c("ts")), F.lit(0.0)) * 100
    drop = F.when((c("tw") > 0) & (c("ts") > 0), drop).otherwise(0.0)
    mean = R(F.max("ts"), F.max("tw"))
    band = lambda lo, hi: R(R(F.sum(F.when(c("gc").between(lo, hi), c("starts"))), F.sum(F.when(c("gc").between(lo, hi), c("windows")))), mean).alias(f"gc_{lo}_{hi}_normcov")
    row = bins.groupBy().agg(F.sum(F.when(c("gc") <= 50, drop).otherwise(0.0)).alias("at_dropout"), F.sum(F.when(c("gc") > 50, drop).otherwise(0.0)).alias("gc_dropout"), *[F.coalesce(band(lo, hi), F.lit(0.0)).alias(f"gc_{lo}_{hi}_normcov") for lo, hi in ((0, 19), (20, 39), (40, 59), (60, 79), (80, 100))])
    return kept.crossJoin(row).select(F.lit(sample).alias("sample"), F.lit(window).cast("long").alias("window_size"), "total_clusters", "aligned_reads", "at_dropout", "gc_dropout", *[f"gc_{lo}_{hi}_normcov" for lo, hi in ((0, 19), (20, 39), (40, 59), (60, 79), (80, 100))])  # one row each
