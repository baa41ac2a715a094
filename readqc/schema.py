"""Input schemas, and names, suffixes and printed decimals of the sixteen metric tables."""

from __future__ import annotations

import re

READS = (
    "read_id long, qname string, flags int, ref_id int, contig string, pos0 long, mapq int, mate_ref_id int, mate_pos0 long, tlen int, "
    "cigar array<struct<op:string,len:int>>, seq string, quals string, nm long, mq long, has_sa boolean"
)
CONTIGS = "ref_id int, contig string, length long"
REFERENCE = "contig string, start0 long, seq string"
INTERVALS = "contig string, start0 long, end0 long, name string"

_HYB6 = ("frac_", "bait_design_efficiency", "on_bait_vs_selected")

#: Table: (suffix, default decimals, decimals of single columns, what a row is).
TABLES = {
    "alignment_summary": (".alignment-metrics.txt", 2, {"frac_": 5, "strand_balance": 5, "_rate": 6}, "Alignment metrics of first, second and all reads."),
    "base_distribution_by_cycle": (".base-distribution-by-cycle.txt", 5, {}, "Share of each base at each cycle."),
    "mean_quality_by_cycle": (".mean-quality-by-cycle.txt", 2, {}, "Mean base quality at each cycle."),
    "quality_score_distribution": (".quality-score-distribution.txt", 5, {}, "Bases at each quality."),
    "gcbias_detail": (".gcbias-detail.txt", 5, {"_quality": 2}, "Windows and reads at each percentage of G and C."),
    "gcbias_summary": (".gcbias-summary.txt", 5, {}, "Dropout and normalised coverage by G and C."),
    "hybcap_metrics": (".hybcap-metrics.txt", 2, {**{k: 6 for k in _HYB6}}, "Hybrid-capture metrics."),
    "per_target": (".hybcap-per-target.txt", 5, {"mean_coverage": 2}, "Coverage of each target."),
    "per_base": (".hybcap-per-base.txt", 2, {}, "Coverage of each target base."),
    "insert_size_metrics": (".isize-metrics.txt", 2, {}, "Insert sizes by pair orientation."),
    "insert_size_histogram": (".isize-histogram.txt", 2, {}, "Pairs at each insert size."),
    "wgs_metrics": (".wgs-metrics.txt", 2, {"frac_": 5}, "Genome coverage and excluded bases."),
    "wgs_coverage": (".wgs-coverage.txt", 5, {}, "Bases at each depth."),
    "error_mismatch": (".error-mismatch.txt", 2, {"frac_": 6}, "Mismatches by stratum."),
    "error_overlap": (".error-overlap.txt", 2, {}, "Mismatches in overlapping mates by stratum."),
    "error_indel": (".error-indel.txt", 2, {"frac_": 6}, "Insertions and deletions by stratum."),
}


def decimals(table: str, column: str) -> int:
    _, usual, special, _ = TABLES[table]
    return next((n for k, n in special.items() if column.startswith(k) or column.endswith(k)), usual)


#: What a column means; {0} and {1} are the groups of the pattern.
MEANINGS = (
    (r"sample", "name of the sample"), (r"category", "read1, read2 or pair"), (r"total_reads", "primary reads"), (r"deduped_reads", "primary reads that are not duplicates"), (r"deduped_reads_aligned", "those of them that are aligned"), (r"aligned_reads", "aligned reads that pass the filters"),
    (r"frac_aligned", "share of reads that are aligned"), (r"hq_aligned_reads", "aligned reads of high mapping quality"), (r"hq_aligned_bases", "aligned bases of these reads"), (r"hq_aligned_q20_bases", "those of a base quality of 20 and more"), (r"hq_median_mismatches", "median of mismatches a read"),
    (r"(hq_)?mismatch_rate", "mismatches an aligned base"), (r"indel_rate", "insertions and deletions an aligned base"), (r"(mean|sd|median|mad|min|max)_read_length", "{0} of read lengths"), (r"mean_aligned_read_length", "mean of aligned and inserted bases of aligned reads"),
    (r"aligned_reads_in_pairs", "aligned reads with an aligned mate"), (r"frac_aligned_in_pairs", "their share of aligned reads"), (r"reads_improperly_paired", "those not marked as a proper pair"), (r"frac_reads_improperly_paired", "their share"), (r"bad_cycles", "cycles at which most bases are N"),
    (r"strand_balance", "share of aligned reads on the forward strand"), (r"frac_chimeras", "share of pairs and reads that look chimeric"), (r"frac_(soft|hard)clipped_reads", "share of bases that are {0}-clipped"), (r"mean_3prime_softclipped_bases", "mean of soft-clipped bases at the end of sequencing, of reads with any"),
    (r"read_end", "1 for first and single reads, 2 for second ones"), (r"cycle", "cycle of sequencing, from 1"), (r"frac_([acgt])", "share of base {0}"), (r"frac_n", "share of other bases"), (r"mean_quality", "mean base quality"), (r"quality", "base quality"), (r"count", "bases"), (r"frac_bases", "share of all bases"),
    (r"gc", "percent of G and C in a window"), (r"windows", "windows of the reference"), (r"read_starts", "reads that begin there"), (r"reported_base_quality", "mean base quality of these reads"), (r"empirical_base_quality", "quality that their mismatches tell"), (r"normalized_coverage", "coverage relative to the mean"), (r"error_bar_width", "its standard error"),
    (r"window_size", "bases of a window"), (r"total_clusters", "first and single reads"), (r"(at|gc)_dropout", "percentage points of reads missing from {0}-rich parts"), (r"gc_(\d+)_(\d+)_normcov", "normalised coverage from {0} to {1} percent"),
    (r"panel_name", "name of the panel"), (r"genome_size", "bases of all contigs"), (r"(bait|target|genome)_territory", "bases of the {0} regions, each once"), (r"bait_design_efficiency", "target bases a bait base"), (r"total_bases", "bases that count"), (r"(deduped_)?bases_aligned", "aligned bases"),
    (r"deduped_bases_aligned", "aligned bases of reads that are not duplicates"), (r"(on|near|off)_bait_bases", "aligned bases {0} baits"), (r"on_target_bases", "bases on targets that pass the filters"), (r"on_target_bases_from_pairs", "those of reads with an aligned mate"), (r"selected_pairs", "pairs that touch padded baits"),
    (r"selected_unique_pairs", "those that are not duplicates"), (r"frac_deduped_reads", "share of reads that are not duplicates"), (r"frac_deduped_reads_aligned", "share of them that are aligned"), (r"frac_selected_bases", "share of bases on or near baits"), (r"frac_off_bait", "share of bases off baits"), (r"on_bait_vs_selected", "share of selected bases on baits"),
    (r"(mean|median|max|min)_target_coverage", "{0} depth of target positions"), (r"mean_bait_coverage", "mean depth of baits"), (r"frac_uncovered_targets", "share of targets without coverage"), (r"fold_enrichment", "density of bases on baits relative to the genome"), (r"fold_(\d+)_base_penalty", "mean depth over the depth that {0} percent of positions reach"),
    (r"frac_exc(?:luded)?_(\w+)", "share of bases excluded: {0}"), (r"frac_target_bases_(\d+)x", "share of target positions with a depth of at least {0}"), (r"frac_bases_at_(\d+)x", "share of positions with a depth of at least {0}"), (r"frac_usable_bases_on_(bait|target)", "bases on the {0} regions as a share of all bases"),
    (r"hs_library_size", "estimated number of distinct molecules"), (r"hs_penalty_(\d+)x", "sequencing relative to the goal that brings 80 percent of the target to a depth of {0}; empty where none does"), (r"chrom", "contig"), (r"start", "first position, from 1"), (r"end", "last position"), (r"length", "positions"), (r"name", "name of the interval"), (r"gc_frac", "share of G and C"),
    (r"(mean|median|min|max|sd|mad)_coverage", "{0} of depth"), (r"frac_0x", "share of positions without coverage"), (r"read_count", "reads with a base on the target"), (r"pos", "position, from 1"), (r"target", "name of the target"), (r"coverage", "depth"), (r"pair_orientation", "FR, RF or TANDEM"), (r"read_pairs", "pairs"),
    (r"(mean|median|mode|min|max)_insert_size", "{0} of insert sizes"), (r"standard_deviation", "standard deviation without outliers"), (r"median_absolute_deviation", "median distance from the median"), (r"insert_size", "insert size"), (r"(fr|rf|tandem)_count", "pairs of orientation {0}"), (r"depth", "depth; the last one stands for all above"), (r"bases", "positions of this depth"),
    (r"bases_at_or_above", "positions of this depth and above"), (r"frac_bases_at_or_above", "their share"), (r"stratifier", "what the row is split by"), (r"covariate", "its value"), (r"error_bases", "bases that differ from the reference"), (r"frac_error", "their share"), (r"q_score", "this rate as a quality, at most 99"),
    (r"overlapping_read_bases", "bases whose position the mate covers too"), (r"bases_mismatching_ref_and_mate", "bases that differ from reference and mate, which agree"), (r"bases_matching_mate_but_not_ref", "bases that agree with the mate against the reference"), (r"bases_in_three_way_disagreement", "bases where all three differ"), (r"q_(\w+)", "rate of {0} as a quality"),
    (r"num_(insertions|deletions)", "{0}"), (r"num_(inserted|deleted)_bases", "{0} bases"), (r"frac_indel_error", "insertions and deletions a base"),
)


def describe(table: str, column: str) -> str:
    """The meaning of a column, by the first pattern that fits the whole name."""
    for pattern, what in MEANINGS:
        if m := re.fullmatch(pattern, column):
            return what.format(*(g or "" for g in m.groups()))
    raise KeyError(f"{table}.{column}")
