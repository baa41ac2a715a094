"""Queries of sources and sinks: the fixture's tables written in each format and read back, against the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fixture, multi, sinks
from .operators import bases
from .plans import simple
from .queries import _HIST, ORACLES, T, query, sql
from .sources import bam, text

_FIELDS = "qname, flags, ref_id, contig, pos0, mapq, mate_ref_id, mate_pos0, tlen, cigar, seq, quals, CAST(nm AS BIGINT) AS nm, CAST(mq AS BIGINT) AS mq, has_sa"
_READS = f" SELECT {_FIELDS}, 'orders' AS sample FROM reads"


def _flat(reads: DataFrame, sample: str) -> DataFrame:
    """Reads with their CIGAR as text."""
    text_of = F.array_join(F.transform("cigar", lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
    return reads.drop("read_id").withColumns({"cigar": text_of, "sample": F.lit(sample)})


@query(sql(_READS))
def bam_reads(spark, d):
    path = T(spark, d).file("reads.bam")
    return _flat(text.reads(spark, path), text.sample_of(path, bam.read_header(spark, path)[0]))


@query(sql(_READS))
def sam_reads(spark, d):
    path = T(spark, d).file("reads.sam")
    return _flat(text.reads(spark, path), text.sample_of(path, text.sam_header(spark, path)))


@query(sql(_READS))
def sam_gzip_reads(spark, d):
    path = T(spark, d).file("reads.sam.gz")
    return _flat(text.reads(spark, path), text.sample_of(path, text.sam_header(spark, path)))


@query(sql(f" SELECT {_FIELDS} FROM r WHERE contig = 'chr2' AND pos0 < 9000 AND end0 > 5000"))
def bam_region_reads(spark, d):
    """A region by the index of each part, read within tasks."""
    return _flat(bam.bam_region(spark, T(spark, d).file("reads.bam"), "chr2", 5000, 9000), "").drop("sample")


@query(sql(" SELECT contig, pos0, flags, count(*) AS reads FROM r WHERE EXISTS (SELECT 1 FROM tg WHERE tg.contig = r.contig AND r.pos0 < tg.end0 AND tg.start0 < r.end0) GROUP BY contig, pos0, flags"))
def bam_reads_in_targets(spark, d):
    """Reads of all targets' intervals, each read once, of which three columns are decoded."""
    t = T(spark, d)
    return bam.bam_intervals(spark, t.file("reads.bam"), t.targets, ["contig", "pos0", "flags"]).groupBy("contig", "pos0", "flags").agg(F.count(F.lit(1)).alias("reads"))


@query(sql(" SELECT read_id % 2 + 1 AS read_end, count(*) AS reads, CAST(sum(pos0) AS BIGINT) AS places FROM reads WHERE contig = 'chr3' AND mapq >= 30 AND flags & 1024 = 0 AND pos0 < 10000 GROUP BY 1"))
def bam_pushed_filters(spark, d):
    """Filters on contig, position and mapping quality go into the source; the one on flags stays with Spark."""
    rows = text.reads(spark, T(spark, d).file("reads.bam"), ["flags", "contig", "pos0", "mapq"]).filter("contig = 'chr3' AND mapq >= 30 AND pos0 < 10000 AND flags & 1024 = 0")
    end = F.when(F.col("flags").bitwiseAND(1) == 0, F.when(F.col("flags").bitwiseAND(16) != 0, 2).otherwise(1)).when(F.col("flags").bitwiseAND(64) != 0, 1).otherwise(2).cast("long")
    return rows.groupBy(end.alias("read_end")).agg(F.count(F.lit(1)).alias("reads"), F.sum("pos0").alias("places"))


@query(ORACLES["isize_hist"])
def bam_isize_hist(spark, d):
    """Insert sizes from a BAM of which neither names nor bases, qualities or tags are decoded."""
    return simple.insert_size_histogram(text.reads(spark, T(spark, d).file("reads.bam"), multi.columns_of(["isize"])))


@query(ORACLES["ref_lookup"])
def fasta_lookup(spark, d):
    """Reference bases under the reads, from an indexed FASTA whose contigs are checked against the reads' header."""
    t = T(spark, d)
    path = t.file("ref.fa")
    text.check_contigs(t.contigs, text.fasta_index(spark, path))
    return bases.aligned_with_reference(t.reads, ["read_id"], text.fasta(spark, path)).select("read_id", "ref_pos", "ref_base")


@query(sql(" SELECT contig, start0, end0, CASE WHEN start0 % 3 = 0 THEN contig || ':' || CAST(start0 AS VARCHAR) || '-' || CAST(end0 AS VARCHAR) ELSE name END AS name FROM tg"))
def bed_intervals(spark, d):
    t = T(spark, d)
    return text.intervals(spark, t.file("targets.bed"), t.contigs)


@query(sql(" SELECT contig, start0, end0, name FROM bt"))
def interval_list_intervals(spark, d):
    t = T(spark, d)
    return text.intervals(spark, t.file("baits.interval_list"), t.contigs)


@query(sql(" SELECT contig, start0, end0, name FROM va", f"va AS ({fixture.VARIANTS_SQL})"))
def vcf_spans(spark, d):
    return text.vcf(spark, T(spark, d).file("variants.vcf"))


@query(sql(" SELECT contig, start0, end0, name FROM va", f"va AS ({fixture.VARIANTS_SQL})"))
def bcf_spans(spark, d):
    return text.vcf(spark, T(spark, d).file("variants.bcf"))


@query(sql(" SELECT contig, start0, end0, name FROM va WHERE contig = 'chr2' AND start0 < 9000 AND end0 > 3000", f"va AS ({fixture.VARIANTS_SQL})"))
def bcf_region_spans(spark, d):
    return text.vcf_region(spark, T(spark, d).file("variants.bcf"), "chr2", 3000, 9000)


@query(ORACLES["isize_hist"])
def tsv_isize_hist(spark, d):
    """The histogram as its TSV file holds it."""
    from .store import claimed

    hist = simple.insert_size_histogram(T(spark, d).reads)
    path = sinks.write_tsv(hist, "insert_size_histogram", f"{claimed(spark, 'tsv')}/run")
    return spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"{n} {k}" for n, k in hist.dtypes))


@query(sql(
    " SELECT orient AS pair_orientation, printf('%.2f', avg(s)) AS mean_insert_size, printf('%.2f', median(s)) AS median_insert_size FROM h JOIN m USING (orient) JOIN d USING (orient) WHERE s <= med + 10 * mad AND n >= (SELECT count(*) FROM h) * 0.05 GROUP BY orient",
    _HIST, "m AS (SELECT orient, count(*) AS n, median(s) AS med FROM h GROUP BY orient)", "d AS (SELECT orient, median(abs(s - med)) AS mad FROM h JOIN m USING (orient) GROUP BY orient)").replace("printf('%.2f', median(s))", "printf('%.2f', min(med))"))
def tsv_isize_metrics(spark, d):
    """Numbers of a metrics file, as text with the decimals of its table."""
    from .store import claimed

    path = sinks.write_tsv(simple.insert_size_metrics(T(spark, d).reads), "insert_size_metrics", f"{claimed(spark, 'tsv')}/run")
    return spark.read.csv(path, sep="\t", header=True).select("pair_orientation", "mean_insert_size", "median_insert_size")
