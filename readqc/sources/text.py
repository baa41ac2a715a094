"""Text sources: SAM, FASTA, BED, IntervalList, VCF. All scans go through Spark's readers, so any store works.

CRAM needs codecs that are not available and raises an error.
"""

from __future__ import annotations

import gzip
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import parse_cigar
from ..operators.bases import CHUNK as PIECE
from . import bcf, bgzf


def detect_format(path: str) -> str:
    low = path.lower()
    for end, kind in ((".sam.gz", "sam"), (".sam", "sam"), (".bam", "bam"), (".cram", "cram"), (".parquet", "parquet")):
        if low.endswith(end):
            return kind
    raise ValueError(f"unknown alignment format: {path}")


def lines_of(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """(value): lines of a text file. BGZF is read by many tasks; other gzip files, which can't be split, by one each."""
    if path.lower().endswith((".gz", ".bgz")) and bgzf.is_blocked(spark, path) and bgzf.reachable(bgzf.files(spark, path)[0][0]):
        return bgzf.text_lines(spark, path, split_bytes)
    return spark.read.text(path)


def _start_of(data: bytes) -> bytes:
    """The beginning of a text file from that of its bytes, inflated if they are gzip."""
    out = b""
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out += d.decompress(data)
        data = d.unused_data
        if not d.eof or not data:
            return out
    return out + data


def sam_header(spark: SparkSession, path: str) -> list[str]:
    """The header lines at the beginning of the first file; more of it is read until another line is seen."""
    name, size = bgzf.files(spark, path)[0]
    part = 1 << 18
    while True:
        data = _start_of(bgzf.read_range(spark, name, 0, part))
        whole = data if part >= size else data[: data.rfind(b"\n") + 1]
        lines = [x for x in whole.decode("utf-8", "replace").splitlines() if x]
        head = [x for x in lines if re.match(r"@[A-Z][A-Z]\t", x)]
        if part >= size or len(head) < len(lines):
            return head
        part *= 4


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of the files, in order of their paths, that isn't blank. A scan's first row is no such thing: Spark reads the largest files first."""
    for name, size in bgzf.files(spark, path):
        part = 1 << 16
        while size:
            data = _start_of(bgzf.read_range(spark, name, 0, part))
            whole = data if part >= size else data[: data.rfind(b"\n") + 1]
            if found := next((x for x in whole.decode("utf-8", "replace").splitlines() if x.strip()), None):
                return found
            if part >= size:
                break
            part *= 4
    return None


def contigs_of(spark: SparkSession, header: list[str]) -> DataFrame:
    rows = [(i, re.search(r"\tSN:([^\t]+)", h)[1], int(re.search(r"\tLN:(\d+)", h)[1])) for i, h in enumerate(x for x in header if x.startswith("@SQ"))]
    return spark.createDataFrame(rows, "ref_id int, contig string, length long")


def sample_of(path: str, header: list[str]) -> str:
    """SM of the first read group that has one, else the file's stem."""
    for h in header:
        if h.startswith("@RG") and (m := re.search(r"\tSM:([^\t]+)", h)):
            return m[1]
    return re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a SAM file (plain or gzip, by many tasks if it is blocked); missing values (*, 0, 255) are null."""
    contigs = F.broadcast(contigs_of(spark, sam_header(spark, path)))  # one row a contig
    f = F.split("value", "\t", 12)
    lines = lines_of(spark, path).filter("NOT (value RLIKE '^@[A-Z][A-Z]\\\\t') AND value <> ''")
    tags = F.coalesce(F.try_element_at(f, F.lit(12)), F.lit(""))
    tag = lambda t: F.when(tags.rlike(rf"(^|\t){t}:i:"), F.regexp_extract(tags, rf"(?:^|\t){t}:i:(-?\d+)", 1).cast("long"))
    raw = lines.select(
        F.monotonically_increasing_id().alias("read_id"), F.when(f[0] != "*", f[0]).alias("qname"), f[1].cast("int").alias("flags"), F.when(f[2] != "*", f[2]).alias("contig"), F.when(f[3] != "0", f[3].cast("long") - 1).alias("pos0"),
        F.when(f[4] != "255", f[4].cast("int")).alias("mapq"), F.when(f[6] == "=", f[2]).when(f[6] != "*", f[6]).alias("mate_contig"), F.when(f[7] != "0", f[7].cast("long") - 1).alias("mate_pos0"), f[8].cast("int").alias("tlen"),
        f[5].alias("cigar_text"), F.when(f[9] != "*", f[9]).otherwise("").alias("seq"), F.when(f[10] != "*", f[10]).otherwise("").alias("quals"), tag("NM").alias("nm"), tag("MQ").alias("mq"), tags.rlike(r"(^|\t)SA:[A-Za-z]:").alias("has_sa"),
    )
    own = contigs.select("contig", "ref_id")
    mate = contigs.select(F.col("contig").alias("mate_contig"), F.col("ref_id").alias("mate_ref_id"))
    out = raw.join(own, "contig", "left").join(mate, "mate_contig", "left").withColumn("cigar", parse_cigar("cigar_text"))
    return out.select("read_id", "qname", "flags", "ref_id", "contig", "pos0", "mapq", "mate_ref_id", "mate_pos0", "tlen", "cigar", "seq", "quals", "nm", "mq", "has_sa")


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length, offset, line_bases, line_width) of path.fai, which must be there."""
    f = F.split("value", "\t")
    return spark.read.text(path + ".fai").select(f[0].alias("contig"), f[1].cast("long").alias("length"), f[2].cast("long").alias("offset"), f[3].cast("long").alias("line_bases"), f[4].cast("long").alias("line_width"))


def _line_starts(spark: SparkSession, path: str):
    """Lines of a text file with their split, and a broadcast of the byte offset at which the lines of each split begin (one row a split)."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_block_start").alias("split"), F.col("value"))
    sizes = lines.groupBy("split").agg(F.sum(F.octet_length("value") + 1).alias("n")).orderBy("split").collect()
    starts, at = {}, 0
    for r in sizes:
        starts[r.split] = at
        at += r.n
    return lines, spark.sparkContext.broadcast(starts)


def fasta(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """Reference pieces (contig, start0, seq) of ``piece`` bases, but for the last one of a contig.

    path.fai must be there: the byte offset of a line tells its contig and position, so files are split like any text. Lines
    are cut at the pieces' borders and put together by piece.
    """
    index = [(r.contig, r.length, r.offset, r.line_bases, r.line_width) for r in fasta_index(spark, path).orderBy("offset").collect()]  # one row a contig
    lines, starts = _line_starts(spark, path)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        names = np.array([x[0] for x in index], dtype=object)
        lengths, offsets, bases, widths = (np.array([x[i] for x in index], np.int64) for i in (1, 2, 3, 4))
        ends = offsets + (lengths // bases) * widths + lengths % bases if len(index) else offsets
        now, at = None, 0
        for batch in batches:
            split, size = batch.column("split").to_numpy(), batch.column("n").to_numpy()
            first = np.empty(len(split), np.int64)
            for lo, hi in _runs(split):
                if split[lo] != now:
                    now, at = int(split[lo]), starts.value[int(split[lo])]
                sums = np.cumsum(size[lo:hi] + 1)
                first[lo:hi] = at + sums - size[lo:hi] - 1
                at += int(sums[-1])
            c = np.searchsorted(offsets, first, "right") - 1
            inside = (c >= 0) & (first < ends[np.maximum(c, 0)]) if len(index) else np.zeros(len(split), bool)
            k = c[inside]
            start = (first[inside] - offsets[k]) // widths[k] * bases[k]
            yield pa.RecordBatch.from_arrays([pa.array(names[k], pa.string()), pa.array(start), batch.column("value").filter(pa.array(inside))], names=["contig", "start0", "seq"])

    placed = lines.select("split", "value", F.octet_length("value").cast("long").alias("n")).mapInArrow(place, "contig string, start0 long, seq string")
    placed = placed.withColumn("seq", F.rtrim(F.regexp_replace("seq", "\r$", ""))).filter("seq <> ''")
    end = F.col("start0") + F.length("seq")
    cut = placed.withColumn("no", F.explode(F.sequence(F.floor(F.col("start0") / piece), F.floor((end - 1) / piece))))
    begin = F.greatest("start0", F.col("no") * piece)
    cut = cut.select("contig", "no", begin.alias("at"), F.substr("seq", (begin - F.col("start0") + 1).cast("int"), (F.least(end, (F.col("no") + 1) * piece) - begin).cast("int")).alias("part"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "")
    return cut.groupBy("contig", "no").agg(whole.alias("seq")).select("contig", (F.col("no") * piece).alias("start0"), "seq")


def _runs(values):
    """(first, last + 1) of runs of equal values."""
    import numpy as np

    cuts = np.flatnonzero(np.diff(values)) + 1 if len(values) else np.zeros(0, int)
    edges = [0, *cuts.tolist(), len(values)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def fasta_region(spark: SparkSession, path: str, contig: str, start0: int, end0: int) -> str:
    """The bases of a region, from the bytes that the index tells; a region is as large as what the caller asks for."""
    r = fasta_index(spark, path).filter(F.col("contig") == contig).first()
    if r is None or not 0 <= start0 <= end0 <= r.length:
        raise ValueError(f"no such region: {contig}:{start0}-{end0}")
    at = lambda p: r.offset + p // r.line_bases * r.line_width + p % r.line_bases
    data = bgzf.read_range(spark, path, at(start0), at(end0) - at(start0)) if end0 > start0 else b""
    return re.sub(rb"\s", b"", data).decode()


def check_contigs(contigs: DataFrame, index: DataFrame) -> None:
    """Every contig of the header must be in the reference."""
    missing = [r.contig for r in contigs.join(index, "contig", "left_anti").limit(5).collect()]
    if missing:
        raise ValueError(f"contigs missing from the reference: {', '.join(missing)}")


def _maybe_gzipped(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value) of a text file, gzip or not, whatever its name. A gzip file that isn't named .gz, an interval list, is inflated whole in one task."""
    packed = bgzf.read_range(spark, bgzf.files(spark, path)[0][0], 0, 2) == b"\x1f\x8b"
    if not packed or path.lower().endswith((".gz", ".bgz")):
        return lines_of(spark, path)

    def unpack(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content").to_pylist():
                yield pa.RecordBatch.from_pydict({"value": gzip.decompress(content).decode().splitlines()}, schema=pa.schema([("value", pa.string())]))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "value string")


def intervals(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """BED, or IntervalList if the first line that isn't empty begins with @; gzip by its first bytes. Unknown contigs in BED are left out; broken lines are errors."""
    lines = _maybe_gzipped(spark, path).filter("trim(value) <> ''")
    first = first_line(spark, path)
    f = F.split("value", "\t")
    fail = lambda cond, text: F.when(cond, F.raise_error(F.concat(F.lit(text + ": "), F.col("value"))))
    if first is not None and first.startswith("@"):
        head = [r.value for r in lines.filter("value LIKE '@SQ%'").collect()]
        given = [(re.search(r"\tSN:([^\t]+)", h)[1], int(re.search(r"\tLN:(\d+)", h)[1])) for h in head]
        known = [(r.contig, r.length) for r in contigs.orderBy("ref_id").limit(len(given)).collect()]
        if given != known:
            raise ValueError("the interval list's dictionary is not a prefix of the reads' dictionary")
        body = lines.filter("value NOT LIKE '@%'")
        bad = fail((F.size(f) < 3) | ~f[1].rlike(r"^\d+$") | ~f[2].rlike(r"^\d+$") | (f[1].cast("long") < 1) | (f[1].cast("long") > f[2].cast("long") + 1), "invalid interval")
        rows = body.withColumn("_bad", bad).filter("_bad IS NULL").select(f[0].alias("contig"), (f[1].cast("long") - 1).alias("start0"), f[2].cast("long").alias("end0"), F.try_element_at(f, F.lit(5)).alias("name"))
    else:
        bad = fail((F.size(f) < 3) | ~f[1].rlike(r"^\d+$") | ~f[2].rlike(r"^\d+$"), "invalid BED line")
        bad = F.coalesce(bad.cast("string"), fail(f[1].cast("long") > f[2].cast("long"), "BED start after end").cast("string"))
        rows = lines.withColumn("_bad", bad).filter("_bad IS NULL").select(f[0].alias("contig"), f[1].cast("long").alias("start0"), f[2].cast("long").alias("end0"), F.try_element_at(f, F.lit(4)).alias("name"))
    plain = F.when((F.trim("name") == "") | (F.col("name") == "."), None).otherwise(F.col("name"))
    return named(rows.withColumn("name", plain)).join(F.broadcast(contigs.select("contig")), "contig", "left_semi")  # one row a contig


def named(rows: DataFrame) -> DataFrame:
    """Missing names become contig:start0-end."""
    return rows.withColumn("name", F.coalesce("name", F.concat(F.col("contig"), F.lit(":"), F.col("start0").cast("string"), F.lit("-"), F.col("end0").cast("string"))))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Spans of all records (contig, start0, end0, name), without a look at FILTER: to INFO/END, else over REF."""
    if path.lower().endswith(".bcf"):
        return bcf.bcf(spark, path)
    return _variants(_maybe_gzipped(spark, path))


def vcf_region(spark: SparkSession, path: str, contig: str, start0: int, end0: int, split_bytes: int = 32 << 20) -> DataFrame:
    """Spans of the records that overlap a region: by TBI or CSI of a BGZF file, a task some of its chunks; without index by a filtered scan."""
    if path.lower().endswith(".bcf"):
        return bcf.bcf_region(spark, path, contig, start0, end0, split_bytes)
    index = bgzf.find_index(spark, path, (".tbi", ".csi"))
    rows = None
    if index is not None and contig in index.names:
        file = bgzf.files(spark, path)[0][0]
        if bgzf.reachable(file):
            rows = _variants(bgzf.range_lines(spark, file, bgzf.grouped(index.chunks(index.names.index(contig), start0, end0), split_bytes)))
    rows = vcf(spark, path) if rows is None else rows
    return rows.filter((F.col("contig") == contig) & (F.col("start0") < end0) & (F.col("end0") > start0))


def _variants(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    rows = lines.filter("value NOT LIKE '#%' AND value <> ''")
    info = F.coalesce(F.try_element_at(f, F.lit(8)), F.lit(""))
    end = F.when(info.rlike(r"(^|;)END=\d+"), F.regexp_extract(info, r"(?:^|;)END=(\d+)", 1).cast("long"))
    start = f[1].cast("long") - 1
    return rows.select(f[0].alias("contig"), start.alias("start0"), F.coalesce(end, start + F.length(f[3])).cast("long").alias("end0"), f[2].alias("name"))


def region(reads: DataFrame, contig: str, start0: int, end0: int) -> DataFrame:
    """Reads that overlap a region; on Parquet the contig and the position reach the scan."""
    from ..functions.expressions import alignment_end

    return reads.filter((F.col("contig") == contig) & (F.col("pos0") < end0)).filter(alignment_end() > start0)


def reads(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Reads of a file of any kind; of a BAM only these columns are decoded, if given, while other plans prune by themselves."""
    kind = detect_format(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "sam":
        return sam(spark, path)
    if kind == "bam":
        from .bam import bam

        return bam(spark, path, columns)
    raise ValueError("CRAM is not supported; convert to BAM or SAM")
