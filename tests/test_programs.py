"""Programs on small reads with numbers worked out by hand, sources, sinks, and all queries against their SQL."""

import gzip
import math
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from readqc import multi, sinks
from readqc.functions import expressions as X
from readqc.operators import bases, histogram as H, intervals as I
from readqc.plans import coverage, errors, hybcap, simple
from readqc.sources import bam, bgzf, text

SF = "/root/testdata/sf0.001"
COLS = "read_id long, qname string, flags int, ref_id int, contig string, pos0 long, mapq int, mate_ref_id int, mate_pos0 long, tlen int, cigar string, seq string, quals string, nm long, mq long, has_sa boolean"


@pytest.fixture()
def make(spark):
    def reads(*rows):
        full = []
        for i, r in enumerate(rows):
            n = r.get("n", 10)
            d = {"qname": f"r{i}", "flags": 0, "ref_id": 0, "contig": "chr1", "pos0": 0, "mapq": 60, "mate_ref_id": None, "mate_pos0": None, "tlen": 0, "cigar": f"{n}M", "seq": "A" * n, "quals": "?" * n, "nm": None, "mq": None, "has_sa": False} | {k: v for k, v in r.items() if k != "n"}
            full.append((i, *(d[k] for k in d)))
        return spark.createDataFrame(full, COLS).withColumn("cigar", X.parse_cigar("cigar"))

    return reads


def pair(name, p1, p2, n=10, extra=0, tlen=None, **more):
    t = tlen if tlen is not None else p2 - p1 + n
    both = {"qname": name, "mate_ref_id": 0, "n": n} | more
    return [both | {"flags": 99 + extra, "pos0": p1, "mate_pos0": p2, "tlen": t}, both | {"flags": 147 + extra, "pos0": p2, "mate_pos0": p1, "tlen": -t}]


def ref_of(spark, seq, contig="chr1", size=50):
    return spark.createDataFrame([(contig, i, seq[i : i + size]) for i in range(0, len(seq), size)], "contig string, start0 long, seq string")


def test_insert_sizes(spark, make):
    rows = [x for i, t in enumerate((90, 95, 100, 100, 105, 110)) for x in pair(f"p{i}", 0, t - 10, tlen=t)]
    (r,) = simple.insert_size_metrics(make(*rows)).collect()
    assert (r.pair_orientation, r.read_pairs, r.median_insert_size, r.mode_insert_size, r.min_insert_size, r.max_insert_size, r.mean_insert_size) == ("FR", 6, 100.0, 100, 90, 110, 100.0)
    dup = [x for i in range(3) for x in pair(f"d{i}", 0, 90, extra=1024)]
    assert simple.insert_size_metrics(make(*rows, *dup)).first().read_pairs == 6
    assert simple.insert_size_metrics(make(*rows, *dup), include_duplicates=True).first().read_pairs == 9


def test_mode_takes_largest(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (2, 1)], "k int, n int")
    assert df.agg(H.mode("k", "n")).first()[0] == 3
    assert H.median_mad(spark.createDataFrame([(1, 2), (2, 2)], "k int, n int"), [], "k", "n").first().median == 1.5


def test_alignment(spark, make):
    rows = {r.category: r for r in simple.alignment_summary(make(*[x for i in range(5) for x in pair(f"p{i}", 0, 90, n=100)])).collect()}
    assert [(rows[c].total_reads, rows[c].strand_balance) for c in ("read1", "read2", "pair")] == [(5, 1.0), (5, 0.0), (10, 0.5)]
    (empty,) = simple.alignment_summary(make(*pair("a", 0, 9)).limit(0)).collect()
    assert empty.category == "read1" and empty.total_reads == 0 and empty.mean_read_length == 0
    five = simple.alignment_summary(make(*[{"nm": i, "qname": f"x{i}"} for i in range(1, 6)])).first()
    assert five.hq_median_mismatches == 3.0


def test_basic(spark, make):
    reads = make({"flags": 77, "seq": "ACGT", "quals": "+5?I", "cigar": "*"}, {"flags": 157, "seq": "TTTT", "quals": "5555", "cigar": "*"})
    assert [(r.cycle, r.mean_quality) for r in simple.mean_quality_by_cycle(reads).collect()] == [(1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0), (5, 20.0), (6, 20.0), (7, 20.0), (8, 20.0)]
    assert {r.quality: r["count"] for r in simple.quality_score_distribution(reads).collect()} == {10: 1, 20: 5, 30: 1, 40: 1}
    rev = {r.cycle: (r.frac_g, r.frac_c, r.frac_a) for r in simple.base_distribution_by_cycle(make({"flags": 16, "seq": "ACG", "quals": "+5?", "cigar": "3M"})).collect()}
    assert rev == {1: (1.0, 0.0, 0.0), 2: (0.0, 1.0, 0.0), 3: (0.0, 0.0, 1.0)}


def test_wgs(spark, make):
    ref = ref_of(spark, "A" * 20)
    m = coverage.wgs_metrics(make(*[x for i in range(5) for x in pair(f"p{i}", 0, 10)]), ref).first()
    assert (m.genome_territory, m.mean_coverage, m.frac_bases_at_1x, m.frac_bases_at_5x, m.frac_bases_at_10x, m.fold_80_base_penalty) == (20, 5.0, 1.0, 1.0, 0.0, 1.0)
    over = coverage.wgs_metrics(make(*pair("p", 0, 5)), ref).first()
    assert over.frac_excluded_overlap == pytest.approx(5 / 20)
    assert coverage.eligible_territory(ref_of(spark, "A" * 10 + "N" * 10)).first()[0] == 10
    hist = coverage.depth_histogram(make(*pair("p", 0, 10)), ref).collect()
    assert len(hist) == 251 and (hist[1].bases, hist[0].bases_at_or_above, hist[1].bases_at_or_above, hist[2].bases_at_or_above) == (20, 20, 20, 0)
    bed = spark.createDataFrame([("chr1", 5, 15, "x")], "contig string, start0 long, end0 long, name string")
    assert coverage.wgs_metrics(make(*pair("p", 0, 10)), ref, intervals=bed).first().genome_territory == 10
    capped = coverage.wgs_metrics(make(*[x for i in range(8) for x in pair(f"p{i}", 0, 0)]), ref, coverage_cap=5).first()
    assert capped.mean_coverage == 2.5 and capped.sd_coverage == pytest.approx((125 / 19) ** 0.5)


def test_gcbias(spark, make):
    contigs = spark.createDataFrame([(0, "chr1", 20)], "ref_id int, contig string, length long")
    rows = coverage.gcbias_detail(make(*[{"qname": f"x{i}"} for i in range(5)]), ref_of(spark, "A" * 20), contigs, window=10).collect()
    assert len(rows) == 101 and (rows[0].windows, rows[0].read_starts, rows[0].normalized_coverage) == (11, 5, 1.0) and not any(r.windows for r in rows[1:])
    s = coverage.gcbias_summary(make(*[x for i in range(3) for x in pair(f"p{i}", 0, 10)]), ref_of(spark, "A" * 20), contigs, window=10).first()
    assert (s.total_clusters, s.aligned_reads) == (3, 6)


def hyb(spark, reads, baits, targets, **options):
    contigs = spark.createDataFrame([(0, "chr1", 10_000)], "ref_id int, contig string, length long")
    ivs = lambda xs: spark.createDataFrame([("chr1", a, b, f"i{a}") for a, b in xs], "contig string, start0 long, end0 long, name string")
    return hybcap.hybcap_metrics(reads, ivs(baits), ivs(targets), contigs, **options).first()


def test_hybcap(spark, make):
    m = hyb(spark, make({"n": 100}, {"n": 100, "quals": "#" * 100}), [(0, 200)], [(0, 200)], min_bq=10)
    assert (m.frac_exc_baseq, m.frac_target_bases_1x, m.max_target_coverage, m.min_target_coverage, m.total_bases) == (0.5, 0.5, 1, 0, 200)
    m = hyb(spark, make(*pair("p", 0, 50, n=100)), [(0, 200)], [(0, 200)])
    assert (m.frac_exc_overlap, m.on_target_bases) == (0.25, 150)
    m = hyb(spark, make({"n": 100, "pos0": 50}), [(0, 100)], [(0, 100)])
    assert (m.on_bait_bases, m.near_bait_bases, m.off_bait_bases) == (50, 50, 0)
    m = hyb(spark, make({"n": 10}), [(0, 60), (40, 100)], [(0, 30), (70, 100)])
    assert (m.bait_territory, m.target_territory, m.bait_design_efficiency) == (100, 60, 0.6)
    m = hyb(spark, make({"n": 100}, {"n": 100, "flags": 1024}), [(0, 100)], [(0, 100)])
    assert (m.total_reads, m.deduped_reads, m.frac_exc_dupe, m.mean_target_coverage, m.hs_library_size) == (2, 1, 0.5, 1.0, None)
    deletion = make(*[{"qname": f"x{i}", "seq": "A" * 100, "quals": "?" * 100, "cigar": "90M20D10M"} for i in range(10)])
    m, d = hyb(spark, deletion, [(0, 120)], [(0, 120)]), hyb(spark, deletion, [(0, 120)], [(0, 120)], include_indels=True)
    assert m.mean_target_coverage == pytest.approx(10 * 100 / 120) and m.min_target_coverage == 0 and (d.mean_target_coverage, d.min_target_coverage) == (10.0, 10)


def test_library_size(spark):
    """Both solve their equations: library size for the pairs, penalty for the goal."""
    rows = [(100, 100), (0, 0), (1000, 800), (10**9, 10**9 - 1), (50, 1), (123_456, 123_000), (10, 9)]
    c = F.col
    out = spark.createDataFrame(rows, "p long, u long").withColumn("size", hybcap.library_size(c("p"), c("u")))
    for r in out.withColumn("penalty", hybcap.hs_penalty(c("size"), F.lit(12.5), F.lit(1.7), F.lit(0.6), c("p"), c("u"), 20)).collect():
        if not 0 < r.u < r.p:
            assert r.size is None and r.penalty == 0.0
            continue
        unique = lambda size: -size * math.expm1(-r.p / size)  # noqa: E731, B023
        assert unique(r.size) <= r.u * (1 + 1e-9) and unique(r.size + 1) >= r.u * (1 - 1e-9)
        need = 20 / 12.5 * 1.7
        if need * r.u >= r.size:
            assert r.penalty is None
        else:
            x = r.penalty * 0.6 / 1.7 * r.u * need / r.p
            assert -r.size * math.expm1(-x * r.p / r.size) / r.u == pytest.approx(need, rel=1e-9)


def test_errors(spark, make):
    ref = ref_of(spark, "ACGT" * 250)
    read = {"pos0": 100, "seq": "ACGTACGTAC", "quals": "?" * 10}
    two = make(read | {"seq": "CCGTTCGTAC"})
    r = {x.stratifier: x for x in errors.mismatch(errors.counted(two, ref, groups=())).collect()}["all"]
    assert (r.total_bases, r.error_bases, r.frac_error) == (10, 2, 0.2)
    indel = lambda c, s: errors.indel(errors.counted(make(read | {"cigar": c, "seq": s, "quals": "?" * len(s)}), ref, groups=())).first()
    a, b = indel("10M3I", "ACGTACGTACGGG"), indel("5M2D5M", "ACGTATACGT"[:10])
    assert (a.num_insertions, a.num_inserted_bases, a.num_deletions) == (1, 3, 0) and (b.num_deletions, b.num_deleted_bases, b.total_bases) == (1, 2, 10)
    both = pair("p", 100, 105)
    both[0] |= {"seq": "ACGTACGTAC"}
    both[1] |= {"seq": "CGTACCTACG"}
    o = errors.overlap(errors.counted(make(*both), ref, groups=())).first()
    assert o.overlapping_read_bases == 10
    masked = spark.createDataFrame([("chr1", 100, 101, "v")], "contig string, start0 long, end0 long, name string")
    assert errors.mismatch(errors.counted(two, ref, groups=(), mask=masked)).first().error_bases == 1
    with pytest.raises(ValueError):
        errors.parse_groups(["nonsense"])


def test_intervals(spark):
    ivs = spark.createDataFrame([("c", 0, 10, "a"), ("c", 10, 20, "b"), ("c", 30, 40, "d"), ("e", 5, 9, "f")], "contig string, start0 long, end0 long, name string")
    assert sorted(map(tuple, I.merge(ivs).select("contig", "start0", "end0", "name").collect())) == [("c", 0, 20, "a|b"), ("c", 30, 40, "d"), ("e", 5, 9, "f")]
    a = spark.createDataFrame([(i, "c", s, s + n) for i, (s, n) in enumerate([(0, 40_000), (5, 1), (25, 3), (39, 100)])], "id long, contig string, a_start long, a_end long")
    b = ivs.select("contig", F.col("start0").alias("b_start"), F.col("end0").alias("b_end"), "name")
    want = {(x.id, y.name) for x in a.collect() for y in b.collect() if x.contig == y.contig and x.a_start < y.b_end and y.b_start < x.a_end}
    assert {(r.id, r.name) for r in I.range_join(a, b, bin_size=16).collect()} == want
    assert {r.id for r in I.range_join(a, b, "left_anti").collect()} == {2}


SAM = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n@RG\tID:a\tSM:me\nq1\t99\tchr1\t11\t60\t4M\t=\t21\t14\tACGT\tIIII\tNM:i:1\tSA:Z:x\nq1\t147\tchr1\t21\t255\t2S2M\t=\t11\t-14\tACGT\t*\tMQ:i:60\n*\t4\t*\t0\t0\t*\t*\t0\t0\tNN\t##\n"


def test_sam_and_bam(spark, tmp_path):
    p = tmp_path / "x.sam"
    p.write_text(SAM)
    with gzip.open(tmp_path / "y.sam.gz", "wt") as f:
        f.write(SAM)
    cols = ["qname", "flags", "contig", "pos0", "mapq", "mate_pos0", "tlen", "seq", "quals", "nm", "mq", "has_sa"]
    got = [tuple(r) for r in text.reads(spark, str(p)).orderBy("read_id").select(*cols).collect()]
    assert got[0] == ("q1", 99, "chr1", 10, 60, 20, 14, "ACGT", "IIII", 1, None, True) and got[1][4] is None and got[1][8] == "" and got[2][:4] == (None, 4, None, None)
    assert sorted(map(str, (tuple(r) for r in text.reads(spark, str(tmp_path / "y.sam.gz")).select(*cols).collect()))) == sorted(map(str, got))
    assert text.sample_of(str(p), SAM.splitlines()) == "me" and text.sample_of("/a/b.bam", []) == "b"
    with pytest.raises(ValueError):
        text.reads(spark, "x.cram")

    def record(name, flags, ref, pos, mapq, ops, mate, mate_pos, tlen, seq, quals, extra):
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flags, len(seq), mate, mate_pos, tlen) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops)
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
        body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2)) + quals + extra
        return struct.pack("<i", len(body)) + body

    raw = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    raw += record("q1", 99, 0, 10, 60, [(4, "M")], 0, 20, 14, "ACGT", bytes([40] * 4), b"NMC\x01SAZx\0")
    raw += record("q1", 147, 0, 20, 255, [(2, "S"), (2, "M")], 0, 10, -14, "ACGT", b"\xff" * 4, b"MQC\x3c")
    raw += record("*", 4, -1, -1, 0, [], -1, -1, 0, "NN", bytes([2, 2]), b"")
    (tmp_path / "z.bam").write_bytes(blocked(raw, (60,))[0])
    assert [tuple(r) for r in bam.bam(spark, str(tmp_path / "z.bam")).orderBy("read_id").select(*cols).collect()] == got


def blocked(raw, cuts):
    """raw as BGZF, cut at these places, and the file offset of each block."""
    out, at = b"", []
    for lo, hi in zip((0, *cuts, len(raw)), (*cuts, len(raw), len(raw))):
        c = zlib.compressobj(1, zlib.DEFLATED, -15)
        packed = c.compress(raw[lo:hi]) + c.flush()
        at.append(len(out))
        out += bgzf.MAGIC + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(raw[lo:hi]), hi - lo)
    return out, at


def test_bam_splits_and_index(spark, tmp_path):
    """A BAM of many blocks and splits equals the SAM of the same records; a region by BAI equals the filtered scan."""
    rng = random.Random(6)
    contigs, records, lines = [("chr1", 900_000), ("chr2", 50_000)], [], []
    raw = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)
    offsets = []
    for k in range(4000):
        ref, pos = (0, k * 200) if k < 3900 else (1, (k - 3900) * 100)
        n = rng.choice((36, 80, 151, 3000 if k % 500 == 0 else 100))
        seq, q = "".join(rng.choices("ACGTN", k=n)), bytes(rng.choices(range(2, 41), k=n))
        ops = [(5, "S"), (n - 5, "M")] if k % 3 else [(n // 2, "M"), (7, "D"), (n - n // 2, "M")]
        name = f"read{k}:{rng.random()}"
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 50, 0, len(ops), 99, n, ref, pos + 5, 9) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", x << 4 | bam.OPS.index(o)) for x, o in ops)
        codes = [bam.BASES.index(c) for c in seq] + [0]
        body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, n, 2)) + q + b"NMi" + struct.pack("<i", k % 9) + b"XBBc" + struct.pack("<i", 3) + b"abc"
        offsets.append((len(raw), ref, pos, pos + sum(x for x, o in ops if o in "MD")))
        raw += struct.pack("<i", len(body)) + body
        lines.append("\t".join([name, "99", contigs[ref][0], str(pos + 1), "50", "".join(f"{x}{o}" for x, o in ops), "=", str(pos + 6), "9", seq, bytes(x + 33 for x in q).decode(), f"NM:i:{k % 9}"]))
    cuts = tuple(range(7000, len(raw), 7000))
    data, blocks = blocked(raw, cuts)
    path = str(tmp_path / "x.bam")
    (tmp_path / "x.bam").write_bytes(data)
    (tmp_path / "x.sam").write_text("\n".join([f"@SQ\tSN:{n}\tLN:{size}" for n, size in contigs] + lines) + "\n")
    cols = [c for c in text.reads(spark, str(tmp_path / "x.sam")).columns if c != "read_id"]
    want = sorted(map(str, text.reads(spark, str(tmp_path / "x.sam")).select(*cols).collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("40000", "9000", before):  # splits with several blocks, with about two, and the whole file
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        try:
            assert size == before or bgzf.blocks(spark, path).select("split").distinct().count() > 5
            assert sorted(map(str, bam.bam(spark, path).select(*cols).collect())) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")

    voffset = lambda at: blocks[at // 7000] << 16 | at % 7000
    ends = [o[0] for o in offsets[1:]] + [len(raw)]
    index = b"BAI\x01" + struct.pack("<i", 2)
    for ref in (0, 1):
        bins = {}
        for (at, r, s, e), end in zip(offsets, ends, strict=True):
            if r == ref:
                number = next((4681 >> 3 * d if False else ((1 << 3 * (5 - d)) - 1) // 7 + (s >> 14 + 3 * d)) for d in range(6) if s >> 14 + 3 * d == (e - 1) >> 14 + 3 * d)
                bins.setdefault(number, []).append((voffset(at), voffset(end) if end < len(raw) else blocks[-1] << 16))
        index += struct.pack("<i", len(bins))
        for number, chunks in bins.items():
            index += struct.pack("<Ii", number, 1) + struct.pack("<QQ", chunks[0][0], chunks[-1][1])
        index += struct.pack("<i", 0)
    whole = bam.bam(spark, path)
    (tmp_path / "x.bam.bai").write_bytes(index)
    for contig, s, e in (("chr1", 100_000, 100_500), ("chr1", 0, 1), ("chr2", 3000, 60_000), ("chr1", 899_000, 900_000)):
        plain = whole.filter((F.col("contig") == contig) & (F.col("pos0") < e)).filter(X.alignment_end() > s)
        found = bam.bam_region(spark, path, contig, s, e)
        assert sorted(map(str, found.select(*cols).collect())) == sorted(map(str, plain.select(*cols).collect()))
        assert sorted(map(str, bam.bam_region(spark, path, contig, s, e, split_bytes=1).select(*cols).collect())) == sorted(map(str, plain.select(*cols).collect()))


def test_intervals_and_references(spark, tmp_path):
    contigs = spark.createDataFrame([(0, "chr1", 1000)], "ref_id int, contig string, length long")
    (tmp_path / "a.bed").write_text("chr1\t5\t15\tx\nchr1\t20\t30\t.\nchrZ\t1\t2\n")
    assert [(r.start0, r.end0, r.name) for r in text.intervals(spark, str(tmp_path / "a.bed"), contigs).orderBy("start0").collect()] == [(5, 15, "x"), (20, 30, "chr1:20-30")]
    (tmp_path / "a.interval_list").write_text("@SQ\tSN:chr1\tLN:1000\nchr1\t6\t15\t+\tx\n")
    assert [(r.start0, r.end0, r.name) for r in text.intervals(spark, str(tmp_path / "a.interval_list"), contigs).collect()] == [(5, 15, "x")]
    (tmp_path / "bad.bed").write_text("track name=x\n")
    with pytest.raises(Exception):
        text.intervals(spark, str(tmp_path / "bad.bed"), contigs).collect()
    (tmp_path / "packed.bed").write_bytes(gzip.compress(b"chr1\t5\t15\tx\n"))
    assert [(r.start0, r.end0, r.name) for r in text.intervals(spark, str(tmp_path / "packed.bed"), contigs).collect()] == [(5, 15, "x")]
    (tmp_path / "r.fa").write_text(">chr1 x\nACGTA\nCGTNN\n")
    (tmp_path / "r.fa.fai").write_text("chr1\t10\t8\t5\t6\n")
    ref = text.fasta(spark, str(tmp_path / "r.fa"))
    assert [(r.start0, r.seq) for r in ref.collect()] == [(0, "ACGTACGTNN")]
    assert [(r.start0, r.seq) for r in text.fasta(spark, str(tmp_path / "r.fa"), piece=4).orderBy("start0").collect()] == [(0, "ACGT"), (4, "ACGT"), (8, "NN")]
    assert [text.fasta_region(spark, str(tmp_path / "r.fa"), "chr1", a, b) for a, b in ((0, 10), (3, 7), (5, 5))] == ["ACGTACGTNN", "TACG", ""]
    assert bases.with_reference(spark.createDataFrame([("chr1", 6)], "contig string, ref_pos long"), ref).first().ref_base == "G"
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\tPOS\nchr1\t10\t.\tACGT\tA\t.\t.\t.\nchr1\t20\t.\tA\tC\t.\t.\tEND=25\n")
    assert [(r.start0, r.end0) for r in text.vcf(spark, str(tmp_path / "v.vcf")).collect()] == [(9, 13), (19, 25)]


def test_fasta_splits(spark, tmp_path):
    """Two contigs of different line lengths over many splits, with \\r\\n, equal the plain text."""
    rng = random.Random(1)
    seqs = {"a": "".join(rng.choices("ACGTN", k=30_001)), "b": "".join(rng.choices("acgt", k=9000))}
    data, index = "", ""
    for (name, seq), width, end in zip(seqs.items(), (61, 100), ("\n", "\r\n"), strict=True):
        data += f">{name} some words{end}"
        index += f"{name}\t{len(seq)}\t{len(data)}\t{width}\t{width + len(end)}\n"
        data += "".join(seq[i : i + width] + end for i in range(0, len(seq), width))
    (tmp_path / "r.fa").write_text(data, newline="")
    (tmp_path / "r.fa.fai").write_text(index)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        found = {n: "".join(r.seq for r in text.fasta(spark, str(tmp_path / "r.fa")).filter(F.col("contig") == n).orderBy("start0").collect()) for n in seqs}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == seqs
    assert text.fasta_region(spark, str(tmp_path / "r.fa"), "b", 95, 305) == seqs["b"][95:305]


def test_vcf_region(spark, tmp_path):
    rows = "".join(f"chr1\t{p}\t.\tAC\tA\t.\t.\t.\n" for p in range(1, 200_000, 50))
    raw = ("##x\n#CHROM\tPOS\n" + rows).encode()
    cuts = tuple(range(5000, len(raw), 5000))
    data, blocks = blocked(raw, cuts)
    (tmp_path / "v.vcf.gz").write_bytes(data)
    bins, at = {}, raw.index(b"chr1")
    for line in rows.splitlines(keepends=True):
        p, end = int(line.split("\t")[1]) - 1, at + len(line)
        place = lambda x: blocks[x // 5000] << 16 | x % 5000
        bins.setdefault(4681 + (p >> 14) if p >> 14 == (p + 1) >> 14 else 585, []).append((place(at), place(end)))
        at = end
    body = struct.pack("<7i", 2, 1, 2, 0, 35, 0, 5) + b"chr1\0" + struct.pack("<i", len(bins))
    for number, chunks in bins.items():
        body += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
    (tmp_path / "v.vcf.gz.tbi").write_bytes(blocked(b"TBI\x01" + struct.pack("<i", 1) + body + struct.pack("<i", 0), ())[0])
    path = str(tmp_path / "v.vcf.gz")
    every = [(r.start0, r.end0) for r in text.vcf(spark, path).collect()]
    assert len(every) == 4000
    for s, e in ((0, 60), (16_000, 17_000), (190_000, 300_000)):
        want = sorted(x for x in every if x[0] < e and x[1] > s)
        assert sorted((r.start0, r.end0) for r in text.vcf_region(spark, path, "chr1", s, e).collect()) == want
        assert sorted((r.start0, r.end0) for r in text.vcf_region(spark, path, "chr1", s, e, split_bytes=1).collect()) == want


def test_sinks(spark, make, tmp_path):
    df = spark.createDataFrame([(1, 0.125), (2, 2.675)], "cycle long, mean_quality double")
    path = sinks.write_tsv(df, "mean_quality_by_cycle", str(tmp_path / "o"))
    assert open(path).read() == "cycle\tmean_quality\n1\t0.12\n2\t2.67\n"
    assert os.path.getsize(sinks.write_tsv(df.limit(0), "mean_quality_by_cycle", str(tmp_path / "e"))) == 0
    many = spark.createDataFrame([("chr1", i, f"t{i}", i * 2) for i in range(100)], "chrom string, pos long, target string, coverage long").orderBy("pos")
    parts = sorted(p for p in (tmp_path / "o.hybcap-per-base.txt").glob("part-*")) if sinks.write_tsv(many, "per_base", str(tmp_path / "o")) else []
    lines = [x for p in parts for x in p.read_text().splitlines() if not x.startswith("chrom")]
    assert lines == [f"chr1\t{i}\tt{i}\t{i * 2}" for i in range(100)]


def test_docs_and_command_line(spark, tmp_path, capsys):
    multi.main(["docs", "--format", "markdown", "-o", str(tmp_path / "d.md")])
    made = (tmp_path / "d.md").read_text()
    assert made.count("## ") == 16 and "| `hs_penalty_20x` | number, 2 decimals |" in made and made.count("\n| `") > 150
    multi.main(["docs"])
    assert capsys.readouterr().out.startswith("alignment_summary (.alignment-metrics.txt)")
    (tmp_path / "x.sam").write_text(SAM)
    (tmp_path / "r.fa").write_text(">chr1 x\n" + "ACGTACGTAC\n" * 100)
    (tmp_path / "r.fa.fai").write_text("chr1\t1000\t8\t10\t11\n")
    out = str(tmp_path / "o")
    multi.main(["multi", "-i", str(tmp_path / "x.sam"), "-o", out, "-r", str(tmp_path / "r.fa"), "--tools", "isize", "wgs", "isize", "--wgs::min-mapq", "0", "--wgs::min-bq", "0", "--wgs::exclude-unpaired-reads", "false", "--isize::include-duplicates"])
    assert sorted(p.name for p in tmp_path.glob("o.*")) == ["o.isize-histogram.txt", "o.isize-metrics.txt", "o.wgs-coverage.txt", "o.wgs-metrics.txt"]
    assert (tmp_path / "o.wgs-coverage.txt").read_text().splitlines()[2].startswith("1\t4\t")
    multi.main(["error", "-i", str(tmp_path / "x.sam"), "-o", out, "-r", str(tmp_path / "r.fa"), "--min-bq", "0", "--min-mapq", "0", "--stratify-by", "read_num", "cycle,read_num"])
    assert {x.split("\t")[0] for x in (tmp_path / "o.error-mismatch.txt").read_text().splitlines()[1:]} == {"all", "read_num", "cycle,read_num"}
    for bad in (["wgs", "-i", "x.sam", "-o", "o", "-r", "f", "--wgs::min-mapq", "3"], ["multi", "-i", "x", "-o", "o", "--wgs::nonsense", "1"], ["isize", "-i", "x", "-o", "o", "--min-frac", "much"], ["wgs", "-i", "x.sam", "-o", "o"], ["nothing"]):
        with pytest.raises(SystemExit):
            multi.main(bad)
    with pytest.raises(ValueError):
        multi.main(["multi", "-i", str(tmp_path / "x.sam"), "-o", out, "--tools", "gcbias"])


def test_multi_equals_single(spark, make):
    x = multi.Inputs(make(*[y for i in range(4) for y in pair(f"p{i}", i, 90 + i)]))
    together = multi.run(["alignment", "basic", "isize", "basic"], x)
    for tool in ("alignment", "basic", "isize"):
        for name, df in multi.tables(tool, x).items():
            assert df.collect() == together[name].collect()
    with pytest.raises(ValueError):
        multi.run(["wgs"], x)


def test_stream(spark, make, tmp_path):
    from readqc.streaming import running_insert_sizes

    reads = make(*[x for i, t in enumerate((90, 95, 100)) for x in pair(f"p{i}", 0, t - 10, tlen=t)])
    reads.write.parquet(str(tmp_path / "in"))
    q = running_insert_sizes(spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("sizes").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.insert_size for r in spark.table("sizes").collect()) == [90, 95, 100]


@pytest.mark.parametrize("name", ["alignment_ends", "mate_clip_pos", "alignment_summary", "isize_metrics", "wgs_depth_hist", "gcbias_detail", "per_target", "error_mismatch_hp_len", "error_overlap"])
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 1


def test_range_join_of_dense_short_spans(spark):
    """Bins follow the spans, so rows that meet in a bin are not many times those that overlap."""
    a = spark.range(3000).select(F.col("id"), F.lit("c").alias("contig"), (F.col("id") * 5).alias("a_start"), (F.col("id") * 5 + 40).alias("a_end"))
    b = spark.range(3000).select(F.lit("c").alias("contig"), (F.col("id") * 5 + 2).alias("b_start"), (F.col("id") * 5 + 30).alias("b_end"), F.col("id").alias("name"))
    assert I.bin_for(a, b) == 64 and I.bin_for(a.limit(0), b.limit(0)) == I.LEAST_BIN
    got = I.range_join(a, b).select("id", "name").collect()
    want = {(i, j) for i in range(3000) for j in range(max(0, i - 9), min(3000, i + 9)) if i * 5 < j * 5 + 30 and j * 5 + 2 < i * 5 + 40}
    assert len(got) == len(want) and set(map(tuple, got)) == want
    met = a.join(b.withColumnRenamed("contig", "_c"), F.floor(F.col("a_start") / 64) == F.floor(F.col("b_start") / 64)).count()
    assert met < 2 * len(want)


def test_range_join_broadcasts_few_entries(spark):
    """Few rows of long spans make many entries, which are not broadcast, whichever side they are on."""
    long = spark.range(8).select(F.col("id"), F.lit("c").alias("contig"), (F.col("id") * 50_000_000).alias("s"), (F.col("id") * 50_000_000 + 600_000_000).alias("e"))
    short = spark.range(40).select(F.col("id").alias("name"), F.lit("c").alias("contig"), (F.col("id") * 25_000_000).alias("s"), (F.col("id") * 25_000_000 + 10).alias("e"))
    want = {(i, j) for i in range(8) for j in range(40) if i * 2 * 25_000_000 < j * 25_000_000 + 10 and j * 25_000_000 < i * 50_000_000 + 600_000_000}
    for one, two, sent in ((long, short, "BuildRight"), (short, long, "")):
        a, b = (df.withColumnsRenamed({"s": f"{x}_start", "e": f"{x}_end"}) for df, x in ((one, "a"), (two, "b")))
        for send in (False, True):
            df = I.range_join(a, b, send=send)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert ("Broadcast" in plan) == bool(sent) and sent in plan and "BuildLeft" not in plan, plan
            assert sorted(map(tuple, df.select("id", "name").collect())) == sorted(want)


def test_interval_list_in_many_files(spark, tmp_path):
    """The header's file need not be the one that a scan reads first."""
    contigs = spark.createDataFrame([(0, "chr1", 90_000)], "ref_id int, contig string, length long")
    (tmp_path / "x.interval_list").mkdir()
    (tmp_path / "x.interval_list" / "part-0").write_text("\n@SQ\tSN:chr1\tLN:90000\n")
    (tmp_path / "x.interval_list" / "part-1").write_text("".join(f"chr1\t{i + 1}\t{i + 9}\t+\tb{i}\n" for i in range(5000)))
    assert text.intervals(spark, str(tmp_path / "x.interval_list"), contigs).count() == 5000


def test_wgs_metrics_without_cap(spark, make):
    ref = spark.createDataFrame([("chr1", 0, "ACGT" * 5)], "contig string, start0 long, seq string")
    reads = make(*[x for i in range(300) for x in pair(f"p{i}", 0, 0)])
    got = coverage.wgs_metrics(reads, ref, coverage_cap=None).first()
    hist = coverage.depth_histogram(reads, ref, coverage_cap=None).collect()
    covered = next(r.bases for r in hist if r.depth == 300)
    assert [r.depth for r in hist] == [0, 300] and covered > 0
    assert got.mean_coverage == 300 * covered / 20 and got.frac_excluded_capped == 0
    assert coverage.wgs_metrics(reads, ref).first().mean_coverage == 250 * covered / 20
