"""The BAM data source: splits, columns, filters, indexes, and blocked text."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from readqc import multi
from readqc.functions import expressions as X
from readqc.plans import simple
from readqc.sources import bam, bcf, bgzf, text
from readqc.sources.bam_writer import Writer, bcf_header, bcf_record, header, placed_record, write_bam

CONTIGS = [("chr1", 900_000), ("chr2", 50_000)]


def reads(n, seed=6):
    """Sorted reads as dicts: lengths from 0 to 20,000, missing values, every operation, two contigs and unplaced ones."""
    rng, out = random.Random(seed), []
    for k in range(n):
        ref, pos = (0, k * 800_000 // n) if k < n * 0.8 else (1, int((k - n * 0.8) * 100)) if k < n * 0.95 else (None, None)
        size = 20_000 if k % 997 == 3 else rng.choice((0, 1, 36, 80, 151, 151))
        seq = "".join(rng.choices("ACGTNMR=", k=size))
        quals = "" if k % 7 == 0 or not size else "".join(chr(33 + rng.randrange(2, 60)) for _ in range(size))
        ops = [] if ref is None or size < 10 else [(3, "H"), (5, "S"), (size - 8, "M"), (7, "D"), (3, "=")] if k % 3 else [(size - 4, "M"), (900, "N"), (2, "X"), (2, "I"), (1, "P")]
        out.append({
            "read_id": k, "qname": f"read{k}:{rng.random()}" if k % 11 else None, "flags": rng.choice((99, 147, 4 if ref is None else 83, 1024)), "ref_id": ref, "contig": None if ref is None else CONTIGS[ref][0], "pos0": pos, "mapq": rng.choice((None, 0, 20, 60)), "mate_ref_id": ref if k % 5 else None,
            "mate_pos0": pos if k % 5 else None, "tlen": rng.randrange(-500, 500), "cigar": [{"op": o, "len": x} for x, o in ops], "seq": seq, "quals": quals, "nm": rng.choice((None, 0, 7)), "mq": rng.choice((None, 30)), "has_sa": k % 13 == 0,
        })
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """(path of one BAM file with index, its reads)."""
    where, rows = tmp_path_factory.mktemp("bam"), reads(3000)
    with open(where / "x.bam", "wb") as out:
        w = Writer(out, header(["@RG\tID:a\tSM:me"], CONTIGS), 2)
        for r in rows:
            w.add(*placed_record(r))
        w.close()
    (where / "x.bam.bai").write_bytes(w.bai())
    return str(where / "x.bam"), rows


COLUMNS = [f.split(" ")[0] for f in bam.READS.replace("op:string,len:int", "").split(", ")]
RECORDS = [c for c in COLUMNS if c != "read_id"]


def plain(rows, columns=RECORDS):
    return [str([[tuple(o.values()) for o in r[c]] if c == "cigar" else r[c] for c in columns]) for r in rows]


def got(df, columns=RECORDS):
    return [str([[tuple(o) for o in r[c]] if c == "cigar" else r[c] for c in columns]) for r in df.orderBy("read_id").collect()]


@pytest.mark.parametrize("split", [20_000, 70_000, 1 << 26])
def test_splits(spark, made, split):
    """Any splits, also less than a block and within records of 20,000 bases, give all reads once, in order, with the same read_id."""
    path, rows = made
    df = bam.bam(spark, path, split_bytes=split)
    assert got(df) == plain(rows)
    assert [r.read_id for r in df.select("read_id").orderBy("read_id").collect()] == [r.read_id for r in bam.bam(spark, path).select("read_id").orderBy("read_id").collect()]


def test_block_scan_is_the_same(spark, made):
    path, rows = made
    assert sorted(str([[tuple(o) for o in r[c]] if c == "cigar" else r[c] for c in RECORDS]) for r in bam.by_blocks(spark, path).collect()) == sorted(plain(rows))


def test_columns_are_pruned(spark, made, tmp_path, monkeypatch):
    """Only what is asked for is decoded: a file whose bases, qualities and tags can't be read gives insert sizes, and no other column does."""
    path, rows = made
    assert bam.bam(spark, path, ["flags", "pos0"]).columns == ["flags", "pos0"]
    broken = tmp_path / "broken.bam"
    with open(broken, "wb") as out:
        w = Writer(out, header([], CONTIGS), 2)
        put = w._put
        w._put = lambda data: put(data[:-1] + b"\xff" if data[-5:] == b"SAZx\0" else data)  # the tag's text has no end
        for r in rows[:1400]:
            w.add(*placed_record(r | {"has_sa": True}))
        w.close()
    want = multi.columns_of(["isize"])
    assert not {"seq", "quals", "qname", "nm", "mq", "has_sa"} & set(want)
    asked = []
    real = bam.Records.column
    monkeypatch.setattr(bam.Records, "column", lambda self, name: asked.append(name) or real(self, name))
    reader = bam.BamReader(spark.createDataFrame([], bam._schema_of(want)).schema, {"path": str(broken)})
    for part in reader.partitions():
        list(reader.read(part))
    assert set(asked) == set(want)
    monkeypatch.undo()
    assert simple.insert_size_histogram(bam.bam(spark, str(broken), want)).count() == simple.insert_size_histogram(bam.bam(spark, path).filter(F.col("read_id") >= 0).limit(1400)).count()
    with pytest.raises(Exception, match="subsection|tag|not found"):
        bam.bam(spark, str(broken), ["nm"]).collect()
    with pytest.raises(Exception, match="no such column"):
        spark.read.format("readqc_bam").schema("bases string").load(path).collect()


def test_programs_need_their_columns_only(spark, made):
    """Every program runs on the columns that it declares."""
    path, _ = made
    contigs, ref = bam.bam_contigs(spark, path), spark.createDataFrame([("chr1", 0, "ACGT" * 1000)], "contig string, start0 long, seq string")
    spans = spark.createDataFrame([("chr1", 10, 500, "a")], "contig string, start0 long, end0 long, name string")
    for tool in multi.NEEDS:
        x = multi.Inputs(bam.bam(spark, path, multi.columns_of([tool])), contigs, ref, spans, spans)
        assert all(df.columns for df in multi.run([tool], x).values())
    assert set(multi.columns_of(["isize", "basic"])) == set(multi.columns_of(["isize"])) | set(multi.columns_of(["basic"]))


@pytest.mark.parametrize("condition", ["flags = 99 AND mapq >= 20", "pos0 < 4000", "mate_ref_id IS NULL AND tlen > 10", "contig = 'chr2' AND pos0 <= 1000", "contig IN ('chr1', 'nowhere')", "contig IS NULL", "mapq IS NOT NULL AND qname LIKE '%9'", "ref_id IN (1, 2)"])
def test_filters(spark, made, condition):
    path, _ = made
    whole = spark.createDataFrame([tuple(r) for r in bam.bam(spark, path).select("read_id", "qname", "flags", "ref_id", "contig", "pos0", "mapq", "mate_ref_id", "tlen").collect()], "read_id long, qname string, flags int, ref_id int, contig string, pos0 long, mapq int, mate_ref_id int, tlen int")
    df = bam.bam(spark, path, split_bytes=50_000).filter(condition)
    want = [r.read_id for r in whole.filter(condition).orderBy("read_id").collect()]
    assert want and [r.read_id for r in df.select("read_id").orderBy("read_id").collect()] == want


def test_a_contig_reads_its_chunks_only(spark, made):
    path, _ = made
    reader = bam.BamReader(spark.createDataFrame([], "pos0 long").schema, {"path": path})
    whole = sum(b - a for p in reader.partitions() for a, b in p.value[2])
    list(reader.pushFilters([bam.D.EqualTo(("contig",), "chr2")]))
    parts = reader.partitions()
    assert all(p.value[3] for p in parts) and sum((b >> 16) - (a >> 16) for p in parts for a, b in p.value[2]) < whole / 3


def test_regions_are_read_by_tasks(spark, made, monkeypatch):
    """Ten thousand intervals give the scan's rows; the driver reads the header and the index only."""
    path, _ = made
    whole = bam.bam(spark, path).withColumn("e", X.alignment_end()).cache()
    read = []
    real = bgzf.read_range
    monkeypatch.setattr(bgzf, "read_range", lambda spark, name, start, size: read.append(name) or real(spark, name, start, size if name.endswith(".bai") else min(size, 1 << 18)))
    for contig, s, e in (("chr1", 100_000, 100_500), ("chr1", 0, 1), ("chr2", 3000, 60_000), ("chr1", 0, 900_000), ("chr1", 899_000, 900_000)):
        want = [r.read_id for r in whole.filter((F.col("contig") == contig) & (F.col("pos0") < e) & (F.col("e") > s)).orderBy("read_id").collect()]
        for size in (1, 1 << 26):
            assert [r.read_id for r in bam.bam_region(spark, path, contig, s, e, split_bytes=size).orderBy("read_id").collect()] == want
    spans = spark.range(10_000).select(F.lit("chr1").alias("contig"), (F.col("id") * 80).alias("start0"), (F.col("id") * 80 + 3 + F.col("id") % 90).alias("end0"))
    found = bam.bam_intervals(spark, path, spans, ["read_id", "pos0"])
    assert found.columns == ["read_id", "pos0"]
    hits = {(80 * i, 80 * i + 3 + i % 90) for i in range(10_000)}
    starts = sorted(hits)
    want = sorted(r.read_id for r in whole.filter("contig = 'chr1' AND e IS NOT NULL").collect() if any(s < r.e and e > r.pos0 for s, e in starts[max(0, r.pos0 // 80 - 3) : r.e // 80 + 2]))
    assert sorted(r.read_id for r in found.collect()) == want
    assert sorted(r.read_id for r in bam.bam_intervals(spark, path, spans, most_intervals=9).select("read_id").collect()) == want
    assert {n.rsplit(".", 1)[-1] for n in read} == {"bam", "bai"}
    whole.unpersist()
    with pytest.raises(ValueError, match="unknown contig"):
        bam.bam_region(spark, path, "chr9", 0, 5)


def test_written_parts(spark, made, tmp_path):
    """A folder of written parts reads back as one table, by scan and by region, from each part's index."""
    path, rows = made
    contigs = spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(CONTIGS)], "ref_id int, contig string, length long")
    out = str(tmp_path / "parts.bam")
    assert write_bam(bam.bam(spark, path), contigs, out, parts=4) == len(rows)
    assert sorted(got(bam.bam(spark, out))) == sorted(plain(rows))
    ours = bam.bam_region(spark, out, "chr1", 50_000, 90_000).select("qname", "pos0").collect()
    assert sorted(map(str, ours)) == sorted(map(str, bam.bam_region(spark, path, "chr1", 50_000, 90_000).select("qname", "pos0").collect()))
    assert sorted(got(spark.read.format("readqc_bam").load(out))) == sorted(plain(rows))


def test_broken_files(spark, made, tmp_path):
    path, _ = made
    data = open(path, "rb").read()
    (tmp_path / "cut.bam").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="ends inside"):
        bam.bam(spark, str(tmp_path / "cut.bam"), ["flags"]).collect()
    raw = header([], CONTIGS) + struct.pack("<i", 500) + b"x" * 100
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = c.compress(raw) + c.flush()
    (tmp_path / "short.bam").write_bytes(bgzf.MAGIC + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(raw), len(raw)))
    with pytest.raises(Exception, match="ends inside a record"):
        bam.bam(spark, str(tmp_path / "short.bam"), ["flags"]).collect()


@pytest.mark.parametrize("split", [200, 3000, 1 << 25])
def test_blocked_text_is_split(spark, tmp_path, split):
    """Lines of blocked gzip text, some longer than a block or empty, come once and in order from splits of any size; plain gzip gives the same."""
    rng = random.Random(3)
    lines = ["@HD\tVN:1.6", *("x" * rng.choice((0, 1, 40, 40, 900, 5000)) + f"\t{i}" * (i % 5 > 0) for i in range(2000))]
    for end in ("\n", ""):
        raw, out = ("\n".join(lines) + end).encode(), b""
        for at in range(0, len(raw), 1500):
            part = raw[at : at + 1500]
            c = zlib.compressobj(1, zlib.DEFLATED, -15)
            packed = c.compress(part) + c.flush()
            out += bgzf.MAGIC + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part))
        (tmp_path / "b.txt.gz").write_bytes(out)
        df = text.lines_of(spark, str(tmp_path / "b.txt.gz"), split)
        assert [r.value for r in df.collect()] == lines
        assert df.rdd.getNumPartitions() == -(-len(out) // split)
    with gzip.open(tmp_path / "p.txt.gz", "wt") as f:
        f.write("\n".join(lines))
    assert [r.value for r in text.lines_of(spark, str(tmp_path / "p.txt.gz")).collect()] == lines


def test_bcf(spark, tmp_path):
    """Spans from BCF with and without index, by splits and regions; long names, sizes beyond REF, numbered contigs, a broken file."""
    rng, rows = random.Random(8), []
    for ref, length in ((0, 800_000), (1, 50_000)):
        for start in sorted(rng.randrange(0, length) for _ in range(3000)):
            rows.append((ref, start, start + rng.choice((1, 1, 3, 400)), rng.choice((None, "rs1", "a name of more than fifteen bytes"))))
    with open(tmp_path / "v.bcf", "wb") as out:
        w = Writer(out, bcf_header(CONTIGS), 2)
        for ref, s, e, name in rows:
            w.add(bcf_record(ref, s, e - s, name, "ACGT" * rng.randrange(1, 60)), ref, s, e)
        w.close()
    path = str(tmp_path / "v.bcf")
    want = sorted((CONTIGS[r][0], s, e, n or ".") for r, s, e, n in rows)
    assert sorted(map(tuple, text.vcf(spark, path).collect())) == want
    (tmp_path / "v.bcf.csi").write_bytes(w.csi())
    df = bcf.bcf(spark, path, split_bytes=10_000)
    assert df.rdd.getNumPartitions() > 3 and sorted(map(tuple, df.collect())) == want
    for contig, s, e in (("chr1", 0, 5000), ("chr1", 400_000, 400_100), ("chr2", 0, 900_000), ("chr9", 0, 10)):
        assert sorted(map(tuple, text.vcf_region(spark, path, contig, s, e).collect())) == [r for r in want if r[0] == contig and r[1] < e and r[2] > s]
    assert bcf.header(b"BCF\x02\x02" + struct.pack("<I", 60) + b"##contig=<ID=b,IDX=4>\n##contig=<ID=a,length=3,IDX=2>\n".ljust(60, b"\0"))[0] == {4: "b", 2: "a"}
    data = (tmp_path / "v.bcf").read_bytes()
    (tmp_path / "cut.bcf").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="ends inside"):
        text.vcf(spark, str(tmp_path / "cut.bcf")).collect()


@pytest.mark.parametrize("at_once", [4 << 20, 5000])
def test_records_of_a_batch_are_those_of_single_reads(monkeypatch, at_once):
    """Bytes, blocks and index of whole batches against those of record(): long reads, missing values, texts that are not ASCII."""
    import io

    import pyarrow as pa

    from readqc.sources import bam_writer

    monkeypatch.setattr(bam_writer, "AT_ONCE", at_once)
    rows = reads(3000, seed=8)
    for i, (c, v) in enumerate([("cigar", None), ("seq", None), ("quals", None), ("qname", ""), ("tlen", None), ("has_sa", None), ("mate_pos0", None), ("qname", "ü"), ("seq", "acgtnx")]):
        rows[10 * i + 1][c] = v
    ops = pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))
    for odd in (False, True):
        rows[2000]["seq"] = "AÄC" if odd else "AAC"
        kinds = {c: ops if c == "cigar" else pa.string() if c in ("qname", "contig", "seq", "quals") else pa.bool_() if c == "has_sa" else pa.int64() if c in ("read_id", "pos0", "mate_pos0", "nm", "mq") else pa.int32() for c in COLUMNS}
        batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], names=COLUMNS)
        outs = []
        for whole in (False, True):
            out = io.BytesIO()
            w = Writer(out, header([], CONTIGS), 2)
            if whole:
                for part in (batch.slice(0, 1700), batch.slice(1700)):
                    for piece in bam_writer._slices(part):
                        w.add_all(*bam_writer.records(piece))
            else:
                for r in rows:
                    w.add(*placed_record(r))
            w.close()
            outs.append((out.getvalue(), w.bai(), w.csi()))
        assert outs[0] == outs[1]
    for c, v in (("flags", None), ("flags", 70_000), ("nm", 1 << 40), ("quals", "III "), ("cigar", [{"op": "Q", "len": 3}])):
        r = rows[5] | {"seq": "ACGT", "quals": "IIII"} | {c: v}
        with pytest.raises((ValueError, struct.error, KeyError)):
            bam_writer.records(pa.RecordBatch.from_arrays([pa.array([r[c]], k) for c, k in kinds.items()], names=COLUMNS))
