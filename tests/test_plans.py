"""Plans: one scan for several programs, running sums, marked pieces, overlap index, runs of depth."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readqc import multi, store
from readqc.fixture import Tables
from readqc.operators import bases, intervals as I
from readqc.plans import coverage, errors, facts, hybcap

DATA = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scan_for_four_programs(spark):
    """The facts of four programs scan the reads once and exchange them once; their tables don't scan them at all."""
    t = Tables(spark, DATA)
    tools = ["alignment", "basic", "isize", "gcbias"]
    where = t.reads.inputFiles()[0].rsplit("/", 2)[-2]
    plan = executed(facts.facts(t.reads, tools))
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1 and where[:20] in plan
    tables = multi.run(tools, multi.Inputs(t.reads, t.contigs, t.ref, options={"gcbias": {"window": 32}}))
    assert len(tables) == 8
    for df in tables.values():
        assert not any(where in f for f in df.inputFiles())


def test_facts_follow_options(spark):
    t = Tables(spark, DATA)
    x = multi.Inputs(t.reads, t.contigs, t.ref, options={"isize": {"include_duplicates": True, "min_frac": 0.0}, "gcbias": {"window": 64, "exclude_duplicates": True, "min_mapq": 30}, "alignment": {"min_mapq": 50, "max_insert_size": 60}})
    together, alone = multi.run(list(facts.SHARED), x), {}
    for tool in facts.SHARED:
        alone |= multi.run([tool], x)
    from readqc.plans import simple

    direct = {
        "insert_size_metrics": simple.insert_size_metrics(t.reads, include_duplicates=True, min_frac=0.0), "gcbias_detail": coverage.gcbias_detail(t.reads, t.ref, t.contigs, window=64, exclude_duplicates=True, min_mapq=30),
        "gcbias_summary": coverage.gcbias_summary(t.reads, t.ref, t.contigs, window=64, exclude_duplicates=True, min_mapq=30), "alignment_summary": simple.alignment_summary(t.reads, min_mapq=50, max_insert_size=60), "mean_quality_by_cycle": simple.mean_quality_by_cycle(t.reads),
    }
    show = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    for name, df in direct.items():
        assert show(together[name]) == show(alone[name]) == show(df), name


def test_no_reads(spark):
    t = Tables(spark, DATA)
    out = multi.run(list(facts.SHARED), multi.Inputs(t.reads.limit(0), t.contigs, t.ref))
    assert [tuple(r)[1:3] for r in out["alignment_summary"].collect()] == [("read1", 0)]
    assert out["gcbias_detail"].count() == 101 and out["insert_size_metrics"].count() == 0


REF = "".join(random.Random(4).choices("ACGTNacgt", weights=[5, 5, 5, 5, 1, 1, 1, 1, 1], k=50_000))


def pieces(spark, size=700):
    return spark.createDataFrame([("c", i, REF[i : i + size]) for i in range(0, len(REF), size)], "contig string, start0 long, seq string").repartition(3)


@pytest.mark.parametrize("window", [1, 100, 9000])
def test_gc_stretches(spark, window):
    """Percentages of every window, also over the borders of stretches and pieces, and their counts."""
    contigs = spark.createDataFrame([(0, "c", len(REF) - 7)], "ref_id int, contig string, length long")
    up, most = REF.upper(), max(4, window // 10)
    want = {i: (up.count("G", i, i + window) + up.count("C", i, i + window)) * 100 // window for i in range(0, len(REF) - 7 - window + 1, 1 if window < 200 else 97) if up.count("N", i, i + window) <= most}
    got = {r.start0: r.gc for r in bases.gc_windows(pieces(spark), contigs, window, most).collect()}
    assert {i: g for i, g in got.items() if window < 200 or i % 97 == 0} == want
    counts = bases.gc_stretches(pieces(spark), contigs, window, most).select(F.posexplode("windows")).groupBy("pos").agg(F.sum("col")).collect()
    tally = {}
    for g in got.values():
        tally[g] = tally.get(g, 0) + 1
    assert {r[0]: r[1] for r in counts if r[1]} == tally


def test_gaps_are_errors(spark):
    contigs = spark.createDataFrame([(0, "c", 900)], "ref_id int, contig string, length long")
    broken = spark.createDataFrame([("c", 0, "ACGT"), ("c", 9, "ACGT")], "contig string, start0 long, seq string")
    with pytest.raises(Exception, match="gap or overlap"):
        bases.gc_windows(broken, contigs, 2).collect()


def test_gc_exchanges_pieces_and_reads(spark):
    """No row a window and no row a base is exchanged: exchanges are by stretch, and by percent."""
    t = Tables(spark, DATA)
    df = coverage.gcbias_bins(t.reads, t.ref, t.contigs, 32)
    keys = [x.split("hashpartitioning(")[1].split(")")[0] for x in executed(df).splitlines() if "Exchange hashpartitioning" in x]
    named = {tuple(w.split("#")[0] for w in k.split(", ")[:-1]) for k in keys}
    assert keys and named <= {("contig", "s"), ("gc",), ("id",), ("_groupingexpression",)}
    assert "Window" not in executed(df)


def test_marked_pieces(spark):
    """Text of open positions against a set of positions; spans overlap, touch, cross pieces and leave the contig."""
    rng = random.Random(9)
    make = lambda n, most: [("c", s, s + rng.randrange(0, most), "x") for s in (rng.randrange(0, len(REF) + 50) for _ in range(n))]
    mask, inside = make(300, 60) + [("c", 10_000, 13_000, "long")], make(40, 1500)
    kind = "contig string, start0 long, end0 long, name string"
    m, i = spark.createDataFrame(mask, kind), spark.createDataFrame(inside, kind)
    shut, held = {p for _, s, e, _ in mask for p in range(s, e)}, {p for _, s, e, _ in inside for p in range(s, e)}
    for intervals, masked in ((None, m), (i, None), (i, m)):
        got = {}
        for r in bases.marked_pieces(pieces(spark), intervals, masked).collect():
            got |= {r.start0 + k: c for k, c in enumerate(r.open)}
        want = {p: b for p, b in enumerate(REF.upper()) if (intervals is None or p in held) and (masked is None or p not in shut)}
        assert {p: c for p, c in got.items() if c != bases.CLOSED} == want


def test_masked_errors_flatten_last(spark):
    """Under a mask and intervals no base is a row before the aggregation: what follows the only explosion of bases is partial aggregation."""
    t = Tables(spark, DATA)
    plan = errors.counted(t.reads, t.ref, groups=("cycle",), intervals=t.targets, mask=t.variants)._jdf.queryExecution().optimizedPlan().toString()
    lines = [x.strip(" :+-") for x in plan.splitlines()]
    at = next(i for i, x in enumerate(lines) if x.startswith("Generate posexplode(arrays_zip"))
    above = [x.split(" ")[0] for x in lines[:at]]
    assert "Join" not in above[above.index("Aggregate") :][:8]
    assert not any(x.startswith("Aggregate") and "ref_pos" in x.split("]")[0] for x in lines[: at + 1])


def brute_runs(rows):
    depth = {}
    for key, start, marks in rows:
        for i, c in enumerate(marks):
            if c == "1":
                depth[key, start + i] = depth.get((key, start + i), 0) + 1
    return depth


def test_depth_runs(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(0, 3000), "".join(rng.choices("01", weights=(1, 4), k=rng.randrange(0, 200)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "target long, start long, marks string")
    for bucket in (I.BUCKET, 64):
        monkeypatch.setattr(I, "BUCKET", bucket)
        out = I.depth_runs(df, "target").collect()
        assert {(r.target, p): r.depth for r in out for p in range(r.start, r.end)} == brute_runs(rows)


def test_overlap_index_and_long_reads(spark, monkeypatch):
    """Bait classes by the index equal a plain count, whether reads fit a bin or not."""
    t = Tables(spark, DATA)
    baits = [(r.contig, r.start0, r.end0) for r in t.baits.collect()]
    on, wide = set(), set()
    for c, s, e in baits:
        on |= {(c, p) for p in range(s, e)}
        wide |= {(c, p) for p in range(max(s - 250, 0), min(e + 250, 19_456))}
    want = {}
    for r in t.reads.filter("flags & 772 = 0").collect():
        at, blocks, m = r.pos0, [], 0
        for o in r.cigar:
            if o.op in "M=X":
                blocks += range(at, at + o.len)
                m += o.len
            at += o.len if o.op in "MDN=X" else 0
        if at == r.pos0:
            continue
        touches = any((r.contig, p) in wide for p in range(r.pos0, at))
        n = sum((r.contig, p) in on for p in blocks) if touches else 0
        want[r.read_id] = (m, touches, n, max(m - n, 0) if touches else 0, 0 if touches else m)
    for size in (I.INDEX_BIN, 33):  # with the smaller bins reads with a skip or a deletion go by blocks
        monkeypatch.setattr(I, "INDEX_BIN", size)
        monkeypatch.setattr(I.overlap_index, "__defaults__", (size,))
        df = hybcap.bait_classes(t.reads.filter("flags & 4 = 0"), t.baits, t.contigs)
        assert {r.read_id: tuple(r)[1:] for r in df.collect()} == want


def test_reads_that_fit_a_bin_are_joined_once(spark):
    """Reads that fit a bin join one table by contig and bin; only the branch of long reads joins by read."""
    t = Tables(spark, DATA)
    rows = hybcap._classified(hybcap._reads(t.reads), t.baits, t.contigs, 250)
    first, rest = rows._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter", 1)
    assert "Join" not in first and rest.split("\n")[0].count("bin#") == 2 and "read_id" not in rest.split("\n")[0]


def test_few_intervals_are_sent(spark, monkeypatch):
    """A side of few rows is broadcast, a larger one shuffled, with the same result."""
    t = Tables(spark, DATA)
    spans = t.reads.filter("pos0 IS NOT NULL").select("read_id", "contig", F.col("pos0").alias("a_start"), (F.col("pos0") + 40).alias("a_end"))
    b = t.targets.select("contig", F.col("start0").alias("b_start"), F.col("end0").alias("b_end"))
    found = {}
    for most in (I.MOST_SENT, 3):
        monkeypatch.setattr(I, "MOST_SENT", most)
        df = I.range_join(spans, b, send=True)
        assert ("rightHint=(strategy=broadcast)" in df._jdf.queryExecution().optimizedPlan().toString()) == (most > 3)
        found[most] = sorted(map(tuple, df.select("read_id", "b_start", "b_end").collect()))
        cls = hybcap.bait_classes(t.reads, t.baits, t.contigs)
        found[most, "baits"] = sorted(map(tuple, cls.collect()))
    a, b = [x for k, x in found.items() if not isinstance(k, tuple)], [x for k, x in found.items() if isinstance(k, tuple)]
    assert a[0] == a[1] and b[0] == b[1] and a[0]


def test_limits(spark, monkeypatch):
    t = Tables(spark, DATA)
    with pytest.raises(ValueError):
        coverage.depth_histogram(t.reads, t.ref, coverage_cap=65_536)
    with pytest.raises(SystemExit):
        multi.parser("wgs").parse_args(["-i", "x", "-o", "y", "-r", "z", "--coverage-cap", "65536"])
    assert multi.parser("wgs").parse_args(["-i", "x", "-o", "y", "-r", "z", "--coverage-cap", "65535"])
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            store.shared_dir(spark)


def test_groups_of_any_size(spark):
    """Groups of up to five names come from the one flattening that all share; their sums over the further names are the smaller group's. Too many groups are an error."""
    t = Tables(spark, DATA)
    names = ("cycle", "cycle,strand", "cycle,strand,ref_base,bq,all")
    df = errors.counted(t.reads, t.ref, groups=names)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode(arrays_zip") == 1
    total = {n: {} for n in names}
    for r in df.filter("g > 0").collect():
        key = r.covariate.split(",")[0]
        total[r.stratifier][key] = total[r.stratifier].get(key, 0) + r.total_bases
    assert total[names[0]] == total[names[1]] and sum(total[names[2]].values()) == sum(total[names[0]].values())
    with pytest.raises(ValueError, match="groups"):
        errors.counted(t.reads, t.ref, groups=["bq"] * 127)


def test_mismatches_are_counted_by_batch(spark):
    """Bases are never rows; what a batch holds changes no count; strata are the same by places and by sorting."""
    t = Tables(spark, DATA)
    parts, groups = errors.mismatch_parts(t.reads, t.ref), [("all",), ("read_num", "cycle"), ("context_3bp",)]
    sums = [F.sum(m).alias(m) for m in errors.MEASURES]
    once, few = (sorted(map(tuple, errors.mismatch_counts(parts, groups, ["k0"], bases_at_once=n).groupBy("k0").agg(*sums).collect())) for n in (1 << 19, 50))
    assert once == few and len(once) == 1 + 64 + 64
    assert "posexplode" not in executed(errors.counted(t.reads, t.ref, groups=("cycle",)))
    rng = np.random.default_rng(2)
    a, b, kind = rng.integers(-1, 9, 5000), rng.integers(0, 7, 5000), rng.random(5000) < 0.1
    for wide in (1, 100_000):
        values, counts = errors._strata_of([a * wide, b], [kind])
        got = {(x // wide, y): (n, m) for x, y, n, m in zip(*values, *counts)}
        assert got == {(x, y): (((a == x) & (b == y)).sum(), ((a == x) & (b == y) & kind).sum()) for x in range(9) for y in range(7)}


def test_tables_of_errors_make_only_what_they_hold(spark):
    """The mismatch table meets no mates and reads no events, and each table alone is that of all together."""
    t = Tables(spark, DATA)
    groups = ("read_num,cycle", "hp_len", "context_3bp", "nm", "isize")
    whole = errors.counted(t.reads, t.ref, groups=groups)
    plan = executed(errors.counted(t.reads, t.ref, groups=groups, tables=("mismatch",)))
    assert "Window" not in plan and "SortMergeJoin" not in plan and plan.count("Scan parquet") == 1
    for name, table in (("mismatch", errors.mismatch), ("overlap", errors.overlap), ("indel", errors.indel)):
        alone = errors.counted(t.reads, t.ref, groups=groups, tables=(name,))
        assert table(alone).collect() == table(whole).collect()



def test_bases_are_counted_by_batch(spark):
    """Bases are never rows: counts are those of a plain loop, whatever a batch holds."""
    t = Tables(spark, DATA)
    reads = t.reads.limit(400)
    rows, want = reads.collect(), {}
    for r in rows:
        if not r.flags & (256 | 2048 | 512):
            end = 2 if r.flags & 1 and r.flags & 128 else 1
            for i, (b, q) in enumerate(zip(r.seq, r.quals)):
                key = (end, len(r.seq) - i if r.flags & 16 else i + 1, b, ord(q) - 33)
                want[key] = want.get(key, 0) + 1
    held = spark.createDataFrame(rows, t.reads.schema)
    for n in (1 << 19, 50):
        f = facts.facts(held, ["basic", "gcbias"], bases_at_once=n)
        assert {(r.read_end, r.cycle, r.base, r.bq): r.n for r in facts.base_counts(f).collect()} == want
    assert "explode" not in executed(f)
