"""Mismatch, overlap and indel rates by stratifier.

Covariates are small numbers until the end. Mates meet a read at a time, in one shuffle by fragment, and the mate's bases
are laid along the read's blocks; blocks, not bases, are shuffled to the pieces of the reference, on whose text masked
positions are marked. What no table or group asks for is not made: without the overlap table nothing meets its mate. Only then are blocks flattened, in arrays of numbers that lie side by side: bases, their neighbours, runs
of equal bases, qualities, reference and mate of a batch of blocks. Each batch counts the strata of every group under a packed
key, so bases are never rows: what leaves a task is a row a stratum and batch, which Spark adds up.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import expressions as X
from ..operators import bases, intervals as I
from .coverage import fragment_key

R = X.ratio
# The stratifiers and the default groups.
STRATIFIERS = ("all", "bq", "mapq", "cycle", "read_num", "strand", "pair_orientation", "isize", "gc", "read_base", "ref_base", "hp_len", "pre_dinuc", "post_dinuc", "context_3bp", "nm", "indel_len")
DEFAULT_GROUPS = ("bq", "isize", "gc", "strand", "pair_orientation", "hp_len", "cycle", "read_num", "read_num,cycle", "read_num,hp_len", "read_num,gc", "read_num,pre_dinuc", "mapq", "nm", "context_3bp")
ORIENTATIONS = ("f1r2", "f2r1", "tandem")
SHIFT = 28  # bits of a covariate in a packed key
MOST_GROUPS = 127  # what is left of a key for the group's number

def parse_groups(groups=DEFAULT_GROUPS) -> list[tuple[str, ...]]:
    """all first and once; other groups in order."""
    out = [("all",)]
    for g in groups:
        names = tuple(x.strip() for x in g.split(","))
        if bad := [x for x in names if x not in STRATIFIERS]:
            raise ValueError(f"unknown stratifier: {', '.join(bad)}")
        if names != ("all",):
            out.append(names)
    return out


def _read_columns(reads: DataFrame, max_isize: int) -> DataFrame:
    """Covariates of a read as numbers, and its bases between two blanks (seen)."""
    first, rev = X.flag(X.FIRST), X.flag(X.REVERSE)
    kind = X.pair_orientation()
    orient = F.when(kind == "TANDEM", 2).when((kind == "FR") == (first == rev), 1).otherwise(F.when(kind.isNotNull(), 0))
    isize = F.when(X.flag(X.PAIRED), F.abs(F.col("tlen").cast("long"))).otherwise(0)
    return reads.withColumns({
        "read_num": F.when(X.flag(X.PAIRED), F.when(first, 1).otherwise(2)), "strand": F.when(rev, 1).otherwise(0), "pair_orientation": orient, "isize": F.when(isize <= max_isize, isize).cast("int"),
        "gc": X.gc_percent(F.col("seq")).cast("int"), "reverse": rev, "nm0": F.when(F.col("nm") >= 0, F.col("nm")).cast("int"), "frag": fragment_key(), "seen": F.concat(F.lit(" "), F.upper("seq"), F.lit(" ")),
    })


def kept_reads(reads: DataFrame, min_mapq: int = 20, include_duplicates: bool = False, max_isize: int = 1000) -> DataFrame:
    keep = ~X.flag(X.UNMAPPED) & ~X.flag(X.SECONDARY | X.SUPPLEMENTARY) & ~X.flag(X.QC_FAIL) & (F.coalesce("mapq", F.lit(0)) >= min_mapq)
    if not include_duplicates:
        keep &= ~X.flag(X.DUPLICATE)
    return _read_columns(reads.filter(keep), max_isize)


_READ = ["mapq", "read_num", "strand", "pair_orientation", "isize", "gc", "reverse", "nm0"]


def _read_names(names) -> list[str]:
    """The columns of a read that these covariates need; the direction always."""
    return [x for x in _READ if x == "reverse" or x in names or (x == "nm0" and "nm" in names)]


def _merged(df: DataFrame) -> DataFrame:
    return I.merge(df).select("contig", F.col("start0").alias("b_start"), F.col("end0").alias("b_end"))


def _inside(flat: DataFrame, intervals: DataFrame | None) -> DataFrame:
    """Rows at positions inside the intervals."""
    if intervals is None:
        return flat
    points = flat.withColumn("a_start", F.col("ref_pos")).withColumn("a_end", F.col("ref_pos") + 1)
    return I.range_join(points, _merged(intervals)).drop("a_start", "a_end", "b_start", "b_end")


def _code(base: Column, flip: Column | None = None) -> Column:
    """0 to 3 for A, C, G, T, and from 3 to 0 where flip holds; null for anything else."""
    at = F.instr(F.lit("ACGT"), base) - 1
    return F.when((at >= 0) & (F.length(base) == 1), at if flip is None else F.when(flip, 3 - at).otherwise(at))


def _own_columns(rows: DataFrame) -> DataFrame:
    """Covariates that a base at read_off of seen has of its own, in sequencing direction: cycle, read_base, hp_len, before and after."""
    rev, off, n = F.col("reverse"), F.col("read_off"), F.length("seen") - 2
    at = lambda i: F.substr("seen", (off + i + 2).cast("int"), F.lit(1))
    return rows.withColumns({
        "cycle": F.when(rev, n - off).otherwise(off + 1).cast("int"), "read_base": _code(at(0), rev), "before": _code(F.when(rev, at(1)).otherwise(at(-1)), rev), "after": _code(F.when(rev, at(-1)).otherwise(at(1)), rev),
        "hp_len": X.homopolymer(F.substr("seen", F.lit(2), n), off.cast("int"), rev).cast("int"),
    }).drop("seen", "read_off")


def _with_reference_codes(rows: DataFrame, ref_base: Column) -> DataFrame:
    rows = rows.withColumn("ref_base", _code(ref_base, F.col("reverse")))
    r = F.col("ref_base")
    return rows.withColumns({"pre_dinuc": F.col("before") * 4 + r, "post_dinuc": F.col("after") * 4 + r, "context_3bp": (F.col("before") * 4 + r) * 4 + F.col("after"), "all": F.lit(0)}).drop("before", "after", "reverse")


def mismatch_parts(reads: DataFrame, ref: DataFrame, intervals=None, mask=None, names=STRATIFIERS, mates: bool = True, **rules) -> DataFrame:
    """Blocks cut at the reference's pieces, with the read's covariates that the names ask for; own: their bases and the one on either side; up and down (for hp_len): the runs of equal bases that end before them and begin after them. Without mates no read is shuffled to its mate."""
    kept = kept_reads(reads, **rules).withColumn("blocks", X.aligned_blocks())
    of_read, laid = _read_names(names), []
    if mates:
        n = X.op_sum("MIS=X").cast("int")
        other = F.struct("pos0", "blocks", F.rpad(F.upper("seq"), F.col("n"), F.lit(" ")).alias("bases"), F.rpad("quals", F.col("n"), F.lit("!")).alias("quals"))
        by = W.partitionBy("frag", "contig").orderBy("read_id")
        kept = kept.withColumn("n", n).select(*of_read, "contig", "pos0", "seen", "quals", "blocks", F.coalesce(F.lag(other).over(by), F.lead(other).over(by)).alias("mate"))
        laid = [X.aligned_to("mate.bases", " ").alias("mate_bases"), X.aligned_to("mate.quals", "!").alias("mate_quals")]
    mate = ["mate"] if mates else []
    flat = kept.select(*of_read, "contig", "pos0", "seen", "quals", *mate, F.explode_outer("blocks").alias("b"))  # outer: no filter that folds the CIGAR again; blocks without len are left out below
    flat = flat.select(*of_read, "contig", (F.col("pos0") + F.col("b.ref_off")).alias("at"), F.col("b.len").alias("len"), F.col("b.read_off").alias("off"), "seen", *mate, F.expr("substr(quals, b.read_off + 1, b.len)").alias("bqs"))
    flat = flat.select(*of_read, "contig", "at", "off", "len", "seen", "bqs", *laid)
    spans = flat.filter("len > 0").withColumns({"start": F.col("at"), "end": F.col("at") + F.col("len")})
    size = bases.piece_size(ref)
    if intervals is not None or mask is not None:
        ref = bases.marked_pieces(ref, intervals, mask).select("contig", "start0", F.col("open").alias("seq"))
    c = F.col
    skip, n = (c("start") - c("at")).cast("int"), (c("end") - c("start")).cast("int")
    parts = bases.with_pieces(spans, ref, size).withColumns({"skip": skip, "n": n, "first": c("off") + skip, "r": F.substr("piece", (c("start") - c("piece_start") + 1).cast("int"), n)})
    if intervals is not None or mask is not None:
        parts = parts.filter(F.length(F.translate("r", f"N{bases.CLOSED}", "")) > 0)
    inner, along = F.substr("seen", F.lit(2), F.length("seen") - 2), lambda text: F.substr(text, c("skip") + 1, c("n"))
    up, down = X.homopolymer(inner, c("first"), F.lit(False)), X.homopolymer(inner, c("first") + c("n") - 1, F.lit(True))
    numbers = [F.coalesce(c(x).cast("int"), F.lit(-1)).alias(x) for x in of_read]
    runs = [up.cast("int").alias("up"), down.cast("int").alias("down")] if "hp_len" in names else []
    theirs = [along(c("mate_bases")).alias("mb"), along(c("mate_quals")).alias("mq")] if mates else []
    return parts.select(*numbers, "first", "n", (F.length("seen") - 2).alias("size"), *runs, F.substr("seen", c("first") + 1, c("n") + 2).alias("own"), "r", along(c("bqs")).alias("q"), *theirs)


_CODES = np.full(256, -1, np.int64)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def _bases_of(part: pa.RecordBatch, min_bq: int, names=STRATIFIERS) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """Of the counted bases of some parts: the covariates that are named, -1 for null, and which ones are errors, and, with mates, overlap, and are mismatches of each kind. All arrays lie side by side."""
    number = {x: part.column(x).to_numpy().astype(np.int64) for x in (*_READ, "first", "n", "size", "up", "down") if x in part.schema.names}
    n = number["n"]
    row = np.repeat(np.arange(len(n)), n)
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def text(name):
        column = part.column(name).fill_null("").cast(pa.binary())
        starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        return starts, np.append(np.frombuffer(column.buffers()[2] or b"", np.uint8), np.uint8(0))

    def at(starts, data, by):
        """The character at i + by of each text; 0 beyond its end."""
        where = starts[:-1][row] + i + by
        return np.where(where < starts[1:][row], where, len(data) - 1)

    score = lambda t, x: np.where(x == len(t[1]) - 1, -1, t[1][x].astype(np.int64) - 33)
    own, r, q = (text(x) for x in ("own", "r", "q"))
    here = at(*own, 1)
    b, under, bq = own[1][here], r[1][at(*r, 0)], score(q, at(*q, 0))
    # From here on only of the bases that count.
    kept = np.flatnonzero(((bq == -1) | (bq >= min_bq)) & (_CODES[b] >= 0) & (_CODES[under] >= 0))
    row, i, here, b, under, bq = (x[kept] for x in (row, i, here, b, under, bq))
    of = lambda x: number[x][row]
    rev = of("reverse") == 1
    code = lambda x: np.where(rev & (_CODES[x] >= 0), 3 - _CODES[x], _CODES[x])
    base, ref = code(b), code(under)
    error, off = base != ref, of("first") + i

    def beside() -> tuple[np.ndarray, np.ndarray]:
        low, high = (own[1][at(*own, k)] for k in (0, 2))
        return code(np.where(rev, high, low)), code(np.where(rev, low, high))

    def run() -> np.ndarray:
        """The run of equal bases before each; those that reach a text's end go on in the read."""
        starts, data = own
        places = np.arange(len(data))
        new = np.ones(len(data), bool)
        new[1:] = data[1:] != data[:-1]
        new[starts] = True
        first = np.maximum.accumulate(np.where(new, places, 0))
        last = np.minimum.accumulate(np.where(np.append(new[1:], True), places, len(data))[::-1])[::-1]
        left, right = np.maximum(here - 1, 0), np.minimum(here + 1, len(data) - 1)
        up = left - first[left] + 1 + np.where(first[left] == starts[:-1][row], of("up") - 1, 0)
        down = last[right] - right + 1 + np.where(last[right] == starts[1:][row] - 1, of("down") - 1, 0)
        return np.where(rev, down, up)

    before, after = beside() if {"pre_dinuc", "post_dinuc", "context_3bp"} & set(names) else (None, None)
    zero = lambda: np.zeros(len(i), np.int64)
    made = {
        "all": zero, "bq": lambda: bq, "cycle": lambda: np.where(rev, of("size") - off, off + 1), "read_base": lambda: base, "ref_base": lambda: ref, "hp_len": run, "pre_dinuc": lambda: np.where(before < 0, -1, before * 4 + ref), "post_dinuc": lambda: np.where(after < 0, -1, after * 4 + ref),
        "context_3bp": lambda: np.where((before < 0) | (after < 0), -1, (before * 4 + ref) * 4 + after), "nm": lambda: np.maximum(of("nm0") - error, 0), "indel_len": zero,
    }
    out = {x: made[x]() if x in made else of(x) for x in names}
    if "mb" not in part.schema.names:
        return out, [error]
    mb, mq = text("mb"), text("mq")
    mate = np.where(score(mq, at(*mq, 0)) >= min_bq, code(mb[1][at(*mb, 0)]), -1)
    met = mate >= 0
    wrong = met & error
    return out, [error, met, wrong & (mate == ref), wrong & (mate == base), wrong & (mate != ref) & (mate != base)]


def _strata_of(covariates: list[np.ndarray], kinds: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The strata of one group that occur, a value a covariate, and the counts of each: bases and those of each kind. A base without a covariate has no stratum."""
    known = np.logical_and.reduce([x >= 0 for x in covariates])
    if not known.all():
        covariates, kinds = [x[known] for x in covariates], [x[known] for x in kinds]
    sizes = [int(x.max()) + 1 if len(x) else 1 for x in covariates]
    key = np.zeros(len(covariates[0]), np.int64)
    for x, size in zip(covariates, sizes, strict=True):
        key = key * size + x
    strata, total = None, math.prod(sizes)
    if total > max(1 << 16, 4 * len(key)):
        strata, key = np.unique(key, return_inverse=True)
        total = len(strata)
    counts = [np.bincount(key, minlength=total), *(np.bincount(key[x], minlength=total) for x in kinds)]
    found = np.flatnonzero(counts[0])
    left, values = found if strata is None else strata[found], []
    for size in sizes[::-1]:
        values.append(left % size)
        left = left // size
    return values[::-1], [x[found] for x in counts]


def mismatch_counts(parts: DataFrame, groups: list[tuple[str, ...]], keys: list[str], min_bq: int = 20, bases_at_once: int = 1 << 19) -> DataFrame:
    """(keys, measures) of mismatch_parts: the counted bases of every stratum, summed within the batches of each task."""
    names, used = [*keys, *MEASURES], sorted({x for g in groups for x in g})

    def work(batches):
        for batch in batches:
            ends, lo = np.cumsum(batch.column("n").to_numpy().astype(np.int64)), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + bases_at_once, "right")))
                covariates, kinds = _bases_of(batch.slice(lo, hi - lo), min_bq, used)
                lo = hi
                for i, g in enumerate(groups):
                    values, counts = _strata_of([covariates[x] for x in g], kinds)
                    values += [np.zeros(len(counts[0]), np.int64)] * (2 * len(keys) - len(g))
                    packed = [(values[2 * j] << SHIFT) + values[2 * j + 1] for j in range(len(keys))]
                    packed[0] = packed[0] + (i << 2 * SHIFT)
                    counts += [np.zeros(len(counts[0]), np.int64)] * (len(MEASURES) - len(counts))
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (*packed, *counts)], names=names)

    return parts.mapInArrow(work, ", ".join(f"{n} long" for n in names))


def indel_rows(reads: DataFrame, ref: DataFrame, min_bq: int = 20, intervals=None, mask=None, **rules) -> DataFrame:
    """One row for each counted insertion or deletion with the covariates of its anchor."""
    kept = kept_reads(reads, **rules)
    ev = kept.select(*_READ, "read_id", "seen", "contig", "pos0", "quals", F.explode(X.indel_events()).alias("e")).select(*_READ, "read_id", "seen", "contig", "quals", "e.*", (F.col("pos0") + F.col("e.anchor_ref")).alias("ref_pos"))
    q = lambda i: F.substr("quals", (i + 1).cast("int"), F.lit(1))
    score = lambda i: F.when(F.length(q(i)) > 0, F.ascii(q(i)) - 33)
    ev = ev.withColumns({"bq": score(F.col("anchor_read")), "first": F.coalesce(score(F.col("read_off")), F.lit(0)), "read_off": F.col("anchor_read")}).drop("quals")
    ev = _own_columns(ev).filter((F.col("op") == "D") | (F.col("first") >= min_bq))
    size = bases.piece_size(ref)
    if intervals is None and mask is None:
        out = bases.with_reference(ev, ref, size)
    else:
        marked = bases.marked_pieces(ref, None, mask)
        ev = bases.with_reference(_inside(ev, intervals), marked, size)
        ins = ev.filter((F.col("op") == "I") & ~F.col("open_base").eqNullSafe(F.lit(bases.CLOSED)))
        dels = ev.filter("op = 'D'")  # a deletion stays unless every deleted position is masked or outside
        gone = dels.select("read_id", "ref_pos", "contig", (F.col("ref_pos") + 1).alias("start"), (F.col("ref_pos") + 1 + F.col("len")).alias("end"))
        under = bases.with_pieces(gone, bases.marked_pieces(ref, intervals, mask).select("contig", "start0", F.col("open").alias("seq")), size)
        left = F.length(F.translate(F.substr("piece", (F.col("start") - F.col("piece_start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), bases.CLOSED, ""))
        out = ins.unionByName(dels.join(under.filter(left > 0).select("read_id", "ref_pos", "contig").distinct(), ["read_id", "ref_pos", "contig"], "left_semi"))
    return _with_reference_codes(out, F.coalesce("ref_base", F.lit(""))).withColumns({"nm": F.col("nm0"), "indel_len": F.col("len")})


MEASURES = ("total_bases", "error_bases", "overlapping_read_bases", "bases_mismatching_ref_and_mate", "bases_matching_mate_but_not_ref", "bases_in_three_way_disagreement", "num_insertions", "num_inserted_bases", "num_deletions", "num_deleted_bases")


def _text(name: str, code: Column) -> Column:
    """The text of a covariate's number."""
    letter = lambda c: F.substr(F.lit("ACGT"), (c + 1).cast("int"), F.lit(1))
    if name == "all":
        return F.lit("all")
    if name == "read_num":
        return F.concat(F.lit("R"), code.cast("string"))
    if name == "strand":
        return F.when(code == 1, "-").otherwise("+")
    if name == "pair_orientation":
        return F.element_at(F.array(*map(F.lit, ORIENTATIONS)), (code + 1).cast("int"))
    if name in ("read_base", "ref_base"):
        return letter(code)
    if name in ("pre_dinuc", "post_dinuc"):
        return F.concat(letter(F.floor(code / 4)), letter(code % 4))
    if name == "context_3bp":
        return F.concat(letter(F.floor(code / 16)), letter(F.floor(code / 4) % 4), letter(code % 4))
    return code.cast("string")


def counted(reads: DataFrame, ref: DataFrame, groups=DEFAULT_GROUPS, tables=("mismatch", "overlap", "indel"), **options) -> DataFrame:
    """(g, stratifier, covariate, measures): all groups from one flattening.

    Measures that only tables other than the named ones hold are 0, strata that only those have are absent: reads meet their mates for overlap alone, and events are read for indel alone.

    A key is the group's number and its covariates, packed two to a number; the numbers of a key are as many as the largest
    group asks for, one for groups of up to two names.
    """
    parsed = parse_groups(groups)
    if len(parsed) > MOST_GROUPS:
        raise ValueError(f"at most {MOST_GROUPS - 1} groups besides all")
    names = sorted({x for g in parsed for x in g})
    zero = {m: F.lit(0).cast("long") for m in MEASURES}
    c = F.col
    one = lambda x: F.when(x, 1).otherwise(0).cast("long")
    ins = c("op") == "I"
    b = "indel" in tables and indel_rows(reads, ref, **options).select(*names, *[v.alias(k) for k, v in {**zero, "num_insertions": one(ins), "num_inserted_bases": F.when(ins, c("len")).otherwise(0).cast("long"), "num_deletions": one(~ins), "num_deleted_bases": F.when(~ins, c("len")).otherwise(0).cast("long")}.items()])
    sums = [F.sum(m).alias(m) for m in MEASURES]
    keys = [f"k{j}" for j in range((max(map(len, parsed)) + 1) // 2)]
    long = lambda n: c(n).cast("long")

    def packed(i: int, g: tuple[str, ...]) -> Column:
        """The numbers of a base's or event's key in a group; null where a covariate is."""
        two = [F.shiftleft(long(g[j]), SHIFT) + (long(g[j + 1]) if j + 1 < len(g) else F.lit(0)) if j < len(g) else F.lit(0).cast("long") for j in range(0, 2 * len(keys), 2)]
        two[0] = two[0] + F.shiftleft(F.lit(i).cast("long"), 2 * SHIFT)
        known = c(g[0]).isNotNull()
        for n in g[1:]:
            known &= c(n).isNotNull()
        return two[0] if len(keys) == 1 else F.when(known, F.struct(*[x.alias(k) for x, k in zip(two, keys, strict=True)]))

    def keyed(rows: DataFrame) -> DataFrame:
        each = rows.select(F.explode(F.array(*[packed(i, g) for i, g in enumerate(parsed)])).alias("k0"), *MEASURES).filter("k0 IS NOT NULL")
        each = each if len(keys) == 1 else each.select("k0.*", *MEASURES)
        return each.groupBy(*keys).agg(*sums)

    parts = mismatch_parts(reads, ref, names=names, mates="overlap" in tables, **{k: v for k, v in options.items() if k != "min_bq"})
    found = mismatch_counts(parts, parsed, keys, options.get("min_bq", 20))
    rows = (found.union(keyed(b)) if "indel" in tables else found).groupBy(*keys).agg(*sums)
    mask = (1 << SHIFT) - 1
    code = lambda j: (c(keys[j // 2]) if j % 2 else F.shiftright(keys[j // 2], SHIFT)).bitwiseAND(mask)
    g_of = F.shiftright("k0", 2 * SHIFT)
    text, name = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for i, g in enumerate(parsed):
        text, name = text.when(g_of == i, F.concat_ws(",", *[_text(n, code(j)) for j, n in enumerate(g)])), name.when(g_of == i, ",".join(g))
    return rows.select(g_of.cast("int").alias("g"), name.alias("stratifier"), text.alias("covariate"), *MEASURES)


def mismatch(counts: DataFrame) -> DataFrame:
    t, e = F.col("total_bases"), F.col("error_bases")
    return counts.filter("total_bases > 0").orderBy("g", "covariate").select("stratifier", "covariate", "total_bases", "error_bases", R(e, t).alias("frac_error"), X.q_score(e, t).alias("q_score"))


def overlap(counts: DataFrame) -> DataFrame:
    names = MEASURES[3:6]
    q = [X.q_score(F.col(n), F.col("overlapping_read_bases")).alias(a) for n, a in zip(names, ("q_mismatching_ref_and_mate", "q_matching_mate_but_not_ref", "q_three_way_disagreement"), strict=True)]
    return counts.filter("overlapping_read_bases > 0").orderBy("g", "covariate").select("stratifier", "covariate", "overlapping_read_bases", *names, *q)


def indel(counts: DataFrame) -> DataFrame:
    ev, t = F.col("num_insertions") + F.col("num_deletions"), F.col("total_bases")
    return counts.filter(t + ev > 0).orderBy("g", "covariate").select("stratifier", "covariate", "total_bases", *MEASURES[6:], R(ev, F.greatest(t, F.lit(1))).alias("frac_indel_error"), X.q_score(ev, t).alias("q_score"))
