"""Column expressions over reads: flags, CIGAR folds, orientation, cycles, quality scores.

A CIGAR is array<struct<op:string,len:int>>; qualities are Phred+33 text. All are built-in expressions, so they stay in
whole-stage code; folds are higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 1, 2, 4, 8, 16, 32
FIRST, LAST, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 64, 128, 256, 512, 1024, 2048


def flag(mask: int, col: str = "flags") -> Column:
    return F.col(col).bitwiseAND(mask) != 0


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; 0 where b is 0, null or not finite."""
    b = b.cast("double")
    return F.when((b == 0) | b.isNull() | F.isnan(b) | (F.abs(b) == float("inf")), F.lit(0.0)).otherwise(a.cast("double") / b)


def parse_cigar(text: str = "cigar") -> Column:
    """CIGAR text to operations; * and null give an empty array, an unknown operation an error."""
    c = F.col(text)
    bad = F.when(c.isNotNull() & ~c.rlike(r"^(\*|([0-9]+[MIDNSHP=X])+)$"), F.raise_error(F.concat(F.lit("invalid CIGAR: "), c)))
    ops = F.transform(
        F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)),
        lambda x: F.struct(F.substr(x, F.length(x)).alias("op"), F.substr(x, F.lit(1), F.length(x) - 1).cast("int").alias("len")),
    )
    return F.when(bad.isNull(), ops)


def op_sum(ops: str) -> Column:
    """Total length of the given operations."""
    return F.expr(f"aggregate(cigar, 0L, (s, o) -> s + if(instr('{ops}', o.op) > 0, o.len, 0))")


def op_count(ops: str) -> Column:
    return F.expr(f"size(filter(cigar, o -> instr('{ops}', o.op) > 0))")


def reference_span() -> Column:
    return op_sum("MDN=X")


def alignment_end() -> Column:
    """Exclusive 0-based end (the 1-based inclusive end); null if unmapped or without span."""
    return F.when(~flag(UNMAPPED) & (reference_span() > 0), F.col("pos0") + reference_span())


def aligned_bases() -> Column:
    return op_sum("M=X")


#: array<struct<ref_off, read_off, len>>, one for each operation M, = or X.
AS_BLOCKS = (
    "aggregate(cigar, named_struct('r', 0, 'q', 0, 'b', cast(array() as array<struct<ref_off:int,read_off:int,len:int>>)), (s, o) -> named_struct("
    "'r', s.r + if(instr('MDN=X', o.op) > 0, o.len, 0), 'q', s.q + if(instr('MIS=X', o.op) > 0, o.len, 0),"
    "'b', if(instr('M=X', o.op) > 0, concat(s.b, array(named_struct('ref_off', s.r, 'read_off', s.q, 'len', o.len))), s.b)), s -> s.b)"
)


def aligned_blocks() -> Column:
    return F.expr(AS_BLOCKS)


def indel_events() -> Column:
    """array<struct<op, ref_off, read_off, len, anchor_ref, anchor_read>>; the anchor is the last aligned base before it, so an event without one is absent."""
    return F.expr(
        "aggregate(cigar, named_struct('r', 0, 'q', 0, 'ar', -1, 'aq', -1, 'b', cast(array() as array<struct<op:string,ref_off:int,read_off:int,len:int,anchor_ref:int,anchor_read:int>>)), (s, o) -> named_struct("
        "'r', s.r + if(instr('MDN=X', o.op) > 0, o.len, 0), 'q', s.q + if(instr('MIS=X', o.op) > 0, o.len, 0),"
        "'ar', if(instr('M=X', o.op) > 0, s.r + o.len - 1, s.ar), 'aq', if(instr('M=X', o.op) > 0, s.q + o.len - 1, s.aq),"
        "'b', if(instr('ID', o.op) > 0 and s.aq >= 0, concat(s.b, array(named_struct('op', o.op, 'ref_off', s.r, 'read_off', s.q, 'len', o.len, 'anchor_ref', s.ar, 'anchor_read', s.aq))), s.b)), s -> s.b)"
    )


def three_prime_clip() -> Column:
    """Soft-clipped bases at the sequencing end: before the first operation other than S, H, N, P if reverse, after it if forward."""
    return F.expr(
        "aggregate(cigar, named_struct('seen', false, 'lead', 0L, 'trail', 0L), (s, o) -> named_struct('seen', s.seen or instr('MID=X', o.op) > 0,"
        f"'lead', s.lead + if(o.op = 'S' and not s.seen, o.len, 0), 'trail', s.trail + if(o.op = 'S' and s.seen, o.len, 0)), s -> if(flags & {REVERSE} != 0, s.lead, s.trail))"
    )


def q20_bases(least: int = 20, of: str = "blocks") -> Column:
    """Aligned bases of at least this quality; of: the aligned blocks, by default a column."""
    low = chr(33 + least - 1)
    return F.expr(f"aggregate({of}, 0L, (s, b) -> s + length(translate(substr(quals, b.read_off + 1, b.len), '" + "".join(chr(i) for i in range(33, ord(low) + 1)).replace("\\", "\\\\").replace("'", "\\'") + "', '')))")


def passing(quals: Column, length: Column, least: int) -> Column:
    """Text of one character a base: 1 if its quality is at least ``least``, else 0; 0 beyond the qualities."""
    scores = range(33, 127)
    marks = F.translate(quals, "".join(map(chr, scores)), "".join("1" if c - 33 >= least else "0" for c in scores))
    return F.rpad(F.coalesce(marks, F.lit("")), length, F.lit("0"))


def aligned_to(text: str, blank: str, mate: str = "mate") -> Column:
    """A mate's text (a character a base) laid along a block (at, len) by reference position; blank where the mate has no base.

    mate has pos0 and blocks; its text is as long as its bases.
    """
    begin, end = f"greatest({mate}.pos0 + m.ref_off, at)", f"least({mate}.pos0 + m.ref_off + m.len, at + len)"
    piece = f"substr({text}, cast(m.read_off + {begin} - {mate}.pos0 - m.ref_off + 1 as int), cast({end} - {begin} as int))"
    laid = f"aggregate({mate}.blocks, repeat('{blank}', len), (s, m) -> if({end} > {begin}, overlay(s placing {piece} from cast({begin} - at + 1 as int)), s))"
    return F.expr(f"if({mate} is null or {mate}.pos0 >= at + len, '', {laid})")


def ones(marks: Column) -> Column:
    return F.length(F.translate(marks, "0", ""))


def pair_orientation() -> Column:
    """FR, RF or TANDEM; null unless paired, both mapped and on one reference."""
    reverse, mate_reverse = flag(REVERSE), flag(MATE_REVERSE)
    pos = F.when(reverse, F.col("mate_pos0") + 1).otherwise(F.col("pos0") + 1)
    neg = F.when(reverse, alignment_end()).otherwise(F.col("pos0") + 1 + F.col("tlen"))
    kind = F.when(reverse == mate_reverse, "TANDEM").when(pos < neg, "FR").otherwise("RF")
    return F.when(flag(PAIRED) & ~flag(UNMAPPED) & ~flag(MATE_UNMAPPED) & (F.col("ref_id") == F.col("mate_ref_id")), kind)


def chimeric(max_insert: int) -> Column:
    kind = pair_orientation()
    return (F.col("ref_id") != F.col("mate_ref_id")) | (F.abs(F.col("tlen").cast("long")) > max_insert) | (F.coalesce(kind, F.lit("FR")) != "FR") | F.col("has_sa")


def mate_clip() -> Column:
    """Reference position from which the left read of an overlapping pair is clipped: the mate's start; at equal starts the second of pair is clipped."""
    both = flag(PAIRED) & ~flag(UNMAPPED) & ~flag(MATE_UNMAPPED) & (F.col("ref_id") == F.col("mate_ref_id"))
    left = (F.col("pos0") < F.col("mate_pos0")) | ((F.col("pos0") == F.col("mate_pos0")) & flag(LAST))
    return F.when(both & left & (F.col("mate_pos0") < alignment_end()), F.col("mate_pos0"))


def adjusted_mismatches() -> Column:
    """NM, not below 0, without inserted and deleted bases."""
    return F.greatest(F.lit(0), F.greatest(F.coalesce("nm", F.lit(0)), F.lit(0)) - op_sum("ID"))


def gc_percent(seq: Column) -> Column:
    n = F.length(seq)
    gc = n - F.length(F.translate(F.upper(seq), "GC", ""))
    return F.when(n > 0, F.floor((gc * 100 + F.floor(n / 2)) / n).cast("long"))


def complement(base: Column) -> Column:
    out = F.translate(base, "ACGT", "TGCA")
    return F.when(base.isin("A", "C", "G", "T"), out).otherwise(F.when(base.isNotNull(), "N"))


def q_score(errors: Column, total: Column) -> Column:
    """Phred score of an error rate: 0 without observations, at most 99."""
    q = F.least(F.lit(99.0), F.lit(-10.0) * F.log10(errors.cast("double") / total.cast("double")))
    return F.when(total == 0, 0.0).when(errors == 0, 99.0).otherwise(q)


def homopolymer(seq: Column, off: Column, reverse: Column) -> Column:
    """Length of the run of equal bases just before a base, in sequencing direction; 0 at the edge of the read."""
    before = F.substr(seq, F.lit(1), off)
    after = F.substr(seq, off + 2)
    last, first = F.substr(before, F.length(before)), F.substr(after, F.lit(1), F.lit(1))
    left = F.length(before) - F.length(F.rtrim(before, last))
    right = F.length(after) - F.length(F.ltrim(after, first))
    return F.when(reverse, F.when(F.length(after) > 0, right).otherwise(0)).otherwise(F.when(F.length(before) > 0, left).otherwise(0))
