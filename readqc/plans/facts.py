"""What several programs need of the reads, from one scan and one aggregation.

A read becomes a few facts (t, a, b, m0..m4): t tells whose row it is, a and b are a key, m0 to m4 numbers to add up. Rows of
all programs are aggregated together, first within the tasks that scan; what leaves them is a row a key, few for all kinds but
STARTS, of which there is one a position at which reads start. All tables of the programs derive from this.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import coverage, simple

BASES, SUMS, MISMATCHES, LENGTHS, NO_CALLS, SIZES, STARTS, CLUSTERS = range(8)
MEASURES = [f"m{i}" for i in range(5)]
ORIENTATIONS = ("FR", "RF", "TANDEM")
#: Programs whose tables derive from facts.
SHARED = ("alignment", "basic", "isize", "gcbias")
_KIND = "array<struct<t:int,a:bigint,b:bigint," + ",".join(f"{m}:bigint" for m in MEASURES) + ">>"


def _row(t: int, a: Column, b: Column, *measures: Column) -> Column:
    """One fact of a kind."""
    given = [F.coalesce(m.cast("long"), F.lit(0)).alias(n) for m, n in zip(measures, MEASURES)]
    return F.struct(F.lit(t).alias("t"), a.cast("long").alias("a"), b.cast("long").alias("b"), *given, *[F.lit(0).cast("long").alias(n) for n in MEASURES[len(given) :]])


def _none() -> Column:
    return F.expr(f"cast(array() as {_KIND})")


def _some(keep: Column, *rows: Column) -> Column:
    return F.when(keep, F.array(*rows)).otherwise(_none())


#: What _base_counts needs of a read: how many of its bases count, the key of its end, its direction, bases and qualities.
_BASES_OF = ("n", "end", "rev", "bases", "quals")


def _basic_columns() -> list[Column]:
    """Of a read: _BASES_OF, without bases unless it is kept."""
    seq, quals = F.coalesce("seq", F.lit("")), F.coalesce("quals", F.lit(""))
    n = F.least(F.length(seq), F.length(quals))
    n = F.when(~X.flag(X.SECONDARY | X.SUPPLEMENTARY) & ~X.flag(X.QC_FAIL), n).otherwise(0)
    end = F.when(X.flag(X.PAIRED) & X.flag(X.LAST), 2).otherwise(1)
    cut = lambda text: F.substr(text, F.lit(1), n)
    return [x.alias(name) for x, name in zip((n.cast("long"), end.cast("long"), X.flag(X.REVERSE).cast("long"), F.upper(cut(seq)), cut(quals)), _BASES_OF, strict=True)]


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of all texts, one after another."""
    _, offsets, data = column.cast(pa.binary()).buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].astype(np.int64)


def _base_counts(part: pa.RecordBatch) -> list[np.ndarray]:
    """(a, b, m0) of some reads: read end and cycle, base and quality, and how often they occur."""
    n, end, rev = (part.column(x).to_numpy() for x in ("n", "end", "rev"))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    bases, quals = (_bytes(part.column(x)) for x in ("bases", "quals"))
    cycle = np.where(rev[row] == 1, n[row] - at, at + 1)
    letters, letter = np.unique(bases, return_inverse=True)
    low = int(quals.min()) if len(quals) else 0
    sizes = [2, int(n.max()) + 1 if len(n) else 1, len(letters), int(quals.max()) - low + 1 if len(quals) else 1]
    key = ((end[row] - 1) * sizes[1] + cycle) * sizes[2] + letter
    key = key * sizes[3] + quals - low
    if math.prod(sizes) <= max(1 << 16, 4 * len(key)):
        counts = np.bincount(key, minlength=1)
        found = np.flatnonzero(counts)
        counts = counts[found]
    else:
        found, counts = np.unique(key, return_counts=True)
    left, q = np.divmod(found, sizes[3])
    left, b = np.divmod(left, sizes[2])
    e, c = np.divmod(left, sizes[1])
    return [(e + 1 << 32) + c, letters[b] * 256 + q + low - 33, counts] if len(found) else [np.zeros(0, np.int64)] * 3


def _alignment_rows(max_insert_size: int = 100_000, min_mapq: int = 20) -> Column:
    """Sums of a primary read by category (0 or 1), its mismatches and length as histogram keys, and its cycles without a call."""
    category = F.when(X.flag(X.PAIRED) & ~X.flag(X.FIRST), 1).otherwise(0)
    one = lambda c: c.cast("long")
    sums = simple.alignment_measures(max_insert_size, min_mapq)
    each = [F.when(keep, one(value)).otherwise(0) for keep, value in sums.values()]
    rows = [_row(SUMS, category, F.lit(i // 5), *each[i : i + 5]) for i in range(0, len(each), 5)]
    hq, pf = simple.high_quality(min_mapq), ~X.flag(X.QC_FAIL)
    more = F.concat(_some(hq, _row(MISMATCHES, category, F.col("_mis"), F.lit(1))), _some(pf, _row(LENGTHS, category, F.length("seq"), F.lit(1))))
    n = F.length("seq")
    cycle = lambda i: F.when(X.flag(X.REVERSE), n - i).otherwise(i + 1)
    calls = F.filter(F.transform(F.split("seq", ""), lambda b, i: F.when(b == "N", _row(NO_CALLS, category, cycle(i), F.lit(1)))), lambda x: x.isNotNull())
    no_calls = F.when(pf & F.col("seq").contains("N"), calls).otherwise(_none())
    return F.when(~X.flag(X.SECONDARY | X.SUPPLEMENTARY), F.concat(F.array(*rows), more, no_calls)).otherwise(_none())


def _size_rows(include_duplicates: bool = False, **_) -> Column:
    kind = X.pair_orientation()
    code = F.array_position(F.array(*map(F.lit, ORIENTATIONS)), kind) - 1
    return _some(F.coalesce(simple.counts_for_size(include_duplicates) & kind.isNotNull(), F.lit(False)), _row(SIZES, code, F.abs(F.col("tlen").cast("long")), F.lit(1)))


def _start_rows(window: int = 100, **rules) -> Column:
    keep, start, cluster, n, nm, q, nq = coverage.gc_measures(window, **rules)
    known = F.col("ref_id").isNotNull() & start.isNotNull()
    return F.concat(_some(keep & known, _row(STARTS, F.col("ref_id"), start, F.lit(1), n, nm, q, nq)), _some(keep, _row(CLUSTERS, F.lit(0), F.lit(0), cluster.cast("int"), F.lit(1))))


_ROWS = {"alignment": _alignment_rows, "isize": _size_rows, "gcbias": _start_rows}


def facts(reads: DataFrame, tools: list[str], options: dict[str, dict] | None = None, bases_at_once: int = 1 << 19) -> DataFrame:
    """(t, a, b, m0..m4) of these programs, lazily: one scan, one exchange. options: arguments of each program.

    A read's few other facts come along with its bases, which are counted in arrays of a batch; each batch is summed by key.
    """
    rows = [_ROWS[t](**(options or {}).get(t, {})) for t in SHARED if t in tools and t != "basic"]
    reads = reads.withColumns(simple.folds()) if "alignment" in tools else reads
    rest = (F.concat(*rows) if len(rows) > 1 else rows[0] if rows else _none()).alias("f")
    names = ["t", "a", "b", *MEASURES]
    own = _basic_columns() if "basic" in tools else []
    counting = bool(own)

    def work(batches):
        for batch in batches:
            table = pa.Table.from_struct_array(batch.column("f").flatten())
            found = table.group_by(["t", "a", "b"], use_threads=False).aggregate([(m, "sum") for m in MEASURES])
            yield from found.select(["t", "a", "b", *(f"{m}_sum" for m in MEASURES)]).rename_columns(names).combine_chunks().to_batches()
            ends, lo = np.cumsum(batch.column("n").to_numpy()) if counting else (), 0
            while counting and lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + bases_at_once, "right")))
                a, b, n = _base_counts(batch.slice(lo, hi - lo))
                lo = hi
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), BASES, np.int32)), *(pa.array(x.astype(np.int64)) for x in (a, b, n)), *[pa.array(np.zeros(len(n), np.int64))] * (len(MEASURES) - 1)], names=names)

    each = reads.select(rest, *own).mapInArrow(work, "t int, " + ", ".join(f"{n} long" for n in names[1:]))
    return each.groupBy("t", "a", "b").agg(*[F.sum(m).alias(m) for m in MEASURES])


def base_counts(f: DataFrame) -> DataFrame:
    """(read_end, cycle, base, bq, n)."""
    rows = f.filter(F.col("t") == BASES)
    return rows.select(F.shiftright("a", 32).alias("read_end"), F.col("a").bitwiseAND(0xFFFFFFFF).alias("cycle"), F.chr(F.shiftright("b", 8)).alias("base"), F.col("b").bitwiseAND(255).cast("int").alias("bq"), F.col("m0").alias("n"))


def size_counts(f: DataFrame) -> DataFrame:
    """(pair_orientation, insert_size, n)."""
    return f.filter(F.col("t") == SIZES).select(F.element_at(F.array(*map(F.lit, ORIENTATIONS)), (F.col("a") + 1).cast("int")).alias("pair_orientation"), F.col("b").alias("insert_size"), F.col("m0").alias("n"))


def start_counts(f: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig, start0, starts, n, nm, q, nq)."""
    rows = f.filter(F.col("t") == STARTS).join(F.broadcast(contigs.select("ref_id", "contig")), F.col("a") == F.col("ref_id"))  # one row a contig
    return rows.select("contig", F.col("b").alias("start0"), *[F.col(m).alias(n) for m, n in zip(MEASURES, ("starts", "n", "nm", "q", "nq"), strict=True)])


def cluster_counts(f: DataFrame) -> DataFrame:
    """(total_clusters, aligned_reads), one row."""
    rows = f.filter(F.col("t") == CLUSTERS)
    return rows.agg(F.coalesce(F.sum("m0"), F.lit(0)).alias("total_clusters"), F.coalesce(F.sum("m1"), F.lit(0)).alias("aligned_reads"))
