"""Reads flattened to bases, and lookups of reference bases.

Columns that hold for a whole read are made before the flattening, and only those named in ``keep`` are carried along.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import intervals as I

CHUNK = 4096


def blocks(reads: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each aligned block: keep, contig, block_start (reference), read_off, len, and the block's bases and qualities."""
    flat = reads.select(*keep, "contig", "pos0", "seq", "quals", F.explode(X.aligned_blocks()).alias("b"))
    return flat.select(
        *keep, "contig", (F.col("pos0") + F.col("b.ref_off")).alias("block_start"), F.col("b.read_off").alias("read_off"), F.col("b.len").alias("len"),
        F.expr("substr(seq, b.read_off + 1, b.len)").alias("bases"), F.expr("substr(quals, b.read_off + 1, b.len)").alias("bqs"),
    )


def aligned(reads: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each aligned base: keep, contig, ref_pos, read_off, base, bq (null beyond the qualities)."""
    flat = blocks(reads, keep).select(*keep, "contig", "block_start", "read_off", "bases", "bqs", F.explode(F.expr("sequence(0, len - 1)")).alias("i"))
    q = F.substr("bqs", F.col("i") + 1, F.lit(1))
    return flat.select(
        *keep, "contig", (F.col("block_start") + F.col("i")).alias("ref_pos"), (F.col("read_off") + F.col("i")).alias("read_off"),
        F.substr("bases", F.col("i") + 1, F.lit(1)).alias("base"), F.when(F.length(q) > 0, F.ascii(q) - 33).alias("bq"),
    )


def reference_bases(ref: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row a reference position: contig, ref_pos, ref_base (upper case). ref: (contig, start0, seq) pieces without overlap."""
    return ref.select("contig", "start0", F.posexplode(F.split(F.upper("seq"), "")).alias("i", "ref_base")).filter("ref_base <> ''").select("contig", (F.col("start0") + F.col("i")).alias("ref_pos"), "ref_base")


_sizes: dict[tuple[str, int], int] = {}


def piece_size(ref: DataFrame) -> int:
    """Length of the longest piece of a reference, looked up once a session: pieces are of one size, but for a contig's last one."""
    key = (ref.sparkSession.sparkContext.applicationId, ref.semanticHash())
    if key not in _sizes:
        _sizes[key] = ref.agg(F.max(F.length("seq"))).first()[0] or 1
    return _sizes[key]


def with_pieces(spans: DataFrame, ref: DataFrame, size: int | None = None) -> DataFrame:
    """spans(contig, start, end, ...) cut at the borders of reference pieces, plus piece_start and piece (upper case); without a piece they are left out. size: piece_size() of the reference, if it is known."""
    size = size or piece_size(ref)
    cut = spans.withColumn("piece_no", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / size))))
    cut = cut.withColumn("start", F.greatest("start", F.col("piece_no") * size)).withColumn("end", F.least("end", (F.col("piece_no") + 1) * size))
    pieces = ref.select("contig", F.floor(F.col("start0") / size).alias("piece_no"), F.col("start0").alias("piece_start"), F.upper("seq").alias("piece"))
    return cut.join(pieces, ["contig", "piece_no"]).drop("piece_no")


CLOSED = "."


def marked_pieces(ref: DataFrame, intervals: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Pieces (contig, start0, seq, open): open is seq (upper case) with CLOSED at positions outside the intervals or within the mask.

    Spans are merged and cut at the borders of pieces, so a piece meets a list of at most half as many as it has bases; marks
    are laid over its text in one fold. Nothing is ever a row a position.
    """
    size = piece_size(ref)

    def of_piece(df: DataFrame, name: str) -> DataFrame:
        spans = I.merge(df.select("contig", "start0", "end0", F.lit("").alias("name"))).filter("end0 > start0")
        cut = spans.select("contig", "start0", "end0", F.explode(F.sequence(F.floor(F.col("start0") / size), F.floor((F.col("end0") - 1) / size))).alias("piece_no"))
        first = F.col("piece_no") * size
        at = (F.greatest("start0", first) - first).cast("int")
        part = F.struct(at.alias("at"), (F.least("end0", first + size) - first - at).cast("int").alias("n"))
        return cut.groupBy("contig", "piece_no").agg(F.collect_list(part).alias(name))

    rows = ref.select("contig", "start0", F.upper("seq").alias("seq"), F.floor(F.col("start0") / size).alias("piece_no"))
    whole = "seq"
    if intervals is not None:
        rows = rows.join(of_piece(intervals, "inside"), ["contig", "piece_no"])  # a piece without intervals has nothing open
        whole = f"aggregate(inside, repeat('{CLOSED}', length(seq)), (s, x) -> overlay(s placing substr(seq, x.at + 1, x.n) from x.at + 1 for least(x.n, length(seq) - x.at)))"
    if mask is not None:
        rows = rows.join(of_piece(mask, "masked"), ["contig", "piece_no"], "left")
        whole = f"aggregate(coalesce(masked, array()), {whole}, (s, x) -> overlay(s placing repeat('{CLOSED}', least(x.n, length(seq) - x.at)) from x.at + 1 for least(x.n, length(seq) - x.at)))"
    return rows.select("contig", "start0", "seq", F.expr(whole).alias("open"))


def aligned_with_reference(reads: DataFrame, keep: list[str], ref: DataFrame) -> DataFrame:
    """One row for each aligned base inside the reference: keep, contig, ref_pos, ref_base. Blocks meet the pieces, and are flattened after it."""
    spans = blocks(reads, keep).filter("len > 0").withColumns({"start": F.col("block_start"), "end": F.col("block_start") + F.col("len")}).select(*keep, "contig", "start", "end")
    under = F.substr("piece", (F.col("start") - F.col("piece_start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    each = with_pieces(spans, ref).select(*keep, "contig", "start", F.posexplode(F.split(under, "")).alias("i", "ref_base"))
    return each.select(*keep, "contig", (F.col("start") + F.col("i")).alias("ref_pos"), "ref_base").filter("ref_base <> ''")


def with_reference(flat: DataFrame, ref: DataFrame, size: int | None = None) -> DataFrame:
    """flat(contig, ref_pos, ...) plus ref_base, and, of marked pieces, open_base; null outside of the reference."""
    size = size or piece_size(ref)
    texts = [c for c in ("seq", "open") if c in ref.columns]
    right = ref.select(F.col("contig").alias("_c"), F.floor(F.col("start0") / size).alias("_piece"), *[F.upper(c).alias(f"_{c}") for c in texts])
    joined = flat.withColumn("_p", F.floor(F.col("ref_pos") / size)).join(right, (F.col("contig") == F.col("_c")) & (F.col("_p") == F.col("_piece")), "left")
    at = (F.col("ref_pos") - F.col("_p") * size + 1).cast("int")
    return joined.withColumns({n: F.substr(f"_{c}", at, F.lit(1)) for c, n in (("seq", "ref_base"), ("open", "open_base")) if c in texts}).drop("_c", "_piece", "_p", *[f"_{c}" for c in texts])


STRETCH, NO_WINDOW = 16_384, 127


def stretch_size(window: int) -> int:
    return max(STRETCH, 2 * window)


def gc_stretches(ref: DataFrame, contigs: DataFrame, window: int, most_n: int = 4) -> DataFrame:
    """(contig, s, gc, windows), a row a stretch of a contig.

    Byte k of gc is the percentage of G and C, rounded down, of the window that starts k bases into the stretch; NO_WINDOW
    where that has more than most_n N or leaves the contig. windows[p] counts the windows of p percent. Pieces, not bases, are dealt by stretch,
    those of the next window - 1 bases to both; windows are differences of running sums of G and C, and of N.
    """
    stretch = stretch_size(window)
    end, c = F.col("start0") + F.length("seq"), F.col
    stretches = F.sequence(F.floor(F.greatest(c("start0") - (window - 1), F.lit(0)) / stretch), F.floor((end - 1) / stretch))
    pieces = ref.filter(F.length("seq") > 0).select("contig", "start0", F.upper("seq").alias("seq"), F.explode(stretches).alias("s"))
    at = F.greatest("start0", c("s") * stretch)
    size = F.least(end, (c("s") + 1) * stretch + window - 1) - at
    parts = pieces.select("contig", "s", F.struct(at.alias("at"), F.substr("seq", (at - c("start0") + 1).cast("int"), size.cast("int")).alias("seq")).alias("part"))
    rows = parts.groupBy("contig", "s").agg(F.sort_array(F.collect_list("part")).alias("parts"))  # bases of one stretch
    rows = rows.join(F.broadcast(contigs.select("contig", "length")), "contig")  # one row a contig
    first, last = c("parts")[0]["at"], F.element_at("parts", -1)
    text = F.array_join(F.transform("parts", lambda x: x["seq"]), "")
    whole = F.when(F.length(text) == last["at"] + F.length(last["seq"]) - first, text).otherwise(F.raise_error(F.concat(F.lit("pieces of the reference leave a gap or overlap in "), c("contig"))))

    @F.pandas_udf("struct<gc:binary,windows:array<bigint>>")
    def percents(seq: pd.Series, skip: pd.Series, start: pd.Series, length: pd.Series) -> pd.DataFrame:
        out = []
        for text, k, at, n in zip(seq, skip, start, length):
            b = np.frombuffer(text.encode(), np.uint8)
            made = np.full(stretch, NO_WINDOW, np.uint8)
            m = min(len(b) - window + 1, n - at - window + 1, stretch - k)
            counts = np.zeros(101, np.int64)
            if m > 0:
                within = [np.concatenate([[0], np.cumsum(x)]) for x in ((b == ord("G")) | (b == ord("C")), b == ord("N"))]
                gc, unknown = (x[window : window + m] - x[:m] for x in within)
                made[k : k + m] = np.where(unknown <= most_n, gc * 100 // window, NO_WINDOW)
                counts = np.bincount(made[made != NO_WINDOW], minlength=101)
            out.append((made.tobytes(), counts))
        return pd.DataFrame(out, columns=["gc", "windows"])

    return rows.select("contig", "s", percents(whole, first - c("s") * stretch, first, "length").alias("w")).select("contig", "s", "w.gc", "w.windows")


def gc_of(start: str, window: int) -> Column:
    """The percentage of the window at a start in its stretch's gc, from one byte of it; NO_WINDOW without one."""
    return F.expr(f"ascii(cast(substring(gc, cast({start} % {stretch_size(window)} as int) + 1, 1) as string))")


def gc_windows(ref: DataFrame, contigs: DataFrame, window: int, most_n: int = 4) -> DataFrame:
    """One row for each window start with at most most_n N: contig, start0, gc (percent, rounded down)."""
    stretch = stretch_size(window)
    each = gc_stretches(ref, contigs, window, most_n).select("contig", "gc", F.explode(F.sequence(F.col("s") * stretch, (F.col("s") + 1) * stretch - 1)).alias("start0"))
    return each.select("contig", "start0", gc_of("start0", window).cast("long").alias("gc")).filter(F.col("gc") <= 100)
