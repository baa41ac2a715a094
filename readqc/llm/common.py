"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import stored

#: ASCII whitespace: the characters \x20 and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def near_ids(df: DataFrame, col: str, ids: DataFrame, most_bits: int = 1 << 29) -> DataFrame:
    """The rows of df whose col is an id of ids (a column "id", no nulls), and a few others: without a shuffle of df.

    Ids set bits of a bitmap under two hashes, 32 bits an id and ``most_bits`` (64 MB) at most, so the broadcast is bounded;
    above that size more other rows pass (0.4 % below it). Callers join the result with their ids anyway.
    """
    bits = min(most_bits, max(1 << 15, 32 * ids.count()))
    place = lambda c, seed: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(bits))
    marks = ids.select(F.explode(F.array(place(F.col("id"), 1), place(F.col("id"), 2))).alias("p")).select(F.shiftright("p", 15).alias("bucket"), (F.col("p") % (1 << 15)).alias("at"))
    table = stored(marks.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bitmap")), "bitmap")
    for seed in (1, 2):
        at = F.col("_p") % (1 << 15)
        byte = F.conv(F.hex(F.substring("_m.bitmap", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        mate = table.select(F.col("bucket").alias("_bucket"), F.struct("bitmap").alias("_m"))
        met = df.select(F.struct("*").alias("_row"), place(F.col(col), seed).alias("_p")).join(F.broadcast(mate), F.shiftright("_p", 15) == F.col("_bucket"))
        df = met.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select("_row.*")
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scaled_vectors(vectors: DataFrame, scale: int, *columns: str) -> DataFrame:
    """The columns and v, floor(scale * x) of each component as int, of the rows whose embedding is not null or empty and holds only finite components."""
    finite = F.forall("_v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is larger than infinity
    rows = vectors.select(*columns, F.col("embedding").cast("array<double>").alias("_v")).filter(F.col("_v").isNotNull() & (F.size("_v") > 0) & finite)
    return rows.select(*columns, F.transform("_v", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def remainder(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 0 + 1, so it is never held out."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(1))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null counts 0."""
    return F.coalesce(F.regexp_count(col, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def pieces(batches, rows: int = 512):
    """The Arrow batches in slices of so many rows, so that a worker holds little at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for the next time; forgets all when it holds ``limit``."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h
