"""Exact line dedup in DataFrame operations only.

Texts are split once: line keys (stripped, A-Z lower-cased) become 128-bit hashes, written with the row and position they
came from. The hashes are dealt by range, sorted by document and position within a hash, and each task streams its sorted
run: first occurrences of a document count it, the largest document keeps its lines. A hash with more lines than a quarter
of a task's share is dealt into several slots by document (there are at most four such hashes a task, so their list is
broadcast); what its slots find is added up, one row a slot. The lines that stay come back as compressed bitmaps, one a
row: 64-bit words of positions, words that lose nothing left out. No text is shuffled until the bitmaps are applied.

A row is known by its id and the hash of its text, so rows may share an id or have none; rows equal in both lose the same
lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACES, ascii_lower, stored

OUT = ["n_lines", "n_dropped", "kept_text"]


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, t, pos, h1, h2) of each line whose key has at least min_chars code points; t is the hash of the row's text."""
    lines = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), F.posexplode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("pos", "line"))
    keys = lines.withColumn("line", F.btrim(F.col("line"), F.lit(SPACES))).filter(F.char_length("line") >= min_chars)
    return keys.select("id", "t", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("2"), "line").alias("h2"))


def dropped_lines(hashes: DataFrame, min_docs: int, slot_lines: int | None = None) -> DataFrame:
    """The rows (id, t, pos) of hashes whose line goes: its hash is in at least min_docs ids, of which this is not the largest."""
    n = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = slot_lines or max(1000, hashes.count() // (4 * n))
    heavy = hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("lines")).filter(F.col("lines") > share)  # less than 4 n rows
    heavy = stored(heavy.select("h1", "h2", F.ceil(F.col("lines") / share).alias("slots")), "heavy")
    place = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("t")).otherwise(F.xxhash64("id")), F.col("slots"))
    dealt = hashes.join(F.broadcast(heavy), ["h1", "h2"], "left").withColumn("slot", F.coalesce(place, F.lit(0)))
    run = dealt.repartitionByRange(n, "h1", "h2", "slot").sortWithinPartitions("h1", "h2", "slot", "id", "t", "pos")

    # Windows over the sorted run: their keys are those of its ranges, so they need no shuffle and no sort.
    sorted_run, whole = W.partitionBy("h1", "h2", "slot").orderBy("id", "t", "pos"), W.partitionBy("h1", "h2", "slot")
    first = F.col("id").isNotNull() & ~F.lag("id").over(sorted_run).eqNullSafe(F.col("id"))
    run = run.withColumn("first", first.cast("int")).withColumns({"docs": F.sum("first").over(whole), "last": F.max("id").over(whole)})
    run = stored(run.filter(F.col("slots").isNotNull() | (F.col("docs") >= min_docs)).drop("first"), "runs")
    added = run.filter("slots IS NOT NULL").groupBy("h1", "h2", "slot").agg(F.max("docs").alias("docs"), F.max("last").alias("last"))
    added = added.groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("last").alias("all_last"))  # less than 4 n rows
    met = run.join(F.broadcast(added), ["h1", "h2"], "left")
    docs, last = F.coalesce("all_docs", "docs"), F.when(F.col("slots").isNull(), F.col("last")).otherwise(F.col("all_last"))
    return met.filter((docs >= min_docs) & ~F.col("id").eqNullSafe(last)).select("id", "t", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, slot_lines: int | None = None) -> DataFrame:
    """(id, t, keep): the lines a row keeps, as array<struct<word, bits>> sorted by word; a word left out keeps all its 64 lines, and a row without entry all lines."""
    gone = dropped_lines(stored(line_hashes(docs, min_chars), "lines"), min_docs, slot_lines)
    words = gone.groupBy("id", "t", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"))
    return words.groupBy("id", "t").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, slot_lines: int | None = None) -> DataFrame:
    """docs plus n_lines, n_dropped and kept_text (the lines that stay, joined by \\n).

    A null or empty text is one empty line. A key found in at least min_docs ids loses its lines in all rows but those of
    the largest id, where even repeats stay. Rows that share an id count as one document, each with its own lines; rows
    without id count as none, and lose the lines that others lose. Keys shorter than min_chars are kept. Columns named like
    an added one are replaced; others may have any name. An empty table gives an empty table.
    """
    docs = docs.drop(*OUT)
    maps = keep_bitmaps(docs, min_chars, min_docs, slot_lines).select(F.col("id").alias("map_id"), F.col("t").alias("map_t"), F.map_from_entries("keep").alias("keep"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"))
    out = rows.join(maps, F.col("id").eqNullSafe(F.col("map_id")) & (F.col("t") == F.col("map_t")), "left")
    out = out.select("row", "keep", F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1).alias("lines"))
    stays = lambda line, i: F.getbit(F.coalesce(F.element_at("keep", F.floor(i / 64).cast("int")), F.lit(-1).cast("long")), i % 64) == 1
    out = out.withColumn("kept", F.when(F.col("keep").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)))
    size = F.size("lines").cast("long")
    new = F.struct(size.alias("n_lines"), (size - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
    return out.select("row", new.alias("new")).select("row.*", "new.*")


def dedup_summary(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """dedup_lines with the text as its SHA-256: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(docs, min_chars, min_docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, row_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), flagged AS (
  SELECT keyed.*, common.k IS NOT NULL AND keyed.doc_id IS DISTINCT FROM common.last AS gone FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id, row_id
"""
