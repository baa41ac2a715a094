"""Near duplicates by bottom-k sketches of one hash function.

1. A document's shingles are hashed once; equal sets form a class, and only its smallest document goes on.
2. A class keeps the k smallest hashes, in order. Inverted lists stand under runs of RUN neighbouring retained values: two
   sets at the threshold of 0.8 agree on each value of their union's sketch with probability 0.8, and miss every run of
   three among forty with a probability below 1e-6. Single values would do, but common shingles make their lists long.
   Sets of up to SMALL shingles use all triples of their prefix, of which two near sets surely share one, with their step
   of size (each also with the next one, so that sets within the ratio meet). Those of them that can be near a larger set
   also stand under their runs: both sketches are whole there, and c common values with d others among them hold
   c - 2 (d + 1) common runs at least, 7 or more across this border, so it survives what the larger set leaves in step 3.
3. Short lists pair all members (at most ``short`` each). A longer list pairs its members with its smallest one; after the
   components of these links are known, the members of lists with several components are joined anew, over components,
   by prefix filtering of their full sets from rare to common shingles. Near sets whose common runs all have long lists share SHARED runs at least (about twenty are expected), so
   documents with fewer long lists leave them, and others stay in all but their SHARED - 1 longest ones. So a list of one big group costs one pair a member.
4. Pairs pass by size and by the overlap in the sketch of the union, then by exact Jaccard of the full sets.

Steps 2 to 4 are exact for sets of up to SMALL shingles. Of larger ones a link of similarity 0.8 is lost with a probability
below 1e-4, in step 3 where all lists of the two are long, and one of higher similarity far more rarely; a link that a
chain of others replaces is lost without effect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, near_ids, pieces, stored
from .components import components

OUT = ["n_shingles", "component_id", "kept"]
RUN, SHARED, SMALL, BEFORE = 3, 3, 20, 16


def shingle_set(text: bytes | None, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles of ``width`` words; fewer words are one shingle, none give none."""
    words = text.lower().split() if text else ()
    if not words:
        return np.zeros(0, np.int64)
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    n = max(1, len(h) - width + 1)
    acc = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for j in range(min(width, len(h))):
        acc = (acc ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((acc ^ (acc >> np.uint64(32))) >> np.uint64(1)).view(np.int64)


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """(id, n, key, sketch) of each row with an id; key identifies the set of shingles, sketch holds its k smallest hashes."""

    def work(batches):
        hashes = WordHashes()
        for batch in pieces(batches):
            sets = [shingle_set(b, hashes, width) for b in batch.column("b").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s[:k] for s in sets], pa.list_(pa.int64()))],
                names=["id", "n", "key", "sketch"],
            )

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("b"))
    return rows.mapInArrow(work, "id long, n long, key binary, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, key, shingles) of the documents in ids, and of a few others: each set of an id once, however many rows hold it."""

    def work(batches):
        hashes = WordHashes()
        for batch in pieces(batches):
            sets = [shingle_set(b, hashes, width) for b in batch.column("b").to_pylist()]
            keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), keys, pa.array(sets, pa.list_(pa.int64()))], names=["id", "key", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("b"))
    return near_ids(rows, "id", ids).mapInArrow(work, "id long, key binary, shingles array<long>").dropDuplicates(["id", "key"])


def list_keys(threshold: int):
    """Keys of the lists in which a sketch stands."""
    x, size = F.col("sketch"), F.size("sketch")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(size - (RUN - 1), F.lit(1))), lambda i: F.xxhash64(*[F.try_element_at(x, (i + j).cast("int")) for j in range(RUN)]))
    # Sets of n values share t = ceil(n * threshold / 100) at least, and three of them among their first n - t + 3.
    first = F.slice(x, F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold / 100) + 3).cast("int"))
    after = lambda i: F.slice(first, i + 2, F.size(first))
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / threshold))) - 1e-9)
    triple = lambda u, v, w: F.array(F.xxhash64(u, v, w, step), F.xxhash64(u, v, w, step + 1))
    triples = F.transform(first, lambda u, i: F.flatten(F.transform(after(i), lambda v, j: F.flatten(F.transform(F.slice(first, i + j + 3, F.size(first)), lambda w: triple(u, v, w))))))
    border = F.col("n") * 100 >= (SMALL + 1) * threshold
    return F.when(F.col("n") > SMALL, runs).when(border, F.concat(F.flatten(triples), runs)).otherwise(F.flatten(triples))


def _alike(threshold: int, k: int):
    """Condition on entries a and b: sizes allow the threshold, and the sketch of the union doesn't speak against it by five standard deviations."""
    j = threshold / 100
    least = max(0.0, j - 5 * (j * (1 - j) / k) ** 0.5)
    a, b = F.col("a.sketch"), F.col("b.sketch")
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    sizes = (F.col("a.n") * 100 >= F.col("b.n") * threshold) & (F.col("b.n") * 100 >= F.col("a.n") * threshold)
    return sizes & (both >= F.size(union) * F.lit(least))


def _confirmed(docs: DataFrame, heads: DataFrame, pairs: DataFrame, width: int, threshold: int, k: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow the threshold and whose full sets reach it."""
    side = lambda name: heads.select(F.col("id").alias(name), F.struct("n", "sketch").alias(name + "_"))
    near = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("a_").alias("a"), F.col("b_").alias("b"))
    pairs = stored(near.filter(_alike(threshold, k)).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = stored(full_sets(docs, ids, width), "sets")
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("_a")), "a")
    inter = F.size(F.array_intersect("_a", "_b"))
    return joined.withColumn("_i", inter).filter(F.col("_i") * 100 >= (F.size("_a") + F.size("_b") - F.col("_i")) * threshold).select("a", "b").distinct()


def _rest(docs: DataFrame, heads: DataFrame, open_ids: DataFrame, width: int, threshold: int, k: int) -> DataFrame:
    """All links between documents of different roots in open_ids(id, root), by prefix filtering of their full sets.

    Shingles are ordered from rare to common among these documents. Of two sets of n values that reach the threshold, the
    first n - ceil(n * threshold / 100) + 1 of each meet in one; what a document alone has takes most of these places.
    """
    sets = stored(full_sets(docs, open_ids.select("id"), width).join(open_ids, "id"), "sets")
    values = sets.select("id", "root", "key", F.size("shingles").alias("n"), F.explode("shingles").alias("v"))
    common = values.groupBy("v").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("r1"), F.max("root").alias("r2")).filter("df > 1").select("v", "df", (F.col("r1") < F.col("r2")).alias("mixed"))
    own = values.join(common, "v").groupBy("id", "root", "key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v", "mixed"))).alias("x"))
    left = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1 - (F.col("n") - F.size("x"))
    own = own.withColumn("first", F.col("n") - F.size("x"))
    placed = F.transform(F.slice("x", 1, F.greatest(left, F.lit(0)).cast("int")), lambda e, i: F.struct(e["v"].alias("v"), e["mixed"].alias("mixed"), i.alias("i")))
    # Each value carries the BEFORE ones that precede it, so that a pair that met in one of them is not made again.
    own = own.select("id", "root", "n", "first", F.filter(placed, lambda e: e["mixed"]).alias("x"))
    seen = lambda i: F.transform(F.slice("x", F.greatest(i - (BEFORE - 1), F.lit(1)), F.least(i, F.lit(BEFORE))), lambda e: e["v"])
    entries = F.transform("x", lambda e, i: F.struct(e["v"].alias("v"), (F.col("n") - F.col("first") - e["i"]).alias("rest"), seen(i).alias("before")))
    lists = stored(own.select("id", "root", "n", F.explode(entries).alias("e")).select("id", "root", "n", "e.*"), "lists")
    # From their first common value on, both must hold as many values as the threshold asks for in common.
    enough = F.least(F.col("a.rest"), F.col("b.rest")) * (100 + threshold) >= (F.col("a.n") + F.col("b.n")) * threshold
    pairs = lists.alias("a").join(lists.alias("b"), (F.col("a.v") == F.col("b.v")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.id") < F.col("b.id")) & enough & ~F.arrays_overlap("a.before", "b.before")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    return _confirmed(docs, heads, pairs, width, threshold, k)


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80, k: int = 40, short: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; two documents are linked if their sets of shingles have 100 * intersection >= threshold * union.

    A null or wordless text has no shingles and no links. Rows with a null id are linked with nothing: n_shingles and
    component_id are null and kept is true. Rows that share an id are one document for links, and equal rows are compared
    once. Other columns are ignored.
    """
    if not 80 <= threshold <= 99:
        raise ValueError("threshold must be from 80 to 99")
    rows = stored(sketches(docs, width, k).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = rows.filter("n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.min_by("row", "id").alias("row"))
    classes = stored(classes, "classes")
    # One row of each class goes on, so that repeated rows don't meet each other in the joins below.
    heads = rows.join(classes.select("row"), "row", "left_semi").select("id", "n", "sketch")

    # Sets of n shingles with 100 * n < threshold * (n + 1) can only be linked with equal ones.
    heads = stored(heads.filter(F.col("n") * 100 >= (F.col("n") + 1) * threshold), "heads")
    entries = heads.select("id", (F.col("n") <= SMALL).alias("few"), F.explode(F.array_distinct(list_keys(threshold))).alias("g"))
    sizes = entries.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("hub")).filter("members > 1")
    lists = stored(entries.join(sizes, "g"), "lists")

    brief = lists.filter(F.col("members") <= short).select("g", "id")
    mates = brief.alias("a").join(brief.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    stars = lists.filter((F.col("members") > short) & (F.col("id") > F.col("hub"))).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    links = stored(_confirmed(docs, heads, mates.union(stars), width, threshold, k), "links")
    roots = components(links, "a", "b")

    own = lists.filter(F.col("members") > short).groupBy("id", "few").agg(F.sort_array(F.collect_list(F.struct("members", "g"))).alias("x"))
    kept = F.when(F.col("few"), F.col("x")).otherwise(F.slice("x", 1, F.greatest(F.size("x") - (SHARED - 1), F.lit(0))))
    long_lists = own.select("id", F.explode(kept).alias("x")).select("id", "x.g").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    long_lists = stored(long_lists, "lists")
    groups = long_lists.groupBy("g", "root").agg(F.count(F.lit(1)).alias("c"))
    most = groups.groupBy("g").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1").drop("groups")
    open_ids = stored(long_lists.join(most, "g").select("id", "root").distinct(), "open")
    more = stored(_rest(docs, heads, open_ids, width, threshold, k), "links")
    if not more.isEmpty():
        roots = components(links.union(more), "a", "b")

    named = classes.select("key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("root", "rep").alias("component_id"))
    # A component's smallest document is the smallest of its classes' smallest ones, which is its root.
    out = rows.drop("sketch", "row").join(named, "key", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nulls = docs.filter(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nulls)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: of each component those of its smallest id, and all rows without id. Columns as given."""
    marks = near_duplicates(docs, **options).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM words
), entries AS (
  SELECT doc_id, unnest(sh) AS v, len(sh) AS n FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM entries a JOIN entries b ON a.v = b.v AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * 100 >= (a.n + b.n - count(*)) * 80
), reach AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.root
)
SELECT sets.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(root) AS component_id, sets.doc_id = min(root) AS kept FROM sets JOIN reach USING (doc_id) GROUP BY sets.doc_id, sh
"""
