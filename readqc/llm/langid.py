"""Language ID by prediction by partial matching (PPM).

Each language has a variable-order context tree over the 256 byte values: counts of the byte after each context of 0 to
``order`` bytes. A byte costs -log2 of its share in the longest context where it was seen; each longer context that was
seen at all but not with this byte charges its escape probability, distinct / (total + distinct); below order 0 a byte
costs 8 bits. Order and alphabet are the same for any number of languages.

Training counts (language, ORDER + 1 bytes) in Spark, over all rows, and derives the costs of every order from these
counts by aggregations. The statistics are frozen, so a model is a sparse sorted table of grams and costs a language and
order. Tables are dealt into units by language and, where a language is larger than ``max_entries``, by ranges of the byte
that is predicted; units are packed into passes of at most ``max_entries`` entries (besides the contexts of their
languages), which bounds what a broadcast holds. One pass scores all texts where they are read; with several passes each
sums its part of the code lengths of the same rows, so lengths do not depend on the number of passes.

The language of the shortest code wins, ties go to the smaller name, and the score is its posterior share.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, remainder, stored

OUT = ["lang_pred", "score", "code_bits"]
ORDER = 3
PIECE = 1 << 20
_LETTER = re.compile(rb"[A-Za-z]")


def grams(texts: list[bytes], piece: int = PIECE):
    """Yields (codes, which, s, e): the ORDER + 1 bytes up to each position of the joined texts as a number, piece by piece, and the spans [s, e) of codes that belong to text which. ORDER spaces stand before each text."""
    gap = b" " * ORDER
    joined = np.frombuffer(gap + gap.join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = ORDER + np.concatenate([[0], np.cumsum(sizes + ORDER)])[:-1] if len(texts) else np.zeros(0, np.int64)
    ends = starts + sizes
    for lo in range(ORDER, len(joined), piece):
        hi = min(len(joined), lo + piece)
        code = np.zeros(hi - lo, dtype=np.uint32)
        for k in range(ORDER, -1, -1):
            code = (code << np.uint32(8)) | joined[lo - k : hi - k]
        a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
        which = np.arange(a, b)
        s, e = np.maximum(starts[a:b], lo) - lo, np.minimum(ends[a:b], hi) - lo
        some = e > s
        yield code, which[some], s[some], e[some]


def span_sums(values: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Sums of values[s:e] for disjoint, rising spans."""
    cuts = np.stack([s, e], 1).ravel()
    if len(cuts) and cuts[-1] == len(values):
        cuts = cuts[:-1]
    return np.add.reduceat(values, cuts, axis=0)[::2]


def batches_of(texts: list[bytes], most: int = 2 * PIECE):
    """(first, texts) of runs of a few megabytes."""
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held < most):
            held += len(texts[hi])
            hi += 1
        yield lo, texts[lo:hi]
        lo = hi


class Tables:
    """The costs of some languages, and of the predicted bytes below ``last`` and from ``first`` up: grams[k] and contexts[k] are, a language, sorted codes and bits."""

    def __init__(self, langs: list[int], first: int, last: int, grams, contexts):
        self.langs, self.first, self.last, self.grams, self.contexts = langs, first, last, grams, contexts

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """(codes, languages) bits; 0 where the predicted byte is outside the range."""
        out = np.zeros((len(codes), len(self.langs)), np.float64)
        byte = codes & np.uint32(255)
        mine = np.arange(len(codes)) if (self.first, self.last) == (0, 256) else np.flatnonzero((byte >= self.first) & (byte < self.last))
        for j in range(len(self.langs)):
            left = mine
            for k in range(ORDER, -1, -1):
                mask = np.uint32((1 << 8 * (k + 1)) - 1)
                cost, seen = _look(self.grams[j][k], codes[left] & mask)
                out[left[seen], j] += cost[seen]
                left = left[~seen]
                if not len(left):
                    break
                escape, _ = _look(self.contexts[j][k], (codes[left] & mask) >> np.uint32(8))
                out[left, j] += escape
            else:
                out[left, j] += 8.0
        return out


def _look(table, codes: np.ndarray):
    """(bits, whether found) of each code."""
    keys, bits = table
    if not len(keys):
        return np.zeros(len(codes)), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    seen = keys[at] == codes
    return np.where(seen, bits[at], 0.0), seen


class Known:
    """Costs of grams, looked up once: the commonest grams recur in every text."""

    def __init__(self, tables: Tables, limit: int = 1 << 19):
        self.tables, self.limit = tables, limit
        self.codes, self.bits = np.zeros(0, np.uint32), np.zeros((0, len(tables.langs)))

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """Bits of sorted distinct codes."""
        at = np.searchsorted(self.codes, codes)
        if len(self.codes):
            held = self.codes[np.minimum(at, len(self.codes) - 1)] == codes
        else:
            held = np.zeros(len(codes), bool)
        out = np.empty((len(codes), len(self.tables.langs)))
        out[held] = self.bits[at[held]]
        new = ~held
        if new.any():
            out[new] = self.tables.costs(codes[new])
            if len(self.codes) + new.sum() > self.limit:
                self.codes, self.bits = codes, out.copy()
            else:
                self.bits = np.insert(self.bits, at[new], out[new], axis=0)
                self.codes = np.insert(self.codes, at[new], codes[new])
        return out


class Model:
    """langs, and one broadcast of Tables a pass."""

    def __init__(self, langs: list[str], passes: list):
        self.langs, self.passes = langs, passes


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, code, n): how often ORDER + 1 bytes end at a position of labelled(text, lang), nulls left out."""

    def count(batches):
        for batch in pieces(batches, 2048):
            by: dict[str, list[bytes]] = {}
            for lang, b in zip(batch.column("lang").to_pylist(), batch.column("b").to_pylist(), strict=True):
                by.setdefault(lang, []).append(b)
            for lang, texts in by.items():
                for _, part in batches_of(texts, 8 * PIECE):
                    codes, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
                    for code, _, s, e in grams(part):
                        mark = np.zeros(len(code) + 1, np.int8)
                        mark[s] += 1
                        mark[e] -= 1
                        u, c = np.unique(code[np.cumsum(mark[:-1]) > 0], return_counts=True)
                        both, back = np.unique(np.concatenate([codes, u]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([n, c]), len(both)).astype(np.int64)
                        codes = both
                    if not len(codes) and texts:  # a language of empty texts is a language
                        codes, n = np.zeros(1, np.uint32), np.zeros(1, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.col("text").cast("binary").alias("b"))
    return rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def cost_table(counts: DataFrame) -> DataFrame:
    """(lang, k, kind, code, bits): costs of the grams seen (kind g: the context's k bytes and the predicted one) and escapes of their contexts (kind c)."""
    out = None
    for k in range(ORDER + 1):
        of_k = counts.filter("n > 0").groupBy("lang", (F.col("code") % (1 << 8 * (k + 1))).alias("code")).agg(F.sum("n").cast("double").alias("n"))
        context = of_k.groupBy("lang", F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("d"))
        bits = of_k.withColumn("context", F.shiftright("code", 8)).join(context, ["lang", "context"]).select("lang", F.lit(k).alias("k"), F.lit("g").alias("kind"), "code", F.log2((F.col("t") + F.col("d")) / F.col("n")).alias("bits"))
        escape = context.select("lang", F.lit(k).alias("k"), F.lit("c").alias("kind"), F.col("context").alias("code"), F.log2((F.col("t") + F.col("d")) / F.col("d")).alias("bits"))
        bits = bits.union(escape)
        out = bits if out is None else out.union(bits)
    return out


def _packed(sizes: dict[tuple[str, int], int], langs: list[str], most: int) -> list[list[tuple[str, int, int]]]:
    """Passes of (language, first byte, last byte + 1). A pass is several whole languages, or one range of one language."""
    passes, room = [], 0
    for lang in langs:
        per = [sizes.get((lang, b), 0) for b in range(256)]
        if sum(per) <= most:
            if not passes or room < sum(per):
                passes.append([])
                room = most
            passes[-1].append((lang, 0, 256))
            room -= sum(per)
            continue
        lo = 0
        while lo < 256:
            hi, n = lo + 1, per[lo]
            while hi < 256 and n + per[hi] <= most:
                n += per[hi]
                hi += 1
            passes.append([(lang, lo, hi)])
            lo, room = hi, 0
    return passes


def train(labelled: DataFrame, max_entries: int = 1 << 21) -> Model | None:
    """The model of labelled(text, lang), all rows without nulls counted; None without rows. Repeated rows count as often as they are there."""
    spark = labelled.sparkSession
    counts = stored(gram_counts(labelled), "grams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())  # one row a language
    if not langs:
        return None
    table = stored(cost_table(counts), "costs")
    seen = table.filter("kind = 'g'").groupBy("lang", (F.col("code") % 256).alias("b")).count().collect()  # 256 rows a language
    passes = []
    for units in _packed({(r.lang, r.b): r["count"] for r in seen}, langs, max_entries):
        names, first, last = [u[0] for u in units], units[0][1], units[0][2]
        byte = F.col("code") % 256
        mine = table.filter(F.col("lang").isin(names) & ((F.col("kind") == "c") | ((byte >= first) & (byte < last))))
        got = mine.select(F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]), F.col("lang")).alias("j"), "k", (F.col("kind") == "g").alias("g"), "code", "bits").toArrow()
        j, k, g, code, bits = (got[c].to_numpy() for c in ("j", "k", "g", "code", "bits"))

        def picked(i, level, gram):
            at = np.flatnonzero((j == i) & (k == level) & (g == gram))
            at = at[np.argsort(code[at])]
            return code[at].astype(np.uint32), bits[at]

        one = [[[picked(i, level, gram) for level in range(ORDER + 1)] for i in range(len(names))] for gram in (True, False)]
        passes.append(spark.sparkContext.broadcast(Tables([langs.index(n) for n in names], first, last, *one)))
    return Model(langs, passes)


def _lengths(shared, n_langs: int, text_column: str):
    """Adds to each batch the list of code lengths by language, of this pass; null where no language is told."""

    def work(batches):
        tables = shared.value
        known = Known(tables)
        for batch in pieces(batches):
            raw = batch.column(text_column).to_pylist()
            ok = np.array([b is not None and (_LETTER.search(b) is not None or any(map(str.isalpha, b.decode("utf-8", "replace")))) for b in raw], dtype=bool)
            texts = [b if fine else b"" for b, fine in zip(raw, ok, strict=True)]
            sums = np.zeros((len(texts), n_langs))
            for lo, part in batches_of(texts):
                for code, which, s, e in grams(part):
                    if len(which):
                        u, back = np.unique(code, return_inverse=True)
                        bits = known(u)
                        for j, lang in enumerate(tables.langs):
                            sums[lo + which, lang] += span_sums(bits[:, j][back], s, e)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * n_langs, pa.int32()), pa.array(sums.ravel()), mask=pa.array(~ok))
            cols = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != text_column]
            yield pa.RecordBatch.from_arrays([*cols, lists], names=[*(c for c in batch.schema.names if c != text_column), "sums"])

    return work


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs plus lang_pred, score and code_bits (the winner's code length). ``und``, 0 and null where the text is null or has no letter, or without a model. Columns of docs named like an added one are replaced; others may have any name."""
    docs = docs.drop(*OUT)
    row = docs.select(F.struct("*").alias("row"), F.col("text").cast("binary").alias("bytes"))
    kind = T.StructType([*row.select("row").schema.fields, T.StructField("sums", T.ArrayType(T.DoubleType()))])
    if model is None:
        scored = row.select("row", F.lit(None).cast("array<double>").alias("sums"))
    elif len(model.passes) == 1:
        scored = row.mapInArrow(_lengths(model.passes[0], len(model.langs), "bytes"), kind)
    else:  # the rows are written with a number, by which the parts of all passes meet
        row = stored(row.withColumn("id", F.monotonically_increasing_id()), "rows")
        parts = None
        for p in model.passes:
            part = row.select("id", "bytes").mapInArrow(_lengths(p, len(model.langs), "bytes"), "id long, sums array<double>")
            parts = part if parts is None else parts.union(part)
        total = parts.groupBy("id").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(len(model.langs))])
        sums = F.when(F.col("s0").isNotNull(), F.array(*[f"s{i}" for i in range(len(model.langs))]))
        scored = row.select("row", "id").join(total, "id").select("row", sums.alias("sums"))
    langs = F.array(*map(F.lit, model.langs)) if model else F.array().cast("array<string>")
    least = F.array_min("sums")
    share = 1 / F.aggregate("sums", F.lit(0.0), lambda s, x: s + F.pow(F.lit(2.0), F.greatest(F.array_min("sums") - x, F.lit(-1000.0))))
    name = F.when(F.col("sums").isNull(), "und").otherwise(F.get(langs, (F.array_position("sums", least) - 1).cast("int")))
    out = F.struct(name.alias("lang_pred"), F.coalesce(share, F.lit(0.0)).alias("score"), least.alias("code_bits"))
    return scored.select("row", out.alias("out")).select("row.*", "out.*")


def identify(docs: DataFrame, folds: int = 4, held: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score and code_bits of every row, learned from text and lang of the rows not held out. A null id is never held out."""
    out = remainder(F.col("doc_id"), folds) == held
    model = train(docs.filter(~out).select("text", "lang"), **options)
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")
