"""Benchmark decontamination by CGK random walks, bit-sampling LSH over windows and exact edit distance.

Texts are words (A-Z lower-cased, outer punctuation stripped) numbered by the vocabulary of the items; other words are 0.
1. Items of nearly one size (RATIO) share a shelf. A window of a document can hold an item of n words within d edits only
   if n - 1 - 2 d of its pairs of neighbours are pairs of the shelf's items (each edit breaks two; where that is no bound,
   n - d of its words). Running sums tell which windows do, at every word; no match is lost here.
2. A CGK walk reads such a window: each step writes the word at the pointer and moves the pointer on or not, by a hash of
   (walk, step, word). Texts of small edit distance so become sequences of small Hamming distance, since walks that an edit
   has parted meet again. Windows have the shelf's size; beyond it and beyond the document walks read 0.
3. A key is made of SAMPLED steps of a walk, drawn at random over the whole walk; each repetition has a walk and steps of
   its own. How many are needed for the recall asked for, at the full number of edits, is worked out by shelf from walks
   over copies edited in several ways (``repetitions``).
4. A window with a key of an item stays if at least n - d words and n - 1 - 2 d pairs around it are the item's own. There the
   edit distance of the item to the best window from every start is worked out: contaminated if it is at most d.

Documents within the tolerance are found with probability ``recall`` at least at d edits, and with more at fewer; exact copies
always. Tolerances of 0.3 and more can take thousands of repetitions for some sizes, so they get slow, not less complete.
The items are collected in blocks of at most ``max_items`` items and about ``max_words`` words; further blocks take
further passes over the documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_count

OUT = ["item_id", "distance", "item_words", "start_word"]
STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CHUNK, CELLS = 1 << 18, 1 << 17
RATIO, LONG = 1.1, 256
SAMPLED, MOST = (3, 2, 1), 160
KINDS = ("scattered", "even", "mixed", "cut", "put")
STEP, MOVE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(STRIP) for x in text.lower().split()) if w]


class Numbers(dict):
    """Word (raw, lower-cased) to number in the vocabulary; -1 for tokens without a word, 0 for others. Remembers what it has looked up."""

    def __init__(self, vocabulary: dict[bytes, int], limit: int = 300_000):
        super().__init__(vocabulary)
        self.vocabulary, self.limit = vocabulary, limit + len(vocabulary)

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.update(self.vocabulary)
        w = raw.strip(STRIP)
        self[raw] = n = self.vocabulary.get(w, 0) if w else -1
        return n


def distances(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edit distance between item and any text[s:e], for each s from 0 to len(text). Row by row from the end, vectorised over the text."""
    back = text[::-1]
    row = np.zeros(len(text) + 1, np.int64)
    ramp = np.arange(len(text) + 1)
    for i, w in enumerate(item[::-1], 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (back != w))
        row = np.minimum.accumulate(new - ramp) + ramp
    return row[::-1]


def edit_distance(item: np.ndarray, text: np.ndarray, most: int) -> int:
    """Least edit distance between item and any prefix of text; most + 1 if above."""
    return min(int(distances(item, text[: len(item) + most])[0]), most + 1)


def edited(words: int, edits: int, kind: str, rng: np.random.Generator) -> np.ndarray:
    """The words 1 to ``words`` after so many edits of a kind; words put in are new."""
    text = list(range(1, words + 1))
    new = iter(range(words + 1, words + 1 + edits))
    if kind in ("cut", "put"):
        at = int(rng.integers(0, words - edits + 1))
        text[at : at + (edits if kind == "cut" else 0)] = [] if kind == "cut" else list(new)
        return np.array(text, np.int32)
    places = np.linspace(0, words - 1, edits).astype(int) if kind == "even" else np.sort(rng.choice(words, edits, replace=False))
    for at in places[::-1].tolist():
        act = int(rng.integers(3)) if kind == "mixed" else 0
        text[at : at + (act != 1)] = [next(new)] if act != 2 else []
    return np.array(text, np.int32)


def walk(mixed: np.ndarray, tokens: np.ndarray, start: np.ndarray, lower: np.ndarray, upper: np.ndarray, seeds: np.ndarray, steps: int):
    """Yields, step by step, what the walk of each seed writes in each window: the mixed word at its pointer, that of 0 outside lower and upper."""
    place = start[:, None] + np.arange(steps)
    inside = (place >= lower[:, None]) & (place < upper[:, None])
    windows = mixed[np.where(inside, tokens[np.clip(place, 0, len(tokens) - 1)], 0)].ravel()
    at = np.repeat((np.arange(len(start)) * steps)[:, None], len(seeds), axis=1)
    for t in range(steps):
        out = windows.take(at)
        yield out
        salt = (seeds + np.uint64((t + 1) * int(STEP) % (1 << 64))) * MOVE
        salt ^= salt >> np.uint64(31)
        move = out ^ salt
        move *= MOVE
        move >>= np.uint64(63)
        at += move.view(np.int64)


def repetitions(words: int, edits: int, recall: float) -> tuple[int, int]:
    """(sampled steps a key, repetitions) by which a window of so many words with so many edits is found with the recall asked for.

    Walks over edited copies, of each kind in KINDS, tell in which share f of their steps they agree with the item's; m
    sampled steps all agree with probability f ** m. The kind found worst decides. More steps a key are better as long as
    they need less than MOST repetitions; single steps take what they need. Long items behave as ones of LONG words.
    """
    if not edits:
        return SAMPLED[0], 1
    if words > LONG:
        words, edits = LONG, -(-edits * LONG // words)
    rng, steps = np.random.default_rng(7), _steps(words)
    seeds = rng.integers(0, 1 << 63, 24, dtype=np.uint64)
    item = np.arange(1, words + 1, dtype=np.int32)
    mixed = rng.integers(0, 1 << 63, words + edits + 2, dtype=np.uint64)
    zero, full = np.zeros(1, np.int64), np.array([words])
    shares = []
    for kind in KINDS:
        copies = [edited(words, edits, kind, rng) for _ in range(20)]
        begin = np.cumsum([0, *(len(c) for c in copies)])
        back = np.unique(np.linspace(0, edits, 4).astype(int))  # windows that begin up to ``edits`` words before the copy
        start = (begin[:-1, None] - back).ravel()
        lower, upper = np.repeat(begin[:-1], len(back)), np.minimum(start + words, np.repeat(begin[1:], len(back)))
        pairs = zip(walk(mixed, np.concatenate(copies), start, lower, upper, seeds, steps), walk(mixed, item, zero, zero, full, seeds, steps), strict=True)
        agree = sum((a == b).astype(np.float64) for a, b in pairs) / steps
        shares.append(agree.reshape(len(copies), len(back), len(seeds)).max(axis=1))
    for m in SAMPLED:
        hit = np.maximum([(s**m).mean(axis=1) for s in shares], 1 / (2 * len(seeds) * steps))  # by kind and copy, for one repetition
        n = 1
        while ((1 - hit) ** n).mean(axis=1).max() > 1 - recall and (n < MOST or m == SAMPLED[-1]):
            n += 1
        if n < MOST:
            break
    return m, n


def _steps(words: int) -> int:
    """Steps of a walk that stays within the window nearly always: one step in two moves on."""
    return max(1, words * 3 // 2)


def _distinct(kinds: np.ndarray, start: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Distinct rows (item, start, document) by item, document and start."""
    if not len(kinds):
        return np.zeros((0, 3), np.int64)
    least, n = start.min(), docs.max() + 1
    span = start.max() - least + 1
    code = np.unique((kinds * n + docs) * span + (start - least))
    return np.stack([code // span // n, code % span + least, code // span % n], 1)


class Shelf:
    """Items of nearly one size: the windows that may hold one, and the keys of their walks."""

    def __init__(self, number: int, items: list[tuple[int, np.ndarray, int]], mixed: np.ndarray, recall: float):
        sizes = [len(t) for _, t, _ in items]
        self.words, self.most = min(sizes), max(m for *_, m in items)
        self.bit, self.span = np.uint64(number % 64), max(sizes) + 2 * self.most
        pairs = min(n - 1 - 2 * m for n, (*_, m) in zip(sizes, items, strict=True))
        self.pairs, self.need = pairs > 0, pairs if pairs > 0 else min(n - m for n, (*_, m) in zip(sizes, items, strict=True))
        self.sampled, self.repeats = repetitions(self.words, self.most, recall)
        rng = np.random.default_rng([5, number])
        self.seeds = rng.integers(0, 1 << 63, self.repeats, dtype=np.uint64)
        picks = rng.integers(0, _steps(self.words), (self.repeats, self.sampled))
        self.at = [np.flatnonzero((picks == t).any(axis=1)) for t in range(int(picks.max()) + 1)]
        keys, kinds = [], []
        for k, t, _ in items:
            keys.append(self.keys(mixed, t, *(np.array([x]) for x in (0, 0, self.words))).ravel())
            kinds.append(np.full(self.repeats, k))
        keys, kinds = np.concatenate(keys), np.concatenate(kinds)
        order = np.argsort(keys, kind="stable")
        self.codes, self.first = np.unique(keys[order], return_index=True)
        self.first, self.kinds = np.append(self.first, len(keys)), kinds[order]

    def keys(self, mixed, tokens, start, lower, upper) -> np.ndarray:
        """One key a window and repetition, of the words at the sampled steps."""
        out = np.repeat(self.seeds[None, :], len(start), axis=0)
        for here, words in zip(self.at, walk(mixed, tokens, start, lower, upper, self.seeds, len(self.at))):
            if len(here):
                out[:, here] = out[:, here] * STEP + words[:, here]
        return out

    def starts(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """(starts, documents) of windows with enough marked places; sums are those before each place. A window may begin ``most`` words before its document."""
        last = len(sums) - 1
        found = np.flatnonzero(sums[np.minimum(np.arange(last) + self.span, last)] - sums[:-1] >= self.need)
        before = begin[:, None] - np.arange(1, self.most + 1)
        early = sums[np.clip(before + self.span, begin[:, None], end[:, None])] - sums[begin][:, None] >= self.need
        docs = np.concatenate([np.searchsorted(end, found, "right"), np.nonzero(early)[0]])
        return np.concatenate([found, before[early]]), docs

    def places(self, mixed, tokens, start, docs, begin, end):
        """(item, start, document) where a window has a key of an item."""
        size = max(1, CELLS // self.repeats)
        for lo in range(0, len(start), size):
            s, d = start[lo : lo + size], docs[lo : lo + size]
            keys = self.keys(mixed, tokens, s, begin[d], np.minimum(s + self.words, end[d]))
            i = np.minimum(np.searchsorted(self.codes, keys), len(self.codes) - 1)
            w, r = np.nonzero(self.codes[i] == keys)
            i = i[w, r]
            n = self.first[i + 1] - self.first[i]
            entry = np.repeat(self.first[i] - np.cumsum(n) + n, n) + np.arange(n.sum())
            w = np.repeat(w, n)
            yield _distinct(self.kinds[entry], s[w], d[w])


class Index:
    """Items on shelves by size, and of each word and pair of neighbours the shelves (as bits) whose items have it."""

    def __init__(self, items: list[tuple[int, np.ndarray]], words: int, tolerance: float, recall: float):
        self.items, self.words = items, words
        self.most = [max(0, math.floor(tolerance * len(t) + 1e-9)) for _, t in items]
        self.mixed = np.random.default_rng(5).integers(0, 1 << 63, words, dtype=np.uint64)
        by: dict[int, list[tuple[int, np.ndarray, int]]] = {}
        for k, ((_, t), m) in enumerate(zip(items, self.most, strict=True)):
            by.setdefault(int(math.log(len(t)) / math.log(RATIO) + 1e-9), []).append((k, t, m))
        self.shelves = [Shelf(j, by[g], self.mixed, recall) for j, g in enumerate(sorted(by))]
        places = max(1 << 10, 8 * sum(len(t) for _, t in items))
        self.shift = np.uint64(64 - places.bit_length())
        self.of_word, self.of_pair = np.zeros(words, np.uint64), np.zeros(1 << places.bit_length(), np.uint64)
        for shelf, g in zip(self.shelves, sorted(by), strict=True):
            mark = np.uint64(1) << shelf.bit
            for _, t, _ in by[g]:
                self.of_word[t] |= mark
                self.of_pair[self._pair(t) >> self.shift] |= mark

    def _pair(self, tokens: np.ndarray) -> np.ndarray:
        """A hash of each word and the next one."""
        x = self.mixed[tokens]
        return (x[:-1] * STEP + x[1:]) * MOVE

    def places(self, tokens: np.ndarray, begin: np.ndarray, end: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Rows (item, start, document) of all windows found by a key."""
        found = [np.zeros((0, 3), np.int64)]
        word = self.of_word[tokens]
        pairs = self._pair(tokens) if pairs is None else pairs
        pair = np.append(np.where((tokens[1:] > 0) & (tokens[:-1] > 0), self.of_pair[pairs >> self.shift], np.uint64(0)), np.uint64(0))
        pair[end[end > begin] - 1] = 0
        sums = lambda marked: np.concatenate([[0], np.cumsum(marked, dtype=np.int32)])
        every = {True: sums(pair > 0), False: sums(word > 0)}
        for shelf in self.shelves:
            if len(shelf.starts(every[shelf.pairs], begin, end)[0]):
                own = sums(((pair if shelf.pairs else word) >> shelf.bit) & np.uint64(1))
                start, docs = shelf.starts(own, begin, end)
                found += shelf.places(self.mixed, tokens, start, docs, begin, end)
        return np.concatenate(found)

    def search(self, tokens: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """(document, item, distance, start) of the matches; document d is tokens[begin[d]:end[d]]."""
        pairs = self._pair(tokens)
        found = _distinct(*self.places(tokens, begin, end, pairs).T)
        pairs = np.append(pairs >> np.uint64(48), np.uint64(0))
        own, own_pairs = np.zeros(self.words, bool), np.zeros(1 << 16, bool)
        cuts = np.flatnonzero(np.diff(found[:, 0], prepend=-1, append=-1)) if len(found) else ()
        for lo, hi in zip(cuts, cuts[1:]):
            k = int(found[lo, 0])
            text, most = self.items[k][1], self.most[k]
            at, doc = found[lo:hi, 1], found[lo:hi, 2]
            own[text] = True
            own_pairs[marks := self._pair(text) >> np.uint64(48)] = True
            around = np.arange(-most, len(text) + most)
            enough = []
            for rows in np.array_split(np.arange(len(at)), len(at) * len(around) // CELLS + 1):
                x = at[rows][:, None] + around
                first, after = begin[doc[rows]][:, None], end[doc[rows]][:, None]
                inside, x = (x >= first) & (x < after), np.clip(x, 0, len(tokens) - 1)
                words = (own[tokens[x]] & inside).sum(axis=1) >= len(text) - most
                whole = inside[:, :-1] & inside[:, 1:]
                enough.append(words & ((own_pairs[pairs[x[:, :-1]]] & whole).sum(axis=1) >= len(text) - 1 - 2 * most))
            own[text] = own_pairs[marks] = False
            enough = np.flatnonzero(np.concatenate(enough))
            order = enough[np.lexsort((at[enough], doc[enough]))]
            at, doc = at[order], doc[order]
            apart = np.flatnonzero((np.diff(at) > 2 * most) | (np.diff(doc) > 0)) + 1
            for group, docs in zip(np.split(at, apart), np.split(doc, apart), strict=True):
                if not len(group):
                    continue
                d = int(docs[0])
                first, last = max(group[0] - 2 * most, begin[d]), min(group[-1] + 2 * most, end[d] - 1)
                if first <= last:
                    near = distances(text, tokens[first : min(last + len(text) + most, end[d])])[: last - first + 1]
                    s = int(near.argmin())
                    if near[s] <= most:
                        yield d, k, int(near[s]), int(first - begin[d]) + s


def index_of(items: list[tuple[int, bytes]], tolerance: float, recall: float = 0.999):
    """(vocabulary, index); items without words are left out."""
    split = [(i, words_of(t)) for i, t in items]
    split = [(i, w) for i, w in split if w]
    vocabulary: dict[bytes, int] = {}
    for _, ws in split:
        for w in ws:
            vocabulary.setdefault(w, len(vocabulary) + 1)
    return vocabulary, Index([(i, np.array([vocabulary[w] for w in ws], np.int32)) for i, ws in split], len(vocabulary) + 1, tolerance, recall)


def contaminated(docs: DataFrame, items: DataFrame, tolerance: float = 0.15, recall: float = 0.999, max_items: int = 20_000, max_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, distance, item_words, start_word): for each document and item the best match within the tolerance, the first if tied.

    Null texts and wordless texts and items match nothing; rows that share an id count as one document; rows without id
    are reported under null. Any other columns are ignored. Items beyond max_items or max_words are taken in further passes.
    """
    if not 0 <= tolerance < 1:
        raise ValueError("tolerance must be from 0 to below 1")
    if not 0 < recall < 1:
        raise ValueError("recall must be above 0 and below 1")
    spark = docs.sparkSession
    every = items.select("item_id", F.col("text").cast("binary").alias("b")).filter("item_id IS NOT NULL AND b IS NOT NULL")
    size = every.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(word_count(F.col("b").cast("string"))), F.lit(0)).alias("w")).first()
    passes = max(1, math.ceil(size.n / max_items), math.ceil(size.w / max_words))
    out = None
    for k in range(passes):
        block = every.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) if passes > 1 else every
        shared = spark.sparkContext.broadcast(index_of([(r.item_id, bytes(r.b)) for r in block.collect()], tolerance, recall))
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("b")).filter("b IS NOT NULL").mapInArrow(_finder(shared), "doc_id long, item_id long, distance int, item_words int, start_word long")
        out = found if out is None else out.union(found)
    best = F.min(F.struct("distance", "start_word", "item_words")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.distance", "m.item_words", "m.start_word")


def _finder(shared):
    def work(batches):
        vocabulary, index = shared.value
        numbers = Numbers(vocabulary)
        look = numbers.__getitem__
        for batch in batches:
            got = []
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("b").to_pylist()
            lo = 0
            while lo < len(ids) and index.items:
                arrays, bounds, size = [], [], 0
                hi = lo
                while hi < len(ids) and (hi == lo or size < CHUNK):
                    raw = texts[hi].lower().split()
                    a = np.fromiter(map(look, raw), np.int32, count=len(raw))
                    a = a[a >= 0]
                    bounds.append((size, size + len(a)))
                    arrays.append(a)
                    size += len(a)
                    hi += 1
                tokens = np.concatenate([*arrays, np.zeros(1, np.int32)])
                begin, end = np.array(bounds).T
                for d, k, distance, start in index.search(tokens, begin, end):
                    item, text = index.items[k]
                    got.append((ids[lo + d], item, distance, len(text), start))
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["doc_id", "item_id", "distance", "item_words", "start_word"])

    return work


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs whose id matches no item; rows without id go only if one of them matches. Columns as given."""
    hit = contaminated(docs, items, **options).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
